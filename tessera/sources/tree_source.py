"""Source trees as a data source: ``spark.read.format("source_tree").option("path", root).load()``, and a stream of changed files.

Columns: path (below the root, with slashes), dir_lower and extension_lower (of the path, in lower case), hidden (a directory of the path
begins with a dot or is a build folder), size, modified, bytes. Only directories down to ``depth`` (2) are listed where the query is
planned; each partition is one of them, or the files right in it, and is walked by the task that reads it. Filters on the other columns
(equality, membership, beginnings, ends and parts of strings, not, bounds of size) are taken over by the source, so a file that they
exclude is never opened, and where they name path, a directory that cannot hold a match is not walked. Files are read in batches of
``batch_bytes`` (64 MB); columns that a query leaves out are not read where bytes is one of them (``.option("bytes", "false")``).

All executors must see the tree under the same path. Names that are no valid text are an error; links are not followed."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith

#: Directories that are build folders wherever they are; directories that a copy of a tree leaves out are not walked at all.
BUILT = ("target", "node_modules")
SCHEMA = "path string, dir_lower string, extension_lower string, hidden boolean, size bigint, modified timestamp, bytes binary"
_COLUMNS = ["path", "dir_lower", "extension_lower", "hidden", "size"]


@dataclass
class Folder(InputPartition):
    """A directory below the root ("" is the root); ``deep``: with all below it, else the files right in it."""

    relative: str
    deep: bool
    since: int = -1
    until: int = 1 << 62

    def __init__(self, relative: str, deep: bool, since: int = -1, until: int = 1 << 62):
        super().__init__((relative, deep))
        self.relative, self.deep, self.since, self.until = relative, deep, since, until


def described(path: str) -> dict[str, Any]:
    """The columns that follow from a path."""
    folder, _, name = path.rpartition("/")
    parts = folder.split("/") if folder else []
    return {"path": path, "dir_lower": folder.lower(), "extension_lower": name.rpartition(".")[2].lower() if "." in name else "", "hidden": any(p.startswith(".") or p in BUILT for p in parts)}


def passes(filter_: Filter, row: dict[str, Any]) -> bool:
    if isinstance(filter_, Not):
        return not passes(filter_.child, row)
    if isinstance(filter_, IsNotNull):
        return True
    value = row[filter_.attribute[0]]
    match filter_:
        case EqualTo():
            return value == filter_.value
        case In():
            return value in filter_.value
        case StringStartsWith():
            return value.startswith(filter_.value)
        case StringEndsWith():
            return value.endswith(filter_.value)
        case StringContains():
            return filter_.value in value
        case GreaterThan():
            return value > filter_.value
        case GreaterThanOrEqual():
            return value >= filter_.value
        case LessThan():
            return value < filter_.value
        case LessThanOrEqual():
            return value <= filter_.value
    raise TypeError(filter_)


def understood(filter_: Filter) -> bool:
    """Filters that ``passes`` decides as Spark would: no column here but bytes and modified is ever null."""
    if isinstance(filter_, Not):
        return understood(filter_.child)
    if isinstance(filter_, IsNotNull):
        return filter_.attribute != ("bytes",)
    kinds = (EqualTo, In, StringStartsWith, StringEndsWith, StringContains, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)
    if not isinstance(filter_, kinds) or filter_.attribute not in [(c,) for c in _COLUMNS]:
        return False
    values = filter_.value if isinstance(filter_, In) else (filter_.value,)
    return all(v is not None for v in values)


class Tree:
    """What reads have in common."""

    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.depth, self.batch = int(options.get("depth", 2)), int(options.get("batch_bytes", 64 << 20))
        self.with_bytes = options.get("bytes", "true").lower() == "true"
        self.filters: list[Filter] = []

    def folders(self, since: int = -1, until: int = 1 << 62) -> list[Folder]:
        if not os.path.isdir(self.root):
            raise FileNotFoundError(f"not a directory: {self.root}")
        found, level = [], [""]
        for depth in range(self.depth + 1):
            below = []
            for folder in level:
                deep = depth == self.depth
                if self._may_hold(folder, deep):
                    found.append(Folder(folder, deep, since, until))
                if not deep:
                    with os.scandir(os.path.join(self.root, folder)) as entries:
                        below += [f"{folder}/{e.name}".lstrip("/") for e in entries if e.is_dir(follow_symlinks=False)]
            level = sorted(below)
        return found

    def _may_hold(self, folder: str, deep: bool) -> bool:
        """Whether files of the folder can pass the filters on directories."""
        row = described(f"{folder}/x" if folder else "x")
        for f in self.filters:
            if isinstance(f, Not) and isinstance(f.child, StringContains) and f.child.attribute == ("dir_lower",) and not passes(f, row):
                return False  # what is below contains it too
            if f == EqualTo(("hidden",), False) and row["hidden"]:
                return False
            if isinstance(f, StringStartsWith) and f.attribute == ("path",):
                head = f"{folder}/" if folder else ""
                rest = f.value[len(head) :] if f.value.startswith(head) else None
                if not head.startswith(f.value) and (rest is None or not deep and "/" in rest):
                    return False
        return True

    def files(self, partition: Folder) -> Iterator[tuple[dict[str, Any], str, os.stat_result]]:
        waiting = [partition.relative]
        while waiting:
            folder = waiting.pop()
            with os.scandir(os.path.join(self.root, folder)) as entries:
                for e in sorted(entries, key=lambda e: e.name):
                    path = f"{folder}/{e.name}".lstrip("/")
                    if e.is_dir(follow_symlinks=False):
                        if partition.deep and self._may_hold(path, True):
                            waiting.append(path)
                    elif e.is_file(follow_symlinks=False):
                        stat = e.stat()
                        row = described(path) | {"size": stat.st_size}
                        if partition.since < stat.st_mtime_ns // 1000 <= partition.until and all(passes(f, row) for f in self.filters):
                            yield row, e.path, stat

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for row, full, stat in self.files(partition):
            data = None
            if self.with_bytes:
                with open(full, "rb") as f:
                    data = f.read()
                held += len(data)
            rows.append((*[row[c] for c in _COLUMNS], stat.st_mtime_ns // 1000, data))
            if held >= self.batch or len(rows) >= 10_000:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.timestamp("us", "UTC"), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names=[*_COLUMNS, "modified", "bytes"])


class _Reader(DataSourceReader):
    def __init__(self, tree: Tree):
        self.tree = tree

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if understood(f):
                self.tree.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Folder]:
        return self.tree.folders()

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        return self.tree.read(partition)


class _Changes(DataSourceStreamReader):
    """Files by the time of their last change, in microseconds; each batch has those of its span. A second is left to pass first, so
    that no file changes within a span that has been read."""

    def __init__(self, tree: Tree):
        self.tree = tree

    def initialOffset(self) -> dict:
        return {"until": -1}

    def latestOffset(self) -> dict:
        import time

        return {"until": time.time_ns() // 1000 - 1_000_000}

    def partitions(self, start: dict, end: dict) -> list[Folder]:
        return self.tree.folders(start["until"], end["until"])

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        return self.tree.read(partition)


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(Tree(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Changes(Tree(self.options))


def register(spark: SparkSession) -> None:
    """Makes ``source_tree`` known to the session, which is set to hand filters to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SourceTree)
