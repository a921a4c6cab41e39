"""Files of a commit, read from a local or mounted repository's objects by the tasks that need them.

Only the ref and the commit are read where the query is planned. Directories are walked a level at a time as a table of trees, and each
task reads the objects of its rows: loose ones, or from packs by binary search in their index and along their delta chains. Nothing is
checked out and no other program runs. All executors must see the repository under the same path. SHA-1 repositories, index version 2."""

from __future__ import annotations

import mmap
import os
import struct
import zlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.scratch import stored

BYTES_AT_ONCE = 64 << 20
# Kinds of packed objects, and modes of directories and of other repositories in a tree.
KINDS, BY_OFFSET, BY_NAME = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}, 6, 7
DIRECTORY, SUBMODULE = "40000", "160000"


def git_folder(repository: str) -> Path:
    """The folder of refs and objects of a working tree or a bare repository."""
    at = Path(repository, ".git")
    if at.is_file():  # a linked working tree
        at = Path(repository, at.read_text().split(":", 1)[1].strip())
        common = at / "commondir"
        at = (at / common.read_text().strip()) if common.exists() else at
    elif not at.is_dir():
        at = Path(repository)
    if not (at / "objects").is_dir():
        raise FileNotFoundError(f"no repository: {repository}")
    return at


def commit_id(repository: str, ref: str = "HEAD") -> str:
    """The hash that a ref (a branch, tag, full ref or hash) stands for."""
    folder = git_folder(repository)
    packed = {}
    if (folder / "packed-refs").exists():
        for line in (folder / "packed-refs").read_text().splitlines():
            if line and line[0] not in "#^":
                value, name = line.split(" ", 1)
                packed[name] = value
    for name in (ref, f"refs/{ref}", f"refs/heads/{ref}", f"refs/tags/{ref}", f"refs/remotes/{ref}"):
        value = (folder / name).read_text().strip() if (folder / name).is_file() else packed.get(name)
        if value:
            return commit_id(repository, value[5:].strip()) if value.startswith("ref:") else value
    if len(ref) == 40 and not set(ref) - set("0123456789abcdef"):
        return ref
    raise LookupError(f"no such ref: {ref}")


class Objects:
    """Reads objects by their hash; packs are mapped, not loaded."""

    def __init__(self, folder: str):
        self.folder = folder
        self.packs = []
        for index in sorted(Path(folder, "objects", "pack").glob("*.idx")):
            self.packs.append((self._mapped(index), self._mapped(index.with_suffix(".pack"))))

    @staticmethod
    def _mapped(path: Path) -> mmap.mmap:
        with open(path, "rb") as f:
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)

    def read(self, name: str) -> tuple[str, bytes]:
        loose = os.path.join(self.folder, "objects", name[:2], name[2:])
        if os.path.exists(loose):
            with open(loose, "rb") as f:
                head, _, body = zlib.decompress(f.read()).partition(b"\0")
            return head.split()[0].decode(), body
        key = bytes.fromhex(name)
        for index, pack in self.packs:
            at = self._offset(index, key)
            if at is not None:
                return self._packed(pack, at)
        raise LookupError(f"no object {name}")

    @staticmethod
    def _offset(index: mmap.mmap, key: bytes) -> int | None:
        if index[:8] != b"\xfftOc\0\0\0\2":
            raise ValueError("a pack index that is not of version 2")
        fan = lambda i: struct.unpack_from(">I", index, 8 + 4 * i)[0]
        low, high, n = fan(key[0] - 1) if key[0] else 0, fan(key[0]), fan(255)
        names = 8 + 1024
        while low < high:
            middle = (low + high) // 2
            if index[names + 20 * middle : names + 20 * middle + 20] < key:
                low = middle + 1
            else:
                high = middle
        if low >= n or index[names + 20 * low : names + 20 * low + 20] != key:
            return None
        (at,) = struct.unpack_from(">I", index, names + 24 * n + 4 * low)
        return at if at < 1 << 31 else struct.unpack_from(">Q", index, names + 28 * n + 8 * (at - (1 << 31)))[0]

    def _packed(self, pack: mmap.mmap, at: int) -> tuple[str, bytes]:
        deltas = []
        while True:
            start, byte = at, pack[at]
            kind = byte >> 4 & 7
            at += 1
            while byte & 128:  # the size, which the data have too
                byte = pack[at]
                at += 1
            if kind == BY_OFFSET:
                byte = pack[at]
                back = byte & 127
                while byte & 128:
                    at += 1
                    byte = pack[at]
                    back = (back + 1) << 7 | byte & 127
                deltas.append(self._inflated(pack, at + 1))
                at = start - back
                continue
            if kind == BY_NAME:
                deltas.append(self._inflated(pack, at + 20))
                name, body = self.read(pack[at : at + 20].hex())
            else:
                name, body = KINDS[kind], self._inflated(pack, at)
            for delta in reversed(deltas):
                body = patched(body, delta)
            return name, body

    @staticmethod
    def _inflated(pack: mmap.mmap, at: int) -> bytes:
        unpack, out = zlib.decompressobj(), []
        while not unpack.eof:
            out.append(unpack.decompress(pack[at : at + 65536]))
            at += 65536
        return b"".join(out)


def patched(base: bytes, delta: bytes) -> bytes:
    """``base`` with a delta's copies and insertions."""
    at, out = 0, []
    for _ in range(2):  # two sizes come first
        while delta[at] & 128:
            at += 1
        at += 1
    while at < len(delta):
        op = delta[at]
        at += 1
        if not op & 128:
            out.append(delta[at : at + op])
            at += op
            continue
        place = size = 0
        for bit in range(7):
            if op >> bit & 1:
                if bit < 4:
                    place |= delta[at] << 8 * bit
                else:
                    size |= delta[at] << 8 * (bit - 4)
                at += 1
        out.append(base[place : place + (size or 65536)])
    return b"".join(out)


def entries(tree: bytes) -> Iterator[tuple[str, str, str]]:
    """(mode, name, hash) of a tree."""
    at = 0
    while at < len(tree):
        space, end = tree.index(b" ", at), tree.index(b"\0", at)
        yield tree[at:space].decode(), tree[space + 1 : end].decode("utf-8", "replace"), tree[end + 1 : end + 21].hex()
        at = end + 21


def _listed(folder: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        objects = Objects(folder)
        for b in batches:
            for path, name in zip(b["path"].to_pylist(), b["hash"].to_pylist(), strict=True):
                rows = [(f"{path}/{n}".lstrip("/"), mode, h) for mode, n, h in entries(objects.read(name)[1])]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["path", "mode", "hash"])

    return work


def _loaded(folder: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        objects = Objects(folder)
        for b in batches:
            first, held, data = 0, 0, []
            for i, (name, mode) in enumerate(zip(b["hash"].to_pylist(), b["mode"].to_pylist(), strict=True)):
                data.append(None if mode == SUBMODULE else objects.read(name)[1])
                held += len(data[-1] or b"")
                if held >= BYTES_AT_ONCE or i == b.num_rows - 1:
                    part = b.slice(first, len(data))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(data, pa.binary())], names=[*part.schema.names, "bytes"])
                    first, held, data = i + 1, 0, []

    return work


def commit_files(spark: SparkSession, repository: str, ref: str = "HEAD") -> tuple[str, DataFrame]:
    """(commit hash, (path, mode, hash, bytes)): the files of a commit; an annotated tag stands for its commit; another repository
    inside has no bytes. One job a level of directories."""
    folder, commit = str(git_folder(repository)), commit_id(repository, ref)
    objects = Objects(folder)
    kind, body = objects.read(commit)
    while kind == "tag":
        commit = body.split(b"\n", 1)[0].split()[1].decode()
        kind, body = objects.read(commit)
    if kind != "commit":
        raise LookupError(f"{ref} is a {kind}")
    level = spark.createDataFrame([("", body.split(b"\n", 1)[0].split()[1].decode())], "path string, hash string")
    parts, files = int(spark.conf.get("spark.sql.shuffle.partitions")), None
    while True:
        found = stored(level.mapInArrow(_listed(folder), "path string, mode string, hash string"), "trees")
        own = found.where(F.col("mode") != DIRECTORY)
        files = own if files is None else files.unionAll(own)
        level = found.where(F.col("mode") == DIRECTORY).select("path", "hash")
        if level.isEmpty():
            break
        level = level.repartition(parts, "path")
    return commit, files.repartition(parts, "path").mapInArrow(_loaded(folder), "path string, mode string, hash string, bytes binary")
