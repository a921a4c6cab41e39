"""File trees, map files and the demo tree."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import extension, line_count

#: Files of a task and bytes of a batch that are read at once (one file at least).
FILES_A_TASK, BYTES_AT_ONCE = 1000, 64 << 20
# Directories that a copy of a tree leaves out.
NOT_COPIED = {".git", "target", "node_modules", ".idea", ".vscode"}


def tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of the files below a local directory. The driver lists paths, as Spark's file sources skip
    names that begin with ``_`` or ``.``; executors that see the same file system read them."""
    found = []
    for at, dirs, names in os.walk(root):
        dirs[:] = sorted(d for d in dirs if d not in NOT_COPIED)
        found += [(os.path.relpath(os.path.join(at, n), root).replace(os.sep, "/"), os.path.join(at, n)) for n in sorted(names)]
    df = spark.createDataFrame(found, "path string, _file string").repartition(max(1, min(len(found), 64), -(-len(found) // FILES_A_TASK)))

    def load(batches):
        for b in batches:
            paths, out, size = [], [], 0
            for path, f in zip(b["path"], b["_file"], strict=True):
                with open(f, "rb") as handle:
                    paths.append(path)
                    out.append(handle.read())
                size += len(out[-1])
                if size >= BYTES_AT_ONCE:
                    yield pd.DataFrame({"path": paths, "bytes": out}, dtype=object)
                    paths, out, size = [], [], 0
            yield pd.DataFrame({"path": paths, "bytes": out}, dtype=object)

    raw = df.mapInPandas(load, "path string, bytes binary")
    return raw.select("path", F.expr("try_validate_utf8(cast(bytes as string))").alias("content"), "bytes")


def tree_or_stand_in(spark: SparkSession, root: str, fetch: Callable[[str], str] | None = None) -> tuple[DataFrame, str | None]:
    """((path, content), reason): the files below ``root``, or, where that is no local directory, below the one that ``fetch``
    brings it to. Where ``fetch`` is missing or fails, the stand-in project, and why; a directory that cannot be read is an error."""
    if os.path.isdir(root):
        return tree(spark, root).select("path", "content"), None
    try:
        if fetch is None:
            raise FileNotFoundError(f"not a directory: {root}")
        return tree(spark, fetch(root)).select("path", "content"), None
    except Exception as e:  # any failure to fetch, as a source that is away must not stop a task
        return demo(spark), str(e)


def remote_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, bytes) below a folder of any file system that Spark reads; hidden names are left out by Spark."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("content").alias("bytes"))


def snapshots(files: DataFrame) -> DataFrame:
    """(path, file_type, line_count, file_hash): undecodable files (null content) have no lines."""
    raw = F.col("bytes") if "bytes" in files.columns else F.col("content")
    return files.select("path", extension(F.substring_index("path", "/", -1)).alias("file_type"), F.coalesce(line_count(F.col("content")), F.lit(0)).cast("bigint").alias("line_count"), F.md5(raw).alias("file_hash"))


def changed_files(new: DataFrame, old: DataFrame) -> DataFrame:
    """(path, change): files added, modified or deleted between two snapshots, by hash. An extension."""
    j = new.select("path", F.col("file_hash").alias("a")).join(old.select("path", F.col("file_hash").alias("b")), "path", "full_outer")
    return j.where("a is distinct from b").select("path", F.when(F.col("b").isNull(), "ADDED").when(F.col("a").isNull(), "DELETED").otherwise("MODIFIED").alias("change"))


def module_map_yaml(text: str) -> list[tuple[int, int, str, str]]:
    """(module_ord, path_ord, module, pattern) of a map file: unindented ``name:`` opens a module, ``- item`` adds a pattern."""
    modules: dict[str, list[str]] = {}
    current: str | None = None
    for line in re.split(r"\r\n|\n|\r", text or ""):
        body = line.strip()
        if not body or body.startswith("#"):
            continue
        if line[0] not in " \t" and ":" in line:
            current = line.split(":", 1)[0].strip()
            modules[current] = []
        elif body.startswith("-") and current is not None:
            modules[current].append(re.sub(r"^['\"]|['\"]$", "", line.split("-", 1)[1].strip()))
    return [(i, j, m, p) for i, (m, patterns) in enumerate(modules.items()) for j, p in enumerate(patterns)]


def module_map_json(text: str) -> list[tuple[int, int, str, str]]:
    """The same of ``{"modules": [{"name" or "id", "paths": [...]}]}``."""
    modules = json.loads(text or "{}").get("modules")
    out = []
    for i, m in enumerate(modules if isinstance(modules, list) else []):
        paths = m.get("paths")
        out += [(i, j, str(m.get("name", m.get("id", ""))), str(p)) for j, p in enumerate(paths if isinstance(paths, list) else [])]
    return out


def patterns(spark: SparkSession, rows: list[tuple[int, int, str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "module_ord int, path_ord int, module string, pattern string")


def demo(spark: SparkSession) -> DataFrame:
    """(path, content) of a small stand-in project: a controller, a service, a mapper and an entity."""
    # The project's files.
    base = "src/main/java/com/demo"
    head = "package com.demo.{0};\n\n"
    rows = [
        (f"{base}/controller/UserController.java", head.format("controller") + '@RestController\n@RequestMapping("/api/users")\npublic class UserController {\n    private final UserService userService;\n\n    @GetMapping("/")\n    public List<User> listUsers() {\n        return userService.listUsers();\n    }\n\n    @GetMapping("/{id}")\n    public User getUser(@PathVariable Long id) {\n        return userService.getUser(id);\n    }\n\n    @PostMapping("/")\n    public User createUser(@RequestBody User user) {\n        return userService.createUser(user);\n    }\n}\n'),
        (f"{base}/service/UserService.java", head.format("service") + "@Service\npublic class UserService {\n    private final UserMapper userMapper;\n\n    public List<User> listUsers() {\n        return userMapper.findAll();\n    }\n\n    public User getUser(Long id) {\n        return userMapper.findById(id);\n    }\n}\n"),
        (f"{base}/mapper/UserMapper.java", head.format("mapper") + '@Mapper\npublic interface UserMapper {\n    @Select("SELECT id, username FROM demo_user")\n    List<User> findAll();\n}\n'),
        (f"{base}/entity/User.java", head.format("entity") + '@Table(name = "demo_user")\npublic class User {\n    private Long id;\n    private String username;\n}\n'),
    ]
    return spark.createDataFrame(rows, "path string, content string")
