"""The data source of source trees: filters, partitions, changed files."""

import os
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, Not, StringContains, StringStartsWith

from tessera.functions import predicates as P
from tessera.sources import tree_source

FILES = ["README.md", "src/A.java", "src/main/B.JAVA", "src/main/deep/er/C.java", "src/main/deep/er/d.txt", ".git/config", "src/.idea/x.xml", "src/target/T.class", "Docs/Guide/g.md", "docs2/node_modules/n.js", "none"]


@pytest.fixture
def root(tmp_path):
    for f in FILES:
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_bytes(f.encode() * 3)
    return str(tmp_path)


@pytest.fixture(scope="module")
def source(spark):
    tree_source.register(spark)
    return lambda root, **options: spark.read.format("source_tree").options(**options).load(root)


@pytest.mark.parametrize("depth", [0, 1, 2, 9])
def test_every_file_once(source, root, depth):
    rows = source(root, depth=depth, batch_bytes=10).collect()
    assert sorted(r.path for r in rows) == sorted(FILES)
    assert all(bytes(r.bytes) == r.path.encode() * 3 and r.size == 3 * len(r.path) for r in rows)
    assert {r.path for r in rows if r.hidden} == {".git/config", "src/.idea/x.xml", "src/target/T.class", "docs2/node_modules/n.js"}


def test_filters_reach_the_source(source, root):
    df = source(root).where("not hidden and not contains(dir_lower, 'deep') and extension_lower not in ('md', 'txt')")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan source_tree" in plan and "Filter (" not in plan  # the source took all of it over
    assert sorted(r.path for r in df.select("path").collect()) == ["none", "src/A.java", "src/main/B.JAVA"]
    assert [r.path for r in source(root).where("path like 'src/main/%' and size > 60").collect()] == ["src/main/deep/er/C.java", "src/main/deep/er/d.txt"]


def test_the_same_files_as_a_scan_of_a_table(spark, source, root):
    """The source's filters say what the predicates say about paths in a table."""
    table = spark.createDataFrame([(f,) for f in FILES], "path string")
    want = {r.path for r in P.scanned(table, "deep, docs", ".md,class").collect()}
    got = source(root).where(~F.col("hidden") & ~F.contains("dir_lower", F.lit("deep")) & ~F.contains("dir_lower", F.lit("docs")) & ~F.col("extension_lower").isin("md", "class"))
    assert {r.path for r in got.collect()} == want


def test_excluded_files_are_not_opened(root, monkeypatch):
    tree = tree_source.Tree({"path": root, "depth": "1"})
    reader = tree_source._Reader(tree)
    odd = EqualTo(("modified",), 1)
    filters = [EqualTo(("hidden",), False), Not(StringContains(("dir_lower",), "main")), StringStartsWith(("path",), "src"), odd]
    assert list(reader.pushFilters(filters)) == [odd]
    listed = [f.relative for f in reader.partitions()]
    assert "src" in listed and ".git" not in listed and "Docs" not in listed
    opened, walked = [], []
    real_open, real_scan = open, os.scandir
    monkeypatch.setattr("builtins.open", lambda f, *a, **k: (opened.append(os.path.relpath(f, root)), real_open(f, *a, **k))[1])
    monkeypatch.setattr(os, "scandir", lambda p: (walked.append(os.path.relpath(p, root)), real_scan(p))[1])
    for part in reader.partitions():
        list(reader.read(part))
    assert opened == ["src/A.java"] and not any("main/" in w or ".idea" in w for w in walked)


def test_changed_files_as_a_stream(spark, source, root, tmp_path_factory):
    at = tmp_path_factory.mktemp("stream")

    def run():
        stream = spark.readStream.format("source_tree").option("depth", 1).load(root)
        q = stream.select("path", F.col("bytes").cast("string").alias("text")).writeStream.format("parquet").option("path", str(at / "out")).option("checkpointLocation", str(at / "c")).trigger(once=True).start()
        assert q.awaitTermination(90)
        return sorted((r.path, r.text) for r in spark.read.schema("path string, text string").parquet(str(at / "out")).collect())

    time.sleep(1.1)
    first = run()
    assert [p for p, _ in first] == sorted(FILES)
    with open(os.path.join(root, "src/A.java"), "w") as f:
        f.write("new")
    os.makedirs(os.path.join(root, "fresh/er"))
    with open(os.path.join(root, "fresh/er/x.py"), "w") as f:
        f.write("x")
    time.sleep(1.1)
    assert sorted(set(run()) - set(first)) == [("fresh/er/x.py", "x"), ("src/A.java", "new")]


def test_a_missing_root_is_an_error(source):
    with pytest.raises(Exception, match="not a directory"):
        source("/no/such/folder").collect()
