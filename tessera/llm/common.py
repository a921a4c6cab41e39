"""Shared helpers of the subpackage: scratch tables in the shared folder, fold
assignment, bounded training samples and connected components.

Scratch tables live below ``spark.checkpoint.dir``, the folder that the driver
and all executors share, so a lost executor costs a re-run of a task and never
a table. Where the setting is absent, a session on one machine (tests) gets a
temporary folder, recorded in the session; on a cluster that is an error.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_ROOTS: dict[str, str] = {}
#: Whether an execution's shuffle files go as soon as it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    """Folder of this application's scratch tables, below spark.checkpoint.dir."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir is not set: it names the folder that driver and executors share, for intermediate tables")
            base = tempfile.mkdtemp(prefix="tessera-")
            spark.conf.set("spark.checkpoint.dir", base)
        _ROOTS[app] = f"{base.rstrip('/')}/tables-{uuid.uuid4().hex}"
        atexit.register(_remove_quietly, spark, _ROOTS[app])
    return _ROOTS[app]


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the JVM may already be gone when Python exits
        pass


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete scratch folders that no later plan reads."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


@contextlib.contextmanager
def shuffles_go(spark: SparkSession):
    """Within it, the shuffle files of a write go when the write ends. Else they stay until the driver happens to collect
    its garbage, so that those of many writes may lie on disk at once."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)


class Scratch:
    """Tables of one operator call. ``put`` writes one and returns it reread;
    ``drop`` deletes those no longer needed. What a returned result still reads
    stays until the application ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.schemas: dict[str, object] = {}

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def put(self, name: str, df: DataFrame) -> DataFrame:
        with shuffles_go(self.spark):
            df.write.mode("overwrite").parquet(self.path(name))
        self.schemas[name] = df.schema
        return self.get(name)

    def get(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schemas[name]).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        remove(self.spark, *[self.path(n) for n in names])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str, modulus: int):
    """crc32 of the id's decimal text, modulo ``modulus``; null ids go to fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(modulus), F.lit(0))


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, keep, bound: int) -> DataFrame:
    """At most ``bound`` labelled ids with their label: of each label the ids of lowest salted hash,
    as many as an equal deal of a quarter of the bound gives (one at least), so that a rare label is
    there; the rest of the bound by lowest hash over all. Of several labels of an id the greatest counts.

    ``keep``: a predicate on the id column for rows that may be learnt from.
    Only ids and labels travel here; texts are fetched later by a join.
    """
    seen = labels.select(F.col(id_col).cast("bigint").alias("_id"), F.col(label_col).alias("_y"))
    seen = seen.where(F.col("_id").isNotNull() & F.col("_y").isNotNull() & keep).groupBy("_id").agg(F.max("_y").alias("_y"))
    seen = seen.withColumn("_h", F.xxhash64(F.col("_id"), F.lit("sample")))
    classes = seen.select("_y").distinct().count()
    each = max(1, bound // 4 // max(1, classes))
    # Tasks keep the first ``each`` of a label before anything moves.
    first = seen.withColumn("_k", F.row_number().over(W.partitionBy("_y").orderBy("_h", "_id"))).where(F.col("_k") <= each).drop("_k")
    rest = seen.orderBy("_h", "_id").limit(max(0, bound - each * classes))
    return first.unionAll(rest).select("_id", "_y").distinct().limit(bound)


def labelled_texts(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str, label_col: str | None = None) -> DataFrame:
    """(_y, t): the whole text of each id of ``sample``, which is bounded, so it may be broadcast.
    An id that many rows share gives one text, the least of them; null texts are empty. ``label_col``: where the labels are a column
    of ``docs``, so that a text comes from a row that has the label."""
    own = [F.col(label_col).alias("_y")] if label_col else []
    few = docs.select(F.col(id_col).cast("bigint").alias("_id"), *own, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")).join(F.broadcast(sample), ["_id", *(["_y"] if own else [])])
    return few.groupBy("_id").agg(F.min(F.struct("_y", "t")).alias("r")).select("r._y", "r.t")


def symmetric(edges: DataFrame) -> DataFrame:
    e = edges.where("u <> v")
    return e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every endpoint of ``edges`` (u, v: bigint).

    Alternating large-star and small-star steps, each a partially aggregated
    minimum joined back to the edges. All state is in scratch tables: the
    driver sees two numbers a round. Both inputs of each join are scans, so
    adaptive execution can split a hot vertex's partition.
    The component is the smallest node reachable. Self-links and null
    endpoints are ignored; an empty input gives an empty result.
    """
    spark = scratch.spark
    cur = scratch.put("cc0", edges.select("u", "v").where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for k in range(max_rounds):
        low = scratch.put(f"low{k}", symmetric(cur).groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        both = cur.select("u", "v").unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # a node's own minimum is kept as an edge too, so nothing is cut off
        own = low.where("m < u").select("u", F.col("m").alias("v"))
        one = scratch.put(f"one{k}", large.unionAll(own).where("u <> v").distinct())
        low2 = scratch.put(f"low2{k}", one.groupBy("u").agg(F.min("v").alias("m")))
        small = one.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = scratch.put(f"cc{k + 1}", small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).unionAll(low2.select("u", F.col("m").alias("v"))).distinct())
        scratch.drop(f"cc{k}", f"low{k}", f"one{k}", f"low2{k}")
        cur = nxt
        # In a star forest every node has one parent and no parent has one.
        s = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if s[0] == 0 or tuple(s) == before:
            break
        before = tuple(s)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
