"""Mixing sources to target weights by pivotal dependent rounding.

Targets: the sources in code-point order (null last) weigh 5, 2, 1, repeating,
and share ``share`` times the whole size by weight. A target stops at ``most``
times its source's size; what is above is shared again by weight among the
others until none is above.

Copies: a document of a source with ratio r = target / size is copied
floor(r) or floor(r) + 1 times. The fractional parts are rounded together: two
documents pass mass (copy probability times size) between them, in a random
direction that keeps each one's expected copies, until one's copies are whole.
So the source's total hardly moves. Documents are dealt into buckets of bounded
size, each bucket leaves at most one fractional document, and these meet in
further levels of a reduction tree until a source has one left, which is
rounded to the nearer side; then at most ``SWAPS`` documents of the root group
change sides where that brings the source's total nearer to its target. The
larger documents are settled first, so what is left is small. All random
numbers are hashes of ids, so reruns agree.

Defined results: a null text has size 0; documents of size 0 take 0 words;
null sources form one source; repeated rows and rows without an id are rounded
as rows of their own (rows that agree in id, source and size are interchangeable); an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import Scratch, table

#: Documents of a bucket, and residuals that meet in one group of the tree.
FAN = 400
#: Documents of a source's root group that may change sides to close the last gap.
SWAPS = 3
#: Equal rows that travel as one.
SAME = 50
WEIGHTS = (5, 2, 1)
WORDS = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORDS)), F.lit(0)).cast("bigint").alias("size"),
    )


def ranked(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds rank (from 0) by code point, null last. Range partitions are numbered on
    their own and shifted by the counts of those before: no task sees all sources."""
    spark = scratch.spark
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = sources.repartitionByRange(n, F.col("source").asc_nulls_last())
    parts = scratch.put("dealt", dealt.withColumn("part", F.spark_partition_id()))
    counts = sorted(map(tuple, parts.groupBy("part").count().collect()))  # one row a partition
    if not counts:
        return parts.withColumn("rank", F.lit(0).cast("bigint")).drop("part")
    before = dict(zip([p for p, _ in counts], np.cumsum([0, *[c for _, c in counts][:-1]]).tolist(), strict=True))
    shift = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("part"))
    from pyspark.sql import Window as W

    own = F.row_number().over(W.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return parts.withColumn("rank", (own + shift).cast("bigint")).drop("part")


def targets(rows: DataFrame, scratch: Scratch, share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """(source, docs, source_size, target) of each source of ``rows`` (source, size)."""
    totals = rows.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    r = ranked(totals, scratch)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    t = scratch.put("sources", r.select("source", "docs", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("cap")))
    whole = float(t.agg(F.sum("source_size")).first()[0] or 0) * share
    # Level: words a unit of weight. Each round fixes the sources that are above their cap.
    level, fixed = 0.0, -1
    while True:
        full = F.col("cap") <= F.col("weight") * level if fixed >= 0 else F.lit(False)
        got = t.agg(F.sum(F.when(full, F.col("cap"))).alias("a"), F.sum(F.when(~full, F.col("weight"))).alias("w"), F.sum(F.when(full, 1).otherwise(0)).alias("n")).first()
        if not got.w or got.n == fixed:
            break
        level, fixed = (whole - (got.a or 0.0)) / got.w, got.n
    return t.select("source", "docs", "source_size", F.least(F.col("cap"), F.col("weight") * F.lit(level)).cast("double").alias("target"))


def _uniform(*ids: int) -> float:
    """A number in [0, 1) from integers: the finaliser of splitmix64."""
    z = 0x9E3779B97F4A7C15
    for i in ids:
        z = (z ^ (int(i) & 0xFFFFFFFFFFFFFFFF)) & 0xFFFFFFFFFFFFFFFF
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
        z ^= z >> 31
    return (z >> 11) / 9007199254740992.0


def pivot(ids: np.ndarray, sizes: np.ndarray, p: np.ndarray, seed: int = 0) -> np.ndarray:
    """Rounds ``p`` (in larger sizes first order) so that sum(p * sizes) stays; at most one entry stays fractional.

    Two entries i (held) and j: either i gains what j loses or the reverse, as
    far as one of them becomes 0 or 1; the direction's chance keeps expectations.
    """
    p, held = p.astype(float).copy(), -1
    for j in range(len(p)):
        if not 0 < p[j] < 1:
            continue
        if held < 0:
            held = j
            continue
        a, b = float(sizes[held]), float(sizes[j])
        up = min(a * (1 - p[held]), b * p[j])  # words that may go from j to the held one
        down = min(a * p[held], b * (1 - p[j]))
        if _uniform(ids[held], ids[j], seed) * (up + down) < down:
            move, full = up, (a * (1 - p[held]) <= b * p[j], b * p[j] <= a * (1 - p[held]))
            p[held], p[j] = (1.0 if full[0] else p[held] + move / a), (0.0 if full[1] else p[j] - move / b)
        else:
            move, full = down, (a * p[held] <= b * (1 - p[j]), b * (1 - p[j]) <= a * p[held])
            p[held], p[j] = (0.0 if full[0] else p[held] - move / a), (1.0 if full[1] else p[j] + move / b)
        left = [k for k in (held, j) if 1e-12 < p[k] < 1 - 1e-12]
        for k in (held, j):
            if k not in left:
                p[k] = round(p[k])
        held = left[0] if left else -1
    return p


_ROW = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("source", T.StringType()), T.StructField("size", T.LongType()),
    T.StructField("base", T.LongType()), T.StructField("p", T.DoubleType()), T.StructField("bucket", T.LongType()),
    T.StructField("buckets", T.LongType()), T.StructField("same", T.LongType()),
])


def _group(pdf: pd.DataFrame) -> pd.DataFrame:
    ids = pdf["doc_id"].fillna(-1).astype("int64")
    if "same" in pdf:  # rows of one id differ; the product wraps
        ids += pdf["same"].astype("int64") * 0x9E3779B97F4A7C
    pdf = pdf.assign(_i=ids).sort_values(["size", "_i", "p"], ascending=[False, True, True], kind="stable")
    pdf["p"] = pivot(pdf["_i"].to_numpy(), pdf["size"].to_numpy(), pdf["p"].to_numpy(dtype=float))
    return pdf.drop(columns="_i")


def close_gap(sizes: np.ndarray, free: np.ndarray, p: np.ndarray, goal: float) -> np.ndarray:
    """Rounds what is fractional, then flips up to SWAPS ``free`` entries, each the one that brings sum(p * sizes) nearest to ``goal``."""
    p = np.where(p < 0.5, 0.0, 1.0)
    for _ in range(SWAPS):
        gap = goal - float((p * sizes).sum())
        after = np.abs(gap - np.where(p == 0, sizes, -sizes))
        after[~free] = np.inf
        best = int(after.argmin()) if len(after) else 0
        if not len(after) or after[best] >= abs(gap):
            break
        p[best] = 1 - p[best]
    return p


def _root(pdf: pd.DataFrame) -> pd.DataFrame:
    start = pdf["p"].to_numpy(dtype=float)
    goal, free = float((start * pdf["size"].to_numpy()).sum()), dict(zip(pdf.index, (start > 0) & (start < 1), strict=True))
    out = _group(pdf)
    out["p"] = close_gap(out["size"].to_numpy(dtype=float), np.array([free[i] for i in out.index], dtype=bool), out["p"].to_numpy(), goal)
    return out


def _settle(pdf: pd.DataFrame) -> pd.DataFrame:
    """A source's last group is closed at the level where that source has one bucket, whatever the others have."""
    if "n" in pdf:  # ``n`` equal rows, numbered from ``same`` on
        n = pdf["n"].to_numpy()
        own = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pdf = pdf.loc[pdf.index.repeat(n)].drop(columns="n").reset_index(drop=True)
        pdf["same"] += own
    return _root(pdf) if pdf["buckets"].iloc[0] <= 1 else _group(pdf)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of each row."""
    scratch = Scratch(docs.sparkSession, "mix")
    rows = scratch.put("sized", sized(docs, id_col, text_col, source_col))
    goal = scratch.put("goal", targets(rows, scratch, share, most, weights))
    # One row a source against all rows; both inputs of the join are scans, so a hot source's partition can be split.
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    equal = rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("all"))
    equal = equal.withColumn("same", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("all") - 1, F.lit(SAME).cast("bigint")))).withColumn("n", F.least(F.col("all") - F.col("same"), F.lit(SAME)).cast("bigint")).drop("all")
    with_goal = equal.join(goal.withColumnRenamed("source", "source2"), F.col("source").eqNullSafe(F.col("source2"))).drop("source2")
    fractional = with_goal.withColumn("ratio", ratio).withColumn("base", F.floor("ratio").cast("bigint"))
    buckets = F.greatest(F.lit(1), F.ceil(F.col("docs") / FAN)).cast("bigint")
    # Rows that agree in id, source and size travel as one row for every SAME of them, each in a bucket of its own, so that
    # neither rows without an id nor those of one id fill a bucket.
    at = F.when(F.col("same") == 0, F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit("bucket"))).otherwise(F.xxhash64("doc_id", "size", "same", F.lit("bucket")))
    level = fractional.select(
        "doc_id", "source", "size", "base", F.when(F.col("size") > 0, F.col("ratio") - F.col("base")).otherwise(0.0).alias("p"),
        F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("size", "same", F.lit("bucket"))).otherwise(at), buckets).cast("bigint").alias("bucket"), buckets.alias("buckets"), "same", "n",
    )
    most_buckets = math.ceil((goal.agg(F.max("docs")).first()[0] or 0) / FAN)
    settled, k = [], 0
    while True:
        root = most_buckets <= 1
        done = scratch.put(f"level{k}", level.groupBy("source", "bucket").applyInPandas(_settle, _ROW))
        open_ = (F.col("p") > 0) & (F.col("p") < 1)
        settled.append(done.where(~open_))
        if root:
            break
        level = done.where(open_).withColumn("bucket", F.floor(F.col("bucket") / FAN).cast("bigint")).withColumn("buckets", F.ceil(F.col("buckets") / FAN).cast("bigint"))
        most_buckets, k = math.ceil(most_buckets / FAN), k + 1
    out = settled[0]
    for more in settled[1:]:
        out = out.unionAll(more)
    out = out.withColumn("copies", F.col("base") + F.col("p").cast("bigint"))
    out = out.join(goal.withColumnRenamed("source", "source2"), F.col("source").eqNullSafe(F.col("source2"))).drop("source2")
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
