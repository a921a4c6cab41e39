"""Stored tables and views of the driver's tables under the engine's names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.audit import cost
from tessera.operators.lifecycle import STATES


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A relational table, read in ``parts`` ranges of ``key`` where bounds are given; filters and columns are pushed down."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if key and bounds:
        r = r.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return r.load()


def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    i, o = F.floor(F.col("value") * 10).cast("bigint"), F.floor(F.col("value") * 3).cast("bigint")
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("system_id"), (F.col("event_id") % 50).alias("task_id"), F.col("event_type").alias("model_name"), i.alias("input_tokens"), o.alias("output_tokens"),
        (i + o).alias("total_tokens"), cost(i, o).alias("cost"), F.when(F.col("event_type") == "error", "TEST").otherwise("INITIAL").alias("type"), F.col("ts").alias("created_at"),
    )


def systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(s) for s in STATES])
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("system_id"), F.get(names, (F.col("o_orderkey") % 15).cast("int")).alias("status"), F.col("o_orderpriority").alias("type"), F.col("o_orderdate").alias("created_at"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").alias("content"))
