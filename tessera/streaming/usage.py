"""Streaming forms of the audit (an extension: the same sums over an unbounded usage table)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def daily_usage(stream: DataFrame, lateness: str = "1 day") -> DataFrame:
    """(day, system_id, tokens) by event time; usage later than ``lateness`` is left out. Zone-less times need a cast for watermarks."""
    s = stream.withColumn("at", F.col("created_at").cast("timestamp")).withWatermark("at", lateness)
    return s.groupBy(F.window("at", "1 day").alias("w"), "system_id").agg(F.sum("total_tokens").alias("tokens")).select(F.col("w.start").alias("day"), "system_id", "tokens")


def latest_autosaves(stream: DataFrame, ttl: str = "7 days") -> DataFrame:
    """(draft_id, content, at): last write of a draft in each span of ``ttl`` (spans follow each other, they do not slide: a draft
    written on both sides of a border is told twice, the later row counts). A span is told once the watermark has passed it."""
    s = stream.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", ttl)
    return s.groupBy(F.window("at", ttl).alias("w"), "draft_id").agg(F.max_by("content", "at").alias("content"), F.max("at").alias("at")).select("draft_id", "content", "at")


def keep_autosaves(stream: DataFrame, path: str, checkpoint: str, ttl: str = "7 days") -> DataStreamWriter:
    """Last autosave of each draft, kept for ``ttl`` after its own time. Each micro-batch joins the state before it to a new folder
    ``batch=<n>``, so a batch that is run again gives the same state; the folder before the last one goes.
    Drafts whose write is older than the newest write by more than ``ttl`` are dropped: the state holds live drafts only."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("draft_id", "content", F.col("at").cast("timestamp").alias("at"))
        if number:
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(f"{path}/batch={number - 1}"))
        newest = F.max(F.struct("at", "content")).alias("r")
        last = rows.where("draft_id is not null and at is not null").groupBy("draft_id").agg(newest).select("draft_id", "r.content", "r.at")
        until = rows.agg(F.max("at")).first()[0]
        live = last if until is None else last.where(F.col("at") > F.lit(until) - F.expr(f"interval {ttl}"))
        live.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if number > 1:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={number - 2}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(merge)


def write_idempotent(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Each micro-batch overwrites only its own folder, so a batch that is run again leaves the same files."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(save)
