"""Completions whose replies are kept, so that no call is made twice.

A request is known by the hash of the model's name and the prompt. Requests that the store has are not asked again; the others, each
once, are asked in batches by tasks, some at a time. A batch that is done is written to the store at once, as a file named by its
requests, before the next is begun: a task that is run again finds it there. So what a lost executor can cost is the batch in hand.

The store is a folder that pyarrow can write and Spark can read (a shared file system or an object store). Only good replies are
kept; the others give the mock text now and are asked again by the next run."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.prompts import parse_completion
from tessera.sources.scratch import stored

_KEPT = pa.schema([("key", pa.string()), ("body", pa.string()), ("duration_ms", pa.int64())])
_KEPT_SQL = "key string, body string, duration_ms bigint"


def kept(spark, store: str) -> DataFrame:
    """(key, body, duration_ms): the store's replies, one a request."""
    fs, path = pafs.FileSystem.from_uri(store)
    fs.create_dir(path, recursive=True)
    rows = spark.read.schema(_KEPT_SQL).option("pathGlobFilter", "batch-*.parquet").parquet(store)
    return rows.groupBy("key").agg(F.min(F.struct("body", "duration_ms")).alias("r")).select("key", "r.*")


def _asked(call: Callable[[str], tuple[int, str]], store: str, batch: int, at_once: int):
    def ask(prompt: str) -> tuple[str | None, str | None, int]:
        import time

        began = time.monotonic()
        try:
            status, body = call(prompt)
            error = None if status == 200 else f"HTTP 错误码: {status}, 详情: {body}"
        except Exception as e:  # any failure of the service falls back to the mock text
            body, error = None, str(e)
        return body, error, int((time.monotonic() - began) * 1000)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pafs.FileSystem.from_uri(store)

        def done(rows: list[tuple[str, str]]) -> pa.RecordBatch:
            name = f"{folder}/batch-{hashlib.sha256(' '.join(k for k, _ in rows).encode()).hexdigest()}.parquet"
            known = set()
            if fs.get_file_info(name).type == pafs.FileType.File:  # an earlier try of this task came so far
                known = set(pq.read_table(name, filesystem=fs, columns=["key"])["key"].to_pylist())
            new = [(k, p) for k, p in rows if k not in known]
            with ThreadPoolExecutor(at_once) as pool:
                replies = list(pool.map(ask, [p for _, p in new]))
            good = [(k, body, ms) for (k, _), (body, error, ms) in zip(new, replies) if error is None and _has_choice(body)]
            if good:
                # A new name is moved over at the end, so that no reader sees half a file.
                part = f"{folder}/_{uuid.uuid4().hex}"
                full = name if not known else name.replace(".parquet", f"-{uuid.uuid4().hex}.parquet")
                pq.write_table(pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*good), _KEPT)], schema=_KEPT), part, filesystem=fs)
                fs.move(part, full)
            ok = {k for k, _, _ in good}
            bad = [(k, error or "no choice in the reply", ms) for (k, _), (_, error, ms) in zip(new, replies) if k not in ok]
            return pa.RecordBatch.from_arrays([pa.array([b[i] for b in bad], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["key", "error", "duration_ms"])

        rows: list[tuple[str, str]] = []
        for b in batches:
            for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows.append(r)
                if len(rows) == batch:
                    yield done(rows)
                    rows = []
        if rows:
            yield done(rows)

    return work


def _has_choice(body: str | None) -> bool:
    import json

    try:
        return bool(json.loads(body or "")["choices"][0]) or True
    except (ValueError, LookupError, TypeError):
        return False


def complete(df: DataFrame, call: Callable[[str], tuple[int, str]], store: str, model: str = "", prompt: str = "prompt", mock: str = "mock", batch: int = 32, at_once: int = 8) -> DataFrame:
    """Adds ``reply`` struct as ``prompts.complete`` does, with every good reply kept in ``store``. Rows of one prompt share one call;
    a null prompt is an empty one. ``at_once``: calls that a task has under way; ``batch``: requests after which it writes."""
    spark = df.sparkSession
    text = F.coalesce(F.col(prompt), F.lit(""))
    keyed = df.withColumn("_key", F.sha2(F.concat_ws("\n", F.lit(model), text), 256))
    wanted = keyed.select("_key", text.alias("_p")).dropDuplicates(["_key"]).join(kept(spark, store).select(F.col("key").alias("_key")), "_key", "left_anti")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Sorted, so that a task that is run again makes the same batches.
    ordered = wanted.repartition(parts, "_key").sortWithinPartitions("_key")
    bad = stored(ordered.mapInArrow(_asked(call, store, batch, at_once), "key string, error string, duration_ms bigint"), "replies")
    good = kept(spark, store).select(F.col("key").alias("_key"), parse_completion(F.col("body")).alias("_c"), F.col("duration_ms").alias("_ms"))
    out = keyed.join(good, "_key", "left").join(bad.select(F.col("key").alias("_key"), F.col("error").alias("_error"), F.col("duration_ms").alias("_bad_ms")), "_key", "left")
    estimate = lambda c: F.floor(F.length(c) / 3).cast("int")
    answered = F.struct(F.coalesce("_c.text", F.lit("")).alias("text"), F.col("_c.input_tokens").alias("input_tokens"), F.col("_c.output_tokens").alias("output_tokens"), F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"), F.col("_ms").alias("duration_ms"))
    stand_in = F.struct(F.col(mock).alias("text"), estimate(F.col(prompt)).alias("input_tokens"), estimate(F.col(mock)).alias("output_tokens"), F.lit(False).alias("ok"), F.col("_error").alias("error"), F.col("_bad_ms").alias("duration_ms"))
    return out.withColumn("reply", F.when(F.col("_ms").isNotNull(), answered).otherwise(stand_in)).select(*[c for c in df.columns if c != "reply"], "reply")
