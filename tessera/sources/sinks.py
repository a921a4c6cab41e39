"""Writers: appends, replaced partitions, document trees, archives and call logs."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import scan
from tessera.sources.scratch import stored


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace_by_key(df: DataFrame, path: str, key: str = "task_id", keys: Sequence | None = None) -> None:
    """Replaces the rows of the keys in ``df`` and leaves those of other keys: one folder a key, overwritten dynamically.
    ``keys``: all keys to replace; the folder of one that ``df`` has no rows of goes. ``df`` is worked out once, so that what is written
    and what goes are of one state; the steps are not one commit, a reader may see the folders change one by one."""
    df = stored(df, "replacement") if keys else df
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
    if keys:
        have = {r[0] for r in df.where(F.col(key).isin(list(keys))).select(key).distinct().collect()}  # at most ``keys``
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        for k in set(keys) - have:
            folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{key}={k}")
            folder.getFileSystem(conf).delete(folder, True)


def get_or_create(stored: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``stored`` and those of ``wanted`` whose key it lacks, one a key."""
    new = wanted.dropDuplicates([key]).join(stored, key, "left_anti")
    return stored.unionByName(new, allowMissingColumns=True)


def write_documents(documents: DataFrame, root: str) -> None:
    """Writes (path, content) below a folder that all executors share."""

    def work(rows) -> None:
        for r in rows:
            target = os.path.normpath(os.path.join(root, r.path))
            if not target.startswith(os.path.normpath(root) + os.sep):
                raise ValueError(f"path outside of the folder: {r.path}")
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with open(target, "w", encoding="utf-8") as f:
                f.write(r.content or "")

    documents.select("path", "content").foreachPartition(work)


def zip_documents(documents: DataFrame, prefix: str = "knowledge/") -> bytes:
    """An archive of one publication: its rows come to the driver one partition at a time."""
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for r in documents.orderBy("path").toLocalIterator():
            z.writestr(prefix + r.path, r.content or "")
    return buffer.getvalue()


def call_records(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the call log and of the usage audit from (task_id, system_id, chunk_id, model_name, reply)."""
    r = replies.select("task_id", "system_id", "chunk_id", "model_name", "reply.*")
    calls = r.select("task_id", "chunk_id", "model_name", F.col("input_tokens").alias("input_token"), F.col("output_tokens").alias("output_token"), F.col("ok").cast("smallint").alias("is_success"), F.col("error").alias("error_reason"), "duration_ms")
    return calls, r.select("system_id", "task_id", "model_name", F.lit(None).cast("int").alias("prompt_version"), "input_tokens", "output_tokens", "ok")


def call_logs(replies: DataFrame) -> DataFrame:
    """(path, content) of two files a call, for ``write_documents``: what was asked, and the text of the reply. A call is named by
    its chunk and its time in milliseconds (``at_ms``), so that a task run again writes the same files."""
    r = replies.select("chunk_id", "model_name", F.col("reply.text").alias("text"), F.concat(F.lit("ai_logs/task_"), F.col("task_id").cast("string"), F.lit("/call_"), F.col("chunk_id").cast("string"), F.lit("_"), F.col("at_ms").cast("string")).alias("base"))
    asked = F.concat(F.lit('{"chunkId":'), F.col("chunk_id").cast("string"), F.lit(',"model":"'), F.col("model_name"), F.lit('"}'))  # a fixed form
    return r.select(F.inline(F.array(F.struct(F.concat("base", F.lit("_req.json")).alias("path"), asked.alias("content")), F.struct(F.concat("base", F.lit("_resp.txt")).alias("path"), F.coalesce("text", F.lit("")).alias("content")))))


def operation_log(entries: DataFrame) -> DataFrame:
    """Rows of the operation log from (system_id, task_id, action_type, detail, exception_msg, ok, created_at)."""
    return entries.select("system_id", "task_id", F.lit(1).cast("bigint").alias("user_id"), F.lit("Owner").alias("username"), "action_type", "detail", F.lit("127.0.0.1").alias("ip_address"), "exception_msg", F.col("ok").cast("smallint").alias("is_success"), "created_at")


def write_lines(lines: DataFrame, root: str) -> None:
    """Writes the files of (path, place, line), each line at its own offset, below a folder that all executors share.

    Where a line begins is the sum of the bytes before it, so the tasks of one file write side by side, and a task that is run again
    writes the same bytes to the same places. Files that are there already are replaced."""
    sized = lines.select("path", "place", F.col("line").cast("binary").alias("bytes")).withColumn("length", F.octet_length("bytes").cast("bigint"))
    placed = scan.running(sized, ["path"], ["place"], sums={"offset": "length"}, inclusive=False)
    ends = placed.groupBy("path").agg(F.sum("length").alias("size"))

    def inside(path: str) -> str:
        target = os.path.normpath(os.path.join(root, path))
        if not target.startswith(os.path.normpath(root) + os.sep):
            raise ValueError(f"path outside of the folder: {path}")
        return target

    def make(rows) -> None:
        for r in rows:
            os.makedirs(os.path.dirname(inside(r.path)), exist_ok=True)
            with open(inside(r.path), "wb") as f:
                f.truncate(r.size)

    def write(rows) -> None:
        open_, f = None, None
        for r in rows:
            if r.path != open_:
                if f:
                    f.close()
                open_, f = r.path, open(inside(r.path), "r+b")  # noqa: SIM115
            f.seek(r.offset)
            f.write(r.bytes)
        if f:
            f.close()

    ends.foreachPartition(make)
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed.repartitionByRange(parts, "path", "place").sortWithinPartitions("path", "place").foreachPartition(write)


def mirrored(documents: DataFrame, source: str, folder: str = "docs/code-insight/drafts") -> bool:
    """Writes (path, content) into a folder of the source tree too, where that is a local directory; whether it was."""
    if not os.path.isdir(source):
        return False
    write_documents(documents, os.path.join(source, folder))
    return True
