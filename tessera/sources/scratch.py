"""Intermediate tables in the folder that driver and executors share.

The folder is spark.checkpoint.dir. Where that is unset, a session on one machine (tests) gets a temporary folder, recorded in the
session; on a cluster it is an error. Tables go when the application ends or ``drop`` is called."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir is not set: it names the folder that driver and executors share, for intermediate tables")
            base = tempfile.mkdtemp(prefix="tessera-")
            spark.conf.set("spark.checkpoint.dir", base)
        _ROOTS[app] = f"{base.rstrip('/')}/engine-{uuid.uuid4().hex}"
        atexit.register(_drop_quietly, spark, _ROOTS[app])
    return _ROOTS[app]


def drop(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _drop_quietly(spark: SparkSession, path: str) -> None:
    try:
        drop(spark, path)
    except Exception:  # the JVM may already be gone when Python exits
        pass


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and reread: later plans start from its files, whatever executors are lost."""
    spark = df.sparkSession
    path = f"{root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
