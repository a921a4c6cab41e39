"""Autosaves of drafts as keyed state over a stream: one value and one timer a draft."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Autosaves(StatefulProcessor):
    """The last write of a draft. A write older than the one kept changes nothing. The timer stands at the write's own time: the
    watermark, which is a life behind the newest write, passes it when the life is over."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "content string, at bigint, timer bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for part in rows:
            for at, seen, content in zip(part["at_us"].tolist(), part["seen_ms"].tolist(), part["content"].tolist()):
                # Of writes of one time the greater text, so that the order of rows does not matter.
                if best is None or (at, content or "") > (best[0], best[2] or ""):
                    best = (at, seen, content)
        old = self.kept.get() if self.kept.exists() else None
        if best is None or old is not None and (old[1], old[0] or "") >= (best[0], best[2] or ""):
            return
        if old is not None:
            self.handle.deleteTimer(old[2])
        self.kept.update((best[2], best[0], best[1]))
        self.handle.registerTimer(best[1])
        yield pd.DataFrame({"draft_id": [key[0]], "content": [best[2]], "at_us": [best[0]], "event": ["saved"]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        old = self.kept.get() if self.kept.exists() else None
        if old is None or old[2] > expiredTimerInfo.getExpiryTimeInMs():
            return
        self.kept.clear()
        yield pd.DataFrame({"draft_id": [key[0]], "content": pd.Series([None], dtype=object), "at_us": [old[1]], "event": ["expired"]})

    def close(self) -> None:
        pass


def autosave_events(stream: DataFrame, ttl: str = "7 days") -> DataFrame:
    """(draft_id, content, at, event): ``saved`` when a write becomes the last of its draft, ``expired`` (no content) when the newest
    write of all is ``ttl`` or more later. A time still to come counts as now, so a write with a time far ahead ends no other's life.

    ``stream``: (draft_id, content, at); rows without a draft or a time are left out, and so are writes whose life is already over.
    Only drafts that a batch writes, and those whose timer runs out, are touched; a query that is started again goes on with its
    checkpoint's state. Needs the state store on RocksDB, which the session of the stream is set to."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    kind = stream.schema["draft_id"].dataType.simpleString()
    at = F.col("at").cast("timestamp")
    rows = stream.where("draft_id is not null and at is not null").select("draft_id", F.col("content").cast("string").alias("content"), F.unix_micros(at).alias("at_us"), F.least(at, F.current_timestamp()).alias("seen"))
    rows = rows.withColumn("seen_ms", F.unix_millis("seen")).withWatermark("seen", ttl)
    out = rows.groupBy("draft_id").transformWithStateInPandas(_Autosaves(), f"draft_id {kind}, content string, at_us bigint, event string", "Append", "EventTime")
    return out.select("draft_id", "content", F.timestamp_micros("at_us").alias("at"), "event")


def live(events: DataFrame) -> DataFrame:
    """(draft_id, content, at): what stored events leave alive. An expiry follows the write that it ends, so at equal times it counts."""
    last = events.groupBy("draft_id").agg(F.max(F.struct("at", (F.col("event") == "expired").alias("gone"), "content")).alias("r"))
    return last.where("not r.gone").select("draft_id", "r.content", "r.at")
