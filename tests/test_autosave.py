"""Autosave state over a stream: restarts, late, future and expiring writes."""

import datetime as dt

import pytest

from tessera.streaming import autosave

pytest.importorskip("google.protobuf")
SCHEMA = "draft_id int, content string, at timestamp"


def test_saves_live_on_their_own_timers(spark, tmp_path):
    source, out, day = str(tmp_path / "in"), str(tmp_path / "out"), dt.timedelta(days=1)
    start = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None) - 10 * day

    def run(*rows):
        """Each run is a query of its own, which goes on from the checkpoint."""
        rows = [(i, text, at if at is None else start + at * day) for i, text, at in rows]
        spark.createDataFrame(rows, "draft_id int, content string, at timestamp_ntz").selectExpr("draft_id", "content", "cast(at AS timestamp) AS at").coalesce(1).write.mode("append").parquet(source)
        stream = autosave.autosave_events(spark.readStream.schema(SCHEMA).parquet(source))
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(90)
        updated = sum(p["stateOperators"][0]["numRowsUpdated"] for p in q.recentProgress if p["stateOperators"])
        return {r.draft_id: r.content for r in autosave.live(spark.read.parquet(out)).collect()}, updated

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        got, _ = run((1, "a", -9), (1, "b", -5), (2, "c", -3), (None, "x", 0), (3, "old", -90), (6, "no time", None))
        assert got == {1: "b", 2: "c"}
        got, updated = run((1, "late", -6), (2, "d", -1))
        assert got == {1: "b", 2: "d"}
        assert 0 < updated <= 3  # draft 2 alone: its value and its timer
        got, _ = run((5, "e", 4))
        assert got == {2: "d", 5: "e"}
        got, _ = run((4, "far", 900))  # counts as now, ten days after the start
        assert got == {4: "far", 5: "e"}
        events = sorted((r.draft_id, r.event) for r in spark.read.parquet(out).collect())
        assert [e for e in events if e[0] < 4] == [(1, "expired"), (1, "saved"), (2, "expired"), (2, "saved"), (2, "saved"), (3, "expired"), (3, "saved")]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before) if before else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
