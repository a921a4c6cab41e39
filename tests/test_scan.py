"""Carried values and the state machine against plain loops over each key."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import audit, lifecycle, publish, scan


def rows(n=1500, seed=0, hot=0.5):
    r = random.Random(seed)
    key = lambda: 7 if r.random() < hot else r.choice([None, 1, 2, 3, 100])
    return [(i, key(), r.choice(["x", None]), r.randrange(50), r.choice([None, 1, 2, 5]), r.choice([None, None, None, f"v{i}"])) for i in range(n)]


SCHEMA = "id int, a int, b string, t int, x int, y string"


def by_key(data):
    groups = {}
    for r in sorted(data, key=lambda r: (r[3], r[0])):
        groups.setdefault((r[1], r[2]), []).append(r)
    return groups


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("batch", [10_000, 3])
def test_running(spark, inclusive, batch):
    data = rows()
    want = {}
    for group in by_key(data).values():
        total, first, last = 0, None, None
        for r in group:
            before = (total, first, last)
            total, first, last = total + (r[4] or 0), r[5] if first is None else first, last if r[5] is None else r[5]
            want[r[0]] = (total, first, last) if inclusive else before
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = scan.running(spark.createDataFrame(data, SCHEMA), ["a", "b"], ["t", "id"], sums={"s": "x"}, firsts={"f": "y"}, lasts={"l": "y"}, inclusive=inclusive)
        assert {r.id: (r.s, r.f, r.l) for r in got.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_hot_key_lies_in_many_partitions(spark):
    df = spark.createDataFrame(rows(4000, 1, 0.7), SCHEMA)
    out, tails = scan._carried(df.withColumn("v", F.lit(1)), ["a"], ["t", "id"], lambda: scan._Running(["sum"], True), "s bigint", ["v"])
    assert len(tails) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = out.where("a = 7").groupBy("_part").count().collect()
    assert len(hot) > 1 and max(r["count"] for r in hot) < 2000
    got = scan.running(df, ["a"], ["t", "id"], sums={"n": "id"})
    assert got.where("a = 7").agg(F.max("n")).first()[0] == sum(r[0] for r in rows(4000, 1, 0.7) if r[1] == 7)


def test_numbers_types_and_empty(spark):
    data = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(hours=k), dt.date(2024, 1, 1), k * 0.5) for k in range(50)]
    df = spark.createDataFrame(data, "k int, at timestamp_ntz, d date, z double")
    assert sorted((r.k, r.n) for r in scan.numbered(df, [], [F.desc("k")], "n").collect()) == [(k, 50 - k) for k in range(50)]
    got = scan.running(df, ["d"], ["k"], sums={"z": "z"}, lasts={"at": "at"}, inclusive=False).orderBy("k").collect()
    assert [r["at"] for r in got] == [None, *[r[1] for r in data[:-1]]] and got[-1].z == sum(r[3] for r in data[:-1])
    empty = scan.running(df.limit(0), ["d"], ["k"], sums={"s": "k"})
    assert empty.collect() == [] and "s" in empty.columns
    assert scan.states(df.limit(0).withColumn("to", F.lit("PENDING")), ["d"], ["k"], "to", lifecycle.STATES, lifecycle.EDGES, "DRAFT").collect() == []


def machine(requests):
    """requests of one task in order: (id, at, target, reason); what each leaves."""
    state, progress, started, ended, lasted, error = "DRAFT", 0, None, None, None, None
    out = {}
    for i, at, target, reason in requests:
        before = state
        ok = target == state or target in lifecycle.EDGES.get(state, [])
        if ok:
            state = target
            progress = lifecycle.PROGRESS.get(target, progress)
            if target in ("PENDING", "PULLING_CODE"):
                started, error = started or at, None
            if target in ("FAILED", "PUSHED", "CANCELLED", "ARCHIVED"):
                ended = at
                lasted = int((ended - started).total_seconds() * 1000) if started else lasted
            if target == "FAILED" and reason is not None:
                error = reason
        out[i] = (before, ok, state, progress, started, ended, lasted, error)
    return out


@pytest.mark.parametrize("batch", [10_000, 5])
def test_requests(spark, batch):
    """Half of all requests are for one task; many are refused; null and unknown targets and equal times occur."""
    r = random.Random(3)
    start = dt.datetime(2024, 5, 1)
    data = []
    for i in range(3000):
        task = 1 if i % 2 else r.choice([2, 3, None, 4])
        to = r.choice([*lifecycle.STATES, *lifecycle.STATES[:7], "PENDING", "FAILED", None, "NO_STATE"])
        data.append((i, task, start + dt.timedelta(minutes=r.randrange(900)), to, r.choice([None, f"r{i}"])))
    want = {}
    for task in {d[1] for d in data}:
        mine = sorted(((i, at, to, why) for i, t, at, to, why in data if t == task), key=lambda d: (d[1], d[0]))
        want |= machine(mine)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = lifecycle.requested(spark.createDataFrame(data, "id int, task_id int, at timestamp_ntz, target string, reason string")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.id: (r.state_before, r.accepted, r.state_after, r.progress, r.started_at, r.ended_at, r.duration_ms, r.error_reason) for r in got} == want
    assert all((r.error is None) == r.accepted for r in got) and 0 < sum(r.accepted for r in got) < len(got)


def test_an_end_before_any_start_leaves_no_duration(spark):
    at = dt.datetime(2024, 1, 1)
    data = [(1, 1, at, "CANCELLED", None), (2, 1, at, "PENDING", None), (3, 1, at, "PUSHED", None)]
    got = lifecycle.requested(spark.createDataFrame(data, "id int, task_id int, at timestamp_ntz, target string, reason string")).orderBy("id").collect()
    assert [(r.accepted, r.duration_ms) for r in got] == [(True, None), (True, None), (False, None)]
    assert got[2].error == "非法的状态流转: PENDING -> PUSHED"


def test_gates(spark):
    data = [(i, 1 if i % 2 else i % 5, i % 3, 10, 5) for i in range(400)]
    df = spark.createDataFrame(data, "id int, task_id int, created_at int, total_tokens bigint, estimate bigint")
    want, used = {}, {}
    for i, task, _, tokens, estimate in sorted(data, key=lambda r: (r[2], r[0])):
        before = used.get(task, 0)
        want[i] = (before, before + estimate > 300)
        used[task] = before + tokens
    gated = audit.quota_gate(df, ["task_id"], 300)
    assert {r.id: (r.used, r.blocked) for r in gated.collect()} == want
    first = {r.task_id: (r.created_at, r.id) for r in audit.first_violations(gated, ["task_id"]).collect()}
    assert first == {t: min((d[2], d[0]) for d in data if d[1] == t and want[d[0]][1]) for t in {d[1] for d in data if want[d[0]][1]}}


def test_classes_and_weights(spark):
    chunks = spark.createDataFrame([(5, "m", "B", "b"), (1, "m", "A", "a"), (2, "m", "B", "b"), (3, "m", " ", "x"), (4, "m", "C", "c"), (6, "n", "Z", "z"), (7, None, "Q", "q")], "id int, module string, class_name string, path string")
    classes = publish.class_list(chunks)
    assert sorted((r.module or "", r.place, r.class_name) for r in classes.collect()) == [("", 1, "Q"), ("m", 1, "A"), ("m", 2, "B"), ("m", 3, "C"), ("n", 1, "Z")]
    assert sorted(tuple(r) for r in publish.flow_edges(classes).collect()) == [("m", 1, "A", "B"), ("m", 2, "B", "C")]
    w = spark.createDataFrame([(1, 10), (2, 10), (3, 5), (4, None)], "id int, sort_order int")
    assert sorted(tuple(r) for r in lifecycle.reordered(w, [F.col("sort_order"), F.desc("id")]).collect()) == [(1, 10, 40), (2, 10, 30), (3, 5, 20), (4, None, 10)]


def test_statistics_in_one_scan(spark):
    """One scan of the usage in the plan; no usage gives zeros; the parts equal those computed one by one."""
    u = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr(
        "event_id AS id", "user_id AS system_id", "event_type AS model_name", "cast(value AS bigint) AS input_tokens", "cast(1 AS bigint) AS output_tokens", "cast(value AS bigint) + 1 AS total_tokens", "cast(value AS decimal(10,4)) AS cost", "ts AS created_at"
    )
    systems = spark.createDataFrame([(1, "one"), (2, "two")], "id bigint, name string")
    day = F.lit(u.agg(F.max("created_at")).first()[0])
    for system in (None, 2, -1):
        got = audit.statistics_table(u, systems, day, system)
        assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("FileScan parquet") == 1
        rows = {}
        for r in sorted(got.collect(), key=lambda r: (r.part, r.place)):
            rows.setdefault(r.part, []).append((r.key, r.tokens))
        parts = audit.statistics(u, systems, day, system)
        assert rows["totals"] == [(None, parts["totals"].first().total_tokens)]
        assert rows.get("ranking", []) == [(str(r.system_id), r.tokens) for r in sorted(parts["ranking"].collect(), key=lambda r: (-r.tokens, r.system_id))]
        assert sorted(rows.get("models", [])) == sorted(tuple(r) for r in parts["models"].collect())
        assert rows["trend"] == sorted(tuple(r) for r in parts["trend"].collect()) and len(rows["trend"]) == 7
