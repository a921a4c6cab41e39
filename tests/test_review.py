"""Review and version rules on small rows: repeats, missing links, empty tables; sinks and texts that no query reaches."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessera import api
from tessera.functions import text
from tessera.operators import audit, publish, review
from tessera.sources import sinks

T0, T1 = datetime(2024, 1, 1), datetime(2024, 1, 2)
DRAFTS = "id bigint, workspace_id bigint, module_name string, content_uri string, content string, hash string, status string, updated_at timestamp_ntz"
EDITS = "draft_id bigint, content string, author string, remark string, at timestamp_ntz"


@pytest.fixture(scope="module")
def drafts(spark):
    return spark.createDataFrame([(1, 5, "m", "u1", "a\nb", "h", "AI_GENERATED", T0), (2, 5, "n", "u2", "c", "h", "CONFIRMED", T0), (3, 6, "o", "u3", None, "h", "REJECTED", T0)], DRAFTS)


def test_the_last_edit_of_a_draft_counts(spark, drafts):
    edits = spark.createDataFrame([(1, "old", "x", None, T0), (1, "a\nz\nz", "y", None, T1), (3, None, "y", "note", T1), (9, "?", "y", None, T1)], EDITS)
    after, revisions = review.saved(drafts, edits)
    got = {r.id: (r.content, r.status) for r in after.collect()}
    assert got == {1: ("a\nz\nz", "REVISED"), 2: ("c", "CONFIRMED"), 3: ("", "REVISED")} and after.columns == drafts.columns
    assert {r.draft_id: r.remark for r in revisions.collect()} == {1: "保存修改 [新增 2 行, 删除 1 行]", 3: "note [新增 0 行, 删除 0 行]"}
    assert [r.draft_id for r in review.missing(edits, drafts).collect()] == [9]
    saves = spark.createDataFrame([(1, T0), (2, T0), (1, datetime(2024, 1, 3))], "draft_id bigint, at timestamp_ntz")
    assert sorted((r.draft_id, r.at.day) for r in review.without_saved(saves, edits).collect()) == [(1, 3), (2, 1)]
    none, no_rows = review.saved(drafts, edits.limit(0))
    assert none.count() == 3 and no_rows.count() == 0


def test_a_workspace_is_completed_by_its_last_confirmation(spark, drafts):
    ws = spark.createDataFrame([(5, "OPEN", T0), (6, "OPEN", T0)], "id bigint, status string, updated_at timestamp_ntz")
    decisions = spark.createDataFrame([(1, False, "x", "no", T0), (1, True, "x", None, T1), (3, False, "x", "why", T1)], "draft_id bigint, confirmed boolean, author string, comment string, at timestamp_ntz")
    after, spaces, comments = review.decided(drafts, ws, decisions)
    assert {r.id: r.status for r in after.collect()} == {1: "CONFIRMED", 2: "CONFIRMED", 3: "REJECTED"}
    assert {r.id: (r.status, r.updated_at) for r in spaces.collect()} == {5: ("COMPLETED", T1), 6: ("OPEN", T0)}
    assert [tuple(r) for r in comments.collect()] == [(3, "x", "why", T1)]


def test_only_usable_drafts_are_published(spark, drafts):
    d = drafts.withColumn("file_path", F.lit("f"))
    ref = publish.referenced(d, spark.createDataFrame([], "id bigint, draft_id bigint, file_path string"), spark.createDataFrame([], "path string, parsed struct<class_name:string,type:string,tables:array<string>,dependencies:array<string>,methods:array<struct<name:string,request_mapping:string,http_method:string>>>"))
    paths = {r.path: r.content for r in publish.publication(d, ref).collect()}
    assert {"modules/m.md", "modules/n.md"} <= set(paths) and "modules/o.md" not in paths and " 2 " in paths["architecture-overview.md"]
    assert "(architecture-overview.md)" in paths["index.md"] and {"frontend-overview.md", "backend-overview.md"} <= set(paths)


def test_quota_sums_cross_steps(spark):
    rows = [(i, "t", 10, 0, datetime(2024, 1, 1 + i // 5, i % 5)) for i in range(20)] + [(100, None, 500, 0, T0), (101, None, 1, 0, T1), (102, None, 1, 0, None)]
    df = spark.createDataFrame(rows, "id int, task_id string, total_tokens bigint, estimate bigint, created_at timestamp_ntz")
    got = {r.id: (r.used, r.blocked, r.first_violation) for r in audit.quota_gate(df, ["task_id"], 150).collect()}
    assert all(got[i] == (10 * i, 10 * i > 150, i == 16) for i in range(20))
    assert got[102] == (0, False, False) and got[100] == (1, False, False) and got[101] == (501, True, True)


def test_replacing_a_key_by_nothing(spark, tmp_path):
    out = str(tmp_path / "t")
    both = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "task_id int, v string")
    sinks.replace_by_key(both, out)
    sinks.replace_by_key(both.where("task_id = 1").withColumn("v", F.lit("z")), out, keys=[1, 2])
    assert sorted(tuple(r) for r in spark.read.parquet(out).select("task_id", "v").collect()) == [(1, "z"), (3, "c")]


def test_small_sinks(spark, tmp_path):
    out = str(tmp_path / "a")
    rows = spark.createDataFrame([(1, "x")], "id int, v string")
    sinks.append(rows, out)
    sinks.append(rows, out)
    assert spark.read.parquet(out).count() == 2
    both = sinks.get_or_create(rows, spark.createDataFrame([(1, "y"), (2, "y"), (2, "y")], "id int, v string"), "id")
    assert sorted(tuple(r) for r in both.collect()) == [(1, "x"), (2, "y")]
    log = sinks.operation_log(spark.createDataFrame([(1, 2, "A", "d", None, True, T0)], "system_id bigint, task_id bigint, action_type string, detail string, exception_msg string, ok boolean, created_at timestamp_ntz")).first()
    assert (log.username, log.ip_address, log.is_success) == ("Owner", "127.0.0.1", 1)


def test_string_hash_counts_utf16_units(spark):
    def plain(s):
        h = 0
        data = s.encode("utf-16-be")
        for k in range(0, len(data), 2):
            h = (h * 31 + int.from_bytes(data[k : k + 2], "big")) % 2**32
        return h - 2**32 if h >= 2**31 else h

    for s in ("", "abc", "模块A", "a😀b𝔘", "z" * 40):
        assert spark.range(1).select(text.string_hash(F.lit(s)).alias("h")).first().h == plain(s)


def test_read_endpoints(spark):
    df = spark.createDataFrame([(2, 7, T0), (1, 7, T0), (3, 8, T0)], "id bigint, task_id bigint, created_at timestamp_ntz")
    assert [r.id for r in api.snapshots(df, 7).collect()] == [1, 2] and api.get(df, 3).first().task_id == 8
    got = {r.id: r.error for r in api.found(df, spark.createDataFrame([(1,), (9,)], "id bigint")).collect()}
    assert got == {1: None, 9: "记录不存在"}
    assert [r.id for r in api.chunks(df, 7).collect()] == [1, 2]
