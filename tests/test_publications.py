"""Publications of many versions: lines against whole pages, files written by offset, the mirror, times that are missing."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessera.functions import predicates
from tessera.operators import publish, review
from tessera.sources import sinks

PARSED = "struct<class_name:string,type:string,tables:array<string>,dependencies:array<string>,methods:array<struct<name:string,request_mapping:string,http_method:string>>>"
DRAFT = "version_id int, id bigint, module_name string, file_path string, content string, status string"


@pytest.fixture(scope="module")
def inputs(spark):
    drafts = spark.createDataFrame([
        (1, 10, "b/x", "f1", "one\n- [ ] first\n- [ ] second", "CONFIRMED"), (1, 11, "a", None, None, "REVISED"), (1, 12, "gone", "f", "- [ ] no", "REJECTED"),
        (2, 20, "é 中", "f2", "text", "AI_GENERATED"), (None, 30, "n", "f3", "t", "CONFIRMED"), (4, 40, "only", "f4", "t", "PENDING_REVIEW"),
    ], DRAFT)
    references = spark.createDataFrame([(5, 10, "A.java"), (3, 11, "B.java"), (4, 10, "x.txt"), (6, 12, "A.java")], "id bigint, draft_id bigint, file_path string")
    method = ("go", "/go", None)
    parsed = spark.createDataFrame([("A.java", ("A", "CONTROLLER", ["t1", "t2"], ["b:B"], [method, ("no", None, None)])), ("B.java", ("B", "SERVICE", [], [], []))], f"path string, parsed {PARSED}")
    return drafts, references, parsed


def pages(lines):
    out = {}
    for r in sorted(lines.collect(), key=lambda r: (str(r.version_id), r.path, r.place)):
        out.setdefault((r.version_id, r.path), []).append(r)
    assert all([r.place for r in rows] == list(range(1, len(rows) + 1)) for rows in out.values())
    return {k: "".join(r.line for r in rows) for k, rows in out.items()}


def test_lines_make_the_pages(spark, inputs):
    drafts, references, parsed = inputs
    got = pages(publish.publication_lines(drafts, references, parsed, "P", "docs/p"))
    assert {v for v, _ in got} == {1, 2, None}  # version 4 has no draft that it may take
    for version in (1, 2):
        mine = drafts.where(F.col("version_id") == version).drop("version_id")
        taken = mine.where(F.col("status").isin(review.VERSION_STATES))
        whole = {r.path: r.content for r in publish.publication(mine, publish.referenced(taken, references, parsed), "P", "docs/p").collect()}
        assert {p: text for (v, p), text in got.items() if v == version} == whole
    assert got[1, "modules/b_x.md"] == "one\n- [ ] first\n- [ ] second" and got[1, "modules/a.md"] == "# a"
    assert publish.publication_lines(drafts.limit(0), references, parsed).collect() == []


def test_files_are_written_by_offset(spark, tmp_path):
    rows = [(f"d/{k}.md", i, f"é{k} line {i}\n" * (1 + i % 3)) for k in range(4) for i in range(1, 120)]
    (tmp_path / "d").mkdir()
    (tmp_path / "d/1.md").write_text("longer before " * 5000)
    sinks.write_lines(spark.createDataFrame(rows, "path string, place bigint, line string").repartition(5), str(tmp_path))
    for k in range(4):
        assert (tmp_path / f"d/{k}.md").read_text() == "".join(line for p, _, line in rows if p == f"d/{k}.md")
    with pytest.raises(Exception, match="outside"):
        sinks.write_lines(spark.createDataFrame([("../x", 1, "l")], "path string, place bigint, line string"), str(tmp_path))


def test_mirror(spark, tmp_path):
    docs = spark.createDataFrame([("task_1/a.md", "text")], "path string, content string")
    assert sinks.mirrored(docs, str(tmp_path)) and (tmp_path / "docs/code-insight/drafts/task_1/a.md").read_text() == "text"
    assert not sinks.mirrored(docs, "git@host:x.git")


def test_edits_and_decisions_without_a_time(spark):
    at = datetime(2024, 1, 1)
    drafts = spark.createDataFrame([(1, 5, "m", "u", "a", "h", "AI_GENERATED", at), (2, 6, "n", "u", "c", "h", "AI_GENERATED", at), (3, 7, "o", "u", "c", "h", "AI_GENERATED", at)], "id bigint, workspace_id bigint, module_name string, content_uri string, content string, hash string, status string, updated_at timestamp_ntz")
    edits = spark.createDataFrame([(1, "new", "x", None, None)], "draft_id bigint, content string, author string, remark string, at timestamp_ntz")
    after, revisions = review.saved(drafts, edits)
    assert [(r.content, r.status, r.updated_at) for r in after.where("id = 1").collect()] == [("new", "REVISED", at)] and revisions.count() == 1
    ws = spark.createDataFrame([(5, "OPEN", at), (6, "OPEN", at), (7, "OPEN", at)], "id bigint, status string, updated_at timestamp_ntz")
    decisions = spark.createDataFrame([(1, True, "x", None, None), (2, None, "x", "c", at), (3, False, "y", "why", None)], "draft_id bigint, confirmed boolean, author string, comment string, at timestamp_ntz")
    after, spaces, comments = review.decided(drafts, ws, decisions)
    assert {r.id: r.status for r in after.collect()} == {1: "CONFIRMED", 2: "AI_GENERATED", 3: "REJECTED"}
    assert {r.id: (r.status, r.updated_at) for r in spaces.collect()} == {5: ("COMPLETED", at), 6: ("OPEN", at), 7: ("OPEN", at)}
    assert [r.comment for r in comments.collect()] == ["why"]


def test_field_errors(spark):
    df = spark.createDataFrame([(1, None), (None, "x"), (None, None)], "a int, b string")
    rules = [(F.col("a").isNull(), "a: missing"), (F.col("b").isNull(), "b: missing")]
    assert [r[0] for r in df.select(predicates.field_errors(rules)).collect()] == ["b: missing", "a: missing", "a: missing, b: missing"]


def test_what_a_draft_is_filled_with_is_not_filled(spark):
    chunks = spark.createDataFrame([(1, "M{m}", "a/{flow}.java", "C{urls}", "m", "CLASS", 1, 2)], "id int, module string, path string, class_name string, method_name string, chunk_type string, start_line int, end_line int")
    parsed = spark.createDataFrame([], f"path string, parsed {PARSED}")
    text = publish.drafts(chunks, parsed, 1).first().content
    assert "- `C{urls} (a/{flow}.java)`\n" in text and text.startswith("# M{m} ") and "{classes}" not in text
