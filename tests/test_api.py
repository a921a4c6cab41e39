"""Read endpoints: optional filters, pages with ties, masks, empty tables."""

from datetime import datetime

from tessera import api

T0 = datetime(2024, 1, 1)


def test_pages_have_a_total_order(spark):
    df = spark.createDataFrame([(i, 1, "DRAFT", T0) for i in range(25)], "id bigint, system_id bigint, status string, created_at timestamp_ntz")
    pages = [[r.id for r in api.tasks(df, current=c).collect()] for c in (1, 2, 3, 4)]
    assert pages == [list(range(24, 14, -1)), list(range(14, 4, -1)), list(range(4, -1, -1)), []]
    assert api.tasks(df, system_id=2).count() == 0 and api.tasks(df.limit(0)).count() == 0


def test_blank_filters_do_not_filter(spark):
    df = spark.createDataFrame([(1, "Alpha", T0), (2, "beta", T0)], "id bigint, name string, created_at timestamp_ntz")
    assert api.systems(df, " ").count() == 2 and [r.id for r in api.systems(df, "lph").collect()] == [1]


def test_passwords_are_masked(spark):
    df = spark.createDataFrame([(1, 1, "u", "x", T0), (2, 1, "u", " ", T0), (3, 1, "u", None, T0)], "id bigint, system_id bigint, git_url string, password string, created_at timestamp_ntz")
    assert {r.id: r.password for r in api.repositories(df).collect()} == {1: "******", 2: " ", 3: None}


def test_new_tasks_take_the_default_model(spark):
    models = spark.createDataFrame([(1, "a", "false"), (2, "b", "true")], "id bigint, identifier string, is_default string")
    req = spark.createDataFrame([(1, 1, 1, None, T0), (1, 1, 1, "c", T0)], "system_id bigint, repository_id bigint, prompt_version int, model_name string, at timestamp_ntz")
    assert sorted(r.model_name for r in api.new_tasks(req, models).collect()) == ["b", "c"]
    assert [r.model_name for r in api.new_tasks(req.limit(1), models.limit(0)).collect()] == [None]


def test_workspace_with_drafts(spark):
    ws = spark.createDataFrame([(1, 7), (2, 8)], "id bigint, task_id bigint")
    d = spark.createDataFrame([(5, 1, "M", "f", "x"), (4, 1, "N", "g", "y")], "id bigint, workspace_id bigint, module_name string, file_path string, status string")
    assert [x.id for x in api.workspace(ws, d, 7).first().drafts] == [4, 5] and api.workspace(ws, d, 8).first().drafts is None
