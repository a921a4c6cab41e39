"""Read endpoints as functions: each takes stored tables and gives a DataFrame (pages: with a total order)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.predicates import page, where_given
from tessera.functions.templates import NO_ROW
from tessera.functions.text import masked
from tessera.operators.lifecycle import STATES


def _newest(df: DataFrame, current: int, size: int) -> DataFrame:
    return page(df, [F.desc("created_at"), F.desc("id")], current, size)


def get(df: DataFrame, key: int) -> DataFrame:
    return df.where(F.col("id") == key)


def found(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of the ids in ``wanted`` (id), and for an id without a row ``error``."""
    out = wanted.select("id").join(df.withColumn("_there", F.lit(True)), "id", "left")
    return out.withColumn("error", F.when(F.col("_there").isNull(), F.lit(NO_ROW))).drop("_there")


def systems_with_repositories(df: DataFrame, repositories_: DataFrame) -> DataFrame:
    return df.join(repositories_.select(F.col("system_id").alias("id")), "id", "left_semi")


def snapshots(df: DataFrame, task_id: int) -> DataFrame:
    """A task's file snapshots in the order of their ids."""
    return df.where(F.col("task_id") == task_id).orderBy("id")


def systems(df: DataFrame, name: str | None = None, current: int = 1, size: int = 10) -> DataFrame:
    return _newest(where_given(df, contains={"name": name}), current, size)


def repositories(df: DataFrame, system_id: int | None = None, url: str | None = None, current: int = 1, size: int = 10) -> DataFrame:
    out = where_given(df, {"system_id": system_id}, contains={"git_url": url})
    return _newest(out, current, size).withColumn("password", masked(F.col("password")))


def prompt_templates(df: DataFrame, name: str | None = None, status: int | None = None, current: int = 1, size: int = 10) -> DataFrame:
    return _newest(where_given(df, {"status": status}, contains={"name": name}), current, size)


def models(df: DataFrame) -> DataFrame:
    return df.orderBy(F.asc("sort_order"), F.desc("id"))


def tasks(df: DataFrame, system_id: int | None = None, status: str | None = None, current: int = 1, size: int = 10) -> DataFrame:
    return _newest(where_given(df, {"system_id": system_id, "status": status}), current, size)


def task_progress(df: DataFrame, task_id: int) -> DataFrame:
    return get(df, task_id).select("status", "progress", "error_reason")


def new_tasks(requests: DataFrame, models_: DataFrame, kind: str = "INITIAL") -> DataFrame:
    """Rows of new tasks from (system_id, repository_id, prompt_version, model_name, at): without a model, the default one's identifier."""
    default = models_.where("is_default = 'true'").agg(F.min_by("identifier", "id").alias("_default")).withColumn("_k", F.lit(1))
    named = F.when(F.trim(F.coalesce("model_name", F.lit(""))) != "", F.col("model_name"))
    out = requests.withColumn("_k", F.lit(1)).join(F.broadcast(default), "_k", "left")  # one row
    return out.select("system_id", "repository_id", "prompt_version", F.coalesce(named, "_default").alias("model_name"), F.lit(STATES[0]).alias("status"), F.lit(kind).alias("type"), F.lit(0).alias("progress"), F.col("at").alias("created_at"))


def chunks(df: DataFrame, task_id: int) -> DataFrame:
    return df.where(F.col("task_id") == task_id).orderBy("id")


def drafts_of(drafts: DataFrame) -> DataFrame:
    """(workspace_id, drafts): the drafts of each workspace by id."""
    return drafts.groupBy("workspace_id").agg(F.array_sort(F.collect_list(F.struct("id", "module_name", "file_path", "status"))).alias("drafts"))


def workspace(workspaces: DataFrame, drafts: DataFrame, task_id: int) -> DataFrame:
    """The task's workspace with its drafts as an array."""
    d = drafts_of(drafts)
    return workspaces.where(F.col("task_id") == task_id).join(d, F.col("id") == F.col("workspace_id"), "left").drop("workspace_id")


def of_draft(df: DataFrame, draft_id: int) -> DataFrame:
    """Revisions or comments of a draft, newest first."""
    return df.where(F.col("draft_id") == draft_id).orderBy(F.desc("created_at"), F.desc("id"))


def draft_references(df: DataFrame, draft_id: int) -> DataFrame:
    return df.where(F.col("draft_id") == draft_id).orderBy("id")


def versions(df: DataFrame, system_id: int | None = None, status: str | None = None, current: int = 1, size: int = 10) -> DataFrame:
    return _newest(where_given(df, {"system_id": system_id, "status": status}), current, size)


def usage(df: DataFrame, system_id: int | None = None, task_id: int | None = None, model: str | None = None, current: int = 1, size: int = 10) -> DataFrame:
    return _newest(where_given(df, {"system_id": system_id, "task_id": task_id, "model_name": model}), current, size)


def logs(df: DataFrame, system_id: int | None = None, action: str | None = None, text: str | None = None, current: int = 1, size: int = 10) -> DataFrame:
    return _newest(where_given(df, {"system_id": system_id, "action_type": action}, contains={"detail": text}), current, size)
