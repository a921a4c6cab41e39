"""Task states, drafts in review, versions and other stored-row rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import templates as T
from tessera.functions.text import has_text
from tessera.operators import scan

# States in order, and where each may go besides staying.
STATES = ["DRAFT", "PENDING", "PULLING_CODE", "PARSING_CODE", "SPLITTING_TASK", "AI_ANALYZING", "GENERATING_DOC", "PENDING_REVIEW", "REVIEWING", "CONFIRMED", "PUSHING", "PUSHED", "FAILED", "CANCELLED", "ARCHIVED"]
EDGES = {
    "DRAFT": ["PENDING", "CANCELLED"], "PENDING": ["PULLING_CODE", "CANCELLED", "FAILED"], "PULLING_CODE": ["PARSING_CODE", "FAILED", "CANCELLED"],
    "PARSING_CODE": ["SPLITTING_TASK", "FAILED", "CANCELLED"], "SPLITTING_TASK": ["AI_ANALYZING", "FAILED", "CANCELLED"], "AI_ANALYZING": ["GENERATING_DOC", "FAILED", "CANCELLED"],
    "GENERATING_DOC": ["PENDING_REVIEW", "FAILED", "CANCELLED"], "PENDING_REVIEW": ["REVIEWING", "CONFIRMED", "FAILED", "CANCELLED"], "REVIEWING": ["CONFIRMED", "PENDING_REVIEW", "CANCELLED"],
    "CONFIRMED": ["PUSHING", "ARCHIVED", "CANCELLED"], "PUSHING": ["PUSHED", "FAILED", "CANCELLED"], "FAILED": ["PENDING", "ARCHIVED"], "CANCELLED": ["PENDING", "ARCHIVED"],
}
# Progress on entering a state; others leave it.
PROGRESS = {"PENDING": 0, "PULLING_CODE": 10, "PARSING_CODE": 30, "SPLITTING_TASK": 50, "AI_ANALYZING": 70, "GENERATING_DOC": 90, "PENDING_REVIEW": 100, "CONFIRMED": 100, "PUSHED": 100}
FINAL, STARTING = ["FAILED", "PUSHED", "CANCELLED", "ARCHIVED"], ["PENDING", "PULLING_CODE"]
RUNNING = STATES[1:7]
# Step of the pipeline that a state stands for.
STEPS = {"PENDING": 0, "PULLING_CODE": 1, "PARSING_CODE": 2, "SPLITTING_TASK": 3, "AI_ANALYZING": 4, "GENERATING_DOC": 5, **dict.fromkeys(["PENDING_REVIEW", "REVIEWING", "CONFIRMED", "PUSHING", "PUSHED", "ARCHIVED"], 6)}


def _lookup(values: dict, key: Column, other: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key), other)


def edge_table(spark: SparkSession) -> DataFrame:
    """52 rows: every allowed (current, target), staying included."""
    rows = [(a, b) for a, targets in EDGES.items() for b in targets] + [(s, s) for s in STATES]
    return spark.createDataFrame(rows, "current string, target string")


def allowed(current: Column, target: Column) -> Column:
    targets = F.split(_lookup({a: ",".join(b) for a, b in EDGES.items()}, current, F.lit("")), ",")
    return F.array_contains(targets, target) | (current == target)


def checked(transitions: DataFrame) -> DataFrame:
    """Adds ``valid`` to (current, target): a join with the 52 edges."""
    edges = edge_table(transitions.sparkSession).withColumn("_ok", F.lit(True))
    return transitions.join(F.broadcast(edges), ["current", "target"], "left").withColumn("valid", F.coalesce("_ok", F.lit(False))).drop("_ok")  # 52 rows


def progress(status: Column, before: Column) -> Column:
    return _lookup(PROGRESS, status, before)


def step_index(status: Column) -> Column:
    return _lookup(STEPS, status, F.lit(-1))


def history(steps: DataFrame, key: str = "task_id", order: str = "at") -> DataFrame:
    """(key, at, status) rows with progress, started_at, ended_at and duration_ms as each step leaves them."""
    w = W.partitionBy(key).orderBy(order, "status")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    out = steps.withColumn("progress", F.coalesce(F.last(_lookup(PROGRESS, F.col("status"), F.lit(None).cast("int")), ignorenulls=True).over(upto), F.lit(0)))
    out = out.withColumn("started_at", F.first(F.when(F.col("status").isin(STARTING), F.col(order)), ignorenulls=True).over(upto))
    out = out.withColumn("ended_at", F.last(F.when(F.col("status").isin(FINAL), F.col(order)), ignorenulls=True).over(upto))
    return out.withColumn("duration_ms", F.expr("timestampdiff(MILLISECOND, started_at, ended_at)")).withColumn("previous", F.lag("status").over(w))


def requested(requests: DataFrame, key: str = "task_id", order: tuple = ("at", "id"), target: str = "target", reason: str = "reason") -> DataFrame:
    """Requests (key, order, target, reason) through the state machine, one after another for each key from DRAFT: adds state_before,
    accepted, state_after, error (what a refusal says), and as each request leaves them progress, started_at, ended_at, duration_ms
    and error_reason. A refused request leaves everything as it was. ``order``: a time, then what tells requests of one time apart."""
    out = scan.states(requests, [key], list(order), target, STATES, EDGES, "DRAFT")
    at, to, ok = F.col(order[0]), F.col(target), F.col("accepted")
    # A start clears the reason of a failure, so both write it. Starts and ends keep their order, so that an end before the
    # first start leaves no duration.
    reasons = F.when(ok & to.isin(STARTING), F.struct(F.lit(None).cast("string").alias("r"))).when(ok & (to == "FAILED") & F.col(reason).isNotNull(), F.struct(F.col(reason).alias("r")))
    when = F.struct(*order)
    marked = out.withColumns({"_progress": F.when(ok, _lookup(PROGRESS, to, F.lit(None).cast("int"))), "_start": F.when(ok & to.isin(STARTING), when), "_end": F.when(ok & to.isin(FINAL), when), "_reason": reasons})
    done = scan.running(marked, [key], list(order), firsts={"_first": "_start"}, lasts={"_progress": "_progress", "_last": "_end", "_reason": "_reason"})
    started, ended = F.col("_first")[order[0]], F.col("_last")[order[0]]
    refusal = F.concat(F.lit(T.REFUSED), F.col("state_before"), F.lit(" -> "), F.coalesce(to, F.lit("null")))
    done = done.withColumns({
        "error": F.when(~ok, refusal), "progress": F.coalesce("_progress", F.lit(0)), "started_at": started, "ended_at": ended,
        "duration_ms": F.when(F.col("_last") > F.col("_first"), F.timestamp_diff("MILLISECOND", started, ended)), "error_reason": F.col("_reason.r"),
    })
    return done.drop("_progress", "_start", "_end", "_reason", "_first", "_last")


def transition_text(current: Column, target: Column, reason: Column) -> Column:
    head, between, why = (F.lit(x) for x in T.TRANSITION)
    return F.concat(head, current, between, target, F.when(reason.isNotNull(), F.concat(why, reason)).otherwise(F.lit("")))


def log_lines(task: DataFrame) -> DataFrame:
    """Adds ``lines`` to (id, type, status, system_id, system_name, progress, error_reason)."""
    s = lambda c: F.col(c).cast("string")
    base = [
        F.concat(F.lit("[task:"), s("id"), F.lit("] type="), F.col("type"), F.lit(" status="), F.col("status")),
        F.concat(F.lit("[system:"), s("system_id"), F.lit("] "), F.coalesce("system_name", F.lit(T.LOG_NO_SYSTEM))), F.concat(F.lit("[progress] 已完成 "), s("progress"), F.lit("%")),
    ]
    status = F.col("status")
    more = F.when(status == "DRAFT", F.lit(T.LOG_DRAFT)).when(status.isin(RUNNING), F.lit(T.LOG_RUNNING))
    more = more.when(status == "FAILED", F.concat(F.lit("[error] "), F.when(F.coalesce("error_reason", F.lit("")) != "", F.col("error_reason")).otherwise(F.lit(T.LOG_NO_REASON))))
    more = more.when(status.isin("PENDING_REVIEW", "REVIEWING", "CONFIRMED", "PUSHED"), F.lit(T.LOG_RESULT))
    return task.withColumn("lines", F.filter(F.array(*base, more), lambda x: x.isNotNull()))


def source_error(requests: DataFrame, systems: DataFrame, repositories: DataFrame) -> DataFrame:
    """Adds ``error``: the first rule that (system_id, repository_id) breaks, null if none."""
    s = systems.select(F.col("id").alias("system_id"), F.col("status").alias("_status"), F.lit(True).alias("_s"))
    r = repositories.select(F.col("id").alias("repository_id"), F.col("system_id").alias("_of"), F.lit(True).alias("_r"))
    e = [F.lit(x) for x in T.SOURCE_ERRORS]
    rule = F.when(F.col("system_id").isNull() | F.col("repository_id").isNull(), e[0]).when(F.col("_s").isNull(), e[1]).when(F.coalesce("_status", F.lit(0)) != 1, e[2])
    rule = rule.when(F.col("_r").isNull(), e[3]).when(~F.col("_of").eqNullSafe(F.col("system_id")), e[4])
    return requests.join(s, "system_id", "left").join(r, "repository_id", "left").withColumn("error", rule).drop("_status", "_s", "_of", "_r")


# --- drafts --------------------------------------------------------------------


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], kept: list[str], changed: list[str]) -> DataFrame:
    """Rows of both by ``keys``: new rows come in whole, known rows take ``changed`` and keep ``kept``."""
    j = stored.alias("o").join(new.alias("n"), keys, "full_outer")
    return j.select(*keys, *[F.coalesce(f"o.{c}", f"n.{c}").alias(c) for c in kept], *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in changed])


def draft_content(drafts: DataFrame, saved: DataFrame, local: DataFrame, files: DataFrame) -> DataFrame:
    """Adds ``content``: the first non-blank of the saved and the local autosave, then the file, then an empty document."""
    one = lambda df, name: df.groupBy("draft_id").agg(F.max_by("content", "at").alias(name))
    blank = lambda c: F.when(has_text(F.col(c)), F.col(c))
    out = drafts.join(one(saved, "_a"), "draft_id", "left").join(one(local, "_b"), "draft_id", "left").join(files.select("draft_id", F.col("content").alias("_c")), "draft_id", "left")
    return out.withColumn("content", F.coalesce(blank("_a"), blank("_b"), F.col("_c"), F.lit(T.EMPTY_DRAFT))).drop("_a", "_b", "_c")


def autosaves(writes: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Last write of each draft that has not expired: (draft_id, content, at)."""
    live = writes.where(F.col("at") > as_of - F.expr(f"INTERVAL {days} DAYS"))
    return live.groupBy("draft_id").agg(F.max_by("content", "at").alias("content"), F.max("at").alias("at"))


def _diff_lines(c: Column) -> Column:
    """Lines without the blank ones at the end; an empty text is one empty line."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"(\r\n|\n|\r)+\z", "")
    return F.split(t, r"\r\n|\n|\r", -1)


def _only(x: Column, y: Column) -> Column:
    """How many of x's lines y lacks: both sorted together, y's first among equals, and walked once."""
    known, mine = F.transform(F.array_distinct(y), lambda v: F.struct(v.alias("v"), F.lit(0).alias("k"))), F.transform(x, lambda v: F.struct(v.alias("v"), F.lit(1).alias("k")))
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).cast("bigint").alias("n"))
    step = lambda s, r: F.when(r["k"] == 0, F.struct(r["v"].alias("last"), s["n"].alias("n"))).otherwise(F.struct(s["last"].alias("last"), (s["n"] + F.when(s["last"].eqNullSafe(r["v"]), 0).otherwise(1)).cast("bigint").alias("n")))
    return F.aggregate(F.array_sort(F.concat(known, mine)), start, step, lambda s: s["n"])


def diff_counts(old: Column, new: Column) -> Column:
    """struct(added, deleted): lines of one text that the other lacks, repeats counted."""
    a, b = _diff_lines(old), _diff_lines(new)
    only = _only
    return F.struct(only(b, a).alias("added"), only(a, b).alias("deleted"))


def diff_remark(old: Column, new: Column) -> Column:
    d = diff_counts(old, new)
    return F.format_string(" [新增 %d 行, 删除 %d 行]", d["added"], d["deleted"])


def all_confirmed(drafts: DataFrame) -> DataFrame:
    """(workspace_id, completed)."""
    return drafts.groupBy("workspace_id").agg(F.bool_and(F.col("status") == "CONFIRMED").alias("completed"))


def confidence(module: Column, string_hash: Column) -> Column:
    return F.when(F.contains(module, F.lit("CoreModule")) | (string_hash % 3 == 0), F.lit(0.70)).otherwise(F.lit(0.85))


def dashboard_counts(tasks: DataFrame) -> DataFrame:
    """(running, pending) of the tasks given."""
    return tasks.agg(F.count_if(F.col("status").isin(RUNNING)).alias("running"), F.count_if(F.col("status") == "PENDING_REVIEW").alias("pending"))


def reordered(df: DataFrame, order: list[Column], weight: str = "sort_order") -> DataFrame:
    """Rows whose weight (place * 10) changes: (id, old, new)."""
    placed = scan.numbered(df.select("*", F.col(weight).alias("_old")), [], order, "_place")
    return placed.select("id", F.col("_old").alias("old"), (F.col("_place") * 10).cast("int").alias("new")).where("old is distinct from new")


def status_domain(df: DataFrame, column: str = "status") -> tuple[DataFrame, DataFrame]:
    """Rows with status 0 or 1, and the others."""
    ok = F.coalesce(F.col(column).isin(0, 1), F.lit(False))
    return df.where(ok), df.where(~ok)
