"""Drafts under review and versions made of them. Many drafts, tasks or versions at a time: requests are tables, results are
the stored rows as they are afterwards and the rows to append."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import templates as T
from tessera.operators.lifecycle import all_confirmed, diff_remark

# States of drafts that a version takes, and states that the rules below set.
VERSION_STATES = ["CONFIRMED", "REVISED", "AI_GENERATED"]
REVISED, CONFIRMED, REJECTED, COMPLETED, DRAFT, PUSHED = "REVISED", "CONFIRMED", "REJECTED", "COMPLETED", "DRAFT", "PUSHED"


def _last(requests: DataFrame, key: str = "draft_id") -> DataFrame:
    """The last request of each key by ``at``; of equal ones the greatest row."""
    rest = [c for c in requests.columns if c not in (key, "at")]
    return requests.groupBy(key).agg(F.max(F.struct("at", *rest)).alias("_r")).select(key, "_r.*")


def missing(requests: DataFrame, drafts: DataFrame) -> DataFrame:
    """Requests for drafts that do not exist, with ``error``."""
    return requests.join(drafts.select(F.col("id").alias("draft_id")), "draft_id", "left_anti").withColumn("error", F.lit(T.NO_DRAFT))


def saved(drafts: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(drafts, revisions) after ``edits`` (draft_id, content, author, remark, at), one a draft, its last.

    A saved draft (id, content, content_uri, hash, status, updated_at, ...) takes the new content and its MD5 and is revised;
    a revision's remark ends with the lines added and deleted. An edit without a time comes before those with one and leaves the
    draft's time as it was. Autosaves of saved drafts go: ``without_saved``."""
    e = _last(edits).select(F.col("draft_id").alias("id"), F.col("content").alias("_new"), F.col("author").alias("_author"), F.col("remark").alias("_remark"), F.col("at").alias("_at"), F.lit(True).alias("_edit"))
    both = drafts.join(e, "id", "left")
    done = F.col("_edit").isNotNull()
    text = F.coalesce("_new", F.lit(""))
    new = {"content": text, "hash": F.md5(text), "status": F.lit(REVISED), "updated_at": F.coalesce("_at", "updated_at")}
    after = both.select(*[F.when(done, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in drafts.columns])
    remark = F.concat(F.coalesce("_remark", F.lit(T.SAVED)), diff_remark(F.coalesce("content", F.lit("")), text))
    revisions = both.where(done).select(F.col("id").alias("draft_id"), "content_uri", F.col("_author").alias("author"), remark.alias("remark"), F.col("_at").alias("created_at"))
    return after, revisions


def without_saved(autosaves: DataFrame, edits: DataFrame) -> DataFrame:
    """Autosave writes (draft_id, at, ...) but for those that a save of the draft, at or after them, has cleared."""
    last = edits.groupBy("draft_id").agg(F.max("at").alias("_saved"))
    return autosaves.join(last, "draft_id", "left").where("_saved is null or at > _saved").drop("_saved")


def decided(drafts: DataFrame, workspaces: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(drafts, workspaces, comments) after ``decisions`` (draft_id, confirmed, author, comment, at), one a draft, its last.

    A rejection leaves a comment. A workspace is completed where a draft of it was confirmed and all its drafts now are. A row whose
    ``confirmed`` is null decides nothing; one without a time comes before those with one and leaves times as they were."""
    d = _last(decisions.where("confirmed is not null")).select(F.col("draft_id").alias("id"), F.col("confirmed").alias("_yes"), F.col("author").alias("_author"), F.col("comment").alias("_comment"), F.col("at").alias("_at"))
    both = drafts.join(d, "id", "left")
    done = F.col("_yes").isNotNull()
    new = {"status": F.when(F.col("_yes"), CONFIRMED).otherwise(REJECTED), "updated_at": F.coalesce("_at", "updated_at")}
    columns = [F.when(done, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in drafts.columns]
    after = both.select(*columns)
    comments = both.where(done & ~F.col("_yes")).select(F.col("id").alias("draft_id"), F.col("_author").alias("author"), F.col("_comment").alias("comment"), F.col("_at").alias("created_at"))
    touched = both.where(done & F.col("_yes")).groupBy("workspace_id").agg(F.max("_at").alias("_at"))
    complete = all_confirmed(after).where("completed").join(touched, "workspace_id").select(F.col("workspace_id").alias("id"), "_at", F.lit(True).alias("_all"))
    ws = workspaces.join(complete, "id", "left")
    state = {"status": F.lit(COMPLETED), "updated_at": F.coalesce("_at", "updated_at")}
    ws = ws.select(*[F.when(F.col("_all").isNotNull(), state[c]).otherwise(F.col(c)).alias(c) if c in state else F.col(c) for c in workspaces.columns])
    return after, ws, comments


def draft_repositories(drafts: DataFrame, workspaces: DataFrame, repositories: DataFrame) -> DataFrame:
    """(draft_id, workspace_id, repository_id, git_url): the repository behind a draft, nulls where a link is missing."""
    w = workspaces.select(F.col("id").alias("workspace_id"), "repository_id")
    r = repositories.select(F.col("id").alias("repository_id"), "git_url")
    return drafts.select(F.col("id").alias("draft_id"), "workspace_id").join(w, "workspace_id", "left").join(r, "repository_id", "left").select("draft_id", "workspace_id", "repository_id", "git_url")


# --- versions ------------------------------------------------------------------


def version_drafts(drafts: DataFrame) -> DataFrame:
    """Drafts that a version takes."""
    return drafts.where(F.col("status").isin(VERSION_STATES))


def new_versions(requests: DataFrame, tasks: DataFrame, repositories: DataFrame, workspaces: DataFrame, drafts: DataFrame, target_branch: str, model_name: Column | str) -> DataFrame:
    """Rows of new versions from (task_id, version_num, confirmed_by, at), with ``error``: the first rule that a request breaks.

    The rules: its task exists, the task's repository, the task's workspace, and a draft to export in it."""
    t = tasks.select(F.col("id").alias("task_id"), "system_id", "repository_id", "prompt_version", F.lit(True).alias("_t"))
    r = repositories.select(F.col("id").alias("repository_id"), F.col("branch").alias("source_branch"), F.col("last_commit_id").alias("source_commit"), F.lit(True).alias("_r"))
    w = workspaces.groupBy("task_id").agg(F.min("id").alias("workspace_id"))
    d = version_drafts(drafts).groupBy("workspace_id").agg(F.count("*").alias("drafts"))
    j = requests.join(t, "task_id", "left").join(r, "repository_id", "left").join(w, "task_id", "left").join(d, "workspace_id", "left")
    no = [F.lit(x) for x in T.VERSION_ERRORS]
    error = F.when(F.col("_t").isNull(), no[0]).when(F.col("_r").isNull(), no[1]).when(F.col("workspace_id").isNull(), no[2]).when(F.col("drafts").isNull(), no[3])
    model = F.lit(model_name) if isinstance(model_name, str) else model_name
    return j.select(
        "system_id", "repository_id", "task_id", "version_num", "source_branch", "source_commit", F.lit(target_branch).alias("target_branch"), F.lit(None).cast("string").alias("target_commit"),
        "prompt_version", model.alias("model_name"), F.lit(DRAFT).alias("status"), "confirmed_by", F.col("at").alias("confirmed_at"), F.lit(None).cast("timestamp_ntz").alias("pushed_at"), F.col("at").alias("created_at"),
        F.coalesce("drafts", F.lit(0)).alias("drafts"), error.alias("error"),
    )


def pushed(versions: DataFrame, gates: DataFrame, commits: DataFrame) -> DataFrame:
    """Versions after a push: those whose gate (version_id, gate) is 0 are pushed, with the commit and time of ``commits``
    (version_id, commit, at); a version without a commit, as without a repository at hand, gets a stand-in. Others stay, with the gate."""
    g = gates.select(F.col("version_id").alias("id"), "gate")
    c = commits.groupBy(F.col("version_id").alias("id")).agg(F.max_by("commit", "at").alias("_commit"), F.max("at").alias("_at"))
    j = versions.join(g, "id", "left").join(c, "id", "left")
    ok = F.col("gate") == 0
    new = {"status": F.lit(PUSHED), "target_commit": F.coalesce("_commit", F.concat(F.lit(T.STAND_IN_COMMIT), F.col("id").cast("string"))), "pushed_at": F.col("_at")}
    return j.select(*[F.when(ok, new[c_]).otherwise(F.col(c_)).alias(c_) if c_ in new else F.col(c_) for c_ in versions.columns], "gate")


def stamped(repositories: DataFrame, runs: DataFrame) -> DataFrame:
    """Repositories with the commit and time of their last run (repository_id, commit_id, at)."""
    last = runs.groupBy(F.col("repository_id").alias("id")).agg(F.max_by("commit_id", "at").alias("_commit"), F.max("at").alias("_at"))
    j = repositories.join(last, "id", "left")
    new = {"last_commit_id": F.coalesce("_commit", "last_commit_id"), "last_decompile_at": F.coalesce("_at", "last_decompile_at")}
    return j.select(*[new[c].alias(c) if c in new else F.col(c) for c in repositories.columns])
