"""Token-usage statistics. Usage: (system_id, task_id, model_name, input_tokens, output_tokens, total_tokens, cost, type, status, created_at)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.predicates import where_given
from tessera.operators import scan

#: USD a token in and out; tokens a task and a system in a month may use.
PRICE_IN, PRICE_OUT = 2e-6, 6e-6
TASK_QUOTA, MONTH_QUOTA = 100_000, 1_000_000


def cost(tokens_in: Column, tokens_out: Column) -> Column:
    """Rounded half up to six places, stored with four."""
    return (tokens_in * F.lit(PRICE_IN) + tokens_out * F.lit(PRICE_OUT)).cast("decimal(18,6)").cast("decimal(10,4)")


def usage_record(df: DataFrame) -> DataFrame:
    """Fills defaults and derives total and cost: (system_id, task_id, model_name, prompt_version, input_tokens, output_tokens, total_tokens, cost, status)."""
    return df.select(
        F.coalesce("system_id", F.lit(0)).cast("bigint").alias("system_id"), F.coalesce("task_id", F.lit(0)).cast("bigint").alias("task_id"),
        F.coalesce("model_name", F.lit("default")).alias("model_name"), F.coalesce("prompt_version", F.lit(1)).cast("int").alias("prompt_version"),
        "input_tokens", "output_tokens", (F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"),
        cost(F.col("input_tokens"), F.col("output_tokens")).alias("cost"), F.col("ok").cast("smallint").alias("status"),
    )


def totals(usage: DataFrame, system_id: int | None = None) -> DataFrame:
    """One row, zeros for no usage: (input_tokens, output_tokens, total_tokens, total_cost)."""
    u = where_given(usage, {"system_id": system_id})
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
    return u.agg(zero("input_tokens"), zero("output_tokens"), zero("total_tokens"), F.coalesce(F.round(F.sum("cost"), 4), F.lit(0)).cast("decimal(18,4)").alias("total_cost"))


def by_model(usage: DataFrame) -> DataFrame:
    return usage.groupBy("model_name").agg(F.sum("total_tokens").cast("bigint").alias("tokens"))


def system_ranking(usage: DataFrame, systems: DataFrame, n: int = 10) -> DataFrame:
    """Top systems by tokens, ties by id: (system_id, system_name, tokens). Names join after the limit, to n rows."""
    top = usage.groupBy("system_id").agg(F.sum("total_tokens").cast("bigint").alias("tokens")).orderBy(F.desc("tokens"), "system_id").limit(n)
    names = systems.groupBy(F.col("id").alias("system_id")).agg(F.min("name").alias("name"))
    out = top.join(names, "system_id", "left")
    return out.select("system_id", F.coalesce("name", F.concat(F.lit("系统ID: "), F.col("system_id").cast("string"))).alias("system_name"), "tokens")


def daily_trend(usage: DataFrame, as_of: Column | str, days: int = 7) -> DataFrame:
    """(day yyyy-MM-dd, tokens) of the last ``days`` calendar days, zero-filled. ``as_of``: a date literal."""
    spine = usage.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(F.to_date(as_of), days - 1), F.to_date(as_of))).alias("day"))
    # Bounds on the stored time itself, so that the scan can use them.
    first, after = (F.date_add(F.to_date(as_of), k).cast("timestamp_ntz") for k in (1 - days, 1))
    recent = usage.where((F.col("created_at") >= first) & (F.col("created_at") < after))
    sums = recent.groupBy(F.to_date("created_at").alias("day")).agg(F.sum("total_tokens").alias("t"))
    return spine.join(sums, "day", "left").select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.coalesce("t", F.lit(0)).cast("bigint").alias("tokens"))


def task_cumulative(usage: DataFrame) -> DataFrame:
    return usage.groupBy("task_id").agg(F.coalesce(F.sum("total_tokens"), F.lit(0)).cast("bigint").alias("used"))


def month_to_date(usage: DataFrame, as_of: Column) -> DataFrame:
    start = F.date_trunc("month", as_of).cast("timestamp_ntz")
    return usage.where(F.col("created_at") >= start).groupBy("system_id").agg(F.sum("total_tokens").cast("bigint").alias("used"))


def quota_used(usage: DataFrame, keys: list[str], limit: int, estimate: str = "estimate", order: tuple = ("created_at", "id")) -> DataFrame:
    """Adds used (the key's tokens before the call) and blocked. A hot key is summed in many partitions."""
    out = scan.running(usage, keys, list(order), sums={"used": "total_tokens"}, inclusive=False)
    return out.withColumn("blocked", F.col("used") + F.col(estimate) > limit)


def first_violations(gated: DataFrame, keys: list[str], order: tuple = ("created_at", "id")) -> DataFrame:
    """(keys, order): each key's first blocked call."""
    first = gated.where("blocked").groupBy(*keys).agg(F.min(F.struct(*order)).alias("_at"))
    return first.select(*keys, "_at.*")


def quota_gate(usage: DataFrame, keys: list[str], limit: int, estimate: str = "estimate", order: tuple = ("created_at", "id")) -> DataFrame:
    """``quota_used`` with first_violation; rows after the first violation are calls that a caller who stops there never makes."""
    out = quota_used(usage, keys, limit, estimate, order)
    first = first_violations(out, keys, order).select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.struct(*order).alias("_at"))
    out = out.join(first, [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)], "left")
    mine = F.col("blocked") & (F.struct(*order) == F.col("_at"))
    return out.withColumn("first_violation", F.coalesce(mine, F.lit(False))).drop("_at", *[f"_key{i}" for i in range(len(keys))])


def ranking_reversed(ranking: DataFrame) -> DataFrame:
    """The ranking as it is shown: least tokens first."""
    return ranking.orderBy("tokens", F.desc("system_id"))


def statistics(usage: DataFrame, systems: DataFrame, as_of: Column | str, system_id: int | None = None) -> dict[str, DataFrame]:
    """All parts of the statistics over one filtered scan."""
    u = where_given(usage, {"system_id": system_id})
    return {"totals": totals(u), "ranking": system_ranking(u, systems), "models": by_model(u), "trend": daily_trend(u, as_of)}


def statistics_table(usage: DataFrame, systems: DataFrame, as_of: Column | str, system_id: int | None = None, n: int = 10, days: int = 7) -> DataFrame:
    """All parts of the statistics as one result of one scan of the usage: (part, place, key, name, input_tokens, output_tokens,
    tokens, cost). Parts: ``totals`` (one row, zeros for no usage), ``ranking`` (the ``n`` systems of most tokens, ties by id),
    ``models`` (most tokens first, ties by name) and ``trend`` (the last ``days`` days, oldest first, zeros for none)."""
    u = where_given(usage, {"system_id": system_id})
    first, after = (F.date_add(F.to_date(as_of), k).cast("timestamp_ntz") for k in (1 - days, 1))
    u = u.select("system_id", "model_name", F.when((F.col("created_at") >= first) & (F.col("created_at") < after), F.to_date("created_at")).alias("day"), "input_tokens", "output_tokens", "total_tokens", "cost")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = [total("input_tokens").cast("bigint").alias("input_tokens"), total("output_tokens").cast("bigint").alias("output_tokens"), total("total_tokens").cast("bigint").alias("tokens"), F.round(total("cost"), 4).cast("decimal(18,4)").alias("cost")]
    cube = u.groupingSets([[], ["system_id"], ["model_name"], ["day"]], "system_id", "model_name", "day").agg(F.grouping_id().alias("gid"), *sums)
    gid = F.col("gid")
    # Bits of the grouping id are set for columns that a set leaves out.
    part = F.when(gid == 0b111, "totals").when(gid == 0b011, "ranking").when(gid == 0b101, "models").otherwise("trend")
    rows = cube.withColumn("part", part).where("part <> 'trend' or day is not null").drop("gid")
    zero = [F.lit(0).cast("bigint").alias(c) for c in ("input_tokens", "output_tokens", "tokens")] + [F.lit(0).cast("decimal(18,4)").alias("cost")]
    one = usage.sparkSession.range(1)
    none = [F.lit(None).cast(usage.schema[c].dataType).alias(c) for c in ("system_id", "model_name")]
    spine = one.select(*none, F.explode(F.sequence(F.to_date(F.lit(first)), F.date_sub(F.to_date(F.lit(after)), 1))).alias("day"), *zero, F.lit("trend").alias("part"))
    empty = one.select(*none, F.lit(None).cast("date").alias("day"), *zero, F.lit("totals").alias("part"))
    added = rows.unionByName(spine).unionByName(empty).groupBy("part", "system_id", "model_name", "day").agg(*[F.sum(c).cast("bigint").alias(c) for c in ("input_tokens", "output_tokens", "tokens")], F.sum("cost").cast("decimal(18,4)").alias("cost"))
    # Systems alone meet in one order; their window keeps n of each task before anything moves.
    ranks = W.partitionBy("part", "model_name", "day").orderBy(F.desc("tokens"), "system_id")
    top = added.withColumn("_r", F.row_number().over(ranks)).where(F.col("_r") <= n).drop("_r")
    order = W.partitionBy("part").orderBy("day", F.desc("tokens"), "system_id", "model_name")
    names = systems.groupBy(F.col("id").alias("system_id")).agg(F.min("name").alias("_name"))
    named = top.withColumn("place", F.row_number().over(order)).join(names, "system_id", "left")
    key = F.when(F.col("part") == "ranking", F.col("system_id").cast("string")).when(F.col("part") == "models", F.col("model_name")).when(F.col("part") == "trend", F.date_format("day", "yyyy-MM-dd"))
    name = F.when(F.col("part") == "ranking", F.coalesce("_name", F.concat(F.lit("系统ID: "), F.col("system_id").cast("string"))))
    return named.select("part", "place", key.alias("key"), name.alias("name"), "input_tokens", "output_tokens", "tokens", "cost")
