"""Prompts, model choice and the mock language model."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import templates as T
from tessera.functions.codetext import FIELD
from tessera.functions.templates import CLASS_SUMMARIES, DEFAULT_PROMPT, METHOD_SUMMARIES
from tessera.functions.text import has_text, redact

RESULT = "text string, input_tokens int, output_tokens int, ok boolean, error string, duration_ms bigint"


def prompt_input(prompt: Column, path: Column, code: Column) -> Column:
    system = F.when(has_text(prompt), prompt).otherwise(F.lit(DEFAULT_PROMPT))
    return redact(F.concat(system, F.lit("\n\n[代码源文件: "), path, F.lit("]\n```java\n"), code, F.lit("\n```")))


def should_mock(flag: Column, key: Column) -> Column:
    return flag | ~has_text(key) | key.startswith("test-key") | (F.lower(key) == "mock")


def mock_summary(chunk_type: Column, class_name: Column, method_name: Column) -> Column:
    c, m = F.coalesce(class_name, F.lit("UnknownClass")), F.coalesce(method_name, F.lit(""))
    by_class, by_method = F.lit(CLASS_SUMMARIES[-1][1]), F.lit(METHOD_SUMMARIES[-1][1])
    for suffix, text in reversed(CLASS_SUMMARIES[:-1]):
        by_class = F.when(c.endswith(suffix), F.replace(F.lit(text), F.lit("{}"), F.replace(c, F.lit(suffix), F.lit("")))).otherwise(by_class)
    for prefixes, text in reversed(METHOD_SUMMARIES[:-1]):
        by_method = F.when(reduce(lambda a, p: a | m.startswith(p), prefixes, F.lit(False)), F.lit(text)).otherwise(by_method)
    return F.when(chunk_type.isin("FILE", "CLASS"), by_class).otherwise(by_method)


def parse_completion(body: Column) -> Column:
    """struct(text, input_tokens, output_tokens) of a chat completion's JSON."""
    number = lambda p: F.coalesce(F.get_json_object(body, p).cast("int"), F.lit(0))
    return F.struct(F.get_json_object(body, "$.choices[0].message.content").alias("text"), number("$.usage.prompt_tokens").alias("input_tokens"), number("$.usage.completion_tokens").alias("output_tokens"))


def request_url(base: Column) -> Column:
    return F.when(base.endswith("/chat/completions"), base).otherwise(F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/chat/completions")))


def http_call(url: str, key: str, model: str, limit: float = 45, tries: int = 1, pause: float = 1) -> Callable[[str], tuple[int, str]]:
    """A ``call`` for ``complete``: posts a chat completion, each try within ``limit`` seconds. Replies 429 and 5xx and lost
    connections are tried again up to ``tries`` times in all, ``pause`` seconds apart; the calls at once are the tasks at once."""
    target = url if url.endswith("/chat/completions") else url.rstrip("/") + "/chat/completions"

    def call(prompt: str) -> tuple[int, str]:
        import time
        import urllib.error
        import urllib.request

        body = json.dumps({"model": model, "stream": False, "messages": [{"role": "user", "content": prompt}]}).encode()
        for left in range(tries - 1, -1, -1):
            request = urllib.request.Request(target, body, {"Authorization": f"Bearer {key}", "Content-Type": "application/json"})
            try:
                with urllib.request.urlopen(request, timeout=limit) as reply:
                    return reply.status, reply.read().decode("utf-8", "replace")
            except urllib.error.HTTPError as e:
                if not left or e.code != 429 and e.code < 500:
                    return e.code, e.read().decode("utf-8", "replace")
            except OSError:
                if not left:
                    raise
            time.sleep(pause)
        raise ValueError("no try was allowed")

    return call


def complete(df: DataFrame, call: Callable[[str], tuple[int, str]] | None = None, prompt: str = "prompt", mock: str = "mock") -> DataFrame:
    """Adds ``reply`` struct. ``call`` takes a prompt and gives (status, JSON body) on executors; without it, and after
    any error, other status or reply without a choice, the mock text stands in, with ok false."""
    estimate = lambda c: F.floor(F.length(c) / 3).cast("int")
    stand_in = lambda ok, error, ms: F.struct(F.col(mock).alias("text"), estimate(F.col(prompt)).alias("input_tokens"), estimate(F.col(mock)).alias("output_tokens"), ok.alias("ok"), error.alias("error"), ms.alias("duration_ms"))
    if call is None:
        return df.withColumn("reply", stand_in(F.lit(True), F.lit(None).cast("string"), F.lit(100).cast("bigint")))

    @F.pandas_udf("status int, body string, error string, ms bigint")
    def ask(prompts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import time

        for batch in prompts:
            rows = []
            for p in batch:
                began = time.monotonic()
                try:
                    status, body = call(p)
                    error = None if status == 200 else f"HTTP 错误码: {status}, 详情: {body}"
                except Exception as e:  # any failure of the service falls back to the mock text
                    status, body, error = 0, None, str(e)
                rows.append((status, body, error, int((time.monotonic() - began) * 1000)))
            yield pd.DataFrame(rows, columns=["status", "body", "error", "ms"])

    out = df.withColumn("_r", ask(prompt)).withColumn("_c", parse_completion(F.col("_r.body")))
    error = F.coalesce(F.col("_r.error"), F.when(F.get_json_object("_r.body", "$.choices[0]").isNull(), F.lit("no choice in the reply")))
    good = F.struct(F.coalesce("_c.text", F.lit("")).alias("text"), F.col("_c.input_tokens").alias("input_tokens"), F.col("_c.output_tokens").alias("output_tokens"), F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"), F.col("_r.ms").alias("duration_ms"))
    return out.withColumn("reply", F.when(error.isNull(), good).otherwise(stand_in(F.lit(False), error, F.col("_r.ms")))).drop("_r", "_c")


def with_model(tasks: DataFrame, models: DataFrame, url: str, key: str) -> DataFrame:
    """Adds active_url and active_key: the model's own where they are not blank."""
    m = models.groupBy("identifier").agg(F.min_by(F.struct("base_url", "api_key"), "id").alias("_m"))
    pick = lambda c, d: F.when(has_text(F.col(c)), F.col(c)).otherwise(F.lit(d))
    return tasks.join(m, F.col("model_name") == F.col("identifier"), "left").withColumn("active_url", pick("_m.base_url", url)).withColumn("active_key", pick("_m.api_key", key)).drop("identifier", "_m")


def resolve_prompt(tasks: DataFrame, prompts: DataFrame) -> DataFrame:
    """Adds ``prompt``: the enabled one of the task's version, else the enabled default, else the built-in text."""
    on = prompts.where("status = 1")
    by_version = on.groupBy(F.col("version").alias("prompt_version")).agg(F.min_by("content", "id").alias("_v"))
    default = on.where("is_default = 1").agg(F.min_by("content", "id").alias("_d")).select("_d", F.lit(1).alias("_one"))
    out = tasks.join(by_version, "prompt_version", "left").withColumn("_one", F.lit(1)).join(F.broadcast(default), "_one", "left")  # default is one row
    return out.withColumn("prompt", F.coalesce("_v", "_d", F.lit(DEFAULT_PROMPT))).drop("_v", "_d", "_one")


def clone(prompts: DataFrame, prompt_id: int) -> DataFrame:
    return prompts.where(F.col("id") == prompt_id).select(F.concat("name", F.lit(" - 副本")).alias("name"), "content", F.lit(1).alias("version"), F.lit(0).cast("smallint").alias("status"), F.lit(0).cast("smallint").alias("is_default"))


def edited(prompts: DataFrame, prompt_id: int, content: str) -> DataFrame:
    mine = F.col("id") == prompt_id
    return prompts.withColumn("content", F.when(mine, F.lit(content)).otherwise(F.col("content"))).withColumn("version", F.when(mine, F.col("version") + 1).otherwise(F.col("version")))


def deletable(prompts: DataFrame) -> DataFrame:
    """Default templates stay."""
    return prompts.withColumn("deletable", F.col("is_default") != 1)


def exclusive_default(df: DataFrame, chosen: int, yes: object = "true", no: object = "false", flag: str = "is_default") -> DataFrame:
    return df.withColumn(flag, F.when(F.col("id") == chosen, F.lit(yes)).otherwise(F.lit(no)))


def sample_class(code: Column) -> Column:
    found = F.regexp_extract(code, T.SAMPLE_CLASS, 1)
    return F.when(has_text(code) & (found != ""), found).otherwise(F.lit(T.NO_CLASS))


def sample_method(code: Column) -> Column:
    found = F.regexp_extract_all(code, F.lit(T.SAMPLE_METHOD), F.lit(1))
    good = F.filter(found, lambda x: ~x.isin(T.NOT_METHODS))
    return F.when(has_text(code), F.coalesce(F.get(good, F.lit(0)), F.lit(T.NO_METHOD))).otherwise(F.lit(T.NO_METHOD))


def sample_dependencies(code: Column) -> Column:
    """array of `` `name` (Type)``."""
    kinds, names = (F.regexp_extract_all(F.coalesce(code, F.lit("")), F.lit(FIELD), F.lit(g)) for g in (1, 2))
    return F.zip_with(names, kinds, lambda n, k: F.concat(F.lit("`"), n, F.lit("` ("), k, F.lit(")")))


def trial_report(code: Column, model: Column) -> Column:
    """struct(class_name, method_name, dependencies, summary, model) of a trial run."""
    c, m = sample_class(code), sample_method(code)
    return F.struct(c.alias("class_name"), m.alias("method_name"), sample_dependencies(code).alias("dependencies"), mock_summary(F.lit("CLASS"), c, m).alias("summary"), model.alias("model"))
