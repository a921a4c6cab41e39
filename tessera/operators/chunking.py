"""Chunks of files, classes and methods, bounded in lines and estimated tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.templates import CHUNK_FAILED
from tessera.functions.text import MAX_LINES, MAX_TOKENS, MIN_TOKENS, content_hash, has_text, lines, token_estimate
from tessera.operators.parser import parsed

_PARTS = "array<struct<first:int,last:int,chars:bigint>>"


def too_large(content: Column, start: Column, end: Column) -> Column:
    count = F.greatest(F.lit(1), end - start + 1)
    return (count > MAX_LINES) | (token_estimate(content) > MAX_TOKENS)


def _pieces(content: Column) -> Column:
    """Lines of a chunk that is split: any line end counts, form feeds and Unicode's among them."""
    return F.split(content, r"\R", -1)


def split_parts(content: Column) -> Column:
    """Greedy parts array<struct<first, last (1-based line numbers), chars>>: a part closes before the line
    that would take it over a limit; one line is never cut.

    Blank parts are estimated as empty ones, as everywhere.
    """
    pieces = _pieces(content)
    start = F.struct(F.array().cast(_PARTS).alias("done"), F.lit(1).alias("first"), F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("chars"), F.lit(True).alias("blank"))

    def step(s: Column, line: Column) -> Column:
        joined = F.when(s["n"] == 0, F.length(line)).otherwise(s["chars"] + 1 + F.length(line)).cast("bigint")
        blank = s["blank"] & ~has_text(line)
        tokens = F.greatest(F.lit(MIN_TOKENS), F.ceil(F.when(blank, 0).otherwise(joined) / 3.0))
        cut = (s["n"] > 0) & ((s["n"] + 1 > MAX_LINES) | (tokens > MAX_TOKENS))
        closed = F.concat(s["done"], F.array(F.struct(s["first"].alias("first"), (s["first"] + s["n"] - 1).alias("last"), s["chars"].alias("chars"))))
        return F.struct(
            F.when(cut, closed).otherwise(s["done"]).alias("done"), F.when(cut, s["first"] + s["n"]).otherwise(s["first"]).alias("first"), F.when(cut, 1).otherwise(s["n"] + 1).alias("n"),
            F.when(cut, F.length(line).cast("bigint")).otherwise(joined).alias("chars"), F.when(cut, ~has_text(line)).otherwise(blank).alias("blank"),
        )

    def finish(s: Column) -> Column:
        return F.concat(s["done"], F.array(F.struct(s["first"].alias("first"), (s["first"] + s["n"] - 1).alias("last"), s["chars"].alias("chars"))))

    return F.aggregate(pieces, start, step, finish)


def method_range(source: Column, name: Column) -> Column:
    """struct<start, end>: first line that holds the name and an opening parenthesis, up to the line where
    its braces close; a line that ends with ``;`` is the whole; unclosed braces give start + 3 at most."""
    n = F.size(source)
    numbered = F.transform(source, lambda x, i: F.struct(x.alias("line"), (i + 1).alias("at")))
    hit = F.get(F.filter(numbered, lambda x: F.contains(x["line"], name) & F.contains(x["line"], F.lit("("))), F.lit(0))
    rest = F.filter(numbered, lambda x: x["at"] >= hit["at"])
    state = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("opened"), F.lit(None).cast("int").alias("end"))

    def step(s: Column, x: Column) -> Column:
        depth = s["depth"] + F.length(F.replace(x["line"], F.lit("}"), F.lit(""))) - F.length(F.replace(x["line"], F.lit("{"), F.lit("")))
        opened = s["opened"] | F.contains(x["line"], F.lit("{"))
        end = F.coalesce(s["end"], F.when(opened & (depth <= 0), x["at"]))
        return F.struct(depth.cast("int").alias("depth"), opened.alias("opened"), end.alias("end"))

    closed = F.aggregate(rest, state, step, lambda s: s["end"])
    end = F.when(F.regexp_replace(hit["line"], r"[\x00-\x20]+$", "").endswith(";"), hit["at"]).otherwise(F.coalesce(closed, F.when(hit["at"] <= 1, F.lit(1)), F.least(n, hit["at"] + 3)))
    return F.struct(F.coalesce(hit["at"], F.lit(1)).alias("start"), F.when(hit.isNull(), F.lit(1)).otherwise(F.least(end, n)).alias("end"))


def _unit(kind: str, class_name: Column, method: Column, content: Column, start: Column, end: Column) -> Column:
    return F.struct(F.lit(kind).alias("chunk_type"), class_name.alias("class_name"), method.alias("method_name"), content.alias("content"), start.cast("int").alias("start_line"), end.cast("int").alias("end_line"))


def chunks(files: DataFrame) -> DataFrame:
    """(path, class_name, method_name, chunk_type, content, content_hash, start_line, end_line, token_estimate, status, error_reason)
    of files (path, content); a null content is a file that is missing. Each file is parsed once."""
    base = files.select("path", "content", lines(F.col("content")).alias("source"))
    base = base.withColumn("parsed", F.when(F.col("content").isNotNull() & F.lower("path").endswith(".java"), parsed(F.col("path"), F.col("content"))))
    none, whole, n = F.lit(None).cast("string"), F.array_join("source", "\n"), F.size("source")
    failed = F.concat(F.lit("FAILED:Snapshot file does not exist: "), F.col("path"))
    named = F.col("parsed.class_name").isNotNull()
    units = F.concat(
        F.array(F.when(F.col("content").isNotNull(), _unit("FILE", none, none, whole, F.lit(1), n)).otherwise(_unit("FILE", none, none, failed, F.lit(1), F.lit(1)))),
        F.when(named, F.array(_unit("CLASS", F.col("parsed.class_name"), none, whole, F.lit(1), n))).otherwise(F.array()),
        F.when(named, F.transform(
            F.transform(F.col("parsed.methods"), lambda m: F.struct(m["name"].alias("name"), method_range(F.col("source"), m["name"]).alias("at"))),
            lambda m: _unit("METHOD", F.col("parsed.class_name"), m["name"], F.concat(F.array_join(F.slice("source", m["at"]["start"], m["at"]["end"] - m["at"]["start"] + 1), "\n"), F.lit("\n")), m["at"]["start"], m["at"]["end"]),
        )).otherwise(F.array()),
    )
    u = base.select("path", F.col("content").isNull().alias("missing"), F.explode(units).alias("u")).select("path", "missing", "u.*")
    text = F.when(has_text(F.col("content")), F.col("content")).otherwise(F.lit(""))
    u = u.withColumn("content", text).withColumn("large", ~F.col("missing") & too_large(F.col("content"), F.col("start_line"), F.col("end_line")))
    whole_part = F.array(F.struct(F.lit(0).alias("first"), F.lit(0).alias("last"), F.length("content").cast("bigint").alias("chars")))
    u = u.select("*", F.posexplode(F.when(F.col("large"), split_parts(F.col("content"))).otherwise(whole_part)).alias("k", "part"))
    piece = F.when(F.col("large"), F.array_join(F.slice(_pieces(F.col("content")), F.greatest(F.lit(1), F.col("part.first")), F.greatest(F.lit(0), F.col("part.last") - F.col("part.first") + 1)), "\n")).otherwise(F.col("content"))
    u = u.withColumn("piece", piece)
    return u.select(
        "path", "class_name", F.when(F.col("large") & F.col("method_name").isNotNull(), F.concat("method_name", F.lit("#part"), (F.col("k") + 1).cast("string"))).otherwise(F.col("method_name")).alias("method_name"),
        F.when(F.col("large"), F.concat("chunk_type", F.lit("_PART"))).otherwise(F.col("chunk_type")).alias("chunk_type"), F.col("piece").alias("content"), content_hash(F.col("piece")).alias("content_hash"),
        F.when(F.col("large"), F.col("start_line") + F.col("part.first") - 1).otherwise(F.col("start_line")).alias("start_line"),
        F.when(F.col("large"), F.col("start_line") + F.col("part.last") - 1).otherwise(F.col("end_line")).alias("end_line"),
        token_estimate(F.col("piece")).alias("token_estimate"), F.when(F.col("missing"), "FAILED").otherwise("PENDING").alias("status"),
        F.when(F.col("missing"), F.concat(F.lit("Snapshot file does not exist: "), F.col("path"))).alias("error_reason"),
    )


def mark(chunk_rows: DataFrame, ids: list[int], status: str, reason: str | None = None) -> DataFrame:
    """Status and reason of the chosen chunks; a failure without a reason gets the default text, any other status none."""
    mine = F.col("id").isin(ids)
    why = F.lit(reason if reason and reason.strip() else CHUNK_FAILED) if status == "FAILED" else F.lit(None).cast("string")
    return chunk_rows.withColumn("status", F.when(mine, F.lit(status)).otherwise(F.col("status"))).withColumn("error_reason", F.when(mine, why).otherwise(F.col("error_reason")))


def chunk_content(chunk_rows: DataFrame, files: DataFrame) -> DataFrame:
    """Adds ``code``: the chunk's lines, each with a line feed; a stub where the file is missing."""
    f = files.select(F.col("path").alias("path"), lines(F.col("content")).alias("_source"))
    first = F.greatest(F.lit(1), F.col("start_line"))
    count = F.greatest(F.lit(0), F.least(F.size("_source"), F.col("end_line")) - first + 1)
    code = F.array_join(F.transform(F.slice("_source", first, count), lambda x: F.concat(x, F.lit("\n"))), "")
    stub = F.concat(F.lit("class "), F.coalesce("class_name", F.lit("null")), F.lit(" { /* code stub */ }"))
    return chunk_rows.join(f, "path", "left").withColumn("code", F.when(F.col("_source").isNotNull(), code).otherwise(stub)).drop("_source")
