"""Optional filters, paging and path predicates."""

from __future__ import annotations

from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import extension, has_text


def given(value: Any) -> bool:
    return value is not None and (not isinstance(value, str) or value.strip() != "")


def where_given(df: DataFrame, equal: dict[str, Any] | None = None, contains: dict[str, str] | None = None, within: dict[str, list] | None = None, at_least: dict[str, Any] | None = None, other_than: dict[str, Any] | None = None) -> DataFrame:
    """Filters by those conditions whose value is given; the predicates reach the scan."""
    found = [F.col(c) == v for c, v in (equal or {}).items() if given(v)]
    found += [F.contains(F.col(c), F.lit(v)) for c, v in (contains or {}).items() if given(v)]
    found += [F.col(c).isin(v) for c, v in (within or {}).items() if v is not None]
    found += [F.col(c) >= v for c, v in (at_least or {}).items() if given(v)]
    found += [F.col(c) != v for c, v in (other_than or {}).items() if given(v)]
    return df.where(reduce(and_, found)) if found else df


def page(df: DataFrame, order: list[Column], current: int = 1, size: int = 10) -> DataFrame:
    """One page in a total order; only offset + size rows leave each partition."""
    current, size = max(1, current), max(0, size)
    return df.orderBy(*order).offset((current - 1) * size).limit(size)


def page_envelope(df: DataFrame, current: int, size: int) -> DataFrame:
    """(total, size, current)."""
    return df.agg(F.count("*").alias("total")).select("total", F.lit(size).cast("bigint").alias("size"), F.lit(current).cast("bigint").alias("current"))


def directory(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit(""))


def directory_excluded(path: Column, entries: list[str]) -> Column:
    """The directory contains one of the trimmed entries, whatever their case."""
    at = F.lower(directory(path))
    return reduce(lambda a, e: a | F.contains(at, F.lit(e.strip().lower())), [e for e in entries if given(e)], F.lit(False))


def type_excluded(path: Column, entries: list[str]) -> Column:
    """The extension is one of the entries, dots and case aside."""
    ext = F.lower(extension(F.substring_index(path, "/", -1)))
    return ext.isin([e.strip().replace(".", "").lower() for e in entries if given(e)])


def hidden_or_built(path: Column) -> Column:
    """A directory of the path starts with a dot or is a build folder."""
    parts = F.split(directory(path), "/")
    return F.exists(parts, lambda x: x.startswith(".") | x.isin("target", "node_modules"))


def scanned(files: DataFrame, exclude_dirs: str | None = None, exclude_types: str | None = None, path: str = "path") -> DataFrame:
    """The files that a scan keeps; exclusions are comma-separated."""
    p = F.col(path)
    out = files.where(~hidden_or_built(p))
    if given(exclude_dirs):
        out = out.where(~directory_excluded(p, exclude_dirs.split(",")))
    if given(exclude_types):
        out = out.where(~type_excluded(p, exclude_types.split(",")))
    return out


def field_errors(rules: list[tuple[Column, str]]) -> Column:
    """The messages of the rules (broken, message) that a row breaks, in their order, joined by a comma and a space; null if none."""
    said = F.concat_ws(", ", *[F.when(broken, F.lit(message)) for broken, message in rules])
    return F.when(said != "", said)


__all__ = ["directory", "directory_excluded", "field_errors", "given", "has_text", "hidden_or_built", "page", "page_envelope", "scanned", "type_excluded", "where_given"]
