"""Module of a file: maps, knowledge, package and route rules, fallback names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.templates import FALLBACK_MODULES
from tessera.functions.text import capitalised, has_text
from tessera.operators import matching


def by_pattern(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """(path, module): the first pattern, in the order of (module_ord, path_ord), that the path contains. Backslashes count as slashes.

    ``patterns``: (module_ord, path_ord, module, pattern), of any number; a path is walked once for all of them."""
    slash = lambda c: F.replace(F.col(c), F.lit("\\"), F.lit("/"))
    paths = files.select("path").distinct().withColumn("_path", slash("path"))
    found = matching.first_pattern(paths, "_path", patterns.withColumn("pattern", slash("pattern")), ["module_ord", "path_ord"], "pattern", "module", "module")
    return found.select("path", "module").where("module is not null")


def by_knowledge(paths: DataFrame, workspaces: DataFrame, drafts: DataFrame, references: DataFrame, statuses: list[str] | None = None) -> DataFrame:
    """(system_id, path, module): the draft that refers to a file in a workspace of its system; ties go to the smallest reference."""
    d = drafts.where(F.col("status").isin(statuses)) if statuses else drafts
    r = references.select(F.col("id").alias("reference_id"), "draft_id", F.col("file_path").alias("path"))
    j = r.join(paths.select("path").distinct(), "path", "left_semi").join(d.select(F.col("id").alias("draft_id"), "workspace_id", "module_name"), "draft_id")
    j = j.join(workspaces.select(F.col("id").alias("workspace_id"), "system_id"), "workspace_id")
    return j.groupBy("system_id", "path").agg(F.min_by("module_name", "reference_id").alias("module"))


def package_rule(path: Column) -> Column:
    """Segment after ``modules`` or ``module``; else the last but one of three or more; else the first. Java files in a directory only."""
    p = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^src/main/java/", "")
    inside = F.regexp_replace(p, r"/[^/]*$", "")
    s = F.split(F.regexp_replace(inside, "/+$", ""), "/")
    n = F.size(s)
    at = F.filter(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: F.lower(F.get(s, i)).isin("modules", "module") & (i < n - 1))
    name = F.when(F.size(at) > 0, F.get(s, F.get(at, F.lit(0)) + 1)).when(n >= 3, F.get(s, n - 2)).otherwise(F.get(s, F.lit(0)))
    return F.when(path.endswith(".java") & F.contains(p, F.lit("/")), F.concat(capitalised(name), F.lit("Module")))


def route_rule(route: Column) -> Column:
    """First segment of a controller's route, one of api, v1 or v2 before it aside."""
    s = F.split(F.regexp_replace(F.trim(route), "^/+", ""), "/")
    first = F.get(s, F.lit(0))
    name = F.when(F.lower(first).isin("api", "v1", "v2") & (F.size(s) > 1), F.get(s, F.lit(1))).otherwise(first)
    return F.when(has_text(route) & has_text(first) & has_text(name), F.concat(capitalised(name), F.lit("Module")))


def fallback(path: Column) -> Column:
    out = F.lit(FALLBACK_MODULES[-1][1])
    for parts, module in reversed(FALLBACK_MODULES[:-1]):
        out = F.when(reduce(lambda a, x: a | F.contains(path, F.lit(x)), parts, F.lit(False)), F.lit(module)).otherwise(out)
    return out


def routed(chunks: DataFrame, yaml_map: DataFrame | None = None, json_map: DataFrame | None = None, confirmed: DataFrame | None = None, historical: DataFrame | None = None) -> DataFrame:
    """Adds ``module``: the first of the maps, the system's knowledge (confirmed, then historical), the package
    rule, the route rule (CLASS chunks of controllers, columns class_type and request_mapping) and the fallback."""
    out, names = chunks, []
    files = chunks.select("path").distinct()
    for k, patterns in enumerate((yaml_map, json_map)):
        if patterns is not None:
            out = out.join(by_pattern(files, patterns).withColumnRenamed("module", f"_m{k}"), "path", "left")
            names.append(F.col(f"_m{k}"))
    for k, known in enumerate((confirmed, historical)):
        if known is not None:
            out = out.join(known.withColumnRenamed("module", f"_k{k}"), ["system_id", "path"], "left")
            names.append(F.col(f"_k{k}"))
    names.append(package_rule(F.col("path")))
    if {"class_type", "request_mapping"} <= set(chunks.columns):
        names.append(F.when((F.col("chunk_type") == "CLASS") & (F.upper("class_type") == "CONTROLLER"), route_rule(F.col("request_mapping"))))
    return out.withColumn("module", F.coalesce(*names, fallback(F.col("path")))).drop("_m0", "_m1", "_k0", "_k1")
