"""Drafts and publications: row-level indexes, documents as (path, content), push gates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import templates as T
from tessera.functions.text import all_lines, extension, file_name, has_text, lines, string_hash
from tessera.operators import scan
from tessera.operators.lifecycle import confidence
from tessera.operators.prompts import mock_summary
from tessera.operators.review import VERSION_STATES


def _text(rows: DataFrame, key: str, order: list[str], line: Column, name: str) -> DataFrame:
    """(key, name): lines joined in order."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, line.alias("_line"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["_line"]), "").alias(name))


def class_list(chunks: DataFrame) -> DataFrame:
    """(module, place, class_name, path, previous): classes of a module, once each, in the order of chunk ids, each with the class before it."""
    named = chunks.where(has_text(F.col("class_name"))).groupBy("module", "class_name", "path").agg(F.min("id").alias("_first"))
    named = named.withColumn("_one", F.lit(1).cast("bigint"))
    placed = scan.running(named, ["module"], ["_first", "class_name", "path"], sums={"_before": "_one"}, lasts={"previous": "class_name"}, inclusive=False)
    return placed.select("module", (F.col("_before") + 1).cast("int").alias("place"), "class_name", "path", "previous")


def flow_edges(classes: DataFrame) -> DataFrame:
    """(module, place, source, target): consecutive classes of a module, by the place of the first."""
    return classes.where("previous is not null").select("module", (F.col("place") - 1).alias("place"), F.col("previous").alias("source"), F.col("class_name").alias("target"))


def endpoints(chunks: DataFrame, parsed: DataFrame, distinct: bool = False) -> DataFrame:
    """(module, id, place, http_method, url, method): routed methods of the class of each chunk's file, once a chunk unless ``distinct``."""
    m = parsed.select("path", F.posexplode("parsed.methods").alias("place", "m")).where(has_text(F.col("m.request_mapping")))
    out = chunks.join(m, "path").select("module", "id", "place", F.coalesce("m.http_method", F.lit("GET")).alias("http_method"), F.col("m.request_mapping").alias("url"), F.col("m.name").alias("method"))
    return out.groupBy("module", "http_method", "url", "method").agg(F.min("id").alias("id"), F.min("place").alias("place")) if distinct else out


def drafts(chunks: DataFrame, parsed: DataFrame, task_id: int) -> DataFrame:
    """(module, file_path, content, hash, confidence, status) of each module of ``chunks``
    (id, module, path, class_name, method_name, chunk_type, start_line, end_line)."""
    tick = lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    nl = F.lit("\n")
    classes = class_list(chunks)
    java = chunks.where(F.lower(extension(F.col("path"))) == "java")
    parts = [
        _text(classes, "module", ["place"], F.concat(F.lit("- "), tick(F.concat("class_name", F.lit(" ("), "path", F.lit(")"))), nl), "classes"),
        _text(flow_edges(classes), "module", ["place"], F.concat(F.lit("  "), "source", F.lit(" --> "), "target", nl), "flow"),
        _text(endpoints(java, parsed), "module", ["id", "place"], F.concat(F.lit("- "), tick(F.col("http_method")), F.lit(" "), tick(F.col("url")), F.lit(" (方法: "), tick(F.col("method")), F.lit(")"), nl), "urls"),
        _text(java.join(parsed.select("path", F.posexplode("parsed.tables").alias("place", "table")), "path"), "module", ["id", "place"], F.concat(F.lit("- 数据表: "), tick(F.col("table")), nl), "tables"),
        _text(chunks.where("chunk_type = 'METHOD'"), "module", ["id"], F.concat(
            F.lit("### 方法: "), tick(F.col("method_name")), F.lit("\n- **所属类**: "), tick(F.col("class_name")), F.lit("\n- **行范围**: 第 "), F.col("start_line").cast("string"), F.lit(" 行到第 "),
            F.col("end_line").cast("string"), F.lit(" 行\n\n**功能逻辑分析**:\n"), mock_summary(F.col("chunk_type"), F.col("class_name"), F.col("method_name")), F.lit("\n\n"),
        ), "methods"),
        _text(chunks, "module", ["id"], F.concat(F.lit("- ["), "path", F.lit("](file:///"), "path", F.lit("#L"), F.col("start_line").cast("string"), F.lit("-L"), F.col("end_line").cast("string"), F.lit(")\n")), "sources"),
    ]
    out = chunks.select("module").distinct()
    for p in parts:
        out = out.join(p, "module", "left")
    empty = {"classes": "", "flow": T.NO_FLOW, "urls": T.NO_URLS, "tables": T.NO_TABLES, "methods": "", "sources": ""}
    # Filled in one pass, so that what is filled in is never looked through.
    fill = {"m": F.col("module")} | {k: F.coalesce(k, F.lit(v)) for k, v in empty.items()}
    body = F.concat(*[fill[x[1:-1]] if x[:1] == "{" and x[1:-1] in fill else F.lit(x) for x in re.split(r"(\{\w+\})", T.DRAFT)])
    out = out.select("module", F.concat(F.lit(f"task_{task_id}/"), file_name(F.col("module")), F.lit(".md")).alias("file_path"), body.alias("content"))
    sure = confidence(F.col("module"), string_hash(F.col("module")))
    return out.withColumn("hash", F.md5("content")).withColumn("confidence", sure).withColumn("status", F.when(sure < 0.75, "PENDING_REVIEW").otherwise("AI_GENERATED"))


def referenced(drafts_: DataFrame, references: DataFrame, parsed: DataFrame) -> DataFrame:
    """(draft_id, module_name, reference_id, parsed): one row for each reference to a Java file; a file is parsed once."""
    r = references.where(F.col("file_path").endswith(".java")).select(F.col("id").alias("reference_id"), "draft_id", F.col("file_path").alias("path"))
    return r.join(drafts_.select(F.col("id").alias("draft_id"), "module_name"), "draft_id").join(parsed.select("path", "parsed"), "path")


def api_index(ref: DataFrame) -> DataFrame:
    m = ref.select("draft_id", "reference_id", "module_name", F.posexplode("parsed.methods").alias("place", "m")).where(has_text(F.col("m.request_mapping")))
    return m.select("draft_id", "reference_id", "place", "module_name", F.col("m.request_mapping").alias("url"), F.coalesce("m.http_method", F.lit("GET")).alias("http_method"), F.col("m.name").alias("method"))


def database_index(ref: DataFrame) -> DataFrame:
    return ref.select("draft_id", "reference_id", F.posexplode("parsed.tables").alias("place", "table"), "module_name", F.col("parsed.type").alias("class_type"))


def dependency_index(ref: DataFrame) -> DataFrame:
    return ref.where(F.size("parsed.dependencies") > 0).select("draft_id", "reference_id", "module_name", F.col("parsed.class_name").alias("class_name"), F.array_join("parsed.dependencies", ", ").alias("dependencies"))


def with_placeholder(rows: DataFrame, placeholder: DataFrame) -> DataFrame:
    """The placeholder's row only where there are no others."""
    some = rows.limit(1).select(F.lit(1).alias("_k"))
    return rows.unionByName(placeholder.withColumn("_k", F.lit(1)).join(some, "_k", "left_anti").drop("_k"))


def pending_items(documents: DataFrame) -> DataFrame:
    """(module_name, line_no, item): lines that, trimmed, begin with an open box."""
    ln = documents.select("module_name", F.posexplode(lines(F.col("content"))).alias("pos", "line"))
    t = F.trim(F.regexp_replace("line", r"^[\x00-\x20]+|[\x00-\x20]+$", ""))
    return ln.withColumn("line", t).where(F.col("line").startswith("- [ ]")).select("module_name", (F.col("pos") + 1).alias("line_no"), F.trim(F.substr("line", F.lit(6))).alias("item"))


def pending_items_loose(documents: DataFrame) -> DataFrame:
    """(module_name, line_no, item) by the looser pattern of the review screen."""
    box = r"^\s*[-*]\s*\[\s*\]\s*(.*)$"
    ln = documents.select("module_name", F.posexplode(all_lines(F.col("content"))).alias("pos", "line")).where(F.col("line").rlike(box))
    item = F.trim(F.regexp_extract("line", box, 1))
    return ln.select("module_name", (F.col("pos") + 1).alias("line_no"), F.when(item == "", F.lit(T.UNNAMED_ITEM)).otherwise(item).alias("item"))


def push_gate(documents: DataFrame, version_col: str = "version_id") -> DataFrame:
    """(version_id, gate): the first gate that fails (0 none, 1 a draft not confirmed, 2 an open box, 3 a name no file may have)."""
    g = documents.groupBy(version_col).agg(
        F.bool_or(F.col("status") != "CONFIRMED").alias("a"), F.bool_or(F.contains("content", F.lit("- [ ]"))).alias("b"), F.bool_or(F.col("module_name").rlike(r'[\\/:*?"<>|]')).alias("c")
    )
    return g.select(version_col, F.when(F.col("a"), 1).when(F.col("b"), 2).when(F.col("c"), 3).otherwise(0).alias("gate"))


def publication(drafts_: DataFrame, ref: DataFrame, product: str = "平台", folder: str = "docs/knowledge") -> DataFrame:
    """(path, content) of the index files and modules of ``drafts_`` (id, module_name, file_path, content; with a status
    only those that a version takes). ``product`` is named in the pages, ``folder`` in the module map."""
    drafts_ = drafts_.where(F.col("status").isin(VERSION_STATES)) if "status" in drafts_.columns else drafts_
    spark, one = drafts_.sparkSession, F.lit(1)
    name = file_name(F.col("module_name"))
    d = drafts_.withColumn("_file", F.concat(name, F.lit(".md"))).withColumn("_k", one)

    def document(path: str, head: str, rows: DataFrame, order: list[str], line: Column, empty: str = "") -> DataFrame:
        t = _text(rows.withColumn("_k", one), "_k", order, line, "body")
        base = spark.range(1).select(one.alias("_k"))
        return base.join(t, "_k", "left").select(F.lit(path).alias("path"), F.concat(F.lit(head), F.coalesce("body", F.lit(empty))).alias("content"))

    cells = lambda *c: F.concat(F.lit("| "), F.concat_ws(" | ", *c), F.lit(" |\n"))
    tick = lambda c: F.concat(F.lit("`"), F.col(c), F.lit("`"))
    out = spark.createDataFrame([("index.md", T.MAIN_INDEX.replace("{product}", product)), ("frontend-overview.md", T.FRONT_END), ("backend-overview.md", T.BACK_END)], "path string, content string")
    parts = [
        architecture(d),
        document("module-index.md", T.MODULE_INDEX.replace("{product}", product), d, ["id"], F.concat(F.lit("- ["), "module_name", F.lit("](modules/"), "_file", F.lit(")\n"))),
        document("meta/module-map.yaml", "modules:\n", d, ["id"], F.concat(F.lit('  - name: "'), "module_name", F.lit(f'"\n    path: "{folder}/modules/'), "_file", F.lit('"\n'))),
        document("api-index.md", "# 系统接口路由索引 (API Index)\n\n", api_index(ref), ["draft_id", "reference_id", "place"], cells("module_name", tick("url"), tick("http_method"), tick("method")), T.NO_API),
        document("database-index.md", T.DATABASE_INDEX, database_index(ref), ["draft_id", "reference_id", "place"], cells(tick("table"), "module_name", F.concat("class_type", F.lit(" 类操作"))), T.NO_ROWS),
        document("dependency-index.md", T.DEPENDENCY_INDEX, dependency_index(ref), ["draft_id", "reference_id"], cells(tick("class_name"), "module_name", tick("dependencies")), T.NO_ROWS),
        document("pending-confirmation.md", T.PENDING_INDEX, pending_items(d), ["module_name", "line_no"], F.concat(F.lit("- 模块 "), tick("module_name"), F.lit(": "), "item", F.lit("\n")), T.NO_PENDING),
        d.select(F.concat(F.lit("modules/"), "_file").alias("path"), F.coalesce("content", F.concat(F.lit("# "), "module_name")).alias("content")),
    ]
    for p in parts:
        out = out.unionByName(p)
    return out


def architecture(drafts_: DataFrame) -> DataFrame:
    """(path, content) of the overview: how many modules there are, and each with its file."""
    begin, middle, end = (F.lit(x) for x in T.ARCHITECTURE)
    line = F.concat(F.lit("- **"), "module_name", F.lit("**: "), F.coalesce("file_path", F.lit("null")), F.lit("\n"))
    rows = drafts_.agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("id", line.alias("_line")))).alias("l"))
    return rows.select(F.lit("architecture-overview.md").alias("path"), F.concat(begin, F.col("n").cast("string"), middle, F.array_join(F.transform("l", lambda x: x["_line"]), ""), end).alias("content"))


def publication_metadata(versions: DataFrame) -> DataFrame:
    """(version_num, path, content): what a publication tells of itself, from version rows (version_num, system_id, task_id,
    source_commit, prompt_version, model_name, confirmed_by, created_at)."""
    at = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    keep = {"pretty": "true", "ignoreNullFields": "false"}
    version = F.struct(F.col("version_num").alias("version"), F.col("system_id").alias("systemId"), F.col("source_commit").alias("commitId"), at.alias("generatedAt"), F.col("confirmed_by").alias("confirmedBy"))
    prompt = F.struct(F.col("task_id").alias("taskId"), F.coalesce("prompt_version", F.lit(1)).alias("promptVersion"), F.col("model_name").alias("modelName"), at.alias("appliedAt"))
    both = F.array(*[F.struct(F.lit(f"meta/{n}.json").alias("path"), F.to_json(c, keep).alias("content")) for n, c in (("knowledge-version", version), ("prompt-used", prompt))])
    return versions.select("version_num", F.explode(both).alias("d")).select("version_num", "d.*")


def version_metadata(versions: DataFrame) -> DataFrame:
    """(path, content): pretty JSON of each version row."""
    return versions.select(F.concat(F.lit("meta/version-"), F.col("id").cast("string"), F.lit(".json")).alias("path"), F.to_json(F.struct("*"), {"pretty": "true"}).alias("content"))


# --- many publications at once ---------------------------------------------------


def with_placeholders(rows: DataFrame, placeholders: DataFrame, keys: list[str]) -> DataFrame:
    """``rows``, and of ``placeholders`` those whose keys have no rows."""
    return rows.unionByName(placeholders.join(rows.select(*keys).distinct(), keys, "left_anti"))


def publication_lines(drafts_: DataFrame, references: DataFrame, parsed: DataFrame, product: str = "平台", folder: str = "docs/knowledge") -> DataFrame:
    """(version_id, path, place, line): all pages of all versions, line after line (with its line feed; a draft's text is one line).

    ``drafts_``: (version_id, id, module_name, file_path, content, status); a version takes drafts of the states that it may take, and
    a version without any has no pages. Lines are numbered by a scan over range partitions, so no page is ever in one row or task."""
    d = drafts_.where(F.col("status").isin(VERSION_STATES)).withColumn("_file", F.concat(file_name(F.col("module_name")), F.lit(".md")))
    versions = d.groupBy("version_id").agg(F.count("*").alias("n"))
    of = d.select(F.col("id").alias("draft_id"), "version_id")
    ref = referenced(d, references, parsed)
    HEAD, ROWS, TAIL = 0, 1, 2
    none = F.lit(None).cast("bigint")

    def lines_(rows: DataFrame, path: Column | str, line: Column, section: int = ROWS, a: Column = none, b: Column = none, c: Column = none, text: Column | None = None) -> DataFrame:
        path = F.lit(path) if isinstance(path, str) else path
        order = [x.cast("bigint").alias(k) for k, x in (("_a", a), ("_b", b), ("_c", c))]
        return rows.select("version_id", path.alias("path"), F.lit(section).alias("_section"), (F.lit(None).cast("string") if text is None else text).alias("_text"), *order, line.alias("line"))

    def table(path: str, rows: DataFrame, empty: str, line: Column, **order) -> DataFrame:
        return with_placeholders(lines_(rows, path, line, **order), lines_(versions, path, F.lit(empty)), ["version_id"])

    cells = lambda *x: F.concat(F.lit("| "), F.concat_ws(" | ", *x), F.lit(" |\n"))
    tick = lambda x: F.concat(F.lit("`"), F.col(x), F.lit("`"))
    by_reference = {"a": F.col("draft_id"), "b": F.col("reference_id")}
    pages = "index.md", "frontend-overview.md", "backend-overview.md", "architecture-overview.md", "module-index.md", "meta/module-map.yaml", "api-index.md", "database-index.md", "dependency-index.md", "pending-confirmation.md"
    begin, middle, end = T.ARCHITECTURE
    heads = {
        "index.md": F.lit(T.MAIN_INDEX.replace("{product}", product)), "frontend-overview.md": F.lit(T.FRONT_END), "backend-overview.md": F.lit(T.BACK_END),
        "architecture-overview.md": F.concat(F.lit(begin), F.col("n").cast("string"), F.lit(middle)), "module-index.md": F.lit(T.MODULE_INDEX.replace("{product}", product)), "meta/module-map.yaml": F.lit(T.MODULE_MAP),
        "api-index.md": F.lit(T.API_INDEX), "database-index.md": F.lit(T.DATABASE_INDEX), "dependency-index.md": F.lit(T.DEPENDENCY_INDEX), "pending-confirmation.md": F.lit(T.PENDING_INDEX),
    }
    head = versions.select("version_id", F.explode(F.array(*[F.struct(F.lit(p).alias("path"), heads[p].alias("line")) for p in pages])).alias("h"))
    items = pending_items(d.withColumn("module_name", F.struct("version_id", "id", "module_name"))).select("module_name.*", "line_no", "item")
    with_version = lambda rows: rows.join(of, "draft_id")
    parts = [
        lines_(head, F.col("h.path"), F.col("h.line"), HEAD),
        lines_(d, "architecture-overview.md", F.concat(F.lit("- **"), "module_name", F.lit("**: "), F.coalesce("file_path", F.lit("null")), F.lit("\n")), a=F.col("id")),
        lines_(versions, "architecture-overview.md", F.lit(end), TAIL),
        lines_(d, "module-index.md", F.concat(F.lit("- ["), "module_name", F.lit("](modules/"), "_file", F.lit(")\n")), a=F.col("id")),
        lines_(d, "meta/module-map.yaml", F.concat(F.lit('  - name: "'), "module_name", F.lit(f'"\n    path: "{folder}/modules/'), "_file", F.lit('"\n')), a=F.col("id")),
        table("api-index.md", with_version(api_index(ref)), T.NO_API, cells("module_name", tick("url"), tick("http_method"), tick("method")), **by_reference, c=F.col("place")),
        table("database-index.md", with_version(database_index(ref)), T.NO_ROWS, cells(tick("table"), "module_name", F.concat("class_type", F.lit(" 类操作"))), **by_reference, c=F.col("place")),
        table("dependency-index.md", with_version(dependency_index(ref)), T.NO_ROWS, cells(tick("class_name"), "module_name", tick("dependencies")), **by_reference),
        table("pending-confirmation.md", items, T.NO_PENDING, F.concat(F.lit("- 模块 "), tick("module_name"), F.lit(": "), "item", F.lit("\n")), text=F.col("module_name"), a=F.col("line_no"), b=F.col("id")),
        lines_(d, F.concat(F.lit("modules/"), "_file"), F.coalesce("content", F.concat(F.lit("# "), "module_name")), a=F.col("id")),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return scan.numbered(every, ["version_id", "path"], ["_section", "_text", "_a", "_b", "_c", "line"], "place").select("version_id", "path", "place", "line")
