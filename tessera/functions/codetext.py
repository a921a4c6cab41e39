"""Stateless extraction from lines of Java source, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import has_text

# The patterns that define what is extracted.
PACKAGE = r"^\s*package\s+([\w.]+);"
DECLARATION = r"(?:public\s+)?(?:abstract\s+|final\s+)?(@interface|class|interface|enum)\s+(\w+)"
ANNOTATION = r"@([A-Za-z][\w.]*)"
TABLE = r'@Table\s*\([^)]*?(?:name\s*=\s*)?"([^"]+)"'
METHOD = r"(?:public|protected|private|static|final|synchronized|\s)+\s+([\w<>\[\],.?\s]+)\s+(\w+)\s*\(([^)]*)\)"
FIELD = r"(?:private|protected|public)\s+(?:final\s+)?([A-Z][\w]*(?:<[^>]+>)?)\s+(\w+)\s*(?:=|;)"
CALL = r"\b(\w+)\.(\w+)\s*\("
SQL_TABLES = {k: r"(?i)\b%s\s+([`\"']?[\w.]+[`\"']?)" % k for k in ("FROM", "INTO", "UPDATE", "JOIN")}
INSERTED = r"(?i)INSERT\s+INTO\s+[\w.`\"']+\s*\(([^)]*)\)"
UPDATED = r"(?i)\bSET\s+(.+?)(?:\bWHERE\b|$)"
CONDITIONS = r"(?i)\bWHERE\b\s+(.+?)(?:\bGROUP\b|\bORDER\b|\bLIMIT\b|$)"
CONDITION_FIELD = r"([\w.]+)\s*(?:=|<>|!=|>=|<=|>|<|LIKE\b|IN\b|BETWEEN\b)"
ALIAS = r"(?i)\s+AS\s+\w+"
OPERATIONS = ["SELECT", "INSERT", "UPDATE", "DELETE"]
CONTROL_FLOW = ["if", "for", "while", "switch", "catch", "new"]
VALUE_TYPES = ["String", "Integer", "Long", "Boolean", "Double", "Float", "BigDecimal", "LocalDate", "LocalDateTime"]
# Suffixes of lower-cased class names and the type they stand for, in order.
SUFFIX_TYPES = [
    ("CONTROLLER", ["controller"]), ("SERVICE", ["service", "serviceimpl"]), ("MAPPER", ["mapper", "dao"]), ("ENTITY", ["entity", "po"]),
    ("DTO", ["dto"]), ("VO", ["vo"]), ("CONFIG", ["config", "configuration"]), ("JOB", ["job", "task", "scheduler"]),
]
# Annotation texts and the type they stand for; the first always counts, the others where nothing is known yet.
ANNOTATION_TYPES = [
    ("CONTROLLER", ["@RestController", "@Controller"]), ("SERVICE", ["@Service"]), ("MAPPER", ["@Mapper"]), ("ENTITY", ["@Entity", "@Table"]),
    ("CONFIG", ["@Configuration"]), ("JOB", ["@Scheduled", "@EnableScheduling"]),
]


def _some(pattern: str, c: Column, group: int = 1) -> Column:
    """The group of the first match, null if there is none."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def skipped(line: Column) -> Column:
    """Blank lines and lines that begin like comments, on the trimmed line."""
    return (line == "") | line.startswith("//") | line.startswith("/*") | line.startswith("*")


def package_name(line: Column) -> Column:
    return _some(PACKAGE, line)


def annotations(line: Column) -> Column:
    found = F.regexp_extract_all(line, F.lit(ANNOTATION), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.substring_index(x, ".", -1)), lambda x: x != ""))


def type_by_annotation(line: Column) -> Column:
    """Type that a line's annotations name, null if none."""
    out = F.lit(None).cast("string")
    for kind, marks in reversed(ANNOTATION_TYPES):
        out = F.when(reduce(lambda a, m: a | F.contains(line, F.lit(m)), marks, F.lit(False)), F.lit(kind)).otherwise(out)
    return out


def declaration_kind(line: Column) -> Column:
    return _some(DECLARATION, line, 1)


def declared_name(line: Column) -> Column:
    return _some(DECLARATION, line, 2)


def type_by_name(name: Column) -> Column:
    low, out = F.lower(name), F.lit("UNKNOWN")
    for kind, ends in reversed(SUFFIX_TYPES):
        out = F.when(reduce(lambda a, e: a | low.endswith(e), ends, F.lit(False)), F.lit(kind)).otherwise(out)
    return out


def first_quoted(c: Column) -> Column:
    """What stands between the first two double quotes, or ``/`` if that is missing or blank."""
    value = F.regexp_extract(c, '"([^"]*)"', 1)
    return F.when(has_text(value), value).otherwise(F.lit("/"))


def mapping_url(line: Column, annotation: str = r"\w*Mapping") -> Column:
    inside = F.regexp_extract(line, r"@%s\s*\(([^)]*)\)" % annotation, 1)
    return F.when(line.rlike(r"@%s\s*\(([^)]*)\)" % annotation), first_quoted(inside)).otherwise(first_quoted(line))


def field_dependency(line: Column) -> Column:
    """``variable:Type`` of an injected field, null for plain values."""
    kind = F.substring_index(F.regexp_extract(line, FIELD, 1), "<", 1)
    return F.when(line.rlike(FIELD) & ~kind.isin(VALUE_TYPES), F.concat_ws(":", F.regexp_extract(line, FIELD, 2), kind))


def method_signature(line: Column) -> Column:
    """struct(name, returns, arguments) of a method head, null for control flow."""
    part = lambda g: F.trim(F.regexp_extract(line, METHOD, g))
    return F.when(line.rlike(METHOD) & ~F.regexp_extract(line, METHOD, 2).isin(CONTROL_FLOW), F.struct(part(2).alias("name"), part(1).alias("returns"), part(3).alias("arguments")))


def call_sites(line: Column) -> Column:
    """array<struct<variable, method>> of ``variable.method(``."""
    a = F.regexp_extract_all(line, F.lit(CALL), F.lit(1))
    b = F.regexp_extract_all(line, F.lit(CALL), F.lit(2))
    return F.zip_with(a, b, lambda x, y: F.struct(x.alias("variable"), y.alias("method")))


def clean_identifier(c: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(c, r"[`\"']", ""), r"\$\{[^}]+\}", "")
    return F.regexp_replace(F.regexp_replace(c, r"^.*\.", ""), r"[^A-Za-z0-9_]", "")


def _clean_all(found: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(found, clean_identifier), lambda x: x != ""))


def is_sql(line: Column) -> Column:
    return line.rlike("(?i)select|insert|update|delete")


def sql_operation(line: Column) -> Column:
    up, out = F.upper(line), F.lit("UNKNOWN")
    for op in reversed(OPERATIONS):
        out = F.when(F.contains(up, F.lit(op)), F.lit(op)).otherwise(out)
    return out


def sql_tables(line: Column) -> Column:
    """Tables after FROM, INTO, UPDATE, then JOIN, each once."""
    return _clean_all(F.concat(*[F.regexp_extract_all(line, F.lit(p), F.lit(1)) for p in SQL_TABLES.values()]))


def joined_tables(line: Column) -> Column:
    return _clean_all(F.regexp_extract_all(line, F.lit(SQL_TABLES["JOIN"]), F.lit(1)))


def normal_sql(line: Column) -> Column:
    c = F.replace(line, F.lit('\\"'), F.lit('"'))
    c = F.replace(F.replace(c, F.lit("+"), F.lit(" ")), F.lit(";"), F.lit(" "))
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def _csv_fields(csv: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(csv, ","), lambda x: clean_identifier(F.regexp_replace(x, ALIAS, ""))), lambda x: x != ""))


_NONE = lambda: F.array().cast("array<string>")


def selected_fields(sql: Column) -> Column:
    """Fields between the first SELECT and the first FROM."""
    up = F.upper(sql)
    a, b = F.instr(up, "SELECT"), F.instr(up, "FROM")
    return F.when((a > 0) & (b > a), _csv_fields(F.substr(sql, a + 6, b - a - 6))).otherwise(_NONE())


def inserted_fields(sql: Column) -> Column:
    return F.when(sql.rlike(INSERTED), _csv_fields(F.regexp_extract(sql, INSERTED, 1))).otherwise(_NONE())


def updated_fields(sql: Column) -> Column:
    parts = F.transform(F.split(F.regexp_extract(sql, UPDATED, 1), ","), lambda x: clean_identifier(F.substring_index(x, "=", 1)))
    return F.when(sql.rlike(UPDATED), F.array_distinct(F.filter(parts, lambda x: x != ""))).otherwise(_NONE())


def condition_fields(sql: Column) -> Column:
    where = F.regexp_extract(sql, CONDITIONS, 1)
    return F.when(sql.rlike(CONDITIONS), _clean_all(F.regexp_extract_all(where, F.lit(CONDITION_FIELD), F.lit(1)))).otherwise(_NONE())
