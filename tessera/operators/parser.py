"""Stateful parser of Java source: one Arrow UDF, as the rules depend on the order of lines.

Lines are read in order and trimmed; blank lines and lines that begin like
comments are passed over. Each rule may end a line's turn. A brace counter
bounds the method whose calls are collected.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import codetext as X

PARSED = (
    "struct<class_name:string,package_name:string,type:string,request_mapping:string,annotations:array<string>,dependencies:array<string>,"
    "methods:array<struct<name:string,return_type:string,arguments:string,request_mapping:string,http_method:string>>,"
    "method_calls:array<struct<caller:string,dependency:string,target:string,expression:string,line:int>>,tables:array<string>,"
    "sql:array<struct<operation:string,tables:array<string>,selected:array<string>,conditions:array<string>,inserted:array<string>,updated:array<string>,joined:array<string>>>>"
)

_C = {k: re.compile(v, re.ASCII) for k, v in {
    "package": X.PACKAGE, "declaration": X.DECLARATION, "annotation": X.ANNOTATION, "table": X.TABLE, "method": X.METHOD, "field": X.FIELD, "call": X.CALL,
    "inserted": X.INSERTED, "updated": X.UPDATED, "conditions": X.CONDITIONS, "condition": X.CONDITION_FIELD, "alias": X.ALIAS,
    **{f"sql_{k}": v for k, v in X.SQL_TABLES.items()},
}.items()}
# Annotations of routes and their verbs.
_VERBS = {"@RequestMapping": "ALL", "@GetMapping": "GET", "@PostMapping": "POST", "@PutMapping": "PUT", "@DeleteMapping": "DELETE"}
_TRIM = "".join(map(chr, range(33)))


class _Unique(list):
    def add(self, value: str) -> None:
        if value and value.strip() and value not in self:
            self.append(value)


def _identifier(text: str) -> str:
    text = re.sub(r"\$\{[^}]+\}", "", re.sub(r"[`\"']", "", text)).strip(_TRIM)
    return re.sub(r"[^A-Za-z0-9_]", "", text.rpartition(".")[2])


def _quoted(text: str) -> str:
    parts = text.split('"', 2)
    return parts[1] if len(parts) == 3 and parts[1].strip() else "/"


def _url(line: str, mark: str) -> str:
    inside = re.search(mark + r"\s*\(([^)]*)\)", line)
    return _quoted(inside[1]) if inside else _quoted(line)


def _csv(text: str) -> _Unique:
    out = _Unique()
    for part in text.split(","):
        out.add(_identifier(_C["alias"].sub("", part)))
    return out


def sql_reference(line: str) -> dict | None:
    """What a line with an SQL keyword refers to."""
    up = line.upper()
    operation = next((o for o in X.OPERATIONS if o in up), None)
    if operation is None:
        return None
    tables, joined, selected, conditions, inserted, updated = (_Unique() for _ in range(6))
    for key in X.SQL_TABLES:
        for m in _C[f"sql_{key}"].finditer(line):
            tables.add(_identifier(m[1]))
            if key == "JOIN":
                joined.add(_identifier(m[1]))
    sql = re.sub(r"\s+", " ", line.replace('\\"', '"').replace("+", " ").replace(";", " "), flags=re.ASCII).strip(_TRIM)
    if operation == "SELECT":
        a, b = sql.upper().find("SELECT"), sql.upper().find("FROM")
        if 0 <= a < b:
            selected = _csv(sql[a + 6 : b])
    elif operation == "INSERT" and (m := _C["inserted"].search(sql)):
        inserted = _csv(m[1])
    elif operation == "UPDATE" and (m := _C["updated"].search(sql)):
        for part in m[1].split(","):
            updated.add(_identifier(part.split("=")[0]))
    if operation != "INSERT" and (m := _C["conditions"].search(sql)):
        for f in _C["condition"].finditer(m[1]):
            conditions.add(_identifier(f[1]))
    return {"operation": operation, "tables": list(tables), "selected": list(selected), "conditions": list(conditions), "inserted": list(inserted), "updated": list(updated), "joined": list(joined)}


class _State:
    def __init__(self):
        self.name = self.package = self.route = None
        self.kind = "UNKNOWN"
        self.annotations, self.dependencies, self.tables = _Unique(), _Unique(), _Unique()
        self.methods, self.calls, self.sql = [], [], []
        self.types: dict[str, str] = {}
        self.pending: tuple[str | None, str | None] = (None, None)
        self.method: str | None = None
        self.depth, self.opened = 0, False

    def line(self, number: int, text: str) -> None:
        if m := _C["package"].search(text):
            self.package = m[1]
            return
        for a in _C["annotation"].findall(text):
            self.annotations.add(a.rpartition(".")[2])
        kind = next((k for k, marks in X.ANNOTATION_TYPES if any(x in text for x in marks)), None)
        if kind == "CONTROLLER" or (kind and self.kind == "UNKNOWN"):
            self.kind = kind
        if m := _C["table"].search(text):
            self.tables.add(_identifier(m[1]))
        if mark := next((v for v in _VERBS if text.startswith(v)), None):
            url = _url(text, mark)
            if mark == "@RequestMapping" and self.method is None and self.name is None:
                self.route = url
            else:
                self.pending = (url, _VERBS[mark])
            return
        if self.name is None and (m := _C["declaration"].search(text)):
            self.name = m[2]
            self.kind = {"enum": "ENUM", "@interface": "ANNOTATION"}.get(m[1], self.kind)
            return
        if m := _C["field"].search(text):
            kind = m[1].partition("<")[0]
            if kind not in X.VALUE_TYPES:
                self.types[m[2]] = kind
                self.dependencies.add(f"{m[2]}:{kind}")
        if ref := sql_reference(text):
            for t in ref["tables"]:
                self.tables.add(t)
            self.sql.append(ref)
        self.scope(number, text)

    def scope(self, number: int, text: str) -> None:
        m = _C["method"].search(text)
        begins = bool(m) and m[2] not in X.CONTROL_FLOW
        balance = text.count("{") - text.count("}")
        if begins:
            self.methods.append({"name": m[2].strip(_TRIM), "return_type": m[1].strip(_TRIM), "arguments": m[3].strip(_TRIM), "request_mapping": self.pending[0], "http_method": self.pending[1]})
            self.method, self.depth, self.opened, self.pending = m[2].strip(_TRIM), balance, "{" in text, (None, None)
        if self.method is None:
            return
        for variable, target in _C["call"].findall(text):
            if variable in self.types:
                self.calls.append({"caller": self.method, "dependency": self.types[variable], "target": target, "expression": f"{variable}.{target}()", "line": number})
        if not self.opened and "{" in text:
            self.opened = True
        elif not begins:
            self.depth += balance
        if self.opened and self.depth <= 0:
            self.method, self.depth, self.opened = None, 0, False

    def result(self) -> dict:
        if self.kind == "UNKNOWN" and self.name is not None:
            low = self.name.lower()
            self.kind = next((k for k, ends in X.SUFFIX_TYPES if low.endswith(tuple(ends))), "UNKNOWN")
        return {
            "class_name": self.name, "package_name": self.package, "type": self.kind, "request_mapping": self.route, "annotations": list(self.annotations),
            "dependencies": list(self.dependencies), "methods": self.methods, "method_calls": self.calls, "tables": list(self.tables), "sql": self.sql,
        }


def parse_source(text: str) -> dict:
    state = _State()
    lines = re.split(r"\r\n|\n|\r", text)
    for number, raw in enumerate(lines, 1):
        line = raw.strip(_TRIM)
        if line and not line.startswith(("//", "/*", "*")):
            state.line(number, line)
    return state.result()


def _parse(path: pd.Series, content: pd.Series) -> pd.DataFrame:
    empty = dict.fromkeys(_State().result())
    rows = [parse_source(c) if isinstance(p, str) and p.endswith(".java") and isinstance(c, str) else empty for p, c in zip(path, content, strict=True)]
    return pd.DataFrame(rows, columns=list(empty))


def parsed(path: Column, content: Column) -> Column:
    """The parsed struct of one file; all null for files that are not Java source."""
    return F.pandas_udf(_parse, PARSED)(path, content)


def parse_files(files: DataFrame) -> DataFrame:
    """Java files of (path, content, ...) with ``parsed``, only those that declare a class. Only Java files reach Python."""
    java = files.where(F.col("path").endswith(".java"))
    return java.withColumn("parsed", parsed(F.col("path"), F.col("content"))).where("parsed.class_name is not null")
