"""Registered queries over Java source: parsing, chunks, drafts. The source is written from ``supplier`` by one
template a kind of file, here and in SQL alike; what is expected of it stands in SQL as plain values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import templates as T
from tessera.operators import chunking, parser, publish
from tessera.plans.registry import query as _query
from tessera.sources import tables

_CONTROLLER = """package com.a{k}.web;

@RestController
@RequestMapping("/api/v{k}")
public class Item{k} {
    private final ItemService{k} service;
    private String note;

    @GetMapping("/x")
    public List<Item> list{k}() {
        return service.find{k}();
    }

    @PostMapping
    public int save{k}(int a, String b) {
        if (a > 0) {
            service.store(b);
        }
        return 0;
    }
}
"""
_MAPPER = """// rows of {k}
package p{k};
@Mapper
public interface Rows{k} {
    @Select("SELECT a.id, b.name AS n FROM demo_{k} a JOIN other b ON a.id = b.id WHERE a.key = 1")
    List<Row> all{k}();
    public abstract Row one{k}(Long id);
}
"""
_ENTITY = """package com.e{k};

@Table(name = "t_{k}")
public class Thing{k} {
    private Long id;
    protected Map<String, Owner> owner = null;
}
"""
_ENUM = "/* colours */\npublic enum Color{k} {\n    RED, BLUE\n}\n"
_MARK = "public @interface Mark{k} {\n}\n"
_LONG = "public class Order{k}ServiceImpl {\n    private final Repo{k} repo;\n    public void run{k}() {\n" + "        repo.step(1);\n" * 100 + "    }\n}\n"
_NONE = "just notes {k}\n"
#: Kind of file by supplier key modulo 7.
_KINDS = [_CONTROLLER, _MAPPER, _ENTITY, _ENUM, _MARK, _LONG, _NONE]
_CASES = " ".join(f"WHEN {i} THEN '{t.replace(chr(39), chr(39) * 2)}'" for i, t in enumerate(_KINDS))
_SOURCES = f"""src AS (SELECT CAST(s_suppkey AS VARCHAR) AS k, s_suppkey % 7 AS kind, 'f' || s_suppkey || '.java' AS path, s_suppkey % 21 = 0 AS missing,
  replace(CASE s_suppkey % 7 {_CASES} END, '{{k}}', CAST(s_suppkey AS VARCHAR)) AS content FROM supplier)"""


def _sources(spark, sf) -> DataFrame:
    key = F.col("s_suppkey")
    text = F.get(F.array(*[F.lit(t) for t in _KINDS]), (key % 7).cast("int"))
    text = F.replace(text, F.lit("{k}"), key.cast("string"))
    return tables.read(spark, sf, "supplier").select(F.concat(F.lit("f"), key.cast("string"), F.lit(".java")).alias("path"), F.when(key % 21 != 0, text).alias("content"))


# kind, class, package, type, route, annotations, dependencies, tables, methods, calls, references
_PARSED_VALUES = """(0, 'Item{k}', 'com.a{k}.web', 'CONTROLLER', '/api/v{k}', 'RestController,RequestMapping,GetMapping,PostMapping', 'service:ItemService{k}', '',
    'list{k}|List<Item>||/x|GET;save{k}|int|int a, String b|/|POST', 'list{k}|ItemService{k}|find{k}|service.find{k}()|11;save{k}|ItemService{k}|store|service.store()|17', ''),
  (1, 'Rows{k}', 'p{k}', 'MAPPER', NULL, 'Mapper,Select', '', 'demo_{k},other', 'one{k}|abstract Row|Long id||', '', 'SELECT|demo_{k},other|id,name|key||other'),
  (2, 'Thing{k}', 'com.e{k}', 'ENTITY', NULL, 'Table', 'owner:Map', 't_{k}', '', '', ''),
  (3, 'Color{k}', NULL, 'ENUM', NULL, '', '', '', '', '', ''), (4, 'Mark{k}', NULL, 'ANNOTATION', NULL, 'interface', '', '', '', '', ''),
  (5, 'Order{k}ServiceImpl', NULL, 'SERVICE', NULL, '', 'repo:Repo{k}', '', 'run{k}|void|||', (SELECT string_agg('run{k}|Repo{k}|step|repo.step()|' || n, ';' ORDER BY n) FROM range(4, 104) r(n)), '')"""


def _put(c: str) -> str:
    return f"replace({c}, '{{k}}', k) AS {c}"


_FIELDS = ["class_name", "package_name", "type", "route", "annotations", "dependencies", "tables", "methods", "calls", "refs"]


@_query(f"""WITH {_SOURCES}, want(kind, {', '.join(_FIELDS)}) AS (VALUES {_PARSED_VALUES})
  SELECT path, {', '.join(_put(c) for c in _FIELDS)} FROM src JOIN want USING (kind) WHERE NOT missing""")
def java_parse(spark, sf):
    """Every field of the parsed source; lists joined, so that both sides read alike."""
    p = F.col("parsed")
    many = lambda rows, *names: F.array_join(F.transform(rows, lambda m: F.concat_ws("|", *[F.coalesce(m[n].cast("string"), F.lit("")) for n in names])), ";")
    refs = F.transform(p["sql"], lambda s: F.concat_ws("|", s["operation"], *[F.array_join(s[n], ",") for n in ("tables", "selected", "conditions", "inserted", "joined")]))
    return parser.parse_files(_sources(spark, sf)).select(
        "path", p["class_name"].alias("class_name"), p["package_name"].alias("package_name"), p["type"].alias("type"), p["request_mapping"].alias("route"),
        *[F.array_join(p[n], ",").alias(n) for n in ("annotations", "dependencies", "tables")],
        many(p["methods"], "name", "return_type", "arguments", "request_mapping", "http_method").alias("methods"), many(p["method_calls"], "caller", "dependency", "target", "expression", "line").alias("calls"),
        F.array_join(refs, ";").alias("refs"),
    )


# kind, chunk type, class, method, lines of the file, first and last line of the chunk, what follows the last line
_CHUNK_VALUES = """(0, 'FILE', NULL, NULL, 1, 21, ''), (0, 'CLASS', 'Item{k}', NULL, 1, 21, ''), (0, 'METHOD', 'Item{k}', 'list{k}', 10, 12, chr(10)), (0, 'METHOD', 'Item{k}', 'save{k}', 15, 20, chr(10)),
  (1, 'FILE', NULL, NULL, 1, 8, ''), (1, 'CLASS', 'Rows{k}', NULL, 1, 8, ''), (1, 'METHOD', 'Rows{k}', 'one{k}', 7, 7, chr(10)), (2, 'FILE', NULL, NULL, 1, 7, ''), (2, 'CLASS', 'Thing{k}', NULL, 1, 7, ''),
  (3, 'FILE', NULL, NULL, 1, 4, ''), (3, 'CLASS', 'Color{k}', NULL, 1, 4, ''), (4, 'FILE', NULL, NULL, 1, 2, ''), (4, 'CLASS', 'Mark{k}', NULL, 1, 2, ''), (6, 'FILE', NULL, NULL, 1, 1, ''),
  (5, 'FILE_PART', NULL, NULL, 1, 80, ''), (5, 'FILE_PART', NULL, NULL, 81, 105, ''), (5, 'CLASS_PART', 'Order{k}ServiceImpl', NULL, 1, 80, ''), (5, 'CLASS_PART', 'Order{k}ServiceImpl', NULL, 81, 105, ''),
  (5, 'METHOD_PART', 'Order{k}ServiceImpl', 'run{k}#part1', 3, 82, ''), (5, 'METHOD_PART', 'Order{k}ServiceImpl', 'run{k}#part2', 83, 105, NULL)"""


@_query(f"""WITH {_SOURCES}, want(kind, chunk_type, class_name, method_name, start_line, end_line, tail) AS (VALUES {_CHUNK_VALUES}),
  c AS (SELECT path, chunk_type, replace(class_name, '{{k}}', k) AS class_name, replace(method_name, '{{k}}', k) AS method_name, start_line, end_line,
      -- the last part of a method holds its closing line end as an empty last line
      array_to_string(string_split(content, chr(10))[start_line:CASE WHEN tail IS NULL THEN 104 ELSE end_line END], chr(10)) || coalesce(tail, chr(10)) AS t FROM src JOIN want USING (kind) WHERE NOT missing)
  SELECT path, chunk_type, class_name, method_name, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, md5(t) AS content_hash, greatest(5, CAST(ceil(length(t) / 3.0) AS BIGINT)) AS token_estimate,
    'PENDING' AS status, CAST(NULL AS VARCHAR) AS error_reason FROM c
  UNION ALL SELECT path, 'FILE', NULL, NULL, 1, 1, md5('FAILED:Snapshot file does not exist: ' || path), greatest(5, CAST(ceil(length('FAILED:Snapshot file does not exist: ' || path) / 3.0) AS BIGINT)), 'FAILED',
    'Snapshot file does not exist: ' || path FROM src WHERE missing""")
def java_chunks(spark, sf):
    return chunking.chunks(_sources(spark, sf)).drop("content")


_BREAK = "\\r\\n|[\\n\\x0B\\f\\r\\x{85}\\x{2028}\\x{2029}]"


@_query(f"""WITH RECURSIVE l AS (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS k FROM (SELECT doc_id, string_split_regex(text, '{_BREAK}') AS s FROM documents WHERE text IS NOT NULL)),
  n AS (SELECT doc_id, k, length(line) AS chars, sum(length(line) + 1) OVER w AS total, regexp_matches(line, '\\S') AS some, count(*) FILTER (regexp_matches(line, '\\S')) OVER w AS filled, max(k) OVER (PARTITION BY doc_id) AS lines
    FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
  -- lines after ``first`` that would take the part over a limit; the least of them opens the next part
  p AS (SELECT doc_id, CAST(0 AS BIGINT) AS part, CAST(1 AS BIGINT) AS first FROM n WHERE k = 1
    UNION ALL SELECT p.doc_id, p.part + 1, min(n.k) FROM p JOIN n a ON a.doc_id = p.doc_id AND a.k = p.first JOIN n ON n.doc_id = p.doc_id AND n.k > p.first AND n.k <= p.first + 80
      WHERE n.k - p.first >= 80 OR ((a.some OR n.filled > a.filled) AND n.total - a.total + a.chars > 3600)
      GROUP BY p.doc_id, p.part),
  q AS (SELECT *, lead(first) OVER (PARTITION BY doc_id ORDER BY part) AS nxt FROM p)
  SELECT q.doc_id, CAST(part AS INTEGER) AS part, CAST(first AS INTEGER) AS first, CAST(z.k AS INTEGER) AS last, CAST(z.total - a.total + a.chars AS BIGINT) AS chars
  FROM q JOIN n a ON a.doc_id = q.doc_id AND a.k = q.first JOIN n z ON z.doc_id = q.doc_id AND z.k = coalesce(q.nxt - 1, z.lines)""")
def chunk_parts(spark, sf):
    d = tables.read(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", F.posexplode(chunking.split_parts(F.col("text"))).alias("part", "p")).select("doc_id", "part", "p.*")


# --- drafts ---------------------------------------------------------------------

_CHUNKS = """c AS (SELECT s_suppkey AS id, s_suppkey % 5 AS mk, 'M' || (s_suppkey % 5) || CASE WHEN s_suppkey % 5 = 0 THEN 'CoreModule' ELSE '订单😀 (A)' END AS module, 'a/C' || (s_suppkey % 40) || CASE WHEN s_suppkey % 5 = 4 THEN '.md' ELSE '.java' END AS path,
  CASE WHEN s_suppkey % 5 <> 3 THEN 'C' || (s_suppkey % 40) END AS class_name, CASE WHEN s_suppkey % 2 = 0 THEN 'getX' ELSE 'run' END AS method_name, CASE WHEN s_suppkey % 3 = 0 THEN 'METHOD' ELSE 'CLASS' END AS chunk_type, s_suppkey AS a, s_suppkey + 9 AS b FROM supplier)"""


def _cell(c: str) -> str:
    return "'`' || " + c + " || '`'"


def _draft_sql() -> str:
    body = "'" + T.DRAFT.replace("'", "''") + "'"
    for name, empty in (("classes", ""), ("flow", T.NO_FLOW), ("urls", T.NO_URLS), ("tables", T.NO_TABLES), ("methods", ""), ("sources", "")):
        body = f"replace({body}, '{{{name}}}', coalesce({name}, '{empty}'))"
    get, other = T.METHOD_SUMMARIES[0][1], T.METHOD_SUMMARIES[-1][1]
    return f"""WITH {_CHUNKS}, k AS (SELECT module, class_name, path, row_number() OVER (PARTITION BY module ORDER BY min(id)) AS place FROM c WHERE class_name IS NOT NULL GROUP BY 1, 2, 3),
      f AS (SELECT module, place, class_name AS s, lead(class_name) OVER (PARTITION BY module ORDER BY place) AS t FROM k),
      classes AS (SELECT module, string_agg('- ' || {_cell("class_name || ' (' || path || ')'")} || chr(10), '' ORDER BY place) AS classes FROM k GROUP BY 1),
      flow AS (SELECT module, string_agg('  ' || s || ' --> ' || t || chr(10), '' ORDER BY place) AS flow FROM f WHERE t IS NOT NULL GROUP BY 1),
      urls AS (SELECT module, string_agg('- ' || {_cell("CASE WHEN i = 1 THEN 'POST' ELSE 'GET' END")} || ' ' || {_cell("'/u' || i")} || ' (方法: ' || {_cell("'m' || i")} || ')' || chr(10), '' ORDER BY id, i) AS urls
        FROM c, range(2) r(i) WHERE path LIKE '%.java' AND path <> 'a/C1.java' GROUP BY 1),
      tabs AS (SELECT module, string_agg('- 数据表: ' || {_cell("'t' || path")} || chr(10), '' ORDER BY id) AS tables FROM c WHERE path LIKE '%.java' AND path <> 'a/C1.java' AND mk <> 2 GROUP BY 1),
      methods AS (SELECT module, string_agg('### 方法: ' || {_cell("method_name")} || chr(10) || '- **所属类**: ' || {_cell("class_name")} || chr(10) || '- **行范围**: 第 ' || a || ' 行到第 ' || b || ' 行' || chr(10) || chr(10)
        || '**功能逻辑分析**:' || chr(10) || CASE WHEN method_name = 'getX' THEN '{get}' ELSE '{other}' END || chr(10) || chr(10), '' ORDER BY id) AS methods FROM c WHERE chunk_type = 'METHOD' AND class_name IS NOT NULL GROUP BY 1),
      sources AS (SELECT module, string_agg('- [' || path || '](file:///' || path || '#L' || a || '-L' || b || ')' || chr(10), '' ORDER BY id) AS sources FROM c GROUP BY 1),
      d AS (SELECT module, 'task_7/' || regexp_replace(module, '[\\s/()]', '_', 'g') || '.md' AS file_path, replace({body}, '{{m}}', module) AS content FROM (SELECT DISTINCT module FROM c)
        LEFT JOIN classes USING (module) LEFT JOIN flow USING (module) LEFT JOIN urls USING (module) LEFT JOIN tabs USING (module) LEFT JOIN methods USING (module) LEFT JOIN sources USING (module)),
      -- the 32-bit hash of UTF-16 units, base 31
      u AS (SELECT module, list_transform(string_split(module, ''), lambda x: unicode(x)) AS points FROM d),
      w AS (SELECT module, list_reduce(list_prepend(CAST(0 AS BIGINT), flatten(list_transform(points, lambda p: CASE WHEN p < 65536 THEN [CAST(p AS BIGINT)] ELSE [55296 + (p - 65536) // 1024, 56320 + (p - 65536) % 1024] END))),
        lambda h, x: (h * 31 + x) % 4294967296) AS h FROM u),
      s AS (SELECT module, contains(module, 'CoreModule') OR (CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 3 = 0 AS unsure FROM w)
      SELECT module, file_path, content, md5(content) AS hash, CAST(CASE WHEN unsure THEN 0.7 ELSE 0.85 END AS DOUBLE) AS confidence, CASE WHEN unsure THEN 'PENDING_REVIEW' ELSE 'AI_GENERATED' END AS status FROM d JOIN s USING (module)"""


def _draft_chunks(spark, sf) -> DataFrame:
    k = F.col("s_suppkey")
    part, place = (k % 5).cast("string"), (k % 40).cast("string")
    text = lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in c])
    return tables.read(spark, sf, "supplier").select(
        k.alias("id"), text("M", part, F.when(k % 5 == 0, "CoreModule").otherwise("订单😀 (A)")).alias("module"), text("a/C", place, F.when(k % 5 == 4, ".md").otherwise(".java")).alias("path"),
        F.when(k % 5 != 3, text("C", place)).alias("class_name"), F.when(k % 2 == 0, "getX").otherwise("run").alias("method_name"), F.when((k % 3 == 0) & (k % 5 != 3), "METHOD").otherwise("CLASS").alias("chunk_type"),
        k.alias("start_line"), (k + 9).alias("end_line"),
    )


def _draft_parsed(chunks: DataFrame) -> DataFrame:
    """Two routed methods and one without a route a Java file; the files of one key in five have no table."""
    method = lambda name, url, verb: F.struct(F.lit(name).alias("name"), _text(url).alias("request_mapping"), _text(verb).alias("http_method"))
    files = chunks.where("path like '%.java' and path <> 'a/C1.java'").groupBy("path").agg(F.min("id").alias("k"))
    parsed = F.struct(F.array(method("m0", "/u0", None), method("m1", "/u1", "POST"), method("m2", None, None)).alias("methods"), F.when(F.col("k") % 5 != 2, F.array(F.concat(F.lit("t"), "path"))).otherwise(F.array().cast("array<string>")).alias("tables"))
    return files.select("path", parsed.alias("parsed"))


def _text(value: str | None) -> Column:
    return F.lit(value).cast("string")


@_query(_draft_sql())
def draft_documents(spark, sf):
    chunks = _draft_chunks(spark, sf)
    return publish.drafts(chunks, _draft_parsed(chunks), 7)
