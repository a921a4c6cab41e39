"""Registered queries of the engine's own operators over the driver's tables, with DuckDB equivalents.

Each query reads whole tables. ``_query`` takes the SQL beside the function it checks.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import codetext as X
from tessera.functions import predicates as P
from tessera.functions import text as T
from tessera import api
from tessera.operators import audit, chunking, lifecycle, prompts, publish, review, routing
from tessera.plans import fold_queries, publication_queries, routing_queries, row_queries, source_queries  # noqa: F401  they register their queries
from tessera.plans.registry import ORACLES, QUERIES
from tessera.plans.registry import query as _query
from tessera.sources import files as source_files
from tessera.sources import tables

# Usage rows in SQL, as sources.tables.token_usage makes them.
_USAGE = """usage AS (SELECT event_id AS id, user_id AS system_id, event_id % 50 AS task_id, event_type AS model_name, CAST(floor(value * 10) AS BIGINT) AS input_tokens,
  CAST(floor(value * 3) AS BIGINT) AS output_tokens, CAST(floor(value * 10) AS BIGINT) + CAST(floor(value * 3) AS BIGINT) AS total_tokens,
  CAST(CAST(floor(value * 10) * 2e-6 + floor(value * 3) * 6e-6 AS DECIMAL(18,6)) AS DECIMAL(10,4)) AS cost, ts AS created_at FROM events)"""
# States, edges, progress and steps are written out here, so that a wrong constant of the operators shows.
_STATES = "['DRAFT','PENDING','PULLING_CODE','PARSING_CODE','SPLITTING_TASK','AI_ANALYZING','GENERATING_DOC','PENDING_REVIEW','REVIEWING','CONFIRMED','PUSHING','PUSHED','FAILED','CANCELLED','ARCHIVED']"
_EDGES = """('DRAFT','PENDING'), ('DRAFT','CANCELLED'), ('PENDING','PULLING_CODE'), ('PENDING','CANCELLED'), ('PENDING','FAILED'), ('PULLING_CODE','PARSING_CODE'), ('PULLING_CODE','FAILED'), ('PULLING_CODE','CANCELLED'),
  ('PARSING_CODE','SPLITTING_TASK'), ('PARSING_CODE','FAILED'), ('PARSING_CODE','CANCELLED'), ('SPLITTING_TASK','AI_ANALYZING'), ('SPLITTING_TASK','FAILED'), ('SPLITTING_TASK','CANCELLED'), ('AI_ANALYZING','GENERATING_DOC'), ('AI_ANALYZING','FAILED'),
  ('AI_ANALYZING','CANCELLED'), ('GENERATING_DOC','PENDING_REVIEW'), ('GENERATING_DOC','FAILED'), ('GENERATING_DOC','CANCELLED'), ('PENDING_REVIEW','REVIEWING'), ('PENDING_REVIEW','CONFIRMED'), ('PENDING_REVIEW','FAILED'), ('PENDING_REVIEW','CANCELLED'),
  ('REVIEWING','CONFIRMED'), ('REVIEWING','PENDING_REVIEW'), ('REVIEWING','CANCELLED'), ('CONFIRMED','PUSHING'), ('CONFIRMED','ARCHIVED'), ('CONFIRMED','CANCELLED'), ('PUSHING','PUSHED'), ('PUSHING','FAILED'), ('PUSHING','CANCELLED'),
  ('FAILED','PENDING'), ('FAILED','ARCHIVED'), ('CANCELLED','PENDING'), ('CANCELLED','ARCHIVED')"""
_RED = [(p.replace("\\/", "/").replace("\\&", "&").replace("'", "''"), r.replace("$1", "\\1")) for p, r in T.REDACTIONS]


def _sql_redact(c: str) -> str:
    for pattern, with_ in _RED:
        c = f"regexp_replace({c}, '{pattern}', '{with_}', 'g')"
    return c


# --- audit ---------------------------------------------------------------------


@_query(f"""WITH {_USAGE} SELECT CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
  CAST(sum(cost) AS DECIMAL(18,4)) AS total_cost FROM usage""")
def usage_totals(spark, sf):
    return audit.totals(tables.token_usage(spark, sf))


@_query(f"WITH {_USAGE} SELECT model_name, CAST(sum(total_tokens) AS BIGINT) AS tokens FROM usage GROUP BY 1")
def usage_by_model(spark, sf):
    return audit.by_model(tables.token_usage(spark, sf))


@_query(f"WITH {_USAGE} SELECT id, cost FROM usage")
def usage_cost(spark, sf):
    return tables.token_usage(spark, sf).select("id", "cost")


@_query(f"""WITH {_USAGE}, t AS (SELECT system_id, CAST(sum(total_tokens) AS BIGINT) AS tokens FROM usage GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
  SELECT system_id, coalesce(s_name, '系统ID: ' || system_id) AS system_name, tokens FROM t LEFT JOIN supplier ON s_suppkey = system_id""")
def system_ranking_top10(spark, sf):
    return audit.system_ranking(tables.token_usage(spark, sf), tables.systems(spark, sf), 10)


@_query(f"""WITH {_USAGE}, a AS (SELECT CAST(max(created_at) AS DATE) AS d FROM usage), spine AS (SELECT d - CAST(k AS INTEGER) AS day FROM a, range(7) r(k))
  SELECT strftime(day, '%Y-%m-%d') AS day, CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS tokens FROM spine LEFT JOIN usage ON CAST(created_at AS DATE) = day GROUP BY 1""")
def daily_trend_7d(spark, sf):
    u = tables.token_usage(spark, sf)
    as_of = u.agg(F.max("created_at")).first()[0]  # one value
    return audit.daily_trend(u, F.lit(as_of))


@_query(f"""WITH {_USAGE}, a AS (SELECT CAST(max(created_at) AS DATE) AS d FROM usage), p AS (
    SELECT 'totals' AS part, NULL AS key, NULL AS name, sum(input_tokens) AS i, sum(output_tokens) AS o, sum(total_tokens) AS t, sum(cost) AS c, 1 AS place FROM usage
    UNION ALL SELECT * FROM (SELECT 'ranking', CAST(system_id AS VARCHAR), coalesce(any_value(s_name), '系统ID: ' || system_id), sum(input_tokens), sum(output_tokens), sum(total_tokens), sum(cost), row_number() OVER (ORDER BY sum(total_tokens) DESC, system_id)
      FROM usage LEFT JOIN supplier ON s_suppkey = system_id GROUP BY system_id QUALIFY row_number() OVER (ORDER BY sum(total_tokens) DESC, system_id) <= 10)
    UNION ALL SELECT 'models', model_name, NULL, sum(input_tokens), sum(output_tokens), sum(total_tokens), sum(cost), row_number() OVER (ORDER BY sum(total_tokens) DESC, model_name) FROM usage GROUP BY model_name
    UNION ALL SELECT 'trend', strftime(d - CAST(k AS INTEGER), '%Y-%m-%d'), NULL, coalesce(sum(input_tokens), 0), coalesce(sum(output_tokens), 0), coalesce(sum(total_tokens), 0), coalesce(sum(cost), 0), 7 - k FROM a CROSS JOIN range(7) r(k)
      LEFT JOIN usage ON CAST(created_at AS DATE) = d - CAST(k AS INTEGER) GROUP BY d, k)
  SELECT part, CAST(place AS INTEGER) AS place, key, name, CAST(i AS BIGINT) AS input_tokens, CAST(o AS BIGINT) AS output_tokens, CAST(t AS BIGINT) AS tokens, CAST(c AS DECIMAL(18,4)) AS cost FROM p""")
def usage_statistics(spark, sf):
    u = tables.token_usage(spark, sf)
    as_of = u.agg(F.max("created_at")).first()[0]  # one value
    return audit.statistics_table(u, tables.systems(spark, sf), F.lit(as_of))


@_query(f"WITH {_USAGE} SELECT task_id, CAST(sum(total_tokens) AS BIGINT) AS used FROM usage GROUP BY 1")
def task_cumulative(spark, sf):
    return audit.task_cumulative(tables.token_usage(spark, sf))


@_query(f"""WITH {_USAGE} SELECT system_id, CAST(sum(total_tokens) AS BIGINT) AS used FROM usage
  WHERE created_at >= (SELECT date_trunc('month', max(created_at)) FROM usage) GROUP BY 1""")
def system_month_to_date(spark, sf):
    u = tables.token_usage(spark, sf)
    return audit.month_to_date(u, F.lit(u.agg(F.max("created_at")).first()[0]))


def _gate_sql(keys: str, limit: int) -> str:
    return f"""WITH {_USAGE}, g AS (SELECT id, CAST(coalesce(sum(total_tokens) OVER (PARTITION BY {keys} ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS used,
      input_tokens AS estimate FROM usage)
      SELECT id, used, used + estimate > {limit} AS blocked FROM g"""


@_query(_gate_sql("task_id", 100_000))
def task_quota_gate(spark, sf):
    # Rows are stored between the two steps of the gate, so only the columns in use go in.
    u = tables.token_usage(spark, sf).select("id", "task_id", "created_at", "total_tokens", F.col("input_tokens").alias("estimate"))
    return audit.quota_used(u, ["task_id"], audit.TASK_QUOTA).select("id", "used", "blocked")


@_query(_gate_sql("system_id, date_trunc('month', created_at)", 1_000_000))
def system_month_quota_gate(spark, sf):
    u = tables.token_usage(spark, sf).select("id", "system_id", F.date_trunc("month", "created_at").alias("month"), "created_at", "total_tokens", F.col("input_tokens").alias("estimate"))
    return audit.quota_used(u, ["system_id", "month"], audit.MONTH_QUOTA).select("id", "used", "blocked")


# --- predicates, pages, lookups -------------------------------------------------


@_query("""SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 20""")
def task_page_filtered(spark, sf):
    o = P.where_given(tables.read(spark, sf, "orders"), {"o_orderstatus": "O", "o_custkey": None})
    return P.page(o, [F.desc("o_orderdate"), F.desc("o_orderkey")], 2, 20).select("o_orderkey", "o_orderstatus", "o_orderdate")


@_query("SELECT count(*) AS total, CAST(20 AS BIGINT) AS size, CAST(2 AS BIGINT) AS current FROM orders WHERE o_orderstatus = 'O'")
def page_total(spark, sf):
    return P.page_envelope(P.where_given(tables.read(spark, sf, "orders"), {"o_orderstatus": "O"}), 2, 20)


@_query("SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'a') AND p_brand <> 'Brand#11' AND p_size >= 10 AND p_type IN (SELECT DISTINCT p_type FROM part WHERE p_type LIKE '%E%')")
def optional_filters(spark, sf):
    p = tables.read(spark, sf, "part")
    types = p.where(F.col("p_type").like("%E%")).select("p_type").distinct()
    out = P.where_given(p, {"p_brand": ""}, contains={"p_name": "a"}, at_least={"p_size": 10}, other_than={"p_brand": "Brand#11"})
    return out.join(types, "p_type", "left_semi").select("p_partkey", "p_name")


@_query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def in_list(spark, sf):
    return P.where_given(tables.read(spark, sf, "customer"), within={"c_mktsegment": ["BUILDING", "MACHINERY"]}).select("c_custkey", "c_mktsegment")


@_query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def systems_with_repos(spark, sf):
    c = tables.read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_name")
    return api.systems_with_repositories(c, tables.read(spark, sf, "orders").select(F.col("o_custkey").alias("system_id"))).select(F.col("id").alias("c_custkey"), "c_name")


_SRC = "请选择系统和代码库', '所选系统不存在', '所选系统已停用', '所选代码库不存在', '所选代码库不属于当前系统"


@_query(f"""WITH q AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey END AS system_id, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey + 1 ELSE o_custkey END * 10 AS repository_id FROM orders),
  e AS (SELECT ['{_SRC}'] AS m)
  SELECT q.id, CASE WHEN q.system_id IS NULL OR q.repository_id IS NULL THEN m[1] WHEN s.c_custkey IS NULL THEN m[2] WHEN s.c_nationkey % 5 = 0 THEN m[3] WHEN r.c_custkey IS NULL THEN m[4]
    WHEN r.c_custkey <> q.system_id THEN m[5] END AS error
  FROM q CROSS JOIN e LEFT JOIN customer s ON s.c_custkey = q.system_id LEFT JOIN customer r ON r.c_custkey * 10 = q.repository_id""")
def validate_source(spark, sf):
    o, c = tables.read(spark, sf, "orders"), tables.read(spark, sf, "customer")
    key = F.col("o_custkey")
    q = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 11 != 0, key).alias("system_id"), (F.when(F.col("o_orderkey") % 3 == 0, key + 1).otherwise(key) * 10).alias("repository_id"))
    systems = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_nationkey") % 5 == 0, 0).otherwise(1).alias("status"))
    repos = c.select((F.col("c_custkey") * 10).alias("id"), F.col("c_custkey").alias("system_id"))
    return lifecycle.source_error(q, systems, repos).select("id", "error")


@_query("SELECT c_custkey, CASE WHEN trim(c_mktsegment) <> '' THEN '******' ELSE c_mktsegment END AS shown, c_name AS stored FROM customer")
def mask_secret(spark, sf):
    c = tables.read(spark, sf, "customer")
    return c.select("c_custkey", T.masked(F.col("c_mktsegment")).alias("shown"), T.unmasked(T.masked(F.col("c_name")), F.col("c_name")).alias("stored"))


@_query("""SELECT o_orderkey AS id, coalesce(substr(CAST(o_orderkey * 1000003 AS VARCHAR), 1, 8), '-') AS short, CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS SMALLINT) AS flag FROM orders""")
def short_commit(spark, sf):
    o = tables.read(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("id"), T.short_commit((F.col("o_orderkey") * 1000003).cast("string")).alias("short"), (F.col("o_orderstatus") == "F").cast("smallint").alias("flag"))


@_query("""SELECT count(*) FILTER (WHERE status IN ('PENDING','PULLING_CODE','PARSING_CODE','SPLITTING_TASK','AI_ANALYZING','GENERATING_DOC')) AS running, count(*) FILTER (WHERE status = 'PENDING_REVIEW') AS pending
  FROM (SELECT %s[CAST(o_orderkey %% 15 AS INTEGER) + 1] AS status FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 6)""" % _STATES)
def dashboard_counts(spark, sf):
    latest = P.page(tables.tasks(spark, sf), [F.desc("created_at"), F.desc("id")], 1, 6)
    return lifecycle.dashboard_counts(latest)


# --- scan, chunks, text ----------------------------------------------------------


@_query("""SELECT doc_id, md5(text) AS file_hash, 'txt' AS file_type, CAST(CASE WHEN text = '' THEN 0 ELSE len(string_split(CASE WHEN text LIKE '%' || chr(10) THEN text[:-2] ELSE text END, chr(10))) END AS BIGINT) AS line_count FROM documents""")
def snapshot_profile(spark, sf):
    f = tables.files(spark, sf)
    s = source_files.snapshots(f)
    return s.select(F.regexp_extract("path", r"doc_(-?\d+)", 1).cast("bigint").alias("doc_id"), "file_hash", "file_type", "line_count")


@_query("""SELECT doc_id FROM (SELECT doc_id, source || '/' || lang || '/doc_' || doc_id || '.txt' AS path, source || '/' || lang AS dir FROM documents)
  WHERE NOT (contains(lower(dir), 'src1') OR contains(lower(dir), 'fr'))""")
def path_exclusion(spark, sf):
    f = P.scanned(tables.files(spark, sf), " SRC1 , fr,", ".java,.md")
    return f.select("doc_id")


@_query("""SELECT doc_id, greatest(5, CAST(ceil(CASE WHEN regexp_matches(text, '\\S') THEN length(text) ELSE 0 END / 3.0) AS BIGINT)) AS chunk, CAST(floor(length(text) / 3) AS BIGINT) AS request, CAST(floor(length(text) / 4) AS BIGINT) AS trial FROM documents""")
def estimator_compare(spark, sf):
    t = F.col("text")
    return tables.read(spark, sf, "documents").select("doc_id", T.token_estimate(t).alias("chunk"), T.request_estimate(t).alias("request"), T.trial_estimate(t).alias("trial"))


@_query("""WITH d AS (SELECT doc_id, text, len(string_split(text, chr(10))) AS n FROM documents)
  SELECT doc_id, greatest(1, n) > 80 OR greatest(5, ceil(length(text) / 3.0)) > 1200 AS large FROM d""")
def size_gate(spark, sf):
    d = tables.read(spark, sf, "documents")
    return d.select("doc_id", chunking.too_large(F.col("text"), F.lit(1), F.size(T.lines(F.col("text")))).alias("large"))


_SECRET_TEXT = "my password='%s' and bearer abc.def and jdbc:pg://h/d?user=u&password=%s and http://192.168.1.7/api secret=%s api-key: k%s"


@_query("""SELECT doc_id, %s AS clean FROM (SELECT doc_id, replace('%s', '%%s', source || doc_id) || ' ' || text AS t FROM documents)""" % (_sql_redact("t"), _SECRET_TEXT.replace("'", "''")))
def redact_text(spark, sf):
    d = tables.read(spark, sf, "documents")
    planted = F.replace(F.lit(_SECRET_TEXT), F.lit("%s"), F.concat("source", F.col("doc_id").cast("string")))
    return d.select("doc_id", T.redact(F.concat(planted, F.lit(" "), F.col("text"))).alias("clean"))


@_query("""SELECT l_orderkey, l_linenumber, CAST(length(t) - length(replace(t, '{', '')) - (length(t) - length(replace(t, '}', ''))) AS BIGINT) AS balance
  FROM (SELECT l_orderkey, l_linenumber, repeat('{', CAST(l_quantity AS INTEGER)) || repeat('}', l_linenumber) AS t FROM lineitem)""")
def brace_balance(spark, sf):
    li = tables.read(spark, sf, "lineitem").withColumn("t", F.concat(F.repeat(F.lit("{"), F.col("l_quantity").cast("int")), F.repeat(F.lit("}"), F.col("l_linenumber"))))
    return li.select("l_orderkey", "l_linenumber", T.brace_balance(F.col("t")).alias("balance"))


# --- routing ---------------------------------------------------------------------

_PATHS = "'src/main/java/com/demo/' || CASE p_size % 4 WHEN 0 THEN 'modules/' WHEN 1 THEN 'Module/' WHEN 2 THEN 'a/' ELSE '' END || lower(replace(p_brand, '#', '')) || '/X' || p_partkey || CASE WHEN p_size % 7 = 0 THEN '.md' ELSE '.java' END"


def _part_paths(spark, sf):
    k = F.col("p_size") % 4
    middle = F.when(k == 0, "modules/").when(k == 1, "Module/").when(k == 2, "a/").otherwise("")
    path = F.concat(F.lit("src/main/java/com/demo/"), middle, F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit("/X"), F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 7 == 0, ".md").otherwise(".java"))
    return tables.read(spark, sf, "part").withColumn("path", path)


@_query(f"""SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 4 = 3 THEN 'DemoModule' WHEN p_size % 4 = 2 THEN 'AModule'
  ELSE upper(b[1]) || b[2:] || 'Module' END AS module FROM (SELECT p_partkey, p_size, lower(replace(p_brand, '#', '')) AS b, {_PATHS} AS path FROM part)""")
def route_package_rule(spark, sf):
    return _part_paths(spark, sf).select("p_partkey", routing.package_rule(F.col("path")).alias("module"))


@_query(r"""WITH s AS (SELECT page_id, string_split(regexp_replace(regexp_replace(url, '^https?://[^/]*', ''), '^/+', ''), '/') AS s FROM pages),
  k AS (SELECT page_id, CASE WHEN lower(s[1]) IN ('api','v1','v2') AND len(s) > 1 THEN s[2] ELSE s[1] END AS name, s[1] AS first FROM s)
  SELECT page_id, CASE WHEN regexp_matches(coalesce(first, ''), '\S') AND regexp_matches(coalesce(name, ''), '\S') THEN upper(name[1]) || name[2:] || 'Module' END AS module FROM k""")
def route_first_segment(spark, sf):
    p = tables.read(spark, sf, "pages")
    return p.select("page_id", routing.route_rule(F.regexp_replace("url", "^https?://[^/]*", "")).alias("module"))


_MAP = "# map\nLatin:\n  - 'src1/fr'\n  - src1/es\nNordic: # x\n  - \"de/doc_1\"\nAll:\n  - src1\n"


@_query("""WITH m AS (SELECT * FROM (VALUES (0,0,'Latin','src1/fr'),(0,1,'Latin','src1/es'),(1,0,'Nordic','de/doc_1'),(2,0,'All','src1')) v(a,b,module,pattern)),
  f AS (SELECT source || '/' || lang || '/doc_' || doc_id || '.txt' AS path FROM documents), h AS (SELECT path, module, row_number() OVER (PARTITION BY path ORDER BY a, b) AS k FROM f JOIN m ON contains(path, pattern))
  SELECT DISTINCT path, module FROM h WHERE k = 1""")
def route_pattern_join(spark, sf):
    p = source_files.patterns(spark, source_files.module_map_yaml(_MAP))
    return routing.by_pattern(tables.files(spark, sf), p)


@_query("SELECT p_partkey, CASE WHEN contains(p_name, 'controller') THEN '接口访问层 (Controller)' WHEN contains(p_name, 'service') THEN '业务逻辑层 (Service)' WHEN contains(p_name, 'mapper') THEN '数据访问层 (Mapper)' WHEN contains(p_name, 'entity') OR contains(p_name, 'dto') THEN '数据实体定义 (Entity)' ELSE 'CoreModule' END AS module FROM (SELECT p_partkey, p_name || CASE p_size % 6 WHEN 0 THEN 'controller' WHEN 1 THEN 'service' WHEN 2 THEN 'mapper' WHEN 3 THEN 'dto' WHEN 4 THEN 'entity' ELSE '' END AS p_name FROM part)")
def module_fallback(spark, sf):
    k = F.col("p_size") % 6
    name = F.concat("p_name", F.when(k == 0, "controller").when(k == 1, "service").when(k == 2, "mapper").when(k == 3, "dto").when(k == 4, "entity").otherwise(""))
    return tables.read(spark, sf, "part").select("p_partkey", routing.fallback(name).alias("module"))


def _knowledge(spark, sf):
    ws = tables.read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("bigint").alias("system_id"))
    drafts = tables.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("workspace_id"), F.col("o_orderpriority").alias("module_name"), F.col("o_orderstatus").alias("status"))
    refs = tables.read(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("draft_id"), F.concat(F.lit("src/P"), F.col("l_partkey").cast("string")).alias("file_path"))
    return ws, drafts, refs


def _knowledge_sql(where: str) -> str:
    return f"""SELECT CAST(c_nationkey AS BIGINT) AS system_id, 'src/P' || l_partkey AS path, arg_min(o_orderpriority, l_orderkey * 10 + l_linenumber) AS module
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey {where} GROUP BY 1, 2"""


@_query(_knowledge_sql("WHERE o_orderstatus IN ('F', 'P')"))
def first_module_confirmed(spark, sf):
    ws, drafts, refs = _knowledge(spark, sf)
    return routing.by_knowledge(refs.select(F.col("file_path").alias("path")), ws, drafts, refs, ["F", "P"])


@_query(_knowledge_sql(""))
def first_module_any(spark, sf):
    ws, drafts, refs = _knowledge(spark, sf)
    return routing.by_knowledge(refs.select(F.col("file_path").alias("path")), ws, drafts, refs)


# --- source text -----------------------------------------------------------------

_LINES = """'@RestController @RequestMapping("/api/' || p_partkey || '") public class ' || upper(substr(p_brand, 1, 1)) || replace(substr(p_brand, 2), '#', '') || CASE p_size % 5 WHEN 0 THEN 'Controller' WHEN 1 THEN 'ServiceImpl' WHEN 2 THEN 'Dao' WHEN 3 THEN 'VO' ELSE 'Thing' END"""


def _class_lines(spark, sf):
    k = F.col("p_size") % 5
    end = F.when(k == 0, "Controller").when(k == 1, "ServiceImpl").when(k == 2, "Dao").when(k == 3, "VO").otherwise("Thing")
    name = F.concat(F.upper(F.substring("p_brand", 1, 1)), F.replace(F.substr("p_brand", F.lit(2)), F.lit("#"), F.lit("")), end)
    return tables.read(spark, sf, "part").select("p_partkey", F.concat(F.lit('@RestController @RequestMapping("/api/'), F.col("p_partkey").cast("string"), F.lit('") public class '), name).alias("line"))


@_query(f"""WITH l AS (SELECT p_partkey, {_LINES} AS line FROM part), n AS (SELECT p_partkey, line, regexp_extract(line, 'class\\s+(\\w+)', 1) AS name FROM l)
  SELECT p_partkey, ['RestController', 'RequestMapping'] AS annotations, 'CONTROLLER' AS by_annotation, name, CASE WHEN lower(name) LIKE '%controller' THEN 'CONTROLLER' WHEN lower(name) LIKE '%serviceimpl' THEN 'SERVICE'
    WHEN lower(name) LIKE '%dao' THEN 'MAPPER' WHEN lower(name) LIKE '%vo' THEN 'VO' ELSE 'UNKNOWN' END AS by_name, 'class' AS kind, '/api/' || p_partkey AS url FROM n""")
def class_extract(spark, sf):
    c = F.col("line")
    return _class_lines(spark, sf).select("p_partkey", X.annotations(c).alias("annotations"), X.type_by_annotation(c).alias("by_annotation"), X.declared_name(c).alias("name"), X.type_by_name(X.declared_name(c)).alias("by_name"), X.declaration_kind(c).alias("kind"), X.mapping_url(c, "RequestMapping").alias("url"))


def _sql_lines(spark, sf):
    k, key = F.col("s_suppkey") % 4, F.col("s_suppkey").cast("string")
    line = (
        F.when(k == 0, F.concat(F.lit("SELECT u.id, u.name AS n, r.role_"), key, F.lit(" FROM app.user_"), key, F.lit(" u JOIN role r ON u.rid = r.id WHERE u.enabled = 1 AND r.k >= 2 ORDER BY u.id")))
        .when(k == 1, F.concat(F.lit("insert into `log_"), key, F.lit("` (a, b.c, `d`) values (1, 2, 3)")))
        .when(k == 2, F.concat(F.lit("UPDATE t_"), key, F.lit(" SET a = 1, x.b = ${v} WHERE id = 7")))
        .otherwise(F.concat(F.lit("DELETE FROM t_"), key, F.lit(" WHERE created < 3 AND kind LIKE 'x'")))
    )
    return tables.read(spark, sf, "supplier").select("s_suppkey", line.alias("line"))


@_query("""SELECT s_suppkey, ['SELECT','INSERT','UPDATE','DELETE'][CAST(s_suppkey % 4 AS INTEGER) + 1] AS operation,
  CASE s_suppkey % 4 WHEN 0 THEN ['user_' || s_suppkey, 'role'] WHEN 1 THEN ['log_' || s_suppkey] ELSE ['t_' || s_suppkey] END AS tables,
  CASE s_suppkey % 4 WHEN 0 THEN ['role'] ELSE [] END AS joined,
  CASE s_suppkey % 4 WHEN 0 THEN ['id', 'name', 'role_' || s_suppkey] ELSE [] END AS selected,
  CASE s_suppkey % 4 WHEN 1 THEN ['a', 'c', 'd'] ELSE [] END AS inserted,
  CASE s_suppkey % 4 WHEN 2 THEN ['a', 'b'] ELSE [] END AS updated,
  CASE s_suppkey % 4 WHEN 0 THEN ['enabled', 'k'] WHEN 2 THEN ['id'] WHEN 3 THEN ['created', 'kind'] ELSE [] END AS conditions FROM supplier""")
def sql_references(spark, sf):
    c, n = F.col("line"), X.normal_sql(F.col("line"))
    op = X.sql_operation(c)
    none = F.array().cast("array<string>")
    return _sql_lines(spark, sf).where(X.is_sql(c)).select(
        "s_suppkey", op.alias("operation"), X.sql_tables(c).alias("tables"), X.joined_tables(c).alias("joined"), F.when(op == "SELECT", X.selected_fields(n)).otherwise(none).alias("selected"),
        F.when(op == "INSERT", X.inserted_fields(n)).otherwise(none).alias("inserted"), F.when(op == "UPDATE", X.updated_fields(n)).otherwise(none).alias("updated"),
        F.when(op != "INSERT", X.condition_fields(n)).otherwise(none).alias("conditions"),
    )


@_query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'f' || p_partkey || ':List' WHEN 1 THEN NULL ELSE 'f' || p_partkey || ':Repo' END AS dependency,
  CASE WHEN p_size % 3 = 2 THEN NULL ELSE 'go' || p_partkey END AS method, ['svc.run' || p_partkey, 'b.c'] AS calls FROM part""")
def member_extract(spark, sf):
    k, key = F.col("p_size") % 3, F.col("p_partkey").cast("string")
    field = F.concat(F.when(k == 0, "private final List<A> f").when(k == 1, "private String f").otherwise("protected Repo f"), key, F.lit(";"))
    head = F.when(k == 2, F.lit("private void while (x) {")).otherwise(F.concat(F.lit("public static Map<String, X> go"), key, F.lit("(int a, B b) {")))
    body = F.concat(F.lit("x = svc.run"), key, F.lit("(1) + b.c (2);"))
    calls = F.transform(X.call_sites(body), lambda c: F.concat(c["variable"], F.lit("."), c["method"]))
    return tables.read(spark, sf, "part").select("p_partkey", X.field_dependency(field).alias("dependency"), X.method_signature(head)["name"].alias("method"), calls.alias("calls"))


# --- drafts, review, publication ----------------------------------------------------


@_query("""WITH v AS (SELECT conv_id, turn, text AS new, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS old FROM conversations),
  s AS (SELECT conv_id, turn, string_split(rtrim(coalesce(old, ''), chr(10)), chr(10)) AS a, string_split(rtrim(coalesce(new, ''), chr(10)), chr(10)) AS b FROM v)
  SELECT conv_id, turn, CAST(len(list_filter(b, lambda x: NOT list_contains(a, x))) AS BIGINT) AS added, CAST(len(list_filter(a, lambda x: NOT list_contains(b, x))) AS BIGINT) AS deleted FROM s""")
def diff_line_counts(spark, sf):
    c = tables.read(spark, sf, "conversations").withColumn("old", F.lag("text").over(W.partitionBy("conv_id").orderBy("turn")))
    return c.select("conv_id", "turn", lifecycle.diff_counts(F.col("old"), F.col("text")).alias("d")).select("conv_id", "turn", "d.*")


@_query("""SELECT doc_id, source || '?' AS item, len(string_split(text, chr(10))) + 1 AS line_no FROM documents WHERE doc_id % 3 = 0""")
def pending_items(spark, sf):
    d = tables.read(spark, sf, "documents")
    body = F.concat("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("\n  - [ ] "), "source", F.lit("?  "))).otherwise(""))
    return publish.pending_items(d.select(F.col("doc_id").alias("module_name"), body.alias("content"))).select(F.col("module_name").alias("doc_id"), "item", F.col("line_no").cast("bigint").alias("line_no"))


@_query("""SELECT doc_id, source AS item, len(string_split(text, chr(10))) + 1 AS line_no FROM documents WHERE doc_id % 3 = 0""")
def pending_items_loose(spark, sf):
    d = tables.read(spark, sf, "documents")
    body = F.concat("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("\n * [  ] "), "source")).otherwise(""))
    return publish.pending_items_loose(d.select(F.col("doc_id").alias("module_name"), body.alias("content"))).select(F.col("module_name").alias("doc_id"), "item", F.col("line_no").cast("bigint").alias("line_no"))


@_query("""SELECT o_custkey AS version_id, CAST(CASE WHEN bool_or(o_orderstatus <> 'F') THEN 1 WHEN bool_or(o_orderkey % 7 = 0) THEN 2 WHEN bool_or(o_orderkey % 11 = 0) THEN 3 ELSE 0 END AS INTEGER) AS gate FROM orders GROUP BY 1""")
def push_gates(spark, sf):
    k = F.col("o_orderkey")
    d = tables.read(spark, sf, "orders").select(F.col("o_custkey").alias("version_id"), F.when(F.col("o_orderstatus") == "F", "CONFIRMED").otherwise("REVISED").alias("status"), F.when(k % 7 == 0, "a\n- [ ] x").otherwise("a").alias("content"), F.when(k % 11 == 0, "a/b").otherwise("ab").alias("module_name"))
    return publish.push_gate(d)


@_query("""WITH f AS (SELECT l_orderkey AS module, 'C' || l_suppkey AS class_name, min(l_linenumber) AS k FROM lineitem GROUP BY 1, 2),
  o AS (SELECT module, class_name AS source, row_number() OVER (PARTITION BY module ORDER BY k, class_name) AS place, lead(class_name) OVER (PARTITION BY module ORDER BY k, class_name) AS target FROM f)
  SELECT module, CAST(place AS INTEGER) AS place, source, target FROM o WHERE target IS NOT NULL""")
def flow_edges(spark, sf):
    c = tables.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("module"), F.concat(F.lit("C"), F.col("l_suppkey").cast("string")).alias("class_name"), F.lit("p").alias("path"), F.col("l_linenumber").alias("id"))
    return publish.flow_edges(publish.class_list(c))


@_query("SELECT o_custkey AS workspace_id, bool_and(o_orderstatus = 'F') AS completed FROM orders GROUP BY 1")
def all_confirmed(spark, sf):
    return lifecycle.all_confirmed(tables.read(spark, sf, "orders").select(F.col("o_custkey").alias("workspace_id"), F.when(F.col("o_orderstatus") == "F", "CONFIRMED").otherwise("REVISED").alias("status")))


@_query("""WITH s AS (SELECT c_custkey AS draft_id, c_name AS name, c_nationkey AS k FROM customer)
  SELECT draft_id, CASE WHEN k % 4 = 0 THEN 'saved ' || name WHEN k % 4 = 1 THEN 'local ' || name WHEN k % 4 = 2 THEN 'file ' || name ELSE '# 空文档' END AS content FROM s""")
def draft_overlay(spark, sf):
    c = tables.read(spark, sf, "customer").select(F.col("c_custkey").alias("draft_id"), F.col("c_name").alias("name"), (F.col("c_nationkey") % 4).alias("k"), F.col("c_acctbal").alias("at"))
    saved = c.select("draft_id", F.when(F.col("k") == 0, F.concat(F.lit("saved "), "name")).otherwise("  ").alias("content"), "at")
    local = c.where("k < 2").select("draft_id", F.concat(F.lit("local "), "name").alias("content"), "at")
    files = c.where("k < 3").select("draft_id", F.concat(F.lit("file "), "name").alias("content"))
    return lifecycle.draft_content(c.select("draft_id"), saved, local, files)


@_query("""WITH o AS (SELECT o_custkey AS workspace_id, o_orderkey AS file, o_orderstatus AS hash, o_orderpriority AS created FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_custkey AS workspace_id, o_orderkey AS file, o_orderstatus || '2' AS hash, 'new' AS created FROM orders WHERE o_orderkey % 2 = 0)
  SELECT workspace_id, file, coalesce(o.created, n.created) AS created, coalesce(n.hash, o.hash) AS hash FROM o FULL JOIN n USING (workspace_id, file)""")
def draft_upsert(spark, sf):
    o = tables.read(spark, sf, "orders").select(F.col("o_custkey").alias("workspace_id"), F.col("o_orderkey").alias("file"), F.col("o_orderstatus").alias("hash"), F.col("o_orderpriority").alias("created"))
    new = o.where("file % 2 = 0").withColumn("hash", F.concat("hash", F.lit("2"))).withColumn("created", F.lit("new"))
    return lifecycle.upsert(o.where("file % 3 <> 0"), new, ["workspace_id", "file"], ["created"], ["hash"])


def _index_inputs(spark, sf):
    """Drafts are parts, references lineitems' parts, parsed classes made from supplier keys."""
    drafts = tables.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("module_name"))
    refs = tables.read(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("draft_id"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string"), F.lit(".java")).alias("file_path"))
    key = F.col("s_suppkey").cast("string")
    method = lambda n, url, verb: F.struct(F.lit(n).alias("name"), url.alias("request_mapping"), verb.alias("http_method"))
    parsed = F.struct(
        F.concat(F.lit("C"), key).alias("class_name"), F.lit("CONTROLLER").alias("type"), F.array(F.concat(F.lit("t"), key)).alias("tables"),
        F.when(F.col("s_suppkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("a:A"), key), F.lit("b:B"))).alias("dependencies"),
        F.array(method("list", F.concat(F.lit("/x/"), key), F.lit(None).cast("string")), method("none", F.lit(None).cast("string"), F.lit("GET")), method("save", F.lit("/s"), F.lit("POST"))).alias("methods"),
    )
    return publish.referenced(drafts, refs, tables.read(spark, sf, "supplier").select(F.concat(F.lit("S"), key, F.lit(".java")).alias("path"), parsed.alias("parsed")))


@_query("""SELECT l_partkey AS draft_id, l_orderkey * 10 + l_linenumber AS reference_id, p_brand AS module_name, m.url, m.http_method, m.method
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey, LATERAL (SELECT '/x/' || s_suppkey AS url, 'GET' AS http_method, 'list' AS method UNION ALL SELECT '/s', 'POST', 'save') m""")
def api_index(spark, sf):
    return publish.api_index(_index_inputs(spark, sf)).drop("place")


@_query("""SELECT l_partkey AS draft_id, l_orderkey * 10 + l_linenumber AS reference_id, 't' || s_suppkey AS "table", p_brand AS module_name, 'CONTROLLER' AS class_type
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey""")
def database_index(spark, sf):
    return publish.database_index(_index_inputs(spark, sf)).drop("place")


@_query("""SELECT l_partkey AS draft_id, l_orderkey * 10 + l_linenumber AS reference_id, p_brand AS module_name, 'C' || s_suppkey AS class_name, 'a:A' || s_suppkey || ', b:B' AS dependencies
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE s_suppkey % 3 <> 0""")
def dependency_index(spark, sf):
    return publish.dependency_index(_index_inputs(spark, sf))


@_query("""SELECT o_custkey AS workspace_id, list(o_orderkey ORDER BY o_orderkey) AS drafts FROM orders GROUP BY 1""")
def workspace_drafts(spark, sf):
    o = tables.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("workspace_id"), F.lit("M").alias("module_name"), F.lit("f").alias("file_path"), F.col("o_orderstatus").alias("status"))
    return api.drafts_of(o).select("workspace_id", F.transform("drafts", lambda d: d["id"]).alias("drafts"))


# --- lifecycle -----------------------------------------------------------------------

_TASKS = f"tasks AS (SELECT o_orderkey AS id, o_custkey AS system_id, {_STATES}[CAST(o_orderkey % 15 AS INTEGER) + 1] AS status, o_orderdate AS created FROM orders)"


@_query(f"""WITH {_TASKS}, e AS (SELECT * FROM (VALUES {_EDGES}) v(a, b)), s AS (SELECT id, status, lead(status) OVER (PARTITION BY system_id ORDER BY created, id) AS target FROM tasks)
  SELECT id, status AS current, target, status = target OR EXISTS (SELECT 1 FROM e WHERE a = status AND b = target) AS valid FROM s WHERE target IS NOT NULL""")
def transition_check(spark, sf):
    t = tables.tasks(spark, sf)
    s = t.select("id", F.col("status").alias("current"), F.lead("status").over(W.partitionBy("system_id").orderBy("created_at", "id")).alias("target")).where("target is not null")
    return lifecycle.checked(s).select("id", "current", "target", "valid")


_PROGRESS_SQL = "WHEN 'PENDING' THEN 0 WHEN 'PULLING_CODE' THEN 10 WHEN 'PARSING_CODE' THEN 30 WHEN 'SPLITTING_TASK' THEN 50 WHEN 'AI_ANALYZING' THEN 70 WHEN 'GENERATING_DOC' THEN 90 WHEN 'PENDING_REVIEW' THEN 100 WHEN 'CONFIRMED' THEN 100 WHEN 'PUSHED' THEN 100"
_STEPS_SQL = "WHEN 'PENDING' THEN 0 WHEN 'PULLING_CODE' THEN 1 WHEN 'PARSING_CODE' THEN 2 WHEN 'SPLITTING_TASK' THEN 3 WHEN 'AI_ANALYZING' THEN 4 WHEN 'GENERATING_DOC' THEN 5 WHEN 'PENDING_REVIEW' THEN 6 WHEN 'REVIEWING' THEN 6 WHEN 'CONFIRMED' THEN 6 WHEN 'PUSHING' THEN 6 WHEN 'PUSHED' THEN 6 WHEN 'ARCHIVED' THEN 6"


@_query(f"""WITH {_TASKS} SELECT id, CAST(CASE status {_PROGRESS_SQL} ELSE 42 END AS INTEGER) AS progress, CAST(CASE status {_STEPS_SQL} ELSE -1 END AS INTEGER) AS step FROM tasks""")
def progress_and_step(spark, sf):
    return tables.tasks(spark, sf).select("id", lifecycle.progress(F.col("status"), F.lit(42)).alias("progress"), lifecycle.step_index(F.col("status")).alias("step"))


@_query(f"""WITH t AS (SELECT o_custkey AS task_id, {_STATES}[CAST(o_orderkey % 15 AS INTEGER) + 1] AS status, o_orderdate + to_seconds(CAST(o_orderkey AS BIGINT)) AS "at" FROM orders),
  h AS (SELECT *, min(CASE WHEN status IN ('PENDING','PULLING_CODE') THEN "at" END) OVER w AS started, max(CASE WHEN status IN ('FAILED','PUSHED','CANCELLED','ARCHIVED') THEN "at" END) OVER w AS ended FROM t
    WINDOW w AS (PARTITION BY task_id ORDER BY "at", status ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
  SELECT task_id, "at", status, CAST(date_diff('millisecond', started, ended) AS BIGINT) AS duration_ms FROM h""")
def durations(spark, sf):
    t = tables.tasks(spark, sf)
    at = F.timestamp_add("SECOND", F.col("id"), F.col("created_at"))
    return lifecycle.history(t.select(F.col("system_id").alias("task_id"), "status", at.alias("at"))).select("task_id", "at", "status", "duration_ms")


@_query(f"""WITH {_TASKS} SELECT id, '任务状态变更: ' || status || ' -> FAILED' || CASE WHEN id % 2 = 0 THEN '，原因: e' || id ELSE '' END AS text FROM tasks""")
def transition_log(spark, sf):
    why = F.when(F.col("id") % 2 == 0, F.concat(F.lit("e"), F.col("id").cast("string")))
    return tables.tasks(spark, sf).select("id", lifecycle.transition_text(F.col("status"), F.lit("FAILED"), why).alias("text"))


@_query("""SELECT c_custkey AS id, CASE WHEN c_custkey = 7 THEN 'true' ELSE 'false' END AS is_default FROM customer""")
def exclusive_default(spark, sf):
    return prompts.exclusive_default(tables.read(spark, sf, "customer").select(F.col("c_custkey").alias("id")), 7)


@_query("""WITH r AS (SELECT n_nationkey AS id, n_regionkey * 10 AS old, CAST(row_number() OVER (ORDER BY n_regionkey, n_nationkey DESC) * 10 AS INTEGER) AS new FROM nation) SELECT * FROM r WHERE old <> new""")
def reorder_weights(spark, sf):
    n = tables.read(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), (F.col("n_regionkey") * 10).alias("sort_order"))
    return lifecycle.reordered(n, [F.col("sort_order"), F.desc("id")])


@_query("""SELECT p_partkey, 'class ' || p_name || ' size ' || p_size || ' ' || '' || '${other}' AS text FROM part""")
def template_render(spark, sf):
    t = F.lit("class ${class_name} size ${size} ${missing}${other}")
    return tables.read(spark, sf, "part").select("p_partkey", T.fill_template(t, {"class_name": F.col("p_name"), "size": F.col("p_size"), "missing": F.lit(None)}).alias("text"))


@_query()
def mock_summaries(spark, sf):
    k = F.col("p_size") % 4
    kind = F.when(k == 0, "CLASS").when(k == 1, "FILE").otherwise("METHOD")
    name = F.concat("p_brand", F.when(F.col("p_partkey") % 2 == 0, "Controller").otherwise("Service"))
    return tables.read(spark, sf, "part").select("p_partkey", prompts.mock_summary(kind, name, F.when(k == 2, F.lit("getX")).otherwise("saveY")).alias("summary"))


# --- further lookups, defaults and texts ------------------------------------------------


@_query("""SELECT CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS system_id, CAST(event_id % 50 AS BIGINT) AS task_id, CASE WHEN event_id % 4 = 0 THEN 'default' ELSE event_type END AS model_name, CAST(1 AS INTEGER) AS prompt_version,
  CAST(floor(value * 10) AS BIGINT) AS input_tokens, CAST(floor(value * 3) AS BIGINT) AS output_tokens, CAST(floor(value * 10) AS BIGINT) + CAST(floor(value * 3) AS BIGINT) AS total_tokens,
  CAST(CAST(floor(value * 10) * 2e-6 + floor(value * 3) * 6e-6 AS DECIMAL(18,6)) AS DECIMAL(10,4)) AS cost, CAST(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS SMALLINT) AS status FROM events""")
def usage_records(spark, sf):
    e = tables.read(spark, sf, "events")
    k = F.col("event_id")
    return audit.usage_record(e.select(
        F.when(k % 3 != 0, F.col("user_id")).alias("system_id"), (k % 50).alias("task_id"), F.when(k % 4 != 0, F.col("event_type")).alias("model_name"), F.lit(None).cast("int").alias("prompt_version"),
        F.floor(F.col("value") * 10).cast("bigint").alias("input_tokens"), F.floor(F.col("value") * 3).cast("bigint").alias("output_tokens"), (F.col("event_type") != "error").alias("ok"),
    ))


@_query("""WITH l AS (SELECT doc_id, string_split(CASE WHEN text LIKE '%' || chr(10) THEN text[:-2] ELSE text END, chr(10)) AS s FROM documents)
  SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'class C' || doc_id || ' { /* code stub */ }' ELSE array_to_string(s[2:least(len(s), 4)], chr(10)) || CASE WHEN len(s) >= 2 THEN chr(10) ELSE '' END END AS code FROM l""")
def chunk_code(spark, sf):
    f = tables.files(spark, sf)
    c = f.select("doc_id", "path", F.concat(F.lit("C"), F.col("doc_id").cast("string")).alias("class_name"), F.lit(2).alias("start_line"), F.lit(4).alias("end_line"))
    return chunking.chunk_content(c, f.where("doc_id % 5 <> 0").select("path", "content")).select("doc_id", "code")


@_query("""SELECT o_orderkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'http://own/' || s_suppkey ELSE 'http://base' END AS active_url, CASE WHEN s_suppkey % 2 = 0 THEN 'k' || s_suppkey ELSE 'test-key' END AS active_key,
  NOT coalesce(s_suppkey % 2 = 0, false) AS mock FROM orders LEFT JOIN supplier ON s_suppkey = o_custkey""")
def model_config(spark, sf):
    s = tables.read(spark, sf, "supplier")
    key = F.col("s_suppkey")
    models = s.select(key.alias("id"), key.cast("string").alias("identifier"), F.when(key % 3 == 0, F.concat(F.lit("http://own/"), key.cast("string"))).otherwise(" ").alias("base_url"), F.when(key % 2 == 0, F.concat(F.lit("k"), key.cast("string"))).alias("api_key"))
    t = tables.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("model_name"))
    out = prompts.with_model(t, models, "http://base", "test-key")
    return out.select("id", "active_url", "active_key", prompts.should_mock(F.lit(False), F.col("active_key")).alias("mock"))


@_query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 IN (1, 2, 4) THEN 'p' || (o_orderkey % 7) ELSE 'p1' END AS prompt FROM orders""")
def prompt_choice(spark, sf):
    rows = [(1, "p1", 1, 1, 1), (2, "p2", 2, 1, 0), (3, "off", 3, 0, 0), (4, "p4", 4, 1, 0), (5, "late", 4, 1, 0)]
    p = spark.createDataFrame(rows, "id int, content string, version int, status int, is_default int")
    t = tables.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 7).cast("int").alias("prompt_version"))
    return prompts.resolve_prompt(t, p).select("id", "prompt")


@_query(f"""WITH {_TASKS} SELECT id, list_filter(['[task:' || id || '] type=T status=' || status, '[system:' || system_id || '] ' || CASE WHEN id % 2 = 0 THEN 'S' ELSE '正在加载系统元数据' END, '[progress] 已完成 5%',
  CASE WHEN status = 'DRAFT' THEN '[next] 启动任务后将进入执行队列' WHEN status IN ('PENDING','PULLING_CODE','PARSING_CODE','SPLITTING_TASK','AI_ANALYZING','GENERATING_DOC') THEN '[worker] 执行管道运行中，进度正在刷新'
    WHEN status = 'FAILED' THEN '[error] 未知失败' WHEN status IN ('PENDING_REVIEW','REVIEWING','CONFIRMED','PUSHED') THEN '[result] Markdown 草稿已生成，可进入复核或版本推送' END], lambda x: x IS NOT NULL) AS lines FROM tasks""")
def status_log_lines(spark, sf):
    t = tables.tasks(spark, sf).select("id", F.lit("T").alias("type"), "status", "system_id", F.when(F.col("id") % 2 == 0, "S").alias("system_name"), F.lit(5).alias("progress"), F.lit("").alias("error_reason"))
    return lifecycle.log_lines(t).select("id", "lines")


@_query("""SELECT c_custkey AS draft_id, max(CASE WHEN o_orderkey % 4 = 0 THEN 'n' || o_orderkey END) IS NOT NULL AS has, arg_max('t' || o_orderkey, o_orderkey) AS content FROM customer JOIN orders ON o_custkey = c_custkey
  WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders) - INTERVAL 700 DAY GROUP BY 1""")
def autosave_latest(spark, sf):
    o = tables.read(spark, sf, "orders")
    as_of = F.lit(o.agg(F.max("o_orderdate")).first()[0])
    w = o.select(F.col("o_custkey").alias("draft_id"), F.col("o_orderkey").alias("k"), F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("content"), F.col("o_orderdate").alias("at"))
    # Of the live writes the one with the greatest key is to be the last.
    start = as_of - F.expr("INTERVAL 700 DAYS")
    at = F.when(F.col("at") > start, F.timestamp_add("SECOND", F.col("k"), start)).otherwise(F.col("at"))
    saves = lifecycle.autosaves(w.withColumn("at", at), as_of, 700)
    flags = w.where(F.col("at") > as_of - F.expr("INTERVAL 700 DAYS")).groupBy("draft_id").agg(F.bool_or(F.col("k") % 4 == 0).alias("has"))
    return saves.select("draft_id", "content").join(flags, "draft_id")


@_query("""SELECT p_partkey, CASE WHEN p_size > 0 THEN printf('%.1fs', p_size * 100 / 1000) ELSE '-' END AS shown, p_size IN (0, 1) AS ok FROM part""")
def duration_and_domain(spark, sf):
    p = tables.read(spark, sf, "part")
    good, bad = lifecycle.status_domain(p, "p_size")
    both = good.withColumn("ok", F.lit(True)).unionByName(bad.withColumn("ok", F.lit(False)))
    return both.select("p_partkey", T.duration_text((F.col("p_size") * 100).cast("bigint")).alias("shown"), "ok")


@_query("""SELECT s_suppkey, 'Order' || s_suppkey || 'Service' AS class_name, 'count' || s_suppkey AS method_name, ['`repo` (Repo)', '`m` (Map<A, B>)'] AS dependencies FROM supplier""")
def trial_parse(spark, sf):
    key = F.col("s_suppkey").cast("string")
    code = F.concat(F.lit("public class Order"), key, F.lit("Service {\n private final Repo repo;\n protected Map<A, B> m = x;\n public int count"), key, F.lit("(int a) { return 1; }\n}"))
    return tables.read(spark, sf, "supplier").select("s_suppkey", prompts.trial_report(code, F.lit("m")).alias("r")).select("s_suppkey", "r.class_name", "r.method_name", "r.dependencies")


@_query("""SELECT p_partkey, regexp_replace(p_name || ' (A/B)', '[\\s/()]', '_', 'g') AS file, upper(p_brand[1]) || p_brand[2:] AS name FROM part""")
def file_names(spark, sf):
    p = tables.read(spark, sf, "part")
    return p.select("p_partkey", T.file_name(F.concat("p_name", F.lit(" (A/B)"))).alias("file"), T.capitalised(F.col("p_brand")).alias("name"))


@_query("""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'a' ELSE 'MODIFIED' END AS change FROM pages WHERE page_id % 3 = 1 AND page_id % 2 <> 0 UNION ALL SELECT page_id, 'ADDED' FROM pages WHERE page_id % 3 = 0 AND page_id % 2 <> 0
  UNION ALL SELECT page_id, 'DELETED' FROM pages WHERE page_id % 3 = 2""")
def changed_files(spark, sf):
    p = tables.read(spark, sf, "pages").select("page_id", F.col("page_id").cast("string").alias("path"), F.md5("html").alias("file_hash"))
    new = p.where("page_id % 3 <> 2 and (page_id % 3 <> 0 or page_id % 2 <> 0)")
    old = p.where("page_id % 3 <> 0").withColumn("file_hash", F.when((F.col("page_id") % 3 == 1) & (F.col("page_id") % 2 != 0), F.lit("old")).otherwise(F.col("file_hash")))
    return source_files.changed_files(new, old).select(F.col("path").cast("bigint").alias("page_id"), "change")


@_query("""SELECT s_suppkey AS id, s_name AS name, CAST(s_suppkey % 5 AS INTEGER) AS sort_order FROM supplier ORDER BY sort_order, id DESC""")
def model_list(spark, sf):
    return api.models(tables.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), (F.col("s_suppkey") % 5).cast("int").alias("sort_order")))


# --- review and versions ------------------------------------------------------------------


def _review(spark, sf):
    """Drafts are orders, workspaces customers, repositories nations, edits and decisions come from orders of some keys."""
    o, c, n = (tables.read(spark, sf, t) for t in ("orders", "customer", "nation"))
    k = F.col("o_orderkey")
    text = F.concat(F.lit("a\nb\n"), F.col("o_orderpriority"))
    drafts = o.select(
        k.alias("id"), F.col("o_custkey").alias("workspace_id"), F.concat(F.lit("m"), (k % 9).cast("string")).alias("module_name"), F.lit("uri").alias("content_uri"), text.alias("content"), F.md5(text).alias("hash"),
        F.when(F.col("o_orderstatus") == "F", "CONFIRMED").when(F.col("o_orderstatus") == "O", "AI_GENERATED").otherwise("PENDING_REVIEW").alias("status"), F.col("o_orderdate").alias("updated_at"),
    )
    ws = c.select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("task_id"), F.col("c_nationkey").cast("bigint").alias("repository_id"), F.lit("OPEN").alias("status"), F.lit(None).cast("timestamp_ntz").alias("updated_at"))
    repos = n.where("n_nationkey % 5 <> 0").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("git_url"), F.lit("main").alias("branch"), F.concat(F.lit("c"), F.col("n_nationkey").cast("string")).alias("last_commit_id"))
    return drafts, ws, repos


_DRAFTS = """drafts AS (SELECT o_orderkey AS id, o_custkey AS workspace_id, 'a' || chr(10) || 'b' || chr(10) || o_orderpriority AS content,
  CASE o_orderstatus WHEN 'F' THEN 'CONFIRMED' WHEN 'O' THEN 'AI_GENERATED' ELSE 'PENDING_REVIEW' END AS status, o_orderdate AS updated_at FROM orders)"""


def _edits(spark, sf):
    o, k = tables.read(spark, sf, "orders"), F.col("o_orderkey")
    text = F.concat(F.lit("b\n"), F.col("o_orderstatus"), F.lit("\nx\nx"))
    return o.where(k % 3 == 0).select(F.when(k % 2 == 0, -k - 1).otherwise(k).alias("draft_id"), text.alias("content"), F.lit("u").alias("author"), F.when(k % 5 == 0, F.lit("r")).alias("remark"), F.col("o_orderdate").alias("at"))


@_query(f"""WITH {_DRAFTS} SELECT d.id, CASE WHEN d.id % 6 = 3 THEN 'REVISED' ELSE d.status END AS status, md5(CASE WHEN d.id % 6 = 3 THEN 'b' || chr(10) || o_orderstatus || chr(10) || 'x' || chr(10) || 'x' ELSE d.content END) AS hash
  FROM drafts d JOIN orders ON o_orderkey = d.id""")
def draft_saved(spark, sf):
    return review.saved(_review(spark, sf)[0], _edits(spark, sf))[0].select("id", "status", "hash")


@_query("""SELECT o_orderkey AS draft_id, 'uri' AS content_uri, 'u' AS author, CASE WHEN o_orderkey % 5 = 0 THEN 'r' ELSE '保存修改' END || ' [新增 3 行, 删除 2 行]' AS remark, o_orderdate AS created_at FROM orders WHERE o_orderkey % 6 = 3""")
def draft_revisions(spark, sf):
    return review.saved(_review(spark, sf)[0], _edits(spark, sf))[1]


@_query("SELECT -o_orderkey - 1 AS draft_id, '草稿不存在' AS error FROM orders WHERE o_orderkey % 6 = 0")
def draft_missing(spark, sf):
    return review.missing(_edits(spark, sf), _review(spark, sf)[0]).select("draft_id", "error")


def _decided(spark, sf):
    drafts, ws, _ = _review(spark, sf)
    k = F.col("id")
    decisions = drafts.where(k % 4 != 0).select(k.alias("draft_id"), (k % 7 != 0).alias("confirmed"), F.lit("u").alias("author"), F.concat(F.lit("why "), k.cast("string")).alias("comment"), F.col("updated_at").alias("at"))
    return review.decided(drafts, ws, decisions)


_AFTER = f"{_DRAFTS}, after AS (SELECT *, CASE WHEN id % 4 = 0 THEN status WHEN id % 7 = 0 THEN 'REJECTED' ELSE 'CONFIRMED' END AS now FROM drafts)"


@_query(f"WITH {_AFTER} SELECT id, now AS status FROM after")
def draft_decisions(spark, sf):
    return _decided(spark, sf)[0].select("id", "status")


@_query(f"""WITH {_AFTER}, w AS (SELECT workspace_id, bool_and(now = 'CONFIRMED') AS done, max(CASE WHEN id % 4 <> 0 AND id % 7 <> 0 THEN updated_at END) AS last FROM after GROUP BY 1)
  SELECT c_custkey AS id, CASE WHEN done AND last IS NOT NULL THEN 'COMPLETED' ELSE 'OPEN' END AS status, CASE WHEN done THEN last END AS updated_at FROM customer LEFT JOIN w ON workspace_id = c_custkey""")
def workspace_completion(spark, sf):
    return _decided(spark, sf)[1].select("id", "status", "updated_at")


@_query("SELECT o_orderkey AS draft_id, 'u' AS author, 'why ' || o_orderkey AS comment, o_orderdate AS created_at FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey % 7 = 0")
def review_comments(spark, sf):
    return _decided(spark, sf)[2]


@_query("""SELECT o_orderkey AS draft_id, o_custkey AS workspace_id, CAST(c_nationkey AS BIGINT) AS repository_id, CASE WHEN n_nationkey % 5 <> 0 THEN n_name END AS git_url
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey""")
def draft_repository(spark, sf):
    return review.draft_repositories(*_review(spark, sf))


_ERRORS = "', '".join(lifecycle.T.VERSION_ERRORS)


@_query(f"""WITH {_DRAFTS}, d AS (SELECT workspace_id, count(*) AS n FROM drafts WHERE status IN ('CONFIRMED', 'REVISED', 'AI_GENERATED') GROUP BY 1), q AS (SELECT c_custkey + (c_custkey % 2) * 100000 AS task_id FROM customer),
  t AS (SELECT q.task_id, c_nationkey, n_nationkey, coalesce(n, 0) AS n, c_custkey FROM q LEFT JOIN customer ON c_custkey = q.task_id LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey % 5 <> 0 LEFT JOIN d ON workspace_id = c_custkey AND c_custkey % 4 = 0)
  SELECT task_id, 'v1' AS version_num, CASE WHEN n_nationkey IS NOT NULL THEN 'c' || n_nationkey END AS source_commit, 'docs' AS target_branch, 'DRAFT' AS status, CAST(n AS BIGINT) AS drafts,
    CASE WHEN c_custkey IS NULL THEN ['{_ERRORS}'][1] WHEN n_nationkey IS NULL THEN ['{_ERRORS}'][2] WHEN c_custkey % 4 <> 0 THEN ['{_ERRORS}'][3] WHEN n = 0 THEN ['{_ERRORS}'][4] END AS error FROM t""")
def version_requests(spark, sf):
    drafts, ws, repos = _review(spark, sf)
    tasks = ws.select("id", F.lit(1).alias("system_id"), "repository_id", F.lit(None).cast("int").alias("prompt_version"))
    requests = ws.select((F.col("id") + (F.col("id") % 2) * 100_000).alias("task_id"), F.lit("v1").alias("version_num"), F.lit("u").alias("confirmed_by"), F.lit(None).cast("timestamp_ntz").alias("at"))
    out = review.new_versions(requests, tasks, repos, ws.where("id % 4 = 0"), drafts, "docs", "model")
    return out.select("task_id", "version_num", "source_commit", "target_branch", "status", "drafts", "error")


@_query("""WITH g AS (SELECT o_custkey AS id, CAST(CASE WHEN bool_or(o_orderstatus <> 'F') THEN 1 WHEN bool_or(o_orderkey % 7 = 0) THEN 2 ELSE 0 END AS INTEGER) AS gate, max(o_orderdate) AS last FROM orders WHERE o_orderkey % 5 = 0 GROUP BY 1)
  SELECT c_custkey AS id, CASE WHEN gate = 0 THEN 'PUSHED' ELSE 'DRAFT' END AS status, CASE WHEN gate = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'k' || c_custkey ELSE 'MOCK_PUSH_COMMIT_' || c_custkey END END AS target_commit, gate FROM customer LEFT JOIN g ON g.id = c_custkey""")
def version_push(spark, sf):
    k = F.col("o_orderkey")
    d = tables.read(spark, sf, "orders").where(k % 5 == 0).select(F.col("o_custkey").alias("version_id"), F.when(F.col("o_orderstatus") == "F", "CONFIRMED").otherwise("REVISED").alias("status"), F.when(k % 7 == 0, "a\n- [ ] x").otherwise("a").alias("content"), F.lit("m").alias("module_name"))
    v = tables.read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit("DRAFT").alias("status"), F.lit(None).cast("string").alias("target_commit"), F.lit(None).cast("timestamp_ntz").alias("pushed_at"))
    commits = v.where("id % 2 = 0").select(F.col("id").alias("version_id"), F.concat(F.lit("k"), F.col("id").cast("string")).alias("commit"), F.lit("2024-01-01").cast("timestamp_ntz").alias("at"))
    return review.pushed(v, publish.push_gate(d), commits).select("id", "status", "target_commit", "gate")


@_query(f"""WITH t AS (SELECT n_nationkey AS k, n_name, n_regionkey FROM nation) SELECT 'architecture-overview.md' AS path, '{lifecycle.T.ARCHITECTURE[0]}' || count(*) || '{lifecycle.T.ARCHITECTURE[1]}' || string_agg('- **' || n_name || '**: f' || k || chr(10), '' ORDER BY k) || '{lifecycle.T.ARCHITECTURE[2]}' AS content
  FROM t WHERE n_regionkey % 2 = 0 UNION ALL SELECT 'frontend-overview.md', '{lifecycle.T.FRONT_END}' UNION ALL SELECT 'backend-overview.md', '{lifecycle.T.BACK_END}' UNION ALL SELECT 'index.md', '{lifecycle.T.MAIN_INDEX.replace("{product}", "X")}'""")
def publication_pages(spark, sf):
    key = F.col("n_nationkey")
    d = tables.read(spark, sf, "nation").select(key.alias("id"), F.col("n_name").alias("module_name"), F.concat(F.lit("f"), key.cast("string")).alias("file_path"), F.lit("x").alias("content"), F.when(F.col("n_regionkey") % 2 == 0, "CONFIRMED").otherwise("REJECTED").alias("status"))
    ref = publish.referenced(d, spark.createDataFrame([], "id bigint, draft_id bigint, file_path string"), _no_classes(spark))
    return publish.publication(d, ref, "X").where(F.col("path").isin("architecture-overview.md", "frontend-overview.md", "backend-overview.md", "index.md"))


def _no_classes(spark):
    parsed = "struct<class_name:string,type:string,tables:array<string>,dependencies:array<string>,methods:array<struct<name:string,request_mapping:string,http_method:string>>>"
    return spark.createDataFrame([], f"path string, parsed {parsed}")


@_query("""WITH m AS (SELECT n_nationkey AS k, n_name AS v FROM nation) SELECT v AS version_num, 'meta/knowledge-version.json' AS path, '{' || chr(10) || '  "version" : "' || v || '",' || chr(10) || '  "systemId" : ' || k || ',' || chr(10) || '  "commitId" : "c",' || chr(10)
  || '  "generatedAt" : "2024-01-02T03:04:05.000000",' || chr(10) || '  "confirmedBy" : null' || chr(10) || '}' AS content FROM m
  UNION ALL SELECT v, 'meta/prompt-used.json', '{' || chr(10) || '  "taskId" : ' || (k * 2) || ',' || chr(10) || '  "promptVersion" : 1,' || chr(10) || '  "modelName" : "M",' || chr(10) || '  "appliedAt" : "2024-01-02T03:04:05.000000"' || chr(10) || '}' FROM m""")
def publication_metadata(spark, sf):
    k = F.col("n_nationkey")
    v = tables.read(spark, sf, "nation").select(F.col("n_name").alias("version_num"), k.alias("system_id"), (k * 2).alias("task_id"), F.lit("c").alias("source_commit"), F.lit(None).cast("int").alias("prompt_version"), F.lit("M").alias("model_name"), F.lit(None).cast("string").alias("confirmed_by"), F.lit("2024-01-02 03:04:05").cast("timestamp_ntz").alias("created_at"))
    return publish.publication_metadata(v)


@_query(f"""WITH f AS (SELECT p_partkey, p_size, lower(replace(p_brand, '#', '')) AS b, {_PATHS} AS path FROM part)
  SELECT p_partkey, CASE WHEN contains(path, 'brand1') THEN 'Mapped' WHEN p_partkey % 3 = 0 THEN 'Known' WHEN p_partkey % 3 = 1 AND p_partkey % 2 = 0 THEN 'Old'
    WHEN p_size % 7 <> 0 THEN CASE WHEN p_size % 4 = 3 THEN 'DemoModule' WHEN p_size % 4 = 2 THEN 'AModule' ELSE upper(b[1]) || b[2:] || 'Module' END WHEN p_partkey % 5 = 0 THEN 'OrdersModule' ELSE 'CoreModule' END AS module FROM f""")
def module_router(spark, sf):
    f = _part_paths(spark, sf).withColumn("system_id", F.lit(1)).withColumn("chunk_type", F.lit("CLASS")).withColumn("class_type", F.when(F.col("p_partkey") % 5 == 0, "CONTROLLER").otherwise("SERVICE")).withColumn("request_mapping", F.lit("/api/orders/x"))
    known = lambda cond, module: f.where(cond).select("system_id", "path", F.lit(module).alias("module"))
    maps = source_files.patterns(spark, [(0, 0, "Mapped", "brand1")])
    none = source_files.patterns(spark, [(0, 0, "Never", "no such path")])
    out = routing.routed(f, maps, none, known("p_partkey % 3 = 0", "Known"), known("p_partkey % 2 = 0", "Old").where("path like '%X%'").join(f.where("p_partkey % 3 = 1").select("path"), "path", "left_semi").select("system_id", "path", "module"))
    return out.select("p_partkey", "module")


@_query("SELECT event_id AS id, event_type AS file_type FROM events WHERE user_id = 3 ORDER BY 1")
def snapshot_list(spark, sf):
    e = tables.read(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("task_id"), F.col("event_type").alias("file_type"))
    return api.snapshots(e, 3).select("id", "file_type")


@_query(f"""WITH {_USAGE}, t AS (SELECT system_id, CAST(sum(total_tokens) AS BIGINT) AS tokens FROM usage GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
  SELECT system_id, tokens FROM t ORDER BY tokens, system_id DESC""")
def ranking_reversed(spark, sf):
    return audit.ranking_reversed(audit.system_ranking(tables.token_usage(spark, sf), tables.systems(spark, sf), 10)).select("system_id", "tokens")


@_query("SELECT o_custkey * 2 AS id, c_name AS name, CASE WHEN c_custkey IS NULL THEN '记录不存在' END AS error FROM (SELECT DISTINCT o_custkey FROM orders) LEFT JOIN customer ON c_custkey = o_custkey * 2")
def lookup_or_error(spark, sf):
    wanted = tables.read(spark, sf, "orders").select((F.col("o_custkey") * 2).alias("id")).distinct()
    return api.found(tables.read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), wanted)


@_query("""WITH r AS (SELECT user_id AS id, arg_max(event_type, ts) AS c, max(ts) AS t FROM events GROUP BY 1) SELECT c_custkey AS id, coalesce(t, NULL) AS last_decompile_at, c IS NOT NULL AS stamped FROM customer LEFT JOIN r ON r.id = c_custkey""")
def commit_stamp(spark, sf):
    none = F.lit(None).cast("string")
    c = tables.read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), none.alias("last_commit_id"), F.lit(None).cast("timestamp_ntz").alias("last_decompile_at"))
    runs = tables.read(spark, sf, "events").select(F.col("user_id").alias("repository_id"), F.col("event_type").alias("commit_id"), F.col("ts").alias("at"))
    return review.stamped(c, runs).select("id", "last_decompile_at", F.col("last_commit_id").isNotNull().alias("stamped"))
