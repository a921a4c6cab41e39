"""Stored-row rules: marked chunks, prompt templates, new tasks, lists of a draft, logs, exclusions of a scan, errors of a row."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import api
from tessera.functions import predicates
from tessera.operators import chunking, prompts
from tessera.plans.registry import ORACLES, query
from tessera.sources import sinks, tables

# Written out here as the texts must be: summaries by the class's end, or by the method's beginning.
ORACLES["mock_summaries"] = """WITH p AS (SELECT p_partkey, p_size % 4 AS k, p_brand || CASE WHEN p_partkey % 2 = 0 THEN 'Controller' ELSE 'Service' END AS c FROM part)
  SELECT p_partkey, CASE WHEN k = 2 THEN '该方法主要负责执行数据库只读检索逻辑。接收特定的过滤参数或标识符，通过持久层抓取对应记录并经过基础映射后输出至调用方。'
    WHEN k = 3 THEN '该方法主要负责执行数据的写入逻辑。对传入实体进行参数完整性与格式化判定，随后通过数据源开启写入事务并在成功后返回对应的主键 ID。'
    WHEN c LIKE '%Controller' THEN '本类为接口访问控制层控制器。定义了针对 ' || replace(c, 'Controller', '') || ' 资源的相关 REST 路由接口，负责前端请求参数校验、数据分发和统一响应格式的封装输出。'
    ELSE '本类为系统的核心业务逻辑服务类。负责处理业务决策、状态机转换和数据处理的事务边界。协调各个数据操作的 Mapper 接口以提供完整的业务支持。' END AS summary FROM p"""


@query("""WITH f AS (SELECT doc_id, source || CASE doc_id % 6 WHEN 0 THEN '/.idea' WHEN 1 THEN '/target/x' WHEN 2 THEN '/my.target' WHEN 3 THEN '/node_modules' ELSE '' END AS dir, CASE doc_id % 4 WHEN 0 THEN '.JAVA' WHEN 1 THEN '.md' WHEN 2 THEN '.mdx' ELSE '' END AS ext FROM documents)
  SELECT doc_id FROM f WHERE doc_id % 6 IN (2, 4, 5) AND lower(ext) NOT IN ('.java', '.md') AND NOT contains(lower(dir), 'src1')""")
def scan_exclusions(spark, sf):
    """Hidden and build folders, types and directories that a scan leaves out."""
    k = F.col("doc_id")
    folder = F.when(k % 6 == 0, "/.idea").when(k % 6 == 1, "/target/x").when(k % 6 == 2, "/my.target").when(k % 6 == 3, "/node_modules").otherwise("")
    ext = F.when(k % 4 == 0, ".JAVA").when(k % 4 == 1, ".md").when(k % 4 == 2, ".mdx").otherwise("")
    f = tables.read(spark, sf, "documents").select("doc_id", F.concat("source", folder, F.lit("/doc_"), k.cast("string"), ext).alias("path"))
    return predicates.scanned(f, "Src1", ".java, MD").select("doc_id")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 64 IN (1, 2, 3) THEN 'FAILED' ELSE 'PENDING' END AS status, CASE WHEN o_orderkey % 64 IN (1, 2, 3) THEN 'Chunk analysis failed' ELSE 'old' END AS error_reason FROM orders""")
def chunk_marks(spark, sf):
    o = tables.read(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_orderkey") % 64).alias("id"), F.lit("PENDING").alias("status"), F.lit("old").alias("error_reason"))
    return chunking.mark(o, [1, 2, 3], "FAILED", " ").select(F.col("key").alias("id"), "status", "error_reason")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 64 IN (1, 2, 3) THEN 'PENDING' ELSE 'FAILED' END AS status, CASE WHEN o_orderkey % 64 IN (1, 2, 3) THEN NULL ELSE 'e' || o_orderkey END AS error_reason FROM orders""")
def chunk_retries(spark, sf):
    o = tables.read(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_orderkey") % 64).alias("id"), F.lit("FAILED").alias("status"), F.concat(F.lit("e"), F.col("o_orderkey").cast("string")).alias("error_reason"))
    return chunking.mark(o, [1, 2, 3], "PENDING").select(F.col("key").alias("id"), "status", "error_reason")


def _prompts(spark, sf):
    k = F.col("p_partkey")
    return tables.read(spark, sf, "part").select(k.alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("content"), F.col("p_size").cast("int").alias("version"), F.lit(1).cast("smallint").alias("status"), (k % 3 == 0).cast("smallint").alias("is_default"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey = 7 THEN 'new text' ELSE p_type END AS content, CAST(p_size + CASE WHEN p_partkey = 7 THEN 1 ELSE 0 END AS INTEGER) AS version, p_partkey % 3 <> 0 AS deletable FROM part""")
def prompt_edits(spark, sf):
    return prompts.deletable(prompts.edited(_prompts(spark, sf), 7, "new text")).select("id", "content", "version", "deletable")


@query("""SELECT p_name || ' - 副本' AS name, p_type AS content, CAST(1 AS INTEGER) AS version, CAST(0 AS SMALLINT) AS status, CAST(0 AS SMALLINT) AS is_default FROM part WHERE p_partkey = 7""")
def prompt_clone(spark, sf):
    return prompts.clone(_prompts(spark, sf), 7)


@query("""SELECT s_suppkey, '`' || 'repo' || '` (Repo)' AS first_dependency, CASE WHEN s_suppkey % 2 = 0 THEN '该方法主要负责执行数据库只读检索逻辑。接收特定的过滤参数或标识符，通过持久层抓取对应记录并经过基础映射后输出至调用方。' ELSE NULL END IS NOT NULL AS even,
  '本类为系统的核心业务逻辑服务类。负责处理业务决策、状态机转换和数据处理的事务边界。协调各个数据操作的 Mapper 接口以提供完整的业务支持。' AS summary, 'm' || s_suppkey AS model FROM supplier""")
def trial_summary(spark, sf):
    key = F.col("s_suppkey").cast("string")
    code = F.concat(F.lit("public class Order"), key, F.lit("Service {\n private final Repo repo;\n public int getOne(int a) { return 1; }\n}"))
    r = tables.read(spark, sf, "supplier").select("s_suppkey", prompts.trial_report(code, F.concat(F.lit("m"), key)).alias("r"))
    return r.select("s_suppkey", F.get("r.dependencies", F.lit(0)).alias("first_dependency"), (F.col("s_suppkey") % 2 == 0).alias("even"), "r.summary", "r.model")


@query("""SELECT o_orderkey AS system_id, CASE WHEN o_orderkey % 3 = 0 THEN 'm' || o_orderkey ELSE 'base' END AS model_name, 'DRAFT' AS status, 'INCREMENTAL' AS type, CAST(0 AS INTEGER) AS progress FROM orders""")
def new_tasks(spark, sf):
    k = F.col("o_orderkey")
    q = tables.read(spark, sf, "orders").select(k.alias("system_id"), F.col("o_custkey").alias("repository_id"), F.lit(1).alias("prompt_version"), F.when(k % 3 == 0, F.concat(F.lit("m"), k.cast("string"))).when(k % 3 == 1, " ").alias("model_name"), F.col("o_orderdate").alias("at"))
    models = tables.read(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") == 4, "base").otherwise("x").alias("identifier"), F.when(F.col("n_nationkey") == 4, "true").otherwise("false").alias("is_default"))
    return api.new_tasks(q, models, "INCREMENTAL").select("system_id", "model_name", "status", "type", "progress")


@query("""SELECT l_orderkey * 10 + l_linenumber AS id, l_shipdate AS created_at FROM lineitem WHERE l_partkey = 3 ORDER BY created_at DESC, id DESC""")
def draft_history(spark, sf):
    li = tables.read(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("draft_id"), F.col("l_shipdate").alias("created_at"))
    return api.of_draft(li, 3).select("id", "created_at")


@query("""SELECT l_orderkey * 10 + l_linenumber AS id FROM lineitem WHERE l_partkey = 3 ORDER BY id""")
def reference_list(spark, sf):
    li = tables.read(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("draft_id"))
    return api.draft_references(li, 3).select("id")


@query("""SELECT o_orderstatus AS status, CAST(o_shippriority AS INTEGER) AS progress, o_orderpriority AS error_reason FROM (SELECT *, 5 AS o_shippriority FROM orders) WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)""")
def task_progress(spark, sf):
    o = tables.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.lit(5).alias("progress"), F.col("o_orderpriority").alias("error_reason"))
    return api.task_progress(o, o.agg(F.min("id")).first()[0])  # one value


@query("""SELECT c_custkey AS task_id, CASE WHEN c_custkey % 2 = 0 THEN 'old' ELSE 'new' END AS status FROM customer""")
def workspaces_once(spark, sf):
    """Half of the tasks have a workspace; each of the others gets one, however often it asks."""
    c = tables.read(spark, sf, "customer").select(F.col("c_custkey").alias("task_id"))
    wanted = c.unionAll(c).withColumn("status", F.lit("new"))
    return sinks.get_or_create(c.where("task_id % 2 = 0").withColumn("status", F.lit("old")), wanted, "task_id")


@query("""SELECT event_id AS task_id, CAST(1 AS BIGINT) AS user_id, 'Owner' AS username, '127.0.0.1' AS ip_address, CAST(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS SMALLINT) AS is_success, event_type AS action_type FROM events""")
def operation_rows(spark, sf):
    e = tables.read(spark, sf, "events")
    rows = e.select(F.col("user_id").alias("system_id"), F.col("event_id").alias("task_id"), F.col("event_type").alias("action_type"), F.lit("d").alias("detail"), F.lit(None).cast("string").alias("exception_msg"), (F.col("event_type") != "error").alias("ok"), F.col("ts").alias("created_at"))
    return sinks.operation_log(rows).select("task_id", "user_id", "username", "ip_address", "is_success", "action_type")


@query("""SELECT p_partkey, CASE WHEN p_size > 40 AND p_partkey % 2 = 0 THEN 'size: at most 40, key: must be odd' WHEN p_size > 40 THEN 'size: at most 40' WHEN p_partkey % 2 = 0 THEN 'key: must be odd' END AS error FROM part""")
def field_errors(spark, sf):
    p = tables.read(spark, sf, "part")
    return p.select("p_partkey", predicates.field_errors([(F.col("p_size") > 40, "size: at most 40"), (F.col("p_partkey") % 2 == 0, "key: must be odd")]).alias("error"))
