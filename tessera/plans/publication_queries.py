"""All pages of several publications, line by line."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import publish
from tessera.plans.registry import query
from tessera.sources import tables

# The pages' fixed texts, written out again so that a wrong constant of the operator shows; $ stands for a line feed.
_HEADS = """h(path, line) AS (VALUES
  ('index.md', '# X知识索引$$本目录包含系统代码解析生成的完整架构和模块说明文档。$$## 文档导览$- [架构概览](architecture-overview.md)$- [模块索引](module-index.md)$- [接口索引](api-index.md)$- [数据库索引](database-index.md)$- [依赖与调用链路](dependency-index.md)$- [待确认事项清单](pending-confirmation.md)$'),
  ('frontend-overview.md', '# 前端子系统架构设计 (React)$$## 核心组件与库$- 核心框架: React 18$- 构建工具: Vite$- 状态库: Zustand$- 组件库: Ant Design 5$'),
  ('backend-overview.md', '# 后端服务系统架构设计 (Java 17)$$## 核心框架$- 基础框架: Spring Boot 3.x$- 持久层: MyBatis-Plus / PostgreSQL$- 缓存: Redis$- 工作流: 任务状态机$'),
  ('module-index.md', '# 模块知识归纳索引$$本知识库由X基于大模型及静态解析自动归纳生成。$$## 系统模块列表$'), ('meta/module-map.yaml', 'modules:$'), ('api-index.md', '# 系统接口路由索引 (API Index)$$'),
  ('database-index.md', '# 数据库操作与表关联索引 (Database Index)$$| 涉及数据表 | 模块名称 | 操作方法 |$| --- | --- | --- |$'), ('dependency-index.md', '# 模块调用与类依赖链路 (Dependency Index)$$| 涉及类名 | 模块名称 | 依赖的其他类 |$| --- | --- | --- |$'),
  ('pending-confirmation.md', '# 待确认事项汇总清单$$'))"""


@query(f"""WITH {_HEADS}, d AS (
  SELECT p_partkey % 12 AS v, p_partkey AS id, 'M ' || p_partkey AS m, 'M_' || p_partkey || '.md' AS file, CASE WHEN p_partkey % 7 <> 0 THEN 'f' || p_partkey END AS file_path,
    CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'text$- [ ] check ' || p_partkey || '$  - [ ]  twice $done' ELSE 'text ' || p_name END AS content FROM part WHERE p_partkey % 4 <> 3
), r AS (
  SELECT v, id AS a, l_orderkey * 10 + l_linenumber AS b, m, s_suppkey AS s FROM lineitem JOIN d ON id = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE v < 9
), c AS (
  SELECT v, id, m, unnest(range(1, 1 + len(string_split(content, '$')))) AS n, string_split(content, '$') AS s FROM d WHERE content IS NOT NULL
), w AS (SELECT v, count(*) AS n FROM d GROUP BY v), l AS (
  SELECT v, path, 0 AS section, NULL AS t, NULL AS a, NULL AS b, NULL AS c, line FROM w CROSS JOIN h
  UNION ALL SELECT v, 'architecture-overview.md', 0, NULL, NULL, NULL, NULL, '# 系统整体架构设计说明$$## 系统划分$目前平台将代码仓库划分为 ' || n || ' 个主要业务模块：$$' FROM w
  UNION ALL SELECT v, 'architecture-overview.md', 1, NULL, id, NULL, NULL, '- **' || m || '**: ' || coalesce(file_path, 'null') || '$' FROM d
  UNION ALL SELECT v, 'architecture-overview.md', 2, NULL, NULL, NULL, NULL, '$## 技术决策与原则$1. 前后端分离设计$2. 引入 Token 审计拦截与操作追踪日志$' FROM w
  UNION ALL SELECT v, 'module-index.md', 1, NULL, id, NULL, NULL, '- [' || m || '](modules/' || file || ')$' FROM d
  UNION ALL SELECT v, 'meta/module-map.yaml', 1, NULL, id, NULL, NULL, '  - name: "' || m || '"$    path: "docs/k/modules/' || file || '"$' FROM d
  UNION ALL SELECT v, 'api-index.md', 1, NULL, a, b, 0, '| ' || m || ' | `/x/' || s || '` | `GET` | `list` |$' FROM r
  UNION ALL SELECT v, 'api-index.md', 1, NULL, a, b, 2, '| ' || m || ' | `/s` | `POST` | `save` |$' FROM r
  UNION ALL SELECT v, 'database-index.md', 1, NULL, a, b, 0, '| `t' || s || '` | ' || m || ' | CONTROLLER 类操作 |$' FROM r
  UNION ALL SELECT v, 'dependency-index.md', 1, NULL, a, b, NULL, '| `C' || s || '` | ' || m || ' | `a:A' || s || ', b:B` |$' FROM r WHERE s % 3 <> 0
  UNION ALL SELECT v, 'api-index.md', 1, NULL, NULL, NULL, NULL, '| 暂无 | 暂无 | 暂无 | 暂无 |$' FROM w WHERE v NOT IN (SELECT v FROM r)
  UNION ALL SELECT v, 'database-index.md', 1, NULL, NULL, NULL, NULL, '| 暂无 | 暂无 | 暂无 |$' FROM w WHERE v NOT IN (SELECT v FROM r)
  UNION ALL SELECT v, 'dependency-index.md', 1, NULL, NULL, NULL, NULL, '| 暂无 | 暂无 | 暂无 |$' FROM w WHERE v NOT IN (SELECT v FROM r WHERE s % 3 <> 0)
  UNION ALL SELECT v, 'pending-confirmation.md', 1, m, n, id, NULL, '- 模块 `' || m || '`: ' || trim(substr(trim(s[n]), 6)) || '$' FROM c WHERE trim(s[n]) LIKE '- [ ]%'
  UNION ALL SELECT v, 'pending-confirmation.md', 1, NULL, NULL, NULL, NULL, '恭喜，目前系统内无待确认的阻断事项！$' FROM w WHERE v NOT IN (SELECT v FROM c WHERE trim(s[n]) LIKE '- [ ]%')
  UNION ALL SELECT v, 'modules/' || file, 1, NULL, id, NULL, NULL, coalesce(content, '# ' || m) FROM d
)
SELECT v AS version_id, path, CAST(row_number() OVER (PARTITION BY v, path ORDER BY section, t NULLS FIRST, a NULLS FIRST, b NULLS FIRST, c NULLS FIRST, line) AS BIGINT) AS place, replace(line, '$', chr(10)) AS line FROM l""")
def publication_lines(spark, sf):
    """A version for every twelfth part, four of them without references; a fourth of the drafts is in a state that no version takes."""
    k = F.col("p_partkey")
    key = k.cast("string")
    content = F.when(k % 5 == 0, None).when(k % 5 == 1, F.concat(F.lit("text\n- [ ] check "), key, F.lit("\n  - [ ]  twice \ndone"))).otherwise(F.concat(F.lit("text "), "p_name"))
    states = F.array(*[F.lit(s) for s in ("CONFIRMED", "REVISED", "AI_GENERATED", "REJECTED")])
    d = tables.read(spark, sf, "part").select((k % 12).alias("version_id"), k.alias("id"), F.concat(F.lit("M "), key).alias("module_name"), F.when(k % 7 != 0, F.concat(F.lit("f"), key)).alias("file_path"), content.alias("content"), F.get(states, (k % 4).cast("int")).alias("status"))
    li = tables.read(spark, sf, "lineitem").where("l_partkey % 12 < 9")
    refs = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("draft_id"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string"), F.lit(".java")).alias("file_path"))
    s = F.col("s_suppkey").cast("string")
    method = lambda n, url, verb: F.struct(F.lit(n).alias("name"), url.alias("request_mapping"), verb.alias("http_method"))
    parsed = F.struct(
        F.concat(F.lit("C"), s).alias("class_name"), F.lit("CONTROLLER").alias("type"), F.array(F.concat(F.lit("t"), s)).alias("tables"),
        F.when(F.col("s_suppkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("a:A"), s), F.lit("b:B"))).alias("dependencies"),
        F.array(method("list", F.concat(F.lit("/x/"), s), F.lit(None).cast("string")), method("none", F.lit(None).cast("string"), F.lit("GET")), method("save", F.lit("/s"), F.lit("POST"))).alias("methods"),
    )
    classes = tables.read(spark, sf, "supplier").select(F.concat(F.lit("S"), s, F.lit(".java")).alias("path"), parsed.alias("parsed"))
    return publish.publication_lines(d, refs, classes, "X", "docs/k")
