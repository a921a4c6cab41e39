"""Queries of module maps: many patterns, and a JSON map beside a map file."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import routing
from tessera.plans.registry import query
from tessera.sources import files, tables

_PATHS = "f AS (SELECT DISTINCT source || '/' || lang || '/doc_' || doc_id || '.txt' AS path FROM documents)"


@query(f"""WITH {_PATHS}, m AS (SELECT CAST(p_partkey % 7 AS BIGINT) AS a, p_partkey AS b, 'M' || p_partkey AS module, CASE WHEN p_partkey % 50 = 0 THEN '/' || chr(92) ELSE 'doc_' END || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '.txt' ELSE '' END AS pattern FROM part),
  h AS (SELECT path, arg_min(module, a * 1000000000 + b) AS module FROM f JOIN m ON contains(path, replace(pattern, chr(92), '/')) GROUP BY path)
  SELECT path, module FROM h""")
def route_many_patterns(spark, sf):
    """A pattern a part: 2,000 and more for every 100 MB of tables; many contain others."""
    k, p = F.col("p_partkey"), F.col("p_partkey").cast("string")
    pattern = F.concat(F.when(k % 50 == 0, "/\\").otherwise("doc_"), p, F.when(k % 2 == 0, ".txt").otherwise(""))
    m = tables.read(spark, sf, "part").select((k % 7).cast("int").alias("module_ord"), k.cast("int").alias("path_ord"), F.concat(F.lit("M"), p).alias("module"), pattern.alias("pattern"))
    return routing.by_pattern(tables.files(spark, sf), m)


_YAML = "First:\n  - src1/fr\n  - src2/de/doc_1\n"
_JSON = '{"modules": [{"name": "Deep", "paths": ["src2/de", "\\\\doc_3"]}, {"id": 7, "paths": ["/en/"]}, {"name": "None"}, {"name": "Late", "paths": ["src2/de/doc_2", "src3"]}]}'


@query("""WITH f AS (SELECT doc_id, source || '/' || lang || '/doc_' || doc_id || '.txt' AS path FROM documents)
  SELECT doc_id, CASE WHEN contains(path, 'src1/fr') OR contains(path, 'src2/de/doc_1') THEN 'First' WHEN contains(path, 'src2/de') OR contains(path, '/doc_3') THEN 'Deep'
    WHEN contains(path, '/en/') THEN '7' WHEN contains(path, 'src3') THEN 'Late' ELSE 'CoreModule' END AS module FROM f""")
def route_json_map(spark, sf):
    """The map file comes before the JSON hierarchy, that before the fallback."""
    f = tables.files(spark, sf)
    maps = [files.patterns(spark, rows) for rows in (files.module_map_yaml(_YAML), files.module_map_json(_JSON))]
    return routing.routed(f.select("doc_id", "path"), *maps).select("doc_id", "module")
