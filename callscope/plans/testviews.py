"""Views of the test tables in the shape of this library's tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")

METHODS = """
SELECT p_partkey AS method_id, concat('com/acme/', lower(p_type), '/', replace(p_brand, '#', '')) AS owner,
  CASE p_size % 10 WHEN 0 THEN '<init>' WHEN 1 THEN 'getInstance' WHEN 2 THEN 'toString' WHEN 3 THEN 'getName' WHEN 4 THEN 'setName' WHEN 5 THEN 'info'
    WHEN 6 THEN '<clinit>' ELSE concat(replace(p_name, ' ', '_'), CAST(p_partkey AS VARCHAR(20))) END AS name,
  CASE p_partkey % 6 WHEN 0 THEN '()V' WHEN 1 THEN '(I)V' WHEN 2 THEN '(Ljava/lang/String;I)V' WHEN 3 THEN '([Ljava/lang/String;[[I)V'
    WHEN 4 THEN '(Lcom/acme/Outer$Inner;JD)Z' ELSE '(Ljava/util/Map;Ljava/util/List;I[BLjava/lang/Object;)V' END AS descriptor,
  CASE p_partkey % 3 WHEN 0 THEN 'PROJECT' WHEN 1 THEN 'DEPENDENCY' ELSE 'EXTERNAL' END AS source,
  CAST(p_size * 64 + p_partkey % 16 AS INT) AS access FROM {part}
"""
EDGES = """
SELECT from_id, to_id, line, l_orderkey, l_suppkey,
  CASE WHEN line % 3 = 0 THEN 'VIRTUAL' WHEN line % 3 = 1 THEN 'STATIC' ELSE 'INTERFACE' END AS invoke FROM (
  SELECT l_partkey AS from_id, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS to_id,
    l_linenumber AS line, l_orderkey, l_suppkey, l_returnflag, l_linestatus FROM {lineitem}) t
WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND to_id IS NOT NULL
"""
ROOTS = "SELECT p_partkey AS entry_id, p_partkey AS method_id FROM {part} WHERE p_size = 1"
SITES = "SELECT l_orderkey AS entry_id, l_partkey AS callee_id, l_suppkey AS caller_id, l_linenumber AS line FROM {lineitem}"
ENTRIES = """
SELECT CAST(o_orderkey AS VARCHAR(20)) AS key, o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS priority FROM {orders}
"""
PROJECTS = """
SELECT c_custkey AS project, max(CASE WHEN o_orderstatus = 'F' THEN o_orderdate END) AS class_time, max(CASE WHEN o_orderstatus = 'O' THEN o_orderdate END) AS source_time,
  max(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS analysed, CASE WHEN max(c_acctbal) < 0 THEN 1 ELSE 0 END AS missing
FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey GROUP BY c_custkey
"""
LOGS = "SELECT user_id AS job, concat(event_type, props) AS line, ts, event_id FROM {events}"
CLASSES = """
SELECT concat('com/r/R', CAST(r_regionkey AS VARCHAR(20))) AS class_name, CAST(NULL AS VARCHAR(60)) AS super_name, CAST(NULL AS VARCHAR(60)) AS iface, 1537 AS access FROM {region}
UNION ALL SELECT concat('com/n/N', CAST(n_nationkey AS VARCHAR(20))), CAST(NULL AS VARCHAR(60)), concat('com/r/R', CAST(n_regionkey AS VARCHAR(20))), 1025 FROM {nation}
UNION ALL SELECT concat('com/s/S', CAST(s_suppkey AS VARCHAR(20))), concat('com/n/N', CAST(s_nationkey AS VARCHAR(20))), CAST(NULL AS VARCHAR(60)), 1 FROM {supplier}
"""
DECLARED = """
SELECT concat('com/r/R', CAST(r_regionkey AS VARCHAR(20))) AS owner, t AS name, '()V' AS descriptor, 1025 AS access FROM {region} CROSS JOIN (SELECT DISTINCT lower(p_type) AS t FROM {part}) x
UNION ALL SELECT concat('com/n/N', CAST(n_nationkey AS VARCHAR(20))), t, '()V', 1 FROM {nation} CROSS JOIN (SELECT DISTINCT lower(p_type) AS t FROM {part}) x WHERE (n_nationkey + length(t)) % 3 = 0
UNION ALL SELECT concat('com/s/S', CAST(s_suppkey AS VARCHAR(20))), t, '()V', 1 FROM {supplier} CROSS JOIN (SELECT DISTINCT lower(p_type) AS t FROM {part}) x WHERE (s_suppkey + length(t)) % 2 = 0
"""
CALLS = """
SELECT DISTINCT concat('com/s/S', CAST(l_suppkey AS VARCHAR(20))) AS owner, lower(p_type) AS name, '()V' AS descriptor FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
UNION ALL SELECT concat('com/r/R', CAST(r_regionkey AS VARCHAR(20))), t, '()V' FROM {region} CROSS JOIN (SELECT DISTINCT lower(p_type) AS t FROM {part}) x
UNION ALL SELECT concat('com/unknown/U', CAST(n_nationkey AS VARCHAR(20))), 'bar', '()V' FROM {nation}
UNION ALL SELECT concat('java/util/J', CAST(n_nationkey AS VARCHAR(20))), 'put', '()V' FROM {nation}
"""
DECLARED_DEPS = """
SELECT project, ga, max(version) AS version, max(scope) AS scope FROM (
  SELECT l_suppkey AS project, l_partkey % 200 AS ga, CASE WHEN l_discount < 0.03 THEN NULL ELSE concat('1.', CAST(l_linenumber AS VARCHAR(20))) END AS version,
    CASE WHEN l_linenumber = 4 THEN 'test' ELSE 'compile' END AS scope,
    row_number() OVER (PARTITION BY l_suppkey, l_partkey % 200 ORDER BY l_orderkey, l_linenumber, l_partkey) AS rn FROM {lineitem}) t
WHERE rn = 1 GROUP BY project, ga
"""
POMS = """
SELECT concat('s', CAST(s_suppkey AS VARCHAR(20))) AS pom, concat('n', CAST(s_nationkey AS VARCHAR(20))) AS parent, s_suppkey AS num FROM {supplier}
UNION ALL SELECT concat('n', CAST(n_nationkey AS VARCHAR(20))), concat('r', CAST(n_regionkey AS VARCHAR(20))), n_nationkey FROM {nation}
UNION ALL SELECT concat('r', CAST(r_regionkey AS VARCHAR(20))), CAST(NULL AS VARCHAR(20)), r_regionkey FROM {region}
"""


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A view over the tables in sf_dir."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def plain(sql: str) -> str:
    """The view for DuckDB, where the tables are registered by name."""
    return "(" + sql.format(**{t: t for t in TABLES}).strip() + ")"
