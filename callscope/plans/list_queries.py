"""Queries of the entry-list, project and log operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from callscope.functions import sig
from callscope.operators import entries as en
from callscope.operators import search
from callscope.operators.freq import numbered
from callscope.plans import testviews as tv
from callscope.plans.graph_queries import M_SQL
from callscope.plans.registry import query
from callscope.plans.signature_queries import DISPLAY_SQL, methods

L_SQL = f"WITH o AS {tv.plain(tv.ENTRIES)}, saved AS (SELECT key, CASE status WHEN 'F' THEN 'confirmed' ELSE 'excluded' END AS status, CASE status WHEN 'P' THEN 'old' END AS exclude_reason FROM o WHERE status IN ('F', 'P')), scan AS (SELECT key FROM o WHERE priority IN ('1-URGENT', '2-HIGH'))"


def orders(spark, sf_dir):
    return tv.view(spark, sf_dir, tv.ENTRIES)


def saved(spark, sf_dir):
    rows = orders(spark, sf_dir).filter("status IN ('F', 'P')")
    return rows.select("key", F.when(F.col("status") == "F", "confirmed").otherwise("excluded").alias("status"), F.when(F.col("status") == "P", "old").alias("exclude_reason"))


def scan(spark, sf_dir):
    return orders(spark, sf_dir).filter("priority IN ('1-URGENT', '2-HIGH')").select("key")


@query("diff_entries", f"{L_SQL} SELECT key, key IN (SELECT key FROM saved) AS known FROM scan")
def diff_entries(spark, sf_dir):
    return en.diff_entries(scan(spark, sf_dir), saved(spark, sf_dir))


@query("merge_entries", f"{L_SQL} SELECT coalesce(s.key, c.key) AS key, coalesce(status, 'confirmed') AS status, CASE WHEN status IS NULL THEN 'added' WHEN c.key IS NOT NULL AND status = 'confirmed' THEN 'existed' ELSE 'kept' END AS outcome FROM saved s FULL JOIN scan c ON s.key = c.key")
def merge_entries(spark, sf_dir):
    return en.merge_entries(scan(spark, sf_dir), saved(spark, sf_dir))


@query("add_entries", f"{L_SQL} SELECT c.key, CASE status WHEN 'confirmed' THEN 'existed' WHEN 'excluded' THEN 'moved' ELSE 'added' END AS outcome FROM scan c LEFT JOIN saved s ON s.key = c.key")
def add_entries(spark, sf_dir):
    return en.add_entries(scan(spark, sf_dir), saved(spark, sf_dir))


@query("exclude_entries", f"{L_SQL} SELECT key, CASE WHEN key IN (SELECT key FROM scan) THEN 'excluded' ELSE status END AS status, CASE WHEN status = 'confirmed' AND key IN (SELECT key FROM scan) THEN '用户排除' ELSE exclude_reason END AS exclude_reason FROM saved")
def exclude_entries(spark, sf_dir):
    return en.exclude_entries(saved(spark, sf_dir), scan(spark, sf_dir)).select("key", "status", "exclude_reason")


@query("restore_entries", f"{L_SQL} SELECT key, CASE WHEN key IN (SELECT key FROM scan) THEN 'confirmed' ELSE status END AS status, CASE WHEN NOT (status = 'excluded' AND key IN (SELECT key FROM scan)) THEN exclude_reason END AS exclude_reason FROM saved")
def restore_entries(spark, sf_dir):
    return en.restore_entries(saved(spark, sf_dir), scan(spark, sf_dir)).select("key", "status", "exclude_reason")


@query("delete_entries", f"{L_SQL} SELECT key, status FROM saved WHERE key NOT IN (SELECT key FROM scan)")
def delete_entries(spark, sf_dir):
    return en.delete_entries(saved(spark, sf_dir), scan(spark, sf_dir)).select("key", "status")


@query("extract_by_class", f"WITH {M_SQL} SELECT method_id, replace(owner, '/', '.') AS class_name, 'MANUAL' AS source FROM m WHERE contains(owner, 'brand1') OR contains(owner, 'Brand1')")
def extract_by_class(spark, sf_dir):
    rows = methods(spark, sf_dir).select("method_id", sig.class_name(F.col("owner")).alias("class_name"), F.lit("AUTO_SCAN").alias("source"))
    return en.extract_by_class(rows, "Brand1")


@query("filter_entries", f"WITH {M_SQL} SELECT method_id FROM m WHERE contains(lower(concat({DISPLAY_SQL}, chr(10), replace(owner, '/', '.'), chr(10), name)), 'getn')")
def filter_entries(spark, sf_dir):
    rows = methods(spark, sf_dir).select("method_id", sig.display(F.col("owner"), F.col("name"), F.col("descriptor")).alias("display"), sig.class_name(F.col("owner")).alias("class_name"), F.col("name").alias("method_name"))
    return en.filter_entries(rows, "getN").select("method_id")


@query("failed_entries", "SELECT p_partkey AS entry_id, concat('error ', p_partkey % 7) AS error FROM part WHERE p_partkey % 5 = 0")
def failed_entries(spark, sf_dir):
    stats = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("entry_id"), (F.col("p_partkey") % 5 == 0).alias("failed"), F.concat(F.lit("error "), (F.col("p_partkey") % 7).cast("string")).alias("error"))
    return en.failed_entries(stats).select("entry_id", "error")


@query("prune_stale", f"{L_SQL} SELECT key AS name FROM o WHERE status = 'F' AND key NOT IN (SELECT key FROM scan)")
def prune_stale(spark, sf_dir):
    return en.prune_stale(orders(spark, sf_dir).filter("status = 'F'").select(F.col("key").alias("name")), scan(spark, sf_dir).withColumnRenamed("key", "name"))


@query("upsert_profiles", f"{L_SQL}, a AS (SELECT key AS id, 'stored' AS name FROM o WHERE status = 'F'), b AS (SELECT key AS id, 'new' AS name FROM scan) SELECT coalesce(a.id, b.id) AS id, coalesce(b.name, a.name) AS name, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'kept' ELSE 'replaced' END AS outcome FROM a FULL JOIN b ON a.id = b.id")
def upsert_profiles(spark, sf_dir):
    stored = orders(spark, sf_dir).filter("status = 'F'").select(F.col("key").alias("id"), F.lit("stored").alias("name"))
    return en.upsert_profiles(stored, scan(spark, sf_dir).select(F.col("key").alias("id"), F.lit("new").alias("name")))


@query("stale_entries", f"{L_SQL}, c AS (SELECT key, md5(concat(key, status)) AS fingerprint FROM o), r AS (SELECT key, md5(concat(key, 'F')) AS fingerprint FROM scan) SELECT c.* FROM c LEFT JOIN r USING (key) WHERE c.fingerprint IS DISTINCT FROM r.fingerprint")
def stale_entries(spark, sf_dir):
    current = orders(spark, sf_dir).select("key", F.md5(F.concat("key", "status")).alias("fingerprint"))
    return en.stale_entries(scan(spark, sf_dir).select("key", F.md5(F.concat("key", F.lit("F"))).alias("fingerprint")), current)


@query("entry_fingerprint", "SELECT o_custkey AS project, md5(string_agg(DISTINCT o_orderkey::VARCHAR, '|' ORDER BY o_orderkey::VARCHAR)) AS fingerprint FROM orders GROUP BY o_custkey")
def entry_fingerprint(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("project"), F.col("o_orderkey").cast("string").alias("key"))
    return en.entry_set_fingerprint(rows, ["project"])


FILES = "SELECT o_custkey AS project, o_orderpriority AS dir, concat('C', CAST(o_orderkey AS VARCHAR(20)), '.class') AS path, CAST(o_orderkey * 1000 AS BIGINT) AS mtime, CAST(o_orderkey % 977 AS BIGINT) AS size FROM {orders}"


#: Commits, build files and rules of the projects of FILES; some have none.
COMMITS = "SELECT c_custkey AS project, CASE WHEN c_custkey % 5 > 0 THEN md5(c_name) END AS commit FROM {customer}"
BUILDS = "SELECT o_custkey AS project, concat('m', CAST(o_orderkey % 7 AS VARCHAR(9)), '/pom.xml') AS path, md5(CAST(min(o_orderkey) AS VARCHAR(20))) AS hash FROM {orders} WHERE o_orderkey % 2 = 0 GROUP BY o_custkey, o_orderkey % 7"
IN_FORCE = """SELECT o_custkey AS project, CASE WHEN o_orderkey % 3 = 0 THEN 'P' ELSE 'G' END AS layer, concat('r', CAST(o_orderkey AS VARCHAR(20))) AS id, 'get' AS method_pattern, '' AS class_pattern, 'ALL' AS source,
  CASE WHEN o_orderkey % 2 = 0 THEN 1 END AS param_count, o_orderkey % 5 > 0 AS enabled FROM {orders} WHERE o_orderstatus = 'F'"""
PARTS_SQL = f"""f AS {tv.plain(FILES)}, d AS (SELECT project, dir, sha1(string_agg(concat(path, ':', mtime, ':', size), ',' ORDER BY concat(path, ':', mtime, ':', size))) AS h FROM f GROUP BY project, dir),
  k AS (SELECT project, string_agg(concat(dir, '=', h), '|' ORDER BY concat(dir, '=', h)) AS classes FROM d GROUP BY project), g AS {tv.plain(COMMITS)}, b0 AS {tv.plain(BUILDS)},
  b AS (SELECT project, string_agg(concat(path, '=', hash), ';' ORDER BY concat(path, '=', hash)) AS build FROM b0 GROUP BY project), r0 AS {tv.plain(IN_FORCE)},
  r1 AS (SELECT project, concat('{{"layer":"', layer, '","id":"', id, '","method_pattern":"get","class_pattern":"","source":"ALL","param_count":', CASE WHEN param_count IS NULL THEN 'null' ELSE concat('"', param_count, '"') END, ',"enabled":"', enabled, '"}}') AS body FROM r0),
  r AS (SELECT project, sha1(string_agg(body, ',' ORDER BY body)) AS rules FROM r1 GROUP BY project),
  p AS (SELECT project, sha1(concat('v2|git=', coalesce(g.commit, '-'), '|build=', coalesce(build, '-'), '|classes=', coalesce(classes, '-'), '|rules=', coalesce(rules, '-'))) AS fingerprint FROM g LEFT JOIN k USING (project) LEFT JOIN b USING (project) LEFT JOIN r USING (project))"""


def fingerprints(spark, sf_dir):
    parts = [tv.view(spark, sf_dir, x) for x in (FILES, COMMITS, BUILDS, IN_FORCE)]
    return en.project_fingerprint(*parts)


@query("project_fingerprint", f"WITH {PARTS_SQL} SELECT * FROM p")
def project_fingerprint(spark, sf_dir):
    return fingerprints(spark, sf_dir)


@query("analysis_fingerprint", f"WITH {PARTS_SQL} SELECT project, o_orderkey::VARCHAR AS key, sha1(concat(fingerprint, '|', o_orderkey, '|20|50000|ALL')) AS fingerprint FROM orders JOIN p ON o_custkey = project")
def analysis_fingerprint(spark, sf_dir):
    keys = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("project"), F.col("o_orderkey").cast("string").alias("key"))
    return en.analysis_fingerprint(keys, fingerprints(spark, sf_dir), 20, 50_000, "ALL")


@query("project_status", f"WITH p AS {tv.plain(tv.PROJECTS)} SELECT project, CASE WHEN missing = 1 THEN 'MISSING' WHEN class_time IS NULL OR source_time > class_time + INTERVAL 5 MINUTE THEN 'NEEDS_COMPILE' WHEN analysed = 0 THEN 'NEEDS_ANALYZE' ELSE 'UP_TO_DATE' END AS state FROM p")
def project_status(spark, sf_dir):
    kind = F.when(F.col("o_orderstatus") == "F", "class").when(F.col("o_orderstatus") == "O", "source").otherwise("result")
    found = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("project"), kind.alias("kind"), F.col("o_orderdate").alias("mtime"))
    projects = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("project"), F.when(F.col("c_acctbal") < 0, 1).otherwise(0).alias("missing"))
    return en.project_status(projects.join(en.project_times(found), "project", "left"))


@query("latest_result", "SELECT o_custkey AS project, o_orderkey AS result FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_result(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("result"), "o_orderdate")
    return en.latest_by(rows, "project", F.desc("o_orderdate"), F.desc("result")).select("project", "result")


@query(
    "projects_sorted",
    """WITH b AS (SELECT c_custkey AS id, c_name AS name, TIMESTAMP '2020-01-01' AS last_opened_at, 0 AS v FROM customer
      UNION ALL SELECT * FROM (SELECT o_custkey, 'opened', max(o_orderdate)::TIMESTAMP, 1 FROM orders GROUP BY o_custkey)),
    u AS (SELECT id, name, last_opened_at FROM b QUALIFY row_number() OVER (PARTITION BY id ORDER BY v DESC, last_opened_at DESC) = 1)
    SELECT id, name, row_number() OVER (ORDER BY last_opened_at DESC, id)::INTEGER AS place FROM u""",
)
def projects_sorted(spark, sf_dir):
    stored = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.expr("TIMESTAMP '2020-01-01 00:00:00'").alias("last_opened_at"))
    opened = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderdate").cast("timestamp").alias("last_opened_at")).withColumn("name", F.lit("opened"))
    rows = en.upsert_projects(stored, opened, ["id", "name", "last_opened_at"])
    return numbered(rows, "place", F.desc("last_opened_at"), "id").select("id", "name", F.col("place").cast("int").alias("place"))


@query("tail_log", f"WITH l AS {tv.plain(tv.LOGS)} SELECT job, trim(line) AS line, event_id FROM l WHERE trim(line) <> '' QUALIFY row_number() OVER (PARTITION BY job ORDER BY ts DESC, event_id DESC) <= 60")
def tail_log(spark, sf_dir):
    return en.tail_log(tv.view(spark, sf_dir, tv.LOGS)).select("job", "line", "event_id")


@query(
    "unique_labels",
    f"""WITH {M_SQL}, b AS (SELECT method_id, substr(concat(split_part(owner, '/', -1), '#', name), 1, 31) AS base FROM m),
    k AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY method_id) AS k FROM b)
    SELECT method_id, CASE WHEN k = 1 THEN base ELSE concat(substr(base, 1, least(length(base), 31 - length(concat('(', k, ')')))), '(', k, ')') END AS label FROM k""",
)
def unique_labels(spark, sf_dir):
    rows = methods(spark, sf_dir).select("method_id", F.concat(sig.simple_name(F.col("owner")), F.lit("#"), F.col("name")).alias("base"), F.col("method_id").alias("ord"))
    return en.unique_labels(rows).select("method_id", "label")


C_SQL = f"{M_SQL}, c AS (SELECT replace(owner, '/', '.') AS class_name, min(source) AS source FROM m GROUP BY owner)"


def class_rows(spark, sf_dir):
    return methods(spark, sf_dir).groupBy(sig.class_name(F.col("owner")).alias("class_name")).agg(F.min("source").alias("source"))


@query(
    "search_classes",
    f"""WITH {C_SQL}, h AS (SELECT class_name, CASE WHEN split_part(class_name, '.', -1) LIKE 'Brand1%' OR class_name LIKE 'Brand1%' THEN 0 WHEN contains(lower(class_name), 'brand1') THEN 1 END AS r FROM c WHERE source = 'DEPENDENCY' OR source = 'PROJECT'),
    a AS (SELECT 'class' AS kind, class_name AS name FROM h WHERE r IS NOT NULL ORDER BY r, class_name LIMIT 20),
    p AS (SELECT DISTINCT regexp_extract(class_name, '^(.*)\\.[^.]*$', 1) AS name FROM h)
    SELECT * FROM a UNION ALL (SELECT 'package', name FROM p WHERE contains(lower(name), 'brand1') ORDER BY name LIMIT 10)""",
)
def search_classes(spark, sf_dir):
    rows = class_rows(spark, sf_dir).filter("source IN ('DEPENDENCY', 'PROJECT')").withColumn("source", F.lit("PROJECT"))
    return search.search_classes(rows, "Brand1")


@query(
    "methods_under",
    f"""WITH {M_SQL}, n AS (SELECT method_id, replace(owner, '/', '.') AS class_name, name, descriptor FROM m),
    f AS (SELECT n.* FROM n WHERE regexp_extract(class_name, '^(.*)\\.[^.]*$', 1) = 'com.acme.promo' AND name NOT IN ('<init>', '<clinit>') AND NOT contains(name, '$'))
    SELECT *, (SELECT count(*) FROM f) > 500 AS truncated FROM f ORDER BY class_name, name, descriptor, method_id LIMIT 500""",
)
def methods_under(spark, sf_dir):
    rows = methods(spark, sf_dir).select("method_id", sig.class_name(F.col("owner")).alias("class_name"), "name", "descriptor")
    return search.methods_under(rows, "com.acme.promo")
