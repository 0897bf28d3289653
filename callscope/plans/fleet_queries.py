"""Queries of rules and scan profiles of many projects; a project is an owner class of the method view, or its package."""

from __future__ import annotations

from pyspark.sql import functions as F

from callscope.functions import rules
from callscope.operators import detect, fleet
from callscope.plans import testviews as tv
from callscope.plans.class_queries import annotated
from callscope.plans.registry import query
from callscope.plans.signature_queries import PARAMS_SQL, M, methods, signed

#: Global rules, some with broken patterns; overrides; custom rules of each owner.
GLOBAL = """SELECT id, concat('n-', id) AS name, method_pattern, class_pattern, source, param_count, enabled FROM (VALUES ('g1', '<init>', '', 'ALL', CAST(NULL AS INT), true), ('g2', 'toString|getInstance', '', 'ALL', NULL, true),
  ('g3', '^(get|is)[A-Z]', '', 'PROJECT', 0, true), ('g4', '(bad', '', 'ALL', NULL, true), ('g5', '', '[.]Brand1[0-9]?$', 'DEPENDENCY', NULL, true), ('g6', 'info|set.+', '.*[.]promo[.].*', 'ALL', NULL, false), ('g7', 'x', '[bad', 'ALL', NULL, true)) g(id, method_pattern, class_pattern, source, param_count, enabled)"""
OVERRIDES = "SELECT DISTINCT owner AS project, concat('g', CAST(1 + method_id % 7 AS VARCHAR(9))) AS id, length(name) % 2 = 0 AS enabled FROM {m} WHERE method_id % 7 = 0 OR name = 'info'"
CUSTOM = """SELECT owner AS project, concat('c', CAST(method_id AS VARCHAR(20))) AS id, concat('own ', name) AS name, CASE method_id % 3 WHEN 0 THEN concat('^', name, '$') WHEN 1 THEN 'getN.me|<cl' ELSE '' END AS method_pattern,
  CASE WHEN method_id % 2 = 0 THEN concat('^', replace(owner, '/', '[.]'), '$') ELSE '' END AS class_pattern, source, CASE WHEN method_id % 4 = 0 THEN CAST(method_id % 3 AS INT) END AS param_count, method_id % 5 > 0 AS enabled FROM {m} WHERE method_id % 11 = 0"""
FLEET_SQL = f"""{M}, g AS ({GLOBAL}), o AS (SELECT project, id, min(enabled) AS enabled FROM ({OVERRIDES.format(m='m')}) GROUP BY project, id), c AS ({CUSTOM.format(m='m')}),
  e AS (SELECT p.project, 'G' AS layer, g.* EXCLUDE (enabled), coalesce(o.enabled, g.enabled) AS enabled FROM (SELECT project FROM o UNION SELECT project FROM c) p CROSS JOIN g LEFT JOIN o ON o.project = p.project AND o.id = g.id
    UNION ALL SELECT project, 'P', id, name, method_pattern, class_pattern, source, param_count, enabled FROM c),
  r AS (SELECT * FROM e WHERE enabled AND id NOT IN ('g4', 'g7')),
  h AS (SELECT m.method_id, string_agg(concat('[', layer, '] ', r.name), ', ' ORDER BY layer, id) AS rules FROM m JOIN r ON r.project = m.owner AND regexp_matches(m.name, method_pattern) AND regexp_matches(replace(owner, '/', '.'), class_pattern)
    AND (r.source = 'ALL' OR r.source = m.source) AND (param_count IS NULL OR param_count = len({PARAMS_SQL})) GROUP BY m.method_id)"""


@query("fleet_rules", f"{FLEET_SQL} SELECT method_id, rules IS NOT NULL AS noise, coalesce(rules, '') AS rules FROM m LEFT JOIN h USING (method_id)")
def fleet_rules(spark, sf_dir):
    """Every method of every project with the rules of its project that match it."""
    m = methods(spark, sf_dir)
    overrides = spark.sql(OVERRIDES, m=m).groupBy("project", "id").agg(F.min("enabled").alias("enabled"))
    table = rules.effective_rules(spark.sql(GLOBAL), overrides, spark.sql(CUSTOM, m=m))
    return fleet.apply_rules(signed(spark, sf_dir).withColumn("project", F.col("owner")), table).select("method_id", "noise", "rules")


#: Profiles: three global ones, and own ones of every third project. A project is a package of the class view.
PROFILES = """SELECT CAST(NULL AS VARCHAR(40)) AS project, id, builtin, ord, off FROM (VALUES ('standard', true, 0, ''), ('strict', true, 1, 'REST'), ('team', false, 2, '')) g(id, builtin, ord, off)
  UNION ALL SELECT project, 'own', false, 3, CASE WHEN n % 2 = 0 THEN 'REST' ELSE 'MAIN' END FROM {p} WHERE n % 3 = 0"""
ACTIVE = "SELECT project, CASE n % 4 WHEN 0 THEN CAST(NULL AS VARCHAR(9)) WHEN 1 THEN 'gone' WHEN 2 THEN 'team' ELSE CASE WHEN n % 3 = 0 THEN 'own' ELSE 'strict' END END AS active_id, n % 3 = 0 AS has_custom FROM {p}"
PACKAGES = "SELECT split_part(owner, '/', 3) AS project, min(method_id) AS n FROM {m} GROUP BY split_part(owner, '/', 3)"
FORCE_SQL = f"""{M}, p AS ({PACKAGES.format(m='m')}), a AS ({ACTIVE.format(p='p')}),
  f AS (SELECT project, CASE active_id WHEN 'team' THEN 'team' WHEN 'strict' THEN 'strict' WHEN 'own' THEN 'own' ELSE 'standard' END AS profile_id, n FROM a JOIN p USING (project))"""


def packages(spark, sf_dir):
    return spark.sql(PACKAGES, m=methods(spark, sf_dir))


def force(spark, sf_dir):
    p = packages(spark, sf_dir)
    profiles = spark.sql(PROFILES, p=p).withColumn("detectors", F.when(F.col("off") != "", F.create_map("off", F.lit(False))))
    return fleet.profiles_in_force(spark.sql(ACTIVE, p=p), profiles)


@query("fleet_profiles", f"{FORCE_SQL} SELECT project, profile_id, CASE profile_id WHEN 'strict' THEN 'REST' WHEN 'own' THEN CASE WHEN n % 2 = 0 THEN 'REST' ELSE 'MAIN' END END AS off FROM f")
def fleet_profiles(spark, sf_dir):
    return force(spark, sf_dir).select("project", "profile_id", F.get(F.map_keys("detectors"), F.lit(0)).alias("off"))


#: Scan rules of every kind, of global and own profiles; a wildcard that is no regex matches nothing.
SCAN = """SELECT CAST(NULL AS VARCHAR(40)) AS project, profile_id, ord, name, kind, value, recursive, exclude, enabled FROM (VALUES ('standard', 0, 'api', 'ANNOTATION_METHOD', 'org.springframework.web.bind.annotation.GetMapping', true, '', true),
  ('standard', 1, 'brand', 'CLASS_NAME', 'Brand1*', true, '**.Brand12', true), ('strict', 0, 'getters', 'METHOD_NAME', 'get*', true, '', true), ('strict', 1, 'off', 'PACKAGE', 'com', true, '**', false), ('team', 0, '', 'PACKAGE', 'com.acme', true, '**.Brand2*', true),
  ('team', 1, 'plain', 'CLASS_NAME', 'Brand31', true, '', true), ('team', 2, 'bad', 'CLASS_NAME', '?', true, '', true)) g(profile_id, ord, name, kind, value, recursive, exclude, enabled)
  UNION ALL SELECT project, 'own', 0, 'mine', 'PACKAGE', concat('com.acme.', project), false, '', true FROM {p} WHERE n % 6 = 0
  UNION ALL SELECT project, 'own', 1, 'rest', 'ANNOTATION_CLASS', 'org.springframework.web.bind.annotation.RestController', true, '**.B*4*', true FROM {p}
  UNION ALL SELECT project, 'own', 2, 'self', 'INTERFACE_IMPLEMENT', concat('com.acme.', project, '.Brand35'), true, '', true FROM {p}"""
SCAN_SQL = f"""{FORCE_SQL}, c AS (SELECT owner, min(method_id) AS k FROM m GROUP BY owner), x AS (SELECT m.*, c.k, f.profile_id, f.n, split_part(m.owner, '/', 3) AS project, split_part(m.owner, '/', -1) AS simple FROM m JOIN c USING (owner) JOIN f ON f.project = split_part(m.owner, '/', 3)),
  y AS (SELECT *, CASE profile_id WHEN 'standard' THEN CASE WHEN simple = 'Brand12' THEN NULL WHEN method_id % 4 = 0 THEN 'api' WHEN simple LIKE 'Brand1%' THEN 'brand' END
    WHEN 'strict' THEN CASE WHEN name LIKE 'get%' THEN 'getters' END
    WHEN 'team' THEN CASE WHEN simple NOT LIKE 'Brand2%' THEN 'PACKAGE' END
    ELSE CASE WHEN simple LIKE 'B%4%' THEN NULL WHEN n % 6 = 0 THEN 'mine' WHEN k % 3 = 0 THEN 'rest' WHEN simple = 'Brand35' THEN 'self' END END AS rule FROM x),
  z AS (SELECT project, 'RULE' AS type, replace(owner, '/', '.') AS class_name, name AS method_name, descriptor, concat('[', rule, '] ', name) AS display, 5 AS place FROM y WHERE rule IS NOT NULL AND name NOT LIKE '<%' AND access & 1 = 1 AND access & 4160 = 0 AND access & 1280 = 0
    UNION SELECT project, 'REST', replace(owner, '/', '.'), name, descriptor, concat(CASE method_id % 4 WHEN 0 THEN 'GET ' WHEN 1 THEN 'DELETE ' ELSE 'ANY ' END, '/api/', k, CASE method_id % 4 WHEN 0 THEN concat('/', name) WHEN 1 THEN '/p' ELSE '' END), 1
    FROM x WHERE k % 3 = 0 AND method_id % 4 < 3 AND name NOT LIKE '<%' AND access & 4160 = 0 AND NOT (profile_id = 'strict' OR profile_id = 'own' AND n % 2 = 0))"""


@query("fleet_scan", f"{SCAN_SQL} SELECT * FROM z")
def fleet_scan(spark, sf_dir):
    """The entries of all projects, each scanned with the whole profile in force there."""
    classes, m = annotated(spark, sf_dir)
    of = lambda column: F.split_part(column, F.lit("/"), F.lit(3))
    scan = spark.sql(SCAN, p=packages(spark, sf_dir)).withColumn("excludes", F.array("exclude"))
    found = fleet.scan_fleet(classes.withColumn("project", of(F.col("class_name"))), m.withColumn("project", of(F.col("owner"))), force(spark, sf_dir), scan)
    return found.select("project", *detect.ENTRY, "place").distinct()
