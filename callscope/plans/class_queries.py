"""Queries of the class, resolution, detection and profile operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from callscope.functions import sig
from callscope.operators import detect, graph, resolve
from callscope.plans import testviews as tv
from callscope.plans.registry import query
from callscope.plans.signature_queries import M, methods

H_SQL = f"cls AS {tv.plain(tv.CLASSES)}, dec AS {tv.plain(tv.DECLARED)}, calls AS {tv.plain(tv.CALLS)}, sup AS (SELECT concat('com/s/S', s_suppkey) AS s, concat('com/n/N', s_nationkey) AS n, concat('com/r/R', n_regionkey) AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
DISP_SQL = "disp AS (SELECT r, name, owner AS target FROM dec JOIN sup ON owner = s)"
RES_SQL = f"""WITH {H_SQL}, {DISP_SQL}, own AS (SELECT DISTINCT owner, c.name FROM calls c JOIN dec d USING (owner, name) WHERE owner LIKE 'com/s/%'),
  inh AS (SELECT DISTINCT c.owner, c.name, n AS target FROM calls c JOIN sup ON c.owner = s JOIN dec d ON d.owner = n AND d.name = c.name WHERE (c.owner, c.name) NOT IN (FROM own)),
  res AS (SELECT owner, name, 'SINGLE' AS kind, owner AS target FROM own UNION ALL SELECT owner, name, 'SINGLE', target FROM inh
    UNION ALL SELECT c.owner, c.name, 'MULTI', target FROM calls c JOIN sup ON c.owner = s JOIN disp ON disp.r = sup.r AND disp.name = c.name WHERE (c.owner, c.name) NOT IN (FROM own) AND (c.owner, c.name) NOT IN (SELECT owner, name FROM inh)
    UNION ALL SELECT c.owner, c.name, 'MULTI', target FROM calls c JOIN disp ON c.owner = disp.r AND disp.name = c.name
    UNION ALL SELECT c.owner, c.name, 'EXTERNAL', c.owner FROM calls c WHERE (c.owner LIKE 'com/unknown/%') OR (c.owner LIKE 'com/r/%' AND (c.owner, c.name) NOT IN (SELECT r, name FROM disp))
    UNION ALL SELECT c.owner, c.name, 'EXTERNAL', c.owner FROM calls c JOIN sup ON c.owner = s WHERE (c.owner, c.name) NOT IN (FROM own) AND (c.owner, c.name) NOT IN (SELECT owner, name FROM inh) AND (sup.r, c.name) NOT IN (SELECT r, name FROM disp))"""


def hierarchy(spark, sf_dir):
    classes = tv.view(spark, sf_dir, tv.CLASSES)
    faces = F.when(F.col("iface").isNull(), F.array().cast("array<string>")).otherwise(F.array("iface"))
    return classes.withColumn("interfaces", faces).drop("iface"), tv.view(spark, sf_dir, tv.DECLARED)


def resolved(spark, sf_dir):
    return resolve.resolve_calls(tv.view(spark, sf_dir, tv.CALLS), *hierarchy(spark, sf_dir))


@query("resolve_calls", f"{RES_SQL} SELECT owner, name, kind, target FROM res")
def resolve_calls(spark, sf_dir):
    return resolved(spark, sf_dir).select("owner", "name", "kind", "target")


@query("dispatch_targets", f"WITH {H_SQL}, {DISP_SQL} SELECT r AS owner, name, target FROM disp")
def dispatch_targets(spark, sf_dir):
    classes, declared = hierarchy(spark, sf_dir)
    wanted = declared.filter("owner LIKE 'com/r/%'")
    return resolve.dispatch_targets(wanted, classes, declared, resolve.subtype_closure(classes)).select("owner", "name", "target")


@query(
    "subtype_closure",
    f"""WITH {H_SQL} SELECT class_name, class_name AS ancestor FROM cls UNION SELECT s, n FROM sup UNION SELECT s, r FROM sup UNION SELECT n, r FROM sup
    UNION SELECT class_name, iface FROM cls WHERE iface IS NOT NULL""",
)
def subtype_closure(spark, sf_dir):
    return resolve.subtype_closure(hierarchy(spark, sf_dir)[0])


@query(
    "build_edges",
    f"""{RES_SQL}, e AS (SELECT 'com/main/M.run' AS from_id, concat(CASE kind WHEN 'MULTI' THEN owner ELSE target END, '.', name) AS to_id, 'VIRTUAL' AS invoke, 7 AS line, 1 AS k FROM res
      UNION ALL SELECT concat(owner, '.', name), concat(target, '.', name), 'IMPL', 7, 2 FROM res WHERE kind = 'MULTI')
    SELECT from_id, to_id, min(invoke) AS invoke, min(line)::INTEGER AS line FROM e GROUP BY from_id, to_id""",
)
def build_edges(spark, sf_dir):
    one, ways, targets = resolve.resolve_ways(tv.view(spark, sf_dir, tv.CALLS), *hierarchy(spark, sf_dir))
    calls = one.select(*resolve.KEY).unionByName(ways.select(*resolve.KEY)).select(F.lit("com/main/M.run").alias("caller"), "*", F.lit("VIRTUAL").alias("invoke"), F.lit(7).alias("line"), F.lit(1).alias("seq"))
    return graph.build_edges_of(calls, one, ways, targets, lambda owner, name, descriptor: F.concat_ws(".", owner, name))


@query(
    "project_counts",
    f"""WITH {H_SQL}, k AS (SELECT class_name, CASE WHEN class_name LIKE 'com/s/%' THEN 'PROJECT' ELSE 'DEPENDENCY' END AS source, regexp_extract(class_name, '^com/([a-z])', 1) AS location FROM cls)
    SELECT source, count(*)::BIGINT AS n_classes, count(DISTINCT location)::BIGINT AS n_locations FROM k GROUP BY source""",
)
def project_counts(spark, sf_dir):
    source = F.when(F.col("class_name").startswith("com/s/"), "PROJECT").otherwise("DEPENDENCY")
    rows = hierarchy(spark, sf_dir)[0].select("class_name", source.alias("source"), F.regexp_extract("class_name", "^com/([a-z])", 1).alias("location"))
    return resolve.project_counts(rows)


@query("detect_jobs", f"WITH {H_SQL} SELECT concat('com.s.S', s_suppkey) AS class_name, 'execute' AS method_name, concat('job: com.s.S', s_suppkey, '#execute') AS display FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1 AND s_suppkey % 2 = 0")
def detect_jobs(spark, sf_dir):
    classes, _ = hierarchy(spark, sf_dir)
    job = F.transform("interfaces", lambda i: F.when(i == "com/r/R1", detect.JOBS[0]).otherwise(i))
    classes = classes.withColumn("interfaces", job).withColumn("source", F.lit("PROJECT")).withColumn("annotations", F.array())
    even = classes.filter("class_name LIKE 'com/s/%' AND CAST(substr(class_name, 8) AS INT) % 2 = 0")
    members = even.select(F.col("class_name").alias("owner"), F.lit("execute").alias("name"), F.lit("()V").alias("descriptor"), F.lit(1).alias("access"), F.array().alias("annotations"))
    return detect.detect_jobs(classes, members).select("class_name", "method_name", "display")


@query("dedup_classes", f"{M} SELECT owner AS class_name, arg_min(method_id, (CASE source WHEN 'PROJECT' THEN 0 WHEN 'DEPENDENCY' THEN 1 ELSE 2 END, method_id)) AS classpath_ord FROM m GROUP BY owner")
def dedup_classes(spark, sf_dir):
    rows = methods(spark, sf_dir).select(F.col("owner").alias("class_name"), "source", F.col("method_id").alias("classpath_ord"))
    return resolve.dedup_classes(rows).select("class_name", "classpath_ord")


@query(
    "resolve_class",
    f"""{M}, c AS (SELECT DISTINCT replace(owner, '/', '.') AS class_name FROM m), q AS (SELECT class_name AS query FROM c UNION SELECT split_part(class_name, '.', -1) FROM c UNION SELECT concat(class_name, 'X') FROM c),
    s AS (SELECT split_part(class_name, '.', -1) AS query, string_agg(class_name, ',' ORDER BY class_name) AS names, count(*) AS n FROM c GROUP BY 1)
    SELECT q.query, CASE WHEN c.class_name IS NOT NULL THEN 'exact' WHEN n = 1 THEN 'simple' WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS outcome, coalesce(c.class_name, names) AS class_name
    FROM q LEFT JOIN c ON q.query = c.class_name LEFT JOIN s ON q.query = s.query""",
)
def resolve_class(spark, sf_dir):
    classes = methods(spark, sf_dir).select(sig.class_name(F.col("owner")).alias("class_name")).distinct()
    asked = classes.select(F.col("class_name").alias("query")).union(classes.select(F.regexp_extract("class_name", r"([^.]*)$", 1))).union(classes.select(F.concat("class_name", F.lit("X"))))
    return resolve.resolve_class_names(asked, classes)


ASKED = """SELECT method_id AS entry_id, CASE WHEN method_id % 17 = 0 THEN 'no.such.C' WHEN method_id % 19 = 0 THEN replace(owner, 'com/acme/economy/', '') ELSE replace(owner, '/', '.') END AS class_name,
  CASE WHEN method_id % 5 > 0 THEN CASE WHEN method_id % 13 = 0 THEN 'nope' ELSE name END END AS method_name, CASE WHEN method_id % 5 > 2 THEN CASE WHEN method_id % 7 = 0 THEN '(Z)V' ELSE descriptor END END AS descriptor FROM {m}"""


def asked(spark, sf_dir):
    m = methods(spark, sf_dir)
    return spark.sql(ASKED, m=m), m.select("method_id", sig.class_name(F.col("owner")).alias("class_name"), "name", "descriptor", "access")


@query(
    "entry_roots",
    f"""{M}, a AS ({ASKED.format(m='m')}), j AS (SELECT entry_id, method_id, a.method_name IS NOT NULL AND a.descriptor IS NOT NULL AND a.descriptor = m.descriptor AS exact FROM a JOIN m ON a.class_name = replace(owner, '/', '.')
      AND ((a.method_name IS NULL AND access & 4160 = 0) OR a.method_name = name)) SELECT entry_id, method_id FROM j QUALIFY exact OR NOT bool_or(exact) OVER (PARTITION BY entry_id)""",
)
def entry_roots(spark, sf_dir):
    return resolve.resolve_entry_roots(*asked(spark, sf_dir))


@query(
    "verify_entries",
    f"""{M}, a AS ({ASKED.format(m='m')}), c AS (SELECT DISTINCT replace(owner, '/', '.') AS class_name FROM m), s AS (SELECT split_part(class_name, '.', -1) AS simple, string_agg(class_name, ',' ORDER BY class_name) AS names, count(*) AS n FROM c GROUP BY 1),
    r AS (SELECT entry_id, method_name, descriptor, CASE WHEN c.class_name IS NOT NULL THEN c.class_name WHEN s.n = 1 THEN s.names END AS class_name, CASE WHEN c.class_name IS NULL AND s.n > 1 THEN s.names END AS candidates FROM a LEFT JOIN c ON a.class_name = c.class_name LEFT JOIN s ON a.class_name = s.simple),
    o AS (SELECT replace(owner, '/', '.') AS class_name, name, string_agg(DISTINCT descriptor, ',' ORDER BY descriptor) AS overloads, count(DISTINCT descriptor) AS n, list(DISTINCT descriptor) AS all_of FROM m GROUP BY 1, 2),
    l AS (SELECT replace(owner, '/', '.') AS class_name, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM m GROUP BY 1),
    v AS (SELECT entry_id, r.class_name, candidates, coalesce(o.n, 0)::BIGINT AS n_overloads, o.overloads, l.names, CASE WHEN candidates IS NOT NULL THEN 'CLASS_AMBIGUOUS' WHEN r.class_name IS NULL THEN 'CLASS_MISSING' WHEN method_name IS NULL THEN 'OK'
      WHEN descriptor IS NOT NULL THEN CASE WHEN list_contains(all_of, descriptor) THEN 'EXACT' ELSE 'MISMATCH' END WHEN coalesce(o.n, 0) = 0 THEN 'METHOD_MISSING' WHEN o.n = 1 THEN 'UNIQUE' ELSE 'OVERLOADS' END AS status
      FROM r LEFT JOIN o ON o.class_name = r.class_name AND o.name = r.method_name LEFT JOIN l ON l.class_name = r.class_name)
    SELECT entry_id, status, class_name, candidates, CASE WHEN status = 'METHOD_MISSING' THEN names END AS available, CASE WHEN status IN ('UNIQUE', 'OVERLOADS') THEN overloads END AS overloads, n_overloads FROM v""",
)
def verify_entries(spark, sf_dir):
    return resolve.verify_entries(*asked(spark, sf_dir))


def annotated(spark, sf_dir):
    """Classes and methods of the method view, with mapping annotations made of their keys."""
    m = methods(spark, sf_dir)
    kind = "array<struct<name:string,values:map<string,array<string>>>>"
    rest, mapping = detect.CONTROLLERS[0], detect.SPRING
    classes = m.groupBy("owner").agg(F.min("method_id").alias("k"))
    marks = F.expr(f"CASE WHEN k % 3 = 0 THEN array(struct('{rest}' AS name, map() AS values), struct('{mapping}RequestMapping' AS name, map('value', array(concat('/api/', k, '/'))) AS values)) ELSE array() END").cast(kind)
    classes = classes.select(F.col("owner").alias("class_name"), F.lit(None).cast("string").alias("super_name"), F.array().cast("array<string>").alias("interfaces"), F.lit(1).alias("access"), F.lit("PROJECT").alias("source"), marks.alias("annotations"))
    own = F.expr(f"CASE method_id % 4 WHEN 0 THEN array(struct('{mapping}GetMapping' AS name, map('value', array(name)) AS values)) WHEN 1 THEN array(struct('{mapping}RequestMapping' AS name, map('path', array('p'), 'method', array('DELETE')) AS values)) WHEN 2 THEN array(struct('{mapping}RequestMapping' AS name, map() AS values)) ELSE array() END").cast(kind)
    return classes, m.withColumn("annotations", own)


REST_SQL = f"""{M}, c AS (SELECT owner, min(method_id) AS k FROM m GROUP BY owner), rest AS (SELECT m.*, concat(CASE method_id % 4 WHEN 0 THEN 'GET ' WHEN 1 THEN 'DELETE ' ELSE 'ANY ' END, '/api/', k, CASE method_id % 4 WHEN 0 THEN concat('/', name) WHEN 1 THEN '/p' ELSE '' END) AS display
    FROM m JOIN c USING (owner) WHERE k % 3 = 0 AND method_id % 4 < 3 AND name NOT LIKE '<%' AND access & 4160 = 0)"""


@query("detect_rest", f"{REST_SQL} SELECT method_id, display FROM rest".replace("SELECT method_id, display", "SELECT replace(owner, '/', '.') AS class_name, name AS method_name, descriptor, display"))
def detect_rest(spark, sf_dir):
    return detect.detect_rest(*annotated(spark, sf_dir)).select("class_name", "method_name", "descriptor", "display")


def services(spark, sf_dir):
    """The classes of annotated(), marked as services in three ways."""
    classes, m = annotated(spark, sf_dir)
    marks = [f"struct('{name}' AS name, {values} AS values)" for name, values in zip(detect.SERVICES, ("map('interfaceClass', array(concat('Lorg/api/A', k, ';')))", "map('interfaceName', array(concat('org.api.B', k)))", "map('interfaceClass', array('Ljava/lang/Void;'))"), strict=True)]
    keys = m.groupBy(F.col("owner").alias("class_name")).agg(F.min("method_id").alias("k"))
    found = F.expr(f"CASE k % 4 WHEN 0 THEN array({marks[0]}) WHEN 1 THEN array({marks[1]}) WHEN 2 THEN array({marks[2]}) ELSE array() END").cast("array<struct<name:string,values:map<string,array<string>>>>")
    return classes.join(keys, "class_name").withColumn("annotations", found).drop("k"), m


@query(
    "detect_dubbo",
    f"""{M}, c AS (SELECT owner, min(method_id) AS k FROM m GROUP BY owner) SELECT replace(owner, '/', '.') AS class_name, name AS method_name, descriptor,
    concat('dubbo: ', CASE k % 4 WHEN 0 THEN concat('org.api.A', k) WHEN 1 THEN concat('org.api.B', k) ELSE replace(owner, '/', '.') END, '#', name) AS display
    FROM m JOIN c USING (owner) WHERE k % 4 < 3 AND name NOT LIKE '<%' AND access & 1 = 1 AND access & 8 = 0 AND access & 4160 = 0""",
)
def detect_dubbo(spark, sf_dir):
    return detect.detect_dubbo(*services(spark, sf_dir)).select("class_name", "method_name", "descriptor", "display")


STARTS = "SELECT owner, CASE WHEN method_id % 3 = 0 THEN 'main' ELSE name END AS name, CASE WHEN method_id % 2 = 0 THEN '([Ljava/lang/String;)V' ELSE descriptor END AS descriptor, access FROM {m}"


@query("detect_main", f"{M}, s AS ({STARTS.format(m='m')}) SELECT replace(owner, '/', '.') AS class_name, concat('main: ', replace(owner, '/', '.')) AS display FROM s WHERE name = 'main' AND descriptor = '([Ljava/lang/String;)V' AND access & 9 = 9")
def detect_main(spark, sf_dir):
    return detect.detect_main(annotated(spark, sf_dir)[0], spark.sql(STARTS, m=methods(spark, sf_dir))).select("class_name", "display")


RULES = (
    detect.ScanRule("api", "ANNOTATION_METHOD", detect.SPRING.replace("/", ".") + "GetMapping"),
    detect.ScanRule("promo", "PACKAGE", "com.acme.promo", recursive=False),
    detect.ScanRule("brand", "CLASS_NAME", "Brand1*"),
    detect.ScanRule("getters", "METHOD_NAME", "get*", excludes=("**.Brand2*",)),
    detect.ScanRule("off", "PACKAGE", "com", enabled=False),
)
RULES_SQL = f"""{M}, r AS (SELECT m.*, CASE WHEN method_id % 4 = 0 THEN 'api' WHEN owner LIKE 'com/acme/promo/%' THEN 'promo' WHEN split_part(owner, '/', -1) LIKE 'Brand1%' THEN 'brand' WHEN name LIKE 'get%' THEN 'getters' END AS rule
    FROM m WHERE name NOT LIKE '<%' AND access & 1 = 1 AND access & 4160 = 0 AND access & 1280 = 0 AND split_part(owner, '/', -1) NOT LIKE 'Brand2%')"""


@query("scan_rules", f"{RULES_SQL} SELECT DISTINCT replace(owner, '/', '.') AS class_name, name AS method_name, descriptor FROM r WHERE rule IS NOT NULL")
def scan_rules(spark, sf_dir):
    return detect.scan_rules(*annotated(spark, sf_dir), RULES).select("class_name", "method_name", "descriptor")


@query("scan_excludes", f"{RULES_SQL} SELECT split_part(owner, '/', 3) AS package, count(DISTINCT (owner, name, descriptor))::BIGINT AS n FROM r WHERE rule IS NOT NULL GROUP BY 1")
def scan_excludes(spark, sf_dir):
    found = detect.scan_rules(*annotated(spark, sf_dir), RULES)
    return found.groupBy(F.split_part("class_name", F.lit("."), F.lit(3)).alias("package")).agg(F.count(F.lit(1)).alias("n"))


@query("scan_groups", f"{REST_SQL}, {RULES_SQL.removeprefix(M).lstrip(', ')} SELECT 'REST' AS type, 1 AS place, count(*)::BIGINT AS n FROM rest UNION ALL SELECT 'RULE', 5, count(DISTINCT (owner, name, descriptor)) FROM r WHERE rule IS NOT NULL")
def scan_groups(spark, sf_dir):
    return detect.scan_groups(detect.scan_entries(*annotated(spark, sf_dir), {"ELASTIC_JOB": False}, RULES))


PROFILES = """SELECT CAST(NULL AS BIGINT) AS project, id, builtin, ord, detector_main FROM (VALUES ('standard', true, 0, true), ('strict', true, 1, false), ('team', false, 2, CAST(NULL AS BOOLEAN))) g(id, builtin, ord, detector_main)
  UNION ALL SELECT s_suppkey, concat('own', CAST(s_suppkey % 2 AS VARCHAR(9))), false, 3, s_suppkey % 2 = 0 FROM {supplier} WHERE s_suppkey % 3 = 0"""
ACTIVE = "SELECT s_suppkey AS project, CASE s_suppkey % 4 WHEN 0 THEN CAST(NULL AS VARCHAR(9)) WHEN 1 THEN 'gone' WHEN 2 THEN 'strict' ELSE 'own1' END AS active_id, s_suppkey % 3 = 0 AS has_custom FROM {supplier}"


@query(
    "effective_profiles",
    f"""WITH p AS {tv.plain(ACTIVE)} SELECT project, CASE WHEN active_id = 'strict' THEN 'strict' WHEN active_id = 'own1' AND has_custom AND project % 2 = 1 THEN 'own1' ELSE 'standard' END AS profile_id,
    CASE WHEN active_id = 'strict' THEN false WHEN active_id = 'own1' AND has_custom AND project % 2 = 1 THEN false ELSE true END AS detector_main FROM p""",
)
def effective_profiles(spark, sf_dir):
    return detect.effective_profiles(tv.view(spark, sf_dir, ACTIVE), tv.view(spark, sf_dir, PROFILES))
