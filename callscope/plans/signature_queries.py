"""Queries of the signature functions, predicates and rules over the method view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.functions import rules, sig
from callscope.operators import resolve
from callscope.plans import testviews as tv
from callscope.plans.registry import query

M = f"WITH m AS {tv.plain(tv.METHODS)} "
PARAMS_SQL = r"regexp_extract_all(regexp_extract(descriptor, '^\(([^)]*)\)', 1), '\[*(?:L[^;]+;|[BCDFIJSZ])')"
TYPES_SQL = (
    f"list_transform({PARAMS_SQL}, lambda d: concat(CASE ltrim(d, '[') WHEN 'B' THEN 'byte' WHEN 'C' THEN 'char' WHEN 'D' THEN 'double' WHEN 'F' THEN 'float' WHEN 'I' THEN 'int'"
    " WHEN 'J' THEN 'long' WHEN 'S' THEN 'short' WHEN 'Z' THEN 'boolean' ELSE regexp_extract(rtrim(d, ';'), '([^/$]*)$', 1) END, repeat('[]', length(d) - length(ltrim(d, '[')))))"
)
ARGS_SQL = f"array_to_string({TYPES_SQL}, ', ')"
ID_SQL = f"concat(replace(owner, '/', '.'), '#', name, '(', {ARGS_SQL}, ')')"
DISPLAY_SQL = f"CASE name WHEN '<init>' THEN concat('new ', regexp_extract(owner, '([^/$]*)$', 1), '(', {ARGS_SQL}, ')') WHEN '<clinit>' THEN 'static {{}}' ELSE concat(name, '(', {ARGS_SQL}, ')') END".replace("{{}}", "{}")


def methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tv.view(spark, sf_dir, tv.METHODS)


def signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The methods with their readable signatures."""
    return methods(spark, sf_dir).withColumn("sig", sig.identifier(F.col("owner"), F.col("name"), F.col("descriptor")))


@query("sig_param_types", f"{M} SELECT method_id, {ARGS_SQL} AS types FROM m")
def sig_param_types(spark, sf_dir):
    return methods(spark, sf_dir).select("method_id", F.array_join(sig.param_types(F.col("descriptor")), ", ").alias("types"))


@query("sig_param_count", f"{M} SELECT method_id, len({PARAMS_SQL})::INTEGER AS n FROM m")
def sig_param_count(spark, sf_dir):
    return methods(spark, sf_dir).select("method_id", sig.param_count_desc(F.col("descriptor")).alias("n"))


@query("sig_identifier", f"{M} SELECT method_id, {ID_SQL} AS sig FROM m")
def sig_identifier(spark, sf_dir):
    return signed(spark, sf_dir).select("method_id", "sig")


@query("sig_display", f"{M} SELECT method_id, {DISPLAY_SQL} AS display FROM m")
def sig_display(spark, sf_dir):
    return methods(spark, sf_dir).select("method_id", sig.display(F.col("owner"), F.col("name"), F.col("descriptor")).alias("display"))


@query("sig_names", f"{M} SELECT method_id, replace(owner, '/', '.') AS class_name, split_part(owner, '/', -1) AS simple_name, regexp_extract(owner, '([^/$]*)$', 1) AS short_name FROM m")
def sig_names(spark, sf_dir):
    return methods(spark, sf_dir).select("method_id", sig.class_name(F.col("owner")).alias("class_name"), sig.simple_name(F.col("owner")).alias("simple_name"), sig.short_name(F.col("owner")).alias("short_name"))


@query("sig_split", f"{M} SELECT method_id, replace(owner, '/', '.') AS class_name, split_part(owner, '/', -1) AS simple_class, name AS method_name, len({PARAMS_SQL})::INTEGER AS param_count FROM m")
def sig_split(spark, sf_dir):
    return signed(spark, sf_dir).select("method_id", sig.split_signature(F.col("sig")).alias("s")).select("method_id", "s.*")


READABLE = "concat('com.acme.X#m(', CASE method_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'Map<String, List<Integer>>, int' WHEN 2 THEN 'String' ELSE 'Function<Map<String, Integer>, Long>, List<int[]>, long' END, ')')"


@query("sig_param_count_readable", f"{M} SELECT method_id, CASE method_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 3 END::INTEGER AS n FROM m")
def sig_param_count_readable(spark, sf_dir):
    return methods(spark, sf_dir).select("method_id", sig.param_count_sig(F.expr(READABLE)).alias("n"))


@query("sig_full", f"{M} SELECT method_id, CASE method_id % 3 WHEN 0 THEN replace(owner, '/', '.') WHEN 1 THEN concat(replace(owner, '/', '.'), '#', name) ELSE {ID_SQL} END AS full_sig FROM m")
def sig_full(spark, sf_dir):
    third = F.col("method_id") % 3
    return methods(spark, sf_dir).select("method_id", sig.full_signature(sig.class_name(F.col("owner")), F.when(third > 0, F.col("name")), F.when(third == 2, F.col("descriptor"))).alias("full_sig"))


BACK_SQL = "CASE method_id % 6 WHEN 0 THEN '()' WHEN 1 THEN '(I)' WHEN 2 THEN '(Ljava/lang/String;I)' WHEN 3 THEN '([Ljava/lang/String;[[I)' WHEN 4 THEN '(LInner;JD)' ELSE '(LMap;LList;I[BLjava/lang/Object;)' END"


@query("sig_to_descriptor", f"{M} SELECT method_id, {BACK_SQL} AS descriptor FROM m")
def sig_to_descriptor(spark, sf_dir):
    return methods(spark, sf_dir).select("method_id", sig.params_to_descriptor(F.array_join(sig.param_types(F.col("descriptor")), ", ")).alias("descriptor"))


@query(
    "parse_entry",
    f"""{M} SELECT method_id, replace(owner, '/', '.') AS class_name, CASE WHEN method_id % 4 > 0 THEN name END AS method_name,
    CASE method_id % 4 WHEN 2 THEN {BACK_SQL} WHEN 3 THEN descriptor END AS descriptor FROM m""",
)
def parse_entry(spark, sf_dir):
    kind = F.col("method_id") % 4
    cls = sig.class_name(F.col("owner"))
    text = F.when(kind == 0, cls).when(kind == 1, F.concat(cls, F.lit("#"), F.col("name"))).when(kind == 2, sig.identifier(F.col("owner"), F.col("name"), F.col("descriptor"))).otherwise(F.concat(cls, F.lit("#"), F.col("name"), F.col("descriptor")))
    return methods(spark, sf_dir).select("method_id", sig.parse_entry(text).alias("e")).select("method_id", "e.*")


@query(
    "access_flags",
    f"""{M} SELECT method_id, access & 512 <> 0 AS is_interface, access & 1024 <> 0 AS is_abstract, access & 1 <> 0 AS is_public, access & 8 <> 0 AS is_static,
    access & 4160 <> 0 AS is_synthetic, access & 1280 = 0 AS is_concrete FROM m""",
)
def access_flags(spark, sf_dir):
    a = F.col("access")
    flags = {"is_interface": sig.is_interface, "is_abstract": sig.is_abstract, "is_public": sig.is_public, "is_static": sig.is_static, "is_synthetic": sig.is_synthetic_or_bridge, "is_concrete": sig.is_concrete}
    return methods(spark, sf_dir).select("method_id", *[f(a).alias(c) for c, f in flags.items()])


OWNERS = "CASE method_id % 4 WHEN 0 THEN 'java/util/List' WHEN 1 THEN 'org/xml/sax/Parser' WHEN 2 THEN 'javafx/Scene' ELSE owner END"


@query("is_jdk", f"{M} SELECT method_id, method_id % 4 < 2 AS jdk FROM m")
def is_jdk(spark, sf_dir):
    return methods(spark, sf_dir).select("method_id", sig.is_jdk(F.expr(OWNERS)).alias("jdk"))


@query(
    "wildcard_match",
    f"""{M} SELECT method_id, regexp_matches(c, '^com\\.acme\\..*$') AS deep, regexp_matches(c, '^com\\.acme\\.[^.]*$') AS flat, regexp_matches(c, '^.*Brand1[^.]*$') AS suffix, false AS bad
    FROM (SELECT method_id, replace(owner, '/', '.') AS c FROM m) x""",
)
def wildcard_match(spark, sf_dir):
    c = sig.class_name(F.col("owner"))
    found = {"deep": "com.acme.**", "flat": "com.acme.*", "suffix": "**Brand1*", "bad": "?"}
    return methods(spark, sf_dir).select("method_id", *[sig.wildcard_match(c, p).alias(n) for n, p in found.items()])


@query(
    "join_path",
    """WITH p AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'api/' ELSE '/v1' END AS base, CASE WHEN page_id % 5 = 0 THEN '' ELSE regexp_extract(url, '^[a-z]+://[^/]*(/?[^?#]*)', 1) END AS path FROM pages),
    q AS (SELECT *, CASE WHEN rtrim(led, '/') = '' THEN '/' ELSE rtrim(led, '/') END AS alone, CASE base WHEN 'api/' THEN '/api' WHEN '/v1' THEN '/v1' ELSE '/' END AS b
      FROM (SELECT *, CASE WHEN path LIKE '/%' THEN path ELSE '/' || path END AS led FROM p) x)
    SELECT page_id, CASE WHEN base = '' THEN alone WHEN path = '' THEN b ELSE b || led END AS path FROM q""",
)
def join_path(spark, sf_dir):
    base = F.expr("CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'api/' ELSE '/v1' END")
    path = F.when(F.col("page_id") % 5 == 0, "").otherwise(F.regexp_extract("url", r"^[a-z]+://[^/]*(/?[^?#]*)", 1))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", sig.join_path(base, path).alias("path"))


@query(
    "result_name",
    f"""{M} SELECT method_id, concat(split_part(owner, '/', -1), '#', regexp_replace(name, '[\\\\/:*?"<>|]', '_', 'g'), '_',
    substr(sha1(concat(replace(owner, '/', '.'), '|', name, '|20|50000|', source)), 1, 8), '.json') AS file_name FROM m""",
)
def result_name(spark, sf_dir):
    return methods(spark, sf_dir).select("method_id", sig.result_name(sig.class_name(F.col("owner")), F.col("name"), F.lit(20), F.lit(50000), F.col("source")).alias("file_name"))


@query("cap_text", "SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 492) || '…（超长已截断）' ELSE text END AS cell FROM documents")
def cap_text(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", sig.cap_text(F.col("text"), 500).alias("cell"))


FILES = "CASE method_id % 5 WHEN 0 THEN 'analysis_result.json' WHEN 1 THEN concat('A#m_', substr(md5(name), 1, 8), '.json') WHEN 2 THEN concat('A#m_', substr(md5(name), 1, 7), '.json') WHEN 3 THEN 'A_0123abcd.txt' ELSE 'x_DEADBEEF.json' END"


@query("is_entry_file", f"{M} SELECT method_id, method_id % 5 = 1 AS is_entry FROM m")
def is_entry_file(spark, sf_dir):
    return methods(spark, sf_dir).select("method_id", sig.is_entry_file(F.expr(FILES)).alias("is_entry"))


@query(
    "labels",
    f"""WITH e AS {tv.plain(tv.EDGES)}, m AS {tv.plain(tv.METHODS)}
    SELECT from_id, to_id, line, CASE source WHEN 'PROJECT' THEN '项目' WHEN 'DEPENDENCY' THEN '依赖' ELSE '外部' END AS source_label,
    CASE invoke WHEN 'VIRTUAL' THEN '虚调用' WHEN 'STATIC' THEN '静态' ELSE '接口' END AS invoke_label FROM e JOIN m ON to_id = method_id""",
)
def labels(spark, sf_dir):
    edges = tv.view(spark, sf_dir, tv.EDGES).join(methods(spark, sf_dir), F.col("to_id") == F.col("method_id"))
    return edges.select("from_id", "to_id", "line", sig.source_label(F.col("source")).alias("source_label"), sig.invoke_label(F.col("invoke")).alias("invoke_label"))


@query("source_filter", f"{M} SELECT method_id, source FROM m WHERE source = 'DEPENDENCY'")
def source_filter(spark, sf_dir):
    return resolve.filter_source(methods(spark, sf_dir), "dependency").select("method_id", "source")


def noise_sql(layered: bool = False, of=rules.BUILTIN) -> str:
    """Rules as SQL over name, owner, source and descriptor: a boolean, or the matching names."""
    tests = []
    for r in of:
        parts = [f"regexp_matches(name, '{r.method}')"]
        parts += [f"regexp_matches(replace(owner, '/', '.'), '{r.cls}')"] if r.cls else []
        parts += [f"source = '{r.source}'"] if r.source != "ALL" else []
        parts += [f"len({PARAMS_SQL}) = {r.params}"] if r.params is not None else []
        tests.append((" AND ".join(parts), f"[{r.layer}] {r.name}"))
    if layered:
        return "concat_ws(', ', " + ", ".join(f"CASE WHEN {t} THEN '{n}' END" for t, n in tests) + ")"
    return "(" + " OR ".join(f"({t})" for t, _ in tests) + ")"


@query("noise_flag", f"{M} SELECT method_id, {noise_sql()} AS noise FROM m")
def noise_flag(spark, sf_dir):
    return signed(spark, sf_dir).select("method_id", rules.is_noise(rules.BUILTIN, F.col("sig"), F.col("source")).alias("noise"))


@query("noise_matched", f"{M} SELECT method_id, {noise_sql(True)} AS rules FROM m")
def noise_matched(spark, sf_dir):
    return signed(spark, sf_dir).select("method_id", rules.matched_rules(rules.BUILTIN, F.col("sig"), F.col("source")).alias("rules"))


#: Rule tables made of the method view: methods of size class 1 are global rules, of 2 custom, of 3 overrides.
GLOBAL_RULES = "SELECT concat('g', CAST(method_id % 40 AS VARCHAR(20))) AS id, min(name) AS name, min(name) AS method_pattern, '' AS class_pattern, min(source) AS source, CAST(NULL AS INT) AS param_count, min(method_id) % 2 = 0 AS enabled FROM {m} GROUP BY method_id % 40"
OVERRIDES = "SELECT owner AS project, concat('g', CAST(method_id % 40 AS VARCHAR(20))) AS id, min(method_id) % 3 = 0 AS enabled FROM {m} WHERE method_id % 7 = 0 GROUP BY owner, method_id % 40"
CUSTOM = "SELECT owner AS project, concat('c', CAST(method_id AS VARCHAR(20))) AS id, name, name AS method_pattern, owner AS class_pattern, source, CAST(method_id % 3 AS INT) AS param_count, method_id % 2 = 1 AS enabled FROM {m} WHERE method_id % 11 = 0"
RULES_CTE = f"{M}, g AS ({GLOBAL_RULES.format(m='m')}), o AS ({OVERRIDES.format(m='m')}), c AS ({CUSTOM.format(m='m')})"


def rule_tables(spark, sf_dir):
    m = methods(spark, sf_dir)
    return spark.sql(GLOBAL_RULES, m=m), spark.sql(OVERRIDES, m=m), spark.sql(CUSTOM, m=m)


EFFECTIVE_SQL = """SELECT p.project, 'G' AS layer, g.id, g.name, g.method_pattern, g.class_pattern, g.source, g.param_count, coalesce(o.enabled, g.enabled) AS enabled
    FROM (SELECT project FROM o UNION SELECT project FROM c) p CROSS JOIN g LEFT JOIN o ON o.project = p.project AND o.id = g.id
    UNION ALL SELECT project, 'P', id, name, method_pattern, class_pattern, source, param_count, enabled FROM c"""


@query("effective_rules", f"{RULES_CTE} {EFFECTIVE_SQL}")
def effective_rules(spark, sf_dir):
    return rules.effective_rules(*rule_tables(spark, sf_dir))


@query(
    "rules_sheet",
    f"""{RULES_CTE}, e AS ({EFFECTIVE_SQL}) SELECT project, layer, row_number() OVER (PARTITION BY project ORDER BY layer, id)::INTEGER AS seq, name, method_pattern,
    CASE class_pattern WHEN '' THEN '不限' ELSE class_pattern END AS class_pattern, source, coalesce(param_count::VARCHAR, '不限') AS param_count, enabled FROM e""",
)
def rules_sheet(spark, sf_dir):
    from callscope.operators.report import rules_sheet as sheet

    return sheet(rules.effective_rules(*rule_tables(spark, sf_dir)))


STORED = """SELECT id, name, method_pattern, class_pattern, source, param_count, method_id % 5 = 0 AS enabled, method_id % 3 <> 0 AS builtin FROM (
  SELECT method_id, concat('g', CAST(method_id AS VARCHAR(20))) AS id, name, name AS method_pattern, '' AS class_pattern, source, CAST(NULL AS INT) AS param_count FROM {m}) x"""


@query(
    "merge_rules",
    f"""{RULES_CTE}, s AS ({STORED.format(m='m')})
    SELECT g.id, g.name, g.method_pattern, g.class_pattern, g.source, g.param_count, coalesce(s.enabled, g.enabled) AS enabled, true AS builtin FROM g LEFT JOIN s ON s.builtin AND s.id = g.id
    UNION ALL SELECT s.id, s.name, s.method_pattern, s.class_pattern, s.source, s.param_count, s.enabled, false FROM s WHERE NOT builtin AND NOT EXISTS (
      SELECT 1 FROM g WHERE g.name = s.name AND g.method_pattern = s.method_pattern AND g.class_pattern = s.class_pattern AND g.source = s.source AND g.param_count IS NOT DISTINCT FROM s.param_count)""",
)
def merge_rules(spark, sf_dir):
    stored = spark.sql(STORED, m=methods(spark, sf_dir))
    return rules.merge_builtin_rules(stored, rule_tables(spark, sf_dir)[0])


@query(
    "rule_from_method",
    f"""{M}, made AS (SELECT DISTINCT {ID_SQL} AS name, concat('^', regexp_replace(name, '([\\\\.\\[\\]{{}}()*+?^$|])', '\\\\\\1', 'g'), '$') AS method_pattern,
    concat('^', replace(replace(owner, '/', '.'), '.', '\\.'), '$') AS class_pattern, source, len({PARAMS_SQL})::INTEGER AS param_count, method_id % 2 = 0 AS even FROM m)
    SELECT DISTINCT name, method_pattern, class_pattern, source, param_count FROM made a WHERE NOT EXISTS (SELECT 1 FROM made b WHERE b.even AND b.method_pattern = a.method_pattern
    AND b.class_pattern = a.class_pattern AND b.source = a.source AND b.param_count = a.param_count)""",
)
def rule_from_method(spark, sf_dir):
    rows = signed(spark, sf_dir)
    none = spark.createDataFrame([], "method_pattern string, class_pattern string, source string, param_count int")
    return rules.rule_from_method(rows, rules.rule_from_method(rows.filter("method_id % 2 = 0"), none))
