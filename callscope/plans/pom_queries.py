"""Queries of the dependency operators over the supplier, nation, region chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from callscope.operators import poms
from callscope.plans import testviews as tv
from callscope.plans.registry import query

PROPS = "SELECT pom, concat('k', CAST(num % 3 AS VARCHAR(9))) AS key, concat('v', CAST(num AS VARCHAR(9))) AS value FROM {p} UNION ALL SELECT pom, 'ref', concat('${{k', CAST(num % 3 AS VARCHAR(9)), '}}-', substr(pom, 1, 1)) FROM {p} WHERE substr(pom, 1, 1) <> 's'"
MANAGED = """SELECT pom, 0 AS ord, CAST(NULL AS BIGINT) AS ga, CAST(NULL AS VARCHAR(20)) AS version, concat('n', CAST((num + 1) % 25 AS VARCHAR(9))) AS bom FROM {p} WHERE substr(pom, 1, 1) = 's'
  UNION ALL SELECT pom, i, CAST((num * 7 + i * 11) % 200 AS BIGINT), concat('2.', CAST(num AS VARCHAR(9)), '.', CAST(i AS VARCHAR(9))), CAST(NULL AS VARCHAR(9)) FROM {p} CROSS JOIN (SELECT 1 AS i UNION ALL SELECT 2 UNION ALL SELECT 3) x WHERE substr(pom, 1, 1) = 'n'
  UNION ALL SELECT pom, i, CAST((num + i * 5) % 200 AS BIGINT), concat('3.', CAST(num AS VARCHAR(9))), CAST(NULL AS VARCHAR(9)) FROM {p} CROSS JOIN (SELECT DISTINCT l_partkey % 40 AS i FROM {lineitem}) y WHERE substr(pom, 1, 1) = 'r'"""
P_SQL = f"WITH RECURSIVE p AS {tv.plain(tv.POMS)}, chain AS (SELECT pom, pom AS ancestor, 0 AS hop FROM p UNION ALL SELECT c.pom, p.parent, hop + 1 FROM chain c JOIN p ON p.pom = c.ancestor WHERE p.parent IS NOT NULL AND hop < 10)"
PROPS_SQL = f"{P_SQL}, props AS ({PROPS.format(p='p')}), eff AS (SELECT c.pom, key, arg_min(value, hop) AS value FROM chain c JOIN props q ON q.pom = c.ancestor GROUP BY c.pom, key)"
MANAGED_SQL = f"""{P_SQL}, man AS ({MANAGED.format(p='p', lineitem='lineitem')}), lev AS (SELECT c.pom, [hop, ord] AS pos, ga, version, bom FROM chain c JOIN man q ON q.pom = c.ancestor),
  allm AS (SELECT pom, pos, ga, version FROM lev WHERE bom IS NULL UNION ALL SELECT a.pom, list_concat(a.pos, b.pos), b.ga, b.version FROM lev a JOIN lev b ON a.bom = b.pom WHERE b.bom IS NULL),
  mv AS (SELECT pom, ga, arg_min(version, pos) AS version FROM allm GROUP BY pom, ga)"""


def fleet(spark, sf_dir):
    return tv.view(spark, sf_dir, tv.POMS)


def managed(spark, sf_dir):
    rows = spark.sql(MANAGED, p=fleet(spark, sf_dir), lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    return poms.managed_versions(poms.parent_chain(fleet(spark, sf_dir)), rows, bom_parents=True)


@query("parent_chain", f"{P_SQL} SELECT pom, ancestor, hop FROM chain")
def parent_chain(spark, sf_dir):
    return poms.parent_chain(fleet(spark, sf_dir))


#: Coordinates: supplier files have no group of their own. Every third one names its parent by a relative path only.
COORDINATES = "SELECT pom, CASE WHEN substr(pom, 1, 1) <> 's' THEN concat('g.', pom) END AS group_id, concat('a-', pom) AS artifact_id, concat('1.', CAST(num AS VARCHAR(9))) AS version FROM {p}"
FILES = """SELECT pom, CASE substr(pom, 1, 1) WHEN 'r' THEN concat('/src/', pom, '/pom.xml') WHEN 'n' THEN concat('/src/', parent, '/', pom, '/pom.xml') ELSE concat('/src/all/', parent, '/', pom, '/./pom.xml') END AS path,
  concat('g:', pom) AS gav, CASE WHEN parent IS NOT NULL THEN CASE WHEN num % 3 = 0 THEN concat('lost:', parent) ELSE concat('g:', parent) END END AS parent_gav, CASE WHEN substr(pom, 1, 1) = 's' AND num % 2 = 0 THEN concat('../../../r', CAST(num % 5 AS VARCHAR(9))) END AS relative_path FROM {p}"""


@query(
    "link_parents",
    f"""{P_SQL}, q AS (SELECT pom, parent, num, substr(pom, 1, 1) AS k FROM p) SELECT pom, CASE WHEN parent IS NULL THEN NULL WHEN num % 3 > 0 THEN parent WHEN k = 'n' THEN parent WHEN k = 's' AND num % 2 = 0 THEN concat('r', num % 5) END AS parent,
    CASE WHEN parent IS NULL THEN 'none' WHEN num % 3 > 0 THEN 'repository' WHEN k = 'n' OR num % 2 = 0 THEN 'path' ELSE 'missing' END AS how FROM q""",
)
def link_parents(spark, sf_dir):
    return poms.link_parents(spark.sql(FILES, p=fleet(spark, sf_dir)))


BUILTIN_SQL = f"""co AS ({COORDINATES.format(p='p')}), bp AS (SELECT p.pom, unnest([('project.version', o.version), ('project.groupId', coalesce(o.group_id, u.group_id)), ('project.artifactId', o.artifact_id),
  ('project.parent.version', u.version), ('project.parent.groupId', u.group_id), ('project.parent.artifactId', u.artifact_id)]) AS kv FROM p JOIN co o ON o.pom = p.pom LEFT JOIN co u ON u.pom = p.parent),
  bi AS (SELECT pom, kv[1] AS key, kv[2] AS value FROM bp WHERE kv[2] IS NOT NULL)"""


@query("builtin_props", f"{P_SQL}, {BUILTIN_SQL} SELECT * FROM bi")
def builtin_props(spark, sf_dir):
    p = fleet(spark, sf_dir)
    return poms.builtin_props(poms.parent_chain(p), spark.sql(COORDINATES, p=p))


#: A property that names a built-in one, beside the others.
OWN = "SELECT pom, 'next' AS key, concat('$', '{{project.version}}+$', '{{project.parent.artifactId}}') AS value FROM {p}"


@query(
    "effective_props",
    f"""{PROPS_SQL}, {BUILTIN_SQL}, x AS (SELECT * FROM eff UNION ALL SELECT * FROM bi UNION ALL SELECT * FROM ({OWN.format(p='p')})), f AS (SELECT pom, {", ".join(f"max(CASE key WHEN '{k}' THEN value END) AS {c}" for k, c in (("k0", "k0"), ("k1", "k1"), ("k2", "k2"), ("project.version", "v"), ("project.parent.artifactId", "pa")))} FROM x GROUP BY pom)
    SELECT pom, key, replace(replace(replace(replace(replace(value, '${{k0}}', coalesce(k0, '${{k0}}')), '${{k1}}', coalesce(k1, '${{k1}}')), '${{k2}}', coalesce(k2, '${{k2}}')), '${{project.version}}', v), '${{project.parent.artifactId}}', coalesce(pa, '${{project.parent.artifactId}}')) AS value FROM x JOIN f USING (pom)""".replace("{{", "{").replace("}}", "}"),
)
def effective_props(spark, sf_dir):
    p = fleet(spark, sf_dir)
    chain, props = poms.parent_chain(p), spark.sql(PROPS, p=p).union(spark.sql(OWN, p=p))
    found = poms.effective_props(chain, props, poms.builtin_props(chain, spark.sql(COORDINATES, p=p)))
    return found.join(poms.props_map(found), "pom").select("pom", "key", poms.substitute(F.col("value"), F.col("props")).alias("value"))


@query("managed_versions", f"{MANAGED_SQL} SELECT * FROM mv")
def managed_versions(spark, sf_dir):
    return managed(spark, sf_dir)


#: Imports of any depth: each nation's file imports the next one, the last the first again, and every third an own one of its region.
IMPORTED = """SELECT pom, 0 AS ord, CAST(NULL AS BIGINT) AS ga, CAST(NULL AS VARCHAR(20)) AS version, concat('n', CAST(num % 25 AS VARCHAR(9))) AS bom FROM {p} WHERE substr(pom, 1, 1) = 's'
  UNION ALL SELECT pom, 1 + num % 2 * 3, NULL, NULL, concat('n', CAST((num + 1) % 25 AS VARCHAR(9))) FROM {p} WHERE substr(pom, 1, 1) = 'n'
  UNION ALL SELECT pom, 2, NULL, NULL, parent FROM {p} WHERE substr(pom, 1, 1) = 'n' AND num % 3 = 0
  UNION ALL SELECT pom, 3, CAST(num AS BIGINT), concat('2.', CAST(num AS VARCHAR(9))), NULL FROM {p} WHERE substr(pom, 1, 1) = 'n'
  UNION ALL SELECT pom, 5, CAST(100 + num % 4 AS BIGINT), concat('3.', CAST(num AS VARCHAR(9))), NULL FROM {p} WHERE substr(pom, 1, 1) <> 's'"""
#: The walk as the depth-first listing does it: all simple paths of imports; a file counts at its first place.
IMPORTED_SQL = f"""{P_SQL}, man AS ({IMPORTED.format(p='p')}), lev AS (SELECT c.pom, hop, [hop, ord] AS pos, ga, version, bom FROM chain c JOIN man q ON q.pom = c.ancestor), own AS (SELECT * FROM lev WHERE hop = 0),
  imp AS (SELECT pom, bom, pos, [bom] AS seen FROM lev WHERE bom IS NOT NULL UNION ALL SELECT i.pom, o.bom, list_concat(i.pos, o.pos), list_append(seen, o.bom) FROM imp i JOIN own o ON o.pom = i.bom WHERE o.bom IS NOT NULL AND NOT list_contains(seen, o.bom)),
  spot AS (SELECT pom, bom, min(pos) AS pos FROM imp GROUP BY pom, bom),
  every AS (SELECT pom, pos, ga, version FROM lev WHERE bom IS NULL UNION ALL SELECT a.pom, list_concat(a.pos, o.pos), o.ga, o.version FROM spot a JOIN own o ON o.pom = a.bom WHERE o.bom IS NULL)"""


@query("managed_imports", f"{IMPORTED_SQL} SELECT pom, ga, arg_min(version, pos) AS version FROM every GROUP BY pom, ga")
def managed_imports(spark, sf_dir):
    """Versions that come through chains of up to 25 imports, which end in a circle."""
    p = fleet(spark, sf_dir)
    return poms.managed_versions(poms.parent_chain(p), spark.sql(IMPORTED, p=p))


DEPS = "SELECT concat('s', CAST(project AS VARCHAR(20))) AS pom, ga, CASE WHEN ga % 31 = 0 THEN '[1,2)' ELSE version END AS version, scope FROM {d}"
REPO = "SELECT ga, version FROM {v} WHERE (ga + length(version)) % 4 > 0"


@query(
    "resolve_deps",
    f"""{MANAGED_SQL}, d0 AS {tv.plain(tv.DECLARED_DEPS)}, d AS ({DEPS.format(d='d0')}), v AS (SELECT ga, version FROM d WHERE version IS NOT NULL UNION SELECT ga, version FROM mv), repo AS ({REPO.format(v='v')})
    SELECT pom, x.ga, coalesce(x.version, '?') AS version, CASE WHEN x.version IS NULL THEN 'unresolved' WHEN x.version LIKE '[%' THEN 'skipped' WHEN r.ga IS NOT NULL THEN 'resolved' ELSE 'unresolved' END AS outcome
    FROM (SELECT d.pom, d.ga, coalesce(d.version, mv.version) AS version FROM d LEFT JOIN mv ON mv.pom = d.pom AND mv.ga = d.ga WHERE scope <> 'test') x LEFT JOIN repo r ON r.ga = x.ga AND r.version = x.version""",
)
def resolve_deps(spark, sf_dir):
    declared = spark.sql(DEPS, d=tv.view(spark, sf_dir, tv.DECLARED_DEPS))
    known = managed(spark, sf_dir)
    repo = spark.sql(REPO, v=declared.filter("version IS NOT NULL").select("ga", "version").union(known.select("ga", "version")).distinct())
    return poms.resolve_dependencies(declared, known, repo)
