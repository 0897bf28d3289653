"""Versions of dependencies from build files, for a whole fleet at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.operators.base import cut

MOST_HOPS = 10


def norm_path(path: Column) -> Column:
    """A path without . parts, and without .. parts and what they undo."""
    start = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != "..")
        return F.when(part.isin(".", ""), done).when(up, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.concat(done, F.array(part)))

    parts = F.aggregate(F.split(path, "/"), start, step)
    return F.concat(F.when(path.startswith("/"), F.lit("/")).otherwise(F.lit("")), F.array_join(parts, "/"))


def link_parents(poms: DataFrame) -> DataFrame:
    """(pom, parent, how) of build files: the parent by its coordinates, else by its relative path; how: repository, path, missing, none.

    poms: (pom, path, gav, parent_gav, relative_path), gav as group:artifact:version. Without a relative path the
    parent is looked for in ../pom.xml. Of several files of equal coordinates the one with the smallest name counts.
    """
    by_gav = poms.filter("gav IS NOT NULL").groupBy(F.col("gav").alias("parent_gav")).agg(F.min("pom").alias("_by_gav"))
    by_path = poms.groupBy(norm_path(F.col("path")).alias("_at")).agg(F.min("pom").alias("_by_path"))
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    given = F.coalesce(F.when(F.col("relative_path") != "", F.col("relative_path")), F.lit("../pom.xml"))
    given = F.when(given.endswith(".xml"), given).otherwise(F.concat_ws("/", given, F.lit("pom.xml")))
    wanted = poms.select("pom", "parent_gav", norm_path(F.concat_ws("/", folder, given)).alias("_at"))
    found = wanted.join(by_gav, "parent_gav", "left").join(by_path, "_at", "left")
    # A file is never its own parent.
    near = F.when(F.col("_by_gav") != F.col("pom"), F.col("_by_gav"))
    far = F.when(F.col("_by_path") != F.col("pom"), F.col("_by_path"))
    asked = F.col("parent_gav").isNotNull()
    how = F.when(~asked, "none").when(near.isNotNull(), "repository").when(far.isNotNull(), "path").otherwise("missing")
    return found.select("pom", F.when(asked, F.coalesce(near, far)).alias("parent"), how.alias("how"))


def parent_chain(poms: DataFrame) -> DataFrame:
    """(pom, ancestor, hop): each build file with itself and its parents, child first, at most ten hops; a file comes once in a chain.

    poms: (pom, parent), as link_parents() finds them. A parent that is no row of poms ends the chain;
    missing_parents() lists it.
    """
    links = cut(poms.select(F.col("pom").alias("ancestor"), "parent"))
    chain = level = cut(poms.select("pom", F.col("pom").alias("ancestor"), F.lit(0).alias("hop"), F.array("pom").alias("_seen")))
    for hop in range(1, MOST_HOPS + 1):
        up = level.join(links.filter("parent IS NOT NULL"), "ancestor").filter(~F.array_contains("_seen", F.col("parent")))
        up = up.select("pom", F.col("parent").alias("ancestor"), F.lit(hop).alias("hop"), F.concat("_seen", F.array("parent")).alias("_seen"))
        level = cut(up.join(links.select("ancestor"), "ancestor", "left_semi"))
        if level.isEmpty():
            break
        chain = chain.unionByName(level)
    return chain.drop("_seen")


def missing_parents(poms: DataFrame) -> DataFrame:
    """(pom, parent): parents that are not there, for warnings."""
    return poms.filter("parent IS NOT NULL").join(poms.select(F.col("pom").alias("parent")), "parent", "left_anti").select("pom", "parent")


def builtin_props(chain: DataFrame, coordinates: DataFrame) -> DataFrame:
    """(pom, key, value): the project.* properties of build files, from their own coordinates and those of their parents.

    coordinates: (pom, group_id, artifact_id, version). A file without a group has its parent's.
    """
    own = coordinates.select(F.col("pom").alias("ancestor"), "group_id", "artifact_id", "version")
    rows = chain.filter("hop <= 1").join(own, "ancestor").select("pom", "hop", "group_id", "artifact_id", "version")
    of = lambda c, hop: F.max(F.when(F.col("hop") == hop, F.when(F.col(c) != "", F.col(c))))
    wide = rows.groupBy("pom").agg(*[of(c, hop).alias(f"{c}_{hop}") for c in ("group_id", "artifact_id", "version") for hop in (0, 1)])
    values = {
        "project.version": F.col("version_0"), "project.groupId": F.coalesce("group_id_0", "group_id_1"), "project.artifactId": F.col("artifact_id_0"),
        "project.parent.version": F.col("version_1"), "project.parent.groupId": F.col("group_id_1"), "project.parent.artifactId": F.col("artifact_id_1"),
    }
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in values.items()])).alias("p")
    return wide.select("pom", pairs).select("pom", "p.key", "p.value").filter("value IS NOT NULL")


def effective_props(chain: DataFrame, props: DataFrame, builtin: DataFrame | None = None) -> DataFrame:
    """(pom, key, value): properties of the nearest build file in the chain. props: (pom, key, value).

    builtin: builtin_props(), which count over properties of the same name.
    """
    own = props.withColumnRenamed("pom", "ancestor")
    rows = chain.join(own, "ancestor").select("pom", "key", "value", "hop")
    if builtin is not None:
        rows = rows.unionByName(builtin.select("pom", "key", "value", F.lit(-1).alias("hop")))
    return rows.groupBy("pom", "key").agg(F.min_by("value", "hop").alias("value"))


def props_map(props: DataFrame) -> DataFrame:
    """(pom, props): a build file's properties as a map."""
    return props.groupBy("pom").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("props"))


def substitute(text: Column, props: Column, passes: int = 5) -> Column:
    """text with ${key} replaced by properties, again and again for at most five passes; unknown keys stay. Only the keys that a text names are looked up."""

    def once(t: Column) -> Column:
        named = F.array_distinct(F.regexp_extract_all(t, F.lit(r"\$\{([^{}]*)\}"), F.lit(1)))
        put = lambda s, key: F.coalesce(F.replace(s, F.concat(F.lit("${"), key, F.lit("}")), F.element_at(props, key)), s)
        return F.aggregate(named, t, put)

    return F.aggregate(F.array(*[F.lit(i) for i in range(passes)]), text, lambda s, _: once(s))


def managed_versions(chain: DataFrame, managed: DataFrame, bom_parents: bool = False) -> DataFrame:
    """(pom, ga, version): managed versions, child before parent, imports in place, the first declaration wins.

    managed: (pom, ord, ga, version, bom); a row with bom stands for all that the build file of that name manages itself, and with
    bom_parents for what its parents manage too. Imports have any depth. For a build file each import counts once, where it is met first;
    so what an import stands for is placed by its first place, and imports in a circle end. A round follows imports whose
    first place is new or came forward.
    """
    rows = cut(chain.join(managed.withColumnRenamed("pom", "ancestor"), "ancestor").select("pom", "hop", F.array("hop", "ord").alias("at"), "ga", "version", "bom"))
    inner = rows if bom_parents else rows.filter("hop = 0")
    inner = cut(inner.select(F.col("pom").alias("bom"), F.col("at").alias("in_at"), "ga", "version", F.col("bom").alias("in_bom")))
    imports = inner.filter("in_bom IS NOT NULL").drop("ga", "version")
    first = level = cut(rows.filter("bom IS NOT NULL").groupBy("pom", "bom").agg(F.min("at").alias("at")))
    while not level.isEmpty():
        below = level.join(imports, "bom").groupBy("pom", F.col("in_bom").alias("bom")).agg(F.min(F.concat("at", "in_at")).alias("_new"))
        both = cut(first.join(below, ["pom", "bom"], "full"))
        sooner = F.col("at").isNull() | (F.col("_new") < F.col("at"))
        level = both.filter(F.col("_new").isNotNull() & sooner).select("pom", "bom", F.col("_new").alias("at"))
        first = both.select("pom", "bom", F.when(F.col("_new").isNotNull() & sooner, F.col("_new")).otherwise(F.col("at")).alias("at"))
    imported = first.join(inner.filter("in_bom IS NULL"), "bom").select("pom", F.concat("at", "in_at").alias("at"), "ga", "version")
    return rows.filter("bom IS NULL").select("pom", "at", "ga", "version").unionByName(imported).groupBy("pom", "ga").agg(F.min_by("version", "at").alias("version"))


def chain_dependencies(chain: DataFrame, declared: DataFrame, child_wins: bool = False) -> DataFrame:
    """(pom, ga, version, scope) over a chain; of several declarations the parent's stays, or the child's if told so."""
    rows = chain.join(declared.withColumnRenamed("pom", "ancestor"), "ancestor")
    order = F.col("hop") if child_wins else -F.col("hop")
    return rows.groupBy("pom", "ga").agg(F.min_by(F.struct("version", "scope"), order).alias("_d")).select("pom", "ga", "_d.version", "_d.scope")


def resolve_dependencies(declared: DataFrame, managed: DataFrame, repo: DataFrame) -> DataFrame:
    """(pom, ga, version, outcome) of declared dependencies that are not of test scope.

    The own version counts, else the managed one. Without any the outcome is unresolved and the version ?; a
    version range is skipped; a version that repo (ga, version) does not have is unresolved; else resolved.
    """
    rows = declared.filter(F.coalesce(F.col("scope"), F.lit("compile")) != "test")
    rows = rows.join(managed.select("pom", "ga", F.col("version").alias("_managed")), ["pom", "ga"], "left")
    rows = rows.withColumn("version", F.coalesce("version", "_managed"))
    rows = rows.join(repo.select("ga", "version", F.lit(True).alias("_there")), ["ga", "version"], "left")
    outcome = F.when(F.col("version").isNull(), "unresolved").when(F.col("version").rlike(r"^[\[(]"), "skipped").when(F.col("_there"), "resolved").otherwise("unresolved")
    return rows.select("pom", "ga", F.coalesce("version", F.lit("?")).alias("version"), outcome.alias("outcome"))

