"""Rules and scan profiles of many projects, as tables, applied in one job.

Rules meet methods and classes by key: a pattern by the letters that its matches must contain, a package, annotation or
interface by its name. Only what shares a key is then tested with the pattern itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callscope.functions import sig
from callscope.functions.literals import is_pattern, pattern_keys, text_keys, wildcard_regexes
from callscope.functions.sig import split_signature
from callscope.operators import detect
from callscope.operators.base import cut

MARK = "\u0001"


def _some(column: str) -> Column:
    """A text that may be missing."""
    return F.coalesce(F.col(column), F.lit(""))


def matched_pairs(methods: DataFrame, rules: DataFrame, order: tuple[str, ...] = ("layer", "id")) -> DataFrame:
    """(project, sig, source, layer, id, name): each distinct method with each enabled rule of its project that matches it.

    methods: (project, sig, source); rules: the columns of rules.effective_rules(). Empty or null patterns, the source ALL and a null
    param_count are no limits; a pattern that is not valid never matches.
    """
    able = rules.filter("enabled").select("project", *order, "name", _some("method_pattern").alias("_m"), _some("class_pattern").alias("_c"), F.upper(_some("source")).alias("_s"), "param_count").distinct()
    able = able.filter(is_pattern(F.col("_m")) & is_pattern(F.col("_c")))
    # The keys of the method's pattern, or of the class's where that has none.
    patterns = able.select(F.col("_m").alias("_p")).union(able.select("_c")).distinct().withColumn("_keys", pattern_keys("_p"))
    for side in "mc":
        able = able.join(patterns.select(F.col("_p").alias(f"_{side}"), F.col("_keys").alias(f"_keys_{side}")), f"_{side}")
    by_class = F.array_contains("_keys_m", "") & ~F.array_contains("_keys_c", "")
    keys = F.when(by_class, F.transform("_keys_c", lambda k: F.concat(F.lit("c"), k))).otherwise(F.transform("_keys_m", lambda k: F.concat(F.lit("m"), k)))
    able = able.withColumn("_key", F.explode(keys)).drop("_keys_m", "_keys_c")
    parts = split_signature(F.col("sig"))
    shapes = methods.select("project", "sig", F.upper(_some("source")).alias("_source"), "source").filter("sig IS NOT NULL").distinct()
    shapes = shapes.withColumns({"_method": parts.getField("method_name"), "_class": parts.getField("class_name"), "_n": parts.getField("param_count")})
    named = lambda letter, column: F.transform(text_keys(F.col(column)), lambda k: F.concat(F.lit(letter), k))
    wanted = able.select("project", F.col("_key").alias("_key")).distinct()
    keyed = shapes.withColumn("_key", F.explode(F.concat(named("m", "_method"), named("c", "_class")))).join(wanted, ["project", "_key"], "left_semi")
    found = keyed.join(able.withColumnRenamed("name", "_name"), ["project", "_key"])
    fits = (F.col("_s").isin("", "ALL") | (F.col("_s") == F.col("_source"))) & F.rlike("_method", F.col("_m")) & F.rlike("_class", F.col("_c"))
    fits = fits & F.coalesce(F.col("_n") == F.col("param_count"), F.col("param_count").isNull())
    return found.filter(fits).select("project", "sig", "source", *order, F.col("_name").alias("name")).distinct()


def apply_rules(methods: DataFrame, rules: DataFrame) -> DataFrame:
    """methods with `noise` and `rules`: whether a rule of the project matches, and the names of all that do, each with its layer.

    methods: (project, sig, source) and other columns, which stay; rules: rules.effective_rules(), of all projects. Rules of a
    project stand in the order of layer and id. The result for a project is that of rules.is_noise() and rules.matched_rules() with
    a list of its rules. A method without a signature matches nothing; own columns named noise or rules are replaced.
    """
    pairs = matched_pairs(methods, rules)
    names = F.array_sort(F.collect_list(F.struct("layer", "id", "name")))
    named = pairs.groupBy("project", "sig", _some("source").alias("_source")).agg(F.array_join(F.transform(names, lambda x: F.format_string("[%s] %s", x.getField("layer"), x.getField("name"))), ", ").alias("rules"))
    rows = methods.drop("noise", "rules").withColumn("_source", _some("source"))
    rows = rows.join(named, ["project", "sig", "_source"], "left").drop("_source")
    return rows.withColumns({"noise": F.col("rules").isNotNull(), "rules": _some("rules")})


def profiles_in_force(projects: DataFrame, profiles: DataFrame, global_active: str = "standard") -> DataFrame:
    """(project, owner, profile_id, detectors): the profile in force of each project; owner: whose profile it is, null for a global one.

    projects: (project, active_id, has_custom); profiles: (project or null for global, id, builtin, ord, detectors map<string,boolean>).
    A project's custom profiles replace the global custom ones; built-ins always stay. The project's active id counts over the global one;
    it finds a global profile too, else `standard` counts, then the first. The choices by id are equi joins; only the first global profile is one row for all.
    """
    wanted = projects.withColumn("wanted", F.coalesce(F.when(F.col("active_id") != "", F.col("active_id")), F.lit(global_active)))
    shared, own = profiles.filter("project IS NULL"), profiles.filter("project IS NOT NULL")
    body = ["id", "ord", "detectors"]
    pick = lambda rank, owner: [F.col("project"), owner.alias("owner"), F.col("id").alias("profile_id"), "ord", "detectors", F.lit(rank).alias("_rank")]
    none = F.lit(None).cast(profiles.schema["project"].dataType)
    by_id = wanted.withColumnRenamed("wanted", "id")
    found = by_id.join(own.select("project", *body), ["project", "id"]).select(*pick(0, F.col("project")))
    found = found.unionByName(by_id.join(shared.select(*body), "id").select(*pick(0, none)))
    standard = projects.withColumn("id", F.lit("standard"))
    found = found.unionByName(standard.join(shared.filter("builtin OR id = 'standard'").select(*body, "builtin"), "id").filter(F.col("builtin") | ~F.col("has_custom")).select(*pick(1, none)))
    found = found.unionByName(standard.join(own.select("project", *body), ["project", "id"]).select(*pick(1, F.col("project"))))
    # The first of all: a project's own first one, and the first global one of those it can see (one row for each of two kinds).
    first = F.min_by(F.struct(*body), "ord")
    heads = shared.filter("builtin").agg(first.alias("f")).withColumn("has_custom", F.lit(True)).unionByName(shared.agg(first.alias("f")).withColumn("has_custom", F.lit(False))).filter("f IS NOT NULL")
    found = found.unionByName(projects.join(heads, "has_custom").select("project", "f.*").select(*pick(2, none)))
    found = found.unionByName(own.groupBy("project").agg(first.alias("f")).join(projects.select("project"), "project").select("project", "f.*").select(*pick(2, F.col("project"))))
    nth = F.row_number().over(Window.partitionBy("project").orderBy("_rank", "ord"))
    return found.withColumn("_r", nth).filter("_r = 1").select("project", "owner", "profile_id", "detectors")


def rules_in_force(force: DataFrame, rules: DataFrame) -> DataFrame:
    """(project, ord, name, kind, value, recursive, excludes): the enabled scan rules of each project's profile.

    force: profiles_in_force(); rules: (project or null for global, profile_id, ord, name, kind, value, recursive, excludes, enabled).
    """
    active = rules.filter("coalesce(enabled, true) AND kind IS NOT NULL").drop("enabled")
    owner = force.select(F.col("project").alias("_for"), F.col("owner"), "profile_id")
    own = owner.filter("owner IS NOT NULL").join(active.withColumnRenamed("project", "owner"), ["owner", "profile_id"])
    shared = owner.filter("owner IS NULL").drop("owner").join(active.filter("project IS NULL").drop("project"), "profile_id")
    columns = [F.col("_for").alias("project"), "ord", "name", "kind", "value", F.coalesce("recursive", F.lit(True)).alias("recursive"), "excludes"]
    return own.select(*columns).unionByName(shared.select(*columns))


def _wild(rules: DataFrame, column: str) -> DataFrame:
    """rules with the regex (_regex) of a wildcard column, which matches whole texts, without those that are not valid, by key (_key)."""
    known = rules.select(F.col(column).alias("_w")).distinct().withColumn("_regex", wildcard_regexes("_w"))
    known = known.filter(is_pattern(F.col("_regex"))).withColumn("_key", F.explode(pattern_keys("_regex")))
    known = known.withColumn("_regex", F.concat(F.lit("\\A(?:"), "_regex", F.lit(")\\z")))
    return rules.join(known, F.col(column) == F.col("_w")).drop("_w")


def excluded_classes(classes: DataFrame, rules: DataFrame) -> DataFrame:
    """(project, class_name) of classes that an exclude of any of the project's rules matches."""
    excludes = _wild(rules.select("project", F.explode("excludes").alias("_exclude")).filter("_exclude <> ''").distinct(), "_exclude")
    names = classes.select("project", "class_name", sig.class_name(F.col("class_name")).alias("_fqn"))
    return names.withColumn("_key", F.explode(text_keys(F.col("_fqn")))).join(excludes, ["project", "_key"]).filter(F.rlike("_fqn", F.col("_regex"))).select("project", "class_name").distinct()


def scan_fleet_rules(classes: DataFrame, methods: DataFrame, rules: DataFrame) -> DataFrame:
    """The entries that the scan rules of each project find, as detect.scan_rules() does with a list of them, with their project.

    classes, methods: as for the detectors, with `project`; rules: rules_in_force(). The first rule in order names an entry.
    """
    members = ["project", "owner", "name", "descriptor"]
    a, inner = F.col("access"), F.replace(F.trim("value"), F.lit("."), F.lit("/"))
    classes = detect.project_classes(classes).join(excluded_classes(classes, rules), ["project", "class_name"], "left_anti")
    rules = rules.filter("value <> ''").select("project", "ord", "kind", F.col("value"), "recursive", F.coalesce(F.when(F.col("name") != "", F.col("name")), F.col("kind")).alias("_label"))
    own = classes.select("project", F.col("class_name").alias("owner"), sig.class_name(F.col("class_name")).alias("_fqn"), sig.simple_name(F.col("class_name")).alias("_simple"), "super_name", "interfaces", F.col("annotations").alias("_marks"))
    of = lambda kind: rules.filter(F.col("kind") == kind)
    hit = ["project", "owner", "ord", "_label"]
    # Classes by the name of a package above them, an annotation, or a type that they are or extend directly.
    folders = F.slice(F.split("_fqn", r"\."), F.lit(1), F.size(F.split("_fqn", r"\.")) - 1)
    above = F.transform(F.sequence(F.lit(1), F.size(folders)), lambda n: F.struct(F.array_join(F.slice(folders, F.lit(1), n), ".").alias("key"), (n == F.size(folders)).alias("own")))
    packages = own.filter(F.size(folders) > 0).select("project", "owner", F.inline(above)).withColumnRenamed("key", "_value")
    found = [packages.join(of("PACKAGE").withColumn("_value", F.trim("value")), ["project", "_value"]).filter(F.col("recursive") | F.col("own")).select(*hit)]
    marks = own.select("project", "owner", F.explode(F.transform("_marks", lambda x: x.getField("name"))).alias("_value"))
    found.append(marks.join(of("ANNOTATION_CLASS").withColumn("_value", inner), ["project", "_value"]).select(*hit))
    types = own.select("project", "owner", F.explode(F.array_compact(F.concat(F.array("owner", "super_name"), F.coalesce("interfaces", F.array().cast("array<string>"))))).alias("_value"))
    found.append(types.join(of("INTERFACE_IMPLEMENT").withColumn("_value", inner), ["project", "_value"]).select(*hit))
    for dotted, name in ((True, "_fqn"), (False, "_simple")):
        named = _wild(of("CLASS_NAME").filter(F.contains("value", F.lit(".")) == dotted), "value")
        keyed = own.select("project", "owner", F.col(name).alias("_text"), F.explode(text_keys(F.col(name))).alias("_key"))
        found.append(keyed.join(named, ["project", "_key"]).filter(F.rlike("_text", F.col("_regex"))).select(*hit))
    by_class = found[0]
    for more in found[1:]:
        by_class = by_class.unionByName(more)
    by_class = by_class.groupBy("project", "owner").agg(F.min(F.struct("ord", "_label")).alias("_class"))
    able = methods.filter(~F.col("name").startswith("<") & sig.is_public(a) & ~sig.is_synthetic_or_bridge(a) & sig.is_concrete(a)).join(own.select("project", "owner"), ["project", "owner"], "left_semi")
    able = able.select(*members, "annotations").dropDuplicates(members)
    marked = able.select(*members, F.explode(F.transform("annotations", lambda x: x.getField("name"))).alias("_value"))
    by_method = marked.join(of("ANNOTATION_METHOD").withColumn("_value", inner), ["project", "_value"]).select(*members, "ord", "_label")
    keyed = able.select(*members, F.explode(text_keys(F.col("name"))).alias("_key"))
    named = keyed.join(_wild(of("METHOD_NAME"), "value"), ["project", "_key"]).filter(F.rlike("name", F.col("_regex"))).select(*members, "ord", "_label")
    by_method = by_method.unionByName(named).groupBy(*members).agg(F.min(F.struct("ord", "_label")).alias("_method"))
    rows = able.drop("annotations").join(by_class, ["project", "owner"], "left").join(by_method, members, "left").withColumn("_first", F.least("_class", "_method")).filter("_first IS NOT NULL")
    display = F.concat(F.lit("["), F.col("_first._label"), F.lit("] "), F.col("name"))
    return rows.select("project", F.lit("RULE").alias("type"), sig.class_name(F.col("owner")).alias("class_name"), F.col("name").alias("method_name"), "descriptor", display.alias("display"))


def scan_fleet(classes: DataFrame, methods: DataFrame, force: DataFrame, rules: DataFrame) -> DataFrame:
    """The entries of all projects by their profiles: of each detector that is on there (unset is on), and of the profile's rules.

    classes, methods: as for the detectors, with `project`; force: profiles_in_force(); rules: rules of profiles. A detector runs once
    for all projects, over names that carry their project. (project, type, class_name, method_name, descriptor, display, place).
    """
    code = F.md5(F.col("project").cast("string"))
    tag = lambda column: F.concat(code, F.lit(MARK), column)
    above = lambda column: F.when(column.isin(*detect.KNOWN_TYPES), column).otherwise(tag(column))
    force = cut(force)
    known = force.select("project")
    own, members = cut(classes.join(known, "project", "left_semi")), cut(methods.join(known, "project", "left_semi"))
    parts = []
    for kind, (_, find) in detect.DETECTORS.items():
        on = force.filter(F.coalesce(F.element_at("detectors", F.lit(kind)), F.lit(True))).select("project")
        there = own.join(on, "project", "left_semi").withColumns({"class_name": tag(F.col("class_name")), "super_name": above(F.col("super_name")), "interfaces": F.transform("interfaces", above)})
        found = find(there.drop("project"), members.join(on, "project", "left_semi").withColumn("owner", tag(F.col("owner"))).drop("project"))
        found = found.withColumn("_code", F.substring_index("class_name", MARK, 1)).join(on.select("project", code.alias("_code")), "_code").drop("_code")
        parts.append(found.withColumns({"class_name": F.substring_index("class_name", MARK, -1), "display": F.regexp_replace("display", f"[0-9a-f]{{32}}{MARK}", "")}))
    parts.append(scan_fleet_rules(own, members, cut(rules_in_force(force, rules))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return detect.with_place(out).select("project", *detect.ENTRY, "place")
