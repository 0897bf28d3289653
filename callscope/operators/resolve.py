"""Classes, hierarchies, and the resolution of calls to their targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callscope.functions import sig
from callscope.operators.base import cut, spread_join, stored

KEY = ["owner", "name", "descriptor"]


def dedup_classes(classes: DataFrame) -> DataFrame:
    """The first definition of each class: project before dependency, then in class-path order."""
    rank = F.when(F.col("source") == "PROJECT", 0).when(F.col("source") == "DEPENDENCY", 1).otherwise(2)
    first = F.row_number().over(Window.partitionBy("class_name").orderBy(rank, "classpath_ord"))
    return classes.withColumn("_r", first).filter("_r = 1").drop("_r")


def parent_table(classes: DataFrame) -> DataFrame:
    """(class_name, parent, idx): the superclass with index -1, interfaces with theirs."""
    above = classes.select("class_name", F.col("super_name").alias("parent"), F.lit(-1).alias("idx"))
    faces = classes.select("class_name", F.posexplode("interfaces").alias("idx", "parent")).select("class_name", "parent", "idx")
    return above.unionByName(faces).filter("parent IS NOT NULL")


def subtype_closure(classes: DataFrame) -> DataFrame:
    """(class_name, ancestor): every class with itself and all it extends or implements, known or not."""
    parents = cut(parent_table(classes).select("class_name", "parent").distinct())
    seen = level = cut(classes.select("class_name", F.col("class_name").alias("ancestor")).distinct())
    while True:
        up = level.join(parents.withColumnRenamed("class_name", "ancestor"), "ancestor").select("class_name", F.col("parent").alias("ancestor")).distinct()
        level = cut(up.join(seen, ["class_name", "ancestor"], "left_anti"))
        if level.isEmpty():
            return seen
        seen = seen.unionByName(level)


def dispatch_targets(wanted: DataFrame, classes: DataFrame, methods: DataFrame, closure: DataFrame) -> DataFrame:
    """(owner, name, descriptor, target): the implementations of interface or abstract methods.

    Targets are classes that are neither interfaces nor abstract, declare the method concretely themselves,
    and are subtypes of the owner. A method without one falls back to the owner's own concrete body.
    """
    solid = classes.filter(~sig.is_interface(F.col("access")) & ~sig.is_abstract(F.col("access"))).select(F.col("class_name").alias("target"))
    bodies = methods.filter(sig.is_concrete(F.col("access"))).select(F.col("owner").alias("target"), "name", "descriptor")
    below = closure.select(F.col("ancestor").alias("owner"), F.col("class_name").alias("target"))
    wanted = wanted.select(*KEY).distinct()
    # Subtypes of the owner first: joining bodies by name alone would pair every owner of a common name with every class that has it.
    below = below.join(solid, "target", "left_semi").distinct()
    found = wanted.join(below, "owner").join(bodies, ["target", "name", "descriptor"], "left_semi").select(*KEY, "target")
    own = wanted.join(bodies.withColumnRenamed("target", "owner"), KEY, "left_semi").join(found.select(*KEY).distinct(), KEY, "left_anti")
    return found.unionByName(own.withColumn("target", F.col("owner")))


def resolve_calls(calls: DataFrame, classes: DataFrame, methods: DataFrame) -> DataFrame:
    """(owner, name, descriptor, kind, target) of distinct call signatures; a row for each target. See resolve_ways()."""
    one, ways, targets = resolve_ways(calls, classes, methods)
    multi = spread_join(ways, targets, ["via", "name", "descriptor"], "target").select(*KEY, F.lit("MULTI").alias("kind"), "target")
    return one.unionByName(multi)


def resolve_ways(calls: DataFrame, classes: DataFrame, methods: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What resolve_calls() gives, before calls of many targets are paired with them, which many calls share.

    (owner, name, descriptor, kind, target) of SINGLE and EXTERNAL signatures; (owner, name, descriptor, via) of MULTI ones;
    (via, name, descriptor, target), distinct.

    JDK owners are dropped; unknown owners are EXTERNAL. The superclass chain is searched first, then interfaces
    breadth-first in declaration order. The first class that declares the method concretely is the SINGLE target; one that
    declares it without a body is remembered, if first, and its parents are not searched. Without a concrete
    hit: an interface owner with implementations, or the remembered class with implementations, is MULTI; a
    remembered class without any is EXTERNAL; else the call is EXTERNAL if an unknown class was met, and
    dropped if not.
    """
    sigs = calls.select(*KEY).distinct().filter(~sig.is_jdk(F.col("owner")))
    known = classes.select(F.col("class_name").alias("cls"), F.col("access").alias("cls_access"))
    parents = cut(parent_table(classes))
    declared = methods.select(F.col("owner").alias("cls"), "name", "descriptor", sig.is_concrete(F.col("access")).alias("concrete"))
    # Visit order: the superclass chain by depth, then interfaces by level and by the path that leads to them.
    level = cut(sigs.withColumn("cls", F.col("owner")).withColumn("chain", F.lit(True)).withColumn("at", F.array(F.lit(0))))
    seen = hits = None
    while not level.isEmpty():
        level = level.join(known, "cls", "left").join(declared, ["cls", "name", "descriptor"], "left")
        order = F.struct(F.when(F.col("chain"), 0).otherwise(1).alias("a"), F.size("at").alias("b"), F.col("at").alias("c"))
        level = level.withColumn("order", order)
        kind = F.when(F.col("cls_access").isNull(), F.when(sig.is_jdk(F.col("cls")), "jdk").otherwise("unknown")).when(F.col("concrete"), "concrete").when(F.col("concrete") == False, "abstract").otherwise("pass")  # noqa: E712
        level = cut(level.withColumn("kind", kind).select(*KEY, "cls", "chain", "at", "order", "kind"))
        hits = level.filter("kind <> 'pass'") if hits is None else hits.unionByName(level.filter("kind <> 'pass'"))
        seen = level.select(*KEY, "cls") if seen is None else seen.unionByName(level.select(*KEY, "cls"))
        up = level.filter("kind = 'pass'").join(parents.withColumnRenamed("class_name", "cls"), "cls")
        up = up.select(*KEY, F.col("parent").alias("cls"), (F.col("chain") & (F.col("idx") < 0)).alias("chain"), F.when(F.col("chain") & (F.col("idx") < 0), F.array(F.element_at("at", 1) + 1)).otherwise(F.concat("at", F.array(F.col("idx")))).alias("at"))
        first = F.row_number().over(Window.partitionBy(*KEY, "cls").orderBy(F.desc("chain"), F.size("at"), "at"))
        level = cut(up.withColumn("_r", first).filter("_r = 1").drop("_r").join(seen, [*KEY, "cls"], "left_anti"))
    best = hits.groupBy(*KEY).agg(
        F.min_by(F.when(F.col("kind") == "concrete", F.col("cls")), F.when(F.col("kind") == "concrete", F.col("order"))).alias("concrete"),
        F.min_by(F.when(F.col("kind") == "abstract", F.col("cls")), F.when(F.col("kind") == "abstract", F.col("order"))).alias("abstract"),
        F.max(F.col("kind") == "unknown").alias("unknown"),
    )
    faces = classes.filter(sig.is_interface(F.col("access"))).select(F.col("class_name").alias("owner"), F.lit(True).alias("face"))
    best = cut(sigs.join(best, KEY, "left").join(faces, "owner", "left"))
    single = best.filter("concrete IS NOT NULL").select(*KEY, F.lit("SINGLE").alias("kind"), F.col("concrete").alias("target"))
    rest = best.filter("concrete IS NULL")
    closure = subtype_closure(classes)
    ways = rest.filter("face").select(*KEY, F.lit(0).alias("way"), F.col("owner").alias("via")).unionByName(rest.filter("abstract IS NOT NULL").select(*KEY, F.lit(1).alias("way"), F.col("abstract").alias("via")))
    targets = dispatch_targets(ways.select(F.col("via").alias("owner"), "name", "descriptor"), classes, methods, closure).withColumnRenamed("owner", "via")
    targets = stored(targets)
    # The first way with targets is known before the pairs of calls and targets are made, which are many and distinct.
    open_ways = ways.join(targets.select("via", "name", "descriptor").distinct(), ["via", "name", "descriptor"], "left_semi")
    chosen = stored(open_ways.groupBy(*KEY).agg(F.min_by("via", "way").alias("via")))
    external = rest.join(chosen.select(*KEY), KEY, "left_anti").filter("abstract IS NOT NULL OR unknown")
    external = external.select(*KEY, F.lit("EXTERNAL").alias("kind"), F.col("owner").alias("target"))
    return single.unionByName(external), chosen, targets


def with_source(rows: DataFrame, known: DataFrame, method: str = "method_id") -> DataFrame:
    """Each row with the source of its method, EXTERNAL where the method is not known. known: (method_id, source)."""
    sources = known.select(F.col("method_id").alias(method), F.col("source").alias("_source"))
    found = rows.drop("source").join(sources, method, "left")
    return found.withColumn("source", F.coalesce("_source", F.lit("EXTERNAL"))).drop("_source")


def project_counts(classes: DataFrame) -> DataFrame:
    """(source, n_classes, n_locations): how many classes, and directories or jars, a project has by source."""
    return classes.groupBy("source").agg(F.count(F.lit(1)).alias("n_classes"), F.count_distinct("location").alias("n_locations"))


def filter_source(rows: DataFrame, source: str | None) -> DataFrame:
    """Rows of one source, in any case; ALL, empty and null mean no limit."""
    if not source or source.upper() == "ALL":
        return rows
    return rows.filter(F.upper("source") == source.upper())


def resolve_class_names(queries: DataFrame, classes: DataFrame) -> DataFrame:
    """(query, outcome, class_name): a class by full name, else by a simple name that only one class has.

    classes: (class_name with dots). outcome: exact, simple, ambiguous (class_name lists the candidates), missing.
    """
    names = classes.select("class_name").distinct()
    simple = names.groupBy(F.regexp_extract("class_name", r"([^.]*)$", 1).alias("query")).agg(F.array_sort(F.collect_list("class_name")).alias("all"))
    found = queries.distinct().join(names.select(F.col("class_name").alias("query"), F.lit(True).alias("exact")), "query", "left").join(simple, "query", "left")
    outcome = F.when(F.col("exact"), "exact").when(F.size("all") == 1, "simple").when(F.size("all") > 1, "ambiguous").otherwise("missing")
    return found.select("query", outcome.alias("outcome"), F.when(F.col("exact"), F.col("query")).otherwise(F.array_join("all", ",")).alias("class_name"))


def resolve_entry_roots(entries: DataFrame, methods: DataFrame) -> DataFrame:
    """(entry_id, method_id): the root methods of entries (entry_id, class_name, method_name, descriptor).

    Without a method name: all methods that are not synthetic or bridges; with one: all overloads, or the one with
    the entry's descriptor if there is such a one. methods: (method_id, class_name, name, descriptor, access).
    """
    asked = entries.select("entry_id", "class_name", "method_name", "descriptor")
    m = methods.select("method_id", "class_name", F.col("name").alias("method_name"), "descriptor", "access")
    # Each case is a join by equal keys, so that no pair of an entry and a method that it does not have is made, and none is compared with others.
    exact = asked.join(m.drop("access"), ["class_name", "method_name", "descriptor"]).select("entry_id", "method_id")
    loose = asked.join(exact.select("entry_id").distinct(), "entry_id", "left_anti").drop("descriptor")
    plain = m.filter(~sig.is_synthetic_or_bridge(F.col("access"))).select("class_name", "method_id")
    whole = spread_join(loose.filter("method_name IS NULL").select("entry_id", "class_name"), plain, ["class_name"], "method_id")
    named = spread_join(loose.filter("method_name IS NOT NULL"), m.select("class_name", "method_name", "method_id"), ["class_name", "method_name"], "method_id")
    return exact.unionByName(whole.select("entry_id", "method_id")).unionByName(named.select("entry_id", "method_id"))


def verify_entries(entries: DataFrame, methods: DataFrame) -> DataFrame:
    """(entry_id, status, class_name, candidates, available, overloads, n_overloads) of entries.

    entries: (entry_id, class_name, method_name, descriptor); methods: (class_name with dots, name, descriptor). A class is
    found by its full name, else by a simple name that only one class has; CLASS_AMBIGUOUS lists the candidates,
    CLASS_MISSING has none. Without a method name the status is OK. METHOD_MISSING lists the class's method names.
    With a descriptor: EXACT or MISMATCH; without: UNIQUE with the one descriptor, or OVERLOADS with all of them.
    """
    names = resolve_class_names(entries.select(F.col("class_name").alias("query")), methods)
    found = entries.select("entry_id", F.col("class_name").alias("query"), "method_name", "descriptor").join(names, "query", "left")
    is_known = F.coalesce(F.col("outcome").isin("exact", "simple"), F.lit(False))
    found = found.select("entry_id", "method_name", "descriptor", "outcome", F.when(is_known, F.col("class_name")).alias("class_name"), F.when(F.col("outcome") == "ambiguous", F.col("class_name")).alias("candidates"))
    own = methods.groupBy("class_name", F.col("name").alias("method_name")).agg(F.array_sort(F.collect_set("descriptor")).alias("overloads"))  # of one method
    listed = own.groupBy("class_name").agg(F.array_sort(F.collect_set("method_name")).alias("all_names"))  # of one class
    found = found.join(own, ["class_name", "method_name"], "left").join(listed, "class_name", "left")
    named, n = F.coalesce(F.col("method_name"), F.lit("")) != "", F.coalesce(F.size("overloads"), F.lit(0))
    n = F.when(F.col("overloads").isNull(), 0).otherwise(n)
    exact = F.coalesce(F.array_contains("overloads", F.col("descriptor")), F.lit(False))
    described = F.coalesce(F.col("descriptor"), F.lit("")) != ""
    status = (
        F.when(F.col("outcome") == "ambiguous", "CLASS_AMBIGUOUS").when(F.col("class_name").isNull(), "CLASS_MISSING").when(~named, "OK")
        .when(described, F.when(exact, "EXACT").otherwise("MISMATCH")).when(n == 0, "METHOD_MISSING").when(n == 1, "UNIQUE").otherwise("OVERLOADS")
    )
    text = lambda when, c: F.when(F.col("status") == when, F.array_join(c, ","))
    found = found.withColumn("status", status)
    overloads = F.when(F.col("status").isin("UNIQUE", "OVERLOADS"), F.array_join("overloads", ","))
    return found.select("entry_id", "status", "class_name", "candidates", text("METHOD_MISSING", "all_names").alias("available"), overloads.alias("overloads"), n.cast("long").alias("n_overloads"))


def raw_callers(sites: DataFrame, methods: DataFrame) -> DataFrame:
    """(method_id) of the methods with any call site, of the JDK too.

    sites: (caller_owner, caller_name, caller_descriptor); methods: (method_id, owner, name, descriptor).
    """
    own = sites.select(F.col("caller_owner").alias("owner"), F.col("caller_name").alias("name"), F.col("caller_descriptor").alias("descriptor")).distinct()
    return methods.join(own, KEY, "left_semi").select("method_id")
