"""Entry detection over tables of classes, methods and their annotations.

classes: (class_name with slashes, super_name, interfaces, access, source, annotations); methods: (owner, name,
descriptor, access, annotations). annotations: array of (name with slashes, values as a map of lists).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.functions import sig
from callscope.operators.resolve import subtype_closure

#: Annotations and interfaces that mark entries.
SPRING = "org/springframework/web/bind/annotation/"
CONTROLLERS = (SPRING + "RestController", SPRING + "Controller")
VERBS = ("GET", "POST", "PUT", "DELETE", "PATCH")
SERVICES = ("org/apache/dubbo/config/annotation/DubboService", "org/apache/dubbo/config/annotation/Service", "com/alibaba/dubbo/config/annotation/Service")
JOBS = ("com/dangdang/ddframe/job/api/simple/SimpleJob", "org/apache/shardingsphere/elasticjob/simple/job/SimpleJob")
MAIN = "([Ljava/lang/String;)V"
#: The groups of a full scan, in order.
GROUPS = ("REST", "DUBBO", "ELASTIC_JOB", "MAIN", "RULE")

ENTRY = ["type", "class_name", "method_name", "descriptor", "display"]
DETECTORS: dict[str, tuple[str, Callable[[DataFrame, DataFrame], DataFrame]]] = {}


#: Types outside of the projects that detectors look for above classes.
KNOWN_TYPES: set[str] = set()


def register_detector(kind: str, label: str, detect: Callable[[DataFrame, DataFrame], DataFrame], types: Sequence[str] = ()) -> None:
    """Adds a detector: (classes, methods) to a frame of ENTRY columns. types: the types that it looks for above classes, if any."""
    DETECTORS[kind] = (label, detect)
    KNOWN_TYPES.update(types)


def annotation(column: Column, name: str) -> Column:
    """The annotation of that name, or null."""
    return F.get(F.filter(column, lambda a: a.getField("name") == name), F.lit(0))


def first_value(found: Column, key: str) -> Column:
    return F.get(F.element_at(found.getField("values"), F.lit(key)), F.lit(0))


def mapping_path(found: Column) -> Column:
    value = first_value(found, "value")
    return F.coalesce(F.when(F.coalesce(value, F.lit("")) != "", value), first_value(found, "path"), F.lit(""))


def project_classes(classes: DataFrame) -> DataFrame:
    return classes.filter((F.col("source") == "PROJECT") & ~sig.is_interface(F.col("access")) & ~sig.is_abstract(F.col("access")))


def _members(classes: DataFrame, methods: DataFrame) -> DataFrame:
    """Methods that are no constructors, beside their class's columns (c_…)."""
    own = classes.select(F.col("class_name").alias("owner"), *[F.col(c).alias(f"c_{c}") for c in classes.columns if c != "class_name"])
    return methods.filter(~F.col("name").startswith("<")).join(own, "owner")


def _entries(rows: DataFrame, kind: str, display: Column) -> DataFrame:
    return rows.select(F.lit(kind).alias("type"), sig.class_name(F.col("owner")).alias("class_name"), F.col("name").alias("method_name"), "descriptor", display.alias("display"))


def detect_rest(classes: DataFrame, methods: DataFrame) -> DataFrame:
    """Methods with a mapping in controller classes; display: verb and path."""
    marked = project_classes(classes).filter(F.exists("annotations", lambda a: a.getField("name").isin(*CONTROLLERS)))
    rows = _members(marked, methods).filter(~sig.is_synthetic_or_bridge(F.col("access")))
    own = [(v, annotation(F.col("annotations"), f"{SPRING}{v.capitalize()}Mapping")) for v in VERBS]
    plain = annotation(F.col("annotations"), SPRING + "RequestMapping")
    found = F.coalesce(*[a for _, a in own], plain)
    verb = F.coalesce(*[F.when(a.isNotNull(), F.lit(v)) for v, a in own], first_value(plain, "method"), F.lit("ANY"))
    base = mapping_path(annotation(F.col("c_annotations"), SPRING + "RequestMapping"))
    return _entries(rows.filter(found.isNotNull()), "REST", F.concat(verb, F.lit(" "), sig.join_path(base, mapping_path(found))))


def detect_dubbo(classes: DataFrame, methods: DataFrame) -> DataFrame:
    """Public instance methods of service classes; display: the service's interface and the method."""
    service = F.coalesce(*[annotation(F.col("annotations"), s) for s in SERVICES])
    rows = _members(project_classes(classes).withColumn("service", service).filter("service IS NOT NULL"), methods)
    rows = rows.filter(sig.is_public(F.col("access")) & ~sig.is_static(F.col("access")) & ~sig.is_synthetic_or_bridge(F.col("access")))
    face, name = first_value(F.col("c_service"), "interfaceClass"), first_value(F.col("c_service"), "interfaceName")
    dotted = F.replace(F.regexp_extract(face, "^L(.*);$", 1), F.lit("/"), F.lit("."))
    api = F.when(F.coalesce(dotted, F.lit("")).isin("", "java.lang.Void", "void"), F.when(~F.coalesce(name, F.lit("")).isin("", "void"), name)).otherwise(dotted)
    return _entries(rows, "DUBBO", F.concat(F.lit("dubbo: "), F.coalesce(api, sig.class_name(F.col("owner"))), F.lit("#"), F.col("name")))


def detect_jobs(classes: DataFrame, methods: DataFrame) -> DataFrame:
    """Concrete execute methods of subtypes of a job interface."""
    jobs = subtype_closure(classes).filter(F.col("ancestor").isin(*JOBS)).select("class_name").distinct()
    rows = _members(project_classes(classes).join(jobs, "class_name", "left_semi"), methods).filter((F.col("name") == "execute") & sig.is_concrete(F.col("access")))
    return _entries(rows, "ELASTIC_JOB", F.concat(F.lit("job: "), sig.class_name(F.col("owner")), F.lit("#execute")))


def detect_main(classes: DataFrame, methods: DataFrame) -> DataFrame:
    own = classes.filter((F.col("source") == "PROJECT") & ~sig.has_flag(F.col("access"), sig.INTERFACE | sig.ENUM)).select(F.col("class_name").alias("owner"))
    rows = methods.filter((F.col("name") == "main") & (F.col("descriptor") == MAIN) & sig.is_public(F.col("access")) & sig.is_static(F.col("access")))
    return _entries(rows.join(own, "owner", "left_semi"), "MAIN", F.concat(F.lit("main: "), sig.class_name(F.col("owner"))))


register_detector("REST", "REST 接口", detect_rest)
register_detector("DUBBO", "Dubbo 服务", detect_dubbo)
register_detector("ELASTIC_JOB", "ElasticJob 作业", detect_jobs, JOBS)
register_detector("MAIN", "main 启动类", detect_main)


@dataclass(frozen=True)
class ScanRule:
    """A user's rule. kind: ANNOTATION_METHOD, ANNOTATION_CLASS, PACKAGE, INTERFACE_IMPLEMENT, CLASS_NAME, METHOD_NAME."""

    name: str
    kind: str | None
    value: str = ""
    recursive: bool = True
    excludes: Sequence[str] = field(default_factory=tuple)
    enabled: bool = True

    def matches(self) -> Column:
        """Over the rows of _members()."""
        fqn, inner = sig.class_name(F.col("owner")), self.value.strip().replace(".", "/")
        if not self.value:
            return F.lit(False)
        if self.kind == "ANNOTATION_METHOD":
            return F.exists("annotations", lambda a: a.getField("name") == inner)
        if self.kind == "ANNOTATION_CLASS":
            return F.exists("c_annotations", lambda a: a.getField("name") == inner)
        if self.kind == "PACKAGE":
            package = self.value.strip()
            return fqn.startswith(package + ".") if self.recursive else F.regexp_extract(fqn, r"^(.*)\.[^.]*$", 1) == package
        if self.kind == "INTERFACE_IMPLEMENT":
            return (F.col("owner") == inner) | F.coalesce(F.col("c_super_name") == inner, F.lit(False)) | F.array_contains("c_interfaces", inner)
        if self.kind == "CLASS_NAME":
            return sig.wildcard_match(fqn if "." in self.value else sig.simple_name(F.col("owner")), self.value)
        return sig.wildcard_match(F.col("name"), self.value) if self.kind == "METHOD_NAME" else F.lit(False)


def scan_rules(classes: DataFrame, methods: DataFrame, rules: Sequence[ScanRule]) -> DataFrame:
    """Public concrete methods that a rule matches; the first rule names each. One pass, no shuffle but the join."""
    active = [r for r in rules if r.enabled and r.kind]
    excludes = [sig.wildcard_match(sig.class_name(F.col("class_name")), e) for r in active for e in r.excludes if e]
    wanted = project_classes(classes)
    for e in excludes:
        wanted = wanted.filter(~e)
    a = F.col("access")
    rows = _members(wanted, methods).filter(sig.is_public(a) & ~sig.is_synthetic_or_bridge(a) & sig.is_concrete(a))
    rule = F.coalesce(F.lit(None).cast("string"), *[F.when(F.coalesce(r.matches(), F.lit(False)), F.lit(r.name or r.kind)) for r in active])
    rows = rows.withColumn("_rule", rule).filter("_rule IS NOT NULL")
    return _entries(rows, "RULE", F.concat(F.lit("["), F.col("_rule"), F.lit("] "), F.col("name"))).dropDuplicates(["class_name", "method_name", "descriptor"])


def scan_entries(classes: DataFrame, methods: DataFrame, detectors: dict[str, bool], rules: Sequence[ScanRule] = ()) -> DataFrame:
    """All entries of the detectors that are on (unset is on) and of the rules, with their group's place."""
    parts = [f(classes, methods) for kind, (_, f) in DETECTORS.items() if detectors.get(kind, True)]
    parts += [scan_rules(classes, methods, rules)] if rules else []
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return with_place(out)


def with_place(entries: DataFrame) -> DataFrame:
    """entries with their group's place in a full scan."""
    place = F.array_position(F.array(*[F.lit(g) for g in GROUPS]), F.col("type"))
    return entries.withColumn("place", F.when(place == 0, len(GROUPS) + 1).otherwise(place).cast("int"))


def scan_groups(entries: DataFrame) -> DataFrame:
    return entries.groupBy("type", "place").agg(F.count(F.lit(1)).alias("n"))


def effective_profiles(projects: DataFrame, profiles: DataFrame, global_active: str = "standard") -> DataFrame:
    """(project, profile_id, detector_main): the profile in force of each project, with one of its switches.

    projects: (project, active_id, has_custom); profiles: (project or null for global, id, builtin, ord, detector_main). The choice is that of
    fleet.profiles_in_force(), which gives whole profiles. An unset detector is on.
    """
    from callscope.operators.fleet import profiles_in_force

    switches = F.when(F.col("detector_main").isNotNull(), F.create_map(F.lit("MAIN"), F.col("detector_main")))
    found = profiles_in_force(projects, profiles.withColumn("detectors", switches), global_active)
    return found.select("project", "profile_id", F.coalesce(F.element_at("detectors", F.lit("MAIN")), F.lit(True)).alias("detector_main"))
