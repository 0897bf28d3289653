"""Boilerplate rules: which methods of a call graph are noise, and why."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.functions.sig import split_signature


@dataclass(frozen=True)
class Rule:
    """A rule matches a method if all that it names match; empty means no limit."""

    id: str
    name: str
    method: str = ""
    cls: str = ""
    source: str = "ALL"
    params: int | None = None
    enabled: bool = True
    layer: str = "G"


#: The built-in rules.
BUILTIN = (
    Rule("factory", "单例/工厂", "getInstance|getBean|getBeanFactory|getInstance.*"),
    Rule("constructor", "构造器", "<init>"),
    Rule("object-method", "Object 方法", "toString|equals|hashCode|getClass|clone|finalize"),
    Rule("logging", "日志", "(info|debug|error|warn|trace|fatal)", ".*(Logger|Log|Slf4j).*"),
    Rule("lifecycle", "Spring 生命周期", "afterPropertiesSet|initMethod|destroy|initialize|dispose|onApplicationEvent|postProcess.*"),
    Rule("simple-getter", "简单 getter（0 参数，getXxx/isXxx）", "^(get|is)[A-Z]", "", "PROJECT", 0),
    Rule("simple-setter", "简单 setter（1 参数，setXxx）", "^set[A-Z]", "", "PROJECT", 1),
)
RULE_COLUMNS = ["id", "name", "method_pattern", "class_pattern", "source", "param_count", "enabled"]


def valid_patterns(spark: SparkSession, patterns: Sequence[str]) -> set[str]:
    """Those of the patterns that the regex engine behind rlike() accepts."""
    compiler, valid = spark._jvm.java.util.regex.Pattern, set()
    for pattern in set(patterns):
        try:
            compiler.compile(pattern)
            valid.add(pattern)
        except IllegalArgumentException:
            continue
    return valid


def usable(spark: SparkSession, rules: Sequence[Rule]) -> list[Rule]:
    """The rules whose patterns are valid; a bad pattern never matches."""
    valid = valid_patterns(spark, [p for r in rules for p in (r.method, r.cls) if p])
    return [r for r in rules if all(p in valid for p in (r.method, r.cls) if p)]


def matches(rule: Rule, sig: Column, source: Column) -> Column:
    """Whether one enabled rule matches a method, by its readable signature and source."""
    if not rule.enabled:
        return F.lit(False)
    parts = split_signature(sig)
    found = F.lit(True)
    if rule.source and rule.source.upper() != "ALL":
        found = found & (F.upper(source) == rule.source.upper())
    if rule.method:
        found = found & parts.getField("method_name").rlike(rule.method)
    if rule.cls:
        found = found & parts.getField("class_name").rlike(rule.cls)
    if rule.params is not None:
        found = found & (parts.getField("param_count") == rule.params)
    return F.coalesce(found, F.lit(False))


def is_noise(rules: Sequence[Rule], sig: Column, source: Column) -> Column:
    """Whether any rule matches. Evaluate it on distinct methods."""
    found = F.lit(False)
    for rule in rules:
        found = found | matches(rule, sig, source)
    return found


def matched_rules(rules: Sequence[Rule], sig: Column, source: Column) -> Column:
    """Names of the rules that match, in rule order, each with its layer."""
    names = F.array(*[F.when(matches(r, sig, source), F.lit(f"[{r.layer}] {r.name}")) for r in rules])
    return F.array_join(F.array_compact(names), ", ")


def effective_rules(global_rules: DataFrame, overrides: DataFrame, custom: DataFrame) -> DataFrame:
    """Rules in force by project: global ones with the project's own `enabled`, and its custom rules.

    global_rules: RULE_COLUMNS; overrides: (project, id, enabled); custom: (project, RULE_COLUMNS).
    Projects are those of overrides and custom.
    """
    projects = overrides.select("project").union(custom.select("project")).distinct()
    changed = overrides.select("project", F.col("id").alias("_id"), F.col("enabled").alias("_enabled"))
    listed = global_rules.agg(F.collect_list(F.struct(*RULE_COLUMNS)).alias("_rules"))  # tens of rules
    base = projects.join(listed, F.lit(True)).select("project", F.inline("_rules"))
    base = base.alias("b").join(changed.alias("o"), (F.col("b.project") == F.col("o.project")) & (F.col("b.id") == F.col("_id")), "left")
    base = base.select("b.project", F.lit("G").alias("layer"), *[F.col(f"b.{c}") for c in RULE_COLUMNS[:-1]], F.coalesce("_enabled", "b.enabled").alias("enabled"))
    return base.unionByName(custom.select("project", F.lit("P").alias("layer"), *RULE_COLUMNS))


def merge_builtin_rules(stored: DataFrame, builtin: DataFrame) -> DataFrame:
    """Stored rules brought up to the built-in ones: bodies come from the built-ins, `enabled` from the store.

    Stored built-ins that are no longer known go; custom rules that equal a built-in in all but the id are
    absorbed; the other custom rules stay. stored has a `builtin` flag beside RULE_COLUMNS.
    """
    flags = stored.filter("builtin").select(F.col("id").alias("_id"), F.col("enabled").alias("_enabled"))
    kept = builtin.join(flags, F.col("id") == F.col("_id"), "left")
    kept = kept.select(*RULE_COLUMNS[:-1], F.coalesce("_enabled", "enabled").alias("enabled"), F.lit(True).alias("builtin"))
    body = ["name", "method_pattern", "class_pattern", "source", "param_count"]
    known = builtin.select(*[F.col(c).alias(f"_{c}") for c in body])
    same = F.lit(True)
    for c in body:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    custom = stored.filter("NOT builtin").join(known, same, "left_anti")
    return kept.unionByName(custom.select(*RULE_COLUMNS, F.lit(False).alias("builtin")))


def escape_regex(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\.\[\]{}()*+?^$|])", r"\\$1")


def rule_from_method(methods: DataFrame, stored: DataFrame) -> DataFrame:
    """An exact rule for each method row (sig, source), unless stored has an equal one."""
    parts = split_signature(F.col("sig"))
    exact = lambda c: F.concat(F.lit("^"), escape_regex(parts.getField(c)), F.lit("$"))
    made = methods.select(F.col("sig").alias("name"), exact("method_name").alias("method_pattern"), exact("class_name").alias("class_pattern"), "source", parts.getField("param_count").alias("param_count")).distinct()
    same = F.lit(True)
    for c in ("method_pattern", "class_pattern", "source", "param_count"):
        same = same & made[c].eqNullSafe(stored[c])
    return made.join(stored, same, "left_anti")
