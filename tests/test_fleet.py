"""Rules and profiles of many projects as tables, held against the forms that take one project's list."""

import random
import re

import pytest
from pyspark.sql import functions as F

from callscope.functions import rules
from callscope.functions.literals import is_pattern, required_keys, text_keys
from callscope.operators import detect, fleet

PATTERNS = ["^(get|is)[A-Z]", "toString|equals", "(info|debug)", "", "set.+", "a+bc", "ab?cde", "x{2}yzw", "[gs]etName", "get\\$x", "\\w+Bean", "abc*d", "(?i)INFO", "a|", "load|[", "(", "get[", "log(ger)?Name", "((info))", "\\Qa.b\\E", ".*Name$", "Nam[e]"]
NAMES = ["getName", "isOpen", "toString", "equals", "info", "debug", "setX", "aabc", "abcde", "acde", "xxyzw", "setName", "get$x", "someBean", "abd", "loggerName", "logName", "", "<init>", "load", "Names"]


def test_a_match_has_a_required_key():
    for pattern in PATTERNS:
        try:
            compiled = re.compile(pattern)
        except re.error:
            continue
        keys = required_keys(pattern)
        for name in NAMES:
            own = {""} | {name[i : i + 3] for i in range(len(name) - 2)}
            assert not compiled.search(name) or own & set(keys), (pattern, name)
    assert required_keys("toString|equals") == ["equ", "toS"] and required_keys("(info|debug)") == ["deb", "inf"] and required_keys("^set[A-Z]") == ["set"]
    assert required_keys("abc*def") == ["def"] and required_keys(None) == [""] and required_keys("a\\.bcd") == ["a.b"]


def test_keys_of_texts_and_validity_of_patterns(spark):
    rows = spark.createDataFrame([("abcab",), ("ab",), ("",)], "t string")
    assert [sorted(r[0]) for r in rows.select(text_keys(F.col("t"))).collect()] == [["", "abc", "bca", "cab"], [""], [""]]
    rows = spark.createDataFrame([("a",), ("(",), ("[a",), (None,)], "t string")
    assert [r[0] for r in rows.select(is_pattern(F.col("t"))).collect()] == [True, False, False, False]


def test_rules_of_projects_equal_their_lists(spark):
    rng = random.Random(3)
    made, table = {}, []
    for project in ("p1", "p2", "p3", None):
        own = [rules.Rule(f"r{k:02}", f"n{k}", rng.choice(PATTERNS), rng.choice(["", "", "com[.]A", "B$", "(", "x.y"]), rng.choice(["ALL", "PROJECT", "project", ""]), rng.choice([None, None, 0, 1]), rng.random() < 0.8, rng.choice("GP")) for k in range(14)]
        made[project] = sorted(own, key=lambda r: (r.layer, r.id))
        table += [(project, r.layer, r.id, r.name, r.method or None, r.cls, r.source, r.params, r.enabled) for r in own]
    methods = [(p, f"{c}#{n}({a})", s, 1) for p in ("p1", "p2", "p3", "p4", None) for c in ("com.A", "x.B", "x.y.C") for n in NAMES for a in ("", "int") for s in ("PROJECT", None)]
    methods += [("p1", None, "PROJECT", 2), methods[0]]
    rows = spark.createDataFrame(methods, "project string, sig string, source string, noise int")
    table = spark.createDataFrame(table, "project string, layer string, id string, name string, method_pattern string, class_pattern string, source string, param_count int, enabled boolean")
    found = fleet.apply_rules(rows, table)
    assert found.count() == len(methods)
    for project in ("p1", "p2", "p3"):
        usable = rules.usable(spark, made[project])
        own = found.filter(F.col("project") == project)
        wanted = own.select("noise", "rules", rules.is_noise(usable, F.col("sig"), F.col("source")).alias("n"), rules.matched_rules(usable, F.col("sig"), F.col("source")).alias("r")).collect()
        assert any(r["n"] for r in wanted) and all((r["noise"], r["rules"]) == (r["n"], r["r"]) for r in wanted)
    rest = found.filter("project IS NULL OR project = 'p4'").collect()
    assert not any(r["noise"] or r["rules"] for r in rest)


def test_no_rules_and_no_methods(spark):
    rows = spark.createDataFrame([("p", "a.B#m()", None)], "project string, sig string, source string")
    table = spark.createDataFrame([], "project string, layer string, id string, name string, method_pattern string, class_pattern string, source string, param_count int, enabled boolean")
    assert [(r["noise"], r["rules"]) for r in fleet.apply_rules(rows, table).collect()] == [(False, "")]
    assert fleet.apply_rules(rows.limit(0), table).count() == 0


KIND = "array<struct<name:string,values:map<string,array<string>>>>"
TYPES = "project string, class_name string, super_name string, interfaces array<string>, access int, source string, annotations " + KIND
METHODS = "project string, owner string, name string, descriptor string, access int, annotations " + KIND
CHOICES = [
    detect.ScanRule("pack", "PACKAGE", "com.a"), detect.ScanRule("flat", "PACKAGE", " com.a ", recursive=False), detect.ScanRule("", "CLASS_NAME", "Ser*"), detect.ScanRule("fq", "CLASS_NAME", "com.**.Job1"),
    detect.ScanRule("m", "METHOD_NAME", "do*"), detect.ScanRule("am", "ANNOTATION_METHOD", "org.x.Do"), detect.ScanRule("ac", "ANNOTATION_CLASS", "org.x.Svc"), detect.ScanRule("if", "INTERFACE_IMPLEMENT", "com.a.Face"),
    detect.ScanRule("off", "PACKAGE", "com", enabled=False), detect.ScanRule("bad", "CLASS_NAME", "?"), detect.ScanRule("none", None, "x"), detect.ScanRule("empty", "PACKAGE", ""), detect.ScanRule("odd", "NO_KIND", "x"),
    detect.ScanRule("ex", "METHOD_NAME", "run", excludes=("**.Job2", "")), detect.ScanRule("every", "METHOD_NAME", "**"),
]


def world(seed):
    """Classes and methods of one project."""
    rng = random.Random(seed)
    job = detect.JOBS[0]
    classes, methods = [], []
    for k in range(14):
        name = rng.choice(["com/a/", "com/a/b/", "org/", ""]) + rng.choice(["Service", "Job", "Face"]) + str(k % 4) + ("" if k < 8 else f"x{k}")
        if name in {c[0] for c in classes}:
            continue
        marks = [(n, {}) for n in ("org/x/Svc", detect.CONTROLLERS[0], detect.SERVICES[0]) if rng.random() < 0.3]
        above = rng.choice([None, job, classes[0][0] if classes else None])
        classes.append((name, None, [x for x in (above, rng.choice([None, "com/a/Face"])) if x], rng.choice([1, 1, 1, 1537]), rng.choice(["PROJECT", "PROJECT", "DEPENDENCY"]), marks))
        for m in rng.sample(["doIt", "run", "execute", "main", "<init>", "get"], 4):
            own = [(n, {"value": ["/p"]}) for n in ("org/x/Do", detect.SPRING + "GetMapping") if rng.random() < 0.3]
            methods.append((name, m, detect.MAIN if m == "main" else "()V", rng.choice([1, 1, 9, 2, 1025]), own))
    return classes, methods


def test_profiles_of_projects_equal_single_scans(spark):
    rng = random.Random(5)
    projects = {f"p/{k}": world(k) for k in range(4)}
    chosen = {p: (rng.sample(CHOICES, 6), {d: False for d in detect.DETECTORS if rng.random() < 0.4}) for p in projects}
    classes = spark.createDataFrame([(p, *c) for p, (cs, _) in projects.items() for c in cs] + [("unknown", *world(1)[0][0])], TYPES)
    methods = spark.createDataFrame([(p, *m) for p, (_, ms) in projects.items() for m in ms], METHODS)
    force = spark.createDataFrame([(p, p, "own", off or None) for p, (_, off) in chosen.items()], "project string, owner string, profile_id string, detectors map<string,boolean>")
    table = [(p, "own", k, r.name, r.kind, r.value, r.recursive, list(r.excludes) or None, r.enabled) for p, (own, _) in chosen.items() for k, r in enumerate(own)]
    table = spark.createDataFrame(table, "project string, profile_id string, ord int, name string, kind string, value string, recursive boolean, excludes array<string>, enabled boolean")
    found = {}
    for r in fleet.scan_fleet(classes, methods, force, table).collect():
        found.setdefault(r["project"], []).append(tuple(r)[1:])
    assert found
    for p, (own, off) in chosen.items():
        one = detect.scan_entries(classes.filter(F.col("project") == p).drop("project"), methods.filter(F.col("project") == p).drop("project"), off, own)
        assert sorted(found.get(p, [])) == sorted(map(tuple, one.collect())), p


@pytest.mark.parametrize(
    ("active", "custom", "wanted"),
    [("strict", False, (None, "strict")), (None, False, (None, "standard")), ("", True, (None, "standard")), ("mine", True, ("p", "mine")), ("team", True, (None, "team")), ("gone", False, (None, "standard"))],
)
def test_profile_in_force(spark, active, custom, wanted):
    projects = spark.createDataFrame([("p", active, custom)], "project string, active_id string, has_custom boolean")
    rows = [(None, "standard", True, 0, None), (None, "strict", True, 1, {"MAIN": False}), (None, "team", False, 2, None)] + ([("p", "mine", False, 3, {"REST": False})] if custom else [])
    profiles = spark.createDataFrame(rows, "project string, id string, builtin boolean, ord int, detectors map<string,boolean>")
    assert [(r["owner"], r["profile_id"]) for r in fleet.profiles_in_force(projects, profiles).collect()] == [wanted]


def test_profile_in_force_without_a_standard_one(spark):
    projects = spark.createDataFrame([("p", "gone", True), ("q", "gone", False), ("r", None, False)], "project string, active_id string, has_custom boolean")
    profiles = spark.createDataFrame([(None, "team", False, 5, None), (None, "late", True, 7, None), ("p", "mine", False, 3, None)], "project string, id string, builtin boolean, ord int, detectors map<string,boolean>")
    assert {r["project"]: r["profile_id"] for r in fleet.profiles_in_force(projects, profiles).collect()} == {"p": "mine", "q": "team", "r": "team"}
