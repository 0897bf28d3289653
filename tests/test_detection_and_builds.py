"""Detectors, build files, entry lists and labels on a made-up lending library."""

import random

from pyspark.sql import functions as F

from callscope.operators import detect, entries, poms
from callscope.sources import files

MARKS = "array<struct<name:string,values:map<string,array<string>>>>"
CLASS = f"class_name string, super_name string, interfaces array<string>, access int, source string, annotations {MARKS}"
METHOD = f"owner string, name string, descriptor string, access int, annotations {MARKS}"
WEB = detect.SPRING


def web(spark):
    classes = [
        ("org/libris/web/Loans", None, [], 1, "PROJECT", [(WEB + "RestController", {}), (WEB + "RequestMapping", {"path": ["loans/"]})]),
        ("org/libris/web/Base", None, [], 0x401, "PROJECT", [(WEB + "RestController", {})]),
        ("org/libris/rpc/Stock", None, [], 1, "PROJECT", [(detect.SERVICES[1], {"interfaceName": ["org.libris.api.StockApi"]})]),
        ("org/libris/rpc/Fees", None, [], 1, "PROJECT", [(detect.SERVICES[2], {"interfaceClass": ["Lorg/libris/api/FeeApi;"], "interfaceName": ["x"]})]),
        ("org/libris/rpc/Plain", None, [], 1, "PROJECT", [(detect.SERVICES[0], {})]),
        ("org/libris/job/Nightly", "org/libris/job/Timed", [], 1, "PROJECT", []),
        ("org/libris/job/Timed", None, [detect.JOBS[1]], 0x401, "PROJECT", []),
        ("org/libris/Start", None, [], 1, "PROJECT", []),
        ("org/lib/Start", None, [], 1, "DEPENDENCY", []),
    ]
    methods = [
        ("org/libris/web/Loans", "list", "()V", 1, [(WEB + "GetMapping", {})]), ("org/libris/web/Loans", "drop", "(J)V", 1, [(WEB + "DeleteMapping", {"value": ["/{id}/"]})]),
        ("org/libris/web/Loans", "any", "()V", 1, [(WEB + "RequestMapping", {"value": [""], "path": ["any"]})]), ("org/libris/web/Loans", "put", "()V", 1, [(WEB + "RequestMapping", {"value": ["x"], "method": ["PUT"]})]),
        ("org/libris/web/Loans", "help", "()V", 1, []), ("org/libris/web/Loans", "list", "()V", 0x1041, [(WEB + "GetMapping", {})]), ("org/libris/web/Base", "base", "()V", 1, [(WEB + "GetMapping", {})]),
        ("org/libris/rpc/Stock", "count", "()I", 1, []), ("org/libris/rpc/Stock", "inner", "()I", 2, []), ("org/libris/rpc/Stock", "of", "()I", 9, []), ("org/libris/rpc/Stock", "<init>", "()V", 1, []),
        ("org/libris/rpc/Fees", "sum", "()J", 1, []), ("org/libris/rpc/Plain", "go", "()V", 1, []), ("org/libris/job/Nightly", "execute", "()V", 1, []), ("org/libris/job/Timed", "execute", "()V", 0x401, []),
        ("org/libris/Start", "main", detect.MAIN, 9, []), ("org/libris/Start", "main", "()V", 9, []), ("org/lib/Start", "main", detect.MAIN, 9, []),
    ]
    return spark.createDataFrame(classes, CLASS), spark.createDataFrame(methods, METHOD)


def test_detectors(spark):
    found = detect.scan_entries(*web(spark), {}).orderBy("place", "display").collect()
    assert [(r["type"], r["display"]) for r in found] == [
        ("REST", "ANY /loans/any"), ("REST", "DELETE /loans/{id}/"), ("REST", "GET /loans"), ("REST", "PUT /loans/x"),
        ("DUBBO", "dubbo: org.libris.api.FeeApi#sum"), ("DUBBO", "dubbo: org.libris.api.StockApi#count"), ("DUBBO", "dubbo: org.libris.rpc.Plain#go"),
        ("ELASTIC_JOB", "job: org.libris.job.Nightly#execute"), ("MAIN", "main: org.libris.Start"),
    ]
    off = detect.scan_entries(*web(spark), {"REST": False, "DUBBO": False})
    assert {r["type"]: r["n"] for r in detect.scan_groups(off).collect()} == {"ELASTIC_JOB": 1, "MAIN": 1}


def test_own_detector(spark):
    def closers(classes, methods):
        own = methods.filter("name = 'help'")
        return own.select(F.lit("HELP").alias("type"), F.col("owner").alias("class_name"), F.col("name").alias("method_name"), "descriptor", F.lit("help").alias("display"))

    detect.register_detector("HELP", "Help pages", closers)
    try:
        found = detect.scan_entries(*web(spark), {"REST": False}).filter("type = 'HELP'").collect()
        assert [(r["class_name"], r["place"]) for r in found] == [("org/libris/web/Loans", len(detect.GROUPS) + 1)]
    finally:
        del detect.DETECTORS["HELP"]


def test_dependencies(spark):
    tree = spark.createDataFrame([("desk", "all"), ("all", "corp"), ("corp", None), ("bom", None), ("loop1", "loop2"), ("loop2", "loop1"), ("lost", "gone")], "pom string, parent string")
    chain = poms.parent_chain(tree)
    assert {(r["pom"], r["ancestor"], r["hop"]) for r in chain.filter("pom IN ('desk', 'loop1', 'lost')").collect()} == {("desk", "desk", 0), ("desk", "all", 1), ("desk", "corp", 2), ("loop1", "loop1", 0), ("loop1", "loop2", 1), ("lost", "lost", 0)}
    assert [tuple(r) for r in poms.missing_parents(tree).collect()] == [("lost", "gone")]
    own = spark.createDataFrame([("corp", "base", "7"), ("all", "base", "8"), ("desk", "both", "${base}-${project.version}"), ("desk", "project.artifactId", "not this")], "pom string, key string, value string")
    coordinates = spark.createDataFrame([("desk", None, "desk", "0.3"), ("all", "org.libris", "all", "2"), ("corp", "org", "corp", "1")], "pom string, group_id string, artifact_id string, version string")
    props = poms.props_map(poms.effective_props(chain, own, poms.builtin_props(chain, coordinates)))
    text = "${both} ${project.groupId}:${project.artifactId} ${project.parent.version} ${none}"
    found = {r["pom"]: r["t"] for r in props.select("pom", poms.substitute(F.lit(text), F.col("props")).alias("t")).collect()}
    assert found["desk"] == "8-0.3 org.libris:desk 2 ${none}"
    managed = spark.createDataFrame([("all", 0, "pages", "4", None), ("desk", 0, None, None, "bom"), ("bom", 0, "ink", "9", None), ("all", 1, "ink", "1", None), ("corp", 0, "pages", "3", None)], "pom string, ord int, ga string, version string, bom string")
    versions = poms.managed_versions(chain, managed)
    assert {r["ga"]: r["version"] for r in versions.filter("pom = 'desk'").collect()} == {"pages": "4", "ink": "9"}
    declared = spark.createDataFrame([("desk", "pages", None, None), ("desk", "glue", "2", "runtime"), ("desk", "probe", "1", "test"), ("desk", "rare", "5", None), ("desk", "bare", None, None), ("desk", "span", "(,3]", None)], "pom string, ga string, version string, scope string")
    repo = spark.createDataFrame([("pages", "4"), ("glue", "2"), ("rare", "4")], "ga string, version string")
    found = {r["ga"]: (r["version"], r["outcome"]) for r in poms.resolve_dependencies(declared, versions, repo).collect()}
    assert found == {"pages": ("4", "resolved"), "glue": ("2", "resolved"), "rare": ("5", "unresolved"), "bare": ("?", "unresolved"), "span": ("(,3]", "skipped")}
    both = spark.createDataFrame([("desk", "x", "near", None), ("all", "x", "mid", None), ("corp", "x", "far", None)], "pom string, ga string, version string, scope string")
    pick = lambda child: poms.chain_dependencies(chain, both, child).filter("pom = 'desk'").collect()[0]["version"]
    assert (pick(False), pick(True)) == ("far", "near")


def test_parents_of_build_files_on_disk(spark, tmp_path):
    """By coordinates, by relative path to a folder or a file, by the folder above, and not at all."""
    def put(folder, artifact, parent=None, relative=None, version="1"):
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        inner = f"<relativePath>{relative}</relativePath>" if relative else ""
        above = f"<parent><groupId>org</groupId><artifactId>{parent}</artifactId><version>{version}</version>{inner}</parent>" if parent else "<groupId>org</groupId><version>1</version>"
        (tmp_path / folder / "pom.xml").write_text(f"<project>{above}<artifactId>{artifact}</artifactId></project>")

    put("root", "root")
    put("root/above", "above", "root", version="0")
    put("root/far/near", "named", "root")
    put("root/far/folder", "folder", "root", "../../", version="0")
    put("root/far/file", "file", "root", "../.././pom.xml", version="0")
    put("alone", "alone", "nowhere")
    links = poms.link_parents(files.pom_links(files.read_poms(spark, [str(p) for p in tmp_path.rglob("pom.xml")])))
    short = lambda p: p and p.split(str(tmp_path) + "/")[1].removesuffix("/pom.xml")
    assert {short(r["pom"]): (short(r["parent"]), r["how"]) for r in links.collect()} == {
        "root": (None, "none"), "root/above": ("root", "path"), "root/far/near": ("root", "repository"), "root/far/folder": ("root", "path"), "root/far/file": ("root", "path"), "alone": (None, "missing"),
    }


def test_paths(spark):
    paths = {"/a/b/../c/./d": "/a/c/d", "a/../../b": "../b", "/a//b/": "/a/b", "file:/x/y/../z": "file:/x/z"}
    rows = spark.createDataFrame(list(paths.items()), "p string, n string")
    assert all(r[0] == r[1] for r in rows.select(poms.norm_path(F.col("p")), "n").collect())


def test_entry_changes(spark):
    saved = spark.createDataFrame([("kept", "confirmed", None), ("out", "excluded", "old")], "key string, status string, exclude_reason string")
    keys = spark.createDataFrame([("kept",), ("out",), ("new",)], "key string")
    assert {r["key"]: r["outcome"] for r in entries.add_entries(keys, saved).collect()} == {"kept": "existed", "out": "moved", "new": "added"}
    gone = entries.exclude_entries(saved, keys)
    assert {r["key"]: r["exclude_reason"] for r in gone.collect()} == {"kept": entries.EXCLUDED_BY_USER, "out": "old"}
    assert {r["status"] for r in entries.restore_entries(gone, keys).collect()} == {"confirmed"}


def test_labels_all_differ(spark):
    """A suffixed label that meets another base, bases that differ only after the cut, and a first few rows."""
    bases = ["Desk", "Desk", "Desk(2)", "Desk", "x" * 40, "x" * 31, "x" * 35, "Desk(2)", "y"]
    rows = spark.createDataFrame(list(enumerate(bases)), "ord long, base string")
    found = {r["ord"]: r["label"] for r in entries.unique_labels(rows).collect()}
    assert len(set(found.values())) == len(bases) and all(len(x) <= 31 for x in found.values())
    assert (found[0], found[2], found[4], found[8]) == ("Desk", "Desk(2)", "x" * 31, "y") and found[1].startswith("Desk(") and found[5] == "x" * 28 + "(2)"
    assert sorted(r["ord"] for r in entries.unique_labels(rows, first=4).collect()) == [0, 1, 2, 3]


def test_changed_rules_change_the_fingerprint(spark):
    class_files = spark.createDataFrame([("p", "out", "A.class", 5, 9)], "project string, dir string, path string, mtime long, size long")
    rules = lambda on: spark.createDataFrame([("p", "G", "r", "get", "", "ALL", None, on)], "project string, layer string, id string, method_pattern string, class_pattern string, source string, param_count int, enabled boolean")
    commits = lambda c: spark.createDataFrame([("p", c)], "project string, commit string")
    builds = lambda h: spark.createDataFrame([("p", "pom.xml", h)], "project string, path string, hash string")
    of = lambda *parts: entries.project_fingerprint(class_files, *parts).collect()[0]["fingerprint"]
    seen = [of(), of(commits("c1")), of(commits("c2")), of(commits("c1"), builds("h")), of(commits("c1"), builds("h"), rules(True)), of(commits("c1"), builds("h"), rules(False))]
    assert len(set(seen)) == len(seen) and of(commits(None)) == of()


def dfs_versions(chain, managed, pom):
    """Managed versions by a depth-first walk that visits each import once."""
    found, seen = {}, set()

    def walk(rows):
        for _, ga, version, bom in sorted(rows):
            if bom is None:
                found.setdefault(ga, version)
            elif bom not in seen:
                seen.add(bom)
                walk(managed.get(bom, []))

    for ancestor in chain[pom]:
        walk(managed.get(ancestor, []))
    return found


def test_imports_of_any_depth_count_where_they_are_met_first(spark):
    rng = random.Random(6)
    for trial in range(6):
        names = [f"b{k}" for k in range(12)]
        managed = {n: [(k, *rng.choice([(rng.randrange(6), f"{n}.{k}", None), ("", "", rng.choice(names))])) for k in range(rng.randrange(4))] for n in names}
        if trial == 0:  # a chain longer than any bound
            managed = {f"b{k}": [(0, k, f"v{k}", None), (1, "", "", f"b{k + 1}")] for k in range(11)} | {"b11": [(0, 0, "late", None), (1, "", "", "b0"), (2, 99, "end", None)]}
        chain = {n: [n, rng.choice(names)] for n in names}
        chain = {n: list(dict.fromkeys(c)) for n, c in chain.items()}
        rows = [(n, k, None if bom else int(ga), version or None, bom) for n, own in managed.items() for k, ga, version, bom in own]
        found = poms.managed_versions(
            spark.createDataFrame([(n, a, hop) for n, c in chain.items() for hop, a in enumerate(c)], "pom string, ancestor string, hop int"),
            spark.createDataFrame(rows, "pom string, ord int, ga int, version string, bom string"),
        ).collect()
        wanted = {(n, ga, v) for n in names for ga, v in dfs_versions(chain, managed, n).items()}
        assert {(r["pom"], r["ga"], r["version"]) for r in found} == wanted, trial


def test_only_named_properties_are_put_in(spark):
    props = {"a": "1", "b": "${a}${c}", "c": "x${d}", "loop": "${loop}!", "odd.key": "$1\\"}
    texts = {"${a}-${b}": "1-1x${d}", "${odd.key}": "$1\\", "${none}": "${none}", "plain": "plain", "${a": "${a", "${}": "${}", "${loop}": "${loop}!!!!!", "${a}${a}": "11"}
    rows = spark.createDataFrame([(t, props) for t in texts] + [("${a}", None)], "t string, p map<string,string>")
    found = {r[0]: r[1] for r in rows.filter("p IS NOT NULL").select("t", poms.substitute(F.col("t"), F.col("p"))).collect()}
    assert found == texts
    assert rows.filter("p IS NULL").select(poms.substitute(F.col("t"), F.col("p"))).first()[0] == "${a}"
