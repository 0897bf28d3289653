"""Class files, rule files, entry lists, build files and CSV."""

import csv
import glob
import io
import json
import os
import zipfile
from concurrent.futures import ThreadPoolExecutor

import pyspark
import pytest
from pyspark.sql import functions as F

from callscope.operators import resolve
from callscope.plans import store_queries
from callscope.sources import classfile, files
from callscope.sources.snapshots import Conflict, SnapshotStore

JARS = os.path.join(os.path.dirname(pyspark.__file__), "jars")


def test_classes_of_a_jar(spark):
    jar = glob.glob(f"{JARS}/commons-lang3-*.jar") or glob.glob(f"{JARS}/*commons*.jar")
    parsed = classfile.read_class_files(spark, [jar[0]], "DEPENDENCY").cache()
    classes, methods, sites = classfile.class_tables(parsed)
    assert classes.count() > 50 and methods.count() > classes.count() and sites.count() > methods.count()
    kinds = {r["invoke"] for r in sites.select("invoke").distinct().collect()}
    assert {"VIRTUAL", "STATIC", "SPECIAL", "INTERFACE", "DYNAMIC"} <= kinds
    assert sites.filter("line < 0 OR owner IS NULL OR descriptor NOT LIKE '(%'").count() == 0
    # Every class calls the constructor of its superclass from its own constructors.
    supers = sites.filter("caller_name = '<init>' AND name = '<init>'").select(F.col("caller_owner").alias("class_name"), F.col("owner").alias("super_name"))
    plain = classes.filter(F.expr("access & 512 = 0")).select("class_name", "super_name")
    with_init = plain.join(methods.filter("name = '<init>'").select(F.col("owner").alias("class_name")).distinct(), "class_name")
    assert with_init.join(supers, ["class_name", "super_name"], "left_anti").count() == 0
    found = resolve.resolve_calls(sites.limit(400), classes, methods)
    assert found.filter("kind = 'SINGLE'").count() > 0


def test_broken_class_is_skipped(spark, tmp_path):
    (tmp_path / "A.class").write_bytes(b"\xca\xfe\xba\xbe\x00\x00\x00\x34\x00")
    (tmp_path / "b.jar").write_bytes(b"no zip")
    assert classfile.read_class_files(spark, [str(tmp_path)]).count() == 0


def jar_of(entries, path, spoil=()):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as jar:
        for name, data in entries.items():
            jar.writestr(name, data)
        places = {i.filename: (i.header_offset, i.header_offset + 30 + len(i.filename)) for i in jar.infolist()}
    data = bytearray(path.read_bytes())
    for name, how in spoil:
        head, body = places[name]
        if how == "bytes":
            data[body : body + 6] = b"\xff" * 6
        else:  # the flag of an encrypted entry, in the directory
            at = data.rfind(name.encode()) - 46
            data[at + 8] |= 1
    path.write_bytes(bytes(data))


def test_damaged_entries_are_reported_and_the_rest_of_a_jar_is_read(spark, tmp_path):
    one = lambda n: store_queries.class_file(f"a/{n}", None, [], 1, [("m", "()V", 1)])
    inner = tmp_path / "inner.jar"
    jar_of({"a/In.class": one("In"), "a/Bad.class": one("Bad") * 9}, inner, [("a/Bad.class", "bytes")])
    nested = inner.read_bytes()
    inner.unlink()
    jar_of({"a/A.class": one("A") * 3, "a/B.class": one("B"), "a/C.class": one("C"), "lib/x.jar": nested, "a/T.class": b"text", "a/S.class": one("S")[:20], "a/Z.class": one("Z"), "n.txt": b"x"}, tmp_path / "j.jar", [("a/A.class", "bytes"), ("a/C.class", "flag")])
    (tmp_path / "no.jar").write_bytes(b"no zip")
    (tmp_path / "cut.jar").write_bytes(nested[: len(nested) // 2])
    rows = classfile.read_entries_of_jars(spark, [str(tmp_path)]).cache()
    assert sorted(r["class_name"] for r in classfile.class_rows(rows).collect()) == ["a/B", "a/In", "a/Z"]
    found = {(r["location"].rpartition("/")[2], r["entry"]) for r in classfile.skipped(rows).collect()}
    assert found == {("j.jar", "a/A.class"), ("j.jar", "a/C.class"), ("j.jar", "a/T.class"), ("j.jar", "a/S.class"), ("x.jar", "a/Bad.class"), ("no.jar", ""), ("cut.jar", "")}
    assert sorted(r["class_name"] for r in classfile.read_class_files(spark, [str(tmp_path)], "DEPENDENCY").filter("source = 'DEPENDENCY'").collect()) == ["a/B", "a/In", "a/Z"]


def test_class_files_of_the_queries_are_as_they_were_asked_for(spark, tmp_path):
    (tmp_path / "K.class").write_bytes(store_queries.class_file("p/K", "p/Base", ["p/I", "p/J"], 1537, [("x", "()V", 1), ("y", "(I)J", 1025)]))
    row = classfile.read_class_files(spark, [str(tmp_path)]).first()
    assert (row["class_name"], row["super_name"], row["interfaces"], row["access"]) == ("p/K", "p/Base", ["p/I", "p/J"], 1537)
    assert [(m["name"], m["descriptor"], m["access"], m["ord"]) for m in row["methods"]] == [("x", "()V", 1, 0), ("y", "(I)J", 1025, 1)]


def test_rules_in_both_forms(spark, tmp_path):
    rule = {"id": "r1", "name": "n", "methodPattern": "get", "source": "ALL", "enabled": False, "extra": 1}
    (tmp_path / "a.json").write_text(json.dumps([rule]))
    (tmp_path / "b.json").write_text(json.dumps({"globalOverrides": {"g1": False}, "customRules": [rule, {**rule, "id": "r2", "paramCount": 2}]}))
    rules, overrides = files.read_noise_rules(spark, [str(tmp_path)])
    assert sorted((r["id"], r["param_count"]) for r in rules.collect() if r["project"].endswith("b.json")) == [("r1", None), ("r2", 2)]
    assert rules.count() == 3
    assert [(r["id"], r["enabled"]) for r in overrides.collect()] == [("g1", False)]


def test_entry_lists_round_trip(spark, tmp_path):
    rows = [("p", "a.A", "m", "()V", "MANUAL", "g", "confirmed", None, 0), ("p", "a.B", None, None, "AUTO_SCAN", "g", "excluded", "why", 0), ("p", "a.C", None, None, "AUTO_SCAN", "g", "confirmed", None, 1)]
    schema = "project string, class_name string, method_name string, descriptor string, source string, group string, status string, exclude_reason string, ord int"
    files.write_entries(spark.createDataFrame(rows, schema), str(tmp_path / "e"))
    back = files.read_entries(spark, [str(tmp_path / "e")]).drop("project").collect()
    assert sorted((tuple(r) for r in back), key=str) == sorted((r[1:] for r in rows), key=str)


def entry_rows(projects, each):
    return [(f"p{p}", f"a.C{k}", "m", None, "MANUAL", "g", "confirmed" if k % 3 else "excluded", None if k % 3 else f"why {k}", k) for p in range(projects) for k in range(each)]


ENTRY_SCHEMA = "project string, class_name string, method_name string, descriptor string, source string, group string, status string, exclude_reason string, ord int"


def test_entry_lists_of_many_projects_round_trip(spark, tmp_path):
    rows = entry_rows(20, 7)
    files.write_entries(spark.createDataFrame(rows, ENTRY_SCHEMA).repartition(5), str(tmp_path / "e"))
    back = files.read_entries(spark, [str(tmp_path / "e")])
    wanted = {(r[0], r[6]): [x[1:8] for x in rows if x[0] == r[0] and x[6] == r[6]] for r in rows}
    found = {}
    for r in sorted(back.collect(), key=lambda r: r["ord"]):
        found.setdefault((r["project"], r["status"]), []).append(tuple(r)[1:8])
    assert found == wanted


def test_entry_lists_over_many_lines_beside_others(spark, tmp_path):
    item = {"className": "a.A", "methodName": "m", "source": "MANUAL", "group": "g", "unknown": 1}
    (tmp_path / "named.json").write_text(json.dumps({"projectPath": "/src/one", "confirmed": [item, {**item, "className": "a.B"}], "excluded": []}, indent=2))
    (tmp_path / "plain.json").write_text(json.dumps({"confirmed": [], "excluded": [{**item, "excludeReason": "old"}]}, indent=2))
    (tmp_path / "lines.json").write_text("\n".join(json.dumps({"projectPath": p, "confirmed": [item]}) for p in ("x", "y")) + "\n\n")
    back = sorted(tuple(r) for r in files.read_entries(spark, [str(tmp_path)]).select("project", "class_name", "status", "ord").collect())
    assert back[:2] == [("/src/one", "a.A", "confirmed", 0), ("/src/one", "a.B", "confirmed", 1)] and [r[0] for r in back[3:]] == ["x", "y"]
    assert back[2][0].endswith("plain.json") and back[2][1:] == ("a.A", "excluded", 0)


def test_build_files(spark, tmp_path):
    (tmp_path / "pom.xml").write_text("""<project><parent><groupId>org.mill</groupId><artifactId>base</artifactId><version>7</version></parent><artifactId>grinder</artifactId><version>3.4</version>
      <properties><stone.size>big</stone.size></properties><dependencies><dependency><groupId>w</groupId><artifactId>wheel</artifactId></dependency><dependency><groupId>w</groupId><artifactId>sieve</artifactId><version>2</version><scope>test</scope></dependency></dependencies></project>""")
    row = files.read_poms(spark, str(tmp_path / "pom.xml")).collect()[0]
    assert row["parent"]["artifactId"] == "base" and row["properties"] == {"stone.size": "big"}
    assert [d["artifactId"] for d in row["dependencies"]["dependency"]] == ["wheel", "sieve"]


def test_callers_csv(spark, tmp_path):
    rows = spark.createDataFrame([('a#m("x", y)', "b#n()", 7), ("a#k", "c#o()", 0)], "callee string, caller string, line int").coalesce(1)
    files.write_callers_csv(rows, str(tmp_path / "c"))
    text = next((tmp_path / "c").glob("part-*")).read_bytes().decode()
    assert text.split("\r\n")[:3] == ["被调方法,调用方方法,行号", '"a#m(""x"", y)",b#n(),7', "a#k,c#o(),"]


CALLERS = [("a#m", f"c{k:03}#n", k % 7) for k in range(90)] + [("a#m", 'q "x"\ny, z', 3), ("a#m", "line\r\nend", 0), ("b", None, 2), ("a#k", "", -1)]


def parts(path):
    return b"".join(p.read_bytes() for p in sorted(path.glob("part-*"))).decode()


def test_ordered_callers_are_one_csv_in_parts(spark, tmp_path):
    rows = spark.createDataFrame(CALLERS, "callee string, caller string, line int").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    files.write_callers_csv(rows, str(tmp_path / "many"), ordered=True)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files.write_callers_csv(rows.coalesce(1), str(tmp_path / "one"), ordered=True)
    assert len(list((tmp_path / "many").glob("part-*"))) > 1 and parts(tmp_path / "many") == parts(tmp_path / "one")
    back = list(csv.reader(io.StringIO(parts(tmp_path / "many"), newline="")))
    key = lambda r: (r[0], r[1] is not None, r[1] or "", r[2])
    assert back == [["被调方法", "调用方方法", "行号"]] + [[a, b or "", str(n) if n > 0 else ""] for a, b, n in sorted(CALLERS, key=key)]
    files.write_callers_csv(rows.limit(0), str(tmp_path / "none"), ordered=True)
    assert parts(tmp_path / "none") == "被调方法,调用方方法,行号\r\n"


def test_line_breaks_in_callers_come_back_as_they_are(spark, tmp_path):
    rows = spark.createDataFrame(CALLERS, "callee string, caller string, line int").repartition(3)
    files.write_callers_csv(rows, str(tmp_path / "c"))
    back = []
    for p in (tmp_path / "c").glob("part-*"):
        head, *own = csv.reader(io.StringIO(p.read_bytes().decode(), newline=""))
        assert head == ["被调方法", "调用方方法", "行号"] and own
        back += own
    assert sorted(back) == sorted([a, b or "", str(n) if n > 0 else ""] for a, b, n in CALLERS)


@pytest.mark.parametrize(("number", "size"), [(1, 10), (3, 10), (2, 37), (10, 100), (1, 1000), (21, 50), (99, 10)])
def test_pages_of_a_stored_ranking(spark, tmp_path_factory, number, size):
    path = str(tmp_path_factory.getbasetemp() / "ranks")
    rows = [(k, k * 7 % 31) for k in range(1000)]
    if not os.path.exists(path):
        files.write_ranked(spark.createDataFrame(rows, "id int, n int").repartition(5), path, F.desc("n"), "id", per_range=64)
    wanted = [(k, n, r) for r, (k, n) in enumerate(sorted(rows, key=lambda x: (-x[1], x[0])), 1)][(number - 1) * size : number * size]
    page = files.read_page(spark, path, number, size)
    assert sorted((tuple(r) for r in page.select("id", "n", "rank").collect()), key=lambda r: r[2]) == wanted
    ranges = {int(f.split("rank_range=")[1].split("/")[0]) for f in (r[0] for r in page.select(F.input_file_name()).distinct().collect())}
    assert len(ranges) <= size // 64 + 2  # only folders of the page


def test_graph_store(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 10), (2, 20)], "entry_id long, method_id long")
    edges = spark.createDataFrame([(1, 10, 11)], "entry_id long, from_id long, to_id long")
    stats = spark.createDataFrame([(1, 2)], "entry_id long, n long")
    files.write_graphs(nodes, edges, stats, str(tmp_path / "g"))
    files.write_graphs(nodes.filter("entry_id = 1").withColumn("method_id", F.lit(99).cast("long")), edges, stats, str(tmp_path / "g"))
    back = files.read_graphs(spark, str(tmp_path / "g"))[0]
    assert sorted((r["entry_id"], r["method_id"]) for r in back.collect()) == [(1, 99), (2, 20)]


def test_graph_store_keeps_other_entries_of_a_bucket(spark, tmp_path):
    """One bucket: entry 1 is written again, without calls now; entry 2 and its index row stay."""
    path = str(tmp_path / "g")
    nodes = spark.createDataFrame([(1, 10), (1, 11), (2, 20)], "entry_id long, method_id long")
    edges = spark.createDataFrame([(1, 10, 11), (2, 20, 20)], "entry_id long, from_id long, to_id long")
    stats = spark.createDataFrame([(1, 2), (2, 1)], "entry_id long, n long")
    files.write_graphs(nodes, edges, stats, path, buckets=1)
    one = nodes.filter("entry_id = 1").select("entry_id", F.lit(99).cast("long").alias("method_id")).distinct()
    files.write_graphs(one, edges.limit(0), stats.filter("entry_id = 1").withColumn("n", F.lit(1).cast("long")), path, buckets=1)
    back = [sorted(tuple(r) for r in df.drop("entry_bucket").collect()) for df in files.read_graphs(spark, path)]
    assert back == [[(1, 99), (2, 20)], [(2, 20, 20)], [(1, 1), (2, 1)]]


def test_graph_store_drops_the_calls_of_an_emptied_bucket(spark, tmp_path):
    path = str(tmp_path / "g")
    nodes = spark.createDataFrame([(k, k) for k in range(40)], "entry_id long, method_id long")
    edges = nodes.select("entry_id", F.col("method_id").alias("from_id"), F.col("method_id").alias("to_id"))
    stats = nodes.select("entry_id", F.lit(1).cast("long").alias("n"))
    files.write_graphs(nodes, edges, stats, path, buckets=64)
    files.write_graphs(nodes.filter("entry_id = 5"), edges.limit(0), stats.filter("entry_id = 5"), path, buckets=64)
    back = [sorted(r["entry_id"] for r in df.collect()) for df in files.read_graphs(spark, path)]
    assert back == [list(range(40)), [k for k in range(40) if k != 5], list(range(40))]


def tables(spark, nodes, edges=(), stats=()):
    return {
        "nodes": spark.createDataFrame(list(nodes), "entry_id long, method_id long"),
        "edges": spark.createDataFrame(list(edges), "entry_id long, from_id long, to_id long"),
        "stats": spark.createDataFrame(list(stats), "entry_id long, n long"),
    }


def store_at(spark, path, buckets=4):
    return SnapshotStore(spark, path, {n: df.schema for n, df in tables(spark, []).items()}, buckets)


def held(store, name="nodes", version=None):
    return sorted(tuple(r) for r in store.read(name, version).drop("entry_bucket").collect())


def test_store_without_calls_is_read(spark, tmp_path):
    store = store_at(spark, str(tmp_path / "s"))
    assert held(store) == [] and store.latest() is None
    store.put(tables(spark, [(1, 10)], [(1, 10, 11)], [(1, 1)]))
    store.put(tables(spark, [(1, 10)], [], [(1, 1)]))
    nodes, edges, stats = files.read_graphs(spark, str(tmp_path / "s"))
    assert (nodes.count(), edges.count(), stats.count()) == (1, 0, 1) and "to_id" in edges.columns


def test_lost_writer_leaves_the_store_as_it_was(spark, tmp_path):
    store = store_at(spark, str(tmp_path / "s"))
    store.put(tables(spark, [(1, 10), (2, 20)], [(1, 10, 11)]))
    new = tables(spark, [(1, 99)], [(1, 99, 98)])
    new["stats"] = new["stats"].withColumn("n", F.raise_error(F.lit("lost")).cast("long")).unionByName(spark.createDataFrame([(1, 1)], "entry_id long, n long").withColumn("n", F.raise_error(F.lit("lost")).cast("long")))
    with pytest.raises(Exception, match="lost"):
        store.put(new)
    assert held(store) == [(1, 10), (2, 20)] and held(store, "edges") == [(1, 10, 11)] and store.versions() == [1]
    assert len(store.vacuum(spare_ms=0)) == 1  # what the lost writer left
    assert held(store) == [(1, 10), (2, 20)]


def test_two_writers_lose_no_entry(spark, tmp_path):
    path = str(tmp_path / "s")
    store_at(spark, path).put(tables(spark, [(0, 0)]))
    writers = [store_at(spark, path) for _ in range(4)]
    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(lambda k: writers[k].put(tables(spark, [(k + 1, 10 * k), (0, k)])), range(4)))
    assert sorted(versions) == [2, 3, 4, 5]
    last = versions.index(5)
    assert held(writers[0]) == sorted([(0, last)] + [(k + 1, 10 * k) for k in range(4)])
    assert all(writers[0].latest(v)["parent"] == v - 1 for v in versions)


def test_number_of_a_lost_writer_is_taken_back(spark, tmp_path):
    store = store_at(spark, str(tmp_path / "s"))
    store.put(tables(spark, [(1, 10)]))
    store.manifests.system.createNewFile(store.manifests.at(".claim-2.json"))
    with pytest.raises(Conflict):
        store._commit(lambda layers: layers, seconds=0.5)
    store._take_back(".claim-2.json", patience_ms=-1)
    assert store.put(tables(spark, [(2, 20)])) == 2 and held(store) == [(1, 10), (2, 20)]


def test_versions_deletion_compaction_and_vacuum(spark, tmp_path):
    store = store_at(spark, str(tmp_path / "s"))
    store.put(tables(spark, [(k, k) for k in range(10)], [(k, k, k) for k in range(10)]))
    store.put(tables(spark, [(3, 33)]))
    store.delete(spark.createDataFrame([(4,), (77,)], "entry_id long"))
    wanted = sorted([(k, k) for k in range(10) if k not in (3, 4)] + [(3, 33)])
    assert held(store) == wanted and [r[0] for r in held(store, "edges")] == [k for k in range(10) if k not in (3, 4)]
    assert store.compact() == 4 and len(store.latest()["layers"]) == 1 and store.compact() == 4
    assert held(store) == wanted and held(store, version=1) == [(k, k) for k in range(10)] and (3, 33) in held(store, version=2)
    assert len(store.vacuum(keep=1, spare_ms=0)) == 3 and store.versions() == [4] and held(store) == wanted
    bucket = store.bucket_of(3)
    assert (3, 33) in {tuple(r)[:2] for r in store.read("nodes").filter(F.col("entry_bucket") == bucket).collect()}
    with pytest.raises(ValueError):
        store.read("nodes", 1)


def test_compaction_keeps_what_others_write_meanwhile(spark, tmp_path):
    store = store_at(spark, str(tmp_path / "s"))
    store.put(tables(spark, [(1, 10), (2, 20)]))
    store.put(tables(spark, [(2, 21)]))
    write = store._write

    def slow(rows, entries=None):
        layer = write(rows, entries)
        store._write = write
        store_at(spark, store.path).put(tables(spark, [(2, 22), (3, 30)]))
        return layer

    store._write = slow
    assert store.compact() == 4 and held(store) == [(1, 10), (2, 22), (3, 30)] and len(store.latest()["layers"]) == 2


def test_store_of_other_buckets_or_columns_is_refused(spark, tmp_path):
    path = str(tmp_path / "s")
    store_at(spark, path).put(tables(spark, [(1, 1)]))
    with pytest.raises(ValueError):
        store_at(spark, path, buckets=5)
    with pytest.raises(ValueError):
        SnapshotStore(spark, path, {"nodes": tables(spark, [])["nodes"].schema})
    with pytest.raises(ValueError):
        SnapshotStore(spark, str(tmp_path / "none"))
