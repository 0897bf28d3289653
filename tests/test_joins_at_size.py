"""Joins whose result is far larger than their input, and lists that no task holds as a whole."""

import json
import os
import random

from pyspark.sql import functions as F

from callscope.operators import graph, resolve
from callscope.operators.base import spread_join
from callscope.sources import files


def test_a_key_of_many_rows_is_dealt_to_many_tasks(spark):
    left, right = spark.range(300).select(F.lit("k").alias("key"), F.col("id").alias("l")), spark.range(500).select(F.lit("k").alias("key"), F.col("id").alias("r"))
    rows = spread_join(left, right, ["key"], "r").withColumn("task", F.spark_partition_id())
    assert rows.select("l", "r").distinct().count() == rows.count() == 150_000
    assert rows.select("task").distinct().count() > 1


def test_entry_roots_by_equal_keys(spark):
    """as by comparing all methods of a class, without a window over them; asks may share an entry."""
    rng = random.Random(3)
    methods = [(k, f"C{rng.randrange(4)}", rng.choice("abc"), rng.choice(["()V", "(I)V"]), rng.choice([1, 4097])) for k in range(60)]
    asked = [(rng.randrange(25), rng.choice(["C0", "C1", "C9"]), rng.choice([None, "a", "b", "z"]), rng.choice([None, "()V", "(J)V"])) for _ in range(40)]
    wanted = []
    pairs = [(e, m[0], name is not None and desc is not None and desc == m[3]) for e, c, name, desc in asked for m in methods if c == m[1] and ((name is None and m[4] == 1) or name == m[2])]
    for e, m, exact in pairs:
        if exact or not any(x for o, _, x in pairs if o == e):
            wanted.append((e, m))
    found = resolve.resolve_entry_roots(spark.createDataFrame(asked, "entry_id long, class_name string, method_name string, descriptor string"), spark.createDataFrame(methods, "method_id long, class_name string, name string, descriptor string, access int"))
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in found.collect()) == sorted(wanted)


def test_long_entry_lists_go_on_in_further_lines(spark, tmp_path):
    """a list of more entries than a line may hold comes back whole and in order."""
    rows = [(p, f"a.C{k}", "m", None, "MANUAL", "g", "confirmed" if k % 3 else "excluded", None, k) for p, n in (("p", 50), ("q", 2)) for k in range(n)]
    schema = "project string, class_name string, method_name string, descriptor string, source string, group string, status string, exclude_reason string, ord int"
    path = str(tmp_path / "e")
    files.write_entries(spark.createDataFrame(rows, schema), path, 10)
    lines = [json.loads(x) for f in os.listdir(path) if f.endswith(".json") for x in open(os.path.join(path, f))]
    assert max(len(o.get(s, [])) for o in lines for s in ("confirmed", "excluded")) == 10 and sorted(o["projectPath"] for o in lines) == ["p"] * 4 + ["q"]
    found = {}
    for r in sorted(files.read_entries(spark, [path]).collect(), key=lambda r: r["ord"]):
        found.setdefault((r["project"], r["status"]), []).append((r["class_name"], r["ord"]))
    wanted = {}
    for r in rows:
        own = wanted.setdefault((r[0], r[6]), [])
        own.append((r[1], len(own)))
    assert found == wanted


def test_edges_of_resolved_calls(spark):
    """F16: as build_edges() over all pairs, also where a declared method calls, and with few rows compared."""
    key = "owner string, name string, descriptor string"
    calls = spark.createDataFrame([("a.x", "I", "m", "()V", "INTERFACE", 3, 4), ("b.y", "I", "m", "()V", "INTERFACE", 9, 2), ("J.m", "X", "m", "()V", "STATIC", 5, 1), ("b.y", "J", "m", "()V", "VIRTUAL", 6, 7)], f"caller string, {key}, invoke string, line int, seq int")
    one = spark.createDataFrame([("X", "m", "()V", "SINGLE", "X")], f"{key}, kind string, target string")
    ways = spark.createDataFrame([("I", "m", "()V", "I"), ("J", "m", "()V", "I")], f"{key}, via string")
    targets = spark.createDataFrame([("I", "m", "()V", "X"), ("I", "m", "()V", "Y")], "via string, name string, descriptor string, target string")
    found = graph.build_edges_of(calls, one, ways, targets, lambda owner, name, descriptor: F.concat_ws(".", owner, name))
    pairs = one.unionByName(ways.join(targets, ["via", "name", "descriptor"]).withColumn("kind", F.lit("MULTI")).drop("via"))
    rows = calls.join(pairs, resolve.KEY).select("caller", F.concat_ws(".", "owner", "name").alias("declared"), "kind", F.concat_ws(".", "target", "name").alias("target"), "invoke", "line", "seq")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, graph.build_edges(rows).collect()))
    assert ("J.m", "X.m", "STATIC", 5) in set(map(tuple, found.collect()))
