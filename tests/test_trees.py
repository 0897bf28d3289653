"""Call trees within a budget, against a recursion; the truncated flag by raw calls."""

import random

import pytest
from pyspark.sql import functions as F

from callscope.operators import graph, resolve, tree

EDGE = "from_id long, to_id long, invoke string, line int"


def recursion(calls, root, depth, budget, calling=None):
    """(place, path, cycle, truncated) of the nodes, as a recursion attaches them until the budget is used up."""
    rows, left = [], [budget]

    def attach(path, cycle):
        left[0] -= 1
        rows.append([len(rows), path, cycle, False])
        return rows[-1]

    def expand(row):
        path = row[1]
        own = calls.get(path[-1], [])
        if len(path) - 1 >= depth:
            row[3] = path[-1] in calling if calling is not None else bool(own)
            return
        for to in own:
            if left[0] <= 0:
                row[3] = True
                break
            child = attach(path + [to], to in path)
            if not child[2]:
                expand(child)

    expand(attach([root], False))
    return rows


def graph_of(rng, n, edges):
    rows = {(rng.randrange(n), rng.randrange(n)): ("VIRTUAL", rng.randrange(9)) for _ in range(edges)}
    calls = {}
    for (a, b), (_, line) in sorted(rows.items(), key=lambda x: (x[1][1], x[0][1])):
        calls.setdefault(a, []).append(b)
    return [(a, b, i, line) for (a, b), (i, line) in rows.items()], calls


@pytest.mark.parametrize(("seed", "n", "edges", "depth", "budget", "ahead"), [(1, 6, 14, 4, 1000, None), (2, 5, 16, 5, 40, 3), (3, 12, 30, 6, 25, 1), (4, 4, 12, 3, 1, None), (5, 9, 40, 4, 200, 20), (6, 7, 7, 1, 3, None)])
def test_tree_within_a_budget_equals_the_recursion(spark, seed, n, edges, depth, budget, ahead):
    rng = random.Random(seed)
    rows, calls = graph_of(rng, n, edges)
    starts = [(100 + k, k % n) for k in range(3)] + [(100, 1), (100, 1), (999, 777)]
    frame = spark.createDataFrame(rows + rows[:3], EDGE)
    found = {}
    for r in tree.call_tree_within(spark.createDataFrame(starts, "entry_id long, method_id long"), frame, depth, budget, ahead=ahead).collect():
        assert r["depth"] == len(r["path"]) - 1 and r["node_id"] == r["path"][-1]
        found.setdefault((r["entry_id"], r["root_id"]), []).append([r["place"], r["path"], r["cycle"], r["truncated"]])
    assert set(found) == set(starts)
    for (entry, root), got in found.items():
        assert sorted(got) == recursion(calls, root, depth, budget), (entry, root)


def test_a_tree_of_very_many_paths_ends(spark):
    """Thirty methods that all call each other: more than 10^20 paths, of which the first 300 are wanted."""
    rows = [(a, b, "STATIC", 1) for a in range(30) for b in range(30)]
    found = tree.call_tree_within(spark.createDataFrame([(1, 0)], "entry_id long, method_id long"), spark.createDataFrame(rows, EDGE), 15, 300, ahead=60).collect()
    wanted = recursion({a: list(range(30)) for a in range(30)}, 0, 15, 300)
    assert sorted([r["place"], r["path"], r["cycle"], r["truncated"]] for r in found) == wanted


def test_tree_marks_nodes_at_the_limit_by_raw_calls(spark):
    rows = spark.createDataFrame([(1, 2, "STATIC", 1), (1, 3, "STATIC", 2)], EDGE)
    callers = spark.createDataFrame([(1,), (3,)], "method_id long")
    start = spark.createDataFrame([(1, 1)], "entry_id long, method_id long")
    found = tree.call_tree_within(start, rows, 1, callers=callers).collect()
    assert {r["node_id"]: r["truncated"] for r in found} == {1: False, 2: False, 3: True}
    assert tree.call_tree_within(start.limit(0), rows, 1).count() == 0
    assert [r["node_id"] for r in tree.call_tree_within(start, rows.limit(0), 3).collect()] == [1]


def test_methods_that_only_call_the_jdk_are_flagged_at_the_limit(spark):
    rows = spark.createDataFrame([(1, 2, "STATIC", 1)], EDGE)
    start = spark.createDataFrame([(1, 1)], "entry_id long, method_id long")
    methods = spark.createDataFrame([(1, "a/A", "m", "()V"), (2, "a/B", "n", "()V"), (3, "a/B", "n", "(I)V")], "method_id long, owner string, name string, descriptor string")
    sites = spark.createDataFrame([("a/A", "m", "()V"), ("a/B", "n", "()V"), ("a/B", "n", "()V")], "caller_owner string, caller_name string, caller_descriptor string")
    nodes, raw = graph.reachable(start, rows, 1), resolve.raw_callers(sites, methods)
    assert sorted(r[0] for r in raw.collect()) == [1, 2]
    flag = lambda callers: graph.with_truncation(nodes, rows, 1, callers=callers)[1].first()["truncated"]
    assert flag(None) is False and flag(raw) is True and flag(raw.filter(F.col("method_id") == 1)) is False
