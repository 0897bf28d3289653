"""Resolution, graphs, listing and search against plain Python on random class trees and calls."""

import random
from collections import Counter, defaultdict, deque

import pytest
from pyspark.sql import functions as F

from callscope.operators import dfs, freq, graph, resolve, search

INTERFACE, ABSTRACT = 0x601, 0x401


def class_tree(rng, n=25):
    """Classes by name: (access, superclass, interfaces), and methods by (class, name): whether they have a body."""
    classes, methods = {}, {}
    faces = [f"org/libris/I{k}" for k in range(n // 3)]
    plain = [f"org/libris/C{k}" for k in range(n)]
    for k, name in enumerate(faces):
        classes[name] = (INTERFACE, None, rng.sample(faces[:k], min(k, rng.randrange(3))))
    for k, name in enumerate(plain):
        above = rng.choice([None, "java/lang/Object", "com/lost/Base", *plain[:k]]) if k else None
        classes[name] = (rng.choice([1, 1, ABSTRACT]), above, rng.sample(faces + ["java/io/Closeable"], rng.randrange(3)))
    for name, (access, _, _) in classes.items():
        for method in ("open", "lend", "close"):
            if rng.random() < 0.35:
                methods[name, method] = rng.random() < (0.15 if access == INTERFACE else 0.4 if access == ABSTRACT else 1.0)
    return classes, methods


def is_jdk(name):
    return name.startswith("java/")


def ancestors(classes, name):
    found, todo = set(), [name]
    while todo:
        c = todo.pop()
        if c not in found:
            found.add(c)
            _, above, faces = classes.get(c, (0, None, []))
            todo += [x for x in (above, *faces) if x]
    return found


def dispatch(classes, methods, owner, name):
    found = {c for c, (access, _, _) in classes.items() if access == 1 and methods.get((c, name)) and owner in ancestors(classes, c)}
    return found or ({owner} if methods.get((owner, name)) else set())


def target(classes, methods, owner, name):
    """(kind, targets) of a call, one class after another."""
    if is_jdk(owner):
        return None, set()
    todo, seen, first, unknown = deque([owner]), set(), None, False
    while todo:
        c = todo.popleft()
        if c in seen:
            continue
        seen.add(c)
        if c not in classes:
            unknown |= not is_jdk(c)
        elif methods.get((c, name)):
            return "SINGLE", {c}
        elif (c, name) in methods:
            first = first or c
        else:
            _, above, faces = classes[c]
            todo.extend(faces)
            if above:
                todo.appendleft(above)
    if owner in classes and classes[owner][0] == INTERFACE and dispatch(classes, methods, owner, name):
        return "MULTI", dispatch(classes, methods, owner, name)
    if first:
        found = dispatch(classes, methods, first, name)
        return ("MULTI", found) if found else ("EXTERNAL", {owner})
    return ("EXTERNAL", {owner}) if unknown else (None, set())


@pytest.mark.parametrize("seed", range(3))
def test_resolution(spark, seed):
    classes, methods = class_tree(random.Random(seed))
    table = spark.createDataFrame([(c, s, f, a, "PROJECT") for c, (a, s, f) in classes.items()], "class_name string, super_name string, interfaces array<string>, access int, source string")
    bodies = spark.createDataFrame([(c, m, "()V", 1 if body else ABSTRACT) for (c, m), body in methods.items()], "owner string, name string, descriptor string, access int")
    asked = [(c, m) for c in [*classes, "com/lost/Base", "java/util/List"] for m in ("open", "lend", "close")]
    calls = spark.createDataFrame([(c, m, "()V") for c, m in asked * 2], "owner string, name string, descriptor string")
    found = defaultdict(lambda: (None, set()))
    for r in resolve.resolve_calls(calls, table, bodies).collect():
        kind, targets = found[r["owner"], r["name"]]
        assert kind in (None, r["kind"]) and r["target"] not in targets
        found[r["owner"], r["name"]] = (r["kind"], targets | {r["target"]})
    for owner, name in asked:
        assert found[owner, name] == target(classes, methods, owner, name), (owner, name)
    closure = Counter((r["class_name"], r["ancestor"]) for r in resolve.subtype_closure(table).collect())
    assert closure == Counter((c, a) for c in classes for a in ancestors(classes, c))


@pytest.fixture(scope="module")
def calls():
    """Calls (from, to, invoke, line) among 60 methods with a hub, self calls and cycles; 150 entries, some of two roots."""
    rng = random.Random(11)
    edges = {(a, b): ("VIRTUAL", rng.randrange(1, 99)) for a in range(60) for b in [rng.randrange(60) for _ in range(rng.choice([0, 1, 2, 3]))]}
    edges |= {(a, 7): ("STATIC", a + 1) for a in range(0, 60, 4)}
    roots = [(1000 + k, rng.randrange(60)) for k in range(150)] + [(1000 + k, rng.randrange(60)) for k in range(0, 150, 5)]
    return edges, sorted(set(roots))


@pytest.fixture(scope="module")
def frames(spark, calls):
    edges, roots = calls
    e = spark.createDataFrame([(a, b, i, n) for (a, b), (i, n) in edges.items()], "from_id long, to_id long, invoke string, line int")
    return spark.createDataFrame(roots, "entry_id long, method_id long").cache(), e.cache()


def depths(edges, starts, limit):
    found, level = dict.fromkeys(starts, 0), set(starts)
    for depth in range(1, limit + 1):
        level = {b for a, b in edges if a in level} - set(found)
        found |= dict.fromkeys(level, depth)
    return found


@pytest.mark.parametrize("limit", [20, 3, 1])
def test_reachability(calls, frames, limit):
    edges, roots = calls
    starts = defaultdict(set)
    for entry, method in roots:
        starts[entry].add(method)
    wanted = {(entry, m): d for entry, own in starts.items() for m, d in depths(edges, own, limit).items()}
    nodes = graph.reachable(*frames, limit)
    rows = nodes.collect()
    assert len(rows) == len(wanted) and {(r["entry_id"], r["method_id"]): r["depth"] for r in rows} == wanted
    assert all(r["is_root"] == (r["depth"] == 0) for r in rows)
    inner = Counter((r["entry_id"], r["from_id"], r["to_id"]) for r in graph.graph_edges(nodes, frames[1], limit).collect())
    assert inner == Counter((entry, a, b) for (entry, m), d in wanted.items() if d < limit for a, b in edges if a == m)
    _, flags = graph.with_truncation(nodes, frames[1], limit)
    callers = {a for a, _ in edges}
    assert {r["entry_id"]: r["truncated"] for r in flags.collect()} == {e: any(wanted[e, m] == limit and m in callers for x, m in wanted if x == e) for e in starts}


def test_budget_stops_the_walk(spark, calls, frames):
    """Entries that pass the budget go no deeper; of those the nearest nodes, and of these the smallest ids, stay."""
    edges, roots = calls
    starts = defaultdict(set)
    for entry, method in roots:
        starts[entry].add(method)
    budget = 9
    nodes = graph.reachable(*frames, 20, budget)
    found = defaultdict(dict)
    for r in nodes.collect():
        found[r["entry_id"]][r["method_id"]] = r["depth"]
    stopped = 0
    for entry, own in starts.items():
        whole = depths(edges, own, 20)
        assert found[entry].items() <= whole.items()
        if len(whole) <= budget:
            assert found[entry] == whole
        else:
            assert len(found[entry]) > budget
            stopped += len(found[entry]) < len(whole)
    assert stopped > 20
    kept, flags = graph.with_truncation(nodes, frames[1], 20, budget)
    near = defaultdict(set)
    for r in kept.collect():
        near[r["entry_id"]].add(r["method_id"])
    for entry, own in starts.items():
        whole = sorted(depths(edges, own, 20).items(), key=lambda x: (x[1], x[0]))
        assert near[entry] == {m for m, _ in whole[:budget]}
    assert {r["entry_id"] for r in flags.filter("truncated").collect()} >= {e for e, own in starts.items() if len(depths(edges, own, 20)) > budget}


@pytest.mark.parametrize("limit", [20, 4])
def test_search(spark, calls, frames, limit):
    edges, roots = calls
    starts = defaultdict(set)
    for entry, method in roots:
        starts[entry].add(method)
    hits = {3, 7, 41}
    wanted = {}
    for entry, own in starts.items():
        d = depths(edges, own, limit)
        marked = {m for m in d if m in hits}
        wanted |= {(entry, m): "hit" for m in marked}
        while more := {a for a, b in edges if b in marked and d.get(a, limit) < limit} - marked:
            marked |= more
            wanted |= {(entry, m): "contains" for m in more}
    table = spark.createDataFrame([(h,) for h in hits], "method_id long")
    walked = graph.walk(*frames, limit)
    for w in (walked, graph.walk_of(walked.nodes().select("entry_id", "method_id", "depth"))):
        rows = search.search_graphs(w, frames[1], table, limit).collect()
        assert len(rows) == len(wanted) and {(r["entry_id"], r["method_id"]): r["mark"] for r in rows} == wanted
    listed = search.hit_list(search.search_graphs(walked, frames[1], table, limit)).orderBy("place").collect()
    assert [(r["entry_id"], r["method_id"]) for r in listed] == sorted(k for k, m in wanted.items() if m == "hit")
    assert [r["place"] for r in listed] == list(range(1, len(listed) + 1))
    shown = walked.nodes().filter("method_id <> 7")
    hidden = {r["entry_id"]: (r["n_hits"], r["n_hidden"]) for r in search.hidden_hits(walked.nodes(), shown, table).collect()}
    assert hidden == {e: (sum((e, h) in wanted for h in hits - {7}), int((e, 7) in wanted)) for e in starts if any((e, h) in wanted for h in hits)}


def test_cycles(calls, frames):
    edges, _ = calls
    reach = {m: depths(edges, {b for a, b in edges if a == m}, 60) for m in range(60)}
    assert {r[0] for r in graph.cycle_nodes(frames[1]).collect()} == {m for m in range(60) if m in reach[m]}


def brute_listing(own, root, noise, limit):
    """Pre-order rows (level, method, cycle) by recursion; own: callees in call order."""
    rows, seen, cycles = [(0, root)], {root}, set()

    def visit(node, level, path):
        for to in own.get(node, ()):
            if to in path or to in (node, root):
                cycles.add(to)
            if to not in seen and to not in noise and level < limit:
                seen.add(to)
                rows.append((level + 1, to))
                visit(to, level + 1, path | {to})

    visit(root, 0, set())
    return [(level, m, m in cycles) for level, m in rows] if root not in noise else []


@pytest.mark.parametrize("limit", [20, 2])
def test_listing(spark, calls, frames, limit):
    edges, _ = calls
    own = defaultdict(list)
    for (a, b), (_, line) in edges.items():
        own[a].append((line, b))
    own = {a: [b for _, b in sorted(found)] for a, found in own.items()}
    roots = spark.createDataFrame([(k, k) for k in range(0, 60, 3)], "entry_id long, method_id long")
    noise = spark.createDataFrame([(5,), (7,), (9,)], "method_id long")
    inner = graph.graph_edges(graph.reachable(roots, frames[1], limit), frames[1], limit).withColumn("seq", F.col("line").cast("long"))
    found = defaultdict(list)
    for r in dfs.chain_rows(roots, inner, noise, limit).orderBy("entry_id", "ord").collect():
        found[r["entry_id"]].append((r["level"], r["method_id"], r["remark"] == dfs.CYCLE))
    for k in range(0, 60, 3):
        assert found[k] == brute_listing(own, k, {5, 7, 9}, limit)


def test_parent_lists_are_bounded(frames, calls):
    edges, _ = calls
    callers = sorted(a for a, b in edges if b == 7)
    few = graph.parents(frames[1], 3).filter("method_id = 7").collect()[0]
    assert few["parents"] == callers[:3] and few["n_parents"] == len(callers)
    assert graph.parents(frames[1]).filter("method_id = 7").collect()[0]["parents"] == callers


def test_build_edges(spark):
    rows = [("a", "I.m", "MULTI", "X.m", "INTERFACE", 3, 0), ("a", "I.m", "MULTI", "Y.m", "INTERFACE", 3, 0), ("a", "X.m", "SINGLE", "X.m", "VIRTUAL", 9, 2), ("a", "X.m", "SINGLE", "X.m", "STATIC", 4, 1), ("b", "J.m", "JDK", "J.m", "STATIC", 1, 0), ("b", "Z.m", "EXTERNAL", "Z.m", "STATIC", 1, 1)]
    found = graph.build_edges(spark.createDataFrame(rows, "caller string, declared string, kind string, target string, invoke string, line int, seq int"))
    assert {tuple(r) for r in found.collect()} == {("a", "I.m", "INTERFACE", 3), ("I.m", "X.m", "IMPL", 3), ("I.m", "Y.m", "IMPL", 3), ("a", "X.m", "STATIC", 4), ("b", "Z.m", "STATIC", 1)}


def test_verify_entries(spark):
    methods = spark.createDataFrame([("a.Desk", "open", "()V"), ("a.Desk", "open", "(I)V"), ("a.Desk", "close", "()V"), ("b.Shelf", "fill", "()V"), ("c.Shelf", "fill", "()V"), ("d.Hall", "go", "()V")], "class_name string, name string, descriptor string")
    asked = {
        1: ("a.Desk", None, None, ("OK", "a.Desk", None, None, None)), 2: ("Desk", "close", None, ("UNIQUE", "a.Desk", None, None, "()V")), 3: ("a.Desk", "open", None, ("OVERLOADS", "a.Desk", None, None, "()V,(I)V")),
        4: ("a.Desk", "lend", None, ("METHOD_MISSING", "a.Desk", None, "close,open", None)), 5: ("a.Desk", "open", "(I)V", ("EXACT", "a.Desk", None, None, None)), 6: ("a.Desk", "open", "(J)V", ("MISMATCH", "a.Desk", None, None, None)),
        7: ("Shelf", "fill", None, ("CLASS_AMBIGUOUS", None, "b.Shelf,c.Shelf", None, None)), 8: ("x.Lost", "go", None, ("CLASS_MISSING", None, None, None, None)), 9: ("Hall", "", "", ("OK", "d.Hall", None, None, None)),
    }
    entries = spark.createDataFrame([(k, *v[:3]) for k, v in asked.items()], "entry_id long, class_name string, method_name string, descriptor string")
    found = {r["entry_id"]: (r["status"], r["class_name"], r["candidates"], r["available"], r["overloads"]) for r in resolve.verify_entries(entries, methods).collect()}
    assert found == {k: v[3] for k, v in asked.items()}


def test_failed_entries_are_counted(spark):
    stats = spark.createDataFrame([(1, 5, 4, 3, 1, 1, False), (2, 7, 9, 7, 0, 0, True)], "entry_id long, n_nodes long, n_edges long, n_project long, n_dependency long, n_external long, truncated boolean")
    asked = spark.createDataFrame([(1,), (2,), (3,)], "entry_id long")
    rows = {r["entry_id"]: r for r in graph.batch_summary(stats, asked).collect()}
    assert (rows[None]["n_entries"], rows[None]["n_nodes"], rows[None]["n_failed"], rows[None]["truncated"]) == (3, 12, 1, True) and "1" in rows[None]["warning"]
    assert (rows[3]["n_failed"], rows[3]["n_nodes"], rows[3]["warning"]) == (1, 0, None)
    assert {r["entry_id"]: r["error"] for r in graph.batch_entries(stats, asked).collect()} == {1: None, 2: None, 3: graph.NO_ROOT}
    assert graph.batch_summary(stats.limit(0)).count() == 0


def test_callers_of_a_hub_have_a_bound_and_a_count(spark):
    rows = spark.createDataFrame([(1, k % 40, 7, "STATIC", k) for k in range(100)] + [(1, 5, 8, "STATIC", 1)], "entry_id long, from_id long, to_id long, invoke string, line int")
    whole = {r["method_id"]: r for r in graph.call_frequency(rows).collect()}
    some = {r["method_id"]: r for r in graph.call_frequency(rows, 10).collect()}
    assert whole[7]["call_count"] == some[7]["call_count"] == 100 and len(whole[7]["callers"]) == 100
    assert some[7]["callers"] == whole[7]["callers"][:10] and some[8]["callers"] == whole[8]["callers"]


def test_numbers_of_sorted_ranges_are_gapless(spark):
    rows = spark.range(5000).withColumn("k", F.col("id") % 13).repartition(6)
    found = freq.numbered(rows, "nth", F.desc("k"), "id").orderBy("nth").collect()
    assert [r["nth"] for r in found] == list(range(1, 5001))
    assert [(r["k"], r["id"]) for r in found] == sorted(((r["k"], r["id"]) for r in found), key=lambda x: (-x[0], x[1]))
    assert freq.numbered(rows.limit(0), "nth", "id").count() == 0
