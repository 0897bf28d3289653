"""Call trees within a budget of nodes: the first rows in depth-first order, without the rest of the tree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callscope.operators.base import cut
from callscope.operators.graph import NODE_BUDGET, clamp_depth

TREE = ["entry_id", "root_id"]


def ordered_calls(edges: DataFrame, order: Sequence[str], most: int) -> DataFrame:
    """(from_id, to_id, invoke, line, ord, to_n): each method's first `most` callees in order, with their place and number of callees."""
    distinct = edges.groupBy("from_id", "to_id").agg(F.min_by(F.struct("invoke", "line", *[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)]), F.struct(*order)).alias("c"))
    distinct = distinct.select("from_id", "to_id", "c.*")
    counts = distinct.groupBy(F.col("from_id").alias("to_id")).agg(F.count(F.lit(1)).alias("to_n"))
    nth = F.row_number().over(Window.partitionBy("from_id").orderBy(*[f"_o{k}" for k in range(len(order))], "to_id"))
    first = distinct.withColumn("ord", nth).filter(F.col("ord") <= most)
    return first.join(counts, "to_id", "left").select("from_id", "to_id", "invoke", "line", "ord", F.coalesce("to_n", F.lit(0)).alias("to_n"))


def call_tree_within(
    roots: DataFrame, edges: DataFrame, max_depth: int | None = None, max_nodes: int = NODE_BUDGET, order: Sequence[str] = ("line", "to_id"),
    callers: DataFrame | None = None, ahead: int | None = None,
) -> DataFrame:
    """(entry_id, root_id, place, path, depth, node_id, invoke, line, cycle, truncated): the first max_nodes nodes of each root's call tree.

    The tree is that of a recursion which goes through a method's calls in order and leaves out repeated callees; a method met
    again on its own path is a leaf with the cycle mark. place: from 0, in the order of that recursion, which ends when the budget is used
    up. truncated: a node at the depth limit with calls, or one whose callees the budget cut. callers: (method_id) of methods
    with any call, JDK calls too; without it those with edges count.

    Rounds open the first `ahead` unopened nodes of each tree in that order, and keep the first max_nodes of all that are known: what is
    found later can only push nodes back, so a node behind the budget never comes forward. A tree of any number of paths takes
    about max_depth rounds, and no more than max_nodes rows and what `ahead` nodes call are ever held of it. Each of several
    roots of an entry has a budget of its own. Repeated roots are one; an entry without roots has no rows.
    """
    depth, ahead = clamp_depth(max_depth), ahead or max(1000, max_nodes // 8)
    calls = cut(ordered_calls(edges, order, max_nodes))
    degrees = calls.groupBy(F.col("from_id").alias("root_id")).agg(F.count(F.lit(1)).alias("n"))
    first = roots.select("entry_id", F.col("method_id").alias("root_id")).distinct().join(degrees, "root_id", "left")
    known = first.select(
        *TREE, F.array().cast("array<int>").alias("at"), F.array("root_id").alias("path"), F.lit(0).alias("depth"), F.col("root_id").alias("node_id"),
        F.lit(None).cast("string").alias("invoke"), F.lit(None).cast("int").alias("line"), F.lit(False).alias("cycle"), F.coalesce("n", F.lit(0)).alias("n"), F.lit(True).alias("closed"),
    ).withColumn("closed", (F.col("n") == 0) | (F.lit(depth) == 0))
    columns = known.columns
    # A tree's rows known so far: at most the budget and what was opened last.
    walk = Window.partitionBy(*TREE).orderBy("at")
    while True:
        placed = known.withColumns({"place": F.row_number().over(walk) - 1, "_waits": F.sum((~F.col("closed")).cast("int")).over(walk)})
        placed = cut(placed.filter(F.col("place") < max_nodes).withColumn("_open", ~F.col("closed") & (F.col("_waits") <= ahead)))
        opened = placed.filter("_open")
        if opened.isEmpty():
            break
        below = opened.select(*TREE, "at", "path", "depth", "node_id", "place").join(calls, F.col("node_id") == F.col("from_id")).filter(F.col("place") + F.col("ord") < max_nodes)
        cycle = F.array_contains("path", F.col("to_id"))
        below = below.select(
            *TREE, F.concat("at", F.array("ord")).alias("at"), F.concat("path", F.array("to_id")).alias("path"), (F.col("depth") + 1).alias("depth"), F.col("to_id").alias("node_id"),
            "invoke", "line", cycle.alias("cycle"), F.col("to_n").alias("n"), (cycle | (F.col("to_n") == 0) | (F.col("depth") + 1 >= depth)).alias("closed"),
        )
        known = placed.withColumn("closed", F.col("closed") | F.col("_open")).select(*columns).unionByName(below)
    held = placed.filter("depth > 0").groupBy(*TREE, F.slice("at", F.lit(1), F.size("at") - 1).alias("at")).agg(F.count(F.lit(1)).alias("_held"))
    calling = (calls.select(F.col("from_id").alias("node_id")) if callers is None else callers.select(F.col("method_id").alias("node_id"))).distinct().withColumn("_calls", F.lit(True))
    rows = placed.join(held, [*TREE, "at"], "left").join(calling, "node_id", "left")
    at_limit = (F.col("depth") >= depth) & F.col("_calls").isNotNull()
    short = (F.col("depth") < depth) & (F.coalesce("_held", F.lit(0)) < F.col("n"))
    return rows.select(*TREE, "place", "path", "depth", "node_id", "invoke", "line", "cycle", (~F.col("cycle") & (at_limit | short)).alias("truncated"))
