"""Sharding: balanced label propagation over documents that are linked by equal text.

The links of a group of equal texts are kept as one hub with a count for each shard, so that a
group of any size costs a row for each shard, and no pair of documents is ever written out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callscope.llm.common import bucket_count, cut, quoted, running_total

GROUP = ["g1", "g2"]


def quotas(rows: int, shards: int) -> list[int]:
    """Rows of each shard; two of them differ by one at most."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def accepted(wanted: np.ndarray, load: np.ndarray, quota: np.ndarray) -> np.ndarray:
    """How many of the wanted moves (from, to) can happen so that no shard passes its quota.

    Moves out of a shard make room in it. Moves into a shard that would be too full are cut in
    proportion, until all fit.
    """
    moves = wanted.astype(np.int64)
    while True:
        after = load - moves.sum(axis=1) + moves.sum(axis=0)
        over = (after > np.maximum(quota, load)) & (moves.sum(axis=0) > 0)
        if not over.any():
            return moves
        for t in np.flatnonzero(over):
            arriving = moves[:, t].sum()
            room = max(0, arriving - (after[t] - max(quota[t], load[t])))
            cut_to = moves[:, t] * room // arriving
            spare = np.argsort(-(moves[:, t] - cut_to), kind="stable")[: room - cut_to.sum()]
            cut_to[spare] += 1  # what rounding down left over
            moves[:, t] = np.minimum(cut_to, moves[:, t])


def pick(values: np.ndarray, shards: int, i: Column, j: Column) -> Column:
    """values[i, j] for columns i and j."""
    return F.element_at(F.array(*[F.lit(int(v)) for v in values.ravel()]), i * shards + j + 1)


def propagate(groups: DataFrame, rows: int, shards: int = 8, rounds: int = 12) -> DataFrame:
    """(g1, g2, shard, n): how many documents of each linked group go to each shard.

    groups: (g1, g2, n). A group starts spread evenly. In each round the part of a group in a
    shard wants to join the group's largest part, if that is larger than itself; parts with the most
    to gain go first, and accepted() sets how many may move between two shards. Every other round
    only shards with room are wanted; in the others parts may also change places between full shards,
    but for groups that no shard can hold.
    """
    quota = np.array(quotas(rows, shards))
    first = F.pmod(F.xxhash64(*GROUP), F.lit(shards)).cast("int")
    cells = groups.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    turn = F.pmod(F.col("shard") - first, F.lit(shards))
    share = F.floor(F.col("n") / shards) + F.when(turn < F.col("n") % shards, 1).otherwise(0)
    cells = cut(cells.select(*GROUP, "shard", share.cast("long").alias("n")).filter("n > 0"))
    buckets = bucket_count(rows, 20_000)
    idle = False
    for turn_no in range(rounds):
        load = np.zeros(shards, np.int64)
        for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect():  # a row for each shard
            load[r["shard"]] = r["n"]
        room = F.element_at(F.array(*[F.lit(bool(x)) for x in load < quota]), F.col("shard") + 1)
        if turn_no % 2 == 0:
            room = room | (F.sum("n").over(Window.partitionBy(*GROUP)) <= int(quota.min()))
        largest = F.max(F.when(room, F.struct("n", F.xxhash64("shard", *GROUP).alias("tie"), "shard"))).over(Window.partitionBy(*GROUP))
        own = F.struct("n", F.xxhash64("shard", *GROUP).alias("tie"), "shard")
        moving = cells.withColumn("best", largest).filter(F.col("best") > own)
        gain = F.floor(F.log2(F.col("best.n").cast("double") + 1)).cast("int")
        moving = moving.select(*GROUP, "shard", "n", F.col("best.shard").alias("to"), ((64 - gain) * buckets + F.pmod(F.xxhash64(*GROUP), F.lit(buckets))).cast("int").alias("bucket"))
        wanted = np.zeros((shards, shards), np.int64)
        for r in moving.groupBy("shard", "to").agg(F.sum("n").alias("n")).collect():  # shards squared
            wanted[r["shard"], r["to"]] = r["n"]
        allowed = accepted(wanted, load, quota)
        if not allowed.any():
            if idle:
                break
            idle = True
            continue
        idle = False
        moving = running_total(moving, ["shard", "to"], "bucket", [F.col(c) for c in GROUP], "n", "start")
        moved = F.least(F.col("n"), F.greatest(F.lit(0), pick(allowed, shards, F.col("shard"), F.col("to")) - F.col("start")))
        moving = moving.select(*GROUP, "shard", "to", moved.cast("long").alias("n")).filter("n > 0")
        change = moving.select(*GROUP, F.explode(F.array(F.struct("shard", (-F.col("n")).alias("n")), F.struct(F.col("to").alias("shard"), "n"))).alias("x"))
        cells = cells.unionByName(change.select(*GROUP, "x.shard", "x.n"))
        cells = cut(cells.groupBy(*GROUP, "shard").agg(F.sum("n").alias("n")).filter("n > 0"))
    # What is over a quota, because linked documents started so, goes to the unlinked ones.
    cells = cells.withColumn("bucket", F.pmod(F.xxhash64(*GROUP), F.lit(buckets)).cast("int"))
    cells = running_total(cells, ["shard"], "bucket", [F.col(c) for c in GROUP], "n", "start")
    limit = F.element_at(F.array(*[F.lit(int(q)) for q in quota]), F.col("shard") + 1)
    return cut(cells.select(*GROUP, "shard", F.least(F.col("n"), limit - F.col("start")).alias("n")).filter("n > 0"))


def shard_documents(docs: DataFrame, shards: int = 8, rounds: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row of docs.

    Documents of equal text are linked. Shards get equal numbers of rows, to within one, and
    propagate() keeps linked documents together where the quotas allow; unlinked documents fill
    what is left. slot numbers a shard's rows from 0 without gaps. size is the UTF-8 bytes of
    the text plus 1.

    Null text is like the empty text, but is not linked to it: null texts form a group of their own.
    Repeated rows, repeated ids and rows with a null id are placed one by one. A group larger than a quota is
    split. Only the id and text columns are read, so other names cannot clash. An empty table gives an
    empty result.
    """
    text = F.col(quoted(text_col))
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"), F.crc32(F.coalesce(text, F.lit(""))).alias("crc"), F.xxhash64(text).alias("g1"), F.xxhash64(F.lit("group"), text, text.isNull()).alias("g2"))
    rows = cut(rows)
    total = rows.count()
    buckets = bucket_count(total)
    # By id and text: the copies of a text have different ids, and rows without an id different texts.
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("id", *GROUP), F.lit(buckets)).cast("int"))
    parts = cut(rows.groupBy(*GROUP, "bucket").agg(F.count(F.lit(1)).alias("n")))
    groups = parts.groupBy(*GROUP).agg(F.sum("n").alias("n")).filter("n > 1")
    cells = propagate(groups, total, shards, rounds)
    load = np.zeros(shards, np.int64)
    for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect():
        load[r["shard"]] = r["n"]
    homes = cells.groupBy(*GROUP).agg(F.array_sort(F.collect_list(F.struct("shard", "n"))).alias("homes"))  # shards at most
    before = Window.partitionBy(*GROUP).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(homes, GROUP, "left").drop("n")
    inside = Window.partitionBy(*GROUP, "bucket").orderBy("id", "bytes", "crc")
    rows = rows.join(parts, [*GROUP, "bucket"]).withColumn("nth", F.col("before") + F.row_number().over(inside) - 1)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(None).cast("int").alias("shard"))

    def step(s: Column, x: Column) -> Column:
        end = s.getField("at") + x.getField("n")
        here = (F.col("nth") >= s.getField("at")) & (F.col("nth") < end)
        return F.struct(end.alias("at"), F.when(here, x.getField("shard")).otherwise(s.getField("shard")).alias("shard"))

    rows = rows.withColumn("home", F.aggregate("homes", start, step, lambda s: s.getField("shard")))
    rows = cut(rows.select("id", "bytes", "crc", *GROUP, "home"))
    wide = bucket_count(total, 2_000, 512)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("id", *GROUP), F.lit(wide)).cast("int")).withColumn("one", F.lit(1).cast("long"))
    order = [F.col(c) for c in ("id", *GROUP, "bytes", "crc")]
    rest = running_total(rows.filter(F.col("home").isNull()), [], "bucket", order, "one", "nth")
    ends = np.cumsum(np.array(quotas(total, shards)) - load)
    fill = F.coalesce(*[F.when(F.col("nth") < int(end), F.lit(s)) for s, end in enumerate(ends)])
    rows = rows.filter(F.col("home").isNotNull()).unionByName(rest.withColumn("home", fill).drop("nth"))
    rows = running_total(cut(rows), ["home"], "bucket", order, "one", "slot")
    return rows.select(F.col("id").alias("doc_id"), (F.col("bytes") + 1).alias("size"), F.col("crc").alias("text_crc32"), F.col("home").alias("shard"), F.col("slot").cast("long").alias("slot"))


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = shard_documents(docs)
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shard_quotas(spark, sf_dir: str) -> DataFrame:
    """The part of op6_sharding that SQL can state: rows and slots of each shard, and the sizes of all."""
    found = op6_sharding(spark, sf_dir)
    total = F.sum(F.sum("size")).over(Window.partitionBy(F.lit(0)))  # over a row for each shard
    return found.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.count_distinct("slot").alias("n_slots"), total.alias("all_sizes"))


SQL = """
WITH d AS (SELECT count(*) AS n, sum(coalesce(strlen(text), 0) + 1)::BIGINT AS all_sizes FROM documents),
s AS (SELECT shard::INTEGER AS shard, n // 8 + CASE WHEN shard < n % 8 THEN 1 ELSE 0 END AS n_rows, all_sizes FROM d, range(8) r(shard))
SELECT shard, n_rows::BIGINT AS n_rows, 0::BIGINT AS first_slot, (n_rows - 1)::BIGINT AS last_slot, n_rows::BIGINT AS n_slots, all_sizes FROM s
"""
