"""Mixing sources to target weights: Efraimidis-Spirakis sampling, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callscope.llm.common import SPACES, bucket_count, cut, packed, quoted, unpacked

#: Quality weights lie between these; the smallest also scales the buckets of the keys.
LEAST_WEIGHT, MOST_WEIGHT = 0.5, 1.0


def quality_weight(text: Column) -> Column:
    """From LEAST_WEIGHT to MOST_WEIGHT: the share of letters of any script among the characters that are not white space.

    Texts without such characters have the least weight.
    """
    shown = F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}\p{M}]+", ""))
    return F.lit(LEAST_WEIGHT) + (MOST_WEIGHT - LEAST_WEIGHT) * F.when(shown > 0, letters / shown).otherwise(0.0)


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most_epochs: float) -> DataFrame:
    """Targets of the sources: (source, source_size) in, with target out.

    The weights repeat over the sources by code point, null last. `share` times all sizes is
    shared by weight; a target stops at `most_epochs` times its source's size and the excess
    is shared again by weight, until none is above. In the end each target is the smaller of
    its cap and weight * level, so sources are filled in order of cap / weight.
    """
    ranked = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (ranked % len(weights) + 1).cast("int"))
    df = sizes.withColumn("_w", weight).withColumn("_cap", most_epochs * F.col("source_size"))
    everything = Window.partitionBy(F.lit(0))
    full_at = Window.partitionBy(F.lit(0)).orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before, onward = full_at.rowsBetween(Window.unboundedPreceding, -1), full_at.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    budget = share * F.sum("source_size").over(everything)
    level = (budget - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(onward)
    df = df.withColumn("_level", level).withColumn("_open", F.col("_level") * F.col("_w") < F.col("_cap"))
    # The first source that its level does not fill sets the level of all that follow.
    df = df.withColumn("_last", F.min(F.when(F.col("_open"), F.struct((F.col("_cap") / F.col("_w")).alias("r"), F.col("_level").alias("level")))).over(everything))
    open_target = F.least(F.col("_cap"), F.col("_last.level") * F.col("_w"))
    return df.withColumn("target", F.coalesce(open_target, F.col("_cap")).cast("double")).drop("_w", "_cap", "_level", "_open", "_last")


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most_epochs: float = 2.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None, carry: bool = False) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row of docs.

    size is the number of words; source_targets() sets the targets. A source first gives whole
    epochs: every document floor(target / source_size) times. What is left of its target is
    filled by Efraimidis-Spirakis sampling: documents stand by -ln(u) / w, u a hash of the id,
    the text and `seed`, w quality_weight(); their sizes are summed in that order, and a document is
    taken once more while at least half of it lies within the rest. So a source misses its target
    by half a document at most. taken is size times the number of times.

    With carry, the columns are docs' own and `taken` and `times` instead; docs' own columns of these two
    names are replaced. weight_col: a column of positive weights in place of quality_weight(); null,
    nonpositive and non-finite weights count as LEAST_WEIGHT, and all are held between the two bounds.

    Null and blank texts have size 0 and take nothing. Null is a source of its own. Rows of equal id
    and text have equal keys; which of them is taken does not show. Sources of size 0 have target 0.
    An empty table gives an empty result. Sources are few; their names are never collected.
    """
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACES))
    size = F.when(F.length(trimmed) > 0, F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))).otherwise(0).cast("long")
    u = (F.shiftrightunsigned(F.xxhash64(F.col(quoted(id_col)), text, F.lit(seed)), 11) + 0.5) / float(2**53)
    weight = quality_weight(text)
    if weight_col is not None:
        given = F.col(quoted(weight_col)).cast("double")
        weight = F.when((given > 0) & (given < float("inf")), F.greatest(F.lit(LEAST_WEIGHT), F.least(F.lit(MOST_WEIGHT), given))).otherwise(LEAST_WEIGHT)
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.xxhash64(text).alias("text"), F.col(quoted(source_col)).cast("string").alias("source"), size.alias("size"), (-F.log(u) / weight).alias("key"))
    rows = cut(rows)  # a few numbers for each document; the texts are read once
    buckets = bucket_count(rows.count())
    # The keys of one source fill the buckets evenly, to within MOST_WEIGHT / LEAST_WEIGHT.
    rows = rows.withColumn("bucket", F.floor(buckets * (1 - F.exp(-F.col("key") * LEAST_WEIGHT))).cast("int"))
    cells = rows.groupBy("source", "bucket").agg(F.sum("size").alias("cell"))
    sizes = cells.groupBy("source").agg(F.sum("cell").alias("source_size"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("source", "bucket", F.coalesce(F.sum("cell").over(before), F.lit(0)).alias("before"))
    targets = source_targets(sizes, weights, share, most_epochs).withColumnRenamed("source", "s")
    cells = cells.join(targets, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumnsRenamed({"source": "cell_source", "bucket": "cell_bucket"})
    rows = rows.join(cells, F.col("source").eqNullSafe(F.col("cell_source")) & (F.col("bucket") == F.col("cell_bucket")))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "id", "text").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("target") - epochs * F.col("source_size")
    times = (epochs + F.when(start + F.col("size") / 2 <= rest, 1).otherwise(0)).cast("long")
    times = F.least(times, F.ceil(F.lit(most_epochs)).cast("long"))
    rows = rows.withColumn("times", F.when(F.col("size") > 0, times).otherwise(0))
    rows = rows.select("id", "text", "source", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))
    if not carry:
        return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
    # Equal ids and texts have equal keys, so the k-th of them takes the k-th largest number of times.
    twin = Window.partitionBy("id", "text", "source")
    rows = rows.withColumn("nth", F.row_number().over(twin.orderBy(F.desc("times"))))
    full = docs.select(packed(docs).alias("_row"), F.col(quoted(id_col)).alias("_id"), F.xxhash64(text).alias("_text"), F.col(quoted(source_col)).cast("string").alias("_source"))
    full = full.withColumn("_nth", F.row_number().over(Window.partitionBy("_id", "_text", "_source").orderBy("_id")))
    same = F.col("_id").eqNullSafe(F.col("id")) & (F.col("_text") == F.col("text")) & F.col("_source").eqNullSafe(F.col("source")) & (F.col("_nth") == F.col("nth"))
    keep = [c for c in docs.columns if c not in ("times", "taken")]
    full = full.join(rows, same)
    return unpacked(full, [*keep, "times", "taken"], changed={"times": F.col("times"), "taken": F.col("taken")})


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_sources(docs)


def mix_targets(spark, sf_dir: str) -> DataFrame:
    """The part of op7_mixing that SQL can state: sizes and targets."""
    return op7_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


#: A source is full if the level that is left for it and for all with a larger cap by weight reaches its cap.
SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ([5, 2, 1])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY source),
r AS (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s),
t AS (SELECT source, source_size, least(2 * source_size, coalesce((SELECT arg_min(level, 2 * source_size / w) FILTER (level * w < 2 * source_size) FROM r), 1e300) * w) AS target FROM r)
SELECT doc_id, size, source_size, round(target, 3)::DOUBLE AS target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""
