"""Call counts over all entries of a project."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callscope.operators.base import stored


def call_sites(edges: DataFrame) -> DataFrame:
    """Distinct (callee_id, caller_id, line): a call site that many entries reach counts once."""
    return edges.select("callee_id", "caller_id", "line").distinct()


def project_frequency(edges: DataFrame) -> DataFrame:
    """(callee_id, call_count): distinct call sites of each method over all entries."""
    return call_sites(edges).groupBy("callee_id").agg(F.count(F.lit(1)).alias("call_count"))


def callers_of(edges: DataFrame, method_id) -> DataFrame:
    """All distinct call sites of one method; the filter reaches the scan."""
    return call_sites(edges.filter(F.col("callee_id") == method_id))


def callers_text(sites: DataFrame, most: int = 20) -> DataFrame:
    """(callee_id, call_count, callers): the first call sites as `caller  L<line>` lines, and how many more.

    sites: distinct (callee_id, caller, line). No more than `most` sites of a method are gathered.
    """
    rank = F.row_number().over(Window.partitionBy("callee_id").orderBy("caller", "line"))
    counts = sites.groupBy("callee_id").agg(F.count(F.lit(1)).alias("call_count"))
    first = sites.withColumn("_r", rank).filter(F.col("_r") <= most).groupBy("callee_id").agg(F.array_sort(F.collect_list(F.struct("_r", "caller", "line"))).alias("_f"))
    lines = F.array_join(F.transform("_f", lambda x: F.concat(x.getField("caller").cast("string"), F.when(x.getField("line") > 0, F.concat(F.lit("  L"), x.getField("line").cast("string"))).otherwise(F.lit("")))), "\n")
    more = F.when(F.col("call_count") > most, F.concat(F.lit("\n… 另有 "), (F.col("call_count") - most).cast("string"), F.lit(" 处调用"))).otherwise(F.lit(""))
    return counts.join(first, "callee_id").select("callee_id", "call_count", F.concat(lines, more).alias("callers"))


def numbered(rows: DataFrame, name: str, *order) -> DataFrame:
    """All rows, numbered from 1 in order (bigint), which must be total. No task sees more than a range of them.

    The rows are sorted once, in ranges; a row's number is its place in its range and the sizes of the ranges before it,
    one number for each partition.
    """
    ranges = stored(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    sizes = ranges.groupBy(F.shiftright("_at", 33).alias("_range")).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    joined = ranges.join(F.broadcast(sizes), F.shiftright("_at", 33) == F.col("_range"))
    return joined.withColumn(name, F.col("_before") + inside).drop("_at", "_range", "_before")


def page(freq: DataFrame, number: int, size: int = 50, *order) -> DataFrame:
    """Page `number`, from 1."""
    return freq.orderBy(*order).offset((number - 1) * size).limit(size)


def split_frequency(freq: DataFrame, noise: str = "noise") -> tuple[DataFrame, DataFrame]:
    """Rows that are kept and rows that rules filter out."""
    return freq.filter(~F.col(noise)), freq.filter(F.col(noise))


def frequency_summary(freq: DataFrame) -> DataFrame:
    """One row: methods kept and removed, greatest and smallest count."""
    return freq.agg(F.count_if(~F.col("noise")).alias("n_kept"), F.count_if("noise").alias("n_removed"), F.max("call_count").alias("max_count"), F.min("call_count").alias("min_count"))


def kept_totals(freq: DataFrame) -> DataFrame:
    """One row: all calls of kept methods, and the method called most (ties: smallest id)."""
    return freq.filter(~F.col("noise")).agg(F.sum("call_count").alias("total_calls"), F.max_by("method_id", F.struct("call_count", (-F.col("method_id")).alias("tie"))).alias("top_method"))


def source_counts(rows: DataFrame) -> DataFrame:
    """Rows by source, with ALL."""
    return rows.rollup("source").agg(F.count(F.lit(1)).alias("n")).withColumn("source", F.coalesce("source", F.lit("ALL")))
