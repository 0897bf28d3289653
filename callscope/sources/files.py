"""Entry lists, rules, build files, stored graphs and report tables on disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.operators.freq import numbered
from callscope.sources.snapshots import SnapshotStore

ENTRY = "array<struct<className:string,methodName:string,descriptor:string,source:string,group:string,excludeReason:string>>"
RULE = "struct<id:string,name:string,methodPattern:string,classPattern:string,source:string,paramCount:int,enabled:boolean,builtin:boolean>"
DEP = "struct<groupId:string,artifactId:string,version:string,type:string,scope:string>"
POM = f"""groupId string, artifactId string, version string, parent struct<groupId:string,artifactId:string,version:string,relativePath:string>, properties map<string,string>,
  dependencyManagement struct<dependencies:struct<dependency:array<{DEP}>>>, dependencies struct<dependency:array<{DEP}>>"""


def read_entries(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows of entry lists, confirmed and excluded, with their project and place.

    A file holds one object over many lines, or an object of a project on each line, as write_entries() makes them. The project is
    the object's projectPath, else the file. Files whose lines are no objects of their own are read whole; others are split by lines.
    An object with a `from` holds a part of both lists, from that place on.
    """
    schema = f"projectPath string, `from` bigint, confirmed {ENTRY}, excluded {ENTRY}"
    text = spark.read.text(paths).select(F.col("_metadata.file_path").alias("_file"), "value").filter(F.trim("value") != "")
    lines = text.select("_file", F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("o")).select("_file", "o.*")
    whole = lines.filter("_bad IS NOT NULL").select("_file").distinct()
    one = spark.read.schema(schema).option("multiLine", "true").json(paths).withColumn("_file", F.col("_metadata.file_path"))
    whole = F.broadcast(whole)  # a name for each such file; the lines stay where they are read
    rows = lines.drop("_bad").join(whole, "_file", "left_anti").unionByName(one.join(whole, "_file", "left_semi"))
    rows = rows.withColumn("project", F.coalesce("projectPath", "_file"))
    rows = rows.withColumn("_from", F.coalesce("from", F.lit(0)).cast("int"))
    parts = [rows.select("project", "_from", F.posexplode(c).alias("_pos", "e"), F.lit(c).alias("status")).withColumn("ord", F.col("_from") + F.col("_pos")) for c in ("confirmed", "excluded")]
    both = parts[0].unionByName(parts[1])
    return both.select("project", F.col("e.className").alias("class_name"), F.col("e.methodName").alias("method_name"), F.col("e.descriptor").alias("descriptor"), F.col("e.source").alias("source"), F.col("e.group").alias("group"), "status", F.col("e.excludeReason").alias("exclude_reason"), "ord")


def write_entries(rows: DataFrame, path: str, most: int = 10_000) -> None:
    """One line with a JSON object for each project: its projectPath and both lists in order.

    Lists of more than `most` entries go on in further lines of the project, each with the place `from` which its parts begin, so that no
    task holds a project's list as a whole.
    """
    rows = numbered(rows.withColumn("project", F.col("project").cast("string")), "_n", "project", "status", "ord")
    first = rows.groupBy("project", "status").agg(F.min("_n").alias("_first"))
    placed = rows.join((first.withColumnsRenamed({"project": "_p", "status": "_s"})), F.col("project").eqNullSafe(F.col("_p")) & (F.col("status") == F.col("_s")))
    placed = placed.withColumn("_at", F.col("_n") - F.col("_first"))
    item = F.struct(F.col("class_name").alias("className"), F.col("method_name").alias("methodName"), "descriptor", "source", "group", F.col("exclude_reason").alias("excludeReason"))
    lists = [F.transform(F.array_sort(F.collect_list(F.when(F.col("status") == s, F.struct("_at", item.alias("e"))))), lambda x: x.getField("e")).alias(s) for s in ("confirmed", "excluded")]
    parts = placed.groupBy(F.col("project").alias("projectPath"), (F.floor(F.col("_at") / most) * most).alias("_from")).agg(*lists)
    parts.select("projectPath", F.when(F.col("_from") > 0, F.col("_from")).alias("from"), "confirmed", "excluded").write.mode("overwrite").json(path)


def read_noise_rules(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(custom rules, overrides) of rule files: a bare array, or an object with globalOverrides and customRules."""
    raw = spark.read.text(paths, wholetext=True).withColumn("project", F.input_file_name())
    whole = F.from_json("value", f"globalOverrides map<string,boolean>, customRules array<{RULE}>")
    bare = F.from_json("value", f"array<{RULE}>")
    is_array = F.trim("value").startswith("[")
    rules = raw.select("project", F.posexplode(F.when(is_array, bare).otherwise(whole.getField("customRules"))).alias("ord", "r"))
    rules = rules.select("project", "ord", "r.id", "r.name", F.col("r.methodPattern").alias("method_pattern"), F.col("r.classPattern").alias("class_pattern"), "r.source", F.col("r.paramCount").alias("param_count"), F.coalesce("r.enabled", F.lit(True)).alias("enabled"))
    overrides = raw.filter(~is_array).select("project", F.explode(whole.getField("globalOverrides")).alias("id", "enabled"))
    return rules, overrides


def read_poms(spark: SparkSession, path: str) -> DataFrame:
    """Build files as rows: path, own and parent coordinates, properties, managed and declared dependencies."""
    rows = spark.read.format("xml").option("rowTag", "project").schema(POM).load(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), "*")


def pom_links(poms: DataFrame) -> DataFrame:
    """(pom, path, gav, parent_gav, relative_path) of read_poms(), for poms.link_parents(); a file is named by its path.

    A file without a group or version has its parent's.
    """
    gav = lambda *parts: F.when(F.greatest(*[p.isNull() for p in parts]), F.lit(None)).otherwise(F.concat_ws(":", *parts))
    parent = [F.col(f"parent.{c}") for c in ("groupId", "artifactId", "version")]
    own = F.coalesce("groupId", parent[0]), F.col("artifactId"), F.coalesce("version", parent[2])
    return poms.select(F.col("path").alias("pom"), "path", gav(*own).alias("gav"), gav(*parent).alias("parent_gav"), F.col("parent.relativePath").alias("relative_path"))


def write_graphs(nodes: DataFrame, edges: DataFrame, stats: DataFrame, path: str, buckets: int | None = None) -> int:
    """Adds graphs to the store at a path, with stats as its index, and gives the store's new version.

    The entries of any of the tables are replaced in all three; all others stay. buckets: of entries, for a new store (16). See
    snapshots.SnapshotStore for readers and writers at the same time, older versions and compaction.
    """
    tables = {"nodes": nodes, "edges": edges, "stats": stats}
    return SnapshotStore(nodes.sparkSession, path, {name: df.schema for name, df in tables.items()}, buckets).put(tables)


def read_graphs(spark: SparkSession, path: str, version: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, stats) of a store at its last version, or at another one."""
    store = SnapshotStore(spark, path)
    return tuple(store.read(name, version) for name in ("nodes", "edges", "stats"))


HEADER = "被调方法,调用方方法,行号"


def _csv_field(text) -> Column:
    """A text as a CSV field: quoted if it has a quote, comma or line break; what it holds stays as it is."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(text.rlike("[\",\r\n]"), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def callers_lines(callers: DataFrame) -> Column:
    """Call sites (callee, caller, line) as CSV lines; no line number when it is not positive."""
    line = F.when(F.col("line") > 0, F.col("line").cast("string"))
    return F.concat_ws(",", _csv_field(F.col("callee")), _csv_field(F.col("caller")), F.coalesce(line, F.lit("")))


def write_callers_csv(callers: DataFrame, path: str, ordered: bool = False) -> None:
    """Call sites of one method (callee, caller, line) as CSV in parts: quoted text, CRLF between rows only, no line number when it is not positive.

    Each part has the header, as Spark reads them. With ordered=True the parts, one after the other by name, are one file: the header
    once, then the rows by callee, caller and line; no part is sorted or written by one task alone.
    """
    rows = callers.select("callee", "caller", "line", callers_lines(callers).alias("value"))
    if ordered:
        head = callers.sparkSession.range(1).select(*[F.lit(None).cast(callers.schema[c].dataType).alias(c) for c in ("callee", "caller", "line")], F.lit(HEADER).alias("value"), F.lit(0).alias("_part"))
        rows = rows.withColumn("_part", F.lit(1)).unionByName(head).orderBy("_part", "callee", "caller", "line").select("value")
    else:
        first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0  # of a part
        rows = rows.select(F.when(first, F.concat(F.lit(HEADER + "\r\n"), "value")).otherwise(F.col("value")).alias("value"))
    rows.write.mode("overwrite").option("lineSep", "\r\n").text(path)


def write_ranked(rows: DataFrame, path: str, *order, per_range: int = 1_000_000) -> None:
    """rows with their `rank` in an order, which must be total, in folders of `per_range` ranks each, for read_page()."""
    ranked = numbered(rows, "rank", *order).withColumn("rank_range", F.floor((F.col("rank") - 1) / per_range).cast("bigint"))
    ranked.write.mode("overwrite").partitionBy("rank_range").parquet(path)
    rows.sparkSession.createDataFrame([(per_range,)], "per_range bigint").coalesce(1).write.mode("overwrite").json(f"{path}/_ranges")


def read_page(spark: SparkSession, path: str, number: int, size: int = 50) -> DataFrame:
    """Page `number`, from 1, of rows that write_ranked() stored: only the folders that hold its ranks are read, however deep it is."""
    per_range = spark.read.schema("per_range bigint").json(f"{path}/_ranges").first()[0]
    first, last = (number - 1) * size + 1, number * size
    inside = F.col("rank_range").between((first - 1) // per_range, (last - 1) // per_range) & F.col("rank").between(first, last)
    return spark.read.parquet(path).filter(inside).drop("rank_range")


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """Each report table in a folder of its own."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
