"""Queries that write tables of the views to files and read them back, in the folder that all executors share."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.operators import freq, graph, incremental, report, substring
from callscope.operators.base import shared_folder
from callscope.plans import testviews as tv
from callscope.plans.graph_queries import E_SQL, R_SQL, edges, reach_sql, roots
from callscope.plans.list_queries import L_SQL, saved
from callscope.plans.registry import query
from callscope.sources import classfile, files
from callscope.sources.snapshots import SnapshotStore


def new_folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Graphs of depth 1, stored; then every third entry is stored again with its root only.
STORE_SQL = f"WITH {E_SQL}, {R_SQL}, n AS (SELECT entry_id, method_id FROM roots UNION SELECT entry_id, to_id FROM roots JOIN e ON method_id = from_id)"


def stored_graphs(spark, sf_dir):
    r, e = roots(spark, sf_dir), edges(spark, sf_dir)
    nodes = graph.reachable(r, e, 1)
    inner, path = graph.graph_edges(nodes, e, 1), new_folder(spark, "graphs")
    count = lambda rows: rows.groupBy("entry_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    files.write_graphs(nodes.select("entry_id", "method_id"), inner, count(nodes), path)
    again = r.filter("entry_id % 3 = 0")
    files.write_graphs(again, inner.limit(0), count(again), path)
    return files.read_graphs(spark, path)


@query("graph_store", f"{STORE_SQL} SELECT entry_id, method_id FROM n WHERE entry_id % 3 > 0 UNION ALL SELECT entry_id, method_id FROM roots WHERE entry_id % 3 = 0")
def graph_store(spark, sf_dir):
    return stored_graphs(spark, sf_dir)[0].select("entry_id", "method_id")


@query("graph_index", f"{STORE_SQL} SELECT entry_id, CASE WHEN entry_id % 3 = 0 THEN 1 ELSE count(*) END::BIGINT AS n_nodes FROM n GROUP BY entry_id")
def graph_index(spark, sf_dir):
    return stored_graphs(spark, sf_dir)[2].select("entry_id", "n_nodes")


@query("entry_files", f"{L_SQL} SELECT concat('com.C', key) AS class_name, status, exclude_reason, (row_number() OVER (PARTITION BY status ORDER BY key) - 1)::INTEGER AS ord FROM saved")
def entry_files(spark, sf_dir):
    """Entry lists of one project written as JSON and read back: both lists in order."""
    rows, path = saved(spark, sf_dir), new_folder(spark, "entries")
    rows = rows.select(F.lit("p").alias("project"), F.concat(F.lit("com.C"), "key").alias("class_name"), F.lit("m").alias("method_name"), F.lit("()V").alias("descriptor"), F.lit("MANUAL").alias("source"), F.lit("g").alias("group"), "status", "exclude_reason", F.col("key").alias("ord"))
    files.write_entries(rows, path)
    return files.read_entries(spark, [path]).select("class_name", "status", "exclude_reason", "ord")


@query(
    "entry_files_fleet",
    f"{L_SQL}, q AS (SELECT s.*, concat('p', id % 20) AS project FROM saved s JOIN o USING (key)) SELECT project, concat('com.C', key) AS class_name, status, exclude_reason, (row_number() OVER (PARTITION BY project, status ORDER BY key) - 1)::INTEGER AS ord FROM q",
)
def entry_files_fleet(spark, sf_dir):
    """Entry lists of twenty projects written to one folder and read back."""
    rows, path = saved(spark, sf_dir).join(tv.view(spark, sf_dir, tv.ENTRIES).select("key", "id"), "key"), new_folder(spark, "entries")
    rows = rows.select(F.concat(F.lit("p"), (F.col("id") % 20).cast("string")).alias("project"), F.concat(F.lit("com.C"), "key").alias("class_name"), F.lit("m").alias("method_name"), F.lit("()V").alias("descriptor"), F.lit("MANUAL").alias("source"), F.lit("g").alias("group"), "status", "exclude_reason", F.col("key").alias("ord"))
    files.write_entries(rows, path)
    return files.read_entries(spark, [path]).select("project", "class_name", "status", "exclude_reason", "ord")


#: A store of several versions: graphs of depth 1; entries divisible by 3 keep their root only, those divisible by 5 go; then it is compacted.
HISTORY_SQL = f"""{STORE_SQL}, v AS (SELECT entry_id, method_id FROM n WHERE entry_id % 5 > 0 AND entry_id % 3 > 0 UNION ALL SELECT entry_id, method_id FROM roots WHERE entry_id % 3 = 0 AND entry_id % 5 > 0)"""


@query("graph_history", f"{HISTORY_SQL} SELECT 'now' AS version, entry_id, method_id FROM v UNION ALL SELECT 'first', entry_id, method_id FROM n")
def graph_history(spark, sf_dir):
    """The nodes of a store after three writes and a compaction, and those of its first version."""
    r, e = roots(spark, sf_dir), edges(spark, sf_dir)
    nodes = graph.reachable(r, e, 1).select("entry_id", "method_id")
    inner, path = graph.graph_edges(graph.reachable(r, e, 1), e, 1), new_folder(spark, "graphs")
    count = lambda rows: rows.groupBy("entry_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    first = files.write_graphs(nodes, inner, count(nodes), path)
    again = r.filter("entry_id % 3 = 0").select("entry_id", "method_id")
    files.write_graphs(again, inner.limit(0), count(again), path)
    store = SnapshotStore(spark, path)
    store.delete(r.filter("entry_id % 5 = 0"))
    store.compact()
    now = store.read("nodes").withColumn("version", F.lit("now"))
    return now.unionByName(store.read("nodes", first).withColumn("version", F.lit("first"))).select("version", "entry_id", "method_id")


#: Rule files of suppliers: every second one is a bare array, the others are objects.
RULE_FILES = """SELECT s_suppkey AS project, CASE WHEN s_suppkey % 2 = 0 THEN concat('[{{"id":"r', CAST(s_suppkey AS VARCHAR(20)), '","name":"n","methodPattern":"get","source":"ALL","enabled":false}}]')
  ELSE concat('{{"globalOverrides":{{"g1":', CASE WHEN s_suppkey % 3 = 0 THEN 'true' ELSE 'false' END, '}},"customRules":[{{"id":"r', CAST(s_suppkey AS VARCHAR(20)), '","paramCount":', CAST(s_suppkey % 4 AS VARCHAR(9)), '}}]}}') END AS value FROM {supplier}"""


def rule_files(spark, sf_dir):
    path = new_folder(spark, "rules")
    tv.view(spark, sf_dir, RULE_FILES).repartition("project").write.partitionBy("project").text(path)
    return files.read_noise_rules(spark, [f"{path}/*"])


@query("rule_files", "SELECT concat('r', s_suppkey) AS id, CASE WHEN s_suppkey % 2 = 1 THEN s_suppkey % 4 END::INTEGER AS param_count, s_suppkey % 2 = 1 AS enabled FROM supplier")
def rule_file_rules(spark, sf_dir):
    return rule_files(spark, sf_dir)[0].select("id", "param_count", "enabled")


@query("rule_overrides", "SELECT 'g1' AS id, s_suppkey % 3 = 0 AS enabled, count(*)::BIGINT AS n FROM supplier WHERE s_suppkey % 2 = 1 GROUP BY 2")
def rule_file_overrides(spark, sf_dir):
    return rule_files(spark, sf_dir)[1].groupBy("id", "enabled").agg(F.count(F.lit(1)).alias("n"))


POM_FILES = """SELECT pom AS file, concat('<project>', CASE WHEN parent IS NOT NULL THEN concat('<parent><groupId>g</groupId><artifactId>', parent, '</artifactId><version>1</version></parent>') ELSE '' END, '<artifactId>', pom, '</artifactId><version>', CAST(num AS VARCHAR(9)),
  '</version><properties><k>v', CAST(num AS VARCHAR(9)), '</k></properties></project>') AS value FROM {p}"""


@query("pom_files", f"WITH p AS {tv.plain(tv.POMS)} SELECT pom AS artifact, num::VARCHAR AS version, parent, concat('v', num) AS k FROM p")
def pom_files(spark, sf_dir):
    """Build files of the supplier chain written as XML and read back."""
    path = new_folder(spark, "poms")
    spark.sql(POM_FILES, p=tv.view(spark, sf_dir, tv.POMS)).repartition("file").write.partitionBy("file").text(path)  # a file for each
    return files.read_poms(spark, path).select(F.col("artifactId").alias("artifact"), "version", F.col("parent.artifactId").alias("parent"), F.element_at("properties", "k").alias("k"))


@query("callers_csv", f"WITH s AS {tv.plain(tv.SITES)} SELECT DISTINCT concat('m\"', callee_id, '\"') AS callee, concat('c, ', caller_id) AS caller, CASE WHEN line > 1 THEN line::VARCHAR END AS line FROM s")
def callers_csv(spark, sf_dir):
    """Call sites written as CSV and read back: quotes and commas come through, lines that are not positive are empty."""
    path = new_folder(spark, "callers")
    rows = tv.view(spark, sf_dir, tv.SITES).select("callee_id", "caller_id", "line").distinct()
    files.write_callers_csv(rows.select(F.format_string('m"%d"', "callee_id").alias("callee"), F.format_string("c, %d", "caller_id").alias("caller"), F.when(F.col("line") > 1, F.col("line")).otherwise(0).alias("line")), path)
    back = spark.read.option("header", "true").option("escape", '"').schema("callee string, caller string, line string").csv(path)
    return back.distinct()


def class_file(name: str, parent: str | None, interfaces: list[str], access: int, methods: list[tuple[str, str, int]]) -> bytes:
    """A class file without code."""
    pool: list[bytes] = []

    def constant(entry: bytes) -> bytes:
        if entry not in pool:
            pool.append(entry)
        return (pool.index(entry) + 1).to_bytes(2, "big")

    def text(value: str) -> bytes:
        raw = value.encode()
        return constant(b"\x01" + len(raw).to_bytes(2, "big") + raw)

    two = lambda n: n.to_bytes(2, "big")
    named = lambda value: constant(b"\x07" + text(value)) if value else two(0)
    body = two(access) + named(name) + named(parent or "java/lang/Object") + two(len(interfaces)) + b"".join(map(named, interfaces)) + two(0)
    body += two(len(methods)) + b"".join(two(flags) + text(method) + text(descriptor) + two(0) for method, descriptor, flags in methods) + two(0)
    return b"\xca\xfe\xba\xbe\0\0\0\x34" + two(len(pool) + 1) + b"".join(pool) + body


def write_jars(classes, folder: str) -> None:
    """A jar for each `jar` of classes (class_name, super_name, iface, access, methods), with a damaged entry and one that is no class file."""

    def write(frame):
        import io
        import zipfile

        import pandas as pd
        import pyarrow.fs

        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as jar:
            for r in frame.itertuples():
                jar.writestr(f"{r.class_name}.class", class_file(r.class_name, r.super_name, [r.iface] if r.iface else [], r.access, [tuple(m.values()) if isinstance(m, dict) else tuple(m) for m in r.methods]))
            jar.writestr("com/odd/Text.class", "no class")
            jar.writestr("com/odd/Broken.class", "abc" * 500)
            broken = jar.infolist()[-1]
        data = bytearray(held.getvalue())
        at = broken.header_offset + 30 + len(broken.filename)
        data[at : at + 8] = b"\xff" * 8
        system, where = pyarrow.fs.FileSystem.from_uri(folder.replace("file:/", "file:///", 1) if "://" not in folder else folder)
        system.create_dir(where, recursive=True)
        with system.open_output_stream(f"{where}/{frame['jar'].iloc[0]}.jar") as out:
            out.write(bytes(data))
        return pd.DataFrame({"jar": frame["jar"].iloc[:1]})

    classes.groupBy("jar").applyInPandas(write, "jar string").count()


JAR_SQL = f"WITH c AS {tv.plain(tv.CLASSES)}, d AS {tv.plain(tv.DECLARED)}"


def jar_entries(spark, sf_dir):
    """The class view as jars, a jar for each last digit, written and read back."""
    path = new_folder(spark, "jars")
    classes, declared = tv.view(spark, sf_dir, tv.CLASSES), tv.view(spark, sf_dir, tv.DECLARED)
    own = declared.groupBy(F.col("owner").alias("class_name")).agg(F.array_sort(F.collect_list(F.struct("name", "descriptor", "access"))).alias("methods"))
    rows = classes.join(own, "class_name", "left").withColumn("methods", F.coalesce("methods", F.array().cast("array<struct<name:string,descriptor:string,access:int>>")))
    write_jars(rows.withColumn("jar", F.concat(F.lit("j"), F.right("class_name", F.lit(1)))), path)
    return classfile.read_entries_of_jars(spark, [path])


@query("jar_classes", f"{JAR_SQL}, n AS (SELECT owner, count(*) AS n, min(name) AS first FROM d GROUP BY owner) SELECT class_name, coalesce(super_name, 'java/lang/Object') AS super_name, iface, access, coalesce(n, 0)::INTEGER AS n_methods, first FROM c LEFT JOIN n ON owner = class_name")
def jar_classes(spark, sf_dir):
    found = classfile.class_rows(jar_entries(spark, sf_dir))
    return found.select("class_name", "super_name", F.get("interfaces", F.lit(0)).alias("iface"), "access", F.size("methods").alias("n_methods"), F.array_min(F.transform("methods", lambda m: m.getField("name"))).alias("first"))


@query("jar_skipped", f"{JAR_SQL} SELECT concat('j', right(class_name, 1), '.jar') AS jar, e AS entry FROM c, (VALUES ('com/odd/Text.class'), ('com/odd/Broken.class')) x(e) GROUP BY ALL")
def jar_skipped(spark, sf_dir):
    """What of the jars could not be read."""
    return classfile.skipped(jar_entries(spark, sf_dir)).select(F.substring_index("location", "/", -1).alias("jar"), "entry")


@query("report_files", f"WITH s AS {tv.plain(tv.SITES)}, f AS (SELECT callee_id, count(DISTINCT (caller_id, line)) AS n FROM s GROUP BY callee_id) SELECT row_number() OVER (ORDER BY n DESC, callee_id)::BIGINT AS rank, callee_id AS method_id, n::BIGINT AS call_count FROM f")
def report_files(spark, sf_dir):
    """The call-count table of a report, stored with the others and read back."""
    path = new_folder(spark, "report")
    sites = tv.view(spark, sf_dir, tv.SITES).select("callee_id", "caller_id", "line").distinct()
    counts = sites.groupBy(F.col("callee_id").alias("method_id")).agg(F.count(F.lit(1)).alias("call_count"))
    frequency = counts.withColumns({"sig": F.lit("s"), "source": F.lit("PROJECT"), "noise": F.lit(False), "rules": F.lit("")})
    texts = freq.callers_text(sites.select("callee_id", F.col("caller_id").cast("string").alias("caller"), "line")).select(F.col("callee_id").alias("method_id"), "callers")
    files.write_report({"call_counts": report.frequency_sheet(frequency, texts), "filtered_out": report.filtered_sheet(frequency, texts)}, path)
    assert spark.read.parquet(f"{path}/filtered_out").isEmpty()
    return spark.read.parquet(f"{path}/call_counts").select("rank", "method_id", "call_count")


@query("ranked_page", f"WITH s AS {tv.plain(tv.SITES)}, f AS (SELECT callee_id, count(*)::BIGINT AS n FROM s GROUP BY callee_id), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, callee_id) AS rank FROM f) SELECT rank, callee_id, n FROM r WHERE rank BETWEEN 61 AND 90")
def ranked_page(spark, sf_dir):
    """The third page of thirty methods by calls, of a stored ranking."""
    path = new_folder(spark, "ranks")
    files.write_ranked(tv.view(spark, sf_dir, tv.SITES).groupBy("callee_id").agg(F.count(F.lit(1)).alias("n")), path, F.desc("n"), "callee_id", per_range=40)
    return files.read_page(spark, path, 3, 30).select("rank", "callee_id", "n")


#: Calls of line 4 are not there at first, those of line 3 go, and so do the entries divisible by 11.
REFRESH_SQL = f"WITH RECURSIVE raw0 AS {tv.plain(tv.EDGES)}, e AS (SELECT DISTINCT from_id, to_id, 'STATIC' AS invoke, line FROM raw0 WHERE line <> 3), r0 AS {tv.plain(tv.ROOTS)}, roots AS (SELECT * FROM r0 WHERE entry_id % 11 > 0), {reach_sql(8)}"


@query("graph_refresh", f"{REFRESH_SQL} SELECT entry_id, method_id, depth FROM n")
def graph_refresh(spark, sf_dir):
    """A store of graphs brought up to changed calls; only entries that reach them are walked again."""
    calls = tv.view(spark, sf_dir, tv.EDGES).select("from_id", "to_id", F.lit("STATIC").alias("invoke"), "line").distinct()
    old, new, r, path = calls.filter("line <> 4"), calls.filter("line <> 3"), roots(spark, sf_dir), new_folder(spark, "graphs")
    nodes = graph.reachable(r, old, 8)
    files.write_graphs(nodes, graph.graph_edges(nodes, old, 8), nodes.groupBy("entry_id").agg(F.count(F.lit(1)).alias("n_nodes")), path)
    store = SnapshotStore(spark, path)
    incremental.refresh_graphs(store, r.filter("entry_id % 11 > 0"), new, incremental.changed_methods(old, new), 8)
    return store.read("nodes").select("entry_id", "method_id", "depth")


TERMS = ("Brand11", "getN", "g", "to", "economy/Brand3", "no such name", "<in", "com/acme/large anodized tin/brand4")


@query(
    "substring_search",
    f"WITH m AS {tv.plain(tv.METHODS)}, t AS (SELECT unnest({list(TERMS)}) AS term) SELECT term, method_id FROM t JOIN m ON contains(lower(concat(owner, '.', name)), lower(term))",
)
def substring_search(spark, sf_dir):
    """Which method names hold terms of one to thirty letters, from the stored postings of their letters."""
    path = new_folder(spark, "substrings")
    substring.write_index(tv.view(spark, sf_dir, tv.METHODS).select(F.col("method_id").alias("id"), F.concat("owner", F.lit("."), "name").alias("text")), path, folders=8)
    found = [substring.find(spark, path, t).select(F.lit(t).alias("term"), F.col("id").alias("method_id")) for t in TERMS]
    return reduce(DataFrame.unionByName, found)
