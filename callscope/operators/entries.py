"""Entry lists, stored results, project state, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callscope.operators.base import cut

EXCLUDED_BY_USER = "用户排除"


def entry_key(cls: Column, method: Column, desc: Column) -> Column:
    return F.concat_ws("#", cls, F.coalesce(method, F.lit("")), F.coalesce(desc, F.lit("")))


def diff_entries(candidates: DataFrame, saved: DataFrame) -> DataFrame:
    """Candidates by key with `known`: whether the list, confirmed or excluded, has them."""
    keys = saved.select("key", F.lit(True).alias("known")).distinct()
    return candidates.join(keys, "key", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def merge_entries(candidates: DataFrame, saved: DataFrame) -> DataFrame:
    """The saved list with new candidates confirmed; `outcome` says added, existed or kept for every key."""
    new = candidates.select("key").distinct().withColumn("_new", F.lit(True))
    found = saved.join(new, "key", "full_outer")
    outcome = F.when(F.col("status").isNull(), "added").when(F.col("_new").isNotNull() & (F.col("status") == "confirmed"), "existed").otherwise("kept")
    return found.select("key", F.coalesce("status", F.lit("confirmed")).alias("status"), outcome.alias("outcome"))


def add_entries(added: DataFrame, saved: DataFrame) -> DataFrame:
    """Manual adds by key: confirmed ones existed, excluded ones are moved back, others are added."""
    found = added.select("key").distinct().join(saved, "key", "left")
    outcome = F.when(F.col("status") == "confirmed", "existed").when(F.col("status") == "excluded", "moved").otherwise("added")
    return found.select("key", outcome.alias("outcome"))


def exclude_entries(saved: DataFrame, keys: DataFrame, reason: str = EXCLUDED_BY_USER) -> DataFrame:
    """The list with the confirmed entries of keys excluded for a reason."""
    marked = saved.join(keys.select("key", F.lit(True).alias("_x")).distinct(), "key", "left")
    moved = F.col("_x").isNotNull() & (F.col("status") == "confirmed")
    return marked.withColumn("exclude_reason", F.when(moved, F.lit(reason)).otherwise(F.col("exclude_reason"))).withColumn("status", F.when(moved, "excluded").otherwise(F.col("status"))).drop("_x")


def restore_entries(saved: DataFrame, keys: DataFrame) -> DataFrame:
    """The list with the excluded entries of keys confirmed again, their reason cleared."""
    marked = saved.join(keys.select("key", F.lit(True).alias("_x")).distinct(), "key", "left")
    back = F.col("_x").isNotNull() & (F.col("status") == "excluded")
    return marked.withColumn("exclude_reason", F.when(~back, F.col("exclude_reason"))).withColumn("status", F.when(back, "confirmed").otherwise(F.col("status"))).drop("_x")


def delete_entries(saved: DataFrame, keys: DataFrame) -> DataFrame:
    return saved.join(keys, "key", "left_anti")


def extract_by_class(scanned: DataFrame, text: str) -> DataFrame:
    """Scan rows whose class is or contains the text, marked as manual."""
    return scanned.filter(F.col("class_name").contains(text)).withColumn("source", F.lit("MANUAL"))


def filter_entries(rows: DataFrame, text: str) -> DataFrame:
    """Entries with the text, in any case, in display, class or method."""
    return rows.filter(F.lower(F.concat_ws("\n", "display", "class_name", "method_name")).contains(text.lower()))


def failed_entries(stats: DataFrame, failed: bool = True) -> DataFrame:
    """The failed, or the done, entries of a batch."""
    return stats.filter(F.col("failed") == failed)


def prune_stale(results: DataFrame, batch: DataFrame) -> DataFrame:
    """Stored results whose name this batch does not have: those to drop."""
    return results.join(batch.select("name").distinct(), "name", "left_anti")


def upsert_profiles(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Profiles by id with incoming ones in place of stored ones; outcome: added, replaced, kept."""
    new = incoming.select("id", F.col("name").alias("_name"))
    found = stored.join(new, "id", "full_outer")
    outcome = F.when(F.col("name").isNull(), "added").when(F.col("_name").isNotNull(), "replaced").otherwise("kept")
    return found.select("id", F.coalesce("_name", "name").alias("name"), outcome.alias("outcome"))


def stale_entries(runs: DataFrame, current: DataFrame) -> DataFrame:
    """Entries of current (key, fingerprint) whose stored fingerprint is missing or another."""
    old = runs.select("key", F.col("fingerprint").alias("_old"))
    return current.join(old, "key", "left").filter(~F.col("fingerprint").eqNullSafe(F.col("_old"))).select("key", "fingerprint")


def entry_set_fingerprint(rows: DataFrame, by: list[str]) -> DataFrame:
    """md5 of an entry set's sorted distinct keys, joined by |; '' for an empty set. A set is one project's list."""
    keys = F.array_sort(F.collect_set("key"))
    return rows.groupBy(*by).agg(F.when(F.count("key") > 0, F.md5(F.array_join(keys, "|"))).otherwise("").alias("fingerprint"))


def project_fingerprint(files: DataFrame, projects: DataFrame | None = None, builds: DataFrame | None = None, rules: DataFrame | None = None, version: str = "v2") -> DataFrame:
    """(project, fingerprint): sha1 over all that a project's results hang on.

    files: (project, dir, path, mtime, size) of class files; projects: (project, commit); builds: (project, path, hash) of
    build files; rules: the rules in force, (project, layer, id, …). Parts that are not there are '-'. Class files
    are hashed by directory first, so that a project of many files gathers a hash for each directory only.
    """
    one = F.concat_ws(":", "path", F.col("mtime").cast("string"), F.col("size").cast("string"))
    dirs = files.groupBy("project", "dir").agg(F.sha1(F.array_join(F.array_sort(F.collect_list(one)), ",")).alias("h"))
    listed = lambda item, sep: F.array_join(F.array_sort(F.collect_list(item)), sep)
    parts = {"classes": dirs.groupBy("project").agg(listed(F.concat_ws("=", "dir", "h"), "|").alias("classes"))}
    if projects is not None:
        parts["git"] = projects.select("project", F.col("commit").alias("git"))
    if builds is not None:
        parts["build"] = builds.groupBy("project").agg(listed(F.concat_ws("=", "path", "hash"), ";").alias("build"))
    if rules is not None:
        parts["rules"] = rule_signature(rules).withColumnRenamed("signature", "rules")
    found = None
    for part in parts.values():
        found = part if found is None else found.join(part, "project", "full_outer")
    text = [F.concat(F.lit(f"{name}="), F.coalesce(F.col(name), F.lit("-")) if name in parts else F.lit("-")) for name in ("git", "build", "classes", "rules")]
    return found.select("project", F.sha1(F.concat_ws("|", F.lit(version), *text)).alias("fingerprint"))


RULE_BODY = ("layer", "id", "method_pattern", "class_pattern", "source", "param_count", "enabled")


def rule_signature(rules: DataFrame) -> DataFrame:
    """(project, signature): a hash of each project's rules in force, so that a changed rule makes results stale."""
    body = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in RULE_BODY]), {"ignoreNullFields": "false"})
    return rules.groupBy("project").agg(F.sha1(F.array_join(F.array_sort(F.collect_list(body)), ",")).alias("signature"))


def analysis_fingerprint(entries: DataFrame, projects: DataFrame, max_depth: int, max_nodes: int, source_filter: str = "") -> DataFrame:
    """(project, key, fingerprint) of entries (project, key): the project's fingerprint, the entry and the parameters."""
    rows = entries.join(projects.select("project", F.col("fingerprint").alias("_own")), "project", "left")
    parts = F.concat_ws("|", F.coalesce("_own", F.lit("")), F.col("key"), F.lit(str(max_depth)), F.lit(str(max_nodes)), F.lit(source_filter))
    return rows.select("project", "key", F.sha1(parts).alias("fingerprint"))


def project_times(files: DataFrame) -> DataFrame:
    """(project, class_time, source_time, analysed): the newest class and source file of each project, and whether it has a result.

    files: (project, kind, mtime), kind class, source or result.
    """
    newest = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("mtime")))
    return files.groupBy("project").agg(newest("class").alias("class_time"), newest("source").alias("source_time"), F.max(F.when(F.col("kind") == "result", 1).otherwise(0)).alias("analysed"))


def project_status(projects: DataFrame, tolerance: str = "5 minutes") -> DataFrame:
    """(project, state) from missing, and class_time, source_time, analysed of project_times(); without files these are null."""
    newer = F.col("source_time") > F.col("class_time") + F.expr(f"INTERVAL {tolerance}")
    state = F.when(F.col("missing") == 1, "MISSING").when(F.col("class_time").isNull() | F.coalesce(newer, F.lit(False)), "NEEDS_COMPILE").when(F.coalesce("analysed", F.lit(0)) == 0, "NEEDS_ANALYZE").otherwise("UP_TO_DATE")
    return projects.select("project", state.alias("state"))


def latest_by(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_r = 1").drop("_r")


def upsert_projects(stored: DataFrame, incoming: DataFrame, columns: list[str]) -> DataFrame:
    """Projects by id, the incoming row in place of the stored one."""
    both = stored.select(*columns, F.lit(0).alias("_v")).unionByName(incoming.select(*columns, F.lit(1).alias("_v")))
    return latest_by(both, "id", F.desc("_v"), F.desc("last_opened_at")).drop("_v")


def tail_log(rows: DataFrame, most: int = 60) -> DataFrame:
    """The last `most` lines of each job that are not blank, trimmed."""
    lines = rows.withColumn("line", F.trim("line")).filter(F.col("line") != "")
    rank = F.row_number().over(Window.partitionBy("job").orderBy(F.desc("ts"), F.desc("event_id")))
    return lines.withColumn("_r", rank).filter(F.col("_r") <= most).drop("_r")


def unique_labels(rows: DataFrame, most: int = 31, first: int | None = None) -> DataFrame:
    """(…, label): the base cut to `most` characters; later rows of a base get (2), (3) and so on, cut to fit.

    rows: (…, base, ord), ord distinct. Labels that meet a label of another row, as a suffixed one may meet another base,
    are made again with the next numbers until all differ. With `first`, only so many rows, by ord, get a label,
    as a workbook holds only so many sheets.
    """
    if first is not None:
        rows = rows.orderBy("ord").limit(first)

    def label(k: Column) -> Column:
        suffix = F.concat(F.lit("("), k.cast("string"), F.lit(")"))
        return F.when(k == 1, F.col("_base")).otherwise(F.concat(F.substring(F.col("_base"), F.lit(1), F.least(F.length("_base"), most - F.length(suffix))), suffix))

    base = F.substring("base", 1, most)
    rows = rows.withColumn("_base", base).withColumn("_k", F.row_number().over(Window.partitionBy(base).orderBy("ord")))
    rows = cut(rows.withColumn("label", label(F.col("_k"))))
    while True:
        # Of the rows of one label the one that has it as its base stays, else the first.
        nth = F.row_number().over(Window.partitionBy("label").orderBy(F.col("_k") > 1, "ord"))
        marked = cut(rows.withColumn("_moves", nth > 1))
        if marked.filter("_moves").isEmpty():
            return marked.drop("_base", "_k", "_moves")
        top = marked.groupBy("_base").agg(F.max("_k").alias("_top"))
        order = Window.partitionBy("_base").orderBy("ord")
        moved = marked.filter("_moves").join(top, "_base").withColumn("_k", F.col("_top") + F.row_number().over(order)).drop("_top")
        rows = marked.filter("NOT _moves").unionByName(moved.withColumn("label", label(F.col("_k")))).drop("_moves")
