"""Line dedup: lines that many documents share stay in one document only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.common import SPACES, cut, packed, quoted, unpacked

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line):
    """The line without white space at its ends and with A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the shared lines taken out of `text_col`, plus n_lines and n_dropped (long).

    A line's key is line_key(line). Keys of at least `min_chars` code points that stand in at
    least `min_docs` distinct ids lose all their lines, except in the largest of these ids.
    The other lines keep their order. Keys are compared by two 64-bit hashes.

    Null text: one empty line, and the text becomes ''. A null id counts as one document and is
    smaller than every other. Rows of one id are one document; repeated rows stay repeated. An
    empty table gives an empty result. All other columns pass through; docs' own columns named
    n_lines or n_dropped are replaced.
    """
    keep = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    rows = docs.select(packed(docs).alias("_row"), F.col(quoted(id_col)).alias("_id"), F.xxhash64(text).alias("_text"))
    lines = docs.select(F.col(quoted(id_col)).alias("id"), F.xxhash64(text).alias("text"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    lines = lines.select("id", "text", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
    lines = cut(lines.select("id", "text", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2")))
    # Two steps: the pairs (line, document) are dealt evenly, then counted before they meet by line.
    shared = lines.groupBy("h1", "h2", "id").agg(F.count(F.lit(1)).alias("_")).groupBy("h1", "h2")
    shared = shared.agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last")).filter(F.col("n") >= min_docs).select("h1", "h2", "last")
    shared = cut(shared)  # so that a line of many documents can be split in the join
    gone = lines.join(shared, ["h1", "h2"]).filter(~F.col("id").eqNullSafe(F.col("last")))
    gone = gone.groupBy("id", "text").agg(F.collect_set("pos").alias("_gone"))
    rows = rows.join(gone, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_text") == F.col("text")), "left")
    # The text is split again here, so that it meets the join once.
    rows = rows.withColumn("_lines", F.split(F.coalesce(F.col(f"_row.{quoted(text_col)}"), F.lit("")), "\n", -1))
    n = F.size("_lines")
    stay = F.transform(F.array_except(F.sequence(F.lit(0), n - 1), F.col("_gone")), lambda p: F.element_at(F.col("_lines"), p + 1))
    rows = rows.withColumn("_kept", F.array_join(F.when(F.col("_gone").isNull(), F.col("_lines")).otherwise(stay), "\n"))
    dropped = F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone"))
    changed = {text_col: F.col("_kept"), "n_lines": n.cast("long"), "n_dropped": dropped.cast("long")}
    return unpacked(rows, [*keep, "n_lines", "n_dropped"], changed=changed)


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos, unnest(string_split(coalesce(text, ''), chr(10))) AS line
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
shared AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id <> s.last AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count_if(gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
