"""Importance resampling towards a target: hashed n-grams, whose CRCs are derived from those of prefixes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.common import cut, quoted, read
from callscope.operators.freq import numbered

#: A-Z in lower case; ASCII other than letters and digits as spaces; every other byte is part of a word.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: The CRC-32 polynomial of zlib, low bit first.
POLYNOMIAL = 0xEDB88320
ONES = np.uint32(0xFFFFFFFF)


def step_table() -> np.ndarray:
    """What the low byte of a CRC register becomes when a zero byte follows."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ (table & np.uint32(1)) * np.uint32(POLYNOMIAL)
    return table


class Shifts:
    """CRCs as polynomials over GF(2), multiplied by the power of x that so many bytes are.

    The CRC of A and B one after the other is that of A, shifted by B's length, plus that of B; so B's is
    found from the two prefixes by adding (which is subtracting) the shifted one.
    """

    def __init__(self):
        self.step = step_table()
        places = np.uint32(8) * np.arange(4, dtype=np.uint32)[:, None]
        first = np.arange(256, dtype=np.uint32)[None, :] << places
        #: For 2^k bytes: what each byte of a register adds to the result.
        self.tables = [self.step[first & np.uint32(255)] ^ (first >> np.uint32(8))]

    def _apply(self, table: np.ndarray, crcs: np.ndarray) -> np.ndarray:
        return table[0][crcs & np.uint32(255)] ^ table[1][crcs >> np.uint32(8) & np.uint32(255)] ^ table[2][crcs >> np.uint32(16) & np.uint32(255)] ^ table[3][crcs >> np.uint32(24)]

    def shifted(self, crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Each CRC moved by its number of bytes."""
        crcs, k, most = crcs.copy(), 0, int(lengths.max(initial=0))
        while most >> k:
            if k == len(self.tables):
                self.tables.append(self._apply(self.tables[-1], self.tables[-1]))
            some = np.flatnonzero(lengths >> k & 1)
            crcs[some] = self._apply(self.tables[k], crcs[some])
            k += 1
        return crcs

    def with_byte(self, crcs: np.ndarray, byte: int) -> np.ndarray:
        """The CRCs after one more byte."""
        register = crcs ^ ONES
        return self.step[(register ^ np.uint32(byte)) & np.uint32(255)] ^ (register >> np.uint32(8)) ^ ONES


class Features:
    """The buckets of the n-grams of some texts, from one scan of their normalised bytes."""

    def __init__(self, lengths: range, buckets: int):
        self.lengths, self.buckets, self.shifts = lengths, np.uint32(buckets), Shifts()

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words of each text, text of each n-gram, bucket of each n-gram).

        The texts' words, each after a space, make one string; a running CRC is kept at the end of each word.
        """
        words: list[bytes] = []
        counts = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            found = text.translate(NORMAL).split()
            counts[k] = len(found)
            words += found
        n = len(words)
        ends = np.fromiter(accumulate(words, lambda crc, word: crc32(word, crc32(b" ", crc)), initial=0), np.uint32, n + 1)
        starts = self.shifts.with_byte(ends[:-1], 32)
        place = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)  # of each word's end
        text_of = np.repeat(np.arange(len(texts)), counts)
        owners, crcs = [], []
        for m in self.lengths:
            if m > n:
                break
            first = np.flatnonzero(text_of[: n - m + 1] == text_of[m - 1 :])
            last = first + m - 1
            size = place[last] - (place[first - 1] * (first > 0)) - 1
            crcs.append(ends[last + 1] ^ self.shifts.shifted(starts[first], size))
            owners.append(text_of[first])
        if not crcs:
            return counts, np.zeros(0, np.int64), np.zeros(0, np.int64)
        return counts, np.concatenate(owners), (np.concatenate(crcs) % self.buckets).astype(np.int64)


def slices(batch: pa.RecordBatch, column: int, slice_bytes: int) -> Iterator[tuple[int, list[bytes]]]:
    """A batch's texts as bytes, about `slice_bytes` at a time, with the place of the first; null texts are empty."""
    texts, at, held, size = batch.column(column), 0, [], 0
    for k in range(batch.num_rows):
        held.append(texts[k].as_py() or b"")
        size += len(held[-1])
        if size >= slice_bytes or k + 1 == batch.num_rows:
            yield at, held
            at, held, size = k + 1, [], 0


def bucket_counts(texts: DataFrame, text_col: str, lengths: range, buckets: int, slice_bytes: int = 1 << 22) -> np.ndarray:
    """How many features of all texts each bucket has. A task sends one row for each bucket at most."""
    rows = texts.select(F.col(quoted(text_col)).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = Features(lengths, buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, held in slices(batch, 0, slice_bytes):
                total += np.bincount(features.of(held)[2], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    found = rows.mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(buckets, np.int64)
    total[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return total


def gains_of(spark, source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain: floor(1000 * ln of how much more often the target has it), in doubles, both counts smoothed by one."""
    buckets = len(source)
    rows = spark.createDataFrame(pa.table({"b": pa.array(range(buckets)), "s": source, "t": target}))
    size = [F.lit(float(int(x.sum()) + buckets)) for x in (source, target)]
    s, t = (F.col(c).cast("double") + 1 for c in "st")
    found = rows.select("b", F.floor(1000 * F.log(t * size[0] / (s * size[1]))).cast("long").alias("g")).toArrow()
    gains = np.zeros(buckets, np.int64)
    gains[found.column("b").to_numpy()] = found.column("g").to_numpy()
    return gains


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, lengths: range = range(1, 2), buckets: int = 10_000, seed: int = 2024,
    id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", slice_bytes: int = 1 << 22,
) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every document; those with a rank are the sample.

    Features are the runs of `lengths` words of a normalised text, joined by one space; a feature's bucket is its CRC-32
    modulo `buckets`. A bucket's gain compares how often target and docs have it; a document's weight is
    the floored mean of its features' gains (0 without features). The score adds Gumbel noise, drawn from the seed and
    id by SHA-256, so that the highest scores are a sample without replacement by weight. Of the documents
    with `least_words` words, `percent` per cent are drawn, rounded down; ranks order them by falling score, then id.

    Both tables are read once to count buckets, docs once more to weigh: only one row for each bucket and task and
    one small row for each document are shuffled, and `buckets` gains are broadcast.

    Null texts have no words; in target too. Null ids draw their noise from an empty id and come first among ties.
    Repeated rows are documents each, and tie; equal rows of a tie are told apart by their features and then by their place
    in the table. An empty table gives an empty result; an empty target counts as seen never. Only the id and text
    columns are read, so other names cannot clash.
    """
    spark = docs.sparkSession
    if percent < 0 or percent > 100 or lengths.start < 1 or lengths.step != 1:
        raise ValueError("percent must be from 0 to 100, and lengths a range from 1 on")
    source, wanted = (bucket_counts(t, c, lengths, buckets, slice_bytes) for t, c in ((docs, text_col), (target, target_col)))
    shared = spark.sparkContext.broadcast(gains_of(spark, source, wanted))
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, gains = Features(lengths, buckets), shared.value
        for batch in batches:
            for at, held in slices(batch, 1, slice_bytes):
                words, owner, bucket = features.of(held)
                n = np.bincount(owner, minlength=len(held))
                total = np.zeros(len(held), np.int64)
                np.add.at(total, owner, gains[bucket])
                columns = [pa.array(x, pa.int64()) for x in (words, n, total // np.maximum(n, 1))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(held)), *columns], ["id", "n_words", "n_features", "weight"])

    kind = rows.schema["id"].dataType.simpleString()
    weighed = rows.mapInArrow(run, f"id {kind}, n_words bigint, n_features bigint, weight bigint")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    weighed = weighed.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(u))).cast("long"))
    weighed = cut(weighed.withColumn("_place", F.monotonically_increasing_id()))
    able = F.col("n_words") >= least_words
    drawn = weighed.filter(able).count() * percent // 100
    none = F.lit(None).cast("bigint")
    ranked = numbered(weighed.filter(able), "rank", F.desc("score"), F.asc_nulls_first("id"), "n_features", "n_words", "_place")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank").cast("bigint")))
    return ranked.unionByName(weighed.filter(~able).withColumn("rank", none)).select("id", "n_words", "n_features", "weight", "score", "rank")


def op12_resampling(spark, sf_dir: str) -> DataFrame:
    found = resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


SQL = r"""
WITH RECURSIVE steps AS (
  SELECT b, b AS c, 0 AS k FROM (SELECT unnest(range(256)) AS b) UNION ALL
  SELECT b, xor(c >> 1, (c & 1) * 3988292384), k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM steps WHERE k = 8),
texts AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 't', item_id, text FROM benchmark),
words AS (
  SELECT kind, id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM texts),
coded AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM words)),
hashed AS (
  SELECT w, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(1, length(h), 2),
      lambda i: (16 * (instr('0123456789ABCDEF', substr(h, i, 1)) - 1) + instr('0123456789ABCDEF', substr(h, i + 1, 1)) - 1)::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM coded, crc),
counts AS (SELECT kind, bucket, count(*) AS n FROM words JOIN hashed USING (w) GROUP BY ALL),
sums AS (SELECT coalesce(sum(n) FILTER (WHERE kind = 'd'), 0)::DOUBLE AS s_all, coalesce(sum(n) FILTER (WHERE kind = 't'), 0)::DOUBLE AS t_all FROM counts),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::BIGINT AS gain
  FROM (SELECT bucket, coalesce(sum(n) FILTER (WHERE kind = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (WHERE kind = 't'), 0)::DOUBLE AS t FROM counts GROUP BY bucket), sums),
weights AS (
  SELECT id, count(*) AS n, sum(gain)::BIGINT AS total FROM words JOIN hashed USING (w) JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY id),
scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0) AS weight,
    floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS noise
  FROM documents LEFT JOIN weights ON id = doc_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + noise DESC, doc_id) AS r, count(*) OVER (PARTITION BY n_features >= 20) AS able FROM scored)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, (weight + noise)::BIGINT AS score,
  CASE WHEN n_features >= 20 AND r <= able * 10 // 100 THEN r END::BIGINT AS rank FROM ranked
"""
