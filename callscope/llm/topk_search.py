"""Exact top-k search by inner product: MaxScore over shards of postings."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callscope.llm.common import delete_at_end, folder_files, quoted, shared_folder

#: side and wide order scores beyond 64 bits: side is their sign, else 0; wide is the score, moved to be positive, in hexadecimal digits of one length.
FIELDS = pa.schema([("query_id", pa.int64()), ("query_hash", pa.int64()), ("id", pa.int64()), ("score", pa.int64()), ("side", pa.int32()), ("wide", pa.string())])
#: Products are summed in 64 bits where no sum of their sizes reaches this.
SAFE = 2.0**62


class Shard:
    """Postings of some vectors: for each term (component) the rows where it is not 0, and its values."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.columns = ids[order], np.ascontiguousarray(vectors[order].T)
        self.rows = [np.flatnonzero(c) for c in self.columns]
        self.values = [c[r] for c, r in zip(self.columns, self.rows, strict=True)]
        self.most = np.array([v.max(initial=0) for v in self.values], np.int64)
        self.least = np.array([v.min(initial=0) for v in self.values], np.int64)

    def top(self, own: int, query: np.ndarray, k: int, bar: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows whose id is not `own`, ties to smaller ids.

        bar: a score that k rows of other shards reach; rows below it may be left out.
        """
        ahead = np.maximum(query * self.most, query * self.least)  # what a term can add; absent terms add 0
        behind = np.minimum(query * self.most, query * self.least)
        order = np.argsort(-ahead, kind="stable")
        rest = np.append(np.cumsum(ahead[order][::-1])[::-1], 0)  # bound of the terms from the i-th on
        rest_behind = np.append(np.cumsum(behind[order][::-1])[::-1], 0)
        score = np.zeros(len(self.ids), np.int64)
        free = self.ids != own
        at, seen = 0, np.zeros(len(self.ids), bool)
        # Essential terms: their postings are traversed until what is left cannot reach the bar alone.
        while at < len(order) and (bar is None or rest[at] >= bar):
            t = order[at]
            score[self.rows[t]] += query[t] * self.values[t]
            seen[self.rows[t]] = True
            at += 1
            if at % 4 == 0 and free.sum() > k:
                known = score[free] + rest_behind[at]
                best = int(np.partition(known, len(known) - k)[len(known) - k])
                bar = best if bar is None else max(bar, best)
        # A row without an essential term has at most the bound of the others, which is below the bar.
        alive = np.flatnonzero(free & seen) if at < len(order) else np.flatnonzero(free)
        score = score[alive]
        for i in range(at, len(order)):  # probe the other terms while a row is competitive
            enough = score + rest[i] >= bar
            alive, score = alive[enough], score[enough]
            score = score + query[order[i]] * self.columns[order[i]][alive]
        best = np.lexsort((self.ids[alive], -score))[:k]
        return self.ids[alive][best], score[best]


def merged(known: list[tuple[int, int]], more: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
    """The k best of both, each (score, id) in Python's whole numbers."""
    return sorted([*known, *more], key=lambda x: (-x[0], x[1]))[:k]


class Best:
    """The k best rows so far of each query of a block, over the shards of a task."""

    def __init__(self, ids: np.ndarray, hashes: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.hashes, self.vectors, self.k = ids, hashes, vectors, k
        self.sizes = np.abs(vectors.astype(np.float64))
        self.found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)
        self.far: dict[int, list[tuple[int, int]]] = {}  # by query: the best of the rows whose sums may pass 64 bits

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        sizes = np.abs(vectors.astype(np.float64))
        shard, largest = Shard(ids, vectors), sizes.max(axis=0, initial=0)
        risky = self.sizes @ largest >= SAFE  # of each query with the largest that a shard has of each term
        for q, (known, scores) in enumerate(self.found):
            bar = int(scores[-1]) if len(scores) == self.k else None
            near = shard
            if risky[q]:
                wide = sizes @ self.sizes[q] >= SAFE  # of each row
                near = Shard(ids[~wide], vectors[~wide])
                self._exact(q, ids[wide], vectors[wide])
            new, new_scores = near.top(int(self.ids[q]), self.vectors[q], self.k, bar)
            if len(new):
                known, scores = np.append(known, new), np.append(scores, new_scores)
                best = np.lexsort((known, -scores))[: self.k]
                self.found[q] = known[best], scores[best]

    def _exact(self, q: int, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Scores of rows whose sums may pass 64 bits, in whole numbers of any size."""
        query = [int(x) for x in self.vectors[q]]
        rows = [(sum(a * int(b) for a, b in zip(query, v, strict=True)), int(i)) for i, v in zip(ids, vectors, strict=True) if i != self.ids[q]]
        self.far[q] = merged(self.far.get(q, []), rows, self.k)

    def rows(self, step: int = 4096) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.found), step):
            part = self.found[at : at + step]
            sizes = [len(x[0]) for x in part]
            columns = [np.repeat(self.ids[at : at + step], sizes), np.repeat(self.hashes[at : at + step], sizes), np.concatenate([x[0] for x in part]), np.concatenate([x[1] for x in part])]
            n = len(columns[0])
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(np.zeros(n, np.int32)), pa.array([""] * n, pa.string())], schema=FIELDS)
        rows = []
        for q, best in self.far.items():
            for score, i in best:
                side = 0 if -(1 << 63) <= score < 1 << 63 else 1 if score > 0 else -1
                rows.append((int(self.ids[q]), int(self.hashes[q]), i, 0 if side else score, side, f"{score + (1 << 200):064x}" if side else ""))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), FIELDS, strict=True)], schema=FIELDS)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of whole numbers as rows of one width; missing components are 0."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    found = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    found[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return found


def stored_blocks(queries: DataFrame, blocks: int) -> list[str]:
    """Writes queries in files, one or more for each block, to the folder that executors share, and gives the files of all blocks."""
    spark = queries.sparkSession
    folder = f"{shared_folder(spark)}/queries-{uuid.uuid4().hex}"
    queries.withColumn("block", F.pmod(F.xxhash64("id", "hash"), F.lit(blocks))).repartition(blocks, "block").write.parquet(folder)
    delete_at_end(spark, folder)
    return [f for f in folder_files(spark, folder) if f.rpartition("/")[2].startswith("part-")]


def read_block(path: str) -> pa.Table:
    system, where = pa.fs.FileSystem.from_uri(path if "://" in path else path.replace("file:/", "file:///", 1))
    return pq.read_table(where, filesystem=system, columns=["id", "hash", "vector"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int = 4096, block_bytes: int = 1 << 26) -> DataFrame:
    """query_id, rank, id and score of the k best vectors for each query, the query's own id left out.

    Both frames: (id bigint, vector array<bigint>). The score is the inner product; missing components
    of a shorter vector are 0. Ties go to smaller ids. Sums that may pass 64 bits are found exactly, row by row; only if one of the k
    best scores itself does not fit 64 bits is there an error.

    Queries are written in blocks of at most `block_bytes`, which their count and width give, to the folder that executors share.
    The vectors are read once, where they lie, and are not shuffled: a task holds its own in shards of `shard_rows`, takes one block
    after the other past them, and keeps the k best of each query of the block, and the bar that they set. The tasks'
    results are merged. No query and no vector goes through the driver. A task holds one block and, where there are several, its part of
    the table. The shared folder must be one that Arrow reads too.

    Rows with a null id or vector take no part. Equal vectors tie. Repeated rows are candidates each. Equal
    queries are one query; queries of one id with different vectors are ranked each on its own. Other columns are
    not read. Empty frames give an empty result.
    """
    vectors, queries = (x.select("id", "vector").filter("id IS NOT NULL AND vector IS NOT NULL") for x in (vectors, queries))
    queries = queries.distinct().withColumn("hash", F.xxhash64("vector"))
    count, query_width = queries.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    width = max(vectors.agg(F.max(F.size("vector"))).first()[0] or 0, query_width or 0)
    # Hashing fills blocks evenly; what is above the mean by chance fits in the rest of the bound.
    blocks = max(1, -(-2 * count * 8 * (width + 2) // block_bytes))
    files = stored_blocks(queries, blocks) if count else []

    def together(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([b.column(0).to_numpy() for b in held]), np.concatenate([matrix(b.column(1), width) for b in held])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, shard_rows):
                held.append(batch.slice(at, min(shard_rows, batch.num_rows - at)))
                size += held[-1].num_rows
                if size >= shard_rows:
                    yield together(held)
                    held, size = [], 0
        if held:
            yield together(held)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One block meets the shards as they come; for several the task keeps its shards.
        own = shards(batches) if len(files) == 1 else list(shards(batches))
        for path in files if own else ():
            rows = read_block(path).combine_chunks()
            if rows.num_rows:
                best = Best(*(rows.column(c).combine_chunks().to_numpy() for c in ("id", "hash")), matrix(rows.column("vector").combine_chunks(), width), k)
                for shard in own:
                    best.add(*shard)
                yield from best.rows()

    found = vectors.mapInArrow(search, "query_id bigint, query_hash bigint, id bigint, score bigint, side int, wide string")
    rank = F.row_number().over(Window.partitionBy("query_id", "query_hash").orderBy(F.desc("side"), F.desc("wide"), F.desc("score"), "id"))
    best = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    score = F.when(F.col("side") == 0, F.col("score")).otherwise(F.raise_error(F.lit("OverflowError: one of the best scores does not fit 64 bits")).cast("bigint"))
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "id", score.alias("score"))


def whole_numbers(rows: DataFrame, id_col: str, vector_col: str, scale: int = 1024) -> DataFrame:
    """(id, vector): each component x as floor(scale * x); vectors with a null or non-finite component are dropped."""
    v = F.col(quoted(vector_col)).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(v.isNotNull() & ~bad)
    return rows.select(F.col(quoted(id_col)).cast("bigint").alias("id"), F.transform(v, lambda x: F.floor(scale * x)).cast("array<bigint>").alias("vector"))


def op2_topk_search(spark, sf_dir: str) -> DataFrame:
    rows = whole_numbers(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), "vec_id", "embedding")
    return top_k(rows, rows.filter(F.col("id") % 100 == 0)).withColumnRenamed("id", "vec_id")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 10
"""
