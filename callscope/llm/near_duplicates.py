"""N-gram Jaccard join: MinHash banding finds candidates, full shingle sets decide.

Rows of equal shingle sets are one node, which knows its number of rows. Nodes that share a band bucket
are candidates; they are laid out in blocks of bounded size, so that a group of any size becomes many pairs
of blocks, each verified on its own. A pair of blocks gives each node's number of linked rows and a forest of
the links, never the pairs.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callscope.llm.common import cut, packed, quoted, unpacked

P = 0x9E3779B97F4A7C15  # odd; powers of it weigh bytes and words
MASK = (1 << 64) - 1
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def banding(threshold: float = 0.8, recall: float = 0.9999, rows: int = 4) -> tuple[int, int]:
    """Bands and rows such that a pair at the threshold shares a band with at least that probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)), rows


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Hashes of the shingles of texts: windows of `size` words `[^\\x20\\x09-\\x0D]+`.

    A text of fewer words, but at least one, is one shingle. Texts are hashed a slice at a time.
    """

    def __init__(self, size: int = 5):
        self.size, self.power = size, np.ones(1, np.uint64)

    def powers(self, n: int) -> np.ndarray:
        if len(self.power) < n:
            self.power = np.cumprod(np.concatenate([[1], np.full(max(n, 1 << 16), P, np.uint64)]).astype(np.uint64))
        return self.power[:n]

    def words(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the words of a text."""
        raw = np.frombuffer(b"\n" + text + b"\n", np.uint8)
        edge = np.flatnonzero(np.diff(IS_SPACE[raw].view(np.int8)))
        starts, ends = edge[::2] + 1, edge[1::2] + 1
        if not len(starts):
            return starts, np.zeros(0, np.uint64)
        # Each byte is weighed by its distance from the word's start, so equal words have equal sums.
        lengths = ends - starts
        body = ~IS_SPACE[raw]
        offset = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        weighed = (raw[body].astype(np.uint64) + np.uint64(1)) * self.powers(int(lengths.max()))[offset]
        sums = np.add.reduceat(weighed, np.cumsum(lengths) - lengths)
        return starts, mix(sums + lengths.astype(np.uint64))

    def shingles(self, texts: list[bytes]) -> list[np.ndarray]:
        """The shingle hashes of each text, in order and with repeats."""
        starts, words = self.words(b"\n".join(texts))
        ends = np.cumsum([len(t) + 1 for t in texts])
        upto = np.searchsorted(starts - 1, ends)
        n = len(words) - self.size + 1
        windows = np.zeros(max(n, 0), np.uint64)
        for j in range(self.size if n > 0 else 0):
            windows = windows * np.uint64(P) + words[j : j + n]
        windows = mix(windows)
        out, at = [], 0
        for end in upto.tolist():
            if end - at >= self.size:
                out.append(windows[at : end - self.size + 1])
            elif end > at:
                out.append(mix(np.array([sum(int(w) * pow(P, k + 7, 1 << 64) for k, w in enumerate(words[at:end])) & MASK], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
            at = end
        return out


def slices(batch: pa.RecordBatch, column: int, size: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """The texts of a batch in slices of about `size` bytes, each with its first row."""
    texts, held, first, total = batch.column(column), [], 0, 0
    for k in range(batch.num_rows):
        held.append(texts[k].as_py())
        total += len(held[-1])
        if total >= size or k + 1 == batch.num_rows:
            yield first, held
            held, first, total = [], k + 1, 0


def signatures(rows: DataFrame, size: int, bands: int, band_rows: int, seed: int = 11) -> DataFrame:
    """(id, th, node, n, bands): a 128-bit name of the row's shingle set, its size and its band hashes.

    rows: (id, th, text as binary). Rows without a word have the empty set and no bands.
    """
    factors = np.random.default_rng(seed).integers(0, 1 << 63, bands * band_rows, np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for batch in batches:
            for first, texts in slices(batch, 2):
                found = shingler.shingles(texts)
                counts = np.array([len(x) for x in found])
                full = np.flatnonzero(counts)
                hashes = np.full((len(texts), bands), 0, np.int64)
                if len(full):
                    flat = np.concatenate([found[k] for k in full])
                    starts = np.cumsum(counts[full]) - counts[full]
                    buffer = np.empty_like(flat)
                    for band in range(bands):
                        bucket = np.full(len(full), band + 1, np.uint64)
                        for factor in factors[band * band_rows : (band + 1) * band_rows]:
                            np.multiply(flat, factor, out=buffer)
                            bucket = mix(bucket * np.uint64(P) + np.minimum.reduceat(buffer, starts))
                        hashes[full, band] = bucket.view(np.int64)
                sets = [np.unique(x) for x in found]
                nodes = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
                columns = [pa.array(nodes, pa.binary()), pa.array([len(x) for x in sets], pa.int64()), pa.array([h.tolist() if len(x) else [] for h, x in zip(hashes, sets, strict=True)], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(first, len(texts)) for c in (0, 1)] + columns, ["id", "th", "node", "n", "bands"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, th bigint, node binary, n bigint, bands array<bigint>")


def linked(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: tuple[int, int], slab: int = 4096) -> np.ndarray:
    """Which of the sets are similar: a matrix, left by right (by left, without the diagonal, if None).

    Only elements of two sets or more count for intersections; sets are rows of 0 and 1 over slabs
    of these elements, and products of the slabs give the intersections.
    """
    sets = left if right is None else [*left, *right]
    sizes = np.array([len(s) for s in sets])
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(place, minlength=len(values)) > 1
    column = np.cumsum(often) - 1
    owner = np.repeat(np.arange(len(sets)), sizes)[often[place]]
    column = column[place[often[place]]]
    m, k = len(left), len(sets)
    common = np.zeros((m, k if right is None else k - m), np.float32)
    for at in range(0, int(often.sum()), slab):
        here = (column >= at) & (column < at + slab)
        x = np.zeros((k, min(slab, int(often.sum()) - at)), np.float32)
        x[owner[here], column[here] - at] = 1
        common += x[:m] @ (x if right is None else x[m:]).T
    other = sizes if right is None else sizes[m:]
    up, down = threshold  # I / (A + B - I) >= up / down, in whole numbers
    similar = (up + down) * common.astype(np.int64) >= up * (sizes[:m, None] + other[None, :])
    if right is None:
        np.fill_diagonal(similar, False)
    return similar


def forest(keys: list, rows: np.ndarray, similar: np.ndarray, offset: int | None) -> list[tuple]:
    """(key, linked rows, smallest key of its group) of all members with a link; keys are not null; offset: first right member.

    rows: how many rows each member stands for.
    """
    root = list(range(len(keys)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, row in enumerate(similar):
        for j in np.flatnonzero(row).tolist():
            a, b = find(i), find(j + (offset or 0))
            if a != b:
                low, high = (a, b) if keys[a] <= keys[b] else (b, a)
                root[high] = low
    links = similar @ rows if offset is None else np.concatenate([similar @ rows[offset:], rows[:offset] @ similar])
    return [(keys[x], n, keys[find(x)]) for x, n in enumerate(links.tolist()) if n]


def verify(blocks: DataFrame, sides: list[str], threshold: tuple[int, int]) -> DataFrame:
    """(node, links, to_node): the rows linked to a node within a block, or between the two of a row, and a node of its group."""
    fields = pa.schema([("node", pa.binary()), ("links", pa.int64()), ("to_node", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                held = []
                for side in sides:
                    members = {x["node"]: (x["shingles"], x["rows"]) for x in batch.column(side)[k].as_py()}
                    held.append((list(members), [np.frombuffer(s, np.uint64) for s, _ in members.values()], [n for _, n in members.values()]))
                keys = [key for part in held for key in part[0]]
                if len(keys) < 2:
                    continue
                similar = linked(held[0][1], held[1][1] if len(held) > 1 else None, threshold)
                rows = np.array([n for part in held for n in part[2]], np.int64)
                found = forest(keys, rows, similar, len(held[0][0]) if len(held) > 1 else None)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found, strict=True), fields, strict=True)], schema=fields)

    return blocks.select(*sides).mapInArrow(run, "node binary, links bigint, to_node binary")


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, to_node): the smallest node that each end of an edge is connected to.

    Each round takes the smallest label among the neighbours and then the label of that label, so
    that paths shorten by half; it ends when nothing changes.
    """
    both = edges.select(F.col("node").alias("a"), F.col("to_node").alias("b"))
    both = cut(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")))
    for _ in range(most_rounds):
        near = both.join(labels.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        new = labels.join(near, "a").select("a", F.least("label", "near").alias("label"))
        above = labels.select(F.col("a").alias("label"), F.col("label").alias("above"))
        new = cut(new.join(above, "label").select("a", F.least("label", "above").alias("label")))
        changed = new.join(labels.withColumnRenamed("label", "old"), "a").filter("label <> old").limit(1).count()
        labels = new
        if not changed:
            break
    else:
        raise RuntimeError("the components did not settle")
    return labels.select(F.col("a").alias("node"), F.col("label").alias("to_node"))


def jaccard_join(docs: DataFrame, size: int = 5, threshold: tuple[int, int] = (4, 5), recall: float = 0.9999, block_nodes: int = 64, block_shingles: int = 400_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, class_id, class_th, n_links) of every row of docs.

    Documents whose sets of `size`-word shingles have a Jaccard similarity of threshold (up, down) or
    more are linked. Candidates share a band of MinHash values, with bands and rows from banding(): a pair at the
    threshold is found with probability `recall` at least; every candidate pair is decided on the full
    sets. class_id is the smallest id connected to the row by links; rows of equal sets are always
    connected. n_links counts the other rows linked to the row, exact copies and repeated rows included.
    th is xxhash64 of the text.

    Null, empty and blank texts have no shingles: they are one class, linked as equal sets are. Texts of fewer
    words than `size` are one shingle. Null ids are smaller than others. Repeated rows and equal texts
    share a class. An empty table gives an empty result. Only the id and text columns are read, so other
    names cannot clash.
    """
    bands, band_rows = banding(threshold[0] / threshold[1], recall)
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.xxhash64(text).alias("th"), text.cast("binary").alias("text"))
    seen = cut(signatures(rows, size, bands, band_rows))
    # A node's name is its key, as ids may be null; its smallest row (id, th), null first, only gives text and class.
    nodes = seen.groupBy("node").agg(F.min(F.struct("id", "th")).alias("rep"), F.count(F.lit(1)).alias("rows"), F.max("n").alias("n"), F.max("bands").alias("bands"))
    nodes = cut(nodes)
    buckets = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = cut(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("label")).filter("c > 1").select("bucket", "label"))
    live = cut(buckets.join(shared, "bucket"))
    # Labels only say which nodes to lay side by side: the smallest node in reach of two steps.
    near = cut(live.groupBy("node").agg(F.min("label").alias("label"), F.max("n").alias("n")))
    wider = live.drop("label", "n").join(near, "node").groupBy("bucket").agg(F.min("label").alias("label"))
    near = live.drop("label").join(cut(wider), "bucket").groupBy("node").agg(F.min("label").alias("label"), F.max("n").alias("n"))
    near = cut(near)
    parts = near.groupBy("label").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block_nodes), F.ceil(F.sum("n") / block_shingles)).alias("parts"))
    placed = near.join(cut(parts), "label")
    placed = cut(placed.select("node", F.xxhash64("label", F.pmod(F.xxhash64("node"), "parts")).alias("block")))
    met = live.select("bucket", "node").join(placed, "node").select("bucket", "block").distinct()
    mixed = met.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("bucket")
    met = cut(met.join(cut(mixed), "bucket"))
    pairs = met.select("bucket", F.col("block").alias("a")).join(met.select("bucket", F.col("block").alias("b")), "bucket")
    pairs = cut(pairs.filter("a < b").select("a", "b").distinct())

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, last = Shingler(size), None
        for batch in batches:
            # Repeated rows mostly follow each other here; the rest of them is taken out below.
            names = [last, *batch.column(0).to_pylist()]
            batch, last = batch.filter(pa.array([x != y for x, y in itertools.pairwise(names)], pa.bool_())), names[-1]
            for first, texts in slices(batch, 3):
                sets = [np.unique(x).tobytes() for x in shingler.shingles(texts)]
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(first, len(texts)) for c in range(3)] + [pa.array(sets, pa.binary())], ["node", "block", "rows", "shingles"])

    owned = placed.join(nodes.select("node", "rows", F.col("rep.id").alias("own"), F.col("rep.th").alias("own_th")), "node")
    wanted = rows.join(cut(owned), F.col("id").eqNullSafe(F.col("own")) & (F.col("th") == F.col("own_th"))).select("node", "block", "rows", "text")
    wanted = wanted.mapInArrow(shingled, "node binary, block bigint, rows bigint, shingles binary")
    wanted = wanted.repartition("block").dropDuplicates(["block", "node"])
    packs = cut(wanted.groupBy("block").agg(F.collect_list(F.struct("node", "rows", "shingles")).alias("members")))
    left, right = packs.select(F.col("block").alias("a"), F.col("members").alias("left")), packs.select(F.col("block").alias("b"), F.col("members").alias("right"))
    found = verify(packs, ["members"], threshold).unionByName(verify(pairs.join(left, "a").join(right, "b"), ["left", "right"], threshold))
    found = cut(found)
    links = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    joined = cut(components(found.select("node", "to_node")).join(nodes.select("node", "rep"), "node"))
    known = links.join(joined.select("node", "to_node"), "node").join(joined.groupBy("to_node").agg(F.min("rep").alias("class")), "to_node")
    own = F.coalesce("n_links", F.lit(0)) + F.col("rows") - 1
    info = nodes.select("node", "rep", "rows").join(known, "node", "left").select("node", F.coalesce("class", "rep").alias("class"), own.cast("bigint").alias("n_links"))
    out = seen.select("id", "th", "node").join(cut(info), "node")
    return out.select("id", "th", F.col("class.id").alias("class_id"), F.col("class.th").alias("class_th"), "n_links")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one document of each class of jaccard_join(): the one with the smallest id.

    So of the documents without words one stays, and of repeated rows one. All columns of docs pass through
    packed in one struct, so that none can clash with a working column.
    """
    found = jaccard_join(docs, id_col=id_col, text_col=text_col, **options)
    stay = found.filter(F.col("id").eqNullSafe(F.col("class_id")) & (F.col("th") == F.col("class_th")))
    stay = stay.select(F.col("id").alias("_own"), F.col("th").alias("_own_th")).distinct()
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    full = docs.select(packed(docs).alias("_row"), F.col(quoted(id_col)).alias("_id"), F.xxhash64(text).alias("_th"))
    full = full.join(stay, F.col("_id").eqNullSafe(F.col("_own")) & (F.col("_th") == F.col("_own_th")))
    first = F.row_number().over(Window.partitionBy("_id", "_th").orderBy(F.xxhash64("_row")))
    return unpacked(full.withColumn("_nth", first).filter("_nth = 1"), docs.columns)


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_join(docs).select(F.col("id").alias("doc_id"), "class_id", "n_links")
