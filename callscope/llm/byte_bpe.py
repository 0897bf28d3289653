"""Byte-level BPE in two tiers: whole pre-tokens by a minimal perfect hash, the others by merges from a heap."""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.common import quoted
from callscope.llm.spans import PerfectHash, windows

#: White space after another character: no pre-token goes across it.
GAP = regex.compile(r"(?<=\S)\s")
#: The part of a heap's number that is a place.
PLACE = (1 << 40) - 1
FOLLOWING, BEFORE = list(range(1, 257)), list(range(-1, 255))


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks, from a file with a token in base 64 and its rank on each line."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


class Encoder:
    """Encodes texts. Pre-tokens of the vocabulary are found by hash, all of a slice of texts at once.

    What the others' merges give is remembered for at most twice `most_pieces` pieces of `short` bytes.
    """

    def __init__(self, ranks: dict[bytes, int], tokens: PerfectHash, pattern: str, most_pieces: int = 250_000, short: int = 64, slice_chars: int = 1 << 20):
        self.ranks = {token: rank + 1 for token, rank in ranks.items()}  # so that 0 is none
        self.tokens, self.pattern = tokens, regex.compile(pattern)
        self.most_pieces, self.short, self.slice_chars = most_pieces, short, slice_chars
        self.pairs = {(a, b): self.ranks.get(bytes([a, b]), 0) for a in range(256) for b in range(256)}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merges(self, piece: bytes) -> bytes:
        """Ids of a piece: the pair of neighbours with the lowest rank is merged first, the leftmost of equal ones.

        Neighbours are linked by their places; a heap holds the ranks of the pairs. Pairs that
        a merge has changed stay in the heap and are passed over. Memory is some numbers for each byte.
        """
        get, n = self.ranks.get, len(piece)
        if n <= len(BEFORE):
            following, before = FOLLOWING[:n], BEFORE[:n]
        else:
            following, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        # The rank of the pair that begins at a place: one more than its rank in the file, 0 for none.
        pairs = self.pairs
        pair = [pairs[a, b] for a, b in zip(piece, piece[1:])]
        pair.append(0)
        heap = [rank << 40 | i for i, rank in enumerate(pair) if rank]
        heapify(heap)
        while heap:
            top = heappop(heap)
            i = top & PLACE
            if pair[i] != top >> 40:
                continue
            j = following[i]
            end = following[i] = following[j]
            pair[j] = 0
            if end < n:
                before[end] = i
                pair[i] = rank = get(piece[i : following[end]], 0)
                if rank:
                    heappush(heap, rank << 40 | i)
            else:
                pair[i] = 0
            if i:
                j = before[i]
                pair[j] = rank = get(piece[j:end], 0)
                if rank:
                    heappush(heap, rank << 40 | j)
        out, ranks, i = array("i"), self.ranks, 0
        while i < n:
            out.append(ranks[piece[i : following[i]]] - 1)
            i = following[i]
        return out.tobytes()

    def missed(self, piece: str) -> bytes:
        """Ids of a pre-token that is not in the vocabulary; those not met again since the last exchange of the halves go."""
        found = self.older.get(piece)
        if found is None:
            found = self.merges(piece.encode())
        if len(piece) <= self.short:
            if len(self.known) >= self.most_pieces:
                self.older, self.known = self.known, {}
            self.known[piece] = found
        return found

    def slices(self, text: str) -> Iterator[str]:
        """The text in slices that end where a pre-token does."""
        at = 0
        while len(text) - at > self.slice_chars:
            gap = GAP.search(text, at + self.slice_chars)
            if not gap:
                break
            yield text[at : gap.start()]
            at = gap.start()
        yield text[at:] if at else text

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        pieces: list[str] = []
        counts = []
        for text in texts:
            found = self.pattern.findall(text)
            pieces += found
            counts.append(len(found))
        data = "".join(texts).encode()
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        end = np.cumsum(length)
        if len(data) != (end[-1] if len(end) else 0):  # places of characters become places of bytes
            first = np.flatnonzero(np.frombuffer(data, np.uint8) & 0xC0 != 0x80)
            end = np.append(first, len(data))[end]
            length = np.diff(end, prepend=0)
        ids = self.tokens.find(windows(data), end - length, length)
        miss = np.flatnonzero(ids < 0)
        known, missed = self.known.get, self.missed
        merged = [known(p) or missed(p) for p in map(pieces.__getitem__, miss.tolist())]
        sizes = np.ones(len(pieces), np.int64)
        sizes[miss] = np.fromiter(map(len, merged), np.int64, len(merged)) // 4
        out = np.repeat(ids, sizes).astype(np.int32)
        out[out < 0] = np.frombuffer(b"".join(merged), np.int32)
        before = np.append(0, np.cumsum(sizes))
        ends = np.cumsum(counts)
        return out, before[ends] - before[ends - counts]


def encode_batches(batches: Iterator[pa.RecordBatch], encoder: Encoder, table: pa.Array, slice_bytes: int) -> Iterator[pa.RecordBatch]:
    """(id, ids, decoded) of batches of (id, text), in slices of about `slice_bytes` of text."""
    for batch in batches:
        texts, at, held, size = batch.column(1), 0, [], 0
        for k in range(batch.num_rows):
            held.append(texts[k].as_py())
            size += len(held[-1])
            if size < slice_bytes and k + 1 < batch.num_rows:
                continue
            if len(held) == 1:  # one text, which may be long
                parts = [encoder.encode([part]) for part in encoder.slices(held[0])]
                ids, counts = np.concatenate([p[0] for p in parts]), np.array([sum(len(p[0]) for p in parts)])
            else:
                ids, counts = encoder.encode(held)
            offsets = pa.array(np.append(0, np.cumsum(counts)), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(held)), lists, decoded(lists, table)], ["id", "ids", "decoded"])
            at, held, size = k + 1, [], 0


def token_table(ranks: dict[bytes, int]) -> pa.Array:
    """The bytes of each id; ids that are no token have none."""
    table: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return pa.array(table, pa.binary())


def decoded(lists: pa.ListArray, table: pa.Array) -> pa.Array:
    """The bytes of each list of ids: the tokens' bytes stand one after the other, so only their bounds are looked up.

    A list that holds an id which is no token, or null, and a null list, become null.
    """
    ids = lists.flatten()
    known = np.asarray(ids.fill_null(-1)).astype(np.int64)
    bad = (known < 0) | (known >= len(table))
    taken = table.take(pa.array(np.where(bad, 0, known))) if len(table) else pa.array([b""] * len(known), pa.binary())
    bad |= np.asarray(taken.is_null())
    bounds = np.frombuffer(taken.buffers()[1], np.int32)[taken.offset : taken.offset + len(taken) + 1] if len(taken) else np.zeros(1, np.int32)
    null = np.asarray(lists.is_null())
    sizes = np.asarray(lists.value_lengths().fill_null(0))
    ends = np.append(0, np.cumsum(sizes))
    wrong = np.append(0, np.cumsum(bad))
    null = null | (wrong[ends[1:]] > wrong[ends[:-1]])
    data = taken.buffers()[2] if len(taken) and taken.buffers()[2] is not None else pa.py_buffer(b"")
    valid = pa.array(~null).buffers()[1]
    return pa.Array.from_buffers(pa.binary(), len(lists), [valid, pa.py_buffer(bounds[ends].astype(np.int32)), data])


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = 1 << 21) -> DataFrame:
    """(id, ids, decoded) of every row: the token ids of its whole text, and the bytes that they decode to.

    path: a file of tokens and ranks (read_ranks); pattern: what splits a text into pre-tokens, each
    encoded on its own, where no pre-token goes across white space that follows another character. The ranks
    and their perfect hash are broadcast; the file bounds their size. Every single byte must be a token.

    Null and empty texts have no ids and decode to nothing. Rows are encoded one by one, so repeated rows
    repeat their result, and an empty table gives an empty result. Special tokens are ordinary text. Only
    the id and text columns are read, so other names cannot clash. Long texts are encoded in slices that end at white
    space; a pre-token is held whole.
    """
    ranks = read_ranks(path)
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("every single byte must be a token")
    shared = docs.sparkSession.sparkContext.broadcast((ranks, PerfectHash(list(ranks), list(ranks.values()))))
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tokens = shared.value
        yield from encode_batches(batches, Encoder(own, tokens, pattern), token_table(own), slice_bytes)

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, decoded binary")


def decode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded) of every row: the bytes of its ids. Null ids, and lists with an id that is no token, give null."""
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(path))
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(ids_col)).cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_table(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), decoded(batch.column(1), table)], ["id", "decoded"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, decoded binary")


def op11_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return found.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
