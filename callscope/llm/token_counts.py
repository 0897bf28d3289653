"""Token counts by unigram segmentation, shared over the prefixes of a trie of pre-tokens."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.common import quoted

SPACE_MARK = "▁"


def read_pieces(path: str, scale: int = 1000, shift: int = 10) -> dict[str, int]:
    """Pieces of a sentencepiece file with their costs.

    The file ranks its pieces; by Zipf's law a piece of rank r gets the cost round(scale * ln(r + shift)),
    a negative log-probability up to a constant, in whole numbers so that sums are exact.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return {piece: round(scale * math.log(rank + shift)) for rank, piece in enumerate(plain)}


class Trie:
    """Pre-tokens as paths of characters; each node has the forward score of its prefix.

    The forward score is the least (cost, tokens) of a segmentation of the prefix. A character that is
    no piece can stand as its UTF-8 bytes, one token each, at a cost above any piece's. The trie is
    cleared before a pre-token that would bring it above `most_nodes` nodes, the terminal counts at `most_words` words or
    `most_bytes` bytes of them; memory is bounded by these and the longest pre-token.
    """

    def __init__(self, pieces: dict[str, int], most_nodes: int = 600_000, most_words: int = 600_000, most_bytes: int = 1 << 25):
        self.most_nodes, self.most_words, self.most_bytes = most_nodes, most_words, most_bytes
        # Every suffix of a piece: the piece's cost, or -1 if only longer pieces end so.
        self.suffixes: dict[str, int] = {}
        for piece in pieces:
            for k in range(1, len(piece)):
                self.suffixes.setdefault(piece[k:], -1)
        self.suffixes |= pieces
        self.byte_cost = max(pieces.values(), default=0) + 1
        self.counts: dict[bytes, int] = {}
        self.held = 0
        self.clear()

    def clear(self) -> None:
        self.next: dict[int, int] = {}
        self.score: list[tuple[int, int]] = [(0, 0)]

    def forward(self, text: str, i: int, scores: list[tuple[int, int]]) -> tuple[int, int]:
        """The score of text[:i] from the scores of the prefixes before it."""
        suffixes, ending = self.suffixes, ""
        n = len(text[i - 1].encode("utf-8", "replace"))
        cost, tokens = scores[i - 1]
        best = (cost + n * self.byte_cost, tokens + n)
        for j in range(i - 1, -1, -1):
            ending = text[j] + ending
            own = suffixes.get(ending)
            if own is None:
                break
            if own >= 0:
                cost, tokens = scores[j]
                if (found := (cost + own, tokens + 1)) < best:
                    best = found
        return best

    def insert(self, word: bytes) -> int:
        """The terminal count of a pre-token; only characters after its longest known prefix are scored."""
        text = SPACE_MARK + word.decode()
        if len(self.score) + len(text) > self.most_nodes:
            self.clear()
        nxt, score, node, scores = self.next, self.score, 0, [(0, 0)]
        for i in range(1, len(text) + 1):
            key = node << 21 | ord(text[i - 1])
            node = nxt.get(key)
            if node is None:
                node = nxt[key] = len(score)
                score.append(self.forward(text, i, scores))
            scores.append(score[node])
        if len(self.counts) >= self.most_words or self.held + len(word) > self.most_bytes:
            self.counts.clear()
            self.held = 0
        self.counts[word] = scores[-1][1]
        self.held += len(word)
        return scores[-1][1]

    def count(self, text: bytes) -> tuple[int, int]:
        """Words and tokens of a UTF-8 text."""
        words, known, insert = text.split(), self.counts.get, self.insert
        return len(words), sum([known(w) or insert(w) for w in words])


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_tokens) of every row: the words `[^\\x20\\x09-\\x0D]+` of its whole text, and their tokens.

    A word is segmented on its own, after the mark of a word's start, into the pieces of the file at
    `path` with the least cost (see read_pieces), then the fewest tokens. This is a unigram segmentation
    with the file's vocabulary, not the merges that the file was made for. The pieces, of the
    vocabulary's size, are broadcast. Each task inserts its distinct pre-tokens in a trie of bounded size, so
    that nothing is shuffled: to share one trie of the whole corpus, all words would have to be.

    Null and blank texts have 0 words and tokens. Repeated rows repeat their result; an empty table
    gives an empty result. Only the id and text columns are read, so other names cannot clash.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_pieces(path))
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.coalesce(F.col(quoted(text_col)), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(shared.value)
        for batch in batches:
            texts = batch.column(1)
            found = [trie.count(texts[k].as_py()) for k in range(batch.num_rows)]
            columns = [pa.array([x[c] for x in found], pa.int64()) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "n_words", "n_tokens"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_words bigint, n_tokens bigint")


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")
