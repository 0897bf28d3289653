"""BPE encoding and decoding by a streaming transducer with bounded lookahead.

For every prefix of a pre-token, the last token of its encoding is the only vocabulary entry that
ends there and fits after the last token of what stands before it; two tokens fit if the merges
leave them as they are side by side. So an encoding grows symbol by symbol, and the encoding of a
prefix is the chain of its last tokens. The merge list bounds how far behind the last symbol
such a chain can still change; tokens before that are stable and leave the window.
"""

from __future__ import annotations

import codecs
import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.common import quoted

END = "</w>"
#: White space of the normaliser and the pre-tokeniser: Unicode's White_Space.
SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACES = regex.compile(rf"[{SPACE}]+")
#: What Python's split() takes for white space and the tokenizer does not.
ODD_SPACES = "\x1c\x1d\x1e\x1f"
PRETOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if printable, else one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Vocabulary:
    """A word-end BPE vocabulary: ids, merge ranks, special tokens, and the lookahead that its merges need."""

    def __init__(self, text: str):
        spec = json.loads(text)
        self.ids: dict[str, int] = spec["model"]["vocab"]
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): k for k, m in enumerate(spec["model"]["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in (self.ids | self.special).items()}
        self.pair_ranks = {self.ids[a] << 20 | self.ids[b]: k for (a, b), k in self.ranks.items()}
        self.symbols = byte_symbols()
        self.bytes = {s: b for b, s in enumerate(self.symbols)}
        # Tokens and their proper prefixes: from a place a token can only grow through these.
        self.prefixes = {t[:k] for t in self.ids for k in range(1, len(t.removesuffix(END)))} | set(self.ids)
        self.most = max(len(s.removesuffix(END)) for s in self.ids)
        self.lookahead = self.sufficient_lookahead()

    def sufficient_lookahead(self) -> int:
        """Symbols after which no later symbol can change a boundary.

        A symbol changes a boundary to its left only through a chain of merges (x, y), (y, z) in
        which the right one comes first; the longest such chain, in tokens of the greatest length,
        bounds how far a change reaches.
        """
        reach: dict[str, int] = {}
        for left, right in self.ranks:  # in order of rank
            reach[left] = max(reach.get(left, 0), 1 + reach.get(right, 0))
        return max(reach.values(), default=0) * self.most


class Transducer:
    """Encodes texts a pre-token at a time, and pre-tokens symbol by symbol.

    Of a pre-token only a window is kept: what is not stable yet, of less than twice the lookahead
    and the longest token together, whatever the length of the text. Ids are held as the bytes of 32-bit
    integers. At most twice `most_words` short words and `most_pairs` pairs of tokens are remembered.
    """

    def __init__(self, vocabulary: Vocabulary, most_words: int = 250_000, most_pairs: int = 400_000, short: int = 64, slice_chars: int = 1 << 16):
        self.v, self.most_words, self.most_pairs, self.short, self.slice_chars = vocabulary, most_words, most_pairs, short, slice_chars
        self.window = 2 * (vocabulary.lookahead + vocabulary.most)
        # What has been read ends with a prefix of a token; a state is the longest such prefix.
        self.states: list[str] = [""]
        self.numbers: dict[str, int] = {"": 0}
        self.ending: list[tuple[tuple[int, int], ...]] = [()]  # the tokens that end there and their lengths, long ones first
        self.next: dict[int, int] = {}
        self.forms: dict[int, tuple[bool, int, int, int]] = {}
        self.edges: tuple[dict[int, tuple[tuple[int, int], ...]], ...] = {}, {}
        self.known_fits: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(vocabulary.special, key=len, reverse=True)))

    def merged(self, symbols: list[str]) -> tuple[list[str], tuple[str, str] | None]:
        """A token's symbols after all merges, lowest rank first and leftmost first, and the last merge."""
        ranks, last = self.v.ranks, None
        while len(symbols) > 1:
            pairs = list(zip(symbols, symbols[1:], strict=False))
            best = min(pairs, key=lambda p: ranks.get(p, 1 << 60))
            if best not in ranks:
                break
            last, out, i = best, [], 0
            while i < len(symbols):
                if i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == best:
                    out.append(symbols[i] + symbols[i + 1])
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols, last

    def split(self, token: str) -> list[str]:
        body = token.removesuffix(END)
        return [*body[:-1], body[-1] + END] if body != token else list(token)

    def form(self, token: int) -> tuple[bool, int, int, int]:
        """Whether the merges make the token of its own symbols, and the last merge: left, right, rank."""
        known = self.forms.get(token)
        if known is None:
            symbols, ids = self.split(self.v.strings[token]), self.v.ids
            if len(symbols) == 1:
                known = True, -1, -1, -1
            else:
                merged, last = self.merged(symbols)
                known = (len(merged) == 1, *((ids[last[0]], ids[last[1]], self.v.ranks[last]) if last else (-1, -1, -1)))
            self.forms[token] = known
        return known

    def edge(self, token: int, right: bool) -> tuple[tuple[int, int], ...]:
        """The tokens that stand at an edge of `token` while it is made, with the rank that ends each."""
        known = self.edges[right].get(token)
        if known is None:
            found, at, until = [], token, 1 << 60
            while at >= 0:
                found.append((at, until))
                _, left_part, right_part, until = self.form(at)
                at = right_part if right else left_part
            known = self.edges[right][token] = tuple(found)
        return known

    def fits(self, a: int, b: int) -> bool:
        """Whether token b can stand after token a; a = -1 is the start."""
        known = self.known_fits.get(key := (a + 1) << 20 | b)
        if known is None:
            if len(self.known_fits) >= self.most_pairs:
                self.known_fits.clear()
            known = self.known_fits[key] = self.form(b)[0] and (a < 0 or not self.crossed(a, b))
        return known

    def crossed(self, a: int, b: int) -> bool:
        """Whether a merge across the border of two tokens comes before those that end its two sides.

        At equal rank the left place is merged first.
        """
        ranks, left = self.v.pair_ranks, self.edge(b, False)
        for x, x_until in self.edge(a, True):
            for y, y_until in left:
                rank = ranks.get(x << 20 | y)
                if rank is not None and rank < x_until and rank <= y_until:
                    return True
        return False

    def go(self, state: int, symbol: int) -> int:
        """The state after one more symbol; 256 and more stand for the last symbol of a pre-token."""
        text = self.states[state] + self.v.symbols[symbol & 255] + END * (symbol > 255)
        while text and text not in self.v.prefixes:
            text = text[1:] if text.removesuffix(END)[1:] else ""
        number = self.numbers.get(text)
        if number is None:
            number = self.numbers[text] = len(self.states)
            self.states.append(text)
            length = len(text.removesuffix(END))
            self.ending.append(tuple((self.v.ids[text[k:]], length - k) for k in range(length) if text[k:] in self.v.ids))
        self.next[state << 9 | symbol] = number
        return number

    def pretoken(self, data: bytes) -> bytes:
        """Ids of a pre-token of any length. Stable tokens leave the window when it is full."""
        following, ending, known_fits, end = self.next, self.ending, self.known_fits, len(data)
        # Of each prefix in the window: its last token (-2 if it can only end within one) and where that starts.
        last, start, out, base, state = [-1], [0], array("i"), 0, 0
        for n, symbol in enumerate(data, 1):
            if n == end:
                symbol += 256
            state = following.get(state << 9 | symbol) or self.go(state, symbol)
            for token, length in ending[state]:
                before = last[n - base - length] if length <= n - base else -2
                if before > -2 and ((fit := known_fits.get((before + 1) << 20 | token)) or (fit is None and self.fits(before, token))):
                    last.append(token)
                    start.append(n - length)
                    break  # no other entry fits
            else:
                last.append(-2)
                start.append(base)
            if n - base >= self.window and n < end:
                stable = self.stable(state, last, start, base, n)
                out.extend(self.chain(last, start, base, stable))
                last, start, base = last[stable - base :], start[stable - base :], stable
        out.extend(self.chain(last, start, base, end))
        return out.tobytes()

    def chain(self, last: list[int], start: list[int], base: int, n: int) -> list[int]:
        """The tokens of the window that encode the prefix of n symbols."""
        found = []
        while n > base:
            found.append(last[n - base])
            n = start[n - base]
        return found[::-1]

    def stable(self, state: int, last: list[int], start: list[int], base: int, n: int) -> int:
        """The last boundary that every prefix which can still go on shares; the lookahead bounds what is after it."""
        text, common = self.states[state], set(range(base, n + 1))
        # A later token starts at the end, or where the rest is a prefix of a token.
        for j in (n, *(n - len(text) + k for k in range(len(text)) if text[k:] in self.v.prefixes)):
            if j < base or last[j - base] == -2:
                continue
            before = {j}
            while j > base:
                j = start[j - base]
                before.add(j)
            common &= before
        found = max(common)
        if n - found > self.v.lookahead + self.v.most:
            raise ValueError(f"{n - found} symbols are not stable; the merges need a lookahead of {self.v.lookahead}")
        return found

    def keep(self, chunk: str, known: bytes) -> bytes:
        """Keeps a short chunk; those not met again since the last exchange of the two halves go."""
        if len(chunk) <= self.short:
            if len(self.words) >= self.most_words:
                self.old_words, self.words = self.words, {}
            self.words[chunk] = known
        return known

    def chunk(self, chunk: str) -> bytes:
        """Ids of text without white space."""
        known = self.words.get(chunk) or self.old_words.get(chunk)
        if known is not None:
            return self.keep(chunk, known)
        low = chunk if chunk.isascii() else unicodedata.normalize("NFC", chunk)
        low = low.lower() if "Σ" not in low else "".join(c.lower() for c in low)  # no final sigma
        word = low.rstrip(".,")
        if not word.isalpha():
            return self.keep(chunk, b"".join([self.word(p) for p in PRETOKEN.findall(low)]))
        known = self.word(word)
        if word != low:  # full stops and commas after letters are a pre-token of their own
            known = known + self.word(low[len(word) :])
        return self.keep(chunk, known) if chunk != word else known

    def word(self, pretoken: str) -> bytes:
        return self.words.get(pretoken) or self.old_words.get(pretoken) or self.keep(pretoken, self.pretoken(pretoken.encode()))

    def encode(self, text: str) -> bytes:
        """Ids of a text, as 32-bit integers."""
        parts: list[bytes] = []
        for piece in self.pieces(text):
            if piece in self.v.special:
                parts.append(array("i", [self.v.special[piece]]).tobytes())
                continue
            chunks = SPACES.split(piece) if any(c in piece for c in ODD_SPACES) else piece.split()
            known = self.words.get
            parts.append(b"".join([known(c) or self.chunk(c) for c in chunks if c]))
        return b"".join(parts)

    def pieces(self, text: str) -> Iterator[str]:
        """The text parted at special tokens, which are pieces of their own, and in slices that end at a space."""
        at = 0
        while at < len(text):
            end = text.find(" ", at + self.slice_chars)
            piece = text[at : end if end >= 0 else len(text)]
            at += len(piece)
            done = 0
            for m in self.special.finditer(piece) if any(s in piece for s in self.v.special) else ():
                if m.start() > done:
                    yield piece[done : m.start()]
                yield m.group()
                done = m.end()
            if done < len(piece):
                yield piece[done:] if done else piece


class Decoder:
    """Ids to text, some at a time, by an incremental UTF-8 state machine across tokens.

    The file names no decoder, so its decoded form is the token strings joined by one space. With
    plain=True the result is the text itself: byte symbols become bytes and word ends become
    spaces. Bad bytes become U+FFFD.
    """

    def __init__(self, vocabulary: Vocabulary, plain: bool = False):
        self.plain, self.utf8, self.first = plain, codecs.getincrementaldecoder("utf-8")("replace"), True
        table = [b""] * (max(vocabulary.strings) + 1)
        special = set(vocabulary.special.values())
        for i, token in vocabulary.strings.items():
            body = token.removesuffix(END)
            table[i] = token.encode() if not plain or i in special else bytes(vocabulary.bytes[c] for c in body) + b" " * (body != token)
        self.table = pa.array(table, pa.binary())

    def feed(self, ids: np.ndarray) -> str:
        if not len(ids):
            return ""
        taken = self.table.take(pa.array(ids, pa.int32()))
        raw = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), taken), b"" if self.plain else b" ")[0].as_py()
        lead, self.first = " " * (not self.plain and not self.first), False
        return lead + self.utf8.decode(raw)

    def close(self) -> str:
        rest, self.first = self.utf8.decode(b"", final=True), True
        return rest

    def decode(self, ids: np.ndarray, step: int = 1 << 16) -> str:
        """All of a text, `step` ids at a time."""
        if len(ids) <= step:
            return self.feed(ids) + self.close()
        return "".join([*(self.feed(ids[k : k + step]) for k in range(0, len(ids), step)), self.close()])


def _encoded(batches: Iterator[pa.RecordBatch], spec: str, slice_bytes: int) -> Iterator[pa.RecordBatch]:
    """(id, ids, decoded, plain) of batches of (id, text); the tables are the task's own."""
    vocabulary = Vocabulary(spec)
    t, named, plain = Transducer(vocabulary), Decoder(vocabulary), Decoder(vocabulary, plain=True)

    def made(held: list[bytes]) -> list[pa.Array]:
        offsets = pa.array(np.cumsum([0, *(len(x) // 4 for x in held)]), pa.int32())
        every = np.frombuffer(b"".join(held), np.int32)
        rows = [np.frombuffer(x, np.int32) for x in held]
        return [pa.ListArray.from_arrays(offsets, pa.array(every)), *(pa.array([d.decode(x) for x in rows], pa.string()) for d in (named, plain))]

    for batch in batches:
        texts, at, held, size = batch.column(1), 0, [], 0
        for k in range(batch.num_rows):
            text = texts[k].as_py()
            held.append(t.encode(text))
            size += len(text)
            if size >= slice_bytes or k + 1 == batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(held)), *made(held)], ["id", "ids", "decoded", "plain"])
                at, held, size = k + 1, [], 0


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = 1 << 22) -> DataFrame:
    """(id, ids, decoded, plain) of every row: the token ids of its whole text, their decoded form and the text they stand for.

    path: a tokenizer file with a word-end BPE model; its content, of the vocabulary's size, is
    broadcast. Null and empty texts have no ids and decode to ''. Special tokens in a text become
    their ids. Rows are encoded one by one, so repeated rows repeat their result, and an empty table
    gives an empty result. Only the id and text columns are read, so other names cannot clash. Besides the
    row itself a task holds tables of bounded size; output leaves it in slices of about `slice_bytes` of text.
    """
    with open(path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _encoded(batches, shared.value, slice_bytes)

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, decoded string, plain string")


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    digests = [F.sha2(c, 256).alias(f"{name}_sha256") for name, c in (("ids", ids), ("decoded", F.col("decoded")), ("plain", F.col("plain")))]
    return found.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), *digests)
