"""Phrase collocations: best-first branch-and-bound growth of phrases, word by word.

A node is a phrase; opening it counts all phrases of one word more that begin with it, in a scan of
the corpus. A phrase q that begins with p has a score of at most 2f(p) / (f(first word) + f(p)): it is no more frequent than p,
and the cut after its first word leaves a rest at least as frequent as q. Nodes are opened, the best bounds first, until
no node could change which phrases are a language's best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callscope.llm.common import cut, quoted, read
from callscope.llm.spans import GOLDEN, SECOND, hash_spans, mixed, windows

#: A-Z in lower case.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bytes that end a piece, and those that part the words of one.
BREAK, BLANK = b".,;:!?\n\x0b\x0c\r", b" \t"
KINDS = np.array([2 if b in BREAK else 1 if b in BLANK else 0 for b in range(256)], np.uint8)
BREAKS = regex.compile(rb"[.,;:!?\n\x0b\x0c\r]")
#: A set of phrases as a bitmap of their hashes: 2^26 bits, 8 MB, whatever the number of phrases. Chance members are sorted out later.
BITS = 26
COUNTS = "lang string, phrase string, n bigint"
KEY = ["lang", "phrase"]


class Words:
    """The words of some texts, their pieces, and hashes of the phrases that begin at each; equal phrases of a language have equal hashes."""

    def __init__(self, texts: list[bytes], langs: np.ndarray):
        self.data = b"\n".join(texts).translate(LOWER)
        kinds = KINDS[np.frombuffer(self.data, np.uint8)]
        edge = np.diff((kinds == 0).view(np.int8), prepend=0, append=0)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.piece = np.searchsorted(np.flatnonzero(kinds == 2), self.start)
        self.text = np.searchsorted(np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1), self.start, side="right")
        self.word = hash_spans(windows(self.data), self.start, self.end - self.start)
        self.keys = [mixed(self.word + langs[self.text] * GOLDEN)]
        # Whether just one space follows a word; then a phrase stands in the data as it is written.
        follows = np.frombuffer(self.data + b" ", np.uint8)[self.end] == 32
        follows[:-1] &= self.start[1:] == self.end[:-1] + 1
        self.odd = np.append(0, np.cumsum(~follows))

    def key(self, m: int) -> np.ndarray:
        """The hash of the m words from each word on that has so many."""
        while len(self.keys) < m:
            last, k = self.keys[-1], len(self.keys)
            self.keys.append(mixed(last[: max(0, len(self.word) - k)] * SECOND + self.word[k:]))
        return self.keys[m - 1]

    def whole(self, m: int) -> np.ndarray:
        """The words that begin m words of one piece."""
        return np.flatnonzero(self.piece[: max(0, len(self.piece) - m + 1)] == self.piece[m - 1 :])

    def phrases(self, first: np.ndarray, m: int | np.ndarray) -> Iterator[tuple[np.ndarray, pa.Array]]:
        """Some of the phrases of m words that begin at `first`, and their texts with one space between words."""
        m = np.broadcast_to(m, first.shape)
        odd = self.odd[first + m - 1] > self.odd[first]
        plain, last = first[~odd], (first + m - 1)[~odd]
        size = self.end[last] - self.start[plain]
        offsets = np.append(0, np.cumsum(size))
        place = np.repeat(self.start[plain] - offsets[:-1], size) + np.arange(offsets[-1])
        raw = np.frombuffer(self.data, np.uint8)[place]
        yield np.flatnonzero(~odd), pa.Array.from_buffers(pa.string(), len(plain), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw)])
        spans = [[self.data[self.start[w] : self.end[w]] for w in range(i, i + n)] for i, n in zip(first[odd], m[odd], strict=True)]
        yield np.flatnonzero(odd), pa.array([b" ".join(s).decode() for s in spans], pa.string())


def tested(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bitmap holds each key."""
    place = keys >> np.uint64(64 - BITS)
    return (bitmap[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def slices(batches: Iterator[pa.RecordBatch], slice_bytes: int) -> Iterator[tuple[list[bytes], list[str], list[int]]]:
    """Texts, languages and their hashes, of about `slice_bytes` together; a long text is cut where a piece ends."""
    texts, langs, hashes, size = [], [], [], 0
    for batch in batches:
        for k in range(batch.num_rows):
            text, lang, code, at = batch.column(2)[k].as_py() or b"", batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), 0
            while True:
                found = BREAKS.search(text, at + slice_bytes) if len(text) - at > slice_bytes else None
                part = text[at : found.start()] if found else text[at:]
                texts.append(part)
                langs.append(lang)
                hashes.append(code)
                size += len(part)
                if size >= slice_bytes:
                    yield texts, langs, hashes
                    texts, langs, hashes, size = [], [], [], 0
                if not found:
                    break
                at = found.start()
    if texts:
        yield texts, langs, hashes


def grown(w: Words, opened: np.ndarray, known: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """(m, words that begin a phrase of m words whose first m - 1 are an opened node), if its inner words and pairs are frequent."""
    able = tested(known, w.key(1))
    pair = tested(known, w.key(2)) if longest > 2 and len(w.start) > 1 else None
    for m in range(2, longest + 1):
        first = w.whole(m)
        first = first[able[first] & able[first + m - 1]]
        for k in range(m - 1 if m > 2 and pair is not None else 0):
            first = first[pair[first + k]]
        first = first[tested(opened, w.key(m - 1)[first])]
        if len(first):
            yield m, first


def count(corpus: DataFrame, opened: np.ndarray | None, known: np.ndarray | None, longest: int, slice_bytes: int, only: np.ndarray | None = None) -> DataFrame:
    """(lang, phrase, n): occurrences of the phrases of one word more than an opened node, which they begin with.

    opened, known: bitmaps of the opened nodes and of all frequent phrases of one and two words. A phrase is counted only
    if its inner words and pairs are frequent, as it could not be frequent otherwise, and if `only`, a bitmap, holds it. Without bitmaps single
    words are counted, and with a null phrase all words. Phrases are summed up in each slice of a task's texts before Spark groups them.
    """
    shared = corpus.sparkSession.sparkContext.broadcast((opened, known, only))

    def rows(w: Words, first: np.ndarray, m: int, names: pa.Array, lang_of: np.ndarray) -> Iterator[pa.RecordBatch]:
        _, at, n = np.unique(w.key(m)[first], return_index=True, return_counts=True)
        first = first[at]
        for some, texts in w.phrases(first, m):
            lang = names.take(pa.array(lang_of[w.text[first[some]]]))
            yield pa.RecordBatch.from_arrays([lang, texts, pa.array(n[some].astype(np.int64))], ["lang", "phrase", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, frequent, sieve = shared.value
        for texts, langs, hashes in slices(batches, slice_bytes):
            w = Words(texts, np.array(hashes, np.int64).view(np.uint64))
            numbers = {x: k for k, x in enumerate(sorted(set(langs)))}
            lang_of = np.array([numbers[x] for x in langs], np.int64)
            names = pa.array(list(numbers), pa.string())
            if nodes is None:
                yield from rows(w, np.arange(len(w.start)), 1, names, lang_of)
                total = np.bincount(lang_of[w.text], minlength=len(names))
                yield pa.RecordBatch.from_arrays([names, pa.nulls(len(names), pa.string()), pa.array(total)], ["lang", "phrase", "n"])
                continue
            for m, first in grown(w, nodes, frequent, longest):
                yield from rows(w, first if sieve is None else first[tested(sieve, w.key(m)[first])], m, names, lang_of)

    return corpus.mapInArrow(run, COUNTS).groupBy(*KEY).agg(F.sum("n").alias("n"))


def sieve(corpus: DataFrame, opened: np.ndarray, known: np.ndarray, least: int, longest: int, slice_bytes: int) -> np.ndarray:
    """A bitmap that holds all phrases count() would find `least` times: those whose hash is met so often.

    Most pairs of frequent words are rare; as hashes they cost less to shuffle and to group than as texts. Phrases of one
    hash only add to each other's number, so none that is frequent is missed; count() then counts their texts.
    """
    shared = corpus.sparkSession.sparkContext.broadcast((opened, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, frequent = shared.value
        for texts, _, hashes in slices(batches, slice_bytes):
            w = Words(texts, np.array(hashes, np.int64).view(np.uint64))
            for m, first in grown(w, nodes, frequent, longest):
                keys, n = np.unique(w.key(m)[first], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    keys = corpus.mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    place = F.call_function("shiftrightunsigned", F.col("key"), F.lit(64 - BITS))
    return packed(keys.select(F.shiftright(place, 6).alias("at"), F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(F.lit(63)).cast("int")).alias("bits")))


def runs(corpus: DataFrame, known: np.ndarray, slice_bytes: int) -> DataFrame:
    """What of the corpus phrases of three words and more can stand in: the longest runs of words whose pairs are all frequent, as lines of one text for each slice and language.

    Every such phrase stands whole in one run, so counts over the runs are those over the corpus; runs of two words are left out.
    """
    shared = corpus.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value
        for texts, langs, hashes in slices(batches, slice_bytes):
            w = Words(texts, np.array(hashes, np.int64).view(np.uint64))
            pairs = np.zeros(len(w.start) + 1, np.int8)  # whether a word and the next one are a frequent pair
            first = w.whole(2)
            pairs[first[tested(frequent, w.key(2)[first])]] = 1
            edge = np.diff(pairs, prepend=0)
            start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            start, size = start[end - start > 1], (end - start + 1)[end - start > 1]
            numbers = {x: k for k, x in enumerate(sorted(set(langs)))}
            codes = dict(zip(langs, hashes, strict=True))
            lang_of = np.array([numbers[x] for x in langs], np.int64)
            for some, text in w.phrases(start, size):
                of = lang_of[w.text[start[some]]]
                order, sizes = np.argsort(of, kind="stable"), np.bincount(of, minlength=len(numbers))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), text.take(pa.array(order)))
                joined = pc.binary_join(lists, "\n").cast(pa.binary())  # a text for each language, whose lines are its runs
                yield pa.RecordBatch.from_arrays([pa.array(list(numbers), pa.string()), pa.array([codes[x] for x in numbers], pa.int64()), joined], ["lang", "code", "text"])

    return corpus.mapInArrow(run, "lang string, code bigint, text binary")


def packed(rows: DataFrame) -> np.ndarray:
    """The bitmap whose words (at) hold the bits of all rows; Spark joins them, at most one row for each word comes to the driver."""
    found = rows.groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << BITS - 6, np.uint64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def bitmap(nodes: DataFrame) -> np.ndarray:
    """The bitmap of some phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.encode() for x in batch.column(0).to_pylist()]
            w = Words(texts, batch.column(1).to_numpy().view(np.uint64))
            first = np.searchsorted(w.text, np.arange(len(texts)))
            size = np.bincount(w.text, minlength=len(texts))
            place = np.zeros(len(texts), np.uint64)
            for m in np.unique(size):
                place[size == m] = w.key(m)[first[size == m]] >> np.uint64(64 - BITS)
            bits = (np.uint64(1) << (place & np.uint64(63))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((place >> np.uint64(6)).view(np.int64)), pa.array(bits)], ["at", "bits"])

    return packed(nodes.select("phrase", F.xxhash64("lang").alias("code")).mapInArrow(run, "at bigint, bits bigint"))


def score(a: Column, parts: Column) -> Column:
    """floor(2000000 * a / parts), exact: the product may pass 64 bits."""
    return F.call_function("div", a.cast("decimal(20,0)") * F.lit(2_000_000).cast("decimal(7,0)"), parts.cast("decimal(21,0)"))


def first_words(n) -> Column:
    return F.expr(f"substring_index(phrase, ' ', {n})")


def last_words(n) -> Column:
    return F.expr(f"substring_index(phrase, ' ', -({n}))")


def judged(nodes: DataFrame) -> DataFrame:
    """The candidates with their lowest-scoring cut (score, k, l, r), whether it is `exact`, `dropped`, and their head.

    A part whose count is not known yet leaves a score that the true one does not pass.
    """
    parts = nodes.select("lang", F.col("phrase").alias("part"), F.col("f").alias("part_f"))
    many = nodes.filter("m > 1")
    cuts = many.select(*KEY, "f", "m", F.explode(F.expr("sequence(1, m - 1)")).alias("k"))
    cuts = cuts.withColumns({"left": first_words("k"), "right": last_words("m - k")})
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(parts.select("lang", F.col("part").alias(side), F.col("part_f").alias(name)), ["lang", side], "left")
    best = F.struct(score(F.col("f"), F.col("l").cast("decimal(20,0)") + F.col("r")).alias("score"), "k", "l", "r")
    cuts = cuts.groupBy(*KEY).agg(F.min(F.when(F.col("l").isNotNull() & F.col("r").isNotNull(), best)).alias("c"), (F.count("l") == F.count(F.lit(1))).alias("x"), (F.count("r") == F.count(F.lit(1))).alias("y"))
    cuts = cuts.select(*KEY, "c.*", (F.col("x") & F.col("y")).alias("exact"))
    # The most frequent phrase of one word more: if a longer one drops a phrase, so does one between them.
    longer = nodes.filter("m > 2")
    longer = longer.select("lang", first_words("m - 1").alias("phrase"), "f").unionByName(longer.select("lang", last_words("m - 1").alias("phrase"), "f"))
    longer = longer.groupBy(*KEY).agg(F.max("f").alias("_longer"))
    found = many.join(cuts, KEY).join(longer, KEY, "left")
    return found.withColumns({"dropped": F.coalesce(5 * F.col("_longer") >= 4 * F.col("f"), F.lit(False)), "head": first_words("m - 1")}).drop("_longer")


def wanted(nodes: DataFrame, found: DataFrame, top: int, ahead: int, longest: int) -> DataFrame:
    """The nodes that may be opened next, with `must`: whether the best `top` phrases of a language depend on it.

    found: judged(nodes). A language's bar is the score of its `top`-th phrase that is not dropped. A node must be opened if its bound reaches the
    bar; if a phrase of at least the bar, which begins with all words of the node but its first, could be dropped by what the node begins, by its
    children or by theirs; or if such a phrase has a part that only the node gives. The others have these reasons for a lower bar, that of `ahead` times as many phrases.
    """
    alive = found.filter(~F.col("dropped"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score")))
    bars = alive.select("lang", "score", place.alias("p")).filter(F.col("p") <= ahead * top)
    bars = bars.groupBy("lang").agg(*[F.coalesce(F.max(F.when(F.col("p") == n, F.col("score"))), F.lit(0)).alias(name) for name, n in (("bar", top), ("low", ahead * top))])
    alive = alive.join(bars, "lang").filter(F.col("score") >= F.col("low"))
    high = F.col("score") >= F.col("bar")
    begun = alive.filter(F.col("m") < longest).withColumn("k", F.explode(F.expr("sequence(1, m - 1)"))).withColumn("tail", first_words("k"))
    least = begun.groupBy("lang", "tail").agg(F.min("f").alias("least_low"), F.min(F.when(high, F.col("f"))).alias("least"))
    part = alive.filter(~F.col("exact")).select("lang", F.expr("substring_index(substring_index(phrase, ' ', -(m - 1)), ' ', m - 2)").alias("phrase"), high.alias("high"))
    part = part.groupBy(*KEY).agg(F.max("high").alias("part"))
    able = nodes.filter((F.col("m") > 1) & (F.col("m") < longest) & ~F.col("open")).withColumns({"tail": last_words("m - 1"), "bound": score(F.col("f"), F.col("lead").cast("decimal(20,0)") + F.col("f"))})
    able = able.join(bars, "lang", "left").fillna(0, ["bar", "low"]).join(least, ["lang", "tail"], "left").join(part, KEY, "left")
    must = (F.col("bound") >= F.col("bar")) | (5 * F.col("f") >= 4 * F.col("least")) | F.col("part")
    may = (F.col("bound") >= F.col("low")) | (5 * F.col("f") >= 4 * F.col("least_low")) | F.col("part").isNotNull()
    return able.filter(F.coalesce(may, F.lit(False))).select(*KEY, "lead", F.coalesce(must, F.lit(False)).alias("must"))


def collocations(
    docs: DataFrame, top: int = 2000, least: int = 30, longest: int = 4, ahead: int = 2, lang_col: str = "lang", text_col: str = "text", slice_bytes: int = 1 << 22,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best `top` phrases of 2 to `longest` words.

    Texts are lower-cased in A-Z and split at `[.,;:!?\\x0A-\\x0D]` into pieces, these at spaces and tabs into words. n: all words of
    a language. a: a phrase's occurrences in pieces, `least` at the least. A cut of it has the score floor(2000000 * a / (l + r)), with l and r
    the occurrences of its two parts; the lowest counts, ties to the earliest cut. Phrases that stand in a longer one of 80 % of their
    occurrences are dropped. Order: score, then a, both falling, then the phrase in bytes.

    Nodes are opened in rounds, the best bounds first. Words and pairs take three scans of the corpus, and a fourth keeps the runs of frequent
    pairs, which each further round scans in its place. A scan sends only phrases that its opened nodes begin and whose inner words and
    pairs are frequent; pairs of words are sieved by their hashes first. Three bitmaps of fixed size are all that is broadcast; they lose
    nothing, and what they let pass by chance is dropped by a join. Counts, phrases and candidates are Spark tables. Inside a slice of a
    text phrases are told apart by a 64-bit hash, between tasks by their text.

    Null texts are empty; null languages are 'und'. Repeated rows count each. An empty table, and a language without a frequent
    phrase, give no rows. Only the two columns are read, so other names cannot clash. A piece is held whole.
    """
    if not 2 <= longest <= 4:
        raise ValueError("phrases of two to four words are mined")
    lang = F.coalesce(F.col(quoted(lang_col)).cast("string"), F.lit("und"))
    corpus = docs.select(lang.alias("lang"), F.xxhash64(lang).alias("code"), F.col(quoted(text_col)).cast("binary").alias("text"))
    words = cut(count(corpus, None, None, longest, slice_bytes).filter(F.col("phrase").isNull() | (F.col("n") >= least)))
    totals = words.filter("phrase IS NULL").select("lang", F.col("n"))
    nodes = words.filter("phrase IS NOT NULL").select(*KEY, F.lit(1).alias("m"), F.col("n").alias("f"), F.col("n").alias("lead"), F.lit(True).alias("open"))
    opened = nodes.select(*KEY, "lead")  # the bound of every word is the greatest there is
    frequent = None
    while True:
        now, only = bitmap(opened), None
        if frequent is None:
            frequent = now
            only = sieve(corpus, now, frequent, least, longest, slice_bytes)
        heads = opened.select("lang", F.col("phrase").alias("head"), "lead")
        new = count(corpus, now, frequent, longest, slice_bytes, only).filter(F.col("n") >= least)
        new = new.withColumn("m", F.size(F.split("phrase", " "))).withColumn("head", first_words("m - 1")).join(heads, ["lang", "head"])
        new = cut(new.select(*KEY, "m", F.col("n").alias("f"), "lead", F.lit(False).alias("open")))
        known = nodes.join(opened.select(*KEY, F.lit(True).alias("_now")), KEY, "left").withColumn("open", F.col("open") | F.coalesce("_now", F.lit(False))).drop("_now")
        nodes = cut(known.unionByName(new))
        if now is frequent:
            frequent = frequent | bitmap(new)  # all pairs are known now
            if longest > 2:
                corpus = cut(runs(corpus, frequent, slice_bytes))
        found = cut(judged(nodes))
        opened = cut(wanted(nodes, found, top, ahead, longest))
        if opened.filter("must").isEmpty():
            break
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("f"), "phrase"))
    best = found.filter(~F.col("dropped")).withColumn("rank", place).filter(F.col("rank") <= top).join(totals, "lang")
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("f").alias("a"), "l", "r", "n", "score")


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
f AS (
  SELECT lang, m, phrase, count(*) AS f FROM (
    SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i : i + m - 1], ' '))) AS phrase
    FROM worded, (SELECT unnest(range(1, 5)) AS m) WHERE len(w) >= m)
  GROUP BY lang, m, phrase HAVING m = 1 OR count(*) >= 30),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
k AS (
  SELECT lang, phrase, a, k, array_to_string(w[1 : k], ' ') AS p, array_to_string(w[k + 1 : m], ' ') AS q
  FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
cuts AS (
  SELECT k.lang, k.phrase, a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * a) // (x.f + y.f) AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = p JOIN f y ON y.lang = k.lang AND y.phrase = q),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_phrases AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, unnest(list_transform(range(1, m - s + 2), lambda i: array_to_string(w[i : i + s - 1], ' '))) AS phrase
    FROM (SELECT *, unnest(range(2, m)) AS s FROM c))
  GROUP BY ALL),
kept AS (
  SELECT x.* FROM lowest x LEFT JOIN inner_phrases i USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN n USING (lang) WHERE rank <= 2000
"""
