"""Byte-level BPE, importance resampling and phrase collocations against brute force and the library that they must equal."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from callscope.llm import byte_bpe, collocations, queries, resampling
from callscope.llm.spans import LONG, PerfectHash, hash_spans, windows

DATA = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Columns whose names the operators use themselves.
CLASHING = "doc_id long, text string, lang string, id string, ids string, rank int, phrase string, n int, score string, code string"


def rows_of(texts, langs=("en", "de", None)):
    return [(k, t, langs[k % len(langs)], "i", "j", 1, "p", 2, "s", "c") for k, t in enumerate(texts)]


def frame(spark, texts, langs=("en", "de", None)):
    return spark.createDataFrame(rows_of(texts, langs), CLASHING).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], CLASHING)


def word(text):
    return text or ""


# Spans and the perfect hash


def test_hashes_of_spans_do_not_depend_on_their_place():
    rng = random.Random(1)
    spans = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 7, 8, 9, 16, 17, LONG, LONG + 1, 3000)]
    seen = {}
    for lead in (b"", b"x", b"some other lead"):
        data, start = lead + b"|".join(spans), len(lead)
        starts = np.cumsum([start, *(len(s) + 1 for s in spans[:-1])])
        hashes = hash_spans(windows(data), starts, np.array([len(s) for s in spans]))
        assert len(set(hashes.tolist())) == len(spans)
        assert seen.setdefault("first", hashes.tolist()) == hashes.tolist()


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 5000])
def test_perfect_hash_is_minimal_and_exact(n):
    rng = random.Random(n)
    keys = list({bytes(rng.randrange(256) for _ in range(rng.randrange(1, 20))) for _ in range(n)})
    table = PerfectHash(keys, range(len(keys)))
    others = [k + b"x" for k in keys[:100]] + [k[:-1] for k in keys[:100]] + [b"", b"q" * 1000]
    known = {k: i for i, k in enumerate(keys)}
    spans = keys + others
    length = np.array([len(s) for s in spans])
    found = table.find(windows(b"".join(spans)), np.cumsum(length) - length, length)
    assert found.tolist() == [known.get(s, -1) for s in spans]
    assert sorted(table.values.tolist()) == list(range(len(keys)))  # a slot for each key, and no other


def test_perfect_hash_refuses_equal_keys():
    with pytest.raises(ValueError):
        PerfectHash([b"a", b"a"], [1, 2])


# Byte-level BPE


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})


def bpe_texts():
    rng = random.Random(11)
    hard = [None, "", " ", "   \n\n\t ", "a" * 6000, "x" * 300 + " " * 300 + "y", "日本語" * 500, "don't I'LL we've 's", "\x00\x1c\x85᠎​", "é é ß 🙂👩‍👩‍👧", "<|endoftext|>", "1234567890" * 40, "!?" * 900, " \xa0  x"]
    hard += ["".join(rng.choice("aeté 日\n'st1!🙂́ ") for _ in range(rng.randrange(300))) for _ in range(150)]
    return hard + [" ".join(rng.choice(["tion", "thre", "Onth", "erea", "zqx"]) * rng.randrange(1, 4) for _ in range(200)) for _ in range(20)]


def test_byte_bpe_equals_the_library(spark, empty, library):
    texts = bpe_texts()
    docs = frame(spark, texts + texts[:5])
    found = byte_bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN, slice_bytes=500).collect()
    assert len(found) == len(texts) + 5
    for r in found:
        text = word((texts + texts[:5])[r["id"]])
        assert r["ids"] == library.encode_ordinary(text), text[:50]
        assert bytes(r["decoded"]) == text.encode()
    assert byte_bpe.encode_documents(empty, PATH, public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_of_long_texts_in_slices_and_with_little_memory(library):
    ranks = byte_bpe.read_ranks(PATH)
    small = byte_bpe.Encoder(ranks, PerfectHash(list(ranks), list(ranks.values())), public_tokenizers.PATTERN, most_pieces=20, slice_chars=64)
    for text in filter(None, bpe_texts()):
        parts = list(small.slices(text))
        assert "".join(parts) == text
        assert np.concatenate([small.encode([p])[0] for p in parts]).tolist() == library.encode_ordinary(text)
    assert len(small.known) <= 20 and len(small.older) <= 20


def test_heap_merges_equal_repeated_search_of_the_best_pair(library):
    ranks = byte_bpe.read_ranks(PATH)
    encoder = byte_bpe.Encoder(ranks, PerfectHash([], []), public_tokenizers.PATTERN)
    rng = random.Random(3)
    for _ in range(300):
        piece = "".join(rng.choice("aetion") for _ in range(rng.randrange(1, 40))).encode()
        parts = [piece[k : k + 1] for k in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((ranks.get(a + b, 1 << 40), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 40:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        assert np.frombuffer(encoder.merges(piece), np.int32).tolist() == [ranks[p] for p in parts]


def test_byte_bpe_decodes_lists_and_marks_wrong_ones():
    table = byte_bpe.token_table({b"a": 0, b"bc": 2})
    lists = pa.array([[0, 2, 0], None, [], [1], [0, None], [3], [-1], [2]], pa.list_(pa.int32()))
    assert byte_bpe.decoded(lists, table).to_pylist() == [b"abca", None, b"", None, None, None, None, b"bc"]
    assert byte_bpe.decoded(lists.slice(2, 1), table).to_pylist() == [b""]
    assert byte_bpe.decoded(pa.array([], pa.list_(pa.int32())), table).to_pylist() == []


def test_byte_bpe_round_trip_as_tables(spark):
    texts = bpe_texts()[:40]
    ids = byte_bpe.encode_documents(frame(spark, texts), PATH, public_tokenizers.PATTERN).select("id", "ids")
    back = byte_bpe.decode_documents(ids, PATH, "id")
    assert {r["id"]: bytes(r["decoded"]).decode() for r in back.collect()} == {k: word(t) for k, t in enumerate(texts)}


# Importance resampling


def grams(text, lengths):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), word(text))
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return w, [" ".join(w[i : i + m]) for m in lengths for i in range(len(w) - m + 1)]


def resampled(docs, target, percent, least, lengths, buckets, seed):
    """(id, n_words, n_features, weight, score) of each document in its order, and the sorted (-score, id) of the drawn ones."""
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s = Counter(bucket(g) for _, t in docs for g in grams(t, lengths)[1])
    t = Counter(bucket(g) for x in target for g in grams(x, lengths)[1])
    s_all, t_all, rows = sum(s.values()), sum(t.values()), []
    for i, text in docs:
        w, g = grams(text, lengths)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in map(bucket, g)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(w), len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((-r[4], r[0] is not None, r[0] or 0) for r in rows if r[1] >= least)
    return rows, able[: len(able) * percent // 100]


@pytest.mark.parametrize(("lengths", "percent", "buckets"), [(range(1, 2), 10, 10_000), (range(1, 4), 50, 97), (range(2, 3), 100, 1), (range(1, 2), 0, 10)])
def test_resampling_equals_brute_force(spark, lengths, percent, buckets):
    rng = random.Random(5)
    vocabulary = ["the", "Of", "and", "été", "日本", "x1", "42", "İß"]
    texts = [None, "", " ,;", "one", "A-b_c.D\x00e\x7ff", "long" * 5000] + [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60))) for _ in range(80)]
    docs = [(k if k != 20 else None, t) for k, t in enumerate(texts)]
    docs += docs[10:13]  # repeated rows
    target = [None, "the of of", "日本 42"]
    rows = spark.createDataFrame([(i, t, "g", "h", 1) for i, t in docs], "doc_id long, text string, weight string, id string, rank int").repartition(3)
    wanted, drawn = resampled(docs, target, percent, 20, lengths, buckets, 2024)
    found = resampling.resample(rows, spark.createDataFrame([(t,) for t in target], "text string"), percent, 20, lengths, buckets, slice_bytes=300).collect()
    key = lambda r: (r[0] is None, r)
    assert sorted((tuple(r)[:5] for r in found), key=key) == sorted(wanted, key=key)
    ranked = sorted((r["rank"], -r["score"], r["id"] is not None, r["id"] or 0) for r in found if r["rank"] is not None)
    assert [r[0] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [r[1:] for r in ranked] == drawn


def test_crcs_of_parts_come_from_those_of_prefixes():
    rng, shifts = random.Random(2), resampling.Shifts()
    sizes = [0, 1, 2, 3, 255, 256, 70_001]
    for size in sizes:
        first, second = (bytes(rng.randrange(256) for _ in range(n)) for n in (rng.randrange(1, 50), size))
        moved = shifts.shifted(np.array([zlib.crc32(first)], np.uint32), np.array([size]))[0]
        assert zlib.crc32(first + second) ^ int(moved) == zlib.crc32(second)
    crcs = np.array([zlib.crc32(b"a"), 0], np.uint32)
    assert shifts.with_byte(crcs, 32).tolist() == [zlib.crc32(b"a "), zlib.crc32(b" ")]


def test_resampling_of_empty_tables(spark, empty):
    target = spark.createDataFrame([], "text string")
    assert resampling.resample(empty, target).count() == 0
    some = resampling.resample(frame(spark, ["a b c", None]), target, least_words=1).collect()
    assert sorted((r["id"], r["n_features"], r["rank"]) for r in some) == [(0, 3, None), (1, 0, None)]
    with pytest.raises(ValueError):
        resampling.resample(empty, target, percent=101)


# Phrase collocations


def mined(docs, top, least, longest):
    """All phrases counted, scored and compared, without bounds."""
    out = []
    for lang in {lang or "und" for lang, _ in docs}:
        f, n = Counter(), 0
        for own, text in docs:
            low = re.sub("[A-Z]", lambda m: m.group().lower(), word(text))
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", low) if (own or "und") == lang else ():
                w = re.findall(r"[^\x20\x09]+", piece)
                n += len(w)
                f.update(tuple(w[i : i + m]) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for q, a in often.items():
            for m in range(2, len(q)):
                for i in range(len(q) - m + 1):
                    inside[q[i : i + m]] = max(inside[q[i : i + m]], a)
        rows = []
        for p, a in often.items():
            if 100 * inside[p] >= 80 * a:
                continue
            s, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-s, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, k + 1, p.decode(), -a, left, right, n, -s) for k, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def phrase_docs():
    rng = random.Random(8)
    fixed = ["new york city", "as soon as possible", "in the end of the", "of the", "A-1 b's"]
    texts = [None, "", " \t ", ".,;", "a\x00b \x1c c"]
    for _ in range(300):
        words = [rng.choice("the of and to in is on at by it was for with from this".split()) for _ in range(rng.randrange(1, 12))]
        words.insert(rng.randrange(len(words) + 1), rng.choice(fixed))
        texts.append(rng.choice([" ", "  ", "\t"]).join(words) + rng.choice([". ", "\n", "! The end", ""]) + rng.choice(["", "New York", "NEW  york city"]))
    return texts + texts[5:15]


@pytest.mark.parametrize(("top", "least", "longest"), [(2000, 30, 4), (5, 5, 4), (1, 3, 4), (20, 8, 3), (10, 10, 2), (40, 2, 4)])
def test_collocations_equal_brute_force(spark, top, least, longest):
    texts = phrase_docs()
    docs = frame(spark, texts)
    found = collocations.collocations(docs, top, least, longest, slice_bytes=700)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == mined([(r[2], r[1]) for r in rows_of(texts)], top, least, longest)


def test_collocations_open_only_what_bounds_allow(spark):
    """Common word pairs, whose bound is low, are not grown once better phrases fill a language."""
    rng = random.Random(1)
    good = [f"w{k}a w{k}b" for k in range(20)]
    texts = [f"{rng.choice(good)}. " + " ".join(rng.choice("abcdef") for _ in range(30)) for _ in range(400)]
    grown = []
    count = collocations.count

    def watched(corpus, opened, known, longest, slice_bytes, only=None):
        grown.append(None if opened is None else int(np.bitwise_count(opened).sum()))
        return count(corpus, opened, known, longest, slice_bytes, only)

    collocations.count = watched
    try:
        found = collocations.collocations(frame(spark, texts, ("en",)), 5, 5, 4).collect()
    finally:
        collocations.count = count
    assert sorted(map(tuple, found)) == mined([("en", t) for t in texts], 5, 5, 4)
    assert grown[0] is None and grown[1] == 46 and sum(grown[2:]) <= 30  # of 36 common pairs and their triples none


def test_collocations_drop_what_a_common_word_always_precedes(spark):
    """`red hot chili` always follows `the`, so that the phrase of four words drops it, though `red hot` often stands alone and `the` is too common for a bound."""
    texts = 10 * ["the red hot chili"] + 30 * ["red hot"] + [f"the n{k}" for k in range(300)]
    texts += [t for k in range(8) for t in 10 * [f"g{k}a g{k}b"] + [t for j in range(20 + k) for t in (f"g{k}a x{k}{j}", f"y{k}{j} g{k}b")]]
    found = collocations.collocations(frame(spark, texts, ("en",)), 2, 5, 4).collect()
    assert [r["phrase"] for r in found] == ["red hot", "g0a g0b"]
    assert sorted(map(tuple, found)) == mined([("en", t) for t in texts], 2, 5, 4)


@pytest.mark.parametrize("top", [5, 12])
def test_collocations_equal_brute_force_where_phrases_nest(spark, top):
    """Many small languages, each with phrases inside others and with more phrases than are wanted."""
    rows = []
    for seed in range(40):
        rng = random.Random(seed)
        common, rare = [f"w{k}" for k in range(30)], [f"r{k}" for k in range(10 + seed)]
        fixed = []
        for _ in range(15):
            core = [rng.choice(rare + common[:3]) for _ in range(rng.randrange(2, 5))]
            fixed += [core, [common[min(29, int(rng.expovariate(0.3)))], *core], core[: rng.randrange(1, len(core) + 1)] + [rng.choice(rare)]]
        weights = [rng.random() ** 3 + 0.01 for _ in fixed]
        for _ in range(120):
            parts = [rng.choices(fixed, weights)[0] if rng.random() < 0.6 else rng.choices(common, k=rng.randrange(1, 5)) for _ in range(rng.randrange(1, 6))]
            rows.append((" ".join(" ".join(p) + rng.choice([" .", ""]) for p in parts), f"lang{seed}"))
    found = collocations.collocations(spark.createDataFrame(rows, "text string, lang string").repartition(3), top, 3, 4)
    assert sorted(map(tuple, found.collect())) == mined([(lang, text) for text, lang in rows], top, 3, 4)


def test_collocation_scores_are_exact_beyond_64_bits(spark):
    rows = spark.createDataFrame([(10**13, 10**13 + 7), (9 * 10**12 + 1, 4 * 10**13)], "a long, parts long")
    assert [r[0] for r in rows.select(collocations.score(rows["a"], rows["parts"])).collect()] == [2_000_000 * a // p for a, p in [(10**13, 10**13 + 7), (9 * 10**12 + 1, 4 * 10**13)]]


def test_collocations_of_nothing(spark, empty):
    assert collocations.collocations(empty).count() == 0
    assert collocations.collocations(frame(spark, [None, "", "a b", "a b c"])).count() == 0
    with pytest.raises(ValueError):
        collocations.collocations(empty, longest=5)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", ["op12_resampling", "op13_collocations"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    found = queries.QUERIES[name](spark, DATA)
    wanted = con.execute(f"SELECT {', '.join(found.columns)} FROM ({queries.SQL[name]})").fetchall()
    assert sorted(map(tuple, found.collect()), key=str) == sorted(wanted, key=str)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_byte_bpe_query_equals_the_library(spark, library):
    found = {r["doc_id"]: tuple(r) for r in queries.QUERIES["op11_byte_bpe"](spark, DATA).collect()}
    rows = duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{DATA}/documents.parquet'").fetchall()
    assert len(found) == len(rows)
    for doc_id, text in rows:
        ids = library.encode_ordinary(text)
        assert found[doc_id] == (doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
