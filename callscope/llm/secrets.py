"""Secret scans: known forms, and random-looking strings by two character Markov models.

DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.llm.common import cut, quoted

#: The known forms: kind, pattern, group whose length counts, least length.
KINDS = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),  # runs are maximal, so shorter ones fail either way
)
#: Candidates of the models: runs of these characters, with no full stop at an end.
MARK, INNER = "[A-Za-z0-9+/_=-]", "[A-Za-z0-9+/_=.-]"
#: Labelled as ordinary: whole runs without digits and marks.
ORDINARY = r"(?<![A-Za-z0-9+/_=-])[A-Za-z_]{8,}(?![A-Za-z0-9+/_=-])"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def matches(text: Column, pattern: str, group: int, least: int, kind: int) -> Column:
    """Leftmost non-overlapping matches with their places in code points; short ones are dropped.

    What lies between the matches, and the matches, give the places: their lengths are summed.
    """
    whole, value = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("whole"), value.alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("found"))

    def step(s: Column, x: Column) -> Column:
        at = s.getField("at") + F.length(x.getField("gap"))
        end = at + F.coalesce(F.length(x.getField("whole")), F.lit(0))
        span = F.struct(at.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x.getField("value").alias("value"))
        found = F.when(F.length(x.getField("value")) >= least, F.concat(s.getField("found"), F.array(span)))
        return F.struct(end.alias("at"), F.coalesce(found, s.getField("found")).alias("found"))

    return F.aggregate(parts, start, step, lambda s: s.getField("found"))


def base_spans(text: Column) -> Column:
    """All known forms, by start and then kind."""
    none = F.array().cast(SPAN)
    low = F.lower(text)
    words = [low.contains(w) for w in ("passw", "secret", "token", "apikey", "api_key")]
    hints = (words[0] | words[1] | words[2] | words[3] | words[4], text.contains("AKIA"), text.rlike("[0-9a-f]{32}"))
    found = [F.when(hint, matches(text, p, g, n, k)).otherwise(none) for k, ((_, p, g, n), hint) in enumerate(zip(KINDS, hints, strict=True))]
    return F.array_sort(F.concat(*found))


def _bigrams(values: DataFrame) -> dict[str, int]:
    """Counts of neighbouring characters of ALPHABET in the column value; at most len(ALPHABET)**2."""
    pairs = F.transform(F.sequence(F.lit(1), F.length("value") - 1), lambda i: F.substring(F.col("value"), i, F.lit(2)))
    pairs = values.filter(F.length("value") >= 2).select(F.explode(pairs).alias("pair"))
    pairs = pairs.filter(F.col("pair").rlike(rf"^{INNER}{{2}}\z"))
    return {r["pair"]: r["n"] for r in pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).collect()}


def looks_random(value: Column, kind: Column) -> Column:
    """Whether the value of a known form is an example of a random string.

    Access keys and long hexadecimal runs are. An assigned value is one if it has 16 characters or more, digits and
    letters, and no six small letters in a row: passwords that people make up mostly fail one of these.
    """
    made = (F.length(value) >= 16) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike("[a-z]{6}")
    return (kind > 0) | made


def train(random: DataFrame, ordinary: DataFrame, smoothing: float = 0.5, backoff: float = 8.0) -> list[float]:
    """Log-likelihood ratios of a character after another, random against ordinary, by places in ALPHABET.

    Both frames hold examples in the column value. A character's own frequency, with `smoothing` added to
    each count, counts as `backoff` examples after every character, so that a pair without an example
    is judged by its second character; a class without examples is uniform.
    """
    logs = []
    for found in (_bigrams(random), _bigrams(ordinary)):
        single = {b: sum(found.get(a + b, 0) for a in ALPHABET) + smoothing for b in ALPHABET}
        every = sum(single.values())
        total = {a: sum(found.get(a + b, 0) for b in ALPHABET) + backoff for a in ALPHABET}
        logs.append([math.log((found.get(a + b, 0) + backoff * single[b] / every) / total[a]) for a in ALPHABET for b in ALPHABET])
    return [r - p for r, p in zip(*logs, strict=True)]


def mean_ratio(value: Column, model: list[float]) -> Column:
    """The mean log-likelihood ratio of the characters of value after the first."""
    table = F.array(*[F.lit(x) for x in model])
    place = lambda i: F.instr(F.lit(ALPHABET), F.substring(value, i, F.lit(1)))
    pair = lambda i: ((place(i - 1) - 1) * len(ALPHABET) + place(i)).cast("int")
    total = F.aggregate(F.sequence(F.lit(2), F.length(value)), F.lit(0.0), lambda s, i: s + F.element_at(table, pair(i)))
    return total / (F.length(value) - 1)


def scan_secrets(docs: DataFrame, sample_rows: int = 2000, least_ratio: float = 0.5, least_chars: int = 20, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) of every row: the spans of secrets in its text, by start and then kind.

    spans: array of (start, kind, end, value); places are code points, end exclusive; kinds 0 to 2
    are KINDS, kind 3 is found by the models. A candidate is a run of `least_chars` characters of INNER or more
    that meets no known form; it is a secret if its mean log-likelihood ratio, random against ordinary, is at
    least `least_ratio`. Labelled samples, each distinct value once: the values of known forms in the table
    that looks_random() accepts are random strings; whole runs of eight or more letters or underscores outside the known
    forms are ordinary identifiers, taken from the distinct texts of a sample of about `sample_rows` rows chosen by
    a hash of id and text. labelled: (value, secret), more samples of both classes.

    Null and empty texts have no spans. Rows are scanned one by one, so repeated rows repeat their
    result. Without any known form the random class is uniform. Only the id and text columns are read, so other
    names cannot clash. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    every = max(1, docs.count() // sample_rows)
    rows = docs.select(F.col(quoted(id_col)).alias("id"), text.alias("text"))
    bare = F.col("text")
    for _, pattern, _, _ in KINDS:
        bare = F.regexp_replace(bare, pattern, " ")
    words = F.regexp_extract_all(bare, F.lit(ORDINARY), F.lit(0))
    none = F.array().cast(SPAN)
    long_run = f"{MARK}{INNER}{{{least_chars - 2},}}{MARK}"
    runs = F.when(F.col("text").rlike(long_run), matches(F.col("text"), long_run, 0, least_chars, len(KINDS))).otherwise(none)
    sampled = F.pmod(F.xxhash64("id", "text"), F.lit(every)) == 0
    found = rows.select("id", base_spans(F.col("text")).alias("base"), runs.alias("runs"), F.when(sampled, F.xxhash64("text")).alias("th"), F.when(sampled, words).alias("words"))
    found = cut(found)  # spans only; the texts are read once
    known = found.select(F.explode("base").alias("x")).filter(looks_random(F.col("x.value"), F.col("x.kind")))
    random = known.select("x.value")
    ordinary = found.filter("th IS NOT NULL").dropDuplicates(["th"]).select(F.explode("words").alias("value"))
    if labelled is not None:
        random, ordinary = random.union(labelled.filter("secret").select("value")), ordinary.union(labelled.filter("NOT secret").select("value"))
    model = train(random.distinct(), ordinary.distinct())

    def secret(x: Column) -> Column:
        meets = F.exists("base", lambda b: (b.getField("start") < x.getField("end")) & (x.getField("start") < b.getField("end")))
        return ~meets & (mean_ratio(x.getField("value"), model) >= least_ratio)

    return found.select("id", F.array_sort(F.concat("base", F.filter("runs", secret))).alias("spans"))


def joined_spans(spans: Column) -> Column:
    names = F.array(*[F.lit(k[0]) for k in KINDS], F.lit("model"))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x.getField("kind")), x.getField("start").cast("string"), x.getField("end").cast("string"))), ",")


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_secrets(docs)
    count = lambda k: F.size(F.filter("spans", lambda x: x.getField("kind") == k)).cast("long")
    base = F.filter("spans", lambda x: x.getField("kind") < len(KINDS))
    counts = [count(k).alias(f"n_{name}") for k, (name, *_) in enumerate(KINDS)]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(joined_spans(base), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"))


def secret_forms(spark, sf_dir: str) -> DataFrame:
    """The part of op4_secret_scan that SQL can state: the known forms."""
    return op4_secret_scan(spark, sf_dir).drop("spans")


def _matches_sql(k: int) -> str:
    """SQL: the matches of a known form with the text before each."""
    name, pattern, group, least = KINDS[k]
    quoted_pattern = "'" + pattern.replace("'", "''") + "'"
    of = lambda g: f"regexp_extract_all(t, {quoted_pattern}, {g})"
    return f"SELECT doc_id, {k} AS k, '{name}' AS kind, {least} AS least, unnest({of(0)}) AS whole, unnest({of(group)}) AS value, unnest(regexp_split_to_array(t, {quoted_pattern})[1:len({of(0)})]) AS gap, generate_subscripts({of(0)}, 1) AS nth FROM d"


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(_matches_sql(k) for k in range(len(KINDS)))}),
placed AS (SELECT *, sum(length(gap) + length(whole)) OVER (PARTITION BY doc_id, k ORDER BY nth) AS stop FROM m),
good AS (SELECT doc_id, k, kind, (stop - length(whole))::BIGINT AS start, stop::BIGINT AS stop FROM placed WHERE length(value) >= least)
SELECT d.doc_id, {", ".join(f"count(*) FILTER (k = {k})::BIGINT AS n_{KINDS[k][0]}" for k in range(len(KINDS)))},
  sha256(coalesce(string_agg(concat(kind, ':', start, ':', stop), ',' ORDER BY start, k) FILTER (k IS NOT NULL), '')) AS base_sha256
FROM d LEFT JOIN good ON good.doc_id = d.doc_id GROUP BY d.doc_id
"""
