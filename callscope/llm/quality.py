"""Quality rules: line-first cleaning, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.llm.common import packed, quoted, unpacked, words_of

SYMBOLS = "[#*$%&|<>]"
#: Phrases of page furniture in English, French, German and Spanish, matched in lines of at most BOILERPLATE_WORDS words.
BOILERPLATE = (
    r"(?i)(?:^|[^A-Za-z])(?:"
    r"all rights reserved|cookie policy|privacy policy|terms of (?:use|service)|enable javascript|lorem ipsum|click here|sign up|subscribe (?:now|to)|skip to (?:main )?content|back to top|share (?:this|on)"
    r"|tous droits r[éÉ]serv[éÉ]s|politique de confidentialit[éÉ]|conditions d.utilisation|mentions l[éÉ]gales|cliquez ici|retour en haut|partager sur|accepter les cookies"
    r"|alle rechte vorbehalten|datenschutzerkl[äÄ]rung|nutzungsbedingungen|impressum|hier klicken|zum seitenanfang|cookie-richtlinie|jetzt abonnieren"
    r"|todos los derechos reservados|pol[íÍ]tica de (?:privacidad|cookies)|t[éÉ]rminos y condiciones|aviso legal|haga clic|volver arriba|compartir en|suscr[íÍ]bete"
    r")"
)
BOILERPLATE_WORDS = 20


def window_hashes(words: Column, shingle: int = 5) -> Column:
    """The 64-bit hashes of a text's windows of `shingle` words, in order."""
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (shingle - 1)), lambda i: F.xxhash64(F.slice(words, i, shingle)))
    return F.when(F.size(words) >= shingle, hashes).otherwise(F.array().cast("array<bigint>"))


def _with_repeats(df: DataFrame, shingle: int = 5) -> DataFrame:
    """Adds _n_repeat: the word places that some window of `shingle` words found twice or more covers.

    Windows are compared by a 64-bit hash. Only texts with an equal pair of windows sort their
    windows: equal neighbours give the places, and sorted places the covered length.
    """
    df = df.withColumn("_hashes", window_hashes(F.col("_words"), shingle))
    placed = F.array_sort(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_placed", F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), placed))
    p = F.col("_placed")

    def twice(x: Column, k: Column) -> Column:
        before = F.when(k > 0, F.get(p, k - 1).getField("h") == x.getField("h")).otherwise(False)
        return before | F.coalesce(F.get(p, k + 1).getField("h") == x.getField("h"), F.lit(False))

    df = df.withColumn("_at", F.sort_array(F.transform(F.filter("_placed", twice), lambda x: x.getField("i"))))
    at, n = F.col("_at"), F.size("_at")
    gaps = F.zip_with(F.slice(at, F.lit(1), n - 1), F.slice(at, F.lit(2), n - 1), lambda a, b: F.least(b - a, F.lit(shingle)))
    covered = F.aggregate(gaps, F.lit(shingle), lambda s, g: s + g)
    return df.withColumn("_n_repeat", F.when(p.isNull(), 0).otherwise(covered)).drop("_hashes", "_placed", "_at")


def failing_line(line: Column) -> Column:
    """Whether a line with a word fails a rule.

    Navigation: two or more separators (| » › >) between items, or one at the line's end.
    Symbols: at least one of `#*$%&|<>` for every four words.
    Punctuation: no mark of a sentence at all in a line of five words or more, or one run of
    `!` or `?` for every five words. Boilerplate: a short line with a phrase of page furniture.
    """
    # Each part tests what few lines have first, so that words are counted in these only.
    n_words = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))
    more_than = lambda n: line.rlike(rf"^[\x20\x09-\x0D]*(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+){{{n}}}[^\x20\x09-\x0D]")
    navigation = line.rlike(r"(?:[|»›>][^|»›>]*){2}|[|»›>][\x20\x09-\x0D]*\z")
    symbols = line.rlike(SYMBOLS) & (4 * F.length(F.regexp_replace(line, "[^#*$%&|<>]+", "")) >= n_words)
    bare = ~line.rlike(r"[.!?:;…。！？]") & more_than(4)
    shouting = line.rlike(r"[!?]{2}") & (5 * F.regexp_count(line, F.lit(r"[!?]{2,}")) >= n_words)
    return navigation | symbols | bare | shouting | (~more_than(BOILERPLATE_WORDS) & line.rlike(BOILERPLATE))


def quality_rules(docs: DataFrame, max_lost: float = 0.5, text_col: str = "text") -> DataFrame:
    """docs with quality columns: word counts, base and verdict, and the cleaned text.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_chars (long),
    base_failed, kept (boolean) and clean_text (string). A word is `[^\\x20\\x09-\\x0D]+`.
    Lines are those that \\n parts. Each line with a word that fails failing_line() is removed;
    clean_text has the others. A document is kept if it passes the base rules (10 words or more,
    and at most 20 % of its words in 5-word windows found twice or more) and loses at most
    `max_lost` of its word characters with the removed lines.

    Null and blank texts have no words: base_failed, not kept; clean_text of null is ''. Rows are
    judged one by one, so ties and repeated rows do not matter. Other columns pass through; docs'
    own columns of these names are replaced.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars", "base_failed", "kept", "clean_text"]
    keep = [c for c in docs.columns if c not in made]
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    df = docs.select(packed(docs).alias("_row"), text.alias("_text"), words_of(text).alias("_words"), F.split(text, "\n", -1).alias("_lines"))
    df = _with_repeats(df)
    n_words = F.size("_words").cast("long")
    df = df.withColumn("_n", n_words).withColumn("_chars", F.length(F.array_join("_words", "")).cast("long")).drop("_words")
    df = df.withColumn("_full", F.filter("_lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("_left", F.filter("_lines", lambda x: ~F.coalesce(failing_line(x) & x.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))))
    left_chars = F.length(F.regexp_replace(F.array_join("_left", ""), r"[\x20\x09-\x0D]+", ""))
    df = df.withColumn("_lost", F.when(F.size("_left") == F.size("_lines"), F.lit(0)).otherwise(F.col("_chars") - left_chars).cast("long"))
    n_repeat = F.col("_n_repeat").cast("long")
    failed = (F.col("_n") < 10) | (100 * n_repeat > 20 * F.col("_n"))
    values = {
        "n_words": F.col("_n"),
        "word_chars": F.col("_chars"),
        "n_symbols": F.length(F.regexp_replace("_text", "[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long"),
        "n_repeat_words": n_repeat,
        "lost_chars": F.col("_lost"),
        "base_failed": failed,
        "kept": ~failed & (F.col("_lost") <= max_lost * F.col("_chars")),
        "clean_text": F.array_join("_left", "\n"),
    }
    # One row in an array: filters on the verdict stay above it, so that no rule is evaluated twice.
    df = df.select("_row", F.inline(F.array(F.struct(*[v.alias(c) for c, v in values.items()]))))
    return unpacked(df, [*keep, *made], changed={c: F.col(c) for c in made})


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = quality_rules(docs)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")


#: The same counts in SQL, and the same line rules.
SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM docs WHERE len(words) >= 5)),
twice AS (
  SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS c FROM windows) WHERE c >= 2),
repeats AS (
  SELECT doc_id, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS n FROM twice GROUP BY doc_id),
lines AS (
  SELECT doc_id, unnest(lines) AS line FROM docs),
judged AS (
  SELECT doc_id, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM lines),
lost AS (
  SELECT doc_id, sum(chars)::BIGINT AS n FROM judged WHERE
    regexp_matches(line, '(?:[|»›>][^|»›>]*){2}|[|»›>][\x20\x09-\x0D]*\z')
    OR (regexp_matches(line, '[#*$%&|<>]') AND 4 * length(regexp_replace(line, '[^#*$%&|<>]+', '', 'g')) >= n)
    OR (n >= 5 AND NOT regexp_matches(line, '[.!?:;…。！？]'))
    OR (regexp_matches(line, '[!?]{2}') AND 5 * len(regexp_extract_all(line, '[!?]{2,}')) >= n)
    OR (n <= 20 AND regexp_matches(line, '@boilerplate@'))
  GROUP BY doc_id),
counted AS (
  SELECT d.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(l.n, 0)::BIGINT AS lost_chars
  FROM docs d LEFT JOIN repeats r USING (doc_id) LEFT JOIN lost l USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 2 * lost_chars <= word_chars AS kept
FROM counted
""".replace("@boilerplate@", BOILERPLATE)
