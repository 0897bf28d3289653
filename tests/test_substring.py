"""The substring index equals contains(), and reads the postings of a term only."""

import random

import pytest
from pyspark.sql import functions as F

from callscope.operators import substring


@pytest.fixture(scope="module")
def names():
    rng = random.Random(4)
    parts = ["get", "Set", "Order", "name", "é", "ß", "_", "$", "a", "Ab", "<init>", "日本", " ", "\\", "%"]
    rows = [(k * rng.choice([1, 1, 1, 5000]), "".join(rng.choice(parts) for _ in range(rng.randrange(0, 9)))) for k in range(400)]
    return [*rows, (-7, "negativeId"), (-5000, "getfar"), (3, None), (None, "nobody"), (12, "secondText"), (12, "otherText")]


@pytest.fixture(scope="module")
def index(spark, names, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("substrings") / "i")
    substring.write_index(spark.createDataFrame(names, "id long, text string").repartition(3), path, folders=16)
    return path


def test_terms_of_all_lengths(spark, names, index):
    rng = random.Random(5)
    terms = ["", "g", "ge", "GET", "étß", "zzz", "get", "negativeid", "secondtextother", "<init>", "$", "\\", "%", "日本", "getsetordernamegetsetordername"]
    for n in (1, 2, 3, 4, 5, 8, 13, 30):
        text = rng.choice([t for _, t in names if t and len(t) >= n] or ["x" * n])
        at = rng.randrange(len(text) - n + 1)
        terms.append(text[at : at + n])
    for term in terms:
        found = sorted(r[0] for r in substring.find(spark, index, term).collect())
        assert found == sorted({k for k, t in names if k is not None and t is not None and term.lower() in t.lower()}), term


def test_only_the_postings_of_a_term_are_read(spark, index):
    whole = spark.read.parquet(f"{index}/postings")
    rows, n = substring.postings(spark, index, "ordername")
    assert n == 7 and rows.select("gram").distinct().count() <= 7
    folders = {f for f in (r[0].split("folder=")[1].split("/")[0] for r in rows.select(F.input_file_name()).distinct().collect())}
    assert len(folders) <= 7 and rows.count() * 10 < whole.count()


def test_empty_index(spark, tmp_path):
    substring.write_index(spark.createDataFrame([], "id long, text string"), str(tmp_path / "i"))
    assert all(substring.find(spark, str(tmp_path / "i"), t).count() == 0 for t in ("", "a", "abc", "abcd"))
