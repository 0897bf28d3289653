"""The pipeline on a small table, stage by stage."""

from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_operators import classes, hard_texts, shingle_set

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    rows = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(hard_texts())]
    docs = spark.createDataFrame(rows, COLUMNS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, str(tmp_path))
        seen[name] = kept.collect()
        kept = spark.createDataFrame(seen[name], kept.schema)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "mixing", "bpe"]
    assert all(set(seen[n][0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars"} for n, _ in corpus_pipeline.STAGES[:-1])
    assert 0 < len(seen["quality"]) < len(rows) and len(seen["line_dedup"]) == len(seen["quality"])
    wanted = classes([(r["doc_id"], shingle_set(r["text"])) for r in seen["line_dedup"]])
    assert sorted(r["doc_id"] for r in seen["near_duplicates"]) == sorted({c for _, c, _ in wanted})
    times = Counter(r["doc_id"] for r in seen["mixing"])
    assert max(times.values()) == 2 and set(times) <= {r["doc_id"] for r in seen["near_duplicates"]}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text_of = {r["doc_id"]: r["text"] for r in seen["mixing"]}
    assert len(seen["bpe"]) == len(seen["mixing"])
    assert all(r["ids"] == library.encode(text_of[r["doc_id"]], add_special_tokens=False).ids for r in seen["bpe"])
    whole = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", F.md5(F.array_join("ids", " ")).alias("h"))
    parts = [(r["doc_id"], tuple(r["ids"])) for r in seen["bpe"]]
    assert whole.count() == len(parts) and whole.distinct().count() == len(set(parts))


def test_run_goes_on_after_its_last_stage(spark, tmp_path, monkeypatch):
    """Lost in the third stage; the second run starts there, gives the whole result and leaves one table, which clean() deletes."""
    import os

    rows = [(k, f"This is document {k} of the run, and it has some more words than ten in it.", "en", "s", 70) for k in range(20)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    wanted = sorted(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    stages, began, broken = corpus_pipeline.STAGES, [], [True]

    def watched(name, stage):
        def f(spark, docs, sf_dir):
            began.append(name)
            if name == "near_duplicates" and broken[0]:
                raise RuntimeError("lost")
            return stage(spark, docs, sf_dir)

        return name, f

    monkeypatch.setattr(corpus_pipeline, "STAGES", [watched(*s) for s in stages])
    try:
        corpus_pipeline.run(spark, str(tmp_path), "again")
    except RuntimeError:
        broken[0] = False
    found = sorted(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path), "again").collect())
    assert found == wanted and began == ["quality", "line_dedup", "near_duplicates", "near_duplicates", "mixing", "bpe"]
    folder = corpus_pipeline.tables(spark, "again").removeprefix("file:")
    assert os.listdir(folder) == ["3-mixing"]
    corpus_pipeline.clean(spark, "again")
    assert not os.path.exists(folder)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def written(spark, path, n, word):
    rows = [(k, f"This is the {word} document {k} of a run, and it has some more words than ten in it.", "en", "s", 70) for k in range(n)]
    spark.createDataFrame(rows, COLUMNS).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return str(path)


def test_run_id_over_other_input_or_code_starts_anew(spark, tmp_path, monkeypatch):
    one, two = written(spark, tmp_path / "one", 12, "small"), written(spark, tmp_path / "two", 30, "large")
    ids = lambda at: sorted({r["doc_id"] for r in corpus_pipeline.run(spark, at, "twice").collect()})
    assert ids(one)[-1] < 12 and ids(two)[-1] >= 12 and ids(one)[-1] < 12
    began, stage = [], corpus_pipeline.STAGES[0][1]
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("quality", lambda *a: began.append(1) or stage(*a)), *corpus_pipeline.STAGES[1:]])
    ids(one)
    assert not began  # the same input and code: only the last stage
    written(spark, tmp_path / "one", 13, "small")  # the same place, other files
    ids(one)
    assert len(began) == 1
    monkeypatch.setattr(corpus_pipeline, "code_fingerprint", lambda: "changed")
    ids(one)
    assert len(began) == 2
    corpus_pipeline.clean(spark, "twice")


def test_run_without_an_id_leaves_no_table_behind(spark, tmp_path, monkeypatch):
    """The folder is handed over for deletion at the application's end, before anything is written to it."""
    folders = []
    keep = corpus_pipeline.delete_at_end
    monkeypatch.setattr(corpus_pipeline, "delete_at_end", lambda spark, path: folders.append(path) or keep(spark, path))
    corpus_pipeline.run(spark, written(spark, tmp_path, 12, "only"))
    where = spark._jvm.org.apache.hadoop.fs.Path(folders[0])
    system = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    assert system.exists(where) and system.cancelDeleteOnExit(where)
    corpus_pipeline.delete(spark, folders[0])
