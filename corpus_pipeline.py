"""The corpus pipeline: five operators, each working on all that the one before it kept."""

from __future__ import annotations

import hashlib
import json
import uuid
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.llm.bpe import encode_documents
from callscope.llm.common import delete, delete_at_end, files_fingerprint, get_text, is_written, put_text, table_folder
from callscope.llm.line_dedup import dedup_lines
from callscope.llm.mixing import mix_sources
from callscope.llm.near_duplicates import deduplicate
from callscope.llm.quality import quality_rules

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_text(docs: DataFrame, text) -> DataFrame:
    """The columns of documents with another text, and its length."""
    return docs.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, with their failing lines removed."""
    return _with_text(quality_rules(docs).filter("kept"), F.col("clean_text"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that three or more share."""
    return _with_text(dedup_lines(docs), F.col("text"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return deduplicate(docs).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its source's target takes it."""
    mixed = mix_sources(docs, carry=True).filter("times > 0")
    return mixed.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select(*COLUMNS)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, and digests of what they decode to."""
    found = encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return found.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"), F.sha2("plain", 256).alias("plain_sha256"))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mixing", mixing), ("bpe", bpe)]

#: SQL cannot state the near-duplicate, sampling and encoding stages; tests hold them against brute force.
ORACLE_SQL = None


def tables(spark: SparkSession, run_id: str) -> str:
    """The folder of a run's tables."""
    return f"{table_folder(spark)}/pipeline-{run_id}"


def code_fingerprint() -> str:
    """A digest of this file, of the operators that the stages call, and of the tokenizer file."""
    own = Path(__file__)
    parts = [own, *sorted((own.parent / "callscope/llm").glob("*.py")), Path(public_tokenizers.path("word_bpe_49k.json"))]
    return hashlib.sha256(b"".join(hashlib.sha256(p.read_bytes()).digest() for p in parts)).hexdigest()


def run(spark: SparkSession, sf_dir: str, run_id: str | None = None) -> DataFrame:
    """The stages applied to documents, each written as a table that the next one reads.

    run_id names the tables; a run that was lost and starts again with the same id goes on after its last written
    stage, if that was made from the same input files by the same code and stages; else it starts anew. A stage's table is deleted
    when the next one is written; clean() deletes the last, which the result reads. Without an id the tables are deleted when the application ends.
    Null ids and texts, repeated rows and an empty table go through every stage as its operator states.
    """
    folder, documents = tables(spark, run_id or uuid.uuid4().hex), f"{sf_dir}/documents.parquet"
    if run_id is None:
        delete_at_end(spark, folder)
    paths = [f"{folder}/{k}-{name}" for k, (name, _) in enumerate(STAGES[:-1])]
    made_of = [files_fingerprint(spark, documents), code_fingerprint()]
    marks = [json.dumps([*made_of, [name for name, _ in STAGES[: k + 1]]]) for k in range(len(paths))]
    done = max((k + 1 for k, path in enumerate(paths) if is_written(spark, path) and get_text(spark, f"{path}/_made_of") == marks[k]), default=0)
    for k in range(done, len(paths)):
        docs = spark.read.parquet(paths[k - 1] if k else documents)
        STAGES[k][1](spark, docs, sf_dir).write.mode("overwrite").parquet(paths[k])
        put_text(spark, f"{paths[k]}/_made_of", marks[k])
        if k:
            delete(spark, paths[k - 1])
    for path in paths[:-1]:  # of a lost run, or of one with other input
        delete(spark, path)
    return STAGES[-1][1](spark, spark.read.parquet(paths[-1]), sf_dir)


def clean(spark: SparkSession, run_id: str) -> None:
    """Deletes what is left of a run's tables."""
    delete(spark, tables(spark, run_id))
