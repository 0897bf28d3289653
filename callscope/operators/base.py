"""Checkpoints and stored tables for jobs that loop."""

from __future__ import annotations

import re
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of this session.

    It is that of spark.checkpoint.dir; where it is not set, a local master gets a new one, as in tests, and a
    cluster an error, as no folder of one machine can be shared.
    """
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """df from a checkpoint in the folder that all executors share, so that lineage does not grow.

    With eager=False it is written by the first action on it, which saves a job where a loop looks at each step anyway.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager)


#: Takes a statement's shuffle files away at its end, else they stay until the driver happens to collect its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@dataclass(frozen=True)
class Stored:
    """A table that was written once, and its folder."""

    rows: DataFrame
    path: str

    def drop(self) -> None:
        """Deletes the files, when nothing reads them any more."""
        spark = self.rows.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def store(df: DataFrame) -> Stored:
    """df, written to the folder that all executors share and read back.

    Like cut(), with files of columns, which take a fifth of the disk, and with sizes that Spark's choice of joins sees. The shuffles
    of the writing are gone at its end, and the files when the application ends.
    """
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLES_GO, "false")
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLES_GO, before)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(where)
    return Stored(spark.read.schema(df.schema).parquet(path), path)


def stored(df: DataFrame) -> DataFrame:
    """The rows of store(), which stay as long as the application."""
    return store(df).rows


def spread_join(left: DataFrame, right: DataFrame, key: list[str], value: str, parts: int = 16) -> DataFrame:
    """Rows of left with each `value` that right has for their key, where few keys have many rows on both sides.

    The values of a key are arrays in `parts` parts, dealt out by key and part, each part beside all rows of left of the key, and to as many
    partitions as there are for shuffles: the inputs are small beside what comes out of them, so that Spark would join them in few tasks.
    """
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.hash(value), F.lit(parts)).alias("_part")
    held = right.groupBy(*key, part).agg(F.collect_list(value).alias("_values")).repartition(n, *key, "_part")
    dealt = left.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(n, *key, "_part")
    return dealt.join(held, [*key, "_part"]).withColumn(value, F.explode("_values")).drop("_part", "_values")
