"""What the training-data operators share: word rules, row packing, checkpoints, prefix sums."""

from __future__ import annotations

import hashlib
import re
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The six ASCII white-space characters that part words.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words_of(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text, in order; null and blank texts have none."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, SPACE_RUN, -1)).otherwise(F.array().cast("array<string>"))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def packed(docs: DataFrame) -> Column:
    """All columns of docs as one struct, so that no name of theirs meets a working column."""
    return F.struct(*[F.col(quoted(c)) for c in docs.columns])


def unpacked(df: DataFrame, columns: Sequence[str], row: str = "_row", changed: dict[str, Column] | None = None) -> DataFrame:
    """The packed columns again, with some of them replaced."""
    changed = changed or {}
    return df.select(*[changed.get(c, F.col(f"{row}.{quoted(c)}")).alias(c) for c in columns])


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: the one of spark.checkpoint.dir, or a new one where none is set on a local master, as in tests.

    On a cluster without that setting it raises, as no folder of one machine can be shared.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df from a checkpoint: computed once, kept in the folder that all executors share."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def table_folder(spark: SparkSession) -> str:
    """Where a run keeps its tables: spark.checkpoint.dir itself, which a later application finds again, or the session's own folder."""
    return spark.conf.get("spark.checkpoint.dir", None) or shared_folder(spark)


def _located(spark: SparkSession, path: str):
    """A path and its file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end."""
    system, where = _located(spark, f"{path}/_SUCCESS")
    return system.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    system, where = _located(spark, path)
    system.delete(where, True)


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Makes a folder that is deleted when the application ends, unless its driver is killed."""
    system, where = _located(spark, path)
    system.mkdirs(where)
    if not system.deleteOnExit(where):
        raise OSError(f"{path} could not be made")


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file."""
    system, where = _located(spark, path)
    stream = system.create(where, True)
    stream.write(bytearray(text.encode()))
    stream.close()


def get_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None if it is not there."""
    system, where = _located(spark, path)
    if not system.exists(where):
        return None
    stream = system.open(where)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def folder_files(spark: SparkSession, path: str) -> list[str]:
    """The files of a folder, by their full names."""
    system, where = _located(spark, path)
    return sorted(f.getPath().toString() for f in system.listStatus(where) if f.isFile())


def files_fingerprint(spark: SparkSession, path: str) -> str:
    """A digest of the names, sizes and times of all files below a path."""
    system, where = _located(spark, path)
    found, files = [], system.listFiles(where, True)
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath().toString()}:{f.getLen()}:{f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


def bucket_count(rows: int, per_bucket: int = 2000, least: int = 64) -> int:
    """Buckets for rows of a table, so that even a bucket of one hot key stays small."""
    return max(least, -(-rows // per_bucket))


def running_total(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[Column], value: str, out: str) -> DataFrame:
    """Adds to each row the sum of `value` over the rows of its key before it.

    Rows stand in the order (bucket, *order) within a key; bucket is a whole number, null keys are keys. No key is gathered in one
    task: totals by (key, bucket) are summed first, then each bucket on its own. The totals are summed in two levels as
    well: those of a block of 1024 buckets, and the blocks' own totals, which are a thousandth of a thousandth of a key's rows or fewer.
    """
    cells = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_cell")).withColumn("_block", F.floor(F.col(bucket) / 1024))
    blocks = cells.groupBy(*keys, "_block").agg(F.sum("_cell").alias("_whole"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*[F.col(k).alias(f"_b_{k}") for k in keys], F.col("_block").alias("_b"), F.coalesce(F.sum("_whole").over(before), F.lit(0)).alias("_blocks"))
    inside = Window.partitionBy(*keys, "_block").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_in", F.coalesce(F.sum("_cell").over(inside), F.lit(0)))
    same = F.col("_block") == F.col("_b")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_b_{k}"))
    cells = cells.join(blocks, same)
    cells = cells.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(bucket).alias("_bucket"), (F.col("_blocks") + F.col("_in")).alias("_before"))
    same = F.col(bucket) == F.col("_bucket")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(cells, same)
    return joined.withColumn(out, F.col("_before") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_bucket", "_before", *[f"_k_{k}" for k in keys])
