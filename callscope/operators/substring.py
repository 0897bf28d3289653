"""An index of the substrings of names: which names hold a term is answered from the postings of the term's letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Letters of a gram; a chunk of a posting list has 2^12 ids.
GRAM, BITS = 3, 12


def grams(text: Column, n: int = GRAM) -> Column:
    """The distinct runs of n letters of a text."""
    size = F.length(text)
    runs = F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(text, i, n))
    return F.when(size >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def folder_of(gram: Column, folders: int) -> Column:
    return F.pmod(F.hash(gram), F.lit(folders))


def write_index(names: DataFrame, path: str, folders: int = 64) -> None:
    """Stores names (id bigint, text) and their postings, for find().

    A posting is (gram, chunk, places): the places of the ids of a chunk of 4096 that hold the gram, in order, as small numbers, so that no list
    grows with the table. Grams of one, two and three letters are kept, in lower case, in folders by gram; names are in
    folders by chunk group. Null texts hold nothing; several texts of an id are all searched. An empty table gives an empty index.
    """
    spark = names.sparkSession
    rows = names.select(F.col("id").cast("bigint").alias("id"), F.lower("text").alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    chunk = F.shiftright("id", BITS)
    every = F.concat(*[grams(F.col("text"), n) for n in range(1, GRAM + 1)])
    posted = rows.select(F.explode(every).alias("gram"), chunk.alias("chunk"), F.col("id").bitwiseAND(F.lit((1 << BITS) - 1)).cast("smallint").alias("place"))
    posted = posted.groupBy("gram", "chunk").agg(F.array_sort(F.collect_set("place")).alias("places"))
    posted.withColumn("folder", folder_of(F.col("gram"), folders)).repartition("folder", "chunk").write.mode("overwrite").partitionBy("folder").parquet(f"{path}/postings")
    rows.withColumn("chunk", chunk).repartitionByRange("chunk", "id").sortWithinPartitions("chunk", "id").write.mode("overwrite").parquet(f"{path}/names")
    spark.createDataFrame([(folders,)], "folders int").coalesce(1).write.mode("overwrite").json(f"{path}/about")


def postings(spark: SparkSession, path: str, term: str) -> tuple[DataFrame, int]:
    """The postings of a term's grams, from their folders only, and how many grams it has."""
    folders = spark.read.schema("folders int").json(f"{path}/about").first()[0]
    n = min(GRAM, len(term))
    wanted = sorted({term[i : i + n] for i in range(len(term) - n + 1)})
    where = [r[0] for r in spark.createDataFrame([(g,) for g in wanted], "g string").select(folder_of(F.col("g"), folders)).distinct().collect()]
    rows = spark.read.schema("gram string, chunk bigint, places array<smallint>, folder int").parquet(f"{path}/postings")
    return rows.filter(F.col("folder").isin(where) & F.col("gram").isin(wanted)), len(wanted)


def find(spark: SparkSession, path: str, term: str) -> DataFrame:
    """(id) of the names that hold a term, whatever its case; an empty term is in all.

    The posting lists of the term's grams are intersected chunk by chunk; what is left is read and tested with the term itself, unless the term is one gram.
    """
    term = term.lower()
    names = spark.read.schema("id bigint, text string, chunk bigint").parquet(f"{path}/names")
    if not term:
        return names.select("id").distinct()
    rows, n = postings(spark, path, term)
    same = F.aggregate(F.slice("lists", F.lit(2), F.greatest(F.size("lists") - 1, F.lit(0))), F.element_at("lists", 1), F.array_intersect)
    left = rows.groupBy("chunk").agg(F.collect_list("places").alias("lists")).filter(F.size("lists") == n)  # a chunk has one list for each gram
    ids = left.select("chunk", F.explode(same).alias("place")).select("chunk", F.shiftleft("chunk", BITS).bitwiseOR(F.col("place").cast("bigint")).alias("id"))
    if len(term) <= GRAM:
        return ids.select("id")
    return names.join(ids, ["chunk", "id"], "left_semi").filter(F.contains("text", F.lit(term))).select("id").distinct()
