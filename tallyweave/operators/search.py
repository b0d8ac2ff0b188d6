"""Search for parts of texts through a stored index of runs of three characters.

A text that holds the asked part holds all its runs. The index has a row for each run and key, written in buckets of runs and sorted by
run, so a search reads the postings of the asked runs only, however large the table is; the keys that have all of them are few, and their
rows are tested as they stand. Parts of less than three characters have no run, and the table is scanned for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions.strings import any_of

GRAM = 3
BUCKETS = 64


def grams(text: Column) -> Column:
    """Distinct runs of a text in lower case."""
    lower = F.lower(text)
    starts = F.sequence(F.lit(1), F.length(lower) - (GRAM - 1))
    return F.when(F.length(lower) >= GRAM, F.array_distinct(F.transform(starts, lambda i: F.substr(lower, i, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.crc32(gram), F.lit(BUCKETS)).cast("int")


class SearchIndex:
    """An index stored at ``path``; tables are searched by the fields that they were indexed by."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, rows: DataFrame, key: str, fields: list[Column]) -> None:
        """Index rows by the runs of their fields. More rows can be added by another call; a key that is indexed again is found once."""
        runs = F.array_distinct(F.flatten(F.array(*[F.coalesce(grams(f), F.array().cast("array<string>")) for f in fields])))
        postings = rows.select(F.explode(runs).alias("gram"), F.col(key).alias("key")).withColumn("bucket", _bucket(F.col("gram")))
        # A run that very many rows have is dealt to several files of its bucket by their keys.
        placed = postings.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(4))).sortWithinPartitions("bucket", "gram")
        placed.write.mode("append").partitionBy("bucket").parquet(self.path)

    def keys(self, text: str) -> DataFrame:
        """(key) of the rows that have all runs of the text."""
        wanted = sorted({text[i : i + GRAM] for i in range(len(text) - GRAM + 1)})
        asked = self.spark.createDataFrame([(g,) for g in wanted], "gram string").select("gram", _bucket(F.col("gram")).alias("bucket"))
        # The runs of one text: as many as it has characters at most.
        buckets = [r["bucket"] for r in asked.select("bucket").distinct().collect()]
        postings = self.spark.read.parquet(self.path).filter(F.col("bucket").isin(buckets) & F.col("gram").isin(wanted))
        return postings.groupBy("key").agg(F.countDistinct("gram").alias("n")).filter(F.col("n") == len(wanted)).select("key")

    def find(self, rows: DataFrame, key: str, fields: list[Column], text: str) -> DataFrame:
        """Rows of which a field contains the text, in any case; all rows for a blank one."""
        wanted = text.strip().lower()
        if not wanted:
            return rows
        holds = any_of([F.coalesce(F.contains(F.lower(f), F.lit(wanted)), F.lit(False)) for f in fields])
        if len(wanted) < GRAM:
            return rows.filter(holds)
        return rows.join(self.keys(wanted).withColumnRenamed("key", key), key, "left_semi").filter(holds)
