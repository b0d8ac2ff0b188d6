"""Invoice documents as text: a folder of text files, or a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_document_folder(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """``(doc_name, text)``: one row per file, whole text, however long."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", glob).text(path)
    name = F.regexp_extract("_metadata.file_path", r"([^/]+)$", 1)
    return files.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("doc_name"), F.col("value").alias("text"))


def read_document_table(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """``(doc_id, text)`` of a Parquet table; no other column is read."""
    return spark.read.parquet(path).select(F.col(key).alias("doc_id"), "text")
