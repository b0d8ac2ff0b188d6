"""A training corpus from raw documents: language identification, near-duplicate, substring and benchmark removal, packing.

Each stage takes all documents that the one before kept, and is written as Parquet and read again. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import common as C
from tallyweave.llm.decontaminate import find_benchmark_text
from tallyweave.llm.language_id import UNDETERMINED, identify_languages
from tallyweave.llm.packing import pack_documents
from tallyweave.llm.simhash import keep_one_of_each_group
from tallyweave.llm.suffix_dedup import remove_repeated_strings

#: Texts of some KB that go from Spark to Python at a time: the default, 10,000, makes batches of tens of MB that executors keep room for.
BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1_000
#: Least posterior probability of a language.
CERTAIN = 0.5
#: Least Jaccard similarity of near duplicates.
SIMILAR = 0.8


def _small_batches(spark: SparkSession) -> None:
    if int(spark.conf.get(BATCH_SETTING)) > BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))


def _columns(docs: DataFrame, *but: str) -> tuple[str, ...]:
    return tuple(c for c in docs.columns if c not in but)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; those without a letter, null texts included, or without a likely language, go.

    Rows are judged one by one, so repeated rows stay or go alike; no documents give none.
    """
    _small_batches(spark)
    columns = [F.col(f"`{c}`").alias(f"keep_{i}") for i, c in enumerate(docs.columns)]
    judged = identify_languages(docs, C.fold("doc_id", 4) != 2, *columns)
    kept = judged.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= CERTAIN))
    return kept.select(*(F.col(f"keep_{i}").alias(c) for i, c in enumerate(docs.columns)))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: fingerprints within 4 bits, or five-word shingles of similarity SIMILAR.

    The smallest doc_id stays, a row without an id only if none has one; of rows equal in id and text one stays. Null texts and texts without
    words are one group.
    """
    _small_batches(spark)
    return keep_one_of_each_group(docs, width=5, distance=4, similarity=SIMILAR)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 100 bytes that begin earlier in the corpus; documents of which nothing is left go.

    Earlier is a smaller doc_id; rows that share one follow their texts, rows without one come last. A null text is left as an empty one.
    """
    _small_batches(spark)
    rest = _columns(docs, "doc_id", "text", "n_chars")
    kept = remove_repeated_strings(docs, window=100, keep=rest).where((F.col("n_removed") == 0) | F.col("kept_text").rlike(r"\S"))
    made = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return kept.select(*(made.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark text; a null text has none. Rows are judged one by one."""
    _small_batches(spark)
    rest = [f"kept_{i}" for i in range(len(docs.columns))]
    wide = docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(k) for c, k in zip(_columns(docs), rest, strict=True)))
    clean = find_benchmark_text(wide, C.table(spark, sf_dir, "benchmark"), width=10, keep=tuple(rest)).where("n_hit = 0")
    return clean.select(*(F.col(k).alias(c) for c, k in zip(docs.columns, rest, strict=True)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences; a null text is the end token alone, and rows that share a doc_id or have none are documents of their own."""
    _small_batches(spark)
    return pack_documents(docs, "word_bpe_49k.json", max_tokens=2048, end_id=1)


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substrings", substring_stage),
    ("benchmark", benchmark_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the models nor the tokenizer; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = C.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
