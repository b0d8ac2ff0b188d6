"""Importance resampling towards a target corpus: hashed bags of word runs, and the highest perturbed weights drawn.

A document's features are its runs of 1 to ``max_words`` words, each hashed to a bucket. A bucket's gain is the logarithm of its share
of the target over its share of the source, in whole thousandths; a document's weight is the sum of its features' gains. With Gumbel noise
added, the highest scores are a sample without replacement in proportion to the weights.

The texts of a batch are joined with a separator that no word holds, and one pass of a pattern finds all words. A binary search of their
places in the documents' offsets says whose they are, which masks the runs that would cross from one document to the next before buckets
are counted. Long batches go on in steps of ``STEP`` words that overlap by a run, so a text of any length keeps little besides itself.
Counts of buckets are summed in each task and then across tasks: a vector of ``buckets`` numbers is all that reaches the driver or a task.

A null text has no words, a null doc_id the empty text as its id. Repeated rows are each scored, counted and drawn for themselves, and
rows with equal scores are drawn by doc_id, a null one last, then by weight and number of features. An empty table draws nothing; an empty
target leaves every gain to the source's counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm import common as C
from tallyweave.operators.scale import global_rank

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SEPARATOR = b"\n"
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Words of a batch that are Python objects at a time.
STEP = 1 << 17
THOUSANDTHS = 1000


def feature_steps(texts: list[bytes], max_words: int, step: int = STEP) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words in the run, document of the batch, unsigned crc32) of all features of the texts, step by step."""
    joined = SEPARATOR.join(texts).translate(LOWER)
    offsets = np.cumsum([0, *(len(t) + len(SEPARATOR) for t in texts)])
    matches = WORD.finditer(joined)
    words: list[bytes] = []
    document = np.zeros(0, np.int64)
    while found := list(islice(matches, step)):
        carried = min(len(words), max_words - 1)
        words = words[len(words) - carried :] + [m.group() for m in found]
        starts = np.fromiter((m.start() for m in found), np.int64, len(found))
        document = np.concatenate([document[len(document) - carried :], np.searchsorted(offsets, starts, "right") - 1])
        hashes = np.fromiter(map(crc32, words), np.uint32, len(words))
        yield 1, document[carried:], hashes[carried:]
        spaced = [b" " + w for w in words] if max_words > 1 else []
        for n in range(2, min(max_words, len(words)) + 1):
            # The hash of a longer run goes on from the hash of the shorter one at the same start.
            hashes = np.fromiter(map(crc32, spaced[n - 1 :], hashes[: len(words) - n + 1].tolist()), np.uint32, len(words) - n + 1)
            inside = document[: len(words) - n + 1] == document[n - 1 :]
            inside[: max(0, carried - n + 1)] = False
            yield n, document[n - 1 :][inside], hashes[inside]


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.large_binary()).to_pylist()]


def bucket_counts(df: DataFrame, max_words: int, buckets: int) -> np.ndarray:
    """How many features of all texts of ``df`` fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in C.small(batches):
            for _, _, hashes in feature_steps(_texts(batch), max_words):
                sums += np.bincount(hashes % np.uint32(buckets), minlength=buckets)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(sums[used], pa.int64())], ["bucket", "n"])

    rows = df.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for row in rows:
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of each bucket's share of the target over its share of the source, both with one count more a bucket."""
    s, t, buckets = source.astype(np.float64), target.astype(np.float64), len(source)
    return np.floor(THOUSANDTHS * np.log((t + 1) * (float(source.sum()) + buckets) / ((s + 1) * (float(target.sum()) + buckets)))).astype(np.int64)


def document_weights(docs: DataFrame, gain: np.ndarray, max_words: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every document."""
    buckets = np.uint32(len(gain))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.small(batches):
            n_words, n_features, weight = np.zeros((3, batch.num_rows), np.int64)
            for n, document, hashes in feature_steps(_texts(batch), max_words):
                count = np.bincount(document, minlength=batch.num_rows)
                n_features += count
                n_words += count if n == 1 else 0
                np.add.at(weight, document, gain[hashes % buckets])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, (n_words, n_features, weight))], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in whole thousandths from the first 32 bits of the SHA-256 of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 32))
    return F.floor(-THOUSANDTHS * F.log(-F.log(uniform))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, max_words: int = 1, buckets: int = 10_000, least_words: int = 20, seed: int = 2024
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; ``rank`` counts the drawn ones from the highest score, others have none.

    Drawn are ``percent`` of a hundred documents of those with ``least_words`` words or more, rounded down.
    """
    gain = gains(bucket_counts(docs, max_words, buckets), bucket_counts(target, max_words, buckets))
    weighed = document_weights(docs, gain, max_words).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    scored = C.stored(weighed, "resampling-scores")
    long_enough = scored.where(F.col("n_words") >= least_words)
    drawn = F.floor(long_enough.agg(F.count(F.lit(1))).scalar() * F.lit(percent) / F.lit(100))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("weight"), F.desc("n_features")]
    ranked = global_rank(long_enough, order, "rank", lambda df: C.stored(df, "resampling-order"))
    columns = ["doc_id", "n_features", "weight", "score"]
    ranked = ranked.select(*columns, F.when(F.col("rank") <= drawn, F.col("rank")).cast("long").alias("rank"))
    return ranked.unionByName(scored.where(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank")))
