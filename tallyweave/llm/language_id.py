"""Language identification: multinomial naive Bayes over hashed character trigrams.

Each letter with its two neighbours (other characters count as one blank) is a trigram, hashed to a slot. Tasks count slots by
language, Spark adds the counts up, and the log-probability matrix, of slots times languages, is broadcast: its size is a
parameter, whatever the corpus. A batch of texts is scored by gathering a language's values and adding them up per document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm import common as C

SLOTS = 1 << 15
#: A matrix of more languages than this isn't broadcast; the caller must lower ``slots``.
MATRIX_CELLS = 1 << 24
UNDETERMINED = "und"
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def trigrams(texts: list[str], slots: int) -> tuple[np.ndarray, np.ndarray]:
    """The slot of each letter's trigram, and how many trigrams each text has."""
    lower = [t.lower() for t in texts]
    lengths = np.array([len(t) for t in lower], np.int64)
    code = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    code[~_letters()[code]] = 0
    ends = np.cumsum(lengths)
    left, right = np.zeros_like(code), np.zeros_like(code)
    left[1:], right[:-1] = code[:-1], code[1:]
    inner = ends[(ends > 0) & (ends < len(code))]
    left[inner], right[inner - 1] = 0, 0
    at = np.flatnonzero(code)
    with np.errstate(over="ignore"):
        x = (left[at] * np.uint64(0x9E3779B97F4A7C15)) ^ (code[at] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (right[at] * np.uint64(0x165667B19E3779F9))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    sums = np.concatenate([[0], np.cumsum(code > 0)])
    return ((x >> np.uint64(40)) % np.uint64(slots)).astype(np.int64), sums[ends] - sums[ends - lengths]


def train(docs: DataFrame, slots: int = SLOTS) -> dict:
    """Model of (text, lang) rows; rows without a language or a text take no part."""

    def count(batches):
        counts: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for batch in C.small(batches):
            slot, sizes = trigrams(batch.column("text").to_pylist(), slots)
            names, which = np.unique(np.array(batch.column("lang").to_pylist(), dtype=object).astype(str), return_inverse=True)
            both = np.bincount(np.repeat(which, sizes) * slots + slot, minlength=len(names) * slots).reshape(len(names), slots)
            for name, of, n in zip(names.tolist(), both, np.bincount(which, minlength=len(names)).tolist(), strict=True):
                counts[name] = counts[name] + of if name in counts else of
                rows[name] = rows.get(name, 0) + n
        for name, of in counts.items():
            used = np.flatnonzero(of)
            # Slot -1 counts the documents.
            slot, value = np.append(used, -1), np.append(of[used], rows[name])
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(slot), pa.string()), pa.array(slot, pa.int32()), pa.array(value, pa.int64())], names=["lang", "slot", "n"])

    labelled = docs.select("text", F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sums = labelled.mapInArrow(C.giving_back(count), "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    sums = C.stored(sums, "language-counts")
    languages = sorted(r["lang"] for r in sums.where("slot = -1").select("lang").collect())
    if len(languages) * slots > MATRIX_CELLS:
        raise ValueError(f"{len(languages)} languages of {slots} slots exceed a matrix of {MATRIX_CELLS} cells; lower slots")
    table = sums.toPandas()
    row = {name: i for i, name in enumerate(languages)}
    counts, documents = np.zeros((len(languages), slots)), np.zeros(len(languages))
    which = table["lang"].map(row).to_numpy(np.int64) if len(table) else np.zeros(0, np.int64)
    slot, n = table["slot"].to_numpy(np.int64), table["n"].to_numpy(np.float64)
    documents[which[slot < 0]] = n[slot < 0]
    counts[which[slot >= 0], slot[slot >= 0]] = n[slot >= 0]
    smooth = 0.1
    logs = np.log((counts + smooth) / (counts.sum(axis=1, keepdims=True) + smooth * slots))
    prior = np.log((documents + 1) / (documents.sum() + len(languages))) if languages else documents
    return {"languages": languages, "matrix": logs, "prior": prior, "slots": slots}


def predict(docs: DataFrame, model: dict, *keep: str | Column) -> DataFrame:
    """The kept columns with lang_pred and score (posterior probability of lang_pred; 0 for ``und``)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    names = docs.select(*keep).columns
    fixed = [f"keep_{i}" for i in range(len(names))]
    source = docs.select(*keep, "text").toDF(*fixed, "text")
    out = source.drop("text").withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema

    def run(batches):
        m = shared.value
        labels = np.array([*m["languages"], UNDETERMINED], dtype=object)
        for batch in C.small(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            best, score = np.full(len(texts), len(labels) - 1), np.zeros(len(texts))
            slot, sizes = trigrams(texts, m["slots"])
            has = np.flatnonzero(sizes)
            if m["languages"] and len(has):
                starts = (np.cumsum(sizes) - sizes)[has]
                # One language at a time: a text's letters times all languages would not stay small.
                logs = np.stack([np.add.reduceat(of[slot], starts) for of in m["matrix"]], axis=1) + m["prior"]
                share = np.exp(logs - logs.max(axis=1, keepdims=True))
                share /= share.sum(axis=1, keepdims=True)
                top = logs.argmax(axis=1)
                best[has], score[has] = top, share[np.arange(len(has)), top]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in fixed), pa.array(labels[best], pa.string()), pa.array(score)], names=[*fixed, "lang_pred", "score"])

    return source.mapInArrow(C.giving_back(run), out).toDF(*names, "lang_pred", "score")


def identify_languages(docs: DataFrame, training: Column, *keep: str | Column, slots: int = SLOTS) -> DataFrame:
    """Predict every document's language by a model learned from the documents for which ``training`` holds.

    docs: text, lang, and what is kept. Only the text is looked at in a prediction. lang_pred is a language seen in training, or
    ``und`` (score 0) if the text is null or has no letter, or if there was nothing to learn from. Ties go to the language first in
    order of names. Rows are judged one by one, so repeated rows repeat. Further columns are ignored.
    """
    return predict(docs, train(docs.where(F.coalesce(training, F.lit(False))), slots), *keep)
