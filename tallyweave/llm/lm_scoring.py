"""Word n-gram scoring by deleted interpolation.

The probability of a word is a mixture of maximum-likelihood estimates, P = w2 c(v,w)/c(v) + w1 c(w)/N + w0 /(V+1), whose weights
depend on how often the context v was seen (a bucket for each power of two). Expectation-maximisation finds the weights on
held-out counts: each training document in turn is left out, its own counts deleted from the totals, and predicted by the rest.

Documents are handled in blocks. A block sends its distinct words and pairs with their training counts to buckets of hash
values, which add them up and send the totals back; no task or driver ever holds the whole model. What the weights need from a
block is a histogram of (context bucket, log pair estimate, log word estimate), which is added up and whose size is bounded by
the number of its cells.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm import common as C

BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 24 << 20
#: Histogram cells for each doubling of an estimate.
STEPS = 8
CONTEXTS, CELLS = 48, 48 * STEPS + 2
END = np.uint64(0x5851F42D4C957F2D)
WORD, PAIR, TYPES, OWN = 0, 1, 2, -1
MESSAGE = "block long, bucket long, kind int, grams binary, counts binary"
MESSAGE_ARROW = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("kind", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary())])
COUNTED = "kind int, docs array<struct<doc_id:long,training:boolean,n_tokens:long,n_known:long,log_counts:double>>, pairs binary, words binary, cells array<struct<cell:long,weight:double>>, types long"
DOC = pa.struct([("doc_id", pa.int64()), ("training", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("log_counts", pa.float64())])
CELL = pa.struct([("cell", pa.int64()), ("weight", pa.float64())])
COUNTED_ARROW = pa.schema([("kind", pa.int32()), ("docs", pa.list_(DOC)), ("pairs", pa.binary()), ("words", pa.binary()), ("cells", pa.list_(CELL)), ("types", pa.int64())])
RESULT = "doc_id long, training boolean, n_tokens long, n_known long, base_score double, score double"


class _Tokens:
    """Tokens of a block: word hashes, each document followed by an end; the context of a first word is the end before it."""

    def __init__(self, block: pa.Table) -> None:
        self.block = C.ordered(block)
        data, offsets = C.flat_text(self.block.column("text"))
        data = C.lower_ascii(data)
        starts, ends, first = C.space_words(data, offsets)
        words, n = C.hash_words(data, starts, ends), np.diff(first)
        self.lengths = n + 1
        self.stops = np.cumsum(self.lengths)
        self.words = np.full(int(self.stops[-1]) if len(n) else 0, END, np.uint64)
        inner = np.ones(len(self.words), bool)
        inner[self.stops - 1] = False
        self.words[inner] = words
        before = np.concatenate([[END], self.words[:-1]])
        before[self.stops[:-1]] = END
        with np.errstate(over="ignore"):
            self.pairs = C.mixed(before * np.uint64(0x9E3779B97F4A7C15) + C.mixed(self.words))
        self.document = np.repeat(np.arange(len(n)), self.lengths)
        self.training = self.block.column("training").to_numpy(zero_copy_only=False).astype(bool)


def _send(block: pa.Table, n_buckets: int) -> pa.Table:
    tokens, number, rows = _Tokens(block), block.column("block")[0].as_py(), []
    used = tokens.training[tokens.document]
    for kind, grams in ((WORD, tokens.words), (PAIR, tokens.pairs)):
        values, which = np.unique(grams, return_inverse=True)
        counts = np.bincount(which, used, len(values)).astype(np.int64)
        rows += [(number, bucket, kind, C.pack_sorted(values[a:b]), C.pack(counts[a:b])) for bucket, a, b in C.bucket_slices(values, 64, n_buckets)]
    return pa.Table.from_pylist([dict(zip(MESSAGE_ARROW.names, r, strict=True)) for r in rows], schema=MESSAGE_ARROW)


def _total(messages: pa.Table) -> pa.Table:
    """Corpus counts of the n-grams that each block asked for, and how many different training words the bucket has."""
    rows = []
    for kind in (WORD, PAIR):
        asked = [r for r in messages.to_pylist() if r["kind"] == kind]
        if not asked:
            continue
        lists = [C.unpack_sorted(r["grams"]) for r in asked]
        ends = np.cumsum([len(x) for x in lists])
        values, which = np.unique(np.concatenate(lists), return_inverse=True)
        totals = np.bincount(which, np.concatenate([C.unpack(r["counts"]) for r in asked]), len(values)).astype(np.int64)
        for r, part in zip(asked, np.split(totals[which], ends[:-1]), strict=True):
            rows.append({**r, "grams": None, "counts": C.pack(part)})
        if kind == WORD:
            types = np.array([np.count_nonzero(totals)])
            rows.append({"block": asked[0]["block"], "bucket": asked[0]["bucket"], "kind": TYPES, "grams": None, "counts": C.pack(types)})
    return pa.Table.from_pylist(rows, schema=MESSAGE_ARROW)


def _level(values: np.ndarray) -> np.ndarray:
    """Cell of an estimate given as its negative log2 in STEPS; the last cell is for none."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(values > 0, np.clip(np.rint(-np.log2(values) * STEPS), 0, CELLS - 2), CELLS - 1).astype(np.int64)


def _context(counts: np.ndarray) -> np.ndarray:
    """0 for an unseen context, then one bucket for each doubling of its count."""
    return np.where(counts > 0, np.minimum(np.log2(np.maximum(counts, 1)).astype(np.int64) + 1, CONTEXTS - 1), 0)


def _contexts_of(words: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Count of each token's context: that of the token before; before a first token, of the end, which each document has once."""
    before = np.concatenate([words[-1:], words[:-1]])
    if len(stops):
        before[np.concatenate([[0], stops[:-1]])] = words[stops - 1]
    return before


def _count(block: pa.Table, messages: pa.Table, n_buckets: int) -> pa.Table:
    answers: dict[tuple[int, int], bytes] = {(r["kind"], r["bucket"]): r["counts"] for r in messages.to_pylist()}
    types = sum(int(C.unpack(v)[0]) for (kind, _), v in answers.items() if kind == TYPES)
    tokens = _Tokens(block)
    got = {}
    for kind, grams in ((WORD, tokens.words), (PAIR, tokens.pairs)):
        values, which = np.unique(grams, return_inverse=True)
        totals = np.empty(len(values), np.int64)
        for bucket, a, b in C.bucket_slices(values, 64, n_buckets):
            totals[a:b] = C.unpack(answers[kind, bucket])
        # How often the token's own document has it, for training documents: what is deleted.
        own = _own_counts(tokens.document, which, len(values)) * tokens.training[tokens.document]
        got[kind] = (totals[which], own)
    (words, own_words), (pairs, own_pairs) = got[WORD], got[PAIR]
    contexts = _contexts_of(words, tokens.stops)
    left = words - own_words, pairs - own_pairs, contexts - _contexts_of(own_words, tokens.stops)
    used = tokens.training[tokens.document]
    with np.errstate(divide="ignore", invalid="ignore"):
        estimate = np.where(left[2] > 0, left[1] / left[2], 0.0)
    # A word's estimate is kept as its count; N is known only when all blocks are done.
    cell = (_context(left[2]) * CELLS + _level(estimate)) * CELLS + np.where(left[0] > 0, np.rint(np.log2(np.maximum(left[0], 1)) * STEPS).astype(np.int64), CELLS - 1)
    cells, weights = np.unique(cell[used], return_counts=True)
    n_docs = len(tokens.lengths)
    known = np.bincount(tokens.document, words > 0, n_docs).astype(np.int64)
    logs = np.bincount(tokens.document, np.log10(words + 1.0), n_docs)
    docs = [
        {"doc_id": i, "training": bool(t), "n_tokens": int(n), "n_known": int(k), "log_counts": float(x)}
        for i, t, n, k, x in zip(tokens.block.column("doc_id").to_pylist(), tokens.training, tokens.lengths, known, logs, strict=True)
    ]
    row = {"kind": 0, "docs": docs, "pairs": C.pack(pairs.astype(np.uint64)), "words": C.pack(words.astype(np.uint64)), "cells": [{"cell": int(c), "weight": float(w)} for c, w in zip(cells, weights, strict=True)], "types": types}
    return pa.Table.from_pylist([row], schema=COUNTED_ARROW)


def _own_counts(document: np.ndarray, which: np.ndarray, n: int) -> np.ndarray:
    _, index, counts = np.unique(document * n + which, return_inverse=True, return_counts=True)
    return counts[index]


def learn_weights(cells: np.ndarray, weights: np.ndarray, tokens: int, types: int, rounds: int = 200, tolerance: float = 1e-7) -> np.ndarray:
    """Mixture weights (pair, word, uniform) of each context bucket, by expectation-maximisation on the histogram."""
    context, pair, word = cells // (CELLS * CELLS), cells // CELLS % CELLS, cells % CELLS
    p = np.stack([
        np.where(pair == CELLS - 1, 0.0, 2.0 ** (-pair / STEPS)),
        np.where(word == CELLS - 1, 0.0, 2.0 ** (word / STEPS) / max(1, tokens)),
        np.full(len(cells), 1.0 / (types + 1)),
    ])
    mix = np.full((CONTEXTS, 3), 1 / 3)
    mix[0] = (0.0, 0.5, 0.5)
    for _ in range(rounds):
        joint = p * mix[context].T
        share = joint / joint.sum(axis=0) * weights
        # One count spread evenly over what a bucket can use, so that no weight is ever zero.
        sums = np.stack([np.bincount(context, s, CONTEXTS) for s in share], axis=1) + 1 / 3
        sums[0, 0] = 0.0
        new = sums / sums.sum(axis=1, keepdims=True)
        done = np.abs(new - mix).max() < tolerance
        mix = new
        if done:
            break
    return mix


def score_documents(docs: DataFrame, training: F.Column) -> DataFrame:
    """log10 probability of each document under a model learned from the documents for which ``training`` holds.

    docs: doc_id, text. Text is lower-cased in A-Z; tokens are runs of characters other than space and \\x09-\\x0D, then one end,
    which counts as a token. A null or empty text is the end alone. Rows that share a doc_id are documents of their own. With no
    training documents every probability is uniform. Further columns are ignored.

    Returns doc_id, training, n_tokens, n_known (tokens seen in training), base_score (add-one unigram), score, train_tokens.
    """
    spark = docs.sparkSession
    source = docs.select("doc_id", "text", F.coalesce(training, F.lit(False)).alias("training"))
    total = C.text_bytes(source)
    blocks, n = C.in_blocks(source, total, BLOCK_BYTES, F.col("training"))
    n_buckets = C.buckets_for(spark, total, BUCKET_BYTES)
    asked = blocks.groupBy("block").applyInArrow(lambda block: _send(block, n_buckets), MESSAGE).repartition(n_buckets, "bucket")
    totals = asked.groupBy("bucket").applyInArrow(_total, MESSAGE).repartition(n, "block")
    pair = blocks.groupBy("block").cogroup(totals.groupBy("block"))
    counted = C.stored(pair.applyInArrow(lambda block, messages: _count(block, messages, n_buckets), COUNTED), "lm-counts")
    train_tokens = F.aggregate("docs", F.lit(0).cast("long"), lambda a, d: a + F.when(d["training"], d["n_tokens"]).otherwise(F.lit(0)))
    sums = counted.agg(F.sum(train_tokens).alias("tokens"), F.sum("types").alias("types")).first()
    tokens, types = int(sums["tokens"] or 0), int(sums["types"] or 0)
    histogram = counted.select(F.explode("cells").alias("c")).groupBy("c.cell").agg(F.sum("c.weight").alias("weight")).toPandas()
    mix = learn_weights(histogram["cell"].to_numpy(np.int64), histogram["weight"].to_numpy(np.float64), tokens, types)

    def score(batches):
        for batch in batches:
            for r in batch.to_pylist():
                lengths = np.array([d["n_tokens"] for d in r["docs"]], np.int64)
                words, pairs = C.unpack(r["words"]).astype(np.float64), C.unpack(r["pairs"]).astype(np.float64)
                contexts = _contexts_of(words, np.cumsum(lengths))
                w = mix[_context(contexts)]
                with np.errstate(divide="ignore", invalid="ignore"):
                    p = w[:, 0] * np.where(contexts > 0, pairs / contexts, 0.0) + w[:, 1] * words / max(1, tokens) + w[:, 2] / (types + 1)
                document = np.repeat(np.arange(len(lengths)), lengths)
                scores = np.bincount(document, np.log10(p), len(lengths))
                base = np.array([d["log_counts"] for d in r["docs"]]) - lengths * np.log10(tokens + types + 1.0)
                yield pa.RecordBatch.from_arrays([
                    pa.array([d["doc_id"] for d in r["docs"]], pa.int64()), pa.array([d["training"] for d in r["docs"]], pa.bool_()), pa.array(lengths),
                    pa.array([d["n_known"] for d in r["docs"]], pa.int64()), pa.array(base), pa.array(scores),
                ], names=["doc_id", "training", "n_tokens", "n_known", "base_score", "score"])

    return counted.select("docs", "words", "pairs").mapInArrow(score, RESULT).withColumn("train_tokens", F.lit(tokens).cast("long"))
