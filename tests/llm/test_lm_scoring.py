import collections
import math
import zlib

import numpy as np
import pytest
from brute import SPACE_WORD, lower
from pyspark.sql import functions as F

from tallyweave.llm import common as C
from tallyweave.llm.lm_scoring import CELLS, learn_weights, score_documents


def tokens(text):
    return [*SPACE_WORD.findall(lower(text)), "</s>"]


def check_base(rows, got, is_training):
    counts = collections.Counter()
    for doc_id, text in rows:
        if is_training(doc_id):
            counts.update(tokens(text))
    n, v = sum(counts.values()), len(counts)
    for (_, text), r in zip(sorted(rows), sorted(got, key=lambda r: r["doc_id"]), strict=True):
        t = tokens(text)
        assert r["n_tokens"] == len(t) and r["n_known"] == sum(counts[x] > 0 for x in t) and r["train_tokens"] == n
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in t))


def test_against_counts(spark, sf_dir, documents):
    got = score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), C.fold("doc_id", 7) != 2).collect()
    check_base([(i, r["text"]) for i, r in documents.items()], got, lambda i: zlib.crc32(str(i).encode()) % 7 != 2)
    held = [r for r in got if not r["training"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_edges(frame):
    rows = [(1, "a b A\tb"), (2, None), (3, ""), (4, "a " * 5000), (5, "c é\x85é"), (6, "unseen words")]
    got = score_documents(frame(rows), F.col("doc_id") < 5).collect()
    check_base(rows, got, lambda i: i < 5)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_nothing_to_learn_from(frame):
    got = score_documents(frame([(1, "a b")]), F.lit(False)).collect()
    assert got[0]["train_tokens"] == 0 and got[0]["base_score"] == 0 and got[0]["score"] <= 0
    assert score_documents(frame([]), F.lit(True)).collect() == []


def model(rows, is_training):
    """Counts, and weights by exact expectation-maximisation: every training token with its own estimates, own counts deleted."""
    words, pairs, own = collections.Counter(), collections.Counter(), []
    for doc_id, text in rows:
        if is_training(doc_id):
            t = tokens(text)
            p = list(zip([t[-1], *t[:-1]], t, strict=True))
            words.update(t)
            pairs.update(p)
            own.append((collections.Counter(t), collections.Counter(p), p))
    n, v = sum(words.values()), len(words)
    bucket = lambda c: min(int(math.log2(c)) + 1, 47) if c > 0 else 0
    seen = []
    for w1, p1, sequence in own:
        for context, word in sequence:
            c = words[context] - w1[context]
            seen.append((bucket(c), (pairs[context, word] - p1[context, word]) / c if c else 0.0, (words[word] - w1[word]) / n, 1 / (v + 1)))
    mix = {b: [0.0, 0.5, 0.5] if b == 0 else [1 / 3] * 3 for b in range(48)}
    for _ in range(200):
        sums = {b: [0.0 if b == 0 else 1 / 3, 1 / 3, 1 / 3] for b in mix}
        for b, *p in seen:
            joint = [m * x for m, x in zip(mix[b], p, strict=True)]
            for i, x in enumerate(joint):
                sums[b][i] += x / sum(joint)
        mix = {b: [x / sum(s) for x in s] for b, s in sums.items()}

    def probability(context, word):
        c = words[context]
        m = mix[bucket(c)]
        return m[0] * (pairs[context, word] / c if c else 0.0) + m[1] * words[word] / n + m[2] / (v + 1)

    return probability, words


def score_of(probability, text):
    t = tokens(text)
    return sum(math.log10(probability(c, w)) for c, w in zip([t[-1], *t[:-1]], t, strict=True))


def test_score_against_an_exact_model(spark, sf_dir, documents):
    """The operator learns its weights from a histogram of eight cells a doubling, which moves them a little."""
    rows = [(i, r["text"]) for i, r in documents.items()]
    training = lambda i: zlib.crc32(str(i).encode()) % 7 != 2
    probability, _ = model(rows, training)
    got = {r["doc_id"]: r for r in score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), C.fold("doc_id", 7) != 2).collect()}
    for i, text in rows:
        expected = score_of(probability, text)
        assert got[i]["score"] == pytest.approx(expected, rel=0.005), i
    # No document is left out of the sum, and the mean over all is nearly that of the exact weights.
    assert sum(r["score"] for r in got.values()) == pytest.approx(sum(score_of(probability, t) for _, t in rows), rel=0.001)


def test_probabilities_add_up(frame):
    """Over all known words, the end and what is left for unseen ones, after a known and an unknown context."""
    rows = [(1, "a b a c"), (2, "a b b"), (3, "c a"), (4, "b a b a")]
    vocabulary = ["a", "b", "c"]
    asked = [(10 * i + j, f"{first} {w}") for i, first in enumerate(["a", "zz"], 1) for j, w in enumerate([*vocabulary, "unseen"])] + [(50, "a"), (51, "zz"), (60, "")]
    asked += [(100 + j, w) for j, w in enumerate([*vocabulary, "unseen"])]
    got = {r["doc_id"]: 10 ** r["score"] for r in score_documents(frame(rows + asked), F.col("doc_id") < 10).collect()}
    probability, words = model(rows, lambda i: i < 10)
    for i, first in enumerate(["a", "zz"], 1):
        # P(first w end) / P(w end | w) is left when the known end probabilities are taken out, by the operator's own answers.
        start = got[50] / probability("a", "</s>") if first == "a" else got[51] / probability("zz", "</s>")
        total = sum(got[10 * i + j] / start / probability(w, "</s>") for j, w in enumerate([*vocabulary, "unseen"])) + got[50 if first == "a" else 51] / start
        assert total == pytest.approx(1.0, rel=0.06)


def test_repeated_rows_and_null_ids(frame):
    rows = [(1, "a b"), (1, "a b"), (2, "a c"), (None, "a b"), (None, None), (3, "a b c")]
    got = score_documents(frame(rows), F.coalesce(F.col("doc_id") < 3, F.lit(True))).collect()
    assert len(got) == len(rows) and {r["train_tokens"] for r in got} == {3 + 3 + 3 + 3 + 1}
    assert len({r["score"] for r in got if r["n_tokens"] == 3 and r["doc_id"] in (1, None)}) == 1


def test_weights_prefer_what_predicts():
    cells = np.array([(3 * CELLS + 0) * CELLS + 8, (3 * CELLS + CELLS - 1) * CELLS + 8])
    mix = learn_weights(cells, np.array([90.0, 10.0]), 1000, 100)
    assert mix[3, 0] > 0.7 and np.allclose(mix.sum(axis=1), 1)
