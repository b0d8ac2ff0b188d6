import hashlib
import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from brute import PLAIN_WORD, lower

from tallyweave.llm import resampling
from tallyweave.llm.resampling import resample

COLUMNS = ("doc_id", "n_features", "weight", "score", "rank")


def runs(text, longest, buckets):
    words = PLAIN_WORD.findall(lower(text))
    return len(words), [crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def drawn(docs, target, percent, longest, buckets, least, seed):
    """Rows as the operator returns them, document by document."""
    bags = [(i, *runs(t, longest, buckets)) for i, t in docs]
    s, t = Counter(k for _, _, b in bags for k in b), Counter(k for text in target for k in runs(text, longest, buckets)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = {k: math.floor(1000 * math.log((t[k] + 1) * (n_s + buckets) / ((s[k] + 1) * (n_t + buckets)))) for k in s}
    rows = []
    for doc_id, words, bag in bags:
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[k] for k in bag)
        rows.append((doc_id, len(bag), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    order = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[2], -r[1]))
    k = percent * len(order) // 100
    out = [(*r[:4], n + 1 if n < k else None) for n, r in enumerate(order)]
    return out + [(*r[:4], None) for r in rows if r[4] < least]


def key(row):
    return tuple((x is None, x or 0) for x in row)


def same(frame, expected):
    assert sorted((tuple(r[c] for c in COLUMNS) for r in frame.collect()), key=key) == sorted(expected, key=key)


def test_whole_table(spark, sf_dir, documents):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), items)
    same(got, drawn([(i, r["text"]) for i, r in documents.items()], [r["text"] for r in items.collect()], 10, 1, 10_000, 20, 2024))


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_odd_rows(frame, longest):
    rng = random.Random(longest)
    rows = [(i, " ".join(rng.choice(["a", "B", "c-d", "é", "É", "x1"]) for _ in range(rng.randrange(9)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "..."), (103, "a\nb\x00c\x7fd"), (104, "long words " * 60_000), (None, "a b c"), (None, "a b c"), (None, "b"), (1, "a b"), (1, "a b"), (105, "ſ K İ 漢字")]
    items = [(1, "a b c d"), (2, None), (2, "é x1 x1"), (None, "zz")]
    target = frame(items, "item_id long, text string")
    same(resample(frame(rows), target, 30, longest, 50, 2, 7), drawn(rows, [t for _, t in items], 30, longest, 50, 2, 7))
    same(resample(frame(rows), target.limit(0), 100, longest, 50, 0, 7), drawn(rows, [], 100, longest, 50, 0, 7))
    assert resample(frame([]), target).collect() == []


@pytest.mark.parametrize("step", [1, 2, 3, 7, 1000])
def test_runs_do_not_cross_documents_or_get_lost_between_steps(step):
    texts = ["one two three four", "", "five", "six seven", "", "Eight nine ten eleven twelve thirteen", "one two"]
    found = [[] for _ in texts]
    for _, document, hashes in resampling.feature_steps([t.encode() for t in texts], 3, step):
        for d, h in zip(document.tolist(), hashes.tolist(), strict=True):
            found[d].append(h % 1000)
    assert [sorted(f) for f in found] == [sorted(runs(t, 3, 1000)[1]) for t in texts]


def test_one_text_on_most_rows(frame):
    rows = [(i, "same words here" if i % 3 else f"other {i} words") for i in range(3000)]
    got = resample(frame(rows), frame([(1, "same")], "item_id long, text string"), least_words=3)
    same(got, drawn(rows, ["same"], 10, 1, 10_000, 3, 2024))


def test_gains_of_equal_shares_are_zero():
    counts = np.array([5, 0, 7])
    assert resampling.gains(counts, counts).tolist() == [0, 0, 0]
