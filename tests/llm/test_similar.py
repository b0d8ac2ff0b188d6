import random

from brute import components
from test_search_and_groups import SPACE_WORD, fingerprint

import corpus_pipeline
from tallyweave.llm import simhash


def shingles(text):
    w = SPACE_WORD.findall(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def planted(rng, n_words, changes):
    """A text and a copy in which some words, far from each other, are new."""
    words = [f"w{rng.randrange(5000)}" for _ in range(n_words)]
    copy = list(words)
    for c in range(changes):
        copy[(2 * c + 1) * n_words // (2 * changes)] = f"new{rng.randrange(10**6)}"
    return " ".join(words), " ".join(copy)


def test_similar_copies_go_and_others_stay(spark):
    """Planted pairs from 0.8 to 0.97 at several sizes: most differ in more than 4 bits. Pairs below 0.8 stay apart."""
    rng = random.Random(5)
    pairs = [planted(rng, n, c) for n, c in [(100, 1), (100, 2), (300, 1), (300, 3), (300, 6), (1000, 5), (1000, 15), (1000, 21)] for _ in range(12)]
    near = [jaccard(a, b) >= 0.8 for a, b in pairs]
    assert all(near)
    far = [planted(rng, 300, 9) for _ in range(12)]
    assert all(jaccard(a, b) < 0.8 for a, b in far)
    rows = [(i, t) for i, t in enumerate(t for pair in [*pairs, *far] for t in pair)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()}
    close = {2 * i + 1 for i, (a, b) in enumerate(pairs) if bin(fingerprint(a, 5) ^ fingerprint(b, 5)).count("1") <= 4}
    assert len(close) < len(pairs) / 2  # 4 bits alone miss over half
    assert {i for i, _ in rows[: 2 * len(pairs)] if i % 2} & kept == set()
    apart = {i for i, t in rows[2 * len(pairs) :]}
    assert {i for i, _ in rows if i % 2 == 0} <= kept
    bits = {2 * (len(pairs) + i) + 1 for i, (a, b) in enumerate(far) if bin(fingerprint(a, 5) ^ fingerprint(b, 5)).count("1") <= 4}
    assert apart - kept == bits


def test_names_of_columns_do_not_clash(spark):
    words = " ".join(f"w{i}" for i in range(50))
    rows = [(1, words, "a", 5, "x"), (2, words, "b", 6, "y"), (3, "other words", "c", 7, "z"), (3, "other words", "c", 7, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __text_hash string, __id long, text_hash string")
    for name in ("root", "c0", "stays", "gone_id", "bloom_places"):
        docs = docs.withColumn(name, spark.createDataFrame([(1,)], "x int").select("x").scalar())
    kept = simhash.keep_one_of_each_group(docs, 5, 4, 0.8)
    assert kept.columns == docs.columns
    assert sorted(tuple(r)[:5] for r in kept.collect()) == [rows[0], rows[2]]


def test_without_a_filter_the_result_is_the_same(spark, monkeypatch):
    """More texts than the filter takes: all rows go to the exact join."""
    rng = random.Random(8)
    pairs = [planted(rng, 100, 2) for _ in range(10)]
    rows = [(i, t) for i, t in enumerate([t for pair in pairs for t in pair] + ["x y z"] * 3 + [None, None])]
    docs = spark.createDataFrame([*rows, (None, "x y z"), rows[0]], "doc_id long, text string").repartition(3)
    with_filter = sorted(r["doc_id"] for r in simhash.keep_one_of_each_group(docs, 5, 4, 0.8).collect())
    monkeypatch.setattr("tallyweave.llm.bloom.filter_of", lambda keys, column: None)
    assert sorted(r["doc_id"] for r in simhash.keep_one_of_each_group(docs, 5, 4, 0.8).collect()) == with_filter == [*range(0, 20, 2), 20, 23]


def test_one_key_with_a_third_of_all_texts(spark, monkeypatch):
    """A family of texts that share half their words and hence many keys; some pairs in it are similar."""
    rng = random.Random(10)
    common = [f"c{i}" for i in range(120)]
    rows = []
    for i in range(150):
        own = [f"o{i}x{j}" for j in range(40)]
        rows.append((2 * i, " ".join(common + own)))
        if i % 10 == 0:
            rows.append((2 * i + 1, " ".join(common + own[:-2] + [f"new{rng.randrange(10**6)}", "z"])))
    rows += [(1000 + i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))) for i in range(250)]
    sets = {i: shingles(t) for i, t in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr("tallyweave.llm.minhash.PART_BYTES", 20_000)
    got = {r["doc_id"] for r in simhash.keep_one_of_each_group(docs, 5, 0, 0.8).collect()}
    found = components({i: n for n, i in enumerate(sets)}, -1, lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    assert got == set(found.values())


def test_chains_parts_and_equal_sets(spark, monkeypatch):
    """A chain of copies each similar to the one before, in many small parts; texts that repeat one set; texts without words."""
    rng = random.Random(6)
    words = [f"w{rng.randrange(5000)}" for _ in range(200)]
    chain = []
    for i in range(20):
        words[i * 10 + 5] = f"new{i}"
        chain.append(" ".join(words))
    assert jaccard(chain[0], chain[-1]) < 0.8 <= min(jaccard(a, b) for a, b in zip(chain, chain[1:], strict=False))
    loop = "a b c d e f g "
    rows = list(enumerate([*chain, loop * 3, loop * 40 + "a b c", "", None, " ", "x y", "X  y"]))
    docs = spark.createDataFrame([*rows, rows[0], (None, chain[3])], "doc_id long, text string").repartition(3)
    monkeypatch.setattr("tallyweave.llm.minhash.PART_BYTES", 3000)
    kept = sorted(r["doc_id"] for r in simhash.keep_one_of_each_group(docs, 5, 4, 0.8).collect())
    assert kept == [0, 20, 22, 25]
