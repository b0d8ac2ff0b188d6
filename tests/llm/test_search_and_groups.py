import random

import pytest
import xxhash
from brute import SPACE_WORD, components, lower
from pyspark.sql import functions as F

from tallyweave.llm import knn_join, simhash
from tallyweave.llm.components import connected_components


def nearest(vectors, k, is_query):
    rows = {}
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and x == x and abs(x) != float("inf") for x in v):
            rows[i] = [int((1024 * x) // 1) for x in v]
    out = set()
    for q in filter(is_query, rows):
        scored = sorted((-sum(a * b for a, b in zip(rows[q], v, strict=False)), i) for i, v in rows.items() if i != q)
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize(("pivots", "cell"), [(1, 16_384), (5, 7), (32, 3)])
def test_knn(spark, monkeypatch, pivots, cell):
    monkeypatch.setattr(knn_join, "PIVOT_ROWS", 5)
    monkeypatch.setattr(knn_join, "CELL_ROWS", cell)
    monkeypatch.setattr(knn_join, "CELL_QUERIES", 2)
    rng = random.Random(3)
    vectors = [(i, [rng.choice([-0.5, -0.1, 0.25, 0.3]) for _ in range(4)]) for i in range(150)]
    vectors += [(200 + i, [0.25, 0.3, 0.3, 0.25]) for i in range(40)]
    vectors += [(300, None), (310, [None, 0.1]), (320, [float("nan")]), (330, [float("inf"), 0.0]), (340, [0.5]), (350, []), (360, [9.0, 9.0, 9.0, 9.0]), (None, [1.0])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in vectors], "vec_id long, embedding array<float>, query string").repartition(3)
    got = knn_join.top_inner_products(frame, F.col("vec_id") % 10 == 0, 10, pivots=pivots).collect()
    import numpy as np

    exact = [(i, v if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, v in vectors]
    assert {tuple(r) for r in got} == nearest(exact, 10, lambda i: i % 10 == 0)


def clusters(rng, n, spread):
    """Unit vectors around sixteen centres."""
    centres, out = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(16)], []
    for i in range(n):
        v = [x + rng.gauss(0, spread) for x in centres[i % 16]]
        out.append((i, [x / sum(y * y for y in v) ** 0.5 for x in v]))
    return out


def copies_sent(monkeypatch, frame, is_query, **options):
    """The answer, and how many copies of vectors the plan sends to query groups."""
    sent = []
    make = frame.sparkSession.createDataFrame

    def watch(rows, schema=None, **more):
        if schema and str(schema).startswith("query_pivot"):
            sent.append(list(rows))
        return make(rows, schema, **more)

    monkeypatch.setattr(type(frame.sparkSession), "createDataFrame", lambda self, *a, **kw: watch(*a, **kw))
    return knn_join.top_inner_products(frame, is_query, **options).collect(), sent[0]


def test_knn_rules_out_most_of_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(knn_join, "PIVOT_ROWS", 50)
    vectors = clusters(random.Random(6), 1600, 0.01)
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3)
    got, plan = copies_sent(monkeypatch, frame, F.col("vec_id") % 10 == 0)
    assert {tuple(r) for r in got} == nearest(vectors, 10, lambda i: i % 10 == 0)
    groups, pivots = {r[0] for r in plan}, {r[1] for r in plan}
    # Less than half of what all groups together would draw; a group whose cluster has no pivot may still take everything.
    assert len(groups) > 8 and len(plan) < len(groups) * len(pivots) / 2


def test_knn_sends_few_copies_where_nothing_can_be_ruled_out(spark, monkeypatch):
    monkeypatch.setattr(knn_join, "PIVOT_ROWS", 10)
    rng = random.Random(7)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(24)]) for i in range(600)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3)
    got, plan = copies_sent(monkeypatch, frame, F.col("vec_id") % 10 == 0)
    assert {tuple(r) for r in got} == nearest(vectors, 10, lambda i: i % 10 == 0)
    assert len({r[0] for r in plan}) <= knn_join.WHOLE


def test_knn_with_repeated_ids(spark, monkeypatch):
    """Rows of one vec_id with different vectors, queries among them, are candidates of their own; equal query rows are answered once."""
    monkeypatch.setattr(knn_join, "PIVOT_ROWS", 4)
    rng = random.Random(9)
    rows = [(i % 25, [round(rng.uniform(-1, 1), 2) for _ in range(3)]) for i in range(150)]
    rows += rows[:3]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in knn_join.top_inner_products(frame, F.col("vec_id") < 2, 4).collect())
    whole = [(i, [int((1024 * x) // 1) for x in v]) for i, v in rows]
    expected = []
    for q, v in {(i, tuple(v)) for i, v in whole if i < 2}:
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in whole if i != q)
        expected += [(q, n + 1, i, -x) for n, (x, i) in enumerate(scored[:4])]
    assert got == sorted(expected)


def test_knn_refuses_scores_beyond_64_bits(spark):
    frame = spark.createDataFrame([(0, [1e300]), (1, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="64 bits"):
        knn_join.top_inner_products(frame, F.lit(True))


def test_knn_without_candidates_or_rows(spark):
    one = spark.createDataFrame([(0, [0.5])], "vec_id long, embedding array<float>")
    assert knn_join.top_inner_products(one, F.lit(True)).collect() == []
    assert knn_join.top_inner_products(one.limit(0), F.lit(True)).collect() == []
    assert knn_join.top_inner_products(one, F.lit(False)).collect() == []


def fingerprint(text, width):
    w = SPACE_WORD.findall(lower(text))
    shingles = [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_on_documents(spark, sf_dir, documents):
    prints = {i: fingerprint(r["text"], 4) for i, r in documents.items()}
    expected = components(prints, 4)
    got = simhash.near_duplicate_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{prints[i]:016x}", expected[i]) for i in prints}


def test_simhash_edges(frame):
    rows = [(5, None), (3, ""), (4, " \n"), (9, "One two"), (8, "one  TWO"), (7, "one two three four five " * 3000), (None, "one two"), (9, "One two"), (6, "É b c d e"), (2, "é b c d e")]
    got = simhash.near_duplicate_groups(frame(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        texts = {t for i, t in rows if i == r["doc_id"]}
        assert r["fingerprint"] in {f"{fingerprint(t, 4):016x}" for t in texts}
    assert {r["component_id"] for r in got if r["doc_id"] in (3, 4, 5)} == {3}
    assert {r["component_id"] for r in got if r["doc_id"] in (8, 9, None)} == {8}
    kept = simhash.keep_one_of_each_group(frame(rows))
    ids = sorted(r["doc_id"] for r in kept.collect())
    assert len(ids) == len(set(ids)) and {3, 8}.issubset(ids) and not {4, 5, 9}.intersection(ids) and "block" in kept.columns
    assert simhash.near_duplicate_groups(frame([])).collect() == []


@pytest.mark.parametrize("part", [4096, 3])
def test_links_connect_what_is_close(spark, part):
    """Families of close fingerprints, chains, and one family with a third of all."""
    rng = random.Random(11)
    prints = [rng.getrandbits(64) for _ in range(60)]
    family = rng.getrandbits(64)
    prints += [family ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(60)]
    chain = rng.getrandbits(64)
    for i in range(12):
        prints.append(chain)
        chain ^= sum(1 << b for b in rng.sample(range(64), 4))
    prints = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    links = simhash.close_links(spark.createDataFrame([(p,) for p in prints], "fp long"), 4, part)
    # A link connects members of one family: any chain of steps of four bits at most.
    family_of = components({p: p & (1 << 64) - 1 for p in prints}, 4)
    assert all(r["u"] != r["v"] and family_of[r["u"]] == family_of[r["v"]] for r in links.collect())
    got = {r["node"]: r["root"] for r in connected_components(links).collect()}
    expected = components({p: p & (1 << 64) - 1 for p in prints}, 4)
    groups = {}
    for p in prints:
        groups.setdefault(got.get(p, p), set()).add(p)
    wanted = {}
    for p in prints:
        wanted.setdefault(expected[p], set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_masks():
    for b in (5, 6, 7, 8):
        masks = simhash.block_masks(b, 4)
        rng = random.Random(b)
        for _ in range(200):
            difference = sum(1 << i for i in rng.sample(range(64), 4))
            assert any(m & difference == 0 for m in masks)


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 200 + i) for i in range(40)] + [(7, 7)]
    root = {n: n for p in pairs for n in p}
    for _ in range(100):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert all(got.get(n, n) == r for n, r in root.items())
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []
