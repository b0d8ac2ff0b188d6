import corpus_pipeline
from brute import components, hits, lower, repeated_bytes
from test_search_and_groups import fingerprint
from test_similar import shingles

from tallyweave.llm import common as C


def test_every_stage_against_brute_force(spark, sf_dir):
    docs = C.table(spark, sf_dir, "documents")
    columns, kept = docs.columns, docs
    frames = []
    for name, stage in corpus_pipeline.STAGES:
        frames.append(kept)
        kept = C.stored(stage(spark, kept, sf_dir), f"test-{name}")
        assert name == "packing" or kept.columns == columns
    rows = [{r["doc_id"]: r["text"] for r in f.collect()} for f in frames]
    assert set(rows[1]) == {i for i, t in rows[0].items() if any(c.isalpha() for c in t)}
    sets = {i: shingles(lower(t)) for i, t in rows[1].items()}
    similar = lambda i, j: len(sets[i] & sets[j]) >= corpus_pipeline.SIMILAR * len(sets[i] | sets[j])
    groups = components({i: fingerprint(t, 5) for i, t in rows[1].items()}, 4, similar)
    assert set(rows[2]) == set(groups.values()) and all(rows[2][i] == rows[1][i] for i in rows[2])
    removed = repeated_bytes(rows[2].items(), 100)
    assert set(rows[3]) <= set(rows[2]) and all(removed[i][1] > 0 for i in set(rows[2]) - set(rows[3]))
    assert all(rows[3][i] == rows[2][i] for i in rows[3] if removed[i][1] == 0)
    items = [(r["item_id"], r["text"]) for r in C.table(spark, sf_dir, "benchmark").collect()]
    assert set(rows[4]) == {i for i, (_, n, _) in hits(rows[3].items(), items, 10).items() if n == 0}
    pieces = kept.collect()
    assert {r["doc_id"] for r in pieces} == set(rows[4])
    whole = {}
    for r in pieces:
        whole[r["doc_id"]] = whole.get(r["doc_id"], 0) + r["length"]
    assert all(whole[r["doc_id"]] == r["doc_tokens"] for r in pieces)


def test_no_documents_nulls_and_extra_columns(spark, sf_dir):
    text = " ".join(f"the word{i} and" for i in range(50))
    rows = [(1, text, "en", "a", 5, "x"), (None, text, "en", None, None, "y"), (2, None, None, None, None, None), (3, "", "en", "a", 0, "z"), (1, text, "en", "a", 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    for made in (docs, docs.limit(0)):
        kept = made
        for _, stage in corpus_pipeline.STAGES:
            kept = C.stored(stage(spark, kept, sf_dir), "test")
        assert {r["doc_id"] for r in kept.collect()} == ({1} if made is docs else set())


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
