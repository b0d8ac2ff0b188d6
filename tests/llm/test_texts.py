import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from brute import hits
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyweave.llm import common as C
from tallyweave.llm import decontaminate, language_id, packing, queries, token_counts, toxicity

ODD = [
    None, "", " ", "  ", "\n\n a  b \n c   ", "a <|endoftext|> b<|endoftext|>", "<|startoftext|>x <|ENDOFTEXT|>", "İİ ΣΑΣ ǅ é ́x", "\x1ca\x1db\x85c\xa0d　e",
    "don't WE'LL 'S 12345 3.14 ½ ²", "x" * 3000, "ab" * 2000 + " " + "é漢" * 500, "日本語 テキスト 🙂🙂", "a\r\nb\tc \t d", " x   y", "tail  ", "   lead",
]


def odd_texts(n=150):
    rng = random.Random(9)
    parts = ["the", "The", " ", "  ", "\n", "\t", "'s", "'t", "é", "漢", "1", "22", "...", "!", "<|endoftext|>", "\xa0", "\x1f", "İ", "́", "ß", "word", "tion", "#", "_"]
    return ODD + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def libraries():
    return {n: Tokenizer.from_file(public_tokenizers.path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json")}


def test_counts_are_the_library_s(frame, libraries, documents):
    texts = odd_texts() + [r["text"] for r in documents.values()]
    got = {r["doc_id"]: r for r in token_counts.count_tokens(frame(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        assert (got[i]["n_bytes"], got[i]["n_tokens"]) == (len((t or "").encode()), len(libraries["byte_bpe_50k.json"].encode(t or "", add_special_tokens=False).ids)), repr(t)
    assert token_counts.count_tokens(frame([])).collect() == []


def test_packing_holds_every_id_once(frame, libraries, documents):
    texts = odd_texts() + [r["text"] for r in documents.values()]
    rows = packing.pack_documents(frame([*enumerate(texts), (0, "again"), (None, "no id")]), max_tokens=2048).collect()
    assert sorted(r["sequence_id"] for r in rows) == list(range(len(rows)))
    lengths = [r["length"] for r in sorted(rows, key=lambda r: r["sequence_id"])]
    assert lengths == sorted(lengths, reverse=True) and all(n & (n - 1) == 0 and n <= 2048 for n in lengths) and all(r["offset"] == 0 for r in rows)
    for i, t in enumerate(texts):
        if i == 0:
            continue
        ids = np.array([*libraries["word_bpe_49k.json"].encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        assert [r["start"] for r in mine] == np.cumsum([0, *(r["length"] for r in mine)])[:-1].tolist() and sum(r["length"] for r in mine) == len(ids), repr(t)
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) and r["doc_tokens"] == len(ids) for r in mine), repr(t)
    assert packing.pack_documents(frame([])).collect() == []


def test_pieces():
    for n in (1, 2, 3, 7, 8, 63, 64, 65, 1000):
        pieces = packing.binary_pieces(n, 64)
        assert sum(x for _, x in pieces) == n and len({x for _, x in pieces if x < 64}) == len([x for _, x in pieces if x < 64])


def test_benchmark_words(frame, spark, sf_dir, documents):
    rows = [(i, r["text"]) for i, r in documents.items()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows += [(1000, None), (1001, ""), (1002, "a b a b a"), (1003, "A\x00b, A"), (1004, "é-É x"), (1005, "ab a bab"), (1006, "long " * 20_000 + "a b a")]
    items += [(900, "a b a"), (901, "A-B"), (902, "É x"), (903, None), (904, "..."), (900, "again here")]
    for slice_bytes in (decontaminate.SLICE_BYTES, 2000):
        got = decontaminate.find_benchmark_text(frame(rows), frame(items, "item_id long, text string"), 10, slice_bytes).collect()
        assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in got} == hits(rows, items, 10)
    by_id = {r["doc_id"]: r for r in got}
    assert [tuple(s) for s in by_id[1003]["spans"]] == [(0, 6)] and by_id[1005]["spans"] == []
    nothing = decontaminate.find_benchmark_text(frame([(1, "a b")]), frame([], "item_id long, text string")).collect()
    assert [(r["n_words"], r["n_hit"]) for r in nothing] == [(2, 0)] and decontaminate.find_benchmark_text(frame([]), frame(items, "item_id long, text string")).collect() == []


def test_languages(spark, documents):
    sf_dir = "/root/testdata/sf0.01"
    got = queries.op5_language_id(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(held) > 100 and sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(frame):
    rows = [(1, "aaa bbb", "x"), (2, "ccc ddd", "y"), (3, None, "x"), (4, "123 ...", "x"), (5, "AAA", None), (6, "ccc " * 30_000, None), (7, "", "y"), (1, "aaa bbb", "x")]
    made = frame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify_languages(made, F.col("doc_id") < 5, "doc_id").collect()}
    assert got[3] == got[4] == got[7] == ("und", 0.0) and got[5][0] == "x" and got[6][0] == "y" and len(got) == 7
    assert {r["lang_pred"] for r in language_id.identify_languages(made, F.lit(False), "doc_id").collect()} == {"und"}
    assert language_id.identify_languages(made.limit(0), F.lit(True), "doc_id").collect() == []


def test_language_ties_go_to_the_first_name(frame):
    rows = [(1, "abc abc", "x"), (2, "abc abc", "b"), (3, "abc", None), (4, "qqq", None)]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify_languages(frame(rows, "doc_id long, text string, lang string"), F.col("doc_id") < 3, "doc_id").collect()}
    assert got[3][0] == got[4][0] == "b" and got[3][1] == pytest.approx(0.5)


def test_names_of_kept_columns(frame):
    rows = [(1, "abc abc", "x"), (2, "ddd", "y")]
    made = frame(rows, "doc_id long, text string, lang string").selectExpr("*", "'a' as __text", "'b' as keep_0")
    got = language_id.identify_languages(made, F.lit(True), "__text", "keep_0", "doc_id")
    assert got.columns == ["__text", "keep_0", "doc_id", "lang_pred", "score"] and sorted(r["lang_pred"] for r in got.collect()) == ["x", "y"]


def test_long_pre_tokens_merge_in_the_same_order():
    counter, rng = token_counts.counter("byte_bpe_50k.json"), random.Random(1)
    tokens = [b"ab" * 300, b"a" * 1000, b"the" * 200, "é漢".encode() * 300, b"=-" * 400] + [bytes(rng.choice(b"abcdenrtsio") for _ in range(rng.randrange(2, 400))) for _ in range(200)]
    for token in tokens:
        assert counter._merged_long(token) == counter.merged(token)
    # A million bytes without a break.
    assert counter.merged(b"ab" * 500_000) == 500_000


def test_benchmark_words_of_repeated_rows(frame):
    rows, items = [(1, "x a b c y"), (1, "x a b c y"), (None, "a b c"), (2, "")], [(5, "a b c"), (5, "a b c"), (None, "b c")]
    got = decontaminate.find_benchmark_text(frame(rows), frame(items, "item_id long, text string"), 10).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"]) for r in got) == [(0, 3, 3), (1, 5, 3), (1, 5, 3), (2, 0, 0)]


def test_toxicity(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = queries.op10_toxicity(spark, sf_dir).join(labels, "doc_id").where("held_out").collect()
    hit = sum(r["predicted"] and r["toxic"] for r in got)
    assert hit / max(1, sum(r["predicted"] for r in got)) > 0.85 and hit / sum(r["toxic"] for r in got) > 0.8


def test_toxicity_counts_every_labelled_text_once(spark, frame):
    """Copies, copies in other case, texts without a label, repeated labels: slots by label are those of all distinct labelled texts."""
    rng = random.Random(2)
    words = ["".join(rng.choice("bcdfghjklm") for _ in range(7)) for _ in range(1500)]
    texts = {i: " ".join(rng.sample(words, 30)) + (" alphax" if i % 5 == 0 else "") for i in range(300)}
    rows = [*texts.items(), (300, texts[0].upper()), (301, texts[1]), (302, None), (None, "nobody")]
    marks = [(i, int("alphax" in t)) for i, t in texts.items() if i % 4] + [(300, 0), (301, int("alphax" in texts[1])), (302, 1), (1, 0), (999, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    total, hit = toxicity._slot_counts(toxicity._examples(frame(rows), labels, F.lit(True)))
    label = {}
    for i, t in marks:
        label[i] = max(label.get(i, 0), t)
    import pyarrow as pa

    seen, expected = set(), {}
    for i, text in rows:
        if i in label and text is not None:
            _, slots, _ = toxicity._features(pa.chunked_array([pa.array([text])]))
            if (label[i], tuple(slots)) not in seen:
                seen.add((label[i], tuple(slots)))
                for s in slots.tolist():
                    n, t = expected.get(s, (0, 0))
                    expected[s] = (n + 1, t + label[i])
    expected = {s: v for s, v in expected.items() if v[0] >= toxicity.SUPPORT}
    assert {int(s): (int(total[s]), int(hit[s])) for s in np.flatnonzero(total)} == expected


def test_label_model_sums_add_up():
    """The sums of parts are the sums of the whole, and rows that stand for several texts count as often."""
    rng = np.random.default_rng(3)
    votes = (rng.random((400, 9)) < 0.3).astype(float)
    model = toxicity.LabelModel(7, 3, 0.2)
    for _ in range(4):
        whole = model.sums(votes)
        assert np.allclose(whole, model.sums(votes[:150]) + model.sums(votes[150:]))
        distinct, n = np.unique(votes, axis=0, return_counts=True)
        assert np.allclose(whole, toxicity._weighted(model, distinct, n.astype(float)))
        model.update(whole)


def test_toxicity_edges(spark, frame):
    rng = random.Random(4)
    rows = [(i, " ".join("".join(rng.choice("aeiklmnrst") for _ in range(3)) for _ in range(20)) + (" nasty" if i % 3 == 0 else " kind")) for i in range(60)] + [(100, None), (101, ""), (102, "nasty " * 20_000), (103, "Nasty"), (0, "dup nasty")]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(1, None), (2, 7), (None, 1)], "doc_id long, toxic int")
    scored = toxicity.score_toxicity(frame(rows), labels, F.lit(True), "doc_id").collect()
    got = {r["doc_id"]: r["score"] for r in scored}
    assert len(scored) == len(rows) and all(0 <= s <= 1 for s in got.values())
    assert got[103] > 0.5 and got[102] > 0.5 and got[100] == got[101] and got[1] < 0.3
    assert all(r["score"] < 0.01 for r in toxicity.score_toxicity(frame(rows), labels.limit(0), F.lit(True), "doc_id").collect())
    assert toxicity.score_toxicity(frame([]), labels, F.lit(True), "doc_id").collect() == []


def test_label_model_sees_through_noise():
    """Three kinds of texts, each with voters of its own, and labels of which a tenth are wrong."""
    rng = np.random.default_rng(0)
    true, kind = rng.random(3000) < 0.2, rng.integers(0, 3, 3000)
    votes = np.stack([(rng.random(3000) < np.where(true & (kind == v % 3), 0.5, 0.002)) for v in range(24)], axis=1)
    votes = np.concatenate([votes, ~votes.any(axis=1, keepdims=True)], axis=1)
    noisy = np.where(rng.random(3000) < 0.1, ~true, true).astype(int)
    posterior = toxicity.fit_label_model(votes, noisy, 24)["posterior"]
    right = ((posterior > 0.5) == true).mean()
    assert right > 0.93 and right > (noisy == true).mean()


def test_fold(spark):
    rows = spark.range(50).select("id", C.fold("id", 7).alias("f"), C.fold(F.lit(None), 7).alias("none")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 7 and r["none"] == 0 for r in rows)
