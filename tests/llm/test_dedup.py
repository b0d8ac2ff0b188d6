import random

import numpy as np
import pytest
from brute import repeated_bytes, repeated_words
from pyspark.sql import functions as F

from tallyweave.llm import substring_dedup as S
from tallyweave.llm import suffix_dedup as B
from tallyweave.llm.suffix_array import permuted_common_prefixes, suffix_array


@pytest.mark.parametrize("letters", [1, 2, 3, 200])
def test_suffix_array(letters):
    rng = random.Random(letters)
    for _ in range(60):
        data = np.array([rng.randint(0, letters) for _ in range(rng.randint(1, 60))], np.uint8)
        raw, sa = data.tobytes(), suffix_array(data)
        assert sa.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
        shared = permuted_common_prefixes(data, sa)
        for a, b in zip(sa[:-1], sa[1:], strict=True):
            n = 0
            while max(a, b) + n < len(raw) and raw[a + n] == raw[b + n]:
                n += 1
            assert shared[b] == n


def test_suffix_array_of_long_text():
    rng = np.random.default_rng(5)
    piece = rng.integers(97, 100, 3000, dtype=np.uint8)
    data = np.concatenate([piece, rng.integers(97, 123, 40_000, dtype=np.uint8), piece, np.full(5000, 97, np.uint8)])
    sa, raw = suffix_array(data), data.tobytes()
    assert sorted(sa.tolist()) == list(range(len(raw)))
    assert all(raw[a:] < raw[b:] for a, b in zip(sa[:-1:13].tolist(), sa[1::13].tolist(), strict=False))


def _rows(alphabet, join=""):
    rng = random.Random(7)
    rows = [(i, join.join(rng.choice(alphabet) for _ in range(rng.choice([0, 3, 20, 60, 300])))) for i in range(50)]
    rows += [(100 + i, rows[i % 5 + 10][1]) for i in range(20)]
    return [*rows, (200, join.join("a" * 300)), (201, join.join("ab" * 200)), (202, None), (203, ""), (-5, rows[20][1])]


@pytest.mark.parametrize(("window", "anchor", "part"), [(6, None, 4096), (7, 4, 2), (10, 10, 1), (1, 1, 3)])
def test_strings(frame, monkeypatch, window, anchor, part):
    monkeypatch.setattr(B, "BLOCK_BYTES", 2000)
    rows = _rows("abé")
    got = B.remove_repeated_strings(frame(rows), window, anchor, part).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == repeated_bytes(rows, window)
    assert all(sum(s["length"] for s in r["spans"]) == r["n_removed"] for r in got)


def test_strings_on_documents(spark, sf_dir, documents):
    rows = [(i, r["text"]) for i, r in documents.items()]
    got = B.remove_repeated_strings(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == repeated_bytes(rows, 100)


def test_widely_shared_passage(frame, monkeypatch):
    """A third of all documents quote one passage between words of their own, in several parts of its anchors."""
    monkeypatch.setattr(B, "BLOCK_BYTES", 20_000)
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = " ".join(word() for _ in range(30))
    rows = [(i, " ".join(word() for _ in range(20)) + (f" {passage} " if i % 3 == 0 else " ") + " ".join(word() for _ in range(20))) for i in range(300)]
    got = B.remove_repeated_strings(frame(rows), 60, part_runs=16).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == repeated_bytes(rows, 60)


@pytest.mark.parametrize(("window", "shortest"), [(20, 5), (8, 1), (7, 2), (3, 5), (1, 1)])
def test_words(frame, monkeypatch, window, shortest):
    monkeypatch.setattr(S, "BLOCK_BYTES", 1500)
    rows = _rows(["a", "b", "é"], " ") + [(300, "x\x0by\x85z\n\n a b a b")]
    got = S.remove_repeated_windows(frame(rows), window, shortest).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == repeated_words(rows, window)


def test_words_on_documents(spark, sf_dir, documents):
    rows = [(i, r["text"]) for i, r in documents.items()]
    got = S.remove_repeated_windows(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == repeated_words(rows, 20)


def test_lengths():
    assert S.doubling_lengths(20) == [5, 10, 20] and S.doubling_lengths(50) == [4, 7, 13, 25, 50] and S.doubling_lengths(3) == [3]


@pytest.mark.parametrize("remove", [S.remove_repeated_windows, B.remove_repeated_strings])
def test_repeated_rows_nulls_and_no_rows(frame, remove):
    text = " ".join(f"word{i}" for i in range(60))
    rows = remove(frame([(1, text), (1, text), (None, text), (None, text), (None, None), (2, "")])).collect()
    assert len(rows) == 6 and sum(r["n_removed"] == 0 and bool(r["kept_text"]) for r in rows) == 1
    assert [r["doc_id"] for r in rows if r["kept_text"]] == [1]
    assert remove(frame([])).collect() == []


def test_kept_columns_and_whole_characters(spark):
    text = "é" * 80
    made = spark.createDataFrame([(1, text, "x"), (2, f"a{text}", "y")], "doc_id long, text string, block string")
    got = {r["doc_id"]: r for r in B.remove_repeated_strings(made, 100, keep=("block",)).collect()}
    assert got[2]["block"] == "y" and got[2]["kept_text"] == "a" and got[1]["kept_text"].strip("é") == ""
    assert B.remove_repeated_strings(made, 100).select(F.sum("n_bytes")).first()[0] == 321
