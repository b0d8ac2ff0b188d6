import re
from itertools import permutations

import pytest
from brute import SPACE_WORD
from pyspark.sql import functions as F

from tallyweave.llm import filter_audit
from tallyweave.llm.filter_audit import audit_filters, text_failures

COLUMNS = "doc_id long, text string, lang string"
LABELS = "doc_id long, quality int, toxic int"
REPORT = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def failures(rows):
    """Per row: part, failed letters."""
    out = []
    for doc_id, text, lang in rows:
        text = text or ""
        words, failed = SPACE_WORD.findall(text), set()
        failed |= {"A"} if len(words) < 200 else set()
        failed |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        failed |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else set()
        failed |= {"D"} if re.search("[#$%&*|]", text) else set()
        order = (1, 0) if doc_id is None else (0, doc_id)
        earlier = any((t or "") == text and ((1, 0) if i is None else (0, i)) < order for i, t, _ in rows)
        failed |= {"E"} if earlier else set()
        out.append((lang or "", failed))
    return out


def audit(rows, labels):
    """{(part, order, step): (kept, removed, redundant, unique, good, toxic, shapley)}, filter after filter over the rows."""
    failed = failures(rows)
    good = {i for i, quality, _ in labels if i is not None and quality == 1}
    toxic = {i for i, _, toxic in labels if i is not None and toxic == 1}
    steps, shares = {}, {}
    for part in {p for p, _ in failed}:
        mine = [(r[0], f) for r, (p, f) in zip(rows, failed, strict=True) if p == part]
        for order in permutations("ABCDE"):
            left, gone = mine, []
            for step, letter in enumerate(order, 1):
                removed = [x for x in left if letter in x[1]]
                left = [x for x in left if letter not in x[1]]
                steps[part, "".join(order), step] = (
                    len(left), len(removed), sum(letter in f for _, f in gone), sum(f == {letter} for _, f in mine),
                    sum(i in good for i, _ in removed), sum(i in toxic for i, _ in removed),
                )
                gone += removed
                shares[part, letter] = shares.get((part, letter), 0) + len(removed)
    return {k: (*v, shares[k[0], k[1][k[2] - 1]]) for k, v in steps.items()}


def reported(frame):
    rows = frame.collect()
    got = {(r["part"], r["filter_order"], r["step"]): (*(r[c] for c in REPORT), r["shapley"]) for r in rows}
    assert len(got) == len(rows)
    return got


def ask(docs, labels):
    return reported(audit_filters(docs, labels, text_failures(F.col("text")), F.col("lang")))


def test_whole_table(spark, sf_dir, documents):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in documents.values()]
    got = ask(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels)
    assert got == audit(rows, [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])


def test_odd_rows(frame):
    many = " ".join(f"w{i}" for i in range(200))
    rows = [
        (1, None, None), (2, "", "x"), (3, "", None), (3, "", None), (3, "", "x"), (None, "", "x"), (None, many, "x"), (None, many, ""), (None, None, None), (4, many, "x"), (5, many, "y"),
        (4, many, "x"), (6, "A" + many, "y"), (7, many + " a|b", "y"), (8, "a\x0bb\x0cb \r\n" * 150, "x"), (9, "é" * 97 + "ABC", "x"), (10, "é" * 96 + "ABCD", "x"), (11, "a\xa0b " * 300, "x"),
        (12, "long Word# " * 30_000, "y"), (13, "long Word# " * 30_000, "z"),
    ]
    labels = [(1, 1, 0), (3, 0, 1), (3, 1, None), (4, 1, 1), (5, None, None), (12, 0, 1), (None, 1, 1), (99, 1, 1), (13, 1, 0)]
    made, marks = frame(rows, COLUMNS), frame(labels, LABELS)
    assert ask(made, marks) == audit(rows, labels)
    assert ask(made.limit(0), marks) == {} and ask(made, marks.limit(0)) == audit(rows, [])


def test_one_text_on_most_rows(frame):
    rows = [(i, "same" if i % 3 else f"text {i}", "xy"[i % 2]) for i in range(3000)]
    got = ask(frame(rows, COLUMNS), frame([], LABELS))
    # The first of them, id 1, is in part y.
    assert got["x", "EABCD", 1][:2] == (500, 1000) and got["y", "EABCD", 1][:2] == (501, 999)


def test_potential_is_the_shapley_value(spark):
    values = [0, 3, 5, 9, 4, 7, 8, 12]
    q = spark.range(1).select(filter_audit.potential(F.array(*(F.lit(v).cast("long") for v in values)), 3).alias("q")).first()["q"]
    for i in range(3):
        marginal = 0
        for order in permutations(range(3)):
            before = sum(1 << j for j in order[: order.index(i)])
            marginal += values[before | 1 << i] - values[before]
        assert q[7] - q[7 ^ 1 << i] == marginal


def test_other_filters(frame):
    docs = frame([(1, "ab", "x"), (2, "a", "x"), (3, "b", "x"), (4, "c", "x")], COLUMNS)
    chosen = {"P": F.col("text").contains("a"), "Q": F.col("text").contains("b")}
    got = reported(audit_filters(docs, frame([], LABELS), chosen, F.lit("all"), copies=None))
    assert got["all", "PQ", 2] == (1, 1, 1, 1, 0, 0, 3) and got["all", "QP", 1] == (2, 2, 0, 1, 0, 0, 3)
    with pytest.raises(ValueError):
        audit_filters(docs, docs, {str(i): F.lit(True) for i in range(7)}, F.lit(""))
