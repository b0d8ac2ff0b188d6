"""How the filters of a corpus overlap: what each removes in every order, and its Shapley share of what all of them remove.

A document's failures are a bit mask. For a coalition S of filters, v(S) is the number of documents that fail at least one of S; it is the
game whose values all reports follow from. Only the table (part, mask) of counts is gathered, at most 2^n rows a part. On it, the
Hart-Mas-Colell potential is computed coalition by coalition, P(S) = (v(S) + sum of P(S without i) for i in S) / |S|; the Shapley value of a
filter is the potential of all filters minus that of all but this one. What a filter removes after others is a difference of two coalitions.
Potentials are held as n! * P(S), which are whole numbers.

Nothing native is left for Python: words, masks, counts and potentials are column expressions.

Documents, also repeated rows, count row by row. A null text is the empty text, a null part the empty string. A row without an id has no
labels and comes after all ids when copies are judged. Equal texts under one id are no copies of each other. Texts are equal if their
SHA-256 are. A document's label is 1 if any of its label rows says 1. An empty table has no parts, hence no rows.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm.common import NO_ID

#: n! orders are reported.
MOST_FILTERS = 6


def space_words(text: Column) -> Column:
    """Maximal runs of characters other than space and \\x09-\\x0D."""
    return F.array_remove(F.split(F.translate(text, "\t\n\x0b\f\r", " " * 5), " "), "")


def text_failures(text: Column) -> dict[str, Column]:
    """What is wrong with a text: A too short, B repetitive, C in capitals, D with symbols of code."""
    words = space_words(text)
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    return {"A": n < 200, "B": 100 * distinct < 50 * n, "C": 100 * capitals > 3 * F.length(text).cast("long"), "D": text.rlike("[#$%&*|]")}


def _labels(labels: DataFrame) -> DataFrame:
    known = labels.select("doc_id", "quality", "toxic").where("doc_id IS NOT NULL")
    return known.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))


def failure_counts(docs: DataFrame, labels: DataFrame, failures: dict[str, Column], part: Column, copies: bool = True) -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters they fail; bit i is the i-th of ``failures``, the last bit a copied text.

    ``failures`` are conditions on the column ``text``. A text is a copy if a smaller doc_id has the same.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    bits = sum((F.when(failed, F.lit(1 << i)).otherwise(F.lit(0)) for i, failed in enumerate(failures.values())), F.lit(0))
    digest = F.unhex(F.sha2(text, 256)) if copies else F.lit(None).cast("binary")
    rows = docs.select("doc_id", F.coalesce(part, F.lit("")).alias("part"), text.alias("text")).select("doc_id", "part", bits.alias("mask"), digest.alias("digest"))
    # A row without an id has no labels; kept out of the join, such rows are no hot key.
    labelled = rows.where("doc_id IS NOT NULL").join(_labels(labels), "doc_id", "left")
    flags = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("good", "toxic")]
    labelled = labelled.select("doc_id", "part", "mask", "digest", *flags)
    anonymous = rows.where("doc_id IS NULL").select(F.lit(NO_ID).alias("doc_id"), "part", "mask", "digest", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    rows = labelled.unionByName(anonymous)
    kind = ["part", "mask", "good", "toxic"]
    if copies:
        # Rows of one text shrink to one per id, then one per kind, before they meet: a text with a third of all rows is a few rows by then.
        per_id = rows.groupBy("digest", "doc_id", *kind).agg(F.count(F.lit(1)).alias("n"))
        per_kind = per_id.groupBy("digest", *kind).agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("first"))
        least = F.min("first.doc_id").over(Window.partitionBy("digest"))
        split = per_kind.withColumn("originals", F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(F.lit(0)))
        copied = F.col("mask") + F.lit(1 << len(failures))
        both = F.array(F.struct(F.col("mask").alias("mask"), F.col("originals").alias("n")), F.struct(copied.alias("mask"), (F.col("n") - F.col("originals")).alias("n")))
        rows = split.select("part", "good", "toxic", F.inline(both)).where("n > 0")
    else:
        rows = rows.select(*kind, F.lit(1).alias("n"))
    return rows.groupBy("part", "mask").agg(
        F.sum("n").cast("long").alias("n"), F.sum(F.col("n") * F.col("good")).cast("long").alias("good"), F.sum(F.col("n") * F.col("toxic")).cast("long").alias("toxic")
    )


def coalition_values(counts: DataFrame, n_filters: int) -> DataFrame:
    """One row a part: size, and arrays by coalition (a bit mask) of the documents, good and toxic ones that fail any filter of it."""

    def removed(column: str) -> Column:
        sums = [F.sum(F.when(F.col("mask").bitwiseAND(s) != 0, F.col(column)).otherwise(F.lit(0))) for s in range(1 << n_filters)]
        return F.array(*sums)

    return counts.groupBy("part").agg(F.sum("n").alias("size"), *(removed(c).alias(f"v_{c}") for c in ("n", "good", "toxic")))


def potential(value: Column, n_filters: int) -> Column:
    """n! times the potential of every coalition, an array by bit mask; ``value`` holds the game's values in the same order.

    A coalition's number is larger than that of all it contains, so one pass in numeric order is the recursion.
    """
    members = F.array(*(F.lit(1 << i) for i in range(n_filters)))

    def step(found: Column, s: Column) -> Column:
        inside = F.filter(members, lambda m: s.bitwiseAND(m) != 0)
        smaller = F.aggregate(inside, F.lit(0).cast("long"), lambda total, m: total + F.get(found, s.bitwiseXOR(m)))
        quotient = F.call_function("div", F.lit(factorial(n_filters)).cast("long") * F.get(value, s) + smaller, F.bit_count(s).cast("long"))
        return F.array_append(found, quotient)

    return F.aggregate(F.sequence(F.lit(1), F.lit((1 << n_filters) - 1)), F.array(F.lit(0).cast("long")), step)


def order_steps(letters: list[str]) -> Column:
    """Every order of the filters, step by step, with the coalition applied before."""
    found = []
    for order in permutations(range(len(letters))):
        before = 0
        for step, i in enumerate(order):
            found.append(("".join(letters[j] for j in order), step + 1, i, before))
            before |= 1 << i
    schema = "array<struct<filter_order:string,step:int,i:int,before:int>>"
    return F.from_json(F.lit("[" + ",".join(f'{{"filter_order":"{o}","step":{s},"i":{i},"before":{b}}}' for o, s, i, b in found) + "]"), schema)


def audit_filters(docs: DataFrame, labels: DataFrame, failures: dict[str, Column], part: Column, copies: str | None = "E") -> DataFrame:
    """One row per part, order of the filters and step, see the module; ``copies`` names the filter of copied texts, None: there is none.

    ``shapley`` is the filter's Shapley value times n!: what it removes, summed over all orders.
    """
    letters = [*failures, *([copies] if copies else [])]
    n = len(letters)
    if not 0 < n <= MOST_FILTERS:
        raise ValueError(f"one to {MOST_FILTERS} filters")
    everything = (1 << n) - 1
    games = coalition_values(failure_counts(docs, labels, failures, part, bool(copies)), n).withColumn("p", potential(F.col("v_n"), n))
    rows = games.select("part", "size", "v_n", "v_good", "v_toxic", "p", F.inline(order_steps(letters)))

    def of(array: str, coalition: Column | int) -> Column:
        return F.get(F.col(array), F.lit(coalition) if isinstance(coalition, int) else coalition)

    bit = F.element_at(F.array(*(F.lit(1 << i) for i in range(n))), F.col("i") + 1)
    before, after, others = F.col("before"), F.col("before").bitwiseOR(bit), F.lit(everything).bitwiseXOR(bit)
    taken = of("v_n", after) - of("v_n", before)
    return rows.select(
        "part",
        "filter_order",
        "step",
        (F.col("size") - of("v_n", after)).alias("kept"),
        taken.alias("removed"),
        (of("v_n", bit) - taken).alias("redundant"),
        (of("v_n", everything) - of("v_n", others)).alias("unique_fails"),
        (of("v_good", after) - of("v_good", before)).alias("good_lost"),
        (of("v_toxic", after) - of("v_toxic", before)).alias("toxic_lost"),
        (of("p", everything) - of("p", others)).alias("shapley"),
    )
