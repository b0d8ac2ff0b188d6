"""Resolve the person printed on an invoice line to a timesheet person, tier by tier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.names import normalize_name, shares_anchor, sorted_key
from tallyweave.operators.best_match import best_match
from tallyweave.operators.scale import last_by
from tallyweave.session import cut_lineage

# Accept a similarity outright from the first, or from the second with a shared component.
STRONG_SIMILARITY = 80.0
ANCHORED_SIMILARITY = 65.0

EXACT, CROSSREF, FUZZY, UNRESOLVED = "exact", "crossref", "fuzzy", "unresolved"


def distinct_people(timesheets: DataFrame) -> DataFrame:
    """One row per timesheet person: canonical name, display name and place of first appearance."""
    return (
        timesheets.filter(F.col("contractor_name_normalized").isNotNull())
        .groupBy("contractor_name_normalized")
        .agg(
            F.min("entry_order").alias("first_seen"),
            F.min_by("contractor_name", "entry_order").alias("contractor_name"),
        )
        .withColumn("contractor_name", F.coalesce("contractor_name", "contractor_name_normalized"))
    )


def by_exact_name(names: DataFrame, people: DataFrame) -> DataFrame:
    """``names(norm)`` that are a timesheet person as they stand."""
    return names.join(
        people.select(F.col("contractor_name_normalized").alias("norm")), "norm"
    ).select("norm", F.col("norm").alias("resolved"), F.lit(EXACT).alias("method"))


def by_sorted_tokens(names: DataFrame, people: DataFrame) -> DataFrame:
    """Equal after sorting the tokens; of several people with one key the last to appear wins."""
    keys = last_by(
        people.select(
            sorted_key("contractor_name_normalized").alias("key"),
            F.col("contractor_name_normalized").alias("resolved"),
            "first_seen",
        ),
        ["key"],
        ["first_seen"],
    ).select("key", "resolved")
    return names.withColumn("key", sorted_key("norm")).join(keys, "key").select(
        "norm", "resolved", F.lit(EXACT).alias("method")
    )


def by_alias(names: DataFrame, people: DataFrame, aliases: DataFrame) -> DataFrame:
    """Through ``aliases(alias_id, invoice_name, timesheet_name)``, only when the target exists.

    Of several rows for one invoice name the last one counts.
    """
    table = last_by(
        aliases.filter(F.coalesce("invoice_name", F.lit("")) != "").select(
            normalize_name("invoice_name").alias("norm"),
            normalize_name("timesheet_name").alias("resolved"),
            "alias_id",
        ),
        ["norm"],
        ["alias_id"],
    ).select("norm", "resolved")
    targets = people.select(F.col("contractor_name_normalized").alias("resolved"))
    return names.join(table, "norm").join(targets, "resolved").select(
        "norm", "resolved", F.lit(CROSSREF).alias("method")
    )


def by_similarity(names: DataFrame, people: DataFrame) -> DataFrame:
    """Best-scoring person, accepted when strong, or anchored by a shared name component."""
    candidates = people.select(
        F.col("contractor_name_normalized").alias("candidate"), F.col("first_seen").alias("candidate_order")
    )
    best = best_match(names.select(F.col("norm").alias("query")), candidates, "name_similarity", ANCHORED_SIMILARITY)
    accepted = (F.col("score") >= STRONG_SIMILARITY) | shares_anchor("query", "candidate")
    return best.filter(accepted).select(
        F.col("query").alias("norm"), F.col("candidate").alias("resolved"), F.lit(FUZZY).alias("method")
    )


def resolve_names(names: DataFrame, timesheets: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """The whole cascade over canonical names ``names(norm)`` -> ``(norm, resolved, method)``.

    The equality tiers are joins on distinct names; only what they leave over reaches the similarity
    search. Invoice lines are never shuffled here.
    """
    people = distinct_people(timesheets)
    names = names.filter(F.col("norm").isNotNull()).select("norm").distinct()
    tiers = [by_exact_name(names, people), by_sorted_tokens(names, people)]
    if aliases is not None:
        tiers.append(by_alias(names, people, aliases))
    direct = names
    for i, tier in enumerate(tiers):
        direct = direct.join(tier.select("norm", F.struct("resolved", "method").alias(f"_tier{i}")), "norm", "left")
    direct = direct.select("norm", F.coalesce(*[f"_tier{i}" for i in range(len(tiers))]).alias("_hit"))
    found = direct.filter("_hit is not null").select("norm", "_hit.*")
    return found.unionByName(by_similarity(direct.filter("_hit is null").select("norm"), people))


def resolve_lines(lines: DataFrame, timesheets: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Lines with ``norm``, ``resolved`` and ``match_method`` (null / ``unresolved`` when nobody fits).

    The resolved names are written to the shared checkpoint folder: a small table whose similarity search
    is the expensive part, and which every later stage (and every retry after a lost executor) reuses.
    """
    lines = lines.withColumn("norm", normalize_name("contractor_name"))
    resolved = cut_lineage(resolve_names(lines.select("norm").distinct(), timesheets, aliases))
    return (
        lines.join(resolved, "norm", "left")
        .withColumn("match_method", F.coalesce("method", F.lit(UNRESOLVED)))
        .drop("method")
    )
