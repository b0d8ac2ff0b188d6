"""Person names: display order, canonical matching key, order-free key, shared components."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyweave.functions.strings import blank_to_null, col, strip

# Shortest token / contained name that counts as a shared name component.
ANCHOR_TOKEN_LENGTH = 3
ANCHOR_NAME_LENGTH = 6


def first_last(name: Column | str) -> Column:
    """``Last, First`` -> ``First Last``; names without a comma pass through."""
    return strip(F.regexp_replace(blank_to_null(name), r"(?s)^\s*([^,]*?)\s*,\s*(.*?)\s*$", "$2 $1"))


def last_first(name: Column | str) -> Column:
    """``First Middle Last`` -> ``Last, First Middle``; a single token is unchanged."""
    flipped = F.regexp_replace(col(name), r"(?s)^\s*(.*\S)\s+(\S+)\s*$", "$2, $1")
    return F.regexp_replace(flipped, r"\s+", " ")


def normalize_name(name: Column | str) -> Column:
    """Canonical key: flipped to first-last, lower case, letters and digits only, single blanks."""
    kept = F.regexp_replace(F.lower(first_last(name)), r"(?U)[^a-z0-9\s]", "")
    return blank_to_null(strip(F.regexp_replace(kept, r"(?U)\s+", " ")))


def sorted_key(normalized: Column | str) -> Column:
    """Order-free key: the tokens of a canonical name, sorted."""
    return F.array_join(F.array_sort(F.split(col(normalized), " ")), " ")


def despaced(normalized: Column | str) -> Column:
    return F.replace(col(normalized), F.lit(" "), F.lit(""))


def shared_tokens(a: Column | str, b: Column | str) -> Column:
    """Distinct tokens of useful length that two canonical names have in common."""

    def long_tokens(value):
        return F.filter(F.split(col(value), " "), lambda t: F.length(t) >= ANCHOR_TOKEN_LENGTH)

    return F.array_intersect(long_tokens(a), long_tokens(b))


def shares_anchor(a: Column | str, b: Column | str) -> Column:
    """True when two names share a whole token, or one despaced name lies inside the other."""
    x, y = despaced(a), despaced(b)
    contained = (F.least(F.length(x), F.length(y)) >= ANCHOR_NAME_LENGTH) & (
        F.when(F.length(x) <= F.length(y), F.contains(y, x)).otherwise(F.contains(x, y))
    )
    return (F.size(shared_tokens(a, b)) > 0) | contained
