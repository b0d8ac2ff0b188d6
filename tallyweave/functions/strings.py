"""Small string helpers shared by the other function modules."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: Column | str) -> Column:
    """Remove leading and trailing whitespace of every kind (``trim`` only removes blanks)."""
    return F.regexp_replace(col(value), r"^\s+|\s+$", "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    Columns are trees, so using one several times copies it; a long cascade over a computed text would
    outgrow the code generator. Binding it as a lambda variable keeps the tree linear.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def kept_once(value: Column, condition: Callable[[Column], Column]) -> Column:
    """A generator that yields ``value`` where the condition holds, and no row otherwise.

    A filter on a computed column is pushed below the projection and computes the column again; a generator
    computes it once, which matters for long text cascades.
    """
    return F.explode(F.filter(F.array(value), condition))


def blank_to_null(value: Column | str) -> Column:
    return F.nullif(col(value), F.lit(""))


def extract(text: Column | str, pattern: str, group: int = 1) -> Column:
    """First match of one group, null (not ``''``) when the pattern or the group does not match."""
    return blank_to_null(F.regexp_extract(col(text), pattern, group))


GROUP_MARK = "\u0001"


def groups(match: Column | str, pattern: str, count: int) -> Column:
    """All groups of a text that the pattern matches as a whole, from one pass; absent groups are blank."""
    marked = F.regexp_replace(col(match), pattern, GROUP_MARK.join(f"${i}" for i in range(1, count + 1)))
    return F.split(marked, GROUP_MARK, -1)


def text_lines(text: Column | str) -> Column:
    """The lines of a document as an array, whatever line ending it uses."""
    return F.split(col(text), r"\r\n|\r|\n")


def collapse(value: Column | str) -> Column:
    return strip(F.regexp_replace(col(value), r"\s+", " "))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
