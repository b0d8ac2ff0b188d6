"""Number text to numbers, exact sums, and the cell formats of the purchase import."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyweave.functions.strings import col, let, strip

# Sums of hours and money are decimal, so they do not depend on shuffle order.
EXACT = "decimal(28,6)"
#: Whole numbers, and numbers with a point behind all commas: read as they are, which most printed numbers are.
PLAIN_NUMBER = r"^[0-9]+(?:(?:,[0-9]+)*\.[0-9]+)?\z"


def clean_number(text: Column | str) -> Column:
    """US or European number text as a double: ``$2,400``, ``8 3.00``, ``180 Hrs``, ``90 400,00``, ``1.234,56``."""
    def read(value):
        kept = F.replace(strip(F.regexp_replace(value, r"[^0-9.,\s]", "")), F.lit(" "), F.lit(""))
        return F.when(value.rlike(PLAIN_NUMBER), F.replace(value, F.lit(","), F.lit("")).try_cast("double")).otherwise(let(kept, _number))

    return let(col(text), read)


def _number(digits: Column) -> Column:
    no_commas = F.replace(digits, F.lit(","), F.lit(""))
    point_commas = F.replace(digits, F.lit(","), F.lit("."))
    european = F.replace(F.replace(digits, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    plain = (
        # Both separators: the one that comes last is the decimal point.
        F.when(digits.rlike(r"\..*,[^.]*$"), european)
        .when(digits.rlike(r",.*\."), no_commas)
        # Only a comma: a decimal point when one or two digits follow it.
        .when(digits.rlike(r",\d{1,2}$"), point_commas)
        .otherwise(no_commas)
    )
    # Of several dots the first is the decimal point.
    return F.regexp_replace(plain, r"(?<=\.)([^.]*)\.", "$1").try_cast("double")


def exact(value: Column | str) -> Column:
    return col(value).cast(EXACT)


def exact_sum(value: Column | str) -> Column:
    """Order-independent sum; null inputs count as zero, so an empty group sums to zero."""
    return F.sum(F.coalesce(exact(value), F.lit(0).cast(EXACT)))


def cents(value: Column) -> Column:
    """Rounded to two places (half up) and back to double, the type money has at the edges."""
    return F.round(value.cast(EXACT), 2).cast("double")


def line_weight(amount: Column | str, hours: Column | str, rate: Column | str) -> Column:
    """Dollar weight of a line: the amount, else hours x rate, else zero."""
    return F.coalesce(col(amount), col(hours) * col(rate), F.lit(0.0))


def date_cell(value: Column) -> Column:
    return F.coalesce(F.date_format(value, "MM/dd/yyyy"), F.lit(""))


def money_cell(value: Column) -> Column:
    return F.coalesce(value.cast("decimal(28,2)").cast("string"), F.lit(""))


def number_cell(value: Column) -> Column:
    """Hours: a whole number loses its ``.0``, real decimals stay."""
    exact_text = value.cast(EXACT).cast("string")
    return F.coalesce(F.regexp_replace(exact_text, r"\.?0+$", ""), F.lit(""))


def hours_text(value: Column) -> Column:
    """Hours inside a sentence: at most two decimals, at least one (``80.0``, ``7.25``)."""
    return F.regexp_replace(value.cast("decimal(28,2)").cast("string"), r"0$", "")


def compact_money(value: Column) -> Column:
    """``$1.2M`` / ``$34K`` / ``$567``."""
    magnitude = F.abs(value)

    def shown(number, pattern, suffix):
        return F.concat(F.lit("$"), F.format_string(pattern, number), F.lit(suffix))

    return (
        F.when(value.isNull(), F.lit(None).cast("string"))
        .when(magnitude >= 1_000_000, shown(F.round(value / 1_000_000, 1), "%.1f", "M"))
        .when(magnitude >= 1_000, shown(F.round(value / 1_000, 0), "%.0f", "K"))
        .otherwise(shown(F.round(value, 0), "%,.0f", ""))
    )


