"""Date text to dates. Parsing is routed by shape, so ANSI mode never meets a format it must reject."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyweave.functions.strings import blank_to_null, col, let, strip

# Month names accepted in documents (full and short forms).
MONTHS = (
    "January|February|March|April|May|June|July|August|September|October|November|December"
    "|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec"
)
_MONTH_STARTS = "janfebmaraprmayjunjulaugsepoctnovdec"
_TIME_TAIL = r"(?:[T ]\d{1,2}:\d{2}.*)?"
_ISO = rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}}){_TIME_TAIL}$"
_NUMERIC = rf"^(\d{{1,2}})[/\-.](\d{{1,2}})[/\-.](\d{{4}}|\d{{2}}){_TIME_TAIL}$"
_DAY_MONTH = rf"(?i)^(\d{{1,2}})[\s\-/]*({MONTHS})[a-z]*\.?[\s\-/,]*(\d{{4}}|\d{{2}})$"
_MONTH_DAY = rf"(?i)^({MONTHS})[a-z]*\.?\s*(\d{{1,2}})(?:\s*,\s*|\s+)(\d{{4}})$"
_MONTH_DAY_ONLY = rf"(?i)^({MONTHS})[a-z]*\.?\s*(\d{{1,2}})$"


def _year(text: Column) -> Column:
    """Two-digit years up to 68 are 20xx, later ones 19xx."""
    short = F.when(text <= "68", F.concat(F.lit("20"), text)).otherwise(F.concat(F.lit("19"), text))
    return F.when(F.length(text) == 2, short).otherwise(text).try_cast("int")


def month_number(name: Column) -> Column:
    position = F.call_function("instr", F.lit(_MONTH_STARTS), F.lower(F.substring(name, 1, 3)))
    return F.when((F.length(name) >= 3) & (position % 3 == 1), ((position + 2) / 3).cast("int"))


def _date(year: Column, month: Column, day: Column) -> Column:
    """A date, or null when the parts do not name one."""
    # Any missing part makes the text null, and with it the date.
    return F.concat(
        F.lpad(year.cast("string"), 4, "0"), F.lit("-"), month.cast("string"), F.lit("-"), day.cast("string")
    ).try_cast("date")


def parse_date(value: Column | str, default_year: Column | None = None) -> Column:
    """Tolerant date of document text.

    Numeric dates are month first, unless the first part exceeds 12 (then it must be the day).
    A month and day without a year take ``default_year`` (the current year when not given).
    """
    fallback_year = F.year(F.current_date()) if default_year is None else default_year
    return let(strip(value), lambda s: _dated(s, fallback_year))


def _dated(s: Column, fallback_year: Column) -> Column:
    def text(pattern, group):
        return F.regexp_extract(s, pattern, group)

    def number(pattern, group):
        return text(pattern, group).try_cast("int")

    first, second, year = number(_NUMERIC, 1), number(_NUMERIC, 2), _year(text(_NUMERIC, 3))
    day_first = (first > 12) & (second <= 12)
    return (
        F.when(s.rlike(_ISO), _date(number(_ISO, 1), number(_ISO, 2), number(_ISO, 3)))
        .when(
            s.rlike(_NUMERIC),
            _date(year, F.when(day_first, second).otherwise(first), F.when(day_first, first).otherwise(second)),
        )
        .when(
            s.rlike(_DAY_MONTH),
            _date(_year(text(_DAY_MONTH, 3)), month_number(text(_DAY_MONTH, 2)), number(_DAY_MONTH, 1)),
        )
        .when(
            s.rlike(_MONTH_DAY),
            _date(_year(text(_MONTH_DAY, 3)), month_number(text(_MONTH_DAY, 1)), number(_MONTH_DAY, 2)),
        )
        .when(
            s.rlike(_MONTH_DAY_ONLY),
            _date(fallback_year, month_number(text(_MONTH_DAY_ONLY, 1)), number(_MONTH_DAY_ONLY, 2)),
        )
    )


# Export cells: shape -> format. Routed by shape, so no format meets text it would have to reject.
_EXPORT_FORMATS = (
    (r"^\s*\d{1,2}/\d{1,2}/\d{4}\s*$", "M/d/yyyy"),
    (r"^\s*\d{1,2}/\d{1,2}/\d{2}\s*$", "M/d/yy"),
    (r"^\s*\d{1,2}-[A-Za-z]{3}-\d{4}\s*$", "d-MMM-yyyy"),
    (r"^\s*\d{1,2}-[A-Za-z]{3}-\d{2}\s*$", "d-MMM-yy"),
)


def to_date(value: Column | str) -> Column:
    """Date of an export cell: ``5/11/26``, ``5/11/2026``, ``11-MAY-26`` or an ISO timestamp, else null.

    The import parses three dates per row, so this form stays small enough for generated code.
    """
    cell = col(value)
    parsed = F.when(cell.rlike(r"^\s*\d{4}-\d{1,2}-\d{1,2}"), cell.try_cast("date"))
    for shape, pattern in _EXPORT_FORMATS:
        parsed = parsed.when(cell.rlike(shape), F.try_to_date(F.trim(cell), pattern))
    return parsed


# A separator must stand alone: a date may itself contain hyphens.
_PERIOD_SPLIT = r"(?i)\s+-\s+|\s*–\s*|\s+to\s+"


def parse_period(period: Column | str) -> tuple[Column, Column]:
    """``start - end`` (spaced dash, en dash or ``to``) as two dates; a lone date is the start."""
    parts = F.split(blank_to_null(period), _PERIOD_SPLIT, 2)
    return parse_date(F.get(parts, F.lit(0))), parse_date(F.get(parts, F.lit(1)))


def us_date(value: Column) -> Column:
    """``M/d/yyyy`` without leading zeros."""
    return F.concat_ws("/", F.month(value), F.dayofmonth(value), F.year(value))


def period_text(start: Column, end: Column) -> Column:
    return F.when(start.isNotNull() & end.isNotNull(), F.concat(us_date(start), F.lit(" - "), us_date(end)))


def full_month(month_name: Column, year: Column) -> Column:
    """``April`` + ``2026`` -> ``4/1/2026 - 4/30/2026``; null when either part is missing."""
    start = _date(year.try_cast("int"), month_number(month_name), F.lit(1))
    return period_text(start, F.last_day(start))


def named_date(month_name: Column, day: Column, year: Column) -> Column:
    """Date of a month name, a day and a year that were matched separately."""
    return _date(year.try_cast("int"), month_number(month_name), day.try_cast("int"))

