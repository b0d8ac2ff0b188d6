"""Interval join of billed spans to daily timesheet entries.

Both sides are reduced before they meet: entries to one row per person and day (at most one row per day of
history, however many entries a person has), billed lines to distinct ``(person, start, end)`` spans. A span
meets days through an equality on (person, month), so a long history is never scanned day by day for a
one-week span. Spans without both bounds count the whole history and take the per-person totals instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.coding import counts_as_billable
from tallyweave.functions.money import cents, exact

PERSON = "contractor_name_normalized"
SPAN = ["resolved", "span_start", "span_end"]


def billable(timesheets: DataFrame) -> DataFrame:
    """Entries that count: posted or submitted, and not time off."""
    return timesheets.filter(is_counted())


def is_counted() -> Column:
    return counts_as_billable("is_posted", "time_sheet_status") & ~F.col("is_time_off")


def is_pending() -> Column:
    return ~counts_as_billable("is_posted", "time_sheet_status") & ~F.col("is_time_off")


def in_window(day: Column, start: Column, end: Column) -> Column:
    """Inclusive; everything passes unless both bounds are known."""
    bounded = start.isNotNull() & end.isNotNull()
    return F.when(bounded, F.coalesce(day.between(start, end), F.lit(False))).otherwise(F.lit(True))


def _entry() -> Column:
    return F.struct("entry_order", "source_row_hash", "contractor_name")


def _summed(condition: Column) -> Column:
    hours = F.when(condition, F.coalesce(exact("hours"), F.lit(0)))
    return F.coalesce(F.sum(hours), F.lit(0)).cast("decimal(28,6)")


def person_days(timesheets: DataFrame) -> DataFrame:
    """Counted and pending hours per person and day, with the first counted entry and the first entry."""
    return (
        timesheets.filter(F.col(PERSON).isNotNull())
        .groupBy(F.col(PERSON).alias("resolved"), "date_worked")
        .agg(
            _summed(is_counted()).alias("counted"),
            _summed(is_pending()).alias("pending"),
            F.min(F.when(is_counted(), _entry())).alias("first_counted"),
            F.min(_entry()).alias("first_entry"),
        )
    )


def months_of(start: Column, end: Column) -> Column:
    """First days of the months an inclusive span touches; empty when the span is empty."""
    first = F.trunc(start, "MM")
    return F.when(start <= end, F.sequence(first, end, F.expr("interval 1 month"))).otherwise(
        F.array().cast("array<date>")
    )


def spans_of(lines: DataFrame) -> DataFrame:
    """Distinct spans; an incomplete period becomes the one unbounded span of its person."""
    bounded = F.col("span_start").isNotNull() & F.col("span_end").isNotNull()
    return lines.filter("resolved is not null").select(
        "resolved", F.when(bounded, F.col("span_start")).alias("span_start"),
        F.when(bounded, F.col("span_end")).alias("span_end"),
    ).distinct()


def spread_over_months(spans: DataFrame) -> DataFrame:
    bounded = spans.filter("span_start is not null")
    return bounded.withColumn("month", F.explode(months_of(F.col("span_start"), F.col("span_end"))))


def days_in_spans(spans: DataFrame, days: DataFrame) -> DataFrame:
    """Every (span, day row) whose day lies in the span; unbounded spans are not handled here."""
    keyed = days.filter("date_worked is not null").withColumn("month", F.trunc("date_worked", "MM"))
    return spread_over_months(spans).join(keyed, ["resolved", "month"]).filter(
        F.col("date_worked").between(F.col("span_start"), F.col("span_end"))
    ).drop("month")


def span_hours(spans: DataFrame, timesheets: DataFrame) -> DataFrame:
    """Per span: counted, pending, whether the period constrained it, and the entry to link to."""
    days = person_days(timesheets)
    people = days.groupBy("resolved").agg(
        F.sum("counted").alias("counted"),
        F.sum("pending").alias("pending"),
        F.min("first_counted").alias("first_counted"),
        F.min("first_entry").alias("first_entry"),
    )
    bounded = days_in_spans(spans, days).groupBy(*SPAN).agg(
        F.sum("counted").alias("counted"), F.sum("pending").alias("pending"),
        F.min("first_counted").alias("first_counted"),
    )
    constrained = F.col("s.span_start").isNotNull()
    inside = (
        F.col("s.resolved").eqNullSafe(F.col("b.resolved"))
        & (F.col("s.span_start") == F.col("b.span_start")) & (F.col("s.span_end") == F.col("b.span_end"))
    )

    def pick(column):
        return F.when(constrained, F.col(f"b.{column}")).otherwise(F.col(f"p.{column}"))

    zero = F.lit(0).cast("decimal(28,6)")
    joined = spans.alias("s").join(bounded.alias("b"), inside, "left").join(
        people.alias("p"), F.col("s.resolved") == F.col("p.resolved"), "left"
    )
    return joined.select(
        "s.*",
        F.coalesce(pick("counted"), zero).alias("counted"),
        F.coalesce(pick("pending"), zero).alias("pending"),
        constrained.alias("period_constrained"),
        F.coalesce(pick("first_counted"), F.col("p.first_entry")).alias("link"),
    )


def same_span(left: str, right: str) -> Column:
    """Join condition between lines and spans, null-safe for unbounded spans."""
    return (
        (F.col(f"{left}.resolved") == F.col(f"{right}.resolved"))
        & F.col(f"{left}.span_start").eqNullSafe(F.col(f"{right}.span_start"))
        & F.col(f"{left}.span_end").eqNullSafe(F.col(f"{right}.span_end"))
    )


def bound_spans(lines: DataFrame, start: Column, end: Column) -> DataFrame:
    """Lines with ``span_start`` / ``span_end``, both null unless both bounds are known."""
    bounded = start.isNotNull() & end.isNotNull()
    return lines.withColumns({"span_start": F.when(bounded, start), "span_end": F.when(bounded, end)})


def line_hours(lines: DataFrame, timesheets: DataFrame) -> DataFrame:
    """Lines (with ``resolved, span_start, span_end``) plus their hours; people with none keep zero."""
    hours = span_hours(spans_of(lines), timesheets)
    joined = lines.alias("l").join(hours.alias("h"), same_span("l", "h"), "left")
    return joined.select(
        "l.*", "h.counted", "h.pending", "h.period_constrained",
        F.col("h.link.source_row_hash").alias("linked_entry"),
        F.col("h.link.contractor_name").alias("linked_name"),
    )


def rounded_hours(value: Column | str) -> Column:
    return cents(F.col(value) if isinstance(value, str) else value)
