"""Boards, history, search, detail views and listings over invoices, lines and timesheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.labels import ALL_DATA_FOUND, CONTRACTOR, FAILED, FLAGGED, MATCHED, MISSING_DATA, NEEDS_REVIEW, OTHER
from tallyweave.functions.money import cents, exact, exact_sum
from tallyweave.functions.strings import any_of, col
from tallyweave.operators.hours import PERSON, billable, bound_spans, days_in_spans, is_counted, same_span, spans_of
from tallyweave.operators.scale import global_rank
from tallyweave.operators.spans import with_span_aggregates

def contractor_board(invoices: DataFrame) -> DataFrame:
    """Active contractor invoices with the column of the board they stand in."""
    column = F.when(F.col("status") == MATCHED, MATCHED).when(
        F.col("status").isin(FLAGGED, NEEDS_REVIEW, FAILED), FLAGGED
    )
    return invoices.filter((F.col("invoice_type") == CONTRACTOR) & F.col("archived_at").isNull()).withColumn(
        "board_column", column
    )


def other_board(invoices: DataFrame) -> DataFrame:
    """Active other invoices, split into complete and incomplete ones."""
    column = F.when(F.col("status") == ALL_DATA_FOUND, "found").when(F.col("status") == MISSING_DATA, "missing")
    return invoices.filter((F.col("invoice_type") == OTHER) & F.col("archived_at").isNull()).withColumn(
        "board_column", column
    )


def history(invoices: DataFrame, invoice_type: str) -> DataFrame:
    """Every invoice of one type, archived ones included, newest first."""
    return invoices.filter(F.col("invoice_type") == invoice_type).orderBy(F.desc("created_at"), F.desc("id"))


def search_fields() -> list[Column]:
    """What a search of invoices looks in."""
    return [F.coalesce("vendor_name", F.lit("")), F.coalesce("invoice_number", F.lit("")), F.col("id").cast("string")]


def matches_search(text: str) -> Column:
    """Case-insensitive substring of the vendor, the invoice number or the id."""
    wanted = text.strip().lower()
    return any_of([F.contains(F.lower(f), F.lit(wanted)) for f in search_fields()]) if wanted else F.lit(True)


def search_timesheets(timesheets: DataFrame, text: str | None = None, limit: int | None = 50) -> DataFrame:
    """Timesheets whose person contains the text, by name. The limit is the caller's page size; None returns them all."""
    found = timesheets.filter(F.contains(PERSON, F.lit(text.lower()))) if text else timesheets
    return _page(found.orderBy("contractor_name", "entry_order"), limit)


def list_projects(projects: DataFrame, limit: int | None = 50) -> DataFrame:
    return _page(projects.orderBy("project_id"), limit)


def _page(rows: DataFrame, limit: int | None) -> DataFrame:
    return rows if limit is None else rows.limit(limit)


def board_orders() -> dict[str, list[Column]]:
    """The orders of a board; a missing price or date counts as zero."""
    price = F.coalesce("total_invoice_cost", F.lit(0.0))
    day = F.coalesce("date_received", F.to_date(F.lit("1970-01-01")))
    newest = [F.desc("created_at"), F.desc("id")]
    return {
        "default": newest, "price_desc": [price.desc(), *newest], "price_asc": [price.asc(), *newest],
        "date_desc": [day.desc(), *newest], "date_asc": [day.asc(), *newest],
    }


def sort_board(cards: DataFrame, key: str) -> DataFrame:
    """``default``, ``price_asc|desc`` or ``date_asc|desc``."""
    return cards.orderBy(*board_orders()[key])


def ranked_board(cards: DataFrame, key: str) -> DataFrame:
    """The cards with their place in the order as ``rank``, for pages of a board of any size."""
    return global_rank(cards, board_orders()[key])


def ranked_history(invoices: DataFrame, invoice_type: str) -> DataFrame:
    """``history`` with the place in its order as ``rank``."""
    return global_rank(invoices.filter(F.col("invoice_type") == invoice_type), board_orders()["default"])


def invoice_cards(invoices: DataFrame, lines: DataFrame) -> DataFrame:
    """Invoices with line counts, matched line counts and the parse method."""
    counted = lines.groupBy(F.col("invoice_id").alias("id")).agg(
        F.count(F.lit(1)).alias("line_item_count"), F.count_if(F.col("line_status") == MATCHED).alias("matched_line_count")
    )
    return invoices.join(counted, "id", "left").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in ("line_item_count", "matched_line_count")}
    ).withColumn("parse_method", F.col("raw_extraction.method"))


def other_cards(invoices: DataFrame, lines: DataFrame) -> DataFrame:
    """Other invoices with line and missing-field counts and the stored accounting fields."""
    counted = lines.groupBy(F.col("invoice_id").alias("id")).agg(F.count(F.lit(1)).alias("line_item_count"))
    stored = ["supplier_number", "budget_id", "cost_center", "offset_gl_account", "approver"]
    return (
        invoices.filter(F.col("invoice_type") == OTHER)
        .join(counted, "id", "left")
        .withColumns({c: F.col(f"raw_extraction.{c}") for c in stored})
        .withColumn("line_item_count", F.coalesce("line_item_count", F.lit(0)))
        .withColumn("missing_count", F.coalesce(F.size("raw_extraction.missing_fields"), F.lit(0)))
    )


def vendor_suggestions(invoices: DataFrame, text: str, limit: int | None = 6) -> DataFrame:
    """Vendors containing the text with invoice counts, by name; the first prefix hit is marked. None returns them all."""
    wanted = text.strip().lower()
    vendors = invoices.filter("vendor_name is not null").groupBy("vendor_name").agg(F.count(F.lit(1)).alias("invoices"))
    prefix = vendors.filter(F.startswith(F.lower("vendor_name"), F.lit(wanted))).agg(F.min("vendor_name")).scalar()
    found = vendors.filter(F.contains(F.lower("vendor_name"), F.lit(wanted)))
    return _page(found.orderBy("vendor_name"), limit).withColumn(
        "is_completion", F.coalesce(F.col("vendor_name") == prefix, F.lit(False))
    )


def invoice_suggestions(invoices: DataFrame, text: str, limit: int | None = 6) -> DataFrame:
    """Invoices whose number contains the text or whose id equals it, newest first. None returns them all."""
    wanted = text.strip().lower()
    hit = F.contains(F.lower("invoice_number"), F.lit(wanted)) | (F.col("id").cast("string") == wanted)
    return _page(invoices.filter(F.coalesce(hit, F.lit(False))).orderBy(F.desc("created_at"), F.desc("id")), limit)


def line_entries(lines: DataFrame, timesheets: DataFrame) -> DataFrame:
    """Every in-period entry behind a resolved line, marked when it counts.

    ``lines`` carry ``resolved, span_start, span_end``. Each distinct span meets the entries once; the lines
    that share a span are attached afterwards.
    """
    spans = spans_of(lines)
    entries = timesheets.filter(F.col(PERSON).isNotNull()).withColumn("resolved", F.col(PERSON)).withColumn(
        "included", is_counted()
    )
    bounded = days_in_spans(spans.filter("span_start is not null"), entries)
    whole = spans.filter("span_start is null").join(entries, "resolved").select(*bounded.columns)
    found = bounded.unionByName(whole)
    attributes = [c for c in found.columns if c not in ("resolved", "span_start", "span_end")]
    return (
        lines.select("id", "invoice_id", "resolved", "span_start", "span_end").alias("l")
        .join(found.alias("e"), same_span("l", "e"))
        .select("l.id", "l.invoice_id", *[f"e.{c}" for c in attributes])
    )


def entry_totals(lines: DataFrame, timesheets: DataFrame) -> DataFrame:
    """``n counted of m`` entries per resolved line, with the counted hours; lines without entries are left out."""
    entries = timesheets.filter(F.col(PERSON).isNotNull()).withColumn("resolved", F.col(PERSON))
    aggregates = {
        "counted_entries": (F.count_if(is_counted()), F.sum("counted_entries")), "entries": (F.count(F.lit(1)), F.sum("entries")),
        "counted_hours": (exact_sum(F.when(is_counted(), F.col("hours"))), F.sum("counted_hours")),
    }
    found = with_span_aggregates(lines.select("id", "resolved", "span_start", "span_end"), entries, aggregates)
    return found.select("id", "counted_entries", "entries", cents(F.col("counted_hours")).alias("counted_hours"))


def matched_people(lines: DataFrame, timesheets: DataFrame) -> DataFrame:
    """``(invoice_id, person)`` of every person a line of the invoice is linked to."""
    linked = timesheets.select(F.col("source_row_hash").alias("matched_timesheet_id"), F.col(PERSON).alias("person"))
    return lines.select("invoice_id", "matched_timesheet_id").join(linked, "matched_timesheet_id").select(
        "invoice_id", "person"
    ).distinct()


def entries_of_matched(timesheets: DataFrame, linked_people: DataFrame) -> DataFrame:
    """Entries of people matched on some invoice."""
    return timesheets.join(linked_people.select(F.col("person").alias(PERSON)).distinct(), PERSON, "left_semi")


def invoice_people(invoices: DataFrame, lines: DataFrame, timesheets: DataFrame) -> DataFrame:
    """``(invoice_id, resolved, span_start, span_end)``: an invoice's matched people with its period."""
    period = invoices.select(F.col("id").alias("invoice_id"), "payment_period_start", "payment_period_end")
    people = matched_people(lines, timesheets).join(period, "invoice_id").withColumnRenamed("person", "resolved")
    return bound_spans(people, F.col("payment_period_start"), F.col("payment_period_end")).drop("payment_period_start", "payment_period_end")


def billable_of_people(timesheets: DataFrame) -> DataFrame:
    return billable(timesheets).filter(F.col(PERSON).isNotNull()).withColumn("resolved", F.col(PERSON))


def person_detail(invoices: DataFrame, lines: DataFrame, timesheets: DataFrame) -> DataFrame:
    """Per invoice and matched person: billable hours within the invoice period, and the attributes of the first entry in it."""
    attributes = ["contractor_name", "project_id", "investment_name", "investment_manager", "resource_manager"]
    aggregates = {
        "hours": (F.sum(exact("hours")), F.sum("hours")),
        "first": (F.min_by(F.struct("entry_order", *attributes), "entry_order"), F.min_by("first", "first.entry_order")),
    }
    found = with_span_aggregates(invoice_people(invoices, lines, timesheets), billable_of_people(timesheets), aggregates)
    return found.select("invoice_id", F.col("resolved").alias("person"), cents(F.col("hours")).alias("hours"), *[f"first.{c}" for c in attributes])


def detail_totals(lines: DataFrame) -> DataFrame:
    """Hours and amount footers per invoice; null counts as zero."""
    return lines.groupBy("invoice_id").agg(
        cents(exact_sum("hours")).alias("hours"), cents(exact_sum("amount")).alias("amount")
    )


def upload_results(files: DataFrame) -> DataFrame:
    """One result row per file of a batch: names that are not ``.pdf`` are refused, the others go on."""
    accepted = F.endswith(F.lower(F.coalesce("file_name", F.lit("invoice.pdf"))), F.lit(".pdf"))
    return files.withColumn("ok", accepted).withColumn("error", F.when(~accepted, "Not a PDF"))


def upload_scope(results: DataFrame, invoices: DataFrame, lines: DataFrame) -> DataFrame:
    """One row for a batch: uploaded and failed files, distinct people, and the period to refresh."""
    counts = results.agg(F.count_if("ok").alias("uploaded"), F.count_if(~F.col("ok")).alias("failed"))
    names = lines.filter(F.coalesce(col("contractor_name"), F.lit("")) != "")
    span = invoices.agg(F.min("payment_period_start").alias("s"), F.max("payment_period_end").alias("e"))
    return counts.select(
        "uploaded", "failed",
        names.agg(F.countDistinct("contractor_name")).scalar().alias("people"),
        span.select("s").scalar().alias("period_start"),
        span.select("e").scalar().alias("period_end"),
    )
