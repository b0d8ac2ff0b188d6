"""Compare billed hours with logged hours: line status, invoice status, and a reason per mismatch."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.labels import CONTRACTOR, FAILED, FLAGGED, MATCHED, route_label
from tallyweave.functions.money import cents, exact, hours_text
from tallyweave.operators.hours import bound_spans, line_hours
from tallyweave.operators.people import resolve_lines

# A difference within one hour or two percent of the billed hours is a match.
HOURS_TOLERANCE = 1.0
HOURS_TOLERANCE_SHARE = 0.02


@dataclass(frozen=True)
class Reconciliation:
    """Line results, invoice statuses, one row per mismatch reason, and the ``matched`` events."""

    lines: DataFrame
    invoices: DataFrame
    reasons: DataFrame
    events: DataFrame


def within_tolerance(billed: Column, logged: Column) -> Column:
    allowed = F.greatest(exact(F.lit(HOURS_TOLERANCE)), exact(billed) * F.lit(HOURS_TOLERANCE_SHARE).cast("decimal(4,2)"))
    return F.abs(exact(billed) - exact(logged)) <= allowed


def single_person_invoices(resolved_lines: DataFrame) -> DataFrame:
    """Per invoice: line count, total billed hours, and whether several lines all bill one person."""
    return resolved_lines.groupBy("invoice_id").agg(
        F.count(F.lit(1)).alias("line_count"),
        F.sum(F.coalesce(exact("hours"), F.lit(0))).alias("billed_total"),
        F.min("line_ord").alias("first_ord"),
        F.min_by("match_method", "line_ord").alias("first_method"),
        F.min_by("contractor_name", "line_ord").alias("first_contractor"),
        (
            (F.count(F.lit(1)) > 1)
            & F.bool_and(F.col("resolved").isNotNull())
            & F.coalesce(F.min("resolved") == F.max("resolved"), F.lit(False))
        ).alias("single_person"),
    )


def prepare_lines(invoices: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines of the contractor invoices that can be matched, with the invoice period they fall back to."""
    header = invoices.filter((F.col("invoice_type") == CONTRACTOR) & (F.col("status") != FAILED)).select(
        F.col("id").alias("invoice_id"), "payment_period_start", "payment_period_end"
    )
    return lines.drop("line_status", "diff", "matched_timesheet_id").join(header, "invoice_id")


def line_period(lines: DataFrame) -> tuple[Column, Column]:
    """The line's own period when both ends are known, else the invoice period."""
    own = F.col("extra.period_start").isNotNull() & F.col("extra.period_end").isNotNull()
    return (
        F.when(own, F.col("extra.period_start")).otherwise(F.col("payment_period_start")),
        F.when(own, F.col("extra.period_end")).otherwise(F.col("payment_period_end")),
    )


def compare_lines(
    invoices: DataFrame, lines: DataFrame, timesheets: DataFrame, aliases: DataFrame | None = None
) -> DataFrame:
    """Every line with its resolution, its logged hours, its status and the numbers behind it."""
    resolved = resolve_lines(prepare_lines(invoices, lines), timesheets, aliases)
    shape = single_person_invoices(resolved)
    joined = resolved.join(shape, "invoice_id")
    own_start, own_end = line_period(joined)
    single = F.col("single_person")
    spanned = bound_spans(
        joined,
        F.when(single, F.col("payment_period_start")).otherwise(own_start),
        F.when(single, F.col("payment_period_end")).otherwise(own_end),
    )
    compared = line_hours(spanned, timesheets)
    billed = F.when(single, F.col("billed_total")).otherwise(exact("hours"))
    delta = billed - F.col("counted")
    ok = F.when(F.col("resolved").isNull() | billed.isNull(), F.lit(False)).otherwise(
        within_tolerance(billed, F.col("counted"))
    )
    return (
        compared.withColumns({"billed": billed, "hours_delta": delta, "ok": ok})
        .withColumn("pending_posting", ~F.col("ok") & (F.col("hours_delta") > 0) & (F.col("pending") > 0))
        .withColumn("line_status", F.when(F.col("ok"), MATCHED).otherwise(FLAGGED))
        .withColumn(
            "match_method", F.when(single, F.col("first_method")).otherwise(F.col("match_method"))
        )
    )


def line_results(compared: DataFrame) -> DataFrame:
    """The stored shape of a matched line: link, status and the ``diff`` record."""
    single, known = F.col("single_person"), F.col("resolved").isNotNull()
    judged = known & F.col("billed").isNotNull()
    diff = F.struct(
        "match_method",
        F.when(known, F.col("linked_name")).alias("matched_name"),
        F.when(known, F.col("hours")).alias("invoice_hours"),
        F.when(known, cents(F.col("counted"))).alias("timesheet_hours"),
        F.when(known, cents(F.col("pending"))).alias("pending_hours"),
        F.when(judged, cents(F.col("hours_delta"))).alias("hours_delta"),
        F.when(judged & (single | ~F.col("ok")), F.coalesce("pending_posting", F.lit(False))).alias("pending_posting"),
        F.when(known & ~single, F.col("period_constrained")).alias("period_constrained"),
        F.when(single, F.lit(True)).alias("aggregated"),
        F.when(single, cents(F.col("billed_total"))).alias("contractor_invoice_total"),
        F.when(known, F.lit(False)).alias("rate_validated"),
        F.when(~known, "No timesheet match").when(~single & F.col("billed").isNull(), "Invoice hours missing").alias("reason"),
    )
    return compared.select(
        F.col("id").alias("line_id"), "invoice_id", "line_ord", "contractor_name", "resolved", "hours",
        F.when(known, F.col("linked_entry")).alias("matched_timesheet_id"), "line_status", diff.alias("diff"),
    )


def mismatch_reasons(compared: DataFrame) -> DataFrame:
    """One row per reason, ordered by ``(invoice_id, line_ord)``; a one-person invoice has at most one."""
    single = F.col("single_person")
    rows = compared.filter(~F.col("ok") & (~single | (F.col("line_ord") == F.col("first_ord"))))
    prefix = F.when(single, F.concat(F.lit("Total across "), F.col("line_count").cast("string"), F.lit(" lines: "))).otherwise("")
    name = F.when(single, F.coalesce("linked_name", "first_contractor")).otherwise(F.col("contractor_name"))
    shown = F.coalesce(name, F.lit("None"))
    billed, logged, pending = (hours_text(F.round(F.col(c), 2)) for c in ("billed", "counted", "pending"))
    waiting = F.concat(
        prefix, shown, F.lit(": invoice bills "), billed, F.lit(" hrs but only "), logged,
        F.lit(" are posted/submitted in the timesheets for this period; "), pending,
        F.lit(" more hrs are logged but not yet posted or submitted. Reconcile once they are posted."),
    )
    differ = F.concat(
        prefix, F.lit("Hours differ for "), shown, F.lit(" (invoice "), billed, F.lit(" vs timesheets "), logged, F.lit(").")
    )
    unknown = F.col("resolved").isNull()
    missing = F.col("billed").isNull()
    return rows.select(
        "invoice_id",
        "line_ord",
        F.when(unknown, "name").otherwise("hours").alias("field"),
        F.when(unknown, F.concat(F.lit("No timesheet match for '"), shown, F.lit("'.")))
        .when(missing, F.concat(F.lit("Invoice hours missing for "), shown, F.lit(".")))
        .when(F.col("pending_posting"), waiting)
        .otherwise(differ)
        .alias("reason"),
        F.when(unknown, F.col("contractor_name")).when(~missing, billed).alias("invoice_value"),
        F.when(~unknown, logged).alias("timesheet_value"),
    )


def invoice_statuses(invoices: DataFrame, compared: DataFrame) -> DataFrame:
    """Contractor invoices with their new status; failed ones keep theirs, empty ones are flagged."""
    outcome = compared.groupBy("invoice_id").agg(
        F.bool_and("ok").alias("all_ok"),
        F.count(F.lit(1)).alias("lines"),
        F.count_if("ok").alias("matched_lines"),
        F.bool_or("single_person").alias("single_person"),
    )
    status = (
        F.when(F.col("status") == FAILED, F.col("status"))
        .when(F.coalesce("all_ok", F.lit(False)), MATCHED)
        .otherwise(FLAGGED)
    )
    return (
        invoices.filter(F.col("invoice_type") == CONTRACTOR)
        .join(outcome, F.col("id") == F.col("invoice_id"), "left")
        .withColumn("status", status)
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("lines", "matched_lines")})
        .withColumn("routed_to", route_label("status"))
        .drop("invoice_id", "all_ok")
    )


def match_events(statuses: DataFrame) -> DataFrame:
    """The ``matched`` event of every invoice that was matched (failed ones are skipped)."""
    detail = F.to_json(
        F.struct(
            "status",
            F.when(F.coalesce("single_person", F.lit(False)), "single_contractor_total").alias("mode"),
            "lines",
            "matched_lines",
        )
    )
    return statuses.filter(F.col("status") != FAILED).select(
        F.col("id").alias("invoice_id"), F.lit("matched").alias("event"), detail.alias("detail")
    )


def reconcile(
    invoices: DataFrame, lines: DataFrame, timesheets: DataFrame, aliases: DataFrame | None = None
) -> Reconciliation:
    """Match contractor invoices against timesheets.

    ``invoices(id, invoice_type, status, payment_period_start, payment_period_end, …)`` and
    ``lines(id, invoice_id, line_ord, contractor_name, hours, extra<period_start, period_end>, …)``.
    """
    compared = compare_lines(invoices, lines, timesheets, aliases)
    statuses = invoice_statuses(invoices, compared)
    return Reconciliation(line_results(compared), statuses, mismatch_reasons(compared), match_events(statuses))


def rematch_scope(invoices: DataFrame, invoice_id: int | None = None) -> DataFrame:
    """All contractor invoices, or one of them; other invoice types are never matched."""
    scope = invoices.filter(F.col("invoice_type") == CONTRACTOR)
    return scope if invoice_id is None else scope.filter(F.col("id") == invoice_id)


def status_counts(statuses: DataFrame) -> DataFrame:
    """Invoices per status; matched, flagged and failed always appear."""
    counted = statuses.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    expected = statuses.sparkSession.range(1).select(
        F.explode(F.array(*map(F.lit, (MATCHED, FLAGGED, FAILED)))).alias("status"), F.lit(0).alias("n")
    )
    return counted.unionByName(expected).groupBy("status").agg(F.sum("n").alias("invoices"))


def route_counts(statuses: DataFrame) -> DataFrame:
    """Invoices per target folder label; both labels always appear."""
    labels = statuses.select(route_label("status").alias("label"))
    return labels.agg(
        F.count_if(F.col("label") == MATCHED).alias(MATCHED), F.count_if(F.col("label") == FLAGGED).alias(FLAGGED)
    ).select(F.explode(F.create_map(F.lit(MATCHED), F.col(MATCHED), F.lit(FLAGGED), F.col(FLAGGED))).alias("label", "invoices"))

