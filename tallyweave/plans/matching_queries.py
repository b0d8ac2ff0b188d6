"""Person resolution and the hours reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.functions import labels, names, similarity
from tallyweave.operators import hours, merges, people, reconcile, spans
from tallyweave.plans.oracle_views import COUNTED, day_text, exact_cents, hours_text, normalized, sorted_tokens
from tallyweave.plans.registry import query
from tallyweave.sources.driver_views import DriverTables


def printed_names(d: DriverTables):
    """Distinct canonical names printed on invoice lines."""
    return d.invoice_lines().select(names.normalize_name("contractor_name").alias("norm")).distinct()


def matched(d: DriverTables) -> reconcile.Reconciliation:
    return reconcile.reconcile(d.invoices(), d.invoice_lines(), d.timesheets(), d.aliases())


def compared(d: DriverTables):
    return reconcile.compare_lines(d.invoices(), d.invoice_lines(), d.timesheets(), d.aliases())


_NORM = normalized("contractor_name")
_LINE_NORM = normalized("l.contractor_name")


@query("join_name_exact", f"""
    SELECT DISTINCT {_NORM} AS norm, {_NORM} AS resolved, 'exact' AS method FROM invoice_lines
    WHERE {_NORM} IN (SELECT norm FROM ts_people)""")
def join_name_exact(d):
    return people.by_exact_name(printed_names(d), people.distinct_people(d.timesheets()))


@query("join_name_sorted", f"""
    SELECT DISTINCT {_LINE_NORM} AS norm, p.norm AS resolved, 'exact' AS method
    FROM invoice_lines l JOIN ts_people p ON {sorted_tokens('p.norm')} = {sorted_tokens(_LINE_NORM)}""")
def join_name_sorted(d):
    return people.by_sorted_tokens(printed_names(d), people.distinct_people(d.timesheets()))


@query("join_name_crossref", f"""
    SELECT DISTINCT {_LINE_NORM} AS norm, p.norm AS resolved, 'crossref' AS method
    FROM invoice_lines l JOIN aliases a ON {normalized('a.invoice_name')} = {_LINE_NORM}
    JOIN ts_people p ON p.norm = {normalized('a.timesheet_name')}""")
def join_name_crossref(d):
    return people.by_alias(printed_names(d), people.distinct_people(d.timesheets()), d.aliases())


@query("join_name_fuzzy", f"""
    SELECT DISTINCT {_NORM} AS norm, made_from AS resolved, 'fuzzy' AS method FROM invoice_lines
    WHERE made_by IN ('exact', 'fuzzy') AND made_from IN (SELECT norm FROM ts_people)""")
def join_name_fuzzy(d):
    return people.by_similarity(printed_names(d), people.distinct_people(d.timesheets()))


@query("join_resolve_tiers", f"""
    SELECT l.id, {_LINE_NORM} AS norm, p.norm AS resolved, CASE WHEN p.norm IS NULL THEN 'unresolved' ELSE made_by END AS match_method
    FROM invoice_lines l LEFT JOIN ts_people p ON p.norm = l.made_from""")
def join_resolve_tiers(d):
    lines = people.resolve_lines(d.invoice_lines(), d.timesheets(), d.aliases())
    return lines.select("id", "norm", "resolved", "match_method")


@query("join_upsert_crossref", """
    SELECT invoice_name, timesheet_name FROM aliases""")
def join_upsert_crossref(d):
    aliases = d.aliases()
    stored = aliases.filter("alias_id % 2 = 0").withColumn("timesheet_name", F.lit("Before"))
    return merges.seed_aliases(merges.seed_aliases(stored, aliases), aliases).select("invoice_name", "timesheet_name")


@query("fn_name_similarity", """
    SELECT user_id, 100e0 AS same, 100e0 AS reversed, 100e0 AS first_only,
           200e0 * (length(full_name) - 1) / (2 * length(full_name) - 1) AS one_letter_off
    FROM (SELECT user_id, lower(first_name || ' ' || last_name) AS full_name FROM people) p""")
def fn_name_similarity(d):
    first, last = F.lower("first_name"), F.lower("last_name")
    whole = F.concat_ws(" ", first, last)
    score = similarity.name_similarity_udf
    cut = F.concat(F.substring(last, 1, 2), F.substring(last, 4, 40))
    return d.kept("people").select(
        "user_id",
        score(whole, whole).alias("same"),
        score(whole, F.concat_ws(" ", last, first)).alias("reversed"),
        score(first, whole).alias("first_only"),
        F.greatest(
            similarity.token_sort_udf(whole, F.concat_ws(" ", first, cut)), similarity.ratio_udf(whole, F.concat_ws(" ", first, cut))
        ).alias("one_letter_off"),
    )


@query("fn_shares_anchor", f"""
    SELECT id, len(list_filter(string_split({_NORM}, ' '), lambda t: length(t) >= 3
                   AND list_contains(string_split(made_from, ' '), t))) > 0
               OR (least(length(replace({_NORM}, ' ', '')), length(replace(made_from, ' ', ''))) >= 6
                   AND (contains(replace({_NORM}, ' ', ''), replace(made_from, ' ', ''))
                        OR contains(replace(made_from, ' ', ''), replace({_NORM}, ' ', '')))) AS anchored
    FROM invoice_lines WHERE made_from IS NOT NULL""")
def fn_shares_anchor(d):
    lines = d.invoice_lines().filter("made_from is not null")
    return lines.select("id", names.shares_anchor(names.normalize_name("contractor_name"), "made_from").alias("anchored"))


@query("set_intersect_tokens", f"""
    SELECT id, array_to_string(list_sort(list_distinct(list_filter(string_split({_NORM}, ' '),
               lambda t: length(t) >= 3 AND list_contains(string_split(made_from, ' '), t)))), ' ') AS shared
    FROM invoice_lines WHERE made_from IS NOT NULL""")
def set_intersect_tokens(d):
    lines = d.invoice_lines().filter("made_from is not null")
    shared = names.shared_tokens(names.normalize_name("contractor_name"), "made_from")
    return lines.select("id", F.array_join(F.array_sort(shared), " ").alias("shared"))


# --- predicates -------------------------------------------------------------------------------------
@query("flt_billable", f"SELECT source_row_hash, hours FROM timesheets WHERE {COUNTED} AND NOT is_time_off")
def flt_billable(d):
    return hours.billable(d.timesheets()).select("source_row_hash", "hours")


@query("flt_pending", f"""
    SELECT contractor_name_normalized AS person, {exact_cents('sum(hours)')} AS pending FROM timesheets
    WHERE NOT {COUNTED} AND NOT is_time_off AND date_worked BETWEEN DATE '2024-01-08' AND DATE '2024-01-14' GROUP BY 1""")
def flt_pending(d):
    window = hours.in_window(F.col("date_worked"), F.to_date(F.lit("2024-01-08")), F.to_date(F.lit("2024-01-14")))
    open_rows = d.timesheets().filter(hours.is_pending() & window)
    return open_rows.groupBy(F.col("contractor_name_normalized").alias("person")).agg(
        hours.rounded_hours(F.sum(F.col("hours").cast("decimal(28,6)"))).alias("pending")
    )


@query("flt_window", """
    SELECT m.id, count(*) AS entries FROM (
        SELECT l.id, l.made_from, v.payment_period_start AS s0, v.payment_period_end AS s1
        FROM invoice_lines l JOIN invoices v ON v.id = l.invoice_id) m
    JOIN timesheets t ON t.contractor_name_normalized = m.made_from
    WHERE s0 IS NULL OR s1 IS NULL OR coalesce(t.date_worked BETWEEN s0 AND s1, false) GROUP BY m.id""")
def flt_window(d):
    header = d.invoices().select(F.col("id").alias("invoice_id"), "payment_period_start", "payment_period_end")
    lines = d.invoice_lines().join(header, "invoice_id").withColumn("resolved", F.col("made_from")).filter("resolved is not null")
    spanned = hours.bound_spans(lines, F.col("payment_period_start"), F.col("payment_period_end"))
    entries = d.timesheets().withColumn("resolved", F.col("contractor_name_normalized"))
    return spans.with_span_aggregates(spanned, entries, {"entries": (F.count(F.lit(1)), F.sum("entries"))}).select("id", "entries")


@query("flt_skip_failed", """
    SELECT v.id, v.status FROM invoices v
    WHERE v.invoice_type = 'contractor' AND v.status = 'processing_failed'""")
def flt_skip_failed(d):
    return matched(d).invoices.filter(F.col("status") == labels.FAILED).select("id", "status")


@query("flt_rematch_scope", """
    SELECT id, id = (SELECT min(id) FROM invoices WHERE invoice_type = 'contractor') AS only_first
    FROM invoices WHERE invoice_type = 'contractor'""")
def flt_rematch_scope(d):
    scope = reconcile.rematch_scope(d.invoices())
    first = scope.agg(F.min("id")).scalar()
    return scope.select("id", (F.col("id") == first).alias("only_first"))


# --- hours ------------------------------------------------------------------------------------------
@query("join_interval_hours", f"""
    SELECT id, {exact_cents('counted')} AS counted, {exact_cents('pending')} AS pending FROM compared
    WHERE resolved IS NOT NULL""")
def join_interval_hours(d):
    return compared(d).filter("resolved is not null").select("id", "counted", "pending")


@query("agg_hours_counted", f"""
    SELECT id, {exact_cents('counted')} AS counted, {exact_cents('pending')} AS pending,
           s0 IS NOT NULL AND s1 IS NOT NULL AS period_constrained
    FROM (SELECT m.id, m.resolved, m.payment_period_start AS s0, m.payment_period_end AS s1,
                 coalesce(sum(CASE WHEN {COUNTED} AND NOT is_time_off AND inside THEN t.hours ELSE 0 END), 0) AS counted,
                 coalesce(sum(CASE WHEN NOT {COUNTED} AND NOT is_time_off AND inside THEN t.hours ELSE 0 END), 0) AS pending
          FROM matchable m JOIN timesheets t ON t.contractor_name_normalized = m.resolved,
               LATERAL (SELECT payment_period_start IS NULL OR payment_period_end IS NULL
                        OR coalesce(t.date_worked BETWEEN payment_period_start AND payment_period_end, false) AS inside) w
          GROUP BY ALL) h""")
def agg_hours_counted(d):
    lines = reconcile.prepare_lines(d.invoices(), d.invoice_lines())
    resolved = people.resolve_lines(lines, d.timesheets(), d.aliases()).filter("resolved is not null")
    spanned = hours.bound_spans(resolved, F.col("payment_period_start"), F.col("payment_period_end"))
    return hours.line_hours(spanned, d.timesheets()).select(
        "id", hours.rounded_hours("counted").alias("counted"), hours.rounded_hours("pending").alias("pending"),
        "period_constrained",
    )


@query("rank_link_row", "SELECT id, link FROM compared WHERE resolved IS NOT NULL")
def rank_link_row(d):
    return compared(d).filter("resolved is not null").select("id", F.col("linked_entry").alias("link"))


@query("agg_single_person", "SELECT invoice_id, line_count, single_person FROM invoice_shape")
def agg_single_person(d):
    lines = reconcile.prepare_lines(d.invoices(), d.invoice_lines())
    resolved = people.resolve_lines(lines, d.timesheets(), d.aliases())
    return reconcile.single_person_invoices(resolved).select("invoice_id", "line_count", "single_person")


@query("agg_single_person_total", f"""
    SELECT id, invoice_id, first_method AS method, CASE WHEN ok THEN 'matched' ELSE 'flagged' END AS line_status,
           {exact_cents('billed_total')} AS contractor_invoice_total, {exact_cents('counted')} AS timesheet_hours,
           {exact_cents('billed_total - counted')} AS hours_delta
    FROM compared WHERE single_person""")
def agg_single_person_total(d):
    rows = matched(d).lines.filter("diff.aggregated")
    return rows.select(
        F.col("line_id").alias("id"), "invoice_id", F.col("diff.match_method").alias("method"), "line_status",
        "diff.contractor_invoice_total", "diff.timesheet_hours", "diff.hours_delta",
    )


@query("agg_line_match", f"""
    SELECT id, CASE WHEN ok THEN 'matched' ELSE 'flagged' END AS line_status,
           CASE WHEN single_person THEN first_method ELSE method END AS method,
           CASE WHEN resolved IS NOT NULL THEN linked_name END AS matched_name,
           CASE WHEN resolved IS NOT NULL THEN {exact_cents('counted')} END AS timesheet_hours,
           CASE WHEN resolved IS NOT NULL THEN {exact_cents('pending')} END AS pending_hours,
           CASE WHEN resolved IS NOT NULL THEN {exact_cents('billed - counted')} END AS hours_delta,
           CASE WHEN resolved IS NOT NULL AND billed IS NOT NULL AND (single_person OR NOT ok)
                THEN NOT ok AND billed > counted AND pending > 0 END AS pending_posting,
           CASE WHEN resolved IS NOT NULL AND NOT single_person THEN s0 IS NOT NULL AND s1 IS NOT NULL END AS period_constrained,
           CASE WHEN resolved IS NULL THEN 'No timesheet match'
                WHEN NOT single_person AND billed IS NULL THEN 'Invoice hours missing' END AS reason
    FROM compared""")
def agg_line_match(d):
    return matched(d).lines.select(
        F.col("line_id").alias("id"), "line_status", F.col("diff.match_method").alias("method"), "diff.matched_name",
        "diff.timesheet_hours", "diff.pending_hours", "diff.hours_delta", "diff.pending_posting",
        "diff.period_constrained", "diff.reason",
    )


@query("agg_invoice_status", """
    SELECT id, vendor_name, new_status AS status, lines, matched_lines,
           CASE WHEN new_status = 'matched' THEN 'matched' ELSE 'flagged' END AS routed_to FROM invoice_outcomes""")
def agg_invoice_status(d):
    return matched(d).invoices.select("id", "vendor_name", "status", "lines", "matched_lines", "routed_to")


@query("agg_mismatch_reasons", f"""
    SELECT invoice_id, line_ord, CASE WHEN resolved IS NULL THEN 'name' ELSE 'hours' END AS field,
           CASE WHEN resolved IS NULL THEN 'No timesheet match for ''' || shown || '''.'
                WHEN billed IS NULL THEN 'Invoice hours missing for ' || shown || '.'
                WHEN billed > counted AND pending > 0 THEN prefix || shown || ': invoice bills ' || {hours_text('billed')}
                    || ' hrs but only ' || {hours_text('counted')} || ' are posted/submitted in the timesheets for this period; '
                    || {hours_text('pending')} || ' more hrs are logged but not yet posted or submitted. Reconcile once they are posted.'
                ELSE prefix || 'Hours differ for ' || shown || ' (invoice ' || {hours_text('billed')} || ' vs timesheets '
                    || {hours_text('counted')} || ').' END AS reason,
           CASE WHEN resolved IS NULL THEN contractor_name WHEN billed IS NOT NULL THEN {hours_text('billed')} END AS invoice_value,
           CASE WHEN resolved IS NOT NULL THEN {hours_text('counted')} END AS timesheet_value
    FROM (SELECT *, CASE WHEN single_person THEN coalesce(linked_name, first_contractor) ELSE contractor_name END AS shown,
                 CASE WHEN single_person THEN 'Total across ' || line_count || ' lines: ' ELSE '' END AS prefix
          FROM compared WHERE NOT ok AND (NOT single_person OR line_ord = first_ord)) c""")
def agg_mismatch_reasons(d):
    return matched(d).reasons


@query("agg_status_counts", """
    SELECT s.status, count(o.id) AS invoices FROM (VALUES ('matched'), ('flagged'), ('processing_failed')) s(status)
    LEFT JOIN invoice_outcomes o ON o.new_status = s.status GROUP BY 1""")
def agg_status_counts(d):
    return reconcile.status_counts(matched(d).invoices)


@query("agg_route_counts", """
    SELECT CASE WHEN new_status = 'matched' THEN 'matched' ELSE 'flagged' END AS label, count(*) AS invoices
    FROM invoice_outcomes GROUP BY 1""")
def agg_route_counts(d):
    return reconcile.route_counts(matched(d).invoices)


@query("match_events", """
    SELECT id AS invoice_id, 'matched' AS event, new_status AS status, lines, matched_lines,
           CASE WHEN single_person THEN 'single_contractor_total' END AS mode
    FROM invoice_outcomes WHERE status <> 'processing_failed'""")
def match_events(d):
    detail = F.from_json("detail", "status string, lines long, matched_lines long, mode string")
    return matched(d).events.select("invoice_id", "event", detail.alias("d")).select("invoice_id", "event", "d.*")


_DAYS = day_text("t.date_worked")


@query("flt_line_drilldown", f"""
    SELECT m.id, t.source_row_hash, {_DAYS} AS date_worked, t.hours, t.project_id, t.time_sheet_status,
           {COUNTED} AND NOT t.is_time_off AS included
    FROM (SELECT l.id, l.resolved, CASE WHEN own_start IS NULL OR own_end IS NULL THEN payment_period_start ELSE own_start END AS s0,
                 CASE WHEN own_start IS NULL OR own_end IS NULL THEN payment_period_end ELSE own_end END AS s1
          FROM matchable l) m
    JOIN timesheets t ON t.contractor_name_normalized = m.resolved
    WHERE s0 IS NULL OR s1 IS NULL OR t.date_worked BETWEEN s0 AND s1""")
def flt_line_drilldown(d):
    from tallyweave.operators.boards import line_entries

    lines = reconcile.prepare_lines(d.invoices(), d.invoice_lines())
    resolved = people.resolve_lines(lines, d.timesheets(), d.aliases()).filter("resolved is not null")
    start, end = reconcile.line_period(resolved)
    return line_entries(hours.bound_spans(resolved, start, end), d.timesheets()).select(
        "id", "source_row_hash", "date_worked", "hours", "project_id", "time_sheet_status", "included"
    )


@query("fn_status_label", """
    SELECT id, CASE status WHEN 'processing_failed' THEN 'FAILED' WHEN 'matched' THEN 'VERIFIED' WHEN 'flagged' THEN 'CONFLICT'
                    WHEN 'needs_manual_review' THEN 'MISSING INFO' END AS label,
           CASE WHEN contains(method, 'llm') THEN 'AI-PARSED' WHEN method = 'template' THEN 'AUTO-LEARNED' END AS badge,
           CASE WHEN total_invoice_cost >= 1000 THEN '$' || CAST(CAST(round(total_invoice_cost / 1000, 0) AS BIGINT) AS VARCHAR) || 'K'
                WHEN total_invoice_cost IS NOT NULL THEN '$' || CAST(CAST(round(total_invoice_cost, 0) AS BIGINT) AS VARCHAR) END AS compact
    FROM spend_invoices""")
def fn_status_label(d):
    from tallyweave.functions.money import compact_money

    return d.kept("spend_invoices").select(
        "id", labels.status_label("status").alias("label"), labels.method_badge("method").alias("badge"),
        compact_money(F.col("total_invoice_cost")).alias("compact"),
    )


@query("fn_line_weight", """
    SELECT id, coalesce(amount, hours * rate, 0) AS weight FROM spend_lines""")
def fn_line_weight(d):
    from tallyweave.functions.money import line_weight

    return d.view("spend_lines").select("id", line_weight("amount", "hours", "rate").alias("weight"))


