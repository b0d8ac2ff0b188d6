"""Extraction over rendered documents and over the driver's own documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.functions import coding, dates, documents, money
from tallyweave.operators import extraction, grid_text, line_text, parse_jobs, service_text, templates
from tallyweave.operators.scale import row_count
from tallyweave.operators.suppliers import supplier_index, supplier_numbers
from tallyweave.plans.oracle_views import ORACLE_VIEWS, day_text, exact_cents
from tallyweave.plans.registry import query
from tallyweave.session import cut_lineage
from tallyweave.sources import rendered as R
from tallyweave.sources.documents import read_document_table

ORACLE_VIEWS["billing"] = R.BILLING_SQL
_ROWNUM = "row_number() OVER (PARTITION BY invoice_id ORDER BY line_ord) - 1"
_FLIPPED = "split_part(contractor_name, ' ', 2) || ', ' || split_part(contractor_name, ' ', 1)"
_CENTS = "CAST(CAST({} AS DECIMAL(18, 2)) AS DOUBLE)"
PERIOD = f"{day_text('period_start')} AS period_start, {day_text('period_end')} AS period_end"
NO_PERIOD = "CAST(NULL AS VARCHAR) AS period_start, CAST(NULL AS VARCHAR) AS period_end"


WHOLE_RATE = "CAST(floor(rate) AS DOUBLE)"


def lines_sql(name="contractor_name", period=NO_PERIOD, amount=_CENTS.format("amount"), rate=_CENTS.format("rate")):
    return (
        f"SELECT invoice_id AS doc_id, {name} AS contractor_name, hours, {rate} AS rate, {amount} AS amount, {period} FROM billing"
    )


def billing(d):
    def build():
        spend = d.spend_lines().select("invoice_id", "line_ord", "contractor_name", "hours", "rate")
        return d.spark.sql(R.BILLING_SQL.replace("FROM spend_lines", "FROM {lines}"), lines=spend)

    return d.stored("billing", build)


def extracted(d, layout):
    return line_text.LAYOUTS[layout](R.rendered(billing(d), layout)).drop("ord")


@query("txt_lines_rate_list", lines_sql(rate=WHOLE_RATE))
def txt_lines_rate_list(d):
    return extracted(d, "rate_list")


@query("txt_lines_billable", lines_sql(_FLIPPED, amount=f"CAST(round(CAST(hours * {_CENTS.format('rate')} AS DECIMAL(28, 6)), 2) AS DOUBLE)"))
def txt_lines_billable(d):
    return extracted(d, "billable")


@query("txt_lines_qty_item", lines_sql())
def txt_lines_qty_item(d):
    return extracted(d, "qty_item")


@query("txt_lines_desc_qty", lines_sql(period=PERIOD))
def txt_lines_desc_qty(d):
    return extracted(d, "desc_qty")


@query("txt_lines_unit_rows", lines_sql(_FLIPPED))
def txt_lines_unit_rows(d):
    return extracted(d, "unit_rows")


@query("txt_lines_period_blocks", lines_sql(period=PERIOD, rate=WHOLE_RATE))
def txt_lines_period_blocks(d):
    return extracted(d, "period_blocks")


@query("txt_lines_cells", lines_sql("'Balran Zarton'", period=PERIOD))
def txt_lines_cells(d):
    return extracted(d, "cells")


def header_docs(d):
    return R.headers(d.spend_invoices())


_START = "payment_period_start"
_US = "CAST(month({0}) AS VARCHAR) || '/' || CAST(day({0}) AS VARCHAR) || '/' || CAST(year({0}) AS VARCHAR)"
HEADER_SQL = f"""
    SELECT id AS doc_id,
           CASE WHEN vendor_name IS NULL THEN 'Invoice No: ' || invoice_number WHEN id % 6 < 3 THEN vendor_name
                ELSE vendor_name || ' Consulting LLC' END AS vendor_name,
           invoice_number,
           CASE WHEN date_received IS NOT NULL THEN strftime(date_received, '%Y-%m-%d')
                WHEN id % 6 = 0 THEN strftime({_START}, '%Y-%m-%d') WHEN id % 6 = 1 THEN strftime({_START}, '%Y-%m-%d')
                WHEN id % 6 = 5 THEN '2020-01-01' END AS date_received,
           CAST(CAST(total_invoice_cost AS DECIMAL(18, 2)) AS DOUBLE) AS total_invoice_cost
    FROM spend_invoices"""


@query("txt_header", HEADER_SQL)
def txt_header(d):
    return extraction.headers(header_docs(d)).select(
        "doc_id", "vendor_name", "invoice_number", "date_received", "total_invoice_cost"
    )


@query("txt_period", f"""
    SELECT id AS doc_id,
           CASE id % 6 WHEN 0 THEN strftime({_START}, '%m/%d/%Y') || ' - ' || strftime({_START} + 6, '%m/%d/%Y')
                WHEN 1 THEN strftime({_START}, '%d-%b-%Y') || ' - ' || strftime({_START} + 6, '%d-%b-%Y')
                WHEN 4 THEN '1/1/2024 - 1/31/2024'
                ELSE {_US.format(_START)} || ' - ' || {_US.format(f'({_START} + 6)')} END AS payment_period,
           id % 6 IN (0, 1, 4, 5) AS labelled
    FROM spend_invoices""")
def txt_period(d):
    found = extraction.headers(header_docs(d))
    return found.select("doc_id", "payment_period", F.col("period_labelled").alias("labelled"))


@query("fn_parse_period", f"""
    SELECT id AS doc_id, strftime({_START}, '%Y-%m-%d') AS period_start, strftime({_START} + 6, '%Y-%m-%d') AS period_end FROM spend_invoices""")
def fn_parse_period(d):
    start, end = F.col(_START), F.date_add(_START, 6)
    text = F.when(F.col("id") % 2 == 0, F.concat(R.us(start, "dd-MMM-yyyy"), F.lit(" - "), R.us(end, "dd-MMM-yyyy"))).otherwise(
        F.concat(R.us(start, "M/d/yyyy"), F.lit(" to "), R.us(end, "MMM d, yyyy"))
    )
    first, last = dates.parse_period(text)
    return d.spend_invoices().select(F.col("id").alias("doc_id"), first.alias("period_start"), last.alias("period_end"))


@query("fn_parse_date", """
    SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS parsed FROM {orders}""")
def fn_parse_date(d):
    day, key = F.col("o_orderdate"), F.col("o_orderkey") % 6
    # Day-first text only where the day cannot be a month.
    text = (
        F.when((key == 0) & (F.dayofmonth(day) > 12), F.date_format(day, "dd/MM/yyyy"))
        .when(key == 1, F.date_format(day, "dd-MMM-yyyy")).when(key == 2, F.date_format(day, "MMMM d, yyyy"))
        .when(key == 3, F.date_format(day, "ddMMMMyyyy")).when(key == 4, F.date_format(day, "yyyy-MM-dd'T00:00:00'"))
        .otherwise(F.date_format(day, " M/d/yyyy "))
    )
    return d.table("orders").select("o_orderkey", dates.parse_date(text).alias("parsed"))


@query("fn_full_month", """
    SELECT o_orderkey, CAST(month(o_orderdate) AS VARCHAR) || '/1/' || CAST(year(o_orderdate) AS VARCHAR) || ' - ' || CAST(month(o_orderdate) AS VARCHAR)
           || '/' || CAST(day(last_day(o_orderdate)) AS VARCHAR) || '/' || CAST(year(o_orderdate) AS VARCHAR) AS period FROM {orders}""")
def fn_full_month(d):
    name = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "MMMM")).otherwise(F.date_format("o_orderdate", "MMM"))
    return d.table("orders").select("o_orderkey", dates.full_month(name, F.date_format("o_orderdate", "yyyy")).alias("period"))


@query("fn_clean_number", """
    SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS DOUBLE) AS value FROM {orders}""")
def fn_clean_number(d):
    us = F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2)
    european = F.translate(us, ",.", ".,")
    key = F.col("o_orderkey") % 5
    text = (
        F.when(key == 0, F.concat(F.lit("$"), us)).when(key == 1, european).when(key == 2, F.translate(european, ".", " "))
        .when(key == 3, F.concat(F.replace(us, F.lit(","), F.lit(" ")), F.lit(" USD"))).otherwise(F.replace(us, F.lit(","), F.lit("")))
    )
    return d.table("orders").select("o_orderkey", money.clean_number(text).alias("value"))


@query("fn_invoice_no_from_name", """
    SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'ACI05012' || CAST(o_orderkey AS VARCHAR) WHEN 1 THEN 'n' || CAST(o_orderkey AS VARCHAR)
           ELSE 'No code here' END AS number,
           CASE o_orderkey % 3 WHEN 0 THEN 'ACI05012' || CAST(o_orderkey AS VARCHAR) || '_Invoice' WHEN 1 THEN 'n1000' || CAST(o_orderkey AS VARCHAR) END AS other_number
    FROM {orders}""")
def fn_invoice_no_from_name(d):
    key, text = F.col("o_orderkey") % 3, F.col("o_orderkey").cast("string")
    stem = F.when(key == 0, F.concat(F.lit("ACI05012"), text, F.lit("_Invoice - May"))).when(
        key == 1, F.concat(F.lit("bill_n"), text)
    ).otherwise("No code here")
    other = F.when(key == 1, F.concat(F.lit("bill n1000"), text)).otherwise(stem)
    return d.table("orders").select(
        "o_orderkey", coding.invoice_number_from_name(stem).alias("number"),
        coding.other_invoice_number_from_name(other).alias("other_number"),
    )


@query("fn_clean_vendor", """
    SELECT c_custkey, c_name AS vendor, replace(c_name, 'C', 'a') AS folded FROM {customer}""")
def fn_clean_vendor(d):
    key = F.col("c_custkey") % 3
    tail = F.when(key == 0, " - April 2026").when(key == 1, " 4/30/2026 - 31-MAY-2026").otherwise("  ")
    folded = F.concat(F.replace("c_name", F.lit("C"), F.lit("@")), F.lit(" DBA Somebody Else"))
    return d.table("customer").select(
        "c_custkey", documents.clean_vendor(F.concat("c_name", tail)).alias("vendor"),
        documents.clean_service_vendor(folded).alias("folded"),
    )


@query("fn_clean_description", "SELECT p_partkey, p_name || ' ' || p_type AS description FROM {part}")
def fn_clean_description(d):
    text = F.concat(F.lit("12. "), F.lit("04/02/2026 "), "p_name", F.lit("\t \u0000 "), "p_type", F.lit("  "))
    return d.table("part").select("p_partkey", documents.clean_description(text).alias("description"))


def parsed_docs(d):
    """Headers with the summary of the spend lines as their lines."""
    lines = billing(d).withColumnRenamed("invoice_id", "doc_id")
    return extraction.with_lines(extraction.headers(header_docs(d)), lines).withColumns(
        {"has_text": F.col("doc_id") % 40 > 0}
    ).withColumn("confidence", extraction.confidence())


ORACLE_VIEWS["parsed"] = f"""
    SELECT h.*, coalesce(n, 0) AS line_count, coalesce(s, 0) AS line_sum,
           coalesce(h.total_invoice_cost, CASE WHEN s <> 0 THEN CAST(round(s, 2) AS DOUBLE) END) AS total, doc_id % 40 > 0 AS has_text
    FROM ({HEADER_SQL}) h LEFT JOIN (SELECT invoice_id, count(*) AS n, sum(CAST(amount AS DECIMAL(28, 6))) AS s FROM billing GROUP BY 1) l ON l.invoice_id = h.doc_id"""
ORACLE_VIEWS["scored"] = """
    SELECT *, round(least(1.0, (CAST(vendor_name IS NOT NULL AS INT) + CAST(invoice_number IS NOT NULL AS INT) + CAST(date_received IS NOT NULL AS INT)
               + CAST(coalesce(total, 0) <> 0 AS INT) + CAST(line_count > 0 AS INT)) / 5.0
               + CASE WHEN line_count > 0 AND line_sum <> 0 AND abs(line_sum - total) <= greatest(1.0, 0.01 * total) THEN 0.15 ELSE 0 END), 3) AS confidence
    FROM parsed"""


@query("fn_confidence", "SELECT doc_id, CAST(confidence AS DOUBLE) AS confidence FROM scored")
def fn_confidence(d):
    return parsed_docs(d).select("doc_id", "confidence")


@query("txt_quality_gate", """
    SELECT doc_id, NOT has_text OR confidence < 0.8 OR date_received IS NULL OR coalesce(total, 0) = 0 OR line_count = 0 AS needs_help FROM scored""")
def txt_quality_gate(d):
    return parsed_docs(d).select("doc_id", extraction.needs_help().alias("needs_help"))


@query("fn_missing_fields", """
    SELECT id AS doc_id, concat_ws(',', CASE WHEN vendor_name IS NULL THEN 'vendor name' END, CASE WHEN id % 3 = 0 THEN 'supplier number' END,
               CASE WHEN id % 5 = 0 THEN 'service description' END, CASE WHEN total_invoice_cost IS NULL THEN 'total price' END,
               CASE WHEN date_received IS NULL THEN 'date received' END) AS missing,
           CASE WHEN vendor_name IS NULL OR id % 3 = 0 OR id % 5 = 0 OR total_invoice_cost IS NULL OR date_received IS NULL
                THEN 'missing_data' ELSE 'all_data_found' END AS status FROM spend_invoices""")
def fn_missing_fields(d):
    invoices = d.spend_invoices().withColumns(
        {"supplier_number": F.when(F.col("id") % 3 > 0, "S-1"), "has_description": F.col("id") % 5 > 0}
    )
    missing = extraction.service_missing()
    return invoices.select(
        F.col("id").alias("doc_id"), F.array_join(missing, ",").alias("missing"), extraction.service_status(missing).alias("status")
    )


@query("fn_ingest_status", """
    SELECT doc_id, CASE WHEN NOT has_text AND line_count = 0 THEN 'processing_failed' ELSE 'needs_manual_review' END AS status,
           CASE WHEN NOT has_text AND line_count = 0 THEN 'document' ELSE concat_ws(',', CASE WHEN date_received IS NULL THEN 'date_received' END,
                CASE WHEN coalesce(total, 0) = 0 THEN 'total_invoice_cost' END) END AS fields FROM parsed""")
def fn_ingest_status(d):
    done = extraction.ingest_status(parsed_docs(d))
    return done.select("doc_id", "status", F.array_join(F.transform("mismatch_reasons", lambda r: r["field"]), ",").alias("fields"))


@query("agg_period_span", f"""
    SELECT i.id AS doc_id, CASE WHEN id % 6 IN (0, 1, 5) OR s IS NULL AND id % 6 <> 4 THEN {day_text(_START)} WHEN id % 6 = 4 THEN '2024-01-01' ELSE {day_text('s')} END AS period_start,
           CASE WHEN id % 6 IN (0, 1, 5) OR s IS NULL AND id % 6 <> 4 THEN {day_text(f'{_START} + 6')} WHEN id % 6 = 4 THEN '2024-01-31' ELSE {day_text('e')} END AS period_end
    FROM spend_invoices i LEFT JOIN (SELECT invoice_id, min(period_start) AS s, max(period_end) AS e FROM billing GROUP BY 1) l ON l.invoice_id = i.id""")
def agg_period_span(d):
    return extraction.invoice_period(parsed_docs(d)).select(
        "doc_id", F.col("payment_period_start").alias("period_start"), F.col("payment_period_end").alias("period_end")
    )


@query("txt_gap_fill", f"""
    SELECT id AS doc_id, coalesce(vendor_name, 'Fallback') AS vendor_name, coalesce({day_text('date_received')}, '2024-12-31') AS date_received,
           coalesce(total_invoice_cost, 1.0) AS total_invoice_cost FROM spend_invoices""")
def txt_gap_fill(d):
    base = d.spend_invoices().select(
        F.col("id").alias("doc_id"), "vendor_name", "invoice_number", "date_received", F.lit("").alias("payment_period"), "total_invoice_cost"
    )
    second = base.select(
        "doc_id", F.lit("Fallback").alias("vendor_name"), F.lit("X-1").alias("invoice_number"),
        F.to_date(F.lit("2024-12-31")).alias("date_received"), F.lit("all year").alias("payment_period"), F.lit(1.0).alias("total_invoice_cost"),
    )
    return extraction.fill_gaps(base, second).select("doc_id", "vendor_name", "date_received", "total_invoice_cost")


@query("txt_reconcile", f"""
    SELECT invoice_id AS doc_id, t AS total, {exact_cents('s')} AS line_sum FROM (
        SELECT invoice_id, sum(CAST(amount AS DECIMAL(28, 6))) AS s, CASE invoice_id % 3 WHEN 0 THEN CAST(sum(CAST(amount AS DECIMAL(28, 6))) AS DOUBLE)
               WHEN 1 THEN CAST(sum(CAST(amount AS DECIMAL(28, 6))) AS DOUBLE) * 1.5e0 ELSE 0 END AS t FROM billing GROUP BY 1) x
    WHERE invoice_id % 3 = 1 AND t <> 0 AND abs(CAST(s AS DOUBLE) - t) > greatest(1.0, 0.01 * t)""")
def txt_reconcile(d):
    lines = billing(d).withColumnRenamed("invoice_id", "doc_id")
    sums = lines.groupBy("doc_id").agg(F.sum(F.col("amount").cast("decimal(28,6)")).cast("double").alias("s"))
    factor = F.when(F.col("doc_id") % 3 == 0, 1.0).when(F.col("doc_id") % 3 == 1, 1.5).otherwise(0.0)
    totals = sums.select("doc_id", (F.col("s") * factor).alias("total"))
    return line_text.reconcile_totals(totals, lines).withColumn("line_sum", F.round(F.col("line_sum"), 2))


# --- names ------------------------------------------------------------------------------------------------
@query("txt_person_name", "SELECT id, coalesce(contractor_name, 'Balran Quorsel') AS person FROM spend_lines")
def txt_person_name(d):
    key, name = F.col("line_ord") % 5, F.coalesce("contractor_name", F.lit("Balran Quorsel"))
    text = (
        F.when(key == 0, F.concat(F.lit("IT consulting services ("), name, F.lit(")")))
        .when(key == 1, F.concat(F.lit("Software development provided by "), name, F.lit(" - Lead")))
        .when(key == 2, F.concat(F.lit("Mobile App Development - 01-Apr to 30-Apr 2026 - "), name, F.lit(" - Developer")))
        .when(key == 3, F.concat(name, F.lit(" 04/26/2026 - 05/30/2026"))).otherwise(name)
    )
    return d.spend_lines().select("id", documents.person_name(text).alias("person"))


@query("txt_repair_names", """
    SELECT invoice_id AS doc_id, line_ord, contractor_name FROM billing""")
def txt_repair_names(d):
    lines = billing(d).withColumnRenamed("invoice_id", "doc_id")
    damaged = lines.select(
        "doc_id", "line_ord",
        F.when(F.col("line_ord") % 2 == 0, F.regexp_replace("contractor_name", "^(.)[aeiou]", "$1" + extraction.REPLACEMENT))
        .otherwise(F.col("contractor_name")).alias("contractor_name"),
    )
    clean = R.render(billing(d), F.col("contractor_name"), "Scanned page\n", "\nThe end")
    return extraction.repair_names(damaged, clean)


# --- the parse jobs -----------------------------------------------------------------------------------------
MIXED = ("rate_list", "billable", "qty_item", "desc_qty", "unit_rows", "period_blocks", "tables")
_WHICH = f"invoice_id % {len(MIXED)}"
_ROUNDED = f"CAST(round(CAST(hours * {_CENTS.format('rate')} AS DECIMAL(28, 6)), 2) AS DOUBLE)"


def mixed_documents(d):
    """Every invoice in one of the layouts below a common letterhead, and the grids of those whose lines stand in a table."""
    which = F.col("invoice_id") % len(MIXED)
    bodies = None
    for i, layout in enumerate(MIXED[:-1]):
        body = R.rendered(billing(d).filter(which == i), layout)
        bodies = body if bodies is None else bodies.unionByName(body)
    in_grid = billing(d).filter(which == len(MIXED) - 1).select(F.col("invoice_id").alias("doc_id")).distinct()
    bodies = bodies.unionByName(in_grid.withColumn("text", F.lit("see annexure")))
    invoices = d.spend_invoices().select(F.col("id").alias("doc_id"), "invoice_number", "date_received", "total_invoice_cost")
    day, total = F.coalesce("date_received", F.to_date(F.lit("2024-01-15"))), F.coalesce("total_invoice_cost", F.lit(100.0))
    # Blocks and unit rows are too loose for any vendor, so theirs are named.
    vendor = F.concat(F.lit("Vendor "), F.col("doc_id") % 50, F.when(F.col("doc_id") % len(MIXED) == 4, " Unitek").when(F.col("doc_id") % len(MIXED) == 5, " Blockwise").otherwise(""), F.lit(" LLC"))
    head = F.concat(vendor, F.lit("\nInvoice No: "), "invoice_number", F.lit("\nInvoice Date: "), R.us(day, "MM/dd/yyyy"), F.lit("\n"))
    docs = bodies.join(invoices, "doc_id").select("doc_id", F.concat(head, "text", F.lit("\nTotal Amount Due: $"), R.money(total)).alias("text"))
    return docs, person_grid(d).join(in_grid, "doc_id", "left_semi")


def _by_layout(default, **cases):
    whens = " ".join(f"WHEN {MIXED.index(k)} THEN {v}" for k, v in cases.items())
    return f"CASE {_WHICH} {whens} ELSE {default} END"


@query("txt_parse_contractor", f"""
    SELECT invoice_id AS doc_id, 'Vendor ' || CAST(invoice_id % 50 AS VARCHAR) || CASE {_WHICH} WHEN 4 THEN ' Unitek' WHEN 5 THEN ' Blockwise' ELSE '' END || ' LLC' AS vendor_name,
           i.invoice_number, strftime(coalesce(i.date_received, DATE '2024-01-15'), '%Y-%m-%d') AS date_received,
           {_CENTS.format('coalesce(i.total_invoice_cost, 100)')} AS total_invoice_cost, 'x' || CAST({_WHICH} AS VARCHAR) AS layout, count(*) OVER (PARTITION BY invoice_id) AS line_count,
           {_by_layout('contractor_name', billable=_FLIPPED, unit_rows=_FLIPPED)} AS contractor_name, hours,
           {_by_layout(_CENTS.format('rate'), rate_list=WHOLE_RATE, period_blocks=WHOLE_RATE)} AS rate,
           {_by_layout(_CENTS.format('amount'), billable=_ROUNDED, tables=_ROUNDED)} AS amount,
           CASE WHEN {_WHICH} IN (3, 5, 6) THEN {day_text('period_start')} END AS period_start, CASE WHEN {_WHICH} IN (3, 5, 6) THEN {day_text('period_end')} END AS period_end
    FROM billing b JOIN spend_invoices i ON i.id = b.invoice_id""")
def txt_parse_contractor(d):
    """One table of all layouts: header, chosen layout and lines of every document."""
    docs, grids = mixed_documents(d)
    known = parse_jobs.Vendors(only={"unit_rows": "unitek", "period_blocks": "blockwise"})
    parsed, lines = parse_jobs.parse_contractor(docs, grids, known)
    layouts = F.create_map(*[F.lit(x) for i, name in enumerate(MIXED) for x in (name, f"x{i}")])
    heads = parsed.select("doc_id", "vendor_name", "invoice_number", "date_received", "total_invoice_cost", "line_count")
    return heads.join(lines.withColumn("layout", F.element_at(layouts, F.col("layout"))).drop("ord"), "doc_id")


@query("txt_parse_service", f"""
    SELECT invoice_id AS doc_id, 'Seller ' || CAST(invoice_id % 50 AS VARCHAR) || ' LLC' AS vendor_name, 'SV' || CAST(100000 + invoice_id AS VARCHAR) AS invoice_number,
           strftime(coalesce(i.date_received, DATE '2024-01-15'), '%Y-%m-%d') AS date_received,
           CAST(sum(CAST(amount AS DECIMAL(18, 2))) OVER (PARTITION BY invoice_id) AS DOUBLE) AS total_invoice_cost,
           CASE invoice_id % 3 WHEN 0 THEN 'table' WHEN 1 THEN 'text' ELSE 'words' END AS method, count(*) OVER (PARTITION BY invoice_id) AS line_count,
           CASE invoice_id % 3 WHEN 0 THEN 'Plan - ' || contractor_name || ' seat' WHEN 1 THEN contractor_name || ' service' ELSE contractor_name || ' seat wrapped' END AS description,
           hours AS quantity, {_CENTS.format('rate')} AS unit_price, {_CENTS.format('amount')} AS amount
    FROM billing b JOIN spend_invoices i ON i.id = b.invoice_id""")
def txt_parse_service(d):
    """Lines in a table, in the text or as positioned words, dotted dates, and numbers that only the file's name has."""
    which = F.col("invoice_id") % 3
    text = R.rendered(billing(d).filter(which == 1), "service").select("doc_id", F.regexp_replace("text", r"(?s)^.*?\n|\nSubtotal.*$", "").alias("body"))
    invoices = d.spend_invoices().select(F.col("id").alias("doc_id"), F.coalesce("date_received", F.to_date(F.lit("2024-01-15"))).alias("day"))
    sums = billing(d).groupBy(F.col("invoice_id").alias("doc_id")).agg(F.sum(F.col("amount").cast("decimal(18,2)")).alias("total"))
    number = F.concat(F.lit("SV"), F.col("doc_id") + 100000)
    in_name = F.col("doc_id") % 2 == 0
    head = F.concat(F.lit("Seller: Seller "), F.col("doc_id") % 50, F.lit(" LLC\n"), F.when(in_name, "").otherwise(F.concat(F.lit("Invoice No: "), number, F.lit("\n"))), F.lit("issued "), R.us(F.col("day"), "MM.dd.yyyy"), F.lit("\n"))
    rows = F.when(F.col("body").isNotNull(), F.concat(F.col("body"), F.lit("\n"))).otherwise("")
    docs = invoices.join(sums, "doc_id").join(text, "doc_id", "left").select(
        "doc_id", F.concat(head, rows, F.lit("Invoice Total: $"), R.money(F.col("total"))).alias("text"), F.when(in_name, F.concat(number, F.lit(" final"))).alias("file_name")
    )
    grids = service_grid(d).filter(F.col("doc_id") % 3 == 0)
    words = word_table(d).filter(F.col("doc_id") % 3 == 2)
    parsed, lines = parse_jobs.parse_service(docs, grids, words, lambda names: names)
    heads = parsed.select("doc_id", "vendor_name", "invoice_number", "date_received", "total_invoice_cost", "method", "line_count")
    return heads.join(lines.drop("ord"), "doc_id")


# --- grids --------------------------------------------------------------------------------------------------
def _grid(d, header, row, footer):
    """One grid per invoice: a title row, the header, the rows in order, a footer."""
    rows = billing(d).select("invoice_id", "line_ord", row.alias("row"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("line_ord", "row"))), lambda r: r["row"])
    return rows.groupBy(F.col("invoice_id").alias("doc_id")).agg(ordered.alias("rows")).select(
        "doc_id", F.lit(1).alias("table_ord"),
        F.concat(F.array(header), F.col("rows"), F.array(footer)).alias("cells"),
    )


def _texts(*values):
    return F.array(*[F.lit(v) if isinstance(v, str) else v for v in values])


def person_grid(d):
    period = F.concat(F.col("contractor_name"), F.lit(" "), R.us(F.col("period_start"), "MM/dd/yyyy"), F.lit(" - "), R.us(F.col("period_end"), "MM/dd/yyyy"))
    row = _texts(period, F.col("hours").cast("int").cast("string"), R.money(F.col("rate")), F.lit(""))
    return _grid(d, _texts("Resource Name", "Units", "Rate", "Amount"), row, _texts("Grand Total", "1", "", "9.00"))


# Amount is derived, and a second, smaller table competes.
@query("txt_table_rows", lines_sql(period=PERIOD, amount=f"CAST(round(CAST(hours * {_CENTS.format('rate')} AS DECIMAL(28, 6)), 2) AS DOUBLE)"))
def txt_table_rows(d):
    grids = person_grid(d).withColumn("cells", F.concat(F.array(_texts("Annexure", "", "", "")), F.col("cells")))
    summary = grids.select("doc_id", F.lit(2).alias("table_ord"), F.array(_texts("Description", "Amount"), _texts("All work", "1.00")).alias("cells"))
    rows = grid_text.largest_table(grid_text.table_rows(grids.unionByName(summary)))
    return rows.select("doc_id", "contractor_name", "hours", "rate", "amount", "period_start", "period_end")


@query("txt_table_stacked", f"""
    SELECT invoice_id AS doc_id, contractor_name, hours, {_CENTS.format('rate')} AS rate,
           {_CENTS.format('amount')} AS amount FROM billing""")
def txt_table_stacked(d):
    def stack(value):
        pairs = F.sort_array(F.collect_list(F.struct(F.col("line_ord"), value.alias("v"))))
        return F.array_join(F.transform(pairs, lambda p: p["v"]), "\n")

    printed = F.concat(F.lit("Services Rendered for: "), F.col("contractor_name"), F.lit(" - Product Manager"))
    stacked = billing(d).groupBy(F.col("invoice_id").alias("doc_id")).agg(
        stack(printed).alias("n"), stack(F.col("hours").cast("int").cast("string")).alias("h"),
        stack(R.money(F.col("rate"))).alias("r"), stack(F.concat(F.lit("$"), R.money(F.col("amount")))).alias("a"),
    )
    grids = stacked.select(
        "doc_id", F.lit(1).alias("table_ord"), F.array(_texts("Description", "Quantity", "Rate", "Amount"), F.array("n", "h", "r", "a")).alias("cells")
    )
    return grid_text.stacked_rows(grids).select("doc_id", "contractor_name", "hours", "rate", "amount")


def service_grid(d):
    row = _texts("Plan", F.concat(F.col("contractor_name"), F.lit("\nseat")), F.col("hours").cast("int").cast("string"), R.money(F.col("rate")), "0.00", F.concat(F.lit("$"), R.money(F.col("amount")), F.lit("T")))
    header = _texts("Product", "Service Description", "Qty", "Unit Price", "Tax Amount", "Amount")
    return _grid(d, header, row, _texts("", "Subtotal", "", "", "", "$9.00"))


SERVICE_SQL = f"""
    SELECT invoice_id AS doc_id, 'Plan - ' || contractor_name || ' seat' AS description, hours AS quantity,
           {_CENTS.format('rate')} AS unit_price, {_CENTS.format('amount')} AS amount FROM billing"""


@query("txt_other_table", SERVICE_SQL)
def txt_other_table(d):
    return grid_text.service_rows(service_grid(d)).select("doc_id", "description", "quantity", "unit_price", "amount")


@query("rank_best_table", SERVICE_SQL)
def rank_best_table(d):
    """A detail appendix with more rows but a weaker heading loses against the billing table."""
    billing_table = service_grid(d)
    rows = F.slice("cells", 2, F.size("cells"))
    appendix = billing_table.select(
        "doc_id", F.lit(0).alias("table_ord"),
        F.concat(F.array(_texts("Product", "Item", "Qty", "Unit Price", "Tax Amount", "Total")), rows, rows).alias("cells"),
    )
    found = grid_text.service_rows(billing_table.unionByName(appendix))
    return grid_text.best_service_table(found).select("doc_id", "description", "quantity", "unit_price", "amount")


# --- goods and services -----------------------------------------------------------------------------------
@query("txt_other_total", f"""
    SELECT id AS doc_id, CASE WHEN total_invoice_cost IS NULL THEN NULL ELSE {_CENTS.format('total_invoice_cost')} END AS total FROM spend_invoices""")
def txt_other_total(d):
    total, key = R.money(F.col("total_invoice_cost")), F.col("id") % 3
    printed = (
        F.when(key == 0, F.concat(F.lit("Invoice Total: $"), total, F.lit("\nBalance Due: $1.00")))
        .when(key == 1, F.concat(F.lit("Sub Total 3.00\nTotal: USD "), total, F.lit("\nTotal Paid 5.00\nBalance Due $2.00")))
        .otherwise(F.concat(F.lit("nothing else\nAmount Due $"), total))
    )
    text = F.coalesce(printed, F.lit("Widget shipment for the month of May"))
    return d.spend_invoices().select(F.col("id").alias("doc_id"), documents.service_total(text).alias("total"))


@query("txt_other_lines", f"""
    SELECT invoice_id AS doc_id, contractor_name || ' service' AS description, hours AS quantity, {_CENTS.format('rate')} AS unit_price,
           {_CENTS.format('amount')} AS amount FROM billing
    UNION ALL SELECT -invoice_id, contractor_name || ' usage', NULL, NULL, {_CENTS.format('amount')} FROM billing""")
def txt_other_lines(d):
    columnar = service_text.text_rows(R.rendered(billing(d), "service"))
    vertical = service_text.text_rows(R.rendered(billing(d), "vertical")).withColumn("doc_id", -F.col("doc_id"))
    return columnar.unionByName(vertical).drop("ord")


def word_table(d):
    """Positioned words: a heading, one row per line, and a wrapped description line below each."""
    lines = billing(d).select(
        F.col("invoice_id").alias("doc_id"), "contractor_name", "hours", "rate", "amount",
        # Rows are placed by their rank among the invoice's lines.
        F.row_number().over(_by_invoice()).alias("n"),
    )
    top = F.lit(40.0) + F.col("n") * 24

    def word(text, x0, y):
        return F.struct(text.cast("string").alias("text"), F.lit(float(x0)).alias("x0"), F.lit(float(x0 + 30)).alias("x1"), y.alias("top"))

    names = F.split("contractor_name", " ")
    row = F.array(
        word(names[0], 10, top), word(names[1], 43, top + 1.5), word(F.lit("seat"), 76, top), word(F.col("hours").cast("int"), 200, top),
        word(R.money(F.col("rate")), 300, top), word(R.money(F.col("amount")), 430, top), word(F.lit("wrapped"), 10, top + 10),
    )
    heading = F.array(
        *[word(F.lit(t), x, F.lit(10.0)) for t, x in (("Service", 10), ("Name", 43), ("Qty", 200), ("Unit", 300), ("Price", 333), ("Total", 430))]
    )
    # The first line of an invoice brings the heading.
    printed = F.when(F.col("n") == 1, F.concat(row, heading)).otherwise(row)
    return lines.select("doc_id", F.explode(printed).alias("w")).select("doc_id", F.lit(1).alias("page"), "w.*")


def _by_invoice():
    from pyspark.sql import Window

    return Window.partitionBy("invoice_id").orderBy("line_ord")


@query("txt_other_words", f"""
    SELECT invoice_id AS doc_id, contractor_name || ' seat wrapped' AS description, hours AS quantity, {_CENTS.format('rate')} AS unit_price,
           {_CENTS.format('amount')} AS amount FROM billing""")
def txt_other_words(d):
    return service_text.word_rows(word_table(d)).drop("ord")


@query("rank_best_candidate", """
    SELECT invoice_id AS doc_id, CASE invoice_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS tier, count(*) * CASE WHEN invoice_id % 3 = 2 THEN 2 ELSE 1 END AS n
    FROM billing GROUP BY invoice_id""")
def rank_best_candidate(d):
    """Three competing sets: halves of the amounts, the amounts, and the amounts split in two rows."""
    lines = billing(d).select(F.col("invoice_id").alias("doc_id"), "amount")
    whole = lines.withColumn("tier", F.lit(1))
    half = lines.withColumn("amount", F.col("amount") * 0.5).withColumn("tier", F.lit(0))
    split = lines.withColumn("amount", F.col("amount") * 0.5).withColumn("tier", F.lit(2))
    candidates = half.unionByName(whole).unionByName(split).unionByName(split)
    sums = lines.groupBy("doc_id").agg(F.sum(F.col("amount").cast("decimal(28,6)")).cast("double").alias("s"))
    # Half totals favour the halves; a far total favours nobody, so the earlier rule decides; else the split wins ties.
    key = F.col("doc_id") % 3
    totals = sums.select("doc_id", F.when(key == 0, F.col("s") * 0.5).otherwise(F.col("s")).alias("total"))
    usable = candidates.filter((F.col("doc_id") % 3 != 1) | (F.col("tier") != 2))
    best = service_text.best_candidate(usable, totals)
    return best.groupBy("doc_id", "tier").agg(F.count(F.lit(1)).alias("n"))


def supplier_of(d):
    def known(names):
        keyed = names.withColumn("vendor_norm", coding.normalize_supplier("vendor"))
        return keyed.join(supplier_numbers(keyed, supplier_index(d.kept("supplier_list"))).select("vendor_norm"), "vendor_norm")

    return known


@query("txt_vendor", """
    SELECT c_custkey AS doc_id, CASE c_custkey % 3 WHEN 2 THEN replace(b.brand, ' ', '') || split_part(b.legal, ' ', 1) ELSE b.brand || ' ' || b.legal END AS vendor
    FROM (SELECT c_custkey, CASE WHEN s % 17 = 16 THEN 1 ELSE s END AS slot
          FROM (SELECT c_custkey, c_custkey % (SELECT count(*) FROM {supplier}) AS s FROM {customer}) x) c JOIN brands b ON b.s_suppkey = c.slot""")
def txt_vendor(d):
    """A document per customer, of one of all suppliers."""
    supplier = F.col("c_custkey") % row_count(d.table("supplier"))
    slot = F.when(supplier % 17 == 16, F.lit(1)).otherwise(supplier)
    docs = d.table("customer").select(F.col("c_custkey").alias("doc_id"), slot.alias("s_suppkey")).join(d.kept("brands"), "s_suppkey")
    key, plain = F.col("doc_id") % 3, F.concat(F.replace("brand", F.lit(" "), F.lit("")), F.split("legal", " ")[0])
    text = (
        F.when(key == 0, F.concat(F.lit("INVOICE\nSeller: "), "brand", F.lit(" "), "legal", F.lit(" Buyer: Somebody Inc\nlines")))
        .when(key == 1, F.concat(F.lit("Invoice No 7\n"), "brand", F.lit(" "), "legal", F.lit(" 12 Main Street\npay pay@pnc.com")))
        .otherwise(F.concat(F.lit("Quxq Shell LLC\npay to a@gmail.com or ar@"), F.lower(plain), F.lit(".com\nThank you, "), plain))
    )
    # The core name of a supplier is known through its legal form.
    return service_text.vendors(docs.select("doc_id", text.alias("text")), supplier_of(d))


@query("txt_vendor_brands", """
    SELECT doc_id, list_distinct(list_filter(list_transform(regexp_extract_all(text, '@([A-Za-z0-9-]+)\\.[A-Za-z][A-Za-z.]{1,}', 1), lambda x: lower(x)),
               lambda x: length(x) >= 3 AND NOT list_contains(string_split('gmail yahoo hotmail outlook live aol icloud me msn proton pnc pncbank wellsfargo chase bankofamerica citibank citi usbank', ' '), x))).len() AS brands
    FROM {documents}""")
def txt_vendor_brands(d):
    return d.table("documents").select("doc_id", F.size(documents.email_brands(F.col("text"))).cast("long").alias("brands"))


@query("src_documents", "SELECT doc_id, length(text) AS chars, md5(text) AS digest FROM {documents}")
def src_documents(d):
    docs = read_document_table(d.spark, f"{d.sf_dir}/documents.parquet")
    return docs.select("doc_id", F.length("text").alias("chars"), F.md5("text").alias("digest"))


# --- templates ------------------------------------------------------------------------------------------------
LINE_PATTERN = r"^(?P<hours>\d+) (?P<name>[A-Za-z ]+) \$(?P<rate>[\d.,]+) \$(?P<amount>[\d.,]+)$"


def template_table(d):
    """A template for each vendor of the spend invoices: even ones read lines by a pattern, odd ones by the headings of a grid."""
    java, groups = templates.translate_pattern(LINE_PATTERN)
    keys = d.spend_invoices().filter("vendor_name is not null").select(F.regexp_extract("vendor_name", r"(\d+)$", 1).cast("long").alias("id")).distinct()
    by_pattern = F.col("id") % 2 == 0

    def spec(strategy, value=None, pattern=None):
        def text(v):
            return F.lit(v).cast("string") if not hasattr(v, "alias") else v

        return F.struct(
            F.lit(strategy).alias("strategy"), text(value).alias("value"), text(pattern).alias("pattern"),
            F.lit(1).alias("group"), F.lit(True).alias("labeled"),
        )

    header = F.create_map(
        F.lit("vendor_name"), spec("constant", F.concat(F.lit("Group "), F.col("id"))),
        F.lit("invoice_number"), spec("regex", pattern=r"Number (\S+)"),
        F.lit("date_received"), spec("regex", pattern=r"Dated (\S+)"),
        F.lit("total_invoice_cost"), spec("regex", pattern=r"Pay \$(\S+)"),
        F.lit("payment_period"), spec("absent"),
    )
    columns = F.create_map(*[F.lit(v) for pair in (("name", "consultant"), ("hours", "hrs"), ("rate", "rate"), ("amount", "amount")) for v in pair])
    return keys.select(
        "id", F.concat(F.lit("group "), "id").alias("vendor_key"), F.concat(F.lit(r"account\s+g"), "id", F.lit(r"\b")).alias("fingerprint_regex"),
        (F.col("id") % 9 > 0).alias("validated"), header.alias("header"), F.when(by_pattern, java).alias("line_pattern"),
        F.create_map(*[F.lit(v) for pair in groups.items() for v in pair]).alias("line_groups"),
        F.lit("^0 ").alias("skip_row_regex"), F.when(~by_pattern, columns).alias("columns"),
    )


def template_docs(d):
    """Documents with their lines printed where the vendor's template reads lines by a pattern, and the grids of the others."""
    vendor = F.regexp_extract("vendor_name", r"(\d+)$", 1)
    invoices = d.spend_invoices().select(F.col("id").alias("doc_id"), "invoice_number", "date_received", "total_invoice_cost", vendor.alias("vendor"))
    in_grid = F.coalesce(F.col("vendor").cast("long") % 2 == 1, F.lit(False))
    line = F.concat(F.col("hours").cast("int").cast("string"), F.lit(" "), "contractor_name", F.lit(" $"), R.money(F.col("rate")), F.lit(" $"), R.money(F.col("amount")))
    body = R.render(billing(d), line, "lines\n", "\n0 Nobody $1.00 $1.00")
    header = F.concat(
        F.lit("Account G"), "vendor", F.lit("\nNumber "), "invoice_number",
        F.coalesce(F.concat(F.lit("\nDated "), F.date_format("date_received", "M/d/yyyy")), F.lit("")),
        F.coalesce(F.concat(F.lit("\nPay $"), R.money(F.col("total_invoice_cost"))), F.lit("")), F.lit("\n"),
    )
    docs = body.join(invoices, "doc_id").select("doc_id", F.concat(header, F.when(in_grid, "see table").otherwise(F.col("text"))).alias("text"))
    row = _texts(F.col("contractor_name"), F.col("hours").cast("int").cast("string"), R.money(F.col("rate")), R.money(F.col("amount")))
    grids = _grid(d, _texts("Consultant", "Hrs", "Rate", "Amount"), row, _texts("Total", "", "", "9.00"))
    return docs, grids.join(invoices.filter(in_grid).select("doc_id"), "doc_id", "left_semi")


VENDOR_NUMBER = "CAST(regexp_extract(i.vendor_name, '(\\d+)$', 1) AS BIGINT)"


@query("join_template_fingerprint", f"""
    SELECT DISTINCT i.id AS doc_id, {VENDOR_NUMBER} AS template_id FROM billing b JOIN spend_invoices i ON i.id = b.invoice_id
    WHERE i.vendor_name IS NOT NULL AND {VENDOR_NUMBER} % 9 > 0""")
def join_template_fingerprint(d):
    return templates.find_templates(template_docs(d)[0], template_table(d))


@query("txt_template_apply", f"""
    SELECT b.invoice_id AS doc_id, 'Group ' || CAST({VENDOR_NUMBER} AS VARCHAR) AS vendor_name, i.invoice_number, {day_text('i.date_received')} AS date_received,
           {_CENTS.format("coalesce(i.total_invoice_cost, sum(CAST(amount AS DECIMAL(18, 2))) OVER (PARTITION BY b.invoice_id))")} AS total_invoice_cost,
           contractor_name, hours, {_CENTS.format('rate')} AS rate, {_CENTS.format('amount')} AS amount
    FROM billing b JOIN spend_invoices i ON i.id = b.invoice_id WHERE i.vendor_name IS NOT NULL AND {VENDOR_NUMBER} % 9 > 0""")
def txt_template_apply(d):
    """Lines of both strategies; a total that is not printed is the sum of the lines."""
    (docs, grids), stored = template_docs(d), template_table(d)
    found = cut_lineage(templates.find_templates(docs, stored))
    headers, lines = templates.template_results(docs, grids, found, stored)
    headers = headers.select("doc_id", "vendor_name", "invoice_number", "date_received", "total_invoice_cost")
    return headers.join(lines.select("doc_id", "contractor_name", "hours", "rate", "amount"), "doc_id")


@query("txt_template_validate", """
    SELECT doc_id, concat_ws(',', CASE doc_id % 5 WHEN 0 THEN 'vendor_name mismatch' END, CASE WHEN doc_id % 7 = 0 THEN 'invoice_number mismatch' END,
               CASE WHEN doc_id % 11 = 0 AND date_received IS NOT NULL THEN 'date_received mismatch' END,
               CASE WHEN doc_id % 13 = 0 AND total IS NOT NULL THEN 'total mismatch' END, CASE WHEN doc_id % 3 = 0 THEN 'line count mismatch' END) AS reasons
    FROM parsed""")
def txt_template_validate(d):
    want = parsed_docs(d).select("doc_id", "vendor_name", "invoice_number", "date_received", "total_invoice_cost", "line_count", "line_sum")
    key = F.col("doc_id")
    got = want.withColumns(
        {
            "vendor_name": F.when(key % 5 == 0, "Zzzz").otherwise(F.upper("vendor_name")),
            "invoice_number": F.when(key % 7 == 0, "X-9").otherwise(F.concat_ws(" ", F.substring("invoice_number", 1, 3), F.substring("invoice_number", 4, 30))),
            "date_received": F.when(key % 11 == 0, F.date_add("date_received", 1)).otherwise(F.col("date_received")),
            "total_invoice_cost": F.when(key % 13 == 0, F.col("total_invoice_cost") * 2 + 5).otherwise(F.col("total_invoice_cost")),
            "line_count": F.when(key % 3 == 0, F.col("line_count") + 1).otherwise(F.col("line_count")),
        }
    )
    return templates.validate(got, want).select("doc_id", F.array_join("reasons", ",").alias("reasons"))


@query("agg_template_hits", """
    SELECT user_id AS template_id, count(*) AS hit_count, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_used_at
    FROM {events} WHERE event_type = 'click' GROUP BY 1""")
def agg_template_hits(d):
    events = d.table("events").select(
        F.when(F.col("event_type") == "click", "template_applied").otherwise("parsed").alias("event"),
        F.to_json(F.struct(F.col("user_id").alias("template_id"))).alias("detail"), F.col("ts").alias("created_at"),
    )
    return templates.template_hits(events)

