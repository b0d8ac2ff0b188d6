"""Invoice documents rendered from the driver's spend lines, one printed layout each.

Extraction must give back the values that were printed, so the source tables are the expected result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BILLING_SQL = """
    SELECT invoice_id, line_ord, coalesce(contractor_name, 'Balran Quorsel') AS contractor_name, hours,
           coalesce(rate, 10.25e0) AS rate, hours * coalesce(rate, 10.25e0) AS amount,
           DATE '2024-01-01' + CAST(invoice_id % 300 AS INT) AS period_start,
           DATE '2024-01-01' + CAST(invoice_id % 300 + 6 AS INT) AS period_end FROM spend_lines"""


def money(value: Column) -> Column:
    return F.format_number(value.cast("decimal(18,2)"), 2)


def us(day: Column, pattern: str = "M/d/yy") -> Column:
    return F.date_format(day, pattern)


def render(lines: DataFrame, line: Column, header: str = "", footer: str = "") -> DataFrame:
    """``(doc_id, text)``: the lines of an invoice in order, between a header and a footer."""
    return _joined(lines, line, F.lit(header), F.lit(footer))


def _joined(lines: DataFrame, line: Column, header: Column, footer: Column) -> DataFrame:
    rows = lines.select("invoice_id", "line_ord", line.alias("printed"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_ord", "printed"))), lambda r: r["printed"]), "\n")
    return rows.groupBy(F.col("invoice_id").alias("doc_id")).agg(body.alias("body")).select(
        "doc_id", F.concat(header, F.col("body"), footer).alias("text")
    )


def layouts() -> dict[str, tuple[Column, str, str]]:
    """Layout -> (printed line, header, footer)."""
    name, hours = F.col("contractor_name"), F.col("hours").cast("int").cast("string")
    rate, amount = money(F.col("rate")), money(F.col("amount"))
    parts = F.split(name, " ")
    last_first = F.concat_ws(", ", parts[1], parts[0])
    period = F.concat(us(F.col("period_start")), F.lit("-"), us(F.col("period_end")))
    # Whole rates: a rate with cents would itself read as an amount.
    plain_rate = F.floor("rate").cast("string")

    def fmt(*pieces):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces])

    return {
        "rate_list": (fmt("Hours- ", name, "- $", plain_rate, "/hr\n", hours, " hours\n$", amount, " net"), "Staffing note\n", "\nTOTAL DUE $1.00"),
        "billable": (fmt("7 ", last_first, " ...Billable ", hours, ".00 Hours @ ", rate, " No 1.00"), "Item Description Tax\n", "\nThe end"),
        "qty_item": (fmt(hours, " ", name, " $", rate, " $", amount), "Bill To Somebody\nQty Item Rate Amount\n", "\nSubtotal $1.00\nTotal $1.00\n1 of 1"),
        "desc_qty": (fmt(name, "-Scrum Master-Reg Hours (", period, ") ", hours, " ", rate, " ", amount), "DESCRIPTION QTY RATE AMOUNT\n", "\nPayment Information BALANCE DUE $7,030.00\nTotal 1 2.00 3.00"),
        "unit_rows": (fmt(last_first, " Onsite RTIME ", hours, ".00 MHR ", rate, " ", amount), "Name Location Type\n", "\nTotal 10.00 USD 1.00 2.00"),
        "period_blocks": (
            fmt(us(F.col("period_start"), "MMMM d"), " - ", us(F.col("period_end"), "MMMM d"), ", ", us(F.col("period_end"), "yyyy"),
                " Hours- ", name, " $", plain_rate, "/hr ", hours, " hours $", amount),
            "PAY PERIOD BILLABLE\n", "\nTOTAL DUE $9.00 2024",
        ),
        "cells": (fmt("Work ", us(F.col("period_start")), " - ", us(F.col("period_end")), "\n", hours, ".00\n$", rate, "\n", amount), "Contact: Balran Zarton\n", "\nThanks"),
        "service": (fmt(name, " service ", hours, " $", rate, " $", amount), "Seller: Acme LLC\nDescription Quantity Price Amount\n", "\nSubtotal: $1.00\nInvoice Total: $2.00"),
        "vertical": (fmt(name, " usage\n$", amount), "Item and Amount\n", "\nTotal due: $1.00"),
    }


def rendered(lines: DataFrame, layout: str) -> DataFrame:
    line, header, footer = layouts()[layout]
    return render(lines, line, header, footer)


def headers(invoices: DataFrame) -> DataFrame:
    """Invoice headers in several printed styles, by invoice."""
    number, key = F.col("invoice_number"), F.col("id") % 6
    day, total = F.col("date_received"), F.col("total_invoice_cost")
    start, end = F.col("payment_period_start"), F.date_add("payment_period_start", 6)

    def fmt(*pieces):
        return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in pieces])

    period = (
        F.when(key == 0, fmt("Service Period: ", us(start, "MM/dd/yyyy"), " - ", us(end, "MM/dd/yyyy")))
        .when(key == 1, fmt("Billed From Date Billed To Date\nAccount 7 ", us(start, "dd-MMM-yyyy"), " ", us(end, "dd-MMM-yyyy")))
        .when(key == 2, fmt("work of ", us(start, "dd MMMM yyyy"), " to ", us(end, "dd MMMM yyyy")))
        .when(key == 3, fmt("work of ", us(start, "dd-MMM"), " to ", us(end, "dd-MMM"), " 2024"))
        .when(key == 4, fmt("Invoice for the month of ", us(start, "MMMM yyyy")))
        .otherwise(fmt("Time Card by company invoice\n01/01/2020 - 12/31/2020\n", us(start, "MM/dd/yyyy"), " Mon Work 8.00\n",
                       us(end, "MM/dd/yyyy"), " Sun Work 8.00"))
    )
    dated = F.when(day.isNotNull(), fmt("Invoice Date: ", us(day, "MM/dd/yyyy"), "\n")).otherwise("")
    totalled = F.when(total.isNotNull(), fmt("\nTotal Amount Due: $", money(total))).otherwise("")
    vendor = F.when(
        F.col("vendor_name").isNotNull(),
        F.when(key < 3, fmt("Beneficiary Name: ", F.col("vendor_name"), "\n")).otherwise(
            fmt("Tax Invoice\n", F.col("vendor_name"), " Consulting LLC - April 2024\n")
        ),
    ).otherwise("")
    return invoices.select(
        F.col("id").alias("doc_id"), fmt(vendor, "Invoice No: ", number, "\n", dated, period, totalled).alias("text")
    )
