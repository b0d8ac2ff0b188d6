import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from tallyweave.functions.coding import Company, Policy
from tallyweave.operators import accounting, export, merges, report, scale, suppliers
from tallyweave.session import cut_lineage

POLICY = Policy(
    companies=(Company("A", "5", "CA", ("/group/a",), r"\balpha"), Company("B", "67", "CB", ("/group/b",), r"\bbeta")),
    capex_gl="246010", opex_gl="667040",
)
SHEETS = "source_row_hash string, entry_order string, contractor_name string, contractor_name_normalized string, hours double, date_worked date, is_time_off boolean, is_posted boolean, time_sheet_status string, project_id string, investment_name string, capex_opex string"


@pytest.fixture(scope="module")
def seed(spark):
    """Two linked entries, a matched and an unmatched contractor invoice, and one other invoice."""
    day = date(2026, 5, 4)
    sheets = spark.createDataFrame(
        [
            ("h1", "1", "Balran Zarton", "balran zarton", 30.0, day, False, True, "Posted", "PR1", "Alpha pad", "CAPEX"),
            ("h2", "2", "Balran Zarton", "balran zarton", 40.0, day, False, True, "Posted", "PR2", "Beta app", "OPEX"),
            ("h3", "3", "Dorbet Wenton", "dorbet wenton", 10.0, day, False, False, "Submitted", "PR2", "Beta app", "OPEX"),
        ],
        SHEETS,
    )
    invoices = spark.createDataFrame(
        [
            (1, "Acme", "INV-1", date(2026, 5, 31), date(2026, 5, 1), date(2026, 5, 31), 1500.0, "matched", "contractor", 0.9, ("rules", None, None, (None,)), "S-1", "Boss"),
            (2, "Beta", "INV-2", date(2026, 6, 1), None, None, 200.0, "flagged", "contractor", 0.7, ("llm", None, None, ("OPEX",)), None, None),
            (3, "Soft", "INV-3", date(2026, 6, 2), None, None, 300.0, "all_data_found", "other", None, ("text", "246010", "CA", (None,)), None, None),
        ],
        "id long, vendor_name string, invoice_number string, date_received date, payment_period_start date, payment_period_end date, total_invoice_cost double, status string, invoice_type string, parse_confidence double, raw_extraction struct<method: string, offset_gl_account: string, cost_center: string, accounting_hint: struct<capex_opex: string>>, supplier_number string, approver string",
    )
    lines = spark.createDataFrame(
        [
            ("1-1", 1, 1, "Balran Zarton", 70.0, 100.0, 1000.0, "h1", "matched", (None, None)),
            ("1-2", 1, 2, "Dorbet Wenton", 10.0, 50.0, 500.0, "h3", "matched", (None, None)),
            ("2-1", 2, 1, "Somebody", 2.0, 100.0, None, None, "flagged", (None, None)),
        ],
        "id string, invoice_id long, line_ord long, contractor_name string, hours double, rate double, amount double, matched_timesheet_id string, line_status string, extra struct<period_start: date, period_end: date>",
    )
    projects = spark.createDataFrame([("PR1", "Alpha pad", "CAPEX"), ("PR2", "Beta app", "OPEX")], "project_id string, project_name string, capex_opex string")
    lob = spark.createDataFrame([("PR1", 1, "/Group/B"), ("PR1", 2, " /group/a "), ("PR1", 3, "/else")], "project_id string, row_idx long, line_of_business string")
    return sheets, invoices, lines, projects, accounting.project_companies(lob, POLICY)


def test_report(seed):
    sheets, invoices, lines, projects, companies = seed
    whole = report.spend_report(invoices, lines, sheets, projects, companies, POLICY)
    totals = whole.totals.first()
    assert (totals.combined_spend, totals.contractor_spend, totals.other_spend, totals.avg_parse_confidence) == (2000.0, 1700.0, 300.0, 0.8)
    assert {r.expense_class: r.amount for r in whole.capex_opex.collect()} == {"CAPEX": 1300.0, "OPEX": 500.0, "vendor_stated_opex": 200.0}
    assert {r.cost_center: r.spend for r in whole.by_cost_center.collect()} == {"CA": 1300.0, "CB": 500.0, "unresolved": 200.0}
    assert [(r.month, r.invoice_count) for r in whole.monthly_trend.orderBy("month").collect()] == [("2026-05", 1), ("2026-06", 2)]
    projects_spend = {r.project: r.spend for r in whole.by_project.collect()}
    assert projects_spend == {"Beta app": 1071.43, "Alpha pad": 428.57, "Unresolved": 500.0}
    june = report.spend_report(invoices, lines, sheets, projects, companies, POLICY, start="2026-06-01")
    assert (june.totals.first().invoice_count, june.totals.first().combined_spend) == (2, 500.0)
    assert report.kpis(whole.totals, whole.status_counts, whole.capex_opex).first().capex_pct == 65.0
    assert '"combined_spend":2000.0' in report.report_document(whole).first().report


def test_allocation_and_splits(seed):
    sheets, invoices, lines, projects, companies = seed
    linked = accounting.linked_lines(invoices, lines.withColumn("amount", F.lit(7000.0)).filter("id = '1-1'"), sheets, projects)
    splits = accounting.span_projects(accounting.spans_of(linked), sheets, companies, POLICY)
    spend = {r.project_id: r.spend for r in accounting.invoice_project_spend(linked, splits).collect()}
    assert spend == {"PR1": 3000.0, "PR2": 4000.0}


def test_purchase_rows(spark, seed):
    sheets, invoices, lines, projects, companies = seed
    linked = accounting.linked_lines(invoices, lines, sheets, projects)
    splits = accounting.span_projects(accounting.spans_of(linked), sheets, companies, POLICY)
    departments = spark.createDataFrame([("balran zarton", "DT500")], "contractor_name_normalized string, cost_center string")
    coded = export.coded_lines(linked, splits, companies, departments, POLICY)
    rows = [r for r in export.purchase_rows(invoices, coded).orderBy("record", "line_number").collect() if r.invoice_id == 1]
    assert [r.record for r in rows] == [0, 1, 2, 3, 3, 3]
    assert rows[0].text.startswith("﻿Invoice,") and [len(r.text.split(",")) for r in rows] == [177, 73, 177, 73, 73, 73]
    first = rows[3].text.split(",")
    assert first[4:6] == ["1", "Balran Zarton - Beta app - 05/01/2026-05/31/2026 (667040-DT500-PR2)"]
    assert (first[8], first[9], first[15], first[24:27]) == ("100.00", "40", "EA", ["67", "DT500", "667040"])
    assert rows[4].text.split(",")[24:27] == ["5", "CA", "246010"] and rows[5].text.split(",")[24:27] == ["67", "", "667040"]
    draft = export.coded_lines(linked, splits, companies, departments, POLICY, matched_only=True)
    assert draft.filter("invoice_id = 2").count() == 0
    assert {r.id for r in export.exportable(invoices, lines, draft=True).collect()} == {1}


def _plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()


def test_lines_are_numbered_before_they_are_multiplied(spark, seed):
    """Lines that repeat an id, alike or in another span or place; nothing is dealt out after the join that multiplies them."""
    sheets, invoices, lines, projects, companies = seed
    linked = accounting.linked_lines(invoices, lines, sheets, projects)
    again = linked.filter("id = '1-1'")
    moved = again.withColumns({"span_start": F.lit(None).cast("date"), "span_end": F.lit(None).cast("date")})
    splits = accounting.span_projects(accounting.spans_of(linked.unionByName(moved)), sheets, companies, POLICY)
    departments = spark.createDataFrame([("nobody", "DT500")], "contractor_name_normalized string, cost_center string")
    for given in (linked, linked.unionByName(again), linked.unionByName(moved), linked.unionByName(again).unionByName(moved)):
        rows = accounting.line_splits(given, accounting.ranked_splits(splits)).collect()
        ids, expected = {}, []
        for r in rows:
            ids.setdefault(r.id, []).append(r)
        of_invoice = {}
        for own in ids.values():
            own.sort(key=lambda r: (-(r.project_hours or -1), r.first_seen or ""))
            of_invoice.setdefault(own[0].invoice_id, []).append((own[0].line_ord, own))
        for invoice in of_invoice.values():
            ordered = [r for _, own in sorted(invoice, key=lambda x: x[0]) for r in own]
            expected += [(r.id, r.project_id, n) for n, r in enumerate(ordered, 1)]
        coded = export.coded_lines(given, splits, companies, departments, POLICY)
        assert sorted(map(str, ((r.id, r.project_id, r.line_number) for r in coded.collect()))) == sorted(map(str, expected))
    last_join = next(line for line in _plan_of(export.coded_lines(linked, splits, companies, departments, POLICY)) if "Join" in line)
    assert "span_start" in last_join and "project_hours" not in last_join


def test_purchase_rows_take_cells_and_files_from_their_lines(spark, seed):
    """As joins of the multiplied rows would give them, for ids that several invoices have too; nothing is joined after the projects."""
    sheets, invoices, lines, projects, companies = seed
    routed = invoices.unionByName(invoices.filter("id = 1").withColumn("vendor_name", F.lit("Other"))).withColumn("supplier_number", F.lit("S-1")).withColumn("approver", F.lit(None).cast("string"))
    names = spark.createDataFrame([(1, "a.csv"), (1, "b.csv"), (3, "c.csv")], "id long, file_name string")
    departments = spark.createDataFrame([("balran zarton", "DT500")], "contractor_name_normalized string, cost_center string")

    def rows(carried, *files):
        linked = accounting.linked_lines(invoices, carried, sheets, projects)
        splits = accounting.span_projects(accounting.spans_of(linked), sheets, companies, POLICY)
        return export.purchase_rows(routed, export.coded_lines(linked, splits, companies, departments, POLICY), *files)

    def listed(df):
        return sorted(map(str, df.select(sorted(df.columns)).collect()))

    joined = rows(lines)
    assert listed(rows(export.with_invoice_cells(lines, routed))) == listed(joined)
    named = rows(export.with_invoice_cells(lines, routed, names), names)
    assert listed(named) == listed(joined.join(names.withColumnRenamed("id", "invoice_id"), "invoice_id"))
    plan = [line for line in _plan_of(rows(export.with_invoice_cells(lines, routed)).filter("record = 3")) if "Join" in line]
    assert "span_start" in plan[0]


def test_project_detail_moves_its_rows_once(spark, seed):
    """Every invoice of a repeated id has its row, without vendor too; above the groups nothing is joined by the invoice alone."""
    sheets, invoices, lines, projects, companies = seed
    twice = invoices.unionByName(invoices.filter("id = 1").withColumn("vendor_name", F.lit(None).cast("string")))
    linked = accounting.linked_lines(invoices, lines, sheets, projects)
    spend = accounting.invoice_project_spend(linked, accounting.span_projects(accounting.spans_of(linked), sheets, companies, POLICY))
    people = linked.filter("resolved is not null").select("invoice_id", *accounting.SPAN).distinct()
    entries = sheets.withColumn("resolved", F.col("contractor_name_normalized"))
    departments = spark.createDataFrame([("balran zarton", "DT500"), ("dorbet wenton", "DT400")], "contractor_name_normalized string, cost_center string")
    lob = spark.createDataFrame([("PR1", "/group/a")], "project_id string, lob string")
    detail = accounting.project_detail(twice, people, entries, spend, projects, companies, lob, departments, POLICY)
    got = sorted(map(tuple, detail.select("invoice_id", "project_id", "capex_opex", "cost_center", F.coalesce("vendor", F.lit("-")), "lob", "spend").collect()))
    assert got == [
        (1, "PR1", "CAPEX", "CA", "-", "/group/a", 428.57), (1, "PR1", "CAPEX", "CA", "Acme", "/group/a", 428.57),
        (1, "PR2", "OPEX", "DT400, DT500", "-", None, 1071.43), (1, "PR2", "OPEX", "DT400, DT500", "Acme", None, 1071.43),
    ]
    above = []
    for line in _plan_of(detail):
        if "Aggregate" in line:
            break
        above.append(line)
    assert not [line for line in above if re.search(r"Join \[invoice_id#\d+L?\], ", line)]


def test_running_offset_is_exact_over_ranges(spark):
    """Sparse positions, and a group with most of all rows, which several ranges share."""
    rows = spark.range(3000).selectExpr("CASE WHEN id % 7 = 0 THEN id % 3 ELSE 9 END AS g", "id * 100000007 % 1000000000039 AS position", "id % 3 AS n")
    seen = []

    def watch(df):
        kept = cut_lineage(df)
        seen.append(kept)
        return kept

    # As on a cluster with much data: ranges stay apart.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.g, r.position): r.before for r in scale.running_offset(rows, ["g"], "position", "n", "before", watch).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    sums = {}
    for r in sorted(rows.collect(), key=lambda r: (r.g, r.position)):
        assert got[r.g, r.position] == sums.get(r.g, 0)
        sums[r.g] = sums.get(r.g, 0) + r.n
    assert seen[0].filter("g = 9").select("_range").distinct().count() > 1


def test_global_rank(spark):
    """Ranks without gaps over several ranges, descending, ties broken by the last column."""
    rows = spark.range(2000).selectExpr("id", "id % 10 AS price", "'x' AS rank_of").repartition(5)
    got = {r.id: r["rank"] for r in scale.global_rank(rows, [F.desc("price"), F.asc("id")]).collect()}
    expected = sorted(range(2000), key=lambda i: (-(i % 10), i))
    assert got == {i: n + 1 for n, i in enumerate(expected)}
    assert scale.global_rank(rows.limit(0), [F.desc("price")]).collect() == []


def test_top_and_rest(spark):
    rows = spark.createDataFrame([("a", 5), ("b", 9), ("c", 1), ("d", 2)], "label string, n long")
    got = scale.top_and_rest(rows, "label", [F.desc("n")], 2, ["n"]).orderBy("rank").collect()
    assert [(r.label, r.n, r.is_rest) for r in got] == [("b", 9, False), ("a", 5, False), ("Other", 3, True)]
    assert scale.top_and_rest(rows, "label", [F.desc("n")], 4, ["n"]).count() == 4


def test_suppliers(spark):
    listed = spark.createDataFrame(
        [(1, "Acme Technologies Inc-300001 (07001)", "S-1"), (2, "ACME TECHNOLOGIES INC", "S-2"), (3, "Bolt Corp", "S-3"), (4, "Bolt LLC", "S-4"), (5, "", "S-5"), (6, "Nameless", " ")],
        "row_idx long, name string, supplier_number string",
    )
    index = suppliers.supplier_index(listed)
    names = ["acme technologies inc", "acmetechnologieslimited", "acme technologis inc", "bolt ltd", "zzz"]
    asked = spark.createDataFrame([(n,) for n in names], "vendor_norm string")
    got = {r.vendor_norm: (r.supplier_number, r.tier) for r in suppliers.supplier_numbers(asked, index).collect()}
    assert got["acme technologies inc"] == ("S-1", "exact") and got["acme technologis inc"] == ("S-1", "similar")
    assert "zzz" not in got and "acmetechnologieslimited" not in got  # two numbers share the core name


def test_upserted_invoices_keep_their_id(spark):
    columns = "id long, invoice_number string, stored_file string, invoice_type string, archived_at timestamp"
    line = "invoice_id long, hours double"
    stored = merges.InvoiceTables(
        spark.createDataFrame([(1, "A", "f1", "contractor", None), (2, None, "f2", "contractor", None)], columns),
        spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 3.0)], line),
    )
    incoming = merges.InvoiceTables(
        spark.createDataFrame([(10, "A", "f9", "contractor", None), (11, "B", "f2", "contractor", None), (12, "C", "f3", "contractor", None)], columns),
        spark.createDataFrame([(10, 9.0), (12, 8.0)], line),
    )
    merged = merges.upsert_invoices(stored, incoming)
    assert sorted(r.id for r in merged.invoices.collect()) == [1, 2, 12]
    assert sorted((r.invoice_id, r.hours) for r in merged.lines.collect()) == [(1, 9.0), (12, 8.0)]


def test_parses_of_one_batch_meet_before_the_store(spark):
    columns = "id long, invoice_number string, stored_file string, invoice_type string, archived_at timestamp"
    line = "invoice_id long, hours double"
    stored = merges.InvoiceTables(
        spark.createDataFrame([(1, "A", "f1", "contractor", None)], columns), spark.createDataFrame([(1, 1.0)], line)
    )
    parses = [
        (10, "A", "f8"), (11, "A", "f9"),  # one stored number twice: the last
        (12, "N", "f3"), (13, "N", "f4"),  # one new number twice: the last
        (14, "B", "f1"),  # finds invoice 1 by file, which number A has taken: new
        (15, None, "f5"), (16, "D", "f5"),  # one new file twice: the last
        (17, None, None), (18, None, None),  # nothing to find them by: both new
    ]
    incoming = merges.InvoiceTables(
        spark.createDataFrame([(*p, "contractor", None) for p in parses], columns),
        spark.createDataFrame([(p[0], float(p[0])) for p in parses], line),
    )
    merged = merges.upsert_invoices(stored, incoming)
    assert {(r.id, r.invoice_number, r.stored_file) for r in merged.invoices.collect()} == {
        (1, "A", "f9"), (13, "N", "f4"), (14, "B", "f1"), (16, "D", "f5"), (17, None, None), (18, None, None)
    }
    assert sorted((r.invoice_id, r.hours) for r in merged.lines.collect()) == [(1, 11.0), (13, 13.0), (14, 14.0), (16, 16.0), (17, 17.0), (18, 18.0)]


def test_repeated_alias_seeds(spark):
    known = spark.createDataFrame([("J. Roe", "Jan Roe")], "invoice_name string, contractor_name string")
    seeds = spark.createDataFrame([("J. Roe", "Joe Roe", 1), ("J. Roe", "Jay Roe", 2)], "invoice_name string, contractor_name string, seq int")
    assert [tuple(r) for r in merges.seed_aliases(known, seeds, "seq").collect()] == [("J. Roe", "Jay Roe")]


def test_hours_that_cancel_out_leave_a_span_unresolved(spark):
    day = date(2026, 5, 4)
    sheets = spark.createDataFrame(
        [(f"h{i}", str(i), "A B", "a b", hours, day, False, True, "Posted", f"PR{i}", f"P{i}", "CAPEX") for i, hours in enumerate((8.0, -8.0))], SHEETS
    )
    linked = spark.createDataFrame([("a b", day, day, 100.0)], "resolved string, span_start date, span_end date, weight double")
    rows = accounting.allocate_labels(linked, sheets).collect()
    assert [(r["project"], float(r["spend"])) for r in rows] == [("Unresolved", 100.0)]


def test_lines_are_read_once_for_spans_and_for_report_parts(spark, seed, tmp_path):
    sheets, invoices, lines, projects, companies = seed
    lines.write.parquet(f"{tmp_path}/billed")
    stored = spark.read.parquet(f"{tmp_path}/billed")
    whole = report.spend_report(invoices, stored, sheets, projects, companies, POLICY)
    # What follows the written sums knows nothing of the lines.
    for bucket in (whole.capex_opex, whole.by_company, whole.by_cost_center, whole.by_project):
        assert not bucket.inputFiles()
    assert {r.expense_class: r.amount for r in whole.capex_opex.collect()} == {"CAPEX": 1300.0, "OPEX": 500.0, "vendor_stated_opex": 200.0}
    spread = accounting.allocate_labels(accounting.linked_lines(invoices, stored, sheets, projects), sheets)
    assert not spread.inputFiles() and sum(r.spend for r in spread.collect()) == 1700
