"""Spend report, boards, search and detail views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.functions import money
from tallyweave.functions.coding import Company, Policy
from tallyweave.operators import accounting, boards, report, search
from tallyweave.operators.scale import top_and_rest
from tallyweave.plans.oracle_views import COUNTED, ORACLE_VIEWS, day_text, exact_cents
from tallyweave.plans.registry import query
from tallyweave.plans.timesheet_queries import fresh_folder
from tallyweave.session import cut_lineage

POLICY = Policy(
    companies=(
        Company("PULSE", "20", "PU200", ("/group/pulse",), r"\bpulse"),
        Company("NOVA", "10", "NO100", ("/group", "/group/nova"), r"\bnova"),
    ),
    capex_gl="246010",
    opex_gl="667040",
    opex_gl_by_vendor_text={"customer 7": "667070"},
    supplier_number_prefix="S-",
)

_COMPANY = """CASE lower(trim(line_of_business)) WHEN '/group/pulse' THEN 'PULSE' WHEN '/group' THEN 'NOVA'
              WHEN '/group/nova' THEN 'NOVA' END"""


def company_of(project: str, name: str) -> str:
    return (
        f"coalesce((SELECT company FROM company_map c WHERE c.project_id = {project}), "
        f"CASE WHEN regexp_matches(lower(coalesce({name}, '')), '\\bpulse') THEN 'PULSE' "
        f"WHEN regexp_matches(lower(coalesce({name}, '')), '\\bnova') THEN 'NOVA' END)"
    )


def center_of(company: str) -> str:
    return f"CASE {company} WHEN 'PULSE' THEN 'PU200' WHEN 'NOVA' THEN 'NO100' END"


def code_of(company: str) -> str:
    return f"CASE {company} WHEN 'PULSE' THEN '20' WHEN 'NOVA' THEN '10' END"


ORACLE_VIEWS.update(
    {
        "company_map": f"""
            SELECT project_id, arg_max({_COMPANY}, row_idx) AS company FROM lob_rows
            WHERE {_COMPANY} IS NOT NULL GROUP BY 1""",
        "lob_map": """
            SELECT project_id, arg_max(trim(line_of_business), row_idx) AS lob FROM lob_rows
            WHERE trim(line_of_business) <> '' GROUP BY 1""",
        "linked": """
            SELECT l.*, i.vendor_name, i.invoice_number, i.status AS invoice_status, i.invoice_type,
                   t.contractor_name_normalized AS resolved, t.project_id AS entry_project,
                   t.investment_name AS entry_project_name,
                   coalesce(t.capex_opex, p.capex_opex) AS expense_class,
                   coalesce(l.amount, l.hours * l.rate, 0) AS weight,
                   CASE WHEN l.own_start IS NOT NULL AND l.own_end IS NOT NULL THEN l.own_start
                        WHEN payment_period_end IS NOT NULL THEN payment_period_start END AS s0,
                   CASE WHEN l.own_start IS NOT NULL AND l.own_end IS NOT NULL THEN l.own_end
                        WHEN payment_period_start IS NOT NULL THEN payment_period_end END AS s1
            FROM spend_lines l JOIN spend_invoices i ON i.id = l.invoice_id
            LEFT JOIN timesheets t ON t.source_row_hash = l.matched_timesheet_id
            LEFT JOIN project_table p ON p.project_id = t.project_id""",
        "parts": f"""
            SELECT 'contractor' AS kind,
                   coalesce(expense_class, 'vendor_stated_' || CASE upper(trim(i.hint)) WHEN 'CAPEX' THEN 'capex' WHEN 'OPEX' THEN 'opex' END,
                            'unclassified') AS expense_class,
                   CASE WHEN matched_timesheet_id IS NOT NULL THEN {company_of('entry_project', 'entry_project_name')} END AS company,
                   weight, CAST(NULL AS VARCHAR) AS stored_center
            FROM linked l JOIN spend_invoices i ON i.id = l.invoice_id WHERE l.invoice_type = 'contractor' AND weight <> 0
            UNION ALL
            SELECT 'other', coalesce(CASE trim(offset_gl) WHEN '246010' THEN 'CAPEX' WHEN '667040' THEN 'OPEX' END, 'unclassified'),
                   NULL, total_invoice_cost, nullif(trim(cost_center), '')
            FROM spend_invoices WHERE invoice_type = 'other' AND coalesce(total_invoice_cost, 0) <> 0""",
        "class_spend": f"""
            SELECT expense_class, {exact_cents('sum(CAST(weight AS DECIMAL(28, 6)))')} AS amount,
                   round(100 * CAST(sum(CAST(weight AS DECIMAL(28, 6))) AS DOUBLE)
                         / CAST((SELECT sum(CAST(weight AS DECIMAL(28, 6))) FROM parts) AS DOUBLE), 2) AS pct
            FROM parts GROUP BY 1""",
        "distinct_spans": """
            SELECT DISTINCT resolved, s0, s1 FROM linked WHERE resolved IS NOT NULL""",
        "span_entries": f"""
            SELECT s.resolved, s.s0, s.s1, t.* FROM distinct_spans s JOIN timesheets t ON t.contractor_name_normalized = s.resolved
            WHERE {COUNTED} AND NOT is_time_off AND (s0 IS NULL OR s1 IS NULL OR coalesce(date_worked BETWEEN s0 AND s1, false))""",
        "label_hours": """
            SELECT resolved, s0, s1, coalesce(investment_name, project_id, 'Unresolved') AS label, round(sum(hours), 2) AS h
            FROM span_entries GROUP BY ALL HAVING sum(hours) <> 0""",
        "label_totals": "SELECT *, sum(h) OVER (PARTITION BY resolved, s0, s1) AS total FROM label_hours",
        "project_spend": """
            SELECT project, sum(CAST(spend AS DECIMAL(38, 10))) AS spend FROM (
                SELECT coalesce(t.label, 'Unresolved') AS project,
                       CASE WHEN t.label IS NULL THEN weight ELSE weight * (h / total) END AS spend
                FROM (SELECT resolved, s0, s1, CAST(sum(CAST(weight AS DECIMAL(28, 6))) AS DOUBLE) AS weight FROM linked
                      WHERE invoice_type = 'contractor' AND weight <> 0 GROUP BY ALL) l
                LEFT JOIN label_totals t ON t.resolved = l.resolved AND t.s0 IS NOT DISTINCT FROM l.s0 AND t.s1 IS NOT DISTINCT FROM l.s1
                UNION ALL SELECT 'Unresolved', total_invoice_cost FROM spend_invoices
                WHERE invoice_type = 'other' AND total_invoice_cost IS NOT NULL) x GROUP BY 1""",
        "project_top": f"""
            WITH ranked AS (SELECT *, row_number() OVER (ORDER BY spend DESC, project) AS rn FROM project_spend
                            WHERE project <> 'Unresolved' AND spend > 0)
            SELECT least(rn, 6) AS rank, CASE WHEN rn <= 5 THEN project ELSE 'Other' END AS project,
                   {exact_cents('sum(spend)')} AS spend, rn > 5 AS is_rest FROM ranked GROUP BY ALL
            UNION ALL SELECT 7, project, {exact_cents('spend')}, true FROM project_spend WHERE project = 'Unresolved' AND spend > 0""",
        "vendor_totals": """
            SELECT coalesce(vendor_name, 'Unknown vendor') AS vendor, sum(coalesce(CAST(total_invoice_cost AS DECIMAL(28, 6)), 0)) AS spend,
                   count(*) AS invoice_count, arg_min(invoice_type, id) AS type, min(id) AS first_id
            FROM spend_invoices GROUP BY 1""",
        "vendor_top": f"""
            WITH ranked AS (SELECT *, row_number() OVER (ORDER BY spend DESC, first_id) AS rn FROM vendor_totals)
            SELECT least(rn, 16) AS rank, CASE WHEN rn <= 15 THEN vendor ELSE 'Other' END AS vendor, {exact_cents('sum(spend)')} AS spend,
                   CAST(sum(invoice_count) AS BIGINT) AS invoice_count, CASE WHEN rn <= 15 THEN type ELSE 'mixed' END AS type
            FROM ranked GROUP BY ALL""",
        "company_spend": f"""
            SELECT coalesce(company, 'unresolved') AS company, {exact_cents('sum(CAST(weight AS DECIMAL(28, 6)))')} AS spend,
                   {code_of('company')} AS company_code, {center_of('company')} AS cost_center
            FROM parts WHERE kind = 'contractor' GROUP BY ALL""",
        "center_spend": f"""
            SELECT coalesce({center_of('company')}, stored_center, 'unresolved') AS cost_center,
                   {exact_cents('sum(CAST(weight AS DECIMAL(28, 6)))')} AS spend FROM parts GROUP BY 1""",
    }
)


def companies(d):
    return accounting.project_companies(d.kept("lob_rows"), POLICY)


def linked(d, lines=None):
    return accounting.linked_lines(d.spend_invoices(), d.spend_lines() if lines is None else lines, d.timesheets(), d.projects())


def parts(d):
    return report.contributions(d.spend_invoices(), linked(d), companies(d), POLICY)


@query("src_project_company", "SELECT project_id, company FROM company_map")
def src_project_company(d):
    return companies(d)


@query("join_project_company", f"""
    SELECT source_row_hash, {company_of('t.project_id', 't.investment_name')} AS company FROM timesheets t""")
def join_project_company(d):
    return accounting.with_company(d.timesheets(), companies(d), POLICY, "project_id", "investment_name").select(
        "source_row_hash", "company"
    )


@query("join_line_timesheet", """
    SELECT id, resolved, entry_project, entry_project_name, expense_class FROM linked""")
def join_line_timesheet(d):
    return linked(d).select("id", "resolved", "entry_project", "entry_project_name", "expense_class")


@query("join_cost_center", """
    SELECT t.source_row_hash, d.cost_center FROM timesheets t
    LEFT JOIN departments d ON d.contractor_name_normalized = t.contractor_name_normalized""")
def join_cost_center(d):
    codes = d.kept("departments").select("contractor_name_normalized", "cost_center")
    return d.timesheets().join(codes, "contractor_name_normalized", "left").select("source_row_hash", "cost_center")


@query("flt_report_range", f"""
    SELECT id, {day_text('date_received')} AS date_received FROM spend_invoices
    WHERE date_received >= DATE '1996-03-01' AND date_received <= DATE '1997-02-28'""")
def flt_report_range(d):
    return report.in_report_range(d.spend_invoices(), "1996-03-01", "1997-02-28").select("id", "date_received")


_TOTALS_SQL = f"""
    SELECT {exact_cents("sum(coalesce(CAST(total_invoice_cost AS DECIMAL(28, 6)), 0))")} AS combined_spend,
           {exact_cents("sum(coalesce(CAST(total_invoice_cost AS DECIMAL(28, 6)), 0)) FILTER (WHERE invoice_type = 'contractor')")} AS contractor_spend,
           {exact_cents("sum(coalesce(CAST(total_invoice_cost AS DECIMAL(28, 6)), 0)) FILTER (WHERE invoice_type = 'other')")} AS other_spend,
           count(*) AS invoice_count, count(*) FILTER (WHERE invoice_type = 'contractor') AS contractor_invoice_count,
           count(*) FILTER (WHERE invoice_type = 'other') AS other_invoice_count,
           round(avg(parse_confidence) FILTER (WHERE invoice_type = 'contractor'), 2) AS avg_parse_confidence
    FROM spend_invoices"""


@query("agg_report_totals", _TOTALS_SQL)
def agg_report_totals(d):
    return report.report_totals(d.spend_invoices())


@query("agg_status_method_counts", """
    SELECT 'status' AS kind, status AS bucket, count(*) AS invoices FROM spend_invoices GROUP BY ALL
    UNION ALL SELECT 'method', method, count(*) FROM spend_invoices WHERE method <> '' GROUP BY ALL""")
def agg_status_method_counts(d):
    invoices = d.spend_invoices()
    status = report.count_by_status(invoices).select(F.lit("status").alias("kind"), F.col("status").alias("bucket"), "invoices")
    method = report.count_by_method(invoices).select(F.lit("method").alias("kind"), F.col("method").alias("bucket"), "invoices")
    return status.unionByName(method)


@query("agg_capex_opex", "SELECT * FROM class_spend")
def agg_capex_opex(d):
    return report.spend_by_class(parts(d))


@query("agg_by_company", "SELECT * FROM company_spend")
def agg_by_company(d):
    return report.spend_by_company(parts(d), POLICY)


@query("agg_by_cost_center", "SELECT * FROM center_spend")
def agg_by_cost_center(d):
    return report.spend_by_cost_center(parts(d))


@query("set_union_contributions", f"""
    SELECT kind, expense_class, coalesce({center_of('company')}, stored_center, 'unresolved') AS cost_center,
           {exact_cents('sum(CAST(weight AS DECIMAL(28, 6)))')} AS spend FROM parts GROUP BY ALL""")
def set_union_contributions(d):
    return parts(d).groupBy("kind", "expense_class", "cost_center").agg(F.round(F.sum("weight"), 2).alias("spend"))


@query("agg_project_allocation", f"SELECT project, {exact_cents('spend')} AS spend FROM project_spend")
def agg_project_allocation(d):
    spend = report.project_contributions(d.spend_invoices(), linked(d), d.timesheets())
    return spend.withColumn("spend", F.round("spend", 2))


@query("agg_by_project_top", "SELECT * FROM project_top")
def agg_by_project_top(d):
    return report.spend_by_project(report.project_contributions(d.spend_invoices(), linked(d), d.timesheets()))


@query("agg_by_vendor_top", "SELECT * FROM vendor_top")
def agg_by_vendor_top(d):
    return report.spend_by_vendor(d.spend_invoices())


@query("rank_topn_remainder", f"""
    WITH ranked AS (
        SELECT l_suppkey AS supplier, sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS spend,
               row_number() OVER (ORDER BY sum(CAST(l_extendedprice AS DECIMAL(18, 2))) DESC, l_suppkey) AS rn
        FROM {{lineitem}} GROUP BY l_suppkey)
    SELECT least(rn, 8) AS rank, CASE WHEN rn <= 7 THEN CAST(supplier AS VARCHAR) ELSE 'Other' END AS supplier,
           CAST(sum(spend) AS DOUBLE) AS spend, rn > 7 AS is_rest FROM ranked GROUP BY ALL""")
def rank_topn_remainder(d):
    spend = d.table("lineitem").groupBy("l_suppkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("spend"))
    labelled = spend.withColumn("supplier", F.col("l_suppkey").cast("string"))
    return top_and_rest(labelled, "supplier", [F.desc("spend"), F.asc("l_suppkey")], 7, ["spend"])


_TREND_SQL = f"""
    SELECT strftime(date_received, '%Y-%m') AS month,
           {exact_cents("sum(CASE WHEN invoice_type <> 'other' THEN coalesce(CAST(total_invoice_cost AS DECIMAL(28, 6)), 0) ELSE 0 END)")} AS contractor_spend,
           {exact_cents("sum(CASE WHEN invoice_type = 'other' THEN coalesce(CAST(total_invoice_cost AS DECIMAL(28, 6)), 0) ELSE 0 END)")} AS other_spend,
           count(*) AS invoice_count
    FROM spend_invoices WHERE date_received IS NOT NULL GROUP BY 1"""


@query("agg_monthly_trend", _TREND_SQL)
def agg_monthly_trend(d):
    return report.monthly_trend(d.spend_invoices())


@query("agg_kpis", """
    SELECT round(100.0 * (SELECT count(*) FROM spend_invoices WHERE status = 'matched')
                 / (SELECT count(*) FROM spend_invoices WHERE invoice_type = 'contractor'), 0) AS matched_pct,
           round(100.0 * sum(amount) FILTER (WHERE expense_class = 'CAPEX') / sum(amount), 0) AS capex_pct FROM class_spend""")
def agg_kpis(d):
    invoices = d.spend_invoices()
    return report.kpis(report.report_totals(invoices), report.count_by_status(invoices), report.spend_by_class(parts(d)))


def full_report(d):
    return report.spend_report(
        d.spend_invoices(), d.spend_lines(), d.timesheets(), d.projects(), companies(d), POLICY
    )


@query("flt_nonzero", """
    SELECT 'class' AS chart, expense_class AS bucket, amount AS value FROM class_spend WHERE amount > 0
    UNION ALL SELECT 'company', company, spend FROM company_spend WHERE spend > 0
    UNION ALL SELECT 'cost_center', cost_center, spend FROM center_spend WHERE spend > 0
    UNION ALL SELECT 'vendor', vendor, spend FROM vendor_top WHERE spend > 0
    UNION ALL SELECT 'project', project, spend FROM project_top WHERE spend > 0""")
def flt_nonzero(d):
    return report.chart_rows(full_report(d))


# Every part of the report document: its fields with their types, and the statement that checks it.
_METHODS = "SELECT method, count(*) AS invoices FROM spend_invoices WHERE method <> '' GROUP BY ALL"
_PARTS = {
    "totals": (
        "combined_spend double, contractor_spend double, other_spend double, invoice_count long, contractor_invoice_count long, other_invoice_count long, avg_parse_confidence double",
        _TOTALS_SQL,
    ),
    "status_counts": ("status string, invoices long", "SELECT status, count(*) AS invoices FROM spend_invoices GROUP BY ALL"),
    "method_counts": ("method string, invoices long", _METHODS),
    "capex_opex": ("expense_class string, amount double, pct double", "SELECT * FROM class_spend"),
    "by_company": ("company string, spend double, company_code string, cost_center string", "SELECT * FROM company_spend"),
    "by_cost_center": ("cost_center string, spend double", "SELECT * FROM center_spend"),
    "by_vendor": ("rank int, vendor string, spend double, invoice_count long, type string", "SELECT * FROM vendor_top"),
    "by_project": ("rank int, project string, spend double, is_rest boolean", "SELECT * FROM project_top"),
    "monthly_trend": ("month string, contractor_spend double, other_spend double, invoice_count long", _TREND_SQL),
}


def _fields(part):
    return [tuple(f.split()) for f in _PARTS[part][0].split(", ")]


def _part_sql(part):
    cells = [
        f"coalesce(CAST({f'CAST(round({name}, 2) AS DECIMAL(28, 2))' if kind == 'double' else name} AS VARCHAR), '')" for name, kind in _fields(part)
    ]
    order = _fields(part)[0][0]
    return f"SELECT '{part}' AS part, row_number() OVER (ORDER BY {order}) AS place, {" || '|' || ".join(cells)} AS cells FROM ({_PARTS[part][1]}) {part}_rows"


@query("snk_report_json", " UNION ALL ".join(_part_sql(part) for part in _PARTS))
def snk_report_json(d):
    """The whole document read back: every row of every part, in its place."""
    # One row; its parts are taken from it, not computed again.
    document = cut_lineage(report.report_document(full_report(d)))
    shape = ", ".join(f"{part} {'struct<{}>' if part == 'totals' else 'array<struct<{}>>'}".format(", ".join(f"{n}: {k.replace('long', 'bigint')}" for n, k in _fields(part))) for part in _PARTS)
    parsed = document.select(F.from_json("report", shape).alias("r"))

    def cells(part):
        rows = parsed.select(F.posexplode(F.array("r.totals") if part == "totals" else F.col(f"r.{part}")).alias("place", "row"))
        texts = []
        for name, kind in _fields(part):
            value = F.round(f"row.{name}", 2).cast("decimal(28,2)") if kind == "double" else F.col(f"row.{name}")
            texts.append(F.coalesce(value.cast("string"), F.lit("")))
        return rows.select(F.lit(part).alias("part"), (F.col("place") + 1).alias("place"), F.concat_ws("|", *texts).alias("cells"))

    whole = None
    for part in _PARTS:
        whole = cells(part) if whole is None else whole.unionByName(cells(part))
    return whole


# --- boards -----------------------------------------------------------------------------------------
_BOARD_ORDER = "created_at DESC, id DESC"


@query("flt_board_contractor", """
    SELECT id, CASE WHEN status = 'matched' THEN 'matched' ELSE 'flagged' END AS board_column FROM spend_invoices
    WHERE invoice_type = 'contractor' AND archived_at IS NULL""")
def flt_board_contractor(d):
    return boards.contractor_board(d.spend_invoices()).select("id", "board_column")


@query("flt_board_other", """
    SELECT id, CASE WHEN status = 'all_data_found' THEN 'found' ELSE 'missing' END AS board_column FROM spend_invoices
    WHERE invoice_type = 'other' AND archived_at IS NULL""")
def flt_board_other(d):
    return boards.other_board(d.spend_invoices()).select("id", "board_column")


@query("flt_history", f"""
    SELECT id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, invoice_type,
           row_number() OVER (PARTITION BY invoice_type ORDER BY {_BOARD_ORDER}) AS rank FROM spend_invoices""")
def flt_history(d):
    """Every invoice with its place in the history of its type."""
    invoices = d.spend_invoices()
    both = boards.ranked_history(invoices, "contractor").unionByName(boards.ranked_history(invoices, "other"))
    return both.select("id", "created_at", "invoice_type", "rank")


@query("flt_search", """
    SELECT id FROM spend_invoices WHERE contains(lower(coalesce(vendor_name, '')), 'mer 12')
        OR contains(lower(coalesce(invoice_number, '')), 'mer 12') OR contains(CAST(id AS VARCHAR), 'mer 12')
    UNION ALL SELECT id FROM spend_invoices WHERE contains(lower(coalesce(vendor_name, '')), '99')
        OR contains(lower(coalesce(invoice_number, '')), '99') OR contains(CAST(id AS VARCHAR), '99')""")
def flt_search(d):
    """Once through the stored index, once by a text that is too short for it."""
    invoices = d.spend_invoices()
    index = search.SearchIndex(d.spark, f"{fresh_folder(d)}/index")
    index.write(invoices, "id", boards.search_fields())
    by_vendor = index.find(invoices, "id", boards.search_fields(), " MER 12")
    return by_vendor.select("id").unionByName(index.find(invoices, "id", boards.search_fields(), "99").select("id"))


@query("flt_timesheet_search", f"""
    SELECT contractor_name, {day_text('date_worked')} AS date_worked, hours, source_row_hash FROM timesheets
    WHERE contains(contractor_name_normalized, 'ran') ORDER BY contractor_name, entry_order""")
def flt_timesheet_search(d):
    """People are indexed, once each; their entries follow."""
    people = d.timesheets().select("contractor_name_normalized").filter("contractor_name_normalized is not null").distinct()
    index = search.SearchIndex(d.spark, f"{fresh_folder(d)}/index")
    index.write(people, "contractor_name_normalized", [F.col("contractor_name_normalized")])
    found = index.find(people, "contractor_name_normalized", [F.col("contractor_name_normalized")], "RAN")
    entries = d.timesheets().join(found, "contractor_name_normalized", "left_semi")
    return boards.search_timesheets(entries, None, None).select("contractor_name", "date_worked", "hours", "source_row_hash")


@query("rank_limit", """
    SELECT project_id, project_name, capex_opex FROM project_table ORDER BY project_id LIMIT 50""")
def rank_limit(d):
    return boards.list_projects(d.projects()).select("project_id", "project_name", "capex_opex")


_SORTS = {
    "default": "", "price_desc": "price DESC, ", "price_asc": "price ASC, ", "date_desc": "received DESC, ", "date_asc": "received ASC, ",
}


@query("rank_board_sort", f"""
    WITH cards AS (SELECT *, coalesce(total_invoice_cost, 0) AS price, coalesce(date_received, DATE '1970-01-01') AS received
                   FROM spend_invoices WHERE invoice_type = 'contractor' AND archived_at IS NULL)
    {' UNION ALL '.join(f"SELECT '{key}' AS sort_key, id, row_number() OVER (ORDER BY {order}{_BOARD_ORDER}) AS rank FROM cards" for key, order in _SORTS.items())}""")
def rank_board_sort(d):
    """The place of every card in each of the five orders."""
    cards = boards.contractor_board(d.spend_invoices())
    ranked = None
    for key in _SORTS:
        places = boards.ranked_board(cards, key).select(F.lit(key).alias("sort_key"), "id", "rank")
        ranked = places if ranked is None else ranked.unionByName(places)
    return ranked


@query("agg_invoice_card", """
    SELECT i.id, count(l.id) AS line_item_count, count(l.id) FILTER (WHERE l.line_status = 'matched') AS matched_line_count,
           any_value(i.method) AS parse_method
    FROM spend_invoices i LEFT JOIN spend_lines l ON l.invoice_id = i.id WHERE i.invoice_type = 'contractor' GROUP BY i.id""")
def agg_invoice_card(d):
    contractor = d.spend_invoices().filter("invoice_type = 'contractor'")
    return boards.invoice_cards(contractor, d.spend_lines()).select("id", "line_item_count", "matched_line_count", "parse_method")


def other_invoices(d):
    """Other invoices with a complete extraction record."""
    raw = F.col("raw_extraction")
    absent = F.array_compact(
        F.array(
            F.when(F.col("vendor_name").isNull(), "vendor name"), F.when(F.col("total_invoice_cost").isNull(), "total price"),
            F.when(F.col("date_received").isNull(), "date received"),
        )
    )
    record = F.struct(
        F.concat(F.lit("S-"), F.col("id") % 17).alias("supplier_number"), F.lit("B1").alias("budget_id"),
        raw["cost_center"].alias("cost_center"), raw["offset_gl_account"].alias("offset_gl_account"),
        F.lit(None).cast("string").alias("approver"), absent.alias("missing_fields"), raw["method"].alias("method"),
    )
    return d.spend_invoices().withColumn("raw_extraction", record)


@query("agg_other_card", """
    SELECT i.id, count(l.id) AS line_item_count, 'S-' || CAST(i.id % 17 AS VARCHAR) AS supplier_number,
           any_value(cost_center) AS cost_center, any_value(offset_gl) AS offset_gl_account,
           any_value((vendor_name IS NULL)::INT + (total_invoice_cost IS NULL)::INT + (date_received IS NULL)::INT) AS missing_count
    FROM spend_invoices i LEFT JOIN spend_lines l ON l.invoice_id = i.id WHERE i.invoice_type = 'other' GROUP BY i.id""")
def agg_other_card(d):
    return boards.other_cards(other_invoices(d), d.spend_lines()).select(
        "id", "line_item_count", "supplier_number", "cost_center", "offset_gl_account", "missing_count"
    )


@query("fn_json_field", """
    SELECT id, method, 'S-' || CAST(id % 17 AS VARCHAR) AS supplier_number,
           CASE WHEN vendor_name IS NULL THEN 'vendor name' WHEN total_invoice_cost IS NULL THEN 'total price'
                WHEN date_received IS NULL THEN 'date received' END AS first_missing FROM spend_invoices""")
def fn_json_field(d):
    stored = other_invoices(d).select("id", F.to_json("raw_extraction").alias("raw"))
    return stored.select(
        "id", F.get_json_object("raw", "$.method").alias("method"),
        F.get_json_object("raw", "$.supplier_number").alias("supplier_number"),
        F.get_json_object("raw", "$.missing_fields[0]").alias("first_missing"),
    )


@query("agg_vendor_suggest", """
    SELECT 'vendor' AS kind, vendor_name AS label, count(*) AS invoices,
           vendor_name = (SELECT min(vendor_name) FROM spend_invoices WHERE starts_with(lower(vendor_name), 'customer 1')) AS is_completion
    FROM spend_invoices WHERE contains(lower(vendor_name), 'customer 1') GROUP BY ALL ORDER BY vendor_name""")
def agg_vendor_suggest(d):
    found = boards.vendor_suggestions(d.spend_invoices(), "Customer 1 ", None)
    return found.select(F.lit("vendor").alias("kind"), F.col("vendor_name").alias("label"), "invoices", "is_completion")


@query("agg_vendor_suggest_numbers", f"""
    SELECT id, invoice_number FROM spend_invoices WHERE contains(lower(invoice_number), '-12') OR CAST(id AS VARCHAR) = '-12'
    ORDER BY {_BOARD_ORDER}""")
def agg_vendor_suggest_numbers(d):
    return boards.invoice_suggestions(d.spend_invoices(), "-12", None).select("id", "invoice_number")


@query("agg_detail_totals", f"""
    SELECT t.*, coalesce(c.counted_entries, 0) AS counted_entries, coalesce(c.entries, 0) AS entries, coalesce(c.counted_hours, 0) AS counted_hours FROM (
        SELECT invoice_id, {exact_cents("sum(coalesce(CAST(hours AS DECIMAL(28, 6)), 0))")} AS hours,
               {exact_cents("sum(coalesce(CAST(amount AS DECIMAL(28, 6)), 0))")} AS amount FROM spend_lines GROUP BY 1) t
    LEFT JOIN (
        SELECT m.invoice_id, count(*) FILTER (WHERE {COUNTED} AND NOT t.is_time_off) AS counted_entries, count(*) AS entries,
               {exact_cents(f"coalesce(sum(CAST(t.hours AS DECIMAL(28, 6))) FILTER (WHERE {COUNTED} AND NOT t.is_time_off), 0)")} AS counted_hours
        FROM linked m JOIN timesheets t ON t.contractor_name_normalized = m.resolved
        WHERE m.s0 IS NULL OR m.s1 IS NULL OR t.date_worked BETWEEN m.s0 AND m.s1 GROUP BY 1) c ON c.invoice_id = t.invoice_id""")
def agg_detail_totals(d):
    """Footers of an invoice's lines, and of the entries behind them: n counted of m, with the counted hours."""
    spanned = linked(d).filter("resolved is not null")
    counted = boards.entry_totals(spanned, d.timesheets())
    per_invoice = spanned.select("id", "invoice_id").join(counted, "id").groupBy("invoice_id").agg(
        *[F.sum(c).alias(c) for c in ("counted_entries", "entries")], money.cents(money.exact_sum("counted_hours")).alias("counted_hours")
    )
    totals = boards.detail_totals(d.spend_lines()).join(per_invoice, "invoice_id", "left")
    return totals.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("counted_entries", "entries", "counted_hours")})


@query("flt_file_type", """
    SELECT page_id, ends_with(lower(url), '.pdf') AS ok, CASE WHEN NOT ends_with(lower(url), '.pdf') THEN 'Not a PDF' END AS error
    FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN url || '.PDF' WHEN 1 THEN url || '.pdf' ELSE url END AS url FROM {pages}) p""")
def flt_file_type(d):
    return boards.upload_results(uploads(d)).select("page_id", "ok", "error")


def uploads(d):
    name = F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit(".PDF"))).when(
        F.col("page_id") % 3 == 1, F.concat("url", F.lit(".pdf"))
    ).otherwise(F.col("url"))
    return d.table("pages").select("page_id", name.alias("file_name"))


@query("agg_upload_scope", f"""
    SELECT (SELECT count(*) FROM {{pages}} WHERE page_id % 3 < 2 OR ends_with(lower(url), '.pdf')) AS uploaded,
           (SELECT count(*) FROM {{pages}} WHERE page_id % 3 = 2 AND NOT ends_with(lower(url), '.pdf')) AS failed,
           (SELECT count(DISTINCT contractor_name) FROM invoice_lines) AS people,
           {day_text('min(payment_period_start)')} AS period_start, {day_text('max(payment_period_end)')} AS period_end
    FROM invoices""")
def agg_upload_scope(d):
    return boards.upload_scope(boards.upload_results(uploads(d)), d.invoices(), d.invoice_lines())


# --- detail -----------------------------------------------------------------------------------------
ORACLE_VIEWS["invoice_people"] = "SELECT DISTINCT invoice_id, resolved FROM linked WHERE resolved IS NOT NULL"
ORACLE_VIEWS["detail_rows"] = f"""
    SELECT p.invoice_id, p.resolved, t.* FROM invoice_people p JOIN spend_invoices i ON i.id = p.invoice_id
    JOIN timesheets t ON t.contractor_name_normalized = p.resolved
    WHERE {COUNTED} AND NOT is_time_off AND (payment_period_start IS NULL OR payment_period_end IS NULL
          OR coalesce(date_worked BETWEEN payment_period_start AND payment_period_end, false))"""
ORACLE_VIEWS["project_hours"] = """
    SELECT resolved, s0, s1, project_id, round(sum(hours), 2) AS h,
           arg_min(investment_name, entry_order) FILTER (WHERE investment_name <> '') AS project_name,
           sum(hours) FILTER (WHERE capex_opex = 'CAPEX') AS ch, sum(hours) FILTER (WHERE capex_opex = 'OPEX') AS oh,
           min(entry_order) FILTER (WHERE capex_opex = 'CAPEX') AS cf, min(entry_order) FILTER (WHERE capex_opex = 'OPEX') AS of_,
           min(entry_order) AS first_seen
    FROM span_entries GROUP BY ALL HAVING round(sum(hours), 2) > 0"""
VOTE = "CASE WHEN ch IS NOT NULL AND (oh IS NULL OR ch > oh OR (ch = oh AND cf < of_)) THEN 'CAPEX' WHEN oh IS NOT NULL THEN 'OPEX' END"
ORACLE_VIEWS["splits"] = f"""
    SELECT *, sum(h) OVER (PARTITION BY resolved, s0, s1) AS total, {VOTE} AS project_class,
           {company_of('p.project_id', 'p.project_name')} AS company FROM project_hours p"""
ORACLE_VIEWS["invoice_spend"] = f"""
    SELECT invoice_id, project_id, {exact_cents('sum(CAST(spend AS DECIMAL(38, 10)))')} AS spend FROM (
        SELECT l.invoice_id, CASE WHEN s.total IS NULL THEN l.entry_project ELSE s.project_id END AS project_id,
               CASE WHEN s.total IS NULL THEN weight ELSE weight * (h / total) END AS spend
        FROM (SELECT invoice_id, resolved, s0, s1, entry_project, CAST(sum(CAST(weight AS DECIMAL(28, 6))) AS DOUBLE) AS weight
              FROM linked WHERE weight <> 0 GROUP BY ALL) l
        LEFT JOIN splits s ON s.resolved = l.resolved AND s.s0 IS NOT DISTINCT FROM l.s0 AND s.s1 IS NOT DISTINCT FROM l.s1) x
    WHERE project_id IS NOT NULL GROUP BY ALL"""


def splits(d, joined=None):
    """Projects of the spans of linked lines; ``joined``: those lines, where a caller has them."""
    return accounting.span_projects(accounting.spans_of(linked(d) if joined is None else joined), d.timesheets(), companies(d), POLICY)


@query("agg_project_split", f"""
    SELECT resolved, {day_text('s0')} AS span_start, {day_text('s1')} AS span_end, project_id, project_name,
           CAST(h AS DOUBLE) AS project_hours, project_class, company FROM splits""")
def agg_project_split(d):
    return splits(d).select(
        "resolved", "span_start", "span_end", "project_id", "project_name", "project_hours", "project_class", "company"
    )


@query("agg_invoice_project_spend", "SELECT * FROM invoice_spend")
def agg_invoice_project_spend(d):
    return accounting.invoice_project_spend(linked(d), splits(d))


@query("join_semi_matched", """
    SELECT source_row_hash FROM timesheets WHERE contractor_name_normalized IN (SELECT resolved FROM invoice_people)""")
def join_semi_matched(d):
    linked_people = boards.matched_people(d.spend_lines(), d.timesheets())
    return boards.entries_of_matched(d.timesheets(), linked_people).select("source_row_hash")


@query("agg_person_detail", f"""
    SELECT invoice_id, resolved AS person, {exact_cents('sum(hours)')} AS hours,
           arg_min(struct_pack(v := project_id), entry_order).v AS project_id,
           arg_min(struct_pack(v := investment_manager), entry_order).v AS investment_manager
    FROM detail_rows GROUP BY ALL""")
def agg_person_detail(d):
    found = boards.person_detail(d.spend_invoices(), d.spend_lines(), d.timesheets())
    return found.select("invoice_id", "person", "hours", "project_id", "investment_manager")


@query("agg_project_detail", f"""
    WITH votes AS (
        SELECT invoice_id, project_id, sum(hours) FILTER (WHERE capex_opex = 'CAPEX') AS ch, sum(hours) FILTER (WHERE capex_opex = 'OPEX') AS oh,
               min(entry_order) FILTER (WHERE capex_opex = 'CAPEX') AS cf, min(entry_order) FILTER (WHERE capex_opex = 'OPEX') AS of_,
               array_to_string(list_sort(list(DISTINCT c.cost_center) FILTER (WHERE c.cost_center IS NOT NULL)), ', ') AS codes
        FROM detail_rows r LEFT JOIN departments c ON c.contractor_name_normalized = r.resolved
        WHERE project_id IS NOT NULL GROUP BY ALL),
    shown AS (
        SELECT v.*, p.project_name, coalesce({VOTE}, p.capex_opex) AS cls, {company_of('v.project_id', 'p.project_name')} AS company
        FROM votes v JOIN project_table p ON p.project_id = v.project_id)
    SELECT s.invoice_id, s.project_id, s.project_name, cls AS capex_opex, {code_of('company')} AS cost_code,
           nullif(CASE WHEN cls = 'OPEX' THEN codes ELSE {center_of('company')} END, '') AS cost_center,
           i.vendor_name AS vendor, m.lob, x.spend
    FROM shown s JOIN spend_invoices i ON i.id = s.invoice_id LEFT JOIN lob_map m ON m.project_id = s.project_id
    LEFT JOIN invoice_spend x ON x.invoice_id = s.invoice_id AND x.project_id = s.project_id""")
def agg_project_detail(d):
    people = boards.invoice_people(d.spend_invoices(), d.spend_lines(), d.timesheets())
    return accounting.project_detail(
        d.spend_invoices(), people, boards.billable_of_people(d.timesheets()), accounting.invoice_project_spend(linked(d), splits(d)), d.projects(), companies(d),
        accounting.project_lines_of_business(d.kept("lob_rows")), d.kept("departments"), POLICY,
    )
