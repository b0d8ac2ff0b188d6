"""Suppliers, approvers, filed accounting, budget routing and the code functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.functions import coding
from tallyweave.operators import suppliers as ops
from tallyweave.plans.oracle_views import ORACLE_VIEWS, core_key, invoice_key, supplier_key
from tallyweave.plans.registry import query
from tallyweave.plans.report_queries import POLICY

_V = supplier_key("vendor_name")
ORACLE_VIEWS.update(
    {
        "supplier_keys": f"""
            SELECT *, {core_key('supplier_norm')} AS core_key FROM (
                SELECT row_idx, {supplier_key('name')} AS supplier_norm, trim(supplier_number) AS supplier_number
                FROM supplier_list) s WHERE supplier_norm <> '' AND supplier_number <> ''""",
        # By construction: printed exactly, as its core name, or with a letter dropped; the rest is unknown.
        "vendor_numbers": """
            SELECT v.c_custkey, v.vendor_name, k.supplier_number,
                   CASE WHEN k.supplier_number IS NOT NULL THEN
                        CASE v.c_custkey % 5 WHEN 1 THEN 'core' WHEN 2 THEN 'similar' ELSE 'exact' END END AS tier
            FROM vendors v LEFT JOIN supplier_keys k ON k.row_idx = v.s_suppkey AND v.c_custkey % 5 <> 3""",
        "filed": f"""
            SELECT {invoice_key('invoice_number')} AS invoice_key, {supplier_key('vendor')} AS filed_vendor,
                   trim(approved_by) AS approver, min(row_order) AS row_order, l_suppkey
            FROM tracker WHERE trim(approved_by) <> '' GROUP BY ALL""",
        "filed_codes": f"""
            SELECT {invoice_key('invoice_number')} AS invoice_key, nullif(trim(cost_center), '') AS cc,
                   nullif(trim(offset_gl_account), '') AS gl, row_order FROM tracker""",
        "lookups": f"""
            SELECT o_orderkey, s_suppkey, {invoice_key('invoice_number')} AS invoice_key, {_V} AS vendor_norm FROM filed_lookups""",
        "filed_sum": """
            SELECT k.invoice_key, c.cost_center, g.offset_gl_account FROM (SELECT DISTINCT invoice_key FROM filed_codes) k
            LEFT JOIN (SELECT invoice_key, string_agg(cc, ', ' ORDER BY f) AS cost_center FROM (
                SELECT invoice_key, cc, min(row_order) AS f FROM filed_codes WHERE cc IS NOT NULL GROUP BY ALL) x GROUP BY 1) c USING (invoice_key)
            LEFT JOIN (SELECT invoice_key, string_agg(gl, ', ' ORDER BY f) AS offset_gl_account FROM (
                SELECT invoice_key, gl, min(row_order) AS f FROM filed_codes WHERE gl IS NOT NULL GROUP BY ALL) x GROUP BY 1) g USING (invoice_key)""",
        "budget": f"""
            SELECT row_idx, {supplier_key('supplier')} AS supplier_norm, lower(product) AS product_norm,
                   CASE WHEN id <> 'TBD' THEN id END AS budget_id, nullif(regexp_extract(cost_center, '^([A-Za-z]{{1,4}}\\d{{3,6}}|\\d{{3,6}})\\b', 1), '') AS cost_center,
                   CASE WHEN approver <> 'Multiple' THEN approver END AS approver, regexp_extract(gl_account, '^\\d+', 0) AS offset_gl_account,
                   CASE WHEN supplier_number = 'n/a' THEN NULL WHEN regexp_full_match(supplier_number, '\\d+') THEN 'S-' || supplier_number
                        ELSE supplier_number END AS supplier_number
            FROM budget_sheet""".replace("{{", "{").replace("}}", "}"),
        "agreed": """
            SELECT supplier_norm, CASE WHEN count(DISTINCT budget_id) = 1 THEN max(budget_id) END AS budget_id,
                   CASE WHEN count(DISTINCT cost_center) = 1 THEN max(cost_center) END AS cost_center,
                   CASE WHEN count(DISTINCT approver) = 1 THEN max(approver) END AS approver,
                   CASE WHEN count(DISTINCT offset_gl_account) = 1 THEN max(offset_gl_account) END AS offset_gl_account,
                   CASE WHEN count(DISTINCT supplier_number) = 1 THEN max(supplier_number) END AS supplier_number
            FROM budget GROUP BY 1""",
    }
)


def vendor_norms(d):
    return d.kept("vendors").select("c_custkey", "vendor_name", coding.normalize_supplier("vendor_name").alias("vendor_norm"))


def index(d):
    return ops.supplier_index(d.kept("supplier_list"))


@query("src_supplier_index", "SELECT row_idx, supplier_norm, supplier_number, core_key FROM supplier_keys")
def src_supplier_index(d):
    return index(d)


@query("rank_first_wins", """
    SELECT supplier_norm, arg_min(supplier_number, row_idx) AS supplier_number FROM (
        SELECT * FROM supplier_keys UNION ALL SELECT row_idx + 1000000, supplier_norm, 'later', core_key FROM supplier_keys) GROUP BY 1""")
def rank_first_wins(d):
    rows = index(d)
    later = rows.withColumn("row_idx", F.col("row_idx") + 1_000_000).withColumn("supplier_number", F.lit("later"))
    return ops.first_numbers(later.unionByName(rows))


@query("fn_normalize_supplier", f"SELECT c_custkey, {_V} AS vendor_norm FROM vendors")
def fn_normalize_supplier(d):
    return vendor_norms(d).select("c_custkey", "vendor_norm")


@query("fn_core_key", f"SELECT c_custkey, {core_key(_V)} AS core_key FROM vendors")
def fn_core_key(d):
    return vendor_norms(d).select("c_custkey", coding.supplier_core_key("vendor_norm").alias("core_key"))


@query("join_supplier_number", """
    SELECT c_custkey, supplier_number, tier FROM vendor_numbers WHERE supplier_number IS NOT NULL""")
def join_supplier_number(d):
    vendors = vendor_norms(d)
    return vendors.join(ops.supplier_numbers(vendors, index(d)), "vendor_norm").select("c_custkey", "supplier_number", "tier")


@query("fn_norm_invoice_no", f"SELECT row_order, {invoice_key('invoice_number')} AS invoice_key FROM tracker")
def fn_norm_invoice_no(d):
    return d.kept("tracker").select("row_order", coding.invoice_number_key("invoice_number").alias("invoice_key"))


@query("src_tracker_index", "SELECT invoice_key, filed_vendor, approver, row_order FROM filed")
def src_tracker_index(d):
    return ops.filed_approvers(d.kept("tracker"))


def lookup_keys(d):
    return d.kept("filed_lookups").select(
        "o_orderkey", coding.invoice_number_key("invoice_number").alias("invoice_key"),
        coding.normalize_supplier("vendor_name").alias("vendor_norm"),
    )


@query("join_approver", """
    WITH per_key AS (SELECT invoice_key, count(DISTINCT approver) AS n, min(approver) AS only_one FROM filed GROUP BY 1),
    per_vendor AS (SELECT invoice_key, l_suppkey, arg_min(approver, row_order) AS approver FROM filed GROUP BY ALL)
    SELECT l.o_orderkey, CASE WHEN n = 1 THEN only_one WHEN l.o_orderkey % 4 <> 2 THEN v.approver END AS approver
    FROM lookups l JOIN per_key k USING (invoice_key)
    LEFT JOIN per_vendor v ON v.invoice_key = l.invoice_key AND v.l_suppkey = l.s_suppkey
    WHERE n = 1 OR (l.o_orderkey % 4 <> 2 AND v.approver IS NOT NULL)""")
def join_approver(d):
    keys = lookup_keys(d)
    found = ops.approvers(keys, ops.filed_approvers(d.kept("tracker")))
    return keys.join(found, ["invoice_key", "vendor_norm"]).select("o_orderkey", "approver")


@query("agg_distinct_concat", "SELECT invoice_key, cost_center FROM filed_sum WHERE cost_center IS NOT NULL")
def agg_distinct_concat(d):
    rows = d.kept("tracker").withColumn("invoice_key", coding.invoice_number_key("invoice_number"))
    return ops.distinct_text(rows, ["invoice_key"], "cost_center", "row_order", "cost_center")


@query("join_tracker_accounting", """
    SELECT o_orderkey, cost_center, offset_gl_account FROM lookups LEFT JOIN filed_sum USING (invoice_key)""")
def join_tracker_accounting(d):
    return lookup_keys(d).join(ops.filed_accounting(d.kept("tracker")), "invoice_key", "left").select(
        "o_orderkey", "cost_center", "offset_gl_account"
    )


@query("src_budget_rows", "SELECT * FROM budget")
def src_budget_rows(d):
    return ops.budget_rows(d.kept("budget_sheet"), POLICY)


@query("fn_code_prefix", """
    SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'DT' || CAST(500 + p_partkey % 400 AS VARCHAR) WHEN 1 THEN '679030' END AS code
    FROM {part}""")
def fn_code_prefix(d):
    cell = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" DT"), 500 + F.col("p_partkey") % 400, F.lit(" - "), "p_name")).when(
        F.col("p_partkey") % 3 == 1, F.concat(F.lit("679030 "), "p_name")
    ).otherwise(F.concat(F.lit("OPEN "), "p_name"))
    return d.table("part").select("p_partkey", coding.code_prefix(cell).alias("code"))


@query("fn_clean_text", """
    SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN p_name END AS value FROM {part}""")
def fn_clean_text(d):
    k = F.col("p_partkey") % 4
    cell = F.when(k == 0, " Multiple ").when(k == 1, "TBD").when(k == 2, "").otherwise(F.concat(F.lit("  "), "p_name"))
    return d.table("part").select("p_partkey", coding.clean_cell(cell).alias("value"))


@query("agg_consensus", "SELECT supplier_norm, cost_center, approver, supplier_number FROM agreed")
def agg_consensus(d):
    return ops.budget_rows(d.kept("budget_sheet"), POLICY).groupBy("supplier_norm").agg(
        *[ops.consensus(c).alias(c) for c in ("cost_center", "approver", "supplier_number")]
    )


def budget_lookups(d):
    """One lookup per part: the exact product, an unrelated text, or none; every fourth vendor reversed."""
    part = d.kept("budget_sheet").select("row_idx", "supplier", "product")
    words = F.split("supplier", " ")
    vendor = F.when(F.col("row_idx") % 4 == 3, F.concat_ws(" ", words[1], words[0])).otherwise(F.upper("supplier"))
    described = F.when(F.col("row_idx") % 3 == 0, F.lower(F.regexp_extract("product", " - (.*)$", 1))).when(
        F.col("row_idx") % 3 == 1, "0123456789"
    ).otherwise("")
    return part.select("row_idx", coding.normalize_supplier(vendor).alias("vendor_norm"), described.alias("description"))


@query("join_budget_route", """
    WITH asked AS (SELECT row_idx, supplier_norm, regexp_extract(product_norm, ' - (.*)$', 1) AS product FROM budget),
    first_rows AS (
        SELECT supplier_norm, regexp_extract(product_norm, ' - (.*)$', 1) AS product, arg_min(row_idx, row_idx) AS first_idx
        FROM budget GROUP BY ALL)
    SELECT a.row_idx, a.row_idx % 3 = 0 AS by_product,
           CASE WHEN a.row_idx % 3 = 0 THEN b.budget_id ELSE g.budget_id END AS budget_id,
           coalesce(CASE WHEN a.row_idx % 3 = 0 THEN b.cost_center END, g.cost_center) AS cost_center,
           coalesce(CASE WHEN a.row_idx % 3 = 0 THEN b.approver END, g.approver) AS approver,
           coalesce(CASE WHEN a.row_idx % 3 = 0 THEN b.offset_gl_account END, g.offset_gl_account) AS offset_gl_account,
           coalesce(CASE WHEN a.row_idx % 3 = 0 THEN b.supplier_number END, g.supplier_number) AS supplier_number
    FROM asked a JOIN agreed g USING (supplier_norm)
    JOIN first_rows f ON f.supplier_norm = a.supplier_norm AND f.product = a.product JOIN budget b ON b.row_idx = f.first_idx""")
def join_budget_route(d):
    lookups = budget_lookups(d)
    routes = ops.budget_routes(lookups, ops.budget_rows(d.kept("budget_sheet"), POLICY))
    return lookups.join(routes, ["vendor_norm", "description"]).select("row_idx", "by_product", *ops.ROUTED)


@query("join_other_accounting", f"""
    WITH per_key AS (SELECT invoice_key, count(DISTINCT approver) AS n, min(approver) AS only_one FROM filed GROUP BY 1),
    per_vendor AS (SELECT invoice_key, l_suppkey, arg_min(approver, row_order) AS approver FROM filed GROUP BY ALL)
    SELECT l.id, CASE WHEN is_listed THEN 'S-' || CAST(l.s_suppkey AS VARCHAR) ELSE a.supplier_number END AS supplier_number,
           a.budget_id, coalesce(f.cost_center, a.cost_center) AS cost_center,
           coalesce(f.offset_gl_account, a.offset_gl_account) AS offset_gl_account,
           coalesce(CASE WHEN n = 1 THEN only_one WHEN is_listed THEN v.approver END, a.approver) AS approver
    FROM other_lookups l
    LEFT JOIN filed_sum f ON f.invoice_key = {invoice_key('l.invoice_number')}
    LEFT JOIN per_key k ON k.invoice_key = {invoice_key('l.invoice_number')}
    LEFT JOIN per_vendor v ON v.invoice_key = {invoice_key('l.invoice_number')} AND v.l_suppkey = l.s_suppkey
    LEFT JOIN agreed a ON NOT is_listed AND a.supplier_norm = {supplier_key('l.vendor_name')}""")
def join_other_accounting(d):
    lookups = d.kept("other_lookups")
    return ops.other_accounting(lookups, d.kept("tracker"), d.kept("supplier_list"), d.kept("budget_sheet"), POLICY)


@query("fn_norm_class", """
    SELECT id, CASE upper(trim(hint)) WHEN 'CAPEX' THEN 'CAPEX' WHEN 'OPEX' THEN 'OPEX' END AS expense_class FROM spend_invoices""")
def fn_norm_class(d):
    return d.kept("spend_invoices").select("id", coding.expense_class_of("hint").alias("expense_class"))


@query("fn_gl_code", """
    SELECT id, CASE upper(trim(hint)) WHEN 'CAPEX' THEN '246010'
           WHEN 'OPEX' THEN CASE WHEN contains(lower(vendor_name), 'customer 7') THEN '667070' ELSE '667040' END ELSE '' END AS gl_code
    FROM spend_invoices""")
def fn_gl_code(d):
    return d.kept("spend_invoices").select("id", POLICY.gl_code(F.col("hint"), F.col("vendor_name")).alias("gl_code"))


@query("fn_cost_center", """
    SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN coalesce(CASE WHEN p_partkey % 5 > 0 THEN 'DT5' END, '')
           ELSE CASE p_partkey % 4 WHEN 0 THEN 'NO100' WHEN 1 THEN 'PU200' ELSE '' END END AS cost_center FROM {part}""")
def fn_cost_center(d):
    k = F.col("p_partkey")
    company = F.when(k % 4 == 0, "NOVA").when(k % 4 == 1, "PULSE").when(k % 4 == 2, "ELSE")
    kind = F.when(k % 3 == 0, "opex ").when(k % 3 == 1, "CAPEX")
    return d.table("part").select("p_partkey", POLICY.cost_center(company, kind, F.when(k % 5 > 0, "DT5")).alias("cost_center"))
