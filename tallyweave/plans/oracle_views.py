"""DuckDB views the check statements share: the import and the reconciliation written as plain SQL."""

from __future__ import annotations


def flipped(name: str) -> str:
    return (
        f"CASE WHEN contains({name}, ',') THEN trim(trim(substr({name}, strpos({name}, ',') + 1)) || ' ' "
        f"|| trim(split_part({name}, ',', 1))) ELSE trim({name}) END"
    )


def normalized(name: str) -> str:
    return (
        f"nullif(trim(regexp_replace(regexp_replace(lower({flipped(name)}), '[^a-z0-9\\s]', '', 'g'), "
        f"'\\s+', ' ', 'g')), '')"
    )


def sorted_tokens(norm: str) -> str:
    return f"array_to_string(list_sort(string_split({norm}, ' ')), ' ')"


def supplier_key(name: str) -> str:
    inner = f"regexp_replace(regexp_replace({name}, '\\s*\\([^)]*\\)\\s*$', ''), '-\\d+\\s*$', '')"
    return (
        f"trim(regexp_replace(regexp_replace(regexp_replace(lower({inner}), '[^a-z0-9]+', ' ', 'g'), "
        f"'\\bcom\\b', ' ', 'g'), '\\s+', ' ', 'g'))"
    )


def core_key(norm: str) -> str:
    endings = "incorporated|corporation|limited|company|llc|ltd|inc|corp|llp|plc|pvt|gmbh"
    return f"regexp_replace(replace({norm}, ' ', ''), '({endings})+$', '')"


def class_of_charge(code: str) -> str:
    return (
        f"CASE WHEN contains(lower({code}), 'capital') THEN 'CAPEX' "
        f"WHEN contains(lower({code}), 'operating') THEN 'OPEX' END"
    )


def export_date(text: str) -> str:
    """ISO text, or month/day/two-digit year of this century."""
    return (
        f"CASE WHEN contains({text}, '/') THEN make_date(2000 + CAST(split_part({text}, '/', 3) AS INT), "
        f"CAST(split_part({text}, '/', 1) AS INT), CAST(split_part({text}, '/', 2) AS INT)) "
        f"ELSE TRY_CAST(substr({text}, 1, 10) AS DATE) END"
    )


def exact_cents(value: str) -> str:
    return f"CAST(round(CAST({value} AS DECIMAL(28, 6)), 2) AS DOUBLE)"


def hours_text(value: str) -> str:
    return f"regexp_replace(CAST(CAST(round({value}, 2) AS DECIMAL(28, 2)) AS VARCHAR), '0$', '')"


def day_text(value: str) -> str:
    return f"strftime({value}, '%Y-%m-%d')"


def invoice_key(value: str) -> str:
    return f"regexp_replace(regexp_replace(lower({value}), '\\s+', '', 'g'), '^(\\d+)\\.0$', '\\1')"


_GROUP = "resource_name, date_worked, investment_id, is_time_off, is_posted"
_FIRST = ", ".join(
    f"arg_min({c}, row_order) FILTER (WHERE {c} IS NOT NULL) AS {c}"
    for c in (
        "resource_id", "resource_manager", "investment_name", "investment_manager", "charge_code",
        "task_name", "time_sheet_status", "period_start", "period_finish",
    )
)
_FIELDS = (
    "contractor_name, contractor_name_normalized, hours, date_worked, is_time_off, task_name, time_sheet_status, "
    "is_posted, period_start, period_end, project_id, resource_id, resource_manager, investment_name, "
    "investment_manager, charge_code, capex_opex"
)
_LAST = ", ".join(f"arg_max(struct_pack(v := {c}), entry_order).v AS {c}" for c in _FIELDS.split(", "))

COUNTED = "(coalesce(is_posted, false) OR coalesce(lower(trim(time_sheet_status)) IN ('posted', 'submitted'), false))"

ORACLE_VIEWS: dict[str, str] = {
    "ts_flagged": """
        SELECT * REPLACE (coalesce(resource_name, '') AS resource_name, coalesce(date_worked, '') AS date_worked,
                          coalesce(investment_id, '') AS investment_id, coalesce(TRY_CAST(hours AS DOUBLE), 0) AS hours),
               coalesce(regexp_matches(lower(task_name), 'time\\s*off|\\bpto\\b'), false) AS is_time_off,
               coalesce(lower(trim(time_sheet_status)) = 'posted', false) AS is_posted
        FROM timesheet_raw""",
    "ts_groups": f"""
        SELECT {_GROUP}, sum(CAST(hours AS DECIMAL(28, 6))) AS hours, {_FIRST}
        FROM ts_flagged GROUP BY {_GROUP}""",
    "ts_keyed": f"""
        SELECT substr(sha256(coalesce({normalized('resource_name')}, 'None') || '|'
                   || coalesce(strftime({export_date('date_worked')}, '%Y-%m-%d'), '') || '|' || investment_id || '|'
                   || CAST(CAST(is_time_off AS INT) AS VARCHAR) || '|' || CAST(CAST(is_posted AS INT) AS VARCHAR)), 1, 32)
                   AS source_row_hash,
               concat_ws(chr(1), '0000000000', resource_name, date_worked, investment_id,
                         CAST(CAST(is_time_off AS INT) AS VARCHAR), CAST(CAST(is_posted AS INT) AS VARCHAR)) AS entry_order,
               {flipped('resource_name')} AS contractor_name,
               {normalized('resource_name')} AS contractor_name_normalized,
               CAST(round(hours, 2) AS DOUBLE) AS hours, {export_date('date_worked')} AS date_worked,
               is_time_off, task_name, time_sheet_status, is_posted,
               {export_date('period_start')} AS period_start, {export_date('period_finish')} AS period_end,
               nullif(investment_id, '') AS project_id, resource_id, resource_manager, investment_name,
               investment_manager, charge_code, {class_of_charge('charge_code')} AS capex_opex
        FROM ts_groups""",
    "timesheets": f"""
        SELECT source_row_hash, min(entry_order) AS entry_order, {_LAST}
        FROM ts_keyed GROUP BY source_row_hash""",
    "project_votes": f"""
        SELECT investment_id AS project_id, {class_of_charge('charge_code')} AS capex_opex, count(*) AS votes,
               min(row_order) AS seen
        FROM timesheet_raw WHERE investment_id IS NOT NULL AND {class_of_charge('charge_code')} IS NOT NULL
        GROUP BY ALL""",
    "project_classes": """
        SELECT project_id, capex_opex FROM project_votes
        QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY votes DESC, seen) = 1""",
    "project_titles": """
        SELECT investment_id AS project_id, arg_min(investment_name, row_order) AS project_name
        FROM timesheet_raw WHERE investment_id IS NOT NULL AND investment_name IS NOT NULL GROUP BY ALL""",
    "project_table": """
        SELECT project_id, project_name, capex_opex FROM project_titles FULL JOIN project_classes USING (project_id)""",
    "ts_people": """
        SELECT contractor_name_normalized AS norm, min(entry_order) AS first_seen,
               arg_min(contractor_name, entry_order) AS contractor_name
        FROM timesheets WHERE contractor_name_normalized IS NOT NULL GROUP BY 1""",
    # Lines that are matched, with the person they were made from (if that person has entries).
    "matchable": f"""
        SELECT l.*, v.payment_period_start, v.payment_period_end, p.norm AS resolved, {normalized('l.contractor_name')} AS norm,
               CASE WHEN p.norm IS NULL THEN 'unresolved' ELSE l.made_by END AS method
        FROM invoice_lines l JOIN invoices v ON v.id = l.invoice_id
        LEFT JOIN ts_people p ON p.norm = l.made_from
        WHERE v.invoice_type = 'contractor' AND v.status <> 'processing_failed'""",
    "invoice_shape": """
        SELECT invoice_id, count(*) AS line_count, sum(coalesce(hours, 0)) AS billed_total,
               arg_min(method, line_ord) AS first_method, arg_min(contractor_name, line_ord) AS first_contractor,
               min(line_ord) AS first_ord,
               count(*) > 1 AND bool_and(resolved IS NOT NULL) AND count(DISTINCT resolved) = 1 AS single_person
        FROM matchable GROUP BY invoice_id""",
    "match_spans": """
        SELECT m.*, s.line_count, s.billed_total, s.first_method, s.first_contractor, s.first_ord, s.single_person,
               CASE WHEN single_person OR own_start IS NULL OR own_end IS NULL THEN payment_period_start ELSE own_start END AS s0,
               CASE WHEN single_person OR own_start IS NULL OR own_end IS NULL THEN payment_period_end ELSE own_end END AS s1
        FROM matchable m JOIN invoice_shape s USING (invoice_id)""",
    "match_hours": f"""
        SELECT m.id, sum(CASE WHEN {COUNTED} AND NOT is_time_off AND inside THEN t.hours ELSE 0 END) AS counted,
               sum(CASE WHEN NOT {COUNTED} AND NOT is_time_off AND inside THEN t.hours ELSE 0 END) AS pending,
               arg_min(t.source_row_hash, t.entry_order) FILTER (WHERE {COUNTED} AND NOT is_time_off AND inside) AS first_counted,
               arg_min(t.source_row_hash, t.entry_order) AS first_entry,
               arg_min(t.contractor_name, t.entry_order) AS linked_name
        FROM match_spans m JOIN (SELECT * FROM timesheets) t ON t.contractor_name_normalized = m.resolved,
             LATERAL (SELECT s0 IS NULL OR s1 IS NULL OR coalesce(t.date_worked BETWEEN s0 AND s1, false) AS inside) w
        GROUP BY m.id""",
    "compared": """
        SELECT m.*, coalesce(h.counted, 0) AS counted, coalesce(h.pending, 0) AS pending,
               coalesce(h.first_counted, h.first_entry) AS link, h.linked_name,
               CASE WHEN single_person THEN billed_total ELSE m.hours END AS billed,
               coalesce(CASE WHEN m.resolved IS NULL THEN false
                    ELSE abs(billed - coalesce(h.counted, 0)) <= greatest(1.0, 0.02 * billed) END, false) AS ok
        FROM match_spans m LEFT JOIN match_hours h USING (id)""",
    "invoice_outcomes": """
        SELECT v.*, coalesce(o.lines, 0) AS lines, coalesce(o.matched_lines, 0) AS matched_lines, o.single_person,
               CASE WHEN v.status = 'processing_failed' THEN v.status WHEN o.all_ok THEN 'matched' ELSE 'flagged' END AS new_status
        FROM invoices v LEFT JOIN (SELECT invoice_id, bool_and(ok) AS all_ok, count(*) AS lines,
                count(*) FILTER (WHERE ok) AS matched_lines, bool_or(single_person) AS single_person
            FROM compared GROUP BY invoice_id) o ON o.invoice_id = v.id
        WHERE v.invoice_type = 'contractor'""",
}
