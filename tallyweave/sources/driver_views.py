"""Domain views over the driver tables, written in SQL that Spark and DuckDB both run.

``events`` become a timesheet export, invoices billed against it, people and their aliases; ``orders`` and
``lineitem`` become spend invoices; ``supplier`` and ``customer`` become supplier lists and printed vendor
names. Attributes are derived from keys, no rows are dropped. Names are built from syllables that differ in
at least two of three letters, so a printed variant is closest to the name it was made from.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.operators.timesheets import import_rows, projects_of
from tallyweave.session import shared_folder

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

_SYLLABLES = {
    "a": "baldorfengimhukjapkeslitmovnud",
    "b": "ranbetcidgofhuljaskemlipmontuv",
    "c": "zarwenviktolsudrappegnibmokluf",
    "d": "tonselrikpamnuzmevlodkifjanhug",
    "e": "bracledriflogrustatreplisnosku",
    "f": "manberlindoxfumgathedjilkopvuz",
}


def _syllable(table: str, digits: str, position: int) -> str:
    return f"substr('{_SYLLABLES[table]}', 1 + 3 * CAST(substr({digits}, {position}, 1) AS INT), 3)"


def _capital(text: str) -> str:
    return f"upper(substr({text}, 1, 1)) || substr({text}, 2)"


def _spelled(table: str, digits: str) -> str:
    for i in range(10):
        digits = f"replace({digits}, '{i}', '{_SYLLABLES[table][3 * i : 3 * i + 3]}')"
    return digits


def six_digits(number: str) -> str:
    """SQL for the last six digits of a number."""
    return f"right(lpad(CAST({number} AS STRING), CAST(greatest(6, length(CAST({number} AS STRING))) AS INT), '0'), 6)"


def two_names(digits: str, number: str) -> tuple[str, str]:
    """SQL for a first and a last name spelled from a number and the text of its last six digits; those before them end the last name."""
    above = f"substr(CAST({number} AS STRING), 1, CAST(length(CAST({number} AS STRING)) - 6 AS INT))"
    first = f"({_syllable('a', digits, 5)} || {_syllable('b', digits, 6)})"
    tail = f"CASE WHEN {number} >= 10000 THEN {_syllable('e', digits, 1)} || {_syllable('f', digits, 2)} ELSE '' END"
    more = f"CASE WHEN {number} >= 1000000 THEN {_spelled('a', above)} ELSE '' END"
    last = f"({_syllable('c', digits, 3)} || {_syllable('d', digits, 4)} || {tail} || {more})"
    return _capital(first), _capital(last)


_FIRST, _LAST = two_names("digits", "user_id")
_BRAND_FIRST, _BRAND_LAST = two_names("digits", "s_suppkey")

VIEWS: dict[str, str] = {
    "event_days": """
        SELECT event_id, user_id, event_type, value,
               CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
               CAST(ts AS DATE) AS worked,
               CAST(floor((dayofyear(ts) - 1) / 7) AS INT) AS week,
               CAST(CASE WHEN (dayofyear(ts) - 1) % 7 < 3 THEN 0 ELSE 1 END AS INT) AS half
        FROM {events}""",
    "people": f"""
        SELECT user_id, {_FIRST} AS first_name, {_LAST} AS last_name
        FROM (SELECT user_id, {six_digits('user_id')} AS digits
              FROM (SELECT DISTINCT user_id FROM event_days) u) p""",
    "timesheet_raw": """
        SELECT lpad(CAST(event_id AS STRING), 20, '0') AS row_order,
               last_name || ', ' || first_name AS resource_name,
               'Manager ' || CAST(e.user_id % 7 AS STRING) AS resource_manager,
               CASE event_type WHEN 'purchase' THEN 'Posted' WHEN 'click' THEN ' Submitted' WHEN 'view' THEN 'Open'
                    WHEN 'signup' THEN 'Approved' ELSE 'posted' END AS time_sheet_status,
               CAST(DATE '2024-01-01' + CAST(7 * week AS INT) AS STRING) AS period_start,
               CAST(DATE '2024-01-01' + CAST(7 * week + 6 AS INT) AS STRING) AS period_finish,
               CASE WHEN k > 0 THEN 'PR' || lpad(CAST(k % 20 AS STRING), 5, '0') END AS investment_id,
               CASE WHEN k = 0 OR k % 20 = 19 THEN NULL
                    WHEN k % 4 = 0 THEN 'Nova Portal ' || CAST(k % 20 AS STRING)
                    WHEN k % 4 = 1 THEN 'Pulse App ' || CAST(k % 20 AS STRING)
                    ELSE 'Core Ops ' || CAST(k % 20 AS STRING) END AS investment_name,
               'Lead ' || CAST(k % 5 AS STRING) AS investment_manager,
               CASE k % 3 WHEN 0 THEN 'U100-Capital' WHEN 1 THEN 'X200-Operating' ELSE 'General' END AS charge_code,
               CASE WHEN event_type <> 'error' THEN 'Development' WHEN event_id % 2 = 0 THEN 'PTO' ELSE 'Time Off' END
                   AS task_name,
               CASE WHEN event_id % 2 = 0 THEN CAST(worked AS STRING) || 'T00:00:00'
                    ELSE CAST(month(worked) AS STRING) || '/' || CAST(day(worked) AS STRING) || '/'
                         || substr(CAST(year(worked) AS STRING), 3, 2) END AS date_worked,
               CASE WHEN event_id % 97 = 0 THEN 'n/a' ELSE CAST(floor(value / 10) / 4 AS STRING) END AS hours,
               'R' || CAST(e.user_id AS STRING) AS resource_id
        FROM event_days e JOIN people p ON e.user_id = p.user_id""",
    "aliases": """
        SELECT user_id AS alias_id, 'Worker ' || CAST(user_id AS STRING) AS invoice_name,
               first_name || ' ' || last_name AS timesheet_name
        FROM people""",
    "departments": """
        SELECT user_id, first_name || ' ' || last_name AS contractor_name,
               lower(first_name || ' ' || last_name) AS contractor_name_normalized,
               CASE WHEN user_id % 7 < 6 THEN 'DT' || CAST(500 + user_id % 20 AS STRING) END AS cost_center,
               'Department ' || CAST(user_id % 20 AS STRING) AS department_name,
               CAST(user_id AS STRING) AS resource_id
        FROM people""",
    "billed": """
        SELECT user_id, week, CASE WHEN user_id % 5 = 0 THEN half ELSE 0 END AS half,
               sum(CASE WHEN event_type IN ('purchase', 'click') AND event_id % 97 <> 0
                        THEN floor(value / 10) / 4 ELSE 0e0 END) AS logged
        FROM event_days
        GROUP BY user_id, week, CASE WHEN user_id % 5 = 0 THEN half ELSE 0 END""",
    "billed_lines": """
        SELECT b.user_id, b.week, b.half, b.user_id % (SELECT count(*) FROM {supplier}) AS slot,
               CAST((b.week * 2 + CASE WHEN b.user_id % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT)
                   * greatest(10000000, (SELECT max(user_id) + 1 FROM {events}), (SELECT count(*) FROM {supplier}))
                   + CASE WHEN b.user_id % 5 = 0 THEN b.user_id ELSE b.user_id % (SELECT count(*) FROM {supplier}) END AS invoice_id,
               CASE (b.user_id + b.week) % 4 WHEN 0 THEN logged WHEN 1 THEN logged + 0.5e0 WHEN 2 THEN logged + 5e0 END
                   AS hours,
               50e0 + b.user_id % 50 AS rate,
               CASE b.user_id % 12
                   WHEN 1 THEN last_name || ' ' || first_name WHEN 7 THEN last_name || ' ' || first_name
                   WHEN 2 THEN upper(first_name || ' ' || last_name) || '.'
                   WHEN 8 THEN upper(first_name || ' ' || last_name) || '.'
                   WHEN 3 THEN first_name || ' ' || substr(last_name, 1, 2) || substr(last_name, 4)
                   WHEN 9 THEN first_name || ' ' || substr(last_name, 1, 2) || substr(last_name, 4)
                   WHEN 4 THEN 'Worker ' || CAST(b.user_id AS STRING) WHEN 10 THEN 'Worker ' || CAST(b.user_id AS STRING)
                   WHEN 5 THEN last_name || ', ' || first_name
                   WHEN 11 THEN 'Quxq Xyqx'
                   ELSE first_name || ' ' || last_name END AS contractor_name,
               CASE b.user_id % 12 WHEN 3 THEN 'fuzzy' WHEN 9 THEN 'fuzzy' WHEN 4 THEN 'crossref' WHEN 10 THEN 'crossref'
                   WHEN 11 THEN 'unresolved' ELSE 'exact' END AS made_by,
               CASE WHEN b.user_id % 12 <> 11 THEN lower(first_name || ' ' || last_name) END AS made_from
        FROM billed b JOIN people p ON b.user_id = p.user_id""",
    "invoice_lines": """
        SELECT user_id * 1000 + week * 2 + half AS id, invoice_id,
               CAST(user_id * 2 + half AS BIGINT) AS line_ord, contractor_name, hours, rate, hours * rate AS amount,
               CASE WHEN user_id % 4 = 1 OR user_id % 8 = 3 THEN DATE '2024-01-01' + CAST(7 * week AS INT) END AS own_start,
               CASE WHEN user_id % 4 = 1 THEN DATE '2024-01-01' + CAST(7 * week + 6 AS INT) END AS own_end,
               made_by, made_from, slot, week
        FROM billed_lines""",
    "invoices": """
        SELECT invoice_id AS id, s_name AS vendor_name, 'INV-' || CAST(invoice_id AS STRING) AS invoice_number,
               DATE '2024-01-01' + CAST(7 * week + 7 AS INT) AS date_received,
               CASE WHEN slot % 10 <> 7 THEN DATE '2024-01-01' + CAST(7 * week AS INT) END AS payment_period_start,
               CASE WHEN slot % 10 <> 7 THEN DATE '2024-01-01' + CAST(7 * week + 6 AS INT) END AS payment_period_end,
               total AS total_invoice_cost,
               CASE WHEN slot % 25 = 24 THEN 'processing_failed' ELSE 'needs_manual_review' END AS status,
               CASE WHEN slot % 20 = 19 THEN 'other' ELSE 'contractor' END AS invoice_type,
               CASE WHEN slot % 9 = 8 THEN CAST('2024-03-01 00:00:00' AS TIMESTAMP) END AS archived_at,
               CASE invoice_id % 4 WHEN 0 THEN 'rules' WHEN 1 THEN 'ocr' WHEN 2 THEN 'template' END AS parse_method,
               week * greatest(100000, (SELECT count(*) FROM {supplier})) + slot AS created_seq
        FROM (SELECT invoice_id, slot, week, sum(amount) AS total FROM (
                  SELECT invoice_id, slot, week, hours * rate AS amount FROM billed_lines) l
              GROUP BY invoice_id, slot, week) i
        JOIN {supplier} s ON s.s_suppkey = i.slot""",
    "lob_rows": """
        SELECT 'PR' || lpad(CAST(project AS STRING), 5, '0') AS project_id, row_idx,
               CASE (project + row_idx) % 5 WHEN 0 THEN '/Group' WHEN 1 THEN ' /group/NOVA '
                    WHEN 2 THEN '/Group/Pulse' WHEN 3 THEN '/Elsewhere' ELSE '' END AS line_of_business
        FROM (SELECT DISTINCT k % 20 AS project, 1 AS row_idx FROM event_days WHERE k % 20 >= 4
              UNION ALL SELECT DISTINCT k % 20 AS project, 2 AS row_idx FROM event_days WHERE k % 20 >= 4 AND k % 3 = 0) p""",
    "person_entry": """
        SELECT p.user_id, t.entry_hash, t.norm FROM people p JOIN (
            SELECT contractor_name_normalized AS norm, min(entry_order || '~' || source_row_hash) AS first_entry,
                   right(min(entry_order || '~' || source_row_hash), 32) AS entry_hash
            FROM {timesheets} GROUP BY contractor_name_normalized) t
        ON t.norm = lower(p.first_name || ' ' || p.last_name)""",
    "spend_invoices": """
        SELECT o_orderkey AS id,
               CASE WHEN o_custkey % 200 > 0 THEN 'Customer ' || CAST(o_custkey AS STRING) END AS vendor_name,
               'INV-' || CAST(o_orderkey AS STRING) AS invoice_number,
               CASE WHEN o_orderkey % 50 > 0 THEN CAST(o_orderdate AS DATE) END AS date_received,
               DATE '2024-01-01' + CAST(o_orderkey % 24 AS INT) AS payment_period_start,
               CASE WHEN o_orderkey % 30 > 0 THEN DATE '2024-01-01' + CAST(o_orderkey % 24 + 6 AS INT) END
                   AS payment_period_end,
               CASE WHEN o_orderkey % 70 > 0 THEN o_totalprice END AS total_invoice_cost,
               CASE WHEN o_orderpriority = '1-URGENT' THEN
                         CASE WHEN o_orderstatus = 'F' THEN 'all_data_found' ELSE 'missing_data' END
                    WHEN o_orderstatus = 'F' THEN 'matched' WHEN o_orderstatus = 'O' THEN 'flagged'
                    WHEN o_orderkey % 2 = 0 THEN 'needs_manual_review' ELSE 'processing_failed' END AS status,
               CASE WHEN o_orderpriority = '1-URGENT' THEN 'other' ELSE 'contractor' END AS invoice_type,
               CASE WHEN o_orderkey % 10 > 0 THEN CAST(o_orderkey % 100 AS DOUBLE) / 100e0 END AS parse_confidence,
               CASE o_orderkey % 4 WHEN 0 THEN 'rules' WHEN 1 THEN 'ocr' WHEN 2 THEN 'template' WHEN 3 THEN '' END AS method,
               CASE o_orderkey % 5 WHEN 0 THEN 'capex' WHEN 1 THEN ' OPEX ' WHEN 2 THEN 'mixed' END AS hint,
               CASE o_orderkey % 4 WHEN 0 THEN '246010' WHEN 1 THEN ' 667040' WHEN 2 THEN '667040, 246010' END AS offset_gl,
               CASE o_orderkey % 3 WHEN 0 THEN 'CC100' WHEN 1 THEN ' CC200 ' ELSE '  ' END AS cost_center,
               CASE WHEN o_orderkey % 6 = 5 THEN o_orderdate END AS archived_at,
               o_orderdate AS created_at
        FROM {orders}""",
    "spend_lines": """
        SELECT CAST(l.l_orderkey AS STRING) || '-' || CAST(l.l_suppkey AS STRING) || '-' || CAST(l.l_partkey AS STRING) AS id,
               l.l_orderkey AS invoice_id, l.l_suppkey * greatest(100000000, (SELECT max(p_partkey) + 1 FROM {part})) + l.l_partkey AS line_ord,
               CASE WHEN l.l_partkey % 29 > 0 THEN p.first_name || ' ' || p.last_name END AS contractor_name,
               l.hours, CASE WHEN l.l_partkey % 13 > 0 THEN floor(r.p_retailprice) / 4 END AS rate,
               CASE WHEN l.l_partkey % 11 > 0 AND l.l_partkey % 13 > 0 THEN l.amount END AS amount,
               CASE WHEN l.l_suppkey % 9 > 0 THEN e.entry_hash END AS matched_timesheet_id,
               CASE WHEN l.l_suppkey % 9 > 0 AND l.l_partkey % 3 > 0 THEN 'matched' ELSE 'flagged' END AS line_status,
               CASE WHEN l.l_partkey % 7 = 0 THEN DATE '2024-01-01' + CAST(l.l_partkey % 20 AS INT) END AS own_start,
               CASE WHEN l.l_partkey % 7 = 0 THEN DATE '2024-01-01' + CAST(l.l_partkey % 20 + 3 AS INT) END AS own_end
        FROM (SELECT g.*, l_suppkey % (SELECT max(user_id) + 1 FROM {events}) AS person_id
              FROM (SELECT l_orderkey, l_suppkey, l_partkey, sum(l_quantity) AS hours,
                           CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS amount
                    FROM {lineitem} GROUP BY l_orderkey, l_suppkey, l_partkey) g) l
        JOIN {part} r ON r.p_partkey = l.l_partkey
        JOIN people p ON p.user_id = l.person_id
        LEFT JOIN person_entry e ON e.user_id = l.person_id""",
    "brands": f"""
        SELECT s_suppkey, {_BRAND_FIRST} || ' ' || {_BRAND_LAST} AS brand,
               CASE s_suppkey % 4 WHEN 0 THEN 'Technologies Inc' WHEN 1 THEN 'Solutions LLC' WHEN 2 THEN 'Systems Limited'
                    ELSE 'Consulting Corp' END AS legal
        FROM (SELECT s_suppkey, {six_digits('s_suppkey')} AS digits FROM {{supplier}}) s""",
    "supplier_list": """
        SELECT s_suppkey AS row_idx,
               brand || ' ' || legal || CASE WHEN s_suppkey % 2 = 0 THEN '-' || CAST(300000 + s_suppkey AS STRING) ELSE '' END
                   || CASE WHEN s_suppkey % 3 = 0 THEN ' (0' || CAST(s_suppkey AS STRING) || ')' ELSE '' END AS name,
               CASE WHEN s_suppkey % 17 < 16 THEN 'S-' || CAST(s_suppkey AS STRING) ELSE ' ' END AS supplier_number
        FROM brands""",
    "vendors": """
        SELECT c_custkey, s_suppkey,
               CASE CASE WHEN s_suppkey % 17 = 16 THEN 3 ELSE c_custkey % 5 END WHEN 0 THEN upper(brand || ', ' || legal) || '.'
                    WHEN 1 THEN replace(brand, ' ', '') || CASE s_suppkey % 4 WHEN 0 THEN 'Technologies Limited'
                         WHEN 1 THEN 'Solutions Inc' WHEN 2 THEN 'Systems LLC' ELSE 'Consulting Gmbh' END
                    WHEN 2 THEN substr(brand, 1, 3) || substr(brand, 5) || ' ' || legal
                    WHEN 3 THEN 'Quxq Xyqx Wyyx'
                    ELSE brand || ' ' || legal END AS vendor_name
        FROM (SELECT c_custkey, c_custkey % (SELECT count(*) FROM {supplier}) AS slot FROM {customer}) c
        JOIN brands b ON b.s_suppkey = c.slot""",
    "tracker": """
        SELECT lpad(CAST(l_orderkey AS STRING), 12, '0') || '-' || lpad(CAST(l_partkey AS STRING), 12, '0') || '-'
                   || lpad(CAST(l_suppkey AS STRING), 12, '0') || '-' || CAST(l_linenumber AS STRING) || '-'
                   || CAST(l_shipdate AS STRING) AS row_order,
               l_orderkey, l_suppkey,
               brand || ' ' || legal AS vendor,
               CASE l_orderkey % 3 WHEN 0 THEN ' Inv ' || CAST(l_orderkey AS STRING) WHEN 1 THEN CAST(l_orderkey AS STRING) || '.0'
                    ELSE 'inv' || CAST(l_orderkey AS STRING) END AS invoice_number,
               CASE WHEN l_orderkey % 6 > 0 THEN 'Approver ' || CAST(l_suppkey % 7 AS STRING) ELSE ' ' END AS approved_by,
               CASE WHEN l_partkey % 5 > 0 THEN 'CC' || CAST(l_partkey % 4 AS STRING) END AS cost_center,
               CASE l_partkey % 3 WHEN 0 THEN '246010' WHEN 1 THEN '667040' ELSE '' END AS offset_gl_account
        FROM {lineitem} JOIN brands ON s_suppkey = l_suppkey""",
    "filed_lookups": """
        SELECT o_orderkey,
               CASE o_orderkey % 3 WHEN 0 THEN 'INV' || CAST(o_orderkey AS STRING) WHEN 1 THEN CAST(o_orderkey AS STRING)
                    ELSE 'Inv ' || CAST(o_orderkey AS STRING) END AS invoice_number,
               f.s_suppkey,
               CASE o_orderkey % 4 WHEN 0 THEN b.brand || ', ' || b.legal
                    WHEN 1 THEN substr(b.brand, 1, 3) || substr(b.brand, 5) || ' ' || b.legal
                    WHEN 2 THEN 'Quxq Xyqx Wyyx' ELSE upper(b.brand || ' ' || b.legal) END AS vendor_name
        FROM {orders} LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS s_suppkey FROM {lineitem} GROUP BY l_orderkey) f
            ON f.l_orderkey = o_orderkey
        LEFT JOIN brands b ON b.s_suppkey = f.s_suppkey""",
    "other_lookups": """
        SELECT o_orderkey AS id, f.s_suppkey, o_orderkey % 2 = 1 AND f.s_suppkey % 17 < 16 AS is_listed,
               CASE WHEN o_orderkey % 2 = 1 AND f.s_suppkey % 17 < 16 THEN b.brand || ' ' || b.legal ELSE upper(b.brand) END
                   AS vendor_name,
               f.invoice_number, '0123456789' AS description
        FROM {orders} JOIN filed_lookups f USING (o_orderkey) LEFT JOIN brands b ON b.s_suppkey = f.s_suppkey""",
    "budget_sheet": """
        SELECT p_partkey AS row_idx, brand AS supplier,
               CASE WHEN p_partkey % 4 = 0 THEN 'n/a' WHEN p_partkey % 4 = 1 THEN CAST(300000 + s_suppkey AS STRING)
                    ELSE 'S-' || CAST(s_suppkey AS STRING) END AS supplier_number,
               CASE WHEN p_partkey % 9 > 0 THEN 'B' || CAST(p_partkey AS STRING) ELSE 'TBD' END AS id,
               CASE WHEN s_suppkey % 3 = 0 THEN 'Owner ' || CAST(s_suppkey AS STRING)
                    WHEN p_partkey % 2 = 0 THEN 'Owner ' || CAST(p_partkey AS STRING) ELSE 'Multiple' END AS approver,
               brand || ' - ' || upper(p_name) AS product,
               CASE WHEN s_suppkey % 2 = 0 THEN 'DT' || CAST(500 + s_suppkey % 100 AS STRING) || ' - Apps'
                    WHEN p_partkey % 3 = 0 THEN 'OPEN' ELSE 'DT' || CAST(500 + p_partkey % 100 AS STRING) END AS cost_center,
               CASE WHEN p_partkey % 2 = 0 THEN '679030 - IT SERVICES' ELSE '131120' END AS gl_account
        FROM (SELECT p_partkey, p_name, p_partkey % (SELECT count(*) FROM {supplier}) AS slot FROM {part}) p
        JOIN brands b ON b.s_suppkey = p.slot""",
}


def needed(sql: str, views: dict[str, str] = VIEWS) -> list[str]:
    """Names of the views a statement uses, dependencies first."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in views:
            if name not in ordered and re.search(rf"(?<![\w.']){name}(?![\w'])", text):
                visit(views[name])
                if name not in ordered:
                    ordered.append(name)

    visit(sql)
    return ordered


def with_views(body: str, views: dict[str, str] = VIEWS) -> str:
    """``body`` with the views it uses in front of it as common table expressions."""
    parts = [f"{name} AS ({views[name]})" for name in needed(body, views)]
    if not parts:
        return body
    if body.lstrip().upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + body.lstrip()[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body


_STORED: dict[tuple[str, str, str], str] = {}


class DriverTables:
    """The driver's parquet tables and the domain views over them, as lazy DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def dealt(self, name: str) -> DataFrame:
        """A driver table for all cores. A small file is one row group, which one task reads: its rows, narrow still, are dealt out."""
        rows, cores = self.table(name), self.spark.sparkContext.defaultParallelism
        return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)

    def view(self, name: str, **provided: DataFrame) -> DataFrame:
        sql = with_views(f"SELECT * FROM {name}")
        used = set(re.findall(r"\{(\w+)\}", sql))
        frames = {t: self.dealt(t) for t in used if t in TABLES}
        if "timesheets" in used:
            provided.setdefault("timesheets", self.timesheets())
        return self.spark.sql(sql, **frames, **{k: v for k, v in provided.items() if k in used})

    def stored(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A derived table, written once per session to the shared folder and read from there.

        Callers of the library have their timesheets and invoices in tables; so do these queries. Rows are written where they are made:
        dealing them out once more would sort and shuffle the widest rows there are.
        """
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _STORED:
            path = f"{shared_folder(self.spark)}/tallyweave-{uuid.uuid4().hex}/{name}"
            build().write.parquet(path)
            _STORED[key] = path
        return self.spark.read.parquet(_STORED[key])

    def raw(self) -> DataFrame:
        return self.stored("timesheet_raw", lambda: self.view("timesheet_raw"))

    def timesheets(self) -> DataFrame:
        """The export imported into an empty table."""
        return self.stored("timesheets", lambda: import_rows(self.raw()))

    def projects(self) -> DataFrame:
        return self.stored("projects", lambda: projects_of(self.raw()))

    def invoices(self) -> DataFrame:
        return self.stored("invoices", lambda: self.view("invoices"))

    def invoice_lines(self) -> DataFrame:
        return self.stored("invoice_lines", lambda: with_own_period(self.view("invoice_lines")))

    def aliases(self) -> DataFrame:
        return self.stored("aliases", lambda: self.view("aliases"))

    def kept(self, name: str) -> DataFrame:
        """A view as a stored table."""
        return self.stored(name, lambda: self.view(name))

    def spend_invoices(self) -> DataFrame:
        extraction = F.struct(
            "method", "cost_center", F.col("offset_gl").alias("offset_gl_account"),
            F.struct(F.col("hint").alias("capex_opex")).alias("accounting_hint"),
        )
        invoices = self.kept("spend_invoices").withColumn("raw_extraction", extraction)
        return invoices.drop("method", "cost_center", "offset_gl", "hint")

    def spend_lines(self) -> DataFrame:
        return self.stored("spend_lines", lambda: with_own_period(self.view("spend_lines")))


def with_own_period(lines: DataFrame) -> DataFrame:
    """Fold the flat period columns into the ``extra`` record lines carry."""
    period = F.struct(F.col("own_start").alias("period_start"), F.col("own_end").alias("period_end"))
    return lines.withColumn("extra", period).drop("own_start", "own_end")
