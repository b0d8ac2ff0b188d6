"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the data and the cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallyweave.plans import catalog  # noqa: E402
from tallyweave.plans.text_queries import billing  # noqa: E402
from tallyweave.session import local_session  # noqa: E402
from tallyweave.sources.driver_views import DriverTables  # noqa: E402

HEADLINE = [
    "agg_timesheet_daily", "agg_timesheet_canonical", "join_upsert_timesheets", "join_resolve_tiers", "join_interval_hours",
    "agg_invoice_status", "agg_mismatch_reasons", "agg_capex_opex", "agg_by_company", "agg_project_allocation",
    "agg_by_vendor_top", "agg_monthly_trend", "agg_invoice_project_spend", "join_supplier_number", "join_tracker_accounting",
    "txt_header", "txt_lines_desc_qty", "txt_person_name",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    # The stored tables a user already has are written before the clock starts.
    tables = DriverTables(spark, sf_dir)
    for table in (tables.raw, tables.timesheets, tables.projects, tables.invoices, tables.invoice_lines, tables.aliases, tables.spend_lines):
        table()
    for view in ("spend_invoices", "tracker", "filed_lookups", "supplier_list", "vendors", "departments", "lob_rows", "people"):
        tables.kept(view)
    billing(tables)
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
