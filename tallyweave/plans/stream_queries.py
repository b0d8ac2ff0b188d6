"""The two streams, run over everything available and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.plans.registry import query
from tallyweave.plans.timesheet_queries import UPSERT_SQL, fresh_folder, split_by_week
from tallyweave.streaming import loads


def run(stream) -> None:
    stream.awaitTermination()
    if stream.exception():
        raise stream.exception()


@query("stream_timesheet_upsert", f"""
    WITH {UPSERT_SQL},
    both_files AS (SELECT *, 0 AS batch FROM first_file UNION ALL SELECT *, 1 AS batch FROM second_file)
    SELECT source_row_hash, arg_max(contractor_name, (batch, entry_order)) AS contractor_name,
           arg_max(hours, (batch, entry_order)) AS hours
    FROM both_files GROUP BY source_row_hash""")
def stream_timesheet_upsert(d):
    """Two drops of files, then the second drop once more: the replay changes nothing."""
    folder = fresh_folder(d)
    first, second = split_by_week(d)
    for drop, rows in (("1", first), ("2", second), ("3", second)):
        rows.write.parquet(f"{folder}/inbox/{drop}")
        source = loads.stream_files(d.spark, rows.schema, f"{folder}/inbox")
        run(loads.load_timesheets(source, f"{folder}/table", f"{folder}/checkpoint"))
    return loads.current_timesheets(d.spark, f"{folder}/table").select("source_row_hash", "contractor_name", "hours")


@query("stream_invoice_match", """
    SELECT id, vendor_name, new_status AS status, lines, matched_lines FROM invoice_outcomes WHERE lines > 0""")
def stream_invoice_match(d):
    """The lines of every invoice dealt to two uploads, and the second upload once more: one verdict, on all lines."""
    folder = fresh_folder(d)
    invoices = d.invoices().select(F.col("id").alias("invoice_id"), F.struct(*loads.INVOICE_COLUMNS).alias("invoice"))
    uploads = d.invoice_lines().join(invoices, "invoice_id").withColumn("upload", 1 + F.pmod(F.xxhash64("id"), F.lit(2)))
    first, second = uploads.filter("upload = 1"), uploads.filter("upload = 2")
    for drop, rows in (("1", first), ("2", second), ("3", second)):
        rows.write.parquet(f"{folder}/inbox/{drop}")
        source = loads.stream_files(d.spark, rows.schema, f"{folder}/inbox")
        run(loads.match_invoices(source, d.timesheets, d.aliases(), f"{folder}/results", f"{folder}/checkpoint"))
    verdicts = loads.current_verdicts(d.spark, f"{folder}/results")
    return verdicts.filter("lines > 0").select("id", "vendor_name", "status", "lines", "matched_lines")
