"""Structured Streaming loads built on the batch operators.

Both write one folder per micro-batch (``batch=<id>``) and overwrite it on a retry, so a batch that runs twice
after a failure leaves the same result. The timesheet table is merged when read: a micro-batch writes only its
own rows, however large the table has become, and ``compact`` folds the history from time to time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyweave.operators.reconcile import compare_lines, invoice_statuses, line_results
from tallyweave.operators.timesheets import import_rows
from tallyweave.session import cut_lineage

#: Partitions of each batch's part of the upload log.
LOG_BUCKETS = 16
INVOICE_COLUMNS = ["id", "vendor_name", "status", "invoice_type", "payment_period_start", "payment_period_end"]


def _batch_folder(path: str, batch_id: int) -> str:
    return f"{path}/batch={batch_id}"


def _run(source: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, name: str) -> StreamingQuery:
    return (
        source.writeStream.queryName(name).foreachBatch(handle).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def stream_files(spark: SparkSession, schema, folder: str) -> DataFrame:
    """New Parquet files below ``folder`` as a stream."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(folder)


def load_timesheets(raw: DataFrame, table: str, checkpoint: str, dedupe: str = "last") -> StreamingQuery:
    """Upsert a stream of raw export rows into ``table``; everything available is loaded, then it stops."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        import_rows(batch, batch_id, dedupe).write.mode("overwrite").parquet(_batch_folder(table, batch_id))

    return _run(raw, handle, checkpoint, "timesheet_upsert")


def current_timesheets(spark: SparkSession, table: str) -> DataFrame:
    """The table as of the last batch: the newest row per hash, at its place of first insertion."""
    log = spark.read.parquet(table)
    fields = [c for c in log.columns if c not in ("source_row_hash", "entry_order", "batch")]
    newest = F.max_by(F.struct(*fields), F.struct("batch", "entry_order"))
    return log.groupBy("source_row_hash").agg(newest.alias("_row"), F.min("entry_order").alias("entry_order")).select(
        "source_row_hash", "entry_order", "_row.*"
    )


def compact(spark: SparkSession, table: str, target: str) -> None:
    """Fold all batches into one at ``target``, under the number of the last batch."""
    last = spark.read.parquet(table).agg(F.max("batch")).first()[0]
    current_timesheets(spark, table).write.mode("overwrite").parquet(_batch_folder(target, last))


def match_invoices(
    uploads: DataFrame, timesheets: Callable[[], DataFrame], aliases: DataFrame | None, results: str, checkpoint: str,
    buckets: int = LOG_BUCKETS,
) -> StreamingQuery:
    """Match a stream of uploaded lines, each carrying its invoice's columns as ``invoice`` and the number of its ``upload``.

    The lines of an invoice may come in any number of uploads, in one micro-batch or several. All that came are kept in a log,
    ``{results}/log``, dealt to buckets by invoice; a micro-batch judges the invoices it touches on all of their lines, against the
    timesheets as they are at that moment, and reads only their buckets. A line that comes again replaces its earlier state. An
    upload with ``replaces`` set is the whole invoice: lines of uploads with a lower number no longer count. A row without a line ``id``
    only brings the invoice. Uploads that come twice, or a micro-batch that runs twice, change nothing.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        log = f"{results}/log"
        bucket = F.pmod(F.xxhash64("invoice.id"), F.lit(buckets)).cast("int")
        arrived = batch if "replaces" in batch.columns else batch.withColumn("replaces", F.lit(False))
        arrived.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(_batch_folder(log, batch_id))
        history = batch.sparkSession.read.parquet(log).filter(F.col("batch") <= batch_id)
        touched = history.filter(F.col("batch") == batch_id).select("bucket", F.col("invoice.id").alias("id")).distinct()
        # At most one row per bucket: the partitions of the log to read.
        asked = [row["bucket"] for row in touched.select("bucket").distinct().collect()]
        known = history.filter(F.col("bucket").isin(asked)).withColumn("invoice_id", F.col("invoice.id"))
        known = known.join(touched.select(F.col("id").alias("invoice_id")), "invoice_id", "left_semi")
        invoices, lines = latest_uploads(known)
        compared = cut_lineage(compare_lines(invoices, lines, timesheets(), aliases))
        line_results(compared).write.mode("overwrite").parquet(_batch_folder(f"{results}/lines", batch_id))
        statuses = invoice_statuses(invoices, compared)
        statuses.select("id", "vendor_name", "status", "lines", "matched_lines", "routed_to").write.mode("overwrite").parquet(
            _batch_folder(f"{results}/invoices", batch_id)
        )

    return _run(uploads, handle, checkpoint, "invoice_match")


def latest_uploads(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Invoices and lines as all uploads in ``log`` together leave them."""
    headers = log.groupBy("invoice_id").agg(
        F.max_by("invoice", "upload").alias("invoice"), F.max(F.when(F.col("replaces"), F.col("upload"))).alias("_whole")
    )
    fields = [c for c in log.columns if c not in ("invoice", "invoice_id", "upload", "replaces", "batch", "bucket", "id")]
    counting = log.join(headers.select("invoice_id", "_whole"), "invoice_id").filter(
        F.col("id").isNotNull() & (F.col("_whole").isNull() | (F.col("upload") >= F.col("_whole")))
    )
    newest = F.max_by(F.struct(*fields), F.struct("upload", "batch"))
    lines = counting.groupBy("invoice_id", "id").agg(newest.alias("_row")).select("invoice_id", "id", "_row.*")
    return headers.select("invoice.*"), lines


def current_verdicts(spark: SparkSession, results: str) -> DataFrame:
    """One row per invoice: its verdict of the last micro-batch that touched it."""
    log = spark.read.parquet(f"{results}/invoices")
    fields = [c for c in log.columns if c != "id"]
    return log.groupBy("id").agg(F.max_by(F.struct(*fields), "batch").alias("_row")).select("id", "_row.*")


def current_line_results(spark: SparkSession, results: str) -> DataFrame:
    """Line results of the last micro-batch that touched each invoice."""
    last = current_verdicts(spark, results).select(F.col("id").alias("invoice_id"), "batch")
    return spark.read.parquet(f"{results}/lines").join(last, ["invoice_id", "batch"])


def compact_uploads(spark: SparkSession, results: str, target: str) -> None:
    """Fold the log into one batch at ``target``, under the number of the last one; lines that no longer count go."""
    stored = spark.read.parquet(f"{results}/log")
    columns = [c for c in stored.columns if c != "batch"]
    log = stored.withColumn("invoice_id", F.col("invoice.id"))
    last = log.agg(F.max("batch")).first()[0]
    newest = log.groupBy("invoice_id").agg(
        F.max("upload").alias("upload"), F.max_by("invoice", "upload").alias("invoice"), F.first("bucket").alias("bucket")
    )
    _, lines = latest_uploads(log)
    # What is folded is each invoice as of its last upload; one without lines keeps a row without a line.
    folded = newest.join(lines, "invoice_id", "left").withColumn("replaces", F.lit(False))
    folded.select(*columns).write.mode("overwrite").partitionBy("bucket").parquet(_batch_folder(f"{target}/log", last))
