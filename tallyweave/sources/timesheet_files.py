"""Timesheet exports (CSV) and nested timesheet payloads (JSON) as one raw, all-string schema."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.functions.names import last_first
from tallyweave.operators.scale import first_by

# Export header -> column name used here.
EXPORT_COLUMNS = {
    "Resource Name": "resource_name",
    "Resource Manager": "resource_manager",
    "Time Sheet Status": "time_sheet_status",
    "Period Start Date": "period_start",
    "Period Finish Date": "period_finish",
    "Investment ID": "investment_id",
    "Investment Name": "investment_name",
    "Investment Manager": "investment_manager",
    "Charge Code": "charge_code",
    "Task Name": "task_name",
    "Date Worked": "date_worked",
    "Time Entry Hours": "hours",
    "Resource ID": "resource_id",
}
REQUIRED = ("Resource Name", "Date Worked", "Investment ID", "Time Entry Hours")
# Encodings are tried in this order; the last one accepts any bytes.
ENCODINGS = ("utf-8", "cp1252", "iso-8859-1")
# Windows text is read as ISO 8859-1 and the block where the two differ is translated.
_WINDOWS_BYTES = [b for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "ignore")]
_LATIN_BLOCK = "".join(map(chr, _WINDOWS_BYTES))
_WINDOWS_BLOCK = bytes(_WINDOWS_BYTES).decode("cp1252")
_NOT_WINDOWS = "".join(rf"\x{b:02x}" for b in range(0x80, 0xA0) if b not in _WINDOWS_BYTES)


def require_columns(columns: list[str]) -> None:
    """Fail with the list of required export columns that are absent."""
    missing = [c for c in REQUIRED if c not in columns]
    if missing:
        raise ValueError(f"Timesheet export is missing required columns: {missing}")


def canonical_columns(df: DataFrame) -> DataFrame:
    """Export headers to column names; unknown columns are dropped, optional ones stay absent."""
    require_columns(df.columns)
    kept = [F.col(f"`{c}`").cast("string").alias(EXPORT_COLUMNS[c]) for c in df.columns if c in EXPORT_COLUMNS]
    extra = [c for c in ("row_order",) if c in df.columns]
    return df.select(*extra, *kept)


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, modified, encoding, header, torn)`` of every export under ``path`` that holds a line.

    The encoding is the first that decodes every line. ``torn`` says that a quoted cell may run over a line break: some line
    holds an odd number of quotes. Lines are judged one by one, so no file has to fit into a cell.
    """
    lines = spark.read.option("pathGlobFilter", "*.csv").text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_modification_time").alias("modified"),
        F.struct("_metadata.file_block_start", F.monotonically_increasing_id().alias("line")).alias("place"),
        F.col("value").cast("binary").alias("bytes"),
        F.is_valid_utf8("value").alias("is_utf8"),
    )
    latin = F.decode("bytes", "iso-8859-1")
    files = lines.groupBy("path").agg(
        F.max("modified").alias("modified"),
        F.bool_and("is_utf8").alias("utf8"),
        F.bool_and(~latin.rlike(f"[{_NOT_WINDOWS}]")).alias("windows"),
        F.min_by("bytes", "place").alias("first_line"),
        F.bool_or(F.length(F.regexp_replace(latin, '[^"]', "")) % 2 == 1).alias("torn"),
    )
    encoding = F.when(F.col("utf8"), ENCODINGS[0]).when(F.col("windows"), ENCODINGS[1]).otherwise(ENCODINGS[2])
    text = F.when(F.col("utf8"), F.decode("first_line", "utf-8")).otherwise(F.decode("first_line", "iso-8859-1"))
    return files.select("path", "modified", encoding.alias("encoding"), text.alias("header"), "torn")


def newest_file(spark: SparkSession, path: str) -> DataFrame:
    """The newest csv / xls export in a folder, as one row ``(path, modified)``; of equally new ones the last by path."""
    files = spark.read.format("binaryFile").load(path).select("path", "modificationTime")
    exports = files.filter(F.lower("path").rlike(r"\.(csv|xls[a-z]?)$"))
    return exports.agg(
        F.max_by("path", F.struct("modificationTime", "path")).alias("path"), F.max("modificationTime").alias("modified")
    )


def _header_cells(line: str) -> list[str]:
    return [cell.strip() for cell in next(csv.reader([line.lstrip("\ufeff")]), [])]


def _place(block: str, line: str) -> Column:
    """Where a row stands: a text that sorts as rows follow in their file."""
    return F.concat_ws("|", "path", F.lpad(F.col(block).cast("string"), 20, "0"), F.lpad(F.col(line).cast("string"), 20, "0"))


def whole_records(lines: DataFrame) -> DataFrame:
    """``(path, block, line, text)`` lines -> ``(path, block, line, text)`` records, joined where a quoted cell holds line breaks.

    A line begins a record if an even number of quotes stands before it in its file. Splits of a file are counted by themselves; how many
    quotes stand before a split is a running sum over the splits of its file, and so is the record that a split's first lines go on with.
    So a file is read by as many tasks as it has splits. The header, the first record of a file, is left out.
    """
    odd = F.pmod(F.length("text") - F.length(F.replace("text", F.lit('"'), F.lit(""))), F.lit(2))
    lines = lines.withColumn("odd", odd)
    within = Window.partitionBy("path", "block").orderBy("line")
    earlier = within.rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("path", "block").agg(F.sum("odd").alias("odd")).select(
        "path", "block", F.pmod(F.coalesce(F.sum("odd").over(before), F.lit(0)), F.lit(2)).alias("inside")
    )
    placed = lines.join(splits, ["path", "block"]).withColumn("begins", F.pmod(F.col("inside") + F.coalesce(F.sum("odd").over(earlier), F.lit(0)), F.lit(2)) == 0)
    own = F.struct("block", "line")
    carried = placed.groupBy("path", "block").agg(F.max(F.when(F.col("begins"), own)).alias("last")).select(
        "path", "block", F.last("last", ignorenulls=True).over(before).alias("carried")
    )
    so_far = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owned = placed.join(carried, ["path", "block"]).withColumn(
        "record", F.coalesce(F.last(F.when(F.col("begins"), own), ignorenulls=True).over(so_far), F.col("carried"))
    )
    first = (F.col("record.block") == 0) & (F.col("record.line") == F.min("record.line").over(Window.partitionBy("path", "record.block")))
    owned = owned.withColumn("is_header", first).filter(~F.col("is_header"))
    alone = F.col("begins") & (F.col("odd") == 0)
    single = owned.filter(alone).select("path", "block", "line", "text")
    pieces = F.transform(F.sort_array(F.collect_list(F.struct("block", "line", "text"))), lambda p: p["text"])
    joined = owned.filter(~alone).groupBy("path", "record").agg(F.array_join(pieces, "\n").alias("text"))
    return single.unionByName(joined.select("path", "record.block", "record.line", "text"))


def read_timesheet_csv(
    spark: SparkSession, paths: list[str], header: list[str], encoding: str = "utf-8", torn: bool = False
) -> DataFrame:
    """Files of one header, every known column as text; only an empty cell is null, so a literal ``NA`` survives.

    Quotes inside a cell are doubled. Cells of ``torn`` files may hold line breaks; their records are put together first
    (``whole_records``). Of columns with the same name the first counts. ``row_order`` is a text that sorts rows as they stand in their file.
    """
    schema = T.StructType([T.StructField(f"cell_{i}", T.StringType()) for i in range(len(header))])
    cells = {name: F.col(f"cell_{i}") for i, name in reversed(list(enumerate(header))) if name in EXPORT_COLUMNS}
    if encoding == "cp1252":
        cells = {name: F.translate(cell, _LATIN_BLOCK, _WINDOWS_BLOCK) for name, cell in cells.items()}
    options = {"nullValue": "", "emptyValue": "", "escape": '"'}
    place = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")]
    if torn:
        text = F.col("value") if encoding == "utf-8" else F.decode(F.col("value").cast("binary"), "iso-8859-1")
        records = whole_records(spark.read.text(paths).select(*place, text.alias("text"))).filter(F.trim("text") != "")
        rows = records.select("path", "block", "line", F.from_csv("text", schema.simpleString()[7:-1].replace(":", " "), options).alias("row")).select("path", "block", "line", "row.*")
    else:
        reader = spark.read.schema(schema).option("header", True).option("encoding", "utf-8" if encoding == "utf-8" else "iso-8859-1")
        rows = reader.options(**options).csv(paths).select("*", *place)
    return rows.select(*[cell.alias(name) for name, cell in cells.items()], _place("block", "line").alias("row_order"))


def read_timesheet_folder(spark: SparkSession, path: str) -> DataFrame:
    """All exports under ``path``: files of one encoding and header are read together, then joined by column name.

    Files without a line are passed over. The driver holds one short row per file, as it does for any file listing.
    """
    groups: dict[tuple, list[str]] = {}
    for row in scan_files(spark, path).toLocalIterator():
        groups.setdefault((row["encoding"], row["header"], row["torn"]), []).append(row["path"])
    parts = []
    for (encoding, header, torn), paths in sorted(groups.items()):
        if header.count('"') % 2:
            raise ValueError(f"The header of {paths[0]} is cut by a line break")
        parts.append(canonical_columns(read_timesheet_csv(spark, sorted(paths), _header_cells(header), encoding, torn)))
    if not parts:
        raise ValueError(f"No timesheet export under {path}")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


# The nested payload: a timesheet holds time entries, an entry holds daily segments in seconds.
SEGMENT = "struct<start: string, value: double>"
ENTRY = (
    "struct<investmentCode: string, investmentName: string, taskName: string, "
    "chargeCode: struct<displayValue: string>, "
    f"actuals: struct<segmentList: struct<segments: array<{SEGMENT}>>>>"
)
PAYLOAD_SCHEMA = (
    "resourceId string, resourceName string, resourceManager string, status struct<displayValue: string>, "
    f"timePeriodStart string, timePeriodFinish string, timeEntries array<{ENTRY}>"
)
RESOURCE_SCHEMA = "_internalId string, fullName string, department struct<id: string, displayValue: string>"


def read_payload(spark: SparkSession, path: str) -> DataFrame:
    """Nested timesheets stored as JSON lines, under the declared schema (no inference pass)."""
    return spark.read.schema(PAYLOAD_SCHEMA).json(path)


def period_pushdown(payload: DataFrame, resources: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Timesheets of known resources lying wholly inside the period (containment, not overlap)."""
    if start:
        payload = payload.filter(F.col("timePeriodStart") >= f"{start}T00:00:00")
    if end:
        payload = payload.filter(F.col("timePeriodFinish") <= f"{end}T00:00:00")
    return payload.join(resources.select(F.col("resource_id").alias("resourceId")), "resourceId", "left_semi")


def flatten_payload(payload: DataFrame) -> DataFrame:
    """One raw row per worked day; hours are seconds / 3600 and must be positive."""
    entries = payload.select("*", F.explode("timeEntries").alias("entry"))
    days = entries.select("*", F.explode("entry.actuals.segmentList.segments").alias("day"))
    hours = F.coalesce(F.col("day.value"), F.lit(0.0)) / 3600
    return days.filter(hours > 0).select(
        F.col("resourceName").alias("resource_name"),
        F.col("resourceManager").alias("resource_manager"),
        F.col("status.displayValue").alias("time_sheet_status"),
        F.col("timePeriodStart").alias("period_start"),
        F.col("timePeriodFinish").alias("period_finish"),
        F.col("entry.investmentCode").alias("investment_id"),
        F.col("entry.investmentName").alias("investment_name"),
        F.lit(None).cast("string").alias("investment_manager"),
        F.col("entry.chargeCode.displayValue").alias("charge_code"),
        F.col("entry.taskName").alias("task_name"),
        F.col("day.start").alias("date_worked"),
        hours.alias("hours"),
    )


def resource_departments(names: DataFrame, resources: DataFrame) -> DataFrame:
    """``names(contractor_name)`` with their resource id and department; unknown names are left out.

    ``Last, First`` is looked up before the name as given; the first hit counts.
    """
    spelled = names.select("contractor_name").distinct().select(
        "contractor_name",
        F.posexplode(F.array_distinct(F.array(last_first("contractor_name"), F.col("contractor_name")))).alias(
            "attempt", "fullName"
        ),
    )
    hits = spelled.join(resources.select("fullName", "_internalId", "department"), "fullName")
    return first_by(
        hits.select(
            "contractor_name",
            "attempt",
            F.col("_internalId").alias("resource_id"),
            F.col("department.id").alias("cost_center"),
            F.col("department.displayValue").alias("department_name"),
        ),
        ["contractor_name"],
        ["attempt", "resource_id"],
    ).drop("attempt")
