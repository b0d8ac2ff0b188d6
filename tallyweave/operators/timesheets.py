"""Timesheet import: daily aggregation, canonical rows, project attributes, keyed upserts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.coding import charge_class, is_posted, is_time_off
from tallyweave.functions.dates import to_date
from tallyweave.functions.money import cents, exact
from tallyweave.functions.names import first_last, normalize_name
from tallyweave.operators.scale import last_by, row_count

GROUP_KEYS = ["resource_name", "date_worked", "investment_id", "is_time_off", "is_posted"]
CARRIED = [
    "resource_id", "resource_manager", "investment_name", "investment_manager", "charge_code",
    "task_name", "time_sheet_status", "period_start", "period_finish",
]
# Joins the parts of a sort key; sorts below every printable character, like a shorter tuple would.
_SEPARATOR = "\u0001"


def flag_rows(raw: DataFrame) -> DataFrame:
    """Raw rows with their flags, numeric hours and non-null keys.

    Without a task column nothing is time off; without a status column everything is posted.
    """
    columns = raw.columns
    time_off = is_time_off("task_name") if "task_name" in columns else F.lit(False)
    posted = is_posted("time_sheet_status") if "time_sheet_status" in columns else F.lit(True)
    keys = {c: F.coalesce(F.col(c), F.lit("")) for c in GROUP_KEYS[:3]}
    return raw.withColumns(
        {
            "is_time_off": time_off,
            "is_posted": posted,
            "hours": F.coalesce(F.trim(F.col("hours").cast("string")).try_cast("double"), F.lit(0.0)),
            **keys,
        }
    )


def daily_groups(raw: DataFrame) -> DataFrame:
    """Hours per raw name, raw date, project and flags, with the first non-null of the carried columns."""
    carried = [
        F.min_by(c, F.when(F.col(c).isNotNull(), F.col("row_order"))).alias(c) for c in CARRIED if c in raw.columns
    ]
    aggregated = flag_rows(raw).groupBy(*GROUP_KEYS).agg(F.sum(exact("hours")).alias("hours"), *carried)
    absent = {c: F.lit(None).cast("string") for c in CARRIED if c not in raw.columns}
    return aggregated.withColumns(absent)


def row_hash(name: Column, day: Column, project: Column, time_off: Column, posted: Column) -> Column:
    """First 32 hex digits of the SHA-256 of the canonical key; a nameless row prints ``None``."""
    key = F.concat_ws(
        "|",
        F.coalesce(normalize_name(name), F.lit("None")),
        F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.lit("")),
        F.coalesce(project, F.lit("")),
        time_off.cast("int").cast("string"),
        posted.cast("int").cast("string"),
    )
    return F.substring(F.sha2(key, 256), 1, 32)


def canonical_rows(groups: DataFrame, batch: int = 0, dedupe: str = "last") -> DataFrame:
    """Daily groups keyed by the canonical hash.

    Two raw spellings of one day collide. ``dedupe="last"`` keeps the last group in sorted key order,
    which is what the keyed import does; ``dedupe="sum"`` adds their hours instead.
    """
    if dedupe not in ("last", "sum"):
        raise ValueError("dedupe must be 'last' or 'sum'")
    sort_key = F.concat_ws(
        _SEPARATOR,
        F.lpad(F.lit(batch).cast("string"), 10, "0"),
        "resource_name", "date_worked", "investment_id",
        F.col("is_time_off").cast("int").cast("string"), F.col("is_posted").cast("int").cast("string"),
    )
    day = to_date("date_worked")
    rows = groups.select(
        row_hash(F.col("resource_name"), day, F.col("investment_id"), F.col("is_time_off"), F.col("is_posted")).alias(
            "source_row_hash"
        ),
        sort_key.alias("entry_order"),
        first_last("resource_name").alias("contractor_name"),
        normalize_name("resource_name").alias("contractor_name_normalized"),
        F.round("hours", 2).alias("hours"),
        day.alias("date_worked"),
        "is_time_off",
        "task_name",
        "time_sheet_status",
        "is_posted",
        to_date("period_start").alias("period_start"),
        to_date("period_finish").alias("period_end"),
        F.when(F.col("investment_id") != "", F.col("investment_id")).alias("project_id"),
        "resource_id",
        "resource_manager",
        "investment_name",
        "investment_manager",
        "charge_code",
        charge_class("charge_code").alias("capex_opex"),
    )
    fields = [c for c in rows.columns if c not in ("source_row_hash", "entry_order")]
    merged = rows.groupBy("source_row_hash").agg(
        F.max_by(F.struct(*fields), "entry_order").alias("_row"),
        F.min("entry_order").alias("entry_order"),
        F.sum("hours").alias("_sum"),
    )
    hours = F.col("_sum") if dedupe == "sum" else F.col("_row.hours")
    return merged.select(
        "source_row_hash", "entry_order",
        *[cents(hours).alias("hours") if c == "hours" else F.col(f"_row.{c}").alias(c) for c in fields],
    )


def import_rows(raw: DataFrame, batch: int = 0, dedupe: str = "last") -> DataFrame:
    """Raw export rows to timesheet rows."""
    return canonical_rows(daily_groups(raw), batch, dedupe)


def _with_project(raw: DataFrame) -> DataFrame:
    return raw.filter(F.coalesce("investment_id", F.lit("")) != "")


def project_classes(raw: DataFrame) -> DataFrame:
    """Most frequent expense class per project, counted over source rows; ties go to the first seen."""
    votes = (
        _with_project(raw)
        .select("investment_id", charge_class("charge_code").alias("capex_opex"), "row_order")
        .filter("capex_opex is not null")
        .groupBy("investment_id", "capex_opex")
        .agg(F.count(F.lit(1)).alias("votes"), F.min("row_order").alias("seen"))
    )
    return votes.groupBy("investment_id").agg(
        F.min_by("capex_opex", F.struct(-F.col("votes"), F.col("seen"))).alias("capex_opex")
    ).withColumnRenamed("investment_id", "project_id")


def project_names(raw: DataFrame) -> DataFrame:
    """First non-null name per project."""
    return (
        _with_project(raw).filter("investment_name is not null").groupBy("investment_id")
        .agg(F.min_by("investment_name", "row_order").alias("project_name"))
        .withColumnRenamed("investment_id", "project_id")
    )


def project_keys(raw: DataFrame) -> DataFrame:
    """Projects that are known by a name or by a class."""
    known = F.col("investment_name").isNotNull() | charge_class("charge_code").isNotNull()
    return _with_project(raw).filter(known).select(F.col("investment_id").alias("project_id")).distinct()


def projects_of(raw: DataFrame) -> DataFrame:
    return project_names(raw).join(project_classes(raw), "project_id", "full")


def mark_actions(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows tagged ``created`` or ``updated``."""
    known = existing.select(key, F.lit(True).alias("_known")).distinct()
    return (
        incoming.join(known, key, "left")
        .withColumn("action", F.when(F.col("_known"), "updated").otherwise("created"))
        .drop("_known")
    )


def upsert_timesheets(existing: DataFrame, incoming: DataFrame, supersede: bool = False) -> DataFrame:
    """Keyed replace on the row hash; a replaced row keeps its place of first insertion.

    The posted flag is part of the key, so an entry that changes status becomes a second row.
    ``supersede=True`` then keeps only the newest import per person, day, project and time-off flag.
    """
    fields = [c for c in existing.columns if c not in ("source_row_hash", "entry_order")]
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    merged = both.groupBy("source_row_hash").agg(
        F.max_by(F.struct(*fields), F.struct("_new", "entry_order")).alias("_row"),
        F.min("entry_order").alias("entry_order"),
        F.max(F.struct("_new", "entry_order")).alias("_age"),
    )
    merged = merged.select("source_row_hash", "entry_order", "_age", "_row.*")
    if supersede:
        merged = last_by(
            merged, ["contractor_name_normalized", "date_worked", "project_id", "is_time_off"], ["_age"]
        )
    return merged.select(*existing.columns)


def upsert_projects(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert new projects; fill the name or class of a known one only where it is empty."""
    new = incoming.select(
        "project_id", F.col("project_name").alias("_name"), F.col("capex_opex").alias("_class")
    )

    def filled(current, fallback):
        return F.coalesce(F.when(F.col(current) != "", F.col(current)), F.col(fallback))

    return existing.join(new, "project_id", "full").withColumns(
        {"project_name": filled("project_name", "_name"), "capex_opex": filled("capex_opex", "_class")}
    ).select(*existing.columns)


def import_counters(
    raw: DataFrame, existing: DataFrame, existing_projects: DataFrame, batch: int = 0
) -> DataFrame:
    """One row: source rows, groups, created and updated timesheets, created projects.

    A group whose hash was already stored, or already met in this file, counts as an update.
    """
    groups = daily_groups(raw)
    rows = import_rows(raw, batch)
    created = rows.join(existing.select("source_row_hash"), "source_row_hash", "left_anti")
    new_projects = project_keys(raw).join(existing_projects.select("project_id"), "project_id", "left_anti")
    counts = [
        raw.agg(F.count(F.lit(1)).alias("n")).select(F.lit("source_rows").alias("counter"), "n"),
        groups.agg(F.count(F.lit(1)).alias("n")).select(F.lit("aggregated_rows").alias("counter"), "n"),
        created.agg(F.count(F.lit(1)).alias("n")).select(F.lit("timesheets_created").alias("counter"), "n"),
        new_projects.agg(F.count(F.lit(1)).alias("n")).select(F.lit("projects_created").alias("counter"), "n"),
    ]
    long = counts[0]
    for part in counts[1:]:
        long = long.unionByName(part)

    def value(name):
        return F.max(F.when(F.col("counter") == name, F.col("n")))

    return long.agg(
        value("source_rows").alias("source_rows"),
        value("aggregated_rows").alias("aggregated_rows"),
        value("timesheets_created").alias("timesheets_created"),
        (value("aggregated_rows") - value("timesheets_created")).alias("timesheets_updated"),
        value("projects_created").alias("projects_created"),
    )


@dataclass(frozen=True)
class Import:
    """What one import leaves behind."""

    timesheets: DataFrame
    projects: DataFrame
    counters: DataFrame


def import_export(
    raw: DataFrame, timesheets: DataFrame, projects: DataFrame, batch: int = 0, dedupe: str = "last",
    supersede: bool = False,
) -> Import:
    """Merge one export into the stored timesheets and projects."""
    return Import(
        upsert_timesheets(timesheets, import_rows(raw, batch, dedupe), supersede),
        upsert_projects(projects, projects_of(raw)),
        import_counters(raw, timesheets, projects, batch),
    )


def timesheet_summary(timesheets: DataFrame, projects: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows, projects, distinct people, and the latest sync state (``unconfigured`` before any)."""
    sheets = timesheets.agg(
        F.count(F.lit(1)).alias("timesheets"), F.countDistinct("contractor_name_normalized").alias("contractors")
    )
    state = runs.agg(
        F.max_by("source", "attempt_at").alias("source"),
        F.max("success_at").alias("last_synced_at"),
        F.max_by("error", F.when(F.col("source") != "unconfigured", F.col("attempt_at"))).alias("last_error"),
    )
    return sheets.select(
        "timesheets",
        row_count(projects).alias("projects"),
        "contractors",
        F.coalesce(state.select("source").scalar(), F.lit("unconfigured")).alias("source"),
        state.select("last_synced_at").scalar().alias("last_synced_at"),
        state.select("last_error").scalar().alias("last_error"),
    )


def run_state(
    attempt_at: Column, has_people: Column, has_source: Column, error: Column
) -> Column:
    """State of one sync run: no people or no source is ``unconfigured``; an error falls back to files."""
    source = (
        F.when(~has_people | ~has_source, "unconfigured").when(error.isNotNull(), "csv_fallback").otherwise("api")
    )
    return F.struct(
        attempt_at.alias("attempt_at"),
        source.alias("source"),
        F.when(source == "api", attempt_at).alias("success_at"),
        F.when(source == "csv_fallback", error).alias("error"),
    )


def latest_run(runs: DataFrame) -> DataFrame:
    """The newest run row."""
    return runs.agg(F.max_by(F.struct(*runs.columns), "attempt_at").alias("run")).select("run.*")
