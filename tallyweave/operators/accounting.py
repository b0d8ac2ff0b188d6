"""Expense class, company, cost center and project of billed lines; splits and proportional allocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.coding import CAPEX, OPEX, Policy, expense_class_of
from tallyweave.functions.money import cents, exact, line_weight
from tallyweave.functions.strings import blank_to_null, strip
from tallyweave.operators.hours import PERSON, SPAN, billable, bound_spans, days_in_spans, same_span, spans_of
from tallyweave.operators.scale import last_by
from tallyweave.operators.spans import with_span_aggregates
from tallyweave.session import cut_lineage

SHARE = "decimal(38,10)"
UNRESOLVED_PROJECT = "Unresolved"


def project_companies(lob_rows: DataFrame, policy: Policy) -> DataFrame:
    """``lob_rows(row_idx, project_id, line_of_business)`` -> project and company.

    Rows whose line of business no company owns are ignored; of several usable rows the last counts.
    """
    rows = lob_rows.select(
        strip("project_id").alias("project_id"), "row_idx",
        policy.company_for_line_of_business(F.col("line_of_business")).alias("company"),
    ).filter("project_id <> '' and company is not null")
    return last_by(rows, ["project_id"], ["row_idx"]).select("project_id", "company")


def project_lines_of_business(lob_rows: DataFrame) -> DataFrame:
    """Project and its raw line of business (last non-blank row counts)."""
    rows = lob_rows.select(
        strip("project_id").alias("project_id"), "row_idx", strip("line_of_business").alias("lob")
    ).filter("project_id <> '' and lob <> ''")
    return last_by(rows, ["project_id"], ["row_idx"]).select("project_id", "lob")


def with_company(df: DataFrame, companies: DataFrame, policy: Policy, project: str, name: str) -> DataFrame:
    """Add ``company``: by project id, else by the project-name pattern, else null."""
    mapped = companies.select(F.col("project_id").alias(project), F.col("company").alias("_mapped"))
    by_name = policy.company_for_project_name(F.coalesce(F.col(name), F.lit("")))
    return df.join(mapped, project, "left").withColumn("company", F.coalesce("_mapped", by_name)).drop("_mapped")


def linked_lines(invoices: DataFrame, lines: DataFrame, timesheets: DataFrame, projects: DataFrame) -> DataFrame:
    """Lines with the entry they are linked to, its project, their weight, and the span their hours lie in."""
    header = invoices.select(
        F.col("id").alias("invoice_id"), "vendor_name", "invoice_number", F.col("status").alias("invoice_status"),
        "invoice_type", "payment_period_start", "payment_period_end",
    )
    entries = timesheets.select(
        F.col("source_row_hash").alias("matched_timesheet_id"), F.col(PERSON).alias("resolved"),
        F.col("project_id").alias("entry_project"), F.col("investment_name").alias("entry_project_name"),
        F.col("capex_opex").alias("entry_class"),
    )
    classes = projects.select(F.col("project_id").alias("entry_project"), F.col("capex_opex").alias("project_class"))
    joined = (
        lines.drop("resolved").join(header, "invoice_id").join(entries, "matched_timesheet_id", "left").join(classes, "entry_project", "left")
    )
    own = F.col("extra.period_start").isNotNull() & F.col("extra.period_end").isNotNull()
    start = F.when(own, F.col("extra.period_start")).otherwise(F.col("payment_period_start"))
    end = F.when(own, F.col("extra.period_end")).otherwise(F.col("payment_period_end"))
    return bound_spans(joined, start, end).withColumns(
        {
            "weight": line_weight("amount", "hours", "rate"),
            "expense_class": expense_class_of(F.coalesce(blank_to_null("entry_class"), F.col("project_class"))),
        }
    ).drop("entry_class", "project_class")


def _span_sums(spans: DataFrame, days: DataFrame, keys: list[str], aggregates: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Aggregate pre-aggregated day rows per span: bounded spans by interval, unbounded over all days.

    ``aggregates`` maps a name to (its value per day group, its combination over days).
    """
    combine = [combined.alias(name) for name, (_, combined) in aggregates.items()]
    bounded = days_in_spans(spans, days).groupBy(*SPAN, *keys).agg(*combine)
    everything = days.groupBy("resolved", *keys).agg(*combine)
    unbounded = spans.filter("span_start is null").join(everything, "resolved").select(*bounded.columns)
    return bounded.unionByName(unbounded)


def _per_day(timesheets: DataFrame, keys: list[str], aggregates: dict[str, tuple[Column, Column]]) -> DataFrame:
    return (
        billable(timesheets).filter(F.col(PERSON).isNotNull())
        .groupBy(F.col(PERSON).alias("resolved"), "date_worked", *keys)
        .agg(*[value.alias(name) for name, (value, _) in aggregates.items()])
    )


def span_labels(spans: DataFrame, timesheets: DataFrame) -> DataFrame:
    """Hours of a span per project label (name, else id, else Unresolved), rounded, with the span's total."""
    label = F.coalesce(blank_to_null("investment_name"), blank_to_null("project_id"), F.lit(UNRESOLVED_PROJECT))
    aggregates = {"label_hours": (F.sum(exact("hours")), F.sum("label_hours"))}
    days = _per_day(timesheets.withColumn("label", label), ["label"], aggregates)
    sums = _span_sums(spans, days, ["label"], aggregates).filter("label_hours <> 0")
    rounded = sums.withColumn("label_hours", F.round("label_hours", 2))
    return rounded.withColumn("span_hours", F.sum("label_hours").over(Window.partitionBy(*SPAN)))


def span_projects(spans: DataFrame, timesheets: DataFrame, companies: DataFrame, policy: Policy) -> DataFrame:
    """Per span and project id: rounded hours (> 0), first non-empty name, company and the class voted by hours."""
    kind = expense_class_of("capex_opex")

    def votes(which):
        return F.sum(F.when(kind == which, F.coalesce(exact("hours"), F.lit(0)))), F.sum(f"{which.lower()}_hours")

    def first(which):
        return F.min(F.when(kind == which, F.col("entry_order"))), F.min(f"{which.lower()}_first")

    named = F.when(F.coalesce("investment_name", F.lit("")) != "", F.struct("entry_order", "investment_name"))
    aggregates = {
        "project_hours": (F.sum(F.coalesce(exact("hours"), F.lit(0))), F.sum("project_hours")),
        "capex_hours": votes(CAPEX),
        "opex_hours": votes(OPEX),
        "capex_first": first(CAPEX),
        "opex_first": first(OPEX),
        "named": (F.min(named), F.min("named")),
        "first_seen": (F.min("entry_order"), F.min("first_seen")),
    }
    days = _per_day(timesheets, ["project_id"], aggregates)
    sums = _span_sums(spans, days, ["project_id"], aggregates)
    shaped = sums.select(
        *SPAN, "project_id", F.col("named.investment_name").alias("project_name"),
        F.round("project_hours", 2).alias("project_hours"),
        majority_class().alias("project_class"), "first_seen",
    ).filter("project_hours > 0")
    return with_company(shaped, companies, policy, "project_id", "project_name").withColumn(
        "span_hours", F.sum("project_hours").over(Window.partitionBy(*SPAN))
    )


def majority_class() -> Column:
    """The class with more hours; a tie goes to the class seen first; null without any vote."""
    capex, opex = F.col("capex_hours"), F.col("opex_hours")
    capex_wins = opex.isNull() | (capex > opex) | ((capex == opex) & (F.col("capex_first") < F.col("opex_first")))
    return F.when(capex.isNotNull() & capex_wins, CAPEX).when(opex.isNotNull(), OPEX)


def ranked_splits(splits: DataFrame) -> DataFrame:
    """Projects of a span with their rank, most hours first, and how many there are."""
    per_span = Window.partitionBy(*SPAN)
    by_hours = per_span.orderBy(F.desc("project_hours"), F.asc("first_seen"))
    return splits.withColumns({"split_rank": F.row_number().over(by_hours), "split_count": F.count(F.lit(1)).over(per_span)})


def line_splits(linked: DataFrame, splits: DataFrame) -> DataFrame:
    """Lines times the projects of their span, ranked (null project columns where there is no split)."""
    extra = ["project_id", "project_name", "project_hours", "project_class", "company", "first_seen", "span_hours", "split_rank"]
    joined = linked.alias("l").join(splits.alias("s"), same_span("l", "s"), "left")
    return joined.select("l.*", *[f"s.{c}" for c in extra], F.col("s.span_hours").isNotNull().alias("is_split"))


def share_of(weight: Column, part: Column, whole: Column) -> Column:
    """``weight * part / whole`` as an exact decimal, so sums do not depend on order."""
    return (weight.cast("double") * (part.cast("double") / whole.cast("double"))).cast(SHARE)


def allocate_labels(linked: DataFrame, timesheets: DataFrame) -> DataFrame:
    """Weight of contractor lines per project label.

    Weights are summed per span before they meet the span's labels, so the fan-out happens on distinct spans. The sums are written, for
    they say both which spans need labels and what to spread: lines are joined once. A span whose hours cancel out can't be split; its
    weight is unresolved.
    """
    per_span = cut_lineage(linked.filter("weight <> 0").groupBy(*SPAN).agg(F.sum(exact("weight")).alias("weight")))
    labels = span_labels(spans_of(per_span), timesheets).filter("span_hours <> 0")
    spread = per_span.alias("l").join(labels.alias("s"), same_span("l", "s"), "left")
    return spread.select(
        F.coalesce("s.label", F.lit(UNRESOLVED_PROJECT)).alias("project"),
        F.when(F.col("s.label").isNull(), F.col("l.weight").cast(SHARE))
        .otherwise(share_of(F.col("l.weight"), F.col("s.label_hours"), F.col("s.span_hours")))
        .alias("spend"),
    )


def invoice_project_spend(linked: DataFrame, splits: DataFrame) -> DataFrame:
    """Spend per invoice and project id; the share of hours without a project id is dropped.

    A line without any split is credited whole to the project of its linked entry.
    """
    weighted = linked.filter("weight <> 0").groupBy("invoice_id", *SPAN, "entry_project").agg(
        F.sum(exact("weight")).alias("weight")
    )
    spread = weighted.alias("l").join(splits.alias("s"), same_span("l", "s"), "left")
    rows = spread.select(
        "l.invoice_id",
        F.when(F.col("s.span_hours").isNotNull(), F.col("s.project_id")).otherwise(F.col("l.entry_project")).alias("project_id"),
        F.when(
            F.col("s.span_hours").isNotNull(),
            share_of(F.col("l.weight"), F.col("s.project_hours"), F.col("s.span_hours")),
        ).otherwise(F.col("l.weight").cast(SHARE)).alias("spend"),
    )
    return rows.filter(F.coalesce("project_id", F.lit("")) != "").groupBy("invoice_id", "project_id").agg(
        cents(F.sum("spend")).alias("spend")
    )


def project_detail(
    invoices: DataFrame, invoice_people: DataFrame, entries: DataFrame, spend: DataFrame, projects: DataFrame, companies: DataFrame,
    lines_of_business: DataFrame, departments: DataFrame, policy: Policy,
) -> DataFrame:
    """Per invoice and project of its matched entries: class, cost center, spend, line of business, vendor.

    ``invoice_people(invoice_id, resolved, span_start, span_end)`` are the people of an invoice with its period, ``entries`` what they logged.

    CAPEX shows the company center, OPEX the distinct department codes of the people who worked on it. People bring the vendors of their
    invoice, and rows are dealt once, by invoice and project as ``spend`` is: nothing moves the multiplied rows again.
    """
    kind = expense_class_of("capex_opex")
    codes = departments.filter(F.coalesce("cost_center", F.lit("")) != "").select(
        F.col("contractor_name_normalized").alias("resolved"), F.col("cost_center").alias("department_code")
    )
    votes = {}
    for k in (CAPEX, OPEX):
        name = k.lower()
        votes[f"{name}_hours"] = F.sum(F.when(F.col("kind") == k, exact("hours"))), F.sum(f"{name}_hours")
        votes[f"{name}_first"] = F.min(F.when(F.col("kind") == k, F.col("entry_order"))), F.min(f"{name}_first")
    worked = entries.filter(F.coalesce("project_id", F.lit("")) != "").withColumn("kind", kind)
    vendors = invoices.groupBy(F.col("id").alias("invoice_id")).agg(F.collect_list(F.struct("vendor_name")).alias("vendors"))
    grouped = (
        with_span_aggregates(invoice_people.join(vendors, "invoice_id"), worked, votes, ["project_id"])
        .join(codes, "resolved", "left")
        .select("invoice_id", "project_id", *votes, "department_code", "vendors")
        # As they are: sets of codes that are begun before the exchange are larger than the rows.
        .repartition("invoice_id", "project_id")
        .groupBy("invoice_id", "project_id")
        .agg(
            *[F.sum(f"{k.lower()}_hours").alias(f"{k.lower()}_hours") for k in (CAPEX, OPEX)],
            *[F.min(f"{k.lower()}_first").alias(f"{k.lower()}_first") for k in (CAPEX, OPEX)],
            # A set of department codes: bounded by the departments, not by the entries.
            F.array_join(F.array_sort(F.collect_set("department_code")), ", ").alias("department_codes"),
            F.any_value("vendors").alias("vendors"),
        )
        .withColumn("voted", majority_class())
    )
    known = projects.select("project_id", "project_name", F.col("capex_opex").alias("stored_class"))
    joined = with_company(grouped.join(spend, ["invoice_id", "project_id"], "left").join(known, "project_id"), companies, policy, "project_id", "project_name")
    shown_class = F.coalesce("voted", expense_class_of("stored_class"))
    center = F.when(F.col("shown_class") == OPEX, F.col("department_codes")).otherwise(
        policy.company_cost_center(F.col("company"))
    )
    return (
        joined.withColumn("shown_class", shown_class)
        .join(lines_of_business, "project_id", "left").withColumn("vendor", F.explode("vendors"))
        .select(
            "invoice_id", "project_id", "project_name", F.col("shown_class").alias("capex_opex"),
            policy.company_code(F.col("company")).alias("cost_code"), blank_to_null(center).alias("cost_center"),
            F.col("vendor.vendor_name").alias("vendor"), "lob", "spend",
        )
    )
