"""Building blocks that keep one hot key, or one huge result, from landing in a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.strings import col
from tallyweave.session import cut_lineage, written


def row_count(df: DataFrame) -> Column:
    """The number of rows as a scalar subquery: it stays in the plan, the driver never asks for it."""
    return df.agg(F.count(F.lit(1))).scalar()


def running_offset(df: DataFrame, group: list[str], position: str, size: str, name: str, materialise=written) -> DataFrame:
    """Add ``name``: the sum of ``size`` over earlier ``position`` values in the group.

    Rows are cut into ranges of (group, position) of about equal numbers, whatever the positions are, so a group of any size is spread
    over many tasks; each range is summed by itself, and only the ranges' totals are scanned per group. The rows are materialised, so
    that sums and totals are taken from the same cut. Positions are unique per group.
    """
    placed = materialise(df.repartitionByRange(*group, position).withColumn("_range", F.spark_partition_id()))
    totals = placed.groupBy(*group, "_range").agg(F.sum(size).alias("_range_size"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*group, "_range", F.coalesce(F.sum("_range_size").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*group, "_range").orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.join(starts, [*group, "_range"])
        .withColumn(name, F.col("_start") + F.coalesce(F.sum(size).over(within), F.lit(0)))
        .drop("_range", "_start")
    )


def global_rank(df: DataFrame, order: list[Column], name: str = "rank", materialise=cut_lineage) -> DataFrame:
    """Add ``name``: 1, 2, 3… over the whole table in ``order``, without one task that sees all rows.

    The rows are cut into ranges of the order and sorted inside each; a row's number is its place in its range plus the sizes of the
    ranges before. The sorted rows are materialised, so that numbers and sizes are taken from the same cut. Only rows that are equal in
    the whole ``order`` must stay in one range, so give it a last column that tells rows apart.
    """
    place = F.monotonically_increasing_id()
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", place)
    placed = materialise(placed.withColumn("_range", F.shiftright("_place", 33)).withColumn("_place", F.col("_place").bitwiseAND((1 << 33) - 1)))
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    # One row a range: as many as the shuffle has partitions, whatever the data.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_place") + 1).drop("_range", "_place", "_start")


def top_and_rest(
    df: DataFrame, label: str, order: list[Column], n: int, sums: list[str], rest_label: str = "Other"
) -> DataFrame:
    """The first ``n`` rows in ``order`` plus one remainder row that sums the others (absent when empty).

    The top rows come from a distributed take-ordered; the remainder is an anti join against those ``n``
    rows (a proven bound, hence the broadcast) followed by a global partial aggregate.
    """
    top = df.orderBy(*order).limit(n)
    rest = df.join(F.broadcast(top.select(label)), label, "left_anti").agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(c).alias(c) for c in sums]
    )
    rest = rest.filter("_rows > 0").select(
        F.lit(n + 1).alias("rank"), F.lit(rest_label).alias(label), *sums, F.lit(True).alias("is_rest")
    )
    ranked = top.select(
        F.row_number().over(Window.orderBy(*order)).alias("rank"), label, *sums, F.lit(False).alias("is_rest")
    )
    return ranked.unionByName(rest)


def first_by(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row per key: the one that comes first in ``order``.

    An aggregate with map-side combine, not a window, so a hot key never sorts in one task.
    """
    others = [c for c in df.columns if c not in keys]
    rank = F.struct(*[col(o).alias(f"_{i}") for i, o in enumerate(order)])
    return df.groupBy(*keys).agg(F.min_by(F.struct(*others), rank).alias("_row")).select(*keys, "_row.*")


def last_by(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row per key: the one that comes last in ``order``."""
    others = [c for c in df.columns if c not in keys]
    rank = F.struct(*[col(o).alias(f"_{i}") for i, o in enumerate(order)])
    return df.groupBy(*keys).agg(F.max_by(F.struct(*others), rank).alias("_row")).select(*keys, "_row.*")
