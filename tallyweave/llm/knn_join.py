"""Exact top-k by inner product as a Voronoi kNN join.

Vectors are turned into points whose distance orders like the inner product: data x becomes (x, sqrt(M - |x|^2)) with M the
largest squared length, a query q becomes (q, 0). Both are grouped by their nearest pivot. A summary of each group (how many
points, the smallest and largest distance to the pivot, the k smallest) gives an upper bound of any query's k-th distance in a
query group, and by the triangle inequality which data points can be within it; only those are replicated to the query group.
Histograms of the distances tell beforehand how many that are. Query groups whose bounds rule out less than half of the data would
each draw most of it, so they are dealt to a few groups that take all data once each: where nothing can be ruled out, as among vectors
without clusters, a vector has few copies, and where it can, many small groups have few vectors each.
Groups of queries and of data are cut into cells of bounded size, solved by integer matrix products, and the cells' best merged.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm import common as C

#: Most pivots, and vectors that make up for one.
PIVOTS, PIVOT_ROWS = 256, 512
#: Groups that take all data, and queries in one of them.
WHOLE, WHOLE_QUERIES = 4, 4096
#: Steps of the histograms of distances to a pivot.
STEPS = 64
#: Data points and queries in one cell.
CELL_ROWS, CELL_QUERIES = 16_384, 1024
#: Largest absolute component whose products doubles add up exactly, for up to 2^13 components.
EXACT = 1 << 20
ASSIGNED = "vec_id long, components array<long>, is_query boolean, query_pivot int, query_distance double, data_pivot int, data_distance double"
BEST = "query_id long, query long, vec_id long, score long"
BEST_ARROW = pa.schema([("query_id", pa.int64()), ("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    """Lists of numbers as rows of a matrix, the shorter ones filled with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    lengths = np.asarray(lists.value_lengths(), np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(lengths) and (lengths == size).all():
        return values.reshape(-1, size)
    out = np.zeros((len(lengths), size), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def _distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squared = (points**2).sum(axis=1)[:, None] - 2 * points @ pivots.T + (pivots**2).sum(axis=1)
    return np.sqrt(np.maximum(squared, 0))


def _lifted(vectors: np.ndarray, largest: float) -> np.ndarray:
    rest = np.maximum(largest - (vectors**2).sum(axis=1), 0)
    return np.concatenate([vectors, np.sqrt(rest)[:, None]], axis=1)


def _products(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    if max(np.abs(queries).max(initial=0), np.abs(data).max(initial=0)) < EXACT and queries.shape[1] <= 1 << 13:
        return np.rint(queries.astype(np.float64) @ data.T.astype(np.float64)).astype(np.int64)
    return queries @ data.T


def top_inner_products(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, pivots: int = PIVOTS) -> DataFrame:
    """For each query vector, the ``k`` other vectors with the largest integer inner product.

    vectors: vec_id, embedding (array of numbers). A component x counts as floor(scale * x). Queries are the rows for which
    ``is_query`` holds; candidates are all rows with another vec_id. Ties go to the smaller vec_id. Vectors that are null, have a
    null or non-finite component, or have no vec_id take no part; shorter vectors are filled with zeros. Of rows that share a
    vec_id each is a candidate of its own; equal query rows are answered once. Scores must fit a 64-bit integer; a vector so long that
    they might not is refused with an error. Further columns are ignored.

    Returns query_id, rank (from 1), vec_id, score; fewer than ``k`` rows for a query if there are fewer candidates.
    """
    spark = vectors.sparkSession
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != F.lit(float("inf"))))
    rows = vectors.select("vec_id", "embedding", F.coalesce(is_query, F.lit(False)).alias("is_query")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    rows = rows.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("components"), "is_query")
    length = F.aggregate("components", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    shape = rows.agg(F.max(F.size("components")).alias("size"), F.max(length).alias("largest"), F.count("*").alias("n"), F.count_if("is_query").alias("queries")).first()
    if not shape["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    size, largest = int(shape["size"]), float(shape["largest"])
    if largest >= 2.0**62:
        raise ValueError("inner products of these vectors do not fit 64 bits: scale them down")
    pivots = min(pivots, max(1, math.ceil(shape["n"] / PIVOT_ROWS)))
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).select("components").collect()
    points = _lifted(_matrix(pa.array([r["components"] for r in chosen], pa.list_(pa.int64())), size).astype(np.float64), largest)
    # Distances are rounded; bounds are widened by far more than that.
    slack = 1e-6 * math.sqrt(largest) + 1e-6

    def assign(batches):
        for batch in batches:
            vectors = _matrix(batch.column("components"), size).astype(np.float64)
            as_data = _distances(_lifted(vectors, largest), points)
            as_query = _distances(np.concatenate([vectors, np.zeros((len(vectors), 1))], axis=1), points)
            query, data = as_query.argmin(axis=1), as_data.argmin(axis=1)
            i = np.arange(len(vectors))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").cast(pa.int64()), batch.column("components"), batch.column("is_query"), pa.array(query, pa.int32()), pa.array(as_query[i, query]), pa.array(data, pa.int32()), pa.array(as_data[i, data])], names=["vec_id", "components", "is_query", "query_pivot", "query_distance", "data_pivot", "data_distance"])

    assigned = C.stored(rows.mapInArrow(assign, ASSIGNED), "knn")
    queries = assigned.where("is_query").dropDuplicates(["vec_id", "components"]).withColumn("query", F.xxhash64("components"))
    # Summaries: the nearest vec_ids of each data group, one more than k as one of them may be the query itself, and one more for each
    # further group that rows of one vec_id lie in. Tasks send their own nearest.
    groups_of_id = assigned.groupBy("vec_id").agg(F.count_distinct("data_pivot").alias("n")).agg(F.max("n")).first()[0]
    need = k + int(groups_of_id)

    def summarise(batches):
        kept: dict[int, dict[int, float]] = {}
        for batch in batches:
            for i, g, d in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "data_pivot", "data_distance")), strict=True):
                best = kept.setdefault(g, {})
                if d < best.get(i, math.inf):
                    best[i] = d
                if len(best) > 64 * need:
                    kept[g] = dict(sorted(best.items(), key=lambda x: (x[1], x[0]))[:need])
        rows = [(i, g, d) for g, best in kept.items() for i, d in sorted(best.items(), key=lambda x: (x[1], x[0]))[:need]]
        yield pa.RecordBatch.from_pylist([dict(zip(("vec_id", "data_pivot", "data_distance"), r, strict=True)) for r in rows], schema=pa.schema([("vec_id", pa.int64()), ("data_pivot", pa.int32()), ("data_distance", pa.float64())]))

    sent = assigned.select("vec_id", "data_pivot", "data_distance").mapInArrow(summarise, "vec_id long, data_pivot int, data_distance double")
    sent = sent.groupBy("data_pivot", "vec_id").agg(F.min("data_distance").alias("data_distance"))
    nearest = Window.partitionBy("data_pivot").orderBy("data_distance", "vec_id")
    small = sent.withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= need).groupBy("data_pivot").agg(F.collect_list("data_distance").alias("d")).collect()
    groups = {r["query_pivot"]: (r["far"], r["n"]) for r in queries.groupBy("query_pivot").agg(F.max("query_distance").alias("far"), F.count("*").alias("n")).collect()}
    # At most STEPS rows a pivot: how many points lie how far from it.
    width = max(1e-9, 2.0 * math.sqrt(largest) + slack) / STEPS
    step = F.floor(F.col("data_distance") / width).cast("int").alias("step")
    counts = np.zeros((pivots, STEPS + 2))
    for r in assigned.groupBy("data_pivot", step).agg(F.count("*").alias("n")).collect():
        counts[r["data_pivot"], min(r["step"], STEPS + 1)] += r["n"]
    sizes = {int(p): int(n) for p, n in enumerate(counts.sum(axis=1)) if n}
    between = _distances(points, points)
    spared, whole = [], []
    for group, (far, n_queries) in groups.items():
        upper = np.sort(np.concatenate([far + between[group, r["data_pivot"]] + np.array(r["d"]) for r in small]))
        bound = upper[need - 1] if len(upper) >= need else math.inf
        mine, drawn = [], 0.0
        for pivot, n_data in sizes.items():
            # A point of this group nearer to its pivot than the first, or further than the second, can't be within the bound.
            gap = between[group, pivot] - far - bound - slack
            reach = between[group, pivot] + far + bound + slack
            low, high = (int(np.clip(math.floor(x / width), 0, STEPS + 1)) if math.isfinite(x) else (0 if x < 0 else STEPS + 1) for x in (gap, reach))
            inside = counts[pivot, low : high + 1].sum() if reach >= 0 else 0
            if inside:
                drawn += inside
                mine.append((int(group), int(pivot), float(gap), float(reach), math.ceil(n_data / CELL_ROWS), math.ceil(n_queries / CELL_QUERIES)))
        if drawn <= shape["n"] / 2:
            spared += mine
        else:
            whole.append((int(group), n_queries))
    # Groups that would draw most of the data share it: -1, -2, … take all of it.
    n_whole = sum(n for _, n in whole)
    parts = min(WHOLE, max(1, math.ceil(n_whole / WHOLE_QUERIES)))
    of_group = {group: -1 - i % parts for i, (group, _) in enumerate(sorted(whole))}
    wanted = spared + [
        (-1 - i, pivot, -math.inf, math.inf, math.ceil(n_data / CELL_ROWS), math.ceil(max(1, n_whole) / parts / CELL_QUERIES))
        for i in range(parts if whole else 0) for pivot, n_data in sizes.items()
    ]
    moved = F.create_map(*(F.lit(x) for pair in of_group.items() for x in pair)) if of_group else None
    if moved is not None:
        queries = queries.withColumn("query_pivot", F.coalesce(F.try_element_at(moved, F.col("query_pivot")), F.col("query_pivot")))
    plan = F.broadcast(spark.createDataFrame(wanted, "query_pivot int, data_pivot int, gap double, reach double, data_parts int, query_parts int"))
    data = assigned.select("vec_id", "components", "data_pivot", "data_distance").join(plan, "data_pivot").where("data_distance >= gap AND data_distance <= reach")
    part = F.pmod(F.xxhash64("vec_id"), F.col("data_parts")).cast("int")
    cell = ("query_pivot", "data_pivot", "data_part", "query_part")
    data = data.withColumn("data_part", part).withColumn("query_part", F.explode(F.sequence(F.lit(0), F.col("query_parts") - 1))).select("vec_id", "components", *cell)
    asked = queries.select("vec_id", "components", "query", "query_pivot").join(plan, "query_pivot").withColumn("query_part", F.pmod(F.xxhash64("vec_id"), F.col("query_parts")).cast("int"))
    asked = asked.withColumn("data_part", F.explode(F.sequence(F.lit(0), F.col("data_parts") - 1))).select("vec_id", "components", "query", *cell)

    def solve(data: pa.Table, queries: pa.Table) -> pa.Table:
        if not data.num_rows or not queries.num_rows:
            return BEST_ARROW.empty_table()
        ids, query_ids, prints = data.column("vec_id").to_numpy(), queries.column("of_vec_id").to_numpy(), queries.column("of_query").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        x = _matrix(data.column("components"), size)[order]
        q = _matrix(queries.column("of_components"), size)
        out = []
        for a in range(0, len(q), 128):
            scores = _products(q[a : a + 128], x)
            for query_id, query, row in zip(query_ids[a : a + 128].tolist(), prints[a : a + 128].tolist(), scores, strict=True):
                other = np.flatnonzero(ids != query_id)
                mine = row[other]
                if len(mine) > k:
                    least = np.partition(mine, len(mine) - k)[len(mine) - k]
                    above, equal = np.flatnonzero(mine > least), np.flatnonzero(mine == least)
                    pick = np.concatenate([above, equal[: k - len(above)]])
                else:
                    pick = np.arange(len(mine))
                out.append((np.full(len(pick), query_id), np.full(len(pick), query), ids[other[pick]], mine[pick]))
        return pa.table(dict(zip(BEST_ARROW.names, (np.concatenate(c) for c in zip(*out, strict=True)), strict=True)), schema=BEST_ARROW)

    # New names: both sides come from the same rows.
    asked = asked.select(*(F.col(c).alias(f"of_{c}") for c in asked.columns))
    best = data.groupBy(*cell).cogroup(asked.groupBy(*(f"of_{c}" for c in cell))).applyInArrow(solve, BEST)
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
