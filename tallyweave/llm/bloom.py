"""A filter of fixed size that rules out most rows of a large table before they are shuffled.

The bits are set by tasks, each for its own range of the filter, so the driver gets BITS bits at most and never a key. A row whose
key is in the set always passes, others do at a rate of a few hundredths; an exact join follows. Beyond CAPACITY keys a filter would
rule out too little, and there is none: then every row goes to the join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 26
HASHES = 4
CAPACITY = BITS // 8
#: Bits that one task sets.
RANGE = 1 << 19


def places(key: Column) -> Column:
    """The bits of a key."""
    return F.array(*(F.pmod(F.xxhash64(F.lit(k), key), F.lit(BITS)) for k in range(HASHES)))


def filter_of(keys: DataFrame, column: str, capacity: int = CAPACITY) -> np.ndarray | None:
    """Packed bits of the keys in ``column``; None where they are more than ``capacity``."""
    if keys.count() > capacity:
        return None
    at = keys.select(F.explode(places(F.col(column))).alias("at"))
    at = at.select((F.col("at") / RANGE).cast("int").alias("range"), (F.col("at") % RANGE).cast("int").alias("at")).distinct()

    def pack(rows: pa.Table) -> pa.Table:
        bits = np.zeros(RANGE, bool)
        bits[rows.column("at").to_numpy()] = True
        return pa.table({"range": rows.column("range")[:1], "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    out = np.zeros(BITS // 8, np.uint8)
    for row in at.groupBy("range").applyInArrow(pack, "range int, bits binary").collect():
        start = row["range"] * (RANGE // 8)
        out[start : start + RANGE // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


def passes(bits: np.ndarray, at: pa.Array) -> np.ndarray:
    """Which rows pass; ``at`` holds the places of their keys."""
    place = at.flatten().to_numpy().reshape(-1, HASHES)
    return ((bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1).all(axis=1)


def split(df: DataFrame, key: Column, bits: np.ndarray | None) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` that may have a key of the filter, and those that surely have none."""
    if bits is None:
        return df, df.limit(0)
    sent = df.sparkSession.sparkContext.broadcast(bits)

    def part(wanted: bool):
        def run(batches):
            for batch in batches:
                yield batch.filter(pa.array(passes(sent.value, batch.column("bloom_places")) == wanted)).drop_columns(["bloom_places"])

        return df.withColumn("bloom_places", places(key)).mapInArrow(run, df.schema)

    return part(True), part(False)
