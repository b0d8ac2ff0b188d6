"""What the operators share: shared storage, document blocks, word positions, hashes and packed integers.

A *block* is a set of whole documents of about a given number of bytes that one task handles at a time. Documents are dealt
to blocks by a hash of their id, so a block never depends on the layout of the input. A *bucket* is a range of hash values;
blocks send each bucket one packed array of distinct values, which is what is shuffled instead of a row for every position.
"""

from __future__ import annotations

import ctypes
import math
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"
#: Order key of a document without an id: it comes after all others.
NO_ID = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a folder of our own only where it is unset."""
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{SETTING} must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tallyweave-llm-")
        spark.conf.set(SETTING, folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and continue from the written table, so later steps do not repeat its work."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete a table that ``stored`` wrote and nothing reads any more."""
    spark = df.sparkSession
    files = df.inputFiles()
    if files:
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: Texts that go from Spark to Python at a time: the default of 10,000 makes batches of tens of MB that executors keep room for.
BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1_000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's batches between Spark and Python to BATCH_ROWS rows."""
    if int(spark.conf.get(BATCH_SETTING)) > BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))


def fold(doc_id: Column | str, modulo: int) -> Column:
    """crc32 of the id as text, modulo ``modulo``; a null id counts as the empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit(""))), F.lit(modulo)).cast("int")


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """Bytes of all texts: one native pass that the numbers of blocks and buckets follow."""
    return int(df.agg(F.sum(F.octet_length(text))).first()[0] or 0)


def plain(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that further columns of the input can't clash with ours."""
    return df.select(*columns)


def in_blocks(df: DataFrame, total: int, block_bytes: int, *more: str | Column) -> tuple[DataFrame, int]:
    """(doc_id, text, more…, block), dealt by block, and the number of blocks."""
    n = max(1, math.ceil(total / block_bytes))
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    blocks = df.select("doc_id", "text", *more, F.pmod(key, F.lit(n)).cast("long").alias("block"))
    return blocks.repartition(n, "block"), n


def buckets_for(spark: SparkSession, total: int, bucket_bytes: int) -> int:
    """Enough buckets for the shuffle's parallelism, more where the data need it."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / bucket_bytes))


# Texts in tasks.

#: Bytes of text that a task turns into Python objects or wide arrays at a time.
WORKING_BYTES = 1 << 20


def small(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = WORKING_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of ``column``; a longer text is a batch of its own."""
    for batch in batches:
        sums = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(sums, (sums[start - 1] if start else 0) + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def give_back() -> None:
    """Return freed memory of this worker to the system, so that a task's arrays don't stay with the process for the next stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def giving_back(run):
    """A function over batches that returns its memory when a partition ends."""

    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped


# Documents of a block as flat arrays.


def flat_text(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts (null: empty) as one byte array, and where each begins; the last offset is the end."""
    array = pc.fill_null(column.cast(pa.large_string()), "")
    array = array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array
    array = pa.concat_arrays(array.chunks) if isinstance(array, pa.ChunkedArray) else array
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def ordered(block: pa.Table) -> pa.Table:
    """A block's documents by id; rows with the same id by text, rows without an id last."""
    return block.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def order_ids(block: pa.Table) -> np.ndarray:
    return pc.fill_null(block.column("doc_id"), NO_ID).to_numpy().astype(np.int64)


def space_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of bytes other than space and \\x09-\\x0D, and the first word of each document."""
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    return _runs(word, offsets)


def _runs(word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(word)
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[begins] = word[begins]
    ends = begins[1:] - 1
    last[ends] = word[ends]
    if n:
        last[n - 1] = word[n - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets).astype(np.int64)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


# Hashes. Sums of table[byte] * base^position modulo 2^64, taken back to position 0 by the inverse power.

_BYTES = np.random.default_rng(20_240_607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = {0: 0x9E3779B97F4A7C15, 1: 0xC2B2AE3D27D4EB4F, 2: 0xD6E8FEB86659FD93}
_POWERS: dict[tuple[int, bool], np.ndarray] = {}
_SLICE = 1 << 20


def _powers(which: int, n: int, inverse: bool) -> np.ndarray:
    got = _POWERS.get((which, inverse))
    if got is None or len(got) < n + 1:
        base = pow(_BASES[which], -1, 1 << 64) if inverse else _BASES[which]
        size = max(n + 1, 1 << 16)
        with np.errstate(over="ignore"):
            got = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, base, np.uint64)]))
        _POWERS[which, inverse] = got
    return got[: n + 1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def _spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    """Hash of values[start:end] for ascending starts and ends."""
    n = len(values)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(values * _powers(which, n, False)[:n], dtype=np.uint64)])
        return mixed((sums[ends] - sums[starts]) * _powers(which, n, True)[starts])


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hash of each word; done in slices, so that wide arrays stay small."""
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _SLICE, "right")))
        base = starts[i]
        out[i:j] = _spans(_BYTES[data[base : ends[j - 1]]], starts[i:j] - base, ends[i:j] - base, which)
        i = j
    return out


def hash_windows(values: np.ndarray, starts: np.ndarray, width: int, which: int = 1) -> np.ndarray:
    """64-bit hash of ``width`` consecutive values from each start."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    return _spans(values, starts, starts + width, which)


# Packed arrays: sorted integers as differences, by byte planes, so that zlib finds the zeros of the high planes.


def pack(values: np.ndarray) -> bytes:
    if not len(values):
        return b""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    used = max(1, 8 - int(np.argmax(planes[::-1].any(axis=1)))) if planes.any() else 1
    return bytes([used]) + zlib.compress(planes[:used].tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(zlib.decompress(data[1:]), np.uint8).reshape(data[0], -1)
    planes = np.zeros((raw.shape[1], 8), np.uint8)
    planes[:, : data[0]] = raw.T
    return planes.view("<u8").ravel().astype(np.uint64)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values.astype(np.uint64), prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def pack_bits(mask: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(mask).tobytes(), 1)


def unpack_bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(data), np.uint8), count=n).astype(bool)


def bucket_slices(values: np.ndarray, bits: int, n_buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of sorted ``bits``-wide hashes, each bucket an equal range of values; empty buckets are left out."""
    width = -(-(1 << bits) // n_buckets)
    if not len(values):
        return []
    bucket = (values // np.uint64(width)).astype(np.int64)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
    return [(int(bucket[a]), int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def shorten(values: np.ndarray, bits: int) -> np.ndarray:
    return values >> np.uint64(64 - bits)


def filter_bits(total: int) -> int:
    """Width of a hash that only has to rule out: about one chance hit in 200 positions at any size of input."""
    return min(60, max(24, math.ceil(math.log2(max(2, total))) + 5))
