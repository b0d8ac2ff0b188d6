"""Near duplicates by SimHash: pigeonhole blocks, a join on equal blocks, and verified Hamming distances.

A 64-bit fingerprint is split into b blocks. Two fingerprints that differ in at most k bits agree in at least b - k whole blocks, so
each choice of b - k blocks is a table whose rows are keyed by those blocks' bits, and every close pair shares a key in a table.
More blocks make longer keys, so their number follows the number of different fingerprints. Equal fingerprints are one row
from the start. A key that many fingerprints share is dealt to cells of pairs of parts; a cell compares its members and
emits only links that connect them, never all pairs.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm import common as C
from tallyweave.llm import bloom, minhash
from tallyweave.llm.components import connected_components

SEED = 42
#: Fingerprints of one key in a part, and rows that a task compares at a time.
PART, GROUP = 4096, 50_000
LINKS = "u long, v long"
LINKS_ARROW = pa.schema([("u", pa.int64()), ("v", pa.int64())])
_ONES = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def ones(x: np.ndarray) -> np.ndarray:
    """Set bits of 64-bit values."""
    return _ONES[np.ascontiguousarray(x).view(np.uint16)].reshape(-1, 4).sum(axis=1)


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of every run of ``width`` words, joined by one blank; of all words if there are fewer; none if there are none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    flat = b" ".join(words)
    hashed = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([hashed(flat, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    count = len(words) - width + 1
    pairs = zip(starts[:count].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.fromiter((hashed(flat[a:b], SEED) for a, b in pairs), np.uint64, count)


def fingerprints(texts: list[bytes], width: int) -> np.ndarray:
    """A bit is set if over half of a text's shingle hashes have it; zero for a text without words."""
    return fingerprints_of([shingle_hashes(text, width) for text in texts])


def fingerprints_of(all_hashes: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(all_hashes), np.uint64)
    for i, hashes in enumerate(all_hashes):
        if len(hashes):
            sums = np.zeros(64, np.int64)
            for a in range(0, len(hashes), 1 << 14):
                sums += np.unpackbits(hashes[a : a + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
            out[i] = np.packbits(sums * 2 > len(hashes)).view(">u8")[0]
    return out


def add_fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, text_hash, fp): the SimHash of each whole text, lower-cased in A-Z, as a signed 64-bit integer."""

    def run(batches):
        for batch in C.small(batches):
            prints = fingerprints([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()], width)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("text_hash"), pa.array(prints.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(C.giving_back(run), "doc_id long, text_hash long, fp long")


def add_sets(docs: DataFrame, width: int) -> DataFrame:
    """As ``add_fingerprints``, with each text's set of shingles: its hash (null for a text without words), size and band keys."""

    def run(batches):
        for batch in C.small(batches):
            hashes = [shingle_hashes(t or b"", width) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            sets = [np.unique(h) for h in hashes]
            ids = [np.uint64(minhash.set_hash(s)).astype(np.int64).item() if len(s) else None for s in sets]
            bands = [minhash.band_keys(s).view(np.int64) if len(s) else [] for s in sets]
            columns = [pa.array(fingerprints_of(hashes).view(np.int64)), pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("text_hash"), *columns], names=["doc_id", "text_hash", "fp", "set_id", "n_shingles", "bands"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(C.giving_back(run), "doc_id long, text_hash long, fp long, set_id long, n_shingles long, bands array<long>")


def block_masks(n_blocks: int, distance: int) -> list[int]:
    """For each choice of n_blocks - distance blocks, the mask of their bits."""
    edge = [64 * i // n_blocks for i in range(n_blocks + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edge[:-1], edge[1:], strict=True)]
    return [sum(c) for c in combinations(blocks, n_blocks - distance)]


def _forest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest member that each of n members is connected to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        for side in (u, v):
            np.minimum.at(new, label[side], low)
            np.minimum.at(new, side, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _links(rows: pa.Table, distance: int) -> pa.Table:
    """Links that connect all close fingerprints of the same cell."""
    cell, fp = rows.column("cell").to_numpy(), rows.column("fp").to_numpy()
    order = np.lexsort((fp, cell))
    cell, fp = cell[order], fp[order].view(np.uint64)
    n, shift, pairs, size = len(fp), 1, [], 0
    left = np.arange(n - 1)
    while len(left):
        left = left[left + shift < n]
        left = left[cell[left] == cell[left + shift]]
        close = left[ones(fp[left] ^ fp[left + shift]) <= distance] if len(left) else left
        if len(close):
            pairs.append(np.stack([close, close + shift]))
            size += len(close)
        if size > 1 << 20:
            u, v = np.concatenate(pairs, axis=1)
            label = _forest(n, u, v)
            linked = np.flatnonzero(label != np.arange(n))
            pairs, size = [np.stack([linked, label[linked]])], len(linked)
        shift += 1
    if not pairs:
        return LINKS_ARROW.empty_table()
    u, v = np.concatenate(pairs, axis=1)
    label = _forest(n, u, v)
    linked = np.flatnonzero(label != np.arange(n))
    return pa.table({"u": fp[linked].view(np.int64), "v": fp[label[linked]].view(np.int64)}, schema=LINKS_ARROW)


def close_links(prints: DataFrame, distance: int = 4, part: int = PART) -> DataFrame:
    """Links (u, v) among different fingerprints (column fp) that connect all that differ in at most ``distance`` bits."""
    n = prints.count()
    n_blocks = next(b for b in range(distance + 1, 65) if b == 64 or 64 * (b - distance) // b >= math.log2(max(2, n)) + 2 or b >= 2 * distance)
    masks = F.array(*(F.lit(m - (1 << 64) if m >> 63 else m) for m in block_masks(n_blocks, distance)))
    keyed = prints.select("fp", F.posexplode(masks).alias("table", "mask")).select("fp", F.xxhash64("table", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / part).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    dealt = keyed.join(shared, "key").withColumn("parts", parts).withColumn("part", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = dealt.select("fp", F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("cell"))
    groups = max(1, math.ceil(n / GROUP))
    cells = cells.withColumn("task", F.pmod("cell", F.lit(groups * 4)))
    return cells.groupBy("task").applyInArrow(lambda rows: _links(rows, distance), LINKS)


def near_duplicate_groups(docs: DataFrame, width: int = 4, distance: int = 4, similarity: float | None = None) -> DataFrame:
    """Each document's fingerprint and the group of near duplicates it belongs to.

    docs: doc_id, text. Words are runs of characters other than space and \\x09-\\x0D, lower-cased in A-Z; shingles are ``width``
    consecutive words (all words if there are fewer), hashed by XXH64 with seed 42. Documents whose fingerprints differ in at most
    ``distance`` bits are linked; texts that are null or have no words have fingerprint zero and are linked like any other.
    With ``similarity``, texts whose sets of shingles have at least that Jaccard similarity are linked too (``minhash``).

    Returns doc_id, text_hash, fp (long), fingerprint (16 hex digits), root (a fingerprint of the group), component_id (smallest doc_id that can be reached; null if no document
    of the group has an id). Every row has a result of its own, so repeated rows repeat. Further columns are ignored.
    """
    stored = C.stored(add_fingerprints(docs, width) if similarity is None else add_sets(docs, width), "simhash")
    prints = stored.groupBy("fp").agg(F.min("doc_id").alias("least"))
    links = close_links(prints.select("fp"), distance)
    roots = connected_components(links if similarity is None else minhash.similar_links(stored, docs, links, width, similarity))
    member = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = member.groupBy("root").agg(F.min("least").alias("component_id"))
    groups = member.join(smallest, "root").select("fp", "root", "component_id")
    return stored.join(groups, "fp").select("doc_id", "text_hash", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "root", "component_id")


def keep_one_of_each_group(docs: DataFrame, width: int = 4, distance: int = 4, similarity: float | None = None) -> DataFrame:
    """The documents with one of each group of near duplicates: that with the smallest doc_id (without an id only if none has one).

    All columns are kept. Nulls and texts without words are as in ``near_duplicate_groups``; of rows equal in id and text one stays.
    """
    fixed = [f"c{i}" for i in range(len(docs.columns))]
    given = docs.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(docs.columns, fixed, strict=True)))
    doc_id, text = (F.col(fixed[docs.columns.index(c)]) for c in ("doc_id", "text"))
    groups = near_duplicate_groups(docs.select("doc_id", "text"), width, distance, similarity)
    rows = groups.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    rows = rows.withColumn("order", order)
    rows = rows.join(rows.groupBy("root").agg(F.min("order").alias("first")), "root")
    stays = F.col("order") == F.col("first")
    # Rows to leave out, and rows to keep once: a small part of all, so only documents that pass a filter of these are shuffled.
    touched = rows.where(~stays | (F.col("n") > 1)).select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"), stays.alias("stays"))
    touched = C.stored(touched, "simhash-touched")
    bits = bloom.filter_of(touched.select(minhash.text_key(F.col("gone_id"), F.col("gone_hash")).alias("key")), "key")
    hashed = given.withColumn("text_hash", F.xxhash64(text))
    maybe, clear = bloom.split(hashed, minhash.text_key(doc_id, F.col("text_hash")), bits)
    found = maybe.join(touched, doc_id.eqNullSafe(F.col("gone_id")) & (F.col("text_hash") == F.col("gone_hash")), "left")
    once = found.where("stays").dropDuplicates([fixed[docs.columns.index("doc_id")], "text_hash"])
    kept = clear.select(*fixed).unionByName(found.where("stays IS NULL").select(*fixed)).unionByName(once.select(*fixed))
    return kept.select(*(F.col(k).alias(c) for k, c in zip(fixed, docs.columns, strict=True)))
