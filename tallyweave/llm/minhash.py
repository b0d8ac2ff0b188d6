"""Texts whose sets of word shingles have a Jaccard similarity of at least a bound: MinHash candidates, exact verification.

Texts with the same set of shingles are one *set* from the start. A set has BANDS keys of ROWS minima each; two sets of similarity s
share a key with probability 1 - (1 - s^ROWS)^BANDS: 0.9996 at 0.8, more above. Members of a key are compared by their whole sets
of 64-bit shingle hashes, so no link is a guess. What is already connected is not compared again: keys whose members are all
connected send nothing, and keys with the same members send them once. A key with many bytes is dealt to cells of pairs of parts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm import bloom
from tallyweave.llm import common as C
from tallyweave.llm.components import connected_components

BANDS, ROWS = 20, 5
#: Bands by round: the first connect most of what is similar, so that the others have few texts left to compare.
ROUNDS = ((0, 4), (4, BANDS))
#: Bytes of shingle hashes of one key in a part, and in a task.
PART_BYTES, TASK_BYTES = 2 << 20, 8 << 20
#: Sets that one set is compared with at a time.
COMPARED = 256
LINKS = "u long, v long"
LINKS_ARROW = pa.schema([("u", pa.int64()), ("v", pa.int64())])
_RANDOM = np.random.default_rng(20_261_201)
_XOR = _RANDOM.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64)
_TIMES = _RANDOM.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key of each band for a set of shingle hashes that isn't empty."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(hashes), 1 << 11):
        least = np.minimum(least, ((hashes[a : a + (1 << 11)] ^ _XOR) * _TIMES).min(axis=1))
    keys = np.arange(BANDS, dtype=np.uint64)
    for minima in least.reshape(BANDS, ROWS).T:
        keys = C.mixed(keys * np.uint64(0x9E3779B97F4A7C15) ^ minima)
    return keys


def set_hash(hashes: np.ndarray) -> int:
    """One 64-bit hash for a sorted set of shingle hashes."""
    return int(C.mixed(np.array([C.mixed(hashes).sum(dtype=np.uint64)]) ^ np.uint64(len(hashes)))[0])


def _similar(roots: np.ndarray, sets: list[np.ndarray], bound: float) -> list[tuple[int, int]]:
    """Pairs of members that connect, beside equal roots, all members of similarity ``bound`` or more.

    With shingles in order of how rare they are, two similar sets share one of the first few of each. A set is compared only with those of
    other components that share one, so members that have little in common cost little.
    """
    component = np.unique(roots, return_inverse=True)[1]
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    _, words, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    member = np.repeat(np.arange(len(sets)), sizes)
    rarity = np.empty(len(counts), np.int64)
    rarity[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    words = rarity[words]
    order = np.lexsort((words, member))
    words = words[order]
    place = np.arange(len(words)) - starts[member]
    shared = np.bincount(words)[words] > 1
    early = np.flatnonzero((place <= sizes[member] - np.ceil(bound * sizes[member] - 1e-9)) & shared)
    # Postings: the members that have a word early, by word.
    early = early[np.argsort(words[early], kind="stable")]
    posted, at = member[early], words[early]
    flag = np.zeros(len(counts), np.int64)
    pairs = []
    largest = np.bincount(component).argmax()
    # Two members of different components are compared when either is taken, so all outside the largest component suffice.
    for i in np.flatnonzero(component != largest).tolist():
        mine = words[starts[i] : starts[i] + sizes[i]]
        first = mine[: int(sizes[i] - np.ceil(bound * sizes[i] - 1e-9)) + 1]
        low, high = np.searchsorted(at, first), np.searchsorted(at, first, "right")
        runs = [posted[x:y] for x, y in zip(low.tolist(), high.tolist(), strict=True) if y - x > 1]
        if not runs:
            continue
        others = np.unique(np.concatenate(runs))
        others = others[(component[others] != component[i]) & (np.minimum(sizes[others], sizes[i]) >= bound * np.maximum(sizes[others], sizes[i]) - 1e-9)]
        if not len(others):
            continue
        flag[mine] = 1
        for a in range(0, len(others), COMPARED):
            some = others[a : a + COMPARED]
            reach = np.cumsum(sizes[some])
            inside = np.arange(reach[-1]) - np.repeat(reach - sizes[some], sizes[some]) + np.repeat(starts[some], sizes[some])
            both = np.add.reduceat(flag[words[inside]], reach - sizes[some])
            for j in some[both >= bound * (sizes[some] + sizes[i] - both)].tolist():
                if component[j] != component[i]:
                    pairs.append((i, j))
                    component[component == component[j]] = component[i]
        flag[mine] = 0
    return pairs


def _cells(rows: pa.Table, bound: float) -> pa.Table:
    cell, fp, root = (rows.column(c).to_numpy() for c in ("cell", "fp", "root"))
    order = np.argsort(cell, kind="stable")
    edges = np.concatenate([[0], np.flatnonzero(np.diff(cell[order])) + 1, [len(order)]])
    shingles, u, v = rows.column("shingles"), [], []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        at = order[a:b]
        for i, j in _similar(root[at], [np.frombuffer(shingles[int(x)].as_py(), "<u8") for x in at], bound):
            u.append(int(fp[at[i]]))
            v.append(int(fp[at[j]]))
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())}, schema=LINKS_ARROW)


def shingle_sets(docs: DataFrame, width: int, bits: np.ndarray | None) -> DataFrame:
    """(set_id, shingles): the sorted distinct shingle hashes as bytes, of the texts (doc_id, text) whose ``text_key`` passes the filter, of all if there is none."""
    from tallyweave.llm.simhash import shingle_hashes

    places = bloom.places(text_key(F.col("doc_id"), F.xxhash64("text")))
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for batch in C.small(batches):
            if sent.value is not None:
                batch = batch.filter(pa.array(bloom.passes(sent.value, batch.column("places"))))
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            sets = [s for s in (np.unique(shingle_hashes(t or b"", width)) for t in texts) if len(s)]
            ids = np.array([set_hash(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], names=["set_id", "shingles"])

    return docs.select("text", places.alias("places")).mapInArrow(C.giving_back(run), "set_id long, shingles binary")


def text_key(doc_id: Column, text_hash: Column) -> Column:
    return F.xxhash64(F.coalesce(doc_id, F.lit(C.NO_ID)), text_hash)


def _shared_keys(sets: DataFrame) -> DataFrame:
    """(key, band, set_id, fp, n_shingles, n) of the keys that several sets have; of keys with the same sets the first."""
    keyed = sets.select(F.posexplode("bands").alias("band", "key"), "set_id")
    several = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = C.stored(keyed.join(several, "key"), "similar-keys")
    which = members.groupBy("key", "band", "n").agg(F.bit_xor(F.xxhash64("set_id")).alias("which"))
    first = which.groupBy("n", "which").agg(F.min(F.struct("band", "key")).alias("s")).select("s.key")
    about = sets.select("set_id", "fp", "n_shingles")
    return C.stored(members.join(first, "key").join(about, "set_id"), "similar-members")


def _compared(members: DataFrame, shingles: DataFrame, bound: float) -> DataFrame:
    """Links (u, v) of fingerprints from members (key, set_id, fp, n_shingles, root) of keys; keys whose members are all connected have none."""
    keys = members.groupBy("key").agg(F.sum(F.col("n_shingles") * 8).alias("bytes"), F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b")
    keys = keys.select("key", F.ceil(F.col("bytes") / PART_BYTES).cast("int").alias("parts"))
    dealt = C.stored(members.join(keys, "key").withColumn("part", F.pmod(F.xxhash64("set_id"), F.col("parts")).cast("int")), "similar-dealt")
    total = dealt.agg(F.sum(F.col("n_shingles") * F.col("parts"))).first()[0] or 0
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = cells.select("set_id", "fp", "root", F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("cell"))
    cells = cells.join(shingles, "set_id").withColumn("task", F.pmod("cell", F.lit(max(1, total * 8 // TASK_BYTES) * 4)))
    return cells.groupBy("task").applyInArrow(lambda rows: _cells(rows, bound), LINKS)


def similar_links(stored: DataFrame, docs: DataFrame, links: DataFrame, width: int, bound: float) -> DataFrame:
    """``links`` and further links (u, v) of fingerprints that together connect all texts found to be similar.

    stored: doc_id, text_hash, fp, set_id, n_shingles, bands (no set_id: a text without words, which has no links here). Texts are not
    shuffled: those that share a key pass a filter of fixed size where they are read, and only their shingles go on.
    """
    first = F.min(F.struct("fp", F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "n_shingles")).alias("s")
    sets = stored.where("set_id IS NOT NULL").groupBy("set_id").agg(first, F.first("bands").alias("bands"))
    sets = C.stored(sets.select("set_id", "s.fp", "s.doc_id", "s.text_hash", "s.n_shingles", "bands"), "similar-sets")
    # Texts of one set may repeat it in different ways, which gives them different fingerprints.
    same = stored.select("set_id", F.col("fp").alias("u")).join(sets.select("set_id", F.col("fp").alias("v")), "set_id").where("u <> v").select("u", "v").distinct()
    links = C.stored(links.unionByName(same), "similar-links")
    members = _shared_keys(sets)
    wanted = members.select("set_id").distinct()
    texts = sets.join(wanted, "set_id", "left_semi").select(text_key(F.col("doc_id"), F.col("text_hash")).alias("key"))
    found = shingle_sets(docs, width, bloom.filter_of(texts, "key")).join(wanted, "set_id", "left_semi")
    shingles = C.stored(found.groupBy("set_id").agg(F.first("shingles").alias("shingles")), "similar-shingles")
    for a, b in ROUNDS:
        roots = connected_components(links)
        round_members = members.where((F.col("band") >= a) & (F.col("band") < b))
        at = round_members.join(roots, round_members["fp"] == roots["node"], "left").withColumn("root", F.coalesce("root", "fp"))
        links = C.stored(links.unionByName(_compared(at.select("key", "set_id", "fp", "n_shingles", "root"), shingles, bound)), "similar-links")
    return links
