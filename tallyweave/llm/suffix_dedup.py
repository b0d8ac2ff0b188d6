"""Removal of byte strings that occur earlier, by suffix arrays over shards of the corpus.

Two equal windows of ``window`` bytes have the same anchor: the smallest hash of the ``anchor`` byte strings in them. A run of
windows with the same anchor is one string, which goes to the shard of its anchor, so equal windows always meet in a shard. An
anchor that only one run of the corpus has can have no equal windows, and is left out; blocks and buckets find that out as
packed hashes, not as rows. Equal strings are sent once per block. A shard sorts its strings' suffixes by induced sorting and
finds the windows that begin earlier from the permuted common prefixes.

An anchor that very many runs share (the edge of a passage that a third of all documents quote) is dealt to several shards by
the hash of the string; each solves its part in the same way, and the first windows of the parts then meet by their hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyweave.llm import common as C
from tallyweave.llm.suffix_array import repeated_windows

BLOCK_BYTES = 3 << 20
BUCKET_BYTES = 64 << 20
SHARD_BYTES = 8 << 20
#: Bytes whose suffixes are sorted at once; a larger group of one anchor is still sorted as a whole.
SORTED_BYTES = 1 << 19
#: Runs of one anchor in one part.
PART_RUNS = 4096
#: A byte that UTF-8 text doesn't have.
STOP = 0xFF
SLICE = 1 << 18

ASK = "block long, bucket long, anchors binary, counts binary"
ASK_ARROW = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("anchors", pa.binary()), ("counts", pa.binary())])
STRING = "shard long, anchor long, parts int, block long, at long, document long, tie long, hash long, hash2 long, again boolean, string binary"
STRING_ARROW = pa.schema([("shard", pa.int64()), ("anchor", pa.int64()), ("parts", pa.int32()), ("block", pa.int64()), ("at", pa.int64()), ("document", pa.int64()), ("tie", pa.int64()), ("hash", pa.int64()), ("hash2", pa.int64()), ("again", pa.bool_()), ("string", pa.binary())])
FOUND = "bucket long, block long, starts binary, stops binary, hash binary, hash2 binary, document binary, tie binary"
FOUND_ARROW = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), *((x, pa.binary()) for x in ("starts", "stops", "hash", "hash2", "document", "tie"))])
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_text string, kept_sha256 string, spans array<struct<start:long,length:long>>"
SPAN = pa.struct([("start", pa.int64()), ("length", pa.int64())])
RESULT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_text", pa.string()), ("kept_sha256", pa.string()), ("spans", pa.list_(SPAN))])


def _minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of ``width`` consecutive values, by doubling."""
    reach = 1
    while reach * 2 <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    return values if reach == width else np.minimum(values[: len(values) - (width - reach)], values[width - reach :])


class _Runs:
    """Runs of windows with one anchor in a block's documents: anchor, first window, one past the last window, and whether the anchor occurs again in it."""

    def __init__(self, block: pa.Table, window: int, anchor: int) -> None:
        self.block = C.ordered(block)
        self.data, self.offsets = C.flat_text(self.block.column("text"))
        lengths = np.diff(self.offsets)
        parts = []
        # Whole documents together up to a slice, a longer document in overlapping slices.
        i, n = 0, len(lengths)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.offsets, self.offsets[i] + SLICE, "right")) - 1)
            a, b = int(self.offsets[i]), int(self.offsets[j])
            if j == i + 1 and b - a > 2 * SLICE:
                for x in range(a, max(a + 1, b - window + 1), SLICE):
                    parts.append(self._slice(x, min(b, x + SLICE + window - 1), window, anchor))
            else:
                parts.append(self._slice(a, b, window, anchor, self.offsets[i : j + 1]))
            i = j
        self.anchors, self.first, self.stop, self.again = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, t) for k, t in enumerate((np.uint64, np.int64, np.int64, bool)))
        self.document = np.searchsorted(self.offsets, self.first, "right") - 1

    def _slice(self, a: int, b: int, window: int, anchor: int, offsets: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        n = b - a
        if n < window:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(C._BYTES[self.data[a:b]] * C._powers(0, n, False)[:n], out=sums[1:])
            hashes = (sums[anchor:] - sums[:-anchor]) * C._powers(0, n, True)[: n - anchor + 1]
        smallest = _minimum(hashes, window - anchor + 1)
        fits = np.ones(len(smallest), bool)
        for stop in (offsets[1:-1] - a).tolist() if offsets is not None else ():
            fits[max(0, stop - window + 1) : stop] = False
        new = fits.copy()
        new[1:] &= (smallest[1:] != smallest[:-1]) | ~fits[:-1]
        first = np.flatnonzero(new)
        last = fits.copy()
        last[:-1] &= new[1:] | ~fits[1:]
        stop = np.flatnonzero(last) + 1
        # Whether the anchor occurs more than once in the run's string: a window may then be repeated inside it.
        values = smallest[first]
        reach = stop + window - anchor
        again = stop - first > window - anchor + 1
        short = np.flatnonzero(~again)
        again[short] = _occurs_again(hashes, values[short], first[short], reach[short])
        return values, first + a, stop + a, again


def _occurs_again(hashes: np.ndarray, values: np.ndarray, first: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Whether a value occurs more than once in hashes[first:reach]."""
    sizes = reach - first
    at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first, sizes)
    hit = hashes[at] == np.repeat(values, sizes)
    return np.add.reduceat(hit.astype(np.int32), np.cumsum(sizes) - sizes) > 1 if len(sizes) else np.zeros(0, bool)


def _ask(runs: _Runs, block: int, bits: int, n_buckets: int) -> pa.Table:
    values, counts = np.unique(C.shorten(runs.anchors, bits), return_counts=True)
    rows = [{"block": block, "bucket": k, "anchors": C.pack_sorted(values[a:b]), "counts": C.pack(counts[a:b])} for k, a, b in C.bucket_slices(values, bits, n_buckets)]
    return pa.Table.from_pylist(rows, schema=ASK_ARROW)


def _answer(messages: pa.Table, part_runs: int) -> pa.Table:
    """For each anchor a block asked about: 0 if one run has it, else 1 plus the doublings of its parts."""
    asked = messages.to_pylist()
    lists = [C.unpack_sorted(r["anchors"]) for r in asked]
    values, which = np.unique(np.concatenate(lists), return_inverse=True)
    totals = np.bincount(which, np.concatenate([C.unpack(r["counts"]) for r in asked]), len(values))
    codes = np.where(totals > 1, 1 + np.ceil(np.log2(np.maximum(1, totals / part_runs))), 0).astype(np.uint64)
    parts = np.split(codes[which], np.cumsum([len(x) for x in lists])[:-1])
    return pa.Table.from_pylist([{**r, "anchors": None, "counts": C.pack(p)} for r, p in zip(asked, parts, strict=True)], schema=ASK_ARROW)


def _gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return data[np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)]


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _strings(runs: _Runs, block: int, messages: pa.Table, bits: int, n_buckets: int, window: int, n_shards: int) -> pa.Table:
    """The strings of anchors that several runs have: one row for each different string of the block; equal ones after it are repeated as a whole."""
    values, which = np.unique(C.shorten(runs.anchors, bits), return_inverse=True)
    codes = np.zeros(len(values), np.int64)
    answers = {r["bucket"]: r["counts"] for r in messages.to_pylist()}
    for k, a, b in C.bucket_slices(values, bits, n_buckets):
        codes[a:b] = C.unpack(answers[k])
    code = codes[which]
    kept = np.flatnonzero((code > 0) | runs.again)
    first, stop = runs.first[kept], runs.stop[kept] + window - 1
    hash1, hash2 = (_hash_strings(runs.data, first, stop, k) for k in (1, 2))
    order = np.lexsort((first, hash2, hash1))
    new = np.ones(len(order), bool)
    new[1:] = (hash1[order][1:] != hash1[order][:-1]) | (hash2[order][1:] != hash2[order][:-1])
    sent = np.sort(order[new])
    copies = np.sort(order[~new])
    parts = np.left_shift(1, np.maximum(code[kept][sent] - 1, 0))
    anchors = runs.anchors[kept][sent]
    part = (hash1[sent] % parts.astype(np.uint64)).astype(np.uint64)
    with np.errstate(over="ignore"):
        shard = (C.mixed(anchors + part * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n_shards)).astype(np.int64)
    document = C.order_ids(runs.block)[runs.document[kept][sent]]
    sizes = (stop - first)[sent]
    strings = pa.table({
        "shard": shard, "anchor": C.mixed(anchors ^ C.mixed(part)).view(np.int64), "parts": parts.astype(np.int32), "block": np.full(len(sent), block), "at": first[sent], "document": document,
        "tie": np.where(document == C.NO_ID, block, 0), "hash": hash1[sent].view(np.int64), "hash2": hash2[sent].view(np.int64), "again": runs.again[kept][sent],
        "string": _binary(_gather(runs.data, first[sent], sizes), sizes),
    }, schema=STRING_ARROW)
    own = _joined(runs.first[kept][copies], runs.stop[kept][copies])
    row = dict.fromkeys(STRING_ARROW.names) | {"shard": block % n_shards, "block": block, "parts": 0, "string": _packed_spans(*own)}
    return pa.concat_tables([strings, pa.Table.from_pylist([row], schema=STRING_ARROW)])


def _hash_strings(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, which: int) -> np.ndarray:
    """64-bit hash of each string; strings may overlap and are in order of their starts."""
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + SLICE)))
        a, b = starts[i], int(stops[i:j].max())
        out[i:j] = C._spans(C._BYTES[data[a:b]], starts[i:j] - a, stops[i:j] - a, which)
        i = j
    return out


def _joined(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same positions as disjoint spans in order; starts ascend."""
    if not len(starts):
        return starts, stops
    reach = np.maximum.accumulate(stops)
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > reach[:-1]
    return starts[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)]


def _packed_spans(starts: np.ndarray, stops: np.ndarray) -> bytes:
    a, b = C.pack_sorted(starts.astype(np.uint64)), C.pack((stops - starts).astype(np.uint64))
    return len(a).to_bytes(8, "little") + a + b


def _unpacked_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    cut = 8 + int.from_bytes(data[:8], "little")
    starts = C.unpack_sorted(data[8:cut]).astype(np.int64)
    return starts, starts + C.unpack(data[cut:]).astype(np.int64)


def _solve(shard: pa.Table, window: int, n_buckets: int) -> pa.Table:
    """Suffix-sort a shard's strings, some anchors at a time, and tell each block which of its windows begin earlier."""
    number = shard.column("parts").to_numpy()
    out = []
    own = shard.filter(pa.array(number == 0))
    for r in own.select(["block", "string"]).to_pylist():
        out.append((r["block"], *_unpacked_spans(r["string"])))
    rows = shard.filter(pa.array(number > 0))
    column = {k: rows.column(k).to_numpy() for k in ("anchor", "parts", "block", "at", "document", "tie", "hash", "hash2")}
    again = rows.column("again").to_numpy(zero_copy_only=False)
    text, offsets = _flat_binary(rows.column("string"))
    order = np.lexsort((column["at"], column["tie"], column["document"], column["hash2"], column["hash"], column["anchor"]))
    c = {k: v[order] for k, v in column.items()}
    size, start = np.diff(offsets)[order], offsets[:-1][order]
    new = np.ones(len(order), bool)
    new[1:] = (c["anchor"][1:] != c["anchor"][:-1]) | (c["hash"][1:] != c["hash"][:-1]) | (c["hash2"][1:] != c["hash2"][:-1])
    # Equal strings after the first: all their windows begin earlier.
    copies = np.flatnonzero(~new)
    blocks, starts, stops = [c["block"][copies]], [c["at"][copies]], [c["at"][copies] + size[copies] - window + 1]
    # Different strings of an anchor that has several, or whose string may repeat itself, or that was dealt to several shards.
    first = np.flatnonzero(new)
    _, group, members = np.unique(c["anchor"][first], return_inverse=True, return_counts=True)
    first = first[(members[group] > 1) | again[order][first] | (c["parts"][first] > 1)]
    windows = {k: [] for k in ("hash", "hash2", "document", "tie", "block", "at")}
    for batch in _batches(c["anchor"][first], size[first]):
        pick = first[batch]
        pick = pick[np.lexsort((c["at"][pick], c["tie"][pick], c["document"][pick]))]
        sizes = size[pick] + 1
        ends = np.cumsum(sizes) - 1
        data = np.full(int(sizes.sum()), STOP, np.uint8)
        inside = np.ones(len(data), bool)
        inside[ends] = False
        data[inside] = _gather(text, start[pick], size[pick])
        string = np.repeat(np.arange(len(pick)), sizes)
        fits, repeated = repeated_windows(data, ends[string], window)
        at = c["at"][pick] - (ends - size[pick])
        hit = np.flatnonzero(repeated)
        blocks.append(c["block"][pick][string[hit]])
        starts.append(hit + at[string[hit]])
        stops.append(hit + at[string[hit]] + 1)
        shared = np.flatnonzero(fits & ~repeated & (c["parts"][pick] > 1)[string])
        if len(shared):
            own_string = string[shared]
            for k, which in (("hash", 1), ("hash2", 2)):
                windows[k].append(_hash_strings(data, shared, shared + window, which))
            for k in ("document", "tie", "block"):
                windows[k].append(c[k][pick][own_string])
            windows["at"].append(shared + at[own_string])
    blocks, starts, stops = (np.concatenate(x) for x in (blocks, starts, stops))
    found = _found([*out, *_by_block(blocks, starts, stops)], windows, n_buckets)
    del text, column, c, rows, shard, blocks, starts, stops, windows, out
    C.give_back()
    return found


def _flat_binary(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    array = column.cast(pa.large_binary()).combine_chunks()
    array = pa.concat_arrays(array.chunks) if isinstance(array, pa.ChunkedArray) else array
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    return np.frombuffer(array.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _batches(anchor: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Whole anchors (in order) of up to SORTED_BYTES together."""
    if not len(anchor):
        return []
    begins = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1])
    sums = np.add.reduceat(size, begins)
    total, cuts = 0, []
    for i, x in enumerate(sums.tolist()):
        if total and total + x > SORTED_BYTES:
            cuts.append(begins[i])
            total = 0
        total += x
    return [np.arange(a, b) for a, b in zip([0, *cuts], [*cuts, len(anchor)], strict=True)]


def _by_block(blocks: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    order = np.lexsort((starts, blocks))
    blocks, starts, stops = blocks[order], starts[order], stops[order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(blocks)) + 1, [len(blocks)]]) if len(blocks) else []
    return [(int(blocks[a]), *_joined(starts[a:b], stops[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _found(spans: list[tuple[int, np.ndarray, np.ndarray]], windows: dict[str, list[np.ndarray]], n_buckets: int) -> pa.Table:
    none = dict.fromkeys(FOUND_ARROW.names)
    rows = [none | {"bucket": b % n_buckets, "block": b, "starts": _packed_spans(a, z)} for b, a, z in spans]
    if windows["hash"]:
        w = {k: np.concatenate(v) for k, v in windows.items()}
        order = np.argsort(w["hash"])
        w = {k: v[order].astype(np.uint64) for k, v in w.items()}
        for k, a, b in C.bucket_slices(w["hash"], 64, n_buckets):
            rows.append({"bucket": k, "block": None, "starts": C.pack(w["at"][a:b]), "stops": C.pack(w["block"][a:b]), "hash": C.pack_sorted(w["hash"][a:b]), **{x: C.pack(w[x][a:b]) for x in ("hash2", "document", "tie")}})
    return pa.Table.from_pylist(rows, schema=FOUND_ARROW)


def _meet(messages: pa.Table) -> pa.Table:
    """First windows of the parts of widely shared anchors meet here; spans pass through."""
    rows, parts = [], []
    for r in messages.to_pylist():
        (parts if r["block"] is None else rows).append(r)
    if parts:
        value = np.concatenate([C.unpack_sorted(r["hash"]) for r in parts])
        second, document, tie, block, at = (np.concatenate([C.unpack(r[k]) for r in parts]).astype(np.int64) for k in ("hash2", "document", "tie", "stops", "starts"))
        order = np.lexsort((at, tie, document, second, value))
        again = np.zeros(len(order), bool)
        again[1:] = (value[order][1:] == value[order][:-1]) & (second[order][1:] == second[order][:-1])
        hit = order[again]
        none = dict.fromkeys(FOUND_ARROW.names) | {"bucket": parts[0]["bucket"]}
        rows += [none | {"block": b, "starts": _packed_spans(x, y)} for b, x, y in _by_block(block[hit], at[hit], at[hit] + 1)]
    return pa.Table.from_pylist(rows, schema=FOUND_ARROW)


def _results(block: pa.Table, messages: pa.Table, window: int, carried: list[str]) -> pa.Table:
    block = C.ordered(block)
    data, offsets = C.flat_text(block.column("text"))
    edge = np.zeros(len(data) + 1, np.int32)
    for r in messages.to_pylist():
        starts, stops = _unpacked_spans(r["starts"])
        np.add.at(edge, starts, 1)
        np.add.at(edge, stops - 1 + window, -1)
    gone = np.cumsum(edge, dtype=np.int32)[: len(data)] > 0
    removed = np.concatenate([[0], np.cumsum(gone, dtype=np.int32)])
    raw, rows = data.tobytes(), []
    for doc_id, a, b in zip(block.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        n = int(removed[b] - removed[a])
        spans, kept, text = [], raw[a:b], raw[a:b]
        if n:
            mask = gone[a:b]
            change = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
            spans = [{"start": int(x), "length": int(y - x)} for x, y in zip(change[::2], change[1::2], strict=True)]
            kept = data[a:b][~mask].tobytes()
            # Whole characters only: one that lost a byte goes.
            first = np.flatnonzero((data[a:b] & 0xC0) != 0x80)
            cut = np.repeat(np.maximum.reduceat(mask, first), np.diff(np.append(first, b - a)))
            text = data[a:b][~cut].tobytes()
        rows.append((doc_id, b - a, n, len(spans), text.decode(), hashlib.sha256(kept).hexdigest(), spans))
    out = pa.Table.from_pylist([dict(zip(RESULT_ARROW.names, r, strict=True)) for r in rows], schema=RESULT_ARROW)
    for name in carried:
        out = out.append_column(name, block.column(name))
    return out


def remove_repeated_strings(docs: DataFrame, window: int = 100, anchor: int | None = None, part_runs: int = PART_RUNS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each document without the bytes of ``window``-byte strings that begin earlier elsewhere, and what was removed.

    docs: doc_id, text. A text is its UTF-8 bytes (null: none). Each byte in a string of ``window`` bytes that also begins
    earlier (smaller doc_id, or same document and earlier start) is removed; matches don't cross documents, and all strings are
    judged on the input. ``anchor`` is the length of the strings that match windows to shards (half the window if not given); an anchor of more than ``part_runs`` runs is dealt to several shards.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_text (without characters that lost a byte),
    kept_sha256 (of exactly the remaining bytes), spans. Texts shorter than the window stay as they are. Rows that share a doc_id
    are documents of their own, in the order of their texts; rows without an id come last. The columns named in ``keep`` follow; others
    are ignored. One document must fit into a task.
    """
    anchor = max(1, window // 2) if anchor is None else anchor
    if not 1 <= anchor <= window:
        raise ValueError("an anchor is no longer than the window")
    spark = docs.sparkSession
    C.small_batches(spark)
    carried = [f"keep_{i}" for i in range(len(keep))]
    source = docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(k) for c, k in zip(keep, carried, strict=True)))
    total = C.text_bytes(source)
    blocks, n = C.in_blocks(source, total, BLOCK_BYTES, *carried)
    result = StructType.fromDDL(RESULT)
    result = StructType([*result.fields, *(source.schema[k] for k in carried)])
    n_buckets, n_shards = C.buckets_for(spark, total, BUCKET_BYTES), C.buckets_for(spark, total, SHARD_BYTES)
    bits = C.filter_bits(total)

    def number(block: pa.Table) -> int:
        return block.column("block")[0].as_py()

    def lean(made: pa.Table) -> pa.Table:
        C.give_back()
        return made

    asked = blocks.groupBy("block").applyInArrow(lambda b: lean(_ask(_Runs(b, window, anchor), number(b), bits, n_buckets)), ASK).repartition(n_buckets, "bucket")
    answers = asked.groupBy("bucket").applyInArrow(lambda m: _answer(m, part_runs), ASK).repartition(n, "block")
    strings = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        lambda b, m: lean(_strings(_Runs(b, window, anchor), number(b), m, bits, n_buckets, window, n_shards)), STRING
    ).repartition(n_shards, "shard")
    found = strings.groupBy("shard").applyInArrow(lambda s: _solve(s, window, n_buckets), FOUND).repartition(n_buckets, "bucket")
    spans = found.groupBy("bucket").applyInArrow(_meet, FOUND).repartition(n, "block")
    return blocks.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(
        lambda b, m: lean(_results(b, m, window, carried)), result
    ).withColumnsRenamed(dict(zip(carried, keep, strict=True)))
