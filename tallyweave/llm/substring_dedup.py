"""Removal of word windows that occur earlier, by level-wise doubling.

A window of ``window`` words can only be repeated if both of its halves are. So windows of a short length are compared first
(20 words: 5, then 10, then 20); only those that are repeated alone are extended to twice the length, until the asked length is
reached or no candidates survive. At each length a block of documents sends the distinct hashes of its candidates to buckets of
hash values; a bucket answers with one bit for each. Short lengths send shortened hashes, which can only let too many through;
the last length sends 128 bits and the first document that has the window. Its two hashes are made from the bytes of the words with
different bases, and both decide within a block as well as between blocks.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyweave.llm import common as C

SHORTEST = 5
BLOCK_BYTES = 6 << 20
BUCKET_BYTES = 24 << 20
MESSAGE = "block long, bucket long, level int, payload binary, second binary, document binary, tie binary"
ARROW = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("level", pa.int32()), ("payload", pa.binary()), ("second", pa.binary()), ("document", pa.binary()), ("tie", pa.binary())])
RESULT = "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string, spans array<struct<start:long,length:long>>"
RESULT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))])
#: Level of a message from a block to itself: which positions were candidates.
OWN = -1


def doubling_lengths(window: int, shortest: int = SHORTEST) -> list[int]:
    """From a short length to ``window``, each at most twice the one before (an odd length takes overlapping halves)."""
    if window < 1:
        raise ValueError("a window has at least one word")
    lengths = [window]
    while lengths[0] > shortest:
        lengths.insert(0, -(-lengths[0] // 2))
    return lengths


class _Words:
    """The words of a block's documents, in the order of documents."""

    def __init__(self, block: pa.Table) -> None:
        self.block = C.ordered(block)
        self.data, offsets = C.flat_text(self.block.column("text"))
        self.starts, self.ends, self.first = C.space_words(self.data, offsets)
        self.hashes = C.mixed(C.hash_words(self.data, self.starts, self.ends))
        self.document = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        self.second: np.ndarray | None = None

    def fitting(self, length: int) -> np.ndarray:
        """Whether ``length`` words from each word on lie in one document."""
        return np.arange(len(self.hashes)) + length <= self.first[1:][self.document]


def _distinct(words: _Words, candidates: np.ndarray, length: int, bits: int, last: bool) -> tuple[np.ndarray, ...]:
    """Sorted distinct hashes of the candidates, the number of each, which one a candidate has, its first candidate, and its second hash."""
    at = np.flatnonzero(candidates)
    hashes = C.shorten(C.hash_windows(words.hashes, at, length), bits)
    if not last:
        return *(x for x in _unique(hashes, at, None)), None
    words.second = C.mixed(C.hash_words(words.data, words.starts, words.ends, 2)) if words.second is None else words.second
    second = C.hash_windows(words.second, at, length, 2)
    values, counts, which, first = _unique(hashes, at, second)
    return values, counts, which, first, second[first]


def _unique(hashes: np.ndarray, at: np.ndarray, second: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order (pairs, if there is a second hash), their counts, which one each position has, and the first position of each."""
    order = np.argsort(hashes, kind="stable") if second is None else np.lexsort((at, second, hashes))
    new = np.ones(len(order), bool)
    new[1:] = hashes[order][1:] != hashes[order][:-1]
    if second is not None:
        new[1:] |= second[order][1:] != second[order][:-1]
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    first = order[new]
    return hashes[first], np.diff(np.append(np.flatnonzero(new), len(order))), which, first


def _ask(words: _Words, block: int, candidates: np.ndarray, length: int, bits: int, n_buckets: int, last: bool) -> pa.Table:
    values, counts, which, first, second = _distinct(words, candidates, length, bits, last)
    document = tie = None
    if last:
        at = np.flatnonzero(candidates)[first]
        document = C.order_ids(words.block)[words.document[at]]
        tie = np.where(document == C.NO_ID, block, 0)
    rows = []
    for bucket, a, b in C.bucket_slices(values, bits, n_buckets):
        more = (C.pack(second[a:b]), C.pack(document[a:b].view(np.uint64)), C.pack(tie[a:b])) if last else (C.pack_bits(counts[a:b] > 1), None, None)
        rows.append((block, bucket, length, C.pack_sorted(values[a:b]), *more))
    rows.append((block, block % n_buckets, OWN, C.pack_bits(candidates), None, None, None))
    return pa.Table.from_pylist([dict(zip(ARROW.names, r, strict=True)) for r in rows], schema=ARROW)


def _answer(messages: pa.Table) -> pa.Table:
    """For each block that asked: a bit for each of its hashes, whether it occurs again (or earlier, at the last length)."""
    rows, asked = [], []
    for r in messages.to_pylist():
        (rows if r["level"] == OWN else asked).append(r)
    if asked:
        lists = [C.unpack_sorted(r["payload"]) for r in asked]
        values, sizes = np.concatenate(lists), [len(x) for x in lists]
        asker = np.repeat(np.arange(len(lists)), sizes)
        if asked[0]["document"] is None:
            again = np.concatenate([C.unpack_bits(r["second"], n) for r, n in zip(asked, sizes, strict=True)])
            _, which, counts = np.unique(values, return_inverse=True, return_counts=True)
            bits = (counts[which] > 1) | (np.bincount(which, again)[which] > 0)
        else:
            second, document, tie = (np.concatenate([C.unpack(r[k]) for r in asked]).view(kind) for k, kind in (("second", np.uint64), ("document", np.int64), ("tie", np.int64)))
            order = np.lexsort((tie, document, second, values))
            new = np.ones(len(order), bool)
            new[1:] = (values[order][1:] != values[order][:-1]) | (second[order][1:] != second[order][:-1])
            bits = np.empty(len(order), bool)
            bits[order] = ~new
        for i, r in enumerate(asked):
            rows.append({**r, "payload": C.pack_bits(bits[asker == i]), "second": None, "document": None, "tie": None})
    return pa.Table.from_pylist(rows, schema=ARROW)


def _answered(words: _Words, messages: pa.Table, length: int, bits: int, n_buckets: int, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the candidates of ``length``; of each, the answer to its window, and whether it is the window's first here."""
    mine, answers = np.zeros(len(words.hashes), bool), {}
    for r in messages.to_pylist():
        if r["level"] == OWN:
            mine = C.unpack_bits(r["payload"], len(words.hashes))
        else:
            answers[r["bucket"]] = r["payload"]
    values, _, which, first, _ = _distinct(words, mine, length, bits, last)
    said = np.zeros(len(values), bool)
    for bucket, a, b in C.bucket_slices(values, bits, n_buckets):
        said[a:b] = C.unpack_bits(answers[bucket], b - a)
    at = np.flatnonzero(mine)
    return at, said[which], np.arange(len(at)) == first[which]


def _extended(words: _Words, at: np.ndarray, repeated: np.ndarray, shorter: int, length: int) -> np.ndarray:
    """Windows of ``length`` of which both halves, of the shorter length, are repeated."""
    half = np.zeros(len(words.hashes) + length, bool)
    half[at[repeated]] = True
    n = len(words.hashes)
    return words.fitting(length) & half[:n] & half[length - shorter : n + length - shorter]


def _covered(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    edge = np.zeros(n + length + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + length, -1)
    return np.cumsum(edge)[:n] > 0


def _results(words: _Words, removed: np.ndarray) -> pa.Table:
    rows = []
    ids = words.block.column("doc_id").to_pylist()
    data, starts, ends = words.data.tobytes(), words.starts, words.ends
    for i, doc_id in enumerate(ids):
        a, b = int(words.first[i]), int(words.first[i + 1])
        gone = removed[a:b]
        kept = b" ".join([data[s:e] for s, e in zip(starts[a:b][~gone].tolist(), ends[a:b][~gone].tolist(), strict=True)])
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
        spans = [{"start": int(s), "length": int(e - s)} for s, e in zip(edge[::2], edge[1::2], strict=True)]
        rows.append((doc_id, b - a, int(gone.sum()), kept.decode(), hashlib.sha256(kept).hexdigest(), spans))
    return pa.Table.from_pylist([dict(zip(RESULT_ARROW.names, r, strict=True)) for r in rows], schema=RESULT_ARROW)


def remove_repeated_windows(docs: DataFrame, window: int = 20, shortest: int = SHORTEST) -> DataFrame:
    """Each document without the words of windows that start earlier elsewhere, and what was removed.

    docs: doc_id, text. Words are runs of characters other than space and \\x09-\\x0D, unchanged. A window is ``window``
    consecutive words of one document; each word in a window whose word sequence also starts earlier (smaller doc_id, or same
    document and earlier start) is removed. All windows are judged on the input.

    Returns doc_id, n_words, n_removed, kept_text (kept words joined by one space), kept_sha256, spans (runs of removed words).
    A null or empty text has no words. Rows that share a doc_id are documents of their own, in the order of their texts;
    rows without an id come last. Further columns are ignored. One document's words must fit into a task.
    """
    spark = docs.sparkSession
    source = C.plain(docs, "doc_id", "text")
    total = C.text_bytes(source)
    blocks, n = C.in_blocks(source, total, BLOCK_BYTES)
    n_buckets = C.buckets_for(spark, total, BUCKET_BYTES)
    lengths = doubling_lengths(window, shortest)
    widths = [C.filter_bits(total)] * (len(lengths) - 1) + [64]

    def begin(block: pa.Table) -> pa.Table:
        words = _Words(block)
        return _ask(words, block.column("block")[0].as_py(), words.fitting(lengths[0]), lengths[0], widths[0], n_buckets, len(lengths) == 1)

    def extend(k: int):
        def run(block: pa.Table, messages: pa.Table) -> pa.Table:
            words = _Words(block)
            at, repeated, _ = _answered(words, messages, lengths[k - 1], widths[k - 1], n_buckets, False)
            candidates = _extended(words, at, repeated, lengths[k - 1], lengths[k])
            return _ask(words, block.column("block")[0].as_py(), candidates, lengths[k], widths[k], n_buckets, k == len(lengths) - 1)

        return run

    def finish(block: pa.Table, messages: pa.Table) -> pa.Table:
        words = _Words(block)
        at, elsewhere, first = _answered(words, messages, lengths[-1], widths[-1], n_buckets, True)
        return _results(words, _covered(len(words.hashes), at[elsewhere | ~first], lengths[-1]))

    asked = blocks.groupBy("block").applyInArrow(begin, MESSAGE)
    for k in range(1, len(lengths) + 1):
        answers = asked.repartition(n_buckets, "bucket").groupBy("bucket").applyInArrow(_answer, MESSAGE).repartition(n, "block")
        pair = blocks.groupBy("block").cogroup(answers.groupBy("block"))
        asked = pair.applyInArrow(extend(k), MESSAGE) if k < len(lengths) else pair.applyInArrow(finish, RESULT)
    return asked
