"""Benchmark decontamination with an Aho-Corasick automaton over normalised benchmark windows.

Texts and items are lower-cased in A-Z, and every run of other bytes than letters, digits and non-ASCII becomes one blank. All
windows of the items, with blanks around them, are the patterns of one automaton; a text is scanned once, and matches are mapped
back to its words and to byte offsets in the original. A benchmark of up to ``SLICE_BYTES`` is one automaton, whose text is broadcast. A larger
one is cut into slices of that size: blocks of documents and slices are dealt to tasks pair by pair, each of which builds one slice's
automaton, and the hits of a document's slices meet again. Neither the driver nor any task holds more than a slice.
"""

from __future__ import annotations

import hashlib
import math
import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyweave.llm import common as C

#: Bytes of benchmark text in one automaton.
SLICE_BYTES = 4 << 20
#: Bytes of documents that meet one slice in a task.
SCAN_BYTES = 32 << 20
HITS = "row long, spans array<struct<start:long,stop:long>>, items array<string>"
HITS_ARROW = pa.schema([("row", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("items", pa.list_(pa.string()))])
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, spans array<struct<start:long,length:long>>"
SPAN = pa.struct([("start", pa.int64()), ("length", pa.int64())])
RESULT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items", pa.list_(pa.string())), ("items_sha256", pa.string()), ("spans", pa.list_(SPAN))])
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_BUILT: dict[str, ahocorasick.Automaton] = {}


def normal(text: bytes) -> list[bytes]:
    """Words of a text in normal form."""
    return text.translate(_TABLE).split()


def windows(words: list[bytes], width: int) -> list[bytes]:
    """Runs of ``width`` words; all words if there are fewer, none if there are none."""
    if not words:
        return []
    return [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]


def _automaton(items: list[tuple[str, bytes]], width: int) -> ahocorasick.Automaton | None:
    patterns: dict[bytes, set[str]] = {}
    for item, text in items:
        for w in windows(normal(text), width):
            patterns.setdefault(w, set()).add(item)
    if not patterns:
        return None
    built = ahocorasick.Automaton()
    for w, of in patterns.items():
        built.add_word(f" {w.decode('latin-1')} ", (w.count(b" ") + 1, tuple(of)))
    built.make_automaton()
    return built


def _scan(texts: list[bytes], hits: list[tuple[list[tuple[int, int]], set[str]]], automaton: ahocorasick.Automaton) -> None:
    for text, (spans, found) in zip(texts, hits, strict=True):
        flat = b" " + b" ".join(normal(text)) + b" "
        blanks = None
        for end, (n, items) in automaton.iter(flat.decode("latin-1")):
            if blanks is None:
                blanks = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
            last = int(np.searchsorted(blanks, end))
            spans.append((last - n, last))
            found.update(items)


def _byte_words(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins and ends in the original."""
    mask = np.frombuffer(text.translate(_TABLE), np.uint8) != 32
    change = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def find_benchmark_text(docs: DataFrame, benchmark: DataFrame, width: int = 10, slice_bytes: int = SLICE_BYTES, keep: tuple[str, ...] = ()) -> DataFrame:
    """Which words of each document lie inside an occurrence of a benchmark window, and of which items.

    docs: doc_id, text; benchmark: item_id, text. A window is ``width`` consecutive words of an item; an item of fewer words is one
    window, one without words is none. A word inside any occurrence of a window is hit.

    Returns doc_id, n_words, n_hit, n_items, items (ids as strings, sorted), items_sha256 (of the ids joined by commas), spans (byte
    runs of the original text from the first to the last hit word of a run). Null texts have no words; items without an id take no part. Every row has a
    result of its own, so repeated rows repeat. The columns named in ``keep`` follow; others are ignored.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    n_slices = max(1, math.ceil(C.text_bytes(items) / slice_bytes))
    carried = [f"keep_{i}" for i in range(len(keep))]
    source = docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(k) for c, k in zip(keep, carried, strict=True)))
    result = StructType([*StructType.fromDDL(RESULT).fields, *(source.schema[k] for k in carried)])
    found = _by_one_automaton(source, items, width, result, carried) if n_slices == 1 else _by_slices(source, items, width, n_slices, result, carried)
    return found.withColumnsRenamed(dict(zip(carried, keep, strict=True)))


def _result(held: pa.Table, texts: list[bytes], hits: list[tuple[list[tuple[int, int]], set[str]]], carried: list[str]) -> pa.Table:
    rows = []
    for doc_id, text, (spans, found) in zip(held.column("doc_id").to_pylist(), texts, hits, strict=True):
        n_words, n_hit, runs = len(normal(text)), 0, []
        if spans:
            edge = np.zeros(n_words + 1, np.int64)
            for a, b in spans:
                edge[a] += 1
                edge[b] -= 1
            hit = np.cumsum(edge)[:-1] > 0
            n_hit = int(hit.sum())
            begin, end = _byte_words(text)
            change = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
            runs = [{"start": int(begin[a]), "length": int(end[b - 1] - begin[a])} for a, b in zip(change[::2], change[1::2], strict=True)]
        names = sorted(found)
        rows.append((doc_id, n_words, n_hit, len(names), names, hashlib.sha256(",".join(names).encode()).hexdigest(), runs))
    out = pa.Table.from_pylist([dict(zip(RESULT_ARROW.names, r, strict=True)) for r in rows], schema=RESULT_ARROW)
    for name in carried:
        out = out.append_column(name, held.column(name))
    return out


def _texts(table: pa.Table | pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in table.column("text").cast(pa.binary()).to_pylist()]


def _by_one_automaton(source: DataFrame, items: DataFrame, width: int, result: StructType, carried: list[str]) -> DataFrame:
    # At most SLICE_BYTES of text: the caller has checked it.
    rows = items.select("item", F.col("text").cast("binary").alias("text")).collect()
    name, sent = uuid.uuid4().hex, source.sparkSession.sparkContext.broadcast([(r["item"], bytes(r["text"])) for r in rows])

    def run(batches):
        if name not in _BUILT:
            _BUILT.clear()
            _BUILT[name] = _automaton(sent.value, width)
        for batch in C.small(batches):
            texts = _texts(batch)
            hits = [([], set()) for _ in texts]
            if _BUILT[name] is not None:
                _scan(texts, hits, _BUILT[name])
            yield from _result(pa.Table.from_batches([batch]), texts, hits, carried).to_batches()

    return source.mapInArrow(C.giving_back(run), result)


def _by_slices(source: DataFrame, items: DataFrame, width: int, n_slices: int, result: StructType, carried: list[str]) -> DataFrame:
    source = C.stored(source.withColumn("row", F.monotonically_increasing_id()), "benchmark-texts")
    n_blocks = max(1, math.ceil(C.text_bytes(source) / SCAN_BYTES))

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    texts = source.select("row", "text", F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int").alias("block"), every(n_slices).alias("slice"))
    slices = items.select("item", "text", F.pmod(F.xxhash64("item", "text"), F.lit(n_slices)).cast("int").alias("slice"), every(n_blocks).alias("block"))

    def scan(docs: pa.Table, of: pa.Table) -> pa.Table:
        pairs = list(zip(of.column("item").to_pylist(), _texts(of), strict=True))
        automaton = _automaton(pairs, width) if docs.num_rows else None
        rows = []
        for batch in C.small(docs.to_batches()) if automaton is not None else ():
            batch_texts = _texts(batch)
            hits = [([], set()) for _ in batch_texts]
            _scan(batch_texts, hits, automaton)
            rows += [
                {"row": row, "spans": [{"start": a, "stop": b} for a, b in spans], "items": sorted(found)}
                for row, (spans, found) in zip(batch.column("row").to_pylist(), hits, strict=True) if spans
            ]
        return pa.Table.from_pylist(rows, schema=HITS_ARROW)

    cell = ("block", "slice")
    hits = texts.groupBy(*cell).cogroup(slices.groupBy(*cell)).applyInArrow(scan, HITS)
    # One row of a document from each slice that has windows in it.
    merged = hits.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))

    def run(batches):
        for batch in C.small(batches):
            found = [([(s["start"], s["stop"]) for s in spans or []], set(items or [])) for spans, items in zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True)]
            yield from _result(pa.Table.from_batches([batch]), _texts(batch), found, carried).to_batches()

    return source.join(merged, "row", "left").drop("row").mapInArrow(C.giving_back(run), result)
