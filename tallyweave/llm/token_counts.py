"""Token counts by byte-pair merging with a heap and a linked list; no token ids are made.

A pre-token's bytes are a doubly linked list of symbols, its adjacent pairs a heap by rank. The lowest pair that is still there is
merged, its neighbours' new pairs are pushed, until no pair has a rank. The count is the number of bytes minus the merges.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tallyweave.llm import common as C

COUNT = "doc_id long, n_bytes long, n_tokens long"
CACHED, CACHED_CHARS = 300_000, 64
#: Bytes from which a pre-token's symbols are kept in arrays.
LONG = 4096
#: A space inside white space, where white space may belong to one pre-token across the space.
_WIDE = re.compile(r"\s (?:\s|$)")
_COUNTERS: dict[str, Counter] = {}


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself where it has one, else from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(other)}


class Counter:
    """Counts the tokens that a byte-level BPE file of the public tokenizers gives."""

    def __init__(self, name: str) -> None:
        with open(public_tokenizers.path(name), encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocabulary = model["vocab"]
        self.first = [vocabulary[c] for _, c in sorted(byte_symbols().items())]
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks[vocabulary[left], vocabulary[right]] = (rank, vocabulary[left + right])
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.special_pattern = re.compile("|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.pair_of: dict[int, tuple[int, int, int]] | None = None
        self.starts: dict[str, int] = {}
        self.spaced: dict[str, int] = {}

    def merged(self, token: bytes) -> int:
        """Number of tokens of one pre-token."""
        n = len(token)
        if n < 2:
            return n
        if n > LONG:
            return self._merged_long(token)
        first, ranks = self.first, self.ranks
        symbol = [first[b] for b in token]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            found = ranks.get((symbol[i], symbol[i + 1]))
            if found is not None:
                heap.append((found[0], i, symbol[i], symbol[i + 1], found[1]))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, left, right, new = heapq.heappop(heap)
            j = after[i]
            # The pair is gone if either side was merged meanwhile.
            if symbol[i] != left or j >= n or symbol[j] != right:
                continue
            merges += 1
            symbol[i], symbol[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = ranks.get((new, symbol[k]))
                if found is not None:
                    heapq.heappush(heap, (found[0], i, new, symbol[k], found[1]))
            h = before[i]
            if h >= 0:
                found = ranks.get((symbol[h], new))
                if found is not None:
                    heapq.heappush(heap, (found[0], h, symbol[h], new, found[1]))
        return n - merges

    def _merged_long(self, token: bytes) -> int:
        """The same merges in the same order, for a pre-token of any length: symbols and links are arrays of 32 bits, and the heap
        holds ranks, each with its positions: an array in order for the first pairs, a heap for those that merges make."""
        n, ranks = len(token), self.ranks
        symbol = np.array(self.first, np.int32)[np.frombuffer(token, np.uint8)]
        pairs, which = np.unique(symbol[:-1].astype(np.int64) << 32 | symbol[1:], return_inverse=True)
        found = [ranks.get((int(p) >> 32, int(p) & 0xFFFFFFFF)) for p in pairs.tolist()]
        order = np.argsort(which, kind="stable").astype(np.int32)
        edges = np.searchsorted(which[order], np.arange(len(pairs) + 1))
        first = {f[0]: array("i", order[a:b].tobytes()) for f, a, b in zip(found, edges[:-1].tolist(), edges[1:].tolist(), strict=True) if f is not None}
        del which, order
        pair_of = {f[0]: (left, right, f[1]) for (left, right), f in ranks.items()} if self.pair_of is None else self.pair_of
        self.pair_of = pair_of
        symbols, after, before = array("i", symbol.tobytes()), array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        at, more, heap, merges = dict.fromkeys(first, 0), {}, list(first), 0
        heapq.heapify(heap)
        while heap:
            rank = heap[0]
            ready, made, k = first.get(rank, ()), more.get(rank, ()), at.get(rank, 0)
            if k < len(ready) and (not made or ready[k] <= made[0]):
                i = ready[k]
                at[rank] = k + 1
            elif made:
                i = heapq.heappop(made)
            else:
                heapq.heappop(heap)
                first.pop(rank, None)
                more.pop(rank, None)
                continue
            left, right, new = pair_of[rank]
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue
            merges += 1
            symbols[i], symbols[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
            for a, b in ((i, k), (before[i], i)):
                pair = ranks.get((symbols[a], symbols[b])) if a >= 0 and b < n else None
                if pair is not None:
                    if pair[0] not in more:
                        more[pair[0]] = []
                        if pair[0] not in first:
                            heapq.heappush(heap, pair[0])
                    heapq.heappush(more[pair[0]], a)
        return n - merges

    def _chunk(self, text: str) -> int:
        return sum(self.merged(p.encode()) for p in self.pattern.findall(text))

    def _plain(self, text: str) -> int:
        """Count of a text without special strings. Unless white space surrounds it, a space always begins a pre-token, so the
        text is cut before spaces and each part counted once per worker."""
        if _WIDE.search(text):
            return self._chunk(text)
        first, *rest = text.split(" ")
        starts, spaced = self.starts, self.spaced
        if first not in starts:
            if len(first) > CACHED_CHARS:
                return self._chunk(first) + self._rest(rest)
            starts[first] = self._chunk(first)
        return starts[first] + self._rest(rest)

    def _rest(self, rest: list[str]) -> int:
        spaced = self.spaced
        try:
            return sum(map(spaced.__getitem__, rest))
        except KeyError:
            pass
        total = 0
        for w in rest:
            n = spaced.get(w)
            if n is None:
                n = self._chunk(" " + w)
                if len(w) <= CACHED_CHARS:
                    spaced[w] = n
            total += n
        return total

    def count(self, text: str) -> int:
        if len(self.spaced) > CACHED or len(self.starts) > CACHED:
            self.spaced.clear()
            self.starts.clear()
        if self.special_pattern is None or not any(x in text for x in self.special):
            return self._plain(text)
        return sum(map(self._plain, self.special_pattern.split(text))) + len(self.special_pattern.findall(text))


def counter(name: str) -> Counter:
    if name not in _COUNTERS:
        _COUNTERS[name] = Counter(name)
    return _COUNTERS[name]


def count_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens of each whole text, as the tokenizers library counts them without adding special tokens.

    docs: doc_id, text (null: empty, no tokens). A special string inside a text is one token. Every row has a result of its own,
    so repeated rows repeat. Further columns are ignored.
    """

    def run(batches):
        for batch in C.small(batches):
            of = counter(tokenizer).count
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            counts = [of(t.decode(errors="replace")) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, COUNT)
