"""String similarity on a 0-100 scale, the one measure family Spark does not provide.

``ratio`` is the normalised indel similarity ``200 * LCS / (len a + len b)``; the token measures and the
partial measure are its published variants. ``levenshtein`` is a different number and is never used.

The measures come in three forms: for two texts (plain definitions), for arrays of pairs (``*_pairs``, wrapped as Arrow UDFs for joins
that already have their pairs) and as ``Block``, which scores one query against a whole block of candidates. The last two work on bit
vectors of any number of words, so long texts take the same way as short ones.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ship these functions with the task, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORD_BITS = 64
#: Cells of a table of pairs times positions, and pairs that are scored before the next best bound is looked at.
CELLS, SCORED = 1 << 21, 64
# Despaced names shorter than this are too generic for the whole-name and partial measures.
DESPACED_MINIMUM = 7


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence by bit-parallel addition (any length, Python integers)."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    state = full
    for ch in b:
        hit = state & masks.get(ch, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


def _scaled(common: int, total: int) -> float:
    return 200.0 * common / total if total else 100.0


def ratio(a: str, b: str) -> float:
    return _scaled(lcs_length(a, b), len(a) + len(b))


def _sorted_text(a: str) -> str:
    return " ".join(sorted(a.split()))


def token_sort(a: str, b: str) -> float:
    return ratio(_sorted_text(a), _sorted_text(b))


def token_set(a: str, b: str) -> float:
    """100 when one token set contains the other; else the best of three ratios around the shared tokens."""
    ta, tb = set(a.split()), set(b.split())
    if not ta or not tb:
        return 0.0
    shared, only_a, only_b = ta & tb, ta - tb, tb - ta
    if shared and (not only_a or not only_b):
        return 100.0
    base = " ".join(sorted(shared))
    with_a = " ".join(filter(None, [base, " ".join(sorted(only_a))]))
    with_b = " ".join(filter(None, [base, " ".join(sorted(only_b))]))
    best = ratio(with_a, with_b)
    if base:
        # The shared text is a prefix of both, so it is itself the common subsequence.
        best = max(best, _scaled(len(base), len(base) + len(with_a)), _scaled(len(base), len(base) + len(with_b)))
    return best


def _best_window(short: str, long: str) -> float:
    m, n = len(short), len(long)
    best = 0.0
    for end in range(1, n + m):
        window = long[max(0, end - m):min(end, n)]
        if m + len(window) and _scaled(min(m, len(window)), m + len(window)) > best:
            best = max(best, ratio(short, window))
    return best


def partial(a: str, b: str) -> float:
    """Best ratio of the shorter text against any window of the longer one, cut windows at the edges included."""
    if not a or not b:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    best = _best_window(a, b)
    return max(best, _best_window(b, a)) if len(a) == len(b) else best


def name_similarity(a: str, b: str) -> float:
    """Best of the token measures and, for names long enough, the measures without blanks."""
    best = max(token_sort(a, b), token_set(a, b))
    x, y = a.replace(" ", ""), b.replace(" ", "")
    if min(len(x), len(y)) >= DESPACED_MINIMUM:
        best = max(best, ratio(x, y), partial(x, y))
    return best


# --- arrays of pairs ---------------------------------------------------------------------------------------
class _Codes:
    """Texts as one array of code points."""

    def __init__(self, texts: list[str]):
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)

    def table(self, rows: np.ndarray, filler: int) -> np.ndarray:
        """One row of code points per text, filled up to the longest."""
        width = int(self.sizes[rows].max()) if len(rows) else 0
        at = self.starts[rows][:, None] + np.arange(width)
        inside = np.arange(width) < self.sizes[rows][:, None]
        return np.where(inside, self.flat[np.minimum(at, max(0, len(self.flat) - 1))] if len(self.flat) else 0, np.uint32(filler)).astype(np.uint32)


def _advance(state: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """One step of the bit-parallel subsequence: rows are pairs, columns the words of their bit vectors, the sum carries between words."""
    hit = state & mask
    total = state + hit
    if state.shape[1] > 1:
        carry = total < state
        for word in range(1, state.shape[1]):
            more = carry[:, word - 1].astype(np.uint64)
            total[:, word] += more
            carry[:, word] |= (more > 0) & (total[:, word] == 0)
    return total | (state & ~mask)


def _full(sizes: np.ndarray, words: int) -> np.ndarray:
    """The lowest bits of each vector, as many as its text has characters."""
    bits = np.clip(sizes[:, None] - WORD_BITS * np.arange(words), 0, WORD_BITS).astype(np.uint64)
    return np.where(bits == WORD_BITS, ~np.uint64(0), (np.uint64(1) << (bits & np.uint64(63))) - np.uint64(1))


def lcs_pairs(a: list[str], b: list[str]) -> np.ndarray:
    """Longest common subsequence of each pair."""
    out = np.zeros(len(a), np.int64)
    left, right = _Codes(a), _Codes(b)
    order = np.lexsort((right.sizes, left.sizes))
    order = order[(left.sizes[order] > 0) & (right.sizes[order] > 0)]
    start = 0
    while start < len(order):
        # Pairs of about one length together, few enough that their tables stay small.
        widest = max(1, int(left.sizes[order[start : start + 1]][0]))
        stop = min(len(order), start + max(1, CELLS // widest))
        while stop - start > 1 and int(left.sizes[order[stop - 1]]) > 2 * widest and (stop - start) * int(left.sizes[order[stop - 1]]) > CELLS:
            stop = start + (stop - start) // 2
        rows = order[start:stop]
        rows = rows[np.argsort(-right.sizes[rows], kind="stable")]
        x, y = left.table(rows, 0xFFFFFFFF), right.table(rows, 0xFFFFFFFE)
        words = -(-x.shape[1] // WORD_BITS)
        full = _full(left.sizes[rows], words)
        state = full.copy()
        for j in range(y.shape[1]):
            n = int(np.searchsorted(-right.sizes[rows], -j))  # pairs whose second text has a character here
            packed = np.zeros((n, words * 8), np.uint8)
            equal = np.packbits(x[:n] == y[:n, j : j + 1], axis=1, bitorder="little")
            packed[:, : equal.shape[1]] = equal
            state[:n] = _advance(state[:n], packed.view(np.uint64))
        out[rows] = left.sizes[rows] - np.bitwise_count(state & full).sum(axis=1, dtype=np.int64)
        start = stop
    return out


def ratio_pairs(a: list[str], b: list[str]) -> np.ndarray:
    sizes = np.fromiter(map(len, a), np.int64, len(a)) + np.fromiter(map(len, b), np.int64, len(b))
    return np.where(sizes > 0, 200.0 * lcs_pairs(a, b) / np.maximum(sizes, 1), 100.0)


def token_sort_pairs(a: list[str], b: list[str]) -> np.ndarray:
    return ratio_pairs([_sorted_text(x) for x in a], [_sorted_text(y) for y in b])


def token_set_pairs(a: list[str], b: list[str]) -> np.ndarray:
    out = np.zeros(len(a))
    open_pairs, with_a, with_b, bases = [], [], [], []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        tx, ty = set(x.split()), set(y.split())
        shared = tx & ty
        if not tx or not ty:
            continue
        if shared and (len(shared) == len(tx) or len(shared) == len(ty)):
            out[i] = 100.0
            continue
        base = " ".join(sorted(shared))
        open_pairs.append(i)
        bases.append(len(base))
        with_a.append(" ".join(filter(None, [base, " ".join(sorted(tx - ty))])))
        with_b.append(" ".join(filter(None, [base, " ".join(sorted(ty - tx))])))
    if open_pairs:
        base = np.array(bases)
        best = ratio_pairs(with_a, with_b)
        for side in (with_a, with_b):
            total = base + np.fromiter(map(len, side), np.int64, len(side))
            best = np.where(base > 0, np.maximum(best, 200.0 * base / np.maximum(total, 1)), best)
        out[open_pairs] = best
    return out


def partial_pairs(a: list[str], b: list[str], floor: np.ndarray | None = None) -> np.ndarray:
    """``partial`` of each pair; where it can't exceed ``floor``, the floor."""
    floor = np.zeros(len(a)) if floor is None else floor
    sizes = [np.fromiter(map(len, side), np.int64, len(side)) for side in (a, b)]
    common = lcs_pairs(a, b)
    reach = np.where(common > 0, 200.0 * common / np.maximum(np.minimum(*sizes) + common, 1), 0.0)
    out = np.array(floor, dtype=np.float64)
    pair, short, window = [], [], []

    def flush() -> None:
        if pair:
            np.maximum.at(out, pair, ratio_pairs(short, window))
            pair.clear(), short.clear(), window.clear()

    for i in np.flatnonzero(reach > floor).tolist():
        x, y = (a[i], b[i]) if sizes[0][i] <= sizes[1][i] else (b[i], a[i])
        for s, t in ((x, y), (y, x))[: 2 if len(x) == len(y) else 1]:
            m, n = len(s), len(t)
            for end in range(1, n + m):
                cut = t[max(0, end - m) : min(end, n)]
                if _scaled(min(m, len(cut)), m + len(cut)) > out[i]:
                    pair.append(i)
                    short.append(s)
                    window.append(cut)
        if len(pair) > CELLS // 256:
            flush()
    flush()
    return out


def name_similarity_pairs(a: list[str], b: list[str]) -> np.ndarray:
    best = np.maximum(token_sort_pairs(a, b), token_set_pairs(a, b))
    x, y = [t.replace(" ", "") for t in a], [t.replace(" ", "") for t in b]
    long = [i for i in range(len(a)) if min(len(x[i]), len(y[i])) >= DESPACED_MINIMUM]
    if long:
        x, y = [x[i] for i in long], [y[i] for i in long]
        best[long] = partial_pairs(x, y, np.maximum(best[long], ratio_pairs(x, y)))
    return best


def _pairwise(scorer):
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        known = (a.notna() & b.notna()).to_numpy()
        out = np.full(len(a), np.nan)
        out[known] = scorer(a[known].tolist(), b[known].tolist())
        return pd.Series(out).astype("Float64") if not known.all() else pd.Series(out)

    score.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(score, T.DoubleType())


ratio_udf = _pairwise(ratio_pairs)
token_sort_udf = _pairwise(token_sort_pairs)
token_set_udf = _pairwise(token_set_pairs)
name_similarity_udf = _pairwise(name_similarity_pairs)


# --- one query against a block --------------------------------------------------------------------------------
class _Matrix:
    """Candidate texts position by position, so one query meets all of them in a few vector operations."""

    def __init__(self, texts: list[str]):
        codes = _Codes(texts)
        self.lengths = codes.sizes
        self.alphabet, flat = np.unique(codes.flat, return_inverse=True)
        self.order = np.argsort(-self.lengths, kind="stable")
        sizes, starts = self.lengths[self.order], codes.starts[self.order]
        longest = int(sizes[0]) if len(sizes) else 0
        reach = np.searchsorted(-sizes, -np.arange(longest))
        self.columns = [flat[starts[:n] + j].astype(np.int32) for j, n in enumerate(reach.tolist())]

    def lcs(self, query: str) -> np.ndarray:
        out = np.zeros(len(self.lengths), dtype=np.int64)
        if not query or not self.columns:
            return out
        words = -(-len(query) // WORD_BITS)
        masks = np.zeros((len(self.alphabet), words), dtype=np.uint64)
        asked = np.frombuffer(query.encode("utf-32-le", "surrogatepass"), np.uint32)
        code = np.minimum(np.searchsorted(self.alphabet, asked), len(self.alphabet) - 1)
        for i in np.flatnonzero(self.alphabet[code] == asked).tolist():
            masks[code[i], i // WORD_BITS] |= np.uint64(1 << (i % WORD_BITS))
        full = _full(np.array([len(query)]), words)
        state = np.repeat(full, len(self.lengths), axis=0)
        for column in self.columns:
            state[: len(column)] = _advance(state[: len(column)], masks[column])
        out[self.order] = len(query) - np.bitwise_count(state & full).sum(axis=1, dtype=np.int64)
        return out


class Block:
    """A block of distinct candidate texts that can be scored as a whole."""

    scorer = staticmethod(token_sort_pairs)

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.sorted = _Matrix([_sorted_text(t) for t in texts])

    def bounds(self, query: str) -> np.ndarray:
        """An upper bound of the score per candidate (here it is the score itself)."""
        text = _sorted_text(query)
        total = self.sorted.lengths + len(text)
        return np.where(total > 0, 200.0 * self.sorted.lcs(text) / np.maximum(total, 1), 100.0)

    def score(self, query: str, which: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return bounds[which]

    def best(self, query: str, cutoff: float, order: list) -> tuple[int, float] | None:
        """Index and score of the best candidate at or above ``cutoff``; ties go to the smaller order."""
        bounds = self.bounds(query)
        possible = np.flatnonzero(bounds >= cutoff)
        possible = possible[np.argsort(-bounds[possible], kind="stable")]
        found, start = None, 0
        while start < len(possible) and not (found and bounds[possible[start]] < found[1]):
            some = possible[start : start + SCORED]
            scores = self.score(query, some, bounds)
            for index, score in zip(some.tolist(), scores.tolist(), strict=True):
                if score >= cutoff and (found is None or score > found[1] or (score == found[1] and order[index] < order[found[0]])):
                    found = (index, score)
            start += SCORED
        return found

    def all(self, query: str, cutoff: float) -> list[tuple[int, float]]:
        """Every candidate at or above ``cutoff``."""
        bounds = self.bounds(query)
        possible = np.flatnonzero(bounds >= cutoff)
        scores = self.score(query, possible, bounds)
        return [(int(i), float(x)) for i, x in zip(possible, scores, strict=True) if x >= cutoff]


class NameBlock(Block):
    """Block for ``name_similarity``: exact for sorted tokens, bounds for the set measure and for the measures without blanks."""

    def __init__(self, texts: list[str]):
        super().__init__(texts)
        self.despaced = _Matrix([t.replace(" ", "") for t in texts])
        tokens = [sorted(set(t.split())) for t in texts]
        self.distinct = [" ".join(t) for t in tokens]
        self.distinct_lengths = np.fromiter(map(len, self.distinct), np.int64, len(texts))
        self.repeats = np.array([len(d) < len(t) for d, t in zip(self.distinct, texts, strict=True)], bool)
        self.holders: dict[str, list[int]] = {}
        for index, of in enumerate(tokens):
            for token in of:
                self.holders.setdefault(token, []).append(index)
        codes = _Codes(self.distinct)
        self.letters, which = np.unique(codes.flat, return_inverse=True)
        owner = np.repeat(np.arange(len(texts)), codes.sizes)
        #: How often each candidate has each character, for the most common characters; the rest are one column.
        self.kept = min(len(self.letters), 63)
        common = np.argsort(-np.bincount(which, minlength=len(self.letters)), kind="stable")[: self.kept]
        column = np.full(len(self.letters), self.kept)
        column[common] = np.arange(self.kept)
        self.column = column
        self.counts = np.bincount(owner * (self.kept + 1) + column[which], minlength=len(texts) * (self.kept + 1)).reshape(len(texts), -1)

    def score(self, query: str, which: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return name_similarity_pairs([query] * len(which), [self.texts[i] for i in which])

    def _set_bounds(self, query: str, which: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Bound of the set measure: characters in common at most, or the shared text against either side."""
        distinct = " ".join(sorted(set(query.split())))
        asked = np.frombuffer(distinct.encode("utf-32-le", "surrogatepass"), np.uint32)
        place = np.minimum(np.searchsorted(self.letters, asked), max(0, len(self.letters) - 1))
        known = self.letters[place] == asked if len(self.letters) else np.zeros(len(asked), bool)
        mine = np.bincount(self.column[place[known]], minlength=self.kept + 1)
        common = np.minimum(self.counts[which], mine).sum(axis=1)
        theirs, own = self.distinct_lengths[which], len(distinct)
        best = 200.0 * common / np.maximum(theirs + own, 1)
        for size in (theirs, own):
            best = np.maximum(best, 200.0 * base / np.maximum(base + size, 1))
        return np.where((base > 0) & ((base == theirs) | (base == own)), 100.0, best)

    def bounds(self, query: str) -> np.ndarray:
        bounds = super().bounds(query)
        tokens = set(query.split())
        base = np.zeros(len(self.texts), np.int64)
        for token in tokens:
            base[self.holders.get(token, [])] += len(token) + 1
        # Without shared or repeated tokens the set measure is that of the sorted tokens.
        repeated = len(" ".join(tokens)) < len(query)
        special = np.flatnonzero((base > 0) | self.repeats | repeated)
        if len(special):
            bounds[special] = np.maximum(bounds[special], self._set_bounds(query, special, np.maximum(base[special] - 1, 0)))
        plain = query.replace(" ", "")
        if len(plain) >= DESPACED_MINIMUM:
            common = self.despaced.lcs(plain)
            shorter = np.minimum(self.despaced.lengths, len(plain))
            # A window of length w holds at most ``common`` matches: best case w = common.
            window = np.where(common > 0, 200.0 * common / np.maximum(shorter + common, 1), 0.0)
            whole = 200.0 * common / np.maximum(self.despaced.lengths + len(plain), 1)
            bounds = np.where(self.despaced.lengths >= DESPACED_MINIMUM, np.maximum(bounds, np.maximum(window, whole)), bounds)
        return bounds


BLOCKS = {"token_sort": Block, "name_similarity": NameBlock}
