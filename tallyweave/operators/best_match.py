"""Exact similarity search between two sets of texts, without a cross join.

*Texts and sorted tokens* (``ratio``, ``token_sort``). Texts meet by keys. The score is a share of common characters, so two texts that reach the cutoff have
a known number of characters in common; with characters in one global order, the rarest first, they share two among the first few of
each. A text is sent once per pair of these first characters, however many texts the other side has. Very short and very long texts
use single characters, which are few for the former and telling for the latter. A key that many texts have is cut into rows and columns.
Where the texts are so alike that keys rule little out (names of one language with a few legal forms), meetings would outnumber the pairs.
Then a grid of cells takes them: bit sets of characters bound the score of a pair in a few machine words, and only what is left is scored.

*Sets of tokens* (``token_set``). Besides such keys of the distinct tokens, which two texts share unless one is nearly contained in the
other, a text is sent with its longest tokens, as many as leave less than a contained text must share, to meet all tokens of the others.

*Names* (``name_similarity``). The partial measure lets a short name match anywhere in a long one, which leaves no key that both must
share. The comparison space is a grid: queries are hashed into row blocks, candidates into column blocks, and every cell is one bounded
task that compares its block with vectorised bounds and emits only the winners.

Block sizes are fixed and their number follows from row counts (as scalar subqueries), so no candidate is ever dropped. Both sides must be
distinct: callers pass distinct names, not the rows that carry them.
"""

from __future__ import annotations

import hashlib
import math
import sys
from collections import Counter

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.functions import similarity
from tallyweave.operators.scale import row_count
from tallyweave.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A cell holds at most this many queries and candidates, and about so many pairs; a task of keyed texts holds about so many rows.
QUERY_BLOCK = 4_000
CANDIDATE_BLOCK = 50_000
CELL_PAIRS = 1 << 24
# A group of a ``within`` key of at most so many pairs is compared as it is.
FEW_PAIRS = 4_096
TASK_ROWS = 50_000
#: Texts of this length and more use keys of single characters.
LONG = 64
#: Pairs that are scored at a time.
SCORED = 1 << 17
#: Pairs of a grid cell that bit sets bound, their bits, and how many such pairs cost as much as one meeting by a key.
BOUNDED_PAIRS = 1 << 26
CHARACTER_BITS = 256
PAIRS_A_MEETING = 64


def _blocks(rows: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(rows / size)).cast("int")


def _every(blocks: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))


def _block_of(text: str, blocks: str) -> Column:
    return F.pmod(F.xxhash64(text), F.col(blocks)).cast("int")


# --- sorted tokens: keys -----------------------------------------------------------------------------------------
def common_characters(size: int, cutoff: float) -> int:
    """Characters that a text of ``size`` has in common at least with any text it reaches the cutoff with."""
    shortest = math.ceil(cutoff * size / (200.0 - cutoff) - 1e-9)
    return max(1, math.ceil(cutoff * (size + shortest) / 200.0 - 1e-9))


def _mixed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = first * np.uint64(0x9E3779B97F4A7C15) ^ second * np.uint64(0xC2B2AE3D27D4EB4F)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (x ^ (x >> np.uint64(29))).view(np.int64)


def text_keys(text: str, cutoff: float, rarity: dict[str, float]) -> np.ndarray:
    """Keys of a text; texts whose ``ratio`` reaches the cutoff share one, in whatever order their characters are.

    ``rarity``: the logarithm of a character's share of texts; a second occurrence counts as rarer than the first.
    """
    if not text:
        return np.zeros(1, np.int64)
    seen: dict[str, int] = {}
    tokens = []
    for ch in text:
        seen[ch] = nth = seen.get(ch, 0) + 1
        tokens.append((nth * rarity.get(ch, -99.0), ch, nth))
    tokens.sort()
    ids = np.array([ord(ch) << 32 | nth for _, ch, nth in tokens], np.uint64)
    size, spare = len(text), len(text) - common_characters(len(text), cutoff)
    shortest = next(n for n in range(1, 1 << 20) if common_characters(n, cutoff) >= 2)
    found = []
    if shortest <= size < LONG:
        first = ids[: spare + 2]
        i, j = np.triu_indices(len(first), 1)
        found.append(_mixed(first[i], first[j]))
    # Pairs with a text too short for two characters, or too long for pairs of them.
    if math.ceil(cutoff * size / (200.0 - cutoff) - 1e-9) < shortest or size * (200.0 - cutoff) / cutoff >= LONG:
        found.append(_mixed(ids[: spare + 1], np.zeros(min(size, spare + 1), np.uint64)))
    return np.unique(np.concatenate(found))


def _token_number(token: str, tag: int) -> np.int64:
    digest = hashlib.blake2b(token.encode("utf-8", "surrogatepass"), digest_size=8, key=bytes([tag])).digest()
    return np.frombuffer(digest, np.int64)[0]


def set_keys(text: str, cutoff: float, rarity: dict[str, float], asks: bool) -> np.ndarray:
    """Keys of a text for ``token_set``; ``asks``: of a query, else of a candidate.

    What two texts share counts against either one. So each side sends the few longest tokens of which one must be shared if it is the
    contained one, and all its tokens for where the other is; the tags keep the two apart.
    """
    tokens = sorted(set(text.split()), key=lambda t: (-len(t), t))
    distinct = " ".join(sorted(tokens))
    need, left, few = cutoff * len(distinct) / (200.0 - cutoff), len(distinct), []
    for token in tokens:
        if left < need - 1e-9 or left <= 0:
            break
        few.append(token)
        left -= len(token) + 1
    mine, others = (1, 2) if asks else (2, 1)
    found = [_token_number(t, mine) for t in few] + [_token_number(t, others) for t in tokens]
    return np.unique(np.concatenate([text_keys(distinct, cutoff, rarity), np.array(found, np.int64)]))


def _keyed(texts: DataFrame, name: str, cutoff: float, rarity: dict[str, float], scorer: str) -> DataFrame:
    asks = name == "query"

    def keys(values: pd.Series) -> pd.Series:
        if scorer == "token_set":
            return pd.Series([set_keys(v, cutoff, rarity, asks) for v in values])
        if scorer == "ratio":
            return pd.Series([text_keys(v, cutoff, rarity) for v in values])
        return pd.Series([text_keys(" ".join(v.split()), cutoff, rarity) for v in values])

    keys.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return texts.withColumn("_prefix", F.explode(F.pandas_udf(keys, T.ArrayType(T.LongType()))(name)))


def _rarity(texts: DataFrame) -> dict[str, float]:
    """Logarithm of the share of texts that have a character: one row per character of the alphabet."""
    per = texts.select(F.explode(F.array_distinct(F.split("candidate", ""))).alias("ch")).groupBy("ch").agg(F.count(F.lit(1)).alias("n"))
    counts = {row["ch"]: row["n"] for row in per.collect()}
    most = max(counts.values(), default=1) + 1
    return {ch: math.log(n / most) for ch, n in counts.items()}


def _keyed_search(measure: str, cutoff: float, keep_all: bool):
    by_set, sorted_tokens = measure == "token_set", measure == "token_sort"
    scorer = similarity.token_set_pairs if by_set else similarity.ratio_pairs

    def search(asked: pd.DataFrame, offered: pd.DataFrame) -> pd.DataFrame:
        columns = ["_key", "query", "candidate", "score", "candidate_order"]
        if not len(asked) or not len(offered):
            return pd.DataFrame([], columns=columns).astype({"score": float})
        texts, own_texts = ([" ".join(sorted(t.split())) for t in side] if sorted_tokens else side.tolist() for side in (offered["candidate"], asked["query"]))
        asked = asked.assign(_text=own_texts).sort_values(["query", "_key"], kind="stable")
        where, codes = np.unique(pd.concat([offered["_prefix"], asked["_prefix"]]).to_numpy(), return_inverse=True)
        code, mine = codes[: len(offered)], codes[len(offered) :]
        by_code = np.argsort(code, kind="stable")
        low = np.searchsorted(code[by_code], mine)
        high = np.searchsorted(code[by_code], mine, "right")
        owner = pd.factorize(pd.MultiIndex.from_arrays([asked["_key"], asked["query"]]))[0]
        candidate = pd.factorize(pd.MultiIndex.from_arrays([offered["_key"], offered["candidate"]]))[0]
        keys_a, keys_o = asked["_key"].to_numpy(), offered["_key"].to_numpy()
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        own = np.fromiter(map(len, asked["_text"]), np.int64, len(asked))
        asked_text, queries = asked["_text"].to_numpy(), asked["query"].to_numpy()
        order, names = offered["candidate_order"].to_numpy(), offered["candidate"].to_numpy()
        ends = np.append(np.flatnonzero(np.diff(owner)) + 1, len(owner))
        found, start = [], 0
        reach = np.cumsum(high - low)
        while start < len(owner):
            # Whole queries, as many as have about SCORED meetings.
            base = reach[start - 1] if start else 0
            stop = int(ends[max(np.searchsorted(ends, start, "right"), np.searchsorted(reach[ends - 1], base + SCORED, "right") - 1)])
            count = (high - low)[start:stop]
            left = np.repeat(np.arange(start, stop), count)
            right = by_code[np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low[start:stop], count)]
            near = keys_a[left] == keys_o[right]
            if not by_set:
                near &= 200.0 * np.minimum(own[left], sizes[right]) >= (cutoff - 1e-9) * (own[left] + sizes[right])
            left, right = left[near], right[near]
            _, once = np.unique(owner[left].astype(np.int64) * (int(candidate.max()) + 1) + candidate[right], return_index=True)
            left, right = left[once], right[once]
            score = scorer(asked_text[left].tolist(), [texts[i] for i in right]) if len(left) else np.zeros(0)
            hit = score >= cutoff
            rows = pd.DataFrame({"_owner": owner[left[hit]], "_key": keys_a[left[hit]], "query": queries[left[hit]], "candidate": names[right[hit]], "score": score[hit], "candidate_order": order[right[hit]]})
            if not keep_all:
                rows = rows.sort_values(["score", "candidate_order"], ascending=[False, True], kind="stable").drop_duplicates("_owner")
            found.append(rows[columns])
            start = stop
        return pd.concat(found, ignore_index=True)

    return search


def _by_keys(queries: DataFrame, candidates: DataFrame, scorer: str, cutoff: float, within: str | None, keep_all: bool) -> DataFrame:
    bounded = within is None and scorer != "token_set"
    if bounded:
        queries, candidates = cut_lineage(queries.select("query")), cut_lineage(candidates.select("candidate", "candidate_order"))
    whole = queries, candidates
    rarity = _rarity(candidates)
    group = F.col(within).cast("string") if within else F.lit("")
    queries = _keyed(queries.select("query", group.alias("_key")), "query", cutoff, rarity, scorer)
    candidates = _keyed(candidates.select("candidate", "candidate_order", group.alias("_key")), "candidate", cutoff, rarity, scorer)
    shared = ["_key", "_prefix"]
    sizes = queries.groupBy(*shared).agg(F.count(F.lit(1)).alias("_asked")).join(
        candidates.groupBy(*shared).agg(F.count(F.lit(1)).alias("_offered")), shared
    ).withColumns({"_rows": _blocks(F.col("_asked"), QUERY_BLOCK), "_columns": _blocks(F.col("_offered"), CANDIDATE_BLOCK)})
    if bounded:
        met = F.coalesce(F.sum(F.col("_asked").cast("double") * F.col("_offered")), F.lit(0.0))
        pairs = row_count(whole[0]).cast("double") * row_count(whole[1])
        if sizes.agg((met * PAIRS_A_MEETING > pairs).alias("dense")).first()["dense"]:
            return _by_grid(*whole, scorer, cutoff, keep_all, _bounded_search, BOUNDED_PAIRS)
    sent = sizes.agg(F.sum(F.col("_asked") * F.col("_columns") + F.col("_offered") * F.col("_rows"))).scalar()
    tasks = _blocks(F.coalesce(sent, F.lit(0)), TASK_ROWS)
    sizes = sizes.select(*shared, "_rows", "_columns")
    asked = queries.join(sizes, shared).withColumn("_row", _block_of("query", "_rows")).withColumn("_column", _every("_columns"))
    offered = candidates.join(sizes, shared).withColumn("_column", _block_of("candidate", "_columns")).withColumn("_row", _every("_rows"))
    task = F.pmod(F.xxhash64(*shared, "_row", "_column"), tasks).alias("_task")
    # The cell becomes part of the key, so that a task pairs what is in the same cell only.
    cell = F.xxhash64("_prefix", "_row", "_column").alias("_prefix")
    found = (
        asked.select(task, "_key", cell, "query").groupBy("_task")
        .cogroup(offered.select(task, "_key", cell, "candidate", "candidate_order").groupBy("_task"))
        .applyInPandas(_keyed_search(scorer, cutoff, keep_all), "_key string, query string, candidate string, score double, candidate_order string")
    )
    return found.withColumnRenamed("_key", within) if within else found.drop("_key")


# --- grids -------------------------------------------------------------------------------------------------------
def _character_bits(texts: list[str], vocabulary: dict[tuple[str, int], int]) -> tuple[np.ndarray, np.ndarray]:
    """Each text's characters, the nth occurrence being one of its own, as bits; how many have no bit."""
    bits, rest = np.zeros((len(texts), CHARACTER_BITS), bool), np.zeros(len(texts), np.int64)
    for row, text in enumerate(texts):
        for token in _occurrences(text):
            place = vocabulary.get(token)
            if place is None:
                rest[row] += 1
            else:
                bits[row, place] = True
    return np.packbits(bits, axis=1).view(np.uint64), rest


def _occurrences(text: str) -> list[tuple[str, int]]:
    seen: dict[str, int] = {}
    found = []
    for ch in text:
        seen[ch] = nth = seen.get(ch, 0) + 1
        found.append((ch, nth))
    return found


def _bounded_search(scorer: str, cutoff: float, keep_all: bool):
    """Every pair of a cell: lengths and characters in common bound the score, what they leave is scored."""
    columns = ["query", "candidate", "score", "candidate_order"]
    # The function, not its module: a module sent by value takes its UDFs along, which hold a handle of the JVM once they were used.
    ratio_pairs = similarity.ratio_pairs

    def search(asked: pd.DataFrame, offered: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame([], columns=columns).astype({"score": float})
        if not len(asked) or not len(offered):
            return empty
        texts, own = ([" ".join(sorted(t.split())) if scorer == "token_sort" else t for t in side] for side in (offered["candidate"], asked["query"]))
        order = np.argsort(np.fromiter(map(len, texts), np.int64, len(texts)), kind="stable")
        texts, offered = [texts[i] for i in order], offered.iloc[order]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        common = Counter(token for side in (texts, own) for text in side for token in _occurrences(text)).most_common(CHARACTER_BITS)
        vocabulary = {token: place for place, (token, _) in enumerate(common)}
        (bits, rest), (own_bits, own_rest) = (_character_bits(side, vocabulary) for side in (texts, own))
        bits = np.ascontiguousarray(bits.T)
        names, places, queries = offered["candidate"].to_numpy(), offered["candidate_order"].to_numpy(), asked["query"].to_numpy()
        found, waiting, held = [empty], [], 0

        def score() -> None:
            left = np.repeat([i for i, _ in waiting], [len(w) for _, w in waiting])
            right = np.concatenate([w for _, w in waiting])
            scores = ratio_pairs([own[i] for i in left], [texts[i] for i in right])
            hit = scores >= cutoff
            rows = pd.DataFrame({"query": queries[left[hit]], "candidate": names[right[hit]], "score": scores[hit], "candidate_order": places[right[hit]]})
            if not keep_all:
                rows = rows.sort_values(["score", "candidate_order"], ascending=[False, True], kind="stable").drop_duplicates("query")
            found.append(rows[columns])
            waiting.clear()

        for i, text in enumerate(own):
            n = len(text)
            low = np.searchsorted(sizes, math.ceil(cutoff * n / (200.0 - cutoff) - 1e-6))
            high = np.searchsorted(sizes, math.floor(n * (200.0 - cutoff) / cutoff + 1e-6), "right")
            if low >= high:
                continue
            shared = np.minimum(rest[low:high], own_rest[i])
            for word in range(len(bits)):
                if own_bits[i, word]:
                    shared += np.bitwise_count(bits[word, low:high] & own_bits[i, word])
            near = low + np.flatnonzero((200.0 * shared >= (cutoff - 1e-9) * (sizes[low:high] + n)) | (sizes[low:high] + n == 0))
            if len(near):
                waiting.append((i, near))
                held += len(near)
            if held >= SCORED:
                score()
                held = 0
        if waiting:
            score()
        return pd.concat(found, ignore_index=True) if len(found) > 1 else empty

    return search


def _cell_search(scorer: str, cutoff: float, keep_all: bool):
    block_type = similarity.BLOCKS[scorer]

    def search(asked: pd.DataFrame, offered: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(asked) and len(offered):
            texts, order = offered["candidate"].tolist(), offered["candidate_order"].tolist()
            block = block_type(texts)
            for query in asked["query"]:
                if keep_all:
                    found += [(query, texts[i], score, order[i]) for i, score in block.all(query, cutoff)]
                    continue
                best = block.best(query, cutoff, order)
                if best:
                    found.append((query, texts[best[0]], best[1], order[best[0]]))
        return pd.DataFrame(found, columns=["query", "candidate", "score", "candidate_order"])

    return search


def _by_grid(
    queries: DataFrame, candidates: DataFrame, scorer: str, cutoff: float, keep_all: bool, cell_search=_cell_search, cell_pairs: int = CELL_PAIRS
) -> DataFrame:
    asked, offered = row_count(queries), row_count(candidates)
    columns = _blocks(offered, CANDIDATE_BLOCK)
    pairs = asked * F.least(offered, F.lit(CANDIDATE_BLOCK))
    rows = F.greatest(_blocks(asked, QUERY_BLOCK), F.least(_blocks(pairs, cell_pairs), F.greatest(F.lit(1), asked.cast("int"))))
    queries, candidates = (side.withColumn("_rows", rows).withColumn("_columns", columns) for side in (queries, candidates))
    queries = queries.withColumn("_row", _block_of("query", "_rows")).withColumn("_column", _every("_columns"))
    candidates = candidates.withColumn("_column", _block_of("candidate", "_columns")).withColumn("_row", _every("_rows"))
    cell = ["_row", "_column"]
    return (
        queries.select(*cell, "query").groupBy(*cell)
        .cogroup(candidates.select(*cell, "candidate", "candidate_order").groupBy(*cell))
        .applyInPandas(cell_search(scorer, cutoff, keep_all), "query string, candidate string, score double, candidate_order string")
    )


def _in_groups(queries: DataFrame, candidates: DataFrame, scorer: str, cutoff: float, within: str, keep_all: bool) -> DataFrame:
    """Groups of few pairs are compared pair by pair, which costs less than keys; larger ones meet by keys."""
    asked = queries.groupBy(within).agg(F.count(F.lit(1)).alias("_asked"))
    offered = candidates.groupBy(within).agg(F.count(F.lit(1)).alias("_offered"))
    few = F.col("_asked") * F.col("_offered") <= FEW_PAIRS
    groups = asked.join(offered, within).select(within, few.alias("_few"))
    queries, candidates = (side.join(groups, within) for side in (queries, candidates))
    pairs = queries.filter("_few").drop("_few").join(candidates.filter("_few").drop("_few"), within)
    score = getattr(similarity, f"{scorer}_udf")
    scored = pairs.withColumn("score", score("query", "candidate")).filter(F.col("score") >= cutoff)
    columns = ["query", "candidate", "score", "candidate_order"]
    scored = scored.select(F.col(within).cast("string").alias(within), *columns)
    keyed = _by_keys(queries.filter("NOT _few"), candidates.filter("NOT _few"), scorer, cutoff, within, keep_all)
    return scored.unionByName(keyed.select(within, *columns))


def _search(queries, candidates, scorer, cutoff, within, keep_all):
    if scorer in ("ratio", "token_sort", "token_set"):
        if within is not None:
            return _in_groups(queries, candidates, scorer, cutoff, within, keep_all)
        return _by_keys(queries, candidates, scorer, cutoff, within, keep_all)
    if within is not None:
        raise ValueError("names are not searched within keys")
    return _by_grid(queries, candidates, scorer, cutoff, keep_all)


def best_match(
    queries: DataFrame, candidates: DataFrame, scorer: str, cutoff: float, within: str | None = None
) -> DataFrame:
    """Best candidate per query at or above ``cutoff``; ties go to the smallest ``candidate_order``.

    ``queries(query[, within])`` and ``candidates(candidate, candidate_order[, within])`` are distinct;
    with ``within`` only candidates of the same key compete.
    """
    found = _search(queries, candidates, scorer, cutoff, within, keep_all=False)
    keys = [within, "query"] if within else ["query"]
    winner = F.min_by(F.struct("candidate", "score"), F.struct(-F.col("score"), F.col("candidate_order")))
    return found.groupBy(*keys).agg(winner.alias("_best")).select(*keys, "_best.*")


def all_matches(queries: DataFrame, candidates: DataFrame, scorer: str, cutoff: float) -> DataFrame:
    """Every (query, candidate) at or above ``cutoff``: the matches themselves, not the compared pairs."""
    found = _search(queries, candidates, scorer, cutoff, None, keep_all=True).drop("candidate_order")
    # Two texts may share several keys, hence meet in several tasks.
    return found.distinct()
