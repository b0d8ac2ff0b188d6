"""Toxicity by weak supervision: many weak voters, a generative label model over their votes, and a linear classifier.

Voters are lexicon words and word beginnings (found by how they split all labelled texts), patterns of the text, and the given label
itself, none of which is trusted. The label model treats the true class as hidden: each voter fires with its own rate in either class, and
votes of one text that are correlated within the classes share their weight. Expectation-maximisation estimates rates and correlations
together. A logistic regression over hashed words and word beginnings is then trained on the posterior of the hidden class and scores
every document.

Texts of all labelled training documents count, copies and near copies once: slots by label are summed by Spark, and so are, in each round
of the estimate, votes and pairs of votes over the table of all their votes, and over the votes of all unlabelled documents in the last
rounds. What reaches the driver is bounded by the number of slots and of pairs of voters. Only the classifier is fitted on a sample.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm import bloom
from tallyweave.llm import common as C

#: Labelled texts that the classifier is fitted on, copies left out before.
SAMPLE = 12_000
#: Rows of two numbers that are sent to every executor.
BROADCAST_ROWS = 1_000_000
#: Rounds of the estimate over labelled texts and then over all; groups in which the sums of tasks meet.
ROUNDS, LAST_ROUNDS, MERGES = 20, 2, 8
SLOT_BITS = 20
#: Features of the classifier, lexicon voters, and in how many texts a feature must occur.
FEATURES, LEXICON, SUPPORT = 4096, 150, 3
#: Least share of toxic texts among those with a lexicon word.
PURITY = 0.6
#: Bytes of a word's beginning.
BEGINNING = 5
PATTERNS = ("capitals", "exclamations", "digits", "symbols", "repeats", "short")


def _slots(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the words and word beginnings of texts, and which text each is of."""
    data = C.lower_ascii(data)
    starts, ends, first = C._runs(((data >= 97) & (data <= 122)) | (data >= 128), offsets)
    document = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    words = C.hash_words(data, starts, ends)
    long = ends - starts >= BEGINNING
    begins = C.hash_words(data, starts[long], starts[long] + BEGINNING) ^ np.uint64(0x5BF03635)
    slot = np.concatenate([C.mixed(words), C.mixed(begins)]) >> np.uint64(64 - SLOT_BITS)
    return slot.astype(np.int64), np.concatenate([document, document[long]])


def _per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(mask)])
    return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(np.float64)


def _patterns(data: np.ndarray, offsets: np.ndarray, distinct: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Votes of the pattern voters, in the order of PATTERNS."""
    n = np.maximum(1, np.diff(offsets))
    capitals = _per_text((data >= 65) & (data <= 90), offsets)
    letters = np.maximum(1, capitals + _per_text((data >= 97) & (data <= 122), offsets))
    symbols = (data >= 33) & (data <= 64) & ~((data >= 48) & (data <= 57)) & (data != 44) & (data != 46)
    return np.stack([
        capitals / letters > 0.3,
        _per_text(data == 33, offsets) / np.maximum(1, words) > 0.05,
        _per_text((data >= 48) & (data <= 57), offsets) / n > 0.05,
        _per_text(symbols, offsets) / n > 0.05,
        distinct < 0.5 * words,
        words < 20,
    ], axis=1)


def _features(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, slot) pairs, in order, and the pattern votes."""
    data, offsets = C.flat_text(texts)
    slot, document = _slots(data, offsets)
    n = len(offsets) - 1
    pair = np.unique(document << SLOT_BITS | slot)
    document_of, slot_of = pair >> SLOT_BITS, pair & ((1 << SLOT_BITS) - 1)
    patterns = _patterns(data, offsets, np.bincount(document_of, minlength=n), np.bincount(document, minlength=n))
    return document_of, slot_of, patterns


class LabelModel:
    """Class balance, firing rates and correlations of binary voters; the posterior of the hidden class follows from a text's votes.

    A voter that doesn't fire abstains: a lexicon word that is absent says nothing, as texts have their own languages and words. The
    given labels and the toxic voters start the estimate, the labels give the class balance; a given label is one voter if toxic and
    another if not, and is taken to be right in at least ``trust`` of either class. The first ``toxic_voters`` voters never speak for the
    clean class. Without these bounds the hidden class could drift to any other that the voters tell apart.
    """

    def __init__(self, n_voters: int, toxic_voters: int, balance: float, trust: float = 0.8) -> None:
        self.n, self.toxic, self.trust = n_voters + 2, toxic_voters, trust
        self.balance, self.rate, self.together = balance, None, np.eye(n_voters + 2)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """votes: one column a voter, then "labelled toxic" and "labelled clean" (neither: no label)."""
        if self.rate is None:
            return 0.1 + 0.4 * votes[:, -2] + 0.4 * votes[:, : self.toxic].any(axis=1)
        # A vote shares its weight with the correlated votes that the same text has.
        shared = np.maximum(1, votes @ self.together)
        odds = np.log(self.balance / (1 - self.balance)) + (votes / shared) @ np.log(self.rate[1] / self.rate[0])
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))

    def sums(self, votes: np.ndarray) -> np.ndarray:
        """What a round needs of some texts, to be added up: rows, share of the class, votes and pairs of votes by class."""
        q = self.posterior(votes)
        # Correlations within each likelier class, where few mistakes of the class blur them least.
        likely = q > 0.5
        pairs = [votes[of].T @ votes[of] for of in (~likely, likely)]
        return np.concatenate([[len(q), q.sum()], votes.T @ (1 - q), votes.T @ q, [(~likely).sum(), likely.sum()], *(p.ravel() for p in pairs)])

    def size(self) -> int:
        return 4 + 2 * self.n + 2 * self.n * self.n

    def update(self, sums: np.ndarray) -> float:
        """Take over what all texts add up to; the largest change of a rate."""
        n, v = sums[0], self.n
        q = sums[1]
        rate = np.stack([(sums[2 : 2 + v] + 1) / (n - q + 2), (sums[2 + v : 2 + 2 * v] + 1) / (q + 2)])
        rate[1, -2:] = np.clip(rate[1, -2:], (self.trust, 0), (1, 1 - self.trust))
        rate[0, -2:] = np.clip(rate[0, -2:], (0, self.trust), (1 - self.trust, 1))
        rate = np.clip(rate, 1e-6, 1)
        rate[1, : self.toxic] = np.maximum(rate[1], rate[0])[: self.toxic]
        change = 1.0 if self.rate is None else float(np.abs(rate - self.rate).max())
        if self.rate is not None:
            counts = sums[2 + 2 * v : 4 + 2 * v]
            pairs = sums[4 + 2 * v :].reshape(2, v, v)
            # What is left of pairs of votes when each class's means are taken out.
            left = sum(p - np.outer(np.diag(p), np.diag(p)) / max(1, c) for p, c in zip(pairs, counts, strict=True))
            spread = np.sqrt(np.maximum(np.diag(left), 0) + 1e-9)
            together = np.clip(left / np.outer(spread, spread), 0, 1)
            together[together < 0.05] = 0
            np.fill_diagonal(together, 1)
            self.together = together
        self.rate = rate
        return change


def fit_label_model(votes: np.ndarray, labels: np.ndarray, toxic_voters: int, rounds: int = 30, trust: float = 0.8) -> dict:
    """The label model of votes in memory, with the posterior of every row."""
    votes = np.concatenate([votes, labels[:, None], 1 - labels[:, None]], axis=1).astype(np.float64)
    model = LabelModel(votes.shape[1] - 2, toxic_voters, (labels.sum() + 1) / (len(labels) + 2), trust)
    for _ in range(rounds):
        if model.update(model.sums(votes)) < 1e-6:
            break
    return {"balance": model.balance, "rates": model.rate, "correlations": model.together, "posterior": model.posterior(votes)}


def fit_classifier(document: np.ndarray, feature: np.ndarray, n_features: int, target: np.ndarray, rounds: int = 300, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on binary features and soft targets, by gradient steps with momentum and scaling."""
    n = len(target)
    w, b = np.zeros(n_features), float(np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3)))
    m, s, mb, sb = np.zeros(n_features), np.zeros(n_features), 0.0, 0.0
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(document, w[feature], n) + b, -30, 30)))
        error = (p - target) / n
        g, gb = np.bincount(feature, error[document], n_features) + penalty * w, error.sum()
        m, s, mb, sb = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * sb + 0.01 * gb * gb
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
        b -= 0.1 * (mb / (1 - 0.9**t)) / (np.sqrt(sb / (1 - 0.99**t)) + 1e-8)
    return w, b


def _copy_key(slots: np.ndarray) -> int:
    """Near copies have the same three minimal hashes of their words."""
    x = slots.astype(np.uint64)
    key = np.zeros(1, np.uint64)
    for k in (1, 2, 3):
        least = C.mixed(x + np.uint64(k << 32)).min() if len(x) else np.uint64(0)
        key = C.mixed(C.mixed(key) ^ least)
    return int(key.view(np.int64)[0])


def _joinable(df: DataFrame) -> DataFrame:
    """Sent to every executor if it has few rows (of a few numbers each); else the join shuffles both sides."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _examples(docs: DataFrame, labels: DataFrame, training: Column) -> DataFrame:
    """(toxic, key, slots, patterns) of every labelled training text, of copies and near copies with one label the first."""
    marked = labels.where(training & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marked = C.stored(marked.where("doc_id IS NOT NULL"), "toxicity-labels")
    given = docs.select("doc_id", "text").where("text IS NOT NULL AND doc_id IS NOT NULL")
    side = _joinable(marked)
    if side is marked:
        # Only texts that may have a label are shuffled.
        given = bloom.split(given, F.col("doc_id"), bloom.filter_of(marked.select("doc_id"), "doc_id"))[0]
    texts = given.join(side, "doc_id").select("toxic", "text", F.monotonically_increasing_id().alias("row"))

    def extract(batches):
        for batch in C.small(batches):
            document, slot, patterns = _features(pa.chunked_array([batch.column("text")]))
            cuts = np.searchsorted(document, np.arange(batch.num_rows + 1))
            rows = [slot[a:b].astype(np.int32) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            keys = pa.array([_copy_key(r) for r in rows], pa.int64())
            votes = pa.array([np.packbits(p).tobytes() for p in patterns], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), keys, batch.column("row"), pa.array([r.tobytes() for r in rows], pa.binary()), votes], names=["toxic", "key", "row", "slots", "patterns"])

    found = C.stored(texts.mapInArrow(C.giving_back(extract), "toxic int, key long, row long, slots binary, patterns binary"), "toxicity-texts")
    # Of near copies the one with the least hash, so that the order in which rows arrive does not matter; of equal ones any.
    first = found.groupBy("toxic", "key").agg(F.min(F.struct(F.xxhash64("slots", "patterns").alias("hash"), "row")).alias("least"))
    first = C.stored(first.select(F.col("least.row").alias("row")), "toxicity-first")
    return found.join(_joinable(first), "row").select("toxic", "key", "slots", "patterns")


def _slot_counts(examples: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """In how many texts each slot occurs, and in how many toxic ones: two numbers a slot, summed in tasks and then across them."""

    def count(batches):
        total, hit = np.zeros((2, 1 << SLOT_BITS), np.int64)
        for batch in batches:
            for toxic, slots in zip(batch.column("toxic").to_pylist(), batch.column("slots").to_pylist(), strict=True):
                of = np.frombuffer(slots, np.int32)
                total[of] += 1
                if toxic:
                    hit[of] += 1
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used]), pa.array(hit[used])], names=["slot", "total", "hit"])

    sums = examples.select("toxic", "slots").mapInArrow(C.giving_back(count), "slot int, total long, hit long").groupBy("slot").agg(F.sum("total").alias("total"), F.sum("hit").alias("hit"))
    # Slots of one or two texts can be no feature.
    rows = sums.where(F.col("total") >= SUPPORT).toPandas()
    total, hit = np.zeros((2, 1 << SLOT_BITS))
    total[rows["slot"]], hit[rows["slot"]] = rows["total"], rows["hit"]
    return total, hit


class _Voters:
    """Votes of texts: the lexicon, the patterns, and whether no lexicon word is there."""

    def __init__(self, raised: np.ndarray) -> None:
        self.raised = np.sort(raised)

    def __len__(self) -> int:
        return len(self.raised) + len(PATTERNS) + 1

    def votes(self, document: np.ndarray, slot: np.ndarray, patterns: np.ndarray) -> np.ndarray:
        out = np.zeros((len(patterns), len(self)), bool)
        if len(self.raised):
            place = np.minimum(np.searchsorted(self.raised, slot), len(self.raised) - 1)
            fires = self.raised[place] == slot
            out[document[fires], place[fires]] = True
        out[:, len(self.raised) : -1] = patterns
        out[:, -1] = ~out[:, : len(self.raised)].any(axis=1)
        return out


def _labelled_votes(examples: DataFrame, voters: _Voters) -> DataFrame:
    """(votes) of the labelled texts, with their labels as the last two."""

    def run(batches):
        for batch in batches:
            lists = [np.frombuffer(x, np.int32) for x in batch.column("slots").to_pylist()]
            document = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            slot = np.concatenate(lists).astype(np.int64) if lists else np.zeros(0, np.int64)
            patterns = np.array([np.unpackbits(np.frombuffer(x, np.uint8), count=len(PATTERNS)) for x in batch.column("patterns").to_pylist()], bool).reshape(-1, len(PATTERNS))
            toxic = batch.column("toxic").to_numpy() == 1
            votes = np.concatenate([voters.votes(document, slot, patterns), toxic[:, None], ~toxic[:, None]], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([np.packbits(v).tobytes() for v in votes], pa.binary())], names=["votes"])

    return examples.mapInArrow(run, "votes binary").groupBy("votes").agg(F.count("*").alias("n"))


def _all_votes(docs: DataFrame, voters: _Voters) -> DataFrame:
    """(votes, n) of all documents, without labels; texts with the same votes are one row with their number."""

    def run(batches):
        for batch in C.small(batches):
            document, slot, patterns = _features(pa.chunked_array([batch.column("text")]))
            votes = np.concatenate([voters.votes(document, slot, patterns), np.zeros((batch.num_rows, 2), bool)], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([np.packbits(v).tobytes() for v in votes], pa.binary())], names=["votes"])

    return docs.select("text").where("text IS NOT NULL").mapInArrow(C.giving_back(run), "votes binary").groupBy("votes").agg(F.count("*").alias("n"))


def _summed(table: DataFrame, model: LabelModel) -> np.ndarray:
    """``LabelModel.sums`` over a table (votes, n), added up in tasks: one row of bounded size from each."""
    width = model.n

    def run(batches):
        total = np.zeros(model.size())
        for batch in batches:
            raw = [np.frombuffer(x, np.uint8) for x in batch.column("votes").to_pylist()]
            if raw:
                votes = np.unpackbits(np.stack(raw), axis=1, count=width).astype(np.float64)
                total += _weighted(model, votes, batch.column("n").to_numpy().astype(np.float64))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.float64) for x in rows.column("sums").to_pylist())
        return pa.table({"sums": pa.array([total.tobytes()], pa.binary())})

    # Sums of tasks meet in a few groups, so that the driver adds up a handful of rows whatever the number of tasks.
    parts = table.mapInArrow(run, "sums binary").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(MERGES)))
    rows = parts.groupBy("part").applyInArrow(lambda t: add(t.select(["sums"])), "sums binary").collect()
    return sum((np.frombuffer(r["sums"], np.float64) for r in rows), np.zeros(model.size()))


def _weighted(model: LabelModel, votes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``sums`` of rows that stand for ``n`` texts each."""
    q = model.posterior(votes)
    likely = q > 0.5
    weighted = votes * n[:, None]
    pairs = [votes[of].T @ weighted[of] for of in (~likely, likely)]
    return np.concatenate([[n.sum(), (n * q).sum()], weighted.T @ (1 - q), weighted.T @ q, [n[~likely].sum(), n[likely].sum()], *(p.ravel() for p in pairs)])


def train(docs: DataFrame, labels: DataFrame, training: Column, sample: int = SAMPLE) -> dict:
    """A model from the labelled training documents; without any, or with one class only, every score is 0."""
    examples = _examples(docs, labels, training)
    counts = {r["toxic"]: r["n"] for r in examples.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return {"slots": np.zeros(0, np.int64), "weights": np.zeros(0), "bias": -30.0}
    base = counts[1] / (counts[0] + counts[1])
    total, hit = _slot_counts(examples)
    # Evidence that a slot tells the classes apart: its log likelihood against the share of toxic texts. What chance alone would
    # show somewhere among so many slots is not kept.
    share = np.clip(hit / np.maximum(total, 1), 1e-9, 1 - 1e-9)
    evidence = total * (share * np.log(share / base) + (1 - share) * np.log((1 - share) / (1 - base)))
    evidence[(total < SUPPORT) | (evidence < np.log(max(2, np.count_nonzero(total >= SUPPORT))))] = 0
    order = np.argsort(-evidence, kind="stable")
    kept = np.sort(order[:FEATURES][evidence[order[:FEATURES]] > 0])
    voters = _Voters(order[(share[order] >= PURITY) & (evidence[order] > 0)][:LEXICON])
    labelled = C.stored(_labelled_votes(examples, voters), "toxicity-votes")
    model = LabelModel(len(voters), len(voters.raised), (counts[1] + 1) / (counts[0] + counts[1] + 2))
    for _ in range(ROUNDS):
        if model.update(_summed(labelled, model)) < 1e-4:
            break
    # All documents have a say in rates and correlations once the labels have told the classes apart.
    everything = C.stored(labelled.unionByName(_all_votes(docs, voters)), "toxicity-votes")
    for _ in range(LAST_ROUNDS):
        model.update(_summed(everything, model))
    # The classifier's sample: texts with the smallest hashes, copies have gone before.
    rows = examples.orderBy(F.xxhash64("key"), "key", "toxic").limit(sample).toPandas().sort_values(["toxic", "key"], ignore_index=True)
    lists = [np.frombuffer(x, np.int32) for x in rows["slots"]]
    document, slot = np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate(lists).astype(np.int64)
    patterns = np.stack([np.unpackbits(np.frombuffer(x, np.uint8), count=len(PATTERNS)) for x in rows["patterns"]]).astype(bool)
    toxic = rows["toxic"].to_numpy() == 1
    votes = np.concatenate([voters.votes(document, slot, patterns), toxic[:, None], ~toxic[:, None]], axis=1).astype(np.float64)
    index = np.full(1 << SLOT_BITS, -1)
    index[kept] = np.arange(len(kept))
    use = index[slot] >= 0
    weights, bias = fit_classifier(document[use], index[slot[use]], len(kept), model.posterior(votes))
    return {"slots": kept, "weights": weights, "bias": bias}


def score(docs: DataFrame, model: dict, *keep: str | Column) -> DataFrame:
    """The kept columns with score: the probability of the toxic class."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    names = docs.select(*keep).columns
    fixed = [f"keep_{i}" for i in range(len(names))]
    source = docs.select(*keep, "text").toDF(*fixed, "text")
    out = source.drop("text").withColumn("score", F.lit(0.0)).schema

    def run(batches):
        m = shared.value
        weight = np.zeros(1 << SLOT_BITS)
        weight[m["slots"]] = m["weights"]
        for batch in C.small(batches):
            data, offsets = C.flat_text(pa.chunked_array([batch.column("text")]))
            slot, document = _slots(data, offsets)
            use = weight[slot] != 0
            pair = np.unique(document[use] << SLOT_BITS | slot[use])
            total = np.bincount(pair >> SLOT_BITS, weight[pair & ((1 << SLOT_BITS) - 1)], batch.num_rows) + m["bias"]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in fixed), pa.array(1 / (1 + np.exp(-np.clip(total, -30, 30))))], names=[*fixed, "score"])

    return source.mapInArrow(C.giving_back(run), out).toDF(*names, "score")


def score_toxicity(docs: DataFrame, labels: DataFrame, training: Column, *keep: str | Column, sample: int = SAMPLE) -> DataFrame:
    """Score every document for toxicity with a model learned from labelled training documents.

    docs: doc_id, text and what is kept; labels: doc_id, toxic (0 or 1; others are ignored). ``training`` is a condition on doc_id of
    the labels. The classifier is fitted on at most ``sample`` labelled texts, equal texts and near copies once; the lexicon, the voters' rates
    and their correlations come from all labelled training texts and all documents. Only the text is looked at in a score. A null or empty text has the score of a text without features. Every row is judged by itself, so
    repeated rows repeat; several labels of one document count as toxic if one is. Further columns are ignored.
    """
    return score(docs, train(docs, labels, training, sample), *keep)
