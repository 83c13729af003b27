"""Quality classifier trained on weak labels.

Overlapping heuristic labellers vote reject, keep or nothing on every
document. Expectation-maximisation over all documents' vote patterns
estimates how accurate each labeller is; the posterior labels of a bounded
sample train a linear scorer over hashed features, which scores every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainsift.llm.common import _LOWER, batches, flat_bytes, mix, prefix_hash, shingle_hashes, span_hash, stored, words

KEEP, REJECT, NONE = 0, 1, 2
#: Labeller: (signal, reject from, keep up to, least words to vote at all). Signals are shares of a text's words.
LABELLERS = (
    ("shouting", 0.15, 0.03, 4),
    ("symbols", 0.12, 0.03, 4),
    ("separators", 0.12, 0.03, 3),
    ("repeats", 0.3, 0.06, 6),
    ("poverty", 0.6, 0.35, 40),
    ("insults", 1e-9, 0.0, 1),
)
SIGNALS = tuple(x[0] for x in LABELLERS)
#: Documents (about) whose posterior labels train the scorer; chosen by a hash of the row.
FIT_ROWS = 20_000
#: Labelled rows (about) that teach the insult labeller its words; chosen by a hash of doc_id.
LABELLED_ROWS = 200_000
#: Hashed features of the scorer (a power of two), and its threshold for keeping a text.
FEATURES, KEEP_FROM = 1 << 16, 0.5
#: A feature in fewer texts of the sample keeps weight 0.
SELDOM = 5
#: Insults are words in at least this part of the texts labelled toxic and LIFT times as frequent there as in the others; the MAX_INSULTS most frequent count.
INSULT_SHARE, LIFT, MAX_INSULTS = 0.01, 20.0, 500
#: Most good texts that a labeller may be estimated to reject.
FALSE_ALARM = 0.02
_STEPS = np.array([1e-9, 0.01, 0.03, 0.06, 0.12, 0.2, 0.3, 0.45, 0.6, 0.8])

_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "#$%&*+<=>@\\^_`{}~"]] = True


def cores(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of each word without the signs around it; empty where it has neither letter nor digit."""
    solid = np.append(np.flatnonzero(_ALNUM[raw]), len(raw))
    a = solid[np.minimum(np.searchsorted(solid, start), len(solid) - 1)]
    b = solid[np.maximum(np.searchsorted(solid, end) - 1, 0)] + 1
    return np.where(a < end, a, start), np.where(a < end, b, start)


def signals(raw: np.ndarray, off: np.ndarray, insults: np.ndarray):
    """(words of each text, signals x texts, core hashes, first word of each text)."""
    word, start, end, first = words(raw, off)
    total = np.diff(first)
    a, b = cores(raw, start, end)
    core = span_hash(prefix_hash(_LOWER[raw]), a, b)
    sums = lambda flag: np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
    inside = lambda s: s[end] - s[start]
    share = lambda flag: np.diff(sums(flag)[first]) / np.maximum(total, 1)
    letters = inside(sums(_LETTER[raw]))
    shouting = (letters >= 2) & (inside(sums(_UPPER[raw])) == letters)
    twice = np.zeros(len(raw), bool)
    twice[1:] = (raw[1:] == 33) & (raw[:-1] == 33)
    symbols = inside(sums(_MARK[raw] | twice)) > 0
    separators = (end - start == 1) & np.isin(raw[start], [ord("|"), ord("/"), ord("-"), ord("=")]) if len(start) else np.zeros(0, bool)
    doc = np.repeat(np.arange(len(total)), total)
    repeats = np.zeros(len(word), bool)
    repeats[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    three = shingle_hashes(word, 3)
    three = three + mix(doc[: len(three)].astype(np.uint64) + np.uint64(1))
    same = np.ones(len(three), bool)
    if len(three):
        same[np.unique(three, return_index=True)[1]] = False
    poverty = np.concatenate([same, np.zeros(len(word) - len(three), bool)])
    found = np.isin(core, insults) & (b > a)
    return total, np.stack([share(x) for x in (shouting, symbols, separators, repeats, poverty, found)]), np.where(b > a, core, 0), first


def votes(total: np.ndarray, signal: np.ndarray, insults: bool) -> np.ndarray:
    """Votes, labellers x texts. A text without words gets none."""
    out = np.full(signal.shape, NONE, np.int8)
    for k, (name, reject, keep, least) in enumerate(LABELLERS):
        if name == "insults" and not insults:
            continue
        on = total >= least
        out[k][on & (signal[k] <= keep)] = KEEP
        out[k][on & (signal[k] >= reject)] = REJECT
    return out


def posterior(pattern: np.ndarray, prior: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """Probability of each kind (documents x kinds; kind 0 is good) given the votes.

    ``rates[kind, labeller]`` is how often a labeller that votes rejects that
    kind; a labeller that does not vote says nothing.
    """
    log = np.log(prior)[None] + (pattern == REJECT) @ np.log(rates).T + (pattern == KEEP) @ np.log(1 - rates).T
    p = np.exp(log - log.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def estimate(pattern: np.ndarray, count: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """EM over vote patterns: (prior of each kind, rates[kind, labeller]).

    Bad texts are bad in different ways, so there is one hidden kind for each
    labeller besides the good kind. EM starts from the votes to reject (the
    kinds of the labellers that fired share a document, good has it if none
    did) and finds how often each labeller rejects each kind: its accuracy
    and its overlap with the others. Two bounds keep the kinds in place: a
    labeller rejects at most FALSE_ALARM of the good texts and at least half
    of its own kind.
    """
    fired = (pattern == REJECT).astype(float)
    p = np.concatenate([(fired.sum(axis=1, keepdims=True) == 0) * 1.0, fired], axis=1) + 1e-6
    p /= p.sum(axis=1, keepdims=True)
    own = np.arange(pattern.shape[1])
    for _ in range(rounds):
        weight = p * count[:, None]
        prior = weight.sum(axis=0) + 0.01
        prior /= prior.sum()
        yes, no = weight.T @ (pattern == REJECT), weight.T @ (pattern == KEEP)
        rates = np.clip((yes + 0.01) / (yes + no + 0.1), 1e-5, 1 - 1e-3)
        rates[0] = np.minimum(rates[0], FALSE_ALARM)
        rates[own + 1, own] = np.maximum(rates[own + 1, own], 0.5)
        new = posterior(pattern, prior, rates)
        if np.abs(new - p).max(initial=0) < 1e-6:
            break
        p = new
    return prior, rates


def features(total: np.ndarray, signal: np.ndarray, core: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, first feature of each text): its distinct hashed words and a step for each signal."""
    n = len(total)
    doc = np.repeat(np.arange(n), total)
    steps = np.searchsorted(_STEPS, signal, side="right")  # signals x texts
    own = (np.arange(len(SIGNALS))[:, None] * (len(_STEPS) + 1) + steps).T.reshape(-1)
    slot = (mix(core) % np.uint64(FEATURES - 256)).astype(np.int64) + 256
    on = core != 0
    key = np.unique(np.concatenate([doc[on] * FEATURES + slot[on], np.repeat(np.arange(n), len(SIGNALS)) * FEATURES + own]))
    return key % FEATURES, np.searchsorted(key, np.arange(n + 1) * FEATURES)


@dataclass
class Model:
    """What ``fit`` learnt: insult hashes, the label model and the scorer's weights."""

    insults: np.ndarray
    prior: np.ndarray
    rates: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    bias: float = 0.0

    def read(self, raw, off):
        total, signal, core, first = signals(raw, off, self.insults)
        vote = votes(total, signal, len(self.insults) > 0)
        return total, 1 - posterior(vote.T, self.prior, self.rates)[:, 0], *features(total, signal, core, first)

    def score(self, feature: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Probability that each text is good."""
        margin, n = np.concatenate([[0], np.cumsum(self.weights[feature])]), np.diff(at)
        return 1 / (1 + np.exp(np.clip((margin[at[1:]] - margin[at[:-1]]) / np.sqrt(np.maximum(n, 1)) + self.bias, -50, 50)))


def train(feature: np.ndarray, at: np.ndarray, target: np.ndarray, epochs: int = 60, rate: float = 0.5, decay: float = 1e-6) -> tuple[np.ndarray, float]:
    """Logistic regression (Adagrad, full batches) on probabilities to reject; features weigh 1/sqrt(features of the text)."""
    n = np.diff(at)
    unit = np.repeat(1 / np.sqrt(np.maximum(n, 1)), n)
    row = np.repeat(np.arange(len(n)), n)
    weights, bias, square, square_b = np.zeros(FEATURES), 0.0, np.full(FEATURES, 1e-8), 1e-8
    seldom = np.bincount(feature, minlength=FEATURES) < SELDOM
    for _ in range(epochs):
        margin = np.bincount(row, weights=weights[feature] * unit, minlength=len(n)) + bias
        gap = (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - target) / max(len(n), 1)
        g = np.bincount(feature, weights=gap[row] * unit, minlength=FEATURES) + decay * weights
        g[seldom] = 0
        square += g * g
        weights -= rate * g / np.sqrt(square)
        square_b += gap.sum() ** 2
        bias -= rate * gap.sum() / np.sqrt(square_b)
    return weights, float(bias)


def learn_insults(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Hashes of the words typical of texts labelled toxic, from about LABELLED_ROWS labelled texts; a word counts once a text."""

    def run(it: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in it:
            for b in batches(whole):
                raw, off = flat_bytes(b.column("text"))
                _, start, end, first = words(raw, off)
                x, y = cores(raw, start, end)
                core = span_hash(prefix_hash(_LOWER[raw]), x, y)
                toxic = np.array(b.column("toxic").to_pylist(), np.int64)
                doc = np.repeat(np.arange(len(toxic)), np.diff(first))
                core, doc = core[y > x], doc[y > x]
                order = np.lexsort((doc, core))
                core, doc = core[order], doc[order]
                once = np.ones(len(core), bool)
                once[1:] = (core[1:] != core[:-1]) | (doc[1:] != doc[:-1])
                core, doc = core[once], doc[once]
                u, inverse = np.unique(core, return_inverse=True)
                bad = np.bincount(inverse, weights=toxic[doc], minlength=len(u)).astype(np.int64)
                n = np.bincount(inverse, minlength=len(u))
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(bad), pa.array(n - bad)], names=["word", "toxic", "other"])

    toxic = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    part = min(1.0, LABELLED_ROWS / max(1, toxic.count()))
    toxic = toxic.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(part * (1 << 30))).limit(2 * LABELLED_ROWS)
    toxic = stored(toxic, "toxic")
    labelled = docs.select("doc_id", "text").join(F.broadcast(toxic), "doc_id").select("text", "toxic")  # at most 2 * LABELLED_ROWS rows
    n_toxic, n_other = toxic.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    if not n_toxic:
        return np.zeros(0, np.uint64)
    found = (
        labelled.mapInArrow(run, "word long, toxic long, other long")
        .groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
        .where((F.col("toxic") >= max(3.0, INSULT_SHARE * n_toxic)) & (F.col("toxic") * (n_other or 1) >= LIFT * (F.col("other") + 1) * n_toxic))
        .orderBy(F.desc("toxic"), "word").limit(MAX_INSULTS).collect()
    )
    return np.array([r.word for r in found], np.int64).view(np.uint64)


def fit(docs: DataFrame, labels: DataFrame | None = None) -> Model:
    """Label model from the votes on all texts, scorer from about FIT_ROWS of them.

    ``labels`` (doc_id, toxic) only teaches the insult labeller its words; the
    driver holds at most 3 ** labellers vote patterns, MAX_INSULTS words and
    the scorer's FEATURES weights.
    """
    insults = learn_insults(docs, labels) if labels is not None else np.zeros(0, np.uint64)

    def count(it: Iterator) -> Iterator:
        import pandas as pd

        seen: dict[tuple, int] = {}
        for whole in it:
            for b in batches(whole):
                total, signal, _, _ = signals(*flat_bytes(b.column("text")), insults)
                u, n = np.unique(votes(total, signal, len(insults) > 0), axis=1, return_counts=True)
                for p, c in zip(u.T.tolist(), n.tolist()):
                    seen[tuple(p)] = seen.get(tuple(p), 0) + c
        import pyarrow as pa

        yield pa.RecordBatch.from_pandas(pd.DataFrame({"pattern": ["".join(map(str, p)) for p in seen], "n": list(seen.values())}).astype({"pattern": str, "n": "int64"}), schema=pa.schema([("pattern", pa.string()), ("n", pa.int64())]), preserve_index=False)

    patterns = docs.select("text").mapInArrow(count, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    rows = sorted((r.pattern, r.n) for r in patterns)
    model = Model(insults, *estimate(np.array([[int(c) for c in p] for p, _ in rows] or np.zeros((0, len(LABELLERS))), np.int64), np.array([n for _, n in rows], float)))
    total = sum(n for _, n in rows)
    if not total:
        return model
    part = min(1.0, FIT_ROWS / total)
    sample = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(part * (1 << 30))).select("text").where("text is not null").limit(2 * FIT_ROWS)

    def learn(it: Iterator) -> Iterator:
        import pandas as pd

        parts, target, size = [], [], []
        for whole in it:
            for b in batches(whole):
                n, p, feature, at = model.read(*flat_bytes(b.column("text")))
                parts.append(feature.astype(np.int32))
                target.append(p)
                size.append(np.diff(at))
        if parts:
            w, bias = train(np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(size))]), np.concatenate(target))
            import pyarrow as pa

            yield pa.RecordBatch.from_pandas(pd.DataFrame({"weights": [w.astype("<f8").tobytes()], "bias": [bias]}), schema=pa.schema([("weights", pa.binary()), ("bias", pa.float64())]), preserve_index=False)

    got = sample.coalesce(1).mapInArrow(learn, "weights binary, bias double").first()
    if got:
        model.weights, model.bias = np.frombuffer(bytes(got.weights), "<f8"), got.bias
    return model


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` plus weak_reject (posterior of the label model), score (probability of a good text) and kept.

    Texts without a word (null, empty, blanks) score 0 and are not kept. Rows
    are independent: repeated rows get equal results. Existing columns of
    these names are replaced.
    """
    from pyspark.sql import types as T

    docs = docs.drop("weak_reject", "score", "kept")
    names = docs.columns
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("weak_reject", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())])

    def run(it: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in it:
            for b in batches(whole):
                total, weak, feature, at = sent.value.read(*flat_bytes(b.column("text")))
                score = np.where(total > 0, sent.value.score(feature, at), 0.0)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.where(total > 0, weak, 1.0)), pa.array(score), pa.array(score >= KEEP_FROM)], names=[*names, "weak_reject", "score", "kept"])

    return docs.mapInArrow(run, schema)
