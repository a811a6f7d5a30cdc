"""Quality classifier by positive-unlabelled learning.

Trusted positives are rows labelled 1 outside the held-out fold; unlabelled rows are any documents outside it, whatever
their labels. The model is additive: each measure of a text is cut into bins at quantiles of the training sample, and a
weight is learnt for each bin. Two measures are of the content: the mean log ratio of a text's words, and of its pairs of
words, in positives against unlabelled texts, by hashed slots; training texts get theirs from the other half of the sample.
Weights minimise the non-negative unbiased risk (logistic loss): the prior times the loss of the positives, plus what is left
of the unlabelled rows' loss as negatives after the positives' share is taken off, not below zero.

The class prior is estimated from positives and unlabelled rows alone: where a first model's scores are so high that no
negatives are left, the unlabelled rows' share over the positives' share is the prior, and lower down it is larger, so the
least ratio over thresholds that nine in ten positives pass is taken.

Training takes SAMPLE rows of each kind at most, those with the least hash of doc_id; scoring covers every row.

Defined cases: null and empty texts get a score like any other; null doc_ids aren't held out and don't train; repeated
rows score alike; without positives or documents every score is a half; other columns are ignored; a very long text is
measured whole, in one task.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX2, mapped, materialise, mix64, session, table, text_bytes, word_hashes

SAMPLE = 10_000
#: Share of the positives that has to be above a threshold from which the prior is estimated.
PASSING = 0.9
BINS = 12
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2
_ALPHA, _UPPER, _DIGIT, _SPACE, _HIGH, _MARK = range(6)
_KIND = np.array([_UPPER if 65 <= b <= 90 else _ALPHA if 97 <= b <= 122 else _DIGIT if 48 <= b <= 57 else _SPACE if b in (32, 9, 10, 11, 12, 13) else _HIGH if b > 127 else _MARK for b in range(256)])
_ONE_HOT = np.eye(6)[_KIND]
_SENTENCE = re.compile(rb"[.!?]+\s")


def measures(text: bytes) -> list[float]:
    """Shares and means that hold for any language and length."""
    words = text.split()
    n, size = len(words), len(text)
    bytes_ = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    kinds = bytes_ @ _ONE_HOT / max(size, 1)
    share = bytes_[bytes_ > 0] / max(size, 1)
    distinct = set(words)
    pairs = set(zip(words, words[1:], strict=False))
    lines = text.splitlines()
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [
        np.log1p(size), np.log1p(n), *kinds.tolist(), float(-(share * np.log(share)).sum()), size / max(n, 1),
        len(distinct) / max(n, 1), len(distinct) / max(n, 1) ** 0.8, len(pairs) / max(n - 1, 1), same / max(n - 1, 1), len(set(lines)) / max(len(lines), 1),
        len(lines) / max(n, 1), n / (1 + len(_SENTENCE.findall(text))), float(bytes_[[33, 35, 36, 37, 38, 42]].sum()) / max(n, 1), bytes_[124] / max(n, 1), bytes_[46] / max(n, 1), bytes_[44] / max(n, 1),
    ]


#: Slots of words, and as many of pairs.
SLOTS = 1 << 16
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def slots(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For words and for pairs of neighbours: the slot of each, and which text it is of."""
    data = np.frombuffer(b" ".join(t.lower() for t in texts), np.uint8)
    word = np.zeros(len(data) + 2, bool)
    word[1:-1] = ~_SPACE[data]
    starts, ends = np.flatnonzero(word[1:] & ~word[:-1]), np.flatnonzero(~word[1:] & word[:-1])
    h = word_hashes(data, starts, ends)
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, "right")
    pair = mix64(h[:-1] * MIX2 + h[1:])[owner[:-1] == owner[1:]]
    return [((x >> np.uint64(48)).astype(np.int64), o) for x, o in ((h, owner), (pair, owner[:-1][owner[:-1] == owner[1:]]))]


def content(texts: list[bytes], ratios: np.ndarray) -> np.ndarray:
    """The mean of ratios (words and pairs by slot) of each text; 0 for a text without any."""
    out = np.zeros((len(texts), 2))
    for k, (slot, owner) in enumerate(slots(texts)):
        n = np.bincount(owner, minlength=len(texts))
        out[:, k] = np.bincount(owner, ratios[k][slot], len(texts)) / np.maximum(n, 1)
    return out


def log_ratios(positive: np.ndarray, unlabelled: np.ndarray) -> np.ndarray:
    """Counts of slots (words, pairs) -> logarithm of how much likelier a slot is in positives, drawn towards 0."""
    p, u = (c + 5 * (positive + unlabelled + 1) / (positive + unlabelled + 1).sum(axis=1, keepdims=True) * 1000 for c in (positive, unlabelled))
    return np.log(p / p.sum(axis=1, keepdims=True)) - np.log(u / u.sum(axis=1, keepdims=True))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Scores of both -> the least ratio of the shares above a threshold, of those that PASSING of the positives pass: higher
    up, where the training positives' scores run ahead of other positives', ratios fall below the prior."""
    if not len(positive) or not len(unlabelled):
        return 0.5
    at = np.quantile(positive, np.linspace(0.0, 1 - PASSING, 21))
    share = lambda x: 1 - np.searchsorted(np.sort(x), at, "left") / len(x)
    return float(np.clip((share(unlabelled) / share(positive)).min(), 0.02, 0.98))


class Model:
    """Bins of each measure, a weight for each bin, and an offset."""

    ratios = np.zeros((2, SLOTS))

    def measured(self, texts: list[bytes]) -> np.ndarray:
        return np.column_stack([np.array([measures(t) for t in texts]), content(texts, self.ratios)]) if texts else np.zeros((0, 0))

    def __init__(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, seed: int = 0):
        both = np.concatenate([positive, unlabelled])
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in both.T] if len(both) else []
        self.first = np.cumsum([0, *(len(e) + 1 for e in self.edges)])
        self.weights, self.offset = np.zeros(self.first[-1]), float(np.log(prior / (1 - prior)))
        if not len(positive) or not len(unlabelled):
            return
        p, u = self.bins(positive), self.bins(unlabelled)
        m, v = np.zeros(len(self.weights) + 1), np.zeros(len(self.weights) + 1)
        for t in range(1, steps + 1):
            sp, su = self.logistic(p), self.logistic(u)
            loss = np.logaddexp(0, self.raw(u)).mean() - prior * np.logaddexp(0, self.raw(p)).mean()
            gp, gu = prior * (sp - 1) / len(p), su / len(u)
            rest = (gu, -prior * sp / len(p))
            if loss < 0:  # the risk of the negatives can't be below zero: only bring it back up
                gp, rest = np.zeros(len(p)), (-rest[0], -rest[1])
            g = np.append(np.bincount(p.ravel(), np.repeat(gp + rest[1], p.shape[1]), len(self.weights)) + np.bincount(u.ravel(), np.repeat(rest[0], u.shape[1]), len(self.weights)) + 1e-4 * self.weights, (gp + rest[1]).sum() + rest[0].sum())
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
            self.weights -= step[:-1]
            self.offset -= step[-1]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, c, "right") + f for e, c, f in zip(self.edges, x.T, self.first, strict=False)]).astype(np.int64)

    def raw(self, bins: np.ndarray) -> np.ndarray:
        return self.weights[bins].sum(axis=1) + self.offset

    def logistic(self, bins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(bins), -30, 30)))

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.logistic(self.bins(x)) if self.edges else np.full(len(x), 1 / (1 + np.exp(-self.offset)))


def fold(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % FOLDS


def _slot_counts(batches):
    """kind, half, slot (pairs after words), n."""
    total = np.zeros((2, 2, 2, SLOTS), np.int64)
    for b in batches:
        kind, half = (b.column(c).to_numpy() for c in ("kind", "half"))
        for k, (slot, owner) in enumerate(slots(b.column("text").to_pylist())):
            np.add.at(total, (kind[owner], half[owner], k, slot), 1)
    at = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (at[0], at[1], at[2] * SLOTS + at[3], total[at])], ["kind", "half", "slot", "n"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """docs: doc_id, text; labels: doc_id, quality, of which only those of 1 are used."""
    spark = session(docs)
    base = text_bytes(docs)

    def some(ids: DataFrame, kind: int) -> DataFrame:
        ids = ids.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct().orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id").limit(sample)
        return base.join(F.broadcast(ids), "doc_id", "left_semi").select(F.lit(kind).alias("kind"), F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)).cast("int").alias("half"), "text")

    both = materialise(some(labels.where((fold() != HELD_OUT) & (F.col("quality") == 1)), 1).unionByName(some(docs.where(fold() != HELD_OUT), 0)))
    counted = mapped(both, _slot_counts, "kind long, half long, slot long, n long").groupBy("kind", "half", "slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((2, 2, 2, SLOTS))
    kind, half, slot, n = (counted[c].to_numpy() for c in ("kind", "half", "slot", "n"))
    counts[kind, half, slot // SLOTS, slot % SLOTS] = n
    other = [log_ratios(counts[1, 1 - h], counts[0, 1 - h]) for h in (0, 1)]
    sent = spark.sparkContext.broadcast(other)  # four tables of SLOTS

    def measured(batches):
        for b in batches:
            texts, half = b.column("text").to_pylist(), b.column("half").to_numpy()
            x = np.column_stack([np.array([measures(t) for t in texts]), np.where((half == 0)[:, None], content(texts, sent.value[0]), content(texts, sent.value[1]))]) if texts else np.zeros((0, 0))
            yield pa.RecordBatch.from_arrays([b.column("kind"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["kind", "x"])

    got = mapped(both, measured, "kind int, x array<double>").toArrow()  # SAMPLE rows of each kind
    rows = [np.array(sorted(x for x, k in zip(got["x"].to_pylist(), got["kind"].to_pylist(), strict=True) if k == kind)) for kind in (1, 0)]
    positive, unlabelled = (x if len(x) else np.zeros((0, 0)) for x in rows)
    first = Model(positive, unlabelled, 0.5)
    prior = estimate_prior(first.score(positive), first.score(unlabelled)) if len(positive) and len(unlabelled) else 0.5
    model = Model(positive, unlabelled, prior)
    model.prior, model.ratios = prior, log_ratios(counts[1].sum(axis=0), counts[0].sum(axis=0))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    sent = session(docs).sparkContext.broadcast(model)

    def apply(batches):
        for b in batches:
            x = sent.value.measured(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sent.value.score(x) if len(x) else [], pa.float64())], ["doc_id", "score"])

    got = mapped(text_bytes(docs), apply, "doc_id long, score double")
    return got.select("doc_id", F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
