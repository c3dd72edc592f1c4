"""Toxicity: a factorization machine over hashed terms.

score = sigmoid(b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), x_i = 1 for each term
of the text. The pairwise part sees what single terms do not say, such as an insult
next to the mention of a group. Fitted on a bounded sample of labelled rows, applied to
every whole text inside tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ramify.llm.labelled import labelled_sample, one_each

BUCKETS = 1 << 20
FACTORS = 8
TERMS_AT_ONCE = 100_000
SAMPLE_ROWS = 20_000  # bound of the labelled sample
# Terms fitted first, under a light penalty: they tell the labels apart, or are frequent.
LEAST_Z = 4.0
FREQUENT = 0.1
# Second step, on what the first leaves unexplained: all terms seen so often in the sample.
LEAST_SEEN = 3
RIDGE_WEIGHTS = 50.0
RIDGE_FACTORS = 600.0  # divided by a power of the rows that have the term
RIDGE_POWER = 0.6

# Bytes outside ASCII stay; letters in lower case, digits stay, the rest parts terms.
_TERMS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256)
)


def term_buckets(text: str | None) -> np.ndarray:
    """Hash buckets of the distinct terms of a whole text."""
    terms = set((text or "").encode("utf-8", "surrogatepass").translate(_TERMS).split())
    return (np.fromiter(map(crc32, terms), np.int64, len(terms)) % BUCKETS).astype(np.int32)


@dataclass
class FactorizationMachine:
    bias: float
    buckets: np.ndarray  # sorted
    weights: np.ndarray
    factors: np.ndarray

    def logits(self, rows: list[np.ndarray]) -> np.ndarray:
        known = []
        for terms in rows:
            if len(self.buckets):
                at = np.searchsorted(self.buckets, terms)
                at[at == len(self.buckets)] = 0
                known.append(np.unique(at[self.buckets[at] == terms]))
            else:
                known.append(np.empty(0, np.int64))
        return _logits(self.bias, self.weights, self.factors, known)


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of rows; empty runs give 0."""
    out = np.zeros((len(sizes), *values.shape[1:]))
    some = sizes > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[some], axis=0)
    return out


def _logits(bias: float, weights: np.ndarray, factors: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    sizes = np.array([len(r) for r in rows])
    terms = np.concatenate([np.empty(0, np.int64), *rows]).astype(np.int64)
    v = factors[terms]
    pairs = (_sums(v, sizes) ** 2 - _sums(v * v, sizes)).sum(axis=1) / 2
    return bias + _sums(weights[terms], sizes) + pairs


def _telling(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Buckets whose shares among the two labels differ by LEAST_Z standard errors, and frequent ones."""
    n, n1 = len(labels), labels.sum()
    seen, ones = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for row, label in zip(rows, labels):
        seen[row] += 1
        ones[row] += label
    buckets = np.flatnonzero(seen)
    seen, ones = seen[buckets], ones[buckets]
    share = (seen + 1) / (n + 2)
    gap = (ones + share) / (n1 + 1) - (seen - ones + share) / (n - n1 + 1)
    z = gap / np.sqrt(share * (1 - share) * (1 / (n1 + 1) + 1 / (n - n1 + 1)))
    return buckets[((np.abs(z) >= LEAST_Z) & (seen > 2)) | (seen >= FREQUENT * n)].astype(np.int32)


def fit(rows: list[np.ndarray], labels: np.ndarray, epochs: int = 30, rate: float = 0.1, decay: float = 3e-5) -> FactorizationMachine:
    """Logistic loss by AdaGrad in small batches, ridge penalty on weights and factors.

    First the telling terms alone, then all others too, on top of the first: see _widened.
    """
    labels = np.asarray(labels, float)
    if not labels.any():
        return FactorizationMachine(-np.inf, np.empty(0, np.int64), np.empty(0), np.empty((0, FACTORS)))
    buckets = _telling(rows, labels)
    fm = FactorizationMachine(0.0, buckets, np.empty(0), np.empty(0))
    known = []
    for r in rows:
        at = np.searchsorted(buckets, r)
        at[at == len(buckets)] = 0
        known.append(np.unique(at[buckets[at] == r]) if len(buckets) else np.empty(0, np.int64))
    random = np.random.default_rng(8)
    w, v = np.zeros(len(buckets)), random.normal(0, 0.01, (len(buckets), FACTORS))
    b, gb2 = float(np.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5))), 1e-6
    w2, v2 = np.full(len(buckets), 1e-6), np.full(v.shape, 1e-6)
    for _ in range(epochs):
        order = random.permutation(len(known))
        for at in range(0, len(order), 128):
            chosen = order[at : at + 128]
            batch = [known[i] for i in chosen]
            sizes = np.array([len(r) for r in batch])
            terms = np.concatenate(batch)
            error = 1 / (1 + np.exp(-np.clip(_logits(b, w, v, batch), -30, 30))) - labels[chosen]
            row = np.repeat(np.arange(len(batch)), sizes)
            each = error[row]
            total = _sums(v[terms], sizes)
            places, inverse = np.unique(terms, return_inverse=True)
            gw = np.bincount(inverse, each, len(places)) / len(batch) + decay * w[places]
            pull = each[:, None] * (total[row] - v[terms])
            gv = np.stack([np.bincount(inverse, pull[:, f], len(places)) for f in range(FACTORS)], axis=1) / len(batch)
            gv += decay * v[places]
            gb = error.mean()
            gb2 += gb * gb
            w2[places] += gw * gw
            v2[places] += gv * gv
            b -= rate * gb / np.sqrt(gb2)
            w[places] -= rate * gw / np.sqrt(w2[places])
            v[places] -= rate * gv / np.sqrt(v2[places])
    fm.bias, fm.weights, fm.factors = b, w, v
    return _widened(fm, rows, labels)


def _widened(first: FactorizationMachine, rows: list[np.ndarray], labels: np.ndarray, epochs: int = 20, rate: float = 0.1) -> FactorizationMachine:
    """``first`` and, for every term seen LEAST_SEEN times, a further weight and further factors.

    They learn from the errors of ``first``, so pairs of terms are found that alone tell
    nothing. Here the ridge penalty selects: it counts once per epoch whatever the number
    of rows, and rare terms pay more for factors, or they would learn single rows by heart.
    """
    seen = np.bincount(np.concatenate([np.empty(0, np.int64), *rows]).astype(np.int64), minlength=BUCKETS)
    old = np.zeros(BUCKETS, bool)
    old[first.buckets] = True
    buckets = np.flatnonzero((seen >= LEAST_SEEN) | old)
    place = np.full(BUCKETS, -1, np.int32)
    place[buckets] = np.arange(len(buckets))
    known = [at[at >= 0] for at in (place[r] for r in rows)]
    given, seen = first.logits(rows), seen[buckets]
    random = np.random.default_rng(9)
    w, v, b, gb2 = np.zeros(len(buckets)), random.normal(0, 0.01, (len(buckets), FACTORS)), 0.0, 1e-6
    w2, v2 = np.full(len(buckets), 1e-6), np.full(v.shape, 1e-6)
    batches = -(-len(rows) // 128)
    # A term is met in so many batches of an epoch; together they make up one penalty.
    met = batches * (1 - (1 - 1 / batches) ** seen)
    ridge_w, ridge_v = RIDGE_WEIGHTS / met / 128, (RIDGE_FACTORS * seen**-RIDGE_POWER / met / 128)[:, None]
    for _ in range(epochs):
        order = random.permutation(len(known))
        for at in range(0, len(order), 128):
            chosen = order[at : at + 128]
            batch = [known[i] for i in chosen]
            sizes, terms = np.array([len(r) for r in batch]), np.concatenate(batch)
            mine = v[terms]
            total = _sums(mine, sizes)
            logits = given[chosen] + b + _sums(w[terms], sizes) + (total**2 - _sums(mine * mine, sizes)).sum(axis=1) / 2
            error = 1 / (1 + np.exp(-np.clip(logits, -30, 30))) - labels[chosen]
            row = np.repeat(np.arange(len(batch)), sizes)
            by_term = np.argsort(terms, kind="stable")
            places, counts = np.unique(terms, return_counts=True)
            gw = _sums(error[row][by_term], counts) / len(batch) + ridge_w[places] * w[places]
            gv = _sums((error[row][:, None] * (total[row] - mine))[by_term], counts) / len(batch) + ridge_v[places] * v[places]
            gb = error.mean()
            gb2 += gb * gb
            w2[places] += gw * gw
            v2[places] += gv * gv
            b -= rate * gb / np.sqrt(gb2)
            w[places] -= rate * gw / np.sqrt(w2[places])
            v[places] -= rate * gv / np.sqrt(v2[places])
    # Sums of products over both kinds of factors: the two machines added.
    both = np.concatenate([np.zeros((len(buckets), first.factors.shape[1])), v], axis=1)
    at = np.searchsorted(buckets, first.buckets)
    both[at, : first.factors.shape[1]] = first.factors
    w[at] += first.weights
    return FactorizationMachine(first.bias + b, buckets.astype(np.int32), w, both)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> FactorizationMachine:
    """The machine for ``labels.toxic``; at most ``rows`` documents reach the driver.

    A doc_id with several labels counts once, as toxic if any label is; of several texts
    it has one, chosen by hash.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [np.unique(term_buckets(t.as_py())) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(terms, pa.list_(pa.int32())), batch.column(3)], names=["doc_id", "_text", "terms", "label"])

    sample = labelled_sample(docs, labels, "toxic", rows)
    table = one_each(sample.mapInArrow(work, f"doc_id {kind}, _text bigint, terms array<int>, label int")).toArrow()
    lists = table.column("terms").combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.int32()))
    values, bounds = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    terms = [values[x:y] for x, y in zip(bounds[:-1], bounds[1:])]  # views
    # A fixed order makes the fit repeatable.
    order = sorted(range(len(terms)), key=lambda i: (len(terms[i]), crc32(terms[i])))
    marks = table.column("label").to_numpy()
    return fit([terms[i] for i in order], marks[order] if order else np.empty(0))


def scores(model: FactorizationMachine, texts: Iterable[str | None]) -> np.ndarray:
    """Toxicity of whole texts, TERMS_AT_ONCE at a time, however long they are."""
    logits, waiting, size = [np.empty(0)], [], 0
    for text in texts:
        waiting.append(term_buckets(text))
        size += len(waiting[-1])
        if size >= TERMS_AT_ONCE:
            logits.append(model.logits(waiting))
            waiting, size = [], 0
    if waiting:
        logits.append(model.logits(waiting))
    found = np.concatenate(logits)
    return np.where(np.isneginf(found), 0.0, 1 / (1 + np.exp(-np.clip(found, -700, 700))))


def toxicity(model: FactorizationMachine, text: Column) -> Column:
    """Score of a column of whole texts. Only the texts go to Python, and only scores come back."""

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(scores(model, (t.as_py() for t in texts)))

    return scored(text)


def score(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """``docs`` with toxicity (0 to 1), over whole texts.

    Null and empty texts get the score of a text without terms; repeated rows each get
    theirs; an empty table stays empty. Without toxic rows to learn from the score is 0.
    """
    return docs.drop("toxicity").withColumn("toxicity", toxicity(model, F.col("text")))


def drop_toxic(docs: DataFrame, model: FactorizationMachine, threshold: float = 0.5) -> DataFrame:
    """``docs`` without those that score at or above ``threshold``; same columns; edges as in ``score``."""
    return docs.filter(toxicity(model, F.col("text")) < threshold)
