"""Quality from positives and unlabelled text: non-negative unbiased risk.

With class prior p, the risk of a classifier g on negatives is E_u[loss(-g)] minus
p * E_p[loss(-g)]; both can be estimated without a single trusted negative. On a finite
sample that difference turns negative when g overfits, so it is held at zero.

The loss is (1 - z)^2 and g is linear in an expansion of 30 figures of the whole text
(shares of character kinds, repetition of words, phrases and lines, compressibility). So
the risk needs only the first and second moments of the expansion, which are sums over
all unlabelled documents, made in the tasks; only trusted positives are a bounded sample.
Labelled negatives are not used at all.

The class prior is estimated from positives and unlabelled text: a classifier fitted on
one half of the positives scores the other half and all documents. Above any score the
share of documents is at least p times the share of positives, with equality where no
negatives score as high, so the least ratio of the two shares bounds p.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ramify.llm.labelled import labelled_ids, one_each
from ramify.llm.staging import staged

SAMPLE_ROWS = 20_000  # bound of the trusted positives
HIDDEN = 64
RIDGE = 0.01
PRIOR_ROUNDS = 3
THRESHOLDS = 200  # of scores, for the prior

_KINDS = np.zeros((256, 12))
for _i, _chars in enumerate((
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n",
    b".", b",", b"!?", b"*#%$&", b"|", b"{}[]()<>/\\_=+;:\"'`~^@-", bytes(range(128, 256)),
)):
    _KINDS[list(_chars), _i] = 1
SYMBOLS = np.array([bytes([c]).isalnum() or c in b" \n.,-'" or c >= 128 for c in range(256)])
FEATURES = 12 + 18


def features(text: str | None) -> np.ndarray:
    """Figures of a whole text; zeros for one without words."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    out = np.zeros(FEATURES)
    if not words:
        return out
    n, m = len(data), len(words)
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    out[:12] = np.sqrt(seen @ _KINDS / n)
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:]))) if m > 1 else 1
    lines = [x for x in data.split(b"\n") if x.strip()]
    lengths = np.fromiter(map(len, words), np.int64, m)
    top = sorted(counts.values())[-3:]
    sides = Counter(w[-1] for w in words)
    odd_ends = sum(v for c, v in sides.items() if not SYMBOLS[c])
    capitals = sum(1 for w in counts if w.isupper() and len(w) > 1)
    adjacent = sum(a == b for a, b in zip(words, words[1:]))
    out[12:] = (
        np.log1p(n), np.log1p(m), lengths.mean() / 10, np.log1p(lengths.std()), np.log1p(lengths.max()),
        len(counts) / m, np.log(len(counts)) / np.log(m + 1), pairs / max(1, m - 1),
        top[-1] / m, sum(top) / m, adjacent / m, odd_ends / m, capitals / len(counts),
        len(set(lines)) / len(lines), np.log1p(n / len(lines)), np.log1p(m / len(lines)),
        len(zlib.compress(data, 1)) / (n + 20), sides.get(46, 0) / m,
    )
    return out


@dataclass
class Expansion:
    """Standardised figures, a constant before them and fixed random directions after."""

    mean: np.ndarray
    scale: np.ndarray

    def __post_init__(self):
        random = np.random.default_rng(7)
        self.directions = random.normal(0, 1 / np.sqrt(FEATURES), (FEATURES, HIDDEN))
        self.shifts = random.normal(0, 0.5, HIDDEN)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([np.ones((len(z), 1)), z, np.tanh(z @ self.directions + self.shifts)], axis=1)


@dataclass
class Quality:
    prior: float
    expansion: Expansion
    weights: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Twice the value of g, which estimates P(good) - P(bad)."""
        return 2 * (self.expansion(x) @ self.weights)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _moments(wide: np.ndarray) -> np.ndarray:
    """Second moments; the first column is constant, so the first row holds the means."""
    return wide.T @ wide / len(wide)


def least_risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> np.ndarray:
    """Weights of the least p * E_p[(1 - g)^2] + max(0, E_u[(1 + g)^2] - p * E_p[(1 + g)^2]).

    The maximum is that of t times the difference over t from 0 to 1, and for every t the
    sum is a convex quadratic; the t wanted is 1, or the largest that keeps the
    difference from turning negative.
    """
    ridge = RIDGE * np.eye(len(positive))
    ridge[0, 0] = 1e-9

    def weights(t: float) -> np.ndarray:
        bent = prior * (1 - t) * positive + t * unlabelled + ridge
        return np.linalg.solve(bent, prior * positive[0] - t * (unlabelled[0] - prior * positive[0]))

    def negative(w: np.ndarray) -> float:
        on_u, on_p = (w @ m @ w + 2 * m[0] @ w + 1 for m in (unlabelled, positive))
        return on_u - prior * on_p

    found = weights(1.0)
    if negative(found) >= 0:
        return found
    low, high = 0.0, 1.0
    for _ in range(40):
        middle = (low + high) / 2
        low, high = (middle, high) if negative(weights(middle)) >= 0 else (low, middle)
    return weights(low)


def fit(positives: np.ndarray, unlabelled: np.ndarray, prior: float) -> Quality:
    """The classifier for a known prior, from figures in memory."""
    expansion = Expansion(unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-6)
    return Quality(prior, expansion, least_risk(_moments(expansion(positives)), _moments(expansion(unlabelled)), prior))


def least_ratio(above_u: np.ndarray, n_u: int, above_p: np.ndarray, n_p: int) -> float:
    """Prior from the numbers of documents and of positives at or above each threshold.

    Shares of few rows are uncertain, so the threshold is the one of the least upper
    confidence bound (90 %), and the ratio there is the estimate, within 0.02 and 0.98.
    """
    doubt = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(n_u) + 1 / np.sqrt(n_p))
    at = np.argmin((above_u / n_u + doubt) / (above_p / n_p))
    return float(np.clip(above_u[at] / n_u / (above_p[at] / n_p), 0.02, 0.98))


def figures(docs: DataFrame) -> DataFrame:
    """doc_id, _text (hash of the text) and x, the figures of the whole text, for every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "_text", "x"])

    return docs.select("doc_id", F.xxhash64("text").alias("_text"), "text").mapInArrow(work, f"doc_id {kind}, _text bigint, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, FEATURES)


def _summed(found: DataFrame, width: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of ``part(x)``, a vector of ``width``, over all rows: one vector a task, added by Spark."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                total += part(_matrix(batch.column(0).slice(at, 4096)))
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(total)], names=["at", "v"])

    added = found.select("x").mapInArrow(work, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    total = np.zeros(width)
    total[added.column("at").to_numpy()] = added.column("v").to_numpy()
    return total


def _estimated_prior(found: DataFrame, expansion: Expansion, wide: np.ndarray, unlabelled: np.ndarray, n: int) -> float:
    """Prior by rounds of fits on half of the positives, judged by the other half."""
    halves = [wide[::2], wide[1::2]] if len(wide) > 1 else [wide, wide]
    prior = 0.5
    for _ in range(PRIOR_ROUNDS):
        weights = [least_risk(_moments(h), unlabelled, prior) for h in halves]
        judged = [other @ w for w, other in zip(weights, reversed(halves))]
        steps = [np.unique(np.quantile(g, np.linspace(0, 0.99, THRESHOLDS))) for g in judged]

        def above(x: np.ndarray, weights=weights, steps=steps) -> np.ndarray:
            grown = expansion(x)
            out = np.zeros(2 * THRESHOLDS)
            for k in (0, 1):
                g = np.sort(grown @ weights[k])
                out[k * THRESHOLDS : k * THRESHOLDS + len(steps[k])] = len(g) - np.searchsorted(g, steps[k])
            return out

        counts = _summed(found, 2 * THRESHOLDS, above).reshape(2, THRESHOLDS)
        prior = float(np.mean([least_ratio(c[: len(s)], n, (g[:, None] >= s).sum(axis=0), len(g)) for c, s, g in zip(counts, steps, judged)]))
    return prior


def learn(found: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Quality | None:
    """The classifier from a written table of ``figures``; see ``train``."""
    sample = found.join(F.broadcast(labelled_ids(labels.filter("quality = 1"), "quality", rows)), "doc_id")
    table = one_each(sample.select("doc_id", "_text", "x")).toArrow()
    if not table.num_rows:
        return None
    x = _matrix(table.column("x").combine_chunks())
    x = x[np.lexsort(x.T)]  # a fixed order makes the fit repeatable
    sums = _summed(found, 1 + 2 * FEATURES, lambda x: np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)]))
    n, mean = int(sums[0]), sums[1 : 1 + FEATURES] / sums[0]
    expansion = Expansion(mean, np.sqrt(np.maximum(sums[1 + FEATURES :] / n - mean * mean, 0)) + 1e-6)
    width = 1 + FEATURES + HIDDEN
    unlabelled = _summed(found, width * width, lambda x: (lambda w: (w.T @ w).ravel())(expansion(x))).reshape(width, width) / n
    wide = expansion(x)
    prior = _estimated_prior(found, expansion, wide, unlabelled, n)
    return Quality(prior, expansion, least_risk(_moments(wide), unlabelled, prior))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Quality | None:
    """The classifier for ``labels.quality``; None without positives to learn from.

    The figures of at most ``rows`` documents labelled 1, first by hash of the id, go to
    the driver; a doc_id counts once there, with one of its texts. All rows of ``docs``
    are the unlabelled text, of which sums go there. Labels other than 1 are not used.
    """
    return learn(staged(figures(docs), "figures"), labels, rows)


def scored(found: DataFrame, model: Quality | None) -> DataFrame:
    """doc_id and score of every row of ``figures``; see ``score``."""
    kind = found.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            scores = np.full(len(x), 0.5) if model is None else _sigmoid(model.logits(x))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["doc_id", "score"])

    return found.select("doc_id", "x").mapInArrow(work, f"doc_id {kind}, score double")


def score(docs: DataFrame, model: Quality | None) -> DataFrame:
    """doc_id and score (0 to 1) of every row, over whole texts.

    Null and empty texts get the score of all-zero figures; repeated rows each get
    theirs; an empty table stays empty; other columns are ignored. Without a model the
    score is 0.5.
    """
    return scored(figures(docs), model)
