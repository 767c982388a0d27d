"""Quality classifier: ordinal cumulative-link (proportional odds) regression on graded ratings.

P(grade <= k) = logistic(t_k - w.x): one weight vector w over hashed text features for all grades, and ordered thresholds
t_1 < t_2 < ... between them. A document gets its expected grade and the tail probability of the grade that selection asks
for. Features are hashed words (A-Z in lower case) and pairs of words, hashed word forms (runs of lower-case letters, capitals, digits and
each punctuation mark, folded: texts of any language give the same forms, so weights carry over to words never seen) and pairs of
forms, repeats of the word before, and the shares of repeated lines and repeated runs of three words.

The grades of the query are those of rating(): a labelled row of quality 0 has grade 0, one of quality 1 grade 1 if it is marked toxic,
else 2. Selection asks for grade 1 or more, that is for quality 1. Any column of whole or fractional ratings can take their place.

Cases. Null texts are graded as empty. Ties: a tail probability of exactly select_at is selected. A doc_id with several labels counts
with the largest, null labels do not count, labels of one grade only give a model that always says it, no labels one that selects
all. Repeated rows give repeated rows; other columns are not read; empty tables give no rows. Very long texts take linear time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haystrata.llm.common import LOWER, flat, grouped, labelled_sample, mix, owner, pieces, windows, word_hashes, words

#: Bound of the training sample: rows of each grade.
ROWS_PER_GRADE = 3000
#: Buckets of hashed words, pairs of words, forms and pairs of forms.
BUCKETS = (1024, 512, 512, 512)
N_FEATURES = sum(BUCKETS) + 4
#: Texts whose features a worker holds at once, 10 kB each.
PIECE_ROWS = 256
#: Selection: the grade, and the probability of at least that grade, that a document needs.
SELECT_GRADE = 1
SELECT_AT = 0.5
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = _CLASS[128:] = ord("a")
_CLASS[65:91] = ord("A")
_CLASS[48:58] = ord("9")


def _shares(n: np.ndarray, of: np.ndarray) -> np.ndarray:
    return np.divide(n, of, out=np.zeros(len(n)), where=of > 0)


def _pairs(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pair, at = windows(h, first, 2)
    return pair, owner(first, at)


def features(texts: pa.Array) -> np.ndarray:
    """One row of N_FEATURES for each text: square roots of shares, so rows are about unit length at any text size."""
    data, offs = flat(texts)
    starts, ends, first = words(data, offs)
    n_docs, n_words = len(offs) - 1, np.diff(first)
    folded = _CLASS[data]
    new = np.ones(len(data), bool)
    new[1:] = folded[1:] != folded[:-1]
    new[starts] = True
    place = np.concatenate([[0], np.cumsum(new)])
    form = word_hashes(folded[new], place[starts], place[ends])
    low = word_hashes(LOWER[data], starts, ends)
    raw = word_hashes(data, starts, ends)
    doc = owner(first, np.arange(len(starts)))
    buckets = sum(BUCKETS)
    out = np.zeros((n_docs, N_FEATURES), np.float32)
    base = 0
    for n, (h, d) in zip(BUCKETS, ((low, doc), _pairs(low, first), (form, doc), _pairs(form, first))):
        at = d * n + (mix(h) % np.uint64(n)).astype(np.int64)
        out[:, base : base + n] = np.sqrt(np.bincount(at, minlength=n_docs * n).reshape(n_docs, n) / np.maximum(n_words, 1)[:, None])
        base += n
    same = np.zeros(len(raw), np.int64)
    if len(raw) > 1:
        same[1:] = (raw[1:] == raw[:-1]) & (doc[1:] == doc[:-1])
    out[:, buckets] = np.sqrt(_shares(np.bincount(doc, same, n_docs), n_words))
    h, at = windows(raw, first, 3)
    d = owner(first, at)
    key = np.unique(mix(h ^ (d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), return_index=True)[1]
    fresh = np.bincount(d[key], minlength=n_docs)
    out[:, buckets + 1] = np.sqrt(np.maximum(0, 1 - _shares(fresh, np.maximum(n_words - 2, 0)))) * (n_words > 2)
    lines = [[y for y in (x or "").split("\n") if y.strip()] for x in texts.to_pylist()]
    out[:, buckets + 2] = [np.sqrt(1 - len(set(x)) / len(x)) if x else 0.0 for x in lines]
    out[:, buckets + 3] = np.log1p(n_words) / 10
    return out


@dataclass
class Model:
    """Grades in order, the weights they share, and the thresholds between them."""

    grades: list[float]
    weights: np.ndarray
    cuts: np.ndarray

    def tails(self, x: np.ndarray) -> np.ndarray:
        """P(grade >= each grade but the lowest), one column each."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - (x @ self.weights)[:, None], -60, 60)))

    def expected(self, tails: np.ndarray) -> np.ndarray:
        return self.grades[0] + tails @ np.diff(np.array(self.grades, float))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1e-4, steps: int = 250) -> Model:
    """Maximum likelihood with a small ridge by Adam on w and the logs of the threshold gaps. One grade only: a model that always says it."""
    grades = sorted(set(y.tolist()))
    if len(grades) < 2:
        return Model(grades or [0], np.zeros(x.shape[1]), np.zeros(0))
    k = np.searchsorted(grades, y)
    weight = np.ones(len(y)) if weight is None else weight
    weight = weight / weight.sum()
    share = np.cumsum(np.bincount(k, weight, len(grades)))[:-1].clip(1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    theta = np.concatenate([np.zeros(x.shape[1]), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    nf, rows = x.shape[1], np.arange(len(y))
    for step in range(1, steps + 1):
        gaps = np.exp(theta[nf + 1 :])
        cuts = theta[nf] + np.concatenate([[0], np.cumsum(gaps)])
        z = (x @ theta[:nf].astype(x.dtype)).astype(float)
        cdf = np.ones((len(y), len(grades) + 1))
        cdf[:, 0] = 0
        cdf[:, 1:-1] = 1 / (1 + np.exp(np.clip(z[:, None] - cuts, -60, 60)))
        p = np.maximum(cdf[rows, k + 1] - cdf[rows, k], 1e-12)
        slope = cdf * (1 - cdf)
        dz = weight * (slope[rows, k + 1] - slope[rows, k]) / p  # of the loss by z
        g = np.zeros_like(theta)
        g[:nf] = x.T @ dz.astype(x.dtype) + l2 * theta[:nf]
        dc = np.array([-(weight * slope[:, j + 1] * ((k == j).astype(float) - (k == j + 1)) / p).sum() for j in range(len(cuts))])
        g[nf] = dc.sum()
        for j in range(len(gaps)):
            g[nf + 1 + j] = dc[j + 1 :].sum() * gaps[j]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(grades, theta[:nf].copy(), theta[nf] + np.concatenate([[0], np.cumsum(np.exp(theta[nf + 1 :]))]))


def rating(labels: DataFrame):
    """The grade of a row of labels (quality 0 or 1, toxic 0 or 1 if there is such a column): 0 for poor, 1 for good but toxic, 2 for good. Null without a quality."""
    good = F.when(F.col("toxic") > 0, 1).otherwise(2) if "toxic" in labels.columns else 2
    return F.when(F.col("quality") <= 0, 0).when(F.col("quality") > 0, good)


def train(docs: DataFrame, labels: DataFrame, value=None, rows_per_grade: int = ROWS_PER_GRADE, where=None) -> Model:
    """Fitted on the bounded sample of labelled rows; grades count as often as all labels have them. Without labels: a model that selects all.

    value: the column of ratings; None: rating(). Executors make the features; the driver gets rows_per_grade x N_FEATURES half-precision numbers a grade.
    """
    sample, counts = labelled_sample(docs, labels, rating(labels) if value is None else value, rows_per_grade, where)
    schema = pa.schema([("y", pa.float64()), ("x", pa.binary())])

    def one(batch):
        return {"y": batch.column(1), "x": [x.tobytes() for x in features(batch.column(0)).astype(np.float16)]}

    rows = sorted(map(tuple, sample.mapInArrow(lambda it: grouped(it, "text", schema, one, PIECE_ROWS), "y double, x binary").collect()))
    if not rows:
        return Model([0], np.zeros(N_FEATURES), np.zeros(0))
    x = np.stack([np.frombuffer(b, np.float16) for _, b in rows]).astype(np.float32)
    y = np.array([v for v, _ in rows])
    grades, at = np.unique(y, return_inverse=True)
    return fit(x, y, (np.array([counts[g] for g in grades]) / np.bincount(at))[at])


def tail(model: Model, tails: np.ndarray, grade: float) -> np.ndarray:
    """P(at least this grade): of the model's lowest grade that is no lower; the highest grade of models without such."""
    at = min(int(np.searchsorted(model.grades, grade)), len(model.grades) - 1)
    return np.ones(len(tails)) if at == 0 else tails[:, at - 1]


def grade(docs: DataFrame, model: Model, select_grade: float = SELECT_GRADE, select_at: float = SELECT_AT) -> DataFrame:
    """(doc_id, expected_grade, tail_probability, selected), one row for each row of docs. Null texts are graded as empty ones."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # N_FEATURES weights
    schema = pa.schema([("doc_id", pa.int64()), ("expected_grade", pa.float64()), ("tail_probability", pa.float64()), ("selected", pa.bool_())])

    def one(batch):
        m = shared.value
        tails = m.tails(features(batch.column(1)))
        p = tail(m, tails, select_grade)
        return {"doc_id": batch.column(0), "expected_grade": m.expected(tails), "tail_probability": p, "selected": p >= select_at}

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(lambda it: grouped(it, "text", schema, one, PIECE_ROWS), "doc_id long, expected_grade double, tail_probability double, selected boolean")


def select_quality(docs: DataFrame, model: Model, select_grade: float = SELECT_GRADE, select_at: float = SELECT_AT) -> DataFrame:
    """The rows of docs, all columns, whose own text the model selects."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "text", rows=PIECE_ROWS):
                m = shared.value
                tails = m.tails(features(piece.column(piece.schema.get_field_index("text"))))
                yield piece.filter(pa.array(tail(m, tails, select_grade) >= select_at))

    return docs.mapInArrow(run, docs.schema)
