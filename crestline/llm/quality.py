"""Quality scores by Bradley-Terry ranking of document pairs.

A text is described by numbers that do not depend on its length: shares of ASCII
characters, of hashed byte pairs, and a few shares over words and lines. Weights are
learned on the driver from preference pairs (a document of label 1 over one of label
0) by logistic loss on the difference of their features. The documents fitted on are
a sample of at most `most_rows` labelled ones, those with the smallest hash, in the order of their ids, so
that neither files nor tasks have an influence on the model. The
threshold is the quantile of the learned scores that leaves the labelled share of
good documents above it; score = sigmoid(utility - threshold).

Defined results: a null text counts as empty and gets a score like any other; a
repeated row is scored each time; a label that is null or belongs to no document is
left out; of documents that repeat an id the one with the least features is learned from; without both labels in the sample every score is the share of good labels
(0.5 with none); an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline.llm.arrow_text import row_spans, text_bytes

PAIR_BUCKETS = 256
N_FEATURES = 128 + PAIR_BUCKETS + 6
SPAN_BYTES = 4_000_000


@dataclass(frozen=True)
class RankModel:
    """weights over scaled features; utility above threshold is a good document."""

    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    base: float | None = None

    def scores(self, features: np.ndarray) -> np.ndarray:
        if self.base is not None:
            return np.full(len(features), self.base)
        # summed row by row, so that a score does not depend on its neighbours
        utility = ((features - self.center) / self.scale * self.weights).sum(1)
        return 1 / (1 + np.exp(-np.clip(utility - self.threshold, -500, 500)))


def features(column: pa.Array) -> np.ndarray:
    """A row of N_FEATURES numbers for each text."""
    raw, ends = text_bytes(column)
    n, sizes = len(column), np.diff(ends)
    out = np.zeros((n, N_FEATURES))
    row = np.repeat(np.arange(n), sizes)
    kind = np.minimum(raw, 127)
    out[:, :128] = np.bincount(row * 128 + kind, minlength=n * 128).reshape(n, 128)
    if len(raw) > 1:
        same = row[1:] == row[:-1]
        pair = (kind[:-1].astype(np.int64) * 131 + kind[1:] * 31) % PAIR_BUCKETS
        out[:, 128:-6] = np.bincount((row[:-1] * PAIR_BUCKETS + pair)[same], minlength=n * PAIR_BUCKETS).reshape(n, PAIR_BUCKETS)
    out[:, :-6] /= np.maximum(sizes, 1)[:, None]
    out[:, :-6] = np.sqrt(out[:, :-6])
    for i, text in enumerate(column.to_pylist()):
        words, lines = (text or "").split(), (text or "").split("\n")
        full = [x for x in lines if x]
        out[i, -6:] = (
            np.log1p(len(words)) / 10,
            np.log1p(len(text or "") / max(1, len(words))) / 3,
            len(set(words)) / max(1, len(words)),
            1 - len(set(full)) / max(1, len(full)),
            np.log1p(len(words) / max(1, len(lines))) / 5,
            float(not words),
        )
    return out


def fit_pairs(x: np.ndarray, y: np.ndarray, *, most_pairs: int = 20_000, penalty: float = 1e-4, rounds: int = 300, seed: int = 7) -> RankModel:
    """Fit by gradient steps with momentum over sampled pairs; deterministic."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return RankModel(np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros(x.shape[1]), 0.0, float(y.mean()) if len(y) else 0.5)
    center, scale = x.mean(0), x.std(0) + 0.02
    z = (x - center) / scale
    draw = np.random.default_rng(seed)
    n = min(most_pairs, 40 * len(y))
    left, right = draw.choice(good, n), draw.choice(bad, n)
    weights, speed = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for _ in range(rounds):
        margin = z @ weights
        gap = 1 / (1 + np.exp(np.clip(margin[left] - margin[right], -60, 60)))
        pull = np.bincount(left, gap, len(z)) - np.bincount(right, gap, len(z))
        speed = 0.9 * speed + (z.T @ pull) / n - penalty * weights
        weights = weights + 0.05 * speed
    utility = np.sort(z @ weights)
    k = len(bad)
    return RankModel(center, scale, weights, float((utility[k - 1] + utility[k]) / 2))


def _featured(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with x, the features as bytes, in place of text_col, which comes last."""
    kept = docs.drop(text_col)

    def run(batches):
        for batch in batches:
            for a, b in row_spans(batch.column(batch.num_columns - 1), SPAN_BYTES):
                part = batch.slice(a, b - a)
                packed = [x.astype(np.float32).tobytes() for x in features(part.column(part.num_columns - 1))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(packed, pa.binary())], [*part.schema.names[:-1], "x"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return docs.select(*kept.columns, text_col).mapInArrow(run, f"{schema}, x binary")


def fit(docs: DataFrame, labels: DataFrame, *, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = 8192, **options) -> RankModel:
    """Learn from at most most_rows labelled documents for which learn (over id_col of labels) holds."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    known = known if learn is None else known.where(learn)
    known = known.groupBy(id_col).agg(F.max(label_col).cast("int").alias("_y"))
    chosen = known.orderBy(F.xxhash64(F.col(id_col)), F.col(id_col)).limit(most_rows)
    # most_rows bounds what is broadcast here and what comes to the driver
    joined = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(chosen), id_col)
    got = _featured(joined.select(id_col, "_y", "_text"), "_text").groupBy(id_col).agg(F.first("_y").alias("_y"), F.min("x").alias("x")).collect()
    got.sort(key=lambda r: r[id_col])
    x = np.array([np.frombuffer(r.x, np.float32) for r in got], float).reshape(-1, N_FEATURES)
    return fit_pairs(x, np.array([r["_y"] for r in got], int), **options)


def score(docs: DataFrame, model: RankModel, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of docs and score_col; a column of that name is replaced."""
    kept = docs.drop(score_col)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in kept.schema.fields)}, `{score_col}` double"
    place = kept.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for a, b in row_spans(batch.column(place), SPAN_BYTES):
                part = batch.slice(a, b - a)
                found = model.scores(features(part.column(place)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.float64())], [*part.schema.names, score_col])

    return kept.mapInArrow(run, schema)
