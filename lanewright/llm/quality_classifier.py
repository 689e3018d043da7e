"""Quality by regularised quadratic discriminant analysis.

Every whole text becomes a vector of transformed statistics.  Class means and covariances come
from sums over all labelled rows of the training folds; covariances are shrunk towards the pooled
one and its diagonal; the score is the logistic of the tempered difference of the two Gaussian
log-densities, from Mahalanobis distances by triangular solves with Cholesky factors computed once.
The pooled one weighs as much as SHRINK rows would, so small classes lean on it and large ones on
their own.  The statistics depend on each other beyond their covariance, so the raw difference is too sure;
TEMPER, about one over the number of dimensions, makes it one of independent halves of evidence.
Statistics are whole multiples of 2 ** -12, so that their sums and products are exact in any order up
to some millions of labelled rows.

Cases: null and empty texts have the statistics of an empty text; labels without a quality or a
document are ignored, repeated labels count each; without training rows of both classes every score
is the training share of label 1 (0.5 without any); no documents give no rows; extra columns are
ignored; lang, source, doc_id and labels never enter a vector.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, require_columns, small_batches

SHRINK, RIDGE, TEMPER, GRID = 400.0, 0.05, 0.1, 4096
NAMES = ("words", "word_length", "word_spread", "capitals", "digits", "symbols", "exclamations", "stops", "commas", "other_ascii", "non_ascii", "lines", "line_length", "variety", "duplicate_lines", "pair_variety", "top_share", "short_words", "long_words", "full_stops_at_ends")
DIMENSIONS = len(NAMES)


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER, _LOWER, _DIGIT = _mask(bytes(range(65, 91))), _mask(bytes(range(97, 123))), _mask(bytes(range(48, 58)))
_SPACE, _HIGH = _mask(bytes([32, 9, 10, 11, 12, 13])), _mask(bytes(range(128, 256)))
_SYMBOL, _STOP, _COMMA = _mask(b"#*$%&|<>"), _mask(b".?:;"), _mask(b",")
_OTHER = ~(_UPPER | _LOWER | _DIGIT | _SPACE | _HIGH | _SYMBOL | _STOP | _COMMA | _mask(b"!"))


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text: logarithms of sizes, square roots of shares."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    of = lambda m: float(count[m].sum())
    letters = of(_UPPER) + of(_LOWER) + 1
    shown = max(1.0, len(raw) - of(_SPACE))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    lengths = np.fromiter(map(len, words), float, n) if n else np.zeros(1)
    seen = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    ends = sum(x.rstrip()[-1:] in b".?!" for x in lines)
    root = lambda x: float(np.sqrt(max(0.0, x)))
    return [
        np.log1p(n),
        np.log1p(lengths.mean()),
        np.log1p(lengths.std()),
        root(of(_UPPER) / letters),
        root(of(_DIGIT) / shown),
        root(of(_SYMBOL) / shown),
        root(count[33] / shown),
        root(of(_STOP) / shown),
        root(of(_COMMA) / shown),
        root(of(_OTHER) / shown),
        root(of(_HIGH) / shown),
        np.log1p(len(lines)),
        np.log1p(len(raw) / max(1, len(lines))),
        root(len(seen) / max(1, n)),
        root(1 - len(set(lines)) / max(1, len(lines))),
        root(pairs / max(1, n - 1)),
        root(max(seen.values(), default=0) / max(1, n)),
        root((lengths <= 3).mean()),
        root((lengths > 14).mean()),
        root(ends / max(1, len(lines))),
    ]


def _vectors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = [(np.round(np.asarray(statistics(t), float) * GRID) / GRID).tolist() for t in b.column(1).to_pylist()]
        yield pa.record_batch([b.column(0), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])


def _moments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each class and batch the count, sums and products, as numbered values."""
    for b in batches:
        x = np.array(b.column("x").to_pylist(), float).reshape(-1, DIMENSIONS)
        y = b.column("quality").to_numpy(zero_copy_only=False)
        for label in (0, 1):
            z = x[y == label]
            values = np.concatenate([[len(z)], z.sum(0), (z.T @ z).ravel()])
            yield pa.record_batch([pa.array([label] * len(values), pa.int32()), pa.array(np.arange(len(values)), pa.int32()), pa.array(values)], ["label", "i", "value"])


def forward(factor: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The solution of factor @ y = right for a lower triangular factor."""
    y = np.empty_like(right)
    for i in range(len(factor)):
        y[i] = (right[i] - factor[i, :i] @ y[:i]) / factor[i, i]
    return y


class Discriminant:
    """Means, Cholesky factors and log-determinants of two classes."""

    def __init__(self, sums: dict[int, np.ndarray], shrink: float = SHRINK, ridge: float = RIDGE, temper: float = TEMPER):
        d = DIMENSIONS
        n = {k: float(v[0]) for k, v in sums.items()}
        total = sum(n.values())
        self.share, self.ready, self.temper = (n[1] / total if total else 0.5), min(n.values()) >= 2, temper
        if not self.ready:
            return
        mean = {k: v[1 : d + 1] / n[k] for k, v in sums.items()}
        cov = {k: v[d + 1 :].reshape(d, d) / n[k] - np.outer(mean[k], mean[k]) for k, v in sums.items()}
        pooled = sum(n[k] * cov[k] for k in n) / total
        between = np.array([mean[k] for k in n])
        scale = np.maximum(np.diag(pooled) + between.var(0), 1e-6)
        self.classes = []
        for k in (0, 1):
            own = n[k] / (n[k] + shrink)
            factor = np.linalg.cholesky(own * cov[k] + (1 - own) * pooled + ridge * np.diag(scale))
            self.classes.append((mean[k], factor, float(np.log(np.diag(factor)).sum())))

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.ready:
            return np.full(len(x), self.share)
        density = [-0.5 * (forward(factor, (x - m).T) ** 2).sum(0) - log_det for m, factor, log_det in self.classes]
        odds = np.clip(self.temper * (density[1] - density[0]) + np.log(self.share / (1 - self.share)), -40, 40)
        return 1 / (1 + np.exp(-odds))


def _score(batches: Iterable[pa.RecordBatch], model: Discriminant, threshold: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        s = model.scores(np.array(b.column("x").to_pylist(), float).reshape(-1, DIMENSIONS))
        yield pa.record_batch([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(vectors: DataFrame, labels: DataFrame) -> Discriminant:
    """vectors (doc_id, x) and labels (doc_id, quality), both of the training folds only."""
    marked = vectors.join(labels.where("quality IN (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality")), "doc_id")
    sums = marked.select("x", "quality").mapInArrow(_moments, "label int, i int, value double").groupBy("label", "i").agg(F.sum("value").alias("value"))
    found = {k: np.zeros(1 + DIMENSIONS + DIMENSIONS**2) for k in (0, 1)}
    for r in sums.collect():  # 2 * (1 + d + d * d) rows
        found[r.label][r.i] = r.value
    return Discriminant(found)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """documents, labels -> doc_id, held_out, score, predicted."""
    require_columns(docs, ["doc_id", "text"])
    require_columns(labels, ["doc_id", "quality"])
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    vectors = materialize(docs.select("doc_id", "text").mapInArrow(_vectors, f"doc_id {kind}, x array<double>"), "vectors")
    model = fit(vectors.where(~held_out(F.col("doc_id"))), labels)
    marked = vectors.select("doc_id", "x", held_out(F.col("doc_id")).alias("held_out"))
    return marked.mapInArrow(partial(_score, model=model, threshold=threshold), f"doc_id {kind}, held_out boolean, score double, predicted int")
