"""Quality by regularised quadratic discriminant analysis over transformed document statistics.

Each class has a mean and a covariance that is shrunk toward the pooled one and a multiple of the identity. A score is
the difference of the classes' log densities, each from the Mahalanobis distance under a cached Cholesky factor, put
through a Platt calibration. Means and covariances are sums over all labelled training rows, made before the shuffle;
shrinkage and calibration are chosen on about CALIBRATION_ROWS training rows (twice that at most) of smallest hash.

Null and empty texts have statistics too, and so a score. Labels that are null or of unknown documents don't count; a
document labelled twice counts twice. With a class unseen, every score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm import wordhash
from tarn.llm.boosting import platt, sigmoid
from tarn.llm.common import map_batches, sampled, steps, utf8, written
from tarn.llm.quality_rules import Compressor, repeated_lines, repeated_words

CALIBRATION_ROWS, SHRINKAGES, IDENTITY, THRESHOLD = 20_000, (0.02, 0.1, 0.3, 0.6), 0.02, 0.3
NAMES = ("log_words", "word_length", "upper", "digits", "stops", "exclaims", "symbols", "pipes", "high_bytes", "distinct_words", "repeated_words", "repeated_lines", "line_words", "ratio")
_D = len(NAMES)


def _logit(share: float, n: float) -> float:
    return float(np.log((share * n + 0.5) / ((1 - share) * n + 0.5)))


def statistics(texts: list[bytes], compressor: Compressor) -> np.ndarray:
    """Counts as logarithms and shares as smoothed logits, a row a text."""
    out = []
    for begin, end in steps(texts, 1 << 20):
        some = texts[begin:end]
        hashes, first = wordhash.words(some)
        for k, text in enumerate(some):
            own = hashes[first[k] : first[k + 1]]
            n, size = len(own), max(len(text), 1)
            hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256) if text else np.zeros(256, np.int64)
            share = lambda *codes: _logit(float(hist[list(codes)].sum()) / size, size)
            lines = text.count(b"\n") + 1
            out.append([
                np.log1p(n), np.log((size - hist[32] + 1) / (n + 1)), share(*range(65, 91)), share(*range(48, 58)), share(44, 46), share(33), share(*b"#*$%&<>"), share(124), share(*range(128, 256)),
                _logit(len(np.unique(own)) / n if n else 1.0, n), _logit(repeated_words(own) / n if n else 0.0, n), _logit(min(1.0, repeated_lines(text) / lines), lines), np.log((n + 1) / lines), np.log(compressor.ratio(text)) if text else 0.0,
            ])
    return np.array(out, float).reshape(-1, _D)


def with_statistics(docs: DataFrame) -> DataFrame:
    held: list[Compressor] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        held or held.append(Compressor())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(statistics(utf8(batch.column(1)), held[0])), pa.list_(pa.float64()))], names=["doc_id", "x"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, x array<double>")


@dataclass
class Discriminant:
    """Scores rows; factors are inverses of the classes' Cholesky factors."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    constants: list[float]
    slope: float = 1.0
    offset: float = 0.0
    constant: float | None = None

    def difference(self, x: np.ndarray) -> np.ndarray:
        density = [c - 0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) for m, f, c in zip(self.means, self.factors, self.constants, strict=True)]
        # the root of a difference of squares keeps far outliers comparable without changing any order
        d = density[1] - density[0]
        return np.sign(d) * np.sqrt(np.abs(d))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return sigmoid(self.slope * self.difference(x) + self.offset)


def _of(counts: np.ndarray, sums: np.ndarray, squares: np.ndarray, shrinkage: float) -> Discriminant:
    means = [s / n for s, n in zip(sums, counts, strict=True)]
    covariances = [q / n - np.outer(m, m) for q, n, m in zip(squares, counts, means, strict=True)]
    pooled = sum(c * n for c, n in zip(covariances, counts, strict=True)) / counts.sum()
    pooled = pooled + IDENTITY * max(float(np.trace(pooled)) / _D, 1e-6) * np.eye(_D)
    factors, constants = [], []
    for c, n in zip(covariances, counts, strict=True):
        chol = np.linalg.cholesky((1 - shrinkage) * c + shrinkage * pooled + 1e-9 * np.eye(_D))
        factors.append(np.linalg.inv(chol))
        constants.append(float(np.log(n / counts.sum()) - np.log(np.diag(chol)).sum()))
    return Discriminant(means, factors, constants)


def fitted(labelled: DataFrame) -> Discriminant:
    """labelled: doc_id, x, y (0 or 1)."""
    upper = [(i, j) for i in range(_D) for j in range(i, _D)]
    product = F.transform(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in upper]), lambda p: F.element_at("x", p["i"] + 1) * F.element_at("x", p["j"] + 1))
    flat = labelled.select("y", F.posexplode(F.concat("x", product)).alias("k", "v"))
    sums = {(r["y"], r["k"]): r["s"] for r in flat.groupBy("y", "k").agg(F.sum("v").alias("s")).collect()}  # 2 x (14 + 105) numbers
    counts = {r["y"]: r["count"] for r in labelled.groupBy("y").count().collect()}
    n = np.array([counts.get(0, 0), counts.get(1, 0)], float)
    if not n.all():
        return Discriminant([], [], [], constant=float(n[1] / n.sum()) if n.sum() else 0.5)
    first = [np.array([sums[y, k] for k in range(_D)]) for y in (0, 1)]
    second = []
    for y in (0, 1):
        q = np.zeros((_D, _D))
        for k, (i, j) in enumerate(upper):
            q[i, j] = q[j, i] = sums[y, _D + k]
        second.append(q)
    rows = sampled(labelled, "doc_id", CALIBRATION_ROWS).select("x", "y").collect()
    x, y = np.array([r["x"] for r in rows], float), np.array([r["y"] for r in rows], float)
    best, least = None, np.inf
    for shrinkage in SHRINKAGES:
        model = _of(n, np.array(first), np.array(second), shrinkage)
        d = model.difference(x)
        model.slope, model.offset = platt(d, y)
        p = np.clip(model.score(x), 1e-9, 1 - 1e-9)
        loss = -float((y * np.log(p) + (1 - y) * np.log(1 - p)).mean())
        if loss < least:
            best, least = model, loss
    return best


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted. Labels of held-out rows are never looked at."""
    rows = written(with_statistics(docs), "statistics")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    sent = docs.sparkSession.sparkContext.broadcast(fitted(written(rows.join(known, "doc_id"), "labelled")))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, _D)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.score(x))], names=["doc_id", "score"])

    out = map_batches(rows, run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
