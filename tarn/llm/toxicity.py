"""Toxicity by a classifier chain: categories in sequence, each model fed the earlier categories' probabilities.

Features are single words (A-Z in lower case, punctuation off) and the first five bytes of longer ones. Each word's counts per label come from all labelled
rows, summed before the shuffle; the TERMS words with the largest signed G2 statistics for some label, MIN_G2 at least
(what chance or a few copies make doesn't count), are kept. The
chain's links are L2-regularised logistic models over the presence of those words and the earlier links' outputs. The
earlier outputs that a link is trained on are out-of-fold predictions, so it learns to trust them as far as they go.
The chain is fitted on about TRAINING_ROWS labelled rows of smallest hash (twice that at most); its thresholds maximise F1 out of fold.

The chain here: junk (quality 0), toxic (toxic 1), severe (toxic with at least as many distinct words that mark
toxicity as the median toxic row; a weak label made on the training rows). Null and empty texts have no words and get
the models' base rates. Null labels don't count. Rows are independent; an empty table gives an empty result; with no
row of some label its probability is a constant and nobody is flagged.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm import wordhash
from tarn.llm.boosting import sigmoid
from tarn.llm.common import hash_bound, map_batches, sampled, steps, utf8, written

TERMS, MIN_ROWS, MIN_G2, TRAINING_ROWS, FOLDS, RIDGE = 1500, 3, 10.8, 20_000, 4, 1e-4
LABELS = ("junk", "toxic")
_CLEAN = bytes((c + 32 if 65 <= c <= 90 else 32 if c < 128 and not (48 <= c <= 57 or 97 <= c <= 122) else c) for c in range(256))
#: A word's beginning: what inflected forms share; the mark keeps it apart from the word itself.
_START = re.compile(rb"(\S{5})\S+")


def doc_terms(texts: list[bytes]) -> list[np.ndarray]:
    """Each text's distinct words and beginnings of longer words, as sorted hashes."""
    out = []
    for begin, end in steps(texts, 1 << 20):
        plain = [t.translate(_CLEAN) for t in texts[begin:end]]
        hashes, first = wordhash.words(plain)
        starts, _ = wordhash.words([_START.sub(rb"\1" + b"_", t) for t in plain])
        out += [np.unique(np.concatenate((hashes[a:b], starts[a:b]))).view(np.int64) for a, b in zip(first[:-1], first[1:], strict=True)]
    return out


@dataclass
class Rows:
    """Presence of terms, row after row, with dense columns beside them."""

    terms: np.ndarray
    row: np.ndarray
    n: int
    dense: np.ndarray

    def margin(self, w: np.ndarray, v: np.ndarray, b: float) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.terms], minlength=self.n)[: self.n] + self.dense @ v + b


def _logistic(rows: Rows, y: np.ndarray, on: np.ndarray, terms: int, rounds: int = 150) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression by Adam steps on the rows that are on; classes weigh by the root of their inverse share."""
    rate = np.clip(y[on].mean(), 1e-4, 1 - 1e-4)
    weight = np.where(y > 0, np.sqrt((1 - rate) / rate), 1.0) * on / on.sum()
    k = rows.dense.shape[1]
    p = np.zeros(terms + k + 1)
    p[-1] = np.log(rate / (1 - rate))
    m, s = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, rounds + 1):
        g = (sigmoid(rows.margin(p[:terms], p[terms:-1], p[-1])) - y) * weight
        grad = np.concatenate((np.bincount(rows.terms, weights=g[rows.row], minlength=terms), rows.dense.T @ g, [g.sum()])) + RIDGE * p
        grad[-1] -= RIDGE * p[-1]
        m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad**2
        p = p - 0.2 * (1 - step / (rounds + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-9)
    return p[:terms], p[terms:-1], float(p[-1])


@dataclass
class Chain:
    vocabulary: np.ndarray
    names: tuple[str, ...] = ()
    links: list[tuple[np.ndarray, np.ndarray, float]] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=list)

    def rows(self, terms: list[np.ndarray]) -> Rows:
        found, row = [], []
        for k, own in enumerate(terms):
            at = np.searchsorted(self.vocabulary, own)
            hit = at[(at < len(self.vocabulary)) & (self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] == own)] if len(self.vocabulary) else at[:0]
            found.append(hit)
            row.append(np.full(len(hit), k))
        return Rows(np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64), np.concatenate(row).astype(np.int64) if row else np.zeros(0, np.int64), len(terms), np.zeros((len(terms), 0)))

    def probabilities(self, rows: Rows) -> np.ndarray:
        for w, v, b in self.links:
            p = sigmoid(rows.margin(w, v, b))
            rows = Rows(rows.terms, rows.row, rows.n, np.concatenate((rows.dense, p[:, None]), axis=1))
        return rows.dense


def _best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Of largest F1; within the gap that leaves, nearer to the lower side, for texts with fewer marks than any seen."""
    if not y.sum():
        return 2.0
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    at = int(f1.argmax())
    after = p[order][at + 1] if at + 1 < len(y) else 0.0
    return float(np.clip(after + (p[order][at] - after) / 4, 0.1, 0.9))


def fitted(vocabulary: np.ndarray, toxic_terms: set[int], terms: list[np.ndarray], labels: dict[str, np.ndarray], folds: np.ndarray) -> Chain:
    chain = Chain(vocabulary)
    rows = chain.rows(terms)
    marks = np.array([len(toxic_terms.intersection(t.tolist())) for t in terms], float)
    toxic = labels["toxic"] > 0
    severe = toxic & (marks >= max(2.0, float(np.median(marks[toxic])) if toxic.any() else 2.0))
    chain.names = (*LABELS, "severe")
    for y in (*(labels[k] for k in LABELS), severe.astype(float)):
        out_of_fold = np.zeros(len(y))
        for f in range(FOLDS):
            w, v, b = _logistic(rows, y, folds != f, len(vocabulary))
            out_of_fold[folds == f] = sigmoid(rows.margin(w, v, b))[folds == f]
        chain.links.append(_logistic(rows, y, np.ones(len(y), bool), len(vocabulary)))
        chain.thresholds.append(_best_threshold(out_of_fold, y))
        rows = Rows(rows.terms, rows.row, rows.n, np.concatenate((rows.dense, out_of_fold[:, None]), axis=1))
    return chain


def _term_counts(labelled: DataFrame) -> DataFrame:
    """term, n, and of these the rows with each label; one row a term and batch before the shuffle."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        terms = doc_terms(utf8(batch.column(1)))
        marks = [np.repeat(batch.column(2 + k).to_numpy(zero_copy_only=False).astype(np.int64), [len(t) for t in terms]) for k in range(len(LABELS))]
        unique, at = np.unique(np.concatenate(terms), return_inverse=True)
        counts = [np.bincount(at, minlength=len(unique)), *(np.bincount(at, weights=m, minlength=len(unique)).astype(np.int64) for m in marks)]
        return pa.RecordBatch.from_arrays([pa.array(unique), *(pa.array(c) for c in counts)], names=["term", "n", *LABELS])

    return map_batches(labelled, run, "term long, n long, " + ", ".join(f"{k} long" for k in LABELS)).groupBy("term").agg(*(F.sum(c).alias(c) for c in ("n", *LABELS)))


def selected_terms(labelled: DataFrame) -> DataFrame:
    """The TERMS terms of largest G2 toward some label: term, label, g2."""
    totals = labelled.agg(F.count("*").alias("rows"), *(F.sum(k).alias(f"all_{k}") for k in LABELS))
    counts = written(_term_counts(labelled).where(F.col("n") >= MIN_ROWS), "terms").join(F.broadcast(totals))  # one row
    chosen = None
    for k in LABELS:
        with_it, total, n, rows = F.col(k), F.col(f"all_{k}"), F.col("n"), F.col("rows")
        part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
        g2 = 2 * (part(with_it, n * total / rows) + part(n - with_it, n * (rows - total) / rows))
        own = counts.where(with_it * rows > n * total).select("term", F.lit(k).alias("label"), g2.alias("g2"), (with_it / n).alias("share")).where(F.col("g2") >= MIN_G2).orderBy(F.desc("g2"), "term").limit(TERMS)
        chosen = own if chosen is None else chosen.unionByName(own)
    return chosen


def fit(docs: DataFrame, labels: DataFrame) -> Chain:
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 0).cast("int").alias("junk"), (F.col("toxic") == 1).cast("int").alias("toxic")).dropna()
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(known, "doc_id").select("doc_id", "text", *LABELS)
    chosen = selected_terms(labelled).collect()  # TERMS rows a label at most
    vocabulary = np.unique(np.array([r["term"] for r in chosen], np.int64))
    toxic_terms = {r["term"] for r in chosen if r["label"] == "toxic" and r["share"] >= 0.5}
    sample = sampled(known, "doc_id", TRAINING_ROWS)
    probe = Chain(vocabulary)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept = [t[np.isin(t, probe.vocabulary, assume_unique=True)] for t in doc_terms(utf8(batch.column(1)))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.list_(pa.int64())), *(batch.column(2 + k) for k in range(len(LABELS)))], names=["doc_id", "terms", *LABELS])

    # the sample's bound holds for documents too, before their texts are shuffled
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bound = hash_bound(known.count(), TRAINING_ROWS)
    texts = texts if bound is None else texts.where(F.xxhash64("doc_id") < bound)
    rows = texts.join(sample, "doc_id").select("doc_id", "text", *LABELS)
    rows = map_batches(rows, run, "doc_id long, terms array<long>, " + ", ".join(f"{k} int" for k in LABELS)).limit(2 * TRAINING_ROWS).collect()
    if not rows:
        return Chain(vocabulary, (*LABELS, "severe"), [(np.zeros(len(vocabulary)), np.zeros(k), -3.0) for k in range(3)], [2.0] * 3)
    rows.sort(key=lambda r: r["doc_id"])
    folds = np.array([hash(r["doc_id"] * 2654435761 % (1 << 32)) >> 8 for r in rows]) % FOLDS
    return fitted(vocabulary, toxic_terms, [np.array(r["terms"], np.int64) for r in rows], {k: np.array([r[k] for r in rows], float) for k in LABELS}, folds)


def scored(docs: DataFrame, chain: Chain) -> DataFrame:
    """Per row: doc_id, p_junk, p_toxic, p_severe, and the flags toxic and severe."""
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    names = (*LABELS, "severe")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = sent.value
        p = own.probabilities(own.rows(doc_terms(utf8(batch.column(1)))))
        flags = {k: p[:, names.index(k)] >= own.thresholds[names.index(k)] for k in ("toxic", "severe")}
        flags["severe"] = flags["severe"] & flags["toxic"]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, k]) for k in range(3)), *(pa.array(f) for f in flags.values())], names=["doc_id", *(f"p_{k}" for k in names), "toxic", "severe"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, p_junk double, p_toxic double, p_severe double, toxic boolean, severe boolean")
