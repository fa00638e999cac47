"""Toxicity: a factorization machine over hashed terms.

Terms (lower-case words) are hashed into 2**TERM_BITS buckets. On a bounded labelled sample the MAX_TERMS buckets
that tell toxic from other documents best (by a likelihood ratio) are taken, and a factorization machine learns
a weight for each and an interaction for each pair of them; a document is the set of such buckets in its
whole text.

Defined results: null texts count as empty; an empty text has the score of no terms; repeated rows are scored
each; a null doc_id is scored but never learnt from; without labels (or with one class only) every score is the
share of label 1 (0.5 with none); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum
from .tables import held_out, texts_of, training_sample, written

#: Labelled documents that are learnt from, at most.
MAX_TRAINING_ROWS = 20_000
TERM_BITS, MAX_TERMS, FACTORS = 18, 256, 4
#: Steps of the fit; all of them run in one task over the sample.
ROUNDS = 80
#: Documents of the sample that a term must be in.
LEAST_DOCUMENTS = 5


def hashed_terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bucket)."""
    w = textnum.words(*textnum.code_points(texts))
    d, h, _ = textnum.counted(w.doc, w.h)
    return d, (h >> np.uint64(64 - TERM_BITS)).astype(np.int64)


def term_sets(rows: DataFrame) -> DataFrame:
    """doc_id, y, terms from doc_id, text, y."""

    def run(batches):
        for b in batches:
            col = b.column(1).to_pylist()
            for lo, hi in textnum.chunks(col):
                d, t = hashed_terms(col[lo:hi])
                ends = np.searchsorted(d, np.arange(hi - lo + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(t.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), lists], names=["doc_id", "y", "terms"])

    return rows.select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y double, terms array<int>")


def telling_terms(train: DataFrame, n: int, ones: float, most: int = MAX_TERMS) -> list[int]:
    """Buckets with the largest likelihood ratio between the classes."""
    by = train.select("y", F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("d"), F.sum("y").alias("d1"))
    part = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
    d0, rate = F.col("d") - F.col("d1"), ones / n
    ratio = part(F.col("d1"), F.col("d") * rate) + part(d0, F.col("d") * (1 - rate))
    ratio = ratio + part(ones - F.col("d1"), (n - F.col("d")) * rate) + part(n - ones - d0, (n - F.col("d")) * (1 - rate))
    best = by.where(F.col("d") >= LEAST_DOCUMENTS).orderBy(F.desc(ratio), "term").limit(most)
    return sorted(r["term"] for r in best.collect())


def machine(d: np.ndarray, f: np.ndarray, y: np.ndarray, features: int, rounds: int = ROUNDS, step: float = 0.1, decay: float = 1e-4, seed: int = 5) -> tuple[float, np.ndarray, np.ndarray]:
    """(intercept, weights, factors) of a factorization machine for rows y with features f (pairs d, f), by Adam with decayed weights."""
    n = len(y)
    theta = np.zeros((1 + FACTORS, features))
    theta[1:] = np.random.default_rng(seed).normal(0, 0.02, (FACTORS, features))
    bias = np.zeros(1)
    memory = [[np.zeros_like(x), np.zeros_like(x)] for x in (theta, bias)]
    for k in range(1, rounds + 1):
        at = theta[:, f]
        sums = np.stack([np.bincount(d, at[j], n) for j in range(1 + FACTORS)])
        squares = np.bincount(d, (at[1:] ** 2).sum(0), n)
        z = bias[0] + sums[0] + ((sums[1:] ** 2).sum(0) - squares) / 2
        g = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / n
        slope = np.stack([np.bincount(f, g[d], features), *(np.bincount(f, g[d] * (sums[j][d] - at[j]), features) for j in range(1, 1 + FACTORS))])
        for x, now, (mean, square) in zip((theta, bias), (slope, np.array([g.sum()])), memory):
            mean += 0.1 * (now - mean)
            square += 0.001 * (now * now - square)
            x -= step * (mean / (1 - 0.9**k) / (np.sqrt(square / (1 - 0.999**k)) + 1e-8) + decay * x)
    return float(bias[0]), theta[0], theta[1:].T


def fit(docs: DataFrame, labels: DataFrame, max_training_rows: int, max_terms: int = MAX_TERMS):
    """(terms, intercept, weights, factors). The bounded sample is learnt from in one task."""
    sample = F.broadcast(training_sample(labels, "toxic", max_training_rows))
    train = written(term_sets(texts_of(docs).join(sample, "doc_id")), "terms")
    n, ones = train.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    terms = telling_terms(train, n, ones, max_terms) if n and 0 < ones < n else []
    if not terms:
        share = ones / n if n else 0.5
        return [], float(np.log((share + 1e-9) / (1 - share + 1e-9))), np.zeros(0), np.zeros((0, FACTORS))
    place = np.full(1 << TERM_BITS, -1, np.int64)
    place[terms] = np.arange(len(terms))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("y", "ascending")])
        lists = rows.column("terms").combine_chunks()
        d = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        at = place[lists.flatten().to_numpy()]
        intercept, weights, factors = machine(d[at >= 0], at[at >= 0], rows.column("y").to_numpy(), len(terms))
        return pa.table({"intercept": [intercept], "weights": [weights.tolist()], "factors": [factors.ravel().tolist()]})

    held = train.select("doc_id", "y", "terms", F.lit(0).alias("all")).groupBy("all").applyInArrow(run, "intercept double, weights array<double>, factors array<double>").first()
    return terms, held["intercept"], np.array(held["weights"]), np.array(held["factors"]).reshape(-1, FACTORS)


def toxicity_scores(docs: DataFrame, labels: DataFrame, max_training_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    terms, intercept, weights, factors = fit(docs, labels, max_training_rows)
    place = np.full(1 << TERM_BITS, -1, np.int16)
    place[terms] = np.arange(len(terms))
    shared = docs.sparkSession.sparkContext.broadcast((place, weights, factors))

    def run(batches):
        place, weights, factors = shared.value
        for b in batches:
            col = b.column(1).to_pylist()
            score = np.full(len(col), intercept)
            for lo, hi in textnum.chunks(col):
                d, t = hashed_terms(col[lo:hi])
                at = place[t]
                d, at = d[at >= 0], at[at >= 0].astype(np.int64)
                pair = np.unique(d * (1 << 20) + at)
                d, at = pair >> 20, pair & ((1 << 20) - 1)
                n = hi - lo
                z = np.bincount(d, weights[at], n)
                for f in range(factors.shape[1]):
                    v = factors[at, f]
                    z = z + (np.bincount(d, v, n) ** 2 - np.bincount(d, v * v, n)) / 2
                score[lo:hi] += z
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(score, -50, 50))))], names=["doc_id", "score"])

    out = texts_of(docs).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
