"""Quality classifier: a sparse rule ensemble over text statistics.

Statistics of every whole text are taken in Arrow tasks; shallow boosted trees are grown on a bounded
labelled sample, every path from a root is a conjunctive rule, a lasso logistic regression weighs
the rules, and the surviving rules become one Spark column expression that scores all documents.

Defined results: a null text counts as empty; an empty text has all statistics 0 and is scored like any
other; repeated rows are scored each; a null doc_id is scored but never learnt from; without labels (or
with one class only) every score is the share of label 1 (0.5 with none); an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum
from .tables import held_out, texts_of, training_sample, written

#: Labelled documents that are learnt from, at most.
MAX_TRAINING_ROWS = 20_000
#: Score from which a document counts as good.
ACCEPT = 0.3

STATISTICS = [
    "words", "chars_per_word", "upper_share", "digit_share", "punctuation_share", "symbol_share", "bang_share",
    "bar_share", "space_share", "distinct_share", "top_share", "repeat_share", "words_per_line", "repeated_pair_share",
]


def _class_table() -> np.ndarray:
    """Character classes: 0 word, 1 capital, 2 digit, 3 blank, 4 line end, 5 punctuation, 6 !, 7 |, 8 other."""
    word = textnum.fold_table() != 0
    out = np.where(word, 0, 8).astype(np.uint8)
    for i in np.flatnonzero(word):
        c = chr(i)
        out[i] = 1 if c.isupper() else 2 if c.isdigit() else 0
    for c in " \t\r ":
        out[ord(c)] = 3
    out[10] = 4
    for c in ".,;:'\"?()-":
        out[ord(c)] = 5
    out[ord("!")], out[ord("|")] = 6, 7
    return out


_classes: list[np.ndarray] = []


def statistics(texts: list[str]) -> np.ndarray:
    """One row of STATISTICS per text."""
    if not _classes:
        _classes.append(_class_table())
    out = np.zeros((len(texts), len(STATISTICS)))
    for lo, hi in textnum.chunks(texts):
        cp, off = textnum.code_points(texts[lo:hi])
        n = hi - lo
        kind = _classes[0][np.minimum(cp, len(_classes[0]) - 1)]
        doc = np.repeat(np.arange(n), np.diff(off))
        count = np.bincount(doc * 9 + kind, minlength=9 * n).reshape(n, 9).astype(float)
        chars = np.maximum(np.diff(off) - 1, 1)
        w = textnum.words(cp, off)
        many = np.diff(w.first)
        some = np.maximum(many, 1)
        d, _, c = textnum.counted(w.doc, w.h)
        firsts = np.searchsorted(d, np.arange(n))
        distinct = np.bincount(d, minlength=n)
        top = np.zeros(n)
        if len(c):
            has = np.flatnonzero(distinct)
            top[has] = np.maximum.reduceat(c, firsts[has])
        follows = w.doc[1:] == w.doc[:-1]
        repeat = np.bincount(w.doc[1:][follows & (w.h[1:] == w.h[:-1])], minlength=n)
        pair = textnum.mix(w.h[1:] ^ (w.h[:-1] * np.uint64(3)))[follows]
        pd, _, _ = textnum.counted(w.doc[1:][follows], pair)
        pairs = np.maximum(many - 1, 1)
        out[lo:hi] = np.stack(
            [
                many, np.bincount(w.doc, weights=w.end - w.start, minlength=n) / some,
                count[:, 1] / chars, count[:, 2] / chars, count[:, 5] / chars, count[:, 8] / chars, count[:, 6] / chars,
                count[:, 7] / chars, count[:, 3] / chars, distinct / some, top / some, repeat / some, many / count[:, 4],
                1 - np.where(many > 1, np.bincount(pd, minlength=n) / pairs, 1),
            ],
            axis=1,
        )
    return out


def with_statistics(docs: DataFrame, keep: str = "doc_id") -> DataFrame:
    """The column `keep` of every row (an id, or a struct that holds the text) and the statistics of its text."""
    inside = keep == "row"

    def run(batches):
        for b in batches:
            text = pc.struct_field(b.column(0), "text") if inside else b.column(1)
            x = statistics([t or "" for t in text.to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x[:, j]) for j in range(x.shape[1]))], names=[keep, *STATISTICS])

    rows = docs.select(keep) if inside else docs.select(keep, "text")
    schema = docs.select(keep, *[F.lit(0.0).alias(s) for s in STATISTICS]).schema
    return rows.mapInArrow(run, schema)


def paths(node) -> list[list[tuple[int, bool, float]]]:
    """Conditions (feature, goes left, threshold) of every path from a root to a node below it."""
    out, stack = [], [(node, [])]
    while stack:
        at, conditions = stack.pop()
        if conditions:
            out.append(conditions)
        if at.getClass().getSimpleName() == "InternalNode":
            split = at.split()
            k, t = int(split.featureIndex()), float(split.threshold())
            stack += [(at.leftChild(), [*conditions, (k, True, t)]), (at.rightChild(), [*conditions, (k, False, t)])]
    return out


def rule_column(rule: list[tuple[int, bool, float]]) -> Column:
    """1.0 where all conditions hold, else 0.0."""
    held = F.lit(True)
    for k, left, t in rule:
        held = held & ((F.col(STATISTICS[k]) <= t) if left else (F.col(STATISTICS[k]) > t))
    return held.cast("double")


def fit_rules(train: DataFrame, trees: int = 12, depth: int = 3, lasso: float = 1e-3) -> tuple[float, list[tuple[float, list]]]:
    """(intercept, [(weight, rule)]) from rows of STATISTICS and y; no rules where only one class is seen."""
    n, ones = train.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    if not n or ones in (0, n):
        share = ones / n if n else 0.5
        return float(np.log((share + 1e-9) / (1 - share + 1e-9))), []
    vectors = VectorAssembler(inputCols=STATISTICS, outputCol="features").transform(train)
    forest = GBTClassifier(labelCol="y", maxDepth=depth, maxIter=trees, maxBins=64, minInstancesPerNode=5, seed=7).fit(vectors)
    found = {tuple(sorted(set(p))): p for t in forest.trees for p in paths(t._java_obj.rootNode())}
    rules = [found[k] for k in sorted(found)]
    held = train.select("y", *[rule_column(r).alias(f"r{i}") for i, r in enumerate(rules)])
    held = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(held)
    model = LogisticRegression(labelCol="y", elasticNetParam=1.0, regParam=lasso, maxIter=60, standardization=False).fit(held)
    return float(model.intercept), [(float(w), r) for w, r in zip(model.coefficients, rules) if w]


def quality_model(train: DataFrame) -> Column:
    """The score as an expression over STATISTICS, learnt from labelled rows (STATISTICS and y)."""
    intercept, rules = fit_rules(train)
    z = F.lit(intercept)
    for w, r in rules:
        z = z + w * rule_column(r)
    return 1 / (1 + F.exp(-z))


def quality_scores(docs: DataFrame, labels: DataFrame, max_training_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    stats = written(with_statistics(texts_of(docs)), "statistics")
    score = quality_model(written(stats.join(F.broadcast(training_sample(labels, "quality", max_training_rows)), "doc_id"), "training"))
    return stats.select("doc_id", held_out().alias("held_out"), score.alias("score"), (score >= ACCEPT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, max_training_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """The documents that the classifier accepts, with all their columns; texts are not shuffled, and only the sample is read twice."""
    sample = F.broadcast(training_sample(labels, "quality", max_training_rows))
    train = with_statistics(texts_of(docs).join(sample.select("doc_id"), "doc_id")).join(sample, "doc_id")
    score = quality_model(written(train, "training"))
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    return with_statistics(rows, "row").where(score >= ACCEPT).select("row.*")
