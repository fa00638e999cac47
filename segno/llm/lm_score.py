"""Language-model scoring by cross-entropy difference.

Two interpolated bigram models of the same order and smoothing, one of a target corpus and one of the background,
are counted over all their texts and share one vocabulary: the most frequent words, the rest being one word
of its own. A document scores by how much less its words cost, each on average, under the target model.
In each model the chances of all words after any context sum to 1: what a context does not spend on bigrams,
all of it where the model never saw the context, goes to the words in proportion to their own chances.

Both models hold every bigram. The most frequent ones, at most BIGRAMS, are broadcast and scored in the task that meets
them; what a document holds of the others meets their values in a join. The vocabulary is a bound of the models, the same at
any input size; the counts it is chosen from are complete. Defined results: null texts count as empty; a text without words
has null losses and score 0; repeated rows are counted and scored each; a null doc_id is kept; without
target or background words a model falls back to equal chances; empty documents give no rows; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum
from .tables import texts_of, written

VOCABULARY, BIGRAMS = 1 << 13, 1 << 20
#: Weight of the bigram estimate and, below it, of the word estimate against equal chances.
BIGRAM_WEIGHT, WORD_WEIGHT = 0.6, 0.95
_PLACE = 1 << 20


def tallied(texts: DataFrame, keys_of) -> DataFrame:
    """key, background, target: how often each key occurs; texts: text, target (boolean); keys_of(texts) gives arrays."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            key, n = (np.concatenate(x) for x in zip(*held))
            key, of = np.unique(key, return_inverse=True)
            return key, np.stack([np.bincount(of, n[:, j], len(key)) for j in (0, 1)], 1)

        def out():
            key, n = merged()
            return pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(n[:, j].astype(np.int64)) for j in (0, 1))], names=["key", "background", "target"])

        for b in batches:
            col, is_target = b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False)
            for lo, hi in textnum.chunks(col):
                for side in (0, 1):
                    mine = [t for t, x in zip(col[lo:hi], is_target[lo:hi]) if x == side]
                    key, n = np.unique(keys_of(mine), return_counts=True) if mine else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                    if len(key):
                        both = np.zeros((len(key), 2), np.int64)
                        both[:, side] = n
                        held.append((key, both))
                if sum(len(k) for k, _ in held) > 1_500_000:
                    held = [merged()]
                    if len(held[0][0]) > 1_000_000:
                        yield out()
                        held = []
        if held:
            yield out()

    rows = texts.mapInArrow(run, "key long, background long, target long")
    return rows.groupBy("key").agg(F.sum("background").alias("background"), F.sum("target").alias("target"))


def most_frequent(counts: DataFrame, most: int, name: str):
    """The keys above the lowest count level that leaves at most `most` of them, as an Arrow table, by key."""
    total = F.col("background") + F.col("target")
    level = F.floor(F.log2(total) * 16)
    counts = written(counts, name)
    kept, least = 0, None
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):
        kept += r["count"]
        if kept > most:
            break
        least = r["level"]
    return counts, counts.where(level >= least if least is not None else F.lit(False)).orderBy("key").toArrow()


def word_keys(texts: list[str]) -> np.ndarray:
    return textnum.words(*textnum.code_points(texts)).h.view(np.int64)


def token_ids(vocabulary: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id of each word, id of the word before it, text): 0 an unknown word, 1 the start of a text, then the vocabulary."""
    w = textnum.words(*textnum.code_points(texts))
    h = w.h.view(np.int64)
    at = np.minimum(np.searchsorted(vocabulary, h), max(0, len(vocabulary) - 1))
    ids = np.where(vocabulary[at] == h, at + 2, 0) if len(vocabulary) else np.zeros(len(h), np.int64)
    before = np.concatenate(([0], ids[:-1])) if len(ids) else ids
    before[w.first[:-1][np.diff(w.first) > 0]] = 1
    return ids, before, w.doc


class Model:
    """Log probabilities of both models: `paired` for the frequent bigrams, `value` for any; `alone` of a word plus `rest` of its context for one that a
    model never saw."""

    def __init__(self, vocabulary: np.ndarray, words: np.ndarray, contexts: np.ndarray):
        """words, contexts: counts by id, one column a model."""
        self.vocabulary, self.contexts = vocabulary, contexts
        p = WORD_WEIGHT * words / np.maximum(words.sum(0), 1) + (1 - WORD_WEIGHT) / len(words)
        self.p = np.where(words.sum(0) > 0, p, 1 / len(words))
        self.spent = np.where(contexts > 0, BIGRAM_WEIGHT, 0.0)
        self.alone, self.rest = np.log(self.p), np.log1p(-self.spent)
        self.pairs, self.paired = np.zeros(0, np.int64), np.zeros((0, 2))

    def value(self, pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """pairs: before * _PLACE + id; counts: of pairs, one column a model."""
        before, after = pairs // _PLACE, pairs % _PLACE
        return np.log(BIGRAM_WEIGHT * counts / np.maximum(self.contexts[before], 1) + (1 - self.spent[before]) * self.p[after])

    def losses(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Number of words of each text; minus the summed log probability without what its rare bigrams add, one column a model; those bigrams, each as often
        as it stands there."""
        ids, before, doc = token_ids(self.vocabulary, texts)
        key = before * _PLACE + ids
        out, rare = np.zeros((len(key), 2)), np.ones(len(key), bool)
        if len(self.pairs):
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            rare = self.pairs[at] != key
            out = np.where(rare[:, None], out, self.paired[at])
        many = np.bincount(doc[rare], minlength=len(texts))
        return np.bincount(doc, minlength=len(texts)), np.stack([-np.bincount(doc, out[:, j], len(texts)) for j in (0, 1)], 1), np.split(key[rare], np.cumsum(many)[:-1])


def models(texts: DataFrame) -> tuple[Model, DataFrame]:
    """Both models, and the bigrams (key, background, target) that are too many to broadcast."""
    counts, top = most_frequent(tallied(texts, word_keys), VOCABULARY, "words")
    vocabulary = top.column("key").to_numpy()
    total = counts.agg(F.coalesce(F.sum("background"), F.lit(0)), F.coalesce(F.sum("target"), F.lit(0))).first()
    words = np.zeros((len(vocabulary) + 2, 2))
    words[2:] = np.stack([top.column(c).to_numpy() for c in ("background", "target")], 1)
    words[0] = np.array(total) - words.sum(0)
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def pair_keys(some: list[str]) -> np.ndarray:
        ids, before, _ = token_ids(shared.value, some)
        return before * _PLACE + ids

    pairs, kept = most_frequent(tallied(texts, pair_keys), BIGRAMS, "pairs")
    by_context = pairs.groupBy((F.col("key") / _PLACE).cast("long").alias("id")).agg(F.sum("background").alias("b"), F.sum("target").alias("t")).collect()
    contexts = np.zeros_like(words)
    for r in by_context:  # at most VOCABULARY + 2 rows
        contexts[r["id"]] = r["b"], r["t"]
    model = Model(vocabulary, words, contexts)
    n = np.stack([kept.column(c).to_numpy() for c in ("background", "target")], 1)
    model.pairs, model.paired = kept.column("key").to_numpy(), model.value(kept.column("key").to_numpy(), n)
    # most_frequent keeps whole levels of counts: the rest is what lies under the least of them
    return model, pairs.where(F.col("background") + F.col("target") < int(n.sum(1).min())) if len(n) else pairs


def cross_entropy_difference(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_words, target_loss, background_loss (each a word), score = background_loss - target_loss."""
    texts = texts_of(docs)
    both = texts.select("text", F.lit(False).alias("target")).unionByName(target.select(F.coalesce("text", F.lit("")).alias("text"), F.lit(True).alias("target")))
    model, others = models(both)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            col = b.column(1).to_pylist()
            for lo, hi in textnum.chunks(col):
                n, loss, rare = shared.value.losses(col[lo:hi])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(n), pa.array(loss[:, 1], pa.float64()), pa.array(loss[:, 0], pa.float64()), pa.array(rare, pa.list_(pa.int64()))],
                    names=["doc_id", "n_words", "target", "background", "rare"],
                )

    def valued(batches):
        for b in batches:
            value = shared.value.value(b.column(0).to_numpy(), np.stack([b.column(k).to_numpy() for k in (1, 2)], 1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(-value[:, 1]), pa.array(-value[:, 0])], names=["key", "target", "background"])

    # a row has a number of its own: doc_id may be null or stand twice
    scored = texts.mapInArrow(run, "doc_id long, n_words long, target double, background double, rare array<long>")
    scored = written(scored.select(F.monotonically_increasing_id().alias("row"), "*"), "scored")
    values = others.select("key", "background", "target").mapInArrow(valued, "key long, target double, background double")
    met = scored.select("row", F.explode("rare").alias("key")).join(values.hint("merge"), "key")
    losses = [F.sum(c).alias(c) for c in ("target", "background")]
    none = F.lit(None).cast("long")
    parts = met.groupBy("row").agg(*losses).select("row", none.alias("doc_id"), none.alias("n_words"), "target", "background")
    every = scored.drop("rare").unionByName(parts).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), *losses)
    loss = {c: F.when(F.col("n_words") > 0, F.col(c) / F.col("n_words")) for c in ("target", "background")}
    score = F.coalesce(loss["background"] - loss["target"], F.lit(0.0))
    return every.select("doc_id", "n_words", loss["target"].alias("target_loss"), loss["background"].alias("background_loss"), score.alias("score"))
