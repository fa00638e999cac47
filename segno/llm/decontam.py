"""Benchmark decontamination: a BM25 inverted index of the test items, searched with block-max WAND.

The index maps a word to its items with their BM25 impacts, as a share of the item's score against itself;
items lie in blocks, and each word keeps its largest impact over all items and for each block. Every
overlapping passage of every text is a query: passages whose words' largest impacts cannot reach the
threshold are passed over, then blocks that cannot reach it, and all items at or above it are retrieved.
For a retrieved item the shares of five-word shingles of its question and of its answer (its last
sentence) that the passage holds are taken (those that touch it); it counts as a leak if at least LEAK of all its shingles and
at least half of the question's and of the answer's are there.

Items come in shards of at most SHARD_ITEMS, so what is broadcast at once is bounded; each shard is another
pass over the texts. Defined results: null texts and items count as empty and leak nothing; repeated
rows are searched each and give one row for each (doc_id, item_id); items of one id with different texts are items
each and give one row together; items under five words say too little and never leak; rows with a null id are left out;
empty tables give no rows; other columns are ignored; ties need no order, since all are retrieved.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum
from .tables import texts_of, written

SHARD_ITEMS = 20_000
#: Items of one block of the index.
BLOCK = 16
#: Share of an item's own BM25 score that a passage must reach.
RETRIEVE = 0.5
#: Share of an item's shingles that makes a leak.
LEAK = 0.8
#: Share of the question's and of the answer's shingles that must be there.
HALF = 0.5
K1, B = 1.2, 0.75


def item_parts(items: DataFrame) -> DataFrame:
    """item (a key of id and text), item_id, text, answer_from: the code point where the last sentence starts (0: a single sentence)."""
    text = F.coalesce("text", F.lit(""))
    lead = F.regexp_extract(text, r"(?s)^(.*[.!?\n])\s*[^\s.!?][^.!?\n]*[.!?\s]*$", 1)
    own = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), text.alias("text"), F.length(lead).alias("answer_from"))
    return own.select(F.xxhash64("item_id", "text").alias("item"), "*").distinct()


def item_words(items: DataFrame) -> DataFrame:
    """item, word, tf, size: the postings of the items."""

    def run(batches):
        for b in batches:
            ids, col = b.column(0).to_numpy(), b.column(1).to_pylist()
            for lo, hi in textnum.chunks(col):
                w = textnum.words(*textnum.code_points(col[lo:hi]))
                d, h, c = textnum.counted(w.doc, w.h)
                size = np.diff(w.first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[lo:hi][d]), pa.array(h.view(np.int64)), pa.array(c), pa.array(size[d].astype(np.int64))], names=["item", "word", "tf", "size"]
                )

    return items.select("item", "text").mapInArrow(run, "item long, word long, tf long, size long")


def spread(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges [start, stop), one after the other, and the range each comes from."""
    n = stop - start
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) + (start - np.cumsum(n) + n)[of], of


class Index:
    """One shard: postings by word, in blocks of items, and what verifies an item."""

    def __init__(self, postings, items, threshold: float):
        """Arrow tables: postings (item, word, impact), impact as a share; items (item, item_id, text, answer_from), by item."""
        self.threshold = threshold
        keys, self.ids = items.column("item").to_numpy(), items.column("item_id").to_numpy()
        item = np.searchsorted(keys, postings.column("item").to_numpy())
        word = postings.column("word").to_numpy().view(np.uint64)
        order = np.lexsort((item, word))
        word, self.item, self.impact = word[order], item[order], postings.column("impact").to_numpy()[order]
        self.words, self.first = np.unique(word, return_index=True)
        self.first = np.append(self.first, len(word))
        self.most = np.maximum.reduceat(self.impact, self.first[:-1]) if len(word) else np.zeros(0)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.words >> np.uint64(44)).astype(np.int64)] = True
        key = np.repeat(np.arange(len(self.words)), np.diff(self.first)) * (1 << 32) + self.item // BLOCK
        self.block_key, at = np.unique(key, return_index=True)
        self.block_most = np.maximum.reduceat(self.impact, at) if len(key) else np.zeros(0)
        self.block_from = np.append(at, len(key))
        self.word_blocks = np.searchsorted(self.block_key, np.arange(len(self.words) + 1) * (1 << 32))
        self.parts, longest = {}, 1
        for i, (text, split) in enumerate(zip(items.column("text").to_pylist(), items.column("answer_from").to_pylist())):
            w = textnum.words(*textnum.code_points([text]))
            longest = max(longest, len(w.h))
            cut = int(np.searchsorted(w.start, split))
            cut = cut if 0 < cut < len(w.h) else 0
            h, at = textnum.shingles(w)
            self.parts[i] = (h, h[at < cut] if cut else h, h[at + 4 >= cut])
        #: A passage is two strides long, so any item lies whole within one.
        self.stride = longest

    @staticmethod
    def shingle_set(text: str) -> np.ndarray:
        return np.unique(textnum.shingles(textnum.words(*textnum.code_points([text])))[0])

    def search(self, of: np.ndarray, word: np.ndarray) -> list[tuple[int, int, float]]:
        """(passage, item, score) of all that reach the threshold; of, word: passages and their distinct words, in order."""
        least = self.threshold - 1e-9
        bound = np.bincount(of, self.most[word])
        keep = bound[of] >= least
        of, word = of[keep], word[keep]
        if not len(of):
            return []
        # words of small impact that together stay under the threshold need not open a block
        rising = np.lexsort((self.most[word], of))
        total = np.cumsum(self.most[word[rising]])
        start = np.searchsorted(of, np.arange(of[-1] + 2))
        before = np.concatenate(([0.0], total))[start]
        needed = rising[total - before[of[rising]] >= least]
        at, i = spread(self.word_blocks[word[needed]], self.word_blocks[word[needed] + 1])
        opened = np.unique(of[needed][i] * (1 << 32) + (self.block_key[at] & 0xFFFFFFFF))
        who, block = opened >> 32, opened & 0xFFFFFFFF
        at, i = spread(start[who], start[who + 1])
        key = word[at] * (1 << 32) + block[i]
        k = np.minimum(np.searchsorted(self.block_key, key), len(self.block_key) - 1)
        real = self.block_key[k] == key
        k, i = k[real], i[real]
        able = np.bincount(i, self.block_most[k], len(opened)) >= least
        k, i = k[able[i]], i[able[i]]
        p, j = spread(self.block_from[k], self.block_from[k + 1])
        pair, of_pair = np.unique(who[i[j]] * (1 << 32) + self.item[p], return_inverse=True)
        score = np.bincount(of_pair, self.impact[p], len(pair))
        return [(int(x) >> 32, int(x) & 0xFFFFFFFF, float(y)) for x, y in zip(pair, score) if y >= least]

    def leaks(self, texts: list[str]):
        """(text, item, score, question share, answer share, all, first and last code point of the passage)."""
        cp, off = textnum.code_points(texts)
        w = textnum.words(cp, off)
        kept = w.h & ~np.uint64((1 << 20) - 1)
        hit = np.flatnonzero(self.maybe[(kept >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.words, kept[hit]), len(self.words) - 1)
        real = self.words[at] == kept[hit]
        hit, at = hit[real], at[real]
        if not len(hit):
            return
        place = (hit - w.first[w.doc[hit]]) // self.stride
        passage = w.doc[hit] * (1 << 32) + place
        # each word lies in the passage that starts in its stride and in the one that starts a stride before
        both = np.concatenate([passage, passage[place > 0] - 1])
        word = np.concatenate([at, at[place > 0]])
        names, of = np.unique(both, return_inverse=True)
        pair = np.unique(of.astype(np.int64) * len(self.words) + word)
        of, word = pair // len(self.words), pair % len(self.words)
        for p, i, score in self.search(of, word):
            d, k = int(names[p] >> 32), int(names[p] & 0xFFFFFFFF)
            a = w.first[d] + k * self.stride
            b = min(a + 2 * self.stride, w.first[d + 1])
            held = self.shingle_set(texts[d][w.start[a] : w.end[b - 1]])
            whole, question, answer = (float(np.isin(x, held).mean()) if len(x) else 0.0 for x in self.parts[i])
            if whole >= LEAK and min(question, answer) >= HALF:
                yield d, int(self.ids[i]), score, question, answer, whole, int(w.start[a]), int(w.end[b - 1])


SCHEMA = "doc_id long, item_id long, score double, question_share double, answer_share double, overlap double, start long, end long"


def indexes(items: DataFrame, threshold: float):
    """The index of each shard, one after the other; statistics are those of all items."""
    items = written(item_parts(items), "items")
    postings = written(item_words(items), "postings")
    n, mean = items.count(), postings.select("item", "size").distinct().agg(F.avg("size")).first()[0] or 1.0
    df = postings.groupBy("word").agg(F.count("*").alias("df"))
    impact = F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / mean))
    scored = postings.join(df, "word").select("item", "word", impact.alias("impact"))
    own = scored.groupBy("item").agg(F.sum("impact").alias("own"))
    shares = scored.join(own, "item").select("item", "word", (F.col("impact") / F.col("own")).alias("impact"))
    shards = -(-n // SHARD_ITEMS)
    for k in range(shards):
        mine = F.pmod(F.col("item"), F.lit(shards)) == k
        yield Index(shares.where(mine).toArrow(), items.where(mine).orderBy("item").toArrow(), threshold)


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = RETRIEVE) -> DataFrame:
    """One row for each document and test item that leaked into it, with its best passage."""
    spark = docs.sparkSession
    texts = texts_of(docs).where("doc_id is not null")
    out = spark.createDataFrame([], SCHEMA)
    for index in indexes(items, threshold):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            for b in batches:
                ids, col = b.column(0).to_pylist(), b.column(1).to_pylist()
                for lo, hi in textnum.chunks(col):
                    rows = [(ids[lo + d], *rest) for d, *rest in shared.value.leaks(col[lo:hi])]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=names)

        out = out.unionByName(texts.mapInArrow(run, SCHEMA))
    best = [F.max_by(c, F.struct("overlap", "score", -F.col("start"))).alias(c) for c in ("question_share", "answer_share", "overlap", "start", "end")]
    return out.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), *best)


def clean(docs: DataFrame, items: DataFrame, threshold: float = RETRIEVE) -> DataFrame:
    """The documents that hold no test item, with all their columns; every row is searched, also one without an id. Rows
    are dropped where they are read, so nothing is joined or moved."""
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    schema = rows.schema
    for index in indexes(items, threshold):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for b in batches:
                col = [t or "" for t in pc.struct_field(b.column(0), "text").to_pylist()]
                good = np.ones(len(col), bool)
                for lo, hi in textnum.chunks(col):
                    good[[lo + leak[0] for leak in shared.value.leaks(col[lo:hi])]] = False
                yield b.filter(pa.array(good))

        rows = rows.mapInArrow(run, schema)
    return rows.select("row.*")
