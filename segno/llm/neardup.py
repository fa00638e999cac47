"""Near-duplicate classes: improved consistent weighted sampling over TF-IDF word shingles.

1. Document frequencies of shingles are counted over all documents in a sketch of fixed width (a one-row
   count sketch that only over-counts, by about the mean text length over the width as a share of documents);
   a shingle weighs its count in the text times 1 + IDF_SHARE * log((1 + N) / (1 + frequency)) / log(2 + N).
2. Every text draws BANDS * ROWS consistent weighted samples; each band of ROWS equal samples is a bucket.
   Texts with the same shingle counts are one class from the start and enter buckets once.
3. Texts that share buckets, over any number of steps, form crowds. A crowd of at most TOGETHER texts is compared
   whole in one task. In a larger one every text is first compared with the most central text of each of its
   buckets, which joins tight groups at linear cost; then the texts outside the largest joined part of a crowd meet
   all texts of the crowd in pairs of blocks of TOGETHER texts. If what is left of a crowd is still over CROWD texts,
   its buckets take its place. Every pair that shares a bucket is so either compared or in one class
   already; no task holds more than two blocks, and a task returns links that join classes, never all pairs.
4. Similarity is the exact weighted Jaccard similarity of whole texts; classes are the connected components of
   pairs at the threshold or above.

Defined results: null texts count as empty; a text without a word is a class of its own (one class per
doc_id); texts under five words are one shingle; repeated rows share their class and each row is returned; rows
of one doc_id with different texts each have the class of their text; rows with a null doc_id are left out
(`one_of_each` keeps them all); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import textnum
from .components import components
from .tables import texts_of, written

SHINGLE_WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 16, 4
#: Cells of the document-frequency sketch, a power of two; its size does not grow with the input.
SKETCH_BITS = 18
#: How much more the rarest shingle weighs than one that all texts hold.
IDF_SHARE = 0.2
#: Bits of the tables of random numbers that the samples are drawn from by hash.
DRAW_BITS = 16
#: Texts of a crowd that one task compares whole, and of a block of a larger one.
TOGETHER, CROWD = 256, 2048
#: Columns of shingles multiplied at once.
COLUMNS = 4096
_SHIFT = np.uint64(64 - SKETCH_BITS)


def _shingle_counts(texts: list[str]):
    """(text, shingle, count) arrays and the number of texts."""
    cp, off = textnum.code_points(texts)
    w = textnum.words(cp, off)
    h, at = textnum.shingles(w, SHINGLE_WORDS)
    return *textnum.counted(w.doc[at], h), len(texts)


def shingle_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Number of texts, and for each cell of the sketch the number of texts with a shingle there."""

    def run(batches):
        cells, n = np.zeros(1 << SKETCH_BITS, np.int64), 0
        for b in batches:
            col = b.column(0).to_pylist()
            for lo, hi in textnum.chunks(col):
                _, h, _, many = _shingle_counts(col[lo:hi])
                n += many
                cells += np.bincount((h >> _SHIFT).astype(np.int64), minlength=len(cells))
        used = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-1], used))), pa.array(np.concatenate(([n], cells[used])))], names=["cell", "n"])

    got = texts.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << SKETCH_BITS)
    cell, n = got.column("cell").to_numpy(), got.column("n").to_numpy()
    out[cell[cell >= 0]] = n[cell >= 0]
    return int(n[cell < 0].sum()), out


def idf_of(n: int, frequency: np.ndarray) -> np.ndarray:
    """Weights from 1 (in every text) to 1 + IDF_SHARE: a large group of copies makes its own shingles frequent,
    and must not fall under the threshold for that."""
    return (1 + IDF_SHARE * np.log((1 + n) / (1 + np.minimum(frequency, n))) / np.log(2 + n)).astype(np.float32)


class Sampler:
    """Consistent weighted samples: for each of the draws, the element and level with the least ln a."""

    def __init__(self, draws: int = BANDS * ROWS, seed: int = 11):
        rng = np.random.default_rng(seed)
        size = 1 << DRAW_BITS
        self.r = rng.gamma(2, 1, size).astype(np.float32)
        self.inv = (1 / self.r).astype(np.float32)
        self.beta = rng.random(size, np.float32)
        self.less = (self.r * (self.beta - 1)).astype(np.float32)
        self.ln_c = np.log(rng.gamma(2, 1, size)).astype(np.float32)
        self.odd = rng.integers(0, 1 << 63, draws, np.uint64) * np.uint64(2) + np.uint64(1)

    def draw(self, h: np.ndarray, weight: np.ndarray, start: np.ndarray, many: np.ndarray) -> np.ndarray:
        """h, weight: elements, grouped; start, many: of each group, none empty. One row of samples per group."""
        ln_w, out = np.log(weight), np.zeros((len(start), len(self.odd)), np.uint64)
        high, low = np.uint64(64 - DRAW_BITS), np.uint64((1 << DRAW_BITS) - 1)
        for k, odd in enumerate(self.odd):
            x = h * odd
            i, j = (x >> high).view(np.int64), ((x >> np.uint64(32)) & low).view(np.int64)
            level = self.inv.take(i)
            level *= ln_w
            level += self.beta.take(i)
            np.floor(level, out=level)
            ln_a = self.r.take(i)
            ln_a *= level
            np.subtract(self.less.take(i), ln_a, out=ln_a)
            ln_a += self.ln_c.take(j)
            least = np.flatnonzero(ln_a == np.repeat(np.minimum.reduceat(ln_a, start), many))
            at = least[np.searchsorted(least, start)]
            out[:, k] = h[at] ^ (level[at].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return out


def signatures(texts: DataFrame, idf) -> DataFrame:
    """doc_id, f1, f2 (equal for equal shingle counts), buckets (one for each band; null without words)."""

    def run(batches):
        sampler = Sampler()
        for b in batches:
            col = b.column(1).to_pylist()
            for lo, hi in textnum.chunks(col, 1 << 18):
                d, h, c, n = _shingle_counts(col[lo:hi])
                many = np.bincount(d, minlength=n)
                has = np.flatnonzero(many)
                start = np.searchsorted(d, has)
                bands = [None] * n
                marks = [np.zeros(n, np.uint64), np.zeros(n, np.uint64)]
                if len(has):
                    x = h * np.uint64(2) + c.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
                    for k, m in enumerate(marks):
                        m[has] = np.add.reduceat(textnum.mix(x + np.uint64(k)), start)
                    s = sampler.draw(h, c.astype(np.float32) * idf.value[(h >> _SHIFT).astype(np.int64)], start, many[has])
                    key = np.zeros((len(has), BANDS), np.uint64)
                    for j in range(ROWS):
                        key = textnum.mix(key ^ s[:, j::ROWS][:, :BANDS]) + np.arange(BANDS, dtype=np.uint64)
                    for i, row in zip(has, key.view(np.int64)):
                        bands[i] = row
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, n), *(pa.array(m.view(np.int64)) for m in marks), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "f1", "f2", "buckets"]
                )

    return texts.mapInArrow(run, "doc_id long, f1 long, f2 long, buckets array<long>")


def similarities(pairs: DataFrame, idf) -> DataFrame:
    """a, b and their weighted Jaccard similarity, from rows (a, b, text_a, text_b)."""

    def run(batches):
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for lo, hi in textnum.chunks([x + y for x, y in zip(left, right)]):
                both = [[np.asarray(x) for x in _shingle_counts(t[lo:hi])] for t in (left, right)]
                d = np.concatenate([both[0][0], both[1][0]])
                h = np.concatenate([both[0][1], both[1][1]])
                w = np.concatenate([both[0][2], both[1][2]]) * idf.value[(h >> _SHIFT).astype(np.int64)].astype(np.float64)
                order = np.lexsort((h, d))
                d, h, w = d[order], h[order], w[order]
                twice = np.flatnonzero((d[1:] == d[:-1]) & (h[1:] == h[:-1]))
                shared = np.bincount(d[twice], np.minimum(w[twice], w[twice + 1]), hi - lo)
                total = np.bincount(d, w, hi - lo) - shared
                s = np.divide(shared, total, out=np.zeros(hi - lo), where=total > 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(s)], names=["a", "b", "similarity"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, similarity double")


def close_pairs(texts: list[str], labels: np.ndarray, left: np.ndarray, weights: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Pairs of texts at the threshold or above that join different labels, as few as join them all.

    left: texts to compare with every other one; weights: of the sketch cells.
    """
    d, h, c, n = _shingle_counts(texts)
    w = weights[(h >> _SHIFT).astype(np.int64)].astype(np.float64)
    total = np.bincount(d, w * c, n)
    # an element that occurs c times counts as c elements, so that sums over shared ones are sums of least counts
    level = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
    d, w, h = np.repeat(d, c), np.repeat(w, c), np.repeat(h, c) + level.astype(np.uint64)
    _, column, many = np.unique(h, return_inverse=True, return_counts=True)
    twice = many[column] > 1
    d, w, column = d[twice], w[twice], (np.cumsum(many > 1) - 1)[column[twice]]
    order = np.argsort(column, kind="stable")
    d, w, column = d[order], w[order], column[order]
    shared = np.zeros((len(left), n))
    place = np.full(n, -1)
    place[left] = np.arange(len(left))
    last = int(column[-1]) + 1 if len(column) else 0
    for lo in range(0, last, COLUMNS):
        a, b = np.searchsorted(column, (lo, lo + COLUMNS))
        here = np.zeros((n, min(COLUMNS, last - lo)))
        here[d[a:b], column[a:b] - lo] = 1
        weight = np.zeros(here.shape[1])
        weight[column[a:b] - lo] = w[a:b]
        shared += (here[left] * weight) @ here.T
    similar = shared / np.maximum(total[left][:, None] + total[None, :] - shared, 1e-12) >= threshold - 1e-9
    similar &= labels[left][:, None] != labels[None, :]
    root = {int(x): int(x) for x in labels}

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for i, j in zip(*np.nonzero(similar)):
        a, b = top(int(labels[left[i]])), top(int(labels[j]))
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((int(left[i]), int(j)))
    return out


def links_within(groups: DataFrame, keys: list[str], idf, threshold: float) -> DataFrame:
    """a, b: links found in each group of keys; groups: keys, first (compared with all), node, label, text."""

    def run(key, t):
        t = t.combine_chunks()
        node, label = t.column("node").to_numpy(), t.column("label").to_numpy()
        left = np.flatnonzero(t.column("first").to_numpy(zero_copy_only=False))
        found = close_pairs(t.column("text").to_pylist(), label, left, idf.value, threshold) if len(left) else []
        a, b = (np.array([node[p[k]] for p in found], np.int64) for k in (0, 1))
        return pa.table({"a": a, "b": b})

    return groups.select(*keys, "first", "node", "label", "text").groupBy(*keys).applyInArrow(run, "a long, b long")


def crowds(member: DataFrame) -> DataFrame:
    """node, crowd: nodes that share buckets, over any number of steps; member: bucket, node."""
    first = member.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most")
    edges = member.join(first, "bucket").where("node > least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    return components(edges).withColumnRenamed("component", "crowd")


def leader_links(member: DataFrame, bodies: DataFrame, idf, threshold: float) -> DataFrame:
    """a, b: links of texts to the most central text of each of their buckets (ties by a hash of text and bucket).

    A text first meets that of its largest bucket; those of its other buckets only where both are not joined with one text already.
    """
    sizes = member.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    sized = member.join(sizes, "bucket")
    centre = sized.groupBy("node").agg(F.sum("n").alias("centre"))
    leader = sized.join(centre, "node").groupBy("bucket").agg(F.max_by("node", F.struct("centre", F.xxhash64("node", "bucket"))).alias("leader"))
    met = written(sized.join(leader, "bucket").select("node", "leader", "n"), "met")
    left, right = (bodies.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")

    def linked(pairs: DataFrame) -> DataFrame:
        # dealt by the texts, of which none has many pairs, where they are compared
        return written(similarities(pairs.join(right, "b").join(left, "a"), idf).where(F.col("similarity") >= threshold).select("a", "b"), "leaders")

    top = met.groupBy("node").agg(F.max_by("leader", F.struct("n", "leader")).alias("top"))
    near = linked(top.where("node <> top").select(F.col("node").alias("a"), F.col("top").alias("b")))
    held = written(top.join(near.select(F.col("a").alias("node"), "b"), "node", "left").select("node", "top", F.coalesce("b", "node").alias("held")), "held")
    others = met.where("node <> leader").select("node", "leader").distinct().join(held, "node").where("leader <> top")
    others = others.join(held.select(F.col("node").alias("leader"), F.col("held").alias("held_leader")), "leader").where("held <> held_leader")
    return near.unionByName(linked(others.select(F.col("node").alias("a"), F.col("leader").alias("b"))))


def in_blocks(rows: DataFrame) -> DataFrame:
    """rows (kind, id, node, label) with i, j, first: the pairs of blocks in which texts outside the largest label of
    their group meet all others."""
    key = ["kind", "id"]
    own = rows.groupBy(*key, "label").agg(F.count("*").alias("n"))
    main = own.groupBy(*key).agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n"))
    main = main.where("n > n_main").select(*key, "main", F.ceil((F.col("n") - F.col("n_main")) / TOGETHER).alias("r"), F.ceil(F.col("n_main") / TOGETHER).alias("m"))
    spot = F.when(F.col("label") != F.col("main"), F.pmod(F.xxhash64("node"), F.col("r"))).otherwise(F.col("r") + F.pmod(F.xxhash64("node", F.lit(1)), F.col("m")))
    rows = rows.join(main, key).withColumn("spot", spot)
    pair = "array<struct<i:bigint,j:bigint>>"
    none = F.array().cast(pair)
    ahead = F.transform(F.sequence("spot", F.col("r") + F.col("m") - 1), lambda j: F.struct(F.col("spot").alias("i"), j.alias("j"))).cast(pair)
    before = F.least("spot", "r")
    behind = F.transform(F.sequence(F.lit(0).cast("long"), before - 1), lambda i: F.struct(i.alias("i"), F.col("spot").alias("j"))).cast(pair)
    met = F.concat(F.when(F.col("spot") < F.col("r"), ahead).otherwise(none), F.when(before > 0, behind).otherwise(none))
    rows = rows.select(*key, "node", "label", "spot", F.explode(met).alias("met"))
    return rows.select(*key, "met.i", "met.j", "node", "label", (F.col("spot") == F.col("met.i")).alias("first"))


def large_crowd_links(member: DataFrame, bodies: DataFrame, idf, threshold: float) -> DataFrame:
    """a, b: links in crowds too large for one task; member: bucket, node of such crowds."""
    near = leader_links(member, bodies, idf, threshold)
    label = components(near).select("node", F.col("component").alias("label"))
    labelled = written(member.join(label, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label")), "labelled")
    open_ = labelled.groupBy("bucket").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least < most").select("bucket")
    open_ = written(labelled.join(open_, "bucket"), "open")
    # what is left of a crowd: labels that still share buckets
    left = crowds(open_.select("bucket", F.col("label").alias("node")).distinct()).select(F.col("node").alias("label"), "crowd")
    placed = open_.join(left, "label")
    sizes = placed.select("crowd", "node").distinct().groupBy("crowd").agg(F.count("*").alias("n"))
    placed = placed.join(sizes, "crowd")
    small = F.col("n") <= CROWD
    rows = placed.select(F.when(small, 0).otherwise(1).alias("kind"), F.when(small, F.col("crowd")).otherwise(F.col("bucket")).alias("id"), "node", "label").distinct()
    groups = in_blocks(written(rows, "groups"))
    found = links_within(groups.join(bodies, "node"), ["kind", "id", "i", "j"], idf, threshold)
    return near.unionByName(found)


def verified_links(texts: DataFrame, classes: DataFrame, idf, threshold: float = THRESHOLD) -> DataFrame:
    """a, b: links that join all texts of a class, between representatives that share a bucket."""
    member = classes.where("buckets is not null").select(F.explode("buckets").alias("bucket"), F.col("rep").alias("node"))
    found = crowds(member)
    # large crowds are few, so no crowd need be gathered to learn of its size
    sizes = found.groupBy("crowd").agg(F.count("*").alias("n")).where(F.col("n") > TOGETHER).select("crowd", F.lit(True).alias("large"))
    crowd = written(found.join(F.broadcast(sizes), "crowd", "left").select("node", "crowd", F.col("large").isNotNull().alias("large")), "crowds")
    bodies = texts.withColumnRenamed("doc_id", "node").join(crowd, "node")
    bodies = written(bodies.select("node", "crowd", "large", "text").distinct(), "bodies")
    small = bodies.where("not large").select("crowd", F.lit(True).alias("first"), "node", F.col("node").alias("label"), "text")
    links = written(links_within(small, ["crowd"], idf, threshold), "links")
    large = crowd.where("large")
    if not large.isEmpty():
        inside = written(member.join(large.select("node"), "node").select("bucket", "node"), "large")
        more = written(large_crowd_links(inside, bodies.where("large").select("node", "text"), idf, threshold), "links")
        links = links.unionByName(more)
    return links


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (least doc_id of its class), copy_of (least doc_id with equal shingle counts)."""
    spark = docs.sparkSession
    texts = texts_of(docs).where("doc_id is not null")
    n, frequency = shingle_frequencies(texts)
    idf = spark.sparkContext.broadcast(idf_of(n, frequency))
    signed = written(signatures(texts, idf), "signatures")
    worded = signed.where("buckets is not null")
    classes = written(worded.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.min_by("buckets", "doc_id").alias("buckets")), "classes")
    label = components(verified_links(texts, classes, idf, threshold))
    idf.destroy()
    of_rep = classes.select("f1", "f2", "rep").join(label.withColumnsRenamed({"node": "rep"}), "rep", "left")
    rows = signed.select("doc_id", "f1", "f2", F.col("buckets").isNull().alias("blank"))
    return (
        rows.where("not blank")
        .join(of_rep, ["f1", "f2"])
        .select("doc_id", F.coalesce("component", "rep").alias("class_id"), F.col("rep").alias("copy_of"))
        .unionByName(rows.where("blank").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_of")))
    )


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without near-duplicates: of each class one row, that of the least doc_id (of equal rows of that id and text one), and
    every row with a null doc_id, which is compared with none. Rows that share a doc_id and have different texts are compared as different
    documents, after those whose doc_id names one text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    hashed = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("h"))
    several = written(hashed.groupBy("id").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high").select("id"), "several")
    rows = docs.where("doc_id is not null").select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"))
    node = F.col("id")
    if not several.isEmpty():
        rows = rows.join(several.withColumn("more", F.lit(True)), "id", "left")
        own = F.lit(1 << 62) + F.pmod(F.xxhash64("id", F.coalesce("row.text", F.lit(""))), F.lit(1 << 61))
        node = F.when(F.col("more"), own).otherwise(node)
    rows = rows.select(node.alias("node"), "row")
    kept = near_duplicates(rows.select(F.col("node").alias("doc_id"), F.col("row.text").alias("text")), threshold).where("doc_id = class_id").select(F.col("doc_id").alias("node")).distinct()
    ties = F.xxhash64(*[F.col(f"row.{c}") for c, kind in docs.dtypes if "map<" not in kind])
    first = F.row_number().over(Window.partitionBy("node").orderBy(F.col("row.text").asc_nulls_first(), ties))
    held = rows.join(kept, "node", "left_semi").withColumn("place", first).where("place = 1").select("row.*")
    return held.unionByName(docs.where("doc_id is null"))
