"""Exact top-k search by distributed histogram selection.

Components become floor(64 * x); scores are integer inner products. Candidates are packed into blocks where they
lie; queries come in shards of at most QUERY_SHARD, each broadcast in turn, so nothing is copied for every pair.
For a shard each pass over the candidates adds up one short histogram a query in every task and over all tasks.
The first pass finds each query's range of scores, the next ones split the range that holds the k-th highest
score into BINS parts until it is one score wide, and the last keeps the candidates at or above it. Of those a
block returns at most k for each query, by score and then by smaller vec_id, which no further one of the same
block can displace.

Defined results: vectors that are null, empty or hold a null, NaN or infinite component take no part; queries
meet candidates of the same length only; a query's own row is every row with its vec_id; repeated rows of
another vec_id are candidates each, and query rows that repeat a vec_id ask each, their answers ranked together; a
query with fewer than k candidates returns all; no rows, no results; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .tables import written

K, BINS = 20, 64
#: Queries broadcast at once, and vectors of a block of candidates.
QUERY_SHARD, CANDIDATE_BLOCK = 16_384, 4096
#: Above this bound on a score the product is taken in integers, else in doubles, which are exact to it.
EXACT = float(1 << 52)


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of long) of the vectors that take part."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.where("vec_id is not null and embedding is not null and size(embedding) > 0").where(fine)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * 64).cast("long")).alias("v"))


def blocks(rows: DataFrame) -> DataFrame:
    """dim, ids and vectors as bytes, up to CANDIDATE_BLOCK of one length to a block, packed where they are read."""

    def run(batches):
        for b in batches:
            ids, lists = b.column(0).to_numpy(), b.column(1)
            size, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
            start = np.concatenate(([0], np.cumsum(size)))
            for dim in np.unique(size):
                at = np.flatnonzero(size == dim)
                for lo in range(0, len(at), CANDIDATE_BLOCK):
                    some = at[lo : lo + CANDIDATE_BLOCK]
                    v = flat[start[some][:, None] + np.arange(dim)]
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids[some].tobytes()]), pa.array([v.tobytes()])], names=["dim", "ids", "vectors"])

    return rows.select("vec_id", "v").mapInArrow(run, "dim int, ids binary, vectors binary")


def scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products, exact."""
    bound = float(np.abs(q.astype(float)).max()) * float(np.abs(c.astype(float)).max()) * q.shape[1]
    if bound < EXACT:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q @ c.T


def over_blocks(candidates: DataFrame, shared, each, end, schema: str) -> DataFrame:
    """Every block of candidates against the shard of queries in `shared` (ids, vectors, state).

    each(rows of the shard, query ids, candidate ids, scores, own mask, state, held) takes a part of a block in and may
    give columns of rows; end(held) gives those of a task.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        ids, q, state = shared.value
        held: dict = {}
        for b in batches:
            for r in b.to_pylist():
                ci = np.frombuffer(r["ids"], np.int64)
                c = np.frombuffer(r["vectors"], np.int64).reshape(len(ci), -1)
                for lo in range(0, len(ids), 256):
                    at = np.arange(lo, min(lo + 256, len(ids)))
                    rows = each(at, ids[at], ci, scores(q[at], c), ids[at][:, None] == ci[None, :], state, held)
                    if rows is not None:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=names)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in end(held)], names=names)

    return candidates.mapInArrow(run, schema)


def value_range(at, q, c, s, own, state, held):
    if not held:
        n = len(state["low"])
        held |= {"low": np.full(n, np.iinfo(np.int64).max), "high": np.full(n, np.iinfo(np.int64).min), "n": np.zeros(n, np.int64)}
    held["low"][at] = np.minimum(held["low"][at], np.where(own, np.iinfo(np.int64).max, s).min(1))
    held["high"][at] = np.maximum(held["high"][at], np.where(own, np.iinfo(np.int64).min, s).max(1))
    held["n"][at] += len(c) - own.sum(1)


def ranges(held):
    at = np.flatnonzero(held["n"])
    return at, held["low"][at], held["high"][at], held["n"][at]


def histogram(at, q, c, s, own, state, held):
    if not held:
        held["n"] = np.zeros((len(state["low"]), BINS), np.int64)
    low, width, size = (state[k][at][:, None] for k in ("low", "width", "size"))
    inside = (s >= low) & (s - low < size) & ~own
    where = (np.arange(len(at))[:, None] * BINS + (s - low) // width)[inside]
    held["n"][at] += np.bincount(where, minlength=len(at) * BINS).reshape(-1, BINS)


def filled(held):
    at, bin_ = np.nonzero(held["n"])
    return at, bin_, held["n"][at, bin_]


def at_least(at, q, c, s, own, state, held):
    who, what = np.nonzero((s >= state["low"][at][:, None]) & (state["left"][at] > 0)[:, None] & ~own)
    value = s[who, what]
    order = np.lexsort((c[what], -value, who))
    who, what, value = who[order], what[order], value[order]
    start = np.searchsorted(who, np.arange(len(q)))
    keep = np.arange(len(who)) - start[who] < state["k"]
    return q[who[keep]], c[what[keep]], value[keep]


def kth_values(candidates: DataFrame, ids: np.ndarray, q: np.ndarray, k: int) -> dict:
    """For each query of a shard `low`: the k-th highest score (the least, if fewer); `left`: 0 where there is no candidate."""
    context = candidates.sparkSession.sparkContext
    n = len(ids)
    state = {"low": np.zeros(n, np.int64), "size": np.ones(n, np.int64), "width": np.ones(n, np.int64), "left": np.zeros(n, np.int64), "k": k}

    def gathered(each, end, schema: str, *sums) -> list[np.ndarray]:
        shared = context.broadcast((ids, q, state))
        keys = ["at"] if each is value_range else ["at", "bin"]
        got = over_blocks(candidates, shared, each, end, schema).groupBy(*keys).agg(*sums).toArrow()
        shared.destroy()
        return [got.column(c).to_numpy() for c in got.column_names]

    at, low, high, many = gathered(value_range, ranges, "at long, low long, high long, n long", F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
    state["low"][at], state["size"][at], state["left"][at] = low, high - low + 1, np.minimum(many, k)
    while (state["size"] > 1).any():
        state["width"] = -(-state["size"] // BINS)
        at, bin_, many = gathered(histogram, filled, "at long, bin long, n long", F.sum("n").alias("n"))
        counts = np.zeros((n, BINS), np.int64)
        counts[at, bin_] = many
        above = np.cumsum(counts[:, ::-1], 1)[:, ::-1]  # at or above each bin
        # the highest bin at which the count from above reaches what is left
        chosen = np.maximum((above >= np.maximum(state["left"], 1)[:, None]).sum(1) - 1, 0)
        over = np.where(chosen + 1 < BINS, above[np.arange(n), np.minimum(chosen + 1, BINS - 1)], 0)
        open_ = state["size"] > 1
        state["low"] = np.where(open_, state["low"] + chosen * state["width"], state["low"])
        state["left"] = np.where(open_, state["left"] - over, state["left"])
        state["size"] = np.where(open_, state["width"], 1)
    return state


def top_k(queries: DataFrame, vectors: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row the k best other vectors; ties go to the smaller vec_id.

    queries, vectors: vec_id, embedding.
    """
    spark = vectors.sparkSession
    packed = written(blocks(whole_vectors(vectors)), "candidates")
    asked = whole_vectors(queries)
    sizes = asked.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"))
    shards = F.ceil(F.col("n") / QUERY_SHARD)
    asked = asked.withColumn("dim", F.size("v")).join(sizes, "dim").select("dim", F.pmod(F.xxhash64("vec_id", "v"), shards).alias("shard"), "vec_id", "v")
    asked = written(asked, "queries")
    schema, found = "query_id long, vec_id long, score long", []
    for r in asked.select("dim", "shard").distinct().orderBy("dim", "shard").collect():
        mine = asked.where((F.col("dim") == r["dim"]) & (F.col("shard") == r["shard"])).orderBy("vec_id", "v").toArrow()
        ids, q = mine.column("vec_id").to_numpy(), mine.column("v").combine_chunks().flatten().to_numpy().reshape(mine.num_rows, -1)
        fits = packed.where(F.col("dim") == r["dim"]).select("ids", "vectors")
        state = kth_values(fits, ids, q, k)
        shared = spark.sparkContext.broadcast((ids, q, state))
        found.append(written(over_blocks(fits, shared, at_least, None, schema), "best"))
        shared.destroy()
    best = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
