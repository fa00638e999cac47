"""Embedding whitening by spectrum slicing of the exact covariance.

Entries become integers, floor(64 * c) + 1000000. Sums and centred products are added up in Spark, each block of rows
exactly in whole numbers around an integer near the mean, so the covariance of the distinct vectors does not depend on how rows
are dealt. Only a matrix of dimension times dimension reaches the driver. There the numbers of negative pivots of LDL^T
factors of shifted covariances count the eigenvalues under a shift; bisection with these counts isolates each leading
eigenvalue, Rayleigh quotient iteration converges to it and its vector, and two further counts certify its number.

Defined results: vectors that are null, empty, or hold a null or non-finite entry take no part; rows that repeat a vector are
returned each and count once in the fit; a null vec_id is kept; vectors of another length are fitted and whitened among
themselves; entries beyond 2^40 units count as 2^40, and a deviation beyond the range of long as its largest value; a
component without variance (under ZERO of the trace) cannot be whitened and is left out, so that one distinct vector gives no rows; equal
eigenvalues get orthogonal vectors of their common space; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written

#: Fixed values of the contract: components of the result, units to one, what is added.
COMPONENTS, UNITS, ADDED = 16, 64, 1_000_000
#: Variance, as a share of the trace, under which a component has none.
ZERO = 1e-12
#: Entries are held to this; a whole number of doubles holds products of two rows of that size only one by one.
FARTHEST = 1 << 40
EXACT = float(1 << 53)
LONGEST = (1 << 63) - 1


@dataclass
class Whitening:
    """Of vectors of one length: their number n, sums, components in rows, eigenvalues and trace."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0


def whole(vectors: DataFrame) -> DataFrame:
    """vec_id, dim, x (array of long) of the vectors that take part."""
    c = F.transform("embedding", lambda v: v.cast("double"))
    fine = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.where("embedding is not null and size(embedding) > 0").where(fine)
    held = F.transform(c, lambda v: F.floor(F.least(F.greatest(v * UNITS, F.lit(-float(FARTHEST))), F.lit(float(FARTHEST)))).cast("long") + ADDED)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("dim"), held.alias("x"))


def matrices(batch: pa.RecordBatch, column: str):
    """(dim, rows of the batch, matrix) for each length in it."""
    lists = batch.column(column)
    start, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    size = np.diff(start)
    for dim in np.unique(size[size > 0]):
        at = np.flatnonzero(size == dim)
        yield int(dim), at, flat[start[at][:, None] + np.arange(dim)]


def products(x: np.ndarray) -> np.ndarray:
    """x transposed times x for whole numbers, exact, as Python integers where longs would not hold it."""
    largest = float(np.abs(x).max(initial=0)) ** 2
    if largest * len(x) < EXACT:
        return (x.astype(float).T @ x.astype(float)).astype(np.int64).astype(object)
    return x.astype(object).T @ x.astype(object)


def summed(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """n and sums of each length."""
    parts = fit.select("dim", F.posexplode("x").alias("i", "v")).groupBy("dim", "i").agg(F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s"))
    found: dict[int, tuple[int, list[int]]] = {}
    for r in parts.orderBy("dim", "i").collect():
        found.setdefault(r["dim"], (r["n"], []))[1].append(int(r["s"]))
    return found


def centred_products(fit: DataFrame, centres: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Sums over rows of (x - centre)(x - centre)^T of each length, in exact whole numbers."""
    shared = fit.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for dim, _, x in matrices(b, "x"):
                held[dim] = held.get(dim, 0) + products(x - shared.value[dim])
        for dim, m in held.items():
            i, j = np.triu_indices(dim)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), dim), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([str(v) for v in m[i, j]])], names=["dim", "i", "j", "v"])

    parts = fit.select("x").mapInArrow(run, "dim int, i int, j int, v string")
    got = parts.groupBy("dim", "i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    shared.destroy()
    out = {dim: np.zeros((dim, dim), object) for dim in centres}
    for r in got:
        out[r["dim"]][r["i"], r["j"]] = out[r["dim"]][r["j"], r["i"]] = int(r["v"])
    return out


def covariance(n: int, sums: list[int], centre: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The covariance with divisor n, rounded once from its exact value."""
    rest = [s - n * int(c) for s, c in zip(sums, centre)]
    d = len(rest)
    out = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            out[i, j] = out[j, i] = float(Fraction(n * m[i, j] - rest[i] * rest[j], n * n))
    return out


def under(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric v are smaller than shift: the negative pivots of an LDL^T factor of v - shift.

    Pivots are single or of two rows, the larger of diagonal and off-diagonal choice, so that factors stay bounded.
    """
    a, negative, k = v - shift * np.eye(len(v)), 0, 0
    tiny = np.finfo(float).tiny * 2**60
    d = len(a)
    while k < d:
        rest = np.abs(a[k:, k:])
        on = int(np.argmax(np.diag(rest)))
        off = np.unravel_index(int(np.argmax(rest - np.diag(np.diag(rest)))), rest.shape) if d - k > 1 else (0, 0)
        if d - k == 1 or rest[on, on] >= 0.64 * rest[off]:
            swap(a, k, k + on)
            p = a[k, k] if abs(a[k, k]) > tiny else -tiny
            negative += p < 0
            c = a[k + 1 :, k].copy()
            a[k + 1 :, k + 1 :] -= np.outer(c, c / p)
            k += 1
        else:
            i, j = sorted(off)
            swap(a, k, k + i)
            swap(a, k + 1, k + j)
            block, c = a[k : k + 2, k : k + 2], a[k + 2 :, k : k + 2].copy()
            negative += 1  # its determinant is negative: one pivot of each sign
            a[k + 2 :, k + 2 :] -= c @ np.linalg.solve(block, c.T)
            k += 2
    return negative


def swap(a: np.ndarray, i: int, j: int) -> None:
    if i != j:
        a[[i, j]] = a[[j, i]]
        a[:, [i, j]] = a[:, [j, i]]


def rayleigh(v: np.ndarray, low: float, high: float, before: list[np.ndarray], seed: int) -> tuple[float, np.ndarray] | None:
    """An eigenvalue in [low, high] and its vector, orthogonal to those before; None if the iteration leaves the interval."""
    d, scale = len(v), np.abs(v).max()
    q = np.array(before)

    def step(y: np.ndarray, shift: float) -> np.ndarray:
        a = v - shift * np.eye(d)
        try:
            y = np.linalg.solve(a, y)
        except np.linalg.LinAlgError:
            y = np.linalg.solve(a + 4e-16 * scale * np.eye(d), y)
        for _ in range(2 if before else 0):
            y = y - q.T @ (q @ y)
        return y / np.linalg.norm(y)

    y = np.random.default_rng(seed).standard_normal(d)
    for _ in range(4):  # towards the middle of the interval first
        y = step(y, (low + high) / 2)
    slack = 1e-13 * scale * d
    best, value, worst = y, float(y @ v @ y), np.inf
    for _ in range(12):
        shift = float(y @ v @ y)
        off = float(np.linalg.norm(v @ y - shift * y))
        if off < worst:
            best, value, worst = y, shift, off
        elif off >= worst and worst < slack:
            break
        y = step(y, shift)
    return (value, best) if worst < slack and low - slack <= value <= high + slack else None


def leading(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors in rows) of the `most` largest eigenvalues with variance, by falling value."""
    d = len(v)
    trace = float(np.trace(v))
    bound = float(np.abs(v).sum(1).max())
    if not trace > 0:
        return np.zeros(0), np.zeros((0, d))
    floor, resolution = ZERO * trace, 4e-16 * bound * d
    counted: dict[float, int] = {}

    def above(shift: float) -> int:
        if shift not in counted:
            counted[shift] = d - under(v, shift)
        return counted[shift]

    many = min(most, above(floor))
    values: list[float] = []
    vectors: list[np.ndarray] = []
    while len(values) < many:
        k = len(values)
        low, high = floor, min([bound * (1 + 1e-12), *values[-1:]]) + resolution
        # the interval shrinks around the k-th from above, down to where it is alone in it or cannot be told from the next
        low = max([s for s, n in counted.items() if n > k and s <= high], default=low)
        found = None
        while found is None:
            middle = (low + high) / 2
            if high - low > resolution and low < middle < high:
                low, high = (middle, high) if above(middle) > k else (low, middle)
            alone = above(low) == k + 1
            if (alone and high - low < 0.25 * high) or high - low <= 4 * resolution:
                found = rayleigh(v, low, high, vectors, k)
                if found is None and high - low <= resolution:
                    raise ArithmeticError(f"component {k + 1} did not converge")
        values.append(found[0])
        vectors.append(found[1] * np.sign(found[1][np.argmax(np.abs(found[1]))]))
    for k, e in enumerate(values):  # the counts on both sides certify the number
        slack = max(8 * resolution, 1e-12 * e)
        if not (above(e - slack) >= k + 1 and above(e + slack) <= k):
            raise ArithmeticError(f"component {k + 1} has the wrong number")
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], np.array(vectors)[order]


def projected(x: np.ndarray, w: Whitening) -> np.ndarray:
    """Whitened rows: x - S/n, taken exactly before it is rounded, on the components, over the roots of their eigenvalues."""
    centre = np.array([round(Fraction(s, w.n)) for s in w.sums], np.int64)
    rest = np.array([float(Fraction(s, w.n) - int(c)) for s, c in zip(w.sums, centre)])
    return ((x - centre).astype(float) - rest) @ w.vectors.T / np.sqrt(w.values)


def identity_errors(fit: DataFrame, models: dict[int, Whitening]) -> None:
    """Sets identity_error: how far the covariance of the whitened fit list is from the identity, at most."""
    shared = fit.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for dim, _, x in matrices(b, "x"):
                y = projected(x, shared.value[dim])
                held[dim] = held.get(dim, 0) + np.vstack([y.T @ y, y.sum(0)])
        for dim, m in held.items():
            i, j = np.indices(m.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), dim), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(m.ravel())], names=["dim", "i", "j", "v"])

    parts = fit.select("x").mapInArrow(run, "dim int, i int, j int, v double")
    total = {dim: np.zeros((len(w.values) + 1, len(w.values))) for dim, w in models.items()}
    for r in parts.groupBy("dim", "i", "j").agg(F.sum("v").alias("v")).collect():
        total[r["dim"]][r["i"], r["j"]] = r["v"]
    shared.destroy()
    for dim, w in models.items():
        mean = total[dim][-1] / w.n
        w.identity_error = float(np.abs(total[dim][:-1] / w.n - np.outer(mean, mean) - np.eye(len(mean))).max(initial=0))


def fit_whitening(rows: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """By length of vectors: what whitens them, fitted on the distinct ones. rows: dim, x."""
    fit = written(rows.select("dim", "x").distinct(), "fit")
    found = summed(fit)
    centres = {dim: np.array([round(Fraction(s, n)) for s in sums], np.int64) for dim, (n, sums) in found.items()}
    models = {}
    for dim, m in centred_products(fit, centres).items():
        n, sums = found[dim]
        v = covariance(n, sums, centres[dim], m)
        values, vectors = leading(v, components)
        models[dim] = Whitening(n, sums, vectors, values, float(np.trace(v)))
    identity_errors(fit, models)
    return models


def deviations(x: np.ndarray, w: Whitening) -> np.ndarray:
    """Sum over dimensions of (n * x - S)^2, exact; LONGEST where no long holds it."""
    centre = [round(Fraction(s, w.n)) for s in w.sums]
    rest = np.array([w.n * c - s for c, s in zip(centre, w.sums)], object)
    near = x - np.array(centre, np.int64)
    largest = (w.n * float(np.abs(near).max(initial=0)) + w.n) ** 2 * x.shape[1]
    if largest < float(1 << 62):
        return ((w.n * near + rest.astype(np.int64)) ** 2).sum(1)
    exact = ((w.n * near.astype(object) + rest) ** 2).sum(1)
    return np.array([min(int(v), LONGEST) for v in exact], np.int64)


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, n, deviation, whitened and explained (arrays by component), identity_error of every vector that takes part."""
    rows = whole(vectors)
    shared = vectors.sparkSession.sparkContext.broadcast(fit_whitening(rows, components))

    def run(batches):
        for b in batches:
            for dim, at, x in matrices(b, "x"):
                w = shared.value[dim]
                y, many = projected(x, w), len(w.values)
                ends = pa.array(np.arange(len(at) + 1) * many, pa.int32())
                columns = {
                    "vec_id": b.column("vec_id").take(pa.array(at)),
                    "n": pa.array(np.full(len(at), w.n)),
                    "deviation": pa.array(deviations(x, w)),
                    "whitened": pa.ListArray.from_arrays(ends, pa.array(y.ravel())),
                    "explained": pa.ListArray.from_arrays(ends, pa.array(np.tile(w.values / (w.trace or 1.0), len(at)))),
                    "identity_error": pa.array(np.full(len(at), w.identity_error)),
                }
                yield pa.RecordBatch.from_pydict(columns)

    return rows.select("vec_id", "x").mapInArrow(run, "vec_id long, n long, deviation long, whitened array<double>, explained array<double>, identity_error double")


def whitened_components(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    pairs = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "of")
    rows = whitened(vectors, components).select("vec_id", "n", "deviation", "identity_error", pairs)
    return rows.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.col("of.whitened").alias("whitened"), F.col("of.explained").alias("explained"), "identity_error"
    )
