"""Note confidence: a standardised logistic regression, scored on songs that it has not seen."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..sources.quality import written


def fit_confidence(rows: DataFrame, features: list[str], label: str = "y", c: float = 1.0) -> dict:
    """{features, mean, scale, weights, intercept}: population standard deviations scale the features (0 counts as 1); an L2 penalty of
    1 / (c * n), since the loss is an average."""
    facts = rows.agg(*[f(x).alias(f"{x}_{n}") for x in features for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))], F.count("*").alias("n"), F.avg(label).alias("rate")).first()
    mean, scale = [float(facts[f"{x}_m"] or 0) for x in features], [float(facts[f"{x}_s"] or 1) or 1.0 for x in features]
    if not facts["n"] or facts["rate"] in (0.0, 1.0):
        rate = facts["rate"] if facts["n"] else 0.5
        return {"features": features, "mean": mean, "scale": scale, "weights": [0.0] * len(features), "intercept": 30.0 if rate == 1 else -30.0 if rate == 0 else 0.0}
    z = F.array(*[(F.col(x) - m) / s for x, m, s in zip(features, mean, scale)])
    model = LogisticRegression(labelCol=label, regParam=1 / (c * facts["n"]), elasticNetParam=0.0, standardization=False, maxIter=50).fit(rows.select(label, array_to_vector(z).alias("features")))
    return {"features": features, "mean": mean, "scale": scale, "weights": [float(w) for w in model.coefficients], "intercept": float(model.intercept)}


def score_confidence(model: dict) -> Column:
    """The chance of label 1 as a plain expression over the features."""
    z = F.lit(model["intercept"])
    for x, m, s, w in zip(model["features"], model["mean"], model["scale"], model["weights"]):
        z = z + w * (F.col(x) - m) / s
    return 1 / (1 + F.exp(-z))


def sums_of_folds(rows: DataFrame, models: list[tuple[np.ndarray, float]], d: int, first: int = 0) -> np.ndarray:
    """For each fold's model (from fold `first` on) the sums over all rows of other folds of the slope (d + 1) and of the upper curvature, in one pass.

    rows: fold, y, x (array). A batch meets all models in two products of matrices; own rows weigh nothing.
    """
    upper = np.triu_indices(d + 1)
    shared = rows.sparkSession.sparkContext.broadcast((np.array([w for w, _ in models]).T, np.array([b for _, b in models])))
    names = ["model", *[f"s{i}" for i in range(d + 1 + len(upper[0]))]]

    def run(batches):
        weights, intercepts = shared.value
        held = np.zeros((len(names) - 1, len(intercepts)))
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            fold, y = b.column("fold").to_numpy(), b.column("y").to_numpy()
            one = np.hstack([x, np.ones((len(x), 1))])
            p = 1 / (1 + np.exp(-np.clip(x @ weights + intercepts, -500, 500)))
            other = fold[:, None] != np.arange(first, first + len(intercepts))[None, :]
            held += np.vstack([one.T @ ((p - y[:, None]) * other), (one[:, upper[0]] * one[:, upper[1]]).T @ (p * (1 - p) * other)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(held.shape[1])), *[pa.array(row) for row in held]], names=names)

    parts = rows.select("fold", "y", "x").mapInArrow(run, "model long, " + ", ".join(f"{n} double" for n in names[1:]))
    got = parts.groupBy("model").agg(*[F.sum(n).alias(n) for n in names[1:]]).orderBy("model").toArrow()
    shared.destroy()
    return np.stack([got.column(n).to_numpy() for n in names[1:]], 1)


def folds_of(rows: DataFrame, song: str, most: int) -> tuple[DataFrame, int]:
    """(rows + fold, number of folds): a song is a fold; beyond `most` songs they share folds by a hash."""
    songs = rows.select(song).distinct()
    n = songs.count()
    if n > most:
        return rows.withColumn("fold", F.pmod(F.xxhash64(song), F.lit(most))), most
    numbers = songs.select(song, (F.row_number().over(Window.orderBy(song)) - 1).cast("long").alias("fold"))
    return rows.join(F.broadcast(numbers), song), n


def fit_left_out(rows: DataFrame, features: list[str], folds: int, label: str = "y", c: float = 1.0, rounds: int = 50) -> list[tuple[np.ndarray, float]]:
    """For each fold (weights, intercept) over raw features of the model that fit_confidence gives on all other folds.

    Means and deviations are total sums less own ones. All models take their Newton steps together: one pass over the rows adds up
    slope and curvature for each, so the number of passes does not depend on the number of folds. They start from the model of all rows,
    whose own passes are cheap and which theirs differ little from. rows: fold, label, features.
    """
    d = len(features)
    facts = [f(x).alias(f"{n}{i}") for i, x in enumerate(features) for n, f in (("a", F.sum), ("b", lambda v: F.sum(F.col(v) * F.col(v))))]
    own = rows.groupBy("fold").agg(F.count("*").alias("n"), F.sum(label).alias("ones"), *facts).toArrow()
    at = own.column("fold").to_numpy()
    sums = np.zeros((folds, 2 + 2 * d))
    sums[at] = np.stack([own.column(x).to_numpy() for x in ["n", "ones", *(f"{k}{i}" for k in "ab" for i in range(d))]], 1)
    # one more model, of no fold's own rows, leaves out nothing
    sums = np.vstack([sums, np.zeros((1, sums.shape[1]))])
    rest = sums.sum(0) - sums
    n, ones = rest[:, 0], rest[:, 1]
    mean = rest[:, 2 : 2 + d] / np.maximum(n, 1)[:, None]
    spread = rest[:, 2 + d :] / np.maximum(n, 1)[:, None] - mean**2
    scale = np.sqrt(np.where(spread > 1e-12 * (1 + mean**2), spread, 1.0))
    lone = (n == 0) | (ones == 0) | (ones == n)
    weights, intercepts = np.zeros((folds + 1, d)), np.where(n == 0, 0.0, np.where(ones == 0, -30.0, np.where(ones == n, 30.0, 0.0)))
    held = written(rows.select("fold", F.col(label).cast("double").alias("y"), F.array(*[F.col(x).cast("double") for x in features]).alias("x")), "confidence")
    i, j = np.triu_indices(d + 1)

    def fitted(part: slice, first: int, weights: np.ndarray, intercepts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The models of `part` by Newton steps from weights and intercepts; first: the fold that the first of them leaves out."""
        n, alone, wide, middle = len(intercepts), lone[part], scale[part], mean[part]
        for _ in range(rounds if not alone.all() else 0):
            got = sums_of_folds(held, list(zip(weights, intercepts)), d, first)
            slope, bend = got[:, : d + 1], np.zeros((n, d + 1, d + 1))
            bend[:, i, j] = bend[:, j, i] = got[:, d + 1 :]
            penalty = np.hstack([wide**2 / c, np.zeros((n, 1))])
            slope = slope + penalty * np.hstack([weights, intercepts[:, None]])
            bend[:, range(d + 1), range(d + 1)] += np.where(penalty > 0, penalty, 1e-12)
            step = np.where(alone[:, None], 0.0, np.linalg.solve(bend, slope[..., None])[..., 0])
            # in units of the margin: a step that would move a usual row by more than 4 is shortened
            size = np.abs(step[:, :d] * wide).sum(1) + np.abs(step[:, d] + (step[:, :d] * middle).sum(1))
            step *= np.minimum(1.0, 4.0 / np.maximum(size, 1e-300))[:, None]
            weights, intercepts = weights - step[:, :d], intercepts - step[:, d]
            if size.max() < 1e-9:
                break
        return weights, intercepts

    whole = slice(folds, folds + 1)
    w, b = fitted(whole, folds, weights[whole], intercepts[whole])
    weights = np.where(lone[:folds, None], weights[:folds], w)
    intercepts = np.where(lone[:folds], intercepts[:folds], b)
    return list(zip(*fitted(slice(0, folds), 0, weights, intercepts)))


def held_out_report(rows: DataFrame, features: list[str], song: str, label: str = "y", most_folds: int = 1024) -> DataFrame:
    """song, notes, mean_p, mean_y, ece of each song, scored by the model of all other songs (of all other folds, beyond most_folds songs)."""
    # what the features come from is computed once, not for each of the passes below
    rows = written(rows.select(*dict.fromkeys([song, label, *features])), "confidence_rows")
    rows, folds = folds_of(rows, song, most_folds)
    models = fit_left_out(rows, features, folds, label)
    table = rows.sparkSession.createDataFrame([(k, [float(x) for x in w], float(b)) for k, (w, b) in enumerate(models)], "fold long, weights array<double>, intercept double")
    x = F.array(*[F.col(f).cast("double") for f in features])
    z = F.aggregate(F.zip_with("weights", x, lambda w, v: w * v), F.col("intercept"), lambda a, v: a + v)
    scored = rows.join(F.broadcast(table), "fold").select(song, F.col(label).alias("y"), (1 / (1 + F.exp(-z))).alias("p")).withColumn("bin", F.least(F.floor(F.col("p") * 10), F.lit(9)))
    bins = scored.groupBy(song, "bin").agg(F.count("*").alias("n"), F.avg("p").alias("p"), F.avg("y").alias("y"))
    n = F.sum("n")
    return bins.groupBy(song).agg(n.alias("notes"), F.round(F.sum(F.col("p") * F.col("n")) / n, 4).alias("mean_p"), F.round(F.sum(F.col("y") * F.col("n")) / n, 4).alias("mean_y"), F.round(F.sum(F.abs(F.col("p") - F.col("y")) * F.col("n")) / n, 4).alias("ece"))
