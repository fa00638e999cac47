"""Bars that resemble each other, and what follows for their notes and windows.

A repeat map (matches) holds song_id, bar, other, score, place: for each bar the bars it resembles, best first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .match import near

#: Bars of a song that are compared with all others at a time.
PAIR_ROWS = 512


def similar_bars(vectors: DataFrame, least: float = 0.6, top: int = 8) -> DataFrame:
    """The repeat map of bars given as vectors (song_id, bar, feature, x; what is not given is 0).

    Features are standardised over a song's bars, bars compared by their cosine, and each score averaged with those of the bars just before and just after both;
    scores of at least `least` count, the `top` best of each bar. Features that never vary say nothing, and bars without any vary stay out.
    All pairs of a song are compared where its bars lie, some rows of pairs at a time; only pairs that may count leave the task.
    """

    def compare(key, t):
        bars, at = np.unique(t.column("bar").to_numpy(), return_inverse=True)
        features, of = np.unique(np.array(t.column("feature").to_pylist()), return_inverse=True)
        x = np.zeros((len(bars), len(features)))
        x[at, of] = t.column("x").to_numpy()
        x = x[:, x.max(0) > x.min(0)]
        z = (x - x.mean(0)) / x.std(0)
        norm = np.sqrt((z * z).sum(1))
        z, bars = z[norm > 0] / norm[norm > 0, None], bars[norm > 0]
        # each bar with the ones before and after it in one row, which is 0 where there is none
        sides, there = [z], [np.ones(len(bars))]
        for step in (-1, 1):
            i = np.minimum(np.searchsorted(bars, bars + step), max(len(bars) - 1, 0))
            has = (bars[i] == bars + step).astype(float) if len(bars) else np.zeros(0)
            sides.append(z[i] * has[:, None])
            there.append(has)
        wide, count = np.hstack(sides), np.stack(there, 1)
        found = [(bars[:0], bars[:0], np.zeros(0))]
        for lo in range(0, len(bars), PAIR_ROWS):
            score = wide[lo : lo + PAIR_ROWS] @ wide.T / (count[lo : lo + PAIR_ROWS] @ count.T)
            a, b = np.nonzero((score >= least - 1e-5) & (bars[lo : lo + PAIR_ROWS, None] < bars))
            found.append((bars[lo + a], bars[b], score[a, b]))
        a, b, raw = (np.concatenate(c) for c in zip(*found))
        song = pa.array([key[0].as_py()] * len(a), t.schema.field("song_id").type)
        return pa.table({"song_id": song, "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "raw": pa.array(raw, pa.float64())})

    rows = vectors.select("song_id", F.col("bar").cast("long").alias("bar"), "feature", F.coalesce(F.col("x").cast("double"), F.lit(0.0)).alias("x")).dropna()
    pairs = rows.groupBy("song_id").applyInArrow(compare, f"song_id {rows.schema['song_id'].dataType.simpleString()}, a long, b long, raw double")
    kept = pairs.select("song_id", "a", "b", F.round("raw", 6).alias("score")).where(F.col("score") >= least)
    ways = F.explode(F.array(F.struct(F.col("a").alias("bar"), F.col("b").alias("other")), F.struct(F.col("b").alias("bar"), F.col("a").alias("other"))))
    each = kept.select("song_id", "score", ways.alias("w")).select("song_id", "w.bar", "w.other", "score")
    return each.withColumn("place", F.row_number().over(Window.partitionBy("song_id", "bar").orderBy(F.desc("score"), "other"))).where(F.col("place") <= top)


def best_match(matches: DataFrame, least: float) -> DataFrame:
    """song_id, bar, other: the first match of each bar that scores `least`."""
    return matches.where(F.col("score") >= least).groupBy("song_id", "bar").agg(F.min_by("other", "place").alias("other"))


def repeat_note_links(notes: DataFrame, bars: DataFrame, matches: DataFrame, least: float = 0.5, tol_us: int = 60_000) -> DataFrame:
    """a, b, both ways: a note and the one it repeats. notes have their bar, bars their start_us.

    The bar's best match moves the note to the same time after that bar's start; the nearest note of its pitch within tol_us there (then the lower note_id), in that bar
    or one beside it, is linked. Notes without a bar and bars without a match have no link.
    """
    start = bars.select("song_id", "bar", "start_us")
    moved = best_match(matches, least).join(start, ["song_id", "bar"]).join(start.withColumnsRenamed({"bar": "other", "start_us": "_to"}), ["song_id", "other"])
    left = notes.join(moved, ["song_id", "bar"]).select("song_id", "note_id", "pitch", "other", (F.col("onset_us") - F.col("start_us") + F.col("_to")).alias("onset_us"))
    pairs = near(left, notes.select("song_id", "note_id", "pitch", "bar", "onset_us"), ["song_id", "pitch"], tol_us)
    pairs = pairs.where((F.abs(F.col("r_bar") - F.col("other")) <= 1) & (F.col("note_id") != F.col("r_note_id")))
    best = pairs.groupBy("note_id").agg(F.min_by("r_note_id", F.struct(F.abs(F.col("onset_us") - F.col("r_onset_us")), "r_note_id")).alias("b"))
    ways = F.explode(F.array(F.struct(F.col("note_id").alias("a"), F.col("b").alias("b")), F.struct(F.col("b").alias("a"), F.col("note_id").alias("b"))))
    return best.select(ways.alias("w")).select("w.a", "w.b").distinct()


def repeat_window_pairs(windows: DataFrame, matches: DataFrame, least: float = 0.5) -> DataFrame:
    """song_id, a, b (a < b): windows where over half of the matched bars of one have their best match in the other. windows: song_id, w, bar; a bar in several
    windows counts for the first. Bars without a match do not vote; matches outside all windows, or within the same one, vote for no pair."""
    home = windows.groupBy("song_id", "bar").agg(F.min("w").alias("w"))
    voters = best_match(matches, least).join(home, ["song_id", "bar"]).join(home.withColumnsRenamed({"bar": "other", "w": "v"}), ["song_id", "other"], "left")
    counted = voters.groupBy("song_id", "w", "v").agg(F.count("*").alias("n")).withColumn("_all", F.sum("n").over(Window.partitionBy("song_id", "w")))
    won = counted.where((F.col("v") != F.col("w")) & (F.col("n") * 2 > F.col("_all")))
    return won.select("song_id", F.least("w", "v").alias("a"), F.greatest("w", "v").alias("b")).distinct()
