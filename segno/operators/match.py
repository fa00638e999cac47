"""Tolerance joins between note lists: bucketed equi-joins instead of range joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def near(left: DataFrame, right: DataFrame, keys: list[str], tol_us: int, how: str = "inner", t: str = "onset_us") -> DataFrame:
    """left rows with right rows of the same keys at most tol_us away (right columns prefixed r_); how as in join.

    The right side goes to its bucket and both neighbours, so one equi-join on (keys, bucket) finds every pair once.
    """
    width = tol_us + 1
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    r = r.withColumn("_b", F.explode(F.array(*[F.floor(F.col(f"r_{t}") / width) + i for i in (-1, 0, 1)])))
    r = r.hint("merge")  # three times as many as Spark takes them for: never broadcast
    lf = left.withColumn("_b", F.floor(F.col(t) / width))
    on = (lf["_b"] == r["_b"]) & (F.abs(lf[t] - r[f"r_{t}"]) <= tol_us)
    for k in keys:
        on = on & (lf[k] == r[f"r_{k}"])
    out = lf.join(r, on, how)
    return out.select(*left.columns) if how in ("left_semi", "left_anti") else out.select(*left.columns, *[c for c in r.columns if c != "_b"])


def nearest_within(left: DataFrame, right: DataFrame, keys: list[str], tol_us: int) -> DataFrame:
    """note_id, residual_us to the nearest right onset of the same keys; ties to the earlier one."""
    pairs = near(left, right, keys, tol_us)
    away = F.col("onset_us") - F.col("r_onset_us")
    return pairs.groupBy("note_id").agg(F.min_by(away, F.struct(F.abs(away), "r_onset_us")).alias("residual_us"))


def match_count(ref: DataFrame, est: DataFrame, keys: list[str], tol_us: int) -> DataFrame:
    """keys, tp, n_ref, n_est: most one-to-one pairs within tol_us.

    Onsets fall into components wherever a gap is over tol_us; in each a fold over sorted onsets pairs the earliest
    open one of the other side, which is optimal for one tolerance. Only a component is gathered, never a song.
    """
    both = ref.select(*keys, F.col("onset_us").alias("t"), F.lit(0).alias("side")).unionByName(est.select(*keys, F.col("onset_us").alias("t"), F.lit(1).alias("side")))
    w = Window.partitionBy(*keys).orderBy("t", "side")
    part = F.sum(F.when(F.col("t") - F.lag("t").over(w) > tol_us, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    groups = both.withColumn("part", part).groupBy(*keys, "part").agg(F.array_sort(F.collect_list(F.struct("t", "side"))).alias("xs"))

    def step(acc, x):
        open_ = F.filter(acc["open"], lambda o: o["t"] >= x["t"] - tol_us)
        other = (F.size(open_) > 0) & (F.coalesce(F.try_element_at(open_, F.lit(1))["side"], F.lit(-1)) != x["side"])
        rest = F.when(other, F.slice(open_, 2, F.greatest(F.size(open_) - 1, F.lit(0)))).otherwise(F.concat(open_, F.array(x)))
        return F.struct((acc["n"] + other.cast("int")).alias("n"), rest.alias("open"))

    zero = F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<t:bigint,side:int>>").alias("open"))
    n = F.aggregate("xs", zero, step)["n"]
    side = lambda s: F.size(F.filter("xs", lambda x: x["side"] == s))
    return groups.select(*keys, n.alias("tp"), side(0).alias("n_ref"), side(1).alias("n_est")).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("tp", "n_ref", "n_est")])


def notes_in_bars(notes: DataFrame, beats: DataFrame) -> DataFrame:
    """song_id, note_id, bar for each bar that a note sounds in: covered beats are exploded, then equi-joined."""
    from .timeline import time_to_beat

    n = beats.groupBy("song_id").agg(F.max("beat_no").alias("_last"))
    on = time_to_beat(notes, beats, "onset_us").withColumnRenamed("beat_pos", "a")
    both = time_to_beat(on, beats, "offset_us").withColumnRenamed("beat_pos", "b").join(n, "song_id")
    lo, hi = F.least(F.greatest(F.floor("a"), F.lit(0)), "_last"), F.least(F.greatest(F.ceil("b") - 1, F.floor("a"), F.lit(0)), "_last")
    covered = both.select("song_id", "note_id", F.explode(F.sequence(lo, F.greatest(lo, hi))).alias("beat_no")).hint("merge")
    return covered.join(beats.select("song_id", "beat_no", "bar"), ["song_id", "beat_no"]).select("song_id", "note_id", "bar").distinct()
