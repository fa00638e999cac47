"""Tracked beats of a song: doubled ones, missing ones and runs at half or twice the tempo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .cluster import runs_of


def by_song(*order: str):
    w = Window.partitionBy("song_id")
    return w.orderBy(*order) if order else w


def merge_double_beats(beats: DataFrame, ratio: float = 0.42) -> DataFrame:
    """song_id, t_us, down of beats (song_id, t_us, down boolean, act) of which none is tracked twice.

    Two beats are one if they lie closer than `ratio` of the intervals on both sides, the shorter counting. The one with the higher activation
    `act` stays (unknown counts 0), then the one that parts its surroundings more evenly, then the earlier; it is a downbeat if either was. Such
    pairs never share a beat. Songs of fewer than three beats stay as they are.
    """
    t, before, after, next_after = F.col("t_us"), F.col("_p"), F.col("_n"), F.col("_n2")
    far = F.lit(float("inf"))
    b = beats.select(
        "song_id", "t_us", "down", F.coalesce("act", F.lit(0.0)).cast("double").alias("_a"), F.count("*").over(by_song()).alias("_size"),
        F.lag("t_us").over(by_song("t_us")).alias("_p"), F.lead("t_us").over(by_song("t_us")).alias("_n"), F.lead("t_us", 2).over(by_song("t_us")).alias("_n2"),
    )
    pair = (after - t < ratio * F.least(F.coalesce((t - before).cast("double"), far), F.coalesce((next_after - after).cast("double"), far))) & (F.col("_size") >= 3)

    def uneven(x: Column) -> Column:
        inside = before.isNotNull() & next_after.isNotNull()
        return F.when(inside, F.round(F.abs(F.ln((x - before) / (next_after - x))), 9)).otherwise(0.0)

    mine, other = F.col("_a"), F.lead("_a").over(by_song("t_us"))
    earlier = F.when(mine != other, mine > other).otherwise(uneven(t) <= uneven(after))
    b = b.withColumn("_pair", F.coalesce(pair, F.lit(False))).withColumn("_first", earlier)
    second = F.coalesce(F.lag("_pair").over(by_song("t_us")), F.lit(False))
    b = b.select("*", second.alias("_second"), F.lag("_first").over(by_song("t_us")).alias("_lost"), F.lag("down").over(by_song("t_us")).alias("_pd"), F.lead("down").over(by_song("t_us")).alias("_nd"))
    gone = (F.col("_pair") & ~F.col("_first")) | (F.col("_second") & F.coalesce("_lost", F.lit(False)))
    down = F.col("down") | (F.col("_pair") & F.coalesce("_nd", F.lit(False))) | (F.col("_second") & F.coalesce("_pd", F.lit(False)))
    return b.where(~gone).select("song_id", "t_us", down.alias("down"))


def fill_missing_beats(beats: DataFrame, around: int = 4, tolerance: float = 0.08, longest_us: int = 4_000_000) -> DataFrame:
    """song_id, t_us double, filled: an interval of k (2 or more) times the median of the intervals up to `around` away, within `tolerance` of it and at most
    `longest_us` long, gets k - 1 evenly spaced beats. Songs of fewer than four beats get none."""
    gaps = beats.select("song_id", "t_us", (F.lead("t_us").over(by_song("t_us")) - F.col("t_us")).alias("_iv"), F.count("*").over(by_song()).alias("_size"))
    gaps = gaps.where("_iv is not null and _size >= 4").withColumn("_local", F.percentile("_iv", F.lit(0.5)).over(by_song("t_us").rowsBetween(-around, around)))
    gaps = gaps.where("_local > 0").withColumn("_k", F.round(F.col("_iv") / F.col("_local")).cast("long"))
    whole = (F.col("_k") >= 2) & (F.col("_iv") <= longest_us) & (F.abs(F.col("_iv") / F.col("_k") - F.col("_local")) <= tolerance * F.col("_local"))
    new = gaps.where(whole).withColumn("_j", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_k") - 1)))
    new = new.select("song_id", (F.col("t_us") + F.col("_iv") * F.col("_j") / F.col("_k")).alias("t_us"), F.lit(True).alias("filled"))
    return beats.select("song_id", F.col("t_us").cast("double").alias("t_us"), F.lit(False).alias("filled")).unionByName(new)


def tempo_level_runs(beats: DataFrame, band: float = 0.25, least: int = 2) -> DataFrame:
    """song_id, kind, start_us, end_us, n: runs of at least `least` intervals near half (fast) or twice (slow) the song's interval, which is the median weighted
    by length; near is within `band` octaves. start_us and end_us are the beats that open the run's first and last interval."""
    gaps = beats.select("song_id", "t_us", (F.lead("t_us").over(by_song("t_us")) - F.col("t_us")).alias("_iv")).where("_iv > 0")
    passed = F.sum("_iv").over(by_song("_iv", "t_us").rowsBetween(Window.unboundedPreceding, 0))
    half = gaps.select("song_id", "_iv", passed.alias("_passed"), F.sum("_iv").over(by_song()).alias("_all")).where("_passed >= 0.5 * _all")
    level = F.log2(F.col("_iv") / F.col("_usual"))
    kind = F.when(F.abs(level + 1) < band, "fast").when(F.abs(level - 1) < band, "slow").otherwise("even")
    marked = gaps.join(half.groupBy("song_id").agg(F.min("_iv").alias("_usual")), "song_id").withColumn("kind", kind)
    runs = runs_of(marked, ["song_id"], "t_us", "kind", least).where("kind <> 'even'")
    return runs.select("song_id", "kind", F.col("first").alias("start_us"), F.col("last").alias("end_us"), "n")
