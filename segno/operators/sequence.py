"""Window features, layers, roles and rankings of notes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def polyphony(notes: DataFrame, around_us: int = 30_000, dense_us: int = 1_000_000) -> DataFrame:
    """note_id, poly (notes within around_us), density (within dense_us), rel_pitch (to the song's median), dur_us."""
    w = Window.partitionBy("song_id").orderBy("onset_us")
    median = F.percentile("pitch", F.lit(0.5)).over(Window.partitionBy("song_id"))
    return notes.select(
        "note_id", F.count("*").over(w.rangeBetween(-around_us, around_us)).alias("poly"), F.count("*").over(w.rangeBetween(-dense_us, dense_us)).alias("density"),
        F.round(F.col("pitch") - median, 6).alias("rel_pitch"), (F.col("offset_us") - F.col("onset_us")).alias("dur_us"),
    )


def chord_share(notes: DataFrame, least: float = 0.6) -> DataFrame:
    """song_id, second, n, chords (notes in chords), role: seconds whose chord share reaches `least` are rhythm."""
    w = Window.partitionBy("song_id", "onset_us")
    s = notes.withColumn("c", F.count("*").over(w)).groupBy("song_id", F.expr("onset_us div 1000000").alias("second"))
    s = s.agg(F.count("*").alias("n"), F.count_if(F.col("c") >= 2).alias("chords"))
    return s.select("*", F.when(F.col("chords") >= least * F.col("n"), "rhythm").otherwise("lead").alias("role"))


def peeled_layers(clustered: DataFrame, step: int = 10) -> DataFrame:
    """note_id, role of clustered notes: top if at least `step` above the next lower note of its cluster, chord in a cluster
    of 3, else line."""
    w = Window.partitionBy("song_id", "anchor_us")
    down = w.orderBy(F.desc("pitch"), "note_id")
    n, place, below = F.count("*").over(w), F.row_number().over(down), F.lead("pitch").over(down)
    top = (place == 1) & (F.col("pitch") - below >= step)
    return clustered.select("note_id", F.when(top, "top").when(n >= 3, "chord").otherwise("line").alias("role"))


def order_lines(notes: DataFrame) -> DataFrame:
    """song_id, line, place: the line with most notes first, the rest by first onset."""
    g = notes.groupBy("song_id", "line").agg(F.count("*").alias("n"), F.min("onset_us").alias("first"))
    w = Window.partitionBy("song_id")
    g = g.withColumn("main", F.row_number().over(w.orderBy(F.desc("n"), "line")) == 1)
    return g.select("song_id", "line", "n", F.row_number().over(w.orderBy(F.desc("main"), "first", "line")).alias("place"))


def tempo_levels(beats: DataFrame) -> DataFrame:
    """song_id, beat_no, interval_us, local_us (median of up to 9 intervals around), ratio."""
    w = Window.partitionBy("song_id").orderBy("beat_no")
    iv = beats.withColumn("interval_us", F.lead("t_us").over(w) - F.col("t_us")).where("interval_us is not null")
    local = F.percentile("interval_us", F.lit(0.5)).over(w.rowsBetween(-4, 4))
    return iv.select("song_id", "beat_no", "interval_us", F.round(local, 6).alias("local_us"), F.round(F.col("interval_us") / local, 6).alias("ratio"))


def top_rows(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """df + place of the first k rows of each key in a total order."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= k)


def even_sample(df: DataFrame, keys: list[str], order: str, k: int) -> DataFrame:
    """k rows of each key, evenly spaced in order (all, if fewer)."""
    w = Window.partitionBy(*keys)
    rows = df.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    new = F.floor(F.col("_i") * k / F.col("_n")) != F.floor((F.col("_i") - 1) * k / F.col("_n"))
    return rows.where((F.col("_n") <= k) | (F.col("_i") == 0) | new).drop("_i", "_n")


def identity_switches(notes: DataFrame, block_us: int = 2_000_000) -> DataFrame:
    """song_id, blocks, switches: how often the commonest line of a block (ties: the lowest) differs from the block before."""
    n = notes.groupBy("song_id", F.expr(f"onset_us div {block_us}").alias("block"), "line").agg(F.count("*").alias("n"))
    mode = n.groupBy("song_id", "block").agg(F.max_by("line", F.struct("n", -F.col("line"))).alias("line"))
    w = Window.partitionBy("song_id").orderBy("block")
    return mode.withColumn("same", F.col("line") == F.lag("line").over(w)).groupBy("song_id").agg(F.count("*").alias("blocks"), F.count_if(~F.col("same")).alias("switches"))


def calibration_error(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """One row: expected calibration error over equal-width bins."""
    b = df.groupBy(F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).alias("b")).agg(F.count("*").alias("n"), F.avg(p).alias("p"), F.avg(y).alias("y"))
    return b.agg(F.round(F.sum(F.abs(F.col("p") - F.col("y")) * F.col("n")) / F.sum("n"), 6).alias("ece"), F.sum("n").alias("n"))
