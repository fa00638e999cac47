"""Repeat consensus: the occurrences of a repeat vote, bar by bar, on what one of them lacks or has alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..sources.quality import written
from .cluster import anchored_clusters
from .harmony import CELL_US
from .match import near
from .timeline import beat_to_time, time_to_beat

#: Positions count whole millionths of a beat, so that comparisons are exact.
FINE = 1_000_000
CELL = ["song_id", "group", "k"]


def aligned_bars(occurrences: DataFrame, bars: DataFrame, beats: DataFrame, least: int) -> DataFrame:
    """song_id, group, k, occ, start_us, end_us (of the occurrence's own time), offset_us, first_beat: bar k of every occurrence of groups with
    `least` occurrences, where all of them have that bar with as many beats."""
    w = Window.partitionBy("song_id", "group")
    rows = occurrences.withColumn("_n", F.count("*").over(w)).withColumn("_common", F.min("n_bars").over(w)).where(F.col("_n") >= least)
    rows = rows.select("song_id", "group", "occ", "offset_us", "_n", "start_bar", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_common").cast("long") - 1)).alias("k"))
    first = beats.where("beat = 1").select("song_id", "bar", F.col("beat_no").alias("first_beat"))
    rows = rows.withColumn("bar", F.col("start_bar") + F.col("k")).join(bars.join(first, ["song_id", "bar"]), ["song_id", "bar"])
    same = Window.partitionBy(*CELL)
    whole = (F.count("*").over(same) == F.col("_n")) & (F.min("n_beats").over(same) == F.max("n_beats").over(same))
    return rows.withColumn("_whole", whole).where("_whole").select(*CELL, "occ", (F.col("start_us") + F.col("offset_us")).alias("start_us"), (F.col("end_us") + F.col("offset_us")).alias("end_us"), "offset_us", "first_beat")


def notes_in_cells(notes: DataFrame, cells: DataFrame, beats: DataFrame, cell_us: int = CELL_US) -> DataFrame:
    """cells + note_id, pitch, instrument, pos (from the bar's first beat) and dur, in millionths of a beat; they meet in cells of time."""
    spans = cells.select("*", F.explode(F.sequence(F.floor(F.col("start_us") / cell_us), F.floor((F.col("end_us") - 1) / cell_us))).alias("_cell"))
    both = notes.select("song_id", "note_id", "pitch", "instrument", "onset_us", F.greatest("onset_us", "offset_us").alias("offset"), F.floor(F.col("onset_us") / cell_us).alias("_cell")).join(spans, ["song_id", "_cell"])
    both = both.where("onset_us >= start_us and onset_us < end_us").withColumn("_on", F.col("onset_us") - F.col("offset_us")).withColumn("_off", F.col("offset") - F.col("offset_us"))
    at = time_to_beat(both, beats, "_on").withColumnRenamed("beat_pos", "_a")
    at = time_to_beat(at, beats, "_off")
    fine = lambda c: F.round(c * FINE).cast("long")
    return at.select(*CELL, "occ", "offset_us", "first_beat", "note_id", "pitch", "instrument", fine(F.col("_a") - F.col("first_beat")).alias("pos"), fine(F.col("beat_pos") - F.col("_a")).alias("dur"))


def repeat_consensus(
    notes: DataFrame, beats: DataFrame, bars: DataFrame, occurrences: DataFrame, least_occurrences: int = 3, least_notes: int = 3, similar: float = 0.7, share: float = 1.0, tol_beats: float = 0.125, dup_us: int = 50_000
) -> tuple[DataFrame, DataFrame]:
    """(added, lone). Voters of an occurrence at a bar are the others that hold `similar` of its notes (at least least_notes of them) there; the
    same pitch within tol_beats is the same note.

    added: song_id, group, k, occ, pitch, onset_us, offset_us, instrument, support: notes that it lacks and at least two and `share` of its voters
    hold, at their median position and length, unless it has that pitch within dup_us. lone: song_id, note_id of notes that none of two or
    more voters holds. occurrences: song_id, group, occ, start_bar, n_bars, offset_us.
    """
    tol = round(tol_beats * FINE)
    cells = aligned_bars(occurrences, bars, beats, least_occurrences)
    held = written(notes_in_cells(notes, cells, beats), "held")
    own = held.select(*CELL, "occ", "pitch", "pos", "note_id")
    other = held.select(*CELL, F.col("occ").alias("voter"), "pitch", "pos", "dur", "instrument", F.col("note_id").alias("id"))
    meets = near(own, other, [*CELL, "pitch"], tol, t="pos").where("occ <> r_voter")
    size = own.groupBy(*CELL, "occ").agg(F.count("*").alias("n")).where(F.col("n") >= least_notes)
    hits = meets.groupBy(*CELL, "occ", F.col("r_voter").alias("voter")).agg(F.count_distinct("note_id").alias("hit"))
    votes = hits.join(size, [*CELL, "occ"]).where(F.col("hit") / F.col("n") >= similar).select(*CELL, "occ", "voter", F.count("*").over(Window.partitionBy(*CELL, "occ")).alias("voters")).where("voters >= 2")
    votes = written(votes, "votes")
    backed = meets.select(*CELL, "occ", "note_id", F.col("r_voter").alias("voter")).join(votes, [*CELL, "occ", "voter"], "left_semi")
    lone = own.join(votes, [*CELL, "occ"], "left_semi").join(backed.select(*CELL, "occ", "note_id"), [*CELL, "occ", "note_id"], "left_anti").select("song_id", "note_id").distinct()
    asked = votes.join(other, [*CELL, "voter"])
    missing = near(asked, own, [*CELL, "occ", "pitch"], tol, "left_anti", t="pos")
    together = anchored_clusters(missing, [*CELL, "occ", "pitch"], tol, "pos", "id")
    key = [*CELL, "occ", "pitch", "anchor_us"]
    first = together.groupBy(*key, "voter", "voters").agg(F.min(F.struct("pos", "id", "dur", "instrument")).alias("x"))
    named = first.groupBy(*key, F.col("x.instrument").alias("instrument")).agg(F.count("*").alias("n"), F.min("x.pos").alias("pos"))
    usual = named.where("instrument is not null").groupBy(*key).agg(F.min_by("instrument", F.struct(-F.col("n"), "pos", "instrument")).alias("instrument"))
    agreed = first.groupBy(*key, "voters").agg(F.count("*").alias("n"), F.median("x.pos").alias("pos"), F.median("x.dur").alias("dur"))
    agreed = agreed.where(F.col("n") >= F.greatest(F.lit(2), F.ceil(share * F.col("voters") - 1e-9))).join(usual, key, "left")
    at = agreed.join(cells.select(*CELL, "occ", "offset_us", "first_beat"), [*CELL, "occ"])
    at = beat_to_time(at.withColumn("beat_pos", F.col("first_beat") + F.col("pos") / FINE), beats).withColumn("onset_us", F.round(F.col("t_us") + F.col("offset_us")).cast("long")).drop("t_us")
    at = beat_to_time(at.withColumn("beat_pos", F.col("first_beat") + (F.col("pos") + F.col("dur")) / FINE), beats)
    at = at.withColumn("end_us", F.greatest(F.round(F.col("t_us") + F.col("offset_us")).cast("long"), F.col("onset_us") + 10_000))
    at = near(at, notes.select("song_id", "pitch", "onset_us"), ["song_id", "pitch"], dup_us, "left_anti")
    # of two agreed places within the tolerance the earlier one is added
    one = anchored_clusters(at.drop("anchor_us").withColumn("pos", F.round("pos").cast("long")), [*CELL, "occ", "pitch"], tol, "pos", "n")
    one = one.groupBy(*CELL, "occ", "pitch", "anchor_us").agg(F.min(F.struct("pos", "onset_us", "end_us", "instrument", "n", "voters")).alias("x"))
    added = one.select(*CELL, "occ", "pitch", "x.onset_us", F.col("x.end_us").alias("offset_us"), "x.instrument", F.round(F.col("x.n") / F.col("x.voters"), 3).alias("support"))
    return added, lone
