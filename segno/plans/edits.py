"""Queries of edit replay: lines above 0 are the guitar's parts, line 0 is the bass; a log of edits of all kinds is derived from the notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import replay
from ..sources import fixtures as X
from .queries import query


def tracked(spark, d):
    return X.notes_ref(spark, d).withColumn("track", F.when(F.col("line") == 0, "bass").otherwise("guitar"))


def edit_log(spark, d):
    """One edit for about half of the notes, in the order of their ids; songs whose id leaves 1 when divided by 3 are split into two parts anew."""
    n, k, null = tracked(spark, d), F.col("note_id") % 20, F.lit(None)
    ops = {0: "delete", 1: "pitch", 2: "part", 3: "pin", 4: "assign", 5: "add", 6: "pitch", 7: "part_span", 8: "part", 9: "pitch", 10: "delete", 12: "part"}
    op = F.when((k == 11) & (F.col("song_id") % 3 == 1), "parts_k")
    for i, name in ops.items():
        op = F.when(k == i, name).otherwise(op)
    split = F.when(F.col("song_id") % 3 == 1, 2).otherwise(0)
    rows = n.select("song_id", F.col("note_id").alias("seq"), op.alias("op"), "track", "onset_us", "offset_us", "pitch", "line", k.alias("_k"), split.alias("_split")).where("op is not null")
    by = lambda i, v: F.when(F.col("_k") == i, v)
    return rows.select(
        "song_id", "seq", "op", "track", F.coalesce(by(5, F.col("onset_us") + 250_000), by(9, F.col("onset_us") + 20_000), by(10, F.col("onset_us") + 500_000), F.col("onset_us")).alias("onset_us"), "offset_us", "pitch",
        by(6, F.col("seq") - 1).alias("added"), F.when(F.col("op") == "pitch", F.col("pitch") + 1).when(F.col("op").isin("part", "part_span"), F.col("line") % 2 + F.when(F.col("_k") == 12, 7).otherwise(1)).alias("to"),
        F.when(F.col("track") == "bass", "guitar").otherwise("bass").alias("to_track"), (F.col("pitch") % 6 + 1).alias("string"), (F.col("seq") % 13).alias("fret"), "line", F.col("line").alias("from_line"),
        F.col("onset_us").alias("start_us"), (F.col("onset_us") + 20_000_000).alias("end_us"), F.when(F.col("op") == "parts_k", 2).when(F.col("_k") == 8, 5).otherwise(F.col("_split")).alias("k"),
    )


def edited(spark, d):
    notes = tracked(spark, d)
    again = notes.where("track = 'guitar'").select("song_id", F.lit(2).alias("k"), "note_id", F.when(F.col("pitch") < 52, 1).otherwise(2).alias("line"))
    links = notes.where("track = 'guitar'").select(F.col("note_id").alias("a"), (F.col("note_id") + 15).alias("b"))
    return replay.apply_note_edits(notes, edit_log(spark, d), links, again)


@query()
def l2_apply_note_edits(spark, d):
    """Every note after the log: track, pitch, part, pin, status, and whether its part was spread from a note that it repeats."""
    return edited(spark, d)[0]


@query()
def l2_edit_report(spark, d):
    """What became of every edit: why it found nothing to change, or null, and whether its anchor was exact."""
    return edited(spark, d)[1]
