"""Written scores: repeats, ties, nominal tempo and the times of notes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import scalars as S
from .timeline import beat_to_time


def play_order(bars: DataFrame) -> DataFrame:
    """song_id, pos, bar: written bars in play order. bars: song_id, bar (from 1), repeat_open, repeat_count, alternate (bits of passes).

    A repeat starts at the last opening bar (else after the last closed repeat, else at the start) and plays
    repeat_count times; a bar with alternate bits plays on those passes only. One fold over a song's bars, which a score
    bounds. From one start a bar is reached once in a pass at most; a start after it is only taken when a closing bar before it, which
    was skipped at first by its alternate bits, is played later, so there are at most as many further starts as such bars.
    """
    xs = F.array_sort(F.collect_list(F.struct("bar", "repeat_open", "repeat_count", "alternate"))).alias("xs")
    songs = bars.groupBy("song_id").agg(xs, F.max(F.greatest("repeat_count", F.lit(1))).alias("passes"), F.count_if((F.col("repeat_count") > 0) & (F.col("alternate") != 0)).cast("int").alias("twisted"))
    fold = """aggregate(sequence(1, size(xs) * passes * (1 + twisted)),
      named_struct('i', 0, 'start', 0, 'pass', 1, 'jumped', false, 'out', cast(array() as array<bigint>)),
      (a, step) -> CASE WHEN a.i >= size(xs) THEN a ELSE
        transform(transform(array(element_at(xs, a.i + 1)), b -> named_struct('b', b, 's', if(b.repeat_open and not a.jumped, a.i, a.start), 'p', if(b.repeat_open and not a.jumped, 1, a.pass))),
          z -> CASE WHEN z.b.alternate <> 0 and (shiftright(z.b.alternate, z.p - 1) & 1) = 0 THEN named_struct('i', a.i + 1, 'start', z.s, 'pass', z.p, 'jumped', false, 'out', a.out)
                    WHEN z.b.repeat_count > 1 and z.p < z.b.repeat_count THEN named_struct('i', z.s, 'start', z.s, 'pass', z.p + 1, 'jumped', true, 'out', array_append(a.out, z.b.bar))
                    WHEN z.b.repeat_count > 0 THEN named_struct('i', a.i + 1, 'start', a.i + 1, 'pass', 1, 'jumped', false, 'out', array_append(a.out, z.b.bar))
                    ELSE named_struct('i', a.i + 1, 'start', z.s, 'pass', z.p, 'jumped', false, 'out', array_append(a.out, z.b.bar)) END)[0] END).out"""
    order = songs.select("song_id", F.posexplode(F.expr(fold)).alias("pos", "bar"))
    return order.select("song_id", (F.col("pos") + 1).cast("long").alias("pos"), "bar")


def expand(order: DataFrame, bars: DataFrame, notes: DataFrame) -> DataFrame:
    """song_id, line, track, bar (played), tick, dur, pitch, string, tied, shared: the written notes in play order; a tied note
    lengthens the note before it on its track and string if the pitch is the same; shared: another line has the same note."""
    meter = bars.select("song_id", "bar", S.beat_unit(F.col("num"), F.col("den")).alias("m"))
    rows = order.join(meter, ["song_id", "bar"]).join(notes, ["song_id", "bar"])
    rows = rows.select(
        "song_id", "pos", "track", "line", "string", "pitch", "tie", "start", "note_no", S.ticks_of(F.col("start"), F.col("m.unit")).alias("tick"), S.ticks_of(F.col("dur"), F.col("m.unit")).alias("dur")
    )
    w = Window.partitionBy("song_id", "track", "string").orderBy("pos", "start", "note_no")
    goes_on = F.coalesce(F.col("tie") & (F.lag("pitch").over(w) == F.col("pitch")), F.lit(False))
    rows = rows.withColumn("_new", F.when(goes_on, 0).otherwise(1)).withColumn("_part", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = rows.groupBy("song_id", "track", "string", "_part").agg(
        F.min(F.struct("pos", "start", "note_no", "line", "tick", "pitch")).alias("first"),
        F.round(F.sum("dur"), 4).alias("dur"), (F.count("*") > 1).alias("tied"),
    )
    out = g.select("song_id", "first.line", "track", F.col("first.pos").alias("bar"), F.round("first.tick", 4).alias("tick"), "dur", "first.pitch", "string", "tied")
    same = Window.partitionBy("song_id", "pitch", "bar", "tick")
    return out.withColumn("shared", F.min("line").over(same) != F.max("line").over(same))


def nominal_beats(order: DataFrame, bars: DataFrame) -> DataFrame:
    """song_id, beat_no, bar (played), beat, t_us: beats of the played bars at the written tempo, which holds until it changes, and one closing beat."""
    w = Window.partitionBy("song_id").orderBy("pos")
    rows = order.join(bars.select("song_id", "bar", "tempo", S.beat_unit(F.col("num"), F.col("den")).alias("m")), ["song_id", "bar"])
    tempo = F.coalesce(F.last("tempo", ignorenulls=True).over(w), F.lit(120.0))
    # microseconds of a beat: the tempo counts quarters
    rows = rows.select("song_id", "pos", F.col("m.beats").alias("n"), (60e6 / F.round(tempo / S.unit_quarters(F.col("m.unit")), 4)).alias("dur"))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", F.coalesce(F.sum(F.col("n") * F.col("dur")).over(before), F.lit(0.0)).alias("t"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("b"), F.lead("pos").over(w).isNull().alias("last"))
    each = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - F.when(F.col("last"), 0).otherwise(1))).alias("k"))
    closing = F.col("k") == F.col("n")
    return each.select(
        "song_id", (F.col("b") + F.col("k")).alias("beat_no"), (F.col("pos") + closing.cast("int")).alias("bar"), F.when(closing, 1).otherwise(F.col("k") + 1).alias("beat"),
        (F.col("t") + F.col("k") * F.col("dur")).alias("t_us"),
    )


def fill_times(notes: DataFrame, beats: DataFrame, ticks: int = 48) -> DataFrame:
    """notes (song_id, bar, tick, dur, ...) + onset_us, offset_us on the beats; times are not under 0 and no note ends before it starts."""
    starts = beats.where("beat = 1").select("song_id", "bar", F.col("beat_no").alias("_bar_beat"))
    at = notes.join(starts, ["song_id", "bar"]).withColumn("beat_pos", F.col("_bar_beat") + F.col("tick") / ticks)
    at = beat_to_time(at, beats).withColumnRenamed("t_us", "_on").withColumn("beat_pos", F.col("beat_pos") + F.col("dur") / ticks)
    at = beat_to_time(at, beats)
    return at.select(*notes.columns, F.round(F.greatest(F.lit(0.0), "_on"), 3).alias("onset_us"), F.round(F.greatest("_on", "t_us"), 3).alias("offset_us"))
