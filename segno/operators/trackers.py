"""Pitch trackers: what they answer for a note, how they vote, how often they are right, and notes that the vote shows to be harmonics.

frames: song_id, line, tracker, frame (hop_us long), midi (null: unvoiced), conf. A frame is valid if it is voiced and its conf is at least conf_min.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import StructField, StructType

from ..sources.quality import dealt, written
from .cluster import anchored_clusters

HOP_US = 10_000
#: Bands of the reference pitch in Hz, half-open.
BANDS = ((30, 100), (100, 400))
#: Half tones over a note at which its harmonics are heard as notes.
HARMONICS = (0, 12, 19, 24)


def valid(conf_min: float) -> Column:
    return F.col("midi").isNotNull() & (F.col("conf") >= conf_min)


def f0_estimates(frames: DataFrame, notes: DataFrame, conf_min: float = 0.5, least: int = 3, hop_us: int = HOP_US) -> DataFrame:
    """song_id, note_id, tracker, x: the median of a tracker's valid frames in the note's evidence, if there are `least`.

    Evidence runs from 30 ms after the onset to 120 ms after it or 10 ms before the offset; where that is under 30 ms, from 10 ms after the onset to the offset
    (30 ms after the onset at least). A note spreads over the few frames of its evidence, so the join is one of equal frames.
    """
    on, off = F.col("onset_us"), F.col("offset_us")
    end = F.least(on + 120_000, off - 10_000)
    short = end - on < 60_000
    a, b = F.when(short, on + 10_000).otherwise(on + 30_000), F.when(short, F.greatest(on + 30_000, off)).otherwise(end)
    first, last = F.ceil(a / hop_us), F.ceil(b / hop_us) - 1
    spread = dealt(notes, "song_id", "note_id").where(last >= first).select("song_id", "line", "note_id", F.explode(F.sequence(first, last)).alias("frame"))
    answers = dealt(spread, "song_id", "line", "frame").join(frames.where(valid(conf_min)).select("song_id", "line", "tracker", "frame", "midi").hint("merge"), ["song_id", "line", "frame"])
    return dealt(answers, "song_id", "note_id").groupBy("song_id", "note_id", "tracker").agg(F.median("midi").alias("x"), F.count("*").alias("_n")).where(F.col("_n") >= least).drop("_n")


def f0_vote(notes: DataFrame, estimates: DataFrame, agree: float = 0.5, need: int = 2) -> DataFrame:
    """notes + action, target, voted_pitch. The target is the whole pitch that most trackers (`need` at least) lie within `agree` of, then the nearest to the note,
    then the higher. A target whole octaves (up to three) or one half tone away is believed; any other is a disagreement, which moves nothing.

    action: no_f0 (fewer than `need` answers), split (no target), confirmed, octave, semitone or disagree. What is gathered for a note is one number a tracker.
    """
    answers = estimates.where("x is not null").groupBy("note_id").agg(F.collect_list("x").alias("_xs"))
    rows = notes.join(answers, "note_id", "left").withColumn("_xs", F.coalesce("_xs", F.array().cast("array<double>")))
    targets = F.array_distinct(F.transform("_xs", lambda x: F.bround(x, 0).cast("int")))
    support = lambda t: F.size(F.filter("_xs", lambda x: F.abs(x - t) <= agree))
    ranked = F.transform(targets, lambda t: F.struct(support(t).alias("n"), (-F.abs(t - F.col("pitch"))).alias("near"), t.alias("t")))
    best = F.array_max(F.filter(ranked, lambda s: s["n"] >= need))
    rows = rows.withColumn("target", F.when(F.size("_xs") >= need, best["t"]))
    away = F.abs(F.col("target") - F.col("pitch"))
    action = (
        F.when(F.size("_xs") < need, "no_f0").when(F.col("target").isNull(), "split").when(away == 0, "confirmed")
        .when((away % 12 == 0) & (away <= 36), "octave").when(away == 1, "semitone").otherwise("disagree")
    )
    rows = rows.withColumn("action", action)
    pitch = F.when(F.col("action").isin("octave", "semitone"), F.col("target")).otherwise(F.col("pitch"))
    return rows.drop("_xs").withColumn("voted_pitch", pitch)


def tracker_accuracy(notes: DataFrame, frames: DataFrame, conf_min: float = 0.5, margin_us: int = 30_000, hop_us: int = HOP_US) -> DataFrame:
    """tracker, band, frames, rpa, rca, vr, rpa_any, octave: shares of the reference frames of a band ("all" holds every one).

    Reference frames lie at least margin_us within a note, where its line sounds no other. rpa: valid and within half a half tone; rca: the same but for octaves;
    vr: valid; rpa_any: within half a half tone whatever conf says; octave: valid and wrong by whole octaves. A tracker that answers no frame of a band has no row.
    """
    first, last = F.greatest(F.ceil((F.col("onset_us") + margin_us) / hop_us), F.lit(0)), F.floor((F.col("offset_us") - margin_us) / hop_us)
    hz = 440 * F.pow(F.lit(2.0), (F.col("pitch") - 69) / 12)
    own = F.lit(len(BANDS))
    for i, (lo, hi) in enumerate(BANDS):
        own = F.when((hz >= lo) & (hz < hi), i).otherwise(own)
    known = "song_id is not null and line is not null"
    sounding = notes.where(known).where(last >= first).select("song_id", "line", F.col("pitch").cast("double").alias("pitch"), own.alias("own"), first.alias("first"), last.alias("last"))
    answers = frames.where(known).where("frame is not null").select("song_id", "line", "tracker", "frame", F.col("midi").cast("double").alias("midi"), F.coalesce(valid(conf_min), F.lit(False)).alias("v"))
    names = ["rpa", "rca", "vr", "rpa_any", "octave"]
    schema = StructType([StructField("tracker", answers.schema["tracker"].dataType), *StructType.fromDDL(f"own int, is_size boolean, {', '.join(f'{c} long' for c in ('frames', *names))}")])

    def heard(n: pa.Table, f: pa.Table) -> pa.Table:
        """Counts of a line: reference frames by band (is_size), then what each tracker answers in them."""
        first, last, pitch, own = (n.column(c).to_numpy() for c in ("first", "last", "pitch", "own"))
        many = last - first + 1
        note = np.repeat(np.arange(len(many)), many)
        frame, at, count = np.unique(first[note] + np.arange(len(note)) - np.repeat(np.cumsum(many) - many, many), return_index=True, return_counts=True)
        frame, note = frame[count == 1], note[at[count == 1]]
        bands = len(BANDS) + 1
        size = np.bincount(own[note], minlength=bands)
        asked, code = f.column("frame").to_numpy(), f.column("tracker").combine_chunks().dictionary_encode("encode")
        code = code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code
        where = np.searchsorted(frame, asked)
        hit = np.flatnonzero(frame[np.minimum(where, len(frame) - 1)] == asked) if len(frame) else np.zeros(0, np.int64)
        note = note[where[hit]]
        v, e = f.column("v").to_numpy()[hit], f.column("midi").to_numpy()[hit] - pitch[note]
        cell = code.indices.to_numpy()[hit].astype(np.int64) * bands + own[note]
        close, folded = np.abs(e) <= 0.5, np.abs(e - 12 * np.round(e / 12)) <= 0.5
        there = np.flatnonzero(np.bincount(cell))
        sums = [np.bincount(cell, x)[there].astype(np.int64) for x in (close & v, folded & v, v, close, v & ~close & folded)] if len(hit) else [np.zeros(0, np.int64)] * len(names)
        tracker = pa.concat_arrays([pa.nulls(bands, code.dictionary.type), code.dictionary.take(pa.array(there // bands))])
        none = np.zeros(bands, np.int64)
        band = np.concatenate((np.arange(bands), there % bands)).astype(np.int32)
        counts = [np.concatenate((size, there * 0)), *[np.concatenate((none, x)) for x in sums]]
        return pa.Table.from_arrays([tracker, pa.array(band), pa.array(np.arange(len(band)) < bands), *map(pa.array, counts)], names=schema.names)

    # a line's notes meet its frames in one group, which the song bounds; what leaves it are a few counts
    lines = written(sounding.groupBy("song_id", "line").cogroup(answers.groupBy("song_id", "line")).applyInArrow(heard, schema), "lines")
    named = F.get(F.array(*[F.lit(f"{lo}-{hi}") for lo, hi in BANDS]), F.col("own"))
    band = F.explode(F.array_compact(F.array(F.lit("all"), named))).alias("band")
    # they are summed by their own band first; what is left are a few rows, and "all" is their sum
    size = lines.where("is_size").groupBy("own").agg(F.sum("frames").alias("frames")).select("frames", band).groupBy("band").agg(F.sum("frames").alias("frames"))
    sums = lines.where("not is_size").groupBy("tracker", "own").agg(*[F.sum(n).alias(n) for n in names]).select("tracker", *names, band)
    sums = sums.groupBy("tracker", "band").agg(*[F.sum(n).alias(n) for n in names])
    return sums.join(F.broadcast(size), "band").select("tracker", "band", "frames", *[F.round(F.col(n) / F.col("frames"), 6).alias(n) for n in names])  # a row a band


def harmonic_dupes(notes: DataFrame, group_us: int = 40_000) -> DataFrame:
    """song_id, note_id, pitch, offset_us without the harmonics of confirmed notes. notes: song_id, note_id, onset_us, offset_us, pitch, target (see f0_vote).

    In a group of notes that start within group_us, the base is the lowest pitch whose note is confirmed (its target is its pitch); its longest such note, then the
    earliest, stands for it. Other notes 0, 12, 19 or 24 half tones over the base go, unless they are confirmed themselves at another pitch; one that goes and has the
    base's pitch gives the note that stands its offset, if later.
    """
    n = anchored_clusters(dealt(notes.select("song_id", "note_id", "onset_us", "offset_us", "pitch", "target"), "song_id"), ["song_id"], group_us)
    group = Window.partitionBy("song_id", "anchor_us")
    sure = F.coalesce(F.col("target") == F.col("pitch"), F.lit(False))
    n = n.withColumn("_sure", sure).withColumn("_base", F.min(F.when(F.col("_sure"), F.col("pitch"))).over(group)).withColumn("_size", F.count("*").over(group))
    place = F.row_number().over(Window.partitionBy("song_id", "anchor_us", "_sure").orderBy("pitch", F.col("onset_us") - F.col("offset_us"), "onset_us", "note_id"))
    n = n.withColumn("_stands", F.col("_sure") & (place == 1) & (F.col("_size") > 1))
    other = ~F.col("_stands") & ~(F.col("_sure") & (F.col("pitch") != F.col("_base")))
    gone = (F.col("_size") > 1) & F.col("_base").isNotNull() & other & (F.col("pitch") - F.col("_base")).isin(*HARMONICS)
    n = n.withColumn("_gone", F.coalesce(gone, F.lit(False)))
    longer = F.max(F.when(F.col("_gone") & (F.col("pitch") == F.col("_base")), F.col("offset_us"))).over(group)
    n = n.withColumn("_longer", longer)
    offset = F.when(F.col("_stands"), F.greatest("offset_us", "_longer")).otherwise(F.col("offset_us"))
    return n.where(~F.col("_gone")).select("song_id", "note_id", "pitch", offset.alias("offset_us"))
