"""Chords of beats: how long each pitch class sounds, what each chord would cost, the cheapest path through a song, and basses off it."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: The tones of each chord quality over its root.
QUALITIES = {
    "maj": (0, 4, 7), "min": (0, 3, 7), "5": (0, 7), "7": (0, 4, 7, 10), "maj7": (0, 4, 7, 11), "m7": (0, 3, 7, 10), "sus2": (0, 2, 7), "sus4": (0, 5, 7), "dim": (0, 3, 6), "add9": (0, 2, 4, 7),
}
#: Every chord, in the order that settles ties; what comes after them is no chord.
CHORDS = [{"root": r, "quality": q, "tones": [(r + d) % 12 for d in tones]} for q, tones in QUALITIES.items() for r in range(12)]
#: Cells of time in which notes meet beats.
CELL_US = 2_000_000


def beat_spans(beats: DataFrame) -> DataFrame:
    """song_id, beat_no, t_us, next_us: beats up to the next one; the last of a song has no end and goes."""
    w = Window.partitionBy("song_id").orderBy("beat_no")
    return beats.select("song_id", "beat_no", "t_us", F.lead("t_us").over(w).alias("next_us")).where("next_us > t_us")


def sounding_shares(notes: DataFrame, beats: DataFrame, cell_us: int = CELL_US) -> DataFrame:
    """song_id, beat_no, pc, share: the part of a beat in which notes of a pitch class sound (notes add up).

    Notes and beats meet in cells of time, each pair in the cell where it first overlaps, so the join stays an equi-join.
    """
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell_us), F.floor((F.col(b) - 1) / cell_us))).alias("cell")
    n = notes.where("offset_us > onset_us").select("song_id", F.pmod("pitch", F.lit(12)).cast("int").alias("pc"), "onset_us", "offset_us", cells("onset_us", "offset_us"))
    b = beat_spans(beats).select("song_id", "beat_no", "t_us", "next_us", cells("t_us", "next_us"))
    start, end = F.greatest("onset_us", "t_us"), F.least("offset_us", "next_us")
    both = n.hint("merge").join(b, ["song_id", "cell"]).where((start < end) & (F.floor(start / cell_us) == F.col("cell")))
    summed = both.groupBy("song_id", "beat_no", "pc").agg(F.sum(end - start).alias("us"), F.first(F.col("next_us") - F.col("t_us")).alias("beat_us"))
    return summed.select("song_id", "beat_no", "pc", (F.col("us") / F.col("beat_us")).alias("share"))


def bass_classes(bass: DataFrame, beats: DataFrame) -> DataFrame:
    """song_id, beat_no, bass: the bass's pitch class that sounds longest in a beat (ties: the lowest); beats without bass have no row."""
    best = F.min_by("pc", F.struct(-F.col("share"), "pc"))
    return sounding_shares(bass, beats).groupBy("song_id", "beat_no").agg(best.alias("bass"))


def chord_costs(notes: DataFrame, bass: DataFrame, beats: DataFrame, bonus: float = 0.1, size_prior: float = 0.02, least: float = 0.1, empty: float = 0.25) -> DataFrame:
    """song_id, beat_no, bass, costs: for every beat the cost of each of CHORDS, then of no chord.

    A chord costs 1 less the cosine of its tones and the beat's shares, a prior for sizes other than 3, and less a bonus where the
    bass is its root; no chord costs 1. In a beat that is filled less than `least` all chords cost `empty` and no chord nothing.
    """
    shares = sounding_shares(notes, beats).groupBy("song_id", "beat_no").agg(F.map_from_entries(F.collect_list(F.struct("pc", "share"))).alias("by"))
    rows = beat_spans(beats).select("song_id", "beat_no").join(shares, ["song_id", "beat_no"], "left").join(bass_classes(bass, beats), ["song_id", "beat_no"], "left")
    h = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda pc: F.coalesce(F.try_element_at("by", pc), F.lit(0.0)))
    rows = rows.select("song_id", "beat_no", "bass", h.alias("h"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    rows = rows.withColumn("fill", total(F.col("h"))).withColumn("norm", F.sqrt(total(F.transform("h", lambda x: x * x))) + 1e-12)
    table = [{"root": c["root"], "tones": c["tones"], "norm": math.sqrt(len(c["tones"])), "prior": size_prior * abs(len(c["tones"]) - 3)} for c in CHORDS]
    chords = F.from_json(F.lit(json.dumps(table)), "array<struct<root:int,tones:array<int>,norm:double,prior:double>>")

    def cost(c: Column) -> Column:
        dot = total(F.transform(c["tones"], lambda t: F.col("h")[t]))
        return F.round(1 - dot / (c["norm"] * F.col("norm")) + c["prior"] - F.when(F.col("bass") == c["root"], bonus).otherwise(0.0), 9)

    filled = F.array_append(F.transform(chords, cost), F.lit(1.0))
    bare = F.array_append(F.array_repeat(F.lit(empty), len(CHORDS)), F.lit(0.0))
    return rows.select("song_id", "beat_no", "bass", F.when(F.col("fill") < least, bare).otherwise(filled).alias("costs"))


def named(state: Column) -> list[Column]:
    """root and quality of a place in `costs`; both null for no chord."""
    chords = F.from_json(F.lit(json.dumps([{"root": c["root"], "quality": c["quality"]} for c in CHORDS])), "array<struct<root:int,quality:string>>")
    chord = F.get(chords, state)
    return [chord["root"].alias("root"), chord["quality"].alias("quality")]


def chord_segments(costs: DataFrame, change: float = 0.15) -> DataFrame:
    """song_id, start_beat, end_beat (both inside), state: the path of least cost through a song's beats, `change` for any change.

    Since a change always leaves the chord that is best so far, it is enough to know for every chord since when the best path
    to it has stayed on it, and for every beat which chord was best: the path is read from its end, one stay at a time.
    """
    xs = F.array_sort(F.collect_list(F.struct("beat_no", "costs")))
    songs = costs.groupBy("song_id").agg(xs.alias("xs"))

    def marked(a: Column) -> Column:
        best = F.array_position(a["total"], a["low"]).cast("int") - 1
        return F.array_append(a["marks"], F.struct(a["at"].alias("at"), best.alias("state"), a["since"][best].alias("since")))

    def arrived(total: Column, at: Column, since: Column, marks: Column) -> Column:
        """The state after a beat; `total` is taken once."""
        parts = lambda t: F.struct(at.alias("at"), t.alias("total"), F.array_min(t).alias("low"), since.alias("since"), marks.alias("marks"))
        return F.transform(F.array(total), parts)[0]

    def step(a: Column, x: Column) -> Column:
        total = F.zip_with(a["total"], x["costs"], lambda t, c: F.least(t, a["low"] + change) + c)
        at = a["at"] + 1
        return arrived(total, at, F.zip_with(a["total"], a["since"], lambda t, s: F.when(a["low"] + change < t, at).otherwise(s)), marked(a))

    none = F.array().cast("array<struct<at:int,state:int,since:int>>")
    start = arrived(F.col("xs")[0]["costs"], F.lit(0), F.array_repeat(F.lit(0), len(CHORDS) + 1), none)
    marks = F.aggregate(F.slice("xs", F.lit(2), F.greatest(F.size("xs") - 1, F.lit(0))), start, step, marked)

    def back(b: Column, m: Column) -> Column:
        return F.when(m["at"] == b["next"], F.struct((m["since"] - 1).alias("next"), F.array_append(b["out"], m).alias("out"))).otherwise(b)

    stays = F.aggregate(F.reverse("marks"), F.struct((F.size("marks") - 1).alias("next"), none.alias("out")), back)["out"]
    rows = songs.select("song_id", F.transform("xs", lambda x: x["beat_no"]).alias("beats"), marks.alias("marks"))
    rows = rows.select("song_id", "beats", F.explode(stays).alias("m"))
    return rows.select("song_id", F.col("beats")[F.col("m.since")].alias("start_beat"), F.col("beats")[F.col("m.at")].alias("end_beat"), F.col("m.state").alias("state"))


def chord_path(segments: DataFrame) -> DataFrame:
    """song_id, beat_no, state of every beat."""
    return segments.select("song_id", F.explode(F.sequence("start_beat", "end_beat")).alias("beat_no"), "state").hint("merge")


def bass_checks(segments: DataFrame, bass: DataFrame) -> DataFrame:
    """song_id, beat_no, root, quality, bass: beats whose bass is no tone of the chord that the path has there. bass: song_id, beat_no, bass."""
    rows = chord_path(segments).where(F.col("state") < len(CHORDS)).join(bass.where("bass is not null").select("song_id", "beat_no", "bass"), ["song_id", "beat_no"])
    tones = F.from_json(F.lit(json.dumps([c["tones"] for c in CHORDS])), "array<array<int>>")
    return rows.where(~F.array_contains(F.get(tones, F.col("state")), F.col("bass"))).select("song_id", "beat_no", *named(F.col("state")), "bass")
