"""Mapping between time, beats, bars and windows: as-of joins on sorted unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def asof_join(events: DataFrame, marks: DataFrame, keys: list[str], t: str, mark_t: str, name: str = "mark") -> DataFrame:
    """events with the last mark at or before each, as struct `name` (null before the first): one shuffle, no range join."""
    facts = F.struct(*[c for c in marks.columns if c not in keys])
    left = events.select(*keys, F.col(t).alias("_t"), F.lit(1).alias("_kind"), F.struct(*[c for c in events.columns if c not in keys]).alias("_event"), F.lit(None).cast(marks.select(facts.alias("s")).schema[0].dataType).alias(name))
    right = marks.select(*keys, F.col(mark_t).alias("_t"), F.lit(0).alias("_kind"), F.lit(None).cast(left.schema["_event"].dataType).alias("_event"), facts.alias(name))
    w = Window.partitionBy(*keys).orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn(name, F.last(name, ignorenulls=True).over(w)).where("_kind = 1")
    return both.select(*keys, "_event.*", name)


def time_to_beat(events: DataFrame, beats: DataFrame, t: str = "onset_us", length: str = "") -> DataFrame:
    """events + beat_pos: linear between beats; the first and last intervals go on beyond the ends. `length` names a column for the
    length of the beat that holds each event."""
    w = Window.partitionBy("song_id").orderBy("t_us")
    spans = beats.select("song_id", "beat_no", "t_us", F.lead("t_us").over(w).alias("next_us")).where("next_us is not null")
    # the first interval also stands far ahead of all events, so that those before it find it
    spans = spans.withColumn("_at", F.row_number().over(w))
    ahead = F.col("_at") == 1
    marks = spans.select("song_id", "beat_no", "t_us", "next_us", F.explode(F.when(ahead, F.array(F.lit(None).cast("long"), F.col("t_us").cast("long"))).otherwise(F.array(F.col("t_us").cast("long")))).alias("from_us"))
    out = asof_join(events, marks, ["song_id"], t, "from_us")
    m = F.col("mark")
    more = [(m["next_us"] - m["t_us"]).alias(length)] if length else []
    return out.select(*events.columns, (m["beat_no"] + (F.col(t) - m["t_us"]) / (m["next_us"] - m["t_us"])).alias("beat_pos"), *more)


def beat_to_time(points: DataFrame, beats: DataFrame) -> DataFrame:
    """points (song_id, beat_pos) + t_us by an equi-join on the beat below."""
    w = Window.partitionBy("song_id").orderBy("beat_no")
    spans = beats.select("song_id", F.col("beat_no").alias("_b"), F.col("t_us").alias("_t"), F.lead("t_us").over(w).alias("_n")).where("_n is not null")
    last = spans.groupBy("song_id").agg(F.max("_b").alias("_last"))
    at = points.join(last, "song_id").withColumn("_b", F.least(F.greatest(F.floor("beat_pos"), F.lit(0)), "_last"))
    return at.join(spans, ["song_id", "_b"]).select(*points.columns, (F.col("_t") + (F.col("beat_pos") - F.col("_b")) * (F.col("_n") - F.col("_t"))).alias("t_us"))


def time_to_bar_tick(events: DataFrame, beats: DataFrame, ticks: int = 48, t: str = "onset_us") -> DataFrame:
    """events + bar, tick, from the beat position and the first beat of each bar."""
    placed = time_to_beat(events, beats, t)
    starts = beats.where("beat = 1").select("song_id", "bar", F.col("beat_no").cast("double").alias("bar_beat"))
    out = asof_join(placed, starts, ["song_id"], "beat_pos", "bar_beat")
    return out.select(*events.columns, F.col("mark.bar").alias("bar"), F.round((F.col("beat_pos") - F.col("mark.bar_beat")) * ticks, 6).alias("tick"))


def window_of(events: DataFrame, windows: DataFrame, t: str = "onset_us") -> DataFrame:
    """events + window, label of the half-open window that holds each, or null."""
    out = asof_join(events, windows.select("song_id", "window", "start_us", "end_us", "label"), ["song_id"], t, "start_us")
    inside: Column = F.col(t) < F.col("mark.end_us")
    return out.select(*events.columns, F.when(inside, F.col("mark.window")).alias("window"), F.when(inside, F.col("mark.label")).alias("label"))


def local_tick_rate(events: DataFrame, beats: DataFrame, ticks: int = 48, t: str = "onset_us") -> DataFrame:
    """events + ticks per second where each lies."""
    w = Window.partitionBy("song_id").orderBy("t_us")
    spans = beats.select("song_id", "t_us", F.lead("t_us").over(w).alias("next_us")).where("next_us is not null")
    out = asof_join(events, spans, ["song_id"], t, "t_us")
    return out.select(*events.columns, F.round(ticks * 1e6 / (F.col("mark.next_us") - F.col("mark.t_us")), 6).alias("ticks_per_s"))


def nearest(points: DataFrame, marks: DataFrame, keys: list[str], t: str, mark_t: str, value: str) -> DataFrame:
    """points + near: the `value` of the mark nearest in time (ties: the lesser value), from the marks on either side of each in one sorted union."""
    w = Window.partitionBy(*keys).orderBy("_t", "_kind")
    back = Window.partitionBy(*keys).orderBy(F.desc("_t"), F.asc("_kind"))
    own = points.select(*keys, F.col(t).alias("_t"), F.lit(1).alias("_kind"), F.struct(*[c for c in points.columns if c not in keys]).alias("_p"))
    m = marks.select(*keys, F.col(mark_t).alias("_t"), F.lit(0).alias("_kind"), F.lit(None).cast(own.schema["_p"].dataType).alias("_p"), F.struct(F.col(mark_t).alias("t"), F.col(value).alias("v")).alias("_m"))
    both = own.withColumn("_m", F.lit(None).cast(m.schema["_m"].dataType)).unionByName(m)
    last = lambda over: F.last("_m", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("_a", last(w)).withColumn("_b", last(back)).where("_kind = 1")
    gap = lambda m: F.struct(F.abs(F.col("_t") - m["t"]).alias("d"), m["v"].alias("v"))
    near = F.when(F.col("_a").isNull(), gap(F.col("_b"))).when(F.col("_b").isNull(), gap(F.col("_a"))).otherwise(F.least(gap(F.col("_a")), gap(F.col("_b"))))
    return both.select(*keys, "_p.*", near["v"].alias("near"))


def path_interp(points: DataFrame, path: DataFrame, keys: list[str], at: str, x: str, y: str) -> DataFrame:
    """points + y: piecewise linear along the path (x, y), held constant beyond its ends."""
    w = Window.partitionBy(*keys).orderBy(x)
    steps = path.select(*keys, F.col(x).alias("x0"), F.col(y).alias("y0"), F.lead(x).over(w).alias("x1"), F.lead(y).over(w).alias("y1"))
    start = path.groupBy(*keys).agg(F.min_by(y, x).alias("head"))
    out = asof_join(points, steps, keys, at, "x0").join(start, keys, "left")
    m = F.col("mark")
    value = F.when(m.isNull(), F.col("head")).when(m["x1"].isNull(), m["y0"]).otherwise(m["y0"] + (F.col(at) - m["x0"]) * (m["y1"] - m["y0"]) / (m["x1"] - m["x0"]))
    return out.select(*points.columns, value.alias(y))


def grid_from_beats(beats: DataFrame, downbeats: DataFrame) -> DataFrame:
    """song_id, t_us, bar, beat: each downbeat goes to its nearest beat, which opens a bar; beats before the first form bar 0,
    counted so that its last beat is the last of a bar of the median length."""
    opens = nearest(downbeats.select("song_id", F.col("t_us").alias("_d")), beats.select("song_id", "t_us"), ["song_id"], "_d", "t_us", "t_us")
    opens = opens.select("song_id", F.col("near").alias("t_us"), F.lit(1).alias("_open")).distinct()
    w = Window.partitionBy("song_id").orderBy("t_us")
    rows = beats.select("song_id", "t_us").join(opens, ["song_id", "t_us"], "left")
    rows = rows.withColumn("bar", F.sum(F.coalesce("_open", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy("song_id", "bar")
    rows = rows.select("song_id", "t_us", "bar", F.row_number().over(own.orderBy("t_us")).alias("k"), F.count("*").over(own).alias("n"))
    usual = rows.where("bar > 0 and k = 1").groupBy("song_id").agg(F.median("n").cast("int").alias("usual"))
    beat = F.when(F.col("bar") > 0, F.col("k")).otherwise(F.col("usual") - F.col("n") + F.col("k"))
    return rows.join(usual, "song_id").select("song_id", "t_us", "bar", beat.alias("beat"))
