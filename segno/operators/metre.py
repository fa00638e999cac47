"""Where onsets lie in the beats, what that says of metre and feel, and what each family of a beat would cost.

beats: song_id, beat_no, t_us, bar, unit (quarter, dotted_quarter, eighth); for costs also swing. Onsets before the first or at and after the last beat have no place.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..sources.quality import dealt, written
from .cluster import anchored_clusters
from .timeline import asof_join

TICKS = 48
#: Parts of a beat by unit and family; subdivision levels of a family; penalty of a level by unit; what a family costs a beat that leaves the beat itself.
PARTS = {"quarter": {"bin": 8, "ter": 6, "swing": 8}, "dotted_quarter": {"bin": 4, "ter": 6, "swing": 4}, "eighth": {"bin": 4, "ter": 3, "swing": 4}}
LEVELS = {"bin": (1, 2, 4, 8), "ter": (1, 3, 6), "swing": (1, 2, 4, 8)}
PENALTY = {"quarter": {1: 0.0, 2: 0.3, 3: 0.6, 4: 0.9, 6: 2.0, 8: 2.5}, "dotted_quarter": {1: 0.0, 2: 1.2, 3: 0.3, 4: 2.5, 6: 0.9}, "eighth": {1: 0.0, 2: 0.6, 3: 1.5, 4: 2.0}}
PRIOR = {"quarter": {"bin": 0.0, "ter": 1.0, "swing": 0.0}, "dotted_quarter": {"bin": 1.5, "ter": 0.0, "swing": 1.5}, "eighth": {"bin": 0.0, "ter": 1.5, "swing": 0.0}}


def points() -> list[tuple[str, str, int, float, float, bool]]:
    """unit, family, tick, played (share of the beat), pen, off (not on a beat) of every grid point. Swing plays the middle of a beat at two thirds of it."""
    out = []
    for unit, parts in PARTS.items():
        for family, d in parts.items():
            for k in range(d + 1):
                level = min(h for h in LEVELS[family] if k * h % d == 0)
                played = float(np.interp(k / d, [0, 0.5, 1], [0, 2 / 3, 1])) if family == "swing" else k / d
                out.append((unit, family, k * TICKS // d, played, PENALTY[unit].get(level, 3.0), level > 1))
    return out


def grid(spark: SparkSession) -> DataFrame:
    """unit, family, prior, ps: the points of a family in one array."""
    rows = spark.createDataFrame(points(), "unit string, family string, tick int, played double, pen double, off boolean")
    prior = F.lit(0.0)
    for unit, each in PRIOR.items():
        for family, v in each.items():
            prior = F.when((F.col("unit") == unit) & (F.col("family") == family), v).otherwise(prior)
    return rows.groupBy("unit", "family").agg(F.collect_list(F.struct("tick", "played", "pen", "off")).alias("ps")).withColumn("prior", prior)


def allowed(family: Column, unit: Column, swing: Column) -> Column:
    """Ternary always, swing for swung quarters, else even."""
    swung = swing & (unit == "quarter")
    return (family == "ter") | (swung & (family == "swing")) | (~swung & (family == "bin"))


def usual_family(unit: Column, swing: Column) -> Column:
    """The family of a beat that nothing decides."""
    return F.when(unit == "dotted_quarter", "ter").when(swing & (unit == "quarter"), "swing").otherwise("bin")


def places(onsets: DataFrame, beats: DataFrame, t: str = "onset_us") -> DataFrame:
    """onsets + mark (beat_no, t_us, next_us and the other columns of the beat), fr (share of the beat)."""
    w = Window.partitionBy("song_id").orderBy("t_us")
    spans = beats.withColumn("next_us", F.lead("t_us").over(w)).where("next_us is not null")
    at = asof_join(onsets, spans, ["song_id"], t, "t_us").where(F.col(t) < F.col("mark.next_us"))
    return at.withColumn("fr", (F.col(t) - F.col("mark.t_us")) / (F.col("mark.next_us") - F.col("mark.t_us")))


def meter_feel(notes: DataFrame, beats: DataFrame, sections: DataFrame, window: float = 0.06, least: int = 8, ratio: float = 2.0, third_max: float = 0.35, dedupe_us: int = 30_000) -> DataFrame:
    """song_id, section, third, half, two_thirds, feel, read_as: where onsets between the beats of a section's quarter bars lie, and what that says.

    Onsets within dedupe_us of the first of a cluster count once; those nearer than `window` to a third, a half or two thirds of a beat are counted. Onsets swing
    if at least `least` lie at two thirds, `ratio` times those at the half, and those at a third are at most third_max of them; then feel is triplet8th. Songs with
    dotted quarters, four a bar as a rule, are read as 12/8 (compound) or, if the onsets of those bars swing, as quarters with that feel (shuffle), which only
    sections lose whose onsets are straight: `least` at the half, `ratio` times those at two thirds. sections: song_id, section, start_bar, end_bar.
    """
    onsets = anchored_clusters(dealt(notes.select("song_id", "note_id", "onset_us"), "song_id"), ["song_id"], dedupe_us)
    onsets = written(onsets.select("song_id", "anchor_us").distinct(), "onsets")
    at = places(onsets, beats.select("song_id", "beat_no", "t_us", "bar", "unit"), "anchor_us").where("fr > 0.15 and fr < 0.85")
    at = at.select("song_id", F.col("mark.bar").alias("bar"), F.col("mark.unit").alias("unit"), "fr")
    spots = {"third": 1 / 3, "half": 0.5, "two_thirds": 2 / 3}
    counts = [F.count_if(F.abs(F.col("fr") - x) < window).alias(n) for n, x in spots.items()]
    c = F.col
    swings = (c("two_thirds") >= least) & (c("two_thirds") >= ratio * c("half")) & (c("third") <= third_max * c("two_thirds"))
    straight = (c("half") >= least) & (c("half") >= ratio * c("two_thirds"))

    bars = beats.groupBy("song_id", "bar", "unit").agg(F.count("*").alias("n"))
    sizes = bars.where("unit = 'dotted_quarter'").groupBy("song_id", "n").agg(F.count("*").alias("k")).groupBy("song_id").agg(F.max_by("n", F.struct("k", "n")).alias("usual")).where("usual = 4")
    dotted = sizes.join(at.where("unit = 'dotted_quarter'").groupBy("song_id").agg(*counts), "song_id", "left").fillna(0, list(spots))
    read = dotted.select("song_id", F.when(swings, "shuffle").otherwise("compound").alias("read_as"))
    quarter = (c("unit") == "quarter") | ((c("unit") == "dotted_quarter") & F.coalesce(c("read_as") == "shuffle", F.lit(False)))

    inside = sections.select("song_id", "section", F.explode(F.sequence("start_bar", c("end_bar") - 1)).alias("bar"))
    held = inside.join(bars.join(read, "song_id", "left").where(quarter).hint("merge"), ["song_id", "bar"]).select("song_id", "bar", "section")
    found = held.join(at.select("song_id", "bar", "fr").hint("merge"), ["song_id", "bar"], "left").groupBy("song_id", "section").agg(*counts)
    rows = sections.select("song_id", "section").join(found.hint("merge"), ["song_id", "section"], "left").join(read, "song_id", "left")
    feel = F.when(swings | ((c("read_as") == "shuffle") & ~straight), "triplet8th")  # null counts: no quarter bar, no feel
    return rows.withColumn("feel", feel).fillna(0, list(spots)).select("song_id", "section", *spots, "feel", "read_as")


def bar_feel(beats: DataFrame, sections: DataFrame, feels: DataFrame) -> DataFrame:
    """song_id, bar, unit, swing: the metre that the song is read in, and whether the bar's section swings. Bars outside all sections take the next section's feel, those
    behind the last its own; feels as meter_feel gives them."""
    known = sections.join(feels.select("song_id", "section", "feel", "read_as").hint("merge"), ["song_id", "section"])
    last = known.groupBy("song_id").agg(F.max_by("feel", "end_bar").alias("_last"), F.max("end_bar").alias("_end"), F.first("read_as").alias("_read"))
    bars = beats.select("song_id", "bar", "unit").distinct().join(last, "song_id", "left")
    ends = known.select("song_id", (-F.col("end_bar") + 1).alias("_to"), F.struct("feel").alias("_f"))
    # the first section that ends behind a bar is the last one at or before it when both are turned round
    at = asof_join(bars.withColumn("_t0", -F.col("bar")), ends, ["song_id"], "_t0", "_to")
    feel = F.when(F.col("bar") >= F.col("_end"), F.col("_last")).otherwise(F.col("mark._f.feel"))
    unit = F.when((F.col("unit") == "dotted_quarter") & F.coalesce(F.col("_read") == "shuffle", F.lit(False)), "quarter").otherwise(F.col("unit"))
    return at.select("song_id", "bar", unit.alias("unit"), (F.coalesce(feel == "triplet8th", F.lit(False)) & (unit == "quarter")).alias("swing"))


def point_of(ps: Column, fr: Column, ms: Column, sigma_ms: float) -> Column:
    """The point of least squared residual (in sigmas) and penalty, then the lower: cost, tick, r2, pen, off, resid (ms, played to heard)."""

    def seen(p: Column) -> Column:
        r2 = F.pow((p["played"] - fr) * ms / sigma_ms, F.lit(2.0))
        return F.struct(F.round(r2 + p["pen"], 9).alias("cost"), p["tick"].alias("tick"), r2.alias("r2"), p["pen"].alias("pen"), p["off"].alias("off"), ((fr - p["played"]) * ms).alias("resid"))

    return F.array_min(F.transform(ps, seen))


def beat_costs(notes: DataFrame, beats: DataFrame, sigma_ms: float = 30.0, cap: float = 9.0) -> DataFrame:
    """song_id, beat, family, cost, notes: for every beat from a song's first note to its last and every family allowed there the sum over its notes of the squared residual
    (at most `cap`) and the penalty of the point each goes to, and the family's prior if one leaves the beat. A beat without notes costs nothing."""
    known = beats.select("song_id", "beat_no", "t_us", "unit", "swing")
    families = F.broadcast(grid(notes.sparkSession))  # nine rows
    at = places(notes.select("song_id", "note_id", "onset_us"), known)
    at = at.select("song_id", F.col("mark.beat_no").alias("beat"), F.col("mark.unit").alias("unit"), F.col("mark.swing").alias("swing"), "fr", ((F.col("mark.next_us") - F.col("mark.t_us")) / 1000.0).alias("ms"))
    may = allowed(F.col("family"), F.col("unit"), F.col("swing"))
    each = at.join(families, "unit").where(may).withColumn("p", point_of(F.col("ps"), F.col("fr"), F.col("ms"), sigma_ms))
    cost = F.sum(F.least(F.col("p.r2"), F.lit(cap)) + F.col("p.pen")) + F.when(F.bool_or("p.off"), F.first("prior")).otherwise(0.0)
    costs = each.groupBy("song_id", "beat", "family").agg(cost.alias("cost"), F.count("*").alias("notes"))
    reach = costs.groupBy("song_id").agg(F.min("beat").alias("_lo"), F.max("beat").alias("_hi"))
    every = known.join(reach, "song_id").where("beat_no between _lo and _hi").join(families.select("unit", "family"), "unit").where(may)
    every = every.select("song_id", F.col("beat_no").alias("beat"), "family").join(costs.hint("merge"), ["song_id", "beat", "family"], "left")
    return every.select("song_id", "beat", "family", F.coalesce("cost", F.lit(0.0)).alias("cost"), F.coalesce("notes", F.lit(0).cast("long")).alias("notes"))


def quantize_notes(notes: DataFrame, families: DataFrame, beats: DataFrame, sigma_ms: float = 30.0) -> DataFrame:
    """song_id, note_id, gtick, dur, bar, tick, family, resid_ms: onset and offset on the grid of their beat's family; the shortest note is one step of the family of the
    beat that holds the quantised onset. Notes that begin or end outside the beats, or are moved behind the last, are left out. families: song_id, beat, family; beats
    that lack one take the usual family of their unit and feel."""
    span = beats.select("song_id", "beat_no", "t_us", "bar", "beat", "unit", "swing").join(families.select("song_id", F.col("beat").alias("beat_no"), "family").hint("merge"), ["song_id", "beat_no"], "left")
    span = span.withColumn("family", F.coalesce("family", usual_family(F.col("unit"), F.col("swing"))))
    families_ = F.broadcast(grid(notes.sparkSession))

    def placed(t: str) -> DataFrame:
        at = places(notes.select("song_id", "note_id", t), span, t)
        at = at.select("song_id", "note_id", "fr", F.col("mark.beat_no").alias("b"), F.col("mark.unit").alias("unit"), F.col("mark.family").alias("family"), ((F.col("mark.next_us") - F.col("mark.t_us")) / 1000.0).alias("ms"))
        p = at.join(families_, ["unit", "family"]).withColumn("p", point_of(F.col("ps"), F.col("fr"), F.col("ms"), sigma_ms))
        return p.select("song_id", "note_id", "family", (F.col("b") * TICKS + F.col("p.tick")).alias("g"), F.col("p.resid").alias("resid"))

    rows = placed("onset_us").join(placed("offset_us").select("note_id", F.col("g").alias("z")).hint("merge"), "note_id").withColumn("beat_no", F.floor(F.col("g") / TICKS).cast("long"))
    step = F.array_min(F.transform(F.filter("ps", lambda p: p["tick"] > 0), lambda p: p["tick"]))
    steps = families_.select("unit", F.col("family").alias("_f"), step.alias("step"))
    hold = span.select("song_id", "beat_no", "bar", "beat", "unit", F.col("family").alias("_f")).join(steps, ["unit", "_f"])
    rows = rows.join(hold.hint("merge"), ["song_id", "beat_no"])
    tick = (F.col("beat") - 1) * TICKS + F.col("g") % TICKS
    return rows.select("song_id", "note_id", F.col("g").alias("gtick"), F.greatest(F.col("z") - F.col("g"), F.col("step")).alias("dur"), "bar", tick.alias("tick"), "family", F.round("resid", 2).alias("resid_ms"))
