"""Accuracy sweeps, paired intervals, offsets, weighted pools and levels."""

from __future__ import annotations

from fractions import Fraction
from math import isfinite

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.scalars import draw, f1, uniform
from .cluster import anchored_clusters, merge_spans
from .match import near


def notation_share(est: DataFrame, ref: DataFrame, key: list[str], by: str = "song_id") -> DataFrame:
    """by, n, hit, share of estimated rows whose whole key is in the reference."""
    hit = est.join(ref.select(*key).distinct().withColumn("_hit", F.lit(1)), key, "left")
    g = hit.groupBy(by).agg(F.count("*").alias("n"), F.count("_hit").alias("hit"))
    return g.select("*", F.round(F.col("hit") / F.col("n"), 6).alias("share"))


def coverage_accuracy(rows: DataFrame, by: str, p: str, right: Column, taus: list[float]) -> DataFrame:
    """by, tau, coverage, accuracy of the rows with p at or over each tau.

    Rows are first counted by how many taus they pass, so only that small table is spread over the taus.
    """
    passed = F.size(F.filter(F.array(*[F.lit(t) for t in taus]), lambda t: t <= F.col(p)))
    g = rows.groupBy(by, passed.alias("passed")).agg(F.count("*").alias("n"), F.count_if(right).alias("ok"))
    g = g.withColumn("total", F.sum("n").over(Window.partitionBy(by)))
    each = g.withColumn("tau", F.explode(F.slice(F.array(*[F.lit(t) for t in taus]), F.lit(1), F.col("passed"))))
    return each.groupBy(by, "tau").agg(F.round(F.sum("n") / F.first("total"), 6).alias("coverage"), F.round(F.sum("ok") / F.sum("n"), 6).alias("accuracy"))


def spread(rows: DataFrame) -> DataFrame:
    """rows over as many tasks as a shuffle has: those that a window numbered lie in as few tasks as it has keys, and each grows to many."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def paired_bootstrap(items: DataFrame, by: list[str], group: str, reps: int = 200, seed: str = "20260930") -> DataFrame:
    """by, delta, low, high of F1(b) - F1(a): both arms are summed over the same drawn groups."""
    facts = [f"{c}_{a}" for a in "ab" for c in ("tp", "fp", "fn")]
    totals = items.groupBy(*by, group).agg(*[F.sum(c).alias(c) for c in facts])
    w = Window.partitionBy(*by)
    totals = totals.withColumn("place", F.row_number().over(w.orderBy(group)) - 1).withColumn("n", F.count("*").over(w))
    slots = spread(totals.select(*by, "n", F.col("place").alias("slot"))).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).hint("merge")
    drawn = slots.withColumn("place", draw(seed, F.col("rep"), F.col("slot"), F.col("n")).cast("int"))
    delta = f1(*[F.col(c) for c in facts[3:]]) - f1(*[F.col(c) for c in facts[:3]])
    sums = [F.sum(c).alias(c) for c in facts]
    each = drawn.join(totals.drop("n"), [*by, "place"]).groupBy(*by, "rep").agg(*sums).withColumn("d", delta)
    ci = each.groupBy(*by).agg(F.percentile("d", F.lit(0.025)).alias("low"), F.percentile("d", F.lit(0.975)).alias("high"))
    point = totals.groupBy(*by).agg(*sums).select(*by, delta.alias("delta"))
    return point.join(ci, by).select(*by, *[F.round(c, 6).alias(c) for c in ("delta", "low", "high")])


def compare_runs(a: DataFrame, b: DataFrame, reps: int = 200) -> DataFrame:
    """metric, scenario, items, delta, low, high, mixed_rungs of F1(b) - F1(a) over the items that both runs have, over all of them and by scenario; groups
    of items are drawn together. a, b: metric, item, group, scenario, rung, tp, fp, fn; scenario and group are those of a, and
    mixed_rungs counts the items whose rungs differ."""
    facts = ["tp", "fp", "fn"]
    own = a.select("metric", "item", "group", "scenario", F.col("rung").alias("_ra"), *[F.col(c).alias(f"{c}_a") for c in facts])
    common = own.join(b.select("metric", "item", F.col("rung").alias("_rb"), *[F.col(c).alias(f"{c}_b") for c in facts]), ["metric", "item"])
    rows = common.withColumn("scenario", F.explode(F.array(F.lit("all"), F.col("scenario")))).where("scenario is not null")
    sizes = rows.groupBy("metric", "scenario").agg(F.count("*").alias("items"), F.count_if(~F.col("_ra").eqNullSafe(F.col("_rb"))).alias("mixed_rungs"))
    return sizes.join(paired_bootstrap(rows, ["metric", "scenario"], "group", reps), ["metric", "scenario"]).select("metric", "scenario", "items", "delta", "low", "high", "mixed_rungs")


def best_offset(ref: DataFrame, est: DataFrame, reach: int = 8) -> DataFrame:
    """song_id, offset, tp, f1: the bar offset with the best overlap of (bar, pitch) bags; the first of equals.

    Bags are counted before they are spread over the offsets.
    """
    r = ref.groupBy("song_id", "bar", "pitch").agg(F.count("*").alias("nr"))
    e = est.groupBy("song_id", "bar", "pitch").agg(F.count("*").alias("ne"))
    moved = e.withColumn("offset", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).withColumn("bar", F.col("bar") + F.col("offset"))
    tp = r.join(moved, ["song_id", "bar", "pitch"]).groupBy("song_id", "offset").agg(F.sum(F.least("nr", "ne")).alias("tp"))
    best = tp.groupBy("song_id").agg(F.max_by("offset", F.struct("tp", -F.col("offset"))).alias("offset"), F.max("tp").alias("tp"))
    n = r.groupBy("song_id").agg(F.sum("nr").alias("r")).join(e.groupBy("song_id").agg(F.sum("ne").alias("e")), "song_id")
    return best.join(n, "song_id").select("song_id", "offset", "tp", F.round(2 * F.col("tp") / (F.col("r") + F.col("e")), 6).alias("f1"))


def quant_stats(residuals: DataFrame, by: str) -> DataFrame:
    """by, mean, p90 of |residual|."""
    a = F.abs("residual")
    return residuals.groupBy(by).agg(F.round(F.avg(a), 6).alias("mean"), F.round(F.percentile(a, F.lit(0.9)), 6).alias("p90"))


def weighted_pool(rows: DataFrame, by: str, rate: str, weight: str) -> DataFrame:
    """by, pooled rate; null where the weights do not sum to more than 0."""
    w = F.sum(weight)
    return rows.groupBy(by).agg(F.round(F.when(w > 0, F.sum(F.col(rate) * F.col(weight)) / w), 6).alias("pooled"))


def weighted_delta(a: DataFrame, b: DataFrame, keys: list[str], by: str) -> DataFrame:
    """by, delta: mean |x of a - x of b| over common keys, weighted by w of a."""
    both = a.select(*keys, F.col("x").alias("xa"), "w").join(b.select(*keys, F.col("x").alias("xb")), keys)
    return weighted_pool(both.withColumn("d", F.abs(F.col("xa") - F.col("xb"))), by, "d", "w").withColumnRenamed("pooled", "delta")


def stem_levels(rows: DataFrame, by: str, x: str) -> DataFrame:
    """by, rms, peak, rel_db to the loudest."""
    g = rows.groupBy(by).agg(F.sqrt(F.avg(F.col(x) * F.col(x))).alias("rms"), F.max(F.abs(x)).alias("peak"))
    loud = g.agg(F.max("rms").alias("loud"))  # one row
    return g.join(F.broadcast(loud)).select(by, F.round("rms", 6).alias("rms"), F.round("peak", 6).alias("peak"), F.round(20 * F.log10(F.col("rms") / F.col("loud")), 6).alias("rel_db"))


def silence_gate(notes: DataFrame, level: str, share: float, part: float) -> DataFrame:
    """notes + kept: the level reaches `part` of the song's `share` percentile.

    Levels may equal the gate, so the last digit of the percentile counts: of the two levels around it, the lower one's part is added to the rounded
    part of the upper one with a single rounding, as a fused multiply-add does. One value a song takes this step; a song bounds its levels.
    """

    @F.udf("double")
    def between(low, high, d):
        if d == 0 or not (isfinite(low) and isfinite(high)):
            return low * (1 - d) + high * d if d else low
        return float(Fraction(low) * Fraction(1 - d) + Fraction(high * d))

    xs = notes.groupBy("song_id").agg(F.array_sort(F.collect_list(F.col(level).cast("double"))).alias("_xs")).where(F.size("_xs") > 0)
    at = (F.size("_xs") - 1) * F.lit(float(share))
    near = lambda i: F.get("_xs", i.cast("int"))
    gate = xs.select("song_id", (between(near(F.floor(at)), near(F.ceil(at)), at - F.floor(at)) * part).alias("_gate"))
    return notes.join(gate, "song_id", "left").withColumn("kept", F.col(level) >= F.col("_gate")).drop("_gate")


def anchor_find(anchors: DataFrame, notes: DataFrame, exact_us: int = 100, tol_us: int = 30_000) -> DataFrame:
    """note_id, found, how: the nearest note of the pitch, exact or within tol, else unmatched."""
    away = F.abs(F.col("r_onset_us") - F.col("onset_us"))
    best = near(anchors, notes, ["song_id", "pitch"], tol_us, "left").groupBy("note_id").agg(F.min(F.when(F.col("r_note_id").isNotNull(), F.struct(away.alias("d"), F.col("r_onset_us"), F.col("r_note_id")))).alias("b"))
    how = F.when(F.col("b").isNull(), "unmatched").when(F.col("b.d") <= exact_us, "exact").otherwise("nearest")
    return best.select("note_id", F.col("b.r_note_id").alias("found"), how.alias("how"))


def reapply_classes(anchors: DataFrame, notes: DataFrame, tol_us: int = 30_000, wide_us: int = 100_000) -> DataFrame:
    """song_id, how, n of anchors: exact, within, near (same pitch in wide_us), octave (12 away in tol_us) or gone."""
    pc = lambda df: df.withColumn("pc", F.pmod("pitch", F.lit(12)))
    d, step = F.abs(F.col("onset_us") - F.col("r_onset_us")), F.abs(F.col("pitch") - F.col("r_pitch"))
    rank = F.when((step == 0) & (d <= 100), 0).when((step == 0) & (d <= tol_us), 1).when(step == 0, 2).when((step == 12) & (d <= tol_us), 3).otherwise(4)
    best = near(pc(anchors), pc(notes), ["song_id", "pc"], wide_us, "left").groupBy("song_id", "note_id").agg(F.min(rank).alias("k"))
    names = F.array(*[F.lit(x) for x in ("exact", "within", "near", "octave", "gone")])
    return best.groupBy("song_id", F.element_at(names, F.col("k") + 1).alias("how")).agg(F.count("*").alias("n"))


def covered_bars(bars: DataFrame, spans: DataFrame, slot_us: int = 1_000_000) -> DataFrame:
    """song_id, bar, covered_us, covered (at least half) by the union of spans.

    Both sides are cut at slots of one second, so the overlap is an equi-join on (song, slot).
    """
    def cut(df, a, z):
        rows = df.where(F.col(z) > F.col(a)).withColumn("slot", F.explode(F.sequence(F.floor(F.col(a) / slot_us), F.floor((F.col(z) - 1) / slot_us))))
        return rows.withColumn("a", F.greatest(F.col(a), F.col("slot") * slot_us)).withColumn("z", F.least(F.col(z), (F.col("slot") + 1) * slot_us))

    s = cut(merge_spans(spans, ["song_id"], 0), "start_us", "end_us").select("song_id", "slot", F.col("a").alias("sa"), F.col("z").alias("sz"))
    both = cut(bars.select("song_id", "bar", "start_us", "end_us"), "start_us", "end_us").join(s, ["song_id", "slot"], "left")
    part = F.when(F.col("sa").isNull(), 0).otherwise(F.greatest(F.lit(0), F.least("z", "sz") - F.greatest("a", "sa")))
    out = both.groupBy("song_id", "bar", "start_us", "end_us").agg(F.sum(part).alias("covered_us"))
    return out.select("song_id", "bar", "covered_us", (F.col("covered_us") * 2 >= F.col("end_us") - F.col("start_us")).alias("covered"))


def shift_bars(bars: DataFrame, edits: DataFrame) -> DataFrame:
    """bars with start_us moved by every edit (song_id, bar, shift_us) of that bar or an earlier one."""
    w = Window.partitionBy("song_id").orderBy("bar").rowsBetween(Window.unboundedPreceding, 0)
    moved = bars.join(edits.groupBy("song_id", "bar").agg(F.sum("shift_us").alias("_s")), ["song_id", "bar"], "left")
    return moved.select("song_id", "bar", (F.col("start_us") + F.sum(F.coalesce("_s", F.lit(0))).over(w)).alias("start_us"))


def spread_beats(starts: DataFrame, per_bar: int = 4) -> DataFrame:
    """song_id, bar, beat, t_us: evenly spaced beats from each known bar start to the next, over missing bars too."""
    w = Window.partitionBy("song_id").orderBy("bar")
    first = starts.groupBy("song_id", "bar").agg(F.min("start_us").alias("t"))
    gap = first.select("*", F.lead("bar").over(w).alias("nb"), F.lead("t").over(w).alias("nt")).where("nb is not null")
    n = (F.col("nb") - F.col("bar")) * per_bar
    rows = gap.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    return rows.select("song_id", (F.col("bar") + F.floor(F.col("i") / per_bar)).alias("bar"), (F.col("i") % per_bar + 1).alias("beat"), F.round(F.col("t") + (F.col("nt") - F.col("t")) * F.col("i") / n, 6).alias("t_us"))


def peaks(series: DataFrame, around: int = 3, mean_around: int = 10, delta: float = 1.0, wait: int = 5) -> DataFrame:
    """song_id, frame, x of local maxima at least delta over their local mean; a peak silences the next `wait` frames."""
    w = Window.partitionBy("song_id").orderBy("frame")
    top, mean = F.max("x").over(w.rowsBetween(-around, around)), F.avg("x").over(w.rowsBetween(-mean_around, mean_around))
    picked = series.withColumn("_p", (F.col("x") == top) & (F.col("x") >= mean + delta)).where("_p").drop("_p")
    kept = anchored_clusters(picked.select("song_id", F.col("frame"), "x"), ["song_id"], wait, "frame", "frame")
    return kept.where("frame = anchor_us").select("song_id", "frame", "x")


def review_queue(notes: DataFrame, p: str, low: float) -> DataFrame:
    """song_id, note_id, kind, place: unassigned notes and unsure ones, the least sure first."""
    kind = F.when(F.col("line").isNull(), "unassigned").when(F.col(p) < low, "unsure")
    rows = notes.withColumn("kind", kind).where("kind is not null")
    return rows.select("song_id", "note_id", "kind", F.row_number().over(Window.partitionBy("song_id").orderBy(p, "note_id")).alias("place"))


def corrupt(notes: DataFrame, seed: str, gone: float = 0.1, octave: float = 0.05, jitter_us: int = 20_000) -> DataFrame:
    """notes with some deleted, raised by an octave and all moved, by hashes of the seed and note_id."""
    u = lambda slot: uniform(seed, F.col("note_id"), F.lit(slot))
    moved = F.greatest(F.lit(0), F.col("onset_us") + F.floor((u(2) * 2 - 1) * jitter_us))
    return notes.where(u(0) >= gone).select("song_id", "note_id", moved.alias("onset_us"), (F.col("pitch") + F.when(u(1) < octave, 12).otherwise(0)).alias("pitch"))
