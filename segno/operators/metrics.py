"""Pooled accuracy, bootstrap intervals, multiset and rule metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.scalars import draw, f1, precision, recall
from ..sources.quality import dealt
from .measures import paired_bootstrap, spread


def note_prf(counts: DataFrame, by: list[str]) -> DataFrame:
    """Pooled tp, fp, fn and precision, recall, f1 by `by`, from tp, n_ref, n_est."""
    g = counts.groupBy(*by).agg(F.sum("tp").alias("tp"), (F.sum("n_est") - F.sum("tp")).alias("fp"), (F.sum("n_ref") - F.sum("tp")).alias("fn"))
    facts = [F.col(c) for c in ("tp", "fp", "fn")]
    return g.select(*by, "tp", "fp", "fn", *[F.round(f(*facts), 6).alias(n) for n, f in (("precision", precision), ("recall", recall), ("f1", f1))])


def block_bootstrap(items: DataFrame, by: list[str], group: str, reps: int = 200, seed: str = "20260930") -> DataFrame:
    """by, point, low, high of the pooled F1: groups are drawn with replacement, as often as there are groups.

    Items are first summed to one row per group, so what is drawn from and joined is that small table.
    """
    totals = items.groupBy(*by, group).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    w = Window.partitionBy(*by)
    totals = totals.withColumn("place", F.row_number().over(w.orderBy(group)) - 1).withColumn("n", F.count("*").over(w))
    slots = spread(totals.select(*by, "n", F.col("place").alias("slot"))).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).hint("merge")
    drawn = slots.withColumn("place", draw(seed, F.col("rep"), F.col("slot"), F.col("n")).cast("int"))
    facts = [F.sum(c).alias(c) for c in ("tp", "fp", "fn")]
    each = drawn.join(totals.drop("n"), [*by, "place"]).groupBy(*by, "rep", "n").agg(*facts).withColumn("f1", f1(F.col("tp"), F.col("fp"), F.col("fn")))
    ci = each.groupBy(*by, "n").agg(F.percentile("f1", F.lit(0.025)).alias("low"), F.percentile("f1", F.lit(0.975)).alias("high"))
    point = totals.groupBy(*by).agg(*facts).select(*by, f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("point"))
    enough = F.col("n") >= 2
    return point.join(ci, by).select(*by, F.round("point", 6).alias("point"), *[F.when(enough, F.round(c, 6)).alias(c) for c in ("low", "high")])


def bag_counts(ref: DataFrame, est: DataFrame, by: list[str], pitch: str, part: str) -> DataFrame:
    """by, tp, n_ref, n_est of multisets: the reference bag is the most any part holds of a pitch."""
    rows = ref.select(*by, pitch, part, F.lit(1).alias("r"), F.lit(0).alias("e")).unionByName(est.select(*by, pitch, F.lit(None).alias(part), F.lit(0).alias("r"), F.lit(1).alias("e")))
    # one shuffle: whatever is grouped lies within a group of `by`
    each = dealt(rows, *by).groupBy(*by, pitch, part).agg(F.sum("r").alias("r"), F.sum("e").alias("e")).groupBy(*by, pitch).agg(F.max("r").alias("nr"), F.sum("e").alias("ne"))
    known = F.array_position(F.array(*[F.col(c).isNull() for c in [*by, pitch]]), True) == 0  # unknown keys match nothing
    return each.groupBy(*by).agg(F.sum(F.when(known, F.least("nr", "ne")).otherwise(0)).alias("tp"), F.sum("nr").alias("n_ref"), F.sum("ne").alias("n_est"))


def burst_spans(notes: DataFrame, window_us: int = 10_000_000, least: int = 20, tiny_us: int = 60_000) -> DataFrame:
    """song_id, bucket, n, tiny of windows with many notes: mostly tiny ones, or over 3 times the upper median count."""
    n = notes.groupBy("song_id", F.expr(f"onset_us div {window_us}").alias("bucket")).agg(F.count("*").alias("n"), F.count_if(F.col("offset_us") - F.col("onset_us") < tiny_us).alias("tiny"))
    busy = n.groupBy("song_id").agg(F.element_at(F.array_sort(F.collect_list("n")), (F.floor(F.count("*") / 2) + 1).cast("int")).alias("median"))
    hot = (F.col("n") >= least) & ((F.col("tiny") * 2 >= F.col("n")) | (F.col("n") > 3 * F.col("median")))
    return n.join(busy, "song_id").where(hot).select("song_id", "bucket", "n", "tiny")


def macro_accuracy(pairs: DataFrame, truth: str, guess: str) -> DataFrame:
    """One row: accuracy averaged over the classes present."""
    each = pairs.groupBy(truth).agg(F.avg((F.col(truth) == F.col(guess)).cast("double")).alias("a"))
    return each.agg(F.round(F.avg("a"), 6).alias("macro"), F.count("*").alias("classes"))


def worst_bars(missed: DataFrame, extra: DataFrame) -> DataFrame:
    """song_id, bar, missed, extra, total of bars with errors."""
    both = missed.select("song_id", "bar", F.lit(1).alias("m"), F.lit(0).alias("x")).unionByName(extra.select("song_id", "bar", F.lit(0).alias("m"), F.lit(1).alias("x")))
    return both.groupBy("song_id", "bar").agg(F.sum("m").alias("missed"), F.sum("x").alias("extra"), F.count("*").alias("total"))


def majority_line(notes: DataFrame, by: str = "song_id") -> DataFrame:
    """by, line, share: the line that holds most notes (ties: the lowest)."""
    n = notes.groupBy(by, "line").agg(F.count("*").alias("n"))
    return n.groupBy(by).agg(F.max_by("line", F.struct("n", -F.col("line"))).alias("line"), F.round(F.max("n") / F.sum("n"), 6).alias("share"))


def evaluate_arms(items: DataFrame, arm: str, group: str, baseline: str, least: float = 0.0) -> DataFrame:
    """arm, dev_f1, chosen, delta, low, high, decision: pooled F1 of each arm on even groups; the best other arm than the baseline (ties:
    the first) is confirmed on odd groups by a bootstrap of group draws over its gain."""
    facts = [F.sum(c).alias(c) for c in ("tp", "fp", "fn")]
    dev = items.where(F.col(group) % 2 == 0).groupBy(arm).agg(*facts).select(F.col(arm).alias("arm"), F.round(f1(F.col("tp"), F.col("fp"), F.col("fn")), 6).alias("dev_f1"))
    best = dev.where(F.col("arm") != baseline).agg(F.min_by("arm", F.struct(-F.col("dev_f1"), "arm")).alias("best"))
    test = items.where(F.col(group) % 2 == 1).crossJoin(F.broadcast(best)).where((F.col(arm) == baseline) | (F.col(arm) == F.col("best")))
    side = lambda c, base: F.sum(F.when((F.col(arm) == baseline) == F.lit(base), F.col(c)).otherwise(0))
    both = test.groupBy(group).agg(*[side(c, x == "a").alias(f"{c}_{x}") for x in "ab" for c in ("tp", "fp", "fn")]).withColumn("_all", F.lit(1))
    gain = paired_bootstrap(both, ["_all"], group).drop("_all")
    decision = F.when(F.col("low").isNull(), "hold").when(F.col("low") > least, "adopt").when(F.col("high") < least, "reject").otherwise("hold")
    out = dev.crossJoin(F.broadcast(best)).crossJoin(F.broadcast(gain)).withColumn("chosen", F.col("arm") == F.col("best"))
    own = lambda c: F.when(F.col("chosen"), F.col(c)).alias(c)
    return out.select("arm", "dev_f1", "chosen", own("delta"), own("low"), own("high"), F.when(F.col("chosen"), decision).alias("decision"))


def ratio_bootstrap(items: DataFrame, by: list[str], group: str, reps: int = 200, seed: str = "20260930") -> DataFrame:
    """by, point, low, high of the pooled ratio sum(total) / sum(n), from draws of whole groups."""
    sums = [F.sum(c).alias(c) for c in ("total", "n")]
    totals = items.groupBy(*by, group).agg(*sums)
    w = Window.partitionBy(*by)
    totals = totals.withColumn("place", F.row_number().over(w.orderBy(group)) - 1).withColumn("_g", F.count("*").over(w))
    slots = spread(totals.select(*by, "_g", F.col("place").alias("slot"))).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).hint("merge")
    drawn = slots.withColumn("place", draw(seed, F.col("rep"), F.col("slot"), F.col("_g")).cast("int"))
    ratio = F.try_divide("total", "n")
    each = drawn.join(totals.drop("_g"), [*by, "place"]).groupBy(*by, "rep").agg(*sums).withColumn("x", ratio)
    ci = each.groupBy(*by).agg(F.percentile("x", F.lit(0.025)).alias("low"), F.percentile("x", F.lit(0.975)).alias("high"))
    return totals.groupBy(*by).agg(*sums).select(*by, ratio.alias("point")).join(ci, by).select(*by, *[F.round(c, 6).alias(c) for c in ("point", "low", "high")])
