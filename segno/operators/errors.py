"""Error tables of an experiment: causes, what a condition adds, what to mend first.

errors: arm, cond, kind (fp, fn), cause, dominant; one row an error. scores: arm, song_id, item, cond, tp, fp, fn, minutes, active (minutes in which what the
condition adds sounds); one row an item heard under a condition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.scalars import draw, f1
from .measures import spread


def cause_matrix(errors: DataFrame, scores: DataFrame) -> DataFrame:
    """arm, cond, kind, cause, n, per_min: errors over all minutes that the arm heard under the condition; cause "*" holds all causes."""
    minutes = scores.groupBy("arm", "cond").agg(F.sum("minutes").alias("_m")).where("_m > 0")
    n = errors.groupingSets([["arm", "cond", "kind", "cause"], ["arm", "cond", "kind"]], "arm", "cond", "kind", "cause")
    n = n.agg(F.count("*").alias("n"), F.grouping("cause").alias("_all"))
    cause = F.when(F.col("_all") == 1, "*").otherwise(F.col("cause"))
    return n.join(minutes, ["arm", "cond"]).select("arm", "cond", "kind", cause.alias("cause"), "n", F.round(F.col("n") / F.col("_m"), 6).alias("per_min"))


def cause_vs_dominant(errors: DataFrame) -> DataFrame:
    """arm, cond, cause, dominant, n of the false positives."""
    return errors.where("kind = 'fp'").groupBy("arm", "cond", "cause", "dominant").agg(F.count("*").alias("n"))


def discrimination(outputs: DataFrame) -> DataFrame:
    """arm, cond, dominant, dropped, kept_fp, rate of output notes (arm, cond, dominant, dropped, matched) that match no reference: how many of those a sound dominates
    were left out. Matched notes that were left out make one row more, with dominant "_true" and no rate."""
    wrong = outputs.where(~F.col("matched") & F.col("dominant").isNotNull()).groupBy("arm", "cond", "dominant")
    wrong = wrong.agg(F.count_if("dropped").alias("dropped"), F.count_if(~F.col("dropped")).alias("kept_fp"))
    rate = F.round(F.col("dropped") / (F.col("dropped") + F.col("kept_fp")), 6)
    true = outputs.groupBy("arm", "cond").agg(F.count_if(F.col("matched") & F.col("dropped")).alias("dropped"))
    true = true.select("arm", "cond", F.lit("_true").alias("dominant"), "dropped", F.lit(0).cast("long").alias("kept_fp"), F.lit(None).cast("double").alias("rate"))
    return wrong.withColumn("rate", rate).unionByName(true)


def redrawn(totals: DataFrame, by: list[str], group: str, stats: dict[str, Column], reps: int, seed: str) -> DataFrame:
    """by, stat, delta, low, high: each stat of the sums over all groups, and over groups drawn with replacement. totals: one row a group."""
    facts = [c for c in totals.columns if c not in (*by, group)]
    w = Window.partitionBy(*by)
    numbered = totals.withColumn("_place", F.row_number().over(w.orderBy(group)) - 1).withColumn("_n", F.count("*").over(w))
    slots = spread(numbered.select(*by, "_n", F.col("_place").alias("_slot"))).withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).hint("merge")
    drawn = slots.select(*by, "_rep", draw(seed, F.col("_rep"), F.col("_slot"), F.col("_n")).cast("int").alias("_place"))
    sums = [F.sum(c).alias(c) for c in facts]
    long = F.explode(F.array(*[F.struct(F.lit(n).alias("stat"), c.cast("double").alias("v")) for n, c in stats.items()]))
    each = drawn.join(numbered, [*by, "_place"]).groupBy(*by, "_rep").agg(*sums).select(*by, long.alias("s"))
    ci = each.groupBy(*by, "s.stat").agg(F.percentile("s.v", F.lit(0.025)).alias("low"), F.percentile("s.v", F.lit(0.975)).alias("high"))
    point = totals.groupBy(*by).agg(*sums).select(*by, long.alias("s")).select(*by, "s.stat", F.col("s.v").alias("delta"))
    return point.join(ci, [*by, "stat"]).select(*by, "stat", *[F.round(c, 6).alias(c) for c in ("delta", "low", "high")])


def compared(scores: DataFrame, base: str, keep: list[str]) -> DataFrame:
    """Items under every other condition beside the same items of the same arm under `base`."""
    own = scores.where(F.col("cond") == base).select("arm", "song_id", "item", *[F.col(c).alias(f"{c}_0") for c in keep])
    return scores.where(F.col("cond") != base).join(own, ["arm", "song_id", "item"])


def category_deltas(scores: DataFrame, base: str, reps: int = 200, seed: str = "20260930") -> DataFrame:
    """arm, cond, items, songs, stat, delta, low, high: what each condition changes against `base` on the items that have both, with 95 % of paired draws of songs.

    stat: fp_per_min, fn_per_min, f1, and both rates per minute of the condition's own activity (null where there is none). Songs are summed first.
    """
    facts = ["tp", "fp", "fn", "minutes"]
    pairs = compared(scores, base, facts)
    by = ["arm", "cond"]
    sizes = pairs.groupBy(*by).agg(F.count("*").alias("items"), F.count_distinct("song_id").alias("songs"))
    totals = pairs.groupBy(*by, "song_id").agg(*[F.sum(c).alias(c) for c in (*facts, *[f"{f}_0" for f in facts], "active")])
    c = F.col
    rate = lambda k: c(k) / c("minutes") - c(f"{k}_0") / c("minutes_0")
    own = lambda k: F.when(c("active") > 0, (c(k) - c(f"{k}_0")) / c("active"))
    stats = {
        "fp_per_min": rate("fp"), "fn_per_min": rate("fn"), "f1": f1(c("tp"), c("fp"), c("fn")) - f1(c("tp_0"), c("fp_0"), c("fn_0")), "fp_per_active_min": own("fp"), "fn_per_active_min": own("fn")
    }
    return sizes.join(redrawn(totals, by, "song_id", stats, reps, seed), by)


def null_changes(scores: DataFrame, base: str, null: str) -> DataFrame:
    """arm, song_id, item, d_fp_per_min, d_fn_per_min, d_f1 (points): what an inaudible change moves in each item."""
    pairs = compared(scores.where(F.col("cond").isin(base, null)), base, ["tp", "fp", "fn"])
    c = F.col
    score = lambda t, p, n: 100 * F.when(2 * c(t) + c(p) + c(n) > 0, 2 * c(t) / (2 * c(t) + c(p) + c(n))).otherwise(1.0)
    return pairs.select(
        "arm", "song_id", "item", ((c("fp") - c("fp_0")) / c("minutes")).alias("d_fp_per_min"), ((c("fn") - c("fn_0")) / c("minutes")).alias("d_fn_per_min"),
        (score("tp", "fp", "fn") - score("tp_0", "fp_0", "fn_0")).alias("d_f1"),
    )


def null_spread(scores: DataFrame, base: str, null: str, by: list[str]) -> DataFrame:
    """by, items, d_fp_per_min, d_fn_per_min, d_f1: the median size of what an inaudible change moves."""
    moved = null_changes(scores, base, null).groupBy(*by)
    return moved.agg(F.count("*").alias("items"), *[F.round(F.median(F.abs(c)), 6).alias(c) for c in ("d_fp_per_min", "d_fn_per_min", "d_f1")])


def fix_first(deltas: DataFrame, causes: DataFrame, changes: DataFrame, items: int, full: str, top: int = 9) -> DataFrame:
    """arm, place, source, kind, errors_per_min, weighted: the `top` sources of errors of each arm, then by name.

    category: what a condition adds (deltas of category_deltas), weighted by its share of all `items`; fp_cause, fn_cause: what remains under condition `full` (causes of
    cause_matrix); null: what an inaudible change moves on average (changes of null_changes).
    """
    both = deltas.where("stat in ('fp_per_min', 'fn_per_min')").groupBy("arm", "cond", "items").agg(F.sum("delta").alias("errors_per_min"))
    a = both.select("arm", F.col("cond").alias("source"), F.lit("category").alias("kind"), "errors_per_min", (F.col("errors_per_min") * F.col("items") / items).alias("weighted"))
    rest = causes.where((F.col("cond") == full) & (F.col("cause") != "*"))
    b = rest.select("arm", F.col("cause").alias("source"), F.concat("kind", F.lit("_cause")).alias("kind"), F.col("per_min").alias("errors_per_min"), F.col("per_min").alias("weighted"))
    moved = F.avg(F.abs("d_fp_per_min") + F.abs("d_fn_per_min"))
    n = changes.groupBy("arm").agg(moved.alias("errors_per_min")).select("arm", F.lit("null").alias("source"), F.lit("null").alias("kind"), "errors_per_min", F.col("errors_per_min").alias("weighted"))
    rows = a.unionByName(b).unionByName(n).select("arm", "source", "kind", F.round("errors_per_min", 6).alias("errors_per_min"), F.round("weighted", 6).alias("weighted"))
    place = F.row_number().over(Window.partitionBy("arm").orderBy(F.desc("weighted"), "source", "kind"))
    return rows.withColumn("place", place).where(F.col("place") <= top)
