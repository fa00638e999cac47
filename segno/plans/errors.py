"""Queries of error tables: notes against their corruption, heard in windows of five conditions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import errors, timeline
from ..sources import fixtures as X
from . import statements as T
from .queries import query

#: Condition of an item as it is, and the ones that change nothing audible or hold everything.
BASE, NULL, FULL = "R0", "R1", "mixed"
#: Output notes shorter than this are left out by the second arm.
LONG_US = 300_000


def compared(spark, d):
    """song_id, item, cond, arm, dominant, side (ref, est), cause (null: matched), dropped: every note of both lists. Five windows, one of each condition, are an item."""
    ref, est = X.notes_ref(spark, d), X.notes_est(spark, d)

    def side(own, other, name, lacking):
        rows = timeline.window_of(own, X.windows(spark, d)).where("window is not null").join(other.select("note_id", F.col("pitch").alias("_p")), "note_id", "left")
        cause = F.when(F.col("_p").isNull(), lacking).when(F.col("_p") != F.col("pitch"), "octave")
        return rows.select("song_id", F.expr("window div 5").alias("item"), F.col("label").alias("cond"), F.col("instrument").alias("dominant"), F.lit(name).alias("side"), cause.alias("cause"), (F.col("offset_us") - F.col("onset_us") < LONG_US).alias("short"))

    both = side(ref, est, "ref", "missed").unionByName(side(est, ref, "est", "added"))
    return both.withColumn("arm", F.explode(F.array(F.lit("all"), F.lit("long")))).withColumn("dropped", (F.col("arm") == "long") & F.col("short")).drop("short")


def error_rows(spark, d):
    rows = compared(spark, d)
    fn = rows.where("side = 'ref' and (cause is not null or dropped)").withColumn("cause", F.coalesce("cause", F.lit("left out")))
    fp = rows.where("side = 'est' and cause is not null and not dropped")
    return fp.withColumn("kind", F.lit("fp")).unionByName(fn.withColumn("kind", F.lit("fn"))).select("arm", "cond", "kind", "cause", "dominant")


def score_rows(spark, d):
    c = compared(spark, d).withColumn("_hit", F.col("cause").isNull() & ~F.col("dropped"))
    n = c.groupBy("arm", "song_id", "item", "cond").agg(
        F.count_if((F.col("side") == "ref") & F.col("_hit")).alias("tp"), F.count_if((F.col("side") == "ref") & ~F.col("_hit")).alias("fn"),
        F.count_if((F.col("side") == "est") & F.col("cause").isNotNull() & ~F.col("dropped")).alias("fp"),
    )
    where = F.expr("window div 5").alias("item")
    sounds = T.windowed(spark, d).where("instrument = 'click'").groupBy("song_id", F.expr("w div 5").alias("item"), F.col("label").alias("cond")).agg((F.sum(F.col("offset_us") - F.col("onset_us")) / 6e7).alias("active"))
    spans = X.windows(spark, d).select("song_id", where, F.col("label").alias("cond"), ((F.col("end_us") - F.col("start_us")) / 6e7).alias("minutes"))
    spans = spans.withColumn("arm", F.explode(F.array(F.lit("all"), F.lit("long"))))
    keys = ["song_id", "item", "cond"]
    return spans.join(n, ["arm", *keys], "left").join(sounds, keys, "left").fillna(0, ["tp", "fp", "fn", "active"])


ROWS = T.MORE + """, ew AS (SELECT n.*, v.w, v.label FROM ne n ASOF JOIN wi v ON n.song_id = v.song_id AND n.onset_us >= v.start_us WHERE n.onset_us < v.end_us), ar AS (SELECT 'all' AS arm UNION ALL SELECT 'long'),
 co AS (SELECT arm, song_id, w // 5 AS item, label AS cond, instrument AS dominant, side, cause, arm = 'long' AND len < 300000 AS dropped FROM ar, (SELECT a.song_id, a.w, a.label, a.instrument, 'ref' AS side, CASE WHEN b.note_id IS NULL THEN 'missed' WHEN b.pitch <> a.pitch THEN 'octave' END AS cause, a.offset_us - a.onset_us AS len FROM nw a LEFT JOIN ne b USING (note_id)
  UNION ALL SELECT a.song_id, a.w, a.label, a.instrument, 'est', CASE WHEN b.note_id IS NULL THEN 'added' WHEN b.pitch <> a.pitch THEN 'octave' END, a.offset_us - a.onset_us FROM ew a LEFT JOIN nr b USING (note_id))),
 er AS (SELECT arm, cond, 'fp' AS kind, cause, dominant FROM co WHERE side = 'est' AND cause IS NOT NULL AND NOT dropped UNION ALL SELECT arm, cond, 'fn', coalesce(cause, 'left out'), dominant FROM co WHERE side = 'ref' AND (cause IS NOT NULL OR dropped)),
 ac AS (SELECT song_id, w // 5 AS item, label AS cond, sum(offset_us - onset_us) / 60000000.0 AS active FROM nw WHERE instrument = 'click' GROUP BY ALL),
 cn AS (SELECT arm, song_id, item, cond, count_if(side = 'ref' AND cause IS NULL AND NOT dropped) AS tp, count_if(side = 'ref' AND (cause IS NOT NULL OR dropped)) AS fn, count_if(side = 'est' AND cause IS NOT NULL AND NOT dropped) AS fp FROM co GROUP BY ALL),
 so AS (SELECT ar.arm, w.song_id, w.w // 5 AS item, w.label AS cond, (end_us - start_us) / 60000000.0 AS minutes, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn, coalesce(active, 0) AS active FROM wi w CROSS JOIN ar LEFT JOIN cn ON cn.arm = ar.arm AND cn.song_id = w.song_id AND cn.item = w.w // 5 AND cn.cond = w.label LEFT JOIN ac ON ac.song_id = w.song_id AND ac.item = w.w // 5 AND ac.cond = w.label),
 mi AS (SELECT arm, cond, sum(minutes) AS m FROM so GROUP BY ALL), cm AS (SELECT arm, cond, kind, coalesce(cause, '*') AS cause, count(*) AS n FROM er GROUP BY GROUPING SETS ((arm, cond, kind, cause), (arm, cond, kind))),
 cx AS (SELECT arm, cond, kind, cause, n, round(n / m, 6) AS per_min FROM cm JOIN mi USING (arm, cond)),
 pa AS (SELECT c.*, b.tp AS tp0, b.fp AS fp0, b.fn AS fn0, b.minutes AS m0 FROM so c JOIN so b ON c.arm = b.arm AND c.song_id = b.song_id AND c.item = b.item AND b.cond = 'R0' WHERE c.cond <> 'R0'),
 su AS (SELECT arm, cond, song_id, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(minutes) AS m, sum(tp0) AS tp0, sum(fp0) AS fp0, sum(fn0) AS fn0, sum(m0) AS m0, sum(active) AS act FROM pa GROUP BY ALL), pl AS (SELECT *, row_number() OVER (PARTITION BY arm, cond ORDER BY song_id) - 1 AS place, count(*) OVER (PARTITION BY arm, cond) AS n FROM su),
 dr AS (SELECT arm, cond, rep, ('0x' || substr(sha256('20260930:' || rep || ':' || place), 1, 8))::BIGINT % n AS place FROM pl, range(200) AS r(rep)), dd AS (SELECT rep, pl.* FROM dr JOIN pl USING (arm, cond, place) UNION ALL SELECT -1, * FROM pl),
 st AS (SELECT arm, cond, rep, sum(fp) / sum(m) - sum(fp0) / sum(m0) AS fp_per_min, sum(fn) / sum(m) - sum(fn0) / sum(m0) AS fn_per_min, 2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) - 2 * sum(tp0) / (2 * sum(tp0) + sum(fp0) + sum(fn0)) AS f1,
  CASE WHEN sum(act) > 0 THEN (sum(fp) - sum(fp0)) / sum(act) END AS fp_per_active_min, CASE WHEN sum(act) > 0 THEN (sum(fn) - sum(fn0)) / sum(act) END AS fn_per_active_min FROM dd GROUP BY ALL),
 un AS (SELECT * FROM st UNPIVOT INCLUDE NULLS (v FOR stat IN (fp_per_min, fn_per_min, f1, fp_per_active_min, fn_per_active_min))),
 de AS (SELECT arm, cond, stat, round(max(v) FILTER (rep = -1), 6) AS delta, round(quantile_cont(v, 0.025) FILTER (rep >= 0), 6) AS low, round(quantile_cont(v, 0.975) FILTER (rep >= 0), 6) AS high FROM un GROUP BY ALL), si AS (SELECT arm, cond, count(*) AS items, count(DISTINCT song_id) AS songs FROM pa GROUP BY ALL),
 nu AS (SELECT arm, song_id, item, (fp - fp0) / minutes AS dp, (fn - fn0) / minutes AS dn, CASE WHEN 2 * tp + fp + fn > 0 THEN 200 * tp / (2 * tp + fp + fn) ELSE 100 END - CASE WHEN 2 * tp0 + fp0 + fn0 > 0 THEN 200 * tp0 / (2 * tp0 + fp0 + fn0) ELSE 100 END AS df FROM pa WHERE cond = 'R1')"""


@query(ROWS + " SELECT * FROM cx")
def g29_cause_per_minute(spark, d):
    return errors.cause_matrix(error_rows(spark, d), score_rows(spark, d))


@query(ROWS + " SELECT arm, cond, cause, dominant, count(*) AS n FROM er WHERE kind = 'fp' GROUP BY ALL")
def g29_cause_vs_dominant(spark, d):
    return errors.cause_vs_dominant(error_rows(spark, d))


@query(ROWS + """ SELECT arm, cond, dominant, count_if(dropped) AS dropped, count_if(NOT dropped) AS kept_fp, round(avg(dropped::INTEGER), 6) AS rate FROM co WHERE side = 'est' AND cause IS NOT NULL GROUP BY ALL
 UNION ALL SELECT arm, cond, '_true', count_if(dropped AND cause IS NULL), 0, NULL FROM co WHERE side = 'est' GROUP BY ALL""")
def g29_discrimination(spark, d):
    return errors.discrimination(compared(spark, d).where("side = 'est'").withColumn("matched", F.col("cause").isNull()))


@query(ROWS + " SELECT arm, cond, items, songs, stat, delta, low, high FROM de JOIN si USING (arm, cond)")
def g30_category_deltas(spark, d):
    return errors.category_deltas(score_rows(spark, d), BASE)


@query(ROWS + """, ff AS (SELECT arm, cond AS source, 'category' AS kind, sum(delta) AS e, sum(delta) * any_value(items) / (SELECT count(DISTINCT (song_id, item)) FROM so) AS wt FROM de JOIN si USING (arm, cond) WHERE stat IN ('fp_per_min', 'fn_per_min') GROUP BY ALL
  UNION ALL SELECT arm, cause, kind || '_cause', per_min, per_min FROM cx WHERE cond = 'mixed' AND cause <> '*' UNION ALL SELECT arm, 'null', 'null', avg(abs(dp) + abs(dn)), avg(abs(dp) + abs(dn)) FROM nu GROUP BY arm)
 SELECT arm, source, kind, round(e, 6) AS errors_per_min, round(wt, 6) AS weighted, row_number() OVER (PARTITION BY arm ORDER BY round(wt, 6) DESC, source, kind) AS place FROM ff QUALIFY place <= 9""")
def g31_fix_first(spark, d):
    scores = score_rows(spark, d)
    items = scores.select("song_id", "item").distinct().count()
    return errors.fix_first(errors.category_deltas(scores, BASE), errors.cause_matrix(error_rows(spark, d), scores), errors.null_changes(scores, BASE, NULL), items, FULL)


@query(ROWS + " SELECT arm, song_id, count(*) AS items, round(median(abs(dp)), 6) AS d_fp_per_min, round(median(abs(dn)), 6) AS d_fn_per_min, round(median(abs(df)), 6) AS d_f1 FROM nu GROUP BY ALL")
def g32_null_spread(spark, d):
    return errors.null_spread(score_rows(spark, d), BASE, NULL, ["arm", "song_id"])
