"""Queries of tunings, lags and rules of windows: the guitar has the notes of lines above 0 and the bass those of line 0, both eight half tones lower."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import evidence
from ..sources import fixtures as X
from ..sources.quality import written
from . import statements as T
from .queries import query

TUNED = """, gu AS MATERIALIZED (SELECT song_id, note_id, onset_us, pitch - 8 AS pitch FROM nr WHERE line > 0), ba AS MATERIALIZED (SELECT song_id, onset_us, offset_us, pitch - 8 AS pitch FROM nr WHERE line = 0),
 lw AS (SELECT g.*, (SELECT count(*) FROM gu o WHERE o.song_id = g.song_id AND o.note_id <> g.note_id AND abs(o.onset_us - g.onset_us) <= 50000) AS others, (SELECT count(*) FROM gu o WHERE o.song_id = g.song_id AND o.note_id <> g.note_id AND abs(o.onset_us - g.onset_us) <= 50000 AND o.pitch = g.pitch + 12) AS up,
  (SELECT count(*) FROM gu o WHERE o.song_id = g.song_id AND o.note_id <> g.note_id AND o.pitch < 40 AND abs(o.onset_us - g.onset_us) <= 2000000) AS lows FROM gu g WHERE pitch < 40),
 fk AS MATERIALIZED (SELECT song_id, note_id, 'bleed' AS why FROM lw WHERE others = 0 AND EXISTS (SELECT 1 FROM ba WHERE ba.song_id = lw.song_id AND ba.pitch = lw.pitch AND ba.onset_us <= lw.onset_us + 50000 AND ba.offset_us >= lw.onset_us - 50000)
  UNION ALL SELECT song_id, note_id, 'octave' FROM lw WHERE others = 1 AND up = 1 AND lows < 2)"""


def tuned(spark, d):
    n = X.notes_ref(spark, d).withColumn("pitch", F.col("pitch") - 8)
    return n.where("line > 0"), n.where("line = 0")


@query(TUNED + " SELECT song_id, note_id, why FROM fk")
def w46_fake_low_notes(spark, d):
    return evidence.fake_low_notes(*tuned(spark, d))


_STRINGS = ", ".join(f"('{h['tuning']}', {lo}, {hi})" for h in evidence.hypotheses() for lo, hi in zip(h["low"], h["high"]))


@query(
    TUNED
    + f""", hy(tuning, lo, hi) AS (VALUES {_STRINGS}) SELECT song_id, tuning, count(*) AS notes, round(count_if(NOT fits) / count(*), 6) AS unplayable
 FROM (SELECT g.song_id, g.note_id, tuning, bool_or(pitch BETWEEN lo AND hi) AS fits FROM gu g CROSS JOIN hy WHERE g.note_id NOT IN (SELECT note_id FROM fk) GROUP BY ALL) GROUP BY ALL"""
)
def w46_tuning_feasibility(spark, d):
    return evidence.tuning_feasibility(*tuned(spark, d)).withColumn("unplayable", F.round("unplayable", 6))


#: The second stream is the first one later, by a lag of the song and a drift, with some notes missing.
LAGS = """, fa AS MATERIALIZED (SELECT song_id, onset_us // 100000 AS frame, count(*) AS x FROM nr GROUP BY ALL), fb AS MATERIALIZED (SELECT song_id, (onset_us + song_id % 5 * 100000 + onset_us // 1200) // 100000 AS frame, count(*) AS x FROM nr WHERE note_id % 10 <> 0 GROUP BY ALL),
 lg AS (SELECT CAST(k AS BIGINT) - 12 AS lag FROM range(25) AS z(k)), ea AS (SELECT song_id, frame // 300 AS w, sum(x * x) AS e FROM fa GROUP BY ALL), eb AS (SELECT song_id, (frame - lag) // 300 AS w, lag, sum(x * x) AS e FROM fb, lg WHERE frame >= lag GROUP BY ALL),
 dt AS (SELECT a.song_id, a.frame // 300 AS w, lag, sum(a.x * b.x) AS dot FROM fa a CROSS JOIN lg JOIN fb b ON b.song_id = a.song_id AND b.frame = a.frame + lag GROUP BY ALL),
 rr AS MATERIALIZED (SELECT dt.song_id, dt.w, dt.lag, round(dot / sqrt(ea.e * eb.e), 9) AS r FROM dt JOIN ea USING (song_id, w) JOIN eb ON eb.song_id = dt.song_id AND eb.w = dt.w AND eb.lag = dt.lag),
 bl AS (SELECT * FROM rr QUALIFY row_number() OVER (PARTITION BY song_id, w ORDER BY r DESC, abs(lag), lag) = 1),
 bw AS MATERIALIZED (SELECT b.song_id, b.w, b.lag, b.r, b.r / (SELECT max(r) FROM rr o WHERE o.song_id = b.song_id AND o.w = b.w AND abs(o.lag - b.lag) > 2) AS ratio, b.lag + coalesce(CASE WHEN p.r - 2 * b.r + n.r < 0 THEN least(greatest(0.5 * (p.r - n.r) / (p.r - 2 * b.r + n.r), -0.5), 0.5) END, 0) AS refined
  FROM bl b LEFT JOIN rr p ON p.song_id = b.song_id AND p.w = b.w AND p.lag = b.lag - 1 LEFT JOIN rr n ON n.song_id = b.song_id AND n.w = b.w AND n.lag = b.lag + 1)"""


def lags(spark, d):
    n = X.notes_ref(spark, d)
    later = F.expr("(onset_us + song_id % 5 * 100000 + onset_us div 1200) div 100000")
    a = n.groupBy("song_id", F.expr("onset_us div 100000").alias("frame")).agg(F.count("*").alias("x"))
    b = n.where("note_id % 10 <> 0").groupBy("song_id", later.alias("frame")).agg(F.count("*").alias("x"))
    return evidence.window_lags(a, b, 12, 300)


@query(LAGS + ' SELECT song_id, w AS "window", lag, round(r, 6) AS r, round(ratio, 6) AS ratio, round(refined, 6) AS refined FROM bw')
def w39_window_lags(spark, d):
    return lags(spark, d).select("song_id", "window", F.col("lag").cast("long").alias("lag"), *[F.round(c, 6).alias(c) for c in ("r", "ratio", "refined")])


@query(
    LAGS
    + """, ok AS (SELECT * FROM (SELECT *, bool_or(r >= 0.3) OVER (PARTITION BY song_id) AS any_good FROM bw) WHERE r >= 0.3 OR NOT any_good)
 SELECT song_id, round(median(refined), 6) AS lag, round(max(refined) - min(refined), 6) AS spread, round(CASE WHEN count(*) >= 3 AND max(w) > min(w) THEN regr_slope(refined, w) ELSE 0 END, 6) AS drift, count(*) AS used FROM ok GROUP BY 1"""
)
def w39_best_lag(spark, d):
    return evidence.best_lag(lags(spark, d)).select("song_id", *[F.round(c, 6).alias(c) for c in ("lag", "spread", "drift")], "used")


FEATURES = T.MORE + f""", wf AS MATERIALIZED (SELECT song_id, "window" AS w, label AS truth, {X.WINDOW_FEATURES_SQL} FROM (SELECT *, "window" * 37 + song_id * 11 AS h FROM wn))"""


def _score(label: str, value) -> str:
    """A label's score for DuckDB; value(key) is its threshold."""
    of = {
        "r0_sm_db": ("sm", -1), "r0_coh": ("coh", 1), "adt_xcorr": ("abs(xcoff)", 1), "adt_min_lag_ms": ("abs(lag)", 1), "adt_over_r0": ("abs(xcoff) - r0", 1), "r2_coh": ("coh", -1), "r2_hard": ("hard", -1), "r2_cen": ("cen", 1),
        "r3_ild_db": ("ildcoh", 1), "r3_hard": ("hard", 1), "r3_coh": ("coh", -1),
    }
    ps = [f"coalesce({of[k][1]} * (({of[k][0]}) - ({value(k)})) / {evidence.SCALES[k]}, -10)" for k in evidence.GROUPS[label]]
    return f"greatest({ps[0]}, least({ps[1]}, {ps[2]}))" if label == "R3" else f"least({', '.join(ps)})"


_FIXED = ", ".join(f"round({_score(k, lambda t: evidence.THRESHOLDS[t])}, 4) AS score_{k}" for k in evidence.LABELS)
_BEST = "CASE WHEN greatest(score_R0, score_R1, score_R2, score_R3) <= 0 THEN 'mixed' WHEN score_R0 >= greatest(score_R1, score_R2, score_R3) THEN 'R0' WHEN score_R1 >= greatest(score_R2, score_R3) THEN 'R1' WHEN score_R2 >= score_R3 THEN 'R2' ELSE 'R3' END"


@query(FEATURES + f" SELECT song_id, w, score_R0, score_R1, score_R2, score_R3, {_BEST} AS rule_label FROM (SELECT *, {_FIXED} FROM wf)")
def w13_rule_labels(spark, d):
    return evidence.rule_labels(X.window_features(spark, d)).select("song_id", "w", *[f"score_{k}" for k in evidence.LABELS], "rule_label")


TRIED = {"r3_ild_db": [3.0, 4.5, 6.0], "r3_hard": [0.1, 0.3, 0.5], "r3_coh": [0.6, 0.8]}
_OTHERS = ", ".join(f"round({_score(k, lambda t: evidence.THRESHOLDS[t])}, 4) AS score_{k}" for k in evidence.LABELS[:3])


@query(
    FEATURES
    + f""", gr AS (SELECT a, b, c FROM unnest({json.dumps(TRIED['r3_ild_db'])}) x(a), unnest({json.dumps(TRIED['r3_hard'])}) y(b), unnest({json.dumps(TRIED['r3_coh'])}) z(c)),
 sc2 AS (SELECT a, b, c, truth, {_OTHERS}, round({_score('R3', lambda t: {'r3_ild_db': 'a', 'r3_hard': 'b', 'r3_coh': 'c'}[t])}, 4) AS score_R3 FROM wf CROSS JOIN gr WHERE song_id % 2 = 0),
 ac AS (SELECT a, b, c, truth, avg(CASE WHEN {_BEST} = truth THEN 1.0 ELSE 0 END) AS acc FROM sc2 GROUP BY ALL) SELECT a AS r3_ild_db, b AS r3_hard, c AS r3_coh, round(avg(acc), 6) AS macro FROM ac GROUP BY ALL"""
)
def w16_threshold_grid(spark, d):
    """Accuracy of every combination of one label's thresholds on the songs that thresholds are fitted on."""
    dev = X.window_features(spark, d).where("song_id % 2 = 0")
    grid = evidence.threshold_grid(dev, "R3", TRIED, evidence.THRESHOLDS)
    return grid.select("combo.*", F.round("macro", 6).alias("macro"))


@query()
def w16_threshold_refit(spark, d):
    """Every threshold before and after the refit on half of the songs, and the accuracy of both on the other half."""
    w = written(X.window_features(spark, d), "features")
    fitted, _ = evidence.threshold_refit(w.where("song_id % 2 = 0"))
    acc = [F.avg((F.col(c) == F.col("truth")).cast("double")) for c in ("old", "new")]
    held = evidence.rule_labels(w.where("song_id % 2 = 1")).withColumn("old", F.col("rule_label")).drop("rule_label", *[f"score_{k}" for k in evidence.LABELS])
    held = evidence.rule_labels(held, fitted).withColumn("new", F.col("rule_label"))
    held = held.groupBy("truth").agg(acc[0].alias("old"), acc[1].alias("new")).agg(F.round(F.avg("old"), 6).alias("test_before"), F.round(F.avg("new"), 6).alias("test_after"))
    rows = F.array(*[F.struct(F.lit(k).alias("threshold"), F.lit(float(v)).alias("start"), F.lit(float(fitted[k])).alias("fitted")) for k, v in evidence.THRESHOLDS.items()])
    return held.select(F.explode(rows).alias("r"), "*").select("r.*", "test_before", "test_after")
