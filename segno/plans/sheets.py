"""Queries of written bars scored by page times: the bars hold the reference notes, a video plays the song a little slower."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..operators import sheets, timeline
from ..sources import fixtures as X
from .queries import SPANS, query

LEADS = [250_000 * k for k in range(-6, 7)]

PAGED = (
    SPANS
    + """, fs AS (SELECT song_id, min(t_us) AS f FROM sp GROUP BY 1), pg AS (SELECT song_id, bar, start_us * 1.002 + 150000 + (bar * 37 % 5 - 2) * 40000 AS t0, lead(start_us * 1.002 + 150000 + (bar * 37 % 5 - 2) * 40000) OVER (PARTITION BY song_id ORDER BY bar) AS t1 FROM br),
 pp AS (SELECT song_id, x, y, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM (SELECT song_id, start_us * 1.002 + 150000 AS x, CAST(start_us AS DOUBLE) AS y FROM br WHERE bar % 8 = 1) WINDOW w AS (PARTITION BY song_id ORDER BY x)), hd AS (SELECT song_id, arg_min(y, x) AS h FROM pp GROUP BY 1),
 pi AS (SELECT n.song_id, b.bar, n.pitch, count(*) AS n FROM nr n JOIN br b ON n.song_id = b.song_id AND n.onset_us >= b.start_us AND n.onset_us < b.end_us GROUP BY ALL),
 he AS MATERIALIZED (SELECT n.song_id, n.pitch, s.beat_no + (n.onset_us + 30000 - s.t_us) / (s.n_us - s.t_us) AS pos FROM (SELECT ne.*, greatest(onset_us + 30000, f) AS g FROM ne JOIN fs USING (song_id)) n ASOF JOIN sp s ON n.song_id = s.song_id AND n.g >= s.t_us),
 pe AS (SELECT song_id, bar, e, CASE e WHEN 0 THEN t0 ELSE t1 END + (CAST(k AS BIGINT) - 6) * 250000 AS t, (CAST(k AS BIGINT) - 6) * 250000 AS ld FROM pg, range(13) AS z(k), range(2) AS y(e) WHERE t1 > t0),
 py AS (SELECT p.*, CASE WHEN x IS NULL THEN h WHEN x1 IS NULL THEN y ELSE y + (t - x) * (y1 - y) / (x1 - x) END AS v FROM pe p JOIN hd USING (song_id) ASOF LEFT JOIN pp ON p.song_id = pp.song_id AND p.t >= pp.x),
 pb AS (SELECT p.song_id, p.bar, p.e, p.ld, s.beat_no + (p.v - s.t_us) / (s.n_us - s.t_us) AS g FROM (SELECT py.*, greatest(v, f) AS gv FROM py JOIN fs USING (song_id)) p ASOF JOIN sp s ON p.song_id = s.song_id AND p.gv >= s.t_us),
 pl AS MATERIALIZED (SELECT * FROM (SELECT song_id, ld, bar, round(max(g) FILTER (e = 0), 9) AS at0, round(max(g) FILTER (e = 1) - max(g) FILTER (e = 0), 9) AS len FROM pb GROUP BY ALL) WHERE len > 0),
 ge AS (SELECT p.song_id, p.ld, p.bar, h.pitch, count(*) AS c FROM pl p JOIN he h ON h.song_id = p.song_id AND h.pos >= p.at0 AND h.pos < p.at0 + p.len WHERE p.at0 >= 0 GROUP BY ALL),
 gb AS (SELECT song_id, ld, sum(least(coalesce(n, 0), coalesce(c, 0))) AS tp, sum(coalesce(n, 0)) AS r, sum(coalesce(c, 0)) AS e FROM (SELECT p.song_id, p.ld, p.bar, pi.pitch, pi.n FROM pl p JOIN pi ON pi.song_id = p.song_id AND pi.bar = p.bar WHERE p.at0 >= 0) w FULL JOIN ge USING (song_id, ld, bar, pitch) GROUP BY ALL),
 bd AS (SELECT song_id, arg_max(ld, {'f': round(2 * tp / (r + e), 9), 'a': -abs(ld), 'm': -ld}) AS ld FROM gb GROUP BY 1),
 rw0 AS MATERIALIZED (SELECT p.*, (row_number() OVER (PARTITION BY p.song_id ORDER BY bar) - 1) // 8 AS blk, round(median(len) OVER (PARTITION BY p.song_id), 9) AS measured FROM pl p JOIN bd ON p.song_id = bd.song_id AND p.ld = bd.ld),
 le AS (SELECT song_id, x AS length, abs(x - measured) AS away FROM (SELECT DISTINCT song_id, measured FROM rw0), unnest([1.0, 1.5, 2.0, 3.0, 4.0, 6.0, 8.0]) u(x) QUALIFY row_number() OVER (PARTITION BY song_id ORDER BY abs(x - measured), x) <= 2),
 ev AS (SELECT r.*, length, away, (bar - min(bar) OVER (PARTITION BY r.song_id, length, blk)) * length AS even FROM rw0 r JOIN le USING (song_id)), es AS (SELECT *, round(median(at0 - even) OVER (PARTITION BY song_id, length, blk), 9) AS base FROM ev),
 wy(way, kind, shift, pen) AS (SELECT CAST(k AS INTEGER), 'even', 0.5 * (k - 8), abs(0.5 * (k - 8)) FROM range(17) z(k) UNION ALL SELECT CAST(17 + k AS INTEGER), 'own', 0.5 * (k - 2), abs(0.5 * (k - 2)) + 0.25 FROM range(5) z(k)),
 ld2 AS MATERIALIZED (SELECT song_id, length, away, blk, way, kind, shift, pen, bar, CASE kind WHEN 'even' THEN base + even ELSE at0 END + shift AS a, CASE kind WHEN 'even' THEN length ELSE len END AS l FROM es CROSS JOIN wy),
 g2 AS (SELECT p.song_id, p.length, p.blk, p.way, p.bar, h.pitch, count(*) AS c FROM ld2 p JOIN he h ON h.song_id = p.song_id AND h.pos >= p.a AND h.pos < p.a + p.l WHERE p.a >= 0 GROUP BY ALL),
 b2 AS (SELECT song_id, length, blk, way, sum(least(coalesce(n, 0), coalesce(c, 0))) AS tp, sum(coalesce(n, 0)) AS r, sum(coalesce(c, 0)) AS e FROM (SELECT p.song_id, p.length, p.blk, p.way, p.bar, pi.pitch, pi.n FROM ld2 p JOIN pi ON pi.song_id = p.song_id AND pi.bar = p.bar WHERE p.a >= 0) w FULL JOIN g2 USING (song_id, length, blk, way, bar, pitch) GROUP BY ALL),
 c2 AS MATERIALIZED (SELECT f.*, coalesce(tp, 0) AS tp, coalesce(r, 0) AS r, coalesce(e, 0) AS e, round(coalesce(2 * tp / nullif(r + e, 0), 0), 9) AS f1 FROM (SELECT DISTINCT song_id, length, away, blk, way, kind, shift, pen FROM ld2) f LEFT JOIN b2 USING (song_id, length, blk, way)),
 k2 AS MATERIALIZED (SELECT * FROM c2 QUALIFY row_number() OVER (PARTITION BY song_id, length, blk ORDER BY f1 DESC, pen, way) = 1),
 fl AS (SELECT song_id, length, away, round(coalesce(2 * sum(tp) / nullif(sum(r) + sum(e), 0), 0), 9) AS f1 FROM k2 GROUP BY ALL), bl AS (SELECT * FROM fl QUALIFY row_number() OVER (PARTITION BY song_id ORDER BY f1 DESC, away, length) = 1),
 sg1 AS (SELECT song_id, length, round(coalesce(2 * sum(tp) / nullif(sum(r) + sum(e), 0), 0), 9) AS f1 FROM c2 WHERE kind = 'even' AND shift = 0 GROUP BY ALL)"""
)


def scored(spark, d):
    bars = X.bars(spark, d)
    start = F.col("start_us") * 1.002 + 150_000
    t0 = start + (F.col("bar") * 37 % 5 - 2) * 40_000
    pages = bars.select("song_id", "bar", t0.alias("t0")).withColumn("t1", F.lead("t0").over(Window.partitionBy("song_id").orderBy("bar")))
    path = bars.where("bar % 8 = 1").select("song_id", start.alias("x"), F.col("start_us").cast("double").alias("y"))
    inside = timeline.asof_join(X.notes_ref(spark, d), bars, ["song_id"], "onset_us", "start_us").select("song_id", "pitch", "onset_us", "mark.bar", "mark.end_us").where("onset_us < end_us")
    pitches = inside.groupBy("song_id", "bar", "pitch").agg(F.count("*").alias("n"))
    return sheets.score_by_time(pages, path, X.beats(spark, d), pitches, X.notes_est(spark, d), LEADS)


@query(PAGED + " SELECT bl.song_id, CAST(bd.ld AS INTEGER) AS lead_us, CAST(bl.length AS DOUBLE) AS beats_per_bar, round(m.measured, 6) AS measured, round(sg1.f1, 6) AS single, round(bl.f1, 6) AS drifting FROM bl JOIN bd USING (song_id) JOIN sg1 ON sg1.song_id = bl.song_id AND sg1.length = bl.length JOIN (SELECT DISTINCT song_id, measured FROM rw0) m ON m.song_id = bl.song_id")
def g48_score_by_time(spark, d):
    return scored(spark, d)[0].select("song_id", "lead_us", "beats_per_bar", *[F.round(c, 6).alias(c) for c in ("measured", "single", "drifting")])


@query(PAGED + " SELECT k2.song_id, blk AS block, kind AS way, CAST(shift AS DOUBLE) AS shift, CAST(tp AS BIGINT) AS tp, CAST(r AS BIGINT) AS n_ref, CAST(e AS BIGINT) AS n_est FROM k2 JOIN bl ON bl.song_id = k2.song_id AND bl.length = k2.length")
def g48_block_shifts(spark, d):
    """Where every block of bars fits best."""
    return scored(spark, d)[1]
