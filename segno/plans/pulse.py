"""Queries of beat repair, pitch trackers and repeated bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pulse, repeats, trackers
from ..sources import fixtures as X
from . import statements as T
from .queries import anchored, query


@query(""", b0 AS (SELECT song_id, t_us, beat = 1 AS down, (beat_no * 7919) % 100 AS act FROM bt UNION ALL SELECT song_id, t_us + 90000, FALSE, (beat_no * 31) % 100 FROM bt WHERE beat_no % 37 = 5),
 b1 AS (SELECT *, lag(t_us) OVER w AS p, lead(t_us) OVER w AS n, lead(t_us, 2) OVER w AS n2, lead(act) OVER w AS nact, lead(down) OVER w AS ndown FROM b0 WINDOW w AS (PARTITION BY song_id ORDER BY t_us)),
 b2 AS (SELECT *, coalesce(n - t_us < 0.42 * least(coalesce(t_us - p, 1000000000000), coalesce(n2 - n, 1000000000000)), FALSE) AS dbl, CASE WHEN p IS NULL OR n2 IS NULL THEN 0 ELSE round(abs(ln((t_us - p) / (n2 - t_us))), 9) END AS u0, CASE WHEN p IS NULL OR n2 IS NULL THEN 0 ELSE round(abs(ln((n - p) / (n2 - n))), 9) END AS u1 FROM b1),
 b3 AS (SELECT *, CASE WHEN act <> nact THEN act > nact WHEN u0 <> u1 THEN u0 < u1 ELSE TRUE END AS win FROM b2),
 pr AS (SELECT song_id, CASE WHEN win THEN t_us ELSE n END AS kept, CASE WHEN win THEN n ELSE t_us END AS gone, down OR ndown AS d FROM b3 WHERE dbl)
 SELECT b0.song_id, b0.t_us, coalesce(k.d, b0.down) AS down FROM b0 LEFT JOIN pr k ON b0.song_id = k.song_id AND b0.t_us = k.kept ANTI JOIN pr g ON b0.song_id = g.song_id AND b0.t_us = g.gone""")
def d11_merge_double_beats(spark, d):
    return pulse.merge_double_beats(X.doubled_beats(spark, d))


@query(""", b0 AS (SELECT song_id, t_us FROM bt WHERE beat_no % 41 NOT IN (7, 8)), b1 AS (SELECT *, lead(t_us) OVER (PARTITION BY song_id ORDER BY t_us) - t_us AS iv FROM b0),
 b2 AS (SELECT *, quantile_cont(iv, 0.5) OVER (PARTITION BY song_id ORDER BY t_us ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS local FROM b1 WHERE iv IS NOT NULL), b3 AS (SELECT *, CAST(round(iv / local) AS BIGINT) AS k FROM b2)
 SELECT song_id, round(t_us + iv * j / k, 3) AS t_us, TRUE AS filled FROM b3, range(1, 9) AS r(j) WHERE j < k AND iv <= 4000000 AND abs(iv / k - local) <= 0.08 * local UNION ALL SELECT song_id, CAST(t_us AS DOUBLE), FALSE FROM b0""")
def d12_fill_missing_beats(spark, d):
    return pulse.fill_missing_beats(X.gappy_beats(spark, d)).withColumn("t_us", F.round("t_us", 3))


@query(""", b0 AS (SELECT song_id, t_us FROM bt UNION ALL SELECT song_id, t_us + 250000 FROM bt WHERE bar % 50 BETWEEN 10 AND 14), b1 AS (SELECT *, lead(t_us) OVER (PARTITION BY song_id ORDER BY t_us) - t_us AS iv FROM b0),
 b2 AS (SELECT *, sum(iv) OVER (PARTITION BY song_id ORDER BY iv, t_us ROWS UNBOUNDED PRECEDING) AS cw, sum(iv) OVER (PARTITION BY song_id) AS total FROM b1 WHERE iv IS NOT NULL), md AS (SELECT song_id, min(iv) AS p FROM b2 WHERE cw >= 0.5 * total GROUP BY song_id),
 b3 AS (SELECT b2.song_id, t_us, CASE WHEN abs(log2(iv / p) + 1) < 0.25 THEN 'fast' WHEN abs(log2(iv / p) - 1) < 0.25 THEN 'slow' ELSE 'even' END AS kind FROM b2 JOIN md USING (song_id)),
 b4 AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY t_us) - row_number() OVER (PARTITION BY song_id, kind ORDER BY t_us) AS g FROM b3)
 SELECT song_id, kind, min(t_us) AS start_us, max(t_us) AS end_us, count(*) AS n FROM b4 WHERE kind <> 'even' GROUP BY song_id, kind, g HAVING count(*) >= 2""")
def d13_tempo_level_runs(spark, d):
    return pulse.tempo_level_runs(X.levelled_beats(spark, d))


FRAMES = """, sp0 AS (SELECT song_id, line, note_id, pitch, unnest(generate_series(onset_us // 10000, offset_us // 10000)) AS frame FROM nr), hd AS (SELECT song_id, line, frame, max(note_id) AS n, max_by(pitch, note_id) AS p FROM sp0 GROUP BY ALL),
 tf AS (SELECT song_id, line, k AS tracker, frame, p + CASE WHEN k = 1 THEN (n % 7 - 3) * 0.1 + CASE WHEN n % 11 = 0 THEN 12 ELSE 0 END WHEN k = 2 THEN (n % 5 - 2) * 0.15 + CASE WHEN n % 11 = 0 THEN 12 WHEN n % 13 = 0 THEN 1 ELSE 0 END
  WHEN n % 3 <> 0 THEN CASE WHEN n % 13 = 0 THEN 1.2 ELSE 0.2 END END + (frame * 7 % 5 - 2) * 0.02 AS midi, (frame * 13 + k * 5) % 10 AS conf FROM hd, range(1, 4) AS r(k))"""
VOTE = FRAMES + """, ev AS (SELECT note_id, song_id, line, pitch, CASE WHEN s THEN onset_us + 10000 ELSE onset_us + 30000 END AS a, CASE WHEN s THEN greatest(onset_us + 30000, offset_us) ELSE e END AS z FROM (SELECT *, least(onset_us + 120000, offset_us - 10000) AS e, least(onset_us + 120000, offset_us - 10000) - onset_us < 60000 AS s FROM nr)),
 es AS (SELECT ev.song_id, ev.note_id, pitch, tracker, median(CAST(midi AS DOUBLE)) AS x FROM ev JOIN tf ON ev.song_id = tf.song_id AND ev.line = tf.line AND frame * 10000 >= a AND frame * 10000 < z WHERE midi IS NOT NULL AND conf >= 5 GROUP BY ALL HAVING count(*) >= 3),
 an AS (SELECT note_id, count(*) AS answers FROM es GROUP BY 1), tg AS (SELECT DISTINCT note_id, pitch, CAST(round_even(x, 0) AS INTEGER) AS target FROM es),
 su AS (SELECT t.note_id, t.pitch, target, count(*) AS support FROM tg t JOIN es ON t.note_id = es.note_id WHERE abs(x - target) <= 0.5 GROUP BY ALL HAVING count(*) >= 2),
 wi2 AS (SELECT note_id, target FROM su QUALIFY row_number() OVER (PARTITION BY note_id ORDER BY support DESC, abs(target - pitch), target DESC) = 1),
 vo AS (SELECT n.*, target, CASE WHEN coalesce(answers, 0) < 2 THEN 'no_f0' WHEN target IS NULL THEN 'split' WHEN target = pitch THEN 'confirmed' WHEN abs(target - pitch) IN (12, 24, 36) THEN 'octave' WHEN abs(target - pitch) = 1 THEN 'semitone' ELSE 'disagree' END AS action FROM nr n LEFT JOIN an USING (note_id) LEFT JOIN wi2 USING (note_id))"""


def votes(spark, d):
    notes = X.notes_ref(spark, d)
    return trackers.f0_vote(notes, trackers.f0_estimates(X.tracker_frames(spark, d), notes))


@query(VOTE + " SELECT song_id, note_id, tracker, round(x, 6) AS x FROM es")
def w17_f0_estimates(spark, d):
    return trackers.f0_estimates(X.tracker_frames(spark, d), X.notes_ref(spark, d)).withColumn("x", F.round("x", 6))


@query(VOTE + " SELECT song_id, note_id, action, CASE WHEN action IN ('octave', 'semitone') THEN target ELSE pitch END AS pitch FROM vo")
def w17_f0_vote(spark, d):
    return votes(spark, d).select("song_id", "note_id", "action", F.col("voted_pitch").alias("pitch"))


@query(VOTE + anchored("song_id").replace("an AS", "ag AS").replace("FROM an a", "FROM ag a").replace("JOIN an a", "JOIN ag a").replace("35000", "40000") + """, gr AS (SELECT cl.*, v.target, coalesce(v.target = cl.pitch, FALSE) AS sure FROM cl JOIN vo v USING (note_id)),
 gb AS (SELECT song_id, anchor_us, count(*) AS n, min(pitch) FILTER (sure) AS base, arg_min(note_id, {'p': pitch, 'l': onset_us - offset_us, 'o': onset_us, 'i': note_id}) FILTER (sure) AS stands FROM gr GROUP BY ALL HAVING count(*) > 1 AND count_if(sure) > 0),
 go AS (SELECT g.note_id, b.stands, CASE WHEN g.pitch = b.base THEN g.offset_us END AS off FROM gr g JOIN gb b USING (song_id, anchor_us) WHERE note_id <> stands AND NOT (sure AND pitch <> base) AND pitch - base IN (0, 12, 19, 24)), lg AS (SELECT stands AS note_id, max(off) AS off FROM go GROUP BY 1)
 SELECT g.song_id, g.note_id, g.pitch, greatest(g.offset_us, coalesce(l.off, g.offset_us)) AS offset_us FROM gr g LEFT JOIN lg l ON g.note_id = l.note_id WHERE g.note_id NOT IN (SELECT note_id FROM go)""")
def d15_harmonic_dupes(spark, d):
    """Notes that the vote of the trackers confirms are the evidence."""
    return trackers.harmonic_dupes(votes(spark, d))


@query(FRAMES + """, rf AS (SELECT song_id, line, frame, min(pitch) AS ref FROM (SELECT song_id, line, pitch, unnest(generate_series(CAST(ceil((onset_us + 30000) / 10000) AS BIGINT), CAST(floor((offset_us - 30000) / 10000) AS BIGINT))) AS frame FROM nr) GROUP BY ALL HAVING count(*) = 1),
 rb AS (SELECT *, 'all' AS band FROM rf UNION ALL SELECT *, CASE WHEN ref < 43.35 THEN '30-100' ELSE '100-400' END FROM rf), sz AS (SELECT band, count(*) AS frames FROM rb GROUP BY 1),
 j AS (SELECT tracker, band, conf >= 5 AND midi IS NOT NULL AS v, abs(midi - ref) <= 0.5 AS close, abs(midi - ref - 12 * round((midi - ref) / 12)) <= 0.5 AS fold FROM rb JOIN tf USING (song_id, line, frame))
 SELECT tracker, band, any_value(frames) AS frames, round(count_if(close AND v) / any_value(frames), 6) AS rpa, round(count_if(fold AND v) / any_value(frames), 6) AS rca, round(count_if(v) / any_value(frames), 6) AS vr, round(count_if(close) / any_value(frames), 6) AS rpa_any, round(count_if(v AND NOT close AND fold) / any_value(frames), 6) AS octave
 FROM j JOIN sz USING (band) GROUP BY tracker, band""")
def g45_tracker_accuracy(spark, d):
    return trackers.tracker_accuracy(X.notes_ref(spark, d), X.tracker_frames(spark, d, by_line=True))


MATCHES = T.MORE + """, bv AS (SELECT song_id, bar, pitch % 12 AS pc, count(*)::DOUBLE AS x FROM nb GROUP BY ALL), bk AS (SELECT DISTINCT song_id, bar FROM bv), pk AS (SELECT DISTINCT song_id, pc FROM bv),
 bg AS (SELECT bk.song_id, bk.bar, pk.pc, coalesce(x, 0) AS x FROM bk JOIN pk USING (song_id) LEFT JOIN bv ON bv.song_id = bk.song_id AND bv.bar = bk.bar AND bv.pc = pk.pc), bm AS (SELECT song_id, pc, avg(x) AS m, stddev_pop(x) AS s FROM bg GROUP BY ALL),
 bz AS (SELECT bg.song_id, bg.bar, list(CASE WHEN s > 0 THEN (x - m) / s ELSE 0 END ORDER BY bg.pc) AS z FROM bg JOIN bm ON bg.song_id = bm.song_id AND bg.pc = bm.pc GROUP BY ALL), bs AS (SELECT a.song_id, a.bar AS a, b.bar AS b, list_cosine_similarity(a.z, b.z) AS c FROM bz a JOIN bz b ON a.song_id = b.song_id AND a.bar < b.bar WHERE list_sum(list_transform(a.z, lambda v: v * v)) > 0 AND list_sum(list_transform(b.z, lambda v: v * v)) > 0),
 bd AS (SELECT song_id, a, b, round(avg(c) OVER (PARTITION BY song_id, b - a ORDER BY a RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS score FROM bs), bu AS (SELECT song_id, a AS bar, b AS other, score FROM bd WHERE score >= 0.6 UNION ALL SELECT song_id, b, a, score FROM bd WHERE score >= 0.6),
 mt AS (SELECT *, row_number() OVER (PARTITION BY song_id, bar ORDER BY score DESC, other) AS place FROM bu QUALIFY place <= 8)"""


def matches(spark, d):
    """The repeat map of a song's bars by their pitch classes."""
    pc = F.pmod("pitch", F.lit(12)).alias("feature")
    return repeats.similar_bars(T.placed(spark, d).groupBy("song_id", "bar", pc).agg(F.count("*").cast("double").alias("x")))


@query(MATCHES + " SELECT * FROM mt")
def w36_bar_similarity_topk(spark, d):
    return matches(spark, d)


LINKS = MATCHES + """, tg2 AS (SELECT n.song_id, n.note_id, n.pitch, m.other, n.onset_us - a.start_us + z.start_us AS t FROM nb n JOIN mt m ON n.song_id = m.song_id AND n.bar = m.bar AND m.place = 1 JOIN br a ON n.song_id = a.song_id AND n.bar = a.bar JOIN br z ON n.song_id = z.song_id AND m.other = z.bar),
 ln AS (SELECT t.note_id AS a, n.note_id AS b FROM tg2 t JOIN nb n ON t.song_id = n.song_id AND t.pitch = n.pitch AND n.bar BETWEEN t.other - 1 AND t.other + 1 AND n.note_id <> t.note_id AND abs(n.onset_us - t.t) <= 60000 QUALIFY row_number() OVER (PARTITION BY t.note_id ORDER BY abs(n.onset_us - t.t), n.note_id) = 1),
 lk AS (SELECT DISTINCT * FROM (SELECT a, b FROM ln UNION ALL SELECT b, a FROM ln))"""


def links(spark, d):
    return repeats.repeat_note_links(T.placed(spark, d), X.bars(spark, d), matches(spark, d))


@query(LINKS + " SELECT a, b FROM lk")
def j12_repeat_note_links(spark, d):
    return links(spark, d)


@query(MATCHES + """, vt AS (SELECT song_id, (bar - 1) // 4 AS i, (other - 1) // 4 AS j FROM mt WHERE place = 1 AND bar <= 359 AND other <= 359), al AS (SELECT song_id, i, count(*) AS n FROM vt GROUP BY ALL)
 SELECT DISTINCT v.song_id, least(v.i, j) AS a, greatest(v.i, j) AS b FROM (SELECT song_id, i, j, count(*) AS votes FROM vt WHERE i <> j GROUP BY ALL) v JOIN al ON v.song_id = al.song_id AND v.i = al.i WHERE votes * 2 > n""")
def j13_repeat_window_pairs(spark, d):
    windows = X.bars(spark, d).select("song_id", "bar", F.expr("(bar - 1) div 4").alias("w"))
    return repeats.repeat_window_pairs(windows, matches(spark, d))
