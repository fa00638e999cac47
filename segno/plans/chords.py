"""Queries of chords: guitar notes are those of lines above 0, bass notes those of line 0."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import harmony
from ..sources import fixtures as X
from .queries import query

SHARES = """, bs AS MATERIALIZED (SELECT * FROM (SELECT song_id, beat_no, t_us, lead(t_us) OVER (PARTITION BY song_id ORDER BY beat_no) AS n_us FROM bt) WHERE n_us > t_us),
 so AS MATERIALIZED (SELECT n.song_id, b.beat_no, n.line = 0 AS low, n.pitch % 12 AS pc, sum(least(n.offset_us, b.n_us) - greatest(n.onset_us, b.t_us)) / any_value(b.n_us - b.t_us) AS share
  FROM nr n JOIN bs b ON n.song_id = b.song_id AND n.onset_us < b.n_us AND n.offset_us > b.t_us GROUP BY ALL)"""
_QUALITIES = ", ".join(f"({i}, '{q}', {list(t)})" for i, (q, t) in enumerate(harmony.QUALITIES.items()))
COSTS = (
    SHARES
    + f""", ql(o, quality, tones) AS (VALUES {_QUALITIES}), st AS (SELECT o * 12 + r AS s, r AS root, quality, list_transform(tones, lambda t: (r + t) % 12) AS tones FROM ql, range(12) AS z(r)),
 tn AS (SELECT s, root, len(tones) AS size, unnest(tones) AS pc FROM st), fl AS (SELECT song_id, beat_no, sum(share) AS fill, sqrt(sum(share * share)) AS norm FROM so WHERE NOT low GROUP BY ALL),
 ba AS MATERIALIZED (SELECT song_id, beat_no, min_by(pc, {{'m': -share, 'p': pc}}) AS bass FROM so WHERE low GROUP BY ALL),
 dt AS (SELECT h.song_id, h.beat_no, t.s, sum(h.share) AS dot FROM so h JOIN tn t ON h.pc = t.pc WHERE NOT h.low GROUP BY ALL),
 cc AS (SELECT b.song_id, b.beat_no, st.s, st.root, CASE WHEN coalesce(f.fill, 0) < 0.1 THEN 0.25 ELSE round(1 - coalesce(d.dot, 0) / (sqrt(len(st.tones)) * (f.norm + 1e-12)) + 0.02 * abs(len(st.tones) - 3) - CASE WHEN ba.bass = st.root THEN 0.1 ELSE 0 END, 9) END AS cost
  FROM bs b CROSS JOIN st LEFT JOIN fl f ON b.song_id = f.song_id AND b.beat_no = f.beat_no LEFT JOIN dt d ON b.song_id = d.song_id AND b.beat_no = d.beat_no AND st.s = d.s LEFT JOIN ba ON b.song_id = ba.song_id AND b.beat_no = ba.beat_no
  UNION ALL SELECT b.song_id, b.beat_no, 120, NULL, CASE WHEN coalesce(f.fill, 0) < 0.1 THEN 0 ELSE 1 END FROM bs b LEFT JOIN fl f ON b.song_id = f.song_id AND b.beat_no = f.beat_no),
 ca AS MATERIALIZED (SELECT song_id, beat_no, list(CAST(cost AS DOUBLE) ORDER BY s) AS c FROM cc GROUP BY ALL)"""
)
PATH = (
    COSTS
    + """, vp AS MATERIALIZED (SELECT v.* FROM (WITH RECURSIVE v AS (SELECT song_id, beat_no, c AS t, CAST([] AS BIGINT[]) AS b FROM ca WHERE beat_no = 0
  UNION ALL SELECT v.song_id, ca.beat_no, list_transform(list_zip(v.t, ca.c), lambda z: least(z[1], list_min(v.t) + 0.15) + z[2]),
   list_transform(range(121), lambda i: CASE WHEN list_min(v.t) + 0.15 < v.t[i + 1] THEN list_position(v.t, list_min(v.t)) - 1 ELSE i END) FROM v JOIN ca ON v.song_id = ca.song_id AND ca.beat_no = v.beat_no + 1) SELECT * FROM v) v),
 pa AS MATERIALIZED (SELECT p.* FROM (WITH RECURSIVE p AS (SELECT song_id, beat_no, CAST(list_position(t, list_min(t)) - 1 AS BIGINT) AS s, b FROM vp WHERE beat_no = 1438
  UNION ALL SELECT v.song_id, v.beat_no, p.b[p.s + 1], v.b FROM p JOIN vp v ON v.song_id = p.song_id AND v.beat_no = p.beat_no - 1) SELECT song_id, beat_no, s FROM p) p)"""
)


def parts(spark, d):
    notes = X.notes_ref(spark, d)
    return notes.where("line > 0"), notes.where("line = 0"), X.beats(spark, d)


def segments(spark, d):
    return harmony.chord_segments(harmony.chord_costs(*parts(spark, d)))


@query(SHARES + " SELECT song_id, beat_no, CAST(pc AS INTEGER) AS pc, round(share, 6) AS share FROM so WHERE NOT low")
def w32_chord_histograms(spark, d):
    guitar, _, beats = parts(spark, d)
    return harmony.sounding_shares(guitar, beats).withColumn("share", F.round("share", 6))


@query(
    COSTS
    + """, rk AS (SELECT cc.*, row_number() OVER (PARTITION BY song_id, beat_no ORDER BY cost, s) AS place FROM cc) SELECT song_id, beat_no, CAST(rk.root AS INTEGER) AS root, quality, round(cost, 6) AS cost
 FROM rk LEFT JOIN st USING (s) WHERE place = 1"""
)
def w32_chord_costs(spark, d):
    """The cheapest chord of every beat by itself."""
    rows = harmony.chord_costs(*parts(spark, d)).withColumn("low", F.array_min("costs"))
    return rows.select("song_id", "beat_no", *harmony.named(F.array_position("costs", F.col("low")).cast("int") - 1), F.round("low", 6).alias("cost"))


@query(
    PATH
    + """, gr AS (SELECT *, beat_no - row_number() OVER (PARTITION BY song_id, s ORDER BY beat_no) AS g FROM pa)
 SELECT song_id, min(beat_no) AS start_beat, max(beat_no) AS end_beat, CAST(any_value(st.root) AS INTEGER) AS root, any_value(st.quality) AS quality FROM gr LEFT JOIN st USING (s) GROUP BY song_id, s, g"""
)
def w33_chord_path(spark, d):
    return segments(spark, d).select("song_id", "start_beat", "end_beat", *harmony.named(F.col("state")))


@query(
    PATH
    + """ SELECT song_id, beat_no, CAST(st.root AS INTEGER) AS root, st.quality, CAST(bass AS INTEGER) AS bass FROM pa JOIN st USING (s) JOIN ba USING (song_id, beat_no) WHERE NOT list_contains(st.tones, bass)"""
)
def w33_bass_checks(spark, d):
    _, bass, beats = parts(spark, d)
    return harmony.bass_checks(segments(spark, d), harmony.bass_classes(bass, beats))
