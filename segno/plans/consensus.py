"""Queries of repeat consensus: sections of one label are the occurrences of a repeat, played from the notes of the first one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import consensus
from ..sources import fixtures as X
from .queries import SPANS, query

#: Occurrences and the notes played in them, with some of the first one's notes left out and all moved a little.
PLAYED = """, oc AS (SELECT song_id, label AS grp, section AS occ, start_bar, end_bar - start_bar AS n_bars, section % 4 * 5000 AS off FROM sc),
 hb AS (SELECT n.*, b.bar, b.start_us FROM nr n JOIN br b ON n.song_id = b.song_id AND n.onset_us >= b.start_us AND n.onset_us < b.end_us AND b.bar <= 48),
 rn AS MATERIALIZED (SELECT h.song_id, h.note_id * 100 + o.occ AS note_id, h.onset_us - h.start_us + b.start_us + o.off + h.note_id * o.occ % 5 * 4000 AS onset_us, h.offset_us - h.start_us + b.start_us + o.off + h.note_id * o.occ % 5 * 4000 AS offset_us, h.pitch, h.instrument
  FROM hb h JOIN oc o ON h.song_id = o.song_id AND (h.bar - 1) // 16 = o.occ % 3 JOIN br b ON b.song_id = h.song_id AND b.bar = o.start_bar + (h.bar - 1) % 16 WHERE (h.note_id + o.occ * 7) % 11 <> 0)"""
VOTES = (
    SPANS
    + PLAYED
    + """, gp AS (SELECT song_id, grp, count(*) AS m, min(n_bars) AS common FROM oc GROUP BY ALL HAVING count(*) >= 3),
 ab AS (SELECT * FROM (SELECT o.song_id, o.grp, k, o.occ, b.start_us + o.off AS s, b.end_us + o.off AS e, o.off, (o.start_bar + k - 1) * 4 AS fb, g.m, count(*) OVER w AS have, min(b.n_beats) OVER w AS lo, max(b.n_beats) OVER w AS hi
  FROM oc o JOIN gp g ON o.song_id = g.song_id AND o.grp = g.grp JOIN range(16) AS z(k) ON k < g.common JOIN br b ON b.song_id = o.song_id AND b.bar = o.start_bar + k WINDOW w AS (PARTITION BY o.song_id, o.grp, k)) WHERE have = m AND lo = hi),
 ce AS MATERIALIZED (SELECT row_number() OVER () AS id, a.song_id, a.grp, a.k, a.occ, a.off, a.fb, n.note_id, n.pitch, n.instrument, n.onset_us - a.off AS x, greatest(n.onset_us, n.offset_us) - a.off AS y FROM ab a JOIN rn n ON a.song_id = n.song_id AND n.onset_us >= a.s AND n.onset_us < a.e),
 px AS (SELECT c.id, s.beat_no + (c.x - s.t_us) / (s.n_us - s.t_us) AS p FROM ce c ASOF JOIN sp s ON c.song_id = s.song_id AND c.x >= s.t_us), py AS (SELECT c.id, s.beat_no + (c.y - s.t_us) / (s.n_us - s.t_us) AS q FROM ce c ASOF JOIN sp s ON c.song_id = s.song_id AND c.y >= s.t_us),
 hn AS MATERIALIZED (SELECT c.*, CAST(round((p - fb) * 1000000) AS BIGINT) AS pos, CAST(round((q - p) * 1000000) AS BIGINT) AS dur FROM ce c JOIN px USING (id) JOIN py USING (id)),
 me AS (SELECT a.id, a.song_id, a.grp, a.k, a.occ, a.note_id, b.occ AS voter FROM hn a JOIN hn b ON a.song_id = b.song_id AND a.grp = b.grp AND a.k = b.k AND a.pitch = b.pitch AND a.occ <> b.occ AND abs(a.pos - b.pos) <= 125000),
 sz AS (SELECT song_id, grp, k, occ, count(*) AS n FROM hn GROUP BY ALL HAVING count(*) >= 3),
 vt AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY song_id, grp, k, occ) AS v FROM (SELECT song_id, grp, k, occ, voter FROM me JOIN sz USING (song_id, grp, k, occ) GROUP BY ALL HAVING count(DISTINCT me.id) >= 0.7 * any_value(n)) QUALIFY count(*) OVER (PARTITION BY song_id, grp, k, occ) >= 2),
 ms AS MATERIALIZED (SELECT vt.song_id, vt.grp, vt.k, vt.occ, vt.voter, vt.v, b.pitch, b.pos, b.dur, b.instrument, b.note_id FROM vt JOIN hn b ON b.song_id = vt.song_id AND b.grp = vt.grp AND b.k = vt.k AND b.occ = vt.voter
  WHERE NOT EXISTS (SELECT 1 FROM hn a WHERE a.song_id = vt.song_id AND a.grp = vt.grp AND a.k = vt.k AND a.occ = vt.occ AND a.pitch = b.pitch AND abs(a.pos - b.pos) <= 125000)),
 ka AS (SELECT song_id, grp, k, occ, pitch, min(pos) AS a FROM ms GROUP BY ALL UNION ALL SELECT m.song_id, m.grp, m.k, m.occ, m.pitch, min(m.pos) FROM ka JOIN ms m ON ka.song_id = m.song_id AND ka.grp = m.grp AND ka.k = m.k AND ka.occ = m.occ AND ka.pitch = m.pitch AND m.pos > ka.a + 125000 GROUP BY m.song_id, m.grp, m.k, m.occ, m.pitch, ka.a),
 fv AS (SELECT m.song_id, m.grp, m.k, m.occ, m.pitch, ka.a, m.voter, m.v, min({'p': m.pos, 'i': m.note_id, 'd': m.dur, 'n': m.instrument}) AS x FROM ms m ASOF JOIN ka ON ka.song_id = m.song_id AND ka.grp = m.grp AND ka.k = m.k AND ka.occ = m.occ AND ka.pitch = m.pitch AND m.pos >= ka.a GROUP BY ALL),
 iu AS (SELECT song_id, grp, k, occ, pitch, a, min_by(name, {'m': -c, 'p': p, 'n': name}) AS instrument FROM (SELECT song_id, grp, k, occ, pitch, a, x.n AS name, count(*) AS c, min(x.p) AS p FROM fv GROUP BY ALL) GROUP BY ALL),
 ag AS (SELECT song_id, grp, k, occ, pitch, a, v, count(*) AS n, median(x.p) AS pos, median(x.d) AS dur FROM fv GROUP BY ALL HAVING count(*) >= greatest(2, v)),
 tt AS (SELECT ag.*, instrument, ab.off, ab.fb + pos / 1000000 AS p, ab.fb + (pos + dur) / 1000000 AS q FROM ag JOIN iu USING (song_id, grp, k, occ, pitch, a) JOIN ab USING (song_id, grp, k, occ)),
 td AS (SELECT t.*, CAST(round(a1.t_us + (p - a1.beat_no) * (a1.n_us - a1.t_us) + off) AS BIGINT) AS onset, CAST(round(b1.t_us + (q - b1.beat_no) * (b1.n_us - b1.t_us) + off) AS BIGINT) AS ends
  FROM tt t JOIN sp a1 ON a1.song_id = t.song_id AND a1.beat_no = least(greatest(CAST(floor(p) AS BIGINT), 0), 1438) JOIN sp b1 ON b1.song_id = t.song_id AND b1.beat_no = least(greatest(CAST(floor(q) AS BIGINT), 0), 1438)),
 tn AS (SELECT t.* FROM td t WHERE NOT EXISTS (SELECT 1 FROM rn WHERE rn.song_id = t.song_id AND rn.pitch = t.pitch AND abs(rn.onset_us - t.onset) <= 50000)),
 kb AS (SELECT song_id, grp, k, occ, pitch, min(round(pos)) AS a FROM tn GROUP BY ALL UNION ALL SELECT m.song_id, m.grp, m.k, m.occ, m.pitch, min(round(m.pos)) FROM kb JOIN tn m ON kb.song_id = m.song_id AND kb.grp = m.grp AND kb.k = m.k AND kb.occ = m.occ AND kb.pitch = m.pitch AND round(m.pos) > kb.a + 125000 GROUP BY m.song_id, m.grp, m.k, m.occ, m.pitch, kb.a)"""
)


def played(spark, d):
    """(notes, occurrences)."""
    s = X.sections(spark, d)
    occ = s.select("song_id", F.col("label").alias("group"), F.col("section").alias("occ"), "start_bar", (F.col("end_bar") - F.col("start_bar")).alias("n_bars"), (F.col("section") % 4 * 5000).alias("offset_us"))
    bars = X.bars(spark, d)
    first = bars.where("bar <= 48").select("song_id", "bar", "start_us", "end_us")
    heard = X.notes_ref(spark, d).join(first, "song_id").where("onset_us >= start_us and onset_us < end_us").withColumn("_part", F.expr("(bar - 1) div 16"))
    again = heard.join(occ.select("song_id", "occ", F.col("start_bar").alias("_start"), F.col("offset_us").alias("_off")), "song_id").where("_part = occ % 3 and (note_id + occ * 7) % 11 <> 0")
    again = again.withColumn("_bar", F.col("_start") + (F.col("bar") - 1) % 16).join(bars.select("song_id", F.col("bar").alias("_bar"), F.col("start_us").alias("_to")), ["song_id", "_bar"])
    moved = F.col("_to") - F.col("start_us") + F.col("_off") + F.col("note_id") * F.col("occ") % 5 * 4000
    notes = again.select("song_id", (F.col("note_id") * 100 + F.col("occ")).alias("note_id"), (F.col("onset_us") + moved).alias("onset_us"), (F.col("offset_us") + moved).alias("offset_us"), "pitch", "instrument")
    return notes, occ


def voted(spark, d):
    notes, occ = played(spark, d)
    return consensus.repeat_consensus(notes, X.beats(spark, d), X.bars(spark, d), occ)


@query(
    VOTES
    + """ SELECT t.song_id, t.grp AS "group", CAST(t.k AS BIGINT) AS k, t.occ, t.pitch, t.onset AS onset_us, greatest(t.ends, t.onset + 10000) AS offset_us, t.instrument, round(t.n / t.v, 3) AS support
 FROM tn t JOIN kb ON kb.song_id = t.song_id AND kb.grp = t.grp AND kb.k = t.k AND kb.occ = t.occ AND kb.pitch = t.pitch AND kb.a = round(t.pos)"""
)
def w25_repeat_consensus(spark, d):
    """Notes that an occurrence of a repeated passage lacks and its voters hold."""
    return voted(spark, d)[0]


@query(VOTES + " SELECT DISTINCT hn.song_id, hn.note_id FROM hn JOIN (SELECT DISTINCT song_id, grp, k, occ FROM vt) USING (song_id, grp, k, occ) WHERE hn.id NOT IN (SELECT me.id FROM me JOIN vt USING (song_id, grp, k, occ, voter))")
def w25_lone_marks(spark, d):
    """Notes of an occurrence that none of its voters holds."""
    return voted(spark, d)[1]
