"""Queries of metre, feel and quantising, over beats of quarters and dotted quarters and notes that swing in a third of the sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import folds, metre
from ..sources import fixtures as X
from ..sources.quality import written
from .queries import anchored, query

PLACED = """, mb AS (SELECT song_id, beat_no, t_us, lead(t_us) OVER (PARTITION BY song_id ORDER BY t_us) AS n_us, bar, beat, CASE WHEN (bar - 1) // 16 % 5 = 4 THEN 'dotted_quarter' ELSE 'quarter' END AS unit FROM bt), mc AS (SELECT * FROM mb WHERE n_us IS NOT NULL),
 sn AS (SELECT n.song_id, n.note_id, CASE WHEN (bar - 1) // 16 % 3 = 1 AND note_id % 4 <> 0 THEN t_us + (n_us - t_us) * 2 // 3 ELSE onset_us END AS onset_us, offset_us + 200000 AS offset_us FROM nr n ASOF JOIN mc b ON n.song_id = b.song_id AND n.onset_us >= b.t_us WHERE n.onset_us < b.n_us)"""
FEEL = PLACED + anchored("song_id").replace("nr", "sn").replace("35000", "30000") + """, pf AS (SELECT a.song_id, b.bar, b.unit, (a.a - b.t_us) / (b.n_us - b.t_us) AS fr FROM (SELECT DISTINCT song_id, a FROM an) a ASOF JOIN mc b ON a.song_id = b.song_id AND a.a >= b.t_us WHERE a.a < b.n_us),
 po AS (SELECT song_id, bar, unit, CASE WHEN abs(fr - 1 / 3) < 0.06 THEN 3 WHEN abs(fr - 0.5) < 0.06 THEN 2 WHEN abs(fr - 2 / 3) < 0.06 THEN 6 ELSE 0 END AS spot FROM pf), dq AS (SELECT s.song_id, CASE WHEN count_if(spot = 6) >= 8 AND count_if(spot = 6) >= 2 * count_if(spot = 2) AND count_if(spot = 3) <= 0.35 * count_if(spot = 6) THEN 'shuffle' ELSE 'compound' END AS read_as
  FROM sg s LEFT JOIN (SELECT * FROM po WHERE unit = 'dotted_quarter') p USING (song_id) GROUP BY 1),
 ub AS (SELECT DISTINCT song_id, bar, CASE WHEN read_as = 'shuffle' THEN 'quarter' ELSE unit END AS unit FROM mb JOIN dq USING (song_id)),
 sf AS (SELECT s.song_id, s.section, s.start_bar, s.end_bar, read_as, count_if(u.unit = 'quarter') AS q, count_if(u.unit = 'quarter' AND spot = 3) AS third, count_if(u.unit = 'quarter' AND spot = 2) AS half, count_if(u.unit = 'quarter' AND spot = 6) AS two_thirds
  FROM sc s JOIN dq USING (song_id) JOIN ub u ON u.song_id = s.song_id AND u.bar >= start_bar AND u.bar < end_bar LEFT JOIN po p ON p.song_id = u.song_id AND p.bar = u.bar GROUP BY ALL),
 fl AS (SELECT *, CASE WHEN q > 0 AND ((two_thirds >= 8 AND two_thirds >= 2 * half AND third <= 0.35 * two_thirds) OR (read_as = 'shuffle' AND NOT (half >= 8 AND half >= 2 * two_thirds))) THEN 'triplet8th' END AS feel FROM sf),
 bf AS (SELECT u.song_id, u.bar, u.unit, coalesce(feel = 'triplet8th' AND u.unit = 'quarter', FALSE) AS swing FROM ub u JOIN fl ON fl.song_id = u.song_id AND u.bar >= start_bar AND u.bar < end_bar)"""
_ROWS = ", ".join(f"('{u}', '{f}', {t}, {p!r}::DOUBLE, {pen}::DOUBLE, {off}, {metre.PRIOR[u][f]}::DOUBLE)" for u, f, t, p, pen, off in metre.points())
COSTS = FEEL + f""", gp AS (SELECT * FROM (VALUES {_ROWS}) v(unit, family, tick, played, pen, off, prior)), bu AS (SELECT c.song_id, c.beat_no, c.t_us, c.n_us, b.unit, b.swing FROM mb c JOIN bf b USING (song_id, bar)),
 nc AS (SELECT n.song_id, n.note_id, b.beat_no, b.unit, b.swing, (n.onset_us - b.t_us) / (b.n_us - b.t_us) AS fr, (b.n_us - b.t_us) / 1000.0 AS ms FROM sn n ASOF JOIN (SELECT * FROM bu WHERE n_us IS NOT NULL) b ON n.song_id = b.song_id AND n.onset_us >= b.t_us),
 ch AS (SELECT n.song_id, n.beat_no, n.note_id, g.family, power((played - fr) * ms / 30, 2) AS r2, pen, off, prior FROM nc n JOIN gp g ON n.unit = g.unit AND (family = 'ter' OR (family = 'swing') = (swing AND n.unit = 'quarter')) WHERE family <> 'swing' OR swing QUALIFY row_number() OVER (PARTITION BY n.note_id, g.family ORDER BY round(power((played - fr) * ms / 30, 2) + pen, 9), tick) = 1),
 cs AS (SELECT song_id, beat_no, family, sum(least(r2, 9) + pen) + CASE WHEN bool_or(off) THEN any_value(prior) ELSE 0 END AS cost, count(*) AS notes FROM ch GROUP BY ALL), rc AS (SELECT song_id, min(beat_no) AS lo, max(beat_no) AS hi FROM cs GROUP BY 1)
 SELECT b.song_id, b.beat_no AS beat, f.family, round(coalesce(cost, 0), 6) AS cost, coalesce(notes, 0) AS notes FROM bu b JOIN rc ON b.song_id = rc.song_id AND b.beat_no BETWEEN lo AND hi JOIN (SELECT DISTINCT unit, family FROM gp) f ON f.unit = b.unit AND (f.family = 'ter' OR (f.family = 'swing' AND swing AND b.unit = 'quarter') OR (f.family = 'bin' AND NOT (swing AND b.unit = 'quarter')))
 LEFT JOIN cs ON cs.song_id = b.song_id AND cs.beat_no = b.beat_no AND cs.family = f.family"""


def beats(spark, d):
    """Beats with a unit: every fifth section counts dotted quarters."""
    return X.beats(spark, d).withColumn("unit", F.when(F.expr("(bar - 1) div 16 % 5 = 4"), "dotted_quarter").otherwise("quarter"))


def notes(spark, d, beats_=None):
    """Notes a little longer; in every third section three in four are played at two thirds of their beat."""
    at = metre.places(X.notes_ref(spark, d).select("song_id", "note_id", "onset_us", "offset_us"), beats(spark, d) if beats_ is None else beats_)
    moved = F.expr("mark.t_us + (mark.next_us - mark.t_us) * 2 div 3")
    swung = F.expr("(mark.bar - 1) div 16 % 3 = 1 and note_id % 4 <> 0")
    return at.select("song_id", "note_id", F.when(swung, moved).otherwise(F.col("onset_us")).alias("onset_us"), (F.col("offset_us") + 200_000).alias("offset_us"))


def heard(spark, d):
    """(notes, beats), each computed once: what follows reads both many times, and a plan that holds them each time outgrows the driver."""
    own = written(beats(spark, d), "beats")
    return written(notes(spark, d, own), "notes"), own


def read_beats(spark, d, n, own):
    """Beats in the unit that their song is read in, with their swing; computed once as well."""
    sections = written(X.sections(spark, d), "sections")
    feels = written(metre.meter_feel(n, own, sections), "feels")
    return written(own.drop("unit").join(metre.bar_feel(own, sections, feels).hint("merge"), ["song_id", "bar"]), "read_beats")


@query(FEEL + " SELECT song_id, section, third, half, two_thirds, feel, read_as FROM fl")
def w31_meter_feel(spark, d):
    n, own = heard(spark, d)
    return metre.meter_feel(n, own, X.sections(spark, d))


@query(FEEL + " SELECT * FROM bf")
def w31_bar_feel(spark, d):
    n, own = heard(spark, d)
    sections = written(X.sections(spark, d), "sections")
    return metre.bar_feel(own, sections, written(metre.meter_feel(n, own, sections), "feels"))


@query(COSTS)
def w28_quantize_costs(spark, d):
    n, own = heard(spark, d)
    return metre.beat_costs(n, read_beats(spark, d, n, own)).withColumn("cost", F.round("cost", 6))


@query()
def w29_viterbi_families(spark, d):
    n, own = heard(spark, d)
    return folds.viterbi_families(metre.beat_costs(n, read_beats(spark, d, n, own)))


@query()
def w30_quantize_notes(spark, d):
    n, own = heard(spark, d)
    own = read_beats(spark, d, n, own)
    families = written(folds.viterbi_families(metre.beat_costs(n, own)), "families")
    return metre.quantize_notes(n, families, own)
