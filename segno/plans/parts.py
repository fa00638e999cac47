"""Queries of the part pipeline, from notes with their strums, windows and stereo signatures to numbered parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cluster, parts, statements
from ..sources import fixtures as X
from ..sources.quality import written
from . import statements as T
from .queries import anchored, query

#: Notes of a window from which it counts; the songs here are sparse.
LEAST = 2

ROWS = (
    T.MORE
    + anchored("song_id")
    + ", "
    + statements.text("symbolic_roles", "duckdb")[0].format(**T.VIEWS)
    + """, rw AS MATERIALIZED (SELECT ro.song_id, ro.note_id, ro.anchor_us, ro.onset_us, ro.pitch, ro.instrument, ro.line, ro.size, ro.peel, ro.chord, ro.lead, CASE WHEN chord THEN -1.0 WHEN lead THEN 1.0 ELSE 0.0 END AS r,
  CASE WHEN ro.note_id % 9 <> 0 THEN (ro.note_id * 37 % 41 - 20) / 2.0 END AS ild, ro.note_id * 13 % 21 / 20.0 AS coh, ro.note_id * 29 % 25 / 2.0 - 2 AS ms, nw.w, nw.label, nw.w // 4 AS section FROM ro LEFT JOIN nw ON ro.note_id = nw.note_id)"""
)
STREAMS = (
    ROWS
    + f""", wa AS (SELECT song_id, w, any_value(label) AS label, any_value(section) AS section, count(*) AS notes, count_if(ild >= 0) AS l, count_if(ild < 0) AS g, count_if(chord) AS ch, count_if(lead) AS le FROM rw WHERE w IS NOT NULL GROUP BY ALL),
 wb AS (SELECT song_id, w, instrument, count(*) AS c, row_number() OVER (PARTITION BY song_id, w ORDER BY count(*) DESC, instrument) AS pl FROM rw WHERE w IS NOT NULL GROUP BY song_id, w, instrument),
 wf AS (SELECT DISTINCT y.song_id, y.w, y.onset_us // 1000000 AS cell FROM rw y JOIN wb f ON f.song_id = y.song_id AND f.w = y.w AND f.instrument = y.instrument AND f.pl = 1),
 wd AS (SELECT b.song_id, b.w, any_value(b.c) AS c, count(wf.cell) AS t FROM wb b JOIN rw x ON x.song_id = b.song_id AND x.w = b.w AND x.instrument = b.instrument LEFT JOIN wf ON wf.song_id = x.song_id AND wf.w = x.w AND wf.cell = x.onset_us // 1000000 WHERE b.pl = 2 GROUP BY b.song_id, b.w),
 ws AS MATERIALIZED (SELECT song_id, w, section, notes, CASE WHEN notes >= {LEAST} AND label = 'R3' THEN CASE WHEN least(l, g) >= {LEAST} THEN 2 ELSE 1 END ELSE 0 END AS spatial, CASE WHEN notes >= {LEAST} THEN CASE WHEN coalesce(c >= {LEAST} AND t >= c / 2, FALSE) THEN 2 ELSE 1 END ELSE 0 END AS class,
  CASE WHEN notes >= {LEAST} THEN CASE WHEN least(ch, le) >= {LEAST} THEN 2 ELSE 1 END ELSE 0 END AS symbolic, 0 AS width FROM wa LEFT JOIN wd USING (song_id, w)),
 wx AS (SELECT *, greatest(spatial, class, symbolic, width) AS c FROM ws)"""
)
COUNTS = (
    STREAMS
    + """, sp0 AS (SELECT song_id, count_if(c >= 2) AS two, count(DISTINCT section) FILTER (c >= 2) AS sections, count(DISTINCT section) AS every, count_if(spatial >= 2) AS a, count_if(class >= 2) AS b, count_if(symbolic >= 2) AS d FROM wx GROUP BY 1),
 pc AS (SELECT *, CASE WHEN sections < least(2, every) THEN least(two - 2.5, -0.5) ELSE two - 2.5 END AS m, CASE WHEN greatest(a, b, d) = 0 THEN NULL WHEN a >= b AND a >= d THEN 'spatial' WHEN b >= d THEN 'class' ELSE 'symbolic' END AS evidence FROM sp0),
 ck AS (SELECT song_id, CASE WHEN song_id % 5 = 2 THEN 3 WHEN song_id % 5 = 3 THEN 4 WHEN two > 0 AND m > 0 THEN 2 ELSE 1 END AS k, evidence FROM pc)"""
)
SEEDS = (
    COUNTS
    + """, ir AS (SELECT song_id, instrument, row_number() OVER (PARTITION BY song_id ORDER BY count(*) DESC, instrument) AS rk FROM rw GROUP BY song_id, instrument),
 sd0 AS (SELECT rw.*, k, evidence, CASE WHEN label = 'R3' AND ild >= 0 THEN 0 WHEN label = 'R3' AND ild < 0 THEN 1 END AS s1, CASE WHEN rk <= 2 THEN rk - 1 END AS s2, CASE WHEN chord THEN 0 WHEN lead THEN 1 END AS s3 FROM rw JOIN ir USING (song_id, instrument) LEFT JOIN ck USING (song_id)),
 hk AS (SELECT song_id, count(DISTINCT s1) = 2 AS h1, count(DISTINCT s2) = 2 AS h2, count(DISTINCT s3) = 2 AS h3 FROM sd0 GROUP BY 1),
 pk0 AS (SELECT *, CASE WHEN evidence = 'spatial' AND h1 THEN 'spatial' WHEN evidence = 'class' AND h2 THEN 'class' WHEN h3 THEN 'symbolic' WHEN h2 THEN 'class' WHEN h1 THEN 'spatial' END AS prim FROM sd0 JOIN hk USING (song_id)),
 tw AS (SELECT *, CASE prim WHEN 'spatial' THEN s1 WHEN 'class' THEN s2 WHEN 'symbolic' THEN s3 END AS side FROM pk0),
 ky AS (SELECT *, CASE prim WHEN 'spatial' THEN CASE side WHEN 0 THEN 'L' WHEN 1 THEN 'R' END WHEN 'class' THEN CASE WHEN side IS NOT NULL THEN instrument END WHEN 'symbolic' THEN CASE side WHEN 0 THEN 'rhythm' WHEN 1 THEN 'lead' END END AS two FROM tw),
 rs AS (SELECT song_id, two FROM ky WHERE two IS NOT NULL AND NOT lead GROUP BY ALL), f4 AS (SELECT song_id, count(DISTINCT side * 2 + CASE WHEN chord THEN 0 WHEN lead THEN 1 END) >= 2 AS enough FROM ky WHERE two IS NOT NULL GROUP BY 1),
 sl AS MATERIALIZED (SELECT ky.song_id, ky.note_id, CASE WHEN coalesce(k, 1) <= 1 OR prim IS NULL THEN 'all' WHEN k = 2 OR prim = 'symbolic' THEN ky.two WHEN k = 3 THEN CASE WHEN lead AND (ky.two IS NULL OR rs.two IS NOT NULL) THEN 'lead' ELSE ky.two END
   WHEN NOT enough THEN ky.two WHEN chord THEN ky.two || '.rhythm' WHEN lead THEN ky.two || '.lead' END AS key,
  CASE WHEN coalesce(k, 1) <= 1 OR prim IS NULL THEN 0 WHEN k = 2 OR prim = 'symbolic' THEN side WHEN k = 3 THEN CASE WHEN lead AND (ky.two IS NULL OR rs.two IS NOT NULL) THEN 2 ELSE side END WHEN NOT enough THEN side WHEN chord THEN side * 2 WHEN lead THEN side * 2 + 1 END AS place
  FROM ky LEFT JOIN rs ON rs.song_id = ky.song_id AND rs.two = ky.two LEFT JOIN f4 ON f4.song_id = ky.song_id),
 sk AS (SELECT * FROM sl WHERE key IS NOT NULL)"""
)
POSTERIORS = (
    SEEDS
    + """, pf AS (SELECT s.song_id, s.key, s.place, count(*) AS seeds, coalesce(avg(tanh(ild)) FILTER (label = 'R3' AND ild IS NOT NULL), 0) AS pos, avg(r) AS role FROM sk s JOIN rw USING (note_id) GROUP BY ALL),
 pg AS (SELECT *, seeds / sum(seeds) OVER (PARTITION BY song_id) AS share FROM pf), nc AS (SELECT song_id, count(DISTINCT instrument) AS c FROM rw GROUP BY 1), kc AS (SELECT s.song_id, s.key, instrument, count(*) AS n FROM sk s JOIN rw USING (note_id) GROUP BY ALL),
 zz AS (SELECT rw.song_id, rw.note_id, rw.anchor_us, rw.instrument, p.key, p.place, coalesce(label <> 'R3', TRUE) AND NOT peel AND size > 1 AS joined, 6 * CASE WHEN label = 'R3' AND ild IS NOT NULL THEN tanh(ild) ELSE 0 END * pos + r * role + ln((coalesce(kc.n, 0) + 1.0) / (seeds + nc.c)) + ln(share) AS z
  FROM rw JOIN pg p ON p.song_id = rw.song_id JOIN nc ON nc.song_id = rw.song_id LEFT JOIN kc ON kc.song_id = rw.song_id AND kc.key = p.key AND kc.instrument = rw.instrument),
 zg AS (SELECT song_id, anchor_us, instrument, key, sum(z) AS g FROM zz WHERE joined GROUP BY ALL), ze AS (SELECT zz.song_id, note_id, zz.key, place, CASE WHEN joined THEN g ELSE z END AS z FROM zz LEFT JOIN zg ON joined AND zg.song_id = zz.song_id AND zg.anchor_us = zz.anchor_us AND zg.instrument = zz.instrument AND zg.key = zz.key),
 po AS MATERIALIZED (SELECT song_id, note_id, key, place, exp(z - m) / sum(exp(z - m)) OVER (PARTITION BY note_id) AS p FROM (SELECT *, max(z) OVER (PARTITION BY note_id) AS m FROM ze))"""
)
NUMBERED = (
    POSTERIORS
    + """, be AS (SELECT * FROM po QUALIFY row_number() OVER (PARTITION BY note_id ORDER BY round(p, 9) DESC, place) = 1), tk AS (SELECT b.song_id, b.key, r.onset_us FROM be b JOIN rw r USING (note_id) WHERE round(p, 9) >= 0.4),
 lg AS (SELECT song_id, key, count(*) AS notes, count(DISTINCT onset_us // 2000000) AS bars, min(onset_us) AS f FROM tk GROUP BY ALL), lh AS (SELECT l.*, place, round(pos, 9) AS pos, row_number() OVER (PARTITION BY l.song_id ORDER BY bars DESC, notes DESC, f, round(pos, 9) DESC, place) AS main FROM lg l JOIN pf USING (song_id, key)),
 ln AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY CASE WHEN main = 1 THEN 0 ELSE 1 END, f, pos DESC, place) AS number FROM lh)"""
)


def rows(spark, d):
    """Notes with their strum, layers, stereo signature and window."""
    notes = X.notes_ref(spark, d)
    clusters = cluster.anchored_clusters(notes, ["song_id"], 35_000)
    layers = statements.apply("symbolic_roles", clusters=clusters).select("note_id", "size", "chord", "peel", "lead")
    window = T.windowed(spark, d).select("note_id", "w", "label")
    x = clusters.withColumnRenamed("anchor_us", "cluster").join(layers, "note_id").join(window, "note_id", "left").join(X.signatures(spark, d), "note_id")
    return written(x.withColumn("section", F.expr("w div 4")), "rows")


def forced(spark, d):
    k = F.when(F.col("song_id") % 5 == 2, 3).when(F.col("song_id") % 5 == 3, 4)
    return X.songs(spark, d).select("song_id", k.alias("forced"))


def counts(spark, d, x):
    found = parts.part_count(parts.window_streams(x, LEAST)).join(forced(spark, d), "song_id", "full")
    return found.select("song_id", F.coalesce("forced", "k").alias("k"), "evidence")


@query(STREAMS + " SELECT song_id, w, section, notes, spatial, class, symbolic, width, c FROM wx")
def g25_window_streams(spark, d):
    return parts.window_streams(rows(spark, d), LEAST)


@query(COUNTS + " SELECT song_id, CASE WHEN two > 0 AND m > 0 THEN 2 ELSE 1 END AS k, evidence, round(CASE WHEN two > 0 THEN 1 / (1 + exp(-m)) ELSE 0 END, 6) AS p2, two, sections FROM pc")
def g25_part_count(spark, d):
    return parts.part_count(parts.window_streams(rows(spark, d), LEAST)).withColumn("p2", F.round("p2", 6))


@query(SEEDS + " SELECT song_id, note_id, key, CAST(place AS INTEGER) AS place FROM sk")
def w6_seed_lines(spark, d):
    x = rows(spark, d)
    return parts.seed_lines(x, counts(spark, d, x)).select("song_id", "note_id", "key", F.col("place").cast("int").alias("place"))


@query(POSTERIORS + " SELECT pg.song_id, pg.key, seeds, round(pos, 6) AS position, round(role, 6) AS role, round(share, 6) AS share, round((coalesce(kc.n, 0) + 1.0) / (seeds + nc.c), 6) AS click FROM pg JOIN nc ON nc.song_id = pg.song_id LEFT JOIN kc ON kc.song_id = pg.song_id AND kc.key = pg.key AND kc.instrument = 'click'")
def g26_line_profiles(spark, d):
    """What the seeds of each line have in common; of the instruments the chance of one."""
    x = rows(spark, d)
    p = parts.line_profiles(x, parts.seed_lines(x, counts(spark, d, x)))
    click = (F.coalesce(F.try_element_at("classes", F.lit("click")), F.lit(0)) + 1.0) / (F.col("seeds") + F.col("n_classes"))
    return p.select("song_id", "key", "seeds", *[F.round(c, 6).alias(c) for c in ("position", "role", "share")], F.round(click, 6).alias("click"))


@query(POSTERIORS + " SELECT song_id, note_id, key, round(p, 6) AS p FROM po")
def w5_note_posteriors(spark, d):
    x = rows(spark, d)
    return parts.note_posteriors(x, parts.line_profiles(x, parts.seed_lines(x, counts(spark, d, x)))).select("song_id", "note_id", "key", F.round("p", 6).alias("p"))


@query(NUMBERED + " SELECT b.song_id, b.note_id, CASE WHEN round(b.p, 9) >= 0.4 THEN l.number END AS number, round(b.p, 6) AS p, round(b.p, 9) < 0.6 AS amber FROM be b LEFT JOIN ln l ON l.song_id = b.song_id AND l.key = b.key")
def w47_diarize(spark, d):
    """Every note's part number, from strums to numbered parts in one chain."""
    notes, _, _ = parts.diarize(rows(spark, d), forced(spark, d), LEAST)
    return notes.withColumn("p", F.round("p", 6))


@query(NUMBERED + " SELECT song_id, k, CASE WHEN song_id % 5 = 2 THEN 3 WHEN song_id % 5 = 3 THEN 4 END AS forced, evidence, chosen FROM (SELECT song_id, CASE WHEN two > 0 AND m > 0 THEN 2 ELSE 1 END AS k, evidence FROM pc) LEFT JOIN (SELECT song_id, count(*) AS chosen FROM ln GROUP BY 1) USING (song_id)")
def w47_counts(spark, d):
    """The estimated, the forced and the chosen number of parts of each song."""
    return parts.diarize(rows(spark, d), forced(spark, d), LEAST)[2]


def layers(spark, d):
    x = rows(spark, d).where("w is not null")
    by = ["song_id", "w", "line"]
    rate = lambda c: F.avg(F.col(c).cast("double"))
    g = x.groupBy(*by).agg(
        F.count("*").alias("n"), F.percentile("pitch", F.lit(0.5)).alias("pitch"), rate("chord").alias("chord"), rate("lead").alias("lead"), (F.count("*") / 8.0).alias("density"), F.avg(F.when(F.col("label") == "R3", F.col("ild_db"))).alias("ild")
    )
    of = x.groupBy(*by, "instrument").agg(F.count("*").alias("c")).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("instrument", "c"))).alias("c"))
    return g.join(of, by).withColumn("classes", F.transform_values("c", lambda k, v: v / F.col("n"))).drop("c")


LAYERS = ROWS + """, la AS MATERIALIZED (SELECT song_id, w, line, count(*) AS n, quantile_cont(pitch, 0.5) AS pitch, avg(chord::INT) AS chord, avg(lead::INT) AS lead, count(*) / 8.0 AS density, avg(ild) FILTER (label = 'R3') AS ild FROM rw WHERE w IS NOT NULL GROUP BY ALL)"""


@query(LAYERS + " SELECT song_id, w, line, round(pitch, 6) AS pitch, round(chord, 6) AS chord, round(lead, 6) AS lead, density, round(ild, 6) AS ild FROM la")
def w7_layer_signature(spark, d):
    return layers(spark, d).select("song_id", "w", "line", *[F.round(c, 6).alias(c) for c in ("pitch", "chord", "lead", "density", "ild")])


@query(
    LAYERS
    + """, lc AS (SELECT song_id, w, line, instrument, count(*) AS c FROM rw WHERE w IS NOT NULL GROUP BY ALL), nx AS (SELECT song_id, w, lag(w) OVER (PARTITION BY song_id ORDER BY w) AS v FROM (SELECT DISTINCT song_id, w FROM la)),
 ds AS (SELECT n.song_id, n.w, a.line AS a, b.line AS b, round(abs(a.pitch - b.pitch) / 7.0 + 2 * abs(a.chord - b.chord) + 2 * abs(a.lead - b.lead) + abs(ln((a.density + 1e-9) / (b.density + 1e-9))) + CASE WHEN a.ild * b.ild < 0 THEN least(2, abs(a.ild - b.ild) / 3) ELSE 0 END
   + 0.5 * (SELECT sum(abs(coalesce(x.c / a.n, 0) - coalesce(y.c / b.n, 0))) FROM (SELECT instrument, c FROM lc WHERE lc.song_id = a.song_id AND lc.w = a.w AND lc.line = a.line) x FULL JOIN (SELECT instrument, c FROM lc WHERE lc.song_id = b.song_id AND lc.w = b.w AND lc.line = b.line) y USING (instrument)), 9) AS d
  FROM nx n JOIN la a ON a.song_id = n.song_id AND a.w = n.v JOIN la b ON b.song_id = n.song_id AND b.w = n.w),
 wm AS (SELECT song_id, w, least(count(DISTINCT a), count(DISTINCT b)) AS m FROM ds GROUP BY ALL),
 wy AS (SELECT song_id, w, [{'a': a, 'b': b, 'd': d}] AS ps FROM ds UNION ALL SELECT y.song_id, y.w, list_append(y.ps, {'a': s.a, 'b': s.b, 'd': s.d}) FROM wy y JOIN ds s ON s.song_id = y.song_id AND s.w = y.w AND s.a > y.ps[-1].a AND NOT list_contains(list_transform(y.ps, lambda p: p.b), s.b)),
 wz AS (SELECT y.song_id, y.w, y.ps FROM wy y JOIN wm USING (song_id, w) WHERE len(y.ps) = m QUALIFY row_number() OVER (PARTITION BY y.song_id, y.w ORDER BY round(list_sum(list_transform(y.ps, lambda p: p.d)), 9), y.ps) = 1)
 SELECT song_id, w, p.a AS a, p.b AS b, round(1 - p.d / 4.0, 6) AS strength FROM (SELECT song_id, w, unnest(ps) AS p FROM wz) WHERE p.d < 4"""
)
def w7_layer_links(spark, d):
    return parts.layer_links(layers(spark, d), 4.0).withColumn("strength", F.round("strength", 6))
