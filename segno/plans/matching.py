"""Queries over one-to-one matching and the measures that rest on it."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import scalars as S
from ..operators import assign, cluster, match
from ..sources import fixtures as X
from .queries import PRF, SPANS, anchored, query

KEYS = ["song_id", "pitch"]


def parts(tol: int) -> str:
    """Components of both lists for DuckDB: rr (refs) and ee (ests) with their part and, of refs, their place in it."""
    return f""", ev AS (SELECT *, sum(CASE WHEN g > {tol} THEN 1 ELSE 0 END) OVER (PARTITION BY song_id, pitch ORDER BY t, side ROWS UNBOUNDED PRECEDING) AS part FROM
  (SELECT *, t - lag(t) OVER (PARTITION BY song_id, pitch ORDER BY t, side) AS g FROM (SELECT song_id, pitch, note_id, onset_us AS t, offset_us AS z, 0 AS side FROM nr UNION ALL SELECT song_id, pitch, note_id, onset_us, offset_us, 1 FROM ne))),
 rr AS (SELECT *, row_number() OVER (PARTITION BY song_id, pitch, part ORDER BY t, note_id) AS i FROM ev WHERE side = 0), ee AS (SELECT * FROM ev WHERE side = 1)"""


def ways(tol: int, more: str = "TRUE") -> str:
    """All ways to match the refs of a component one after the other, then the best of each."""
    return parts(tol) + f""", cd AS (SELECT rr.song_id, rr.pitch, rr.part, rr.i, ee.note_id AS e, abs(rr.t - ee.t) AS d FROM rr JOIN ee USING (song_id, pitch, part) WHERE abs(rr.t - ee.t) <= {tol} AND {more}),
 wy AS (SELECT DISTINCT song_id, pitch, part, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS used, 0 AS n, CAST(0 AS BIGINT) AS cost FROM cd UNION ALL
  SELECT w.song_id, w.pitch, w.part, w.i + 1, CASE WHEN c.e IS NULL THEN w.used ELSE list_append(w.used, c.e) END, w.n + CASE WHEN c.e IS NULL THEN 0 ELSE 1 END, w.cost + coalesce(c.d, 0)
  FROM wy w JOIN rr ON rr.song_id = w.song_id AND rr.pitch = w.pitch AND rr.part = w.part AND rr.i = w.i + 1
  JOIN (SELECT song_id, pitch, part, i, e, d FROM cd UNION ALL SELECT song_id, pitch, part, i, NULL, NULL FROM rr) c ON c.song_id = w.song_id AND c.pitch = w.pitch AND c.part = w.part AND c.i = w.i + 1 AND (c.e IS NULL OR NOT list_contains(w.used, c.e))),
 bw AS (SELECT song_id, pitch, part, max(n * 1000000000000 - cost) AS v FROM wy GROUP BY ALL)"""


def both(spark, d):
    return X.notes_ref(spark, d), X.notes_est(spark, d)


@query(ways(150_000) + " SELECT song_id, sum(CAST(ceil(v / 1000000000000.0) AS BIGINT))::BIGINT AS pairs, sum(CAST(ceil(v / 1000000000000.0) AS BIGINT) * 1000000000000 - v)::BIGINT AS cost_us FROM bw GROUP BY 1")
def j5_match_min_cost(spark, d):
    return assign.match_min_cost(*both(spark, d), KEYS, 150_000).groupBy("song_id").agg(F.count("*").alias("pairs"), F.sum("cost_us").alias("cost_us"))


GREEDY = parts(150_000) + """, pr AS (SELECT song_id, pitch, part, rr.note_id AS r, ee.note_id AS e, abs(rr.t - ee.t) AS d, row_number() OVER (PARTITION BY song_id, pitch, part ORDER BY abs(rr.t - ee.t), ee.note_id, rr.note_id) AS k FROM rr JOIN ee USING (song_id, pitch, part) WHERE abs(rr.t - ee.t) <= 150000),
 gr AS (SELECT DISTINCT song_id, pitch, part, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS rs, CAST([] AS BIGINT[]) AS es, CAST(NULL AS BIGINT) AS r, CAST(NULL AS BIGINT) AS e, CAST(NULL AS BIGINT) AS d FROM pr UNION ALL
  SELECT g.song_id, g.pitch, g.part, p.k, CASE WHEN free THEN list_append(rs, p.r) ELSE rs END, CASE WHEN free THEN list_append(es, p.e) ELSE es END, CASE WHEN free THEN p.r END, CASE WHEN free THEN p.e END, CASE WHEN free THEN p.d END
  FROM (SELECT g.*, p.r AS pr_r, p.e AS pr_e, NOT list_contains(g.rs, p.r) AND NOT list_contains(g.es, p.e) AS free FROM gr g JOIN pr p ON p.song_id = g.song_id AND p.pitch = g.pitch AND p.part = g.part AND p.k = g.k + 1) g
  JOIN pr p ON p.song_id = g.song_id AND p.pitch = g.pitch AND p.part = g.part AND p.k = g.k + 1),
 gp AS (SELECT song_id, pitch, r, e, d FROM gr WHERE r IS NOT NULL)"""


@query(GREEDY + " SELECT song_id, pitch, r AS ref_id, e AS est_id, d AS cost_us FROM gp")
def j6_match_greedy(spark, d):
    return assign.match_greedy(*both(spark, d), KEYS, 150_000)


def grid(name: str, notes: str) -> str:
    """Notes on the grid for DuckDB: `name` with the first of each pitch within a tick, positions in millionths of a tick."""
    return f""", {name}p AS MATERIALIZED (SELECT n.song_id, n.pitch, n.note_id, CAST(round((s.beat_no + (n.onset_us - s.t_us) / (s.n_us - s.t_us)) * 48 * 1000000) AS BIGINT) AS pos, CAST(round(50000 / (s.n_us - s.t_us) * 48 * 1000000) AS BIGINT) AS tol
  FROM (SELECT x.*, greatest(onset_us, f) AS g FROM {notes} x JOIN fs USING (song_id)) n ASOF JOIN sp s ON n.song_id = s.song_id AND n.g >= s.t_us),
 {name}a AS (SELECT song_id, pitch, min(pos) AS a FROM {name}p GROUP BY ALL UNION ALL SELECT n.song_id, n.pitch, min(n.pos) FROM {name}a k JOIN {name}p n ON k.song_id = n.song_id AND k.pitch = n.pitch AND n.pos > k.a + 1000000 GROUP BY n.song_id, n.pitch, k.a),
 {name}f AS (SELECT n.song_id, n.pitch, min({{'p': n.pos, 'id': n.note_id, 'w': n.tol}}) AS x FROM {name}p n ASOF JOIN {name}a k ON k.song_id = n.song_id AND k.pitch = n.pitch AND n.pos >= k.a GROUP BY n.song_id, n.pitch, k.a),
 {name} AS MATERIALIZED (SELECT n.song_id, n.pitch, n.x.id AS note_id, n.x.p AS pos, n.x.w AS w, b.bar, row_number() OVER (PARTITION BY n.song_id, n.pitch ORDER BY n.x.p, n.x.id) AS i FROM {name}f n ASOF LEFT JOIN (SELECT song_id, bar, beat_no * 48000000 AS at FROM bt WHERE beat = 1) b ON n.song_id = b.song_id AND n.x.p >= b.at)"""


#: Every est in order takes the free ref that ends first among those that hold it.
TICKS = SPANS + ", fs AS (SELECT song_id, min(t_us) AS f FROM sp GROUP BY 1)" + grid("gr", "nr") + grid("ge", "ne") + """,
 mt AS (SELECT DISTINCT song_id, pitch, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS r, CAST(NULL AS BIGINT) AS e FROM ge UNION ALL
  SELECT song_id, pitch, i + 1, CASE WHEN rid IS NULL THEN used ELSE list_append(used, rid) END, rid, eid FROM
  (SELECT m.*, a.note_id AS eid, (SELECT arg_min(n.note_id, {'z': n.pos + n.w, 'id': n.note_id}) FROM gr n WHERE n.song_id = m.song_id AND n.pitch = m.pitch AND abs(n.pos - a.pos) <= n.w AND NOT list_contains(m.used, n.note_id)) AS rid
   FROM mt m JOIN ge a ON a.song_id = m.song_id AND a.pitch = m.pitch AND a.i = m.i + 1) m),
 mp AS (SELECT song_id, r, e FROM mt WHERE r IS NOT NULL)"""


@query(TICKS + " SELECT song_id, r AS ref_id, e AS est_id FROM mp")
def j7_match_ticks(spark, d):
    refs, _ = assign.match_ticks(*both(spark, d), X.beats(spark, d))
    return refs.where("mate is not null").select("song_id", F.col("note_id").alias("ref_id"), F.col("mate").alias("est_id"))


@query(TICKS + f""", cr AS (SELECT g.song_id, g.bar, count(r) AS tp, count(*) - count(r) AS fn, 0 AS fp FROM gr g LEFT JOIN mp ON note_id = r GROUP BY ALL UNION ALL BY NAME SELECT song_id, bar, 0 AS tp, 0 AS fn, count(*) AS fp FROM ge WHERE note_id NOT IN (SELECT e FROM mp) GROUP BY ALL),
 sx AS (SELECT cr.song_id, sc.section, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM cr LEFT JOIN sc ON cr.song_id = sc.song_id AND cr.bar >= sc.start_bar AND cr.bar < sc.end_bar GROUP BY ALL) SELECT song_id, section, tp, fp, fn, {PRF} FROM sx""")
def g3_tick_prf(spark, d):
    """Sections that part a song add up to its counts, since the whole song is matched first."""
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    counts = assign.tick_counts(*assign.match_ticks(*both(spark, d), X.beats(spark, d)), X.sections(spark, d))
    return counts.select("song_id", "section", "tp", "fp", "fn", *[F.round(f(tp, fp, fn), 6).alias(n) for n, f in (("precision", S.precision), ("recall", S.recall), ("f1", S.f1))])


@query(ways(100_000, "abs(rr.z - ee.z) <= greatest(50000, 0.2 * (rr.z - rr.t))") + " SELECT song_id, sum(CAST(ceil(v / 1000000000000.0) AS BIGINT))::BIGINT AS pairs FROM bw GROUP BY 1")
def j8_match_with_offset(spark, d):
    return assign.match_with_offset(*both(spark, d), KEYS, 100_000).groupBy("song_id").agg(F.count("*").alias("pairs"))


VARIANTS = [("onset50", 50_000, False, False), ("onset100", 100_000, False, False), ("offset50", 50_000, True, False), ("chroma50", 50_000, False, True)]


@query()
def g2_note_prf_variants(spark, d):
    """song_id, variant, tp, fp, fn, f1, and the octave error: chroma F1 less pitch F1."""
    ref, est = both(spark, d)
    sizes = ref.groupBy("song_id").agg(F.count("*").alias("n_ref")).join(est.groupBy("song_id").agg(F.count("*").alias("n_est")), "song_id", "full")
    found = []
    for name, tol, offsets, chroma in VARIANTS:
        r, e = ((x.withColumn("pitch", S.chroma_fold(F.col("pitch"))) for x in (ref, est)) if chroma else (ref, est))
        pairs = assign.match_with_offset(r, e, KEYS, tol) if offsets else None
        n = pairs.groupBy("song_id").agg(F.count("*").alias("tp")) if offsets else match.match_count(r, e, KEYS, tol).groupBy("song_id").agg(F.sum("tp").alias("tp"))
        found.append(n.select("song_id", F.lit(name).alias("variant"), "tp"))
    rows = found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3]).join(sizes, "song_id")
    fp, fn = F.coalesce("n_est", F.lit(0)) - F.col("tp"), F.coalesce("n_ref", F.lit(0)) - F.col("tp")
    rows = rows.select("song_id", "variant", F.col("tp").cast("long").alias("tp"), fp.cast("long").alias("fp"), fn.cast("long").alias("fn"), F.round(S.f1(F.col("tp"), fp, fn), 6).alias("f1"))
    of = lambda v: F.max(F.when(F.col("variant") == v, F.col("f1"))).over(Window.partitionBy("song_id"))
    return rows.withColumn("octave_error", F.round(of("chroma50") - of("onset50"), 6))


#: Guessed lines turned by one, so that the identity is not the best map.
LINED = GREEDY + ", lp AS (SELECT gp.song_id, a.line AS line, (b.line + 1) % 3 AS guess FROM gp JOIN nr a ON a.note_id = r JOIN ne b ON b.note_id = e)"
MAPS = "(SELECT * FROM (VALUES ([0,1,2]), ([0,2,1]), ([1,0,2]), ([1,2,0]), ([2,0,1]), ([2,1,0])) AS v(m))"
MAPPED = LINED + f""", sk AS (SELECT song_id, m, round(avg(acc), 9) AS macro, round(sum(hit) / sum(n), 9) AS weighted FROM (SELECT song_id, m, line, count(*) AS n, count_if(m[guess + 1] = line) AS hit, count_if(m[guess + 1] = line) / count(*) AS acc FROM lp, {MAPS} GROUP BY ALL) GROUP BY ALL),
 am AS (SELECT * FROM sk QUALIFY row_number() OVER (PARTITION BY song_id ORDER BY macro DESC, weighted DESC, m) = 1)"""


def lined(spark, d):
    ref, est = both(spark, d)
    pairs = assign.match_greedy(ref, est, KEYS, 150_000)
    return pairs.join(ref.select(F.col("note_id").alias("ref_id"), "line"), "ref_id").join(est.select(F.col("note_id").alias("est_id"), ((F.col("line") + 1) % 3).alias("guess")), "est_id").select("song_id", "ref_id", "est_id", "line", "guess")


@query(MAPPED + " SELECT song_id, array_to_string(m, ',') AS map, macro, weighted FROM am")
def g5_assignment_metrics(spark, d):
    return assign.assignment(lined(spark, d), ["song_id"], 3)


@query(MAPPED + " SELECT lp.song_id, line, count(*) AS n, count_if(m[guess + 1] = line)::BIGINT AS correct, count_if(guess = line)::BIGINT AS raw FROM lp JOIN am USING (song_id) GROUP BY ALL")
def g5_per_line(spark, d):
    """Per line: notes, those right under the best map, and those right without one."""
    pairs = lined(spark, d)
    best = assign.assignment(pairs, ["song_id"], 3).select("song_id", F.transform(F.split("map", ","), lambda x: x.cast("int")).alias("m"))
    right = F.get("m", F.col("guess")) == F.col("line")
    return pairs.join(best, "song_id").groupBy("song_id", "line").agg(F.count("*").alias("n"), F.count_if(right).alias("correct"), F.count_if(F.col("guess") == F.col("line")).alias("raw"))


@query(MAPPED + ", w AS (SELECT lp.line AS label, m[guess + 1] AS line, count(*) AS n FROM lp JOIN am USING (song_id) GROUP BY ALL) SELECT label, line, n, round(n / sum(n) OVER (PARTITION BY label), 6) AS share FROM w")
def g17_macro_hungarian(spark, d):
    """Confusion of all songs after each song's own best map of labels to lines."""
    pairs = lined(spark, d)
    best = assign.assignment(pairs, ["song_id"], 3).select("song_id", F.transform(F.split("map", ","), lambda x: x.cast("int")).alias("m"))
    n = pairs.join(best, "song_id").select(F.col("line").alias("label"), F.get("m", F.col("guess")).alias("line")).groupBy("label", "line").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("label")), 6))


@query(GREEDY + f""", sh AS (SELECT song_id, pitch, note_id, line, onset_us, count(*) OVER (PARTITION BY song_id, pitch ORDER BY onset_us RANGE BETWEEN 300000 PRECEDING AND 300000 FOLLOWING) > 1 AS s FROM nr),
 se AS (SELECT song_id, pitch, note_id, count(*) OVER (PARTITION BY song_id, pitch ORDER BY onset_us RANGE BETWEEN 300000 PRECEDING AND 300000 FOLLOWING) > 1 AS s FROM ne),
 k AS (SELECT song_id, (SELECT count(*) FROM gp JOIN sh ON sh.note_id = r AND sh.s JOIN se ON se.note_id = e AND se.s WHERE gp.song_id = g.song_id) AS tp, (SELECT count(*) FROM sh WHERE sh.song_id = g.song_id AND s) AS n, (SELECT count(*) FROM se WHERE se.song_id = g.song_id AND s) AS m FROM sg g),
 q AS (SELECT song_id, tp, m - tp AS fp, n - tp AS fn FROM k) SELECT song_id, tp, fp, fn, {PRF} FROM q""")
def g7_shared_prf(spark, d):
    """Accuracy on unison notes: those with another note of the pitch within 300 ms on their own side."""
    ref, est = both(spark, d)
    w = Window.partitionBy(*KEYS).orderBy("onset_us").rangeBetween(-300_000, 300_000)
    shared = lambda df: df.withColumn("s", F.count("*").over(w) > 1).where("s").select("song_id", "note_id")
    r, e = shared(ref), shared(est)
    pairs = assign.match_greedy(ref, est, KEYS, 150_000)
    hit = pairs.join(r.select(F.col("note_id").alias("ref_id")), "ref_id").join(e.select(F.col("note_id").alias("est_id")), "est_id").groupBy("song_id").agg(F.count("*").alias("tp"))
    out = X.songs(spark, d).select("song_id")
    for name, df in (("n", r), ("m", e)):
        out = out.join(df.groupBy("song_id").agg(F.count("*").alias(name)), "song_id", "left")
    out = out.join(hit, "song_id", "left").fillna(0, ["n", "m", "tp"])
    tp, fp, fn = F.col("tp"), F.col("m") - F.col("tp"), F.col("n") - F.col("tp")
    return out.select("song_id", "tp", fp.alias("fp"), fn.alias("fn"), *[F.round(f(tp, fp, fn), 6).alias(n) for n, f in (("precision", S.precision), ("recall", S.recall), ("f1", S.f1))])


@query(MAPPED + """, pm AS (SELECT ne.song_id, line_r AS line, count(*) AS n_est FROM (SELECT ne.song_id, m[(ne.line + 1) % 3 + 1] AS line_r FROM ne JOIN am USING (song_id)) ne GROUP BY ALL), rm AS (SELECT song_id, line, count(*) AS n_ref FROM nr GROUP BY ALL),
 hm AS (SELECT lp.song_id, line, count(*) AS tp FROM lp JOIN am USING (song_id) WHERE m[guess + 1] = line GROUP BY ALL)
 SELECT song_id, line, coalesce(tp, 0) AS tp, coalesce(n_est, 0) - coalesce(tp, 0) AS fp, n_ref - coalesce(tp, 0) AS fn FROM rm JOIN am USING (song_id) LEFT JOIN pm USING (song_id, line) LEFT JOIN hm USING (song_id, line)""")
def g7_lines_f1(spark, d):
    """Counts of each line after the best map; a pair counts where its line is the mapped one."""
    ref, est = both(spark, d)
    pairs = lined(spark, d)
    best = assign.assignment(pairs, ["song_id"], 3).select("song_id", F.transform(F.split("map", ","), lambda x: x.cast("int")).alias("m"))
    n_est = est.join(best, "song_id").select("song_id", F.get("m", (F.col("line") + 1) % 3).alias("line")).groupBy("song_id", "line").agg(F.count("*").alias("n_est"))
    hits = pairs.join(best, "song_id").where(F.get("m", F.col("guess")) == F.col("line")).groupBy("song_id", "line").agg(F.count("*").alias("tp"))
    rows = ref.groupBy("song_id", "line").agg(F.count("*").alias("n_ref")).join(best.select("song_id"), "song_id").join(n_est, ["song_id", "line"], "left").join(hits, ["song_id", "line"], "left").fillna(0, ["n_est", "tp"])
    return rows.select("song_id", "line", "tp", (F.col("n_est") - F.col("tp")).alias("fp"), (F.col("n_ref") - F.col("tp")).alias("fn"))


@query(GREEDY + """, rs AS (SELECT song_id, onset_us // 30000000 AS section, count(*) AS n, count(r) AS tp FROM nr LEFT JOIN (SELECT r FROM gp) ON note_id = r GROUP BY ALL), es AS (SELECT ne.song_id, onset_us // 30000000 AS section, count(*) AS fp FROM ne WHERE note_id NOT IN (SELECT e FROM gp) GROUP BY ALL)
 SELECT song_id, section, coalesce(tp, 0)::BIGINT AS tp, coalesce(fp, 0)::BIGINT AS fp, (coalesce(n, 0) - coalesce(tp, 0))::BIGINT AS fn FROM rs FULL JOIN es USING (song_id, section)""")
def g9_section_share(spark, d):
    """The whole song is matched first; a pair counts in the section of its ref, an extra in that of its own onset."""
    ref, est = both(spark, d)
    pairs, section = assign.match_greedy(ref, est, KEYS, 150_000), F.expr("onset_us div 30000000").alias("section")
    r = ref.select("song_id", "note_id", section).join(pairs.select(F.col("ref_id").alias("note_id"), F.lit(1).alias("hit")), "note_id", "left").groupBy("song_id", "section").agg(F.count("*").alias("n"), F.count("hit").alias("tp"))
    e = est.select("song_id", "note_id", section).join(pairs.select(F.col("est_id").alias("note_id")), "note_id", "left_anti").groupBy("song_id", "section").agg(F.count("*").alias("fp"))
    out = r.join(e, ["song_id", "section"], "full").fillna(0, ["n", "tp", "fp"])
    return out.select("song_id", "section", "tp", "fp", (F.col("n") - F.col("tp")).alias("fn"))


@query(""" SELECT note_id, min(CASE WHEN d = 0 AND (ov OR nr_d <= 100000) THEN 0 WHEN ov AND abs(d) IN (12, 19, 24) THEN 1 WHEN ov AND abs(d) IN (1, 2) THEN 2 END) AS relation FROM (SELECT a.note_id, b.pitch - a.pitch AS d, b.onset_us < a.offset_us + 30000 AND a.onset_us < b.offset_us + 30000 AS ov, abs(a.onset_us - b.onset_us) AS nr_d
  FROM ne a LEFT JOIN nr b ON a.song_id = b.song_id) GROUP BY 1""")
def j10_relation_of(spark, d):
    """0 timing, 1 octave, 2 near, or null: how a note relates to those of the other list that sound with it."""
    ref, est = both(spark, d)
    steps = [0, 1, -1, 2, -2, 12, -12, 19, -19, 24, -24]
    # each estimate looks for a pitch at a fixed step away, in cells of a second that its own sound touches
    cell = lambda a, b: F.explode(F.sequence(F.floor(a / 1_000_000), F.floor(b / 1_000_000)))
    a = est.select("song_id", "note_id", F.col("onset_us").alias("a_on"), F.col("offset_us").alias("a_off"), "pitch", F.explode(F.array(*[F.lit(x) for x in steps])).alias("step"))
    a = a.select("song_id", "note_id", "a_on", "a_off", "step", (F.col("pitch") + F.col("step")).alias("pitch"), cell(F.col("a_on") - 130_000, F.col("a_off") + 130_000).alias("cell"))
    b = ref.select("song_id", "pitch", F.col("onset_us").alias("b_on"), F.col("offset_us").alias("b_off"), cell(F.col("onset_us"), F.col("offset_us")).alias("cell"))
    ov = (F.col("b_on") < F.col("a_off") + 30_000) & (F.col("a_on") < F.col("b_off") + 30_000)
    step = F.abs("step")
    kind = F.when((step == 0) & (ov | (F.abs(F.col("a_on") - F.col("b_on")) <= 100_000)), 0).when(ov & step.isin(12, 19, 24), 1).when(ov & step.isin(1, 2), 2)
    found = a.join(b, ["song_id", "pitch", "cell"]).groupBy("note_id").agg(F.min(kind).alias("relation"))
    return est.select("note_id").join(found, "note_id", "left")


@query(""" SELECT DISTINCT a.note_id FROM ne a WHERE EXISTS (SELECT 1 FROM nr b WHERE a.song_id = b.song_id AND abs(a.pitch - b.pitch) IN (0, 12) AND abs(a.onset_us - b.onset_us) <= 50000)""")
def j1_exists_within_octave(spark, d):
    """The semi join with the octave option: the left pitch, or one an octave away."""
    ref, est = both(spark, d)
    wide = est.select("song_id", "note_id", "onset_us", F.explode(F.array(F.col("pitch") - 12, F.col("pitch"), F.col("pitch") + 12)).alias("pitch"))
    return match.near(wide, ref, KEYS, 50_000, "left_semi").select("note_id").distinct()


@query(anchored("song_id, pitch") + " SELECT song_id, note_id FROM (SELECT song_id, note_id, row_number() OVER (PARTITION BY song_id, pitch, anchor_us ORDER BY onset_us, note_id) AS k FROM cl) WHERE k = 1")
def s6_union_ref(spark, d):
    """The takes (here the lines) of a song together, without near-duplicates of a kept note."""
    notes = X.notes_ref(spark, d)
    takes = [notes.where(F.col("line") == k) for k in range(3)]
    rows = cluster.anchored_clusters(takes[0].unionByName(takes[1]).unionByName(takes[2]), KEYS, 35_000)
    place = F.row_number().over(Window.partitionBy(*KEYS, "anchor_us").orderBy("onset_us", "note_id"))
    return rows.withColumn("k", place).where("k = 1").select("song_id", "note_id")
