"""Queries over the folds, lineage and confidence models."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import scalars as S
from ..operators import cluster, confidence, folds, lineage, match, metrics, replay, sequence, statements
from ..sources import fixtures as X
from ..sources import quality
from . import statements as T
from .pulse import LINKS, links
from .queries import items, query


@query(""", fg AS (SELECT song_id, pitch, note_id, onset_us, offset_us + 300000 AS off, note_id % 4 = 0 AS attack, note_id % 3 <> 0 AS evidence, row_number() OVER (PARTITION BY song_id, pitch ORDER BY onset_us, note_id) AS rn FROM nr),
 fo AS (SELECT DISTINCT song_id, pitch, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS head, CAST(-9000000000 AS BIGINT) AS z FROM fg UNION ALL SELECT f.song_id, f.pitch, g.rn, CASE WHEN j THEN f.head ELSE g.note_id END, CASE WHEN j THEN greatest(f.z, g.off) ELSE g.off END
  FROM (SELECT f.*, f.head IS NOT NULL AND g.onset_us - f.z BETWEEN -5000 AND 30000 AND NOT g.attack AND (g.off - g.onset_us < 400000 OR NOT g.evidence) AS j FROM fo f JOIN fg g ON f.song_id = g.song_id AND f.pitch = g.pitch AND g.rn = f.rn + 1) f JOIN fg g ON f.song_id = g.song_id AND f.pitch = g.pitch AND g.rn = f.rn + 1)
 SELECT song_id, pitch, head AS note_id, max(z) AS offset_us, CAST(count(*) - 1 AS INTEGER) AS merged FROM fo WHERE head IS NOT NULL GROUP BY ALL""")
def d9_merge_fragments(spark, d):
    n = F.col("note_id")
    notes = X.notes_ref(spark, d).withColumn("offset_us", F.col("offset_us") + 300_000).withColumn("attack", n % 4 == 0).withColumn("evidence", n % 3 != 0)
    return folds.merge_fragments(notes, short_us=400_000).select("song_id", "pitch", "note_id", "offset_us", "merged")


@query(""", tp AS (SELECT song_id, start_us + (bar * 31 % 17 - 8) * 150000 AS t FROM br WHERE bar % 9 = 4), tr AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY t) AS rn FROM tp),
 ta AS (SELECT DISTINCT song_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS t, CAST(NULL AS BIGINT) AS bar, CAST(-9999999 AS BIGINT) AS last FROM tr UNION ALL SELECT song_id, rn, t, b, coalesce(b, last) FROM
  (SELECT a.song_id, r.rn, r.t, a.last, (SELECT min_by(br.bar, abs(br.start_us - r.t) * 100000 + br.bar) FROM br WHERE br.song_id = a.song_id AND br.bar > a.last) AS b FROM ta a JOIN tr r ON a.song_id = r.song_id AND r.rn = a.rn + 1))
 SELECT song_id, t AS t_us, bar FROM ta WHERE rn > 0""")
def t9_assign_taps(spark, d):
    bars = X.bars(spark, d)
    taps = bars.where("bar % 9 = 4").select("song_id", (F.col("start_us") + (F.col("bar") * 31 % 17 - 8) * 150_000).cast("long").alias("t_us"))
    return folds.assign_taps(taps, bars.select("song_id", "bar", F.col("start_us").cast("long").alias("t_us")))


@query(""", se AS (SELECT song_id, section, 100.0 + (song_id * 7 + section * 13) % 11 AS bpm, row_number() OVER (PARTITION BY song_id ORDER BY section) AS rn FROM sc),
 wt AS (SELECT DISTINCT song_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS section, CAST(NULL AS DOUBLE) AS bpm, FALSE AS written, CAST(NULL AS DOUBLE) AS now FROM se UNION ALL SELECT w.song_id, s.rn, s.section, s.bpm, w.now IS NULL OR abs(s.bpm - w.now) > 0.03 * w.now, CASE WHEN w.now IS NULL OR abs(s.bpm - w.now) > 0.03 * w.now THEN s.bpm ELSE w.now END
  FROM wt w JOIN se s ON w.song_id = s.song_id AND s.rn = w.rn + 1) SELECT song_id, section, bpm, written FROM wt WHERE rn > 0""")
def w42_written_tempi(spark, d):
    s = X.sections(spark, d)
    return folds.written_tempi(s.select("song_id", "section", (100.0 + (F.col("song_id") * 7 + F.col("section") * 13) % 11).cast("double").alias("bpm")))


@query()
def w35_refine_beats(spark, d):
    onsets = X.notes_ref(spark, d).select("song_id", "onset_us", ((F.col("offset_us") - F.col("onset_us")) / 1000.0).alias("strength"))
    return folds.refine_beats(X.beats(spark, d), onsets)


@query()
def g19_drifting_offsets(spark, d):
    bars = X.notes_ref(spark, d).select("song_id", F.expr("onset_us div 2000000").alias("bar"), "pitch")
    est = X.notes_est(spark, d).select("song_id", (F.expr("onset_us div 2000000") + F.when(F.col("onset_us") > 360_000_000, 1).otherwise(0)).alias("bar"), "pitch")
    shifted = est.withColumn("shift", F.explode(F.sequence(F.lit(-2), F.lit(2)))).withColumn("bar", F.col("bar") + F.col("shift"))
    e = shifted.groupBy("song_id", "shift", "bar", "pitch").agg(F.count("*").alias("e"))
    r = bars.groupBy("song_id", "bar", "pitch").agg(F.count("*").alias("r"))
    tp = e.join(r, ["song_id", "bar", "pitch"]).groupBy("song_id", "shift", F.floor(F.col("bar") / 8).alias("block")).agg(F.sum(F.least("e", "r")).alias("tp"))
    ne = e.groupBy("song_id", "shift", F.floor(F.col("bar") / 8).alias("block")).agg(F.sum("e").alias("ne"))
    n_r = r.groupBy("song_id", F.floor(F.col("bar") / 8).alias("block")).agg(F.sum("r").alias("notes"))
    scores = ne.join(n_r, ["song_id", "block"]).join(tp, ["song_id", "shift", "block"], "left").select("song_id", "block", "notes", "shift", F.round(2 * F.coalesce("tp", F.lit(0)) / (F.col("ne") + F.col("notes")), 9).alias("f1"))
    start = X.songs(spark, d).select("song_id", F.lit(0).alias("shift"))
    return folds.drifting_offsets(scores, start, least=10)


@query()
def w26_select_spread_windows(spark, d):
    w = T.windowed(spark, d).groupBy("song_id", "w", "label").agg(F.count("*").cast("double").alias("score"))
    spans = T.spans(spark, d)
    return folds.spread_windows(w.join(spans.drop("label"), ["song_id", "w"]).withColumnRenamed("w", "window"))


@query(""", ac AS (SELECT song_id, s AS start_us, count(*) AS n, count(DISTINCT instrument) AS kinds, list_sort(list(DISTINCT instrument)) AS cats FROM (SELECT *, unnest(generate_series(onset_us // 5000000 - 14, onset_us // 5000000)) * 5000000 AS s FROM nr) WHERE s >= 0 GROUP BY ALL),
 f1 AS (SELECT * FROM ac QUALIFY row_number() OVER (PARTITION BY song_id ORDER BY kinds DESC, n DESC, start_us) = 1), f2 AS (SELECT a.*, len(list_filter(a.cats, lambda c: NOT list_contains(f.cats, c))) AS more FROM ac a JOIN f1 f ON a.song_id = f.song_id AND abs(a.start_us - f.start_us) >= 75000000)
 SELECT song_id, 1 AS place, start_us, n FROM f1 UNION ALL SELECT song_id, 2, start_us, n FROM (SELECT * FROM f2 QUALIFY row_number() OVER (PARTITION BY song_id ORDER BY more DESC, n DESC, start_us) = 1)""")
def w27_select_rich_windows(spark, d):
    """The richest window of 75 s in steps of 5 s, and the best one apart from it that adds a kind."""
    at = F.expr("onset_us div 5000000")
    rows = X.notes_ref(spark, d).withColumn("step", F.explode(F.sequence(at - 14, at))).withColumn("start_us", F.col("step") * 5_000_000).where("start_us >= 0")
    ac = rows.groupBy("song_id", "start_us").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("instrument")).alias("cats"))
    first = ac.withColumn("k", F.row_number().over(Window.partitionBy("song_id").orderBy(F.desc(F.size("cats")), F.desc("n"), "start_us"))).where("k = 1")
    f = first.select("song_id", F.col("start_us").alias("f_start"), F.col("cats").alias("f_cats"))
    other = ac.join(f, "song_id").where(F.abs(F.col("start_us") - F.col("f_start")) >= 75_000_000)
    place = F.row_number().over(Window.partitionBy("song_id").orderBy(F.desc(F.size(F.array_except("cats", "f_cats"))), F.desc("n"), "start_us"))
    second = other.withColumn("k", place).where("k = 1")
    return first.select("song_id", F.lit(1).alias("place"), "start_us", "n").unionByName(second.select("song_id", F.lit(2).alias("place"), "start_us", "n"))


@query("""WITH RECURSIVE k AS (SELECT o_custkey AS c, CAST(floor(o_totalprice) AS BIGINT) AS p FROM orders), e AS (SELECT DISTINCT least(a.c, b.c) AS a, greatest(a.c, b.c) AS b FROM k a JOIN k b ON a.p = b.p AND a.c <> b.c), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
 r AS (SELECT DISTINCT a AS node, a AS root FROM u UNION SELECT u.b, r.root FROM r JOIN u ON r.node = u.a WHERE r.root < u.b) SELECT node, min(root) AS take, count(*) OVER (PARTITION BY min(root)) AS size FROM r GROUP BY node""", cte=False)
def d14_connected_takes(spark, d):
    """Customers with orders of one price are taken as one take."""
    quality.checkpoint_folder(spark)
    k = X.table(spark, d, "orders").select(F.col("o_custkey").alias("c"), F.floor("o_totalprice").alias("p"))
    hub = k.groupBy("p").agg(F.min("c").alias("a"))
    return lineage.connected_takes(k.join(hub, "p").where("c <> a").select("a", F.col("c").alias("b")).distinct())


@query(""", q AS (SELECT a.song_id, a.line, a.note_id, EXISTS (SELECT 1 FROM ne b WHERE b.song_id = a.song_id AND b.pitch = a.pitch AND b.line = 0 AND abs(b.onset_us - a.onset_us) <= 50000) AS x, EXISTS (SELECT 1 FROM ne b WHERE b.song_id = a.song_id AND b.pitch = a.pitch AND abs(b.onset_us - a.onset_us) <= 50000) AS y FROM nr a)
 SELECT song_id, line, count(*) AS n, round(count_if(x) / count(*), 6) AS share, round(count_if(y) / count(*), 6) AS share_any FROM q GROUP BY song_id, line""")
def g34_pair_stats(spark, d):
    ref, est = X.notes_ref(spark, d), X.notes_est(spark, d)
    some = lambda df, name: match.near(ref, df, ["song_id", "pitch"], 50_000, "left_semi").select("note_id", F.lit(1).alias(name))
    rows = ref.join(some(est.where("line = 0"), "x"), "note_id", "left").join(some(est, "y"), "note_id", "left")
    return rows.groupBy("song_id", "line").agg(F.count("*").alias("n"), F.round(F.count("x") / F.count("*"), 6).alias("share"), F.round(F.count("y") / F.count("*"), 6).alias("share_any"))


@query(""" SELECT a.note_id FROM nr a WHERE line = 0 AND NOT EXISTS (SELECT 1 FROM nr b WHERE b.song_id = a.song_id AND b.line = 1 AND abs(b.pitch - a.pitch) <= 2 AND abs(b.onset_us - a.onset_us) <= 300000)""")
def w44_lead_minus_side(spark, d):
    n = X.notes_ref(spark, d)
    side = n.where("line = 1").select("song_id", "note_id", "onset_us", F.explode(F.array(*[F.col("pitch") + k for k in range(-2, 3)])).alias("pitch"))
    return match.near(n.where("line = 0"), side, ["song_id", "pitch"], 300_000, "left_anti").select("note_id")


@query(""" SELECT note_id FROM nr a WHERE instrument <> 'purchase' AND (note_id % 3 <> 0 OR NOT EXISTS (SELECT 1 FROM nr k WHERE k.song_id = a.song_id AND k.instrument = 'purchase' AND abs(k.onset_us - a.onset_us) <= 30000))""")
def w21_kick_reject(spark, d):
    """Purchases stand for kicks; notes near one without evidence (every third) go."""
    n = X.notes_ref(spark, d)
    rows, kicks = n.where("instrument <> 'purchase'"), n.where("instrument = 'purchase'")
    weak = rows.where("note_id % 3 = 0")
    return rows.where("note_id % 3 <> 0").select("note_id").unionByName(match.near(weak, kicks, ["song_id"], 30_000, "left_anti").select("note_id"))


@query("SELECT p_brand AS backend, p_size % 3 AS rung, round(median(p_retailprice), 6) AS med, count(*) AS n, round(any_value(c), 6) AS context FROM (SELECT *, median(p_retailprice) OVER (PARTITION BY p_brand) AS c FROM part WHERE p_size > 5) GROUP BY p_brand, p_size % 3", cte=False)
def g40_bench_medians(spark, d):
    rows = X.table(spark, d, "part").where("p_size > 5").select(F.col("p_brand").alias("backend"), (F.col("p_size") % 3).alias("rung"), "p_retailprice")
    context = rows.groupBy("backend").agg(F.round(F.percentile("p_retailprice", F.lit(0.5)), 6).alias("context"))
    return rows.groupBy("backend", "rung").agg(F.round(F.percentile("p_retailprice", F.lit(0.5)), 6).alias("med"), F.count("*").alias("n")).join(context, "backend").select("backend", "rung", "med", "n", "context")


@query("SELECT o_custkey AS song_id, count(*) AS stages, round(sum(o_totalprice), 2) AS seconds, CAST(count_if(o_orderstatus = 'F') AS BIGINT) AS cached, bool_or(o_orderkey % 13 = 0) AS degraded, CAST(count_if(o_orderkey % 17 = 0) AS BIGINT) AS warnings FROM orders GROUP BY 1", cte=False)
def g41_run_summary(spark, d):
    k = F.col("o_orderkey")
    o = X.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("song_id"))
    return o.agg(F.count("*").alias("stages"), F.round(F.sum("o_totalprice"), 2).alias("seconds"), F.count_if(F.col("o_orderstatus") == "F").alias("cached"), F.bool_or(k % 13 == 0).alias("degraded"), F.count_if(k % 17 == 0).alias("warnings"))


@query(" SELECT song_id, pitch, greatest(coalesce(a, 0), coalesce(b, 0)) AS n FROM (SELECT song_id, pitch, count(*) AS a FROM nr GROUP BY ALL) FULL JOIN (SELECT song_id, pitch, count(*) AS b FROM ne GROUP BY ALL) USING (song_id, pitch)")
def s4_bag_union(spark, d):
    n = lambda df, c: df.groupBy("song_id", "pitch").agg(F.count("*").alias(c))
    both = n(X.notes_ref(spark, d), "a").join(n(X.notes_est(spark, d), "b"), ["song_id", "pitch"], "full")
    return both.select("song_id", "pitch", F.greatest(F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))).alias("n"))


@query(" SELECT song_id, array_to_string(list_sort(list_filter(p, lambda x: NOT list_contains(f, x))), ',') AS added, len(list_intersect(p, f)) AS shared FROM (SELECT song_id, list(DISTINCT pitch) AS p, list(DISTINCT pitch) FILTER (onset_us < 360000000) AS f FROM nr GROUP BY 1) WHERE f IS NOT NULL")
def s5_set_difference(spark, d):
    """Pitches that a song has only after its first half, and how many it has in both."""
    n = X.notes_ref(spark, d).groupBy("song_id").agg(F.collect_set("pitch").alias("p"), F.collect_set(F.when(F.col("onset_us") < 360_000_000, F.col("pitch"))).alias("f"))
    return n.where(F.size("f") > 0).select("song_id", F.array_join(F.array_sort(F.array_except("p", "f")), ",").alias("added"), F.size(F.array_intersect("p", "f")).cast("long").alias("shared"))


@query(" SELECT song_id, note_id FROM (SELECT song_id, note_id, row_number() OVER (PARTITION BY song_id ORDER BY sha256('7:' || note_id), note_id) AS k FROM nr WHERE line = 1) WHERE k <= 20")
def s7_sample_anchors(spark, d):
    n = X.notes_ref(spark, d).where("line = 1")
    return sequence.top_rows(n.withColumn("h", F.sha2(F.concat(F.lit("7:"), F.col("note_id").cast("string")), 256)), ["song_id"], [F.col("h"), F.col("note_id")], 20).select("song_id", "note_id")


@query(" SELECT n.note_id, n.line, e.pitch AS edited FROM (SELECT * FROM nr WHERE offset_us - onset_us >= 60000) n LEFT JOIN (SELECT note_id, pitch FROM ne WHERE note_id % 20 = 1) e USING (note_id)")
def j19_join_kept_index(spark, d):
    """Edits find their note by its id, whatever a filter has left out before it."""
    kept = X.notes_ref(spark, d).where("offset_us - onset_us >= 60000")
    edits = X.notes_est(spark, d).where("note_id % 20 = 1").select("note_id", F.col("pitch").alias("edited"))
    return kept.join(edits, "note_id", "left").select("note_id", "line", "edited")


@query(""", nt AS (SELECT a.note_id, a.onset_us // 1000000 AS c, a.song_id, CASE WHEN note_id % 10 = 0 THEN 'fn' ELSE 'fp' END AS kind FROM nr a WHERE note_id % 10 IN (0, 3)), be AS (SELECT song_id, onset_us // 1000000 AS c, instrument, sum(offset_us - onset_us) AS e FROM nr GROUP BY ALL),
 dm AS (SELECT nt.note_id, nt.kind, be.instrument, be.e, sum(be.e) OVER (PARTITION BY nt.note_id) AS total, row_number() OVER (PARTITION BY nt.note_id ORDER BY be.e DESC, be.instrument) AS k FROM nt JOIN be ON nt.song_id = be.song_id AND nt.c = be.c)
 SELECT note_id, kind, CASE WHEN e < 50000 THEN 'unknown' WHEN instrument = 'click' THEN kind || '_guitar' ELSE kind || '_' || instrument END AS cause, round(e / total, 6) AS share FROM dm WHERE k = 1""")
def j11_attach_energy_cause(spark, d):
    """The strongest category in the second of a missed or extra note names its cause, above a floor."""
    n, cell = X.notes_ref(spark, d), F.expr("onset_us div 1000000").alias("c")
    bad = n.where("note_id % 10 in (0, 3)").select("note_id", "song_id", cell, F.when(F.col("note_id") % 10 == 0, "fn").otherwise("fp").alias("kind"))
    energy = n.groupBy("song_id", cell, "instrument").agg(F.sum(F.col("offset_us") - F.col("onset_us")).alias("e"))
    g = bad.join(energy, ["song_id", "c"]).groupBy("note_id", "kind").agg(F.min_by(F.struct("instrument", "e"), F.struct(-F.col("e"), "instrument")).alias("top"), F.sum("e").alias("total"))
    cause = F.when(F.col("top.e") < 50_000, "unknown").when(F.col("top.instrument") == "click", F.concat("kind", F.lit("_guitar"))).otherwise(F.concat_ws("_", "kind", "top.instrument"))
    return g.select("note_id", "kind", cause.alias("cause"), F.round(F.col("top.e") / F.col("total"), 6).alias("share"))


@query(""" SELECT note_id, 40 + [0, 5, 10, 15, 19, 24][CAST(6 - s + 1 AS INTEGER)] + f + CASE WHEN song_id % 3 = 1 THEN 2 ELSE 0 END - CASE WHEN song_id % 3 = 2 THEN 1 ELSE 0 END AS sounding FROM (SELECT note_id, song_id, note_id % 6 + 1 AS s, pitch % 12 AS f FROM nr)""")
def p13_sheet_tuning_pitch(spark, d):
    """String and fret as a sounding pitch: songs are as written, with a capo on 2, or tuned down a half step."""
    tuning = F.transform(F.array(*[F.lit(x) for x in (40, 45, 50, 55, 59, 64)]), lambda x: x - F.when(F.col("song_id") % 3 == 2, 1).otherwise(0))
    open_ = F.element_at(tuning, (6 - (F.col("note_id") % 6 + 1) + 1).cast("int"))
    return X.notes_ref(spark, d).select("note_id", (open_ + F.col("pitch") % 12 + F.when(F.col("song_id") % 3 == 1, 2).otherwise(0)).alias("sounding"))


GATE = "CASE WHEN low IS NULL OR high IS NULL THEN 'hold' WHEN high < 0 THEN 'reject' WHEN low <= 0 THEN 'hold' WHEN worst < -2 OR delta < 1 THEN 'reject' ELSE 'adopt' END"


@query(f"SELECT p_partkey, {GATE} AS decision, coalesce(low > -0.5, FALSE) AS non_inferior FROM (SELECT p_partkey, (p_size - 20) / 5.0 AS delta, CASE WHEN p_partkey % 17 <> 0 THEN (p_size - 20) / 5.0 - p_partkey % 7 / 3.0 END AS low, (p_size - 20) / 5.0 + p_partkey % 7 / 3.0 AS high, 3 - p_partkey % 9 AS worst FROM part)", cte=False)
def p14_gate_decision(spark, d):
    k, delta = F.col("p_partkey"), (F.col("p_size") - 20) / 5.0
    low, high = F.when(k % 17 != 0, delta - k % 7 / 3.0), delta + k % 7 / 3.0
    decision = S.gate_decision(delta, low, high, 1.0, F.array(3 - k % 9))
    return X.table(spark, d, "part").select("p_partkey", decision.alias("decision"), S.non_inferior(low, -0.5).alias("non_inferior"))


@query()
def p12_stable_seed(spark, d):
    """The seed of an item: the crc32 of its name."""
    return X.table(spark, d, "documents").select("doc_id", S.stable_seed(F.col("doc_id")).alias("seed"))


@query(""", g AS (SELECT song_id, count_if(line = 0)::BIGINT AS tp, count_if(line = 1)::BIGINT AS fp, count_if(line = 2)::BIGINT AS fn FROM nr GROUP BY 1), b AS (SELECT 'majority' AS baseline, song_id, max(n)::BIGINT AS hit, sum(n)::BIGINT AS n FROM (SELECT song_id, line, count(*) AS n FROM nr GROUP BY ALL) GROUP BY song_id
 UNION ALL SELECT 'no_split', song_id, count_if(line = 0)::BIGINT, count(*) FROM nr GROUP BY song_id UNION ALL SELECT 'class_filtered', song_id, count_if(line = 0)::BIGINT, count(*) FROM nr WHERE instrument IN ('click', 'view') GROUP BY song_id) SELECT baseline, song_id, hit, n, round(hit / n, 6) AS share FROM b""")
def g8_baselines(spark, d):
    n = X.notes_ref(spark, d)
    most = n.groupBy("song_id", "line").agg(F.count("*").alias("n")).groupBy("song_id").agg(F.max("n").alias("hit"), F.sum("n").alias("n")).select(F.lit("majority").alias("baseline"), "song_id", "hit", "n")
    one = lambda df, name: df.groupBy("song_id").agg(F.count_if(F.col("line") == 0).alias("hit"), F.count("*").alias("n")).select(F.lit(name).alias("baseline"), "song_id", "hit", "n")
    rows = most.unionByName(one(n, "no_split")).unionByName(one(n.where("instrument in ('click', 'view')"), "class_filtered"))
    return rows.withColumn("share", F.round(F.col("hit") / F.col("n"), 6))


@query()
def l12_evaluate_experiment(spark, d):
    """arm, dev_f1, chosen, delta, low, high, decision: the best arm on even groups is confirmed against the baseline on odd ones."""
    return metrics.evaluate_arms(items(spark, d), "arm", "grp", "O")


@query(LINKS + """, ed AS (SELECT note_id AS seq, note_id, (line + 1) % 3 AS too FROM nr WHERE note_id % 6 = 0), ow AS (SELECT note_id, max_by(too, seq) AS own FROM ed GROUP BY 1), sp AS (SELECT lk.b AS note_id, max_by(too, seq) AS spread FROM ed JOIN lk ON ed.note_id = lk.a GROUP BY 1)
 SELECT n.note_id, coalesce(own, spread, line) AS line, CASE WHEN own IS NOT NULL THEN 'explicit' WHEN spread IS NOT NULL THEN 'spread' ELSE 'kept' END AS how FROM nr n LEFT JOIN ow ON n.note_id = ow.note_id LEFT JOIN sp ON n.note_id = sp.note_id""")
def l3_spread_part(spark, d):
    n = X.notes_ref(spark, d)
    edits = n.where("note_id % 6 = 0").select("song_id", F.col("note_id").alias("seq"), "note_id", ((F.col("line") + 1) % 3).alias("to"))
    return replay.spread_part(n, edits, links(spark, d))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT o_orderkey AS child, o_orderkey // 2 AS parent, o_custkey % 4 AS stage FROM orders WHERE o_orderkey > 1), k AS (SELECT o_orderkey AS node FROM orders WHERE o_orderkey % 500 = 7), c AS (SELECT node AS export, node, 0 AS depth FROM k UNION SELECT c.export, e.parent, c.depth + 1 FROM c JOIN e ON c.node = e.child)
 SELECT export, o_custkey % 4 AS stage, min_by(node, depth * 100000000 + node) AS artifact, min(depth) AS depth FROM c JOIN orders ON node = o_orderkey GROUP BY export, o_custkey % 4""", cte=False)
def l8_artifact_of_export(spark, d):
    """Of what an export depends on, the nearest artifact of each stage."""
    quality.checkpoint_folder(spark)
    o = X.table(spark, d, "orders")
    edges = o.where("o_orderkey > 1").select(F.col("o_orderkey").alias("child"), F.expr("o_orderkey div 2").alias("parent"))
    start = o.where("o_orderkey % 500 = 7").select(F.col("o_orderkey").alias("export"))
    return lineage.artifacts(start, edges, o.select(F.col("o_orderkey").alias("node"), (F.col("o_custkey") % 4).alias("stage")))


@query("SELECT o_custkey AS song_id, CASE WHEN count_if(o_orderkey % 3 = 0) = 0 THEN 'up to date' WHEN bool_or(o_orderkey % 3 = 0 AND o_orderkey % 9 = 0) THEN 'skip: costly' ELSE 'recompute' END AS plan, array_to_string(list_sort(list(DISTINCT o_orderkey % 8) FILTER (o_orderkey % 3 = 0)), ',') AS stages FROM orders GROUP BY 1", cte=False)
def l17_refresh_plan(spark, d):
    """Keys divisible by 3 are stale, those by 9 are costly."""
    k = F.col("o_orderkey")
    g = X.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("song_id")).agg(F.count_if(k % 3 == 0).alias("stale"), F.bool_or(k % 9 == 0).alias("costly"), F.array_sort(F.collect_set(F.when(k % 3 == 0, k % 8))).alias("s"))
    plan = F.when(F.col("stale") == 0, "up to date").when(F.col("costly"), "skip: costly").otherwise("recompute")
    return g.select("song_id", plan.alias("plan"), F.when(F.size("s") > 0, F.array_join("s", ",")).alias("stages"))


def confidence_rows(spark, d):
    x = statements.apply("part_features", signed=X.notes_ref(spark, d).join(X.signatures(spark, d), "note_id"))
    hit = match.near(X.notes_ref(spark, d), X.notes_est(spark, d), ["song_id", "pitch"], 20_000, "left_semi").select("note_id", F.lit(1.0).alias("y"))
    return X.notes_ref(spark, d).select("song_id", "note_id").join(x, "note_id").join(hit, "note_id", "left").fillna(0.0, ["y"])


@query()
def m1_score_confidence(spark, d):
    """song_id, notes, mean_p, mean_y, ece: notes are scored by a model of all other songs."""
    return confidence.held_out_report(confidence_rows(spark, d), ["same_side", "rel_pitch", "is_click", "is_view", "poly"], "song_id")


@query()
def m2_part_confidence(spark, d):
    """The same model on features of a part."""
    return confidence.held_out_report(confidence_rows(spark, d), ["ild_z", "same_side", "rel_pitch", "is_purchase"], "song_id")
