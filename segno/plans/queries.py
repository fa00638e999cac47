"""Queries over the given tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import scalars as S
from ..operators import cluster, lineage, match, metrics, sequence, timeline
from ..sources import fixtures as X
from ..sources import quality

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str = "", cte: bool = True):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (X.CTE + sql) if cte else sql
        return f

    return keep


SPANS = ", sp AS (SELECT * FROM (SELECT song_id, beat_no, t_us, lead(t_us) OVER (PARTITION BY song_id ORDER BY t_us) AS n_us FROM bt) WHERE n_us IS NOT NULL)"
POS = SPANS + """, fs AS (SELECT song_id, min(t_us) AS f FROM sp GROUP BY 1),
 tp AS (SELECT n.*, s.beat_no + (n.onset_us - s.t_us) / (s.n_us - s.t_us) AS beat_pos FROM (SELECT nr.*, greatest(onset_us, f) AS g FROM nr JOIN fs USING (song_id)) n ASOF JOIN sp s ON n.song_id = s.song_id AND n.g >= s.t_us)"""


@query(POS + " SELECT note_id, round(beat_pos, 6) AS beat_pos FROM tp")
def t1_time_to_beat(spark, d):
    return timeline.time_to_beat(X.notes_ref(spark, d), X.beats(spark, d)).select("note_id", F.round("beat_pos", 6).alias("beat_pos"))


@query("""SELECT p.song_id, p.beat_pos, round(a.t_us + (p.beat_pos - a.beat_no) * (b.t_us - a.t_us), 6) AS t_us
  FROM (SELECT song_id, x + 0.25 AS beat_pos, least(x, 1438) AS k FROM sg, range(1440) AS r(x)) p JOIN bt a ON a.song_id = p.song_id AND a.beat_no = p.k JOIN bt b ON b.song_id = p.song_id AND b.beat_no = p.k + 1""")
def t2_beat_to_time(spark, d):
    points = X.beats(spark, d).select("song_id", (F.col("beat_no") + 0.25).alias("beat_pos"))
    return timeline.beat_to_time(points, X.beats(spark, d)).select("song_id", "beat_pos", F.round("t_us", 6).alias("t_us"))


@query(POS + """ SELECT note_id, b.bar, round((beat_pos - b.beat_no) * 48, 6) AS tick FROM tp ASOF JOIN (SELECT * FROM bt WHERE beat = 1) b ON tp.song_id = b.song_id AND tp.beat_pos >= b.beat_no""")
def t3_time_to_bar_tick(spark, d):
    return timeline.time_to_bar_tick(X.notes_ref(spark, d), X.beats(spark, d)).select("note_id", "bar", "tick")


@query(SPANS + " SELECT note_id, round(48 * 1e6 / (s.n_us - s.t_us), 6) AS ticks_per_s FROM nr ASOF JOIN sp s ON nr.song_id = s.song_id AND nr.onset_us >= s.t_us")
def t5_local_tick_rate(spark, d):
    return timeline.local_tick_rate(X.notes_ref(spark, d), X.beats(spark, d)).select("note_id", "ticks_per_s").where("ticks_per_s is not null")


@query("""SELECT note_id, CASE WHEN onset_us < w.end_us THEN w."window" END AS "window", CASE WHEN onset_us < w.end_us THEN w.label END AS label FROM nr ASOF LEFT JOIN wn w ON nr.song_id = w.song_id AND nr.onset_us >= w.start_us""")
def t10_window_of(spark, d):
    return timeline.window_of(X.notes_ref(spark, d), X.windows(spark, d)).select("note_id", "window", "label")


@query("""SELECT note_id FROM ne a WHERE EXISTS (SELECT 1 FROM nr b WHERE a.song_id = b.song_id AND a.pitch = b.pitch AND abs(a.onset_us - b.onset_us) <= 50000)""")
def j1_exists_within(spark, d):
    return match.near(X.notes_est(spark, d), X.notes_ref(spark, d), ["song_id", "pitch"], 50_000, "left_semi").select("note_id")


@query("""SELECT note_id FROM ne a WHERE NOT EXISTS (SELECT 1 FROM nr b WHERE a.song_id = b.song_id AND a.pitch = b.pitch AND abs(a.onset_us - b.onset_us) <= 50000)""")
def j2_unmatched_within(spark, d):
    return match.near(X.notes_est(spark, d), X.notes_ref(spark, d), ["song_id", "pitch"], 50_000, "left_anti").select("note_id")


@query("""SELECT note_id, residual_us FROM (SELECT a.note_id, a.onset_us - b.onset_us AS residual_us, row_number() OVER (PARTITION BY a.note_id ORDER BY abs(a.onset_us - b.onset_us), b.onset_us) AS k
  FROM ne a JOIN nr b ON a.song_id = b.song_id AND a.pitch = b.pitch AND abs(a.onset_us - b.onset_us) <= 100000) WHERE k = 1""")
def j3_nearest_within(spark, d):
    return match.nearest_within(X.notes_est(spark, d), X.notes_ref(spark, d), ["song_id", "pitch"], 100_000)


MATCH = """, ev AS (SELECT *, row_number() OVER (PARTITION BY song_id, pitch ORDER BY t, side) AS rn FROM (SELECT song_id, pitch, onset_us AS t, 0 AS side FROM nr UNION ALL SELECT song_id, pitch, onset_us, 1 FROM ne)),
 fo AS (SELECT song_id, pitch, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS tp, CAST([] AS STRUCT(t BIGINT, side INTEGER)[]) AS op FROM ev GROUP BY ALL
  UNION ALL SELECT song_id, pitch, rn, CASE WHEN len(keep) > 0 AND keep[1].side <> side THEN tp + 1 ELSE tp END, CASE WHEN len(keep) > 0 AND keep[1].side <> side THEN keep[2:] ELSE list_append(keep, {'t': t, 'side': side}) END
  FROM (SELECT e.*, f.tp, list_filter(f.op, lambda o: o.t >= e.t - 50000) AS keep FROM fo f JOIN ev e ON e.song_id = f.song_id AND e.pitch = f.pitch AND e.rn = f.rn + 1)),
 mc AS (SELECT song_id, pitch, max(tp) AS tp FROM fo GROUP BY ALL), nn AS (SELECT song_id, pitch, count_if(side = 0)::BIGINT AS n_ref, count_if(side = 1)::BIGINT AS n_est FROM ev GROUP BY ALL)"""


def matched(spark, d):
    return match.match_count(X.notes_ref(spark, d), X.notes_est(spark, d), ["song_id", "pitch"], 50_000)


@query(MATCH + " SELECT song_id, pitch, tp, n_ref, n_est FROM mc JOIN nn USING (song_id, pitch)")
def j4_match_count(spark, d):
    return matched(spark, d)


PRF = "round(CASE WHEN tp + fp + fn = 0 THEN 1 WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fp + fn = 0 THEN 1 WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall, round(CASE WHEN tp + fp + fn = 0 THEN 1 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1"


@query(MATCH + f" SELECT song_id, tp, fp, fn, {PRF} FROM (SELECT song_id, sum(tp)::BIGINT AS tp, (sum(n_est) - sum(tp))::BIGINT AS fp, (sum(n_ref) - sum(tp))::BIGINT AS fn FROM mc JOIN nn USING (song_id, pitch) GROUP BY 1)")
def g1_note_prf(spark, d):
    return metrics.note_prf(matched(spark, d), ["song_id"])


BEATS_OF = """, e AS (SELECT song_id, beat_no, t_us FROM bt), iv AS (SELECT note_id, n.song_id, a.beat_no AS a, b.beat_no AS b, n.offset_us, b.t_us AS bt_us FROM nr n ASOF JOIN e a ON n.song_id = a.song_id AND n.onset_us >= a.t_us ASOF JOIN e b ON n.song_id = b.song_id AND n.offset_us >= b.t_us)"""


@query(BEATS_OF + " SELECT DISTINCT iv.song_id, note_id, x // 4 + 1 AS bar FROM iv, range(1440) AS r(x) WHERE x >= a AND x <= CASE WHEN b > a AND offset_us = bt_us THEN b - 1 ELSE b END")
def j14_notes_in_bars(spark, d):
    return match.notes_in_bars(X.notes_ref(spark, d), X.beats(spark, d))


@query("""SELECT o_orderkey, o_orderstatus, c_nationkey, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""", cte=False)
def j17_keyed_join(spark, d):
    o, c, n = (X.table(spark, d, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select("o_orderkey", "o_orderstatus", "c_nationkey", "n_name")


@query("SELECT d.doc_id, coalesce(CASE l.quality WHEN 1 THEN 'clean' WHEN 0 THEN 'contaminated' END, 'unknown') AS status FROM documents d LEFT JOIN labels l USING (doc_id)", cte=False)
def j18_lookup_status(spark, d):
    rows = X.table(spark, d, "documents").select("doc_id").join(X.table(spark, d, "labels"), "doc_id", "left")
    return rows.select("doc_id", F.coalesce(F.when(F.col("quality") == 1, "clean").when(F.col("quality") == 0, "contaminated"), F.lit("unknown")).alias("status"))


def anchored(keys: str) -> str:
    on = " AND ".join(f"a.{k} = n.{k}" for k in keys.split(", "))
    return f""", an AS (SELECT {keys}, min(onset_us) AS a FROM nr GROUP BY {keys} UNION ALL SELECT {', '.join('n.' + k for k in keys.split(', '))}, min(n.onset_us) FROM an a JOIN nr n ON {on} AND n.onset_us > a.a + 35000 GROUP BY {', '.join('n.' + k for k in keys.split(', '))}, a.a),
 cl AS (SELECT n.*, a.a AS anchor_us FROM nr n ASOF JOIN an a ON {on} AND n.onset_us >= a.a)"""


@query(anchored("song_id") + " SELECT note_id, anchor_us FROM cl")
def d1_anchored_clusters(spark, d):
    return cluster.anchored_clusters(X.notes_ref(spark, d), ["song_id"], 35_000).select("note_id", "anchor_us")


@query(""" SELECT note_id, CAST(sum(CASE WHEN g > 35000 THEN 1 ELSE 0 END) OVER (PARTITION BY song_id, pitch ORDER BY onset_us, note_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS part
  FROM (SELECT *, onset_us - lag(onset_us) OVER (PARTITION BY song_id, pitch ORDER BY onset_us, note_id) AS g FROM nr)""")
def d2_chain_components(spark, d):
    return cluster.chain_components(X.notes_ref(spark, d), ["song_id", "pitch"], 35_000).select("note_id", "part")


@query(anchored("song_id, pitch") + " SELECT song_id, pitch, anchor_us, string_agg(DISTINCT CAST(line AS VARCHAR), ',' ORDER BY CAST(line AS VARCHAR)) AS lines, count(*) AS n, count(DISTINCT line) > 1 AS shared FROM cl GROUP BY ALL")
def d3_dedupe_events(spark, d):
    return cluster.dedupe_events(X.notes_ref(spark, d), 35_000)


@query(anchored("song_id, pitch") + " SELECT song_id, pitch, anchor_us, arg_min(note_id, onset_us * 1000000 + note_id) AS note_id, max(offset_us) AS offset_us, count(*) AS n FROM cl GROUP BY ALL")
def d4_merge_unison(spark, d):
    return cluster.merge_unison(X.notes_ref(spark, d), 35_000)


@query(anchored("song_id, line") + " SELECT song_id, line, anchor_us, arg_min(note_id, pitch * 1000000000000000 + onset_us * 1000000 + note_id) AS note_id, min(pitch) AS pitch, max(offset_us) AS offset_us FROM cl GROUP BY ALL")
def d6_lowest_of_bundle(spark, d):
    return cluster.lowest_of_bundle(X.notes_ref(spark, d), 35_000)


@query(" SELECT note_id, offset_us - onset_us >= 60000 AS kept FROM nr")
def d7_drop_short(spark, d):
    return X.notes_ref(spark, d).select("note_id", (F.col("offset_us") - F.col("onset_us") >= 60_000).alias("kept"))


@query(""" SELECT song_id, min(onset_us) AS start_us, max(offset_us) AS end_us, count(*) AS n FROM (SELECT *, sum(CASE WHEN onset_us - m <= 50000 THEN 0 ELSE 1 END) OVER (PARTITION BY song_id ORDER BY onset_us, offset_us ROWS UNBOUNDED PRECEDING) AS run
  FROM (SELECT *, max(offset_us) OVER (PARTITION BY song_id ORDER BY onset_us, offset_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM nr)) GROUP BY song_id, run""")
def d8_merge_spans(spark, d):
    spans = X.notes_ref(spark, d).select("song_id", F.col("onset_us").alias("start_us"), F.col("offset_us").alias("end_us"))
    return cluster.merge_spans(spans, ["song_id"], 50_000)


@query(""" SELECT song_id, label, min("window") AS first, max("window") AS last, count(*) AS n FROM (SELECT *, "window" - row_number() OVER (PARTITION BY song_id, label ORDER BY "window") AS g FROM (SELECT song_id, "window", label <> 'mixed' AS label FROM wn)) GROUP BY song_id, label, g HAVING count(*) >= 2""")
def d10_runs_of(spark, d):
    rows = X.windows(spark, d).select("song_id", "window", (F.col("label") != "mixed").alias("label"))
    return cluster.runs_of(rows, ["song_id"], "window", "label", 2)


@query(" SELECT pitch, CAST(pitch % 12 AS INTEGER) AS pitch_class, round(440 * pow(2.0, (pitch - 69) / 12), 6) AS hz, round(69 + 12 * log2(440 * pow(2.0, (pitch - 69) / 12) / 440), 6) AS midi FROM (SELECT DISTINCT pitch FROM nr)")
def p1_midi_hz(spark, d):
    p, hz = F.col("pitch"), S.midi_hz(F.col("pitch"))
    return X.notes_ref(spark, d).select("pitch").distinct().select("pitch", S.pitch_class(p).alias("pitch_class"), F.round(hz, 6).alias("hz"), F.round(S.hz_midi(hz), 6).alias("midi"))


@query(" SELECT note_id, greatest(0, onset_us - 3000) AS onset_us, greatest(0, offset_us - 3000) AS offset_us FROM nr")
def p4_apply_latency(spark, d):
    return X.notes_ref(spark, d).select("note_id", *[F.greatest(F.lit(0), F.col(c) - 3000).alias(c) for c in ("onset_us", "offset_us")])


@query("""SELECT p_partkey, CASE WHEN len(list_intersect(t, ['green', 'lime', 'olive'])) > 0 THEN 'green' WHEN len(list_intersect(t, ['blue', 'navy', 'sky'])) > 0 THEN 'blue' WHEN len(list_intersect(t, ['red', 'rose', 'salmon'])) > 0 THEN 'red' WHEN len(list_intersect(t, ['steel', 'brass', 'copper', 'tin', 'nickel'])) > 0 THEN 'metal' ELSE 'other' END AS category
  FROM (SELECT p_partkey, regexp_extract_all(lower(p_name || '_' || p_type || p_brand), '[a-z]+|[0-9]+') AS t FROM part)""", cte=False)
def p6_categorize_name(spark, d):
    tokens = F.regexp_extract_all(F.lower(F.concat("p_name", F.lit("_"), "p_type", "p_brand")), F.lit("[a-z]+|[0-9]+"), F.lit(0))
    rules = [("green", "green lime olive"), ("blue", "blue navy sky"), ("red", "red rose salmon"), ("metal", "steel brass copper tin nickel")]
    out = F.lit("other")
    for name, words in reversed(rules):
        out = F.when(F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in words.split()])), name).otherwise(out)
    return X.table(spark, d, "part").select("p_partkey", out.alias("category"))


@query(" SELECT song_id, anchor_us, count(DISTINCT pitch) AS n, CASE WHEN count(DISTINCT pitch) = 1 THEN 'single' WHEN count(DISTINCT pitch % 12) = 1 THEN 'octave' WHEN count(DISTINCT pitch % 12) = 2 AND max(pitch % 12) - min(pitch % 12) IN (5, 7) THEN 'power' WHEN count(DISTINCT pitch) = 2 THEN 'dyad' WHEN count(DISTINCT pitch) <= 4 THEN 'triad34' ELSE 'full56' END AS shape FROM cl GROUP BY ALL".join([anchored("song_id"), ""]))
def p10_chord_shape(spark, d):
    g = cluster.anchored_clusters(X.notes_ref(spark, d), ["song_id"], 35_000).groupBy("song_id", "anchor_us").agg(F.collect_set("pitch").alias("ps"))
    return g.select("song_id", "anchor_us", F.size("ps").cast("long").alias("n"), S.chord_shape(F.col("ps")).alias("shape"))


@query("SELECT doc_id, CASE WHEN CAST('0x' || substr(sha256('dev:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 2 = 0 THEN 'dev' ELSE 'test' END AS split FROM documents", cte=False)
def p12_hash_split(spark, d):
    h = F.conv(F.substring(F.sha2(F.concat(F.lit("dev:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("long")
    return X.table(spark, d, "documents").select("doc_id", F.when(h % 2 == 0, "dev").otherwise("test").alias("split"))


ITEMS = "WITH it AS (SELECT o_orderkey AS item, c_nationkey AS grp, o_orderstatus AS arm, CAST(floor(o_totalprice) AS BIGINT) % 97 AS tp, CAST(floor(o_totalprice) AS BIGINT) % 13 AS fp, CAST(floor(o_totalprice) AS BIGINT) % 11 AS fn FROM orders JOIN customer ON o_custkey = c_custkey)"


def items(spark, d):
    p = F.floor("o_totalprice").cast("long")
    rows = X.table(spark, d, "orders").join(X.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(F.col("o_orderkey").alias("item"), F.col("c_nationkey").alias("grp"), F.col("o_orderstatus").alias("arm"), (p % 97).alias("tp"), (p % 13).alias("fp"), (p % 11).alias("fn"))


@query(ITEMS + f", g AS (SELECT arm, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM it GROUP BY 1) SELECT arm, tp, fp, fn, {PRF} FROM g", cte=False)
def g11_pooled_stats(spark, d):
    g = items(spark, d).groupBy("arm").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    facts = [F.col(c) for c in ("tp", "fp", "fn")]
    return g.select("arm", *facts, *[F.round(f(*facts), 6).alias(n) for n, f in (("precision", S.precision), ("recall", S.recall), ("f1", S.f1))])


BOOT = ITEMS + """, gt AS (SELECT arm, grp, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM it GROUP BY ALL), pl AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY grp) - 1 AS place, count(*) OVER (PARTITION BY arm) AS n FROM gt),
 dr AS (SELECT arm, n, rep, CAST('0x' || substr(sha256('20260930:' || rep || ':' || place), 1, 8) AS BIGINT) % n AS place FROM pl, range(200) AS r(rep)),
 ea AS (SELECT d.arm, d.n, rep, CAST(2 * sum(tp) AS DOUBLE) / (2 * sum(tp) + sum(fp) + sum(fn)) AS f1 FROM dr d JOIN pl p ON d.arm = p.arm AND d.place = p.place GROUP BY ALL),
 ci AS (SELECT arm, n, quantile_cont(f1, 0.025) AS low, quantile_cont(f1, 0.975) AS high FROM ea GROUP BY ALL),
 po AS (SELECT arm, round(CAST(2 * sum(tp) AS DOUBLE) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS point FROM gt GROUP BY 1)"""


@query(BOOT + " SELECT arm, point, CASE WHEN n >= 2 THEN round(low, 6) END AS low, CASE WHEN n >= 2 THEN round(high, 6) END AS high FROM po JOIN ci USING (arm)", cte=False)
def g12_block_bootstrap(spark, d):
    return metrics.block_bootstrap(items(spark, d), ["arm"], "grp")


@query(BOOT + " SELECT arm, CASE WHEN n < 2 THEN 'hold' WHEN low > 0.85 THEN 'adopt' WHEN high < 0.85 THEN 'reject' ELSE 'hold' END AS decision FROM ci", cte=False)
def p14_decide(spark, d):
    ci = metrics.block_bootstrap(items(spark, d), ["arm"], "grp")
    return ci.select("arm", S.decide(F.col("low"), F.col("high"), 0.85).alias("decision"))


@query(ITEMS + " SELECT coalesce(arm, '*') AS arm, coalesce(CAST(grp AS VARCHAR), '*') AS grp, count(*) AS items, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM it GROUP BY GROUPING SETS ((arm, grp), (arm), ())", cte=False)
def g15_aggregate_metrics(spark, d):
    g = items(spark, d).groupingSets([["arm", "grp"], ["arm"], []], "arm", "grp").agg(F.count("*").alias("items"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return g.select(F.coalesce("arm", F.lit("*")).alias("arm"), F.coalesce(F.col("grp").cast("string"), F.lit("*")).alias("grp"), "items", "tp", "fp", "fn")


@query(" SELECT round(avg(a), 6) AS macro, count(*) AS classes FROM (SELECT a.line, avg(CASE WHEN a.line = b.line THEN 1.0 ELSE 0.0 END) AS a FROM nr a JOIN ne b USING (note_id) GROUP BY 1)")
def g16_macro_accuracy(spark, d):
    pairs = X.notes_ref(spark, d).select("note_id", "line").join(X.notes_est(spark, d).select("note_id", F.col("line").alias("guess")), "note_id")
    return metrics.macro_accuracy(pairs, "line", "guess")


@query("""WITH r AS (SELECT l_orderkey AS bar, p, max(n) AS nr FROM (SELECT l_orderkey, l_linenumber % 2 AS part, l_partkey % 24 AS p, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY ALL),
 e AS (SELECT l_orderkey AS bar, (l_partkey + CASE WHEN l_suppkey % 5 = 0 THEN 1 ELSE 0 END) % 24 AS p, count(*) AS ne FROM lineitem GROUP BY ALL)
 SELECT bar, sum(least(coalesce(nr, 0), coalesce(ne, 0)))::BIGINT AS tp, sum(coalesce(nr, 0))::BIGINT AS n_ref, sum(coalesce(ne, 0))::BIGINT AS n_est FROM r FULL JOIN e USING (bar, p) GROUP BY 1""", cte=False)
def g18_bag_counts(spark, d):
    li = X.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("bar"), (F.col("l_linenumber") % 2).alias("part"), "l_partkey", "l_suppkey")
    est = li.select("bar", ((F.col("l_partkey") + F.when(F.col("l_suppkey") % 5 == 0, 1).otherwise(0)) % 24).alias("p"))
    return metrics.bag_counts(li.withColumn("p", F.col("l_partkey") % 24), est, ["bar"], "p", "part")


@query(""" SELECT song_id, bucket, n, tiny FROM (SELECT *, list_sort(list(n) OVER (PARTITION BY song_id))[CAST(floor(count(*) OVER (PARTITION BY song_id) / 2) AS INTEGER) + 1] AS med FROM (SELECT song_id, onset_us // 10000000 AS bucket, count(*) AS n, count_if(offset_us - onset_us < 60000)::BIGINT AS tiny FROM nr GROUP BY ALL)) WHERE n >= 5 AND (tiny * 2 >= n OR n > 3 * med)""")
def g36_burst_spans(spark, d):
    return metrics.burst_spans(X.notes_ref(spark, d), least=5)


@query(""" SELECT song_id, bar, sum(m)::BIGINT AS missed, sum(x)::BIGINT AS extra, count(*) AS total FROM (SELECT song_id, onset_us // 2000000 AS bar, 1 AS m, 0 AS x FROM nr a WHERE NOT EXISTS (SELECT 1 FROM ne b WHERE a.song_id = b.song_id AND a.pitch = b.pitch AND abs(a.onset_us - b.onset_us) <= 50000)
  UNION ALL SELECT song_id, onset_us // 2000000, 0, 1 FROM ne a WHERE NOT EXISTS (SELECT 1 FROM nr b WHERE a.song_id = b.song_id AND a.pitch = b.pitch AND abs(a.onset_us - b.onset_us) <= 50000)) GROUP BY ALL""")
def g10_worst_bars(spark, d):
    ref, est, bar = X.notes_ref(spark, d), X.notes_est(spark, d), F.expr("onset_us div 2000000").alias("bar")
    missed = match.near(ref, est, ["song_id", "pitch"], 50_000, "left_anti").select("song_id", bar)
    return metrics.worst_bars(missed, match.near(est, ref, ["song_id", "pitch"], 50_000, "left_anti").select("song_id", bar))


@query(" SELECT song_id, arg_max(line, n * 10 - line) AS line, round(max(n) / sum(n), 6) AS share FROM (SELECT song_id, line, count(*) AS n FROM nr GROUP BY ALL) GROUP BY 1")
def g8_majority_baseline(spark, d):
    return metrics.majority_line(X.notes_ref(spark, d))


@query("SELECT l_returnflag, l_linestatus, round(median(l_quantity), 6) AS median_quantity, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90_price, count(*) AS n FROM lineitem GROUP BY ALL", cte=False)
def g40_bench_table(spark, d):
    li = X.table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus")
    return li.agg(F.round(F.percentile("l_quantity", F.lit(0.5)), 6).alias("median_quantity"), F.round(F.percentile("l_extendedprice", F.lit(0.9)), 6).alias("p90_price"), F.count("*").alias("n"))


@query(""", rs AS (SELECT note_id, residual_us FROM (SELECT a.note_id, a.onset_us - b.onset_us AS residual_us, row_number() OVER (PARTITION BY a.note_id ORDER BY abs(a.onset_us - b.onset_us), b.onset_us) AS k
  FROM ne a JOIN nr b ON a.song_id = b.song_id AND a.pitch = b.pitch AND abs(a.onset_us - b.onset_us) <= 100000) WHERE k = 1), md AS (SELECT median(residual_us) AS m FROM rs)
 SELECT round(any_value(m), 6) AS latency_us, round(median(abs(residual_us - m)), 6) AS mad_us, count(*) AS n FROM rs, md""")
def g33_latency_estimate(spark, d):
    r = match.nearest_within(X.notes_est(spark, d), X.notes_ref(spark, d), ["song_id", "pitch"], 100_000)
    # residuals lie within the tolerance, so counts of their values are bounded, and both medians are taken from them
    c = r.groupBy("residual_us").agg(F.count("*").alias("n"))
    m = c.agg(F.percentile("residual_us", F.lit(0.5), F.col("n")).alias("m"))
    away = F.abs(F.col("residual_us") - F.col("m"))
    return c.crossJoin(F.broadcast(m)).agg(F.round(F.max("m"), 6).alias("latency_us"), F.round(F.percentile(away, F.lit(0.5), F.col("n")), 6).alias("mad_us"), F.sum("n").alias("n"))


@query(""", bk AS (SELECT song_id, onset_us // 2000000 AS block, line, count(*) AS n FROM nr GROUP BY ALL), mo AS (SELECT song_id, block, arg_max(line, n * 10 - line) AS line FROM bk GROUP BY ALL)
 SELECT song_id, count(*) AS blocks, count_if(line <> p)::BIGINT AS switches FROM (SELECT *, lag(line) OVER (PARTITION BY song_id ORDER BY block) AS p FROM mo) GROUP BY 1""")
def g27_identity_switches(spark, d):
    return sequence.identity_switches(X.notes_ref(spark, d))


@query("""WITH x AS (SELECT least(n_chars, 9999) / 10000.0 AS p, quality AS y FROM documents JOIN labels USING (doc_id)) SELECT round(sum(abs(p - y) * n) / sum(n), 6) AS ece, sum(n)::BIGINT AS n FROM (SELECT least(floor(p * 10), 9) AS b, count(*) AS n, avg(p) AS p, avg(y) AS y FROM x GROUP BY 1)""", cte=False)
def g28_calibration_error(spark, d):
    rows = X.table(spark, d, "documents").select("doc_id", "n_chars").join(X.table(spark, d, "labels"), "doc_id")
    return sequence.calibration_error(rows.select((F.least("n_chars", F.lit(9999)) / 10000.0).alias("p"), F.col("quality").alias("y")), "p", "y")


@query(" SELECT note_id, count(*) OVER (w RANGE BETWEEN 30000 PRECEDING AND 30000 FOLLOWING) AS poly, count(*) OVER (w RANGE BETWEEN 1000000 PRECEDING AND 1000000 FOLLOWING) AS density, round(pitch - median(pitch) OVER (PARTITION BY song_id), 6) AS rel_pitch, offset_us - onset_us AS dur_us FROM nr WINDOW w AS (PARTITION BY song_id ORDER BY onset_us)")
def w3_note_features(spark, d):
    return sequence.polyphony(X.notes_ref(spark, d))


@query(" SELECT song_id, onset_us // 1000000 AS second, count(*) AS n, count_if(c >= 2)::BIGINT AS chords, CASE WHEN count_if(c >= 2) >= 0.6 * count(*) THEN 'rhythm' ELSE 'lead' END AS role FROM (SELECT *, count(*) OVER (PARTITION BY song_id, onset_us) AS c FROM nr) GROUP BY ALL")
def w2_chord_share_split(spark, d):
    return sequence.chord_share(X.notes_ref(spark, d))


@query(anchored("song_id") + " SELECT note_id, CASE WHEN k = 1 AND pitch - below >= 10 THEN 'top' WHEN c >= 3 THEN 'chord' ELSE 'line' END AS role FROM (SELECT *, row_number() OVER w AS k, lead(pitch) OVER w AS below, count(*) OVER (PARTITION BY song_id, anchor_us) AS c FROM cl WINDOW w AS (PARTITION BY song_id, anchor_us ORDER BY pitch DESC, note_id))")
def w1_symbolic_layers(spark, d):
    return sequence.peeled_layers(cluster.anchored_clusters(X.notes_ref(spark, d), ["song_id"], 35_000))


@query(""" SELECT song_id, line, n, row_number() OVER (PARTITION BY song_id ORDER BY main DESC, f, line) AS place FROM (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY n DESC, line) = 1 AS main FROM (SELECT song_id, line, count(*) AS n, min(onset_us) AS f FROM nr GROUP BY ALL))""")
def w8_order_parts(spark, d):
    return sequence.order_lines(X.notes_ref(spark, d))


@query(" SELECT song_id, onset_us // 2000000 AS bar, count(DISTINCT line) AS lines FROM nr GROUP BY ALL HAVING count(DISTINCT line) > 1")
def w11_view_violations(spark, d):
    g = X.notes_ref(spark, d).groupBy("song_id", F.expr("onset_us div 2000000").alias("bar")).agg(F.count_distinct("line").alias("lines"))
    return g.where("lines > 1")


@query(' SELECT song_id, "window", start_us, end_us, label FROM wn')
def w12_router_windows(spark, d):
    return X.windows(spark, d).select("song_id", "window", "start_us", "end_us", "label")


@query(" SELECT song_id, beat_no, iv AS interval_us, round(m, 6) AS local_us, round(iv / m, 6) AS ratio FROM (SELECT *, median(iv) OVER (PARTITION BY song_id ORDER BY beat_no ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS m FROM (SELECT song_id, beat_no, lead(t_us) OVER (PARTITION BY song_id ORDER BY t_us) - t_us AS iv FROM bt) WHERE iv IS NOT NULL)")
def d12_local_intervals(spark, d):
    return sequence.tempo_levels(X.beats(spark, d))


@query(" SELECT song_id, note_id, row_number() OVER (PARTITION BY song_id ORDER BY onset_us, pitch, offset_us, instrument, note_id) AS place FROM nr")
def s1_canonical_order(spark, d):
    w = Window.partitionBy("song_id").orderBy("onset_us", "pitch", "offset_us", "instrument", "note_id")
    return X.notes_ref(spark, d).select("song_id", "note_id", F.row_number().over(w).alias("place"))


@query(" SELECT song_id, bucket, n, place FROM (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY n DESC, bucket) AS place FROM (SELECT song_id, onset_us // 10000000 AS bucket, count(*) AS n FROM nr GROUP BY ALL)) WHERE place <= 5")
def s2_top_windows(spark, d):
    n = X.notes_ref(spark, d).groupBy("song_id", F.expr("onset_us div 10000000").alias("bucket")).agg(F.count("*").alias("n"))
    return sequence.top_rows(n, ["song_id"], [F.desc("n"), F.col("bucket")], 5)


@query(" SELECT song_id, pitch, count(*) AS n FROM (SELECT song_id, pitch FROM nr INTERSECT ALL SELECT song_id, pitch FROM ne) GROUP BY ALL")
def s4_bag_intersection(spark, d):
    both = X.notes_ref(spark, d).select("song_id", "pitch").intersectAll(X.notes_est(spark, d).select("song_id", "pitch"))
    return both.groupBy("song_id", "pitch").agg(F.count("*").alias("n"))


@query(" SELECT song_id, pitch, count(*) AS n FROM (SELECT song_id, pitch FROM nr EXCEPT ALL SELECT song_id, pitch FROM ne) GROUP BY ALL")
def s5_bag_difference(spark, d):
    left = X.notes_ref(spark, d).select("song_id", "pitch").exceptAll(X.notes_est(spark, d).select("song_id", "pitch"))
    return left.groupBy("song_id", "pitch").agg(F.count("*").alias("n"))


@query(" SELECT song_id, note_id FROM (SELECT song_id, note_id, row_number() OVER (PARTITION BY song_id ORDER BY note_id) - 1 AS i, count(*) OVER (PARTITION BY song_id) AS n FROM nr) WHERE n <= 25 OR i = 0 OR floor(i * 25 / n) <> floor((i - 1) * 25 / n)")
def s7_sample_evenly(spark, d):
    return sequence.even_sample(X.notes_ref(spark, d).select("song_id", "note_id"), ["song_id"], "note_id", 25)


@query("SELECT doc_id, sha256(text) AS sha, count(*) OVER (PARTITION BY text) > 1 AS copied FROM documents", cte=False)
def a10_content_key(spark, d):
    docs = X.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    n = docs.groupBy("sha").agg(F.count("*").alias("n"))
    return docs.join(n, "sha").select("doc_id", "sha", (F.col("n") > 1).alias("copied"))


@query("SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(p_name || ':' || p_brand), ':', '-'), '[^a-z0-9_-]', '_', 'g'), '-+', '-', 'g'), '_+', '_', 'g'), '_') AS slug FROM part", cte=False)
def a11_slug(spark, d):
    return X.table(spark, d, "part").select("p_partkey", S.slug(F.concat("p_name", F.lit(":"), "p_brand")).alias("slug"))


@query(" SELECT note_id, list_aggregate(list_filter([CASE WHEN offset_us < onset_us + 30000 THEN 'short' END, CASE WHEN pitch > 60 THEN 'pitch' END, CASE WHEN instrument NOT IN ('click', 'view', 'purchase') THEN 'instrument' END], lambda x: x IS NOT NULL), 'string_agg', ',') AS rules FROM nr WHERE offset_us < onset_us + 30000 OR pitch > 60 OR instrument NOT IN ('click', 'view', 'purchase')")
def q1_validate_notes(spark, d):
    rules = {"short": F.col("offset_us") < F.col("onset_us") + 30_000, "pitch": F.col("pitch") > 60, "instrument": ~F.col("instrument").isin("click", "view", "purchase")}
    _, bad = quality.split_by_rules(X.notes_ref(spark, d), rules)
    return bad.select("note_id", F.array_join("rules", ",").alias("rules"))


@query(""", fa AS (SELECT song_id, note_id, onset_us, CASE WHEN note_id % 13 = 0 THEN onset_us - 1 ELSE offset_us END AS z, CASE WHEN note_id % 17 = 0 THEN 130 ELSE pitch END AS p, CASE WHEN note_id % 23 = 0 THEN 'unheard' WHEN note_id % 31 <> 0 THEN instrument ELSE '' END AS cls, note_id % 19 = 0 AS nostring, note_id % 29 = 0 AS nofret FROM ne),
 fb AS (SELECT a.*, lag((onset_us, p, z, cls)) OVER (PARTITION BY song_id ORDER BY note_id) AS prev FROM fa a), fc AS (SELECT song_id, note_id, concat_ws(',', CASE WHEN z < onset_us THEN 'offset' END, CASE WHEN p > 127 THEN 'pitch' END, CASE WHEN cls = 'unheard' THEN 'instrument' END, CASE WHEN (onset_us, p, z, cls) < prev THEN 'order' END, CASE WHEN nostring <> nofret THEN 'string' END) AS rules FROM fb)
 SELECT * FROM fc WHERE rules <> ''""")
def q1_note_rules(spark, d):
    return quality.note_rules(X.faulty_notes(spark, d), ["click", "view", "purchase", "signup", "error"])


@query(""", sa AS (SELECT song_id, "window" AS place, start_us + CASE WHEN "window" % 11 = 3 THEN 9000000 ELSE 0 END AS a, end_us - CASE WHEN "window" % 13 = 5 THEN 9000000 WHEN "window" % 13 = 7 THEN -1000000 ELSE 0 END AS z FROM wn)
 SELECT s.song_id, s.place, CASE WHEN s.z <= s.a THEN 'empty' ELSE 'overlap' END AS fault FROM sa s LEFT JOIN sa b ON b.song_id = s.song_id AND b.place = s.place - 1 WHERE s.z <= s.a OR s.a < coalesce(b.z, 0)""")
def q1_segment_rules(spark, d):
    return quality.segment_rules(X.faulty_segments(spark, d))


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN d.doc_id IS NULL THEN 'extra' WHEN sha256(d.text) = sha256(CASE WHEN l.quality = 1 THEN d2.text ELSE '' END) THEN 'verified' ELSE 'mismatch' END AS status FROM documents d FULL JOIN labels l USING (doc_id) LEFT JOIN documents d2 ON d2.doc_id = l.doc_id", cte=False)
def q3_verify_manifest(spark, d):
    docs = X.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    held = X.table(spark, d, "labels").join(docs, "doc_id", "left").select("doc_id", F.when(F.col("quality") == 1, F.col("sha")).otherwise(F.sha2(F.lit(""), 256)).alias("sha"))
    return lineage.verify_manifest(docs, held, "doc_id", "sha")


CLOSURE = """WITH RECURSIVE e AS (SELECT DISTINCT o_orderkey AS child, o_orderkey // 3 AS parent FROM orders WHERE o_orderkey >= 3), c AS (SELECT child AS node, parent AS ancestor, 1 AS depth FROM e UNION SELECT c.node, e.parent, c.depth + 1 FROM c JOIN e ON c.ancestor = e.child)"""


def closure(spark, d):
    """Each order depends on the one whose key is a third of its own."""
    edges = X.table(spark, d, "orders").where("o_orderkey >= 3").select(F.col("o_orderkey").alias("child"), F.expr("o_orderkey div 3").alias("parent"))
    quality.checkpoint_folder(spark)
    return lineage.lineage_closure(edges)


@query(CLOSURE + " SELECT node, ancestor, min(depth) AS depth FROM c GROUP BY ALL", cte=False)
def l6_lineage_closure(spark, d):
    return closure(spark, d)


@query(CLOSURE + ", k AS (SELECT o_orderkey AS node FROM orders WHERE o_orderkey % 101 = 5) SELECT DISTINCT node FROM (SELECT node FROM k UNION ALL SELECT c.node FROM c JOIN k ON c.ancestor = k.node)", cte=False)
def l6_stale_sets(spark, d):
    changed = X.table(spark, d, "orders").where("o_orderkey % 101 = 5").select(F.col("o_orderkey").alias("node"))
    return lineage.stale(closure(spark, d), changed)


@query("SELECT d.doc_id, sha256(d.text) AS key FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)", cte=False)
def l7_plan_incremental(spark, d):
    docs = X.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    return lineage.incremental_plan(docs, X.table(spark, d, "labels"), "doc_id").select("doc_id", "key")


@query("SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS status, count(*) AS n FROM orders GROUP BY 1", cte=False)
def l11_latest_status(spark, d):
    return lineage.latest_status(X.table(spark, d, "orders"), "o_custkey", "o_orderkey", "o_orderstatus")


LOG = """, lg AS (SELECT song_id, note_id AS seq, CASE instrument WHEN 'error' THEN 'undo' WHEN 'signup' THEN 'redo' ELSE 'edit' END AS op, note_id AS id, CASE WHEN note_id % 5 = 0 THEN -1 ELSE lag(note_id) OVER (PARTITION BY song_id ORDER BY note_id) END AS target, row_number() OVER (PARTITION BY song_id ORDER BY note_id) AS rn FROM nr),
 fo AS (SELECT song_id, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS dn, CAST([] AS BIGINT[]) AS un FROM lg GROUP BY ALL UNION ALL SELECT f.song_id, l.rn,
  CASE WHEN op = 'edit' THEN list_append(dn, id) WHEN op = 'undo' AND dn[-1] = target THEN dn[:-2] WHEN op = 'redo' AND un[-1] = target THEN list_append(dn, target) ELSE dn END,
  CASE WHEN op = 'edit' THEN CAST([] AS BIGINT[]) WHEN op = 'undo' AND dn[-1] = target THEN list_append(un, target) WHEN op = 'redo' AND un[-1] = target THEN un[:-2] ELSE un END FROM fo f JOIN lg l ON l.song_id = f.song_id AND l.rn = f.rn + 1)"""


@query(LOG + " SELECT song_id, len(dn) AS active, list_sum(list_transform(dn, lambda x: x))::BIGINT AS ids, len(un) AS undone FROM fo QUALIFY row_number() OVER (PARTITION BY song_id ORDER BY rn DESC) = 1")
def l1_active_edits(spark, d):
    op = F.when(F.col("instrument") == "error", "undo").when(F.col("instrument") == "signup", "redo").otherwise("edit")
    target = F.when(F.col("note_id") % 5 == 0, -1).otherwise(F.lag("note_id").over(Window.partitionBy("song_id").orderBy("note_id")))
    log = X.notes_ref(spark, d).select("song_id", F.col("note_id").alias("seq"), op.alias("op"), F.col("note_id").alias("id"), target.alias("target"))
    out = lineage.active_edits(log, "song_id", "seq")
    total = F.aggregate("active", F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select("song_id", F.size("active").cast("long").alias("active"), F.when(F.size("active") > 0, total).alias("ids"), F.size("undone").cast("long").alias("undone"))


@query("SELECT c_custkey, CASE WHEN n = 1 THEN c_mktsegment ELSE c_mktsegment || '_' || n END AS folder FROM (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS n FROM customer)", cte=False)
def l16_unique_names(spark, d):
    return lineage.unique_names(X.table(spark, d, "customer"), "c_mktsegment", "c_custkey").select("c_custkey", "folder")
