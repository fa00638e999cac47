"""More queries over the given tables: sweeps, paired intervals, anchors, coverage, edits and streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import scalars as S
from ..operators import cluster, measures, timeline
from ..sources import fixtures as X
from ..streaming import jobs
from .queries import anchored, query


@query("SELECT p_partkey, p_brand AS brand, CAST(p_size AS VARCHAR) AS size FROM part", cte=False)
def p9_parse_spec(spark, d):
    spec = S.parse_spec(F.concat(F.lit("brand="), "p_brand", F.lit("; size = "), F.col("p_size").cast("string")))
    return X.table(spark, d, "part").select("p_partkey", spec.alias("m")).select("p_partkey", F.col("m.brand").alias("brand"), F.col("m.size").alias("size"))


@query(", z AS (SELECT song_id, line, avg(pitch) AS s FROM nr GROUP BY ALL) SELECT song_id, line, round(exp(s - max(s) OVER w) / sum(exp(s - m)) OVER w, 6) AS p FROM (SELECT *, max(s) OVER (PARTITION BY song_id) AS m FROM z) WINDOW w AS (PARTITION BY song_id)")
def p15_softmax_rows(spark, d):
    z = X.notes_ref(spark, d).groupBy("song_id", "line").agg(F.avg("pitch").alias("s"))
    return z.select("song_id", "line", F.round(S.softmax(F.col("s"), Window.partitionBy("song_id")), 6).alias("p"))


@query(", z AS (SELECT song_id, line, avg(CASE WHEN pitch > 52 THEN 1.0 ELSE 0.0 END) AS e FROM nr GROUP BY ALL) SELECT song_id, round(1 - product(1 - 0.5 * e), 6) AS p FROM z GROUP BY 1")
def p15_noisy_or(spark, d):
    z = X.notes_ref(spark, d).groupBy("song_id", "line").agg(F.avg((F.col("pitch") > 52).cast("double")).alias("e"))
    return z.groupBy("song_id").agg(F.round(S.noisy_or(F.lit(0.5), F.col("e")), 6).alias("p"))


@query(" SELECT a.song_id, a.bar, a.t_us + 0.5 * (b.t_us - a.t_us) AS t_us FROM bt a JOIN bt b ON a.song_id = b.song_id AND b.beat_no = a.beat_no + 1 WHERE a.beat = 2")
def t4_bar_tick_to_time(spark, d):
    starts = X.beats(spark, d).where("beat = 1").select("song_id", "bar", (F.col("beat_no") + 72 / 48).alias("beat_pos"))
    return timeline.beat_to_time(starts, X.beats(spark, d)).select("song_id", "bar", "t_us")


@query(""", kn AS (SELECT song_id, bar, start_us AS t, lead(bar) OVER w AS nb, lead(start_us) OVER w AS nt FROM br WHERE bar % 5 <> 3 WINDOW w AS (PARTITION BY song_id ORDER BY bar))
 SELECT song_id, bar + i // 4 AS bar, i % 4 + 1 AS beat, round(t + (nt - t) * i / ((nb - bar) * 4), 6) AS t_us FROM kn, range(8) AS r(i) WHERE nb IS NOT NULL AND i < (nb - bar) * 4""")
def t13_spread_beats(spark, d):
    return measures.spread_beats(X.bars(spark, d).where("bar % 5 <> 3"))


@query(anchored("song_id, line, pitch") + " SELECT song_id, line, pitch, anchor_us, max(offset_us) AS offset_us, count(*) AS n FROM cl GROUP BY ALL")
def d5_dedupe_within_line(spark, d):
    c = cluster.anchored_clusters(X.notes_ref(spark, d), ["song_id", "line", "pitch"], 35_000)
    return c.groupBy("song_id", "line", "pitch", "anchor_us").agg(F.max("offset_us").alias("offset_us"), F.count("*").alias("n"))


@query(" SELECT song_id, count(*) AS n, count_if(hit) AS hit, round(count_if(hit) / count(*), 6) AS share FROM (SELECT song_id, EXISTS (SELECT 1 FROM nr WHERE nr.song_id = e.song_id AND nr.pitch = e.pitch AND nr.onset_us // 125000 = e.onset_us // 125000) AS hit FROM ne e) GROUP BY 1")
def g4_notation_match(spark, d):
    cell = lambda df: df.select("song_id", "pitch", F.expr("onset_us div 125000").alias("cell"))
    return measures.notation_share(cell(X.notes_est(spark, d)), cell(X.notes_ref(spark, d)), ["song_id", "pitch", "cell"])


@query(""", q AS (SELECT song_id, (note_id * 37 % 100) / 100.0 AS p, line = pitch % 3 AS ok FROM nr), n AS (SELECT song_id, count(*) AS total FROM q GROUP BY 1)
 SELECT song_id, tau, round(count(*) / any_value(total), 6) AS coverage, round(count_if(ok) / count(*), 6) AS accuracy FROM q JOIN n USING (song_id), (SELECT unnest([0.0, 0.25, 0.5, 0.75, 0.9])::DOUBLE AS tau) WHERE p >= tau GROUP BY ALL""")
def g6_coverage_accuracy(spark, d):
    q = X.notes_ref(spark, d).withColumn("p", (F.col("note_id") * 37 % 100) / 100)
    return measures.coverage_accuracy(q, "song_id", "p", F.col("line") == F.col("pitch") % 3, [0.0, 0.25, 0.5, 0.75, 0.9])


@query(""", it AS (SELECT instrument, song_id, count_if(line = 0 AND a) AS ta, count_if(line = 1 AND a) AS pa, count_if(line = 2 AND a) AS na, count_if(line = 0 AND NOT a) AS tb, count_if(line = 1 AND NOT a) AS pb, count_if(line = 2 AND NOT a) AS nb
  FROM (SELECT *, true AS a FROM nr UNION ALL SELECT *, false FROM ne) GROUP BY ALL),
 tt AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY song_id) - 1 AS place, count(*) OVER (PARTITION BY instrument) AS n FROM it),
 dr AS (SELECT instrument, rep, ('0x' || substr(sha256('20260930:' || rep || ':' || place), 1, 8))::BIGINT % n AS pick FROM tt, range(200) AS r(rep)),
 ea AS (SELECT instrument, rep, 2 * sum(tb) / (2 * sum(tb) + sum(pb) + sum(nb)) - 2 * sum(ta) / (2 * sum(ta) + sum(pa) + sum(na)) AS x FROM dr JOIN tt USING (instrument) WHERE place = pick GROUP BY ALL),
 po AS (SELECT instrument, 2 * sum(tb) / (2 * sum(tb) + sum(pb) + sum(nb)) - 2 * sum(ta) / (2 * sum(ta) + sum(pa) + sum(na)) AS delta FROM it GROUP BY 1)
 SELECT instrument, round(any_value(delta), 6) AS delta, round(quantile_cont(x, 0.025), 6) AS low, round(quantile_cont(x, 0.975), 6) AS high FROM ea JOIN po USING (instrument) GROUP BY 1""")
def g13_paired_bootstrap(spark, d):
    both = X.notes_ref(spark, d).withColumn("arm", F.lit("a")).unionByName(X.notes_est(spark, d).withColumn("arm", F.lit("b")))
    facts = [F.count_if((F.col("line") == k) & (F.col("arm") == a)).alias(f"{c}_{a}") for a in "ab" for k, c in enumerate(("tp", "fp", "fn"))]
    return measures.paired_bootstrap(both.groupBy("instrument", "song_id").agg(*facts), ["instrument"], "song_id")


@query(""", it AS (SELECT instrument AS metric, song_id * 10 + line AS item, song_id AS grp, CASE WHEN song_id % 2 = 0 THEN 'even' ELSE 'odd' END AS scenario, count_if(a AND pitch % 3 = 0) AS ta, count_if(a AND pitch % 3 = 1) AS pa, count_if(a AND pitch % 3 = 2) AS na, count_if(NOT a AND pitch % 3 = 0) AS tb,
  count_if(NOT a AND pitch % 3 = 1) AS pb, count_if(NOT a AND pitch % 3 = 2) AS nb FROM (SELECT *, true AS a FROM nr UNION ALL SELECT *, false FROM ne) GROUP BY ALL HAVING count_if(a) > 0 AND count_if(NOT a) > 0),
 sc3 AS (SELECT * REPLACE ('all' AS scenario) FROM it UNION ALL SELECT * FROM it), gr AS (SELECT metric, scenario, grp, sum(ta) AS ta, sum(pa) AS pa, sum(na) AS na, sum(tb) AS tb, sum(pb) AS pb, sum(nb) AS nb FROM sc3 GROUP BY ALL),
 tt AS (SELECT *, row_number() OVER (PARTITION BY metric, scenario ORDER BY grp) - 1 AS place, count(*) OVER (PARTITION BY metric, scenario) AS n FROM gr), dr AS (SELECT metric, scenario, rep, ('0x' || substr(sha256('20260930:' || rep || ':' || place), 1, 8))::BIGINT % n AS pick FROM tt, range(200) AS r(rep)),
 ea AS (SELECT metric, scenario, rep, 2 * sum(tb) / (2 * sum(tb) + sum(pb) + sum(nb)) - 2 * sum(ta) / (2 * sum(ta) + sum(pa) + sum(na)) AS x FROM dr JOIN tt USING (metric, scenario) WHERE place = pick GROUP BY ALL),
 po AS (SELECT metric, scenario, count(*) AS items, 2 * sum(tb) / (2 * sum(tb) + sum(pb) + sum(nb)) - 2 * sum(ta) / (2 * sum(ta) + sum(pa) + sum(na)) AS delta, count_if(item % 4 = 1) AS mixed FROM sc3 GROUP BY ALL)
 SELECT metric, scenario, any_value(items) AS items, round(any_value(delta), 6) AS delta, round(quantile_cont(x, 0.025), 6) AS low, round(quantile_cont(x, 0.975), 6) AS high, any_value(mixed) AS mixed_rungs FROM ea JOIN po USING (metric, scenario) GROUP BY ALL""")
def l13_compare_runs(spark, d):
    """Two runs over songs and lines: the reference notes and their corruption."""

    def run(notes, rung):
        item = (F.col("song_id") * 10 + F.col("line")).alias("item")
        scenario = F.when(F.col("song_id") % 2 == 0, "even").otherwise("odd")
        facts = [F.count_if(F.col("pitch") % 3 == k).alias(c) for k, c in enumerate(("tp", "fp", "fn"))]
        return notes.groupBy(F.col("instrument").alias("metric"), item, F.col("song_id").alias("group"), scenario.alias("scenario")).agg(*facts).withColumn("rung", rung)

    b = F.when(F.col("item") % 4 == 1, "other").otherwise("same")
    return measures.compare_runs(run(X.notes_ref(spark, d), F.lit("same")), run(X.notes_est(spark, d), b))


@query(" SELECT CASE WHEN grouping(song_id) = 1 THEN -1 ELSE song_id END AS song_id, CASE WHEN grouping(instrument) = 1 THEN '*' ELSE instrument END AS instrument, count(*) AS n FROM nr GROUP BY GROUPING SETS ((song_id, instrument), (song_id), (instrument), ())")
def g29_cause_matrix(spark, d):
    song = F.when(F.grouping("song_id") == 1, -1).otherwise(F.col("song_id")).alias("song")
    kind = F.when(F.grouping("instrument") == 1, "*").otherwise(F.col("instrument")).alias("kind")
    return X.notes_ref(spark, d).cube("song_id", "instrument").agg(F.count("*").alias("n"), song, kind).select(F.col("song").alias("song_id"), F.col("kind").alias("instrument"), "n")


@query(" SELECT event_type, round(sqrt(avg(value * value)), 6) AS rms, round(max(abs(value)), 6) AS peak, round(20 * log10(sqrt(avg(value * value)) / max(sqrt(avg(value * value))) OVER ()), 6) AS rel_db FROM events GROUP BY 1")
def g39_stem_stats(spark, d):
    return measures.stem_levels(X.table(spark, d, "events"), "event_type", "value")


@query(" SELECT song_id, round(avg(abs(r)), 6) AS mean, round(quantile_cont(abs(r), 0.9), 6) AS p90 FROM (SELECT song_id, (onset_us + 62500) % 125000 - 62500 AS r FROM nr) GROUP BY 1")
def g42_quant_stats(spark, d):
    return measures.quant_stats(X.notes_ref(spark, d).select("song_id", ((F.col("onset_us") + 62500) % 125000 - 62500).alias("residual")), "song_id")


@query(""", a AS (SELECT song_id, onset_us // 2000000 AS bar, pitch, count(*) AS r FROM nr GROUP BY ALL), b AS (SELECT song_id, onset_us // 2000000 + 3 AS bar, pitch, count(*) AS e FROM ne GROUP BY ALL),
 o AS (SELECT a.song_id, k, sum(least(r, e))::BIGINT AS tp FROM b, range(-8, 9) AS g(k), a WHERE a.song_id = b.song_id AND a.pitch = b.pitch AND a.bar = b.bar + k GROUP BY ALL)
 SELECT song_id, k AS "offset", tp, round(2 * tp / ((SELECT sum(r) FROM a WHERE a.song_id = o.song_id) + (SELECT sum(e) FROM b WHERE b.song_id = o.song_id)), 6) AS f1 FROM o QUALIFY row_number() OVER (PARTITION BY song_id ORDER BY tp DESC, k) = 1""")
def g46_compare_parts(spark, d):
    bar = lambda df, by: df.select("song_id", "pitch", (F.expr("onset_us div 2000000") + by).alias("bar"))
    return measures.best_offset(bar(X.notes_ref(spark, d), 0), bar(X.notes_est(spark, d), 3))


@query(" SELECT instrument, round(sum(pitch * (offset_us - onset_us)) / sum(offset_us - onset_us), 6) AS pooled FROM nr GROUP BY 1")
def g50_frame_weighted_pool(spark, d):
    return measures.weighted_pool(X.notes_ref(spark, d).withColumn("w", F.col("offset_us") - F.col("onset_us")), "instrument", "pitch", "w")


@query(""" SELECT song_id, round(sum(abs(a.x - b.x) * w) / sum(w), 6) AS delta FROM (SELECT song_id, line, onset_us // 10000000 AS b, avg(pitch) AS x, count(*) AS w FROM nr GROUP BY ALL) a
 JOIN (SELECT song_id, line, onset_us // 10000000 AS b, avg(pitch) AS x FROM ne GROUP BY ALL) b USING (song_id, line, b) GROUP BY 1""")
def g54_weighted_delta(spark, d):
    by = lambda df: df.groupBy("song_id", "line", F.expr("onset_us div 10000000").alias("b")).agg(F.avg("pitch").alias("x"), F.count("*").alias("w"))
    return measures.weighted_delta(by(X.notes_ref(spark, d)), by(X.notes_est(spark, d)), ["song_id", "line", "b"], "song_id")


@query(""" SELECT event_id, value >= 0.4 * q AS kept FROM (SELECT event_id, value, user_id // 12 AS s FROM events) JOIN (SELECT user_id // 12 AS s, quantile_cont(value, 0.95) AS q FROM events GROUP BY 1) USING (s)""", cte=False)
def w23_silence_gate(spark, d):
    return measures.silence_gate(X.table(spark, d, "events").withColumn("song_id", F.expr("user_id div 12")), "value", 0.95, 0.4).select("event_id", "kept")


@query(""", sr AS (SELECT song_id, onset_us // 1000000 AS frame, count(*) AS x FROM nr GROUP BY ALL),
 pk AS (SELECT song_id, frame, x FROM (SELECT *, max(x) OVER (w ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS m, avg(x) OVER (w ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS a FROM sr WINDOW w AS (PARTITION BY song_id ORDER BY frame)) WHERE x = m AND x >= a + 1),
 an AS (SELECT song_id, min(frame) AS f FROM pk GROUP BY 1 UNION ALL SELECT a.song_id, min(p.frame) FROM an a JOIN pk p ON a.song_id = p.song_id AND p.frame > a.f + 5 GROUP BY a.song_id, a.f)
 SELECT p.song_id, frame, x FROM an JOIN pk p ON p.song_id = an.song_id AND frame = f""")
def w41_peak_pick(spark, d):
    series = X.notes_ref(spark, d).groupBy("song_id", F.expr("onset_us div 1000000").alias("frame")).agg(F.count("*").alias("x"))
    return measures.peaks(series)


@query(""" SELECT note_id, coalesce(found, -1) AS found, CASE WHEN found IS NULL THEN 'unmatched' WHEN dist <= 100 THEN 'exact' ELSE 'nearest' END AS how FROM (SELECT a.note_id, b.note_id AS found, abs(a.onset_us - b.onset_us) AS dist, row_number() OVER (PARTITION BY a.note_id ORDER BY abs(a.onset_us - b.onset_us), b.onset_us, b.note_id) AS k
 FROM ne a LEFT JOIN nr b ON a.song_id = b.song_id AND a.pitch = b.pitch AND abs(a.onset_us - b.onset_us) <= 30000) WHERE k = 1""")
def j9_anchor_find(spark, d):
    return measures.anchor_find(X.notes_est(spark, d), X.notes_ref(spark, d)).fillna(-1, ["found"])


@query(""", cs AS (SELECT song_id, min(onset_us) AS s, max(offset_us) AS e FROM (SELECT *, sum(CASE WHEN onset_us <= b THEN 0 ELSE 1 END) OVER (PARTITION BY song_id ORDER BY onset_us, offset_us ROWS UNBOUNDED PRECEDING) AS r
  FROM (SELECT *, max(offset_us) OVER (PARTITION BY song_id ORDER BY onset_us, offset_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM nr)) GROUP BY song_id, r)
 SELECT song_id, bar, covered_us, covered_us * 2 >= end_us - start_us AS covered FROM (SELECT br.song_id, bar, start_us, end_us, sum(CASE WHEN s IS NULL THEN 0 ELSE least(e, end_us) - greatest(s, start_us) END)::BIGINT AS covered_us
  FROM br LEFT JOIN cs ON br.song_id = cs.song_id AND s < end_us AND e > start_us GROUP BY ALL)""")
def j15_coverage_join(spark, d):
    spans = X.notes_ref(spark, d).select("song_id", F.col("onset_us").alias("start_us"), F.col("offset_us").alias("end_us"))
    return measures.covered_bars(X.bars(spark, d), spans)


@query(" SELECT song_id, bar, start_us + sum(CASE WHEN bar % 40 = 0 THEN (bar % 3 - 1) * 10000 ELSE 0 END) OVER (PARTITION BY song_id ORDER BY bar)::BIGINT AS start_us FROM br")
def l4_shift_bars(spark, d):
    edits = X.bars(spark, d).where("bar % 40 = 0").select("song_id", "bar", ((F.col("bar") % 3 - 1) * 10000).alias("shift_us"))
    return measures.shift_bars(X.bars(spark, d), edits)


@query(""" SELECT song_id, ['exact', 'within', 'near', 'octave', 'gone'][k + 1] AS how, count(*) AS n FROM (SELECT a.song_id, a.note_id, min(CASE WHEN a.pitch = b.pitch AND abs(a.onset_us - b.onset_us) <= 100 THEN 0 WHEN a.pitch = b.pitch AND abs(a.onset_us - b.onset_us) <= 30000 THEN 1
  WHEN a.pitch = b.pitch THEN 2 WHEN abs(a.pitch - b.pitch) = 12 AND abs(a.onset_us - b.onset_us) <= 30000 THEN 3 ELSE 4 END) AS k FROM ne a LEFT JOIN nr b ON a.song_id = b.song_id AND a.pitch % 12 = b.pitch % 12 AND abs(a.onset_us - b.onset_us) <= 100000 GROUP BY ALL) GROUP BY ALL""")
def l5_reapply_rate(spark, d):
    return measures.reapply_classes(X.notes_est(spark, d), X.notes_ref(spark, d))


U = "(('0x' || substr(sha256('oracle:' || note_id || ':{}'), 1, 8))::BIGINT / 4294967296.0)"


@query(f" SELECT song_id, note_id, greatest(0, onset_us + floor(({U.format(2)} * 2 - 1) * 20000)::BIGINT) AS onset_us, pitch + CASE WHEN {U.format(1)} < 0.05 THEN 12 ELSE 0 END AS pitch FROM nr WHERE {U.format(0)} >= 0.1")
def l14_corrupt_oracle(spark, d):
    return measures.corrupt(X.notes_ref(spark, d), "oracle")


@query(""" SELECT song_id, note_id, kind, row_number() OVER (PARTITION BY song_id ORDER BY p, note_id) AS place FROM (SELECT song_id, note_id, (note_id * 37 % 100) / 100.0 AS p, CASE WHEN line = 2 THEN 'unassigned' WHEN note_id * 37 % 100 < 20 THEN 'unsure' END AS kind FROM nr) WHERE kind IS NOT NULL""")
def s3_review_queue(spark, d):
    notes = X.notes_ref(spark, d).withColumn("p", (F.col("note_id") * 37 % 100) / 100).withColumn("line", F.when(F.col("line") != 2, F.col("line")))
    return measures.review_queue(notes, "p", 0.2)


#: Events on the songs' time axis; windows that close after the newest event less the allowed delay stay open.
EV = ", ev AS (SELECT CAST(user_id // 12 AS BIGINT) AS song_id, event_id, event_type, value, (epoch_us(ts) - 1704067200000000) // 3600 AS t FROM events)"
MARK = "(SELECT max(t) // 1000 * 1000 - 10000000 FROM {})"


def event_stream(spark, d):
    onset = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts) div 3600")
    return jobs.stream_of(spark, f"{d}/events.parquet").select(F.expr("user_id div 12").alias("song_id"), "event_id", "event_type", "value", F.timestamp_micros(onset).alias("t"))


@query(EV + f" SELECT song_id, t // 10000000 * 10000000 AS start_us, round(avg(value * value), 6) AS power, count(*) AS n FROM ev GROUP BY 1, 2 HAVING start_us + 10000000 <= {MARK.format('ev')}")
def r1_stream_levels(spark, d):
    return jobs.run_now(jobs.levels(event_stream(spark, d), "10 seconds", "10 seconds"), "levels")


@query(EV + ", ss AS (SELECT * FROM ev WHERE event_type = 'error'), se AS (SELECT *, sum(CASE WHEN g <= 2000000 THEN 0 ELSE 1 END) OVER (PARTITION BY song_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS r FROM (SELECT *, t - lag(t) OVER (PARTITION BY song_id ORDER BY t, event_id) AS g FROM ss))"
       + f" SELECT song_id, min(t) AS start_us, max(t) AS end_us, count(*) AS n FROM se GROUP BY song_id, r HAVING max(t) + 2000001 <= {MARK.format('ss')}")
def r3_stream_silence_spans(spark, d):
    return jobs.run_now(jobs.spans(event_stream(spark, d).where("event_type = 'error'"), 2_000_000, "10 seconds"), "spans")


@query(EV + f" SELECT song_id, (t // 5000000 - k) * 5000000 AS start_us, count(*) AS n, count_if(event_type = 'click') AS hit FROM ev, range(15) AS r(k) GROUP BY 1, 2 HAVING start_us + 75000000 <= {MARK.format('ev')}")
def r4_stream_chord_share(spark, d):
    return jobs.run_now(jobs.shares(event_stream(spark, d), "75 seconds", "5 seconds", "10 seconds", "click"), "shares")


@query(" SELECT event_id, concat_ws(',', CASE WHEN value > 50 THEN 'loud' END, CASE WHEN event_type = 'error' THEN 'type' END) AS rules FROM events WHERE value > 50 OR event_type = 'error'")
def r7_stream_quality(spark, d):
    rules = {"loud": F.col("value") > 50, "type": F.col("event_type") == "error"}
    return jobs.quarantine(event_stream(spark, d), rules, "quality")[1].select("event_id", F.array_join("rules", ",").alias("rules"))
