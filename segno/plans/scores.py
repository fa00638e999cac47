"""Queries over written scores and time maps; an order stands for a written bar of its customer's song, its line items for the notes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import scalars as S
from ..operators import score, timeline
from ..sources import fixtures as X
from .queries import query

#: The written bars and notes for DuckDB, their play order and what follows from it.
WRITTEN = """WITH RECURSIVE wb AS (SELECT o_custkey AS song_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS bar, o_orderkey,
  CASE o_orderkey % 4 WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 6 ELSE 5 END AS num, CASE WHEN o_orderkey % 4 >= 2 THEN 8 ELSE 4 END AS den, CASE WHEN o_orderkey % 3 = 0 THEN 90.0 + o_orderkey % 60 END AS tempo,
  o_orderkey % 5 = 0 AS repeat_open, CAST(CASE o_orderkey % 7 WHEN 0 THEN 2 WHEN 3 THEN 3 ELSE 0 END AS INTEGER) AS repeat_count, CAST(CASE o_orderkey % 11 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS INTEGER) AS alternate FROM orders),
 um AS MATERIALIZED (SELECT *, CASE WHEN den = 8 AND num >= 6 AND num % 3 = 0 THEN 'dotted_quarter' WHEN den = 8 THEN 'eighth' ELSE 'quarter' END AS unit, CASE WHEN den = 8 AND num >= 6 AND num % 3 = 0 THEN num // 3 ELSE num END AS beats,
  CASE WHEN den = 8 AND num >= 6 AND num % 3 = 0 THEN 1.5 WHEN den = 8 THEN 0.5 ELSE 1.0 END AS q FROM wb),
 wt AS MATERIALIZED (SELECT song_id, bar, l_linenumber % 3 AS track, 'L' || l_linenumber % 2 AS line, CAST(l_suppkey % 2 + 1 AS INTEGER) AS string, CAST(40 + l_partkey % 6 AS INTEGER) AS pitch, l_partkey % 3 = 0 AS tie, (l_linenumber - 1) // 2 * 480 AS start, 480 AS dur, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS note_no
  FROM lineitem JOIN wb ON l_orderkey = o_orderkey),
 sn AS (SELECT song_id, count(*) AS n FROM wb GROUP BY 1),
 st AS (SELECT song_id, 0 AS k, 0 AS i, 0 AS s, 1 AS p, FALSE AS j, CAST(NULL AS BIGINT) AS bar FROM sn UNION ALL
  SELECT song_id, k + 1, CASE WHEN skip THEN i + 1 WHEN jump THEN s2 ELSE i + 1 END, CASE WHEN skip OR jump THEN s2 WHEN repeat_count > 0 THEN i + 1 ELSE s2 END,
   CASE WHEN skip THEN p2 WHEN jump THEN p2 + 1 WHEN repeat_count > 0 THEN 1 ELSE p2 END, NOT skip AND jump, CASE WHEN NOT skip THEN b END
  FROM (SELECT *, alternate <> 0 AND ((alternate >> (p2 - 1)) & 1) = 0 AS skip, repeat_count > 1 AND p2 < repeat_count AS jump FROM
   (SELECT st.song_id, k, i, wb.bar AS b, repeat_count, alternate, CASE WHEN repeat_open AND NOT j THEN i ELSE s END AS s2, CASE WHEN repeat_open AND NOT j THEN 1 ELSE p END AS p2 FROM st JOIN wb ON wb.song_id = st.song_id AND wb.bar = i + 1))),
 po AS MATERIALIZED (SELECT song_id, row_number() OVER (PARTITION BY song_id ORDER BY k) AS pos, bar FROM st WHERE bar IS NOT NULL)"""
EXPANDED = WRITTEN + """, ex AS (SELECT po.song_id, pos, track, line, string, pitch, tie, start, note_no, start / (960 * q) * 48 AS tick, dur / (960 * q) * 48 AS dur FROM po JOIN um USING (song_id, bar) JOIN wt USING (song_id, bar)),
 tg AS (SELECT *, sum(CASE WHEN tie AND prev = pitch THEN 0 ELSE 1 END) OVER (PARTITION BY song_id, track, string ORDER BY pos, start, note_no ROWS UNBOUNDED PRECEDING) AS part
  FROM (SELECT *, lag(pitch) OVER (PARTITION BY song_id, track, string ORDER BY pos, start, note_no) AS prev FROM ex)),
 en AS (SELECT song_id, track, string, part, arg_min({'line': line, 'bar': pos, 'tick': tick, 'pitch': pitch}, pos * 1000000 + start * 10 + note_no) AS f, round(sum(dur), 4) AS dur, count(*) > 1 AS tied FROM tg GROUP BY ALL),
 nx AS MATERIALIZED (SELECT *, min(line) OVER w <> max(line) OVER w AS shared FROM (SELECT song_id, f.line AS line, track, f.bar AS bar, round(f.tick, 4) AS tick, dur, f.pitch AS pitch, string, tied FROM en) WINDOW w AS (PARTITION BY song_id, pitch, bar, tick)),
 tm AS (SELECT po.song_id, pos, beats AS n, 60e6 / round(coalesce(last_value(tempo IGNORE NULLS) OVER (PARTITION BY po.song_id ORDER BY pos), 120) / q, 4) AS d FROM po JOIN um USING (song_id, bar)),
 tb AS (SELECT *, coalesce(sum(n * d) OVER w, 0) AS t, coalesce(sum(n) OVER w, 0) AS b, lead(pos) OVER (PARTITION BY song_id ORDER BY pos) IS NULL AS z FROM tm WINDOW w AS (PARTITION BY song_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 nb AS MATERIALIZED (SELECT song_id, CAST(b + k AS BIGINT) AS beat_no, CASE WHEN k = n THEN pos + 1 ELSE pos END AS bar, CASE WHEN k = n THEN 1 ELSE k + 1 END AS beat, t + k * d AS t_us FROM (SELECT *, unnest(range(CASE WHEN z THEN n + 1 ELSE n END)) AS k FROM tb))"""


def written(spark, d):
    """Bars and notes of the written scores."""
    k = F.col("o_orderkey")
    bars = X.table(spark, d, "orders").select(
        F.col("o_custkey").alias("song_id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long").alias("bar"), "o_orderkey",
        F.when(k % 4 == 0, 4).when(k % 4 == 1, 3).when(k % 4 == 2, 6).otherwise(5).alias("num"), F.when(k % 4 >= 2, 8).otherwise(4).alias("den"), F.when(k % 3 == 0, 90.0 + k % 60).alias("tempo"),
        (k % 5 == 0).alias("repeat_open"), F.when(k % 7 == 0, 2).when(k % 7 == 3, 3).otherwise(0).alias("repeat_count"), F.when(k % 11 == 1, 1).when(k % 11 == 2, 2).otherwise(0).alias("alternate"),
    )
    n = F.col("l_linenumber")
    notes = X.table(spark, d, "lineitem").join(bars.select("song_id", "bar", "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        "song_id", "bar", (n % 3).alias("track"), F.concat(F.lit("L"), (n % 2).cast("string")).alias("line"), (F.col("l_suppkey") % 2 + 1).cast("int").alias("string"), (40 + F.col("l_partkey") % 6).cast("int").alias("pitch"),
        (F.col("l_partkey") % 3 == 0).alias("tie"), F.expr("(l_linenumber - 1) div 2 * 480").alias("start"), F.lit(480).alias("dur"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).alias("note_no"),
    )
    return bars, notes


@query("SELECT l_orderkey, l_linenumber, CASE WHEN d = 8 AND n >= 6 AND n % 3 = 0 THEN 'dotted_quarter' WHEN d IN (8, 16) THEN 'eighth' ELSE 'quarter' END AS unit, CAST(CASE WHEN d = 8 AND n >= 6 AND n % 3 = 0 THEN n // 3 WHEN d = 2 THEN n * 2 WHEN d = 1 THEN n * 4 WHEN d = 16 THEN greatest(1, (n + 1) // 2) ELSE n END AS INTEGER) AS beats, round(480 / (960 * CASE WHEN d = 8 AND n >= 6 AND n % 3 = 0 THEN 1.5 WHEN d IN (8, 16) THEN 0.5 ELSE 1 END) * 48, 6) AS ticks FROM (SELECT *, l_linenumber + 2 AS n, [1, 2, 4, 8, 16][l_partkey % 5 + 1] AS d FROM lineitem)", cte=False)
def p5_beat_unit(spark, d):
    den = F.element_at(F.array(*[F.lit(x) for x in (1, 2, 4, 8, 16)]), (F.col("l_partkey") % 5 + 1).cast("int"))
    rows = X.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.beat_unit(F.col("l_linenumber") + 2, den).alias("m"))
    return rows.select("l_orderkey", "l_linenumber", "m.unit", "m.beats", F.round(S.ticks_of(F.lit(480), F.col("m.unit")), 6).alias("ticks"))


@query(WRITTEN + " SELECT song_id, pos, bar FROM po", cte=False)
def l9_unroll_repeats(spark, d):
    return score.play_order(written(spark, d)[0])


@query(EXPANDED + " SELECT song_id, line, track, bar, tick, dur, pitch, string, tied, shared FROM nx", cte=False)
def l10_expand_score(spark, d):
    bars, notes = written(spark, d)
    return score.expand(score.play_order(bars), bars, notes)


@query(EXPANDED + " SELECT song_id, beat_no, bar, beat, round(t_us, 3) AS t_us FROM nb", cte=False)
def t6_nominal_beats(spark, d):
    bars, _ = written(spark, d)
    return score.nominal_beats(score.play_order(bars), bars).withColumn("t_us", F.round("t_us", 3))


@query(EXPANDED + """, bs AS (SELECT song_id, bar, beat_no AS bb FROM nb WHERE beat = 1), la AS (SELECT song_id, max(beat_no) - 1 AS m FROM nb GROUP BY 1), pt AS MATERIALIZED (SELECT *, CAST(least(greatest(floor(p), 0), m) AS BIGINT) AS i, CAST(least(greatest(floor(e), 0), m) AS BIGINT) AS j FROM (SELECT nx.*, bb + tick / 48 AS p, bb + (tick + dur) / 48 AS e FROM nx JOIN bs USING (song_id, bar)) JOIN la USING (song_id)),
 sl AS MATERIALIZED (SELECT song_id, beat_no, t_us, lead(t_us) OVER (PARTITION BY song_id ORDER BY beat_no) - t_us AS d FROM nb),
 ti AS (SELECT pt.*, a.t_us + (p - i) * a.d AS x, b.t_us + (e - j) * b.d AS y FROM pt JOIN sl a ON a.song_id = pt.song_id AND a.beat_no = i JOIN sl b ON b.song_id = pt.song_id AND b.beat_no = j)
 SELECT song_id, track, string, bar, tick, pitch, round(greatest(0, x), 3) AS onset_us, round(greatest(x, y), 3) AS offset_us FROM ti""", cte=False)
def t7_fill_times(spark, d):
    bars, notes = written(spark, d)
    order = score.play_order(bars)
    return score.fill_times(score.expand(order, bars, notes), score.nominal_beats(order, bars)).select("song_id", "track", "string", "bar", "tick", "pitch", "onset_us", "offset_us")


@query(", sy AS (SELECT song_id, bar, start_us + (bar * 37 % 101 - 50) * 30000 AS t FROM br) SELECT sy.song_id, sy.bar, arg_min(br.bar, abs(sy.t - br.start_us) * 100000 + br.bar) AS near FROM sy JOIN br ON sy.song_id = br.song_id GROUP BY ALL")
def t8_bar_map_by_downbeat(spark, d):
    bars = X.bars(spark, d)
    system = bars.select("song_id", "bar", (F.col("start_us") + (F.col("bar") * 37 % 101 - 50) * 30000).alias("t"))
    return timeline.nearest(system, bars, ["song_id"], "t", "start_us", "bar").select("song_id", "bar", "near")


@query(""", pa AS (SELECT song_id, start_us AS x, start_us * 1.01 + bar % 5 * 10000 AS y, lead(start_us) OVER w AS x1, lead(start_us * 1.01 + bar % 5 * 10000) OVER w AS y1 FROM br WHERE bar > 3 WINDOW w AS (PARTITION BY song_id ORDER BY bar)), hd AS (SELECT song_id, arg_min(y, x) AS h FROM pa GROUP BY 1)
 SELECT note_id, round(CASE WHEN x IS NULL THEN h WHEN x1 IS NULL THEN y ELSE y + (onset_us - x) * (y1 - y) / (x1 - x) END, 3) AS y FROM nr JOIN hd USING (song_id) ASOF LEFT JOIN pa ON nr.song_id = pa.song_id AND nr.onset_us >= pa.x""")
def t11_path_interp(spark, d):
    path = X.bars(spark, d).where("bar > 3").select("song_id", F.col("start_us").alias("x"), (F.col("start_us") * 1.01 + F.col("bar") % 5 * 10000).alias("y"))
    return timeline.path_interp(X.notes_ref(spark, d), path, ["song_id"], "onset_us", "x", "y").select("note_id", F.round("y", 3).alias("y"))


@query(""", dn AS (SELECT song_id, start_us + 9000 AS t FROM br WHERE bar > 2 AND bar % 10 <> 4), op AS (SELECT DISTINCT song_id, t_us FROM (SELECT dn.song_id, arg_min(bt.t_us, abs(dn.t - bt.t_us)) AS t_us FROM dn JOIN bt ON dn.song_id = bt.song_id AND abs(dn.t - bt.t_us) < 1000000 GROUP BY dn.song_id, dn.t)),
 gb AS (SELECT bt.song_id, bt.t_us, sum(CASE WHEN op.t_us IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY bt.song_id ORDER BY bt.t_us ROWS UNBOUNDED PRECEDING)::BIGINT AS bar FROM bt LEFT JOIN op ON bt.song_id = op.song_id AND bt.t_us = op.t_us),
 gk AS (SELECT *, row_number() OVER (PARTITION BY song_id, bar ORDER BY t_us) AS k, count(*) OVER (PARTITION BY song_id, bar) AS n FROM gb), us AS (SELECT song_id, CAST(floor(median(n)) AS INTEGER) AS u FROM gk WHERE bar > 0 AND k = 1 GROUP BY 1)
 SELECT song_id, t_us, bar, CASE WHEN bar > 0 THEN k ELSE u - n + k END AS beat FROM gk JOIN us USING (song_id)""")
def t12_grid_from_beats(spark, d):
    downbeats = X.bars(spark, d).where("bar > 2 and bar % 10 <> 4").select("song_id", (F.col("start_us") + 9000).alias("t_us"))
    return timeline.grid_from_beats(X.beats(spark, d), downbeats)


@query(" SELECT DISTINCT pitch, CAST(60 + pitch % 12 AS INTEGER) AS folded FROM nr")
def p2_chroma_fold(spark, d):
    return X.notes_ref(spark, d).select("pitch", S.chroma_fold(F.col("pitch")).alias("folded")).distinct()


@query("SELECT p_partkey, round(1 / (1 + exp(-(p_size - 25) / 5.0)), 6) AS p FROM part", cte=False)
def p15_logistic_margin(spark, d):
    return X.table(spark, d, "part").select("p_partkey", F.round(S.logistic((F.col("p_size") - 25) / 5.0), 6).alias("p"))


@query("SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY sha256('dev:' || doc_id), doc_id) % 2 = 1 THEN 'dev' ELSE 'test' END AS split FROM documents", cte=False)
def p12_alternating_split(spark, d):
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.sha2(F.concat(F.lit("dev:"), F.col("doc_id").cast("string")), 256), "doc_id"))
    return X.table(spark, d, "documents").select("doc_id", F.when(place % 2 == 1, "dev").otherwise("test").alias("split"))
