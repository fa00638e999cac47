"""What larger tables brought out: rows that few grow to, long scores, equal levels and the first events of a stream."""

import random

from pyspark.sql import functions as F

from segno.operators import measures, repeats, score
from segno.plans import streams
from segno.sources import fixtures as X

DATA = "/root/testdata/sf0.001"


def plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_beats_are_spread_and_never_broadcast(spark):
    beats = X.beats(spark, DATA)
    joined = beats.join(beats.select("song_id", "beat_no", "t_us").withColumnRenamed("t_us", "again"), ["song_id", "beat_no"])
    assert "BroadcastHashJoin" not in plan(joined)
    assert beats.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def plain_order(bars: list[tuple]) -> list[int]:
    out, i, start, at, jumped = [], 0, 0, 1, False
    while i < len(bars):
        is_open, count, alternate = bars[i]
        if is_open and not jumped:
            start, at = i, 1
        jumped = False
        if alternate and not alternate >> (at - 1) & 1:
            i += 1
            continue
        out.append(i + 1)
        if count > 1 and at < count:
            i, at, jumped = start, at + 1, True
        elif count > 0:
            i, start, at = i + 1, i + 1, 1
        else:
            i += 1
    return out


def test_play_order_ends_where_the_score_does(spark):
    random.seed(3)
    songs = [[(False, 2, 2)] * 12 + [(False, 0, 0)] * 20 + [(False, 3, 0)]]
    songs += [[(random.random() < 0.1, random.choice([0, 0, 2, 3]), random.choice([0, 0, 1, 2, 4])) for _ in range(30)] for _ in range(40)]
    rows = [(s, b + 1, *bar) for s, bars in enumerate(songs) for b, bar in enumerate(bars)]
    order = score.play_order(spark.createDataFrame(rows, "song_id long, bar long, repeat_open boolean, repeat_count int, alternate int"))
    got = {s: [] for s in range(len(songs))}
    for r in order.orderBy("song_id", "pos").collect():
        got[r["song_id"]].append(r["bar"])
    assert got == {s: plain_order(bars) for s, bars in enumerate(songs)}


def test_silence_gate_rounds_once(spark):
    import duckdb

    ends = [(36.55, 37.55, 14.94), (48.74, 54.19, 21.24), (37.92, 52.52, 19.84), (47.38, 59.03, 22.68), (26.46, 47.76, 17.4), (47.52, 65.37, 24.72), (36.7, 46.2, 17.72), (45.83, 67.73, 25.34)]
    rows = [(s, i, x) for s, (low, high, gate) in enumerate(ends) for i, x in enumerate((gate, gate, gate, low, high))]
    got = measures.silence_gate(spark.createDataFrame(rows, "song_id long, n long, v double"), "v", 0.95, 0.4)
    df = spark.createDataFrame(rows, "song_id long, n long, v double").toPandas()  # noqa: F841
    want = duckdb.sql("SELECT song_id, n, v >= 0.4 * q AS kept FROM df JOIN (SELECT song_id, quantile_cont(v, 0.95) AS q FROM df GROUP BY 1) USING (song_id)").fetchall()
    assert sorted(tuple(r) for r in got.select("song_id", "n", "kept").collect()) == sorted(want)


def test_stream_match_keeps_the_first_events(spark, tmp_path):
    events = spark.sql("SELECT id AS event_id, timestamp_ntz'2024-01-01 00:00:01' AS ts, 1L AS user_id, 'click' AS event_type, 1.0D AS value, '{\"k\": 3}' AS props FROM range(1, 200)")
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = {tuple(r) for r in streams.r5_stream_match(spark, str(tmp_path)).collect()}
    moved = {n: (n * 7919 % 121 - 60) * 1000 for n in range(1, 200) if n % 10}
    assert got == {(i, r) for i in range(1, 200) for r, t in moved.items() if abs(1_000_000 // 3600 - 1_000_000 // 3600 - t) <= 50_000}


def test_similar_bars_shuffle_no_pairs(spark):
    vectors = spark.range(400).select((F.col("id") % 2).alias("song_id"), F.expr("id div 8").alias("bar"), F.expr("id div 2 % 4").alias("feature"), (F.col("id") * 7 % 5).cast("double").alias("x"))
    assert "Join" not in plan(repeats.similar_bars(vectors))
