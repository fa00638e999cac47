"""Steps that are bounded by a song or by a table of candidates, whatever the number of rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from segno.operators import contours, evidence, sheets, trackers
from segno.sources import fixtures as X

DATA = "/root/testdata/sf0.001"


def test_windows_are_not_multiplied_by_the_combinations_of_thresholds(spark):
    r = random.Random(8)
    some = lambda *xs: r.choice([None, *xs])
    rows = [(r.choice(["R0", "R1", "R2", "R3", "mixed"]), some(-15.0, -12.0, -9.0), some(0.5, 0.85, 0.95, 1.0), some(-0.7, 0.5, 0.9), some(-9.0, 5.0), some(0.0, 0.5), some(0.1, 0.3), some(6.0, 9.0), some(0.4, 0.6)) for _ in range(300)]
    windows = spark.createDataFrame(rows, "truth string, sm double, coh double, xcoff double, lag double, r0 double, hard double, ildcoh double, cen double").cache()
    tried = {k: sorted({t, t - evidence.SCALES[k], t + evidence.SCALES[k] / 2}) for k, t in evidence.THRESHOLDS.items()}
    for label, keys in evidence.GROUPS.items():
        grid = {tuple(x.combo): x.macro for x in evidence.threshold_grid(windows, label, tried, evidence.THRESHOLDS).collect()}
        assert len(grid) == 3 ** len(keys)
        for combo in random.Random(9).sample(sorted(grid), 4):
            got = evidence.rule_labels(windows, dict(zip(keys, combo))).selectExpr("truth", "double(rule_label = truth) AS hit").groupBy("truth").avg("hit").agg({"avg(hit)": "avg"}).first()[0]
            assert grid[combo] == pytest.approx(got, abs=2e-9)
        counted = evidence.met_counts(windows, label, tried, evidence.THRESHOLDS)
        assert "Generate" not in counted._jdf.queryExecution().optimizedPlan().toString() and counted.count() < len(rows)


def test_written_bars_are_laid_within_their_song(spark):
    """Bars of two beats, laid on a song by a video that runs 100 ms late; nothing that is tried leaves the song's group."""
    songs = spark.range(3).select(F.col("id").alias("song_id"))
    each = lambda n, **cols: songs.select("song_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("i")).select("song_id", *[F.expr(e).alias(c) for c, e in cols.items()])
    beats = each(40, beat_no="i", t_us="i * 500000")
    pages = each(19, bar="i", t0="i * 1000000 + 350000D", t1="IF(i < 18, (i + 1) * 1000000 + 350000D, NULL)")
    path = each(2, x="i * 20000000 + 100000D", y="i * 20000000D")
    notes = each(36, onset_us="i * 500000 + 10000", pitch="int(IF(i = 7, NULL, 40 + i % 5))")
    pitches = notes.selectExpr("song_id", "onset_us div 1000000 AS bar", "pitch").groupBy("song_id", "bar", "pitch").agg(F.count("*").alias("n"))
    found, blocks = sheets.score_by_time(pages, path, beats, pitches, notes, [-250_000, 0, 250_000])
    assert {tuple(r) for r in found.collect()} == {(s, -250_000, 2.0, 2.0, round(70 / 72, 9), round(70 / 72, 9)) for s in range(3)}
    got = sorted(tuple(r) for r in blocks.collect())
    assert got == sorted((s, b, "even", 0.0, 2 * n - (b == 0), 2 * n, 2 * n) for s in range(3) for b, n in enumerate((8, 8, 2)))
    plan = blocks._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan.split("FlatMapGroupsInArrow")[0] and plan.count("FlatMapGroupsInArrow") == 1


def test_decimals_are_rounded_as_spark_does(spark):
    r = random.Random(4)
    values = [0.0, 1.0000000015, 0.0000000005, -2.0000000025, 1439.1234567895, 5e-10, 1 / 1024, 812.0000000004999] + [round(r.uniform(-1440, 1440), 10) for _ in range(3000)] + [r.uniform(-1440, 1440) for _ in range(3000)]
    want = [x[0] for x in spark.createDataFrame([(v,) for v in values], "v double").select(F.round("v", 9)).collect()]
    assert sheets.half_up(np.array(values)).tolist() == want


@pytest.mark.parametrize("find", [contours.glides, contours.plateaus, contours.bends])
def test_frames_are_not_dealt_once_they_have_grown(spark, find):
    plan = find(X.notes_ref(spark, DATA), X.contour(spark, DATA))._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    at = next(i for i, line in enumerate(plan) if "Generate explode(sequence((onset_us" in line)
    above, level = [], depth(plan[at])
    for line in reversed(plan[:at]):  # the operators that frames go through
        if depth(line) < level:
            level = depth(line)
            above.append(line)
    assert not [line for line in above if "Exchange" in line or "Join" in line] and any("FlatMapCoGroupsInArrow" in line for line in above)


def test_lines_without_frames_and_frames_out_of_order(spark):
    notes = spark.createDataFrame([(1, 0, 1, 0, 600_000, 50), (1, 1, 2, 0, 600_000, 50), (1, None, 3, 0, 600_000, 50), (2, 0, 4, 0, 600_000, 50)], "song_id long, line int, note_id long, onset_us long, offset_us long, pitch int")
    frames = spark.range(60).selectExpr("1L AS song_id", "0 AS line", "59 - id AS frame", "50D AS midi").union(spark.range(60).selectExpr("1L", "int(null)", "id", "50D")).union(spark.range(9).selectExpr("3L", "0", "id", "50D"))
    assert {tuple(r) for r in contours.plateaus(notes, frames).collect()} == {(1, 1, True), (1, 2, False), (1, 3, False), (2, 4, False)}
    assert contours.bends(notes, frames).collect() == []


def test_tracker_frames_are_counted_where_they_grow(spark):
    notes = spark.createDataFrame([(1, 0, 1, 0, 300_000, 40), (1, 0, 2, 200_000, 400_000, 45), (1, 1, 3, 0, 200_000, 90), (2, 0, 4, 0, 200_000, None)], "song_id long, line int, note_id long, onset_us long, offset_us long, pitch int")
    r = random.Random(6)
    rows = [(s, n, k, f, r.choice([None, 40.0, 45.5, 52.0, 90.2, 45.0 + r.random()]), r.choice([None, 0.2, 0.5, 0.9])) for s in (1, 2) for n in (0, 1) for k in (1, 2) for f in range(45) if r.random() < 0.8]
    r.shuffle(rows)
    got = {tuple(x) for x in trackers.tracker_accuracy(notes, spark.createDataFrame(rows, "song_id long, line int, tracker int, frame long, midi double, conf double")).collect()}
    ref = {}
    for s, n, _, a, z, p in [tuple(x) for x in notes.collect()]:
        for f in range(-(-(a + 30_000) // 10_000), (z - 30_000) // 10_000 + 1):
            ref[s, n, f] = ref.get((s, n, f), []) + [p]
    ref = {k: v[0] for k, v in ref.items() if len(v) == 1}
    band = lambda p: {"all"} | ({"30-100"} if p and p < 44 else {"100-400"} if p and p < 68 else set())
    want = set()
    for k in (1, 2):
        for b in ("all", "30-100", "100-400"):
            size = sum(b in band(p) for p in ref.values())
            seen = [(m, c, ref[s, n, f]) for s, n, t, f, m, c in rows if t == k and (s, n, f) in ref and b in band(ref[s, n, f])]
            valid = [m is not None and c is not None and c >= 0.5 for m, c, _ in seen]
            e = [None if m is None or p is None else m - p for m, _, p in seen]
            close, fold = [x is not None and abs(x) <= 0.5 for x in e], [x is not None and abs(x - 12 * round(x / 12)) <= 0.5 for x in e]
            facts = [sum(map(all, zip(close, valid))), sum(map(all, zip(fold, valid))), sum(valid), sum(close), sum(v and f and not c for v, f, c in zip(valid, fold, close))]
            want.add((k, b, size, *[round(x / size, 6) for x in facts]))
    assert got == want
    plan = X.tracker_frames(spark, DATA, by_line=True)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("Generate explode(sequence")[0]
    assert {tuple(x) for x in X.tracker_frames(spark, DATA, by_line=True).collect()} == {tuple(x) for x in X.tracker_frames(spark, DATA).collect()}
