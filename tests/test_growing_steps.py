"""Steps whose cost must grow with the rows and not with the length of a song or with the few keys of a window."""

import random

from pyspark.sql import functions as F

from segno.operators import folds, measures, metrics, trackers
from segno.plans import metre


def plain_beats(rows):
    last, out = -9_000_000_000_000, []
    for b, t in sorted(rows):
        last = t if t > last + 1000 else last + 1000
        out.append((b, last))
    return out


def test_refined_beats_are_one_pass_over_a_song(spark):
    random.seed(5)
    beats = [(s, b, b * 700 + random.randrange(900)) for s in range(3) for b in range(400)]
    df = spark.createDataFrame(beats, "song_id long, beat_no long, t_us long")
    onsets = spark.createDataFrame([(9, 0, 1.0)], "song_id long, onset_us long, strength double")
    refined = folds.refine_beats(df, onsets)
    got = {s: [] for s in range(3)}
    for r in refined.orderBy("song_id", "beat_no").collect():
        got[r.song_id].append((r.beat_no, r.t_us))
    assert got == {s: plain_beats([x[1:] for x in beats if x[0] == s]) for s in range(3)}
    assert "FlatMapGroupsInArrow" in refined._jdf.queryExecution().optimizedPlan().toString()


def test_drawn_groups_are_spread_before_they_grow(spark):
    items = spark.range(300).select(F.lit("a").alias("m"), (F.col("id") % 100).alias("g"), *[(F.col("id") * k % 7).alias(f"{c}_{x}") for k, (c, x) in enumerate([(c, x) for x in "ab" for c in ("tp", "fp", "fn")], 2)])
    got = measures.paired_bootstrap(items, ["m"], "g", 50)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan[plan.index("explode") :].split("Window")[0]
    assert got.count() == 1


def test_bag_counts_shuffle_once_and_unknown_keys_match_nothing(spark):
    rows = spark.createDataFrame([(1, 0, 5), (1, 1, 5), (1, 1, 5), (1, 0, None), (2, 0, 7), (None, 0, 5)], "bar long, part int, p int")
    est = spark.createDataFrame([(1, 5), (1, 5), (1, 5), (1, None), (3, 7), (None, 5)], "bar long, p int")
    got = metrics.bag_counts(rows, est, ["bar"], "p", "part")
    assert {tuple(r) for r in got.collect()} == {(1, 2, 3, 4), (2, 0, 1, 0), (3, 0, 0, 1), (None, 0, 1, 1)}
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


def test_metre_tables_are_computed_once(spark):
    plan = metre.w30_quantize_notes(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan.replace("Generate explode(ps", "") and "events.parquet" not in plan
    assert plan.count("Relation") < 12


def test_tracker_bands_are_counted_before_they_are_spread(spark):
    notes = spark.createDataFrame([(1, 0, 1, 0, 500_000, 40), (1, 0, 2, 600_000, 900_000, 50), (1, 1, 3, 0, 300_000, 90)], "song_id long, line int, note_id long, onset_us long, offset_us long, pitch int")
    frames = spark.range(0, 100).selectExpr("1L AS song_id", "int(id % 2) AS line", "1 AS tracker", "id AS frame", "IF(id % 2 = 0, IF(id < 60, 40D, 62D), 90D) AS midi", "id % 10 / 10 AS conf")
    got = trackers.tracker_accuracy(notes, frames)
    size = lambda a, z: (z - 30_000) // 10_000 - (a + 30_000) // 10_000 + 1
    want = {"all": size(0, 500_000) + size(600_000, 900_000) + size(0, 300_000), "30-100": size(0, 500_000), "100-400": size(600_000, 900_000)}
    assert {r.band: r.frames for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    spread = [i for i, line in enumerate(lines) if "Generate explode(" in line and "sequence" not in line]
    assert len(spread) == 2 and all("Aggregate" in lines[i + 1] + lines[i + 2] for i in spread)
