"""Edges of the sweeps, coverage, offsets and peaks."""

from pyspark.sql import functions as F

from segno.functions import scalars as S
from segno.operators import measures


def test_bars_without_spans_are_not_covered(spark):
    bars = spark.createDataFrame([(1, 1, 0, 2_000_000), (1, 2, 2_000_000, 4_000_000)], "song_id long, bar long, start_us long, end_us long")
    spans = spark.createDataFrame([(1, 500_000, 1_000_000), (1, 800_000, 1_500_000), (1, 3_900_000, 3_900_000)], "song_id long, start_us long, end_us long")
    assert sorted(map(tuple, measures.covered_bars(bars, spans).collect())) == [(1, 1, 1_000_000, True), (1, 2, 0, False)]
    assert sorted(map(tuple, measures.covered_bars(bars, spans.limit(0)).collect())) == [(1, 1, 0, False), (1, 2, 0, False)]


def test_first_of_equal_offsets_wins(spark):
    notes = spark.createDataFrame([(1, b, 60) for b in range(4)], "song_id long, bar long, pitch int")
    one = spark.createDataFrame([(1, 2, 60)], "song_id long, bar long, pitch int")
    assert [tuple(r) for r in measures.best_offset(notes, one).collect()] == [(1, -2, 1, 0.4)]


def test_corruption_repeats(spark):
    notes = spark.range(500).select(F.lit(1).alias("song_id"), F.col("id").alias("note_id"), (F.col("id") * 1000).alias("onset_us"), F.lit(60).alias("pitch"))
    a, b = (sorted(map(tuple, measures.corrupt(notes.repartition(n), "s").collect())) for n in (1, 5))
    assert a == b and 400 < len(a) < 490


def test_pool_without_weight_is_null(spark):
    rows = spark.createDataFrame([("a", 1.0, 0.0), ("b", 2.0, 3.0)], "k string, x double, w double")
    assert sorted(map(tuple, measures.weighted_pool(rows, "k", "x", "w").collect())) == [("a", None), ("b", 2.0)]


def test_spec_is_trimmed(spark):
    spec = spark.range(1).select(S.parse_spec(F.lit("k = v; a=b c ")).alias("m")).first()["m"]
    assert spec == {"k": "v", "a": "b c"}
