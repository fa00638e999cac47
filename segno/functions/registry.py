"""Statistics and systems by name: what a metric or a prediction is, without a change to the operators that use them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scalars

#: A statistic is an expression of pooled counts.
STATISTICS: dict[str, Callable[..., Column]] = {
    "f1": lambda tp, fp, fn: F.when(2 * tp + fp + fn > 0, 100.0 * 2 * tp / (2 * tp + fp + fn)),
    "precision": lambda tp, fp: F.when(tp + fp > 0, 100.0 * tp / (tp + fp)),
    "recall": lambda tp, fn: F.when(tp + fn > 0, 100.0 * tp / (tp + fn)),
    "mean": lambda total, n: F.when(n > 0, total / n),
    "ratio": lambda total, n: F.when(n > 0, 100.0 * total / n),
}
#: A system gives predictions (item, note_id, line, p) of a song table.
SYSTEMS: dict[str, Callable[[SparkSession, DataFrame], DataFrame]] = {}


def register_statistic(name: str, statistic: Callable[..., Column]) -> None:
    STATISTICS[name] = statistic


def register_system(name: str, system: Callable[[SparkSession, DataFrame], DataFrame]) -> None:
    SYSTEMS[name] = system


def predictions(name: str, spark: SparkSession, notes: DataFrame) -> DataFrame:
    """The rows of a system under its name, in the columns that every system shares."""
    return SYSTEMS[name](spark, notes).select(F.lit(name).alias("system"), "item", "note_id", "line", "p")


def pooled(rows: DataFrame, by: list[str], statistic: str, counts: list[str]) -> DataFrame:
    """by, value: a statistic of the counts summed over `by`."""
    sums = rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in counts])
    return sums.select(*by, F.round(STATISTICS[statistic](*[F.col(c) for c in counts]), 6).alias("value"))


def register_functions(spark: SparkSession) -> None:
    """SQL functions of the scalar rules: midi_hz, hz_midi, pitch_class and logistic of the session."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION midi_hz(p DOUBLE) RETURNS DOUBLE RETURN 440 * power(2, (p - 69) / 12)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION hz_midi(hz DOUBLE) RETURNS DOUBLE RETURN CASE WHEN hz > 0 THEN 69 + 12 * log2(hz / 440) END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION pitch_class(p DOUBLE) RETURNS INT RETURN pmod(CAST(round(p) AS INT), 12)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION logistic(m DOUBLE) RETURNS DOUBLE RETURN 1 / (1 + exp(-m))")


SYSTEMS["single_line"] = lambda spark, notes: notes.select(F.col("song_id").alias("item"), "note_id", F.lit(0).alias("line"), F.lit(1.0).alias("p"))
SYSTEMS["by_pitch"] = lambda spark, notes: notes.select(F.col("song_id").alias("item"), "note_id", scalars.pitch_class(F.col("pitch")).alias("pc"), (F.col("pitch") % 3).alias("line"), F.lit(0.5).alias("p"))
