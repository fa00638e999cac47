"""Queries over the registries: statistics, systems, experiments and SQL functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import registry
from ..sources import fixtures as X
from .queries import ITEMS, items, query


@query(ITEMS + " SELECT arm, round(100.0 * 2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS f1, round(100.0 * sum(tp) / (sum(tp) + sum(fp)), 6) AS precision, round(100.0 * sum(tp) / (sum(tp) + sum(fn)), 6) AS recall FROM it GROUP BY 1", cte=False)
def u1_statistics_registry(spark, d):
    rows = items(spark, d)
    out = registry.pooled(rows, ["arm"], "f1", ["tp", "fp", "fn"]).withColumnRenamed("value", "f1")
    for name, counts in (("precision", ["tp", "fp"]), ("recall", ["tp", "fn"])):
        out = out.join(registry.pooled(rows, ["arm"], name, counts).withColumnRenamed("value", name), "arm")
    return out


@query(" SELECT 'single_line' AS system, count(*) AS n, CAST(count_if(line = 0) AS BIGINT) AS hit FROM nr UNION ALL SELECT 'by_pitch', count(*), CAST(count_if(line = pitch % 3) AS BIGINT) FROM nr")
def u2_systems_registry(spark, d):
    notes = X.notes_ref(spark, d)
    rows = registry.predictions("single_line", spark, notes).unionByName(registry.predictions("by_pitch", spark, notes))
    return rows.join(notes.select("note_id", F.col("line").alias("truth")), "note_id").groupBy("system").agg(F.count("*").alias("n"), F.count_if(F.col("line") == F.col("truth")).alias("hit"))


@query(ITEMS + " SELECT s.spec, s.arm, round(CASE WHEN s.stat = 'f1' THEN 100.0 * 2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) ELSE 100.0 * sum(tp) / (sum(tp) + sum(fp)) END, 6) AS value FROM (SELECT 'e1' AS spec, 'F' AS arm, 'f1' AS stat UNION ALL SELECT 'e2', 'O', 'precision') s JOIN it ON it.arm = s.arm GROUP BY s.spec, s.arm, s.stat", cte=False)
def u3_experiments_registry(spark, d):
    """Experiments are rows: a name, an arm and a statistic."""
    specs = [("e1", "F", "f1", ["tp", "fp", "fn"]), ("e2", "O", "precision", ["tp", "fp"])]
    rows = items(spark, d)
    parts = [registry.pooled(rows.where(F.col("arm") == arm), ["arm"], stat, counts).select(F.lit(name).alias("spec"), "arm", "value") for name, arm, stat, counts in specs]
    return parts[0].unionByName(parts[1])


@query(" SELECT pitch, round(440 * pow(2.0, (pitch - 69) / 12), 6) AS hz, CAST(pitch % 12 AS INTEGER) AS pc, round(1 / (1 + exp(-(pitch - 52) / 4.0)), 6) AS p FROM (SELECT DISTINCT pitch FROM nr)")
def u5_sql_functions(spark, d):
    registry.register_functions(spark)
    notes = X.notes_ref(spark, d).select("pitch").distinct()
    return notes.selectExpr("pitch", "round(midi_hz(pitch), 6) AS hz", "pitch_class(pitch) AS pc", "round(logistic((pitch - 52) / 4.0D), 6) AS p")
