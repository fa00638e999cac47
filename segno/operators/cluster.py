"""Clusters and runs of events on a time axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def chain_components(df: DataFrame, keys: list[str], tol_us: int, t: str = "onset_us", tie: str = "note_id") -> DataFrame:
    """df + part: a gap over tol_us starts a new part."""
    w = Window.partitionBy(*keys).orderBy(t, tie)
    new = F.when(F.col(t) - F.lag(t).over(w) > tol_us, 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("part", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def anchored_clusters(df: DataFrame, keys: list[str], tol_us: int, t: str = "onset_us", tie: str = "note_id") -> DataFrame:
    """df + anchor_us: the onset of the first event of its cluster; an event over tol_us after it opens the next.

    Gaps over tol_us always part clusters, so the fold that carries the anchor only sees one chain component.
    """
    rows = chain_components(df, keys, tol_us, t, tie)
    rest = [c for c in df.columns if c not in keys]
    item = F.struct(F.col(t).alias("_t"), F.col(tie).alias("_tie"), F.struct(*rest).alias("_row"))
    groups = rows.groupBy(*keys, "part").agg(F.array_sort(F.collect_list(item), lambda a, b: F.when(a["_t"] < b["_t"], -1).when(a["_t"] > b["_t"], 1).when(a["_tie"] < b["_tie"], -1).when(a["_tie"] > b["_tie"], 1).otherwise(0)).alias("xs"))
    anchors = F.aggregate(
        "xs", F.array().cast("array<bigint>"), lambda acc, x: F.when((F.size(acc) > 0) & (x["_t"] - F.try_element_at(acc, F.lit(-1)) <= tol_us), acc).otherwise(F.concat(acc, F.array(x["_t"])))
    )
    each = groups.withColumn("anchors", anchors).select(*keys, "anchors", F.explode("xs").alias("_x"))
    anchor = F.array_max(F.filter("anchors", lambda a: a <= F.col("_x._t")))
    return each.select(*keys, "_x._row.*", anchor.alias("anchor_us"))


def merge_spans(spans: DataFrame, keys: list[str], gap_us: int) -> DataFrame:
    """keys, start_us, end_us, n of spans joined where the gap to all before is at most gap_us."""
    w = Window.partitionBy(*keys).orderBy("start_us", "end_us")
    before = F.max("end_us").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = spans.withColumn("_new", F.when(F.col("start_us") - before <= gap_us, 0).otherwise(1))
    run = new.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(*keys, "_run").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.count("*").alias("n")).drop("_run")


def runs_of(df: DataFrame, keys: list[str], order: str, flag: str, least: int = 1) -> DataFrame:
    """keys, flag, first, last, n of each run of equal flags of at least `least` rows."""
    w = Window.partitionBy(*keys).orderBy(order)
    changed = F.when(F.col(flag).eqNullSafe(F.lag(flag).over(w)) & F.lag(order).over(w).isNotNull(), 0).otherwise(1)
    run = df.withColumn("_c", changed).withColumn("_run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = run.groupBy(*keys, "_run", flag).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))
    return out.where(F.col("n") >= least).drop("_run")


def merge_unison(notes: DataFrame, tol_us: int) -> DataFrame:
    """First note of each anchored cluster of one pitch, with the latest offset."""
    c = anchored_clusters(notes, ["song_id", "pitch"], tol_us)
    return c.groupBy("song_id", "pitch", "anchor_us").agg(F.min_by("note_id", F.struct("onset_us", "note_id")).alias("note_id"), F.max("offset_us").alias("offset_us"), F.count("*").alias("n"))


def lowest_of_bundle(notes: DataFrame, tol_us: int) -> DataFrame:
    """Lowest note (then earliest, then id) of each anchored bundle, with the bundle's last offset."""
    c = anchored_clusters(notes, ["song_id", "line"], tol_us)
    return c.groupBy("song_id", "line", "anchor_us").agg(F.min_by("note_id", F.struct("pitch", "onset_us", "note_id")).alias("note_id"), F.min("pitch").alias("pitch"), F.max("offset_us").alias("offset_us"))


def dedupe_events(notes: DataFrame, tol_us: int) -> DataFrame:
    """Anchored clusters of one pitch over all lines: their lines, size, and whether shared."""
    c = anchored_clusters(notes, ["song_id", "pitch"], tol_us)
    lines: Column = F.array_join(F.transform(F.array_sort(F.collect_set("line")), lambda x: x.cast("string")), ",")
    return c.groupBy("song_id", "pitch", "anchor_us").agg(lines.alias("lines"), F.count("*").alias("n"), (F.count_distinct("line") > 1).alias("shared"))
