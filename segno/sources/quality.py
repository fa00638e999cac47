"""Row rules and checkpoints."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window


def split_by_rules(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows without a violation, rows with one and the names of the rules they break as `rules`)."""
    broken = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    marked = df.withColumn("rules", broken)
    return marked.where(F.size("rules") == 0).drop("rules"), marked.where(F.size("rules") > 0)


def note_rules(notes: DataFrame, instruments: list[str], lowest: int = 0, highest: int = 127) -> DataFrame:
    """song_id, note_id, rules (joined by commas) of notes that break one: offset (before the onset, or a time lacks), pitch (outside lowest to highest, or lacks), instrument
    (named but unknown), order (by onset, pitch, offset and name it comes before the note just above it), string (a string without a fret or a fret without a string).

    notes: song_id, note_id, place (its line in the file), onset_us, offset_us, pitch, instrument, string, fret.
    """
    key = F.struct("onset_us", "pitch", "offset_us", F.coalesce("instrument", F.lit("")).alias("i"))
    before = F.lag(key).over(Window.partitionBy("song_id").orderBy("place"))
    c = F.col
    broken = {
        "offset": F.coalesce(c("offset_us") < c("onset_us"), F.lit(True)), "pitch": F.coalesce(~c("pitch").between(lowest, highest), F.lit(True)),
        "instrument": F.coalesce(~c("instrument").isin(instruments), F.lit(False)), "order": F.coalesce(key < before, F.lit(False)), "string": c("string").isNull() != c("fret").isNull(),
    }
    names = F.concat_ws(",", *[F.when(b, n) for n, b in broken.items()])
    return notes.select("song_id", "note_id", names.alias("rules")).where("rules <> ''")


def segment_rules(segments: DataFrame) -> DataFrame:
    """song_id, place, fault of segments (song_id, place, start_us, end_us) that are empty, or that start before the end of the one above them (overlap); the first may
    not start before 0."""
    before = F.lag("end_us", 1, 0).over(Window.partitionBy("song_id").orderBy("place"))
    fault = F.when(F.coalesce(F.col("end_us") <= F.col("start_us"), F.lit(True)), "empty").when(F.col("start_us") < before, "overlap")
    return segments.select("song_id", "place", fault.alias("fault")).where("fault is not null")


def grid_violations(beats: DataFrame) -> DataFrame:
    """song_id, beat_no, rules: beats that are not after the one before (time) or in an earlier bar (bar)."""
    w = Window.partitionBy("song_id").orderBy("beat_no")
    seen = beats.select("*", (F.col("t_us") > F.lag("t_us").over(w)).alias("_time"), (F.col("bar") >= F.lag("bar").over(w)).alias("_bar"))
    _, bad = split_by_rules(seen, {r: F.coalesce(~F.col(f"_{r}"), F.lit(False)) for r in ("time", "bar")})
    return bad.drop("_time", "_bar")


def playable(places: DataFrame, span: int = 5) -> DataFrame:
    """song_id, event, n, ok: frets 0 to 24 and within `span` of each other, a note a string, and each string and fret give the pitch."""
    fretted = F.when(F.col("fret") > 0, F.col("fret"))
    near = F.coalesce(F.max(fretted) - F.min(fretted) <= span, F.lit(True))
    ok = F.bool_and(F.col("fret").between(0, 24)) & near & (F.count("*") == F.count_distinct("string")) & F.bool_and(F.col("open") + F.col("fret") == F.col("pitch"))
    return places.groupBy("song_id", "event").agg(F.count("*").alias("n"), ok.alias("ok"))


def track_faults(tracks: DataFrame, lines: DataFrame, kinds: list[str]) -> DataFrame:
    """Tracks of an unknown kind, then those whose line the song does not have, with `fault`."""
    unknown = tracks.where(~F.col("kind").isin(kinds)).withColumn("fault", F.lit("unknown kind"))
    lost = tracks.where(F.col("kind").isin(kinds)).join(lines, ["song_id", "line"], "left_anti").withColumn("fault", F.lit("no such line"))
    return unknown.unionByName(lost)


def checkpoint_folder(spark: SparkSession) -> None:
    """Use the folder of spark.checkpoint.dir; set a temporary one only where none is set and Spark runs on this machine alone."""
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        if not re.fullmatch(r"local(\[[^\[]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="segno-"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that every executor can write to."""
    checkpoint_folder(spark)
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()).rstrip("/")


def dealt(df: DataFrame, *keys: str, times: int = 1) -> DataFrame:
    """`df` by its keys over as many tasks as a shuffle has, or so many times as many. Spark joins small tasks by the bytes they read, so rows that grow or
    are sorted side by side afterwards would fill the few that are left."""
    return df.repartition(times * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet into the shared folder and read again: lineage ends here, and it is computed once."""
    path = f"{shared_folder(df.sparkSession)}/segno-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
