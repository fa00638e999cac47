"""Readers and writers of note sets, grids, sections, annotations, labels, metrics, logs and event files, one row an element.

Paths are what spark.read takes: a file, a folder or a glob on any file system. Every reader keeps `file`, the path of the
file a row comes from, so that rows of many files can be told apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

NOTE = "onset_s double, offset_s double, pitch int, instrument string"
NOTE_SET = f"format string, view string, time_offset_applied_s double, audio_duration_s double, segments array<array<double>>, notes array<struct<{NOTE.replace(' double', ':double').replace(' int', ':int').replace(' string', ':string')}>>"
GRID = "format string, duration_s double, tpb int, beats array<struct<t_s:double,bar:int,beat:int>>, bars array<struct<bar:int,start_s:double,end_s:double,n_beats:int>>, tempo array<struct<start_s:double,bpm:double>>, meter array<struct<start_bar:int,end_bar:int,numerator:int,denominator:int>>"
SECTIONS = "format string, sections array<struct<id:string,label:string,start_bar:int,end_bar:int>>, groups array<struct<label:string,reference:string,occurrences:array<struct<section:string,start_bar:int,n_bars:int,offset_s:double>>>>, bars array<struct<bar:int,matches:array<struct<bar:int,score:double,offset_s:double>>>>"
#: Columns of a metrics table and the order of its rows; the other columns break ties.
METRICS = ["suite", "system", "dataset", "item", "group", "scenario", "section", "line", "rung", "metric", "value", "tp", "fp", "fn", "n", "ci_low", "ci_high", "note"]
METRICS_ORDER = ["suite", "dataset", "item", "scenario", "section", "line", "metric", "rung"]


def file_name() -> Column:
    return F.col("_metadata.file_path").alias("file")


def documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, one a line or one a file, with their file."""
    return spark.read.schema(schema).json(path).select("*", file_name())


def current_format(old: str, new: str) -> Column:
    """The format id with a former product prefix replaced."""
    return F.regexp_replace("format", f"^{old}\\.", f"{new}.")


def read_note_sets(spark: SparkSession, path: str, old: str = "old", new: str = "segno") -> tuple[DataFrame, DataFrame]:
    """(headers: file, format, view, ...; notes: file, note_no, NOTE) of note-set documents."""
    docs = documents(spark, path, NOTE_SET).withColumn("format", current_format(old, new))
    return docs.drop("notes"), docs.select("file", F.posexplode("notes").alias("note_no", "n")).select("file", "note_no", "n.*")


def read_grids(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """beats (file, beat_no, t_s, bar, beat), bars, tempo and meter of grid documents."""
    docs = documents(spark, path, GRID)
    out = {"beats": docs.select("file", F.posexplode("beats").alias("beat_no", "x")).select("file", "beat_no", "x.*")}
    return out | {part: docs.select("file", F.explode(part).alias("x")).select("file", "x.*") for part in ("bars", "tempo", "meter")}


def read_sections(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """sections, occurrences of repeat groups and bar matches (in order) of section documents."""
    docs = documents(spark, path, SECTIONS)
    groups = docs.select("file", F.explode_outer("groups").alias("g")).select("file", "g.label", "g.reference", F.explode_outer("g.occurrences").alias("o"))
    bars = docs.select("file", F.explode_outer("bars").alias("b")).select("file", F.col("b.bar").alias("bar"), F.posexplode_outer("b.matches").alias("rank", "m"))
    return {
        "sections": docs.select("file", F.explode("sections").alias("x")).select("file", "x.*"),
        "occurrences": groups.where("o is not null").select("file", "label", "reference", "o.*"),
        "matches": bars.where("m is not null").select("file", "bar", "rank", F.col("m.bar").alias("other"), "m.score", "m.offset_s"),
    }


def read_annotations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(notes: file, string, onset_s, offset_s, pitch; beats: file, t_s, position; tempo: file, bpm) of annotation documents
    whose data are a list of observations or one list for each of their fields; the string is 6 less the source, 0 to 5."""
    docs = documents(spark, path, "annotations array<struct<namespace:string,annotation_metadata:struct<data_source:string>,data:string>>")
    each = docs.select("file", F.explode("annotations").alias("a")).select("file", "a.namespace", F.col("a.annotation_metadata.data_source").alias("source"), "a.data")

    def observations(value: str, *spaces: str) -> DataFrame:
        row = f"struct<time:double,duration:double,value:{value}>"
        listed = F.from_json("data", f"array<{row}>")
        columns = F.from_json("data", f"struct<time:array<double>,duration:array<double>,value:array<{value}>>")
        zipped = F.transform(F.arrays_zip(columns["time"], columns["duration"], columns["value"]), lambda x: F.struct(x["time"], x["duration"], x["value"]))
        data = F.when(F.col("data").startswith("["), listed).otherwise(F.filter(zipped, lambda x: x["time"].isNotNull()))
        return each.where(F.col("namespace").isin(*spaces)).select("file", "source", F.explode(data).alias("x")).select("file", "source", "x.*")

    notes = observations("double", "note_midi").where("try_cast(source as int) between 0 and 5")
    notes = notes.select("file", (6 - F.col("source").cast("int")).alias("string"), F.col("time").alias("onset_s"), (F.col("time") + F.col("duration")).alias("offset_s"), F.round("value").cast("int").alias("pitch"))
    beats = observations("struct<position:int>", "beat_position").select("file", F.round("time", 6).alias("t_s"), F.coalesce("value.position", F.lit(0)).alias("position"))
    tempo = observations("double", "tempo").groupBy("file").agg(F.min_by("value", "time").alias("bpm"))
    return notes, beats, tempo


def read_labels_tsv(spark: SparkSession, path: str) -> DataFrame:
    """file, t_s, bar, label of tab-separated label tracks: a decimal comma is a point; blank lines, comments and lines without a time are skipped."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where("trim(value) <> '' and not startswith(value, '\\\\')").select(file_name(), parts.alias("p"))
    t, label = F.replace(F.trim(F.col("p")[0]), F.lit(","), F.lit(".")).try_cast("double"), F.coalesce(F.trim(F.get("p", F.lit(2))), F.lit(""))
    rows = rows.select("file", F.round(t, 6).alias("t_s"), label.alias("label")).where("t_s is not null")
    return rows.select("file", "t_s", F.regexp_extract("label", r"(?i)^bar\s*(-?\d+)$", 1).try_cast("int").alias("bar"), "label")


def normal_metrics(rows: DataFrame) -> DataFrame:
    """The metric columns as text; unknown columns and rows without a metric are errors, absent columns are empty."""
    unknown = sorted(set(rows.columns) - set(METRICS))
    if unknown:
        raise ValueError(f"unknown metrics columns: {unknown}")
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in rows.columns else F.lit("")
    out = rows.select(*[shown(c).alias(c) for c in METRICS])
    return out.withColumn("metric", F.when(F.col("metric") == "", F.raise_error(F.lit("a metrics row needs a metric"))).otherwise(F.col("metric")))


def write_metrics(rows: DataFrame, path: str, report: bool = False) -> None:
    """Metrics as Parquet; a report is one sorted CSV file besides, so only summaries should ask for it."""
    normal = normal_metrics(rows)
    normal.write.mode("overwrite").parquet(path)
    if report:
        order = METRICS_ORDER + [c for c in METRICS if c not in METRICS_ORDER]
        normal.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}_report")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(", ".join(f"`{c}` string" for c in METRICS)).parquet(path)


def read_jsonl_log(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no, entry (JSON text), id, op of JSON-lines logs, a log a file: a torn last line is left out, damage elsewhere is an error."""
    lines = spark.read.text(path, wholetext=True).select(file_name(), F.posexplode(F.split("value", "\n")).alias("line_no", "entry")).where("trim(entry) <> ''")
    last = F.max("line_no").over(Window.partitionBy("file"))
    parsed = lines.select("file", (F.col("line_no") + 1).alias("line_no"), "entry", (F.col("line_no") == last).alias("_last"), F.try_parse_json("entry").alias("j"))
    kept = parsed.where("j is not null or not _last")
    id_, op = (F.try_variant_get("j", f"$.{k}", "string") for k in ("id", "op"))
    bad = F.raise_error(F.concat(F.lit("damaged log line "), F.col("line_no").cast("string"), F.lit(" of "), F.col("file")))
    return kept.select("file", "line_no", "entry", F.when(id_.isNull() | op.isNull(), bad).otherwise(id_).alias("id"), op.alias("op"))


def index_files(spark: SparkSession, path: str, kinds: dict[str, str], track: str) -> DataFrame:
    """track and, for each kind, its first file: files of a tree by the pattern of their kind; `track` extracts the id from a path. Hidden
    and partial files are left out; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    files = files.where(~name.startswith(".") & ~name.startswith("_") & ~name.endswith(".part") & ~F.col("path").rlike(r"/\.[^/]+/"))
    kind = F.coalesce(*[F.when(name.rlike(p), k) for k, p in kinds.items()])
    rows = files.select(F.regexp_extract("path", track, 1).alias("track"), kind.alias("kind"), name.alias("name"), "path").where("kind is not null and track <> ''")
    return rows.groupBy("track").pivot("kind", list(kinds)).agg(F.min("name"))


def publish_partition(rows: DataFrame, path: str, key: str) -> DataFrame:
    """Write rows by `key`, each key once: keys that are complete stay as they are, others are written whole. The keys that were new."""
    spark = rows.sparkSession
    here = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    held = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(here)
    if held:
        rows = rows.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")
    new = rows.select(key).distinct()
    rows.write.mode("append").partitionBy(key).parquet(path)
    return new


def read_event_xml(spark: SparkSession, path: str, strings: int = 4) -> DataFrame:
    """file, onset_s, offset_s, pitch, string (1 is the highest), fret, style, instrument of per-note event files and their header."""
    events = spark.read.format("xml").option("rowTag", "event").schema("pitch double, onsetSec double, offsetSec double, stringNumber int, fretNumber int, excitationStyle string").load(path)
    header = spark.read.format("xml").option("rowTag", "globalParameter").schema("instrument string, instrumentTuning string").load(path).select(file_name(), "instrument")
    renumbered = F.when(F.col("stringNumber").between(1, strings), strings - F.col("stringNumber") + 1)
    rows = events.select(file_name(), F.col("onsetSec").alias("onset_s"), F.col("offsetSec").alias("offset_s"), F.col("pitch").cast("int").alias("pitch"), renumbered.alias("string"), F.col("fretNumber").alias("fret"), F.col("excitationStyle").alias("style"))
    return rows.join(header, "file", "left")


def read_beats_csv(spark: SparkSession, path: str) -> DataFrame:
    """file, t_s, downbeat of rows `time,bar.beat`; short and blank rows are skipped; beat 1 is a downbeat."""
    rows = spark.read.schema("t string, place string").csv(path).select("*", file_name()).where("trim(coalesce(t, '')) <> '' and place is not null")
    return rows.select("file", F.round(F.col("t").cast("double"), 6).alias("t_s"), (F.substring_index(F.trim("place"), ".", -1) == "1").alias("downbeat"))
