"""Queries that write files from the given tables and read them back, and checks of what was read."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import fixtures as X
from ..sources import quality, readers
from .queries import query

S = 1e6


def folder(spark, name: str) -> str:
    return f"{quality.shared_folder(spark)}/segno-{uuid.uuid4().hex}/{name}"


def by_song(rows, spark, name: str, ext: str = "json", lines: bool = False) -> str:
    """Rows (song_id, value) as text files, one a song, named song_<id>.<ext>."""
    path = folder(spark, name)
    rows.select(F.concat(F.lit("song_"), F.col("song_id").cast("string")).alias("song"), "value").repartition("song").write.partitionBy("song").text(path)
    return path


def song() -> F.Column:
    return F.regexp_extract(F.col("_metadata.file_path"), r"song=song_(\d+)", 1).cast("long")


def note_struct():
    return F.struct((F.col("onset_us") / S).alias("onset_s"), (F.col("offset_us") / S).alias("offset_s"), F.col("pitch").cast("int").alias("pitch"), "instrument")


@query(" SELECT song_id, count(*) AS notes, round(sum(onset_us) / 1e6, 6) AS onsets, sum(pitch)::BIGINT AS pitches, 'segno.notes/1' AS format FROM nr GROUP BY 1")
def a1_read_note_sets(spark, d):
    docs = X.notes_ref(spark, d).groupBy("song_id").agg(F.array_sort(F.collect_list(note_struct())).alias("notes"))
    value = F.to_json(F.struct(F.lit("old.notes/1").alias("format"), F.concat(F.lit("mix_"), F.col("song_id").cast("string")).alias("view"), "notes"))
    path = folder(spark, "notes")
    docs.select(value.alias("value")).write.text(path)
    docs = readers.documents(spark, path, readers.NOTE_SET).withColumn("format", readers.current_format("old", "segno"))
    rows = docs.select(F.split_part("view", F.lit("_"), F.lit(2)).cast("long").alias("song_id"), "format", F.explode("notes").alias("n"))
    return rows.groupBy("song_id", "format").agg(F.count("*").alias("notes"), F.round(F.sum("n.onset_s"), 6).alias("onsets"), F.sum("n.pitch").alias("pitches"))


@query(" SELECT beat_no, count(*) AS songs, round(sum(t_us) / 1e6, 6) AS t, sum(bar)::BIGINT AS bars FROM bt GROUP BY 1")
def a2_read_grids(spark, d):
    beats = X.beats(spark, d).groupBy("song_id").agg(F.array_sort(F.collect_list(F.struct((F.col("t_us") / S).alias("t_s"), F.col("bar").cast("int").alias("bar"), F.col("beat").cast("int").alias("beat")))).alias("beats"))
    path = folder(spark, "grids")
    beats.select(F.to_json(F.struct(F.lit("segno.grid/1").alias("format"), F.lit(48).alias("tpb"), "beats")).alias("value")).write.text(path)
    rows = readers.read_grids(spark, path)["beats"]
    return rows.groupBy(F.col("beat_no").cast("long").alias("beat_no")).agg(F.count("*").alias("songs"), F.round(F.sum("t_s"), 6).alias("t"), F.sum("bar").alias("bars"))


@query(" SELECT CAST(section AS VARCHAR) AS id, label, start_bar, end_bar, count(*) AS songs FROM sc GROUP BY ALL")
def a3_read_sections(spark, d):
    rows = X.sections(spark, d).groupBy("song_id").agg(F.array_sort(F.collect_list(F.struct(F.col("section").cast("string").alias("id"), "label", F.col("start_bar").cast("int").alias("start_bar"), F.col("end_bar").cast("int").alias("end_bar")))).alias("sections"))
    path = folder(spark, "sections")
    rows.select(F.to_json(F.struct(F.lit("segno.sections/1").alias("format"), "sections")).alias("value")).write.text(path)
    return readers.read_sections(spark, path)["sections"].groupBy("id", "label", "start_bar", "end_bar").agg(F.count("*").alias("songs"))


@query(" SELECT CAST(6 - line AS INTEGER) AS string, pitch, count(*) AS n, round(sum(onset_us) / 1e6, 6) AS onsets, round(sum(offset_us) / 1e6, 6) AS offsets FROM nr GROUP BY ALL")
def a4_read_annotations(spark, d):
    """Even songs are written as lists of observations, odd ones as lists of their fields."""
    n = X.notes_ref(spark, d).groupBy("song_id", "line").agg(F.collect_list(F.struct((F.col("onset_us") / S).alias("time"), ((F.col("offset_us") - F.col("onset_us")) / S).alias("duration"), F.col("pitch").cast("double").alias("value"))).alias("x"))
    columns = F.struct(*[F.col(f"x.{c}").alias(c) for c in ("time", "duration", "value")])
    data = F.when(F.col("song_id") % 2 == 0, F.to_json("x")).otherwise(F.to_json(columns))
    ann = F.concat(F.lit('{"namespace":"note_midi","annotation_metadata":{"data_source":"'), F.col("line").cast("string"), F.lit('"},"data":'), data, F.lit("}"))
    path = folder(spark, "annotations")
    n.groupBy("song_id").agg(F.collect_list(ann).alias("a")).select(F.concat(F.lit('{"annotations":['), F.array_join("a", ","), F.lit("]}")).alias("value")).write.text(path)
    notes, _, _ = readers.read_annotations(spark, path)
    return notes.groupBy("string", "pitch").agg(F.count("*").alias("n"), F.round(F.sum("onset_s"), 6).alias("onsets"), F.round(F.sum("offset_s"), 6).alias("offsets"))


@query(" SELECT bar, count(*) AS taps, round(sum(start_us) / 1e6, 6) AS t FROM (SELECT CASE WHEN bar % 3 = 0 THEN NULL ELSE bar END AS bar, start_us FROM br) GROUP BY 1")
def a5_read_labels_tsv(spark, d):
    """Every third tap has a free label; comments and lines without a time are among the rows."""
    b = X.bars(spark, d)
    t = F.replace((F.col("start_us") / S).cast("decimal(20,6)").cast("string"), F.lit("."), F.lit(","))
    label = F.when(F.col("bar") % 3 == 0, F.lit("tap")).otherwise(F.concat(F.lit("bar "), F.col("bar").cast("string")))
    lines = F.array(F.concat_ws("\t", t, t, label), F.lit("\\ a comment"), F.lit("x\ty\tbar 9"))
    path = folder(spark, "labels")
    b.select(F.explode(lines).alias("value")).write.text(path)
    return readers.read_labels_tsv(spark, path).groupBy("bar").agg(F.count("*").alias("taps"), F.round(F.sum("t_s"), 6).alias("t"))


@query(" SELECT 'song_' || song_id AS item, instrument AS system, CAST(count(*) AS VARCHAR) AS n, '' AS note FROM nr GROUP BY song_id, instrument")
def a6_metrics_round_trip(spark, d):
    rows = X.notes_ref(spark, d).groupBy("song_id", "instrument").agg(F.count("*").alias("n"))
    rows = rows.select(F.lit("notes").alias("suite"), F.col("instrument").alias("system"), F.concat(F.lit("song_"), F.col("song_id").cast("string")).alias("item"), F.lit("count").alias("metric"), "n")
    path = folder(spark, "metrics")
    readers.write_metrics(rows, path)
    return readers.read_metrics(spark, path).select("item", "system", "n", "note")


@query(" SELECT 'e' || note_id AS id, instrument AS op FROM nr WHERE line < 2")
def a7_read_jsonl_log(spark, d):
    """A log for each song of the notes of two lines; every file ends in a torn line."""
    n = X.notes_ref(spark, d).where("line < 2").select("song_id", "note_id", F.to_json(F.struct(F.concat(F.lit("e"), F.col("note_id").cast("string")).alias("id"), F.col("instrument").alias("op"))).alias("value"))
    logs = n.groupBy("song_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("note_id", "value"))), lambda x: x["value"]), "\n").alias("v"))
    path = by_song(logs.select("song_id", F.concat("v", F.lit('\n{"id": "e9", "op')).alias("value")), spark, "logs")
    return readers.read_jsonl_log(spark, path + "/*").select("id", "op")


@query(" SELECT 'song=song_' || song_id AS track, 1 AS logs FROM sg")
def a8_index_files(spark, d):
    """One log file for each song in a tree; hidden and marker files are no part of it."""
    path = by_song(X.songs(spark, d).select("song_id", F.lit("x").alias("value")), spark, "tree")
    return readers.index_files(spark, path, {"log": r"^part-.*\.txt$"}, r"/(song=song_\d+)/").select("track", F.col("log").isNotNull().cast("int").alias("logs"))


@query(" SELECT song_id % 7 AS key, count(*) AS n FROM nr GROUP BY 1")
def a9_publish_partition(spark, d):
    """Published twice: the second time every key is complete, so nothing changes."""
    rows, path = X.notes_ref(spark, d).select((F.col("song_id") % 7).alias("key"), "note_id"), folder(spark, "published")
    readers.publish_partition(rows, path, "key")
    readers.publish_partition(rows, path, "key")
    return spark.read.parquet(path).groupBy(F.col("key").cast("long").alias("key")).agg(F.count("*").alias("n"))


@query(" SELECT CAST(4 - (line % 4 + 1) + 1 AS INTEGER) AS string, instrument AS style, count(*) AS n, round(sum(onset_us) / 1e6, 6) AS onsets, sum(pitch)::BIGINT AS pitches, 'bass' AS instrument FROM nr GROUP BY line, nr.instrument")
def a12_read_event_xml(spark, d):
    tag = lambda k, v: F.concat(F.lit(f"<{k}>"), v.cast("string"), F.lit(f"</{k}>"))
    event = F.concat(F.lit("<event>"), tag("pitch", F.col("pitch")), tag("onsetSec", (F.col("onset_us") / S).cast("decimal(20,6)")), tag("offsetSec", (F.col("offset_us") / S).cast("decimal(20,6)")), tag("stringNumber", F.col("line") % 4 + 1), tag("fretNumber", F.col("pitch") % 12), tag("excitationStyle", F.col("instrument")), F.lit("</event>"))
    docs = X.notes_ref(spark, d).groupBy("song_id").agg(F.array_join(F.collect_list(event), "").alias("e"))
    value = F.concat(F.lit("<rec><globalParameter><instrument>bass</instrument><instrumentTuning>28,33,38,43</instrumentTuning></globalParameter><transcription>"), "e", F.lit("</transcription></rec>"))
    path = by_song(docs.select("song_id", value.alias("value")), spark, "events")
    rows = readers.read_event_xml(spark, path + "/*")
    return rows.groupBy("string", "style", "instrument").agg(F.count("*").alias("n"), F.round(F.sum("onset_s"), 6).alias("onsets"), F.sum("pitch").alias("pitches"))


@query(" SELECT beat = 1 AS downbeat, count(*) AS n, round(sum(t_us) / 1e6, 6) AS t FROM bt GROUP BY 1")
def a13_read_beats_csv(spark, d):
    b = X.beats(spark, d)
    line = F.concat((F.col("t_us") / S).cast("decimal(20,6)").cast("string"), F.lit(","), F.col("bar").cast("string"), F.lit("."), F.col("beat").cast("string"))
    path = folder(spark, "beats")
    b.select(F.explode(F.array(line, F.lit("7.5"), F.lit("  "))).alias("value")).write.text(path)
    return readers.read_beats_csv(spark, path).groupBy("downbeat").agg(F.count("*").alias("n"), F.round(F.sum("t_s"), 6).alias("t"))


@query(""", g AS (SELECT song_id, beat_no, CASE WHEN beat_no % 97 = 13 THEN t_us - 600000 ELSE t_us END AS t, CASE WHEN beat_no % 89 = 17 THEN bar - 2 ELSE bar END AS bar FROM bt),
 l AS (SELECT *, lag(t) OVER w AS pt, lag(bar) OVER w AS pb FROM g WINDOW w AS (PARTITION BY song_id ORDER BY beat_no)) SELECT song_id, beat_no, concat_ws(',', CASE WHEN t <= pt THEN 'time' END, CASE WHEN bar < pb THEN 'bar' END) AS rules FROM l WHERE t <= pt OR bar < pb""")
def q2_validate_grid(spark, d):
    n = F.col("beat_no")
    bad = X.beats(spark, d).select("song_id", "beat_no", F.when(n % 97 == 13, F.col("t_us") - 600_000).otherwise(F.col("t_us")).alias("t_us"), F.when(n % 89 == 17, F.col("bar") - 2).otherwise(F.col("bar")).alias("bar"))
    return quality.grid_violations(bad).select("song_id", "beat_no", F.array_join("rules", ",").alias("rules"))


@query(""", a AS (SELECT song_id, onset_us // 200000 AS event, line % 2 + 1 AS string, pitch % 26 AS fret, pitch + CASE WHEN note_id % 9 = 0 THEN 1 ELSE 0 END AS pitch, CASE line % 2 + 1 WHEN 1 THEN pitch - pitch % 26 ELSE pitch - pitch % 26 END AS open FROM nr)
 SELECT song_id, event, count(*) AS n, bool_and(fret BETWEEN 0 AND 24) AND coalesce(max(CASE WHEN fret > 0 THEN fret END) - min(CASE WHEN fret > 0 THEN fret END) <= 5, TRUE) AND count(*) = count(DISTINCT string) AND bool_and(open + fret = pitch) AS ok FROM a GROUP BY song_id, event""")
def q4_playability_check(spark, d):
    n, p = X.notes_ref(spark, d), F.col("pitch")
    a = n.select("song_id", F.expr("onset_us div 200000").alias("event"), (F.col("line") % 2 + 1).alias("string"), (p % 26).alias("fret"), (p + F.when(F.col("note_id") % 9 == 0, 1).otherwise(0)).alias("pitch"), (p - p % 26).alias("open"))
    return quality.playable(a)


@query(""", t AS (SELECT song_id, instrument AS kind, CASE WHEN line = 2 THEN 9 ELSE line END AS line, count(*) AS n FROM nr GROUP BY ALL) SELECT song_id, kind, line, CASE WHEN kind = 'error' THEN 'unknown kind' ELSE 'no such line' END AS fault FROM t WHERE kind = 'error' OR line NOT IN (0, 1, 2)""")
def q5_validate_tracks(spark, d):
    n = X.notes_ref(spark, d)
    tracks = n.groupBy("song_id", F.col("instrument").alias("kind"), F.when(F.col("line") == 2, 9).otherwise(F.col("line")).alias("line")).agg(F.count("*").alias("n"))
    lines = n.select("song_id", "line").distinct()
    return quality.track_faults(tracks, lines, ["click", "view", "purchase", "signup"]).select("song_id", "kind", "line", "fault")


FLAGS = ["replica", "remix", "live", "acoustic", "short", "tv size", "tv ver", "arrange", "piano", "slow", "speed up", "sped up", "nightcore", "instrumental", "version", "ver."]


@query("SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"'{w}'" for w in FLAGS) + "], lambda w: contains(t, w)), ',') AS flags FROM (SELECT doc_id, replace(lower(coalesce(text, '')), 'full ver', '') AS t FROM documents)", cte=False)
def p11_title_flags(spark, d):
    t = F.replace(F.lower(F.coalesce("text", F.lit(""))), F.lit("full ver"), F.lit(""))
    rows = X.table(spark, d, "documents").select("doc_id", t.alias("t"))
    return rows.select("doc_id", F.array_join(F.filter(F.array(*[F.lit(w) for w in FLAGS]), lambda w: F.contains(F.col("t"), w)), ",").alias("flags"))
