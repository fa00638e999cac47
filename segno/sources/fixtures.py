"""Note, beat, bar, section and window tables derived from the given tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .quality import dealt

#: Users of one song, so that songs grow in number with the events and not in length; beats of a song.
USERS, BEATS = 12, 1440


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def notes_ref(spark: SparkSession, d: str) -> DataFrame:
    """Reference notes: one hour of events is one second of a song."""
    onset = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts) div 3600")
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").select(
        F.expr(f"user_id div {USERS}").alias("song_id"), F.col("event_id").cast("long").alias("note_id"), onset.alias("onset_us"),
        (onset + 20000 + F.round(F.col("value") * 10000).cast("long")).alias("offset_us"), (40 + k % 24).alias("pitch"), F.col("event_type").alias("instrument"), (k % 3).alias("line"),
    )


def notes_est(spark: SparkSession, d: str) -> DataFrame:
    """A fixed corruption of the reference notes: dropped, moved, transposed, reassigned and added ones."""
    ref, n = notes_ref(spark, d), F.col("note_id")
    jitter = ((n * 7919) % 121 - 60) * 1000
    kept = ref.where(n % 10 != 0).select(
        "song_id", "note_id", F.greatest(F.lit(0), F.col("onset_us") + jitter).alias("onset_us"), F.greatest(F.lit(0), F.col("offset_us") + jitter).alias("offset_us"),
        (F.col("pitch") + F.when(n % 20 == 1, 12).otherwise(0)).alias("pitch"), "instrument", F.when(n % 10 == 2, (F.col("line") + 1) % 3).otherwise(F.col("line")).alias("line"),
    )
    added = ref.where(n % 20 == 3).select(
        "song_id", (n + 1000000000).alias("note_id"), (F.col("onset_us") + 300000).alias("onset_us"), (F.col("offset_us") + 300000).alias("offset_us"),
        (F.col("pitch") + 1).alias("pitch"), "instrument", "line",
    )
    return kept.unionByName(added)


def faulty_notes(spark: SparkSession, d: str) -> DataFrame:
    """Estimated notes as a file might hold them, with faults of every kind; place is note_id."""
    n = F.col("note_id")
    return notes_est(spark, d).select(
        "song_id", "note_id", n.alias("place"), "onset_us", F.when(n % 13 == 0, F.col("onset_us") - 1).otherwise(F.col("offset_us")).alias("offset_us"), F.when(n % 17 == 0, 130).otherwise(F.col("pitch")).alias("pitch"),
        F.when(n % 23 == 0, "unheard").when(n % 31 != 0, F.col("instrument")).alias("instrument"), F.when(n % 19 != 0, F.col("line")).alias("string"), F.when(n % 29 != 0, n % 12).alias("fret"),
    )


def faulty_segments(spark: SparkSession, d: str) -> DataFrame:
    """song_id, place, start_us, end_us: windows of which some start late or end early."""
    w = windows(spark, d)
    late, early = F.when(F.col("window") % 11 == 3, 9_000_000).otherwise(0), F.when(F.col("window") % 13 == 5, 9_000_000).when(F.col("window") % 13 == 7, -1_000_000).otherwise(0)
    return w.select("song_id", F.col("window").alias("place"), (F.col("start_us") + late).alias("start_us"), (F.col("end_us") - early).alias("end_us"))


def signatures(spark: SparkSession, d: str) -> DataFrame:
    """note_id, ild_db (level of left over right; some unknown), coh (coherence of both), ms_db (middle over side): a stereo signature of each note."""
    n = F.col("note_id")
    ild = F.when(n % 9 != 0, (n * 37 % 41 - 20) / 2.0)
    return notes_ref(spark, d).select("note_id", ild.alias("ild_db"), (n * 13 % 21 / 20.0).alias("coh"), (n * 29 % 25 / 2.0 - 2).alias("ms_db"))


def contour(spark: SparkSession, d: str) -> DataFrame:
    """song_id, line, frame (10 ms), midi: the pitch of a line's notes, which wavers, with one frame in thirteen missing; every third note rises by two half
    tones and comes back, and the others run into the next note where it follows soon."""
    w = Window.partitionBy("song_id", "line").orderBy("onset_us", "note_id")
    # a note grows to some sixty frames, which are sorted: in tasks small enough to do so in memory
    n = dealt(notes_ref(spark, d), "song_id", "line", times=4).withColumn("_t2", F.lead("onset_us").over(w)).withColumn("_p2", F.lead("pitch").over(w))
    end = F.greatest("offset_us", F.least(F.col("offset_us") + 200_000, F.coalesce("_t2", "offset_us")))
    rows = n.select("*", F.explode(F.sequence(F.expr("onset_us div 10000"), (end / 10_000).cast("long"))).alias("frame"))
    t, length = F.col("frame") * 10_000, F.greatest(F.col("offset_us") - F.col("onset_us"), F.lit(1))
    part = F.least(F.greatest((t - F.col("onset_us")) / length, F.lit(0.0)), F.lit(1.0))
    into = F.least(F.greatest((t - F.col("offset_us") + 80_000) / 160_000, F.lit(0.0)), F.lit(1.0)) * (F.col("_p2") - F.col("pitch"))
    soon = F.coalesce(F.col("_t2") - F.col("offset_us") < 30_000, F.lit(False))
    move = F.when(soon & (F.col("note_id") % 3 != 0), into).when(F.col("note_id") % 3 == 0, 2 * F.least(2 * part, 2 - 2 * part)).otherwise(0.0)
    midi = F.col("pitch") + move + (F.col("frame") * 7 % 5 - 2) * 0.02
    rows = grown(rows).where("frame % 13 <> 5").select("song_id", "line", "frame", "note_id", midi.alias("midi"))
    # the latest note of a frame by a sort, which stays where the line's notes are and in the order of its frames
    last = Window.partitionBy("song_id", "line", "frame").orderBy(F.desc("note_id"))
    return rows.withColumn("_k", F.row_number().over(last)).where("_k = 1").select("song_id", "line", "frame", "midi")


#: Features of a window from its number h, some of them unknown; DuckDB reads the same text.
WINDOW_FEATURES_SQL = (
    "CASE WHEN h % 23 <> 4 THEN -16.0 + h % 9 * 2 END AS sm, 0.5 + h * 7 % 11 * 0.05 AS coh, (h * 13 % 21 - 10) / 10.0 AS xcoff, CASE WHEN h % 19 <> 3 THEN (h * 5 % 17 - 8) * 1.5 END AS lag, h * 3 % 10 / 10.0 AS r0, "
    "h * 17 % 10 / 10.0 AS hard, h % 7 * 1.5 AS ildcoh, h * 19 % 10 / 10.0 AS cen"
)


def window_features(spark: SparkSession, d: str) -> DataFrame:
    """song_id, w, truth and the features of every window."""
    rows = windows(spark, d).select("song_id", F.col("window").alias("w"), F.col("label").alias("truth"), (F.col("window") * 37 + F.col("song_id") * 11).alias("h"))
    parts = [re.sub(r"(\d+\.\d+)", r"\1D", p) for p in WINDOW_FEATURES_SQL.split(", ")]
    return rows.selectExpr("song_id", "w", "truth", *parts)


def songs(spark: SparkSession, d: str) -> DataFrame:
    """song_id and how many notes it has."""
    return notes_ref(spark, d).groupBy("song_id").agg(F.count("*").alias("n_notes"))


def dealt_songs(spark: SparkSession, d: str) -> DataFrame:
    """songs over as many tasks as a shuffle has: each grows to many rows, which Spark doesn't foresee. It would put all songs into one task."""
    return songs(spark, d).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))


def grown(rows: DataFrame) -> DataFrame:
    """Rows that few have grown to: their joins are merged, since Spark takes them for as small as what they grew from and would send all of them through the driver."""
    return rows.hint("merge")


def beats(spark: SparkSession, d: str) -> DataFrame:
    """Half a second each, moved by the beat and by how many notes the song has."""
    b = F.col("beat_no")
    rows = dealt_songs(spark, d).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(BEATS - 1).cast("long"))).alias("beat_no"))
    return grown(rows).select("song_id", "beat_no", (b * 500000 + (b % 7) * 1000 + b * F.col("n_notes") % 11 * 700).alias("t_us"), F.expr("beat_no div 4 + 1").alias("bar"), (b % 4 + 1).alias("beat"))


def bars(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("song_id").orderBy("bar")
    rows = beats(spark, d).groupBy("song_id", "bar").agg(F.min("t_us").alias("start_us"), F.count("*").alias("n_beats"))
    return rows.select("song_id", "bar", "start_us", F.lead("start_us").over(w).alias("end_us"), "n_beats").where("end_us is not null")


def doubled_beats(spark: SparkSession, d: str) -> DataFrame:
    """song_id, t_us, down, act: beats as a tracker gives them, some of them twice."""
    b, n = beats(spark, d), F.col("beat_no")
    twice = b.where(n % 37 == 5).select("song_id", (F.col("t_us") + 90_000).alias("t_us"), F.lit(False).alias("down"), (n * 31 % 100 / 100).alias("act"))
    return b.select("song_id", "t_us", (F.col("beat") == 1).alias("down"), (n * 7919 % 100 / 100).alias("act")).unionByName(twice)


def gappy_beats(spark: SparkSession, d: str) -> DataFrame:
    """song_id, t_us: beats with two in 41 lacking."""
    return beats(spark, d).where(~(F.col("beat_no") % 41).isin(7, 8)).select("song_id", "t_us")


def levelled_beats(spark: SparkSession, d: str) -> DataFrame:
    """song_id, t_us: beats tracked at twice their number in five bars of fifty."""
    b = beats(spark, d)
    return b.select("song_id", "t_us").unionByName(b.where((F.col("bar") % 50).between(10, 14)).select("song_id", (F.col("t_us") + 250_000).alias("t_us")))


def tracker_frames(spark: SparkSession, d: str, by_line: bool = False) -> DataFrame:
    """song_id, line, tracker, frame (10 ms), midi, conf: what three trackers hear of each line; one rests in every third note, some notes are heard an octave or a half tone higher.
    by_line: dealt by lines and not by frames, for what meets whole lines."""
    span = F.explode(F.sequence(F.expr("onset_us div 10000"), F.expr("offset_us div 10000"))).alias("frame")
    if by_line:
        # the latest note of a frame by a sort where the line's notes are, in tasks small enough to do so in memory
        spread = dealt(notes_ref(spark, d), "song_id", "line", times=12).select("song_id", "line", F.col("note_id").alias("n"), F.col("pitch").alias("p"), span)
        last = Window.partitionBy("song_id", "line", "frame").orderBy(F.desc("n"))
        heard = spread.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k")
    else:
        spread = dealt(notes_ref(spark, d), "song_id", "note_id").select("song_id", "line", "note_id", "pitch", span)
        heard = dealt(spread, "song_id", "line", "frame").groupBy("song_id", "line", "frame").agg(F.max("note_id").alias("n"), F.max_by("pitch", "note_id").alias("p"))
    n, k, f = F.col("n"), F.col("tracker"), F.col("frame")
    off = (
        F.when(k == 1, (n % 7 - 3) * 0.1 + F.when(n % 11 == 0, 12).otherwise(0)).when(k == 2, (n % 5 - 2) * 0.15 + F.when(n % 11 == 0, 12).when(n % 13 == 0, 1).otherwise(0))
        .when(n % 3 != 0, F.when(n % 13 == 0, 1.2).otherwise(0.2))
    )
    rows = heard.withColumn("tracker", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])))
    return grown(rows).select("song_id", "line", "tracker", "frame", (F.col("p") + off + (f * 7 % 5 - 2) * 0.02).alias("midi"), ((f * 13 + k * 5) % 10 / 10).alias("conf"))


def sections(spark: SparkSession, d: str) -> DataFrame:
    n = BEATS // 4
    rows = dealt_songs(spark, d).select("song_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((n - 1) // 16).cast("long"))).alias("section"))
    s = F.col("section")
    return grown(rows).select("song_id", "section", F.char(65 + s % 3).alias("label"), (s * 16 + 1).alias("start_bar"), F.least(s * 16 + 17, F.lit(n + 1)).alias("end_bar"))


def windows(spark: SparkSession, d: str) -> DataFrame:
    rows = bars(spark, d).withColumn("window", F.expr("(bar - 1) div 4")).groupBy("song_id", "window")
    rows = rows.agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"))
    label = F.element_at(F.array(*[F.lit(x) for x in ("R0", "R1", "R2", "R3", "mixed")]), ((F.col("window") * 7 + F.col("song_id")) % 5 + 1).cast("int"))
    return rows.select("*", label.alias("label"))


#: The same tables for DuckDB.
CTE = """WITH RECURSIVE nr AS (SELECT CAST(user_id // 12 AS BIGINT) AS song_id, CAST(event_id AS BIGINT) AS note_id, (epoch_us(ts) - 1704067200000000) // 3600 AS onset_us,
  (epoch_us(ts) - 1704067200000000) // 3600 + 20000 + CAST(round(value * 10000) AS BIGINT) AS offset_us, 40 + k % 24 AS pitch, event_type AS instrument, k % 3 AS line
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)),
ne AS (SELECT song_id, note_id, greatest(0, onset_us + ((note_id * 7919) % 121 - 60) * 1000) AS onset_us, greatest(0, offset_us + ((note_id * 7919) % 121 - 60) * 1000) AS offset_us,
  pitch + CASE WHEN note_id % 20 = 1 THEN 12 ELSE 0 END AS pitch, instrument, CASE WHEN note_id % 10 = 2 THEN (line + 1) % 3 ELSE line END AS line FROM nr WHERE note_id % 10 <> 0
  UNION ALL SELECT song_id, note_id + 1000000000, onset_us + 300000, offset_us + 300000, pitch + 1, instrument, line FROM nr WHERE note_id % 20 = 3),
sg AS (SELECT song_id, count(*) AS n_notes FROM nr GROUP BY 1),
bt AS (SELECT song_id, b AS beat_no, b * 500000 + (b % 7) * 1000 + b * n_notes % 11 * 700 AS t_us, b // 4 + 1 AS bar, b % 4 + 1 AS beat FROM sg, range(1440) AS r(b)),
br AS (SELECT * FROM (SELECT song_id, bar, start_us, lead(start_us) OVER (PARTITION BY song_id ORDER BY bar) AS end_us, n_beats
  FROM (SELECT song_id, bar, min(t_us) AS start_us, count(*) AS n_beats FROM bt GROUP BY ALL)) WHERE end_us IS NOT NULL),
sc AS (SELECT song_id, s AS section, chr(CAST(65 + s % 3 AS INTEGER)) AS label, s * 16 + 1 AS start_bar, least(s * 16 + 17, 361) AS end_bar FROM sg, range(23) AS r(s)),
wn AS (SELECT song_id, w AS "window", min(start_us) AS start_us, max(end_us) AS end_us, ['R0', 'R1', 'R2', 'R3', 'mixed'][CAST((w * 7 + song_id) % 5 + 1 AS INTEGER)] AS label
  FROM (SELECT *, (bar - 1) // 4 AS w FROM br) GROUP BY song_id, w)
"""
