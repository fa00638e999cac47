"""More streaming queries: bursts, matches, edit stacks, calibration and fine levels."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..sources import fixtures as X
from ..sources import quality
from ..streaming import jobs
from .more import EV, MARK, event_stream
from .queries import LOG, query


@query(EV + f" SELECT song_id, t // 100000 * 100000 AS start_us, round(avg(value * value), 6) AS power, count(*) AS n FROM ev GROUP BY 1, 2 HAVING start_us + 100000 <= {MARK.format('ev')}")
def r1_stream_fine_levels(spark, d):
    return jobs.run_now(jobs.levels(event_stream(spark, d), "100 milliseconds", "10 seconds"), "fine")


@query(EV + f""", bk AS (SELECT song_id, t // 10000000 * 10000000 AS start_us, count(*) AS n, CAST(count_if(value < 15) AS BIGINT) AS tiny FROM ev GROUP BY 1, 2), md AS (SELECT song_id, median(n) AS m FROM bk GROUP BY 1)
 SELECT song_id, start_us, n, tiny FROM bk JOIN md USING (song_id) WHERE n >= 8 AND (tiny * 2 >= n OR n > 3 * m) AND start_us + 10000000 <= {MARK.format('ev')}""")
def r2_stream_bursts(spark, d):
    n = X.notes_ref(spark, d).groupBy("song_id", F.expr("onset_us div 10000000")).agg(F.count("*").alias("n"))
    median = n.groupBy("song_id").agg(F.median("n").alias("median"))
    return jobs.run_now(jobs.bursts(event_stream(spark, d), median, "10 seconds", "10 seconds", 8, 15.0), "bursts")


@query(EV + ", k AS (SELECT ev.*, CAST(json_extract_string(props, '$.k') AS INTEGER) % 24 AS pitch FROM ev JOIN events USING (event_id)), e AS (SELECT song_id, event_id, pitch, t + (event_id * 7919 % 121 - 60) * 1000 AS t FROM k WHERE event_id % 10 <> 0) SELECT k.event_id AS id, e.event_id AS r_id FROM k JOIN e ON k.song_id = e.song_id AND k.pitch = e.pitch AND abs(k.t - e.t) <= 50000")
def r5_stream_match(spark, d):
    onset = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts) div 3600")
    pitch = (F.get_json_object("props", "$.k").cast("int") % 24).alias("pitch")
    rows = lambda: jobs.stream_of(spark, f"{d}/events.parquet").select(F.expr("user_id div 12").alias("song_id"), pitch, "event_id", onset.alias("us"))
    day = 86_400_000_000  # moved back, the first events would lie before 1970, where Spark's watermark starts, and be late at once
    left = rows().select("song_id", "pitch", F.col("event_id").alias("id"), F.timestamp_micros(F.col("us") + day).alias("t"))
    moved = F.col("us") + (F.col("event_id") * 7919 % 121 - 60) * 1000
    right = rows().where("event_id % 10 <> 0").select("song_id", "pitch", F.col("event_id").alias("r_id"), F.timestamp_micros(moved + day).alias("r_t"))
    return jobs.run_now(jobs.matches(left, right, ["song_id", "pitch"], "50 milliseconds", "10 seconds"), "matches")


@query(LOG + " SELECT song_id, rn AS seq, CAST(len(dn) AS BIGINT) AS active, CAST(len(un) AS BIGINT) AS undone FROM fo QUALIFY row_number() OVER (PARTITION BY song_id ORDER BY rn DESC) = 1")
def r6_stream_edits(spark, d):
    """The log arrives in several batches, out of order and with an entry twice; the stacks after all of it."""
    w = Window.partitionBy("song_id").orderBy("note_id")
    op = F.when(F.col("instrument") == "error", "undo").when(F.col("instrument") == "signup", "redo").otherwise("edit")
    target = F.when(F.col("note_id") % 5 == 0, -1).otherwise(F.coalesce(F.lag("note_id").over(w), F.lit(-1)))
    log = X.notes_ref(spark, d).select("song_id", F.row_number().over(w).cast("long").alias("seq"), op.alias("op"), F.col("note_id").alias("id"), target.alias("target"))
    path = f"{quality.shared_folder(spark)}/segno-{uuid.uuid4().hex}/log"
    log.unionByName(log.where("seq % 50 = 1")).repartition(3, F.xxhash64("id")).write.parquet(path)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = jobs.run_now(jobs.stack_updates(stream), "stacks")
    return out.groupBy("song_id").agg(F.max("seq").alias("seq"), F.max_by("active", "seq").alias("active"), F.max_by("undone", "seq").alias("undone"))


@query("SELECT event_type, count(*) AS n, max(value) AS peak FROM events GROUP BY 1", cte=False)
def r8_stream_calibration(spark, d):
    return jobs.calibration(event_stream(spark, d), "calibration").select("event_type", "n", "peak")
