"""Structured Streaming jobs over note events; each runs over all that is there and ends."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.quality import shared_folder, split_by_rules


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet file or folder at path, with the schema of what is now there.

    The source takes folders and globs only, so the last letter becomes a glob that matches itself.
    """
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def run_now(rows: DataFrame, name: str) -> DataFrame:
    """Append `rows` to a table until all present input is read; sink and checkpoint lie in the shared folder."""
    spark = rows.sparkSession
    base = f"{shared_folder(spark)}/segno-{uuid.uuid4().hex}/{name}"
    rows.writeStream.format("parquet").outputMode("append").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{base}/rows")


def levels(events: DataFrame, window: str, late: str) -> DataFrame:
    """song_id, start_us, power (mean square), n of each closed tumbling window of `t`."""
    g = events.withWatermark("t", late).groupBy("song_id", F.window("t", window).alias("w")).agg(F.avg(F.col("value") * F.col("value")).alias("power"), F.count("*").alias("n"))
    return g.select("song_id", F.unix_micros("w.start").alias("start_us"), F.round("power", 6).alias("power"), "n")


def shares(events: DataFrame, window: str, slide: str, late: str, kind: str) -> DataFrame:
    """song_id, start_us, n, hit: rows of a kind in each closed sliding window."""
    g = events.withWatermark("t", late).groupBy("song_id", F.window("t", window, slide).alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == kind).alias("hit"))
    return g.select("song_id", F.unix_micros("w.start").alias("start_us"), "n", "hit")


def spans(events: DataFrame, gap_us: int, late: str) -> DataFrame:
    """song_id, start_us, end_us, n of closed sessions: rows at most gap_us apart."""
    gap = f"{gap_us + 1} microseconds"
    g = events.withWatermark("t", late).groupBy("song_id", F.session_window("t", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select("song_id", F.unix_micros("w.start").alias("start_us"), (F.unix_micros("w.end") - gap_us - 1).alias("end_us"), "n")


def quarantine(rows: DataFrame, rules: dict, name: str) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected) tables of a stream; a batch written again after a failure replaces its own files."""
    spark = rows.sparkSession
    base = f"{shared_folder(spark)}/segno-{uuid.uuid4().hex}/{name}"

    def sink(batch: DataFrame, number: int) -> None:
        good, bad = split_by_rules(batch, rules)
        good.write.mode("overwrite").parquet(f"{base}/kept/batch={number}")
        bad.write.mode("overwrite").parquet(f"{base}/rejected/batch={number}")

    rows.writeStream.foreachBatch(sink).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/kept").drop("batch"), spark.read.parquet(f"{base}/rejected").drop("batch")


def bursts(events: DataFrame, median: DataFrame, window: str, late: str, least: int, tiny: float) -> DataFrame:
    """song_id, start_us, n, tiny of closed windows with many events: mostly tiny ones, or over 3 times the song's median (a static
    snapshot: song_id, median)."""
    g = events.withWatermark("t", late).groupBy("song_id", F.window("t", window).alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("value") < tiny).alias("tiny"))
    hot = (F.col("n") >= least) & ((F.col("tiny") * 2 >= F.col("n")) | (F.col("n") > 3 * F.col("median")))
    return g.join(median, "song_id").where(hot).select("song_id", F.unix_micros("w.start").alias("start_us"), "n", "tiny")


def matches(left: DataFrame, right: DataFrame, keys: list[str], tol: str, late: str) -> DataFrame:
    """left id and right id of pairs of equal keys within tol of each other; both sides forget what the watermarks have passed.

    left: keys, id, t; right: keys, r_id, r_t. Times lie after 1970: what is before it is late from the start.
    """
    a, b = left.withWatermark("t", late), right.withWatermark("r_t", late)
    on = (F.col("t") >= F.col("r_t") - F.expr(f"INTERVAL {tol}")) & (F.col("t") <= F.col("r_t") + F.expr(f"INTERVAL {tol}"))
    for k in keys:
        on = on & (a[k] == b[k])
    return a.join(b.select(*keys, "r_id", "r_t"), on).select("id", "r_id")


#: What is kept of a song: the next sequence number, both stacks, and entries that came too early.
STACKS = "next long, done array<long>, undone array<long>, early array<struct<seq:long,op:string,id:long,target:long>>"


def stack_updates(log: DataFrame) -> DataFrame:
    """song_id, seq, active, undone after each arrival: entries act in order of seq (from 1, without gaps); one that comes early waits
    in the state until the gap closes, one that comes again is dropped. log: song_id, seq, op, id, target."""
    import pandas as pd

    def run(key, batches, state):
        nxt, done, undone, early = state.get if state.exists else (1, [], [], [])
        done, undone, waiting = list(done), list(undone), {int(e[0]): (e[1], int(e[2]), int(e[3])) for e in early}
        for b in batches:
            for seq, op, id_, target in zip(b["seq"], b["op"], b["id"], b["target"]):
                if seq >= nxt:
                    waiting[int(seq)] = (op, int(id_), int(target))
        while nxt in waiting:
            op, id_, target = waiting.pop(nxt)
            if op == "undo":
                if done and done[-1] == target:
                    undone.append(done.pop())
            elif op == "redo":
                if undone and undone[-1] == target:
                    done.append(undone.pop())
            else:
                done.append(id_)
                undone = []
            nxt += 1
        state.update((nxt, done, undone, [(s, *e) for s, e in sorted(waiting.items())]))
        yield pd.DataFrame({"song_id": [key[0]], "seq": [nxt - 1], "active": [len(done)], "undone": [len(undone)]})

    return log.groupBy("song_id").applyInPandasWithState(run, "song_id long, seq long, active long, undone long", STACKS, "append", "NoTimeout")


def calibration(events: DataFrame, name: str) -> DataFrame:
    """event_type, n, peak so far: running counts and maxima, each batch replacing the table of the one before."""
    spark = events.sparkSession
    base = f"{shared_folder(spark)}/segno-{uuid.uuid4().hex}/{name}"
    running = events.groupBy("event_type").agg(F.count("*").alias("n"), F.max("value").alias("peak"))

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows/batch={number}")

    running.writeStream.outputMode("complete").foreachBatch(sink).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{base}/rows")
    return rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch").drop("batch")
