"""Rules that carry a state along a sorted list: fragments, taps, tempi, beats and note families.

A list is that of one chain component or of one song's beats or bars, which bounds it; none is that of a whole table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def merge_fragments(notes: DataFrame, join_us: int = 30_000, early_us: int = 5_000, short_us: int = 80_000) -> DataFrame:
    """song_id, pitch, note_id, onset_us, offset_us, merged: a note goes into the one of its pitch before it if it starts from early_us
    before to join_us after that one's end without an attack, and is shorter than short_us or has no evidence; what was
    joined counts for the next. notes: attack, evidence (boolean)."""
    w = Window.partitionBy("song_id", "pitch").orderBy("onset_us", "note_id")
    end = F.max("offset_us").over(w.rowsBetween(Window.unboundedPreceding, -1))
    part = F.sum(F.when(F.col("onset_us") - end <= join_us, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    xs = F.array_sort(F.collect_list(F.struct("onset_us", "note_id", "offset_us", "attack", "evidence")))
    groups = notes.withColumn("_end", end).withColumn("_part", part).groupBy("song_id", "pitch", "_part").agg(xs.alias("xs"))
    kept = "array<struct<onset_us:bigint,note_id:bigint,offset_us:bigint,merged:int>>"
    fold = f"""aggregate(xs, cast(array() as {kept}), (a, x) -> CASE
      WHEN size(a) > 0 AND x.onset_us - a[size(a) - 1].offset_us BETWEEN -{early_us} AND {join_us} AND NOT x.attack AND (x.offset_us - x.onset_us < {short_us} OR NOT x.evidence)
      THEN array_append(slice(a, 1, size(a) - 1), named_struct('onset_us', a[size(a) - 1].onset_us, 'note_id', a[size(a) - 1].note_id, 'offset_us', greatest(a[size(a) - 1].offset_us, x.offset_us), 'merged', a[size(a) - 1].merged + 1))
      ELSE array_append(a, named_struct('onset_us', x.onset_us, 'note_id', x.note_id, 'offset_us', x.offset_us, 'merged', 0)) END)"""
    return groups.select("song_id", "pitch", F.explode(F.expr(fold)).alias("n")).select("song_id", "pitch", "n.*")


def assign_taps(taps: DataFrame, downbeats: DataFrame) -> DataFrame:
    """song_id, t_us, bar: taps in order take the nearest downbeat after the last one taken (ties: the lower bar); none left gives null."""
    bars = downbeats.groupBy("song_id").agg(F.array_sort(F.collect_list(F.struct("bar", "t_us"))).alias("bars"))
    rows = taps.groupBy("song_id").agg(F.array_sort(F.collect_list("t_us")).alias("ts")).join(bars, "song_id")
    fold = """aggregate(ts, named_struct('last', cast(-9999999 as bigint), 'out', cast(array() as array<struct<t_us:bigint,bar:bigint>>)), (a, t) ->
      transform(array(array_min(transform(filter(bars, b -> b.bar > a.last), b -> named_struct('d', abs(b.t_us - t), 'bar', cast(b.bar as bigint))))),
        m -> named_struct('last', coalesce(m.bar, a.last), 'out', array_append(a.out, named_struct('t_us', t, 'bar', m.bar))))[0]).out"""
    return rows.select("song_id", F.explode(F.expr(fold)).alias("x")).select("song_id", "x.*")


def written_tempi(sections: DataFrame, tol: float = 0.03) -> DataFrame:
    """song_id, section, bpm, written: a section's tempo is written only where it differs from the one in force by over tol."""
    rows = sections.groupBy("song_id").agg(F.array_sort(F.collect_list(F.struct("section", "bpm"))).alias("xs"))
    fold = f"""aggregate(xs, named_struct('now', cast(null as double), 'out', cast(array() as array<struct<section:bigint,bpm:double,written:boolean>>)), (a, x) ->
      if(a.now is null or abs(x.bpm - a.now) > {tol} * a.now, named_struct('now', x.bpm, 'out', array_append(a.out, named_struct('section', x.section, 'bpm', x.bpm, 'written', true))),
        named_struct('now', a.now, 'out', array_append(a.out, named_struct('section', x.section, 'bpm', x.bpm, 'written', false))))).out"""
    return rows.select("song_id", F.explode(F.expr(fold)).alias("x")).select("song_id", "x.*")


def refine_beats(beats: DataFrame, onsets: DataFrame, reach_us: int = 35_000, ratio: float = 1.5, around_us: int = 2_000_000) -> DataFrame:
    """song_id, beat_no, t_us: beats move to the strongest onset within reach_us if it is `ratio` times the median strength around;
    then no beat is less than 1 ms after the one before. onsets: song_id, onset_us, strength."""
    near = Window.partitionBy("song_id").orderBy("onset_us").rangeBetween(-around_us, around_us)
    o = onsets.withColumn("_med", F.percentile("strength", F.lit(0.5)).over(near)).withColumn("_cell", F.explode(F.array(*[F.floor(F.col("onset_us") / reach_us) + k for k in (-1, 0, 1)])))
    b = beats.select("song_id", "beat_no", F.col("t_us").cast("long").alias("t_us")).withColumn("_cell", F.floor(F.col("t_us") / reach_us))
    hit = b.join(o, ["song_id", "_cell"]).where(F.abs(F.col("onset_us") - F.col("t_us")) <= reach_us)
    best = hit.groupBy("song_id", "beat_no").agg(F.max_by(F.struct("onset_us", "strength", "_med"), F.struct("strength", -F.col("onset_us"))).alias("o"))
    strong = (F.col("o.strength") > 0) & (F.col("o.strength") >= ratio * F.col("o._med"))
    moved = b.join(best, ["song_id", "beat_no"], "left").select("song_id", "beat_no", "t_us", F.when(strong, F.col("o.onset_us")).otherwise(F.col("t_us")).alias("to"))

    def run(key, t):
        last, out = -9_000_000_000_000, []
        for b, own, to in sorted(zip(*(t.column(c).to_pylist() for c in ("beat_no", "t_us", "to"))), key=lambda x: [(v is None, v or 0) for v in x]):
            last = next((v for v in (to, own) if v is not None and v > last + 1000), last + 1000)
            out.append((b, last))
        return pa.table([pa.array([key[0].as_py()] * len(out), t.schema.field("song_id").type), *(pa.array(x, pa.int64()) for x in zip(*out))], names=["song_id", "beat_no", "t_us"])

    # one pass over a song's beats: a list that is appended to in SQL is copied for every beat
    return moved.withColumn("beat_no", F.col("beat_no").cast("long")).groupBy("song_id").applyInArrow(run, f"song_id {beats.schema['song_id'].dataType.simpleString()}, beat_no long, t_us long")


#: The families of note values of a beat, and which of them are even or ternary.
FAMILIES, KIND = ["bin", "ter", "swing"], {"bin": 0, "ter": 1, "swing": 0}


def viterbi_families(costs: DataFrame, switch: float = 1.0) -> DataFrame:
    """song_id, beat, family: the families of least total cost, `switch` being paid where even and ternary meet; ties in order of
    FAMILIES. costs: song_id, beat, family, cost; a family without a row is not allowed in a beat that has others; beats without any row cost nothing in any family that the song uses."""

    def run(key, t):
        beat, cost = t.column("beat").to_numpy(), t.column("cost").to_numpy()
        name = t.column("family").to_pylist()
        used = [f for f in FAMILIES if f in set(name)]
        lo, hi = int(beat.min()), int(beat.max())
        grid = np.zeros((hi - lo + 1, len(used)))
        grid[beat - lo] = np.inf
        for b, f, c in zip(beat, name, cost):
            grid[b - lo, used.index(f)] = c
        pay = np.array([[switch * (KIND[a] != KIND[b]) for b in used] for a in used])
        total, back = grid[0], np.zeros(grid.shape, np.int64)
        for i in range(1, len(grid)):
            way = total[:, None] + pay
            back[i] = way.argmin(0)
            total = way.min(0) + grid[i]
        path = [int(total.argmin())]
        for i in range(len(grid) - 1, 0, -1):
            path.append(int(back[i][path[-1]]))
        return pa.table({"song_id": pa.array([key[0].as_py()] * len(path), pa.int64()), "beat": pa.array(range(lo, hi + 1), pa.int64()), "family": [used[p] for p in path[::-1]]})

    return costs.select("song_id", F.col("beat").cast("long").alias("beat"), "family", F.col("cost").cast("double").alias("cost")).groupBy("song_id").applyInArrow(run, "song_id long, beat long, family string")


def drifting_offsets(scores: DataFrame, start: DataFrame, gain: float = 0.03, least: int = 40, reach: int = 2) -> DataFrame:
    """song_id, block, shift: blocks keep the offset in force unless another within `reach` of the song's own scores at least `gain`
    more and the block has `least` notes. scores: song_id, block, notes, shift, f1; start: song_id, shift."""
    rows = scores.groupBy("song_id", "block").agg(F.max("notes").alias("notes"), F.collect_list(F.struct("shift", "f1")).alias("f1")).groupBy("song_id").agg(F.array_sort(F.collect_list(F.struct("block", "notes", "f1"))).alias("xs"))
    rows = rows.join(start.select("song_id", F.col("shift").alias("own")), "song_id")
    fold = f"""aggregate(xs, named_struct('now', cast(own as bigint), 'out', cast(array() as array<struct<block:bigint,shift:bigint>>)), (a, x) ->
      transform(array(array_max(transform(filter(x.f1, s -> abs(s.shift - own) <= {reach}), s -> named_struct('f1', s.f1, 'near', -abs(s.shift - a.now), 'shift', cast(s.shift as bigint))))), m ->
        transform(array(if(x.notes >= {least} and m.shift <> a.now and m.f1 >= coalesce(filter(x.f1, s -> s.shift = a.now)[0].f1, 0) + {gain}, m.shift, a.now)), now -> named_struct('now', now, 'out', array_append(a.out, named_struct('block', x.block, 'shift', now))))[0])[0]).out"""
    return rows.select("song_id", F.explode(F.expr(fold)).alias("x")).select("song_id", "x.*")


def spread_windows(candidates: DataFrame, most: int = 6, gap_us: int = 8_000_000) -> DataFrame:
    """song_id, window, place: windows by score, each at least gap_us from those taken and first of a label not taken yet; at most `most`."""
    rows = candidates.groupBy("song_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "window", "start_us", "end_us", "label"))).alias("xs"))
    free = f"filter(xs, x -> not exists(a, y -> y.window = x.window or (x.start_us < y.end_us + {gap_us} and y.start_us < x.end_us + {gap_us})))"
    new = "filter({f}, x -> not exists(a, y -> y.label = x.label))".format(f=free)
    fold = f"aggregate(sequence(1, {most}), cast(array() as array<struct<window:bigint,start_us:double,end_us:double,label:string>>), (a, k) -> CASE WHEN size({new}) > 0 THEN array_append(a, transform({new}, x -> named_struct('window', cast(x.window as bigint), 'start_us', cast(x.start_us as double), 'end_us', cast(x.end_us as double), 'label', x.label))[0]) WHEN size({free}) > 0 THEN array_append(a, transform({free}, x -> named_struct('window', cast(x.window as bigint), 'start_us', cast(x.start_us as double), 'end_us', cast(x.end_us as double), 'label', x.label))[0]) ELSE a END)"
    out = rows.select("song_id", F.posexplode(F.expr(fold)).alias("at", "x"))
    return out.select("song_id", "x.window", "x.label", (F.col("at") + 1).cast("long").alias("place"))
