"""Written bars laid on a song by page times: leads, bar lengths and block shifts are tried one after the other, the best kept.

A song's notes, beats, pages and bars meet in one group, which the song bounds; all that is tried there stays in the task.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.quality import dealt

#: Plain bar lengths in beats.
BAR_BEATS = [1.0, 1.5, 2.0, 3.0, 4.0, 6.0, 8.0]
#: What a block of bars may do, in this order (way): bars of one length from the best start moved by up to four beats, or its own times moved by up to one; kind, shift in beats, penalty.
WAYS = [("even", 0.5 * k, abs(0.5 * k)) for k in range(-8, 9)] + [("own", 0.5 * k, abs(0.5 * k) + 0.25) for k in range(-2, 3)]
#: Kinds of the rows that a song gathers.
NOTE, BEAT, PATH, PAGE, PITCH = range(5)


def half_up(x: np.ndarray) -> np.ndarray:
    """x to 9 decimals as Spark rounds: half up on the decimal form."""
    x = np.asarray(x, float)
    y = np.abs(x) * 1e9
    out = np.atleast_1d(np.floor(y + 0.5))
    for i in np.flatnonzero(np.abs(y - np.floor(y) - 0.5) <= 1e-6 + 4e-16 * y):  # too near for the product to tell
        out.flat[i] = int(Decimal(repr(abs(float(x.flat[i])))).quantize(Decimal("1e-9"), ROUND_HALF_UP).scaleb(9))
    return np.copysign(out.reshape(x.shape) / 1e9, x)


def bag_f1(tp: np.ndarray, n_ref: np.ndarray, n_est: np.ndarray) -> np.ndarray:
    """F1 of bags, to 9 decimals; 0 where both are empty."""
    return half_up(2 * tp / np.maximum(1, n_ref + n_est))


def on_grid(t: np.ndarray, at: np.ndarray, no: np.ndarray) -> np.ndarray:
    """Beat positions of times on beats `no` at the times `at`, as timeline.time_to_beat has them."""
    i = np.clip(np.searchsorted(at[:-1], t, "right") - 1, 0, len(at) - 2)
    return no[i] + (t - at[i]) / (at[i + 1] - at[i])


def on_path(t: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Values of the path (x, y), held beyond its ends, as timeline.path_interp has them."""
    if len(x) == 1:
        return np.full(t.shape, y[0])
    i = np.searchsorted(x, t, "right") - 1
    k = np.clip(i, 0, len(x) - 2)
    between = y[k] + (t - x[k]) * (y[k + 1] - y[k]) / (x[k + 1] - x[k])
    return np.where(i < 0, y[0], np.where(i >= len(x) - 1, y[-1], between))


class Bags:
    """Pitches of a song's notes in order of time, and of each written bar."""

    def __init__(self, pos: np.ndarray, pitch: np.ndarray, bars: np.ndarray, want_bar: np.ndarray, want_pitch: np.ndarray, want_n: np.ndarray):
        order = np.argsort(pos, kind="stable")
        self.pos = pos[order]
        # an unknown pitch (nan) is no pitch of the other side: a column of its own on either side
        known = np.unique(np.concatenate((pitch, want_pitch)))
        known = known[~np.isnan(known)]
        column = lambda p, own: np.where(np.isnan(p), own, np.searchsorted(known, p))
        self.upto = np.zeros((len(pos) + 1, len(known) + 2), np.int32)
        self.upto[np.arange(1, len(pos) + 1), column(pitch[order], len(known))] = 1
        np.cumsum(self.upto, 0, out=self.upto)
        self.want = np.zeros((len(bars), len(known) + 2), np.int32)
        row = np.searchsorted(bars, want_bar)
        there = bars[np.minimum(row, len(bars) - 1)] == want_bar
        np.add.at(self.want, (row[there], column(want_pitch, len(known) + 1)[there]), want_n[there].astype(np.int32))

    def counts(self, at: np.ndarray, beats: np.ndarray, row: np.ndarray) -> np.ndarray:
        """(3, number of bars): tp, n_ref, n_est of the written bars `row` (of the bars given) placed at [at, at + beats); 0 where a bar begins before the first beat."""
        lo, hi = np.searchsorted(self.pos, at), np.searchsorted(self.pos, at + beats)
        got, want = self.upto[hi] - self.upto[lo], self.want[row]
        return np.where((at >= 0) & (beats > 0), np.array([np.minimum(got, want).sum(1), want.sum(1), got.sum(1)]), 0)


def laid(song, notes, beats, path, pages, pitches, leads_us: list[int], block: int) -> dict | None:
    """One song of score_by_time with its blocks, from its rows as (k, x, y); None if nothing of it can be placed."""
    if len(beats[1]) < 2 or not len(path[1]) or not len(pages[0]):
        return None
    bars, first = np.unique(pages[0], return_index=True)  # pages are in order of bars
    leads = np.array(leads_us)[:, None]
    start, end = (np.maximum.reduceat(on_grid(on_path(t + leads, *path[1:]), beats[1], beats[2]), first, 1) for t in pages[1:])
    at, length = half_up(start), half_up(end - start)
    pos = on_grid(notes[1], beats[1], beats[2])
    bags = Bags(pos[~np.isnan(pos)], notes[2][~np.isnan(pos)], bars, pitches[0], pitches[2], pitches[1])
    rows = np.arange(len(bars))
    sums = np.array([bags.counts(a, b, rows).sum(1) for a, b in zip(at, length)])
    f1 = bag_f1(*sums.T)
    tried = [(f1[i], -abs(lead), -lead, i) for i, lead in enumerate(leads_us) if sums[i, 1] + sums[i, 2]]
    if not tried:
        return None
    lead = max(tried)[3]
    row = np.flatnonzero(length[lead] > 0)
    bar, own, own_beats = bars[row], at[lead, row], length[lead, row]
    measured = float(half_up(np.median(own_beats)))
    opens = np.arange(0, len(row), block)
    size = np.diff(np.append(opens, len(row)))
    kinds, shifts, penalties = zip(*WAYS)
    is_even, shift = np.array([k == "even" for k in kinds])[:, None], np.array(shifts)[:, None]
    found = []
    for away, beats_per_bar in sorted((abs(x - measured), x) for x in BAR_BEATS)[:2]:
        even = (bar - np.repeat(bar[opens], size)) * beats_per_bar
        base = half_up(np.array([np.median((own - even)[o : o + block]) for o in opens]))
        where = np.where(is_even, np.repeat(base, size) + even, own) + shift
        wide = np.where(is_even, beats_per_bar, own_beats)
        n = bags.counts(where.ravel(), np.broadcast_to(wide, where.shape).ravel(), np.tile(row, len(WAYS))).reshape(3, len(WAYS), -1)
        n = np.add.reduceat(n, opens, 2)  # tp, n_ref, n_est by way and block
        f1 = bag_f1(*n)
        best = [max(range(len(WAYS)), key=lambda w: (f1[w, b], -penalties[w], -w)) for b in range(len(opens))]  # noqa: B023
        chosen = n[:, best, np.arange(len(opens))]
        single = float(bag_f1(*n[:, WAYS.index(("even", 0.0, 0.0))].sum(1)))
        found.append((float(bag_f1(*chosen.sum(1))), -away, -beats_per_bar, single, best, chosen))
    drifting, _, beats_per_bar, single, best, chosen = max(found, key=lambda f: f[:3])
    blocks = [{"block": b, "way": kinds[w], "shift": shifts[w], "tp": int(t), "n_ref": int(r), "n_est": int(e)} for b, (w, t, r, e) in enumerate(zip(best, *chosen))]
    return {"song_id": song, "lead_us": leads_us[lead], "beats_per_bar": -beats_per_bar, "measured": measured, "single": single, "drifting": drifting, "blocks": blocks}


BLOCK = [("block", "long"), ("way", "string"), ("shift", "double"), ("tp", "long"), ("n_ref", "long"), ("n_est", "long")]


def score_by_time(pages: DataFrame, path: DataFrame, beats: DataFrame, pitches: DataFrame, notes: DataFrame, leads_us: list[int], block: int = 8, early_us: int = 30_000) -> tuple[DataFrame, DataFrame]:
    """(songs, blocks). A written bar plays from its page time to the next; `path` (x, y) carries that to the song and the beats to a grid.

    The lead over all pages with the best F1 is taken (ties: the least), then of the two plain bar lengths nearest the measured one that
    with the better F1 when every block of bars is laid evenly from the best start within four beats, or keeps its own times moved by up to a beat (WAYS).
    songs: song_id, lead_us, beats_per_bar, measured, single (F1 without shifts), drifting (with them); blocks: song_id, block, way, shift (beats), tp, n_ref, n_est.
    pages: song_id, bar, t0, t1; pitches: song_id, bar, pitch, n.
    """
    facts = [
        (NOTE, notes, F.lit(None), F.col("onset_us") + early_us, "pitch"), (BEAT, beats, F.lit(None), "t_us", "beat_no"), (PATH, path, F.lit(None), "x", "y"),
        (PAGE, pages.where("t1 > t0"), F.col("bar"), "t0", "t1"), (PITCH, pitches, F.col("bar"), "n", "pitch"),
    ]
    as_double = lambda c: (F.col(c) if isinstance(c, str) else c).cast("double")
    rows = None
    for kind, df, k, x, y in facts:
        one = df.where("song_id is not null").select("song_id", F.lit(kind).cast("byte").alias("kind"), k.cast("long").alias("k"), as_double(x).alias("x"), as_double(y).alias("y"))
        rows = one if rows is None else rows.unionByName(one)

    def lay(table: pa.Table) -> pa.Table:
        kind, k, x, y = (table.column(c).to_numpy() for c in ("kind", "k", "x", "y"))
        given = []
        for which, by in ((NOTE, x), (BEAT, x), (PATH, x), (PAGE, k), (PITCH, k)):
            mine = np.flatnonzero(kind == which)
            mine = mine[np.argsort(by[mine], kind="stable")]
            given.append((k[mine].astype(np.int64) if which in (PAGE, PITCH) else None, x[mine], y[mine]))
        found = laid(table.column("song_id")[0].as_py(), *given, leads_us, block)
        return pa.Table.from_pylist([found] if found else [], schema)

    song_type = rows.schema["song_id"].dataType.simpleString()
    ddl = f"song_id {song_type}, lead_us int, beats_per_bar double, measured double, single double, drifting double, blocks array<struct<{','.join(f'{n}:{t}' for n, t in BLOCK)}>>"
    arrow = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    schema = pa.schema([
        ("song_id", {"bigint": pa.int64(), "int": pa.int32()}.get(song_type, pa.string())), ("lead_us", pa.int32()), *[(c, pa.float64()) for c in ("beats_per_bar", "measured", "single", "drifting")],
        ("blocks", pa.list_(pa.struct([(n, arrow[t]) for n, t in BLOCK]))),
    ])
    songs = dealt(rows, "song_id").groupBy("song_id").applyInArrow(lay, ddl)
    return songs.drop("blocks"), songs.select("song_id", F.explode("blocks").alias("b")).select("song_id", "b.*")
