"""Metre, feel and quantising against plain Python."""

import random
from bisect import bisect_right
from itertools import product

import pytest

from segno.operators import folds, metre

N = "song_id long, note_id long, onset_us long, offset_us long"
B = "song_id long, beat_no long, t_us long, bar long, beat int, unit string"
S = "song_id long, section long, start_bar long, end_bar long"


def beats_of(song, units, r, per_bar=4):
    """Beats of bars in the units given, of slightly changing length."""
    rows, t = [], 100_000
    for i in range(len(units) * per_bar + 1):
        rows.append((song, i, t, i // per_bar + 1, i % per_bar + 1, units[min(i // per_bar, len(units) - 1)]))
        t += 500_000 + r.randrange(-9, 10) * 1000
    return rows


def onsets_at(beats, shares, r, every=1.0):
    rows = []
    for a, b in zip(beats, beats[1:]):
        for f in shares:
            if r.random() < every:
                t = a[2] + int(f * (b[2] - a[2])) + r.randrange(-4, 5) * 1000
                rows.append((a[0], a[0] * 10_000 + len(rows), t, t + r.choice([90_000, 250_000, 700_000])))
    return rows


def feel_of(spark, beats, notes, sections):
    got = metre.meter_feel(spark.createDataFrame(notes, N), spark.createDataFrame(beats, B), spark.createDataFrame(sections, S))
    return {(x.song_id, x.section): (x.feel, x.read_as) for x in got.collect()}, got


def test_feel_and_reading(spark):
    r = random.Random(1)
    songs = {1: (["quarter"] * 8, [2 / 3]), 2: (["quarter"] * 8, [0.5]), 3: (["dotted_quarter"] * 8, [2 / 3]), 4: (["dotted_quarter"] * 8, [1 / 3, 2 / 3]), 5: (["quarter"] * 8, [1 / 3, 2 / 3])}
    beats, notes = [], []
    for s, (units, shares) in songs.items():
        own = beats_of(s, units, r)
        beats += own
        notes += onsets_at(own, [0, *shares], r)
    sections = [(s, k, 2 + 3 * k, 5 + 3 * k) for s in songs for k in (0, 1)]  # bars 1 and 8 lie outside
    got, feels = feel_of(spark, beats, notes, sections)
    assert got == {
        **{(1, k): ("triplet8th", None) for k in (0, 1)}, **{(2, k): (None, None) for k in (0, 1)}, **{(3, k): ("triplet8th", "shuffle") for k in (0, 1)},
        **{(4, k): (None, "compound") for k in (0, 1)}, **{(5, k): (None, None) for k in (0, 1)},
    }
    bars = metre.bar_feel(spark.createDataFrame(beats, B), spark.createDataFrame(sections, S), feels).collect()
    read = {(x.song_id, x.bar): (x.unit, x.swing) for x in bars}
    assert {read[1, b] for b in range(1, 9)} == {("quarter", True)} and {read[3, b] for b in range(1, 9)} == {("quarter", True)}
    assert {read[2, b] for b in range(1, 9)} == {("quarter", False)} and {read[4, b] for b in range(1, 9)} == {("dotted_quarter", False)}


def test_bars_outside_take_the_next_section_and_the_last(spark):
    r = random.Random(2)
    beats = beats_of(1, ["quarter"] * 14, r)
    notes = onsets_at([b for b in beats if b[3] < 9], [0, 0.5], r) + [(1, 9_000 + i, *n[2:]) for i, n in enumerate(onsets_at([b for b in beats if b[3] >= 9], [0, 2 / 3], r))]
    sections = [(1, 0, 2, 6), (1, 1, 10, 13)]
    got, feels = feel_of(spark, beats, notes, sections)
    assert got == {(1, 0): (None, None), (1, 1): ("triplet8th", None)}
    read = {x.bar: x.swing for x in metre.bar_feel(spark.createDataFrame(beats, B), spark.createDataFrame(sections, S), feels).collect()}
    assert [read[b] for b in range(1, 15)] == [False] * 5 + [True] * 9


def choose(unit, family, fr, ms):
    """(cost, tick, r2, pen, off, residual) of the best point."""
    each = [(round(((p - fr) * ms / 30) ** 2 + pen, 9), tick, ((p - fr) * ms / 30) ** 2, pen, off, (fr - p) * ms) for u, f, tick, p, pen, off in metre.points() if (u, f) == (unit, family)]
    return min(each)


def test_costs_path_and_quantised_notes(spark):
    r = random.Random(3)
    units = ["quarter"] * 3 + ["dotted_quarter"] * 2 + ["eighth"] * 2 + ["quarter"] * 3
    beats = beats_of(1, units, r)
    swing = {b[1]: b[3] <= 3 for b in beats}
    notes = onsets_at(beats, [0, 0.25, 1 / 3, 0.5, 2 / 3, 0.9, 0.97], r, 0.3) + [(1, 77_777, 0, 90_000)]
    t = [b[2] for b in beats]
    at = lambda x: (i := bisect_right(t, x) - 1, (x - t[i]) / (t[i + 1] - t[i]), (t[i + 1] - t[i]) / 1000) if t[0] <= x < t[-1] else None
    inside = {n[1]: at(n[2]) for n in notes if at(n[2])}
    may = lambda b: ["swing" if swing[b] and beats[b][5] == "quarter" else "bin", "ter"]
    lo, hi = min(p[0] for p in inside.values()), max(p[0] for p in inside.values())
    want = {}
    for b in range(lo, hi + 1):
        for f in may(b):
            best = [choose(beats[b][5], f, fr, ms) for i, fr, ms in inside.values() if i == b]
            want[b, f] = sum(min(x[2], 9) + x[3] for x in best) + (metre.PRIOR[beats[b][5]][f] if any(x[4] for x in best) else 0)
    table = spark.createDataFrame([(*b, swing[b[1]]) for b in beats], B + ", swing boolean")
    costs = metre.beat_costs(spark.createDataFrame(notes, N), table)
    assert {(x.beat, x.family): x.cost for x in costs.collect()} == pytest.approx(want)
    families = folds.viterbi_families(costs)
    path = {x.beat: x.family for x in families.collect()}
    kind = lambda f: f == "ter"
    total = lambda p, b0: sum(want[b0 + i, f] for i, f in enumerate(p)) + sum(kind(a) != kind(b) for a, b in zip(p, p[1:]))
    assert all(path[b] in may(b) for b in path)
    best = {f: want[lo, f] for f in may(lo)}  # least cost of paths by their last family, beat by beat
    for b in range(lo + 1, hi + 1):
        best = {f: min(c + (kind(g) != kind(f)) for g, c in best.items()) + want[b, f] for f in may(b)}
    assert total([path[b] for b in range(lo, hi + 1)], lo) == pytest.approx(min(best.values()))
    got = {x.note_id: x for x in metre.quantize_notes(spark.createDataFrame(notes, N), families, table).collect()}
    seen = 0
    for _, i, on, off in notes:
        if not (at(on) and at(off)):
            assert i not in got
            continue
        place = lambda x: (a := at(x), choose(beats[a[0]][5], path.get(a[0]) or may(a[0])[0], a[1], a[2]))
        (b, _, _), p = place(on)
        (b2, _, _), p2 = place(off)
        g, z = b * 48 + p[1], b2 * 48 + p2[1]
        hold = g // 48
        fallback = "ter" if beats[hold][5] == "dotted_quarter" else may(hold)[0]
        step = 48 // metre.PARTS[beats[hold][5]][path.get(hold) or fallback]
        x = got[i]
        assert (x.gtick, x.dur, x.bar, x.tick, x.family) == (g, max(z - g, step), beats[hold][3], (beats[hold][4] - 1) * 48 + g % 48, path[b])
        assert x.resid_ms == pytest.approx(p[5], abs=0.006)
        seen += 1
    assert seen > 30


def test_beats_allow_only_their_own_families(spark):
    rows = [(1, 0, "swing", 0.0), (1, 0, "ter", 5.0), (1, 1, "bin", 3.0), (1, 1, "ter", 0.5), (1, 2, "swing", 0.0), (1, 2, "ter", 5.0)]
    got = [x.family for x in folds.viterbi_families(spark.createDataFrame(rows, "song_id long, beat long, family string, cost double")).orderBy("beat").collect()]
    cost = {(b, f): c for _, b, f, c in rows}
    every = [(sum(cost[b, f] for b, f in enumerate(p)) + sum((x == "ter") != (y == "ter") for x, y in zip(p, p[1:])), p) for p in product(*[[f for b2, f in cost if b2 == b] for b in range(3)])]
    assert tuple(got) == min(every)[1] == ("swing", "ter", "swing")
