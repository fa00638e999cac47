"""Contours, thresholds and tunings against plain Python."""

import random
from itertools import product

import numpy as np
import pytest

from segno.operators import contours, evidence, parts
from segno.sources import quality

HOP = 10_000
NOTES = "song_id long, line int, note_id long, onset_us long, offset_us long, pitch int"


def played(r):
    """Notes of one line one after the other, and a contour that holds, glides, jumps, wavers, bends or drops out."""
    notes, frames, t = [], {}, 50_000
    pitch = 50
    for i in range(40):
        length = r.choice([60_000, 150_000, 320_000, 500_000])
        following = pitch + r.choice([-4, -2, 0, 1, 3, 5])
        notes.append((1, 0, i, t, t + length, pitch))
        way, noise = r.choice(["hold", "glide", "jump", "bend", "drop"]), r.choice([0.0, 0.02, 0.3])
        for f in range(t // HOP, (t + length) // HOP):
            share = (f - t // HOP) / (length / HOP)
            v = pitch + r.uniform(-noise, noise)
            if way == "glide":
                v += (following - pitch) * max(0.0, (share - 0.4) / 0.6)
            elif way == "bend":
                v += 2.0 * min(2 * share, 2 - 2 * share)
            if way == "drop" and r.random() < 0.3:
                continue
            frames[f] = v
        t += length + r.choice([0, 0, 10_000, 60_000])
        pitch = following
    return notes, frames


def glide_by_hand(a, b, frames):
    (_, _, _, on, off, p), (_, _, _, t2, z2, p2) = a, b
    first, last = (on + 30_000) // HOP, -(-max(z2 - 20_000, t2 + 60_000) // HOP)
    known = [f for f in range(first, last + 1) if f in frames]
    if not known or known[0] != first or known[-1] - first + 1 < 4:
        return False
    for x, y in zip(known, known[1:]):
        gap = y - x - 1
        if gap > 5 or abs(frames[y] - frames[x]) > 0.8 * (1 + gap / 2):
            return False
    ks = np.arange(first, known[-1] + 1)
    seg = np.interp(ks, known, [frames[k] for k in known])
    pos = (seg - p) / (p2 - p)
    reach = next((i for i in range(len(ks)) if pos[i] >= 0.75), None)
    if reach is None:
        return False
    left = [i for i in range(reach) if pos[i] <= 0.25]
    if not left:
        return False
    i0 = left[-1]
    if max(abs(seg[i0 + 1] - seg[i0]), abs(seg[reach] - seg[reach - 1])) > 0.4:
        return False
    return sum(ks[i] in frames for i in range(i0 + 1, reach)) * HOP >= 40_000


def held_by_hand(note, frames):
    first, last = note[3] // HOP, -(-note[4] // HOP)
    for k in range(first, last - 25 + 2, 2):
        known = [f for f in range(k, k + 25) if f in frames]
        if len(known) < 20:
            continue
        v = np.array([frames[f] for f in known])
        if abs(np.polyfit(np.array(known) * HOP / 1e6, v, 1)[0]) <= 1.5 and v.std() <= 0.15:
            return True
    return False


def bend_by_hand(i, notes, frames):
    _, _, _, on, off, p = notes[i]
    if any(j != i and min(off, z) - max(on, o) > 0.5 * (off - on) for j, (_, _, _, o, z, _) in enumerate(notes)):
        return None
    a, b = (on + 40_000) // HOP, off // HOP
    if b - a < 8:
        return None
    smooth = {}
    for k in range(a, b):
        near = [frames[f] for f in range(max(a, k - 2), min(b, k + 3)) if f in frames]
        if len(near) >= 2:
            smooth[k] = float(np.median(near))
    if len(smooth) < 8:
        return None
    ks = sorted(smooth)
    start = float(np.median([smooth[k] for k in ks[:4]]))
    top = max(ks, key=lambda k: (smooth[k], -k))
    rise = 100 * (smooth[top] - start)
    if not 80 <= rise <= 450 or (top - a) * HOP + 40_000 < 50_000 or (abs(start - p) > 0.7 and abs(smooth[top] - p) > 0.7):
        return None
    return "half" if rise < 150 else "full" if rise < 250 else "one_half", 100 * (smooth[top] - min(smooth[k] for k in ks if k >= top)) >= 80


@pytest.mark.parametrize("seed", [1, 2])
def test_glides_plateaus_and_bends_equal_the_rules_by_hand(spark, seed):
    notes, frames = played(random.Random(seed))
    n = spark.createDataFrame(notes, NOTES)
    f = spark.createDataFrame([(1, 0, k, float(v)) for k, v in frames.items()], "song_id long, line int, frame long, midi double")
    got = {x.note_id: x.glide for x in contours.glides(n, f).collect()}
    pairs = [(a, b) for a, b in zip(notes, notes[1:]) if a[5] != b[5] and b[3] - a[4] <= 30_000 and b[3] - a[3] >= 40_000]
    assert got == {a[2]: glide_by_hand(a, b, frames) for a, b in pairs} and len(set(got.values())) == 2
    held = {x.note_id: x.held for x in contours.plateaus(n, f).collect()}
    assert held == {x[2]: held_by_hand(x, frames) for x in notes} and len(set(held.values())) == 2
    bent = {x.note_id: (x.bend, x.release) for x in contours.bends(n, f).collect()}
    want = {i: bend_by_hand(i, notes, frames) for i in range(len(notes))}
    assert bent == {i: w for i, w in want.items() if w} and bent
    assert contours.glides(n.limit(0), f).count() == contours.bends(n, f.limit(0)).count() == 0


def label_by_hand(x, t):
    def one(v, key, above):
        return evidence.UNKNOWN if v is None else ((v - t[key]) if above else (t[key] - v)) / evidence.SCALES[key]

    r0 = min(one(x["sm"], "r0_sm_db", False), one(x["coh"], "r0_coh", True))
    r1 = min(one(abs(x["xcoff"]), "adt_xcorr", True), one(x["lag"] if x["lag"] is None else abs(x["lag"]), "adt_min_lag_ms", True), one(abs(x["xcoff"]) - x["r0"], "adt_over_r0", True))
    r2 = min(one(x["coh"], "r2_coh", False), one(x["hard"], "r2_hard", False), one(x["cen"], "r2_cen", True))
    r3 = max(one(x["ildcoh"], "r3_ild_db", True), min(one(x["hard"], "r3_hard", True), one(x["coh"], "r3_coh", False)))
    s = [round(v, 4) for v in (r0, r1, r2, r3)]
    return evidence.LABELS[s.index(max(s))] if max(s) > 0 else "mixed"


def macro_by_hand(rows, t):
    classes = sorted({x["truth"] for x in rows})
    return sum(np.mean([label_by_hand(x, t) == c for x in rows if x["truth"] == c]) for c in classes) / len(classes)


def test_thresholds_are_refitted_as_by_hand(spark):
    r = random.Random(3)
    rows = []
    for i in range(160):
        truth = r.choice(["R0", "R1", "R2", "R3", "mixed"])
        rows.append({
            "truth": truth, "sm": r.choice([None, -15.0, -9.0, -3.0]) if truth != "R0" else r.uniform(-20, -6), "coh": round(r.uniform(0.9, 1) if truth == "R0" else r.uniform(0.4, 1), 3),
            "xcoff": round(r.uniform(-1, 1), 2), "lag": r.choice([None, 2.0, 9.0, -12.0]), "r0": round(r.uniform(0, 1), 2), "hard": round(r.uniform(0, 0.6), 2), "ildcoh": round(r.uniform(0, 12 if truth == "R3" else 7), 2), "cen": round(r.uniform(0, 1), 2),
        })
    frame = spark.createDataFrame([tuple(x.values()) for x in rows], "truth string, sm double, coh double, xcoff double, lag double, r0 double, hard double, ildcoh double, cen double").cache()
    quantiles = [0.25, 0.75]
    found, trace = evidence.threshold_refit(frame, sweeps=2, quantiles=quantiles)
    tried = evidence.candidates(frame, list(evidence.THRESHOLDS), quantiles)
    for key, values in tried.items():  # a quantile is the least value that the share of windows reaches, in steps of a thousandth of a unit
        column = {"r0_sm_db": "sm", "adt_min_lag_ms": "lag", "r3_ild_db": "ildcoh"}.get(key)
        if column:
            v = sorted(abs(x[column]) if key == "adt_min_lag_ms" else x[column] for x in rows if x[column] is not None)
            want = {evidence.THRESHOLDS[key], *(v[int(np.ceil(q * len(v))) - 1] for q in quantiles)}
            assert values == pytest.approx(sorted(want), abs=1e-3 * evidence.SCALES[key])
    now, by_hand = dict(evidence.THRESHOLDS), []
    for _ in range(2):
        for label, keys in evidence.GROUPS.items():
            way = lambda c: now | dict(zip(keys, c))  # noqa: B023, E731
            away = lambda c: sum(abs(v - evidence.THRESHOLDS[k]) / evidence.SCALES[k] for k, v in zip(keys, c))  # noqa: B023, E731
            best = min(product(*[tried[k] for k in keys]), key=lambda c: (-round(macro_by_hand(rows, way(c)), 9), round(away(c), 9), c))
            now = way(best)
        by_hand.append(macro_by_hand(rows, now))
    assert found == pytest.approx(now) and trace == pytest.approx(by_hand[: len(trace)])
    assert trace[-1] >= macro_by_hand(rows, evidence.THRESHOLDS)


def test_fake_low_notes_change_what_is_playable(spark):
    guitar = [(1, 0, 0, 38), (1, 1, 5_000_000, 38), (1, 2, 5_010_000, 50), (1, 3, 9_000_000, 52), (1, 4, 9_000_000, 57)]
    bass = [(1, 10, 1_000, 400_000, 38)]
    g = spark.createDataFrame([(s, i, t, t + 100_000, p) for s, i, t, p in guitar], "song_id long, note_id long, onset_us long, offset_us long, pitch int")
    b = spark.createDataFrame(bass, "song_id long, note_id long, onset_us long, offset_us long, pitch int")
    assert {(x.note_id, x.why) for x in evidence.fake_low_notes(g, b).collect()} == {(0, "bleed"), (1, "octave")}
    got = {x.tuning: (x.notes, x.unplayable) for x in evidence.tuning_feasibility(g, b).collect()}
    assert len(got) == len(evidence.hypotheses()) and got["std"] == (3, 0.0)
    held = g.unionByName(spark.createDataFrame([(1, 20 + k, 5_500_000 + k * 300_000, 5_900_000 + k * 300_000, 38) for k in range(3)], g.schema))
    again = {x.tuning: (x.notes, round(x.unplayable, 3)) for x in evidence.tuning_feasibility(held, b.limit(0)).collect()}
    assert again["std"] == (8, 0.625) and again["drop"] == (8, 0.0)  # a riff of low notes is no error, so only the drop tuning plays it


def test_a_planted_lag_and_drift_are_found(spark):
    r = random.Random(9)
    a = {f: r.random() for f in r.sample(range(3000), 900)}
    b = {f + 4 + f // 1000: v for f, v in a.items()}
    rows = lambda s: spark.createDataFrame([(1, k, v) for k, v in s.items()], "song_id long, frame long, x double")
    windows = evidence.window_lags(rows(a), rows(b), 10, 250)
    by = {x.window: (x.lag, x.r) for x in windows.collect()}
    assert all(by[k][0] == 4 + k // 4 and by[k][1] > 0.99 for k in range(12))
    one = evidence.best_lag(windows).first()
    assert abs(one.lag - 5) < 0.6 and 1.5 < one.spread < 2.8 and 0.15 < one.drift < 0.35 and one.used == 12


def test_parts_of_two_sides_are_told_apart_and_forced_counts_kept(spark):
    quality.checkpoint_folder(spark)
    rows, t = [], 0
    for w in range(6):
        for k in range(24):
            t += 300_000
            left = k % 2 == 0
            rows.append((1, len(rows), t, 45 if left else 66, "a" if left else "b", t, 1, False, False, False, 6.0 if left else -6.0, 0.5, 0.0, w, "R3", w // 3))
    kind = "song_id long, note_id long, onset_us long, pitch int, instrument string, cluster long, size int, chord boolean, peel boolean, lead boolean, ild_db double, coh double, ms_db double, w long, label string, section long"
    frame = spark.createDataFrame(rows, kind)
    notes, lines, counts = parts.diarize(frame, spark.createDataFrame([(1, None)], "song_id long, forced int"))
    c = counts.first()
    assert (c.k, c.forced, c.evidence, c.chosen) == (2, None, "spatial", 2)
    got = {x.note_id: x.number for x in notes.collect()}
    assert got == {r[1]: 1 if r[10] > 0 else 2 for r in rows}
    assert {(x.number, x.key, x.notes) for x in lines.collect()} == {(1, "L", 72), (2, "R", 72)}
    notes, lines, counts = parts.diarize(frame, spark.createDataFrame([(1, 1)], "song_id long, forced int"))
    assert {x.number for x in notes.collect()} == {1} and counts.first().chosen == 1 and counts.first().forced == 1 and counts.first().k == 2
