"""Beat repair, trackers, repeats and error tables on tables of one's own, against plain Python."""

import math
import random
import statistics

import pytest

from segno.operators import errors, pulse, repeats, trackers
from segno.sources import quality


def doubled_by_hand(beats):
    """The beats left, one after the other: (time, downbeat)."""
    if len(beats) < 3:
        return [(t, d) for t, d, _ in beats]
    t = [b[0] for b in beats]
    gone, down = set(), [b[1] for b in beats]
    for i in range(len(t) - 1):
        left = t[i] - t[i - 1] if i else math.inf
        right = t[i + 2] - t[i + 1] if i + 2 < len(t) else math.inf
        if t[i + 1] - t[i] >= 0.42 * min(left, right):
            continue
        keys = []
        for j in (i, i + 1):
            odd = round(abs(math.log((t[j] - t[i - 1]) / (t[i + 2] - t[j]))), 9) if i and i + 2 < len(t) else 0.0
            keys.append((-(beats[j][2] or 0.0), odd, j))
        keep = min(keys)[2]
        down[keep] = beats[i][1] or beats[i + 1][1]
        gone.add(2 * i + 1 - keep)
    return [(t[i], down[i]) for i in range(len(t)) if i not in gone]


def test_merge_double_beats(spark):
    r = random.Random(3)
    songs = {s: [] for s in range(12)}
    for s, out in songs.items():
        t = 0
        for i in range(2 if s == 0 else 1 if s == 1 else 60):
            out.append((t, i % 4 == 0, r.choice([None, 0.2, 0.2, 0.9])))
            t += r.choice([500_000, 510_000, 490_000, 60_000, 150_000])
    rows = [(s, *b) for s, bs in songs.items() for b in bs]
    got = pulse.merge_double_beats(spark.createDataFrame(rows, "song_id long, t_us long, down boolean, act double"))
    want = [(s, *b) for s, bs in songs.items() for b in doubled_by_hand(bs)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert len(want) < len(rows)


def test_fill_missing_beats(spark):
    r = random.Random(4)
    rows, want = [], []
    for s in range(6):
        t, times = 0, []
        for _ in range(3 if s == 0 else 50):
            times.append(t)
            t += r.choice([1, 1, 1, 2, 3, 2.4, 9]) * 500_000 + r.randint(-15_000, 15_000)
        times = [int(x) for x in times]
        rows += [(s, x) for x in times]
        gaps = [b - a for a, b in zip(times, times[1:])]
        want += [(s, float(x), False) for x in times]
        for i, g in enumerate(gaps if len(times) >= 4 else []):
            local = statistics.median(gaps[max(0, i - 4) : i + 5])
            k = round(g / local)
            if k >= 2 and g <= 4_000_000 and abs(g / k - local) <= 0.08 * local:
                want += [(s, times[i] + g * j / k, True) for j in range(1, k)]
    got = pulse.fill_missing_beats(spark.createDataFrame(rows, "song_id long, t_us long"))
    near = lambda xs: sorted((s, round(t, 2), f) for s, t, f in xs)
    assert near(map(tuple, got.collect())) == near(want)
    assert any(f for _, _, f in want)


def test_tempo_level_runs(spark):
    times, t = [], 0
    for step in [500] * 10 + [250] * 4 + [500] * 5 + [1000] * 3 + [500] * 4 + [250] + [500] * 3:
        times.append(t)
        t += step * 1000
    got = pulse.tempo_level_runs(spark.createDataFrame([(7, x) for x in times], "song_id long, t_us long")).orderBy("start_us").collect()
    assert [(g.kind, g.start_us, g.end_us, g.n) for g in got] == [("fast", 5_000_000, 5_750_000, 4), ("slow", 8_500_000, 10_500_000, 3)]


def vote_by_hand(pitch, xs):
    if len(xs) < 2:
        return "no_f0", None
    ranked = [(sum(abs(x - t) <= 0.5 for x in xs), -abs(t - pitch), t) for t in {round(x) for x in xs}]
    ranked = [k for k in ranked if k[0] >= 2]
    if not ranked:
        return "split", None
    t = max(ranked)[2]
    d = abs(t - pitch)
    return "confirmed" if d == 0 else "octave" if d in (12, 24, 36) else "semitone" if d == 1 else "disagree", t


def test_votes_and_estimates(spark):
    r = random.Random(5)
    notes, frames = [], {}
    for i in range(150):
        on = i * 1_000_000 + r.randint(0, 9_999)
        off = on + r.choice([15_000, 45_000, 69_999, 70_000, 200_000, 900_000])
        notes.append((1, 0, i, on, off, r.randint(40, 60)))
        for k in ("a", "b", "c"):
            base = notes[-1][5] + r.choice([0, 0, 0, 12, 1, -1, 5, 0.5])
            for f in range(on // 10_000, off // 10_000 + 2):
                frames[1, 0, k, f] = (None if r.random() < 0.1 else float(base + r.choice([0, 0.1, -0.2])), r.choice([0.5, 0.9, 0.9, 0.49]))
    table = spark.createDataFrame(notes, "song_id long, line int, note_id long, onset_us long, offset_us long, pitch int")
    heard = spark.createDataFrame([(*k, *v) for k, v in frames.items()], "song_id long, line int, tracker string, frame long, midi double, conf double")
    estimates = trackers.f0_estimates(heard, table)
    got = {(x.note_id, x.tracker): x.x for x in estimates.collect()}
    want = {}
    for _, _, i, on, off, _ in notes:
        a, b = on + 30_000, min(on + 120_000, off - 10_000)
        if b - a < 30_000:
            a, b = on + 10_000, max(on + 30_000, off)
        for k in ("a", "b", "c"):
            xs = [m for f in range(-(-a // 10_000), -(-b // 10_000)) for m, c in [frames.get((1, 0, k, f), (None, 0))] if m is not None and c >= 0.5]
            if len(xs) >= 3:
                want[i, k] = statistics.median(xs)
    assert got == pytest.approx(want)
    voted = {v.note_id: (v.action, v.target) for v in trackers.f0_vote(table, estimates).collect()}
    assert voted == {n[2]: vote_by_hand(n[5], [x for (i, _), x in got.items() if i == n[2]]) for n in notes}
    assert len({a for a, _ in voted.values()}) == 6


def test_harmonics_of_confirmed_notes(spark):
    n = [
        (1, 1, 0, 300_000, 40, 40), (1, 2, 10_000, 900_000, 40, None), (1, 3, 20_000, 200_000, 52, None), (1, 4, 30_000, 200_000, 59, 59), (1, 5, 35_000, 200_000, 47, None),
        (1, 6, 2_000_000, 2_100_000, 40, None), (1, 7, 2_010_000, 2_100_000, 52, None), (1, 8, 5_000_000, 5_100_000, 40, 40),
    ]
    got = trackers.harmonic_dupes(spark.createDataFrame(n, "song_id long, note_id long, onset_us long, offset_us long, pitch int, target int"))
    # 2 is the base again and gives its offset, 3 its octave; 4 is confirmed itself, 5 no harmonic; without a confirmed note all stay
    assert sorted((x.note_id, x.offset_us) for x in got.collect()) == [(1, 900_000), (4, 200_000), (5, 200_000), (6, 2_100_000), (7, 2_100_000), (8, 5_100_000)]


def test_tracker_accuracy(spark):
    notes = spark.createDataFrame([(1, 0, 0, 200_000, 40), (1, 0, 160_000, 400_000, 50)], "song_id long, line int, onset_us long, offset_us long, pitch int")
    # reference frames: 3 to 17 of the first and 19 to 37 of the second; none sounds twice once margins are off
    rows = [(1, 0, "a", f, 40.2 if f < 10 else 52.0, 0.9) for f in range(3, 18)] + [(1, 0, "a", f, 50.0, 0.2) for f in range(19, 38)]
    got = {x.band: x for x in trackers.tracker_accuracy(notes, spark.createDataFrame(rows, "song_id long, line int, tracker string, frame long, midi double, conf double")).collect()}
    low, high, both = got["30-100"], got["100-400"], got["all"]
    assert (low.frames, high.frames, both.frames) == (15, 19, 34)
    assert (low.rpa, low.rca, low.vr, low.octave) == (round(7 / 15, 6), 1.0, 1.0, round(8 / 15, 6))
    assert (high.rpa, high.vr, high.rpa_any) == (0.0, 0.0, 1.0)


def test_similar_bars_find_a_planted_repeat(spark):
    r = random.Random(6)
    verse = [[r.random() for _ in range(6)] for _ in range(8)]
    bars = verse + [[r.random() for _ in range(6)] for _ in range(8)] + verse
    rows = [(1, b, f, x) for b, v in enumerate(bars, 1) for f, x in enumerate(v)]
    got = repeats.similar_bars(spark.createDataFrame(rows, "song_id long, bar long, feature int, x double")).where("place = 1").collect()
    best = {x.bar: (x.other, x.score) for x in got}
    assert all(best[b] == (b + 16, 1.0) and best[b + 16] == (b, 1.0) for b in range(2, 8))


def test_links_and_pairs(spark):
    bars = spark.createDataFrame([(1, b, b * 2_000_000) for b in range(1, 9)], "song_id long, bar long, start_us long")
    matches = spark.createDataFrame([(1, 1, 5, 0.4, 1), (1, 1, 6, 0.3, 2), (1, 2, 6, 0.9, 1), (1, 3, 7, 0.8, 1), (1, 4, 4, 0.7, 1)], "song_id long, bar long, other long, score double, place int")
    n = [(1, 10, 2, 4_100_000, 40), (1, 11, 6, 12_150_000, 40), (1, 12, 6, 12_060_000, 40), (1, 13, 6, 12_100_000, 41), (1, 14, 1, 2_100_000, 40), (1, 15, 5, 10_100_000, 40), (1, 16, 3, 7_990_000, 50), (1, 17, 8, 16_040_000, 50), (1, 18, None, 100, 40)]
    notes = spark.createDataFrame(n, "song_id long, note_id long, bar long, onset_us long, pitch int")
    got = sorted(tuple(x) for x in repeats.repeat_note_links(notes, bars, matches).collect())
    # 10 takes the nearer of two of its pitch; 16 reaches the next bar; bar 1 matches too weakly
    assert got == [(10, 12), (12, 10), (16, 17), (17, 16)]
    windows = spark.createDataFrame([(1, (b - 1) // 4, b) for b in range(1, 9)] + [(1, 5, 6)], "song_id long, w long, bar long")
    assert [tuple(x) for x in repeats.repeat_window_pairs(windows, matches).collect()] == [(1, 0, 1)]


def test_error_tables(spark):
    s = [("x", g, i, c, 8 - k, k, 2 * k, 0.5, 0.25 if c == "+a" else 0.0) for g in range(4) for i in range(3) for k, c in enumerate(("base", "null", "+a"))]
    scores = spark.createDataFrame(s, "arm string, song_id long, item long, cond string, tp long, fp long, fn long, minutes double, active double")
    d = {(x.cond, x.stat): x for x in errors.category_deltas(scores, "base", reps=50).collect()}
    assert d["+a", "fp_per_min"].delta == d["+a", "fp_per_min"].low == d["+a", "fp_per_min"].high == 4.0
    assert d["+a", "fn_per_active_min"].delta == 16.0 and d["null", "fp_per_active_min"].delta is None
    assert d["+a", "f1"].delta == round(12 / (12 + 2 + 4) - 1, 6) and d["+a", "f1"].items == 12 and d["+a", "f1"].songs == 4
    e = [("x", "+a", "fp", "octave", "drums")] * 6 + [("x", "+a", "fn", "missed", None)] * 3
    rows = spark.createDataFrame(e, "arm string, cond string, kind string, cause string, dominant string")
    causes = errors.cause_matrix(rows, scores)
    assert {(x.kind, x.cause): (x.n, x.per_min) for x in causes.collect()} == {("fp", "octave"): (6, 1.0), ("fp", "*"): (6, 1.0), ("fn", "missed"): (3, 0.5), ("fn", "*"): (3, 0.5)}
    assert [tuple(x) for x in errors.cause_vs_dominant(rows).collect()] == [("x", "+a", "octave", "drums", 6)]
    null = errors.null_spread(scores, "base", "null", ["arm"]).first()
    assert (null.items, null.d_fp_per_min, null.d_fn_per_min) == (12, 2.0, 4.0) and null.d_f1 == round(100 - 1400 / 17, 6)
    top = errors.fix_first(errors.category_deltas(scores, "base", reps=5), causes, errors.null_changes(scores, "base", "null"), 24, "+a").orderBy("place").collect()
    assert [(x.source, x.weighted) for x in top] == [("+a", 6.0), ("null", 6.0), ("null", 3.0), ("octave", 1.0), ("missed", 0.5)]
    out = [("x", "+a", "drums", True, False)] * 3 + [("x", "+a", "drums", False, False)] + [("x", "+a", None, True, True)] * 2
    got = errors.discrimination(spark.createDataFrame(out, "arm string, cond string, dominant string, dropped boolean, matched boolean"))
    assert {x.dominant: (x.dropped, x.kept_fp, x.rate) for x in got.collect()} == {"drums": (3, 1, 0.75), "_true": (2, 0, None)}


def test_note_and_segment_rules(spark):
    n = [
        (1, 1, 1, 0, 10, 60, "a", 1, 2), (1, 2, 2, 5, 4, 60, "a", 1, 2), (1, 3, 3, 5, 9, 128, "b", None, 2), (1, 4, 4, 5, 9, 60, None, None, None), (1, 5, 5, 5, 9, 60, "a", None, None),
        (1, 6, 6, None, 9, None, "a", None, None), (2, 7, 7, 1, 2, 60, "a", 3, None),
    ]
    notes = spark.createDataFrame(n, "song_id long, note_id long, place long, onset_us long, offset_us long, pitch int, instrument string, string int, fret int")
    got = {x.note_id: x.rules for x in quality.note_rules(notes, ["a"]).collect()}
    assert got == {2: "offset", 3: "pitch,instrument,string", 4: "order", 6: "offset,pitch,order", 7: "string"}
    s = spark.createDataFrame([(1, 0, -5, 3), (1, 1, 3, 8), (1, 2, 7, 9), (1, 3, 12, 12), (1, 4, 12, 20), (2, 0, 0, None)], "song_id long, place long, start_us long, end_us long")
    assert sorted((x.song_id, x.place, x.fault) for x in quality.segment_rules(s).collect()) == [(1, 0, "overlap"), (1, 2, "overlap"), (1, 3, "empty"), (2, 0, "empty")]
