"""Operators of the library against plain Python, and their defined results at the edges."""

import math
import random
from itertools import permutations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from segno.operators import assign, confidence, folds, harmony, lineage, replay, score
from segno.sources import quality, readers

NOTES = "song_id long, note_id long, onset_us long, offset_us long, pitch int, instrument string, line int"


def notes_of(spark, rows):
    return spark.createDataFrame([(1, i, t, t + 100_000, p, "click", 0) for i, (t, p) in enumerate(rows)], NOTES)


def random_lists(r):
    ref = sorted((r.randrange(0, 2_000_000), r.randrange(2)) for _ in range(14))
    return ref, sorted((r.randrange(0, 2_000_000), r.randrange(2)) for _ in range(14))


@pytest.mark.parametrize("seed", [1, 2])
def test_minimum_cost_matching_equals_all_ways(spark, seed):
    r = random.Random(seed)
    ref = sorted(r.sample(range(0, 900_000, 1000), 6))
    est = sorted(r.sample(range(0, 900_000, 1000), 6))
    got = assign.match_min_cost(notes_of(spark, [(t, 0) for t in ref]), notes_of(spark, [(t, 0) for t in est]), ["song_id", "pitch"], 150_000).collect()
    best = (0, 0)
    for p in permutations(range(6)):
        d = [abs(ref[i] - est[j]) for i, j in enumerate(p)]
        fine = [x for x in d if x <= 150_000]
        best = max(best, (len(fine), -sum(fine)))
    assert (len(got), -sum(x.cost_us for x in got)) == best


def test_greedy_matching_equals_the_sorted_rule(spark):
    ref, est = random_lists(random.Random(3))
    got = {(x.ref_id, x.est_id) for x in assign.match_greedy(notes_of(spark, ref), notes_of(spark, est), ["song_id", "pitch"], 200_000).collect()}
    pairs = sorted((abs(a - b), j, i) for i, (a, p) in enumerate(ref) for j, (b, q) in enumerate(est) if p == q and abs(a - b) <= 200_000)
    want = set()
    for _, j, i in pairs:
        if all(i != a and j != b for a, b in want):
            want.add((i, j))
    assert got == want


def test_augmenting_paths_find_the_largest_matching():
    r = random.Random(4)
    for _ in range(50):
        edges = [[j for j in range(5) if r.random() < 0.4] for _ in range(5)]
        most = max(sum(j in edges[i] for i, j in enumerate(p)) for p in permutations(range(5)))
        assert sum(m >= 0 for m in assign.most_pairs(5, edges)) == most


def test_family_path_equals_all_paths(spark):
    r = random.Random(5)
    cost = [{f: r.random() * 2 for f in ("bin", "ter")} for _ in range(7)]
    rows = [(1, b, f, c) for b, x in enumerate(cost) for f, c in x.items()]
    got = [x.family for x in folds.viterbi_families(spark.createDataFrame(rows, "song_id long, beat long, family string, cost double")).orderBy("beat").collect()]
    total = lambda p: sum(cost[b][f] for b, f in enumerate(p)) + sum(a != b for a, b in zip(p, p[1:]))
    assert total(got) == pytest.approx(min(total(p) for p in product(("bin", "ter"), repeat=7)))


def chord_costs_by_hand(shares, bass):
    """Costs of one beat: 120 chords, then none."""
    if sum(shares.values()) < 0.1:
        return [0.25] * 120 + [0.0]
    norm = math.sqrt(sum(x * x for x in shares.values()))
    out = []
    for tones in harmony.QUALITIES.values():
        for root in range(12):
            dot = sum(shares.get((root + t) % 12, 0) for t in tones) / math.sqrt(len(tones)) / norm
            out.append(1 - dot + 0.02 * abs(len(tones) - 3) - (0.1 if bass == root else 0))
    return out + [1.0]


def test_chord_costs_and_path_equal_all_paths_by_hand(spark):
    r = random.Random(4)
    beats = [(s, b, b * 500_000 + s * 1000 + (b % 3) * 20_000) for s in range(3) for b in range(14)]
    at = {(s, b): t for s, b, t in beats}
    notes = []
    for s in range(3):
        for _ in range(45):
            on = r.randrange(0, 7_000_000)
            notes.append((s, len(notes), on, on + r.randrange(0, 2_500_000), r.randrange(40, 70), r.randrange(3)))
    frame = spark.createDataFrame(notes, "song_id long, note_id long, onset_us long, offset_us long, pitch int, line int")
    grid = spark.createDataFrame(beats, "song_id long, beat_no long, t_us long")
    costs = harmony.chord_costs(frame.where("line > 0"), frame.where("line = 0"), grid).cache()
    got = {(x.song_id, x.beat_no): (x.bass, x.costs) for x in costs.collect()}
    assert len(got) == 3 * 13
    for (s, b), (bass, cost) in got.items():
        a, z = at[s, b], at[s, b + 1]
        shares = [{}, {}]
        for song, _, on, off, pitch, line in notes:
            if song == s and min(off, z) > max(on, a):
                low = shares[line == 0]
                low[pitch % 12] = low.get(pitch % 12, 0) + (min(off, z) - max(on, a)) / (z - a)
        want = min(shares[1], key=lambda pc: (-shares[1][pc], pc)) if shares[1] else None
        assert bass == want
        assert cost == pytest.approx(chord_costs_by_hand(shares[0], want), abs=1e-8)
    segments = harmony.chord_segments(costs)
    path = {(x.song_id, x.beat_no): x.state for x in harmony.chord_path(segments).collect()}
    assert sorted(path) == sorted(got)
    for s in range(3):
        best = got[s, 0][1]
        for b in range(1, 13):
            low = min(best)
            best = [min(x, low + 0.15) + c for x, c in zip(best, got[s, b][1])]
        mine = [path[s, b] for b in range(13)]
        total = sum(got[s, b][1][q] for b, q in enumerate(mine)) + 0.15 * sum(p != q for p, q in zip(mine, mine[1:]))
        assert total == pytest.approx(min(best), abs=1e-9)
    checks = harmony.bass_checks(segments, costs)
    off = {(s, b) for (s, b), (bass, _) in got.items() if bass is not None and path[s, b] < 120 and bass not in harmony.CHORDS[path[s, b]]["tones"]}
    assert {(x.song_id, x.beat_no) for x in checks.collect()} == off and off
    assert harmony.chord_segments(costs.where("song_id = 9")).count() == 0


def test_repeats_and_endings_unroll(spark):
    kind = "song_id long, bar long, repeat_open boolean, repeat_count int, alternate int"
    rows = [(1, 1, False, 0, 0), (1, 2, True, 0, 0), (1, 3, False, 2, 1), (1, 4, False, 0, 2), (1, 5, False, 3, 0)]
    got = [x.bar for x in score.play_order(spark.createDataFrame(rows, kind)).orderBy("pos").collect()]
    # bar 3 is the first ending, bar 4 the second; bar 5 closes the third pass, which plays neither
    assert got == [1, 2, 3, 2, 4, 5, 2, 5] and score.play_order(spark.createDataFrame([], kind)).count() == 0


def replayed_by_hand(notes, edits, links, parts):
    """Notes (id -> dict) and reasons (seq -> why) of one song, edit by edit."""
    ns = {i: dict(track=tr, t=t, pitch=p, line=ln, pin=(None, None), status="kept", spread=False, origin=tr) for tr, i, t, p, ln in notes}
    forced = next((e["k"] for e in sorted(edits, key=lambda e: -e["seq"]) if e["op"] == "parts_k"), 0)
    for (k, i), line in parts.items():
        if k == forced and ns[i]["track"] == "guitar":
            ns[i]["line"] = line
    present = {n["line"] for n in ns.values() if n["track"] == "guitar"} | {-1}

    def find(e, now):
        if e.get("added") is not None:
            return -e["added"] if -e["added"] in now and now[-e["added"]]["status"] != "deleted" and now[-e["added"]]["track"] == e["track"] else None
        near = [(abs(n["t"] - e["onset_us"]), i) for i, n in now.items() if i >= 0 and n["status"] != "deleted" and n["track"] == e["track"] and n["pitch"] == e["pitch"] and abs(n["t"] - e["onset_us"]) <= 30_000]
        return min(near)[1] if near else None

    def refused(e):
        if (e.get("k") or 0) != forced:
            return "made with another part count"
        return "part is not in this run" if e["to"] not in present or (e["op"] == "part" and e["track"] != "guitar") else None

    def run(explicit):
        now, why, fixed, sets = {i: dict(n) for i, n in ns.items()}, {}, set(), set()
        for e in sorted(edits, key=lambda e: e["seq"]):
            op, why[e["seq"]] = e["op"], None
            if op == "parts_k":
                continue
            if op == "add":
                now[-e["seq"]] = dict(track=e["track"], t=e["onset_us"], pitch=e["pitch"], line=e["line"] if e["line"] in present else -1, pin=(None, None), status="added", spread=False, origin=e["track"])
                continue
            if op == "part_span":
                why[e["seq"]] = refused(e)
                if not why[e["seq"]]:
                    hit = [i for i, n in now.items() if n["status"] != "deleted" and n["track"] == "guitar" and n["line"] == e["from_line"] and e["start_us"] - 100 <= n["t"] < e["end_us"]]
                    for i in hit:
                        now[i].update(line=e["to"], pin=(None, None), spread=False)
                        fixed.add(i)
                    why[e["seq"]] = None if hit else "no note of that part there"
                continue
            i = find(e, now)
            if i is None:
                why[e["seq"]] = "no such note"
                continue
            n = now[i]
            if op == "delete":
                n["status"] = "deleted"
            elif op == "pitch":
                n.update(pitch=e["to"], pin=(None, None))
            elif op == "assign":
                n.update(track=e["to_track"], pin=(None, None))
            elif op == "pin":
                n["pin"] = (e["string"], e["fret"])
            else:
                why[e["seq"]] = refused(e)
                if not why[e["seq"]]:
                    n.update(line=e["to"], pin=(None, None), spread=False)
                    sets.add(i)
                    for b in links.get(i, []):
                        m = now.get(b)
                        if m and b not in explicit and b not in fixed and m["status"] != "deleted" and m["track"] == m["origin"] == "guitar" and m["line"] != e["to"]:
                            m.update(line=e["to"], spread=True)
        return now, why, sets

    return run(run(set())[2])[:2]


def test_edits_of_all_kinds_equal_a_replay_by_hand(spark):
    quality.checkpoint_folder(spark)
    r = random.Random(11)
    songs = {}
    for song in range(12):
        notes, t = [], 0
        for i in range(18):
            t += r.choice([0, 8_000, 25_000, 400_000])
            notes.append((r.choice(["guitar", "guitar", "bass"]), song * 1000 + i, t, r.choice([60, 61, 62]), r.choice([1, 2])))
        edits = []
        for seq in range(song * 1000 + 1, song * 1000 + 40):
            track, _, at, pitch, line = r.choice(notes)
            e = dict(seq=seq, op=r.choice(["delete", "pitch", "assign", "pin", "part", "part", "add", "part_span", "part", "pitch"]), track=track, onset_us=at + r.choice([0, 0, 50, 9_000, 200_000]), offset_us=at + 90_000, pitch=pitch, line=r.choice([1, 2, 9]), from_line=r.choice([1, 2]), start_us=at, end_us=at + 500_000,
                     string=r.randrange(6), fret=r.randrange(12), to_track="bass" if track == "guitar" else "guitar", k=r.choice([0, 0, 0, 3]) if song % 2 else r.choice([2, 2, 2, 0]))
            e["to"] = r.choice([60, 61, 62]) if e["op"] == "pitch" else r.choice([1, 2, 2, 1, -1, 8])
            before = [x["seq"] for x in edits if x["op"] == "add"]
            if before and e["op"] in replay.ANCHORED and r.random() < 0.3:
                e["added"] = r.choice(before)
            edits.append(e)
        if song % 2 == 0:
            edits.append(dict(seq=song * 1000 + 500, op="parts_k", k=2))
        links = {i: [j for j in range(song * 1000, song * 1000 + 18) if j != i and r.random() < 0.1] for _, i, *_ in notes}
        parts = {(2, i): r.choice([1, 2, 3]) for _, i, *_ in notes}
        songs[song] = notes, edits, links, parts
    n = spark.createDataFrame([(s, *x) for s, (notes, *_) in songs.items() for x in notes], "song_id long, track string, note_id long, onset_us long, pitch int, line int")
    fields = ["seq", "op", *replay.FIELDS]
    e = spark.createDataFrame([(s, *[x.get(f) for f in fields]) for s, (_, edits, *_) in songs.items() for x in edits], "song_id long, seq long, op string, " + ", ".join(f"`{k}` {v}" for k, v in replay.FIELDS.items()))
    ln = spark.createDataFrame([(a, b) for _, _, links, _ in songs.values() for a, bs in links.items() for b in bs], "a long, b long")
    pk = spark.createDataFrame([(s, k, i, line) for s, (*_, parts) in songs.items() for (k, i), line in parts.items()], "song_id long, k int, note_id long, line int")
    after, report = replay.apply_note_edits(n, e, ln, pk)
    got = {(x.song_id, x.note_id): (x.track, x.pitch, x.line, (x.string, x.fret), x.status, x.spread) for x in after.collect()}
    why = {(x.song_id, x.seq): x.why for x in report.collect()}
    for song, data in songs.items():
        notes, reasons = replayed_by_hand(*data)
        assert {k: v for k, v in got.items() if k[0] == song} == {(song, i): (x["track"], x["pitch"], x["line"], x["pin"], x["status"], x["spread"]) for i, x in notes.items()}
        assert {k[1]: v for k, v in why.items() if k[0] == song} == reasons
    assert set(why.values()) == {None, "no such note", "made with another part count", "part is not in this run", "no note of that part there"}
    assert any(x[5] for x in got.values())


def test_closure_ends_on_cycles_and_takes_join(spark):
    quality.checkpoint_folder(spark)
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "child long, parent long")
    closed = lineage.lineage_closure(edges)
    assert {x.node for x in lineage.cycles(closed).collect()} == {1, 2, 3}
    assert {x.node for x in lineage.stale(closed, spark.createDataFrame([(2,)], "node long")).collect()} == {1, 2, 3, 4}
    long_chain = spark.createDataFrame([(i, i + 1) for i in range(1000)], "child long, parent long")
    chain = lineage.lineage_closure(long_chain)
    assert chain.count() == 1000 * 1001 // 2 and chain.where("depth <> ancestor - node").isEmpty()
    pairs = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (3, 5)], "a long, b long")
    assert {(x.node, x.take) for x in lineage.connected_takes(pairs).collect()} == {(1, 1), (2, 1), (3, 1), (5, 1), (7, 7), (8, 7)}


def test_closure_takes_the_least_depth_on_any_graph(spark):
    r = random.Random(2)
    for n, m in ((12, 14), (30, 60), (40, 40)):
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)]
        want, front = {e: 1 for e in edges}, set(edges)
        for depth in range(2, n + 2):
            front = {(a, d) for a, b in front for c, d in edges if b == c and (a, d) not in want}
            want |= {p: depth for p in front}
        got = {(x.node, x.ancestor): x.depth for x in lineage.lineage_closure(spark.createDataFrame(edges, "child long, parent long")).collect()}
        assert got == want


def separate_fit(x, y, rounds=60):
    """Standardised logistic regression with an L2 penalty of 1, by Newton steps: (weights, intercept) over raw features."""
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale == 0, 1.0, scale)
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    penalty = np.array([1.0] * x.shape[1] + [0.0])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag(penalty), z.T @ (p - y) + penalty * w)
    return w[:-1] / scale, w[-1] - (w[:-1] * mean / scale).sum()


@pytest.mark.parametrize("most", [100, 3])
def test_models_of_all_songs_left_out_equal_separate_fits(spark, most):
    quality.checkpoint_folder(spark)
    r = np.random.default_rng(6)
    rows = []
    for song in range(7):
        for _ in range(int(r.integers(20, 60))):
            a, b = r.normal(song * 0.3, 1), r.normal(10, 4)
            rows.append((song, float(a), float(b), 3.0, float(r.random() < 1 / (1 + np.exp(-(a - 0.2 * (b - 10) - 1))))))
    frame = spark.createDataFrame(rows, "song long, a double, b double, still double, y double")
    placed, folds = confidence.folds_of(frame, "song", most)
    models = confidence.fit_left_out(placed, ["a", "b", "still"], folds)
    own = {x.song: x.fold for x in placed.select("song", "fold").distinct().collect()}
    assert folds == min(most, 7) and len(set(own.values())) <= folds
    data = np.array(rows)
    for song, fold in own.items():
        other = np.array([own[int(s)] != fold for s in data[:, 0]])
        w, b = separate_fit(data[other, 1:4], data[other, 4])
        x = data[~other, 1:4]
        mine = 1 / (1 + np.exp(-(x @ models[fold][0] + models[fold][1])))
        assert mine == pytest.approx(1 / (1 + np.exp(-(x @ w + b))), abs=1e-7)
    one = confidence.fit_confidence(placed.where(F.col("fold") != own[2]), ["a", "b", "still"])
    got = placed.where(F.col("fold") == own[2]).select("a", "b", "still", confidence.score_confidence(one).alias("p")).collect()
    assert [g.p for g in got] == pytest.approx([1 / (1 + np.exp(-(np.array([g.a, g.b, g.still]) @ models[own[2]][0] + models[own[2]][1]))) for g in got], abs=1e-3)


def test_torn_last_lines_are_skipped_and_other_damage_is_an_error(spark, tmp_path):
    (tmp_path / "good.jsonl").write_text('{"id": "e1", "op": "a"}\n\n{"id": "e2", "op": "b"}\n{"id": "e3", "o')
    got = [(x.line_no, x.id, x.op) for x in readers.read_jsonl_log(spark, str(tmp_path / "good.jsonl")).collect()]
    assert got == [(1, "e1", "a"), (3, "e2", "b")]
    (tmp_path / "bad.jsonl").write_text('{"id": "e1", "o\n{"id": "e2", "op": "b"}\n')
    with pytest.raises(Exception, match="damaged log line 1"):
        readers.read_jsonl_log(spark, str(tmp_path / "bad.jsonl")).collect()


def test_metrics_reject_unknown_columns_and_missing_names(spark):
    with pytest.raises(ValueError, match="unknown"):
        readers.normal_metrics(spark.createDataFrame([("f1", 1)], "metric string, colour int"))
    with pytest.raises(Exception, match="needs a metric"):
        readers.normal_metrics(spark.createDataFrame([(None, "s")], "metric string, suite string")).collect()


def test_annotations_in_either_layout(spark, tmp_path):
    listed = '{"annotations": [{"namespace": "note_midi", "annotation_metadata": {"data_source": "0"}, "data": [{"time": 1.0, "duration": 0.5, "value": 60.2}]}, {"namespace": "tempo", "data": [{"time": 0.0, "value": 120.0}]}]}'
    columns = '{"annotations": [{"namespace": "note_midi", "annotation_metadata": {"data_source": "5"}, "data": {"time": [2.0, 3.0], "duration": [0.1, 0.2], "value": [61.0, 62.0]}}, {"namespace": "beat_position", "data": [{"time": 0.5, "value": {"position": 1}}]}]}'
    (tmp_path / "a.json").write_text(listed + "\n" + columns)
    notes, beats, tempo = readers.read_annotations(spark, str(tmp_path / "a.json"))
    assert sorted((x.string, x.onset_s, x.pitch) for x in notes.collect()) == [(1, 2.0, 61), (1, 3.0, 62), (6, 1.0, 60)]
    assert [(x.t_s, x.position) for x in beats.collect()] == [(0.5, 1)] and [x.bpm for x in tempo.collect()] == [120.0]
