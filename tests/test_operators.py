"""Operators against brute force on small random inputs."""

import random

import pytest

from segno.operators import cluster, match


def notes(spark, seed, n, first=0):
    r = random.Random(seed)
    return [(r.randrange(2), first + i, r.randrange(0, 400), r.randrange(2)) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "song_id long, note_id long, onset_us long, pitch int")


def most_pairs(a, b, tol):
    """Augmenting paths: the most one-to-one pairs within tol."""
    taken = {}

    def grow(i, seen):
        for j, y in enumerate(b):
            if abs(a[i] - y) <= tol and j not in seen:
                seen.add(j)
                if j not in taken or grow(taken[j], seen):
                    taken[j] = i
                    return True
        return False

    return sum(grow(i, set()) for i in range(len(a)))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_match_count_is_maximal(spark, seed):
    ref, est = notes(spark, seed, 60), notes(spark, seed + 50, 50, 1000)
    got = {(r.song_id, r.pitch): r.tp for r in match.match_count(frame(spark, ref), frame(spark, est), ["song_id", "pitch"], 9).collect()}
    for key, tp in got.items():
        a, b = ([x[2] for x in rows if (x[0], x[3]) == key] for rows in (ref, est))
        assert tp == most_pairs(a, b, 9)


def test_anchored_clusters_follow_the_first_note(spark):
    rows = notes(spark, 7, 80)
    got = {r.note_id: r.anchor_us for r in cluster.anchored_clusters(frame(spark, rows), ["song_id"], 10).collect()}
    for song in (0, 1):
        anchor = None
        for _, i, t, _ in sorted((x for x in rows if x[0] == song), key=lambda x: (x[2], x[1])):
            anchor = t if anchor is None or t - anchor > 10 else anchor
            assert got[i] == anchor


def test_near_finds_every_pair(spark):
    a, b = notes(spark, 4, 50), notes(spark, 5, 50, 1000)
    got = {(r.note_id, r.r_note_id) for r in match.near(frame(spark, a), frame(spark, b), ["song_id", "pitch"], 7).collect()}
    assert got == {(x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[3] == y[3] and abs(x[2] - y[2]) <= 7}


def test_empty_inputs(spark):
    none = frame(spark, [])
    assert match.match_count(none, none, ["song_id"], 5).count() == 0
    assert cluster.anchored_clusters(none, ["song_id"], 5).count() == 0
