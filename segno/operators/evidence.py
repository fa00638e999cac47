"""Evidence of a song: notes too low to trust, playable tunings, lags of two streams, rule scores of windows and their thresholds."""

from __future__ import annotations

import json
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..sources.quality import written

# tunings

#: Open strings of guitar tunings.
PROFILES = {
    "std": (40, 45, 50, 55, 59, 64), "drop": (38, 45, 50, 55, 59, 64), "open_g": (38, 43, 50, 55, 59, 62), "open_d": (38, 45, 50, 54, 57, 62), "dadgad": (38, 45, 50, 55, 57, 62),
}


def hypotheses() -> list[dict]:
    """name, low and high of each string's range: standard and drop tunings down to five half tones or with a capo, open ones with a capo."""
    found = [(p, d, 0) for p in ("std", "drop") for d in range(0, -6, -1)] + [(p, 0, c) for p in ("std", "drop") for c in range(1, 8)] + [(p, 0, c) for p in ("open_g", "open_d", "dadgad") for c in range(8)]
    return [{"tuning": f"{p}{d:+d}" if d else f"{p} capo {c}" if c else p, "low": [s + d + c for s in PROFILES[p]], "high": [s + d + 24 for s in PROFILES[p]]} for p, d, c in found]


def fake_low_notes(guitar: DataFrame, bass: DataFrame, low: int = 40, window_us: int = 50_000, isolation_us: int = 2_000_000, least: int = 2) -> DataFrame:
    """song_id, note_id, why: guitar notes under `low` that are no evidence of a lower tuning. bleed: alone within window_us and at the pitch of a
    sounding bass note; octave: with nothing but its octave, and fewer than `least` other low notes within isolation_us."""
    song = Window.partitionBy("song_id").orderBy("onset_us")
    near, wide = song.rangeBetween(-window_us, window_us), song.rangeBetween(-isolation_us, isolation_us)
    is_low = F.col("pitch") < low
    rows = guitar.select("song_id", "note_id", "pitch", "onset_us", (F.count("*").over(near) - 1).alias("others"), (F.sum("pitch").over(near) - F.col("pitch")).alias("rest"), (F.count_if(is_low).over(wide) - 1).alias("lows")).where(is_low)
    # the latest end of all bass notes of the pitch that have begun by the end of the window
    own = rows.where("others = 0").select("song_id", "pitch", (F.col("onset_us") + window_us).alias("t"), F.lit(1).alias("side"), F.col("note_id"), F.col("onset_us"), F.lit(None).cast("long").alias("end"))
    heard = bass.select("song_id", "pitch", F.col("onset_us").alias("t"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("note_id"), F.lit(None).cast("long").alias("onset_us"), F.col("offset_us").alias("end"))
    w = Window.partitionBy("song_id", "pitch").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    bleed = own.unionByName(heard).withColumn("_end", F.max("end").over(w)).where((F.col("side") == 1) & (F.col("_end") >= F.col("onset_us") - window_us))
    octave = rows.where((F.col("others") == 1) & (F.col("rest") == F.col("pitch") + 12) & (F.col("lows") < least))
    return bleed.select("song_id", "note_id", F.lit("bleed").alias("why")).unionByName(octave.select("song_id", "note_id", F.lit("octave").alias("why")))


def tuning_feasibility(guitar: DataFrame, bass: DataFrame, tunings: list[dict] | None = None) -> DataFrame:
    """song_id, tuning, notes, unplayable: the share of notes, fake low ones left out, that no string of a tuning reaches. Only counts of pitches
    meet the tunings."""
    real = guitar.join(fake_low_notes(guitar, bass).select("note_id"), "note_id", "left_anti").groupBy("song_id", "pitch").agg(F.count("*").alias("n"))
    table = F.from_json(F.lit(json.dumps(tunings or hypotheses())), "array<struct<tuning:string,low:array<int>,high:array<int>>>")
    each = real.select("song_id", "pitch", "n", F.explode(table).alias("h"))
    fits = F.exists(F.arrays_zip("h.low", "h.high"), lambda s: F.col("pitch").between(s["low"], s["high"]))
    g = each.groupBy("song_id", F.col("h.tuning").alias("tuning")).agg(F.sum("n").alias("notes"), F.sum(F.when(fits, 0).otherwise(F.col("n"))).alias("out"))
    return g.select("song_id", "tuning", "notes", (F.col("out") / F.col("notes")).alias("unplayable"))


# lags


def window_lags(a: DataFrame, b: DataFrame, most: int, width: int, guard: int = 2) -> DataFrame:
    """song_id, window, lag, r, ratio, refined: for each window of `width` frames of a the lag (up to `most` frames either way) at which b is most like
    it: b at frame + lag against a at frame, as a cosine. ratio: to the best lag more than `guard` away (null without one); refined:
    the top of the parabola through the neighbours. a, b: song_id, frame, x; frames without a row are 0."""
    lags = F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("lag")
    left = a.select("song_id", "frame", F.col("x").alias("xa"), F.floor(F.col("frame") / width).alias("window"), lags)
    energy = a.groupBy("song_id", F.floor(F.col("frame") / width).alias("window")).agg(F.sum(F.col("x") * F.col("x")).alias("ea"))
    moved = b.select("song_id", F.col("frame").alias("_f"), F.col("x").alias("xb"), lags).withColumn("frame", F.col("_f") - F.col("lag")).hint("merge")  # a row for each lag, which Spark doesn't foresee
    other = moved.groupBy("song_id", F.floor(F.col("frame") / width).alias("window"), "lag").agg(F.sum(F.col("xb") * F.col("xb")).alias("eb"))
    dots = left.join(moved.select("song_id", "frame", "lag", "xb"), ["song_id", "frame", "lag"]).groupBy("song_id", "window", "lag").agg(F.sum(F.col("xa") * F.col("xb")).alias("dot"))
    rs = dots.join(other, ["song_id", "window", "lag"]).join(energy, ["song_id", "window"])
    rs = rs.select("song_id", "window", "lag", F.round(F.col("dot") / F.sqrt(F.col("ea") * F.col("eb")), 9).alias("r"))
    g = rs.groupBy("song_id", "window").agg(F.collect_list(F.struct("lag", "r")).alias("rs"))
    best = F.array_max(F.transform("rs", lambda x: F.struct(x["r"].alias("r"), (-F.abs(x["lag"])).alias("near"), (-x["lag"]).alias("minus"))))
    g = g.select("song_id", "window", "rs", best["r"].alias("r"), (-best["minus"]).alias("lag"))
    at = lambda k: F.get(F.filter("rs", lambda x: x["lag"] == F.col("lag") + k), F.lit(0))["r"]
    second = F.array_max(F.transform(F.filter("rs", lambda x: F.abs(x["lag"] - F.col("lag")) > guard), lambda x: x["r"]))
    bend = at(-1) - 2 * F.col("r") + at(1)
    top = F.when(bend < 0, F.least(F.greatest(0.5 * (at(-1) - at(1)) / bend, F.lit(-0.5)), F.lit(0.5))).otherwise(0.0)
    return g.select("song_id", "window", "lag", "r", F.when(second > 0, F.col("r") / second).alias("ratio"), (F.col("lag") + F.coalesce(top, F.lit(0.0))).alias("refined"))


def best_lag(windows: DataFrame, least: float = 0.3) -> DataFrame:
    """song_id, lag (median), spread, drift (frames of lag by window), used: over the windows with a cosine of `least`, or all where none has."""
    good = F.col("r") >= least
    rows = windows.withColumn("_any", F.bool_or(good).over(Window.partitionBy("song_id"))).where(good | ~F.col("_any"))
    slope = F.when((F.count("*") >= 3) & (F.max("window") > F.min("window")), F.regr_slope("refined", "window")).otherwise(0.0)
    return rows.groupBy("song_id").agg(F.median("refined").alias("lag"), (F.max("refined") - F.min("refined")).alias("spread"), slope.alias("drift"), F.count("*").alias("used"))


# rules of windows

LABELS = ["R0", "R1", "R2", "R3"]
#: Where each rule starts, and the unit in which its distance counts.
THRESHOLDS = {
    "r0_sm_db": -12.0, "r0_coh": 0.95, "adt_xcorr": 0.5, "adt_min_lag_ms": 5.0, "adt_over_r0": 0.0, "r2_coh": 0.85, "r2_hard": 0.1, "r2_cen": 0.4, "r3_ild_db": 6.0, "r3_hard": 0.3, "r3_coh": 0.6,
}
SCALES = {
    "r0_sm_db": 3.0, "r0_coh": 0.05, "adt_xcorr": 0.1, "adt_min_lag_ms": 2.0, "adt_over_r0": 0.1, "r2_coh": 0.05, "r2_hard": 0.05, "r2_cen": 0.1, "r3_ild_db": 2.0, "r3_hard": 0.05, "r3_coh": 0.05,
}
#: Thresholds that are searched together: those of one label.
GROUPS = {"R0": ["r0_sm_db", "r0_coh"], "R1": ["adt_xcorr", "adt_min_lag_ms", "adt_over_r0"], "R2": ["r2_coh", "r2_hard", "r2_cen"], "R3": ["r3_ild_db", "r3_hard", "r3_coh"]}
FEATURES = ["sm", "coh", "xcoff", "lag", "r0", "hard", "ildcoh", "cen"]
#: Score of a rule whose feature is unknown.
UNKNOWN = -10.0


def features() -> dict[str, tuple[Column, bool]]:
    """By threshold: the feature it bounds, and whether from below."""
    c, over = F.col, F.abs("xcoff") - F.col("r0")
    return {
        "r0_sm_db": (c("sm"), False), "r0_coh": (c("coh"), True), "adt_xcorr": (F.abs("xcoff"), True), "adt_min_lag_ms": (F.abs("lag"), True), "adt_over_r0": (over, True), "r2_coh": (c("coh"), False),
        "r2_hard": (c("hard"), False), "r2_cen": (c("cen"), True), "r3_ild_db": (c("ildcoh"), True), "r3_hard": (c("hard"), True), "r3_coh": (c("coh"), False),
    }


def rule_score(label: str, thresholds: dict[str, float | Column]) -> Column:
    """How far a window meets a label's rules, in units of SCALES; over 0: it meets them."""

    known = features()

    def one(key: str) -> Column:
        value, above = known[key]
        t = thresholds[key] if isinstance(thresholds[key], Column) else F.lit(float(thresholds[key]))
        return F.coalesce((value - t if above else t - value) / SCALES[key], F.lit(UNKNOWN))

    parts = [one(k) for k in GROUPS[label]]
    if label == "R3":  # one side is louder, or sides are hard and differ
        return F.greatest(parts[0], F.least(parts[1], parts[2]))
    return F.least(*parts)


def best_label(scores: list[Column]) -> Column:
    """The label with the highest score over 0 (ties: the first), else mixed."""
    best = F.array_max(F.array(*[F.struct(F.round(s, 4).alias("s"), F.lit(-i).alias("order"), F.lit(k).alias("label")) for i, (k, s) in enumerate(zip(LABELS, scores))]))
    return F.when(best["s"] > 0, best["label"]).otherwise("mixed")


def rule_labels(windows: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """windows + score_R0 to score_R3 (4 decimals), rule_label. windows: sm, coh, xcoff, lag, r0, hard, ildcoh, cen, each may be null."""
    t = THRESHOLDS | (thresholds or {})
    rows = windows.select("*", *[F.round(rule_score(k, t), 4).alias(f"score_{k}") for k in LABELS])
    return rows.withColumn("rule_label", best_label([F.col(f"score_{k}") for k in LABELS]))


def candidates(windows: DataFrame, keys: list[str], quantiles: list[float], step: float = 1e-3) -> dict[str, list[float]]:
    """By threshold: its start and the quantiles of its feature, which is counted in steps of its unit, so that counts stay few at any size."""
    known = features()
    steps = F.array(*[F.struct(F.lit(k).alias("key"), F.round(known[k][0] / (step * SCALES[k])).cast("long").alias("at")) for k in keys])
    each = windows.select(F.explode(steps).alias("s")).where("s.at is not null").groupBy("s.key", "s.at").agg(F.count("*").alias("n"))
    counts: dict[str, list] = {k: [] for k in keys}
    for r in each.collect():
        counts[r["key"]].append((r["at"], r["n"]))
    out = {}
    for key in keys:
        total, run, found = sum(n for _, n in counts[key]), 0, {round(THRESHOLDS[key], 4)}
        for at, n in sorted(counts[key]):
            found |= {round(at * step * SCALES[key], 4) for q in quantiles if run < q * total <= run + n}
            run += n
        out[key] = sorted(found)
    return out


def met_counts(windows: DataFrame, label: str, tried: dict[str, list[float]], thresholds: dict[str, float]) -> DataFrame:
    """truth, other, one column for each threshold of the label, n: windows by whether they are labelled right where this label does not win (other)
    and by how many values of each threshold let its rule win.

    A score falls as its threshold gets stricter, so the values that let it win lie together at one end, and least and greatest of scores win where
    all or one of them do. Windows are counted once, whatever the number of combinations.
    """
    place, features_of = LABELS.index(label), features()
    scores = {k: F.round(rule_score(k, thresholds), 4) for k in LABELS if k != label}
    rows = windows.where("truth is not null").select("*", *[scores[k].alias(f"score_{k}") for k in scores])
    rivals = [F.col(f"score_{k}") if k != label else F.lit(float("-inf")) for k in LABELS]
    # what a score must be over, and what it must be at least: of equal scores the first label wins
    over, least = (F.greatest(F.lit(low), F.lit(low), *r) for low, r in ((0.0, rivals[:place]), (float("-inf"), rivals[place + 1 :])))
    right = best_label(rivals) == F.col("truth")
    rows = rows.select("truth", right.alias("other"), over.alias("_over"), least.alias("_least"), *[features_of[k][0].alias(k) for k in GROUPS[label]])

    def met(key: str) -> Column:
        value, above, unit = F.col(key), features_of[key][1], SCALES[key]

        def wins(t: Column) -> Column:
            s = F.round(F.coalesce((value - t if above else t - value) / unit, F.lit(UNKNOWN)), 4)
            return (s > F.col("_over")) & (s >= F.col("_least"))

        return F.size(F.filter(F.array(*[F.lit(float(t)) for t in tried[key]]), wins)).alias(key)

    return rows.select("truth", "other", *[met(k) for k in GROUPS[label]]).groupBy("truth", "other", *GROUPS[label]).agg(F.count("*").alias("n"))


def macro_by_combo(windows: DataFrame, label: str, tried: dict[str, list[float]], thresholds: dict[str, float]) -> dict[tuple[float, ...], float]:
    """By combination of a label's thresholds (in the order of GROUPS): accuracy over the true labels (9 decimals) if they take these values and the others stay.

    Windows are counted by how many values of each threshold they meet (met_counts); only these counts, of which there are no more than
    combinations for a truth, reach the driver.
    """
    keys, known = GROUPS[label], features()
    tried = {k: sorted(set(map(float, tried[k]))) for k in keys}
    shape = tuple(len(tried[k]) for k in keys)
    hits, total = {}, {}
    for r in met_counts(windows, label, tried, thresholds).collect():
        # the combinations at which each rule wins: an end of its values
        ends = [slice(0, r[k]) if known[k][1] else slice(len(tried[k]) - r[k], None) for k in keys]
        won = np.zeros(shape, bool)
        if label == "R3":  # as in rule_score
            won[ends[0]] = True
            won[:, ends[1], ends[2]] = True
        else:
            won[tuple(ends)] = True
        truth, n = r["truth"], r["n"]
        hits[truth] = hits.get(truth, 0) + n * np.where(won, truth == label, r["other"])
        total[truth] = total.get(truth, 0) + n
    if not hits:
        return {}
    macro = sum(hits[t] / total[t] for t in sorted(hits)) / len(hits)
    return {c: round(float(m), 9) for c, m in zip(product(*[tried[k] for k in keys]), macro.ravel())}


def threshold_grid(windows: DataFrame, label: str, tried: dict[str, list[float]], thresholds: dict[str, float]) -> DataFrame:
    """combo (values in the order of GROUPS), macro: see macro_by_combo. windows: truth, features."""
    rows = list(macro_by_combo(windows, label, tried, thresholds).items())
    return windows.sparkSession.createDataFrame(rows, f"combo struct<{','.join(f'{k}:double' for k in GROUPS[label])}>, macro double")


def threshold_refit(windows: DataFrame, sweeps: int = 3, quantiles: list[float] | None = None) -> tuple[dict[str, float], list[float]]:
    """(thresholds, macro accuracy after each sweep): label by label the combination with the best accuracy, of equals the one nearest to the
    start in units of SCALES, then the smaller values; sweeps end when none changes. Only grids of candidates reach the driver."""
    quantiles = quantiles or [round(0.05 + 0.09 * i, 2) for i in range(11)]
    windows = written(windows.select("truth", *FEATURES), "windows")  # computed once for all passes
    now, trace = dict(THRESHOLDS), []
    tried = candidates(windows, list(THRESHOLDS), quantiles)
    for _ in range(sweeps):
        before, macro = dict(now), 0.0
        for label, keys in GROUPS.items():
            grid = macro_by_combo(windows, label, tried, now)
            away = lambda c: round(sum(abs(v - THRESHOLDS[k]) / SCALES[k] for k, v in zip(keys, c)), 9)  # noqa: B023, E731
            best = min(grid, key=lambda c: (-grid[c], away(c), c))  # noqa: B023
            now |= dict(zip(keys, best))
            macro = grid[best]
        trace.append(macro)
        if now == before:
            break
    return now, trace
