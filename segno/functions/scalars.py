"""Scalar rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hz_midi(hz: Column) -> Column:
    """Null for hz at or under 0."""
    return F.when(hz > 0, 69 + 12 * F.log2(hz / 440))


def midi_hz(midi: Column) -> Column:
    return 440 * F.pow(F.lit(2.0), (midi - 69) / 12)


def pitch_class(pitch: Column) -> Column:
    return F.pmod(F.round(pitch).cast("int"), F.lit(12))


def precision(tp: Column, fp: Column, fn: Column) -> Column:
    """1 where both sides are empty."""
    return F.when(tp + fp + fn == 0, 1.0).otherwise(F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)))


def recall(tp: Column, fp: Column, fn: Column) -> Column:
    return F.when(tp + fp + fn == 0, 1.0).otherwise(F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.when(tp + fp + fn == 0, 1.0).otherwise(F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)))


def chord_shape(pitches: Column) -> Column:
    """none, single, octave, power, dyad, triad34 or full56 of a set of pitches."""
    distinct = F.array_sort(F.array_distinct(pitches))
    classes = F.array_distinct(F.transform(distinct, lambda p: F.pmod(p, F.lit(12))))
    n, c = F.size(distinct), F.size(classes)
    step = F.array_max(classes) - F.array_min(classes)
    return (
        F.when(n == 0, "none").when(n == 1, "single").when(c == 1, "octave").when((c == 2) & step.isin(5, 7), "power").when(n == 2, "dyad").when(n <= 4, "triad34").otherwise("full56")
    )


def slug(name: Column) -> Column:
    """ASCII id: lower case, ':' to '-', others to '_', runs of either collapsed, '_' trimmed; an empty one or a lone '-' is an error."""
    s = F.regexp_replace(F.replace(F.lower(name), F.lit(":"), F.lit("-")), "[^a-z0-9_-]", "_")
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "-+", "-"), "_+", "_"), "^_|_$", "")
    return F.when(s.isin("", "-"), F.raise_error(F.lit("empty slug"))).otherwise(s)


def content_key(*facts: Column) -> Column:
    """sha256 of the facts as one JSON text in the order given."""
    return F.sha2(F.to_json(F.struct(*facts)), 256)


def draw(seed: str, rep: Column, slot: Column, n: Column) -> Column:
    """A uniform draw below n that any engine can repeat: the first 8 hex figures of a sha256, modulo n."""
    text = F.concat_ws(":", F.lit(seed), rep.cast("string"), slot.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long") % n


def decide(low: Column, high: Column, least: float = 0.0) -> Column:
    """adopt if the interval lies above `least`, reject if below, else (or without one) hold."""
    return F.when(low.isNull() | high.isNull(), "hold").when(low > least, "adopt").when(high < least, "reject").otherwise("hold")


def parse_spec(text: Column) -> Column:
    """'k=v; k=v' as a map with trimmed keys and values."""
    pairs = F.str_to_map(text, F.lit(";"), F.lit("="))
    return F.transform_values(F.transform_keys(pairs, lambda k, v: F.trim(k)), lambda k, v: F.trim(v))


def softmax(score: Column, over) -> Column:
    """Share of each row in the exponentials of its window, shifted by the largest score."""
    e = F.exp(score - F.max(score).over(over))
    return e / F.sum(e).over(over)


def noisy_or(weight: Column, evidence: Column) -> Column:
    """Aggregate: 1 less the product of (1 - weight * evidence)."""
    return 1 - F.product(1 - weight * evidence)


def uniform(seed: str, *facts: Column) -> Column:
    """A number in [0, 1) that any engine can repeat: the first 8 hex figures of a sha256 of the facts."""
    text = F.concat_ws(":", F.lit(seed), *[f.cast("string") for f in facts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long") / float(1 << 32)


#: Quarters of a beat unit.
UNIT_QUARTERS = {"quarter": 1.0, "dotted_quarter": 1.5, "eighth": 0.5}


def beat_unit(num: Column, den: Column) -> Column:
    """(unit, beats a bar) of a time signature; eighths in threes count dotted quarters; an unknown denominator is an error."""
    compound = (den == 8) & (num >= 6) & (num % 3 == 0)
    unit = F.when(compound, "dotted_quarter").when(den.isin(8, 16), "eighth").when(den.isin(1, 2, 4), "quarter").otherwise(F.raise_error(F.lit("unsupported time signature")))
    n = F.when(compound, num / 3).when(den == 2, num * 2).when(den == 1, num * 4).when(den == 16, F.greatest(F.lit(1), F.floor((num + 1) / 2))).otherwise(num)
    return F.struct(unit.alias("unit"), n.cast("int").alias("beats"))


def unit_quarters(unit: Column) -> Column:
    return F.when(unit == "dotted_quarter", 1.5).when(unit == "eighth", 0.5).otherwise(1.0)


def ticks_of(ticks: Column, unit: Column, to: int = 48, per_quarter: int = 960) -> Column:
    """Ticks of `per_quarter` a quarter as ticks of `to` a beat."""
    return ticks / (per_quarter * unit_quarters(unit)) * to


def stable_seed(item: Column) -> Column:
    return F.crc32(item.cast("string"))


def logistic(margin: Column) -> Column:
    return 1 / (1 + F.exp(-margin))


def chroma_fold(pitch: Column) -> Column:
    """The pitch in the octave from 60 to 71."""
    return 60 + F.pmod(F.round(pitch).cast("int"), F.lit(12))


def gate_decision(delta: Column, low: Column, high: Column, least: float, subsets: Column, regression: float = 2.0) -> Column:
    """hold without an interval or with 0 in it; reject if below 0, if a subset's upper end is under -regression, or if the
    gain is under `least`; else adopt. subsets: array of upper ends."""
    clear = F.exists(subsets, lambda h: F.coalesce(h < -regression, F.lit(False)))
    return (
        F.when(delta.isNull() | low.isNull() | high.isNull(), "hold").when(high < 0, "reject").when(low <= 0, "hold").when(clear | (delta < least), "reject").otherwise("adopt")
    )


def non_inferior(low: Column, margin: float) -> Column:
    return F.coalesce(low > margin, F.lit(False))
