"""Every registered query of the note-event library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chords, consensus, edits, errors, evidence, folds, matching, metre, more, names, parts, pulse, readers, scores, sheets, statements, streams, surface  # noqa: F401  (they register their queries)
from .queries import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled accuracy of the estimated notes of each song."""
    return QUERIES["g1_note_prf"](spark, sf_dir)
