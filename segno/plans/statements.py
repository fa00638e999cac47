"""Queries of the SQL statements: each name is a survey id and what it does."""

from __future__ import annotations

from ..operators import cluster, statements, timeline
from ..sources import fixtures as X
from .queries import ORACLES, QUERIES, anchored

#: Query names and their statements.
NAMES = {
    "w34_tempo_octave_scores": "tempo_octave_scores",
    "w18_running_median": "running_median", "w19_tuning_offset": "tuning_offset", "w20_gap_fill_runs": "gap_fill_runs", "w40_pair_relation": "pair_relation",
    "w1_symbolic_roles": "symbolic_roles", "w2_chord_share_roles": "chord_share_roles", "w4_part_features": "part_features", 
    "w8_order_and_names": "order_parts", "w9_section_roles": "section_roles", "w10_role_view": "role_view", "w14_solo_gate": "solo_gate", "w15_spatial_split": "spatial_split",
    "w37_repeat_groups": "repeat_groups", "w38_snap_and_merge_sections": "snap_and_merge_sections", "w43_band_window_truth": "band_window_truth", "w45_exp_split_windows": "exp_split_windows",
    "g20_per_part_best": "per_part_best", "g21_downbeat_share": "downbeat_share", "g21_string_fret_agreement": "string_fret_agreement", "g21_phrase_quality": "phrase_quality",
    "g21_texture_shares": "texture_shares", "g22_evidence_per_class": "evidence_per_class", "g23_stem_bar_activity": "stem_bar_activity", "g24_estimate_presence": "estimate_presence", 
    "g27_block_der": "block_der", 
    "g32_leak_summary": "leak_summary", "g35_song_health": "song_health", "g37_bleed_bars": "bleed_bars", "g38_vocal_per_bar": "vocal_per_bar", "g43_resource_gate": "resource_gate", "g43_mixed_rungs": "mixed_rungs", "g44_cross_talk": "cross_talk",
    "g52_select_on_dev": "select_on_dev", "g53_identity_verdict": "identity_verdict", "j14_overlap_seconds": "overlap_seconds",
    "j16_levels_at_onset": "levels_at_onset", "j17_paired_runs": "paired_runs", "j20_apply_offsets": "apply_offsets", "p16_stem_view_levels": "stem_view_levels", "l15_import_predictions": "import_predictions",
    "l18_summary_card": "summary_card", "q3_manifest_status": "manifest_status", "w3_sixteen_features": "note_features", "g28_capture": "capture", "g36_merged_bursts": "burst_spans",
    "g42_level_histogram": "level_histogram", "g46_identical_bars": "identical_bars", "g39_stem_windows": "stem_windows", "j2_unmatched_by_source": "unmatched_by_source", "j18_contamination": "contamination", "l7_forced_and_blocked": "incremental_plan",
    "l11_experiment_ledger": "experiment_ledger", "l16_catalog": "catalog", "s3_review_queue_edits": "review_queue", "t3_bars_outside": "bar_tick_outside", "g10_ranked_bars": "worst_bars_ranked", "w12_section_windows": "section_windows",
    "w23_gated_spans": "gated_spans", "a10_recipe_key": "recipe_key", "l14_swaps_and_inserts": "corrupted_more",
}
#: The same tables for DuckDB.
VIEWS = {"notes": "nr", "est": "ne", "beats": "bt", "bars": "br", "sections": "sc", "spans": "wi", "placed": "nb", "windowed": "nw", "clusters": "cl", "signed": "nsg", "signed_windowed": "nsw", "documents": "documents", "labels": "labels", "orders": "orders", "customer": "customer"}
MORE = """, wi AS (SELECT song_id, "window" AS w, start_us, end_us, label FROM wn), nb AS (SELECT n.*, b.bar FROM nr n ASOF JOIN br b ON n.song_id = b.song_id AND n.onset_us >= b.start_us WHERE n.onset_us < b.end_us),
 nw AS (SELECT n.*, v.w, v.label FROM nr n ASOF JOIN wi v ON n.song_id = v.song_id AND n.onset_us >= v.start_us WHERE n.onset_us < v.end_us),
 sgn AS (SELECT note_id, CASE WHEN note_id % 9 <> 0 THEN (note_id * 37 % 41 - 20) / 2.0 END AS ild_db, note_id * 13 % 21 / 20.0 AS coh, note_id * 29 % 25 / 2.0 - 2 AS ms_db FROM nr), nsg AS (SELECT * FROM nr JOIN sgn USING (note_id)), nsw AS (SELECT * FROM nw JOIN sgn USING (note_id))"""


def placed(spark, d):
    """Notes with the bar they start in."""
    bars = X.bars(spark, d).select("song_id", "bar", "start_us", "end_us")
    out = timeline.asof_join(X.notes_ref(spark, d), bars, ["song_id"], "onset_us", "start_us")
    return out.where("onset_us < mark.end_us").select(*[c for c in out.columns if c != "mark"], "mark.bar")


def spans(spark, d):
    return X.windows(spark, d).withColumnRenamed("window", "w").select("song_id", "w", "start_us", "end_us", "label")


def windowed(spark, d):
    """Notes with the window they start in and its label."""
    out = timeline.window_of(X.notes_ref(spark, d), X.windows(spark, d))
    return out.where("window is not null").withColumnRenamed("window", "w")


TABLES = {
    "notes": X.notes_ref, "est": X.notes_est, "beats": X.beats, "bars": X.bars, "sections": X.sections, "spans": spans, "placed": placed, "windowed": windowed,
    "signed": lambda spark, d: X.notes_ref(spark, d).join(X.signatures(spark, d), "note_id"), "signed_windowed": lambda spark, d: windowed(spark, d).join(X.signatures(spark, d), "note_id"),
    "clusters": lambda spark, d: cluster.anchored_clusters(X.notes_ref(spark, d), ["song_id"], 35_000),
    **{t: (lambda spark, d, t=t: X.table(spark, d, t)) for t in ("documents", "labels", "orders", "customer")},
}


def register(name: str, statement: str) -> None:
    def run(spark, d):
        return statements.apply(statement, **{t: TABLES[t](spark, d) for t in statements.tables_of(statement)})

    run.__name__ = name
    QUERIES[name] = run
    parts, select = statements.text(statement, "duckdb")
    ctes = X.CTE + MORE + (anchored("song_id") if "clusters" in statements.tables_of(statement) else "")
    ORACLES[name] = f"{ctes}{', ' + parts if parts else ''} {select}".format(**VIEWS)


for _name, _statement in NAMES.items():
    register(_name, _statement)
