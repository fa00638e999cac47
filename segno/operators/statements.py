"""Operators as SQL statements over named tables, run by Spark on the DataFrames that take those names.

A statement is (named parts, final select). Tables, all keyed by song_id: notes and est (note_id, onset_us, offset_us,
pitch, instrument, line), placed (notes + bar), windowed (notes + w, label), signed and signed_windowed (the same with ild_db, coh, ms_db of each note), beats, bars, sections, spans (windows:
w, start_us, end_us, label), clusters (notes + anchor_us). PCT(x, p) is an interpolated percentile, SHA(x) a sha256 in hex, and SEQ(a, b) gives a row
for each whole number from a to b; `text` writes both for an engine.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

#: Frames of a second with the mean pitch of the notes that start in them; some are unvoiced.
FRAMES = "fr AS (SELECT song_id, CAST(floor(onset_us / 1000000) AS BIGINT) AS frame, avg(pitch) AS v, count(*) AS n FROM {notes} GROUP BY song_id, CAST(floor(onset_us / 1000000) AS BIGINT)), fv AS (SELECT song_id, frame, n, CASE WHEN frame % 7 <> 3 THEN v END AS x FROM fr)"
#: Chord, peel and size of each note's strum (see symbolic_roles).
STRUMS = """st AS (SELECT *, count(*) OVER (PARTITION BY song_id, anchor_us) AS size, row_number() OVER (PARTITION BY song_id, anchor_us ORDER BY pitch DESC, note_id DESC) AS k, lead(pitch) OVER (PARTITION BY song_id, anchor_us ORDER BY pitch DESC, note_id DESC) AS below FROM {clusters}),
 pe AS (SELECT *, k = 1 AND coalesce(pitch - below >= 10, FALSE) AS peel FROM st), pk AS (SELECT *, max(CASE WHEN peel THEN 1 ELSE 0 END) OVER (PARTITION BY song_id, anchor_us) AS peeled FROM pe),
 bo AS (SELECT song_id, anchor_us, count(*) AS nb, max(pitch) - min(pitch) AS gap, min(onset_us) AS on_us, max(offset_us) AS off_us, max(pitch) AS top FROM pk WHERE NOT peel GROUP BY song_id, anchor_us),
 ch AS (SELECT * FROM bo WHERE nb >= 3 OR (nb = 2 AND gap IN (5, 7))),
 fe AS (SELECT pk.song_id, pk.note_id, pk.anchor_us, pk.onset_us, pk.offset_us, pk.pitch, pk.instrument, pk.line, pk.size, pk.peel, ch.anchor_us IS NOT NULL AND NOT pk.peel AS chord FROM pk LEFT JOIN ch ON pk.song_id = ch.song_id AND pk.anchor_us = ch.anchor_us),
 cell AS (SELECT ch.*, SEQ(CAST(floor(on_us / 8000000) AS BIGINT), CAST(floor(on_us / 8000000) AS BIGINT) + 1) AS c8 FROM ch),
 lo AS (SELECT DISTINCT fe.note_id FROM fe JOIN cell ON fe.song_id = cell.song_id AND CAST(floor(fe.onset_us / 8000000) AS BIGINT) = cell.c8 AND cell.on_us <= fe.onset_us - 80000 AND cell.on_us >= fe.onset_us - 8000000 AND cell.off_us > fe.onset_us AND fe.pitch > cell.top WHERE NOT fe.chord AND NOT fe.peel),
 ro AS (SELECT fe.*, NOT fe.chord AND (fe.peel OR lo.note_id IS NOT NULL) AS lead FROM fe LEFT JOIN lo ON fe.note_id = lo.note_id)"""

STATEMENTS: dict[str, tuple[str, str]] = {
    # beats
    "tempo_octave_scores": (
        """cd AS (SELECT song_id, 'keep' AS level, t_us FROM {beats} UNION ALL SELECT song_id, 'half', t_us FROM {beats} WHERE beat_no % 2 = 0 UNION ALL SELECT song_id, 'double', t_us FROM {beats} UNION ALL SELECT song_id, 'double', t_us + 250000 FROM {beats}),
 ce AS (SELECT cd.*, SEQ(CAST(floor(t_us / 140000) AS BIGINT) - 1, CAST(floor(t_us / 140000) AS BIGINT) + 1) AS cell FROM cd),
 hn AS (SELECT DISTINCT ce.level, o.note_id FROM {notes} o JOIN ce ON o.song_id = ce.song_id AND CAST(floor(o.onset_us / 140000) AS BIGINT) = ce.cell AND abs(o.onset_us - ce.t_us) <= 70000),
 hb AS (SELECT DISTINCT ce.song_id, ce.level, ce.t_us FROM {notes} o JOIN ce ON o.song_id = ce.song_id AND CAST(floor(o.onset_us / 140000) AS BIGINT) = ce.cell AND abs(o.onset_us - ce.t_us) <= 70000),
 bm AS (SELECT song_id, level, count(*) AS beats, 60000000.0 * (count(*) - 1) / (max(t_us) - min(t_us)) AS bpm FROM cd GROUP BY song_id, level),
 wn0 AS (SELECT n.song_id, h.level, sum(n.offset_us - n.onset_us) AS hit FROM {notes} n JOIN hn h ON n.note_id = h.note_id GROUP BY n.song_id, h.level), tw AS (SELECT song_id, sum(offset_us - onset_us) AS total FROM {notes} GROUP BY song_id), nh AS (SELECT song_id, level, count(*) AS hits FROM hb GROUP BY song_id, level),
 sr AS (SELECT bm.song_id, bm.level, bpm, coalesce(hit, 0) / total AS recall, coalesce(hits, 0) / beats AS prec FROM bm JOIN tw ON bm.song_id = tw.song_id LEFT JOIN wn0 ON bm.song_id = wn0.song_id AND bm.level = wn0.level LEFT JOIN nh ON bm.song_id = nh.song_id AND bm.level = nh.level)""",
        "SELECT song_id, level, round(bpm, 4) AS bpm, round(recall, 6) AS recall, round(prec, 6) AS prec, round(CASE WHEN recall + prec > 0 THEN 2 * recall * prec / (recall + prec) ELSE 0 END * exp(-0.5 * power(log2(bpm / 120) / 0.5, 2)), 6) AS score FROM sr",
    ),
    # pitch trackers
    "running_median": (FRAMES, "SELECT song_id, frame, CASE WHEN cnt >= 3 THEN round(med, 6) END AS value FROM (SELECT song_id, frame, PCT(x, 0.5) OVER (PARTITION BY song_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS med, count(x) OVER (PARTITION BY song_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS cnt FROM fv)"),
    "tuning_offset": (
        FRAMES + ", sd AS (SELECT song_id, x - round(x) AS dev, abs(lead(x, 2) OVER (PARTITION BY song_id ORDER BY frame) - lag(x, 2) OVER (PARTITION BY song_id ORDER BY frame)) <= 3 AS steady FROM fv)",
        "SELECT song_id, CASE WHEN count(*) >= 20 THEN round(PCT(dev, 0.5), 6) ELSE 0 END AS offset_st, count(*) AS frames FROM sd WHERE steady AND abs(dev) <= 0.5 GROUP BY song_id",
    ),
    "gap_fill_runs": (
        FRAMES + ", g AS (SELECT song_id, frame, x, frame - row_number() OVER (PARTITION BY song_id ORDER BY frame) AS run FROM fv WHERE n = 1 AND x IS NOT NULL), r AS (SELECT song_id, run, min(frame) AS first, max(frame) AS last, count(*) AS n, PCT(x, 0.5) AS med FROM g GROUP BY song_id, run), q AS (SELECT r.song_id, r.run, r.first, r.last, r.n, r.med, avg(CASE WHEN abs(x - med) <= 6 THEN 1.0 ELSE 0.0 END) AS near FROM r JOIN g ON r.song_id = g.song_id AND r.run = g.run GROUP BY r.song_id, r.run, r.first, r.last, r.n, r.med)",
        "SELECT song_id, first, last, n, CAST(round(med) AS INT) AS pitch FROM q WHERE n >= 2 AND near >= 0.9",
    ),
    "pair_relation": (
        """f AS (SELECT song_id, line, CAST(floor(onset_us / 2000000) AS BIGINT) AS frame, CAST(count(*) AS DOUBLE) AS x FROM {notes} GROUP BY song_id, line, CAST(floor(onset_us / 2000000) AS BIGINT)), c AS (SELECT song_id, line, pitch % 12 AS pc, CAST(count(*) AS DOUBLE) AS x FROM {notes} GROUP BY song_id, line, pitch % 12),
 j AS (SELECT a.song_id, a.line AS a, b.line AS b, count(*) AS joint, sum(a.x * b.x) AS dot FROM f a JOIN f b ON a.song_id = b.song_id AND a.frame = b.frame AND a.line < b.line GROUP BY a.song_id, a.line, b.line), n AS (SELECT song_id, line, count(*) AS n, sqrt(sum(x * x)) AS e FROM f GROUP BY song_id, line),
 h AS (SELECT a.song_id, a.line AS a, b.line AS b, sum(a.x * b.x) AS dot FROM c a JOIN c b ON a.song_id = b.song_id AND a.pc = b.pc AND a.line < b.line GROUP BY a.song_id, a.line, b.line), m AS (SELECT song_id, line, sqrt(sum(x * x)) AS e FROM c GROUP BY song_id, line),
 r AS (SELECT j.song_id, j.a, j.b, joint / least(na.n, nb.n) AS joint, j.dot / (na.e * nb.e) AS corr, coalesce(h.dot, 0) / (ma.e * mb.e) AS chroma FROM j JOIN n na ON j.song_id = na.song_id AND j.a = na.line JOIN n nb ON j.song_id = nb.song_id AND j.b = nb.line LEFT JOIN h ON j.song_id = h.song_id AND j.a = h.a AND j.b = h.b JOIN m ma ON j.song_id = ma.song_id AND j.a = ma.line JOIN m mb ON j.song_id = mb.song_id AND j.b = mb.line)""",
        "SELECT song_id, a, b, round(joint, 6) AS joint, round(corr, 6) AS corr, round(chroma, 6) AS chroma, CASE WHEN joint < 0.2 THEN 'none' WHEN corr >= 0.8 AND chroma >= 0.9 THEN 'same' WHEN chroma >= 0.9 THEN 'double' ELSE 'different' END AS relation FROM r",
    ),
    # parts
    "symbolic_roles": (STRUMS, "SELECT song_id, note_id, size, chord, peel, lead, CASE WHEN chord THEN -1 WHEN lead THEN 1 ELSE 0 END AS role FROM ro"),
    "chord_share_roles": (
        STRUMS + ", sh AS (SELECT *, sum(CASE WHEN chord THEN 2.0 ELSE 0.0 END) OVER (PARTITION BY song_id, CAST(floor(onset_us / 1000000) AS BIGINT)) AS c, sum(CASE WHEN chord THEN 0.0 ELSE 1.0 END) OVER (PARTITION BY song_id, CAST(floor(onset_us / 1000000) AS BIGINT)) AS o FROM ro)",
        "SELECT song_id, note_id, CASE WHEN chord THEN 'rhythm' WHEN peel THEN 'lead' WHEN c / (c + o) >= 0.6 THEN 'rhythm' ELSE 'lead' END AS role FROM sh",
    ),
    "part_features": (
        "a AS (SELECT *, coalesce(ild_db, 0) AS ild FROM {signed}), s AS (SELECT song_id, line, avg(ild) AS m, stddev_pop(ild) AS sd, avg(pitch) AS mp FROM a GROUP BY song_id, line)",
        "SELECT a.note_id, round(CASE WHEN sd > 0 THEN (ild - m) / sd ELSE 0 END, 6) AS ild_z, CASE WHEN ild * m > 0 THEN 1 ELSE 0 END AS same_side, round(pitch - mp, 6) AS rel_pitch, CASE WHEN instrument = 'click' THEN 1 ELSE 0 END AS is_click, CASE WHEN instrument = 'view' THEN 1 ELSE 0 END AS is_view, CASE WHEN instrument = 'purchase' THEN 1 ELSE 0 END AS is_purchase, count(*) OVER (PARTITION BY a.song_id ORDER BY onset_us RANGE BETWEEN 30000 PRECEDING AND 30000 FOLLOWING) AS poly FROM a JOIN s ON a.song_id = s.song_id AND a.line = s.line",
    ),
    "order_parts": (
        STRUMS + """, rn AS (SELECT ro.*, CAST(floor(ro.onset_us / 2000000) AS BIGINT) AS bar FROM ro), ic AS (SELECT song_id, line, instrument, count(*) AS c, row_number() OVER (PARTITION BY song_id, line ORDER BY count(*) DESC, instrument) AS place FROM rn GROUP BY song_id, line, instrument),
 pt AS (SELECT song_id, line, count(*) AS notes, count(DISTINCT bar) AS bars, min(onset_us) AS first_us, avg(CASE WHEN chord THEN 1.0 ELSE 0.0 END) AS chord, avg(CASE WHEN lead THEN 1.0 ELSE 0.0 END) AS lead, avg(CASE WHEN size = 1 THEN 1.0 ELSE 0.0 END) AS single, PCT(pitch, 0.5) AS med FROM rn GROUP BY song_id, line),
 mn AS (SELECT pt.*, row_number() OVER (PARTITION BY song_id ORDER BY bars DESC, notes DESC, first_us, line) AS k FROM pt), nm AS (SELECT mn.*, row_number() OVER (PARTITION BY mn.song_id ORDER BY CASE WHEN k = 1 THEN 0 ELSE 1 END, first_us, mn.line) AS num, instrument, c FROM mn JOIN ic ON mn.song_id = ic.song_id AND mn.line = ic.line AND ic.place = 1)""",
        "SELECT song_id, line, num, concat('Gtr ', CAST(num AS VARCHAR(9)), ' - ', CASE WHEN chord >= 0.5 THEN 'Rhythm' WHEN lead >= 0.4 OR (single >= 0.5 AND med >= 64) THEN 'Lead' ELSE 'Riff' END, CASE WHEN c >= 0.7 * notes THEN concat(' (', instrument, ')') ELSE '' END) AS name FROM nm",
    ),
    "section_roles": (
        STRUMS + """, sn AS (SELECT ro.*, p.bar FROM ro JOIN {placed} p ON ro.note_id = p.note_id), ns AS (SELECT sn.*, s.section, s.start_bar, s.end_bar FROM sn JOIN {sections} s ON sn.song_id = s.song_id AND sn.bar >= s.start_bar AND sn.bar < s.end_bar),
 rg AS (SELECT *, CASE WHEN size = 1 THEN lead(onset_us) OVER (PARTITION BY song_id, line, section, size ORDER BY onset_us, note_id) END AS next_us FROM ns), al AS (SELECT DISTINCT n.song_id, n.line, s.section, s.end_bar - s.start_bar AS bars FROM (SELECT DISTINCT song_id, line FROM {notes}) n JOIN {sections} s ON n.song_id = s.song_id),
 ag AS (SELECT song_id, line, section, count(*) AS n, avg(CASE WHEN chord THEN 1.0 ELSE 0.0 END) AS chord, avg(CASE WHEN lead THEN 1.0 ELSE 0.0 END) AS lead, avg(CASE WHEN size = 1 THEN 1.0 ELSE 0.0 END) AS single, count(next_us) AS pairs, sum(CASE WHEN next_us IS NOT NULL AND offset_us > next_us + 20000 THEN 1 ELSE 0 END) AS ring, PCT(pitch, 0.5) AS med, count(DISTINCT bar) AS used FROM rg GROUP BY song_id, line, section)""",
        "SELECT al.song_id, al.line, al.section, CASE WHEN coalesce(n, 0) < 4 THEN 'Tacet' WHEN chord >= 0.5 THEN 'Rhythm' WHEN single >= 0.8 AND pairs > 0 AND ring >= 0.5 * pairs THEN 'Arpeggio' WHEN lead >= 0.4 OR (single >= 0.5 AND med >= 64) THEN CASE WHEN used >= 0.5 * bars THEN 'Lead' ELSE 'Fill' END ELSE 'Riff' END AS role, coalesce(n, 0) AS n FROM al LEFT JOIN ag ON al.song_id = ag.song_id AND al.line = ag.line AND al.section = ag.section",
    ),
    "role_view": (
        "c AS (SELECT p.song_id, s.section, p.line, count(*) AS n, avg(CASE WHEN p.pitch < 52 THEN 1.0 ELSE 0.0 END) AS low FROM {placed} p JOIN {sections} s ON p.song_id = s.song_id AND p.bar >= s.start_bar AND p.bar < s.end_bar GROUP BY p.song_id, s.section, p.line), g AS (SELECT *, CASE WHEN low >= 0.5 THEN 'Rhythm' ELSE 'Lead' END AS base FROM c), k AS (SELECT *, row_number() OVER (PARTITION BY song_id, section, base ORDER BY n DESC, line) AS place FROM g)",
        "SELECT song_id, section, line, n, CASE WHEN place = 1 THEN base ELSE concat(base, ' ', CAST(place AS VARCHAR(9))) END AS track FROM k",
    ),
    "spatial_split": (
        "a AS (SELECT *, coalesce(ild_db, 0) AS ild FROM {signed_windowed})",
        "SELECT song_id, note_id, CASE WHEN label = 'R3' AND ild >= 0 THEN 'L' WHEN label = 'R3' THEN 'R' WHEN label = 'R2' AND coh < 0.5 THEN 'L,R' WHEN label = 'R2' THEN 'centre' ELSE 'all' END AS lines FROM a",
    ),
    "solo_gate": (
        "f AS (SELECT song_id, w, min(label) AS label, avg(pitch) AS rise, count(CASE WHEN instrument = 'error' THEN 1 END) AS vocal, count(*) AS n FROM {windowed} GROUP BY song_id, w), m AS (SELECT song_id, PCT(CASE WHEN label = 'R2' THEN rise END, 0.5) AS med FROM f GROUP BY song_id)",
        "SELECT f.song_id, w, coalesce(rise >= med + 2, FALSE) AND vocal * 3 < n AS solo FROM f JOIN m ON f.song_id = m.song_id",
    ),
    "band_window_truth": (
        "e AS (SELECT song_id, w, sum(offset_us - onset_us) AS total, sum(CASE WHEN line = 0 THEN offset_us - onset_us ELSE 0 END) AS a, sum(CASE WHEN line = 1 THEN offset_us - onset_us ELSE 0 END) AS b FROM {windowed} GROUP BY song_id, w)",
        "SELECT song_id, w, CASE WHEN a >= 0.8 * total THEN 'first' WHEN b >= 0.8 * total THEN 'second' WHEN a + b >= 0.8 * total THEN 'both' ELSE 'mixed' END AS truth, round(a / total, 6) AS share FROM e",
    ),
    "exp_split_windows": ("e AS (SELECT song_id, max(offset_us) AS z FROM {notes} GROUP BY song_id), c AS (SELECT song_id, z, SEQ(0, CAST(ceil(z / 2000000) AS BIGINT) - 1) AS cell FROM e)", "SELECT song_id, cell, cell * 2000000 AS start_us, least((cell + 1) * 2000000, z) AS end_us, CAST(floor(cell * 4 / ceil(z / 2000000)) AS INT) AS zone FROM c"),
    "snap_and_merge_sections": (
        """l AS (SELECT song_id, CAST(floor(onset_us / 20000000) AS BIGINT) AS cell, line, count(*) AS n FROM {notes} GROUP BY song_id, CAST(floor(onset_us / 20000000) AS BIGINT), line), m AS (SELECT *, sum(n) OVER (PARTITION BY song_id, cell) AS total, row_number() OVER (PARTITION BY song_id, cell ORDER BY n DESC, line) AS k FROM l), t AS (SELECT song_id, cell, line, n, total FROM m WHERE k = 1),
 c AS (SELECT *, CASE WHEN line = lag(line) OVER (PARTITION BY song_id ORDER BY cell) THEN 0 ELSE 1 END AS new FROM t), r AS (SELECT *, sum(new) OVER (PARTITION BY song_id ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM c), g AS (SELECT song_id, run, line, min(cell) AS first, sum(n) / sum(total) AS purity FROM r GROUP BY song_id, run, line),
 p AS (SELECT g.*, b.bar, row_number() OVER (PARTITION BY g.song_id, g.run ORDER BY abs(b.start_us - g.first * 20000000), b.bar) AS k FROM g JOIN {bars} b ON g.song_id = b.song_id AND b.start_us BETWEEN g.first * 20000000 - 2000000 AND g.first * 20000000 + 2000000), f AS (SELECT song_id, line, min(first) AS f FROM g GROUP BY song_id, line), w AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY f) AS letter FROM f)""",
        "SELECT p.song_id, p.run, p.bar AS start_bar, w.letter, round(p.purity, 6) AS purity FROM p JOIN w ON p.song_id = w.song_id AND p.line = w.line WHERE p.k = 1",
    ),
    "repeat_groups": (
        """h AS (SELECT p.song_id, s.section, s.label, p.pitch % 12 AS pc, CAST(count(*) AS DOUBLE) AS x FROM {placed} p JOIN {sections} s ON p.song_id = s.song_id AND p.bar >= s.start_bar AND p.bar < s.end_bar GROUP BY p.song_id, s.section, s.label, p.pitch % 12), n AS (SELECT song_id, section, sqrt(sum(x * x)) AS n FROM h GROUP BY song_id, section),
 c AS (SELECT a.song_id, a.label, a.section AS a, b.section AS b, sum(a.x * b.x) AS dot FROM h a JOIN h b ON a.song_id = b.song_id AND a.label = b.label AND a.pc = b.pc AND a.section <> b.section GROUP BY a.song_id, a.label, a.section, b.section), m AS (SELECT c.song_id, c.label, c.a, avg(dot / (na.n * nb.n)) AS sim, count(*) + 1 AS members FROM c JOIN n na ON c.song_id = na.song_id AND c.a = na.section JOIN n nb ON c.song_id = nb.song_id AND c.b = nb.section GROUP BY c.song_id, c.label, c.a),
 k AS (SELECT *, row_number() OVER (PARTITION BY song_id, label ORDER BY round(sim, 9) DESC, a) AS place FROM m)""",
        "SELECT song_id, label, a AS reference, members, round(sim, 6) AS similarity FROM k WHERE place = 1",
    ),
    # evidence
    "evidence_per_class": (
        """b AS (SELECT song_id, count(*) AS bars FROM {bars} GROUP BY song_id), p AS (SELECT song_id, instrument, bar, count(*) AS n FROM {placed} GROUP BY song_id, instrument, bar), s AS (SELECT song_id, instrument, sum(n) AS notes, count(CASE WHEN n >= 2 THEN 1 END) AS active, count(DISTINCT CASE WHEN n >= 2 THEN CAST(floor((bar - 1) / 16) AS BIGINT) END) AS sections FROM p GROUP BY song_id, instrument)""",
        "SELECT s.song_id, instrument, CAST(notes AS BIGINT) AS notes, active, sections, round(active / bars, 6) AS ratio, round(CASE WHEN notes >= 10 AND sections >= 2 THEN least(1.0, active / bars / 0.1) ELSE 0.0 END, 6) AS e FROM s JOIN b ON s.song_id = b.song_id",
    ),
    "stem_bar_activity": (
        "f AS (SELECT song_id, bar, instrument AS stem, power((offset_us - onset_us) / 10000.0, 2) AS p FROM {placed}), m AS (SELECT song_id, bar, avg(p) AS mix FROM f GROUP BY song_id, bar), s AS (SELECT song_id, bar, stem, avg(p) AS stem_p FROM f GROUP BY song_id, bar, stem)",
        "SELECT s.song_id, s.bar, s.stem, 10 * log10(stem_p + 1e-20) - 10 * log10(mix + 1e-20) > -6 AS active FROM s JOIN m ON s.song_id = m.song_id AND s.bar = m.bar",
    ),
    "estimate_presence": (
        """b AS (SELECT song_id, count(*) AS bars FROM {bars} GROUP BY song_id), p AS (SELECT song_id, instrument, bar, count(*) AS n, avg(power((offset_us - onset_us) / 10000.0, 2)) AS pw FROM {placed} GROUP BY song_id, instrument, bar), x AS (SELECT song_id, bar, sum(n * pw) / sum(n) AS mix FROM p GROUP BY song_id, bar),
 e AS (SELECT p.song_id, p.instrument, least(1.0, count(CASE WHEN n >= 2 THEN 1 END) / min(bars) / 0.1) AS e_mix, least(1.0, count(CASE WHEN pw > 0.25 * mix THEN 1 END) / min(bars) / 0.3) AS e_stem FROM p JOIN x ON p.song_id = x.song_id AND p.bar = x.bar JOIN b ON p.song_id = b.song_id GROUP BY p.song_id, p.instrument)""",
        "SELECT song_id, instrument, round(1 - (1 - 0.6 * e_mix) * (1 - 0.3 * e_stem), 6) AS p, CASE WHEN 1 - (1 - 0.6 * e_mix) * (1 - 0.3 * e_stem) >= 0.5 THEN 'present' WHEN 1 - (1 - 0.6 * e_mix) * (1 - 0.3 * e_stem) >= 0.2 THEN 'unsure' ELSE 'absent' END AS state FROM e",
    ),
    "bleed_bars": (
        "f AS (SELECT song_id, bar, CASE WHEN line = 0 THEN power((offset_us - onset_us) / 10000.0, 2) END AS g, CASE WHEN line <> 0 THEN power((offset_us - onset_us) / 10000.0, 2) END AS o FROM {placed}), m AS (SELECT song_id, bar, avg(g) AS g, avg(o) AS o FROM f GROUP BY song_id, bar)",
        "SELECT song_id, bar, round(10 * log10((o + 1e-12) / (g + 1e-12)), 6) AS ratio_db, o > 2 * g AS bleed FROM m WHERE g IS NOT NULL AND o IS NOT NULL",
    ),
    "vocal_per_bar": (
        FRAMES + ", s AS (SELECT song_id, frame, PCT(n, 0.5) OVER (PARTITION BY song_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS level FROM fr), c AS (SELECT song_id, frame, level, CAST(floor((frame * 1000000 + 500000) / 2000000) AS BIGINT) AS bar FROM s)",
        "SELECT song_id, bar, count(*) AS frames, round(avg(CASE WHEN level >= 1.5 THEN 1.0 ELSE 0.0 END), 6) AS active FROM c GROUP BY song_id, bar",
    ),
    "song_health": (
        """b AS (SELECT song_id, count(*) AS n, avg(CASE WHEN line = 2 THEN 1.0 ELSE 0.0 END) AS unplaced, avg(CASE WHEN offset_us - onset_us < 60000 THEN 1.0 ELSE 0.0 END) AS tiny, max(offset_us) - min(onset_us) AS span FROM {notes} GROUP BY song_id), w AS (SELECT song_id, count(CASE WHEN n > 20 THEN 1 END) AS bursts FROM (SELECT song_id, CAST(floor(onset_us / 10000000) AS BIGINT) AS c, count(*) AS n FROM {notes} GROUP BY song_id, CAST(floor(onset_us / 10000000) AS BIGINT)) GROUP BY song_id),
 i AS (SELECT song_id, 'unplaced' AS item, CASE WHEN unplaced >= 0.35 THEN 'warn' ELSE 'info' END AS level, round(unplaced, 6) AS value FROM b UNION ALL SELECT song_id, 'tiny', CASE WHEN tiny >= 0.3 THEN 'warn' ELSE 'info' END, round(tiny, 6) FROM b UNION ALL SELECT song_id, 'burst', CASE WHEN bursts > 0 THEN 'warn' ELSE 'info' END, CAST(bursts AS DOUBLE) FROM w UNION ALL SELECT song_id, 'thin', CASE WHEN n < span / 2000000.0 THEN 'warn' ELSE 'info' END, CAST(n AS DOUBLE) FROM b)""",
        "SELECT song_id, item, level, value, row_number() OVER (PARTITION BY song_id ORDER BY CASE WHEN level = 'warn' THEN 0 ELSE 1 END, item) AS place FROM i",
    ),
    # errors and experiments
    "leak_summary": (
        "l AS (SELECT label, instrument, avg(power((offset_us - onset_us) / 10000.0, 2)) AS p FROM {windowed} GROUP BY label, instrument), b AS (SELECT label, max(p) AS top FROM l GROUP BY label)",
        "SELECT instrument, count(*) AS conditions, round(avg(10 * log10(p / top)), 6) AS leak_db, round(avg(p / top), 6) AS share FROM l JOIN b ON l.label = b.label GROUP BY instrument",
    ),
    "cross_talk": (
        "p AS (SELECT n.song_id, n.line AS truth, e.line AS guess FROM {notes} n JOIN {est} e ON n.note_id = e.note_id)",
        "SELECT song_id, truth, count(*) AS n, round(avg(CASE WHEN guess = truth THEN 1.0 ELSE 0.0 END), 6) AS macro, round(sum(CASE WHEN guess <> truth THEN 1 ELSE 0 END) / count(*), 6) AS leakage FROM p GROUP BY song_id, truth",
    ),
    "select_on_dev": (
        "s AS (SELECT SEQ(1, 6) AS setting), i AS (SELECT s.setting, n.song_id, avg(CASE WHEN n.pitch >= 40 + s.setting * 4 THEN CASE WHEN n.line = 1 THEN 1.0 ELSE 0.0 END ELSE CASE WHEN n.line = 1 THEN 0.0 ELSE 1.0 END END) AS score, avg(CASE WHEN n.pitch >= 40 + s.setting * 4 THEN 1.0 ELSE 0.0 END) AS used FROM {notes} n, s GROUP BY s.setting, n.song_id), g AS (SELECT setting, round(avg(score), 9) AS score, avg(used) AS used FROM i GROUP BY setting), k AS (SELECT *, row_number() OVER (ORDER BY score DESC, setting) AS place FROM g WHERE used >= 0.2)",
        "SELECT setting, round(score, 6) AS score, round(used, 6) AS used FROM k WHERE place = 1",
    ),
    "mixed_rungs": ("", "SELECT instrument AS arm, count(DISTINCT label) AS rungs, count(DISTINCT label) > 1 AS mixed, count(CASE WHEN offset_us - onset_us > 400000 THEN 1 END) AS violations FROM {windowed} GROUP BY instrument"),
    "resource_gate": (
        "a AS (SELECT line, avg(offset_us - onset_us) AS v FROM {notes} GROUP BY line), r AS (SELECT c.line AS candidate, (c.v - b.v) / abs(b.v) AS rel FROM a c JOIN a b ON b.line = 0 WHERE c.line <> 0)",
        "SELECT candidate, round(rel, 6) AS relative, rel <= -0.01 AS ok FROM r",
    ),
    "identity_verdict": (
        "b AS (SELECT song_id, CAST(floor(onset_us / 2000000) AS BIGINT) AS block, line, count(*) AS n, min(onset_us) AS f FROM {notes} GROUP BY song_id, CAST(floor(onset_us / 2000000) AS BIGINT), line), m AS (SELECT *, row_number() OVER (PARTITION BY song_id, block ORDER BY n DESC, f, line) AS k FROM b), s AS (SELECT song_id, line <> lag(line) OVER (PARTITION BY song_id ORDER BY block) AS sw FROM m WHERE k = 1), t AS (SELECT song_id, count(CASE WHEN sw THEN 1 END) AS switches, count(*) AS blocks FROM s GROUP BY song_id)",
        "SELECT round(PCT(switches, 0.5), 6) AS median_switches, count(*) AS songs, round(avg(switches / blocks), 6) AS rate, CASE WHEN PCT(switches, 0.5) <= 60 THEN 'adopt' ELSE 'reject' END AS verdict FROM t",
    ),
    "block_der": (
        "r AS (SELECT song_id, CAST(floor(onset_us / 2000000) AS BIGINT) AS block, line FROM {notes} GROUP BY song_id, CAST(floor(onset_us / 2000000) AS BIGINT), line), e AS (SELECT song_id, CAST(floor(onset_us / 2000000) AS BIGINT) AS block, line FROM {est} GROUP BY song_id, CAST(floor(onset_us / 2000000) AS BIGINT), line), u AS (SELECT coalesce(r.song_id, e.song_id) AS song_id, coalesce(r.block, e.block) AS block, r.line IS NOT NULL AS inr, e.line IS NOT NULL AS ine FROM r FULL JOIN e ON r.song_id = e.song_id AND r.block = e.block AND r.line = e.line), c AS (SELECT song_id, block, count(CASE WHEN inr THEN 1 END) AS nr, count(CASE WHEN ine THEN 1 END) AS ne, count(CASE WHEN inr AND ine THEN 1 END) AS hit FROM u GROUP BY song_id, block)",
        "SELECT song_id, CAST(sum(nr) AS BIGINT) AS ref, CAST(sum(greatest(nr, ne) - hit) AS BIGINT) AS errors, round(sum(greatest(nr, ne) - hit) / sum(nr), 6) AS der FROM c GROUP BY song_id",
    ),
    "levels_at_onset": (
        "f AS (SELECT song_id, CAST(floor(onset_us / 100000) AS BIGINT) AS frame, max((offset_us - onset_us) / 10000.0) AS level FROM {est} GROUP BY song_id, CAST(floor(onset_us / 100000) AS BIGINT)), n AS (SELECT song_id, note_id, SEQ(CAST(floor((onset_us - 30000) / 100000) AS BIGINT), CAST(ceil((onset_us + 120000) / 100000) AS BIGINT) - 1) AS frame FROM {notes})",
        "SELECT n.note_id, round(max(coalesce(f.level, 0)), 6) AS level FROM n LEFT JOIN f ON n.song_id = f.song_id AND n.frame = f.frame GROUP BY n.note_id",
    ),
    "stem_view_levels": (
        "s AS (SELECT song_id, instrument AS stem, 10 * log10(avg(power((offset_us - onset_us) / 10000.0, 2))) AS db FROM {notes} GROUP BY song_id, instrument), v AS (SELECT 'band' AS view, 'click' AS stem UNION ALL SELECT 'band', 'view' UNION ALL SELECT 'band', 'purchase' UNION ALL SELECT 'side', 'error' UNION ALL SELECT 'side', 'signup')",
        "SELECT s.song_id, v.view, round(10 * log10(sum(power(10, db / 10))), 6) AS db FROM s JOIN v ON s.stem = v.stem GROUP BY s.song_id, v.view",
    ),
    "overlap_seconds": (
        "p AS (SELECT n.song_id, n.note_id, b.bar, least(n.offset_us, b.end_us) - greatest(n.onset_us, b.start_us) AS ov FROM {placed} n JOIN {bars} b ON n.song_id = b.song_id AND (b.bar = n.bar OR b.bar = n.bar + 1) AND b.start_us < n.offset_us)",
        "SELECT song_id, bar, count(*) AS notes, round(sum(ov) / 1000000.0, 6) AS seconds FROM p WHERE ov > 0 GROUP BY song_id, bar",
    ),
    "paired_runs": (
        "a AS (SELECT song_id AS item, instrument AS metric, count(*) AS value, min(line) AS rung FROM {notes} GROUP BY song_id, instrument), b AS (SELECT song_id AS item, instrument AS metric, count(*) AS value, max(line) AS rung FROM {est} GROUP BY song_id, instrument)",
        "SELECT a.item, a.metric, a.value AS a, b.value AS b, b.value - a.value AS delta, a.rung <> b.rung AS rung_differs FROM a JOIN b ON a.item = b.item AND a.metric = b.metric",
    ),
    "apply_offsets": (
        """s AS (SELECT song_id, bar, pitch, beat_no FROM (SELECT p.song_id, p.bar + 2 AS bar, p.pitch, (p.bar + 1) * 4 AS beat_no FROM {placed} p)), o AS (SELECT song_id, bar, pitch, beat_no, SEQ(-4, 12) AS shift FROM s), r AS (SELECT song_id, bar, shift, pitch, beat_no - shift AS b0, count(*) AS want FROM o GROUP BY song_id, bar, shift, pitch, beat_no - shift),
 t AS (SELECT r.*, a.t_us - 60000 AS lo, z.t_us - 60000 AS hi FROM r JOIN {beats} a ON r.song_id = a.song_id AND a.beat_no = r.b0 JOIN {beats} z ON r.song_id = z.song_id AND z.beat_no = r.b0 + 4), g AS (SELECT t.song_id, t.shift, t.bar, t.pitch, min(want) AS want, count(e.note_id) AS got FROM t LEFT JOIN (SELECT song_id, pitch, note_id, onset_us, SEQ(bar - 1, bar + 1) AS near FROM {placed}) e ON t.song_id = e.song_id AND t.pitch = e.pitch AND CAST(floor(t.b0 / 4) AS BIGINT) + 1 = e.near AND e.onset_us >= lo AND e.onset_us < hi GROUP BY t.song_id, t.shift, t.bar, t.pitch),
 f AS (SELECT song_id, shift, sum(least(want, got)) AS tp, sum(want) AS n FROM g GROUP BY song_id, shift), k AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY tp / n DESC, abs(shift), shift) AS place FROM f)""",
        "SELECT song_id, shift, CAST(tp AS BIGINT) AS tp, CAST(n AS BIGINT) AS n, place = 1 AS best FROM k",
    ),
    "downbeat_share": ("b AS (SELECT song_id, bar, start_us FROM {bars}), s AS (SELECT song_id, bar, (bar - 1) * 4 + CASE WHEN bar % 7 = 0 THEN 1 ELSE 0 END AS beat_no FROM b)", "SELECT s.song_id, count(*) AS sheet_bars, count(CASE WHEN t.beat = 1 THEN 1 END) AS on_line, round(count(CASE WHEN t.beat = 1 THEN 1 END) / count(*), 6) AS share FROM s JOIN {beats} t ON s.song_id = t.song_id AND s.beat_no = t.beat_no GROUP BY s.song_id"),
    "string_fret_agreement": (
        "r AS (SELECT song_id, bar, pitch, line AS string, note_id % 3 AS fret, count(*) AS n FROM {placed} GROUP BY song_id, bar, pitch, line, note_id % 3), e AS (SELECT p.song_id, p.bar, p.pitch, e.line AS string, e.note_id % 3 AS fret, count(*) AS n FROM {est} e JOIN {placed} p ON e.note_id = p.note_id GROUP BY p.song_id, p.bar, p.pitch, e.line, e.note_id % 3), k3 AS (SELECT r.song_id, sum(least(r.n, e.n)) AS v FROM r JOIN e ON r.song_id = e.song_id AND r.bar = e.bar AND r.pitch = e.pitch AND r.string = e.string AND r.fret = e.fret GROUP BY r.song_id), r2 AS (SELECT song_id, bar, pitch, string, sum(n) AS n FROM r GROUP BY song_id, bar, pitch, string), e2 AS (SELECT song_id, bar, pitch, string, sum(n) AS n FROM e GROUP BY song_id, bar, pitch, string), k2 AS (SELECT r2.song_id, sum(least(r2.n, e2.n)) AS v FROM r2 JOIN e2 ON r2.song_id = e2.song_id AND r2.bar = e2.bar AND r2.pitch = e2.pitch AND r2.string = e2.string GROUP BY r2.song_id), r1 AS (SELECT song_id, bar, pitch, sum(n) AS n FROM r GROUP BY song_id, bar, pitch), e1 AS (SELECT song_id, bar, pitch, sum(n) AS n FROM e GROUP BY song_id, bar, pitch), k1 AS (SELECT r1.song_id, sum(least(r1.n, e1.n)) AS v FROM r1 JOIN e1 ON r1.song_id = e1.song_id AND r1.bar = e1.bar AND r1.pitch = e1.pitch GROUP BY r1.song_id)",
        "SELECT k1.song_id, CAST(k1.v AS BIGINT) AS pitch, CAST(k2.v AS BIGINT) AS string, CAST(k3.v AS BIGINT) AS fret, round(k2.v / k1.v, 6) AS string_share, round(k3.v / k1.v, 6) AS fret_share FROM k1 JOIN k2 ON k1.song_id = k2.song_id JOIN k3 ON k1.song_id = k3.song_id",
    ),
    "phrase_quality": (
        "r AS (SELECT song_id, bar, pitch, count(*) AS n FROM {placed} GROUP BY song_id, bar, pitch), e AS (SELECT p.song_id, p.bar, e.pitch, count(*) AS n FROM {est} e JOIN {placed} p ON e.note_id = p.note_id GROUP BY p.song_id, p.bar, e.pitch), u AS (SELECT coalesce(r.song_id, e.song_id) AS song_id, coalesce(r.bar, e.bar) AS bar, coalesce(r.n, 0) AS a, coalesce(e.n, 0) AS b FROM r FULL JOIN e ON r.song_id = e.song_id AND r.bar = e.bar AND r.pitch = e.pitch), b AS (SELECT song_id, bar, sum(least(a, b)) AS tp, sum(a) AS want, sum(b) AS got FROM u GROUP BY song_id, bar), p AS (SELECT song_id, CAST(floor((bar - 1) / 4) AS BIGINT) AS phrase, count(CASE WHEN want > 0 THEN 1 END) AS played, 2 * sum(tp) / (sum(want) + sum(got)) AS f1, sum(want + got - 2 * tp) / count(*) AS err FROM b GROUP BY song_id, CAST(floor((bar - 1) / 4) AS BIGINT))",
        "SELECT song_id, count(*) AS phrases, count(CASE WHEN f1 >= 0.7 THEN 1 END) AS practisable, count(CASE WHEN err <= 2 AND f1 >= 0.5 THEN 1 END) AS light FROM p WHERE played >= 2 GROUP BY song_id",
    ),
    "per_part_best": (
        "c AS (SELECT n.song_id, n.line AS a, e.line AS b, count(*) AS tp FROM {notes} n JOIN {est} e ON n.note_id = e.note_id AND n.pitch = e.pitch GROUP BY n.song_id, n.line, e.line), na AS (SELECT song_id, line, count(*) AS n FROM {notes} GROUP BY song_id, line), ne0 AS (SELECT song_id, line, count(*) AS n FROM {est} GROUP BY song_id, line), f AS (SELECT c.song_id, c.a, c.b, 2 * c.tp / (na.n + ne0.n) AS f1 FROM c JOIN na ON c.song_id = na.song_id AND c.a = na.line JOIN ne0 ON c.song_id = ne0.song_id AND c.b = ne0.line), p AS (SELECT '012' AS m, 0 AS x, 1 AS y, 2 AS z UNION ALL SELECT '021', 0, 2, 1 UNION ALL SELECT '102', 1, 0, 2 UNION ALL SELECT '120', 1, 2, 0 UNION ALL SELECT '201', 2, 0, 1 UNION ALL SELECT '210', 2, 1, 0), s AS (SELECT f.song_id, p.m, sum(f1) / 3 AS mean FROM f, p WHERE (f.a = 0 AND f.b = p.x) OR (f.a = 1 AND f.b = p.y) OR (f.a = 2 AND f.b = p.z) GROUP BY f.song_id, p.m), k AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY round(mean, 9) DESC, m) AS place FROM s)",
        "SELECT song_id, m AS map, round(mean, 6) AS mean_f1 FROM k WHERE place = 1",
    ),
    "texture_shares": (
        "r AS (SELECT song_id, anchor_us, count(DISTINCT pitch) AS n, count(DISTINCT pitch % 12) AS pcs FROM {clusters} GROUP BY song_id, anchor_us)",
        "SELECT song_id, count(*) AS columns, round(avg(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END), 6) AS single, round(avg(CASE WHEN n >= 3 THEN 1.0 ELSE 0.0 END), 6) AS chord, round(avg(CASE WHEN n > 1 AND pcs = 1 THEN 1.0 ELSE 0.0 END), 6) AS octave FROM r GROUP BY song_id",
    ),
    "section_density": ("", "SELECT s.song_id, s.section, s.label, count(*) AS notes, round(count(*) / min(s.end_bar - s.start_bar), 6) AS per_bar FROM {placed} p JOIN {sections} s ON p.song_id = s.song_id AND p.bar >= s.start_bar AND p.bar < s.end_bar GROUP BY s.song_id, s.section, s.label"),
    # harmony and metre
    # edits, runs and catalogue
    "import_predictions": ("m AS (SELECT 0 AS track, 'L1' AS line UNION ALL SELECT 1, 'L2')", "SELECT e.song_id, e.note_id, coalesce(m.line, concat('T', CAST(e.line AS VARCHAR(9)))) AS line FROM {est} e LEFT JOIN m ON e.line = m.track"),
    "summary_card": (
        "n AS (SELECT song_id, count(*) AS notes, count(CASE WHEN line = 0 THEN 1 END) AS p0, count(CASE WHEN line = 1 THEN 1 END) AS p1, count(CASE WHEN line = 2 THEN 1 END) AS p2, count(CASE WHEN offset_us - onset_us < 60000 THEN 1 END) AS warnings FROM {notes} GROUP BY song_id), t AS (SELECT song_id, lead(t_us) OVER (PARTITION BY song_id ORDER BY t_us) - t_us AS iv FROM {beats}), m AS (SELECT song_id, round(60000000 / PCT(iv, 0.5), 4) AS bpm FROM t GROUP BY song_id), s AS (SELECT song_id, label, sum(end_bar - start_bar) AS bars, row_number() OVER (PARTITION BY song_id ORDER BY sum(end_bar - start_bar) DESC, label) AS k FROM {sections} GROUP BY song_id, label)",
        "SELECT n.song_id, notes, p0, p1, p2, warnings, bpm, s.label AS longest FROM n JOIN m ON n.song_id = m.song_id JOIN s ON n.song_id = s.song_id AND s.k = 1",
    ),
    # whole forms of rules that other queries give in part
    "manifest_status": (
        "r AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 1 WHEN doc_id % 5 = 0 THEN -1 ELSE 0 END AS off FROM {labels}), h AS (SELECT doc_id, coalesce(length(text), 0) AS n FROM {documents} WHERE doc_id % 9 <> 4)",
        "SELECT coalesce(r.doc_id, h.doc_id) AS doc_id, CASE WHEN r.doc_id IS NULL THEN 'extra' WHEN h.doc_id IS NULL THEN 'absent' WHEN r.doc_id % 11 = 0 THEN 'manual' WHEN off > 0 THEN 'partial' WHEN off < 0 THEN 'mismatch' ELSE 'verified' END AS status FROM r FULL JOIN h ON r.doc_id = h.doc_id",
    ),
    "note_features": (
        """w AS (SELECT *, count(*) OVER (PARTITION BY song_id ORDER BY onset_us RANGE BETWEEN 30000 PRECEDING AND 30000 FOLLOWING) AS poly, count(*) OVER (PARTITION BY song_id ORDER BY onset_us RANGE BETWEEN 1000000 PRECEDING AND 1000000 FOLLOWING) AS density, count(*) OVER (PARTITION BY song_id, pitch % 12 ORDER BY onset_us RANGE BETWEEN 30000 PRECEDING AND 30000 FOLLOWING) - count(*) OVER (PARTITION BY song_id, pitch ORDER BY onset_us RANGE BETWEEN 30000 PRECEDING AND 30000 FOLLOWING) AS octaves,
  PCT(pitch, 0.5) OVER (PARTITION BY song_id) AS med, onset_us - lag(onset_us) OVER (PARTITION BY song_id, line ORDER BY onset_us, note_id) AS prev_gap, lead(onset_us) OVER (PARTITION BY song_id, line ORDER BY onset_us, note_id) - onset_us AS next_gap FROM {notes})""",
        "SELECT w.note_id, round(ln((w.offset_us - w.onset_us) / 1000000.0), 6) AS log_dur, poly, density, round(w.pitch - med, 6) AS rel_pitch, octaves > 0 AS octave_partner, coalesce(e.pitch = w.pitch, FALSE) AS second_same, coalesce(abs(e.pitch - w.pitch) = 12, FALSE) AS second_octave, e.note_id IS NOT NULL AS second_any, abs((w.onset_us + 62500) % 125000 - 62500) AS residual_us, prev_gap, next_gap, w.offset_us - w.onset_us < 60000 AS short, w.pitch < 45 AS low, w.pitch > 58 AS high, w.instrument = 'click' AS is_click, coalesce(next_gap < w.offset_us - w.onset_us, FALSE) AS overlaps FROM w LEFT JOIN {est} e ON w.note_id = e.note_id",
    ),
    "capture": (
        "r AS (SELECT song_id, (note_id * 37) % 100 AS p, note_id, CASE WHEN line <> (pitch + note_id) % 3 THEN 1 ELSE 0 END AS wrong FROM {notes}), k AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY p, note_id) AS place, count(*) OVER (PARTITION BY song_id) AS n FROM r)",
        "SELECT song_id, count(*) AS n, round(sum(CASE WHEN place <= greatest(1, round(0.2 * n)) THEN wrong ELSE 0 END) / sum(wrong), 6) AS capture FROM k GROUP BY song_id",
    ),
    "burst_spans": (
        "b AS (SELECT song_id, CAST(floor(onset_us / 10000000) AS BIGINT) AS c, count(*) AS n, count(CASE WHEN offset_us - onset_us < 200000 THEN 1 END) AS tiny FROM {notes} GROUP BY song_id, CAST(floor(onset_us / 10000000) AS BIGINT)), f AS (SELECT song_id, c, n FROM b WHERE n >= 10 AND tiny * 2 >= n), g AS (SELECT *, c - row_number() OVER (PARTITION BY song_id ORDER BY c) AS run FROM f)",
        "SELECT song_id, min(c) * 10000000 AS start_us, (max(c) + 1) * 10000000 AS end_us, CAST(sum(n) AS BIGINT) AS notes FROM g GROUP BY song_id, run",
    ),
    "level_histogram": (
        "g AS (SELECT song_id, CAST(round(onset_us % 500000 / 62500.0) AS INT) % 8 AS k, abs((onset_us + 31250) % 62500 - 31250) AS r FROM {notes}), l AS (SELECT song_id, CASE WHEN k = 0 THEN 1 WHEN k = 4 THEN 2 WHEN k % 2 = 0 THEN 4 ELSE 8 END AS level, r FROM g)",
        "SELECT song_id, level, count(*) AS n, round(avg(r), 6) AS mean_us, round(PCT(r, 0.9), 6) AS p90_us FROM l GROUP BY song_id, level",
    ),
    "identical_bars": (
        "a AS (SELECT song_id, CAST(floor(onset_us / 2000000) AS BIGINT) AS bar, pitch, count(*) AS n FROM {notes} GROUP BY song_id, CAST(floor(onset_us / 2000000) AS BIGINT), pitch), b AS (SELECT song_id, CAST(floor(onset_us / 2000000) AS BIGINT) AS bar, pitch, count(*) AS n FROM {est} GROUP BY song_id, CAST(floor(onset_us / 2000000) AS BIGINT), pitch), u AS (SELECT coalesce(a.song_id, b.song_id) AS song_id, coalesce(a.bar, b.bar) AS bar, CASE WHEN coalesce(a.n, 0) = coalesce(b.n, 0) THEN 0 ELSE 1 END AS differs FROM a FULL JOIN b ON a.song_id = b.song_id AND a.bar = b.bar AND a.pitch = b.pitch), g AS (SELECT song_id, bar, max(differs) AS differs FROM u GROUP BY song_id, bar)",
        "SELECT song_id, count(*) AS bars, round(avg(1.0 - differs), 6) AS identical FROM g GROUP BY song_id",
    ),
    "stem_windows": (
        "f AS (SELECT song_id, instrument AS stem, CAST(floor(onset_us / 10000000) AS BIGINT) AS c, avg(power((offset_us - onset_us) / 10000.0, 2)) AS p FROM {notes} GROUP BY song_id, instrument, CAST(floor(onset_us / 10000000) AS BIGINT)), m AS (SELECT song_id, c, sum(p) AS mix FROM f GROUP BY song_id, c), l AS (SELECT song_id, PCT(mix, 0.2) AS quiet FROM m GROUP BY song_id), r AS (SELECT f.song_id, f.c, f.p / m.mix AS share FROM f JOIN m ON f.song_id = m.song_id AND f.c = m.c JOIN l ON f.song_id = l.song_id WHERE f.stem = 'error' AND m.mix >= l.quiet), k AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY round(share, 9) DESC, c) AS place FROM r)",
        "SELECT song_id, c * 10000000 AS start_us, round(share, 6) AS share, share > 0.5 AS leftover, place FROM k WHERE place <= 5",
    ),
    "unmatched_by_source": (
        "c AS (SELECT song_id, note_id, pitch, onset_us, line AS source, CASE line WHEN 0 THEN 50000 WHEN 1 THEN 100000 ELSE 30000 END AS tol, CAST(floor(onset_us / 100000) AS BIGINT) AS cell FROM {est}), b AS (SELECT song_id, pitch, onset_us, SEQ(CAST(floor(onset_us / 100000) AS BIGINT) - 1, CAST(floor(onset_us / 100000) AS BIGINT) + 1) AS cell FROM {notes}), m AS (SELECT c.note_id, min(abs(c.onset_us - b.onset_us)) AS d FROM c JOIN b ON c.song_id = b.song_id AND c.pitch = b.pitch AND c.cell = b.cell GROUP BY c.note_id)",
        "SELECT c.song_id, c.note_id, c.source, CASE WHEN m.note_id IS NULL THEN 'no note' ELSE 'too far' END AS reason FROM c LEFT JOIN m ON c.note_id = m.note_id WHERE m.note_id IS NULL OR m.d > c.tol",
    ),
    "contamination": (
        "t AS (SELECT 'click' AS model, 'R0' AS dataset, 'in training' AS status UNION ALL SELECT 'click', 'R1', 'held out' UNION ALL SELECT 'view', 'R0', 'held out' UNION ALL SELECT 'view', 'mixed', 'in training'), p AS (SELECT DISTINCT song_id, instrument, label FROM {windowed})",
        "SELECT p.song_id, p.instrument AS model, p.label AS dataset, coalesce(t.status, 'unknown') AS status FROM p LEFT JOIN t ON p.instrument = t.model AND p.label = t.dataset",
    ),
    "incremental_plan": (
        "k AS (SELECT o_custkey AS song_id, o_orderkey % 5 AS stage, o_orderkey AS recipe, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS held, o_orderkey % 13 = 0 AS costly FROM {orders}), m AS (SELECT *, min(CASE WHEN held = 0 THEN stage END) OVER (PARTITION BY song_id) AS first FROM k)",
        "SELECT song_id, recipe, CASE WHEN held = 0 AND costly THEN 'blocked' WHEN held = 0 THEN 'missing' WHEN stage > first THEN 'forced' ELSE 'held' END AS plan FROM m",
    ),
    "experiment_ledger": (
        "e AS (SELECT o_custkey AS id, o_orderkey AS seq, o_orderstatus AS status, o_orderkey % 10 AS view, o_orderstatus = 'F' AS decided FROM {orders}), f AS (SELECT *, min(CASE WHEN decided THEN seq END) OVER (PARTITION BY id) AS closed, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS k FROM e)",
        "SELECT id, max(CASE WHEN k = 1 THEN status END) AS status, count(*) AS n, count(CASE WHEN seq > closed THEN 1 END) AS refused, count(DISTINCT view) AS views, count(DISTINCT view) > 6 AS over_budget FROM f GROUP BY id",
    ),
    "catalog": (
        "o AS (SELECT o_custkey, count(*) AS edits, round(avg(o_totalprice), 2) AS tempo FROM {orders} GROUP BY o_custkey)",
        "SELECT c_custkey, c_mktsegment AS title, coalesce(edits, 0) AS edits, tempo, CASE WHEN edits IS NULL THEN 'no result' WHEN c_custkey % 17 = 3 THEN 'guitar removed' END AS skipped FROM {customer} LEFT JOIN o ON c_custkey = o_custkey",
    ),
    "review_queue": (
        "q AS (SELECT song_id, note_id, -1 AS p, 'unapplied edit' AS kind FROM {notes} WHERE note_id % 50 = 7 UNION ALL SELECT song_id, note_id, 0, 'unassigned' FROM {notes} WHERE line = 2 AND note_id % 50 <> 7 UNION ALL SELECT song_id, note_id, note_id * 37 % 100, 'unsure' FROM {notes} WHERE line <> 2 AND note_id * 37 % 100 < 20 AND note_id % 50 <> 7)",
        "SELECT song_id, note_id, kind, row_number() OVER (PARTITION BY song_id ORDER BY p, note_id) AS place FROM q",
    ),
    "bar_tick_outside": (
        "e AS (SELECT song_id, min(bar) AS b0, min(start_us) AS t0, max(bar) AS b1, max(end_us) AS t1 FROM {bars} GROUP BY song_id), n AS (SELECT song_id, note_id, CASE WHEN note_id % 2 = 0 THEN onset_us - 40000000 ELSE onset_us + 700000000 END AS t FROM {notes}), x AS (SELECT n.song_id, n.note_id, n.t, b0, b1, CASE WHEN n.t < t0 THEN (n.t - t0) / 2000000.0 ELSE (n.t - t1) / 2000000.0 END AS d, n.t < t0 AS early FROM n JOIN e ON n.song_id = e.song_id WHERE n.t < t0 OR n.t >= t1)",
        "SELECT note_id, CAST(CASE WHEN early THEN b0 + floor(d) ELSE b1 + 1 + floor(d) END AS BIGINT) AS bar, round((d - floor(d)) * 192, 4) AS tick FROM x",
    ),
    "worst_bars_ranked": (
        "u AS (SELECT n.song_id, CAST(floor(n.onset_us / 2000000) AS BIGINT) AS bar, CASE WHEN e.note_id IS NULL THEN 1 ELSE 0 END AS missed, 0 AS extra, CASE WHEN e.line <> n.line THEN 1 ELSE 0 END AS wrong FROM {notes} n LEFT JOIN {est} e ON n.note_id = e.note_id UNION ALL SELECT e.song_id, CAST(floor(e.onset_us / 2000000) AS BIGINT), 0, 1, 0 FROM {est} e LEFT JOIN {notes} n ON n.note_id = e.note_id WHERE n.note_id IS NULL), g AS (SELECT song_id, bar, CAST(sum(missed) AS BIGINT) AS missed, CAST(sum(extra) AS BIGINT) AS extra, CAST(sum(wrong) AS BIGINT) AS wrong_line FROM u GROUP BY song_id, bar), k AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY missed + extra + wrong_line DESC, bar) AS place FROM g WHERE missed + extra + wrong_line > 0)",
        "SELECT song_id, bar, missed, extra, wrong_line, place FROM k WHERE place <= 10",
    ),
    "section_windows": (
        "b AS (SELECT b.song_id, s.section, b.bar, b.start_us, b.end_us, CAST(floor((b.bar - s.start_bar) / CASE WHEN s.section % 3 = 1 THEN 5 ELSE 4 END) AS BIGINT) AS g FROM {bars} b JOIN {sections} s ON b.song_id = s.song_id AND b.bar >= s.start_bar AND b.bar < s.end_bar), c AS (SELECT *, count(*) OVER (PARTITION BY song_id, section, g) AS n FROM b)",
        "SELECT song_id, section, CASE WHEN n = 1 AND g > 0 THEN g - 1 ELSE g END AS w, min(start_us) AS start_us, max(end_us) AS end_us, count(*) AS bars FROM c GROUP BY song_id, section, CASE WHEN n = 1 AND g > 0 THEN g - 1 ELSE g END",
    ),
    "gated_spans": (
        "l AS (SELECT song_id, note_id, onset_us, 20 * log10((offset_us - onset_us) / 10000.0) AS db FROM {notes}), q AS (SELECT song_id, PCT(db, 0.95) AS top FROM l GROUP BY song_id), d AS (SELECT l.song_id, l.onset_us, l.note_id FROM l JOIN q ON l.song_id = q.song_id WHERE db < top - 12), g AS (SELECT *, CASE WHEN onset_us - lag(onset_us) OVER (PARTITION BY song_id ORDER BY onset_us, note_id) <= 2000000 THEN 0 ELSE 1 END AS new FROM d), r AS (SELECT *, sum(new) OVER (PARTITION BY song_id ORDER BY onset_us, note_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM g)",
        "SELECT song_id, min(onset_us) AS start_us, max(onset_us) AS end_us, count(*) AS dropped FROM r GROUP BY song_id, run",
    ),
    "recipe_key": (
        """r AS (SELECT song_id, count(*) AS n, min(pitch) AS lo, max(pitch) AS hi FROM {notes} GROUP BY song_id)""",
        """SELECT song_id, SHA(concat('{{"code":"v1","inputs":["song_', CAST(song_id AS VARCHAR(20)), '"],"models":[],"params":{{"hi":', CAST(hi AS VARCHAR(20)), ',"lo":', CAST(lo AS VARCHAR(20)), ',"n":', CAST(n AS VARCHAR(20)), '}},"stage":"quant"}}')) AS recipe FROM r""",
    ),
    "corrupted_more": (
        """h AS (SELECT song_id, note_id, onset_us, pitch, line, SHA(concat('oracle:', CAST(note_id AS VARCHAR(20)))) AS s FROM {notes}), u AS (SELECT *, substr(s, 1, 1) AS a, substr(s, 2, 1) AS b, substr(s, 3, 1) AS c FROM h),
 k AS (SELECT song_id, note_id, onset_us, pitch, CASE WHEN a = '0' THEN NULL WHEN b IN ('0', '1') THEN (line + 1) % 3 ELSE line END AS line FROM u), i AS (SELECT song_id, note_id + 2000000000 AS note_id, onset_us + 250000 AS onset_us, pitch + 7 AS pitch, line FROM u WHERE c = '0')""",
        "SELECT song_id, note_id, onset_us, pitch, line FROM k UNION ALL SELECT song_id, note_id, onset_us, pitch, line FROM i",
    ),
}


#: By statement and step: the side of its join that few rows have grown to, which Spark takes for as small as those; it is merged, never broadcast.
MERGED = {"apply_offsets": {"g": "e"}, "tempo_octave_scores": {"hn": "ce", "hb": "ce"}}


def text(name: str, engine: str = "spark") -> tuple[str, str]:
    """The statement as it reads for an engine, tables still in braces."""
    percentile, series = {"spark": ("percentile", "explode(sequence"), "duckdb": ("quantile_cont", "unnest(generate_series")}[engine]
    out = []
    for part in STATEMENTS[name]:
        part = part.replace("PCT(", percentile + "(")
        part = re.sub(r"SHA\((concat\(.*?\))\) AS", r"sha2(\1, 256) AS" if engine == "spark" else r"sha256(\1) AS", part)
        if engine == "spark":  # numbers with a point are doubles
            part = re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1D", part)
        while m := re.search(r"SEQ\(", part):
            depth, at = 1, m.end()
            while depth:
                depth += {"(": 1, ")": -1}.get(part[at], 0)
                at += 1
            part = f"{part[: m.start()]}{series}({part[m.end() : at - 1]})){part[at:]}"
        for cte, side in MERGED.get(name, {}).items() if engine == "spark" else ():
            part = re.sub(rf"\b{cte} AS \(SELECT ", f"{cte} AS (SELECT /*+ MERGE({side}) */ ", part)
        out.append(part)
    return out[0], out[1]


def tables_of(name: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", " ".join(STATEMENTS[name]))))


def apply(name: str, **tables: DataFrame) -> DataFrame:
    """Run a statement on the DataFrames of its tables."""
    parts, select = text(name)
    spark = next(iter(tables.values())).sparkSession
    return spark.sql(f"WITH {parts} {select}" if parts else select, **tables)
