"""Queries over names, masks, marks and the last of the measures."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import names as N
from ..functions import scalars as S
from ..operators import assign, contours, measures, metrics, timeline
from ..sources import fixtures as X
from .matching import ways
from .queries import ITEMS, items, query


def words(text: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in text.split()) + "]"


#: A stem's file name made of a part's name, brand and size.
STEM = "replace(p_name, ' ', '_') || '_' || CASE p_partkey % 12 WHEN 0 THEN 'ElecGtr2DI' WHEN 1 THEN 'BassDrum' WHEN 2 THEN 'LeadVox' WHEN 3 THEN 'Rhodes' WHEN 4 THEN 'synthLead' WHEN 5 THEN 'AcousticGuitar1' WHEN 6 THEN 'Cello' WHEN 7 THEN 'BassAmp' WHEN 8 THEN 'SampleLoop' WHEN 9 THEN 'PadSwell' WHEN 10 THEN 'mix' ELSE 'misc' END || p_size || '.wav'"
HAS = lambda w: f"len(list_intersect(t, {words(w)})) > 0"
CATEGORY = f"""CASE WHEN ({HAS(N.GUITAR_WORDS)} OR contains(j, 'guitar')) AND {HAS(N.ACOUSTIC_WORDS)} THEN 'guitar_acoustic' WHEN {HAS(N.GUITAR_WORDS)} OR contains(j, 'guitar') THEN 'guitar_electric' WHEN contains(j, 'bassdrum') OR contains(j, 'bassdrm') THEN 'drums' WHEN {HAS('bassoon')} THEN 'brass_winds'
 WHEN {HAS(N.BASS_WORDS)} OR starts_with(j, 'bass') OR contains(j, 'synthbass') OR contains(j, 'subbass') THEN 'bass' WHEN {HAS(N.SFX_WORDS)} THEN 'sfx' WHEN {HAS(N.DRUM_WORDS)} THEN 'drums' WHEN {HAS(N.VOCAL_WORDS)} THEN 'vocals' WHEN {HAS(N.STRING_WORDS)} THEN 'strings' WHEN {HAS(N.WIND_WORDS)} THEN 'brass_winds'
 WHEN {HAS(N.EPIANO_WORDS)} OR ({HAS('elec electric')} AND {HAS('piano')}) THEN 'keys_epiano' WHEN {HAS(N.ORGAN_WORDS)} THEN 'organ' WHEN {HAS(N.PIANO_WORDS)} THEN 'keys_piano' WHEN {HAS(N.PAD_WORDS)} THEN 'synth_pad' WHEN {HAS(N.LONE_LEAD_WORDS)} OR ({HAS(N.LEAD_WORDS)} AND {HAS(N.SYNTH_WORDS)}) THEN 'synth_lead' WHEN {HAS(N.SYNTH_WORDS)} THEN 'synth_other'
 WHEN {HAS(N.WEAK_DRUM_WORDS)} AND NOT {HAS(N.TONAL_WORDS)} THEN 'drums' ELSE 'other' END"""
# the pattern of DuckDB has no look-ahead: a capital that opens a word is parted from the capitals before it first
TOKENS = f"WITH s AS (SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace({STEM}, '\\.[^.]*$', ''), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '([0-9]+)', ' \\1 ', 'g') AS s FROM part), k AS (SELECT p_partkey, list_transform(regexp_extract_all(s, '[A-Z]+(?:[^a-zA-Z]|$)|[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda x: lower(regexp_replace(x, '[^A-Za-z0-9]', '', 'g'))) AS t FROM s), n AS (SELECT p_partkey, t, array_to_string(list_filter(t, lambda x: NOT regexp_matches(x, '^[0-9]+$')), '') AS j FROM k)"


def stem():
    ends = ["ElecGtr2DI", "BassDrum", "LeadVox", "Rhodes", "synthLead", "AcousticGuitar1", "Cello", "BassAmp", "SampleLoop", "PadSwell", "mix", "misc"]
    end = F.element_at(F.array(*[F.lit(e) for e in ends]), (F.col("p_partkey") % 12 + 1).cast("int"))
    return F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), end, F.col("p_size").cast("string"), F.lit(".wav"))


@query(TOKENS + f", c AS (SELECT p_partkey, t, {CATEGORY} AS category FROM n) SELECT p_partkey, category, {HAS(N.EXCLUDED_WORDS)} AS excluded, NOT {HAS(N.EXCLUDED_WORDS)} AND category = 'other' AND NOT {HAS(N.TONAL_WORDS)} AS unknown FROM c", cte=False)
def p6_sound_categories(spark, d):
    rows = X.table(spark, d, "part").select("p_partkey", stem().alias("s"))
    return rows.select("p_partkey", N.categorize(F.col("s")).alias("category"), N.excluded(F.col("s")).alias("excluded"), N.unknown(F.col("s")).alias("unknown"))


@query(TOKENS + f""", c AS (SELECT p_partkey, t, {CATEGORY} AS c FROM n), f AS (SELECT *, CASE WHEN starts_with(c, 'guitar') THEN 'guitar' WHEN starts_with(c, 'keys') OR c = 'organ' THEN 'keys' WHEN starts_with(c, 'synth') THEN 'synth' ELSE c END AS family, list_contains(t, 'di') AS di FROM c)
 SELECT p_partkey, CASE WHEN di AND family IN ('guitar', 'bass') THEN 'di' WHEN family IN ('guitar', 'bass', 'vocals', 'drums', 'keys') THEN family WHEN list_contains(t, 'mix') AND family = 'other' THEN 'mix' ELSE 'other' END AS kind, family, di, family IN ('guitar', 'bass') AND {HAS(N.MIC_WORDS)} AS mic,
  CASE WHEN family = 'guitar' THEN TRY_CAST(list_filter(list_transform(t, lambda x, i: CASE WHEN list_contains({words(N.GUITAR_WORDS)}, x) THEN t[i + 1] END), lambda x: regexp_matches(x, '^[0-9]+$'))[1] AS INTEGER) END AS number FROM f""", cte=False)
def p7_guess_part(spark, d):
    rows = X.table(spark, d, "part").select("p_partkey", N.guess_part(stem()).alias("g"))
    return rows.select("p_partkey", "g.*")


@query("SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'other' WHEN contains(lower(p_type), 'bass') THEN 'bass' WHEN regexp_matches(lower(p_type), 'guitar|gtr') THEN 'guitar' WHEN g BETWEEN 24 AND 31 THEN 'guitar' WHEN g BETWEEN 32 AND 39 THEN 'bass' WHEN n IN (4, 5) AND low < 40 THEN 'bass' WHEN n >= 6 AND g IS NULL THEN 'guitar' ELSE 'other' END AS kind, "
       "CASE WHEN g BETWEEN 24 AND 31 THEN 'guitar' WHEN g BETWEEN 32 AND 39 THEN 'bass' WHEN g BETWEEN 0 AND 23 THEN 'keys' WHEN g BETWEEN 40 AND 55 THEN 'strings' WHEN g BETWEEN 56 AND 63 THEN 'brass' WHEN g BETWEEN 64 AND 79 THEN 'winds' WHEN g BETWEEN 80 AND 103 THEN 'synth' END AS family FROM (SELECT *, CASE WHEN p_partkey % 5 > 0 THEN p_partkey % 128 END AS g, p_size % 4 + 4 AS n, p_size AS low FROM part)", cte=False)  # fmt: skip
def p8_guess_kind(spark, d):
    k = F.col("p_partkey")
    g = F.when(k % 5 > 0, k % 128)
    return X.table(spark, d, "part").select("p_partkey", N.guess_kind(k % 9 == 0, F.col("p_type"), g, F.col("p_size") % 4 + 4, F.col("p_size")).alias("kind"), N.family_of_program(g).alias("family"))


CLASSES = [c for cs in N.FAMILIES.values() for c in cs]
CASES = " ".join(f"WHEN list_contains({words(' '.join(cs))}, c) THEN '{f}'" for f, cs in N.FAMILIES.items())


@query(f", k AS (SELECT note_id, song_id, [{', '.join(repr(c) for c in CLASSES)}][CAST(note_id % {len(CLASSES)} + 1 AS INTEGER)] AS c FROM nr) SELECT note_id, CASE {CASES} END AS family FROM k")
def p3_family_of(spark, d):
    c = F.element_at(F.array(*[F.lit(c) for c in CLASSES]), (F.col("note_id") % len(CLASSES) + 1).cast("int"))
    return X.notes_ref(spark, d).select("note_id", N.family_of(c).alias("family"))


@query(f", k AS (SELECT song_id, list(DISTINCT [{', '.join(repr(c) for c in CLASSES)}][CAST(note_id % {len(CLASSES)} + 1 AS INTEGER)]) FILTER (note_id % 3 = 0 AND pitch < 44) AS p FROM nr GROUP BY 1) SELECT song_id, array_to_string(list_filter([{', '.join(repr(c) for c in CLASSES)}], lambda c: list_contains({words(' '.join(N.FAMILIES['guitar']))}, c) OR (list_contains({words(' '.join(N.FAMILIES['keys'] + N.FAMILIES['synth']))}, c) AND list_contains(coalesce(p, []), c))), ',') AS mask FROM k")
def p3_mask_members(spark, d):
    """The guitar classes always, and the keys and synth classes that a song has."""
    c = F.element_at(F.array(*[F.lit(c) for c in CLASSES]), (F.col("note_id") % len(CLASSES) + 1).cast("int"))
    rows = X.notes_ref(spark, d).groupBy("song_id").agg(F.collect_set(F.when((F.col("note_id") % 3 == 0) & (F.col("pitch") < 44), c)).alias("present"))
    return rows.select("song_id", F.array_join(N.mask_members(F.col("present"), ["keys", "synth"]), ",").alias("mask"))


RATE = ITEMS + """, gt AS (SELECT arm, grp, sum(tp) AS s, sum(tp + fp) AS c FROM it GROUP BY ALL), pl AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY grp) - 1 AS place, count(*) OVER (PARTITION BY arm) AS n FROM gt),
 dr AS (SELECT arm, n, rep, CAST('0x' || substr(sha256('20260930:' || rep || ':' || place), 1, 8) AS BIGINT) % n AS place FROM pl, range(200) AS r(rep)), ea AS (SELECT d.arm, d.n, rep, sum(s) / sum(c) AS x FROM dr d JOIN pl p ON d.arm = p.arm AND d.place = p.place GROUP BY ALL)"""


@query(RATE + " SELECT arm, round(any_value(point), 6) AS point, round(quantile_cont(x, 0.025), 6) AS low, round(quantile_cont(x, 0.975), 6) AS high FROM ea JOIN (SELECT arm, sum(s) / sum(c) AS point FROM gt GROUP BY 1) USING (arm) GROUP BY arm", cte=False)
def g14_rate_bootstrap(spark, d):
    rows = items(spark, d).select("arm", "grp", F.col("tp").alias("total"), (F.col("tp") + F.col("fp")).alias("n"))
    return metrics.ratio_bootstrap(rows, ["arm"], "grp")


@query(RATE.replace("sum(tp) AS s, sum(tp + fp) AS c", "sum(tp - fn) AS s, count(*) AS c") + " SELECT arm, round(any_value(point), 6) AS point, round(quantile_cont(x, 0.025), 6) AS low, round(quantile_cont(x, 0.975), 6) AS high FROM ea JOIN (SELECT arm, sum(s) / sum(c) AS point FROM gt GROUP BY 1) USING (arm) GROUP BY arm", cte=False)
def g14_mean_diff_bootstrap(spark, d):
    """The mean over items of tp - fn, with an interval from draws of whole groups."""
    rows = items(spark, d).select("arm", "grp", (F.col("tp") - F.col("fn")).alias("total"), F.lit(1).alias("n"))
    return metrics.ratio_bootstrap(rows, ["arm"], "grp")


@query()
def g51_step_decisions(spark, d):
    """step, rule, delta, low, high, decision: each rule of a table compares two arms on the same drawn groups, in points of F1."""
    rules = [("first", "F", "O", "superiority"), ("second", "P", "O", "noninferiority"), ("third", "P", "F", "superiority")]
    rows, out = items(spark, d), None
    for step, cand, base, rule in rules:
        arm = lambda c, a: F.sum(F.when(F.col("arm") == a, F.col(c)).otherwise(0))
        both = rows.where(F.col("arm").isin(cand, base)).groupBy("grp").agg(*[arm(c, a).alias(f"{c}_{s}") for s, a in (("a", base), ("b", cand)) for c in ("tp", "fp", "fn")])
        ci = measures.paired_bootstrap(both.withColumn("step", F.lit(step)), ["step"], "grp").select("step", *[(100 * F.col(c)).alias(c) for c in ("delta", "low", "high")])
        decision = S.gate_decision(F.col("delta"), F.col("low"), F.col("high"), 1.0, F.array(F.lit(0.0))) if rule == "superiority" else F.when(S.non_inferior(F.col("low"), -1.0), "adopt").otherwise("reject")
        one = ci.select("step", F.lit(rule).alias("rule"), *[F.round(c, 4).alias(c) for c in ("delta", "low", "high")], decision.alias("decision"))
        out = one if out is None else out.unionByName(one)
    return out


GREEDY50 = """, pr AS (SELECT a.song_id, a.note_id AS r, b.note_id AS e, abs(a.onset_us - b.onset_us) AS dist FROM nr a JOIN ne b ON a.song_id = b.song_id AND a.pitch = b.pitch AND abs(a.onset_us - b.onset_us) <= 50000), b1 AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY dist, e) AS kr, row_number() OVER (PARTITION BY e ORDER BY dist, r) AS ke FROM pr), mp AS (SELECT r, e FROM b1 WHERE kr = 1 AND ke = 1)"""


@query(GREEDY50 + """, st AS (SELECT note_id, onset_us, song_id, ['DN', 'VI', 'SL', 'no', 'no'][CAST(note_id % 5 + 1 AS INTEGER)] AS style FROM nr), mk AS (SELECT note_id, ['DN', 'VI', 'SL', 'no', 'no', 'no'][CAST(note_id % 5 + 1 + CASE WHEN note_id % 7 = 0 THEN 1 ELSE 0 END AS INTEGER)] AS style FROM ne)
 SELECT t.style, (SELECT count(*) FROM st WHERE st.style = t.style) AS gt, (SELECT count(*) FROM mp JOIN st ON st.note_id = r AND st.style = t.style JOIN mk ON mk.note_id = e AND mk.style = t.style) AS hit, (SELECT count(*) FROM mk WHERE mk.style = t.style) AS marked FROM (SELECT unnest(['DN', 'VI', 'SL']) AS style) t""")
def g49_mark_counts(spark, d):
    """Of each technique: annotated notes, those whose matched estimate is marked with it, and all marked estimates."""
    ref, est = X.notes_ref(spark, d), X.notes_est(spark, d)
    styles = F.array(*[F.lit(s) for s in ("DN", "VI", "SL", "no", "no", "no")])
    gt = ref.select("note_id", F.element_at(styles, (F.col("note_id") % 5 + 1).cast("int")).alias("style"))
    marks = est.select(F.col("note_id").alias("est_id"), F.element_at(styles, (F.col("note_id") % 5 + 1 + F.when(F.col("note_id") % 7 == 0, 1).otherwise(0)).cast("int")).alias("mark"))
    pairs = assign.mutual_nearest(ref, est, ["song_id", "pitch"], 50_000)
    hit = pairs.join(gt, pairs["ref_id"] == gt["note_id"]).join(marks, "est_id").where("style = mark").groupBy("style").agg(F.count("*").alias("hit"))
    n = gt.where("style <> 'no'").groupBy("style").agg(F.count("*").alias("gt"))
    m = marks.where("mark <> 'no'").groupBy(F.col("mark").alias("style")).agg(F.count("*").alias("marked"))
    return n.join(hit, "style", "left").join(m, "style", "left").fillna(0, ["hit", "marked"]).select("style", "gt", "hit", "marked")


@query(""", r AS (SELECT song_id, onset_us // 2000000 AS bar, pitch, count(*) AS n FROM nr GROUP BY ALL), e AS (SELECT song_id, onset_us // 2000000 AS bar, pitch, count(*) AS n FROM ne GROUP BY ALL), u AS (SELECT coalesce(r.song_id, e.song_id) AS song_id, coalesce(r.bar, e.bar) AS bar, coalesce(r.n, 0) AS a, coalesce(e.n, 0) AS b FROM r FULL JOIN e ON r.song_id = e.song_id AND r.bar = e.bar AND r.pitch = e.pitch)
 SELECT song_id, bar // 8 AS block, sum(a)::BIGINT AS tab_notes, round(CASE WHEN sum(b) > 0 THEN sum(least(a, b)) / sum(b) ELSE 0 END, 6) AS precision, round(CASE WHEN sum(a) > 0 THEN sum(least(a, b)) / sum(a) ELSE 0 END, 6) AS recall FROM u GROUP BY song_id, bar // 8""")
def g47_score_blocks(spark, d):
    """Precision and recall of the notes of each block of eight bars."""
    bag = lambda df, c: df.groupBy("song_id", F.expr("onset_us div 2000000").alias("bar"), "pitch").agg(F.count("*").alias(c))
    both = bag(X.notes_ref(spark, d), "a").join(bag(X.notes_est(spark, d), "b"), ["song_id", "bar", "pitch"], "full").fillna(0, ["a", "b"])
    hit, a, b = F.sum(F.least("a", "b")), F.sum("a"), F.sum("b")
    share = lambda x: F.round(F.when(x > 0, hit / x).otherwise(0.0), 6)
    return both.groupBy("song_id", F.expr("bar div 8").alias("block")).agg(a.alias("tab_notes"), share(b).alias("precision"), share(a).alias("recall"))


@query(""", f AS (SELECT song_id, onset_us // 100000 AS frame, avg(pitch) AS m FROM ne GROUP BY ALL), v AS (SELECT n.note_id, n.pitch, f.m, f.frame * 100000 < n.onset_us AS pre FROM (SELECT *, unnest(generate_series(onset_us // 100000 - 2, offset_us // 100000)) AS frame FROM nr) n JOIN f USING (song_id, frame))
 SELECT note_id, avg(CASE WHEN pre THEN NULL WHEN abs(m - pitch) <= 1 THEN 1.0 ELSE 0.0 END) >= 0.5 AND NOT coalesce(bool_or(pre AND abs(m - pitch) <= 1), FALSE) AS vocal, pitch < 45 AND avg(CASE WHEN CAST(round(m) AS INTEGER) % 12 = pitch % 12 THEN 1.0 ELSE 0.0 END) >= 0.6 AS bass FROM v GROUP BY note_id, pitch HAVING count(CASE WHEN NOT pre THEN 1 END) > 0""")
def w24_bleed_flags(spark, d):
    """A note that another contour arrives at and stays on (vocal), or a low one on its pitch class (bass)."""
    frames = X.notes_est(spark, d).groupBy("song_id", F.expr("onset_us div 100000").alias("frame")).agg(F.avg("pitch").alias("m"))
    a, z = F.expr("onset_us div 100000") - 2, F.expr("offset_us div 100000")
    rows = X.notes_ref(spark, d).withColumn("frame", F.explode(F.sequence(a, z))).join(frames, ["song_id", "frame"])
    pre, on = F.col("frame") * 100_000 < F.col("onset_us"), F.abs(F.col("m") - F.col("pitch")) <= 1
    rows = rows.select("note_id", "pitch", pre.alias("pre"), on.alias("on"), (F.round("m").cast("int") % 12 == F.col("pitch") % 12).alias("same"))
    held = F.avg(F.when(~F.col("pre"), F.col("on").cast("double")))
    g = rows.groupBy("note_id", "pitch").agg(held.alias("held"), F.coalesce(F.bool_or(F.col("pre") & F.col("on")), F.lit(False)).alias("early"), F.avg(F.col("same").cast("double")).alias("cls"), F.count_if(~F.col("pre")).alias("n"))
    return g.where("n > 0").select("note_id", ((F.col("held") >= 0.5) & ~F.col("early")).alias("vocal"), ((F.col("pitch") < 45) & (F.col("cls") >= 0.6)).alias("bass"))


@query(ways(200_000, "abs(rr.z - ee.z) <= greatest(50000, 0.2 * (rr.z - rr.t))") + " SELECT song_id, sum(CAST(ceil(v / 1000000000000.0) AS BIGINT))::BIGINT AS pairs FROM bw GROUP BY 1")
def u4_component_assignment(spark, d):
    """song_id, pairs: the shared matcher of components by augmenting paths, at a wide tolerance."""
    pairs = assign.match_with_offset(X.notes_ref(spark, d), X.notes_est(spark, d), ["song_id", "pitch"], 200_000)
    return pairs.groupBy("song_id").agg(F.count("*").alias("pairs"))


@query()
def w22_glide_metrics(spark, d):
    """Glides between the notes of a line."""
    out = contours.glides(X.notes_ref(spark, d), X.contour(spark, d))
    return out.withColumn("largest_step", F.round("largest_step", 6))


@query()
def w22_plateaus(spark, d):
    """Whether each note holds its pitch somewhere."""
    return contours.plateaus(X.notes_ref(spark, d), X.contour(spark, d))


@query()
def w22_bends(spark, d):
    """Notes that are bent, how far and whether they come back."""
    out = contours.bends(X.notes_ref(spark, d), X.contour(spark, d))
    return out.select("song_id", "note_id", *[F.round(c, 4).alias(c) for c in ("rise_cents", "start_pitch", "top_pitch")], "bend", "release", "top_us")
