"""One-to-one matching of two note lists within small components, and what is scored with it."""

from __future__ import annotations

from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .cluster import anchored_clusters
from .match import near
from .timeline import asof_join, time_to_beat


def component_lists(ref: DataFrame, est: DataFrame, keys: list[str], tol_us: int, ref_facts: list[str], est_facts: list[str], t: str = "onset_us") -> DataFrame:
    """keys, part, refs, ests: sorted lists of struct(t, id, facts) of each group of notes that can only match inside itself
    (gaps over tol_us part them); groups that lack a side are left out."""
    side = lambda df, k, facts: df.select(*keys, F.col(t).alias("t"), F.lit(k).alias("side"), F.struct(F.col(t).alias("t"), F.col("note_id").alias("id"), *facts).alias("x"))
    both = side(ref, 0, ref_facts).withColumnRenamed("x", "r").unionByName(side(est, 1, est_facts).withColumnRenamed("x", "e"), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("t", "side")
    part = F.sum(F.when(F.col("t") - F.lag("t").over(w) > tol_us, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    lists = both.withColumn("part", part).groupBy(*keys, "part").agg(F.array_sort(F.collect_list("r")).alias("refs"), F.array_sort(F.collect_list("e")).alias("ests"))
    return lists.where((F.size("refs") > 0) & (F.size("ests") > 0))


def match_min_cost(ref: DataFrame, est: DataFrame, keys: list[str], tol_us: int) -> DataFrame:
    """keys, ref_id, est_id, cost_us: as many pairs within tol_us as can be, of those ways one of least total distance.

    On a line some best way does not cross, so a table over (refs, ests) of (pairs, -cost) per component finds it.
    """
    lists = component_lists(ref, est, keys, tol_us, [], [])
    none = "named_struct('n', 0, 'minus', cast(0 as bigint), 'pairs', cast(array() as array<struct<r:bigint,e:bigint,d:bigint>>))"
    table = f"""aggregate(refs, array_repeat({none}, size(ests) + 1), (row, r) -> aggregate(sequence(1, size(ests)), array(row[0]),
      (out, j) -> array_append(out, array_max(array(row[j], out[j - 1],
        CASE WHEN abs(r.t - ests[j - 1].t) <= {tol_us} THEN named_struct('n', row[j - 1].n + 1, 'minus', row[j - 1].minus - abs(r.t - ests[j - 1].t),
          'pairs', array_append(row[j - 1].pairs, named_struct('r', r.id, 'e', ests[j - 1].id, 'd', abs(r.t - ests[j - 1].t)))) END)))))"""
    best = lists.select(*keys, F.explode(F.element_at(F.expr(table), -1)["pairs"]).alias("p"))
    return best.select(*keys, F.col("p.r").alias("ref_id"), F.col("p.e").alias("est_id"), F.col("p.d").alias("cost_us"))


def match_greedy(ref: DataFrame, est: DataFrame, keys: list[str], tol_us: int) -> DataFrame:
    """keys, ref_id, est_id, cost_us: pairs by distance (then ids), each taken if neither side is taken yet; folded per component."""
    lists = component_lists(ref, est, keys, tol_us, [], [])
    pairs = "array_sort(filter(flatten(transform(refs, r -> transform(ests, e -> named_struct('d', abs(r.t - e.t), 'e', e.id, 'r', r.id)))), p -> p.d <= {}))".format(tol_us)
    fold = f"aggregate({pairs}, cast(array() as array<struct<d:bigint,e:bigint,r:bigint>>), (a, p) -> if(exists(a, x -> x.e = p.e or x.r = p.r), a, array_append(a, p)))"
    out = lists.select(*keys, F.explode(F.expr(fold)).alias("p"))
    return out.select(*keys, F.col("p.r").alias("ref_id"), F.col("p.e").alias("est_id"), F.col("p.d").alias("cost_us"))


def match_intervals(ref: DataFrame, est: DataFrame, keys: list[str], tol: str, t: str = "onset_us") -> DataFrame:
    """keys, ref_id, est_id: as many pairs as can be where each ref takes ests within its own tolerance (column `tol` of ref).

    Ests in order take, of the refs whose interval holds them and that are free, the one that ends first (ties: the lesser id), which is
    optimal for intervals. Only intervals that overlap are open together, and a place that none covers parts the notes.
    """
    kind = "struct<t:bigint,side:int,id:bigint,end:bigint>"
    side = lambda df, k, at, end: df.select(*keys, F.struct(at.alias("t"), F.lit(k).alias("side"), F.col("note_id").alias("id"), end.alias("end")).cast(kind).alias("x"))
    both = side(ref, 0, F.col(t) - F.col(tol), F.col(t) + F.col(tol)).unionByName(side(est, 1, F.col(t), F.col(t)))
    w = Window.partitionBy(*keys).orderBy("x.t", "x.side", "x.id")
    covered = F.max(F.when(F.col("x.side") == 0, F.col("x.end"))).over(w.rowsBetween(Window.unboundedPreceding, -1)) >= F.col("x.t")
    parts = both.withColumn("_new", F.when(covered, 0).otherwise(1)).withColumn("_part", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    lists = parts.groupBy(*keys, "_part").agg(F.array_sort(F.collect_list("x")).alias("xs")).where(F.exists("xs", lambda x: x["side"] == 0) & F.exists("xs", lambda x: x["side"] == 1))

    def step(a, x):
        holding = F.filter(a["open"], lambda r: r["end"] >= x["t"])
        first = F.array_min(holding)
        taken = F.struct(F.filter(holding, lambda r: r["id"] != first["id"]).alias("open"), F.array_append(a["pairs"], F.struct(first["id"].alias("ref_id"), x["id"].alias("est_id"))).alias("pairs"))
        opened = F.struct(F.array_append(holding, F.struct(x["end"].alias("end"), x["id"].alias("id"))).alias("open"), a["pairs"].alias("pairs"))
        return F.when(x["side"] == 0, opened).when(first.isNotNull(), taken).otherwise(a)

    none = F.struct(F.array().cast("array<struct<end:bigint,id:bigint>>").alias("open"), F.array().cast("array<struct<ref_id:bigint,est_id:bigint>>").alias("pairs"))
    return lists.select(*keys, F.explode(F.aggregate("xs", none, step)["pairs"]).alias("p")).select(*keys, "p.*")


#: Positions on the grid are kept in whole millionths of a tick, so that comparisons are exact.
FINE = 1_000_000


def on_grid(notes: DataFrame, beats: DataFrame, ticks: int, tol_us: int = 0) -> DataFrame:
    """notes + pos and tol (millionths of a tick; tol_us at the tempo of the beat that holds the note), bar; of notes of one pitch within a tick
    after the first only that one stays."""
    fine = lambda c: F.round(c * ticks * FINE).cast("long")
    at = time_to_beat(notes, beats, "onset_us", "_beat_us")
    at = at.select(*notes.columns, fine(F.col("beat_pos")).alias("pos"), fine(F.lit(tol_us) / F.col("_beat_us")).alias("tol"))
    starts = beats.where("beat = 1").select("song_id", F.col("bar").alias("_bar"), fine(F.col("beat_no")).alias("_pos"))
    at = asof_join(at, starts, ["song_id"], "pos", "_pos")
    at = at.select(*notes.columns, "pos", "tol", F.col("mark._bar").alias("bar"))
    first = anchored_clusters(at, ["song_id", "pitch"], FINE, "pos")
    one = F.min(F.struct("pos", "note_id", "tol", "bar")).alias("x")
    return first.groupBy("song_id", "pitch", "anchor_us").agg(one).select("song_id", "pitch", "x.*")


def match_ticks(ref: DataFrame, est: DataFrame, beats: DataFrame, tol_us: int = 50_000, ticks: int = 48) -> tuple[DataFrame, DataFrame]:
    """(refs, ests) on the grid: song_id, pitch, note_id, pos, bar and mate, the note of the other side or null.

    A ref takes ests of its pitch within tol_us at the tempo where it lies; the whole song is matched at once.
    """
    r, e = on_grid(ref, beats, ticks, tol_us), on_grid(est, beats, ticks)
    pairs = match_intervals(r, e, ["song_id", "pitch"], "tol", "pos").select("ref_id", "est_id")
    own = lambda df, a, b: df.join(pairs.select(F.col(a).alias("note_id"), F.col(b).alias("mate")), "note_id", "left").select("song_id", "pitch", "note_id", "pos", "bar", "mate")
    return own(r, "ref_id", "est_id"), own(e, "est_id", "ref_id")


def tick_counts(refs: DataFrame, ests: DataFrame, sections: DataFrame) -> DataFrame:
    """song_id, section, tp, fp, fn: a pair counts where its ref is, a miss where its ref and an extra where its est starts, so that
    sections that part a song add up to it; notes outside all sections have a null one. sections: song_id, section, start_bar, end_bar."""
    bars = sections.select("song_id", "section", F.explode(F.sequence("start_bar", F.col("end_bar") - 1)).alias("bar"))
    hit = F.col("mate").isNotNull().cast("int")
    rows = refs.select("song_id", "bar", hit.alias("tp"), F.lit(0).alias("fp"), (1 - hit).alias("fn"))
    rows = rows.unionByName(ests.where("mate is null").select("song_id", "bar", F.lit(0).alias("tp"), F.lit(1).alias("fp"), F.lit(0).alias("fn")))
    rows = rows.groupBy("song_id", "bar").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).join(bars, ["song_id", "bar"], "left")
    return rows.groupBy("song_id", "section").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def most_pairs(n: int, edges: list[list[int]]) -> list[int]:
    """For each of n right nodes its left partner or -1, by augmenting paths; edges: right nodes of each left node."""
    mate = [-1] * n

    def take(left: int, seen: set[int]) -> bool:
        for j in edges[left]:
            if j not in seen:
                seen.add(j)
                if mate[j] < 0 or take(mate[j], seen):
                    mate[j] = left
                    return True
        return False

    for i in range(len(edges)):
        take(i, set())
    return mate


def match_with_offset(ref: DataFrame, est: DataFrame, keys: list[str], tol_us: int, ratio: float = 0.2, least_us: int = 50_000) -> DataFrame:
    """keys, ref_id, est_id: as many pairs as can be with onsets within tol_us and offsets within the larger of ratio x the ref's
    length and least_us. Components of one possible partner each side are plain rows; only the others meet the path search."""
    pair = near(ref.select(*keys, "note_id", "onset_us", "offset_us"), est.select(*keys, "note_id", "onset_us", "offset_us"), keys, tol_us)
    allowed = F.greatest(F.lit(float(least_us)), ratio * (F.col("offset_us") - F.col("onset_us")))
    pair = pair.where(F.abs(F.col("offset_us") - F.col("r_offset_us")) <= allowed).select(*keys, F.col("note_id").alias("ref_id"), F.col("r_note_id").alias("est_id"), "onset_us")
    lone = (F.count("*").over(Window.partitionBy(*keys, "ref_id")) == 1) & (F.count("*").over(Window.partitionBy(*keys, "est_id")) == 1)
    pair = pair.withColumn("_lone", lone)
    w = Window.partitionBy(*keys).orderBy("onset_us", "ref_id")
    part = F.sum(F.when(F.col("onset_us") - F.lag("onset_us").over(w) > 2 * tol_us, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rest = pair.where("not _lone").withColumn("_part", part)

    def solve(key, batch):
        ids = sorted(zip(*(batch.column(c).to_pylist() for c in ("ref_id", "est_id"))))
        refs, ests = sorted({r for r, _ in ids}), sorted({e for _, e in ids})
        place, edges = {e: j for j, e in enumerate(ests)}, {r: [] for r in refs}
        for r, e in ids:
            edges[r].append(place[e])
        got = [(refs[m], e) for e, m in zip(ests, most_pairs(len(ests), [edges[r] for r in refs])) if m >= 0]
        first = batch.slice(0, 1).select(keys).take([0] * len(got))
        return first.append_column("ref_id", pa.array([r for r, _ in got], pa.int64())).append_column("est_id", pa.array([e for _, e in got], pa.int64()))

    schema = rest.select(*keys, "ref_id", "est_id").schema
    return pair.where("_lone").select(*keys, "ref_id", "est_id").unionByName(rest.select(*keys, "_part", "ref_id", "est_id").groupBy(*keys, "_part").applyInArrow(solve, schema))


def assignment(pairs: DataFrame, by: list[str], k: int) -> DataFrame:
    """by, map, macro, weighted: the one-to-one map of guessed lines to true ones of the best macro accuracy (then weighted, then
    the first); pairs: by, line, guess in 0..k-1. Every way to permute the k lines is scored on counts, never on notes."""
    ways = F.array(*[F.array(*[F.lit(x) for x in p]) for p in permutations(range(k))])
    n = pairs.groupBy(*by, "line", "guess").agg(F.count("*").alias("n"))
    cells = n.groupBy(*by).agg(F.collect_list(F.struct("line", "guess", "n")).alias("cells"))
    total = F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + c["n"])

    def count(cells, line: int):
        return F.aggregate(F.filter(cells, lambda c: c["line"] == line), F.lit(0.0), lambda a, c: a + c["n"])

    def scored(way):
        right = F.filter("cells", lambda c: F.get(way, c["guess"]) == c["line"])
        per = F.array(*[F.try_divide(count(right, i), count(F.col("cells"), i)) for i in range(k)])
        per = F.filter(per, lambda x: x.isNotNull())
        macro = F.try_divide(F.aggregate(per, F.lit(0.0), lambda a, x: a + x), F.size(per))
        weighted = F.try_divide(F.aggregate(right, F.lit(0.0), lambda a, c: a + c["n"]), total)
        return F.struct(F.round(macro, 9).alias("macro"), F.round(weighted, 9).alias("weighted"), F.transform(way, lambda x: -x).alias("minus"))

    best = F.array_max(F.transform(ways, scored))
    return cells.select(*by, best.alias("b")).select(*by, F.array_join(F.transform("b.minus", lambda x: (-x).cast("string")), ",").alias("map"), "b.macro", "b.weighted")



def mutual_nearest(ref: DataFrame, est: DataFrame, keys: list[str], tol_us: int) -> DataFrame:
    """ref_id, est_id of notes within tol_us that are each other's nearest (ties: the lesser id)."""
    pair = near(ref.select(*keys, "note_id", "onset_us"), est.select(*keys, "note_id", "onset_us"), keys, tol_us)
    pair = pair.select(F.col("note_id").alias("ref_id"), F.col("r_note_id").alias("est_id"), F.abs(F.col("onset_us") - F.col("r_onset_us")).alias("d"))
    first = lambda own, other: F.row_number().over(Window.partitionBy(own).orderBy("d", other)) == 1
    return pair.withColumn("_r", first("ref_id", "est_id")).withColumn("_e", first("est_id", "ref_id")).where("_r and _e").select("ref_id", "est_id")
