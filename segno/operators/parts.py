"""How many parts play at once, and which note belongs to which: streams of windows, seeded lines, posteriors, numbered parts.

`rows` are notes with what is known of them: song_id, note_id, onset_us, pitch, instrument; of their strum cluster, size, chord, peel, lead; of their sound
ild_db, coh, ms_db (each may be null); of their window w, label, section (null outside all windows).
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..sources.quality import written

#: Kinds of evidence, in the order that settles ties.
KINDS = ["spatial", "class", "symbolic", "width"]


def centred(hi_db: float = 6.0, coherent: float = 0.9, lo_db: float = 2.0) -> tuple[Column, Column]:
    """(clearly centred, clearly wide) by the ratio of middle to side and the coherence."""
    middle = (F.col("ms_db") >= hi_db) & (F.col("coh") >= coherent)
    return F.coalesce(middle, F.lit(False)), F.coalesce(~F.coalesce(middle, F.lit(False)) & (F.col("ms_db") <= lo_db), F.lit(False))


def window_streams(rows: DataFrame, least: int = 8, cell_us: int = 1_000_000, width: bool = False, least_width: int = 6) -> DataFrame:
    """song_id, w, section, notes, spatial, class, symbolic, width, c: how many streams each kind of evidence shows in a window with `least`
    notes, and the most of them. spatial: both sides of an R3 window; class: the second instrument, half of it in cells with the
    first; symbolic: chords and leads; width: centred and wide notes of an R2 window."""
    inside = rows.where("w is not null")
    mid, wide = centred()
    r3 = F.col("label") == "R3"
    n = inside.groupBy("song_id", "w").agg(
        F.first("label").alias("label"), F.first("section").alias("section"), F.count("*").alias("notes"), F.count_if(r3 & (F.col("ild_db") >= 0)).alias("left"), F.count_if(r3 & (F.col("ild_db") < 0)).alias("right"),
        F.count_if("chord").alias("chords"), F.count_if("lead").alias("leads"), F.count_if(mid).alias("mid"), F.count_if(wide).alias("wide"),
    )
    by = inside.groupBy("song_id", "w", "instrument").agg(F.count("*").alias("c"))
    by = by.withColumn("place", F.row_number().over(Window.partitionBy("song_id", "w").orderBy(F.desc("c"), "instrument"))).where("place <= 2")
    cells = inside.withColumn("cell", F.floor(F.col("onset_us") / cell_us)).join(by, ["song_id", "w", "instrument"])
    first = cells.where("place = 1").select("song_id", "w", "cell").distinct()
    second = by.where("place = 2").select("song_id", "w", F.col("c").alias("second"))
    together = cells.where("place = 2").join(first, ["song_id", "w", "cell"], "left_semi").groupBy("song_id", "w").agg(F.count("*").alias("together"))
    n = n.join(second, ["song_id", "w"], "left").join(together, ["song_id", "w"], "left")
    enough = F.col("notes") >= least
    streams = lambda applies, two: F.when(enough & applies, F.when(F.coalesce(two, F.lit(False)), 2).otherwise(1)).otherwise(0)
    n = n.select(
        "song_id", "w", "section", "notes",
        streams(r3, F.least("left", "right") >= least).alias("spatial"), streams(F.lit(True), (F.col("second") >= least) & (F.coalesce("together", F.lit(0)) >= F.col("second") / 2)).alias("class"),
        streams(F.lit(True), F.least("chords", "leads") >= least).alias("symbolic"), streams((F.col("label") == "R2") & F.lit(width), F.least("mid", "wide") >= least_width).alias("width"), enough.cast("int").alias("one"),
    )
    return n.withColumn("c", F.greatest("one", *KINDS)).drop("one")


def part_count(streams: DataFrame, least_windows: int = 3, least_sections: int = 2) -> DataFrame:
    """song_id, k, evidence, p2, two, sections: two parts where two streams hold in enough windows of enough sections; evidence is the kind
    that shows two most often (null: none). Songs without a window have no row."""
    two = F.col("c") >= 2
    support = [F.count_if(F.col(k) >= 2).alias(k) for k in KINDS]
    g = streams.groupBy("song_id").agg(F.count_if(two).alias("two"), F.count_distinct(F.when(two, F.col("section"))).alias("sections"), F.count_distinct("section").alias("_all"), *support)
    margin = F.col("two") - least_windows + 0.5
    margin = F.when(F.col("sections") < F.least(F.lit(least_sections), "_all"), F.least(margin, F.lit(-0.5))).otherwise(margin)
    best = F.array_max(F.array(*[F.struct(F.col(k).alias("n"), F.lit(-i).alias("order"), F.lit(k).alias("kind")) for i, k in enumerate(KINDS)]))
    p2 = F.when(F.col("two") > 0, 1 / (1 + F.exp(-margin))).otherwise(0.0)
    return g.select("song_id", F.when((F.col("two") > 0) & (margin > 0), 2).otherwise(1).alias("k"), F.when(best["n"] > 0, best["kind"]).alias("evidence"), p2.alias("p2"), "two", "sections")


def seed_lines(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """song_id, note_id, key, kind, place: the notes that start each of a song's lines, one to four of them. counts: song_id, k, evidence.

    The first kind that has both sides of [evidence, symbolic, class, spatial] parts the notes in two; a third line takes the lead notes, and
    four lines part both by chords and leads. Without any kind all notes are one line.
    """
    song = Window.partitionBy("song_id")
    mid, wide = centred()
    r2, r3 = F.col("label") == "R2", F.col("label") == "R3"
    by = rows.groupBy("song_id", "instrument").agg(F.count("*").alias("n"))
    ranked = by.select("song_id", "instrument", F.row_number().over(song.orderBy(F.desc("n"), "instrument")).alias("rank"))
    x = rows.join(ranked, ["song_id", "instrument"]).join(counts.select("song_id", "k", "evidence"), "song_id", "left")
    sides = {
        "spatial": F.when(r3 & (F.col("ild_db") >= 0), 0).when(r3 & (F.col("ild_db") < 0), 1), "class": F.when(F.col("rank") <= 2, F.col("rank") - 1),
        "symbolic": F.when(F.col("chord"), 0).when(F.col("lead"), 1), "width": F.when(r2 & mid, 0).when(r2 & wide, 1),
    }
    both = {k: (F.min(s).over(song) == 0) & (F.max(s).over(song) == 1) for k, s in sides.items()}
    order = [F.col("evidence"), F.lit("symbolic"), F.lit("class"), F.lit("spatial")]
    holds = lambda c: F.coalesce(F.coalesce(*[F.when(c == k, F.col(f"_{k}")) for k in KINDS]), F.lit(False))
    x = x.select("*", *[b.alias(f"_{k}") for k, b in both.items()], *[s.cast("int").alias(f"_side_{k}") for k, s in sides.items()])
    x = x.withColumn("primary", F.coalesce(*[F.when(holds(c), c) for c in order]))
    x = x.withColumn("side", F.coalesce(*[F.when(F.col("primary") == k, F.col(f"_side_{k}")) for k in KINDS]))
    names = {"spatial": ("L", "R"), "symbolic": ("rhythm", "lead"), "width": ("centre", "wide")}
    key = F.coalesce(*[F.when((F.col("primary") == k) & (F.col("side") == i), n) for k, pair in names.items() for i, n in enumerate(pair)], F.when((F.col("primary") == "class") & F.col("side").isNotNull(), F.col("instrument")))
    x = x.withColumn("two", key)
    line = Window.partitionBy("song_id", "two")
    third = F.col("lead") & (F.col("two").isNull() | (F.count_if(~F.col("lead")).over(line) > 0))
    x = x.withColumn("third", third)
    four = F.when(F.col("chord"), F.lit(0)).when(F.col("lead"), F.lit(1))
    x = x.withColumn("four", F.when(F.col("two").isNotNull(), 2 * F.col("side") + four))
    many = F.size(F.collect_set("four").over(song))
    pair_only = (F.col("k") == 2) | F.col("primary").isin("symbolic", "width")
    as_three = ~pair_only & (F.col("k") == 3)
    as_four = ~pair_only & (F.col("k") >= 4) & (many >= 2)
    alone = (F.coalesce("k", F.lit(1)) <= 1) | F.col("primary").isNull()
    suffix = F.when(F.col("four") % 2 == 0, ".rhythm").otherwise(".lead")
    out = x.select(
        "song_id", "note_id",
        F.when(alone, "all").when(as_four, F.when(F.col("four").isNotNull(), F.concat("two", suffix))).when(as_three & F.col("third"), "lead").otherwise(F.col("two")).alias("key"),
        F.when(alone, "all").when(as_four, F.concat("primary", F.lit("+symbolic"))).when(as_three & F.col("third"), "symbolic").otherwise(F.col("primary")).alias("kind"),
        F.when(alone, 0).when(as_four, F.col("four")).when(as_three & F.col("third"), 2).otherwise(F.col("side")).alias("place"),
    )
    return out.where("key is not null")


def role_score() -> Column:
    return F.when(F.col("chord"), -1.0).when(F.col("lead"), 1.0).otherwise(0.0)


def pan(scale_db: float = 1.0) -> Column:
    return F.when((F.col("label") == "R3") & F.col("ild_db").isNotNull(), F.tanh(F.col("ild_db") / scale_db)).otherwise(0.0)


def width(middle_db: float = 4.0, scale_db: float = 3.0) -> Column:
    return F.when((F.col("label") == "R2") & F.col("ms_db").isNotNull(), F.tanh((F.col("ms_db") - middle_db) / scale_db)).otherwise(0.0)


def line_profiles(rows: DataFrame, seeds: DataFrame) -> DataFrame:
    """song_id, key, kind, place, seeds, position, width, role, share, classes (map), n_classes: what the seeds of a line have in common."""
    x = seeds.join(rows, ["song_id", "note_id"])
    panned = (F.col("label") == "R3") & F.col("ild_db").isNotNull()
    wide = (F.col("kind") == "width") & (F.col("label") == "R2")
    g = x.groupBy("song_id", "key", "kind", "place").agg(
        F.count("*").alias("seeds"), F.coalesce(F.avg(F.when(panned, pan())), F.lit(0.0)).alias("position"), F.coalesce(F.avg(F.when(wide, width())), F.lit(0.0)).alias("width"), F.avg(role_score()).alias("role"),
    )
    of = x.groupBy("song_id", "key", "instrument").agg(F.count("*").alias("n")).groupBy("song_id", "key").agg(F.map_from_entries(F.collect_list(F.struct("instrument", "n"))).alias("classes"))
    total = rows.groupBy("song_id").agg(F.count_distinct("instrument").alias("n_classes"))
    share = F.col("seeds") / F.sum("seeds").over(Window.partitionBy("song_id"))
    return g.withColumn("share", share).join(of, ["song_id", "key"]).join(total, "song_id")


def note_posteriors(rows: DataFrame, profiles: DataFrame, weight_pan: float = 6.0, weight_width: float = 6.0) -> DataFrame:
    """song_id, note_id, key, place, p: how likely each line of its song is for a note. Notes of one strum and instrument add up their scores, so
    that they go together, unless they are peeled or in an R3 window."""
    x = rows.join(profiles.select("song_id", "key", "place", "seeds", "position", F.col("width").alias("_width"), "role", "share", "classes", "n_classes"), "song_id")
    chance = (F.coalesce(F.try_element_at("classes", F.col("instrument")), F.lit(0)) + 1.0) / (F.col("seeds") + F.col("n_classes"))
    score = weight_pan * pan() * F.col("position") + role_score() * F.col("role") + F.log(chance) + F.log("share") + weight_width * width() * F.col("_width")
    joined = F.coalesce(F.col("label") != "R3", F.lit(True)) & ~F.col("peel") & (F.col("size") > 1)
    strum = Window.partitionBy("song_id", "cluster", "instrument", "key")
    x = x.withColumn("_z", score).withColumn("_z", F.when(joined, F.sum(F.when(joined, F.col("_z"))).over(strum)).otherwise(F.col("_z")))
    note = Window.partitionBy("song_id", "note_id")
    x = x.withColumn("_e", F.exp(F.col("_z") - F.max("_z").over(note)))
    return x.select("song_id", "note_id", "key", "place", (F.col("_e") / F.sum("_e").over(note)).alias("p"))


def diarize(rows: DataFrame, forced: DataFrame, least: int = 8, tau: float = 0.4, amber: float = 0.6, cell_us: int = 2_000_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(notes, lines, counts). notes: song_id, note_id, number (null under tau), p, amber; lines: song_id, number, key, kind, role, notes, bars;
    counts: song_id, k (estimated), forced, evidence, chosen. `forced` (song_id, forced) replaces the estimated count.

    Lines that no note goes to are dropped and the rest numbered: the one in most bars first, the others by their first note.
    """
    found = part_count(window_streams(rows, least)).join(forced.select("song_id", "forced"), "song_id", "full")
    counts = written(found.select("song_id", "k", "forced", "evidence"), "counts")
    profiles = written(line_profiles(rows, seed_lines(rows, counts.select("song_id", F.coalesce("forced", "k").alias("k"), "evidence"))), "profiles")
    post = note_posteriors(rows, profiles)
    best = post.groupBy("song_id", "note_id").agg(F.max_by(F.struct("key", "place", "p"), F.struct(F.round("p", 9), -F.col("place"))).alias("b")).select("song_id", "note_id", "b.*")
    best = written(best, "best")
    taken = best.where(F.round("p", 9) >= tau).join(rows.select("song_id", "note_id", "onset_us", "pitch", "chord", "lead", "size"), ["song_id", "note_id"])
    rate = lambda c: F.avg(c.cast("double"))
    g = taken.groupBy("song_id", "key").agg(
        F.count("*").alias("notes"), F.count_distinct(F.floor(F.col("onset_us") / cell_us)).alias("bars"), F.min("onset_us").alias("first_us"), rate(F.col("chord")).alias("chords"), rate(F.col("lead")).alias("leads"),
        rate(F.col("size") == 1).alias("single"), F.percentile("pitch", F.lit(0.5)).alias("median"),
    )
    role = F.when(F.col("chords") >= 0.5, "Rhythm").when((F.col("leads") >= 0.4) | ((F.col("single") >= 0.5) & (F.col("median") >= 64)), "Lead").otherwise("Riff")
    g = g.join(profiles.select("song_id", "key", "kind", "place", "position"), ["song_id", "key"])
    song = Window.partitionBy("song_id")
    main = F.row_number().over(song.orderBy(F.desc("bars"), F.desc("notes"), "first_us", F.desc(F.round("position", 9)), "place")) == 1
    g = g.withColumn("main", main)
    lines = g.select("song_id", F.row_number().over(song.orderBy(F.desc("main"), "first_us", F.desc(F.round("position", 9)), "place")).alias("number"), "key", "kind", role.alias("role"), "notes", "bars")
    notes = best.join(lines.select("song_id", "key", "number"), ["song_id", "key"], "left")
    notes = notes.select("song_id", "note_id", F.when(F.round("p", 9) >= tau, F.col("number")).alias("number"), "p", (F.round("p", 9) < amber).alias("amber"))
    chosen = lines.groupBy("song_id").agg(F.count("*").alias("chosen"))
    return notes, lines, counts.join(chosen, "song_id", "left")


def layer_links(layers: DataFrame, farthest: float) -> DataFrame:
    """song_id, w, a, b, strength: the layers of a window matched one to one with those of the layered window before it, as close as can be in
    sum, pairs farther than `farthest` left out. layers: song_id, w, line (0 to 3), pitch, chord, lead, density, ild (or null), classes (map of shares).

    A fifth of register, half a flip of role or of doubled density count about 1. Every way to place up to four layers is tried on the
    distances of the two windows alone.
    """
    x = layers.groupBy("song_id", "w").agg(F.collect_list(F.struct("line", "pitch", "chord", "lead", "density", "ild", "classes")).alias("ls"))
    w = Window.partitionBy("song_id").orderBy("w")
    x = x.select("song_id", "w", F.lag("ls").over(w).alias("before"), "ls").where("before is not null")

    def distance(a: Column, b: Column) -> Column:
        d = F.abs(a["pitch"] - b["pitch"]) / 7.0 + 2.0 * F.abs(a["chord"] - b["chord"]) + 2.0 * F.abs(a["lead"] - b["lead"]) + F.abs(F.log((a["density"] + 1e-9) / (b["density"] + 1e-9)))
        d = d + F.when(a["ild"] * b["ild"] < 0, F.least(F.lit(2.0), F.abs(a["ild"] - b["ild"]) / 3.0)).otherwise(0.0)
        keys = F.array_union(F.map_keys(a["classes"]), F.map_keys(b["classes"]))
        part = lambda m, k: F.coalesce(F.try_element_at(m, k), F.lit(0.0))
        return d + 0.5 * F.aggregate(keys, F.lit(0.0), lambda s, k: s + F.abs(part(a["classes"], k) - part(b["classes"], k)))

    pairs = x.select("song_id", "w", F.explode("before").alias("one"), "ls").select("song_id", "w", "one", F.explode("ls").alias("other"))
    cost = pairs.select("song_id", "w", F.col("one.line").alias("a"), F.col("other.line").alias("b"), F.round(distance(F.col("one"), F.col("other")), 9).alias("d"))
    cells = cost.groupBy("song_id", "w").agg(F.collect_list(F.struct("a", "b", "d")).alias("cells"), F.array_sort(F.collect_set("a")).alias("as"), F.array_sort(F.collect_set("b")).alias("bs"))
    ways = F.from_json(F.lit("[" + ",".join(str(list(p)) for p in permutations(range(4))) + "]"), "array<array<int>>")

    def placed(way: Column) -> Column:
        """Pairs of a way: the i-th layer before with the way's i-th place now; places without a layer pair with nothing."""
        met = F.transform(F.col("as"), lambda a, i: F.filter("cells", lambda c: (c["a"] == a) & (c["b"] == F.get(F.col("bs"), F.get(way, i)))))
        return F.flatten(met)

    total = lambda ps: F.aggregate(ps, F.lit(0.0), lambda s, c: s + c["d"])
    most = F.least(F.size("as"), F.size("bs"))
    tried = F.filter(F.transform(ways, placed), lambda ps: F.size(ps) == most)
    best = F.array_min(F.transform(tried, lambda ps: F.struct(F.round(total(ps), 9).alias("total"), F.array_sort(ps).alias("pairs"))))["pairs"]
    out = cells.select("song_id", "w", F.explode(best).alias("p")).where(F.col("p.d") < farthest)
    return out.select("song_id", "w", F.col("p.a").alias("a"), F.col("p.b").alias("b"), (1 - F.col("p.d") / farthest).alias("strength"))
