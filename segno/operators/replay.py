"""Replay of note edits in log order, as two folds: which note each edit meets, then what its edits make of each note.

Whether an anchor finds a note depends on tracks, pitches, deletions and added notes only, never on parts. So anchors are resolved
first, in small groups of notes and edits that lie together; what follows is a fold over the edits of one note, which spans
and repeats join as further edits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Edits: what each kind reads besides song_id, seq and op. Columns that a log lacks count as null.
#: delete, pitch (to), assign (to_track), pin (string, fret), part (to, k): an anchor, that is track, onset_us and pitch, or added;
#: add: track, onset_us, offset_us, pitch, line; part_span: from_line, to, start_us, end_us, k; parts_k: k.
FIELDS = {
    "track": "string", "onset_us": "long", "offset_us": "long", "pitch": "int", "added": "long", "to": "int", "to_track": "string", "string": "int", "fret": "int",
    "line": "int", "from_line": "int", "start_us": "long", "end_us": "long", "k": "int",
}
ANCHORED = ["delete", "pitch", "assign", "pin", "part"]
#: The track whose notes have parts; the part of notes that have none.
PARTED, UNASSIGNED = "guitar", -1
#: An anchor up to this far from its note is exact.
EXACT_US = 100


def whole_edits(edits: DataFrame) -> DataFrame:
    return edits.select("song_id", F.col("seq").cast("long").alias("seq"), "op", *[(F.col(c) if c in edits.columns else F.lit(None)).cast(t).alias(c) for c, t in FIELDS.items()])


def resolved(notes: DataFrame, edits: DataFrame, tol_us: int = 30_000) -> DataFrame:
    """song_id, seq, note_id, exact of every anchored edit: the nearest note of its track and pitch within tol_us as the notes are when
    the edit's turn comes (ties: the lesser id), or the added note it names; null where there is none.

    Onsets never move, so notes and edits are folded together in each chain of onsets with gaps up to tol_us; an added
    note and the edits that name it are a group of their own. The note that edit `seq` adds has the id -seq.
    """
    kind = "struct<seq:bigint,op:string,t:bigint,id:bigint,track:string,pitch:int,to:int,to_track:string>"
    item = lambda seq, op, t, i, to, to_track: F.struct(seq.alias("seq"), op.alias("op"), t.alias("t"), i.alias("id"), "track", F.col("pitch").cast("int").alias("pitch"), to.alias("to"), to_track.alias("to_track")).cast(kind).alias("x")
    none, word = F.lit(None).cast("int"), F.lit(None).cast("string")
    base = notes.select("song_id", item(F.lit(None).cast("long"), F.lit("note"), F.col("onset_us"), F.col("note_id"), none, word))
    lies = edits.where(F.col("op").isin(ANCHORED) & F.col("added").isNull()).select("song_id", item(F.col("seq"), F.col("op"), F.col("onset_us"), F.lit(None).cast("long"), F.col("to"), F.col("to_track")))
    w = Window.partitionBy("song_id").orderBy("x.t")
    far = F.coalesce(F.col("x.t") - F.lag("x.t").over(w) > tol_us, F.lit(True))
    chains = base.unionByName(lies).withColumn("_new", far.cast("int")).withColumn("part", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).select("song_id", "part", "x")
    own = edits.where((F.col("op") == "add") | (F.col("op").isin(ANCHORED) & F.col("added").isNotNull()))
    own = own.select("song_id", (-F.when(F.col("op") == "add", F.col("seq")).otherwise(F.col("added"))).alias("part"), item(F.col("seq"), F.col("op"), F.lit(0).cast("long"), F.when(F.col("op") == "add", -F.col("seq")), F.col("to"), F.col("to_track")))
    groups = chains.unionByName(own).groupBy("song_id", "part").agg(F.collect_list("x").alias("xs"))
    groups = groups.where(F.exists("xs", lambda x: x["seq"].isNotNull() & (x["op"] != "add")))
    by_seq = lambda a, b: F.when(a["seq"] < b["seq"], -1).when(a["seq"] > b["seq"], 1).otherwise(0)
    alive = lambda x: F.struct(x["id"].alias("id"), x["t"].alias("t"), x["track"].alias("track"), x["pitch"].alias("pitch"))
    start = F.transform(F.filter("xs", lambda x: x["seq"].isNull()), alive)
    log = F.array_sort(F.filter("xs", lambda x: x["seq"].isNotNull()), by_seq)

    def step(a: Column, e: Column) -> Column:
        added = F.col("part") < 0
        near = F.filter(a["ns"], lambda n: (n["track"] == e["track"]) & (added | ((n["pitch"] == e["pitch"]) & (F.abs(n["t"] - e["t"]) <= tol_us))))
        best = F.array_min(F.transform(near, lambda n: F.struct(F.when(added, F.lit(0).cast("long")).otherwise(F.abs(n["t"] - e["t"])).alias("d"), n["id"].alias("id"))))

        def met(hit: Column) -> Column:
            changed = F.transform(
                a["ns"],
                lambda n: F.when(
                    n["id"] == hit["id"],
                    F.struct(n["id"].alias("id"), n["t"].alias("t"), F.when(e["op"] == "assign", e["to_track"]).otherwise(n["track"]).alias("track"), F.when(e["op"] == "pitch", e["to"]).otherwise(n["pitch"]).alias("pitch")),
                ).otherwise(n),
            )
            left = F.when(e["op"] == "delete", F.filter(a["ns"], lambda n: n["id"] != hit["id"])).when(e["op"].isin("assign", "pitch"), changed).otherwise(a["ns"])
            out = F.array_append(a["out"], F.struct(e["seq"].alias("seq"), hit["id"].alias("note_id"), (hit["d"] <= EXACT_US).alias("exact")))
            return F.struct(F.when(hit.isNull(), a["ns"]).otherwise(left).alias("ns"), out.alias("out"))

        born = F.struct(F.array_append(a["ns"], alive(e)).alias("ns"), a["out"].alias("out"))
        return F.when(e["op"] == "add", born).otherwise(F.transform(F.array(best), met)[0])

    nothing = F.array().cast("array<struct<seq:bigint,note_id:bigint,exact:boolean>>")
    hits = F.aggregate(log, F.struct(start.alias("ns"), nothing.alias("out")), step)["out"]
    return groups.select("song_id", F.explode(hits).alias("h")).select("song_id", "h.*")


def apply_note_edits(notes: DataFrame, edits: DataFrame, links: DataFrame, parts: DataFrame, tol_us: int = 30_000) -> tuple[DataFrame, DataFrame]:
    """(notes, report) after the edits in force, in log order.

    notes: song_id, track, note_id, onset_us, pitch, line; after: these, origin, string and fret (pinned or null), status (kept, added, deleted),
    spread (its part came from a note it repeats). report: song_id, seq, op, why (null: applied), exact.
    The last parts_k of a song gives its notes the parts of `parts` (song_id, k, note_id, line); part and part_span count only if made
    with that k (0 without one) and for a part that the run has. A part reaches the notes that `links` (a, b: note ids) says repeat its
    note, unless an edit of their own or a span sets those. A new pitch, track or part takes a pin away, a spread part does not.
    """
    edits = whole_edits(edits)
    forced = edits.where("op = 'parts_k'").groupBy("song_id").agg(F.max_by("k", "seq").alias("forced"))
    rows = notes.select("song_id", "track", F.col("note_id").cast("long").alias("note_id"), F.col("onset_us").cast("long").alias("onset_us"), F.col("pitch").cast("int").alias("pitch"), F.col("line").cast("int").alias("line"))
    again = parts.select("song_id", F.col("k").alias("forced"), "note_id", F.col("line").cast("int").alias("_line")).join(F.broadcast(forced), ["song_id", "forced"]).select("song_id", "note_id", "_line")
    rows = rows.join(again, ["song_id", "note_id"], "left").withColumn("line", F.when(F.col("track") == PARTED, F.coalesce("_line", "line")).otherwise(F.col("line"))).drop("_line")
    run = rows.where(F.col("track") == PARTED).groupBy("song_id").agg(F.collect_set("line").alias("_present"))
    edits = edits.join(F.broadcast(forced), "song_id", "left").join(run, "song_id", "left")
    present = F.coalesce(F.col("_present"), F.array().cast("array<int>"))
    known = lambda c: (F.col(c) == UNASSIGNED) | F.array_contains(present, F.col(c))
    of_parts = F.col("op").isin("part", "part_span")
    why = F.when(of_parts & (F.coalesce("k", F.lit(0)) != F.coalesce("forced", F.lit(0))), "made with another part count").when(of_parts & (~known("to") | ((F.col("op") == "part") & (F.col("track") != PARTED))), "part is not in this run")
    edits = edits.withColumn("_why", why)
    hits = resolved(rows, edits, tol_us)
    event = "struct<seq:bigint,op:string,to:int,to_track:string,string:int,fret:int,from_line:int>"
    what = F.struct("seq", "op", "to", "to_track", "string", "fret", "from_line").cast(event).alias("e")
    met = edits.where(F.col("op").isin(ANCHORED) & F.col("_why").isNull()).join(hits.where("note_id is not null"), ["song_id", "seq"])
    direct = met.select("song_id", "note_id", what)
    set_ = met.where("op = 'part'").select("song_id", "note_id", F.lit(True).alias("explicit")).distinct()
    spans = edits.where("op = 'part_span' and _why is null").select("song_id", what, "start_us", "end_us")
    added = edits.where("op = 'add'").select("song_id", "track", (-F.col("seq")).alias("note_id"), "onset_us", "pitch", F.when(known("line"), F.col("line")).otherwise(UNASSIGNED).alias("line"), F.col("seq").alias("born"))
    every = rows.withColumn("born", F.lit(None).cast("long")).unionByName(added)
    over = every.select("song_id", "note_id", F.col("onset_us").alias("_t")).join(F.broadcast(spans), "song_id").where((F.col("_t") >= F.col("start_us") - EXACT_US) & (F.col("_t") < F.col("end_us"))).select("song_id", "note_id", "e")
    spread = met.where("op = 'part'").join(links.select(F.col("a").alias("note_id"), F.col("b")), "note_id").select("song_id", F.col("b").alias("note_id"), F.struct("seq", F.lit("spread").alias("op"), "to", "to_track", "string", "fret", "from_line").cast(event).alias("e"))
    events = direct.unionByName(over).unionByName(spread).groupBy("song_id", "note_id").agg(F.array_sort(F.collect_list("e"), lambda a, b: F.when(a["seq"] < b["seq"], -1).when(a["seq"] > b["seq"], 1).otherwise(0)).alias("es"))
    every = every.join(events, ["song_id", "note_id"], "left").join(set_, ["song_id", "note_id"], "left").withColumn("origin", F.col("track"))
    state = "struct<track:string,pitch:int,line:int,string:int,fret:int,fixed:boolean,gone:boolean,spread:boolean,moved:array<bigint>>"
    null = F.lit(None).cast("int")

    def step(a: Column, e: Column) -> Column:
        op, here = e["op"], a["track"] == PARTED
        spans_it = (op == "part_span") & here & (a["line"] == e["from_line"]) & F.coalesce(e["seq"] > F.col("born"), F.lit(True))
        spreads = (op == "spread") & here & (F.col("origin") == PARTED) & F.col("born").isNull() & ~a["fixed"] & ~F.coalesce(F.col("explicit"), F.lit(False)) & ~a["line"].eqNullSafe(e["to"])
        parted = (op == "part") | spans_it
        unpinned = op.isin("pitch", "assign") | parted
        new = F.struct(
            F.when(op == "assign", e["to_track"]).otherwise(a["track"]).alias("track"), F.when(op == "pitch", e["to"]).otherwise(a["pitch"]).alias("pitch"),
            F.when(parted | spreads, e["to"]).otherwise(a["line"]).alias("line"),
            F.when(op == "pin", e["string"]).when(unpinned, null).otherwise(a["string"]).alias("string"), F.when(op == "pin", e["fret"]).when(unpinned, null).otherwise(a["fret"]).alias("fret"),
            (a["fixed"] | spans_it).alias("fixed"), (op == "delete").alias("gone"), F.when(spreads, True).when(parted, False).otherwise(a["spread"]).alias("spread"),
            F.when(spans_it, F.array_append(a["moved"], e["seq"])).otherwise(a["moved"]).alias("moved"),
        ).cast(state)
        return F.when(a["gone"], a).otherwise(new)

    first = F.struct("track", "pitch", "line", null.alias("string"), null.alias("fret"), F.lit(False).alias("fixed"), F.lit(False).alias("gone"), F.lit(False).alias("spread"), F.array().cast("array<bigint>").alias("moved")).cast(state)
    folded = every.select("song_id", "note_id", "onset_us", "origin", "born", F.aggregate(F.coalesce("es", F.array().cast(f"array<{event}>")), first, step).alias("s"))
    status = F.when(F.col("s.gone"), "deleted").when(F.col("born").isNotNull(), "added").otherwise("kept")
    after = folded.select("song_id", "note_id", "onset_us", "origin", "s.track", "s.pitch", "s.line", "s.string", "s.fret", status.alias("status"), "s.spread")
    moved = folded.select("song_id", F.explode("s.moved").alias("seq")).distinct().withColumn("_moved", F.lit(True))
    report = edits.join(hits, ["song_id", "seq"], "left").join(moved, ["song_id", "seq"], "left")
    lost = F.when(F.col("op").isin(ANCHORED) & F.col("note_id").isNull(), "no such note").when(F.col("_why").isNotNull(), F.col("_why")).when((F.col("op") == "part_span") & F.col("_moved").isNull(), "no note of that part there")
    return after, report.select("song_id", "seq", "op", lost.alias("why"), F.when(lost.isNull(), F.col("exact")).alias("exact"))


def spread_part(notes: DataFrame, edits: DataFrame, links: DataFrame) -> DataFrame:
    """note_id, line, how: a part edit sets its own note (explicit) and those it repeats (spread), unless they have an edit of their own;
    the last edit in log order wins. edits: seq, note_id, to; links: a, b."""
    own = edits.groupBy("note_id").agg(F.max_by("to", "seq").alias("own"))
    reach = edits.join(links, edits["note_id"] == links["a"]).select(F.col("b").alias("note_id"), "seq", "to").groupBy("note_id").agg(F.max_by("to", "seq").alias("spread"))
    rows = notes.select("note_id", "line").join(own, "note_id", "left").join(reach, "note_id", "left")
    how = F.when(F.col("own").isNotNull(), "explicit").when(F.col("spread").isNotNull(), "spread").otherwise("kept")
    return rows.select("note_id", F.coalesce("own", "spread", "line").alias("line"), how.alias("how"))
