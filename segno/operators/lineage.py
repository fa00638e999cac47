"""Stage graphs, incremental plans and edit logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..sources.quality import written


def lineage_closure(edges: DataFrame, start: str = "child", end: str = "parent") -> DataFrame:
    """node, ancestor, depth (least): all that each node depends on; on a cycle a node is its own ancestor.

    Reach doubles in each round: a least path of 2^k + d steps is one of 2^k steps and one of d <= 2^k steps, so pairs that are
    exactly 2^k apart meet all pairs found so far, and a graph is closed after the logarithm of its depth. Only the new pairs are
    written in a round; the walk ends with one that finds nothing.
    """
    out = written(edges.select(F.col(start).alias("node"), F.col(end).alias("ancestor")).distinct().withColumn("depth", F.lit(1)), "closure")
    reach = 1
    while True:
        front = out.where(F.col("depth") == reach).select("node", F.col("ancestor").alias("mid"))
        rest = out.select(F.col("node").alias("mid"), "ancestor", (F.col("depth") + reach).alias("depth"))
        new = front.join(rest, "mid").groupBy("node", "ancestor").agg(F.min("depth").alias("depth"))
        new = written(new.join(out.select("node", "ancestor"), ["node", "ancestor"], "left_anti"), "closure")
        if new.isEmpty():
            return out
        out, reach = out.unionByName(new), 2 * reach


def cycles(closure: DataFrame) -> DataFrame:
    """node: those that depend on themselves."""
    return closure.where("node = ancestor").select("node").distinct()


def stale(closure: DataFrame, changed: DataFrame) -> DataFrame:
    """node: changed ones and all that depend on them."""
    reach = closure.join(changed.select(F.col("node").alias("ancestor")), "ancestor", "left_semi").select("node")
    return reach.unionByName(changed.select("node")).distinct()


def incremental_plan(wanted: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """wanted keys that are not held yet."""
    return wanted.join(held.select(key).distinct(), key, "left_anti")


def active_edits(log: DataFrame, key: str, seq: str) -> DataFrame:
    """key, active (ids of edits in force, in order), undone: an undo or redo counts only if it targets the top of its stack; a
    new edit clears what could be redone. log: key, seq, op (edit, undo or redo), id, target."""
    xs = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("seq"), "op", "id", "target")))
    top = lambda s: F.try_element_at(s, F.lit(-1))
    popped = lambda s: F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))
    none = F.array().cast("array<bigint>")

    def step(a, x):
        undo = (x["op"] == "undo") & F.coalesce(top(a["done"]) == x["target"], F.lit(False))
        redo = (x["op"] == "redo") & F.coalesce(top(a["undone"]) == x["target"], F.lit(False))
        edit = x["op"] == "edit"
        done = F.when(edit, F.concat(a["done"], F.array(x["id"]))).when(undo, popped(a["done"])).when(redo, F.concat(a["done"], F.array(x["target"]))).otherwise(a["done"])
        undone = F.when(edit, none).when(undo, F.concat(a["undone"], F.array(x["target"]))).when(redo, popped(a["undone"])).otherwise(a["undone"])
        return F.struct(done.alias("done"), undone.alias("undone"))

    state = F.aggregate("xs", F.struct(none.alias("done"), none.alias("undone")), step)
    return log.groupBy(key).agg(xs.alias("xs")).select(key, state["done"].alias("active"), state["undone"].alias("undone"))


def latest_status(entries: DataFrame, key: str, seq: str, status: str) -> DataFrame:
    """key, status of its last entry, n entries."""
    return entries.groupBy(key).agg(F.max_by(status, seq).alias("status"), F.count("*").alias("n"))


def verify_manifest(recorded: DataFrame, present: DataFrame, key: str, digest: str) -> DataFrame:
    """key, status: verified, mismatch, missing (recorded only) or extra (present only)."""
    both = recorded.select(key, F.col(digest).alias("_r"), F.lit(True).alias("_in_r")).join(present.select(key, F.col(digest).alias("_p"), F.lit(True).alias("_in_p")), key, "full_outer")
    status = F.when(F.col("_in_r").isNull(), "extra").when(F.col("_in_p").isNull(), "missing").when(F.col("_r").eqNullSafe(F.col("_p")), "verified").otherwise("mismatch")
    return both.select(key, status.alias("status"))


def unique_names(df: DataFrame, name: str, tie: str, width: int = 1000) -> DataFrame:
    """df + folder: the name, with a number from the second of its kind on, by a numeric tie.

    Rows are numbered in spans of `width` ties and spans are added up, so that one very common name is no single task.
    """
    rows = df.withColumn("_span", F.floor(F.col(tie) / width))
    sizes = rows.groupBy(name, "_span").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(name).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(sizes.select(name, "_span", before.alias("_before")), [name, "_span"])
    n = F.row_number().over(Window.partitionBy(name, "_span").orderBy(tie)) + F.col("_before")
    return rows.select(*df.columns, F.when(n == 1, F.col(name)).otherwise(F.concat_ws("_", F.col(name), n.cast("string"))).alias("folder"))


def connected_takes(pairs: DataFrame) -> DataFrame:
    """node, take, size: nodes of pairs (a, b) by the least node they are joined with over any number of pairs.

    Labels spread to neighbours and jump to their label's label until none changes; each round is checkpointed.
    """
    ends = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    now = ends.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("take")).select(F.col("a").alias("node"), "take").checkpoint()
    while True:
        near = ends.join(now, ends["b"] == now["node"]).groupBy("a").agg(F.min("take").alias("other"))
        jump = now.select(F.col("node").alias("take"), F.col("take").alias("far"))
        new = now.join(near, now["node"] == near["a"]).join(jump, "take", "left").select("node", F.col("take").alias("old"), F.least("take", "other", "far").alias("take")).checkpoint()
        changed = not new.where("old <> take").isEmpty()
        now = new.select("node", "take")
        if not changed:
            return now.withColumn("size", F.count("*").over(Window.partitionBy("take")))


def artifacts(exports: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """export, stage, artifact, depth: of all that an export depends on (itself included) the nearest node of each stage (ties: the
    least). edges: child, parent; nodes: node, stage."""
    seen = written(exports.select("export", F.col("export").alias("node"), F.lit(0).alias("depth")), "artifacts")
    front = seen
    while not front.isEmpty():
        step = front.join(edges, front["node"] == edges["child"]).select("export", F.col("parent").alias("node"), (F.col("depth") + 1).alias("depth")).distinct()
        front = written(step.join(seen.select("export", "node"), ["export", "node"], "left_anti"), "artifacts")
        seen = seen.unionByName(front)
    found = seen.join(nodes, "node").groupBy("export", "stage")
    return found.agg(F.min_by("node", F.struct("depth", "node")).alias("artifact"), F.min("depth").alias("depth"))
