"""Connected components of a link table, by alternating star contraction on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written

#: Links of one task of what is written between rounds, so that small tables are not dealt over many files.
LINKS_A_TASK = 100_000


def _packed(links: DataFrame, n: int) -> DataFrame:
    """`links` in as few partitions as n links need, and no fewer than tasks run at once."""
    return links.coalesce(max(links.sparkSession.sparkContext.defaultParallelism, -(-n // LINKS_A_TASK)))


def _star(edges: DataFrame, large: bool, n: int) -> DataFrame:
    """Each node's neighbours (above it if large, else below and itself) are hung on the least node around it."""
    if large:
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ends = ends.select(F.col("a").alias("u"), F.col("b").alias("v"))
    else:
        ends = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = ends.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    hung = ends.join(least, "u")
    hung = hung.where("v > u") if large else hung
    out = hung.select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return _packed(out.where("a <> b"), n)


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for every node of the links (a, b).

    Links are written between rounds; a round ends the loop once it changes nothing. No links: no rows.
    """
    now = written(edges.select("a", "b").where("a <> b").distinct(), "links")
    mark = None
    most = now.count()
    while True:
        now = written(_packed(_star(_star(now, True, most), False, most).distinct(), most), "links")
        got = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        most = got[0]
        if tuple(got) == mark:
            break
        mark = tuple(got)
    own = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(own)
