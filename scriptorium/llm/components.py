"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cleared, written


def _star(both: DataFrame, large: bool) -> DataFrame:
    """One step over edges ``u, v``: every node's neighbours are moved to its least one. Minima are
    formed before the shuffle; the join back can be split where one node has very many edges."""
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("of"), F.least("of", "m").alias("m"))
    moved = both.join(least, both["u"] == least["of"])
    if large:
        return moved.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select(F.col("of").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, least``: for each node of ``edges`` (``u, v`` of any ordered type) the least node of
    its component. Each round's edges are a table in the shared folder; it ends when a round
    changes nothing, and only the last table stays."""
    with cleared(edges.sparkSession) as made:
        now = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        before = None
        for _ in range(rounds):
            both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            large = written(_star(both, True), "large-star")
            now = written(_star(large, False), "small-star")
            mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 999_983)).first()
            if mark == before:
                break
            before = mark
        else:
            raise RuntimeError("the components did not settle")
        made.pop()  # the last round's, which stays
    return now.select(F.col("u").alias("node"), F.col("v").alias("least")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("least")).distinct())
