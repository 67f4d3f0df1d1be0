"""Connected components of an edge table, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _scratch


def _round(now: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (u, v) with v < u."""
    both = now.union(now.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return _scratch.write_table(small.union(low.select("u", "m")).distinct(), "edges")


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")


def shortened(edges: DataFrame, rounds: int = 2) -> DataFrame:
    """Edges (u, v), v < u, with the same components and shorter paths. The least v of a
    node is a node of its component, and one for all of it where paths were short."""
    now = _ordered(edges)
    for _ in range(rounds):
        now = _round(now)
    return now


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``edges(a, b)`` but the least of each component, which
    labels itself; the label is the least node of the component. Rounds go on until the edges
    are stars, which is known by their not changing; each ends in a written table. Their number
    grows with the logarithm of the longest path."""
    now, seen = _round(_ordered(edges)), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label"))
        seen = state
        nxt = _round(now)
        _scratch.drop_table(now)
        now = nxt
