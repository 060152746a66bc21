"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hubs import with_hubs
from .scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; root is the least node that can be reached.

    Each step is a grouped minimum and an equi-join; a hub's minimum is
    broadcast, so that its neighbours are never gathered in one task. The number of rounds grows with the logarithm
    of the longest path. Self-loops and repeated edges are ignored; no edges give no rows.
    """
    now, seen = _saved(edges.where("a <> b"), scratch)
    for _ in range(most_rounds if seen["n"] else 0):
        both = now.union(now.select("b", "a")).toDF("u", "v")
        large = _with_least(both, 2 * seen["n"]).where("v > u").select(F.col("v").alias("a"), F.least("m", "u").alias("b"))
        large = _directed(large)
        small = _with_least(large.toDF("u", "v"), seen["n"]).select(F.explode(F.array("v", "u")).alias("a"), F.col("m").alias("b"))
        new, mark = _saved(small.where("a <> b"), scratch)
        scratch.drop(now)
        now, seen, before = new, mark, seen
        if seen == before:
            break
    else:
        if seen["n"]:
            raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.toDF("node", "root").union(roots)


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """Adds to ``edges(u, v)`` the least ``v`` of its ``u`` as ``m``."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return with_hubs(edges, least, "u", total)


def _directed(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger node to the smaller."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _saved(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, dict]:
    return scratch.measured(_directed(edges), "cc", n=F.count(F.lit(1)), mark=F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
