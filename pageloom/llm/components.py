"""Distributed connected components: alternating large-star and small-star steps (Kiveris et al., 2014).

Each round is two aggregations and joins over the edges, whose number never grows
beyond the first round's; the number of rounds grows with the logarithm of the
longest path.  Each round is stored in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm import shared


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) of every node of an edge to another node; ``component`` is the least node of its component.

    Edges have no direction; repeated ones, loops and ones with a null end don't matter.
    """
    a, b = F.col(src), F.col(dst)
    linked = edges.where(a.isNotNull() & b.isNotNull() & (a != b))
    now = shared.store(linked.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        before, now = now, shared.store(_small_star(_large_star(now)), "edges")
        shared.discard(before)
        if (new := _state(now)) == state:
            break
        state = new
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
