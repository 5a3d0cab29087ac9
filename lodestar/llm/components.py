"""Connected components by alternating large-star and small-star steps.

Each step replaces a node's links by links to the smallest node it sees, so that after
O(log n) rounds in practice every component is a star around its smallest node. A node's
smallest neighbour is a partially aggregated minimum; it is settled before the links are
joined to it, so both sides of the join are plain shuffles and adaptive execution can
split the links of a hub over many tasks. Nothing is gathered: the driver sees a count
and a checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import settle


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = settle(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
    linked = both.where("v > u").join(least, "u")
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = settle(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    rest = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """``node, component`` for every node that some link between two different nodes touches.

    ``component`` is the smallest node reachable. Links are undirected; null ends and
    self-links are ignored; an empty table gives an empty result.
    """
    edges = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u != v")
    edges = settle(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(edges)
    while state[0]:
        edges = settle(_small_star(settle(_large_star(edges), "large")), "small")
        before, state = state, _state(edges)
        if before == state:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select("v", F.col("v").alias("component")).distinct()
    )
