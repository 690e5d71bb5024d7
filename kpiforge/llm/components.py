"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is two equi-joins on aggregated minima; no neighbour list is ever collected, so
a hub with very many links is a skewed join key (which AQE splits), not one big group. The
edges of a round are stored in the shared folder before the next one starts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.common import stored


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first()
    return tuple(row)


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` of one type, any direction, repeats and loops allowed -> (node, root):
    one row per node that has a link, root being the smallest node of its component."""
    cur = stored(edges.where("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-0")
    before, i = _state(cur), 0
    while before[0]:
        i += 1
        # large star: every larger neighbour is linked to the smallest neighbour
        sym = _both_ways(cur)
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (sym.where("v > u").join(low, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: a node and its smaller neighbours are linked to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = low.select("u", F.col("m").alias("v")).unionByName(small).where("u <> v").distinct()
        cur = stored(nxt, f"cc-{i}")
        after = _state(cur)
        if after == before:
            break
        before = after
    roots = cur.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
