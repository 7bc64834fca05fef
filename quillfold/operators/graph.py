"""Connected components of a graph held in tables, by alternating large and small stars.

Each round joins every node to the least node that it sees; rounds needed grow with the logarithm of the graph, and they
go on until nothing moves. Rounds are written to the shared folder, so lineage stays short and a lost executor costs a
re-read. Minima are combined before the shuffle, and a node with very many links meets them where they lie.

Links with a null end are none; self links and repeated links are allowed; an empty table gives an empty result; other
columns are ignored. Nodes may be of any type that can be ordered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import discard, spool, spread_join


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()
    return r["n"], r["x"]


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """node, root: each node of the edges with the least node of its component."""
    e = spool(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct())  # both skip nulls
    state = _state(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = spool(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")))
        # Each greater neighbour goes to the node's least one.
        large = spool(spread_join(both, least, "u", "n", 2 * state[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = spool(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        # Each lesser neighbour, and the node itself, goes to the least of them.
        small = spread_join(large, low, "u", "n", 2 * state[0]).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        after = spool(small)
        discard(e, least, large, low)
        new, e = _state(after), after
        if new == state:
            break
        state = new
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
