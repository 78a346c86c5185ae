"""Connected components by alternating large and small stars, in DataFrame operations.

Every round halves the tree's depth at least; hot nodes are folded by a minimum, never
gathered. Each round is cut to the shared folder, so that plans stay short and joins
deal both sides anew (which lets adaptive execution split a hot node).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.shared import cut


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """From undirected links (a, b), both long: (node, root) of each linked node that isn't
    the root itself; the root is the component's smallest node. No links give no rows."""
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _sum(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = cut(both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(low, both.a == low.u).where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        edges = cut(large)
        low = cut(edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")))
        small = edges.join(low, edges.a == low.u).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        edges = cut(small.select("e.*").where("a <> b").distinct())
        after = _sum(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
