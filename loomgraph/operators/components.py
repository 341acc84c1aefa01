"""Connected components of an undirected edge list, as alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import split_join, staged


def _stars(edges: DataFrame) -> DataFrame:
    """(u, v, m): every edge with the least of u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("v0")).select("u", F.least("u", "v0").alias("m"))
    return split_join(edges, least, ["u"])


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """edges (u, v) to (node, root): root is the least node reachable. Only nodes with an edge appear.

    Each round is two aggregations and two joins over the edges; what remains at the end are stars, and the
    number of rounds grows with the logarithm of the longest chain. Nulls and loops are ignored.
    """
    edges = staged(edges.where("u is not null and v is not null and u <> v").select("u", "v").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # every edge now points down, from u to a smaller v
        s = _stars(large)
        small = s.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = staged(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        after = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if after == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
