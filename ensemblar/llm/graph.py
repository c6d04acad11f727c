"""Connected components by alternating star contraction (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Parts that a node's neighbours are dealt out to.
SALTS = 8


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.hash("v", "m").cast("long")), F.sum(F.xxhash64("m", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the undirected edges; root is the smallest id reachable.

    Each round replaces edges by edges to the smallest neighbour, first towards
    larger neighbours (large star) and then towards smaller ones (small star). The minimum is a
    partial aggregate and a hub's neighbours are dealt out to several tasks, so that
    a star with very many leaves needs no single one. Rounds grow with the
    logarithm of the longest path. Self loops and null ends are ignored, and repeated edges are merged.
    """
    edges = (
        edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("m"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("v") != F.col("m")))
        .distinct()
    )
    edges = cut(edges)
    before = _state(edges)
    while before[0]:
        both = edges.select(F.col("v").alias("u"), F.col("m").alias("n")).union(edges.select("m", "v"))
        least = both.groupBy("u").agg(F.least(F.min("n"), F.first("u")).alias("m"))
        dealt = both.where(F.col("n") > F.col("u")).withColumn("salt", F.pmod(F.xxhash64("n"), F.lit(SALTS)).cast("int"))
        spread = least.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        large = dealt.join(spread, ["u", "salt"]).select(F.col("n").alias("v"), "m").distinct()
        down = large.where(F.col("v") != F.col("m"))
        small = down.groupBy("v").agg(F.min("m").alias("low"))
        moved = down.join(small, "v").where(F.col("m") != F.col("low")).select(F.col("m").alias("v"), F.col("low").alias("m"))
        edges = cut(moved.union(small.select("v", F.col("low").alias("m"))).distinct())
        after = _state(edges)
        if after == before:
            break
        before = after
    nodes = edges.select(F.col("v").alias("node"), F.col("m").alias("root"))
    return nodes.union(edges.select(F.col("m").alias("node"), F.col("m").alias("root")).distinct())
