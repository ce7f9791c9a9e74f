"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every end of an edge (a long, b long): root is the smallest end in its component.

    Alternating star contraction: each vertex first hands its smallest neighbour to the larger ones, then to the smaller
    ones, until every edge points at a root. Minima combine before the shuffle; joins on a vertex with very many edges
    are split by adaptive execution. Rounds grow with the logarithm of a component's size; each is written to the
    shared folder, so a lost executor repeats one round at most.
    """
    pairs = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        pairs = written(small, "edges")
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    roots = pairs.select(F.col("v").alias("root")).distinct()
    return pairs.select(F.col("u").alias("v"), F.col("v").alias("root")).unionByName(roots.select(F.col("root").alias("v"), "root"))
