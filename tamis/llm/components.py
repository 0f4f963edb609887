"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.session import written


def _toward_smallest(edges: DataFrame, only_larger: bool) -> DataFrame:
    """Point the neighbours of each node u at the smallest of u and its neighbours.

    ``only_larger`` keeps the neighbours above u (the large star); else those below u and u itself (the small star). The
    smallest is an aggregate with partial sums, and the join that follows is one that Spark can split where u is hot.
    """
    large = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    small = F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")
    below = edges.select(*large)
    if only_larger:
        smallest = edges.select(*small).unionByName(below).groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        kept = edges.select(*small).join(smallest, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        smallest = below.groupBy("u").agg(F.min("v").alias("m"))
        kept = below.join(smallest, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            smallest.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    return kept.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge, where root is the smallest node of its component.

    ``edges`` has two columns of one type without nulls, in either direction, repeats and loops allowed. Alternating large
    and small stars halve the depth of each tree per round; every round is written, so a lost executor costs one round.
    """
    first, second = edges.columns
    current = written(
        edges.select(F.greatest(first, second).alias("a"), F.least(first, second).alias("b")).where("a <> b").distinct(), "edges"
    )

    def sign(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    before = sign(current)
    while True:
        current = written(_toward_smallest(_toward_smallest(current, True), False), "edges")
        after = sign(current)
        if after == before:
            break
        before = after
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
