"""Connected components by star contraction (Kiveris et al., SoCC 2014), as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.session import materialize


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node of the undirected ``edges`` (a, b), loops left out.

    Every round hangs the larger neighbours of each node, then the smaller ones, below its smallest neighbour. No
    neighbourhood is gathered; a round is two aggregations and two joins, and their number grows with the logarithm of the
    longest chain.
    """
    pairs = materialize(edges.select("a", "b").where("a <> b").distinct(), "edges")
    while True:
        both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("c")).agg(F.least(F.min("b"), F.min("a")).alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("c")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.where("a <> b").distinct(), "large-star")
        below = large.groupBy(F.col("a").alias("c")).agg(F.min("b").alias("m"))
        kept = large.join(below, F.col("a") == F.col("c"))
        small = kept.select("a", F.col("m").alias("b")).unionByName(kept.select(F.col("b").alias("a"), F.col("m").alias("b")))
        found = materialize(small.where("a <> b").distinct(), "small-star")
        if _same(pairs, found):
            break
        pairs = found
    roots = found.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _same(a: DataFrame, b: DataFrame) -> bool:
    told = [x.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first() for x in (a, b)]
    return told[0] == told[1]
