"""Connected components of links between numbers, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.settle import settle


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of ``links`` (a, b); the label is the smallest node it reaches.

    Each step lets every node point its neighbours to the smallest of them, as
    in the large-star and small-star steps of Kiveris et al. (2014), until
    nothing changes; the number of steps grows with the logarithm of a
    component's size. Only sums leave the cluster.
    """
    edges = settle(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = _state(edges)
    while before[0]:
        edges = settle(_small_star(_large_star(edges)))
        now = _state(edges)
        if now == before:
            break
        before = now
    # each node but the smallest now has one edge, to the smallest
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    low = F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1))
    return tuple(edges.agg(F.count("*"), F.sum(low)).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    others = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(least.select("u", F.col("m").alias("v"))).distinct()
