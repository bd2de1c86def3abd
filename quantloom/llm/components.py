"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm import common


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the node's smallest neighbour (or itself)."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    smaller = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return smaller.union(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """One row per node that has a link: node, component (the component's smallest node).

    Links may repeat and point either way; nulls and loops are ignored. Every round ends in a
    written table, so lineage stays short and a lost executor costs one round. Sums of hashes tell
    when nothing moves; no link reaches the driver. Minima are taken before the shuffle, so a node
    with very many links costs no more to sum up than another.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    edges = common.materialise(edges, "links")
    seen = None
    for _ in range(rounds):
        before, edges = edges, common.materialise(_small_star(_large_star(edges)).distinct(), "stars")
        common.discard(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    stars = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return stars.union(roots)
