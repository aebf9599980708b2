"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    near = down.join(least.withColumnRenamed("u", "w"), F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (its smallest reachable node) for each node of ``links`` (u, v).

    A node's neighbours are never gathered: each step keeps one minimum a node,
    combined before the shuffle, so a node with very many links is no burden.
    The edge list is written after each round; the loop ends when it no longer
    changes, which takes a number of rounds near the logarithm of the longest
    path.  Self-links and repeated links are allowed; no links give no rows.
    """
    links = frames.written(links.select("u", "v").filter("u != v").distinct(), "links")
    before = None
    for _ in range(rounds):
        links = frames.written(_small_star(_large_star(links)), "links")
        now = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before or not now[0]:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = links.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
