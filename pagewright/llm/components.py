"""Connected components of a link table, by alternating large-star and small-star steps.

Minima combine before the shuffle, and the joins meet one row for each node,
so that a node with very many links is split by Spark's skew handling. Nothing
is collected but one count and one checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, salted_join, written


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("x")).select("x.u", "x.v")


def _large_star(links: DataFrame) -> DataFrame:
    both = _both_ways(links)
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return salted_join(both.filter("v > u"), least, ["u"], "v").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = salted_join(down, least, ["u"], "v").filter("v > m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links (a, b) -> node, root: every linked node with the smallest node it reaches (itself where it is the root)."""
    links = written(links.filter("a <> b").select("a", "b").distinct(), "links")
    seen = None
    for _ in range(rounds):
        before, links = links, written(_small_star(_large_star(links)), "links")
        dropped(before)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    else:
        raise RuntimeError(f"components: not settled after {rounds} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
