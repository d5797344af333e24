"""Connected components of an undirected link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import discard, materialize


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the smallest node it sees."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node hands its smaller neighbours, and itself, to the smallest of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component): every node that has a link, with the smallest node it reaches.

    Alternating large and small stars: each round is two grouped minima joined back, so the neighbours of a node are never
    gathered, and rounds grow with the logarithm of the longest chain. Each round is written to the shared folder. Loops and
    repeated links count once; rows with a null end are no links.
    """
    now = materialize(links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u > v").distinct(), "links")
    before = _state(now)
    while before[0]:
        last, now = now, materialize(_small_star(_large_star(now)), "links")
        after = _state(now)
        discard(last)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
