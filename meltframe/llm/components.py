"""Connected components of a link table by alternating star contractions; every step is a grouping and a join of link rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meltframe.llm.common import maybe_broadcast
from meltframe.session import free, stored


def _with_least(links: DataFrame, least: DataFrame) -> DataFrame:
    """Links (u, v) with `m`, the least of u and its neighbours; `least` is stored, so its size is known."""
    return links.join(maybe_broadcast(least, least.count()), "u")


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least node around it."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stored(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m")))
    out = _with_least(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return stored(out.where("u <> v").distinct())


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node itself, is linked to the least of them. Links point from larger to smaller."""
    least = stored(links.groupBy("u").agg(F.min("v").alias("m")))
    out = _with_least(links, least).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        least.select("u", F.col("m").alias("v")))
    return stored(out.where("u <> v").distinct())


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that occurs in a link (a, b); a component's name is its least node."""
    now = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    # the star of a component is the only form both contractions leave as it is
    mark = None
    while True:
        size, check = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if (size, check) == mark or not size:
            break
        mark = (size, check)
        large = _large_star(now)
        before, now = now, _small_star(large)
        free(before, large)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
