"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfline.llm.common import stored


def star(links: DataFrame, u: Column, v: Column, keep: Column | None = None) -> DataFrame:
    """Links (u, v) seen from u: every v (and u itself) is linked to the smallest node around u instead.

    The smallest node is a partial aggregate, joined back, so a node with very many links is never collected in one row."""
    seen = links.select(u.alias("u"), v.alias("v"))
    least = seen.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    moved = seen.join(least, "u")
    if keep is not None:
        moved = moved.filter(keep)
    return moved


def components(links: DataFrame) -> DataFrame:
    """links (u, v): long node ids; returns (node, component) for every node with a link, component being its smallest node.

    Each round is written to the shared folder. Links only ever move to smaller nodes, and the rounds end when nothing moves; their
    number grows with the logarithm of the longest chain."""
    links = stored(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = None
    while True:
        # large star: the neighbours above a node go to the smallest node around it
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both, F.col("u"), F.col("v"), F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its neighbours below go to the smallest of them
        small = star(large, F.col("u"), F.col("v"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        links = stored(small.filter("u <> v").distinct(), "links")
        now = links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if state == now:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        state = now
