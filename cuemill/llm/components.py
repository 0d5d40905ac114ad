"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _minima(links: DataFrame) -> DataFrame:
    """Of each node, the smallest of itself and its neighbours. links: u, v in both directions."""
    return links.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("least"))


def connected_components(links: DataFrame) -> DataFrame:
    """node, component (smallest node that can be reached) of all nodes of ``links`` (columns a, b); a table in the shared folder.

    Each round hangs every node's larger neighbours under its smallest one (large star), then
    its smaller ones (small star), until nothing changes; a round halves the depth of what is
    left.  The links lie in the shared folder between rounds; only a count and a checksum come to the
    driver.  Minima are aggregated before the shuffle, and the joins are ones that Spark splits, so
    that a node with very many links is no task of its own.  Null ends are dropped.
    """
    now = written(links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if state == seen or not state["n"]:
            out = now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v")).groupBy("node").agg(F.min("component").alias("component"))
            out = written(out, "components")
            discard(now)
            return out
        seen = state
        both = now.union(now.select(F.col("v"), F.col("u")))
        large = both.join(_minima(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("least"))
        small = large.join(least, "u").where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v")).union(least)
        before, now = now, written(small.where("u <> v").distinct(), "links")
        discard(before)
