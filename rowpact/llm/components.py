"""Connected components of a table of links, by rounds of joins; no link or label comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rowpact.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """node, root from the links (a, b), in either direction; root is the least node of the component.

    Large-star and small-star rounds: each node hangs its greater neighbours, then all its neighbours, on the least one it
    knows. The number of links never grows, and a node of very many links is only ever grouped by minimum, which is
    summed before it is shuffled. Each round is written, so a lost executor costs one round at most.
    """
    edges = scratch.stage(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), f"{name}-0")
    before, k = None, 0
    while True:
        k += 1
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        edges = scratch.stage(
            small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), f"{name}-{k}")
        # Done when the links are the same as before: their number and the sum of their hashes.
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
