"""Connected components of a stored table of links, by stars that move to smaller ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from glossa.session import WorkFolder


def components(links: DataFrame, folder: WorkFolder, name: str = "components") -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest id it reaches.

    Rounds of large and small stars (Kiveris et al., 2014): each node links its neighbours
    to the smallest of them, first the larger ones, then the others. The number of rounds
    grows with the logarithm of the largest component. Every round is a written table, and
    the end is seen from sums over it; no links reach the driver. A node with very many
    links appears as one row per link, which sums with a map-side combine.
    """

    def smallest(rows: DataFrame) -> DataFrame:
        return rows.groupBy("u").agg(F.min("v").alias("m"))

    def state() -> tuple:
        mixed = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        return tuple(kept.agg(F.count("*"), mixed).first())

    step = 0
    kept = links.select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    ).filter("u != v").distinct()
    kept = folder.write(kept, f"{name}-{step}")
    seen, now = None, state()
    while now[0] and now != seen:
        both = kept.union(kept.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = smallest(both).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = folder.write(large.distinct(), f"{name}-{step}-large")
        low = smallest(large)
        small = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = low.select("u", F.col("m").alias("v"))
        step += 1
        kept = folder.write(small.union(stars).distinct(), f"{name}-{step}")
        seen, now = now, state()
    roots = kept.select(F.col("u").alias("node"), F.col("v").alias("root"))
    tops = kept.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return roots.union(tops)
