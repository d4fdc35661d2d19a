"""Connected components by alternating large-star and small-star steps, each a grouping and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .storage import forget, saved


def _with_least(pairs: DataFrame) -> DataFrame:
    """pairs u, v with m, the least of u and all v of that u."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """id and component (the least id reachable) of each id in links (a, b); the least id of a component has no row.

    The number of rounds grows with the logarithm of the longest chain. Every round is written to the shared folder.
    """
    edges = saved(
        links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name
    )
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _with_least(large)
        small = small.select("v", "m").unionByName(small.select(F.col("u").alias("v"), "m"))
        old, edges = edges, saved(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), name)
        forget(old)
        n, mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, mark) == state:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        state = (n, mark)
