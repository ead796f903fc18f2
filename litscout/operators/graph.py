"""Connected components of edges that no driver ever sees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b bigint): one row (node, root) per node, root the smallest node.

    Alternating large-star and small-star steps, each a few shuffles of the edges that remain and
    written to the shared folder; ends when a round changes nothing, which takes a number of rounds that
    grows with the logarithm of the edges. The least neighbours are written before they are joined, so that
    a hub's rows meet a plain join, which Spark splits, and no aggregation by hub; tables of earlier rounds
    are removed.
    """

    def tidy(df: DataFrame) -> DataFrame:
        return df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("bigint")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first())

    now = stored(tidy(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    was = mark(now)
    while was[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = stored(tidy(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))))
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        after = stored(tidy(small))
        discard(now, low, large, least)
        now, before = after, was
        if (was := mark(now)) == before:
            break
    roots = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.union(now.select("v", F.col("v").alias("root")).distinct())
