"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetdrift.llm.storage import stored


def components(links: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) of every node in ``links`` (a, b: long).

    Alternating large-star and small-star steps: every step is one aggregation
    and one join on the link table; the number of rounds grows with the logarithm
    of the longest path.  A hot node's links are joined, never collected.
    """
    pairs = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: larger neighbours link to the smallest of the neighbourhood.
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        # Small star: smaller neighbours and the node itself link to the smallest.
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = (
            large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
            .unionByName(low.select("a", F.col("low").alias("b")))
            .where("a <> b").distinct()
        )
        pairs = stored(small)
        # Sums of hashes tell whether anything changed.
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
