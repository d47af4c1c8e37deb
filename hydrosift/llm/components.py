"""Connected components of a table of links, by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

#: links that a task writes: a few thousand are no work for all shuffle partitions
LINKS = 1 << 16


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(id, component): the smallest id reachable from each id in ``links(a, b)``.

    Alternating large-star and small-star steps (Kiveris et al., 2014) until
    the links no longer change; every round is written to the shared folder.
    Rounds grow with the logarithm of the longest path.  Links of a node to
    itself carry no information and are left out."""
    edges = stage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                  .distinct(), name)
    rows, before = edges.count(), None
    while True:
        parts = max(1, -(-rows // LINKS))
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large.coalesce(parts), name)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = stage(small.coalesce(parts), name)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        rows, before = now[0], now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
