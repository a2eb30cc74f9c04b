"""Connected components of links, as joins and groupings only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import cut_lineage


def connected_components(links: DataFrame) -> DataFrame:
    """Rows node, component (the smallest node of the component) for the nodes of ``links`` (columns a, b).

    Alternates two steps until no link changes: every node's larger neighbours are linked to its smallest
    neighbour, then its smaller neighbours are. The number of rounds grows with the logarithm of the
    longest path, and neither step gathers the neighbours of a node in one row.
    """
    links = cut_lineage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)
        links = cut_lineage(small.distinct())
        # Links only ever move to smaller nodes; the same rows twice mean that all are stars.
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if now == before:
            break
        before = now
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
