"""Connected components by alternating large-star and small-star steps.

Each step is a partial aggregation and a join of stored tables, so that
adaptive execution can split the rows of a node with very many links. The links
stay in the shared folder; only whether a step is the last reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step over links (u, v) with u > v. Large: a node's larger neighbours
    are linked to the smallest node around it; small: the others."""
    rows = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = stored(rows.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    joined = rows.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    stars = stored(out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    forget(least)
    return stars


def _done(links: DataFrame) -> bool:
    """Whether links are stars already: each node has one link to a smaller
    node, and that one has none."""
    ends = links.select("u", F.lit(1).alias("child"), F.lit(0).alias("root")).unionByName(links.select(F.col("v").alias("u"), F.lit(0).alias("child"), F.lit(1).alias("root")))
    odd = ends.groupBy("u").agg(F.sum("child").alias("child"), F.max("root").alias("root")).where("child > 1 or (child = 1 and root = 1)")
    return odd.isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node with a link (long columns u, v), where root
    is the smallest node that is reachable; a root itself has no row."""
    links = stored(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while not _done(links):
        large = _star(links, True)
        small = _star(large, False)
        forget(links, large)
        links = small
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
