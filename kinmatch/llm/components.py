"""Connected components of a table of links, by alternating large-star and small-star steps.

Nothing is collected: each step is a minimum per node and a join back, and a hub's links are combined map-side or, in the
join, split by Spark as a skewed partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = _least(both).select("u", F.least("u", "m").alias("m"))
    return both.join(near, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    # links run from the larger id u to the smaller v
    near = _least(links)
    star = links.join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return star.union(near.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(links: DataFrame) -> DataFrame:
    """links (u, v) of long ids: (id, component) for each id in a link, component being the smallest id reachable."""
    links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
    links, seen = cut(links, "links"), None
    while True:
        links = cut(_small_star(_large_star(links)), "links")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = links.select(F.col("v").alias("u"), "v").distinct()
    return links.union(roots).select(F.col("u").alias("id"), F.col("v").alias("component"))
