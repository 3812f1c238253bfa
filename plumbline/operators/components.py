"""Connected components of a link table, by alternating large-star and small-star steps (Kiveris and others, 2014).

Each step is one aggregation and one join over the links; a step's table is written to the shared folder.  No link
and no label reaches the driver, only two sums by which convergence is seen.  A node with very many links is spread by
partial aggregation and by the join's skew handling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.staging import discard, staged


def _measure(links: DataFrame):
    return links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def connected_components(links: DataFrame) -> DataFrame:
    """node and component (the smallest node that links reach) for every node of ``links`` (columns u, v: long).

    The result is a staged table of its own, for the caller to discard; those of the steps are gone.
    """
    links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    links = staged(links, "links")
    seen = _measure(links)
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        large = staged(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        before, links = links, staged(small.filter("u > v").distinct(), "small-star")
        discard(before, large)
        now = _measure(links)
        if now == seen:
            break
        seen = now
    roots = links.select(F.col("v").alias("node")).distinct()
    found = links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
    held = staged(found, "components")
    discard(links)
    return held
