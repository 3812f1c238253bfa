"""Samples of an exact size by a seeded hash of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: hash digits that one round tells apart: at most 65,536 counts reach the driver
_DIGITS = 4
#: rows of the bucket at the edge that may be ordered at once
EDGE = 100_000


def seeded_order(keys: list[str], seed: int) -> Column:
    """The order of a sample: MD5 of seed and keys; a null key counts as an empty text."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys)))


def exact_sample(df: DataFrame, keys: list[str], n: int, seed: int = 0, edge: int = EDGE) -> DataFrame:
    """The ``n`` rows whose keys come first in the seeded order; all rows where there are no more.

    The order is that of a hash, so the sample does not depend on partitions.  Counts by leading digits give the threshold: rows
    below it stay by a filter, in the tasks that hold them, and only a bucket of at most ``edge`` rows at the threshold is
    ordered.  Rows of one key are alike to the sample; of these any may be taken.
    """
    at = "_order"
    while at.lower() in {c.lower() for c in df.columns}:
        at += "_"
    held = df.withColumn(at, seeded_order(keys, seed))
    if n <= 0:
        return df.limit(0)
    inside, left, digits = held, n, 0
    while digits < 32:
        digits += _DIGITS
        lead = F.substring(at, 1, digits)
        counts = sorted(map(tuple, inside.groupBy(lead.alias("lead")).count().collect()))
        for bucket, count in counts:
            if count >= left:
                break
            left -= count
        else:
            return df
        if count == left:
            return held.filter(lead <= bucket).drop(at)
        inside = held.filter(lead == bucket)
        if count <= edge:
            break
    return held.filter(lead < bucket).union(inside.orderBy(at).limit(left)).drop(at)
