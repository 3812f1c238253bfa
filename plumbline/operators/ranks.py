"""Positions in a total order of a whole table, without one task that holds it.

Rows are dealt by ranges of the order, sorted within each range and numbered there; a row's number is then its place in
its range plus the rows of the ranges before it.  The driver sees one count a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.staging import discard, staged

#: a row's place within its task, in the lower bits of ``monotonically_increasing_id``
PLACE_BITS = 33


def numbered(df: DataFrame, order: list[Column], name: str = "number") -> DataFrame:
    """``df`` with the row's number from 1 in ``order`` (a long column ``name``); rows equal in ``order`` in any order.

    An empty table gives an empty one.  The table is written once, so numbers stay the same when tasks are run again.
    """
    spark = df.sparkSession
    at = name + "_at"
    while at.lower() in {c.lower() for c in df.columns}:
        at += "_"
    placed = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "ordered")
    counts = sorted(map(tuple, placed.groupBy(F.shiftright(at, PLACE_BITS).alias("range")).count().collect()))
    rows, before = [], 0
    for part, n in counts:
        rows.append((part, before))
        before += n
    part, first = at + "_range", at + "_first"
    offsets = spark.createDataFrame(rows, f"{part} long, {first} long")  # one row a range
    number = F.col(first) + F.col(at).bitwiseAND((1 << PLACE_BITS) - 1) + 1
    found = placed.withColumn(part, F.shiftright(at, PLACE_BITS)).join(F.broadcast(offsets), part).withColumn(name, number).drop(at, part, first)
    found._staged_at = placed._staged_at
    return found


def beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``left`` with the columns of ``right`` for the same keys, null ones included; without keys both are one row."""
    if not keys:
        return left.crossJoin(right)
    names = {k: f"_right_{i}" for i, k in enumerate(keys)}
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    return left.join(right.withColumnsRenamed(names), same, "left").drop(*names.values())


def ranked_within(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with the row's number from 1 within its group, and ``{name}_of`` rows of the group; no group meets in one task."""
    placed = numbered(df, [*(F.col(k).asc() for k in keys), *order], name)
    groups = placed.groupBy(*keys).agg(F.min(name).alias("_first"), F.count("*").alias(f"{name}_of"))
    found = beside(placed, groups, keys).withColumn(name, F.col(name) - F.col("_first") + 1).drop("_first")
    found._staged_at = placed._staged_at
    return found


def quantiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str | Column, float]]) -> DataFrame:
    """keys and, for each name in ``wanted``, the quantile (0 to 1, linear between neighbours, exact) of a column.

    All values are put in one order of (keys, column, value) by ranges; the two rows next to each quantile's place are then
    found by their numbers.  So a group of any size is spread over all tasks.  Nulls are passed over; a group without a value
    has null quantiles, if another of its columns has values, or no row.
    """
    columns: list = []
    which = {}
    for name, (value, _) in wanted.items():
        at = next((i for i, c in enumerate(columns) if c is value or (isinstance(c, str) and isinstance(value, str) and c == value)), None)
        which[name] = len(columns) if at is None else at
        if at is None:
            columns.append(value)
    cells = F.array(*(F.struct(F.lit(i).alias("_c"), (F.col(c) if isinstance(c, str) else c).cast("double").alias("_v")) for i, c in enumerate(columns)))
    long = df.select(*keys, F.explode(cells).alias("_x")).select(*keys, "_x.*").filter("_v IS NOT NULL")
    placed = numbered(long, [*(F.col(k).asc() for k in keys), F.col("_c").asc(), F.col("_v").asc()], "_n")
    groups = placed.groupBy(*keys, "_c").agg(F.min("_n").alias("_first"), F.count("*").alias("_of"))
    places = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(which[name]).alias("c"), F.lit(float(q)).alias("q")) for name, (_, q) in wanted.items()))
    asked = groups.select(*keys, "_c", "_first", "_of", F.explode(places).alias("_w")).filter("_w.c = _c").withColumn("_at", F.col("_w.q") * (F.col("_of") - 1))
    low, high = F.floor("_at"), F.ceil("_at")
    ends = F.array(F.struct(low.alias("at"), F.when(low == high, 1.0).otherwise(high - F.col("_at")).alias("share")), F.struct(high.alias("at"), F.when(low == high, 0.0).otherwise(F.col("_at") - low).alias("share")))
    asked = asked.select(*keys, F.col("_w.name").alias("_name"), "_first", F.explode(ends).alias("_e")).filter("_e.share > 0")
    asked = asked.select(*keys, "_name", (F.col("_first") + F.col("_e.at")).alias("_n"), F.col("_e.share").alias("_share"))
    found = asked.join(placed.select("_n", "_v"), "_n").withColumn("_v", F.col("_v") * F.col("_share"))
    held = staged(found.groupBy(*keys).agg(*(F.sum(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in wanted)), "quantiles")
    discard(placed)
    return held
