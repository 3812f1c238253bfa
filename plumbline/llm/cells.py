"""Cells of vectors around pivots, as a tree: a locality that lets whole cells be ruled out by the triangle inequality.

All vectors of a group start in one cell.  A cell of more than ``block`` vectors is split around pivots, which are some
of its vectors (in the order of a hash), in proportion to its size and at most ``FAN``; cells that are still too large are
split again.  The tree is a table: its depth grows with the logarithm of the data, and neither its pivots nor its nodes
pass through the driver.  Pivots decide only how tight the cells are, never what is found.  A cell that does not shrink,
as one of equal vectors, is left large after ``DEEPEST`` levels and dealt into blocks by hash.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import discard, stage

FAN, DEEPEST = 256, 6
#: vectors of a cell that one task deals out
SPLIT_ROWS = 1 << 14


def finite(vector: str = "embedding") -> Column:
    """True where a vector is not null and has only finite components, one at least."""
    v = F.col(vector)
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & ok, F.lit(False))


def distances(x: np.ndarray, p: np.ndarray, angular: bool) -> np.ndarray:
    """Angles, or Euclidean distances, of all rows of x to all rows of p."""
    if angular:
        unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
        return np.arccos(np.clip(unit(x) @ unit(p).T, -1, 1))
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * x @ p.T, 0))


def _split(placed: DataFrame, large: DataFrame, block: int, fan: int, angular: bool) -> tuple[DataFrame, DataFrame]:
    """Rows of large cells (cell, _size) put one level deeper, and the new nodes (node, centre)."""
    cell = F.element_at("path", -1)
    rows = placed.withColumn("_cell", cell).join(large.withColumnRenamed("cell", "_cell"), "_cell")
    place = F.row_number().over(Window.partitionBy("_cell").orderBy(F.xxhash64("id", F.lit(3)), "id"))
    first = rows.select("_cell", "_size", F.col("v").alias("centre"), place.alias("_place")).filter(F.col("_place") <= fan)
    chosen = first.filter(F.col("_place") <= F.ceil(2 * F.col("_size") / block)).select("_cell", "_size", F.xxhash64("_cell", "_place").alias("node"), "centre")
    chosen = stage(chosen, "pivots")
    salts = F.ceil(F.col("_size") / SPLIT_ROWS).cast("int")
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64("id", F.lit(9)), salts).cast("int")).drop("_size")
    copies = chosen.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_size")

    def assign(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        x, p = (np.stack(c.to_numpy()).astype(np.float64) for c in (left["v"], right["centre"]))
        away = distances(x, p, angular)
        nearest = away.argmin(axis=1)
        nodes = right["node"].to_numpy()[nearest]
        out = left.drop(columns=["_cell", "_salt"])
        out["path"] = [[*path, node] for path, node in zip(left["path"], nodes.tolist(), strict=True)]
        out["away"] = [[*a, d] for a, d in zip(left["away"], away[np.arange(len(x)), nearest].tolist(), strict=True)]
        return out

    key = ["_cell", "_salt"]
    deeper = dealt.groupBy(key).cogroup(copies.groupBy(key)).applyInPandas(assign, placed.schema)
    return deeper, chosen.select("node", "centre")


def cell_tree(vectors: DataFrame, block: int, angular: bool, fan: int = FAN) -> tuple[DataFrame, DataFrame, int]:
    """(vectors with path and away, nodes with centre, levels), staged tables.

    ``vectors`` has id, grp (vectors of one grp may be compared), v (array of double) and other columns.  path has the
    cells of a vector from the root, which is its grp, to its leaf; away its distance to the centre of each (unknown,
    and so infinite, at the root).
    """
    placed = stage(vectors.withColumn("path", F.array("grp")).withColumn("away", F.array(F.lit(float("inf")))), "cells")
    made, levels = [], 1
    for _ in range(DEEPEST):
        last = F.element_at("path", -1)
        sizes = placed.groupBy(last.alias("cell")).agg(F.count("*").alias("_size"))
        large = stage(sizes.filter(F.col("_size") > (block if levels == 1 else 2 * block)), "large-cells")
        if large.isEmpty():
            discard(large)
            break
        deeper, nodes = _split(placed, large, block, fan, angular)
        rest = placed.join(large.select(F.col("cell").alias("_cell")), last == F.col("_cell"), "left_anti")
        before, placed = placed, stage(rest.unionByName(deeper), "cells")
        discard(before, large)
        made.append(nodes)
        levels += 1
    none = placed.sparkSession.createDataFrame([], "node long, centre array<double>")
    return placed, reduce(DataFrame.unionByName, made, none), levels


def tree_nodes(placed: DataFrame, centres: DataFrame) -> DataFrame:
    """grp, level, node, parent, n, away (the largest of its vectors), leaf and centre (null at the root) of every node."""
    each = placed.select("grp", F.size("path").alias("depth"), F.posexplode(F.arrays_zip("path", "away", F.array_insert("path", 1, F.lit(None).cast("long")).alias("parent"))).alias("level", "at")).filter("at.path IS NOT NULL")
    rows = each.select("grp", "level", F.col("at.path").alias("node"), F.col("at.parent").alias("parent"), F.col("at.away").alias("away"), (F.col("level") == F.col("depth") - 1).alias("leaf"))
    found = rows.groupBy("grp", "level", "node").agg(F.first("parent").alias("parent"), F.count("*").alias("n"), F.max("away").alias("away"), F.bool_or("leaf").alias("leaf"))
    return found.join(centres, "node", "left")


def children(nodes: DataFrame) -> DataFrame:
    """Nodes by the parent (column ``above``) under which a level is read; a leaf stands under itself as well."""
    columns = ["grp", "node", "n", "away", "leaf", "centre"]
    return nodes.filter("parent IS NOT NULL").select(F.col("parent").alias("above"), *columns).unionByName(nodes.filter("leaf").select(F.col("node").alias("above"), *columns))


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
