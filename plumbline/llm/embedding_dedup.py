"""Operator 1: near-duplicate embeddings by randomised-rotation binary codes with correction factors.

Method.  A vector, brought to length one, is turned by a random rotation; its code is the signs of the turned
components, and its correction factor f the inner product of the turned vector with the code's unit vector.  For any
other vector the inner product of that vector with the code, over f, estimates the true inner product without bias;
for a pair at the threshold t the error has a standard deviation of sqrt(1 - t^2) sqrt(1 - f^2) / (f sqrt(D - 1)).
Pairs whose estimate is more than ``BOUND`` deviations under t are passed over; all others are recomputed exactly, in
double precision.

Codes (packed, a bit a component) and factors are computed once for each vector and stored with it.  The other side of a
pair, whose role is that of a query, is turned in the task.

Vectors are compared within their label only.  Equal vectors form one class.  Classes lie in blocks of bounded size
by a tree of cells around pivots; the tree is walked together with itself, and pairs of cells that are too far apart by
the triangle inequality of angles are left out at the highest level that shows it.  Each remaining pair of blocks is
one task, which gives one row for each vector with links (its number of links there, and the smallest member it hangs
together with) and never the pairs themselves.

Defined results: a vector that is null, empty, zero or has null or non-finite components, or whose label is null,
links with nothing and is its own component; vectors of different lengths do not link; repeated rows are links of
each other; a null vec_id keeps a null component; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.cells import FAN, cell_tree, children, dot, finite, tree_nodes
from plumbline.llm.common import by_rows, discard, stage
from plumbline.llm.components import connected_components
from plumbline.operators.ranks import numbered

THRESHOLD = 0.93
BLOCK = 4096
TILE = 512
#: standard deviations: a linked pair is passed over with a chance of one in a thousand million
BOUND = 6.0


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed + dim).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def codes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Turned vectors, their signs as +-1/sqrt(D), and correction factors."""
    turned = unit @ rotation(unit.shape[1]).T
    signs = np.where(turned > 0, 1.0, -1.0) / np.sqrt(unit.shape[1])
    return turned, signs, (turned * signs).sum(axis=1)


def least_estimate(factor: np.ndarray, dim: int, threshold: float) -> np.ndarray:
    """The lower confidence bound of the estimate of a pair at the threshold."""
    spread = np.sqrt(max(0.0, 1 - threshold**2)) * np.sqrt(np.maximum(0, 1 - factor**2)) / (factor * np.sqrt(max(1, dim - 1)))
    return threshold - BOUND * spread - 1e-9


def coded(vectors: DataFrame) -> DataFrame:
    """Adds code (packed signs of the turned vector) and factor to vectors (id, grp, n, v)."""

    def run(cols):
        sizes = cols["dim"].to_numpy()
        values = cols["v"].combine_chunks() if isinstance(cols["v"], pa.ChunkedArray) else cols["v"]
        flat, at = values.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)])
        packed, factors = [b""] * len(sizes), np.zeros(len(sizes))
        for d in np.unique(sizes):
            rows = np.flatnonzero(sizes == d)
            x = flat[at[rows][:, None] + np.arange(d)]
            turned, signs, factors[rows] = codes(x / np.linalg.norm(x, axis=1, keepdims=True))
            for r, bits in zip(rows, np.packbits(turned > 0, axis=1), strict=True):
                packed[r] = bits.tobytes()
        return {c: cols[c] for c in ("id", "grp", "n", "dim", "v")} | {"code": pa.array(packed, pa.binary()), "factor": pa.array(factors)}

    return by_rows(vectors, ["id", "grp", "n", "dim", "v"], run, "id long, grp long, n long, dim int, v array<double>, code binary, factor double")


def links_between(a: np.ndarray, code: np.ndarray, factor: np.ndarray, b: np.ndarray, threshold: float):
    """For tiles of a (with packed codes and factors): (rows of the tile, boolean matrix of links to all of b)."""
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    dim = a.shape[1]
    signs = (np.unpackbits(code, axis=1, count=dim).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(dim))
    turned = codes(b / nb[:, None])[0].astype(np.float32)
    floor = least_estimate(factor, dim, threshold)
    for at in range(0, len(a), TILE):
        rows = slice(at, at + TILE)
        near = (signs[rows] @ turned.T) / factor[rows, None] >= floor[rows, None]
        count = near.sum()
        if not count:
            continue
        if count * 8 > near.size:
            near &= (a[rows] @ b.T) / (na[rows, None] * nb[None]) >= threshold
        else:
            i, j = np.nonzero(near)
            near[i, j] = (a[rows][i] * b[j]).sum(axis=1) / (na[rows][i] * nb[j]) >= threshold
        yield rows, near


def compare_blocks(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """A pair of blocks (side 1 and 2; only side 0 for a block with itself): cls, n_links, root."""
    one = pdf[pdf["side"] < 2]
    same = bool((one["side"] == 0).any())
    two = one if same else pdf[pdf["side"] == 2]
    if not len(one) or not len(two):
        return pd.DataFrame({"cls": [], "n_links": [], "root": []}).astype(np.int64)
    a, b = (np.stack(x["v"].to_numpy()).astype(np.float64) for x in (one, two))
    code = np.stack([np.frombuffer(c, np.uint8) for c in one["code"]])
    ca, cb, wa, wb = one["cls"].to_numpy(), two["cls"].to_numpy(), one["n"].to_numpy(), two["n"].to_numpy()
    out = []
    for rows, near in links_between(a, code, one["factor"].to_numpy(), b, threshold):
        if same:
            i = np.arange(rows.start, min(rows.stop, len(a)))
            near[np.arange(len(i)), i] = False
        touched_a, touched_b = near.any(axis=1), near.any(axis=0)
        if not touched_a.any():
            continue
        part = near[np.ix_(touched_a, touched_b)]
        la, lb = ca[rows][touched_a].copy(), cb[touched_b].copy()
        while True:  # the smallest member each hangs together with
            na = np.minimum(la, np.where(part, lb[None], np.iinfo(np.int64).max).min(axis=1))
            nb = np.minimum(lb, np.where(part, na[:, None], np.iinfo(np.int64).max).min(axis=0))
            if (na == la).all() and (nb == lb).all():
                break
            la, lb = na, nb
        out.append((ca[rows][touched_a], part @ wb[touched_b], la))
        out.append((cb[touched_b], np.zeros(len(lb), np.int64) if same else wa[rows][touched_a] @ part, lb))
    if not out:
        return pd.DataFrame({"cls": [], "n_links": [], "root": []}).astype(np.int64)
    cls, n, root = (np.concatenate(x) for x in zip(*out, strict=True))
    return pd.DataFrame({"cls": cls, "n_links": n, "root": root}).groupby(["cls", "root"], as_index=False)["n_links"].sum()[["cls", "n_links", "root"]]


def _near_cells(nodes: DataFrame, levels: int, threshold: float) -> DataFrame:
    """Pairs of leaves (cell, other: each pair once) that may hold a link, found level by level from the roots."""
    roots = nodes.filter("level = 0").select("node")
    pairs = roots.select(F.col("node").alias("cell"), F.col("node").alias("other"))
    below = children(nodes)
    side = lambda x: below.select(F.col("above").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in ("node", "away", "centre")))
    size = lambda c: F.sqrt(dot(c, c))
    cosine = dot("cell_centre", "other_centre") / (size("cell_centre") * size("other_centre"))
    angle = F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0)))
    reach = F.col("cell_away") + F.col("other_away") + float(np.arccos(threshold)) + 1e-6
    for _ in range(levels - 1):
        pairs = pairs.join(side("cell"), "cell").join(side("other"), "other").filter("cell <> other OR cell_node <= other_node")
        pairs = pairs.filter(F.coalesce(angle <= reach, F.lit(True)))
        pairs = pairs.select(F.least("cell_node", "other_node").alias("cell"), F.greatest("cell_node", "other_node").alias("other"))
    return pairs


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, embedding, label)."""
    usable = F.col("label").isNotNull() & finite() & F.exists("embedding", lambda x: x != 0)
    same = ["h1", "h2"]  # equal vectors of one label, by 128 bits
    usable_rows = vectors.filter(usable).select("vec_id", F.xxhash64("label", "embedding").alias("h1"), F.xxhash64(F.lit(1), "label", "embedding").alias("h2"), "label", "embedding")
    classes = usable_rows.groupBy(*same).agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.first("label").alias("label"), F.first("embedding").cast("array<double>").alias("v"))
    classes = numbered(classes.select(*same, "n", "least", F.xxhash64("label", F.size("v")).alias("grp"), F.size("v").alias("dim"), "v"), [F.col("h1").asc(), F.col("h2").asc()], "id")
    placed, centres, levels = cell_tree(coded(classes), block, angular=True, fan=fan)
    nodes = stage(tree_nodes(placed, centres), "cell-nodes")
    pairs = _near_cells(nodes, levels, threshold)

    blocks = nodes.filter("leaf").select(F.col("node").alias("cell"), F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    tasks = pairs.join(blocks.withColumnRenamed("blocks", "cell_blocks"), "cell").join(blocks.select(F.col("cell").alias("other"), F.col("blocks").alias("other_blocks")), "other")
    tasks = tasks.select("cell", "other", "other_blocks", upto("cell_blocks").alias("i")).select("cell", "other", "i", upto("other_blocks").alias("j")).filter("cell <> other OR i <= j")
    tasks = stage(tasks, "block-pairs")
    inside = placed.select(F.col("id").alias("cls"), F.element_at("path", -1).alias("cell"), "n", "v", "code", "factor").join(blocks, "cell")
    inside = inside.withColumn("i", F.pmod(F.xxhash64("cls", F.lit(5)), F.col("blocks")).cast("int")).drop("blocks")
    itself = (F.col("cell") == F.col("other")) & (F.col("i") == F.col("j"))
    key = ["cell", "other", "i", "j"]
    left = inside.join(tasks, ["cell", "i"]).withColumn("side", F.when(itself, 0).otherwise(1))
    right = inside.withColumnsRenamed({"cell": "other", "i": "j"}).join(tasks, ["other", "j"]).filter(~itself).withColumn("side", F.lit(2))
    columns = [*key, "cls", "n", "v", "code", "factor", "side"]
    spread = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    compared = left.select(columns).unionByName(right.select(columns)).repartition(spread, *key).groupBy(key).applyInPandas(lambda pdf: compare_blocks(pdf, threshold), "cls long, n_links long, root long")
    compared = stage(compared, "vector-links")

    labels = connected_components(compared.filter("cls <> root").select(F.col("cls").alias("u"), F.col("root").alias("v")))
    own = classes.select(*same, F.col("id").alias("cls"), "n", "least")
    least = labels.join(own.select(F.col("cls").alias("node"), "least"), "node").groupBy("component").agg(F.min("least").alias("component_id"))
    component = labels.join(least, "component").select(F.col("node").alias("cls"), "component_id")
    links = compared.groupBy("cls").agg(F.sum("n_links").alias("others"))
    found = own.join(links, "cls", "left").join(component, "cls", "left")
    found = found.select(*same, (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    found = stage(found, "class-links")  # written, so that the rows of a vector that very many share can be split over tasks
    discard(placed, nodes, tasks, compared, classes, labels)
    out = usable_rows.select("vec_id", *same).join(found, same).select("vec_id", "n_links", "component_id")
    others = vectors.filter(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    # rows without an id have no component; a class of such rows alone has none to give
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    out = out.unionByName(others).select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
