"""Operator 7: exact top-k inner products by dual-tree search over cover trees.

Method.  Vectors are turned into integers, floor(scale * x).  Data lie in blocks of bounded size by a tree of cells
around pivots; each task indexes a block of data and a group of queries in a cover tree each and walks both trees together.
For a pair of nodes with centres q, r and covering radii a, b no inner product exceeds <q, r> + a |r| + b |q| + a b; a
pair whose bound lies below the worst kth score of the query node is pruned.

First every query searches the block it lies in, which gives it a kth score to beat.  Then the queries of a cell, as one
node, go down the tree of cells, level by level, to those cells only whose bound reaches their worst kth score; of these
each query takes the cells that its own bound reaches.  Scores are exact integers; ties go to the smaller vec_id.

A node of a cover tree has a scale (``cover``), at most its radius over ``BASE``: each of its points lies within it of
the centre of its child, and the centres of its children lie at least as far apart.  Points of which ``FAN`` centres,
each the farthest from those before, do not cover a node that closely stay together as a leaf: vectors without any
structure allow no pruning by any such bound, and all pairs of them are scored.

Defined results: vectors that are null, empty or hold null or non-finite components take no part, nor do rows with a
null vec_id; vectors of other lengths are no candidates; rows that repeat a vec_id are one candidate each, and a
query's own id is never its candidate; of several vectors of one vec_id that asks, the smallest (component by component)
asks; a query with fewer than k candidates returns all; an empty table gives an empty
one; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.cells import FAN as CELL_FAN
from plumbline.llm.cells import cell_tree, children, dot, finite, tree_nodes
from plumbline.llm.common import discard, stage

BLOCK = 8192
QUERIES = 1024
#: points of a leaf, of data and of queries
LEAF, QUERY_LEAF = 32, 4
FAN, BASE = 256, 1.3
#: pairs of nodes whose bounds are computed at once
PAIRS = 1 << 16


class CoverTree:
    """Nodes as arrays: centre, radius, cover, range of points (in tree order), first child and number of children."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.points, self.leaf = points, leaf
        self.order = np.arange(len(points))
        nodes = [self._node(0, len(points), 0)]
        at = 0
        while at < len(nodes):
            nodes += self._children(nodes[at], len(nodes))
            at += 1
        column = lambda name, kind: np.array([n[name] for n in nodes], kind)
        self.centre, self.low, self.high, self.first, self.many = (column(n, np.int64) for n in ("centre", "low", "high", "first", "many"))
        self.radius, self.cover = column("radius", np.float64), column("cover", np.float64)
        self.norm = np.linalg.norm(points[self.centre], axis=1)

    def _away(self, low: int, high: int, to: int) -> np.ndarray:
        d = self.points[self.order[low:high]] - self.points[to]
        return np.sqrt((d * d).sum(axis=1))

    def _node(self, low: int, high: int, centre: int) -> dict:
        radius = float(self._away(low, high, centre).max(initial=0.0)) * (1 + 1e-12)
        return {"centre": centre, "radius": radius, "cover": radius, "low": low, "high": high, "first": -1, "many": 0}

    def _children(self, node: dict, first: int) -> list[dict]:
        low, high, centre, radius = (node[c] for c in ("low", "high", "centre", "radius"))
        if high - low <= self.leaf or radius == 0:
            return []
        nearest = self._away(low, high, centre)
        centres, owner = [centre], np.zeros(high - low, np.int64)
        while nearest.max() > radius / BASE:
            if len(centres) == FAN:
                return []
            new = int(self.order[low + int(nearest.argmax())])
            d = self._away(low, high, new)
            owner[d < nearest] = len(centres)
            nearest = np.minimum(nearest, d)
            centres.append(new)
        dealt = np.argsort(owner, kind="stable")
        self.order[low:high] = self.order[low:high][dealt]
        ends = low + np.cumsum(np.bincount(owner, minlength=len(centres)))
        starts = np.concatenate([[low], ends[:-1]])
        made = [self._node(int(a), int(b), c) for a, b, c in zip(starts, ends, centres, strict=True) if b > a]
        node |= {"cover": float(nearest.max()), "first": first, "many": len(made)}
        return made


class Best:
    """The k best (score, smaller id) of each query, in tree order of the queries."""

    def __init__(self, queries: int, k: int):
        self.score = np.full((queries, k), -np.inf)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)

    def offer(self, low: int, score: np.ndarray, ids: np.ndarray) -> None:
        """Scores of the queries from ``low`` on with the points of ``ids``."""
        k = self.score.shape[1]
        least = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else np.full(len(score), -np.inf)
        least = np.maximum(least, self.score[low : low + len(score), -1])
        for i in np.flatnonzero((score >= least[:, None]).any(axis=1)):
            some = np.flatnonzero(score[i] >= least[i])  # all that tie with the kth among them
            s = np.concatenate([self.score[low + i], score[i, some]])
            x = np.concatenate([self.id[low + i], ids[some]])
            best = np.lexsort((x, -s))[:k]
            self.score[low + i], self.id[low + i] = s[best], x[best]


def _ragged(first: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers, and first + 0, 1, ... many - 1 of each row."""
    rows = np.repeat(np.arange(len(many)), many)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(many) - many, many) + first[rows]


def search(q: np.ndarray, q_ids: np.ndarray, kth: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int) -> tuple[Best, np.ndarray]:
    """Best k of ``x`` for each of ``q``, and how many points each was scored with; scores under ``kth`` (known elsewhere) need not be found."""
    qt, xt = CoverTree(q, QUERY_LEAF), CoverTree(x, LEAF)
    qs, xs, q_ids, x_ids, floor = q[qt.order], x[xt.order], q_ids[qt.order], x_ids[xt.order], kth[qt.order]
    qc, xc = q[qt.centre], x[xt.centre]
    best, scored = Best(len(q), k), np.zeros(len(q), np.int64)
    slack = lambda up: up + np.abs(up) * 1e-12 + 1e-6

    def bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        inner = [np.einsum("ij,ij->i", qc[a[k : k + PAIRS]], xc[b[k : k + PAIRS]]) for k in range(0, len(a), PAIRS)]
        up = (np.concatenate(inner) if inner else np.empty(0)) + qt.radius[a] * xt.norm[b] + xt.radius[b] * qt.norm[a] + qt.radius[a] * xt.radius[b]
        return slack(up)

    def least(a: int) -> float:
        rows = slice(qt.low[a], qt.high[a])
        return float(np.maximum(best.score[rows, -1], floor[rows]).min())

    def score(a: int, leaves: np.ndarray) -> None:
        low, high = qt.low[a], qt.high[a]
        cols = _ragged(xt.low[leaves], xt.high[leaves] - xt.low[leaves])[1]
        got = qs[low:high] @ xs[cols].T
        got[q_ids[low:high][:, None] == x_ids[cols][None]] = -np.inf
        best.offer(low, got, x_ids[cols])
        scored[low:high] += len(cols)

    home = np.full(len(qt.centre), -1)
    for a in np.flatnonzero(qt.many == 0):  # down to one promising leaf, for a first kth score
        b = 0
        while xt.many[b]:
            below = np.arange(xt.first[b], xt.first[b] + xt.many[b])
            b = int(below[np.argmax(xc[below] @ qc[a])])
        home[a] = b
        score(a, np.array([b]))
    worst = np.array([least(a) for a in range(len(qt.centre))])

    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
    pairs = []
    while len(a):  # both trees, level by level
        keep = bound(a, b) >= worst[a]
        a, b = a[keep], b[keep]
        deep_q = (qt.many[a] > 0) & ((xt.many[b] == 0) | (qt.radius[a] > xt.radius[b]))
        deep_x = ~deep_q & (xt.many[b] > 0)
        done = ~deep_q & ~deep_x
        pairs.append((a[done], b[done]))
        rows, below = _ragged(qt.first[a[deep_q]], qt.many[a[deep_q]])
        rows2, below2 = _ragged(xt.first[b[deep_x]], xt.many[b[deep_x]])
        a, b = np.concatenate([below, a[deep_x][rows2]]), np.concatenate([b[deep_q][rows], below2])
    a, b = (np.concatenate(c) for c in zip(*pairs, strict=True))
    new = b != home[a]
    a, b = a[new], b[new]
    up = bound(a, b)
    order = np.lexsort((-up, a))
    a, b, up = a[order], b[order], up[order]
    for node, at, to in zip(*_groups(a), strict=True):  # best bounds first, in growing portions
        size = 1
        while at < to:
            reach = at + int(np.searchsorted(-up[at:to], -least(node), "right"))
            stop = min(at + size, reach)
            if stop == at:
                break
            score(node, b[at:stop])
            at, size = stop, size * 4
    back = np.argsort(qt.order)
    best.score, best.id = best.score[back], best.id[back]
    return best, scored[back]


def _groups(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of a sorted array, with where each begins and ends."""
    values, first, many = np.unique(a, return_index=True, return_counts=True)
    return values, first, first + many


FOUND = "query_id long, vec_id long, score long, scored long"


def _search_group(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    data, query = pdf[pdf["is_data"]], pdf[~pdf["is_data"]]
    if not len(data) or not len(query):
        return pd.DataFrame({c: [] for c in ("query_id", "vec_id", "score", "scored")}).astype(np.int64)
    x, q = (np.stack(p["v"].to_numpy()).astype(np.float64) for p in (data, query))
    ids = query["id"].to_numpy(np.int64)
    best, scored = search(q, ids, query["kth"].fillna(-np.inf).to_numpy(np.float64), x, data["id"].to_numpy(np.int64), k)
    i, j = np.nonzero(np.isfinite(best.score))
    return pd.DataFrame({"query_id": ids[i], "vec_id": best.id[i, j], "score": best.score[i, j].astype(np.int64), "scored": np.where(j == 0, scored[i], 0)})


def _rounds(data: DataFrame, queries: DataFrame, k: int, spread: int) -> DataFrame:
    """Search of queries (id, v, kth, cell, block) in data (id, v, cell, block), a task for each block and group of queries."""
    key = ["cell", "block", "group"]
    counted = stage(queries.groupBy("cell", "block").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("groups")), "asked-blocks")
    queries = queries.join(counted, ["cell", "block"]).withColumn("group", F.pmod(F.xxhash64("id", F.lit(7)), F.col("groups")).cast("int"))
    held = data.join(counted, ["cell", "block"]).withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    columns = [*key, "id", "v"]
    both = held.select(*columns, F.lit(None).cast("double").alias("kth"), F.lit(True).alias("is_data")).unionByName(queries.select(*columns, F.col("kth").cast("double").alias("kth"), F.lit(False).alias("is_data")))
    return both.repartition(spread, *key).groupBy(key).applyInPandas(lambda pdf: _search_group(pdf, k), FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _reached(queries: DataFrame, nodes: DataFrame, levels: int) -> DataFrame:
    """id, v, kth and the leaves (cell, blocks) that may hold one of a query's k best, its own among them.

    The queries of a leaf are a node, around the leaf's centre, with their own radius and worst kth score.  It goes down
    the tree of cells by the bound of a pair of nodes; a query then takes the leaves that its own bound reaches.
    """
    leaves = nodes.filter("leaf").select(F.col("node").alias("home"), F.col("centre").alias("q_centre"))
    groups = queries.groupBy(F.col("cell").alias("home"), "grp").agg(F.max("away").alias("q_away"), F.min(F.coalesce("kth", F.lit(float("-inf")))).alias("worst"))
    groups = groups.join(leaves, "home")
    size = lambda c: F.sqrt(dot(c, c))
    slack = lambda up: up + F.abs(up) * 1e-12 + 1e-6
    pairs = groups.join(nodes.filter("level = 0").select("grp", F.col("node").alias("above")), "grp").drop("grp")
    below = children(nodes).select("above", "node", "n", "away", "centre")
    up = slack(dot("q_centre", "centre") + F.col("q_away") * size("centre") + F.col("away") * size("q_centre") + F.col("q_away") * F.col("away"))
    for _ in range(levels - 1):
        pairs = pairs.select("home", "q_away", "worst", "q_centre", "above").join(below, "above")
        # the centre of the root and the extent around it are unknown: nothing is left out there
        pairs = pairs.filter(F.coalesce(up >= F.col("worst"), F.lit(True))).drop("above").withColumnRenamed("node", "above")
    if levels == 1:
        pairs = pairs.join(nodes.select(F.col("node").alias("above"), "n", "away", "centre"), "above")
    asked = queries.join(pairs.select(F.col("home").alias("cell"), F.col("above").alias("leaf"), "n", F.col("away").alias("leaf_away"), "centre"), "cell")
    own = slack(dot("v", "centre") + F.col("leaf_away") * size("v"))
    near = F.coalesce(own >= F.col("kth"), F.lit(True))
    return asked.filter(near).select("id", "v", "kth", F.col("cell").alias("own"), F.col("block").alias("home"), F.col("leaf").alias("cell"), "n")


def _search(vectors: DataFrame, k: int, scale: float, every: int, block: int, fan: int) -> tuple[DataFrame, DataFrame]:
    """All that the blocks found (with the number of points that each query was scored with), and the rows that took part."""
    spread = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    rows = vectors.filter(F.col("vec_id").isNotNull() & finite()).select(F.col("vec_id").cast("long").alias("id"), F.size("embedding").cast("long").alias("grp"), whole.alias("v"))
    placed, centres, levels = cell_tree(rows, block, angular=False, fan=fan)
    nodes = stage(tree_nodes(placed, centres), "cell-nodes")
    blocks = lambda n: F.ceil(F.col(n) / block).cast("int")
    inside = placed.select("id", "grp", "v", F.element_at("path", -1).alias("cell"), F.element_at("away", -1).alias("away"))
    inside = inside.join(nodes.filter("leaf").select(F.col("node").alias("cell"), blocks("n").alias("blocks")), "cell")
    data = stage(inside.withColumn("block", F.pmod(F.xxhash64("id", F.lit(5)), F.col("blocks")).cast("int")).drop("blocks"), "vector-blocks")
    discard(placed)
    asking = data.filter(F.col("id") % every == 0)
    rest = [c for c in data.columns if c not in ("id", "v")]
    queries = asking.groupBy("id").agg(F.min(F.struct("v", *rest)).alias("r")).select("id", "r.*")
    points = data.select("id", "v", "cell", "block")
    first = stage(_rounds(points, queries.withColumn("kth", F.lit(None).cast("long")), k, spread), "home-search")
    kth = _ranked(first, k).groupBy("query_id").agg(F.min("score").alias("kth"), F.count("*").alias("n"))
    kth = kth.select(F.col("query_id").alias("id"), F.when(F.col("n") == k, F.col("kth")).alias("kth"))
    asked = _reached(queries.join(kth, "id", "left"), nodes, levels).withColumn("block", F.explode(F.sequence(F.lit(0), blocks("n") - 1)))
    asked = stage(asked.filter("cell <> own OR block <> home").select("id", "v", "kth", "cell", "block"), "asked")
    second = _rounds(points, asked, k, spread)
    return first.unionByName(second), data


def top_k(vectors: DataFrame, k: int = 5, scale: float = 256.0, every: int = 50, block: int = BLOCK, fan: int = CELL_FAN) -> DataFrame:
    """query_id, rank, vec_id and score of the k best of all rows for each row whose vec_id ``every`` divides."""
    found, _ = _search(vectors, k, scale, every, block, fan)
    return _ranked(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def scored_share(vectors: DataFrame, k: int = 5, scale: float = 256.0, every: int = 50, block: int = BLOCK, fan: int = CELL_FAN) -> float:
    """The share of all pairs of a query and a row that the search scores."""
    found, data = _search(vectors, k, scale, every, block, fan)
    n = data.count()
    queries = data.filter(F.col("id") % every == 0).count()
    return (found.agg(F.sum("scored")).first()[0] or 0) / max(1, n * queries)
