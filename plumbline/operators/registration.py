"""Triangulation, resection and two-view geometry of a whole map at once, from aggregated moment matrices.

A point, an image or a pair of images is found from the sum, over what is known of it, of outer products of linear
equations: a 4x4 matrix for a point (each observation gives two equations), a 12x12 one for an image (each point it sees
gives two, and the matrix consists of four 4x4 sums), a 9x9 one for a pair (each match gives one).  The solution is the
eigenvector of the smallest eigenvalue, taken in batches.  Sums combine on the map side, so a point that very many images
see, or an image that sees very many points, is no large group anywhere.

Wrong observations are met by hypotheses: each row takes part in those that a hash of it draws, about ``draw`` rows a
hypothesis, and hypothesis 0 takes all.  One aggregation makes the models of all of them, a second counts for each the rows
that agree with it, and the best is made again from those rows.

That is how points and images of very many rows are found.  All others are found by ``groups``: their rows are dealt by point or
image, and a task does the same for whole groups in arrays.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.operators import groups
from plumbline.staging import discard, staged

Fit = Callable[[np.ndarray], np.ndarray]


def _model(fit: Fit, sums: list[str]) -> Column:
    """The models of rows of sums: ``fit`` maps (n, sums) to (n, size); a model with a value that is not finite is null."""

    @F.pandas_udf("array<double>")
    def solve(cells: pd.DataFrame) -> pd.Series:
        values = cells.to_numpy(np.float64)
        out = np.full(len(values), None, object)
        known = np.flatnonzero(np.isfinite(values).all(axis=1))
        if len(known):
            models = fit(values[known])
            for at, model in zip(known, models, strict=True):
                out[at] = model if np.isfinite(model).all() else None
        return pd.Series(out)

    return solve(F.struct(*sums))


def robust_models(
    rows: DataFrame, keys: list[str], identity: list[str], terms: list[Column], fit: Fit, error: Callable[[Column], Column], most_error: float, least: int, hypotheses: int = 32, draw: int = 8, refits: int = 2
) -> DataFrame:
    """keys, model (array of double), n, n_inliers and rms (of the inliers) of every group with a model.

    ``terms`` are what is summed, ``fit`` makes models of the sums, ``error`` is a row's error under a model (null where
    it cannot agree), ``least`` the rows that a model needs, ``identity`` the columns by whose hash rows are drawn.
    """
    names = [f"_s{i}" for i in range(len(terms))]
    ready = rows.select("*", *(t.alias(n) for t, n in zip(terms, names, strict=True)))
    counted = rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least)
    ready = staged(ready.join(counted, keys), "equations")
    total = [F.sum(n).alias(n) for n in names]

    chance = lambda h: F.pmod(F.xxhash64(*identity, h), F.lit(1 << 20)) * F.col("_n")
    drawn = F.filter(F.sequence(F.lit(1), F.lit(hypotheses)), lambda h: (chance(h) < draw << 20) & (F.col("_n") > draw))
    sums = ready.select(*keys, F.explode(F.concat(F.array(F.lit(0)), drawn)).alias("_h"), *names).groupBy(*keys, "_h").agg(F.count("*").alias("_m"), *total)
    models = sums.filter(F.col("_m") >= least).select(*keys, "_h", _model(fit, names).alias("model")).filter(F.col("model").isNotNull())
    models = models.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_h", "model"))).alias("_of"))
    models = staged(models.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(hypotheses)), lambda h: F.try_element_at("_of", h)).alias("_models")), "hypotheses")

    judged = ready.drop(*names).join(models, keys).select(*keys, F.transform("_models", error).alias("_e"))
    each = range(hypotheses + 1)
    agrees = lambda h: F.get("_e", h) <= most_error
    tallies = [F.count_if(agrees(h)).alias(f"_c{h}") for h in each] + [F.sum(F.when(agrees(h), F.get("_e", h) * F.get("_e", h))).alias(f"_q{h}") for h in each]
    best = F.array_max(F.array(*(F.struct(F.col(f"_c{h}").alias("n"), (-F.coalesce(f"_q{h}", F.lit(0.0))).alias("q"), F.lit(-h).alias("h")) for h in each)))
    chosen = judged.groupBy(*keys).agg(*tallies).select(*keys, best.alias("_best")).join(models, keys)
    now = staged(chosen.select(*keys, F.get("_models", -F.col("_best.h")).alias("model")).filter(F.col("model").isNotNull()), "chosen")
    discard(models)

    held = []
    for turn in range(refits + 1):
        e = error(F.col("model"))
        told = ready.join(now, keys).withColumn("_e", e).withColumn("_in", F.coalesce(F.col("_e") <= most_error, F.lit(False)))
        inner = [F.sum(F.when(F.col("_in"), F.col(n))).alias(n) for n in names] if turn < refits else []
        told = told.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("_in").alias("n_inliers"), F.sqrt(F.avg(F.when(F.col("_in"), F.col("_e") * F.col("_e")))).alias("rms"), *inner)
        told = told.join(now, keys).withColumn("_turn", F.lit(turn))
        told = staged(told, "judged")
        held.append(told)
        discard(now)
        if turn < refits:
            again = F.when(F.col("n_inliers") >= least, _model(fit, names))
            now = staged(told.select(*keys, F.coalesce(again, F.col("model")).alias("model")), "refitted")
    discard(ready)
    what = F.struct("n_inliers", (-F.coalesce("rms", F.lit(0.0))).alias("_q"), "_turn", "model", "n", "rms")
    every = held[0].select(*keys, what.alias("_w"))
    for other in held[1:]:
        every = every.unionByName(other.select(*keys, what.alias("_w")))
    found = staged(every.groupBy(*keys).agg(F.max("_w").alias("_w")).select(*keys, "_w.model", "_w.n", "_w.n_inliers", "_w.rms"), "models")
    discard(*held)
    return found


def robust_models_by_size(rows: DataFrame, keys: list[str], identity: list[str], terms: list[Column], fit: Fit, error: Callable[[Column], Column], spec: groups.InTask, *options) -> tuple[DataFrame, DataFrame | None]:
    """``robust_models`` of distinct rows with ``also`` (null for large groups), and the rows of large groups, if any are."""
    large = staged(rows.groupBy(*keys).count().filter(F.col("count") > groups.MOST_ROWS).select(*keys), "large-groups")
    if large.isEmpty():
        discard(large)
        return staged(groups.models_in_tasks(rows, keys, identity, spec, fit, *options), "models"), None
    few = F.broadcast(large)  # one row for so many rows
    whole = staged(rows.join(few, keys, "left_semi").distinct(), "large")
    by_tables = robust_models(whole, keys, identity, terms, fit, error, *options)
    in_tasks = groups.models_in_tasks(rows.join(few, keys, "left_anti"), keys, identity, spec, fit, *options)
    both = staged(in_tasks.unionByName(by_tables.withColumn("also", F.lit(None).cast("double"))), "models")
    discard(by_tables, large)
    return both, whole


def _upper(n: int) -> list[tuple[int, int]]:
    return [(i, k) for i in range(n) for k in range(i, n)]


def _outer(v: list[Column], scale: Column | None = None) -> list[Column]:
    return [v[i] * v[k] if scale is None else scale * v[i] * v[k] for i, k in _upper(len(v))]


def symmetric(sums: np.ndarray, n: int) -> np.ndarray:
    """(rows, n, n) symmetric matrices of their upper triangles."""
    m = np.zeros((len(sums), n, n))
    for c, (i, k) in enumerate(_upper(n)):
        m[:, i, k] = m[:, k, i] = sums[:, c]
    return m


def _pixel_error(c: Column) -> Column:
    """Distance in pixels of a point in camera coordinates from where it is seen; null behind the camera."""

    def of(c: Column) -> Column:
        z = F.get(c, 2)
        return F.when(z > 1e-9, F.hypot(F.col("fx") * F.get(c, 0) / z + F.col("cx") - F.col("x"), F.col("fy") * F.get(c, 1) / z + F.col("cy") - F.col("y")))

    return G.bound(of)(c)


def _apart(c: list[np.ndarray], x: list[np.ndarray]) -> np.ndarray:
    """``_pixel_error`` of arrays: camera coordinates, and x, y, fx, fy, cx, cy."""
    at, up, fx, fy, cx, cy = x
    return np.where(c[2] > 1e-9, np.hypot(fx * c[0] / c[2] + cx - at, fy * c[1] / c[2] + cy - up), np.nan)


def _moved(r: np.ndarray, t: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
    """R x + t, with a row a number."""
    return [r[3 * i] * x[0] + r[3 * i + 1] * x[1] + r[3 * i + 2] * x[2] + t[i] for i in range(3)]


def _products(v: list[np.ndarray]) -> np.ndarray:
    return np.stack([v[i] * v[k] for i, k in _upper(len(v))], axis=1)


def _ray() -> tuple[Column, Column]:
    return (F.col("x") - F.col("cx")) / F.col("fx"), (F.col("y") - F.col("cy")) / F.col("fy")


PIXEL = ["x", "y", "fx", "fy", "cx", "cy"]


# ---- points
@dataclass
class Triangulation:
    most_error: float = 4.0
    least_angle: float = 1.5
    hypotheses: int = 32
    draw: int = 2
    refits: int = 2


def points_of(sums: np.ndarray) -> np.ndarray:
    """World points of sums of a 4x4 moment matrix; not finite where the rays do not meet."""
    values, vectors = np.linalg.eigh(symmetric(sums, 4))
    h = vectors[:, :, 0]
    far = (np.abs(h[:, 3]) < 1e-12) | (values[:, 1] <= 1e-12 * values[:, 3])
    return np.where(far[:, None], np.nan, h[:, :3] / np.where(far, 1.0, h[:, 3])[:, None])


def triangulate(reproj: DataFrame, frames: DataFrame, options: Triangulation | None = None) -> DataFrame:
    """point3D_id, xyz, n, n_inliers, rms (pixels) and angle (degrees) of every point that two of ``frames`` agree on.

    ``reproj`` has frame_id, point3D_id, x, y and intrinsics; ``frames`` the posed frames (frame_id, rotation, translation).
    The angle is the largest at the point between the ray of the inlier of the smallest frame_id and another; a point
    under ``least_angle`` is left out.  Rows with nulls take no part.
    """
    o = options or Triangulation()
    rows = reproj.select("frame_id", "point3D_id", *PIXEL).dropna().join(frames.select("frame_id", "rotation", "translation"), "frame_id")
    u, v = _ray()
    scale = F.sqrt(1 + u * u + v * v)
    third = [F.get("rotation", 6), F.get("rotation", 7), F.get("rotation", 8), F.get("translation", 2)]
    line = lambda w, k: F.array(*((w * third[i] - (F.get("rotation", 3 * k + i) if i < 3 else F.get("translation", k))) / scale for i in range(4)))
    of = lambda c: [F.get(c, i) for i in range(4)]
    terms = [p + q for p, q in zip(_outer(of(line(u, 0))), _outer(of(line(v, 1))), strict=True)]
    error = lambda m: _pixel_error(G.add(G.apply(F.col("rotation"), m), F.col("translation")))
    numbers = [*(F.col(c) for c in PIXEL), *(F.get("rotation", i) for i in range(9)), *(F.get("translation", i) for i in range(3))]
    spec = groups.InTask(numbers, _point_terms, _point_error, 3, "frame_id", _widest)
    models, large = robust_models_by_size(rows, ["point3D_id"], ["frame_id", "x", "y"], terms, points_of, error, spec, o.most_error, 2, o.hypotheses, o.draw, o.refits)
    found = models.filter("n_inliers >= 2").select("point3D_id", F.col("model").alias("xyz"), "n", "n_inliers", "rms", F.col("also").alias("angle"))
    if large is not None:
        seen = large.join(found.select("point3D_id", "xyz"), "point3D_id").filter(error(F.col("xyz")) <= o.most_error)
        seen = seen.select("point3D_id", "frame_id", "xyz", G.camera_centre(F.col("rotation"), F.col("translation")).alias("_c"))
        pivot = seen.groupBy("point3D_id").agg(F.min_by("_c", "frame_id").alias("_p"))
        angle = G.direction_angle(G.sub(F.col("_c"), F.col("xyz")), G.sub(F.col("_p"), F.col("xyz")))
        wide = seen.join(pivot, "point3D_id").groupBy("point3D_id").agg(F.max(angle).alias("_wide"))
        found = found.join(wide, "point3D_id", "left").withColumn("angle", F.coalesce("angle", "_wide")).drop("_wide")
    held = staged(found.filter(F.col("angle") >= o.least_angle), "triangulated")
    discard(models, *([] if large is None else [large]))
    return held


def _point_terms(x: np.ndarray) -> np.ndarray:
    """Products of the two lines of each observation, as summed for a point."""
    r, t = x[6:15], x[15:18]
    u, v = (x[0] - x[4]) / x[2], (x[1] - x[5]) / x[3]
    scale = np.sqrt(1 + u * u + v * v)
    third = [r[6], r[7], r[8], t[2]]
    line = lambda w, k: [(w * third[i] - (r[3 * k + i] if i < 3 else t[k])) / scale for i in range(4)]
    return _products(line(u, 0)) + _products(line(v, 1))


def _point_error(model: np.ndarray, x: np.ndarray) -> np.ndarray:
    return _apart(_moved(x[6:15], x[15:18], model.T), x[:6])


def _widest(x: np.ndarray, frame: np.ndarray, model: np.ndarray, inner: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The largest angle between the ray of the inlier of the smallest frame and another; not a number where there is none."""
    r, t = x[6:15], x[15:18]
    ray = np.stack([-(r[i] * t[0] + r[3 + i] * t[1] + r[6 + i] * t[2]) for i in range(3)], axis=1) - model
    n = np.diff(np.append(first, len(frame)))
    by = np.lexsort((frame, ~inner, np.repeat(np.arange(len(n)), n)))  # the inlier of the smallest frame comes first in its group
    pivot = np.repeat(ray[by[first]], n, axis=0)
    a, b = np.linalg.norm(ray, axis=1), np.linalg.norm(pivot, axis=1)
    angle = np.degrees(np.arccos(np.clip((ray * pivot).sum(axis=1) / np.maximum(a * b, 1e-300), -1, 1)))
    widest = np.maximum.reduceat(np.where(inner & (a >= 1e-9) & (b >= 1e-9), angle, -1.0), first)
    return np.where(widest < 0, np.nan, widest)


# ---- images
@dataclass
class Resection:
    most_error: float = 12.0
    least_inliers: int = 6
    least_share: float = 0.25
    hypotheses: int = 128
    draw: int = 7
    refits: int = 2


def poses_of(sums: np.ndarray) -> np.ndarray:
    """Rotation (9) and translation (3) of frames from 4 times 10 sums; not finite where points leave the pose open.

    The sums are those of X X', u X X', v X X' and (u u + v v) X X' over points X = (x, y, z, 1) seen at the ray (u, v, 1).
    Points are centred and scaled first, by sums that are among these.
    """
    a, bu, bv, c = (symmetric(sums[:, 10 * i : 10 * i + 10], 4) for i in range(4))
    n = np.maximum(a[:, 3, 3], 1)
    mean = a[:, :3, 3] / n[:, None]
    spread = np.trace(a[:, :3, :3], axis1=1, axis2=2) / n - (mean**2).sum(axis=1)
    s = np.sqrt(3 / np.maximum(spread, 1e-300))
    t = np.zeros_like(a)
    t[:, [0, 1, 2], [0, 1, 2]] = s[:, None]
    t[:, :3, 3] = -s[:, None] * mean
    t[:, 3, 3] = 1
    a, bu, bv, c = (t @ m @ t.transpose(0, 2, 1) for m in (a, bu, bv, c))
    m = np.zeros((len(a), 12, 12))
    m[:, :4, :4] = m[:, 4:8, 4:8] = a
    m[:, :4, 8:] = m[:, 8:, :4] = -bu
    m[:, 4:8, 8:] = m[:, 8:, 4:8] = -bv
    m[:, 8:, 8:] = c
    open_ = ~np.isfinite(m).all(axis=(1, 2)) | (spread <= 0)
    m[open_] = np.eye(12)
    values, vectors = np.linalg.eigh(m)
    p = vectors[:, :, 0].reshape(-1, 3, 4) @ t
    p[~np.isfinite(p).all(axis=(1, 2))] = 0
    left, size, right = np.linalg.svd(p[:, :, :3])
    turn = left @ right
    sign = np.sign(np.linalg.det(turn))
    scale = sign * size.mean(axis=1)
    open_ |= (values[:, 1] <= 1e-9 * values[:, -1]) | (size[:, 2] <= 1e-6 * size[:, 0])
    moved = p[:, :, 3] / np.where(open_, 1.0, scale)[:, None]
    return np.where(open_[:, None], np.nan, np.concatenate([(sign[:, None, None] * turn).reshape(-1, 9), moved], axis=1))


def resect(reproj: DataFrame, points: DataFrame, options: Resection | None = None) -> DataFrame:
    """frame_id, rotation, translation, n, n_inliers and rms (pixels) of every frame that its points determine.

    A frame needs ``least_inliers`` points (six at least, not all in one plane) and ``least_share`` of those it sees.
    ``points`` has point3D_id and xyz; rows with nulls take no part.
    """
    o = options or Resection()
    rows = reproj.select("frame_id", "point3D_id", *PIXEL).dropna().join(points.select("point3D_id", "xyz"), "point3D_id")
    u, v = _ray()
    whole = [F.get("xyz", 0), F.get("xyz", 1), F.get("xyz", 2), F.lit(1.0)]
    terms = [t for scale in (None, u, v, u * u + v * v) for t in _outer(whole, scale)]

    def error(m: Column) -> Column:
        return _pixel_error(G.add(G.apply(F.slice(m, 1, 9), F.col("xyz")), F.slice(m, 10, 3)))

    least = max(6, o.least_inliers)
    spec = groups.InTask([*(F.col(c) for c in PIXEL), *(F.get("xyz", i) for i in range(3))], _pose_terms, _pose_error, 12, "point3D_id")
    models, large = robust_models_by_size(rows, ["frame_id"], ["point3D_id", "x", "y"], terms, poses_of, error, spec, o.most_error, 6, o.hypotheses, o.draw, o.refits)
    discard(*([] if large is None else [large]))
    found = models.filter((F.col("n_inliers") >= least) & (F.col("n_inliers") >= o.least_share * F.col("n")))
    return found.select("frame_id", F.slice("model", 1, 9).alias("rotation"), F.slice("model", 10, 3).alias("translation"), "n", "n_inliers", "rms")


def _pose_terms(x: np.ndarray) -> np.ndarray:
    """The four times ten products of each point, as summed for a frame."""
    u, v = (x[0] - x[4]) / x[2], (x[1] - x[5]) / x[3]
    w = _products([x[6], x[7], x[8], np.ones_like(u)])
    return np.concatenate([w, u[:, None] * w, v[:, None] * w, (u * u + v * v)[:, None] * w], axis=1)


def _pose_error(model: np.ndarray, x: np.ndarray) -> np.ndarray:
    return _apart(_moved(model.T[:9], model.T[9:], x[6:9]), x[:6])


# ---- pairs of images
@dataclass
class TwoView:
    most_error: float = 4.0
    least_inliers: int = 8
    hypotheses: int = 96
    draw: int = 9
    refits: int = 2


def essentials_of(sums: np.ndarray) -> np.ndarray:
    """Essential matrices (9, by rows, of norm one) of sums of a 9x9 moment matrix of products of rays."""
    values, vectors = np.linalg.eigh(symmetric(sums, 9))
    e = vectors[:, :, 0].reshape(-1, 3, 3)
    left, size, right = np.linalg.svd(e)
    mid = (size[:, 0] + size[:, 1]) / 2
    near = (left * np.stack([mid, mid, np.zeros_like(mid)], axis=1)[:, None, :]) @ right
    near /= np.maximum(np.linalg.norm(near, axis=(1, 2)), 1e-300)[:, None, None]
    open_ = values[:, 1] <= 1e-9 * values[:, -1]
    return np.where(open_[:, None], np.nan, near.reshape(-1, 9))


def four_poses(e: np.ndarray) -> np.ndarray:
    """(n, 4, 12): the four poses of the second camera in the first one's frame that an essential matrix leaves."""
    left, _, right = np.linalg.svd(e.reshape(-1, 3, 3))
    left *= np.sign(np.linalg.det(left))[:, None, None]
    right *= np.sign(np.linalg.det(right))[:, None, None]
    quarter = np.array([[0.0, -1, 0], [1, 0, 0], [0, 0, 1]])
    turns, move = (left @ quarter @ right, left @ quarter.T @ right), left[:, :, 2]
    return np.stack([np.concatenate([r.reshape(-1, 9), s * move], axis=1) for r in turns for s in (1, -1)], axis=1)


def relative_poses(matches: DataFrame, options: TwoView | None = None) -> DataFrame:
    """id_a, id_b, rotation, translation (of length one), n, n_inliers, rms (pixels), n_front and angle of every pair with a geometry.

    ``matches`` has id_a, id_b, match_id, the rays ua, va, ub, vb (normalised coordinates) and the focal length in pixels;
    pairs of which all matches lie on one plane are left out.  ``angle`` is the mean angle (degrees) between an inlier's rays.  Of the four poses of an essential matrix it is the one
    that puts the most inliers in front of both cameras.
    """
    o = options or TwoView()
    rows = matches.select("id_a", "id_b", "match_id", "ua", "va", "ub", "vb", "focal").dropna()
    a, b = [F.col("ua"), F.col("va"), F.lit(1.0)], [F.col("ub"), F.col("vb"), F.lit(1.0)]

    def error(m: Column) -> Column:
        """First-order distance to the epipolar lines, in pixels."""
        of_a = [sum((F.get(m, 3 * i + k) * a[k] for k in range(1, 3)), F.get(m, 3 * i) * a[0]) for i in range(3)]
        of_b = [sum((F.get(m, 3 * k + i) * b[k] for k in range(1, 3)), F.get(m, i) * b[0]) for i in range(3)]
        off = b[0] * of_a[0] + b[1] * of_a[1] + of_a[2]
        return F.col("focal") * F.abs(off) / F.sqrt(of_a[0] * of_a[0] + of_a[1] * of_a[1] + of_b[0] * of_b[0] + of_b[1] * of_b[1] + 1e-300)

    rows = rows.withColumn("_x", F.array(*(x * y for x in b for y in a)))
    terms = _outer([F.get("_x", i) for i in range(9)])
    keys = ["id_a", "id_b"]
    models = robust_models(rows, keys, ["match_id"], terms, essentials_of, error, o.most_error, 8, o.hypotheses, o.draw, o.refits)

    @F.pandas_udf("array<array<double>>")
    def poses(e: pd.Series) -> pd.Series:
        return pd.Series([list(map(list, p)) for p in four_poses(np.stack(e.to_numpy()))] if len(e) else [])

    judged = rows.join(models.filter(F.col("n_inliers") >= max(8, o.least_inliers)).withColumn("_poses", poses("model")), keys).filter(error(F.col("model")) <= o.most_error)

    def front(p: Column) -> Column:
        turned, move = G.apply(F.slice(p, 1, 9), F.array(*a)), F.slice(p, 10, 3)
        cross = lambda x, y: [F.get(x, i) * F.get(y, j) - F.get(x, j) * F.get(y, i) for i, j in ((1, 2), (2, 0), (0, 1))]
        one, two = cross(F.array(*b), turned), cross(F.array(*b), move)
        near = -sum((x * y for x, y in zip(one[1:], two[1:], strict=True)), one[0] * two[0]) / (sum((x * x for x in one[1:]), one[0] * one[0]) + 1e-300)
        return (near > 0) & (near * F.get(turned, 2) + F.get(move, 2) > 0)

    apart = lambda p: G.direction_angle(G.apply(F.slice(p, 1, 9), F.array(*a)), F.array(*b))
    counts = [F.count_if(front(F.get("_poses", i))).alias(f"_f{i}") for i in range(4)] + [F.avg(apart(F.get("_poses", i))).alias(f"_a{i}") for i in range(4)]
    told = judged.groupBy(*keys).agg(*counts)
    best = F.array_max(F.array(*(F.struct(F.col(f"_f{i}").alias("n_front"), F.lit(-i).alias("i"), F.col(f"_a{i}").alias("angle")) for i in range(4))))
    told = told.select(*keys, best.alias("_b")).join(models.withColumn("_poses", poses("model")), keys).withColumn("_p", F.get("_poses", -F.col("_b.i")))
    return told.select(*keys, F.slice("_p", 1, 9).alias("rotation"), F.slice("_p", 10, 3).alias("translation"), "n", "n_inliers", "rms", F.col("_b.n_front").alias("n_front"), F.col("_b.angle").alias("angle"))
