"""Assembly of a bundle adjustment problem as tables: residuals, constant blocks, depth factors, costs.

``observations`` has image_id, point2D_idx, point3D_id (null where not triangulated), x, y; ``images`` has image_id,
frame_id, camera_id; ``config`` the image_ids that are adjusted.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import depth as D
from plumbline.functions import geometry as G
from plumbline.operators.checks import not_sky


def config_residuals(observations: DataFrame, images: DataFrame, config: DataFrame) -> DataFrame:
    """One reprojection residual for each triangulated observation of a config image."""
    seen = observations.filter(F.col("point3D_id").isNotNull())
    return seen.join(config.select("image_id"), "image_id", "left_semi").join(images, "image_id").withColumn("phase", F.lit(1))


def outside_residuals(observations: DataFrame, images: DataFrame, config: DataFrame, listed: DataFrame) -> DataFrame:
    """Residuals of listed points in images outside the config; their poses only anchor."""
    seen = observations.join(listed.select("point3D_id").distinct(), "point3D_id", "left_semi")
    return seen.join(config.select("image_id"), "image_id", "left_anti").join(images, "image_id").withColumn("phase", F.lit(2))


def residual_table(observations: DataFrame, images: DataFrame, config: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    first = config_residuals(observations, images, config)
    return first if listed is None else first.unionByName(outside_residuals(observations, images, config, listed))


def frame_flags(residuals: DataFrame, constant: DataFrame | None = None, refine: bool = True) -> DataFrame:
    """frame_id and is_constant: fixed where given, where poses are not refined, and where a frame only anchors."""
    flags = residuals.groupBy("frame_id").agg((F.min("phase") > 1).alias("anchor"), F.max((F.col("phase") > 1).cast("int")).alias("_out"))
    flags = flags.withColumn("is_constant", F.col("anchor") | (F.col("_out") > 0) | F.lit(not refine))
    if constant is not None:
        given = constant.select("frame_id").distinct().withColumn("_given", F.lit(True))
        flags = flags.join(given, "frame_id", "left").withColumn("is_constant", F.col("is_constant") | F.coalesce("_given", F.lit(False)))
    return flags.select("frame_id", "is_constant")


def camera_flags(residuals: DataFrame, constant: DataFrame | None = None, refine: bool = True) -> DataFrame:
    """camera_id and is_constant: fixed unless it serves a config image, is not given, and any intrinsics are refined."""
    flags = residuals.groupBy("camera_id").agg((F.min("phase") > 1).alias("is_constant"))
    flags = flags.withColumn("is_constant", F.col("is_constant") | F.lit(not refine))
    if constant is not None:
        given = constant.select("camera_id").distinct().withColumn("_given", F.lit(True))
        flags = flags.join(given, "camera_id", "left").withColumn("is_constant", F.col("is_constant") | F.coalesce("_given", F.lit(False)))
    return flags.select("camera_id", "is_constant")


def point_flags(residuals: DataFrame, observations: DataFrame, variable: DataFrame | None = None, constant: DataFrame | None = None) -> DataFrame:
    """point3D_id, num_obs (in config images), track_length and is_constant.

    A point that images outside the config see too is fixed, unless it is listed as variable.
    """
    tracks = observations.filter(F.col("point3D_id").isNotNull()).groupBy("point3D_id").agg(F.count("*").alias("track_length"))
    seen = residuals.groupBy("point3D_id").agg(F.count_if(F.col("phase") == 1).alias("num_obs"))
    flags = seen.join(tracks, "point3D_id")
    fixed = F.col("num_obs") < F.col("track_length")
    if variable is not None:
        flags = flags.join(variable.select("point3D_id").distinct().withColumn("_variable", F.lit(True)), "point3D_id", "left")
        fixed = fixed & F.col("_variable").isNull()
    if constant is not None:
        flags = flags.join(constant.select("point3D_id").distinct().withColumn("_constant", F.lit(True)), "point3D_id", "left")
        fixed = fixed | F.col("_constant").isNotNull()
    return flags.select("point3D_id", "num_obs", "track_length", fixed.alias("is_constant"))


def variable_points(points: DataFrame, observations: DataFrame, most_track: int = 15) -> DataFrame:
    """Points that a local adjustment frees: without an error yet (-1), or with a track of at most ``most_track``."""
    tracks = observations.filter(F.col("point3D_id").isNotNull()).groupBy("point3D_id").agg(F.count("*").alias("track_length"))
    return points.join(tracks, "point3D_id").filter((F.col("error") == -1) | (F.col("track_length") <= most_track)).select("point3D_id", "track_length")


def depth_factors(residuals: DataFrame, measurements: DataFrame, frames: DataFrame, points: DataFrame) -> DataFrame:
    """Measurements that get a depth factor: not sky, triangulated, in the problem, with something variable to move."""
    rows = residuals.filter("phase = 1").select("image_id", "point2D_idx", "frame_id", "point3D_id").join(measurements.filter(not_sky(F.col("is_sky"))), ["image_id", "point2D_idx"])
    rows = rows.join(frames.withColumnRenamed("is_constant", "pose_const"), "frame_id").join(points.select("point3D_id", F.col("is_constant").alias("point_const")), "point3D_id")
    return rows.filter(~(F.col("pose_const") & F.col("point_const"))).drop("pose_const", "point_const")


def affine_key(image_id: Column, shared: bool) -> Column:
    """One scale for the whole map (-1), or one for each image."""
    return F.lit(-1).cast("long") if shared else image_id


def median_depth_ratio(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Start of alpha: median of z over the measured depth, over rows outside the sky with both positive; 1 where none is."""
    good = not_sky(F.col("is_sky")) & (F.col("z") > 0) & (F.col("estimated_depth") > 0)
    ratio = F.median(F.when(good, F.col("z") / F.nullif(F.col("estimated_depth"), F.lit(0.0))))
    return rows.groupBy(*keys).agg(F.coalesce(ratio, F.lit(1.0)).alias("alpha"))


def rescaled(affine: DataFrame, scale: float) -> DataFrame:
    """Scales and shifts after the map was scaled: both follow."""
    return affine.withColumn("alpha", F.col("alpha") * scale).withColumn("beta", F.col("beta") * scale)


def started(affine: DataFrame, ratios: DataFrame, keys: list[str]) -> DataFrame:
    """Affine blocks got or created: those there stay, new keys start at their ratio and a shift of 0."""
    new = ratios.join(affine.select(*keys), keys, "left_anti").select(*keys, "alpha", F.lit(0.0).alias("beta"))
    return affine.unionByName(new)


def prior_cost(affine: DataFrame, sigma_alpha: float | None, sigma_beta: float | None) -> DataFrame:
    """Half the squared distance of alpha to 1 and beta to 0; the sigma given is squared as the prior's covariance."""
    alpha = F.lit(0.0) if sigma_alpha is None else F.pow((F.col("alpha") - 1) / sigma_alpha, F.lit(2.0))
    beta = F.lit(0.0) if sigma_beta is None else F.pow(F.col("beta") / sigma_beta, F.lit(2.0))
    return affine.withColumn("prior", 0.5 * (alpha + beta))


def objective_split(costs: DataFrame, keys: list[str]) -> DataFrame:
    """Cost by kind of factor: half of rho of the squared residuals (columns kind, rho)."""
    return costs.groupBy(*keys, "kind").agg(F.count("*").alias("n"), (0.5 * F.sum("rho")).alias("cost"))


def depth_costs(rows: DataFrame, space: str = "log", huber: float | None = None, sigma: float = 0.05) -> DataFrame:
    """Rows (z, modes, weights, sigmas, alpha, beta) with the factor's residual ``wh`` and its ``cost``."""
    sigmas = D.sigmas_or(F.col("sigmas"), sigma, F.col("modes"))
    rows = rows.withColumn("_s", sigmas)
    wh = D.depth_factor(F.col("z"), F.col("modes"), F.col("_s"), F.col("weights"), F.col("alpha"), F.col("beta"), space)
    rows = rows.withColumn("wh", wh).drop("_s")
    s = F.col("wh") * F.col("wh")
    return rows.withColumn("cost", 0.5 * (s if huber is None else D.robust(s, "huber", huber)))


def convention_costs(rows: DataFrame, sigma: float = 0.1) -> DataFrame:
    """Rows (rotation, translation, xyz) with the cost of a log depth factor under both orders of a pose's seven numbers.

    The depth measured is that of the point in the camera; ``cost`` reads the seven numbers as quaternion and translation,
    ``swapped`` reads them the other way round.  Null where either depth is not positive.  Only the right reading costs nothing.
    """
    z = G.depth_in_camera(F.col("rotation"), F.col("translation"), F.col("xyz"))
    p = G.pose_vector(F.col("rotation"), F.col("translation"))

    def cost(vector: Column) -> Column:
        read = G.pose_of_vector(vector)
        seen = G.depth_in_camera(read["rotation"], read["translation"], F.col("xyz"))
        wh = (F.ln(z) - F.ln(seen)) / sigma
        return F.when((z > 0) & (seen > 0), 0.5 * wh * wh)

    return rows.withColumn("cost", cost(p)).withColumn("swapped", cost(F.concat(F.slice(p, 5, 3), F.slice(p, 1, 4))))


def gauge_three_points(points: DataFrame) -> list[int]:
    """Ids of points to fix until three independent ones are: fixed points count first, then others by id.

    Each of the three is the first row, in that order, that is independent of those before it; one row a search
    reaches the driver.
    """
    tiny = 1e-12
    size = F.sqrt(F.aggregate("xyz", F.lit(0.0), lambda s, v: s + v * v))
    cross = lambda a: F.array(*(F.lit(float(a[i])) * F.get("xyz", j) - F.lit(float(a[j])) * F.get("xyz", i) for i, j in ((1, 2), (2, 0), (0, 1))))
    chosen: list = []
    while len(chosen) < 3:
        if not chosen:
            apart = size > tiny
        elif len(chosen) == 1:
            first = np.array(chosen[0].xyz)
            apart = F.sqrt(F.aggregate(cross(first), F.lit(0.0), lambda s, v: s + v * v)) > tiny * float(np.linalg.norm(first)) * size
        else:
            normal = np.cross(chosen[0].xyz, chosen[1].xyz)
            along = sum(F.lit(float(normal[i])) * F.get("xyz", i) for i in range(3))
            apart = F.abs(along) > tiny * float(np.linalg.norm(normal)) * size
        found = points.filter(apart).select("point3D_id", "xyz", "is_constant").orderBy(F.col("is_constant").desc(), "point3D_id").first()
        if found is None:
            break
        chosen.append(found)
    return [r.point3D_id for r in chosen if not r.is_constant]


def gauge_two_frames(frames: DataFrame) -> tuple[int, int, int] | None:
    """(fixed frame, second frame, fixed axis of its translation), or None where two frames cannot pin the gauge.

    Frames with rotation, translation and is_constant; the axis is that of the largest part of the baseline.
    """
    order = frames.orderBy(F.col("is_constant").desc(), "frame_id")
    first = order.first()
    if first is None:
        return None
    move = G.relative_translation(F.col("rotation"), F.col("translation"), F.lit(first.rotation), F.lit(first.translation))
    others = frames.filter(F.col("frame_id") != first.frame_id).withColumn("base", move)
    longest = F.array_max(F.transform("base", F.abs))
    found = others.filter(longest > 1e-9).orderBy("frame_id").first()
    if found is None:
        return None
    return first.frame_id, found.frame_id, int(np.argmax(np.abs(found.base)))
