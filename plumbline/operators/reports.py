"""Whole reports: reconstruction against truth, trajectory, sweep over arms; pose transfer; figures of affine blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.operators import alignment, ranks
from plumbline.operators import evaluation as E

CENTRE = ("x", "y", "z")


def camera_errors(estimated: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pos and rot (degrees) of cameras in both tables (keys, rotation, translation, camera from world, one frame of reference)."""
    ref = truth.select(*keys, F.col("rotation").alias("_r"), F.col("translation").alias("_t"))
    both = estimated.join(ref, keys)
    pos = G.norm(G.sub(G.camera_centre(F.col("rotation"), F.col("translation")), G.camera_centre(F.col("_r"), F.col("_t"))))
    return both.select(*keys, pos.alias("pos"), G.rotation_angle(F.col("rotation"), F.col("_r")).alias("rot"))


def aligned_errors(estimated: DataFrame, truth: DataFrame, groups: list[str], name: str, most_error: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(errors of each camera after its group is moved onto the truth by a similarity of camera centres, the similarities).

    Where ``most_error`` is given, a second fit is on the cameras whose centres the first brings that close, if three are.
    """
    keys = [*groups, name]
    centre = lambda df, names: df.select(*keys, *(F.get(G.camera_centre(F.col("rotation"), F.col("translation")), i).alias(n) for i, n in enumerate(names)))
    pairs = centre(estimated, alignment.SOURCE).join(centre(truth, alignment.TARGET), keys)
    fits = alignment.align(pairs, groups)
    if most_error is not None:
        near = alignment.residuals(pairs, fits, groups).filter(F.col("residual") <= most_error).drop("residual")
        again = alignment.align(near, groups)
        fits = again.unionByName(fits.join(again.select(*groups), groups, "left_anti"))
    fit = fits.select(*groups, "scale", F.col("rotation").alias("_sr"), F.col("translation").alias("_st"))
    moved = estimated.join(fit, groups).withColumn("_p", G.pose_in_similarity(F.col("scale"), F.col("_sr"), F.col("_st"), F.col("rotation"), F.col("translation")))
    return camera_errors(moved.select(*keys, F.col("_p.rotation").alias("rotation"), F.col("_p.translation").alias("translation")), truth, keys), fits


def truth_report(errors: DataFrame, groups: list[str], name: str) -> DataFrame:
    """groups, n, mean, median and maximum of position and rotation errors, and the camera of the worst position."""
    figures = [f(F.col(c)).alias(f"{c}_{n}") for c in ("pos", "rot") for n, f in (("mean", F.avg), ("max", F.max))]
    worst = F.min_by(name, F.struct(-F.round("pos", 6), F.col(name))).alias("worst")
    told = errors.groupBy(*groups).agg(F.count("*").alias("n"), *figures, worst)
    return ranks.beside(told, ranks.quantiles(errors, groups, {f"{c}_median": (c, 0.5) for c in ("pos", "rot")}), groups)


def trajectory_report(poses: DataFrame, groups: list[str], order: str, thresholds: tuple[int, ...] = (1, 5, 20)) -> DataFrame:
    """groups, pairs of neighbours, summary of their relative rotation errors, and pose AUC in percent at each threshold."""
    relative = E.relative_pose_errors(poses, groups, order)
    summary = E.error_summary(relative, groups, "rot_err")
    auc = E.pose_auc(relative.filter(F.col("pose_err").isNotNull()), groups, "pose_err", [float(t) for t in thresholds])
    wide = auc.groupBy(*groups).agg(*(F.max(F.when(F.col("threshold") == t, 100 * F.col("auc"))).alias(f"auc_{t}") for t in thresholds))
    return summary.join(wide, groups, "left")


def baseline_distance(cameras: DataFrame, groups: list[str], arm: str, baseline: str, name: str) -> DataFrame:
    """groups, arm, dbase: the median distance of an arm's camera centres to those of the baseline."""
    base = cameras.filter(F.col(arm) == baseline).select(*groups, name, *(F.col(c).alias(f"_{c}") for c in CENTRE))
    apart = F.sqrt(sum((F.pow(F.col(c) - F.col(f"_{c}"), F.lit(2.0)) for c in CENTRE[1:]), F.pow(F.col("x") - F.col("_x"), F.lit(2.0))))
    others = cameras.filter(F.col(arm) != baseline).join(base, [*groups, name])
    return ranks.quantiles(others, [*groups, arm], {"dbase": (apart, 0.5)})


def sweep_report(cameras: DataFrame, errors: DataFrame, groups: list[str], arm: str, baseline: str, name: str, tail: float) -> DataFrame:
    """groups, arm, n_cameras, dbase (null for the baseline) and the figures of errors (groups, arm, pos, rot)."""
    counted = cameras.groupBy(*groups, arm).agg(F.count("*").alias("n_cameras"))
    figures = E.error_figures(errors, [*groups, arm], {"pos": "pos_"}, [E.bad_percent("pos", tail)], {"rot_median": ("rot", 0.5), "rot_p90": ("rot", 0.9)})
    return counted.join(baseline_distance(cameras, groups, arm, baseline, name), [*groups, arm], "left").join(figures, [*groups, arm], "left")


def report_cells(columns: list[tuple[Column, int, int]]) -> Column:
    """One line of right-aligned cells (value, width, digits after the point); a dash where there is no value."""
    cell = lambda c, width, digits: F.lpad(F.coalesce(F.format_string(f"%.{digits}f", c.cast("double")), F.lit("-")), width, " ")
    # format_string writes a null as text, so nulls are replaced before it
    return F.concat(*(F.when(c.isNull(), F.lpad(F.lit("-"), w, " ")).otherwise(cell(c, w, d)) for c, w, d in columns))


def affine_spread(affine: DataFrame, groups: list[str]) -> DataFrame:
    """Mean and population standard deviation of alpha and beta."""
    return affine.groupBy(*groups).agg(F.count("*").alias("n"), *(f(c).alias(f"{c}_{n}") for c in ("alpha", "beta") for n, f in (("mean", F.avg), ("std", F.stddev_pop))))


def shared_range(pixels: DataFrame, groups: list[str], value: str = "x", share: float = 0.95) -> DataFrame:
    """The percentile of the values of all variants pooled: one end of a colour range for pictures that are compared."""
    return ranks.quantiles(pixels, groups, {"vmax": (value, share)})


def in_range(value: Column, vmax: Column) -> Column:
    """A value as a share of the range from 0 to vmax, clipped to [0, 1]."""
    return F.greatest(F.least(value / F.nullif(vmax, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def transferred_poses(dataset: DataFrame, reconstruction: DataFrame, groups: list[str], name: str) -> DataFrame:
    """All poses of a dataset (groups, name, rotation, translation) in the frame of its reconstruction.

    The similarity is that of the camera centres that both have; groups with fewer than three give no rows.
    """
    keys = [*groups, name]
    centre = lambda df, names: df.select(*keys, *(F.get(G.camera_centre(F.col("rotation"), F.col("translation")), i).alias(n) for i, n in enumerate(names)))
    fits = alignment.align(centre(dataset, alignment.SOURCE).join(centre(reconstruction, alignment.TARGET), keys), groups)
    fit = fits.select(*groups, "scale", F.col("rotation").alias("_sr"), F.col("translation").alias("_st"))
    moved = dataset.join(fit, groups).withColumn("_p", G.pose_in_similarity(F.col("scale"), F.col("_sr"), F.col("_st"), F.col("rotation"), F.col("translation")))
    return moved.select(*keys, "_p.rotation", "_p.translation").withColumn("q_wxyz", G.quaternion_of(F.col("rotation")))


def assembly_report(expected: DataFrame, files: DataFrame, models: DataFrame, groups: list[str]) -> DataFrame:
    """groups, n_missing (files of ``expected`` that are not there) and n_models; rows with something missing or more than one model."""
    keys = [*groups, "name"]
    missing = expected.select(*keys).join(files.select(*keys), keys, "left_anti").groupBy(*groups).agg(F.count("*").alias("n_missing"))
    counted = models.groupBy(*groups).agg(F.count("*").alias("n_models"))
    both = missing.join(counted, groups, "full_outer").select(*groups, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_missing", "n_models")))
    return both.filter("n_missing > 0 OR n_models > 1")


def unknown_sensors(rigs: DataFrame, frames: DataFrame) -> DataFrame:
    """Frames whose rig has a sensor, other than its reference one, without a known pose in the rig.

    ``rigs`` has rig_id, camera_id, is_reference and sensor_from_rig (null where unknown); ``frames`` frame_id and rig_id.
    """
    unknown = rigs.filter(~F.col("is_reference") & F.col("sensor_from_rig").isNull()).select("rig_id").distinct()
    return frames.join(unknown, "rig_id", "left_semi").select("frame_id")
