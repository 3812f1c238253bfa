"""Checks of measurements, coverage and completeness; each gives rows for what is wrong, none where all is well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import ranks

WEIGHT_SLACK = 1e-3


def not_sky(is_sky: Column) -> Column:
    return ~F.coalesce(is_sky, F.lit(False))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def measurement_rules() -> dict[str, Column]:
    """Rule -> condition that breaks it, for one measurement row."""
    any_bad = lambda a, bad: F.coalesce(F.exists(a, bad), F.lit(False))
    total = F.aggregate("weights", F.lit(0.0), lambda s, w: s + w.cast("double"))
    return {
        "modes": any_bad("modes", lambda m: ~finite(m) | (m <= 0)),
        "estimated_depth": ~finite(F.col("estimated_depth")) | (F.col("estimated_depth") <= 0),
        "weights": any_bad("weights", lambda w: ~finite(w) | (w < 0)),
        "weight_sum": F.coalesce(total > 1 + WEIGHT_SLACK, F.lit(False)),
        "sigmas": any_bad("sigmas", lambda s: ~finite(s) | (s <= 0)),
    }


def broken_measurements(rows: DataFrame) -> DataFrame:
    """One row for each rule that a row outside the sky breaks: image_id, point2D_idx, rule."""
    broken = F.array_compact(F.array(*(F.when(bad, F.lit(rule)) for rule, bad in measurement_rules().items())))
    return rows.filter(not_sky(F.col("is_sky"))).select("image_id", "point2D_idx", F.explode(broken).alias("rule"))


def sensor_shape(rows: DataFrame) -> DataFrame:
    """sensor, kinds of K, of presence of confidence and of sigmas over images; consistent where each is one."""
    per = rows.groupBy("sensor").agg(
        F.countDistinct(F.size("modes")).alias("n_k"),
        F.countDistinct(F.col("confidence").isNotNull()).alias("n_confidence"),
        F.countDistinct(F.col("sigmas").isNotNull()).alias("n_sigmas"),
    )
    return per.withColumn("consistent", (F.col("n_k") == 1) & (F.col("n_confidence") == 1) & (F.col("n_sigmas") == 1))


def sigma_space_agrees(shape: DataFrame, space: str | None) -> bool:
    """A sigma space is given if and only if the rows have sigmas."""
    has = shape.filter(F.col("sigmas").isNotNull()).limit(1).count() > 0
    return has == (space is not None)


def incomplete_images(keypoints: DataFrame, rows: DataFrame) -> DataFrame:
    """image_id, n_keypoints, n_rows where the two differ."""
    a = keypoints.groupBy("image_id").agg(F.count("*").alias("n_keypoints"))
    b = rows.groupBy("image_id").agg(F.count("*").alias("n_rows"))
    both = a.join(b, "image_id", "full_outer").select("image_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_keypoints", "n_rows")))
    return both.filter("n_keypoints <> n_rows")


def missing_stems(images: DataFrame, bundles: DataFrame) -> DataFrame:
    """Stems of images that no bundle has."""
    return images.select("stem").join(bundles.select("stem"), "stem", "left_anti").distinct()


def first_missing(images: DataFrame, bundles: DataFrame, n: int = 10) -> DataFrame:
    return missing_stems(images, bundles).orderBy("stem").limit(n)


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def stem_collisions(files: DataFrame) -> DataFrame:
    return files.groupBy("stem").agg(F.count("*").alias("n")).filter("n > 1")


def bundle_problems(bundles: DataFrame, expected_hw: tuple[int, int] | None = None) -> DataFrame:
    """Shape, K and pairing rules of bundle rows: one row (image_id, rule) for each that is broken."""
    pixels, planes = F.col("h") * F.col("w"), F.col("h") * F.col("w") * F.col("k")
    wrong = lambda c, n: F.col(c).isNotNull() & (F.size(c) != n)
    rules = {
        "estimated_depth": F.col("estimated_depth").isNull() | (F.size("estimated_depth") != pixels),
        "confidence": wrong("confidence", pixels),
        "sky_mask": wrong("sky_mask", pixels),
        "means": wrong("means", planes),
        "weights": wrong("weights", planes),
        "sigmas": wrong("sigmas", planes),
        "pairing": F.col("means").isNull() != F.col("weights").isNull(),
        "lone_sigmas": F.col("sigmas").isNotNull() & F.col("means").isNull() & (F.col("k") != 1),
    }
    if expected_hw:
        rules["grid"] = (F.col("h") != expected_hw[0]) | (F.col("w") != expected_hw[1])
    broken = F.array_compact(F.array(*(F.when(bad, F.lit(rule)) for rule, bad in rules.items())))
    return bundles.select("image_id", F.explode(broken).alias("rule"))


def audit(keypoints: DataFrame, rows: DataFrame, meta: DataFrame) -> DataFrame:
    """All problems of stored sensors in one table: kind, image_id, n; rows of a sensor without a meta row are ``no_meta``."""
    known = rows.join(meta.select("sensor", "num_modes"), "sensor", "left")
    unknown = known.filter(F.col("num_modes").isNull()).groupBy("image_id").agg(F.count("*").alias("n")).select(F.lit("no_meta").alias("kind"), "image_id", "n")
    expected = known.filter(F.size("modes") != F.col("num_modes"))
    kinds = expected.groupBy("image_id").agg(F.count("*").alias("n")).select(F.lit("num_modes").alias("kind"), "image_id", "n")
    gaps = incomplete_images(keypoints, rows).select(F.lit("row_count").alias("kind"), "image_id", (F.col("n_keypoints") - F.col("n_rows")).alias("n"))
    values = broken_measurements(rows).groupBy("rule", "image_id").agg(F.count("*").alias("n")).select(F.col("rule").alias("kind"), "image_id", "n")
    return kinds.unionByName(unknown).unionByName(gaps).unionByName(values)


def audit_statistics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Informational figures of each sensor (or whatever ``keys`` are): rows, images, depth range, and the share of rows with two distinct modes."""
    log_ratio = F.abs(F.ln(F.get("modes", 1).cast("double") / F.get("modes", 0).cast("double")))
    seen = rows.filter(not_sky(F.col("is_sky")))
    figures = seen.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.countDistinct("image_id").alias("n_images"),
        F.min("estimated_depth").alias("min_depth"),
        F.max("estimated_depth").alias("max_depth"),
        F.avg((log_ratio > 1e-6).cast("double")).alias("bimodal_rate"),
    )
    return ranks.beside(figures, ranks.quantiles(seen, keys, {"median_depth": ("estimated_depth", 0.5)}), keys)
