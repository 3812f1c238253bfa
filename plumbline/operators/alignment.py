"""Similarity alignment of paired points (Umeyama, 1991), plain and with one trimming pass, for many groups at once.

The 16 moments of each group come from one aggregation, so only one row a group meets the 3x3 decomposition.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import geometry as G

SOURCE, TARGET = ("sx", "sy", "sz"), ("dx", "dy", "dz")
MOMENTS = [f"c{i}{j}" for i in range(3) for j in range(3)]


def similarity(cov: np.ndarray, spread: float, mu_s: np.ndarray, mu_d: np.ndarray, with_scale: bool) -> tuple[float, np.ndarray, np.ndarray]:
    """Scale, rotation and translation from the cross-covariance (target by source) and the source's variance."""
    left, values, right = np.linalg.svd(cov)
    sign = np.ones(3)
    if np.linalg.det(left) * np.linalg.det(right) < 0:
        sign[2] = -1.0
    rotation = (left * sign) @ right
    scale = float((values * sign).sum() / spread) if with_scale else 1.0
    return scale, rotation, mu_d - scale * rotation @ mu_s


def align(pairs: DataFrame, keys: list[str], with_scale: bool = True) -> DataFrame:
    """keys, n, scale, rotation (9) and translation (3) with dst ~ scale R src + t; groups of fewer than 3 pairs give none."""
    means = pairs.groupBy(*keys).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m_{c}") for c in (*SOURCE, *TARGET))).filter("n >= 3")
    centred = pairs.join(means, keys) if keys else pairs.crossJoin(F.broadcast(means))
    away = lambda c: F.col(c) - F.col(f"m_{c}")
    cross = [F.avg(away(TARGET[i]) * away(SOURCE[j])).alias(f"c{i}{j}") for i in range(3) for j in range(3)]
    spread = F.avg(sum((away(c) * away(c) for c in SOURCE[1:]), away(SOURCE[0]) * away(SOURCE[0]))).alias("spread")
    held = [F.first("n").alias("n"), *(F.first(f"m_{c}").alias(f"m_{c}") for c in (*SOURCE, *TARGET))]
    moments = centred.groupBy(*keys).agg(*held, *cross, spread)

    @F.pandas_udf("struct<scale: double, rotation: array<double>, translation: array<double>>")
    def solve(row: pd.DataFrame) -> pd.DataFrame:
        out = [similarity(r[:9].reshape(3, 3), r[9], r[10:13], r[13:16], with_scale) for r in row.to_numpy(np.float64)]
        return pd.DataFrame({"scale": [o[0] for o in out], "rotation": [o[1].ravel().tolist() for o in out], "translation": [o[2].tolist() for o in out]})

    solved = moments.withColumn("_fit", solve(F.struct(*MOMENTS, "spread", *(f"m_{c}" for c in (*SOURCE, *TARGET)))))
    return solved.select(*keys, "n", "_fit.*")


def residuals(pairs: DataFrame, fits: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs with the distance ``residual`` of the target to the moved source."""
    joined = pairs.join(fits.drop("n"), keys) if keys else pairs.crossJoin(F.broadcast(fits.drop("n")))  # one row without keys
    moved = G.apply_similarity(F.col("scale"), F.col("rotation"), F.col("translation"), F.array(*SOURCE))
    return joined.withColumn("residual", G.norm(G.sub(F.array(*TARGET), moved))).drop("scale", "rotation", "translation")


def align_robust(pairs: DataFrame, keys: list[str], with_scale: bool = True, trim: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """Fits after one trimming pass, and pairs with ``residual`` of the first fit and ``inlier``.

    Pairs with a residual over ``trim`` times the median are dropped and the rest fitted once more, where at least
    three are left and any was dropped.
    """
    first = align(pairs, keys, with_scale)
    judged = residuals(pairs, first, keys)
    median = judged.groupBy(*keys).agg(F.median("residual").alias("_median"))
    judged = (judged.join(median, keys) if keys else judged.crossJoin(F.broadcast(median))).withColumn("inlier", F.col("residual") <= trim * F.col("_median")).drop("_median")
    count = judged.groupBy(*keys).agg(F.count_if("inlier").alias("n_in"), F.count("*").alias("n_all"))
    again = count.filter("n_in >= 3 AND n_in < n_all").select(*keys)
    if not keys:
        refit = align(judged.filter("inlier"), keys, with_scale)
        c = count.first()
        return (refit if 3 <= c.n_in < c.n_all else first), judged
    refit = align(judged.filter("inlier").join(again, keys, "left_semi"), keys, with_scale)
    return refit.unionByName(first.join(again, keys, "left_anti")), judged


def inlier_rms(judged: DataFrame, keys: list[str]) -> DataFrame:
    """Root mean square of the inliers' residuals."""
    return judged.filter("inlier").groupBy(*keys).agg(F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("rms"))
