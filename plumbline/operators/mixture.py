"""Anchored two-component mixture fit of weighted log depths, one fit a keypoint.

The first mean stays at the keypoint's own log depth; the second, both spreads and the weights are fitted by a fixed
number of expectation-maximisation rounds.  Keypoints of a batch with equally long patches are fitted together in
numpy, so no Python loop runs over keypoints.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULTS = {"patch_scale": 4.0, "r_min": 2, "wmin": 0.05, "em_iters": 30, "uniform_prior": True, "sigma_log_min": 0.05, "sep_log_min": 0.1}


def fit_block(y: np.ndarray, w: np.ndarray, mu0: np.ndarray, floor: float, wmin: float, sep: float, rounds: int) -> np.ndarray:
    """Rows (mu1, s0, s1, w0, w1) for equally long samples ``y`` with weights ``w`` (fits x samples)."""
    n = len(mu0)
    single = np.stack([mu0, np.full(n, floor), np.full(n, floor), np.full(n, 1 - wmin), np.full(n, wmin)], axis=1)
    if y.shape[1] < 2:
        return single
    total = np.maximum(w.sum(axis=1), 1e-12)
    mean = (w * y).sum(axis=1) / total
    variance = (w * (y - mean[:, None]) ** 2).sum(axis=1) / total
    start = np.maximum(np.sqrt(variance), floor)
    out = np.stack([mu0, start, start, single[:, 3], single[:, 4]], axis=1)
    live = np.flatnonzero(~(variance < floor**2))
    if not len(live):
        return out
    y, w, m0, total = y[live], w[live], mu0[live], total[live]
    m1 = y[np.arange(len(live)), np.abs(y - m0[:, None]).argmax(axis=1)]
    s0 = s1 = start[live]
    p0 = p1 = np.full(len(live), 0.5)
    for _ in range(rounds):
        g0 = p0[:, None] * np.exp(-0.5 * ((y - m0[:, None]) / s0[:, None]) ** 2) / s0[:, None]
        g1 = p1[:, None] * np.exp(-0.5 * ((y - m1[:, None]) / s1[:, None]) ** 2) / s1[:, None]
        both = g0 + g1 + 1e-12
        a0, a1 = w * g0 / both, w * g1 / both
        n0, n1 = a0.sum(axis=1), a1.sum(axis=1)
        p0, p1 = n0 / total, n1 / total
        m1 = (a1 * y).sum(axis=1) / np.maximum(n1, 1e-12)
        s0 = np.maximum(np.sqrt((a0 * (y - m0[:, None]) ** 2).sum(axis=1) / np.maximum(n0, 1e-12)), floor)
        s1 = np.maximum(np.sqrt((a1 * (y - m1[:, None]) ** 2).sum(axis=1) / np.maximum(n1, 1e-12)), floor)
    weak = (p1 < wmin) | (np.abs(m1 - m0) < sep)
    fitted = np.stack([np.where(weak, m0, m1), s0, np.where(weak, s0, s1), np.where(weak, 1 - wmin, p0), np.where(weak, wmin, p1)], axis=1)
    out[live] = fitted
    return out


def with_fit(samples: DataFrame, y: str = "y", w: str = "w", mu0: str = "mu0", params: dict | None = None) -> DataFrame:
    """Adds the column ``fit`` (mu1, s0, s1, w0, w1) for sample arrays ``y`` with weights ``w`` around ``mu0``.

    All columns of ``samples`` go through the worker, so it should have no others than are wanted after it.
    """
    p = DEFAULTS | (params or {})
    names = ["mu1", "s0", "s1", "w0", "w1"]

    def fit(batches):
        for batch in batches:
            sizes = batch.column(y).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            first = np.cumsum(sizes) - sizes
            ys, ws = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.float64) for c in (y, w))
            mus = batch.column(mu0).to_numpy(zero_copy_only=False).astype(np.float64)
            out = np.empty((batch.num_rows, len(names)))
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                at = first[rows][:, None] + np.arange(size)
                out[rows] = fit_block(ys[at], ws[at], mus[rows], p["sigma_log_min"], p["wmin"], p["sep_log_min"], p["em_iters"])
            fitted = pa.StructArray.from_arrays([pa.array(c) for c in out.T], names)
            yield pa.RecordBatch.from_arrays([*batch.columns, fitted], [*batch.schema.names, "fit"])

    return samples.mapInArrow(fit, T.StructType([*samples.schema.fields, T.StructField("fit", T.StructType([T.StructField(n, T.DoubleType()) for n in names]))]))


def weighted_moments(samples: DataFrame, keys: list[str], y: str = "y", w: str = "w") -> DataFrame:
    """Total weight, weighted mean and weighted variance of exploded samples, by the moments' sums in one aggregation."""
    sums = samples.groupBy(*keys).agg(F.sum(w).alias("W"), F.sum(F.col(w) * F.col(y)).alias("wy"), F.sum(F.col(w) * F.col(y) * F.col(y)).alias("wyy"))
    total = F.greatest(F.col("W"), F.lit(1e-12))
    mean = F.col("wy") / total
    return sums.select(*keys, "W", mean.alias("ybar"), F.greatest(F.col("wyy") / total - mean * mean, F.lit(0.0)).alias("yvar"))
