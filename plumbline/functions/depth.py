"""Column functions of the depth residual layer: residuals, max-mixture choice, robust losses, ambiguity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = ("log", "linear", "inverse")


def residual(z: Column, mode: Column, sigma: Column, alpha: Column, beta: Column, space: str = "log") -> Column:
    """Whitened residual of a depth ``z`` against a measured mode, scaled and shifted; null where it is undefined."""
    predicted = alpha * mode + beta
    if space == "log":
        error = F.when((z > 0) & (predicted > 0), F.ln(z) - F.ln(predicted))
    elif space == "linear":
        error = z - predicted
    elif space == "inverse":
        error = F.when((z != 0) & (predicted != 0), 1 / F.nullif(z, F.lit(0.0)) - 1 / F.nullif(predicted, F.lit(0.0)))
    else:
        raise ValueError(f"space {space!r} is none of {SPACES}")
    return error / sigma


def floored_weights(weights: Column, floor: float = 1e-20) -> Column:
    return F.transform(weights, lambda w: F.greatest(w.cast("double"), F.lit(floor)))


def sigmas_or(sigmas: Column, default: float, modes: Column) -> Column:
    """The row's own sigmas, else the configured one for each mode."""
    return F.coalesce(F.transform(sigmas, lambda s: s.cast("double")), F.array_repeat(F.lit(default), F.size(modes)))


def max_mixture(z: Column, modes: Column, sigmas: Column, weights: Column, alpha: Column, beta: Column, space: str = "log") -> Column:
    """struct(score, mode, wh) of the mode with the least wh^2 + 2 ln(sigma / weight); the first among equals."""
    floored = floored_weights(weights)

    def scored(m, k):
        wh = residual(z, m.cast("double"), F.get(sigmas, k), alpha, beta, space)
        return F.struct((wh * wh + 2 * F.ln(F.get(sigmas, k) / F.get(floored, k))).alias("score"), k.alias("mode"), wh.alias("wh"))

    return F.array_min(F.transform(modes, scored))


def depth_factor(z: Column, modes: Column, sigmas: Column, weights: Column, alpha: Column, beta: Column, space: str = "log") -> Column:
    """The factor's residual: plain for one mode, that of the max-mixture winner for several."""
    plain = residual(z, F.get(modes, 0).cast("double"), F.get(sigmas, 0), alpha, beta, space)
    return F.when(F.size(modes) == 1, plain).otherwise(max_mixture(z, modes, sigmas, weights, alpha, beta, space).wh)


def robust(s: Column, kind: str = "trivial", scale: float = 1.0) -> Column:
    """rho(s) of a squared residual; a cost is half of it."""
    b = scale * scale
    if kind == "trivial":
        return s
    if kind == "soft_l1":
        return 2 * b * (F.sqrt(1 + s / b) - 1)
    if kind == "cauchy":
        return b * F.log1p(s / b)
    if kind == "huber":
        return F.when(s <= b, s).otherwise(2 * scale * F.sqrt(F.greatest(s, F.lit(0.0))) - b)
    raise ValueError(f"unsupported loss {kind!r}")


def ambiguity(modes: Column, weights: Column) -> Column:
    """The lesser weight times the distance of the two log modes, modes not under 1e-12."""
    log = lambda k: F.ln(F.greatest(F.get(modes, k).cast("double"), F.lit(1e-12)))
    return F.array_min(weights).cast("double") * F.abs(log(0) - log(1))


def gaussian(x: Column, mean: Column, sigma: Column) -> Column:
    return F.exp(-0.5 * F.pow((x - mean) / sigma, F.lit(2.0))) / (sigma * F.sqrt(F.lit(2.0) * F.pi()))
