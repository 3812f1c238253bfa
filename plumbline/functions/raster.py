"""Column functions over dense rasters held as row-major arrays: pixel lookup, disks, gradients, quantisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pixel(x: Column, size: Column) -> Column:
    """Index of the pixel that holds coordinate ``x``: its floor, clipped to the raster; no half-pixel shift."""
    return F.least(F.greatest(F.floor(x).cast("int"), F.lit(0)), size.cast("int") - 1)


def gather(raster: Column, v: Column, u: Column, width: Column) -> Column:
    return F.get(raster, (v * width + u).cast("int"))


def gather_stack(stack: Column, planes: int | Column, v: Column, u: Column, height: Column, width: Column) -> Column:
    """Values of all planes at one pixel, from planes laid end to end."""
    n = F.lit(planes) if isinstance(planes, int) else planes
    return F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda k: F.get(stack, (k * height * width + v * width + u).cast("int")))


def disk(radius: Column) -> Column:
    """Offsets (dv, du) with dv^2 + du^2 <= radius^2, rows first."""
    r = radius.cast("int")
    span = F.sequence(-r, r)
    pairs = F.flatten(F.transform(span, lambda dv: F.transform(span, lambda du: F.struct(dv.alias("dv"), du.alias("du")))))
    return F.filter(pairs, lambda o: o.dv * o.dv + o.du * o.du <= r * r)


def keypoint_scale(a11: Column, a12: Column, a21: Column, a22: Column) -> Column:
    """Scale of a keypoint: the root of its shape's determinant, not under 0."""
    return F.sqrt(F.greatest(a11 * a22 - a12 * a21, F.lit(0.0)))


def patch_radius(scale: Column, patch_scale: float = 4.0, least: int = 2) -> Column:
    """Half-to-even rounding of ``patch_scale * scale``, at least ``least``."""
    return F.greatest(F.rint(scale * patch_scale).cast("int"), F.lit(least))


def patch(raster: Column, v: Column, u: Column, height: Column, width: Column, radius: Column, scale: Column) -> Column:
    """Samples (dv, du, y, w) of the disk around a pixel: in bounds, finite and positive; y is the log depth."""
    ss = F.greatest(scale, F.lit(1e-12))

    def sample(o):
        d = gather(raster, v + o.dv, u + o.du, width).cast("double")
        return F.struct(o.dv.alias("dv"), o.du.alias("du"), d.alias("d"))

    inside = F.filter(disk(radius), lambda o: (v + o.dv >= 0) & (v + o.dv < height) & (u + o.du >= 0) & (u + o.du < width))
    good = F.filter(F.transform(inside, sample), lambda s: s.d.isNotNull() & ~F.isnan(s.d) & (s.d < float("inf")) & (s.d > 0))
    weight = lambda s: F.exp(-(s.dv * s.dv + s.du * s.du) / (2 * ss * ss))
    return F.transform(good, lambda s: F.struct(s.dv.alias("dv"), s.du.alias("du"), F.ln(s.d).alias("y"), weight(s).alias("w")))


def gradient_magnitude(raster: Column, v: Column, u: Column, height: Column, width: Column) -> Column:
    """Length of the gradient at a pixel: central differences, one-sided at the borders."""

    def slope(at, size, value):
        low, high = F.greatest(at - 1, F.lit(0)), F.least(at + 1, size - 1)
        return F.when(high > low, (value(high) - value(low)) / (high - low)).otherwise(F.lit(0.0))

    dv = slope(v, height, lambda r: gather(raster, r, u, width).cast("double"))
    du = slope(u, width, lambda c: gather(raster, v, c, width).cast("double"))
    return F.hypot(dv, du)


def to_byte(x: Column) -> Column:
    """[-1, 1] to 0..255, truncating after adding one half."""
    return F.least(F.greatest((x + 1) / 2 * 255 + 0.5, F.lit(0.0)), F.lit(255.0)).cast("int")
