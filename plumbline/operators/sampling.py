"""Depth measurements at keypoints: extractors from dense rasters, and their registry.

A bundle row holds ``image_id, h, w, k`` and flat arrays ``estimated_depth`` (h*w) and optionally ``confidence``,
``sky_mask`` (h*w), ``means, weights, sigmas`` (k*h*w).  A keypoint row holds ``image_id, point2D_idx, x, y`` and its
2x2 shape.  An extractor turns both into measurement rows: one join on image_id, then lookups into arrays, so nothing
is exploded to pixels.  With the parameter ``tile`` (pixels a side) rasters are cut into tiles first and the join is on the
image and tile, so that a row of a large raster is never joined whole.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import raster
from plumbline.operators import mixture

OPTIONAL = ("means", "weights", "sigmas", "confidence", "sky_mask")
MEASURED = ("image_id", "point2D_idx", "modes", "weights", "estimated_depth", "sigmas", "confidence", "is_sky")


def tiles(bundles: DataFrame, size: int, halo: int) -> DataFrame:
    """Rasters cut into tiles of ``size`` pixels a side with ``halo`` more around them, as far as the image goes.

    image_id, tile_v, tile_u, k, the image's h and w, the first pixel (v0, u0), the tile's own th and tw, and its rasters.  An
    image is cut in the task that reads it and its tiles go their ways: no task holds more than one image.
    """
    have = [c for c in ("estimated_depth", *OPTIONAL) if c in bundles.columns]
    kind = dict(bundles.dtypes)
    head = ["image_id", *(["k"] if "k" in kind else []), "h", "w"]
    schema = ", ".join([*(f"`{c}` {kind[c]}" for c in head), "tile_v int", "tile_u int", "v0 int", "u0 int", "th int", "tw int", *(f"`{c}` {kind[c]}" for c in have if kind[c] != "void")])
    have = [c for c in have if kind[c] != "void"]

    def cut(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in [*head, *have]}
                h, w = row["h"].as_py(), row["w"].as_py()
                flat = {c: None if not row[c].is_valid else row[c].values for c in have}
                for tv in range(0, -(-h // size)):
                    for tu in range(0, -(-w // size)):
                        v0, u0 = max(0, tv * size - halo), max(0, tu * size - halo)
                        v1, u1 = min(h, (tv + 1) * size + halo), min(w, (tu + 1) * size + halo)
                        inside = (np.arange(v0, v1)[:, None] * w + np.arange(u0, u1)).reshape(-1)
                        out = {c: [row[c].as_py()] for c in head} | {"tile_v": [tv], "tile_u": [tu], "v0": [v0], "u0": [u0], "th": [v1 - v0], "tw": [u1 - u0]}
                        for c in have:
                            planes = 0 if flat[c] is None else len(flat[c]) // (h * w)
                            at = (np.arange(planes)[:, None] * h * w + inside).reshape(-1)
                            out[c] = [None if flat[c] is None else flat[c].take(pa.array(at)).to_pylist()]
                        kinds = {c: batch.schema.field(c).type for c in [*head, *have]}
                        yield pa.RecordBatch.from_pydict({c: pa.array(v, kinds.get(c, pa.int32())) for c, v in out.items()})

    return bundles.select(*head, *have).mapInArrow(cut, schema)


def located_in_tiles(bundles: DataFrame, keypoints: DataFrame, size: int, radius: Column | None = None) -> DataFrame:
    """As ``located``, by tiles: h, w, v and u are those of the tile and of the pixel in it.

    ``radius`` is how far a keypoint's patch reaches; the tiles' halo is the largest, which one aggregation finds.  At an edge
    of the image a tile ends too, and elsewhere its halo holds all that a patch reaches, so patches are the same.
    """
    farthest = 0 if radius is None else keypoints.agg(F.max(radius)).first()[0] or 0
    cut = tiles(bundles, size, int(farthest))
    place = keypoints.join(bundles.select("image_id", F.col("h").alias("_h"), F.col("w").alias("_w")), "image_id")
    place = place.withColumn("v", raster.pixel(F.col("y"), F.col("_h"))).withColumn("u", raster.pixel(F.col("x"), F.col("_w")))
    place = place.withColumn("tile_v", F.floor(F.col("v") / size).cast("int")).withColumn("tile_u", F.floor(F.col("u") / size).cast("int")).drop("_h", "_w")
    have = set(cut.columns)
    optional = [F.col(f"b.{c}").alias(f"b_{c}") if c in have else F.lit(None).alias(f"b_{c}") for c in OPTIONAL]
    k = F.col("b.k") if "k" in have else F.lit(1)
    rows = place.alias("p").join(cut.alias("b"), ["image_id", "tile_v", "tile_u"])
    rows = rows.select("p.*", F.col("b.th").alias("h"), F.col("b.tw").alias("w"), k.alias("k"), F.col("b.v0").alias("v0"), F.col("b.u0").alias("u0"), F.col("b.estimated_depth").alias("b_depth"), *optional)
    return rows.withColumn("v", F.col("v") - F.col("v0")).withColumn("u", F.col("u") - F.col("u0")).drop("v0", "u0", "tile_v", "tile_u")


def _located(bundles: DataFrame, keypoints: DataFrame, params: dict | None, radius: Column | None = None) -> DataFrame:
    size = (params or {}).get("tile")
    return located(bundles, keypoints) if size is None else located_in_tiles(bundles, keypoints, size, radius)


def located(bundles: DataFrame, keypoints: DataFrame) -> DataFrame:
    """Keypoints with their image's rasters and the pixel (v, u) they fall in; rasters that are absent are null."""
    have = set(bundles.columns)
    optional = [F.col(f"b.{c}").alias(f"b_{c}") if c in have else F.lit(None).alias(f"b_{c}") for c in OPTIONAL]
    k = F.col("b.k") if "k" in have else F.lit(1)
    rows = keypoints.alias("p").join(bundles.alias("b"), "image_id").select("p.*", F.col("b.h").alias("h"), F.col("b.w").alias("w"), k.alias("k"), F.col("b.estimated_depth").alias("b_depth"), *optional)
    return rows.withColumn("v", raster.pixel(F.col("y"), F.col("h"))).withColumn("u", raster.pixel(F.col("x"), F.col("w")))


def _passed_through(rows: DataFrame) -> dict:
    types = dict(rows.dtypes)
    at = lambda c: raster.gather(F.col(c), F.col("v"), F.col("u"), F.col("w"))
    depth = at("b_depth").cast("double")
    confidence = at("b_confidence").cast("double") if types["b_confidence"] != "void" else F.lit(None).cast("double")
    sky = at("b_sky_mask").cast("boolean") if types["b_sky_mask"] != "void" else F.lit(None).cast("boolean")
    return {"estimated_depth": depth, "confidence": confidence, "is_sky": sky}


def _measured(rows: DataFrame, modes, weights, sigmas) -> DataFrame:
    floats = lambda a: a.cast("array<float>")
    made = {"image_id": F.col("image_id"), "point2D_idx": F.col("point2D_idx"), "modes": floats(modes), "weights": floats(weights), "sigmas": floats(sigmas)} | _passed_through(rows)
    return rows.select(*(made[c].alias(c) for c in MEASURED))


def _stack(rows: DataFrame, name: str):
    if dict(rows.dtypes)[name] == "void":
        return F.lit(None).cast("array<double>")
    values = raster.gather_stack(F.col(name), F.col("k"), F.col("v"), F.col("u"), F.col("h"), F.col("w"))
    return F.when(F.col(name).isNotNull(), values)


def unimodal(bundles: DataFrame, keypoints: DataFrame, params: dict | None = None) -> DataFrame:
    """One mode: the depth at the pixel, weight 1; a sigma only where the bundle has a single plane of them."""
    rows = _located(bundles, keypoints, params)
    depth = raster.gather(F.col("b_depth"), F.col("v"), F.col("u"), F.col("w"))
    sigmas = F.when(F.col("k") == 1, _stack(rows, "b_sigmas"))
    return _measured(rows, F.array(depth), F.array(F.lit(1.0)), sigmas)


def mixture_stack(bundles: DataFrame, keypoints: DataFrame, params: dict | None = None) -> DataFrame:
    """All modes of the bundle's own mixture at the pixel; a bundle without at least two planes is an error."""
    rows = _located(bundles, keypoints, params)
    means = _stack(rows, "b_means")
    checked = F.when((F.col("k") >= 2) & means.isNotNull(), means).otherwise(F.raise_error(F.lit("a mixture needs K>=2 planes of means")).cast("array<double>"))
    return _measured(rows, checked, _stack(rows, "b_weights"), _stack(rows, "b_sigmas"))


def patches(bundles: DataFrame, keypoints: DataFrame, params: dict | None = None) -> DataFrame:
    """Keypoints with the log depths ``y`` and spatial weights ``w`` of their disk, and the anchor ``mu0``."""
    p = mixture.DEFAULTS | (params or {})
    scale = raster.keypoint_scale(*(F.col(c).cast("double") for c in ("a11", "a12", "a21", "a22")))
    rows = _located(bundles, keypoints, params, raster.patch_radius(scale, p["patch_scale"], p["r_min"]))
    rows = rows.withColumn("scale", scale).withColumn("radius", raster.patch_radius(F.col("scale"), p["patch_scale"], p["r_min"]))
    samples = raster.patch(F.col("b_depth"), F.col("v"), F.col("u"), F.col("h"), F.col("w"), F.col("radius"), F.col("scale"))
    anchor = raster.gather(F.col("b_depth"), F.col("v"), F.col("u"), F.col("w")).cast("double")
    rows = rows.withColumn("samples", samples).withColumn("mu0", F.ln(F.greatest(anchor, F.lit(1e-12))))
    return rows.withColumn("ys", F.transform("samples", lambda s: s.y)).withColumn("ws", F.transform("samples", lambda s: s.w))


def patch_mixture(bundles: DataFrame, keypoints: DataFrame, params: dict | None = None) -> DataFrame:
    """Two modes fitted to the depths around a keypoint; equal modes where the patch does not support a second."""
    p = mixture.DEFAULTS | (params or {})
    rows = patches(bundles, keypoints, p)
    # what is read from the raster is read before the fit, so that no raster goes through the Python worker
    narrow = rows.select("image_id", "point2D_idx", "ys", "ws", "mu0", *(v.alias(c) for c, v in _passed_through(rows).items()))
    fitted = mixture.with_fit(narrow, "ys", "ws", "mu0", p)
    weights = F.array(F.lit(0.5), F.lit(0.5)) if p["uniform_prior"] else F.array("fit.w0", "fit.w1")
    made = {"modes": F.array(F.exp("mu0"), F.exp("fit.mu1")), "weights": weights, "sigmas": F.array("fit.s0", "fit.s1")}
    return fitted.select(*(made[c].cast("array<float>").alias(c) if c in made else F.col(c) for c in MEASURED))


#: name -> function of (bundles, keypoints, params); add to it to plug in an extractor
EXTRACTORS: dict[str, Callable[[DataFrame, DataFrame, dict | None], DataFrame]] = {"unimodal": unimodal, "mda_native": mixture_stack, "gmm_patch": patch_mixture}
#: the space each extractor's sigmas are in, where it gives any
SIGMA_SPACE = {"gmm_patch": "log"}


def from_columns(measured: DataFrame, sensor: str) -> DataFrame:
    """Rows of a per-image struct of arrays (``modes`` and so on, one element a keypoint), numbered by position."""
    names = [c for c in MEASURED[2:] if c in measured.columns]
    zipped = F.posexplode(F.arrays_zip(*names)).alias("point2D_idx", "m")
    return measured.select("image_id", zipped).select("image_id", "point2D_idx", F.lit(sensor).alias("sensor"), "m.*")
