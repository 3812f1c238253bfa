"""Readers of file formats as DataFrames, on Spark's own readers: a file each for bundles and databases, text for the rest.

``binaryFile`` finds and ships the files, so folders may lie in any store Spark reads.
"""

from __future__ import annotations

import io
import sqlite3
import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import schemas
from plumbline.functions import naming
from plumbline.operators import checks
from plumbline.sources import records
from plumbline.sources.bytes import PART, numbered_lines

KNOWN = {"estimated_depth", "means", "weights", "sigmas", "confidence", "sky_mask"}


def _files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.withColumn("stem", naming.stem(F.col("path")))


def _bundle_row(stem: str, content: bytes) -> dict:
    with np.load(io.BytesIO(content), allow_pickle=False) as npz:
        held = {k: npz[k] for k in npz.files}
    if unknown := set(held) - KNOWN:
        raise ValueError(f"{stem}: unknown arrays {sorted(unknown)}")
    if "estimated_depth" not in held:
        raise ValueError(f"{stem}: estimated_depth is missing")
    depth = held["estimated_depth"]
    if depth.ndim != 2:
        raise ValueError(f"{stem}: estimated_depth has shape {depth.shape}")
    h, w = depth.shape
    stacks = [held[c] for c in ("means", "weights", "sigmas") if c in held]
    k = stacks[0].shape[0] if stacks else 1
    if any(s.shape != (k, h, w) for s in stacks) or any(held[c].shape != (h, w) for c in ("confidence", "sky_mask") if c in held):
        raise ValueError(f"{stem}: arrays do not share one grid and one K")
    if ("means" in held) != ("weights" in held) or ("sigmas" in held and "means" not in held and k != 1):
        raise ValueError(f"{stem}: means and weights come together, and sigmas with them")
    flat = {c: held[c].astype(np.float32).ravel().tolist() if c in held else None for c in ("estimated_depth", "means", "weights", "sigmas", "confidence")}
    sky = held["sky_mask"].astype(bool).ravel().tolist() if "sky_mask" in held else None
    return {"stem": stem, "h": h, "w": w, "k": k} | flat | {"sky_mask": sky}


def read_bundles(spark: SparkSession, folder: str, expected_hw: tuple[int, int] | None = None) -> DataFrame:
    """Depth bundles (``.npz``), a row a file, by file stem; broken files are errors, as is a grid other than expected."""

    def run(batches):
        for pdf in batches:
            rows = [_bundle_row(s, c) for s, c in zip(pdf["stem"], pdf["content"], strict=True)]
            for r in rows:
                if expected_hw and (r["h"], r["w"]) != tuple(expected_hw):
                    raise ValueError(f"{r['stem']}: grid {r['h']}x{r['w']} is not {expected_hw}")
            yield pd.DataFrame(rows, columns=schemas.BUNDLE.fieldNames())

    return _files(spark, folder, "*.npz").select("stem", "content").mapInPandas(run, schemas.BUNDLE)


def write_bundles(bundles: DataFrame, folder: str, expected_hw: tuple[int, int] | None = None) -> None:
    """Bundles (rows of the bundle schema) as a Parquet table; any row with a broken shape, pairing or grid is refused.

    Arrays that a bundle lacks stay null and take no space.
    """
    wrong = checks.bundle_problems(bundles.withColumn("image_id", F.col("stem")), expected_hw).limit(3).collect()
    if wrong:
        raise ValueError("; ".join(f"{r.image_id}: {r.rule}" for r in wrong))
    bundles.select(schemas.BUNDLE.fieldNames()).write.option("compression", "zstd").parquet(folder)


def bundle_files(bundles: DataFrame) -> DataFrame:
    """stem and content: the compressed array file of each bundle, with the arrays that are there."""

    def run(batches):
        for pdf in batches:
            content = []
            for row in pdf.itertuples():
                held = {}
                for name in ("estimated_depth", "confidence", "sky_mask", "means", "weights", "sigmas"):
                    if (values := getattr(row, name)) is not None:
                        grid = (row.h, row.w) if name in ("estimated_depth", "confidence", "sky_mask") else (row.k, row.h, row.w)
                        held[name] = np.asarray(values, bool if name == "sky_mask" else np.float32).reshape(grid)
                out = io.BytesIO()
                np.savez_compressed(out, **held)
                content.append(out.getvalue())
            yield pd.DataFrame({"stem": pdf["stem"], "content": content})

    return bundles.select(schemas.BUNDLE.fieldNames()).mapInPandas(run, "stem string, content binary")


def bundle_stems(spark: SparkSession, folder: str) -> DataFrame:
    """Stems of the bundle files in a folder."""
    return _files(spark, folder, "*.npz").select("stem")


def dump_digest(spark: SparkSession, folder: str) -> str:
    """SHA-256 over the sorted names and sizes of a folder's bundle files."""
    files = _files(spark, folder, "*.npz").select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "length")
    return files.agg(naming.file_digest(F.col("name"), F.col("length"))).first()[0]


SCENE = "scene string, frame int, h int, w int, points array<float>, pose array<double>, conf array<float>, sky_mask array<boolean>, mapped boolean, intrinsics array<double>"


def read_scenes(spark: SparkSession, folder: str) -> DataFrame:
    """Scene files (pts, pose, conf, sky_mask, unmapped_frames, intrinsics), a row a frame."""

    def run(batches):
        for pdf in batches:
            for stem, content in zip(pdf["stem"], pdf["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    pts, pose, conf, sky = z["pts"], z["pose"], z["conf"], z["sky_mask"]
                    unmapped = set(np.asarray(z["unmapped_frames"]).ravel().tolist())
                    k = z["intrinsics"].astype(float).ravel().tolist()
                t, h, w = pts.shape[:3]
                yield pd.DataFrame([{"scene": stem, "frame": i, "h": h, "w": w, "points": pts[i].astype(np.float32).ravel().tolist(), "pose": pose[i].astype(float).ravel().tolist(), "conf": conf[i].astype(np.float32).ravel().tolist(), "sky_mask": sky[i].astype(bool).ravel().tolist(), "mapped": i not in unmapped, "intrinsics": k} for i in range(t)])

    return _files(spark, folder, "*.npz").select("stem", "content").mapInPandas(run, SCENE)


def scene_depths(scenes: DataFrame, least_conf: float = 1e-4) -> DataFrame:
    """Depth of each world point in its own camera: scene, frame, h, w, estimated_depth, valid; unmapped frames go."""
    r = lambda i, j: F.get("pose", 4 * i + j)
    part = lambda p, i: F.get("points", 3 * p + i).cast("double") - r(i, 3)
    z = lambda p: part(p, 0) * r(0, 2) + part(p, 1) * r(1, 2) + part(p, 2) * r(2, 2)
    pixels = F.sequence(F.lit(0), F.col("h") * F.col("w") - 1)
    depth = F.transform(pixels, lambda p: z(p).cast("float"))
    valid = F.transform(pixels, lambda p: ~F.get("sky_mask", p) & (F.get("conf", p) > least_conf))
    return scenes.filter("mapped").select("scene", "frame", "h", "w", depth.alias("estimated_depth"), "conf", "sky_mask", valid.alias("valid"))


def scene_intrinsics(scenes: DataFrame) -> DataFrame:
    """scene and text: the focal lengths and the centre of each scene's 3x3 matrix, as the text of its intrinsics file."""
    at = {"fx": 0, "fy": 4, "cx": 2, "cy": 5}
    text = F.to_json(F.struct(*(F.get("intrinsics", i).alias(name) for name, i in at.items())))
    return scenes.groupBy("scene").agg(F.min_by("intrinsics", "frame").alias("intrinsics")).select("scene", text.alias("text"))


def positive_share(depths: DataFrame) -> DataFrame:
    """Per scene: share of valid pixels with a positive depth, and whether all are finite."""
    pairs = depths.select("scene", F.explode(F.arrays_zip("estimated_depth", "valid")).alias("p")).filter("p.valid")
    d = F.col("p.estimated_depth")
    return pairs.groupBy("scene").agg(F.avg((d > 0).cast("double")).alias("positive"), F.bool_and(~F.isnan(d) & (F.abs(d) < float("inf"))).alias("all_finite"))


TABLES = {
    "images": ("SELECT image_id, name, camera_id FROM images", "image_id long, name string, camera_id long"),
    "cameras": ("SELECT camera_id, model, width, height, params FROM cameras", "camera_id long, model int, width int, height int, params array<double>"),
    "keypoints": ("SELECT image_id, rows, cols, data FROM keypoints", "image_id long, point2D_idx int, x float, y float, a11 float, a12 float, a21 float, a22 float"),
}


def read_database(spark: SparkSession, folder: str, name: str, pattern: str = "*.db") -> DataFrame:
    """A table (images, cameras or keypoints) of feature databases (SQLite files), with the file's stem as ``database``."""
    query, schema = TABLES[name]

    def rows_of(content: bytes):
        with tempfile.NamedTemporaryFile(suffix=".db") as f:  # the library opens files only; gone at the task's end
            f.write(content)
            f.flush()
            with sqlite3.connect(f"file:{f.name}?mode=ro", uri=True) as db:
                for row in db.execute(query):
                    if name == "cameras":
                        yield (*row[:4], np.frombuffer(row[4], "<f8").tolist())
                    elif name == "keypoints":
                        image, n, cols, data = row
                        held = np.zeros((n, 6), np.float32)
                        if n:
                            held[:, :cols] = np.frombuffer(data, "<f4").reshape(n, cols)
                        yield from ((image, i, *map(float, held[i])) for i in range(n))
                    else:
                        yield row

    columns = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches):
        for pdf in batches:
            for stem, content in zip(pdf["stem"], pdf["content"], strict=True):
                yield pd.DataFrame(list(rows_of(content)), columns=columns).assign(database=stem)

    return _files(spark, folder, pattern).select("stem", "content").mapInPandas(run, f"{schema}, database string")


def read_trajectory(lines: DataFrame) -> DataFrame:
    """Poses of trajectory logs given whole (path, text): 5-line groups of a header and a 4x4 camera-to-world matrix.

    frame is the place in the log, view the first number of the header; a log of another number of lines is an error.
    """
    held = lines.select("path", F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "").alias("l"))
    whole = F.when(F.size("l") % 5 == 0, F.col("l")).otherwise(F.raise_error(F.lit("a log must have groups of five lines")).cast("array<string>"))
    held = held.withColumn("l", whole).filter(F.size("l") > 0)
    group = F.sequence(F.lit(0), (F.size("l") / 5).cast("int") - 1)
    numbers = lambda i: F.transform(F.split(F.trim(F.array_join(F.slice("l", i * 5 + 2, 4), " ")), r"\s+"), lambda x: x.cast("double"))
    view = lambda i: F.split(F.trim(F.get("l", i * 5)), r"\s+")[0].cast("long")
    poses = F.transform(group, lambda i: F.struct(i.alias("frame"), view(i).alias("view"), numbers(i).alias("pose")))
    return held.select("path", F.explode(poses).alias("p")).select("path", "p.*")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: path, text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """4x4 matrices written as text: path, m (16 numbers)."""
    return read_texts(spark, path).select("path", F.transform(F.regexp_extract_all("text", F.lit(r"(\S+)"), F.lit(1)), lambda x: x.cast("double")).alias("m"))


def model_form(spark: SparkSession, folder: str) -> str | None:
    """``binary``, ``text`` or None: the form in which a folder holds a reconstruction."""
    path = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    there = lambda name: path(name).getFileSystem(spark._jsc.hadoopConfiguration()).exists(path(name))
    return "binary" if there("cameras.bin") else "text" if there("cameras.txt") else None


def read_model(spark: SparkSession, folder: str, part: int = PART) -> dict[str, DataFrame]:
    """A reconstruction in binary or text form: cameras, images (pose and name), observations, points, tracks.

    Both forms give the same tables and are read in many splits.  A point2D without a point has a null point3D_id.
    """
    form = model_form(spark, folder)
    if form is None:
        raise FileNotFoundError(f"{folder} holds no cameras.bin or cameras.txt")
    return _binary_model(spark, folder, part) if form == "binary" else _text_model(spark, folder)


def _binary_model(spark: SparkSession, folder: str, part: int) -> dict[str, DataFrame]:
    cameras, _ = records.read_records(spark, f"{folder}/cameras.bin", records.CAMERAS, part)
    images, seen = records.read_records(spark, f"{folder}/images.bin", records.IMAGES, part)
    points, tracks = records.read_records(spark, f"{folder}/points3D.bin", records.POINTS, part)
    point = F.nullif("point3D_id", F.lit(-1).cast("long")).alias("point3D_id")
    observations = images.select("at", "image_id").join(seen, "at").select("image_id", F.col("place").cast("int").alias("point2D_idx"), "x", "y", point)
    tracks = points.select("at", "point3D_id").join(tracks, "at").select("point3D_id", "image_id", F.col("point2D_idx").cast("int").alias("point2D_idx"))
    return {"cameras": cameras.drop("path", "at"), "images": images.drop("path", "at"), "observations": observations, "points": points.drop("path", "at"), "tracks": tracks}


def _text_model(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    lines = lambda name: spark.read.text(f"{folder}/{name}").select(F.col("value").alias("line")).filter("line NOT LIKE '#%' AND trim(line) <> ''")
    part = lambda i: F.get(F.split("line", " "), i)
    numbers = lambda a: F.transform(a, lambda x: x.cast("double"))
    words = F.split("line", " ")
    cameras = lines("cameras.txt").select(part(0).cast("long").alias("camera_id"), part(1).alias("model"), part(2).cast("int").alias("width"), part(3).cast("int").alias("height"), numbers(F.slice(words, 5, 100)).alias("params"))
    rows = numbered_lines(spark, f"{folder}/images.txt", "#").withColumn("record", F.shiftright("no", 1)).withColumn("odd", F.col("no") % 2)  # two lines an image
    images = rows.filter("odd = 0 AND trim(line) <> ''").select("record", part(0).cast("long").alias("image_id"), numbers(F.slice(words, 2, 4)).alias("q_wxyz"), numbers(F.slice(words, 6, 3)).alias("translation"), part(8).cast("long").alias("camera_id"), F.array_join(F.slice(words, 10, 1000), " ").alias("name"))
    points2d = rows.filter("odd = 1 AND trim(line) <> ''").select("record", F.filter(words, lambda x: x != "").alias("n"))
    n = F.sequence(F.lit(0), (F.size("n") / 3).cast("int") - 1)
    each = F.explode(F.transform(n, lambda i: F.struct(i.alias("point2D_idx"), F.get("n", 3 * i).cast("double").alias("x"), F.get("n", 3 * i + 1).cast("double").alias("y"), F.nullif(F.get("n", 3 * i + 2).cast("long"), F.lit(-1).cast("long")).alias("point3D_id"))))
    observations = images.select("record", "image_id").join(points2d, "record").select("image_id", each.alias("o")).select("image_id", "o.*")
    held = lines("points3D.txt")
    points = held.select(part(0).cast("long").alias("point3D_id"), numbers(F.slice(words, 2, 3)).alias("xyz"), part(7).cast("double").alias("error"))
    track = F.filter(words, lambda x, i: (i >= 8) & (x != ""))
    pairs = held.select(part(0).cast("long").alias("point3D_id"), track.alias("n")).filter("size(n) > 1")
    pair = F.explode(F.transform(F.sequence(F.lit(0), (F.size("n") / 2).cast("int") - 1), lambda i: F.struct(F.get("n", 2 * i).cast("long").alias("image_id"), F.get("n", 2 * i + 1).cast("int").alias("point2D_idx"))))
    tracks = pairs.select("point3D_id", pair.alias("t")).select("point3D_id", "t.*")
    return {"cameras": cameras, "images": images.drop("record"), "observations": observations, "points": points, "tracks": tracks}


def model_lines(images: DataFrame) -> DataFrame:
    """Lines of an images.txt without observations: image_id (for the order) and two lines a row."""
    head = F.concat_ws(" ", F.col("image_id").cast("string"), *(F.get("q_wxyz", i).cast("string") for i in range(4)), *(F.get("translation", i).cast("string") for i in range(3)), F.col("camera_id").cast("string"), "name")
    return images.select("image_id", F.concat(head, F.lit("\n")).alias("value"))


def camera_lines(cameras: DataFrame) -> DataFrame:
    """Lines of a cameras.txt: camera_id, model, size and parameters."""
    words = F.concat_ws(" ", F.col("camera_id").cast("string"), "model", F.col("width").cast("string"), F.col("height").cast("string"), F.array_join(F.transform("params", lambda x: x.cast("string")), " "))
    return cameras.select("camera_id", words.alias("value"))


def point_lines(points: DataFrame) -> DataFrame:
    """Lines of a points3D.txt without tracks: id, place, a grey colour and the error."""
    words = F.concat_ws(" ", F.col("point3D_id").cast("string"), *(F.get("xyz", i).cast("string") for i in range(3)), F.lit("128 128 128"), F.coalesce("error", F.lit(-1.0)).cast("string"))
    return points.select("point3D_id", words.alias("value"))


def write_model(cameras: DataFrame, images: DataFrame, points: DataFrame, folder: str) -> None:
    """A reconstruction in text form: a folder a table, each an ordered text."""
    for name, lines, key in (("cameras.txt", camera_lines(cameras), "camera_id"), ("images.txt", model_lines(images), "image_id"), ("points3D.txt", point_lines(points), "point3D_id")):
        lines.repartitionByRange(1 if name == "images.txt" else 4, key).sortWithinPartitions(key).select("value").write.text(f"{folder}/{name}")


def read_view_metrics(spark: SparkSession, path: str, iteration: str) -> DataFrame:
    """Per-view metrics JSON ({iteration: {metric: {view: value}}}): path, metric, view, value."""
    kind = "map<string, map<string, map<string, double>>>"
    held = read_texts(spark, path).select("path", F.from_json("text", kind).alias("j"))
    metric = held.select("path", F.explode(F.col("j")[iteration]).alias("metric", "views"))
    return metric.select("path", "metric", F.explode("views").alias("view", "value"))


def read_results(spark: SparkSession, path: str, iteration: str) -> DataFrame:
    """Result JSON ({iteration: {metric: value}}): path, metric, value."""
    held = read_texts(spark, path).select("path", F.from_json("text", "map<string, map<string, double>>").alias("j"))
    return held.select("path", F.explode(F.col("j")[iteration]).alias("metric", "value"))


def read_scene_table(spark: SparkSession, path: str, metrics: list[str]) -> DataFrame:
    """Wide scene-by-arm CSV (columns scene, then arm_metric) without its footer rows, as scene, arm, metric, value."""
    wide = spark.read.option("header", True).csv(path)
    long = wide.unpivot(["scene"], [c for c in wide.columns if c != "scene"], "cell", "text")
    tail = "|".join(metrics)
    long = long.filter(~F.col("scene").isin("MEAN", "N_SCENES"))
    return long.select("scene", F.regexp_extract("cell", f"^(.*)_({tail})$", 1).alias("arm"), F.regexp_extract("cell", f"^(.*)_({tail})$", 2).alias("metric"), F.expr("try_cast(text AS DOUBLE)").alias("value"))


def sampled_points(points: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """At most n points without replacement, by a seeded order."""
    return points.orderBy(F.rand(seed)).limit(n)
