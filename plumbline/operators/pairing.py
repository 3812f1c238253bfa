"""Image pairs and task grids: exhaustive, sequential, arms by sequences; ranking for incremental growth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import geometry as G


def strided(names: DataFrame, keys: list[str], name: str, stride: int) -> DataFrame:
    """Every ``stride``-th name in sorted order, with its place among those kept."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(name)) - 1
    kept = names.withColumn("_p", place).filter(F.col("_p") % max(1, stride) == 0)
    return kept.withColumn("seq", (F.col("_p") / max(1, stride)).cast("int")).drop("_p")


def _pairs_within(rows: DataFrame, keys: list[str], block: int, carry: str | None = None) -> DataFrame:
    """keys, id_a, id_b of all pairs id_a <= id_b of image_id within each group; ``carry`` of both, in no order, as c_1 and c_2.

    A group is dealt into blocks of about ``block`` images by a hash of the id and joined block by block, so that no
    task holds the pairs of a whole group.
    """
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias("_n"))
    dealt = rows.join(sizes, keys).withColumn("_at", F.pmod(F.xxhash64("image_id"), F.col("_n")).cast("int"))
    own = lambda name: [] if carry is None else [F.col(carry).alias(name)]
    a = dealt.select(*keys, F.col("image_id").alias("_a"), F.col("_at").alias("_p"), *own("c_1"), F.explode(F.sequence("_at", F.col("_n") - 1)).alias("_q"))
    b = dealt.select(*keys, F.col("image_id").alias("_b"), *own("c_2"), F.explode(F.sequence(F.lit(0), "_at")).alias("_p"), F.col("_at").alias("_q"))
    # merged: what blocks multiply is not in the planner's estimates, by which a side may look small enough to be sent to all tasks
    pairs = a.join(b.hint("merge"), [*keys, "_p", "_q"]).filter("_p < _q OR _a < _b")
    return pairs.select(*keys, F.least("_a", "_b").alias("id_a"), F.greatest("_a", "_b").alias("id_b"), *([] if carry is None else ["c_1", "c_2"]))


def views_in_common(rays: DataFrame, block: int = 1024) -> DataFrame:
    """point3D_id, id_a, id_b and the angle (degrees) between the two rays, for all pairs of images of each point.

    ``rays`` has image_id, point3D_id and ray (from the point to the camera); one row an image and point.
    """
    pairs = _pairs_within(rays.select("image_id", "point3D_id", "ray"), ["point3D_id"], block, "ray")
    return pairs.select("point3D_id", "id_a", "id_b", G.direction_angle(F.col("c_1"), F.col("c_2")).alias("angle"))


def exhaustive_pairs(images: DataFrame, keys: list[str], block: int = 1024) -> DataFrame:
    """All pairs id_a < id_b within each group; the result itself is all pairs, as asked."""
    return _pairs_within(images.select(*keys, "image_id").filter(F.col("image_id").isNotNull()), keys, block)


def sequential_pairs(images: DataFrame, keys: list[str], overlap: int) -> DataFrame:
    """Each image with the next ``overlap`` ones of its sequence: an equi-join on the place, one row a pair."""
    ahead = images.select(*keys, F.col("image_id").alias("id_a"), F.explode(F.sequence(F.col("seq") + 1, F.col("seq") + overlap)).alias("seq"))
    return ahead.join(images.select(*keys, "seq", F.col("image_id").alias("id_b")), [*keys, "seq"]).select(*keys, "id_a", "id_b")


def grid(arms: DataFrame, sequences: DataFrame) -> DataFrame:
    """task, arm, sequence of every arm (arm_no from 0) on every sequence (sequence_no from 0), arms outermost.

    Both lists are parameters, a few rows each.
    """
    both = arms.crossJoin(sequences).crossJoin(sequences.agg(F.count("*").alias("_n")))
    return both.withColumn("task", F.col("arm_no") * F.col("_n") + F.col("sequence_no")).drop("_n")


def initial_pairs(observations: DataFrame, least: int = 1, block: int = 1024) -> DataFrame:
    """Image pairs by the number of points they share, most first; a point that very many images see is split in blocks."""
    seen = observations.filter(F.col("point3D_id").isNotNull()).select("image_id", "point3D_id").distinct()
    pairs = _pairs_within(seen, ["point3D_id"], block)
    return pairs.groupBy("id_a", "id_b").agg(F.count("*").alias("shared")).filter(F.col("shared") >= least).orderBy(F.desc("shared"), "id_a", "id_b")


def next_images(observations: DataFrame, registered: DataFrame, triangulated: DataFrame, least: int = 1) -> DataFrame:
    """Images not registered yet by the number of triangulated points they see, most first."""
    rest = observations.join(registered.select("image_id"), "image_id", "left_anti").join(triangulated.select("point3D_id"), "point3D_id", "left_semi")
    return rest.groupBy("image_id").agg(F.countDistinct("point3D_id").alias("visible")).filter(F.col("visible") >= least).orderBy(F.desc("visible"), "image_id")


def rig_counts(images: DataFrame, frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frames of each rig, and images of each camera."""
    return frames.groupBy("rig_id").agg(F.count("*").alias("n_frames")), images.groupBy("camera_id").agg(F.count("*").alias("n_images"))
