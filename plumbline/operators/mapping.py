"""Incremental growth of maps as rounds over tables, and the ledger of pipeline stages.

Every connected component of the observation graph is a model of its own, and all models grow in the same jobs.  A model
starts from a pair of frames that share many points, posed by its two-view geometry (or by poses that are given).  A round
triangulates what the registered frames see, adjusts frames and points, and poses by resection all further images that
see enough of it.  Bounds are relaxed where nothing registers.  Frames that lose their points are filtered, and models that
stay small are dropped in the end.  Features and matching are outside the reference's own code too and are not rebuilt.
"""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import pairing, registration, solver
from plumbline.operators.components import connected_components
from plumbline.staging import discard, staged


@dataclass
class GrowthOptions:
    least_visible: int = 6
    least_pair: int = 8
    pair_trials: int = 16
    least_pair_angle: float = 4.0
    relaxations: int = 2
    most_rounds: int = 50
    least_model: int = 2
    least_frame_points: int = 3
    triangulation: registration.Triangulation = field(default_factory=registration.Triangulation)
    resection: registration.Resection = field(default_factory=registration.Resection)
    two_view: registration.TwoView = field(default_factory=registration.TwoView)
    adjust: solver.Options = field(default_factory=lambda: solver.Options(loss="cauchy", rounds=10))


def graph_models(reproj: DataFrame) -> DataFrame:
    """frame_id and model (the smallest frame_id that shared points lead to) of every frame."""
    first = reproj.groupBy("point3D_id").agg(F.min("frame_id").alias("_f"))
    links = reproj.select("frame_id", "point3D_id").distinct().join(first, "point3D_id").select(F.col("frame_id").alias("u"), F.col("_f").alias("v"))
    found = connected_components(links)
    held = staged(reproj.select("frame_id").distinct().join(found.withColumnRenamed("node", "frame_id"), "frame_id", "left").select("frame_id", F.coalesce("component", "frame_id").alias("model")), "models")
    discard(found)
    return held


def first_pairs(reproj: DataFrame, models: DataFrame, least: int, given: DataFrame | None = None, trials: int = 16, options: registration.TwoView | None = None, least_angle: float = 4.0) -> DataFrame:
    """model, id_a, id_b and the second frame's pose (rotation, translation) in the first one's, of the pair each model starts from.

    Of the ``trials`` pairs of a model that share the most points it is the one of which the most matches lie in front of both
    cameras, among those with a mean angle of at least ``least_angle`` degrees if there are any.  With poses ``given`` (frames) it is the pair that shares the most, and its pose is theirs.
    """
    seen = reproj.select(F.col("frame_id").alias("image_id"), "point3D_id")
    pairs = pairing.initial_pairs(seen, least).join(models.withColumnRenamed("frame_id", "id_a"), "id_a")
    place = F.row_number().over(Window.partitionBy("model").orderBy(F.desc("shared"), "id_a", "id_b"))
    pairs = pairs.withColumn("_at", place).filter(F.col("_at") <= (1 if given is not None else trials)).select("model", "id_a", "id_b")
    if given is not None:
        return staged(pairs.withColumn("rotation", F.lit(None).cast("array<double>")).withColumn("translation", F.lit(None).cast("array<double>")), "first-pairs")
    pairs = staged(pairs, "pair-trials")
    u, v = (F.col("x") - F.col("cx")) / F.col("fx"), (F.col("y") - F.col("cy")) / F.col("fy")
    ray = lambda s: reproj.select(F.col("frame_id").alias(f"id_{s}"), F.col("point3D_id").alias("match_id"), u.alias(f"u{s}"), v.alias(f"v{s}"), F.col("fx").alias(f"_f{s}"))
    matches = pairs.join(ray("a"), "id_a").join(ray("b"), ["id_b", "match_id"]).withColumn("focal", F.col("_fa"))
    posed = registration.relative_poses(matches, options).join(pairs, ["id_a", "id_b"])
    best = posed.groupBy("model").agg(F.max(F.struct((F.col("angle") >= least_angle).alias("_wide"), "n_front", (-F.col("id_a")).alias("_a"), (-F.col("id_b")).alias("_b"), "rotation", "translation")).alias("_b"))
    held = staged(best.select("model", (-F.col("_b._a")).alias("id_a"), (-F.col("_b._b")).alias("id_b"), "_b.rotation", "_b.translation"), "first-pairs")
    discard(pairs)
    return held


def filtered_frames(reproj: DataFrame, frames: DataFrame, least: int = 3) -> DataFrame:
    """frame_id of the frames that keep at least ``least`` points which two frames or more see.

    A frame that goes may leave points with one view, and so other frames with too few: rounds go on until nothing changes.
    """
    views = staged(reproj.select("frame_id", "point3D_id").distinct().join(frames.select("frame_id"), "frame_id", "left_semi"), "views")
    kept = frames.select("frame_id").distinct()
    n = views.count()
    while True:
        twice = views.groupBy("point3D_id").agg(F.count("*").alias("_n")).filter("_n >= 2").select("point3D_id")
        enough = views.join(twice, "point3D_id", "left_semi").groupBy("frame_id").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select("frame_id")
        before, views = views, staged(views.join(twice, "point3D_id", "left_semi").join(enough, "frame_id", "left_semi"), "views")
        discard(before)
        now = views.count()
        if now == n:
            break
        n = now
    held = staged(kept.join(views.select("frame_id").distinct(), "frame_id", "left_semi"), "kept-frames")
    discard(views)
    return held


def grow(reproj: DataFrame, start: solver.State | None = None, options: GrowthOptions | None = None, depth: DataFrame | None = None) -> tuple[solver.State, DataFrame, str]:
    """(state, registered frames with the round they came in and their model, "ok" or why it stopped).

    ``reproj`` has frame_id, point3D_id, x, y and intrinsics.  ``start`` may give poses, of which those of the first pairs are
    taken, and affine blocks for ``depth``; frames and points are found otherwise.  The first frame of each model is constant.
    Models with fewer than ``least_model`` frames are dropped where there are several; "rounds used up" says that images
    might still have registered.
    """
    o = options or GrowthOptions()
    spark = reproj.sparkSession
    seen = reproj.select(F.col("frame_id").alias("image_id"), "point3D_id")
    affine = start.affine if start else spark.createDataFrame([], "key long, alpha double, beta double, is_constant boolean")
    models = graph_models(reproj)
    least, pairs = o.least_pair, None
    for _ in range(1 + o.relaxations):
        pairs = first_pairs(reproj, models, least, start.frames if start else None, o.pair_trials, o.two_view, o.least_pair_angle)
        if not pairs.isEmpty():
            break
        least = max(1, least // 2)
    eye = F.array(*(F.lit(float(i % 4 == 0)) for i in range(9)))
    own = lambda c, rotation, translation, fixed: pairs.select(F.col(c).alias("frame_id"), rotation.alias("rotation"), translation.alias("translation"), F.lit(fixed).alias("is_constant"), F.lit(0).alias("round"), "model")
    posed = own("id_a", eye, F.array(*[F.lit(0.0)] * 3), True).unionByName(own("id_b", F.col("rotation"), F.col("translation"), False))
    if start:
        held = start.frames.select("frame_id", F.col("rotation").alias("_r"), F.col("translation").alias("_t"), F.col("is_constant").alias("_c"))
        posed = posed.join(held, "frame_id").select("frame_id", F.col("_r").alias("rotation"), F.col("_t").alias("translation"), (F.col("is_constant") | F.col("_c")).alias("is_constant"), "round", "model")
    frames = staged(posed, "registered")
    nothing = spark.createDataFrame([], "point3D_id long, xyz array<double>, is_constant boolean")
    if frames.isEmpty():
        return (start or solver.State(frames.select("frame_id", "rotation", "translation", "is_constant"), nothing, affine)), frames.select("frame_id", "round", "model"), "no initial pair"
    state, why, visible = solver.State(frames, nothing, affine), "rounds used up", o.least_visible
    for number in range(1, o.most_rounds + 1):
        ours = staged(reproj.join(frames, "frame_id", "left_semi"), "growing")
        found = registration.triangulate(ours, frames, o.triangulation)
        points = staged(found.select("point3D_id", "xyz", F.lit(False).alias("is_constant")), "points")
        held = staged(solver.filtered(ours, solver.State(frames, points, affine), o.triangulation.most_error), "growing")
        depths = None if depth is None else depth.join(held.select("frame_id", "point3D_id"), ["frame_id", "point3D_id"], "left_semi")
        pose = ["frame_id", "rotation", "translation", "is_constant"]
        state, _, _ = solver.solve(held, solver.State(frames.select(pose), points, state.affine), o.adjust, depths)
        solid = filtered_frames(held, frames, o.least_frame_points)
        known = frames.select("frame_id", "round", "model")
        frames = staged(state.frames.join(known, "frame_id").join(solid, "frame_id", "left_semi"), "registered")
        new, bound = None, visible
        for _ in range(1 + o.relaxations):
            near = pairing.next_images(seen, known.withColumnRenamed("frame_id", "image_id"), state.points, bound).select(F.col("image_id").alias("frame_id"))
            got = registration.resect(reproj.join(near, "frame_id", "left_semi"), state.points, o.resection).join(models, "frame_id")
            got = staged(got.select("frame_id", "rotation", "translation", F.lit(False).alias("is_constant"), F.lit(number).alias("round"), "model"), "resected")
            if not got.isEmpty():
                new = got
                break
            bound = max(1, bound // 2)
        discard(ours, found, held, solid)
        if new is None:
            why = "ok"
            break
        frames = staged(frames.unionByName(new), "registered")
    sizes = frames.groupBy("model").agg(F.count("*").alias("_n"))
    if sizes.count() > 1:
        frames = staged(frames.join(sizes.filter(F.col("_n") >= o.least_model), "model", "left_semi"), "registered")
        mine = reproj.join(frames, "frame_id", "left_semi").select("point3D_id").distinct()
        state = solver.State(state.frames, staged(state.points.join(mine, "point3D_id", "left_semi"), "points"), state.affine)
    registered = staged(frames.select("frame_id", "round", "model"), "registered-frames")
    poses = frames.select("frame_id", "rotation", "translation", "is_constant")
    if start:  # frames that never registered keep the pose they came with
        poses = poses.unionByName(start.frames.select(poses.columns).join(registered, "frame_id", "left_anti"))
    return solver.State(staged(poses, "frames"), state.points, state.affine), registered, why


def write_snapshot(state: solver.State, folder: str, millis: int) -> str:
    """The tables of a map under a folder named by the time in milliseconds, with 13 digits."""
    at = f"{folder.rstrip('/')}/{millis:013d}"
    for name in ("frames", "points", "affine"):
        getattr(state, name).write.parquet(f"{at}/{name}")
    return at


class Ledger:
    """Markers of finished stages, one JSON file a stage; a stage that runs again clears those after it."""

    def __init__(self, folder: str, order: list[str]):
        self.folder, self.order = Path(folder), order

    def _path(self, stage: str) -> Path:
        return self.folder / f"done_{stage}.json"

    def done(self, stage: str) -> bool:
        return self._path(stage).exists()

    def run(self, stages: list[str], actions: dict, config: dict, commit: str = "") -> list[str]:
        """Run the stages that have no marker, in the order asked; the names of those that ran."""
        unknown = [s for s in stages if s not in actions]
        if unknown:
            raise ValueError(f"unknown stages {unknown}; there are {sorted(actions)}")
        ran = []
        for stage in stages:
            if self.done(stage):
                continue
            for later in self.order[self.order.index(stage) :]:
                self._path(later).unlink(missing_ok=True)
            actions[stage]()
            self.folder.mkdir(parents=True, exist_ok=True)
            at = dt.datetime.now(dt.UTC).isoformat(timespec="seconds")
            self._path(stage).write_text(json.dumps({"stage": stage, "commit": commit, "at": at, "config": config}, sort_keys=True))
            ran.append(stage)
        return ran
