"""The joint step against a dense solve, gauges, whole adjustments, growth and what lies around them."""

import dataclasses
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import mapping, packs, problem, registration, solver
from plumbline.plans.adjustment import scene_of
from plumbline.staging import staged


def seen_by_all(spark, n_frames, n_points):
    return spark.createDataFrame([(f, p) for f in range(1, n_frames + 1) for p in range(n_points)], "image_id long, point3D_id long")


@pytest.fixture(scope="module")
def scene(spark):
    """Five frames and fourteen points; all but one frame see every point."""
    reproj, state, depth, truth = scene_of(seen_by_all(spark, 5, 14).filter("image_id < 5 OR point3D_id % 2 = 0"), 0.05, 1)
    keep = lambda df: staged(df.coalesce(2), "scene")
    return keep(reproj), solver.State(keep(state.frames), keep(state.points), keep(state.affine)), keep(depth), keep(truth)


def dense(rows, damping):
    """The damped normal equations of all derivative rows, solved whole: {(kind, id): step}."""
    size = {"frame": 6, "key": 2, "point": 3}
    names = sorted({("frame", r.frame_id) for r in rows} | {("key", r.key) for r in rows if r.key is not None} | {("point", r.point3D_id) for r in rows})
    at, n = {}, 0
    for name in names:
        at[name] = n
        n += size[name[0]]
    j, e = np.zeros((len(rows), n)), np.array([r.e for r in rows])
    for i, r in enumerate(rows):
        for name, d in ((("frame", r.frame_id), r.jf), (("key", r.key), r.ja), (("point", r.point3D_id), r.jp)):
            if name in at:
                j[i, at[name] : at[name] + size[name[0]]] = d
    h = j.T @ j
    h += damping * np.diag(np.diag(h)) + np.diag(np.where(np.diag(h) == 0, 1.0, 1e-12))
    step = np.linalg.solve(h, -j.T @ e)
    return {name: step[a : a + size[name[0]]] for name, a in at.items()}


@pytest.mark.parametrize(("gauge", "in_arrays"), [("two_frames", False), ("two_frames", True), ("three_points", True)])
def test_joint_step_is_the_dense_one(scene, gauge, in_arrays):
    reproj, state, depth, _ = scene
    o = solver.Options(gauge=gauge, inner_rounds=60, inner_tolerance=1e-6, loss="huber", loss_scale=1.5)
    rows = solver._derivatives(reproj, depth, state, o, solver._gauge(state, gauge))
    expected = dense(rows.collect(), 1e-2)
    step, points = packs.step(packs.packed(rows), 1e-2, o.inner_rounds, o.inner_tolerance) if in_arrays else solver._step(rows, o, 1e-2)
    got = {(("frame", "key")[r.kind], r.id): r.x for r in step.collect()} | {("point", r.point3D_id): r.x for r in points.collect()}
    assert set(got) == set(expected)
    scale = max(np.abs(v).max() for v in expected.values())
    for name, v in expected.items():
        assert np.allclose(got[name], v, atol=1e-3 * scale), name
    assert np.allclose(got["frame", 1], 0)  # the constant frame
    if gauge == "two_frames":
        first, second, axis = problem.gauge_two_frames(state.frames)
        assert first == 1 and got["frame", second][3 + axis] == 0
    if gauge == "three_points":
        assert all(np.allclose(got["point", p], 0) for p in problem.gauge_three_points(state.points))


def test_adjustment_finds_the_true_scene(scene):
    reproj, state, depth, truth = scene
    got, costs, _ = solver.solve(reproj, state, solver.Options(rounds=3, inner_rounds=8), depth)
    assert all(b <= a for a, b in zip(costs, costs[1:], strict=False)) and costs[-1] < 1e-2 * costs[0]
    both = got.frames.join(truth.select("frame_id", F.col("translation").alias("true")), "frame_id").collect()
    assert max(np.linalg.norm(np.subtract(r.translation, r.true)) for r in both) < 0.02
    kept = solver.filtered(reproj, got, 1.0)
    assert kept.columns == reproj.columns and kept.count() == reproj.count()
    assert solver.filtered(reproj.withColumn("x", F.when(F.col("point3D_id") == 3, F.col("x") + 50).otherwise(F.col("x"))), got, 4.0).filter("point3D_id = 3").count() == 0


def test_global_refinement(scene):
    reproj, state, depth, _ = scene
    wrong = reproj.withColumn("x", F.when((F.col("point3D_id") == 2) & (F.col("frame_id") == 3), F.col("x") + 300).otherwise(F.col("x")))
    o = solver.Options(rounds=1, inner_rounds=3, loss="cauchy")
    got, kept, changes = solver.refine_globally(wrong, state, o, depth, refinements=1)
    assert changes[0] > 0 and kept.filter("point3D_id = 2 AND frame_id = 3").count() == 0
    centres = np.array([-np.array(r.rotation).reshape(3, 3).T @ r.translation for r in got.frames.collect()])
    assert np.allclose(np.median(centres, axis=0), 0, atol=1e-6) and np.linalg.norm(centres.max(0) - centres.min(0)) == pytest.approx(10)


def test_normalising_keeps_what_cameras_see(scene):
    reproj, state, depth, _ = scene
    moved, s = solver.normalised(state, 4.0)
    a, b = (solver.cost(reproj, depth, x, solver.Options()) for x in (state, moved))
    assert a["reprojection"] == pytest.approx(b["reprojection"]) and s > 0
    alpha = {r.key: r.alpha for r in moved.affine.collect()}
    assert all(alpha[r.key] == pytest.approx(r.alpha * s) for r in state.affine.collect())


POINT = "point3D_id long, xyz array<double>, is_constant boolean"


def test_three_points_fix_the_gauge(spark):
    line = [(i, [1.0 * i, 2.0 * i, 0.0], False) for i in range(6)]
    assert problem.gauge_three_points(spark.createDataFrame(line, POINT)) == [1]  # all on one line through the origin
    plane = [*line, (9, [1.0, 0.0, 0.0], False)]
    assert problem.gauge_three_points(spark.createDataFrame(plane, POINT)) == [1, 9]
    space = [*plane, (7, [5.0, 5.0, 5.0], True), (12, [0.0, 0.0, 3.0], False)]
    assert problem.gauge_three_points(spark.createDataFrame(space, POINT)) == [1, 9]  # 7 is constant already and counts


def test_two_frames_fix_the_gauge(spark):
    eye = [float(i % 4 == 0) for i in range(9)]
    schema = "frame_id long, rotation array<double>, translation array<double>, is_constant boolean"
    rows = [(1, eye, [0.0, 0.0, 0.0], False), (2, eye, [0.0, 0.0, 0.0], False), (3, eye, [0.5, -2.0, 1.0], False)]
    assert problem.gauge_two_frames(spark.createDataFrame(rows, schema)) == (1, 3, 1)
    assert problem.gauge_two_frames(spark.createDataFrame(rows[:2], schema)) is None and problem.gauge_two_frames(spark.createDataFrame([], schema)) is None


def test_maps_grow_to_all_frames(spark):
    """Frames in a chain: 5 sees nothing of what 1 and 2 see, 6 nothing of the map; 20 to 22 are a map of their own, 30 and 31 a small one."""
    sees = {1: range(0, 20), 2: range(0, 20), 3: range(6, 30), 4: range(10, 32), 5: range(18, 40), 6: range(60, 64), 20: range(100, 120), 21: range(100, 124), 22: range(104, 124), 30: range(200, 214), 31: range(200, 214)}
    seen = spark.createDataFrame([(f, p) for f, points in sees.items() for p in points], "image_id long, point3D_id long")
    reproj, state, _, truth = scene_of(seen, 0.02, 2)
    reproj = staged(reproj.coalesce(2), "pixels")
    few = {"hypotheses": 2, "refits": 0}  # no observation is wrong
    o = mapping.GrowthOptions(least_model=3, least_pair_angle=1.0, pair_trials=4, relaxations=0, adjust=solver.Options(rounds=1, inner_rounds=3))
    o.triangulation, o.resection, o.two_view = registration.Triangulation(least_angle=0.05, **few), registration.Resection(**few), registration.TwoView(**few)
    got, registered, why = mapping.grow(reproj, None, o)
    found = {r.frame_id: (r["round"], r.model) for r in registered.collect()}
    assert why == "ok" and {f: m for f, (_, m) in found.items()} == {**dict.fromkeys(range(1, 6), 1), **dict.fromkeys((20, 21, 22), 20)}
    assert found[5][0] > found[3][0] == 1 or found[5][0] > 0
    true = {r.frame_id: np.array(r.translation) for r in truth.collect()}
    poses = {r.frame_id: r for r in got.frames.collect()}
    for model in (1, 20):  # each model is the scene up to a similarity; all cameras look the same way
        ids = [f for f in found if found[f][1] == model]
        base = poses[ids[0]].rotation
        assert all(np.allclose(poses[f].rotation, base, atol=2e-3) for f in ids)
        centre = {f: -np.reshape(poses[f].rotation, (3, 3)).T @ poses[f].translation for f in ids}
        a, b = (np.array([x[f] - x[ids[0]] for f in ids[1:]]) for x in (centre, {f: -t for f, t in true.items()}))
        ratio = np.linalg.norm(a, axis=1) / np.linalg.norm(b, axis=1)
        assert np.allclose(ratio, ratio[0], rtol=0.02)
    assert {r.point3D_id for r in got.points.collect()} <= {p for f in found for p in sees[f]}
    assert mapping.grow(reproj.filter("frame_id = 6"), state, o)[2] == "no initial pair"
    capped = mapping.grow(reproj.filter("frame_id < 6"), state, dataclasses.replace(o, most_rounds=1))
    assert capped[2] == "rounds used up" and capped[0].frames.count() == 11


def test_frames_without_enough_points_go_one_after_another(spark):
    sees = {1: "abcdef", 2: "abcdef", 3: "efgh", 4: "ghij", 5: "ijk", 6: "xyz"}
    rows = [(f, ord(p)) for f, points in sees.items() for p in points]
    reproj = spark.createDataFrame(rows, "frame_id long, point3D_id long")
    kept = lambda least: sorted(r.frame_id for r in mapping.filtered_frames(reproj, reproj, least).collect())
    assert kept(2) == [1, 2, 3, 4, 5] and kept(3) == [1, 2] and kept(7) == []  # 5 goes, then 4, then 3


def test_snapshots_and_the_ledger(scene, spark, tmp_path):
    _, state, _, _ = scene
    at = mapping.write_snapshot(state, str(tmp_path), 1712345678)
    assert at.endswith("/0001712345678") and spark.read.parquet(f"{at}/frames").count() == 5
    ledger, ran = mapping.Ledger(str(tmp_path / "done"), ["a", "b", "c"]), []
    actions = {k: lambda k=k: ran.append(k) for k in "abc"}
    assert ledger.run(["a", "b"], actions, {"x": 1}) == ["a", "b"] and ledger.run(["a", "b", "c"], actions, {}) == ["c"]
    ledger._path("a").unlink()
    assert ledger.run(["a"], actions, {}, "123") == ["a"] and not ledger.done("b")  # what follows a stage is cleared
    held = json.loads(ledger._path("a").read_text())
    assert held["stage"] == "a" and held["commit"] == "123" and ran == ["a", "b", "c", "a"]
    with pytest.raises(ValueError, match="unknown"):
        ledger.run(["z"], actions, {})


def test_adjusted_scene_converges(spark, capsys):
    from plumbline.plans.adjustment import QUERIES

    rows = QUERIES["adjusted_scene"](spark, "/root/testdata/sf0.001").collect()
    before, after = (np.array([r[c] for r in rows]) for c in ("error_before", "error_after"))
    assert len(rows) == 150 and after.mean() < before.mean() / 4 and all(a == 0 for r, a in zip(rows, after, strict=True) if r.frame_id <= 2)


def test_arrays_of_more_blocks_are_added_up_in_pieces(scene, monkeypatch):
    """Five thousand frames are still arrays; pieces that tasks add up first give the same step."""
    reproj, state, depth, _ = scene
    spark = reproj.sparkSession
    many = spark.range(5000).select(F.col("id").alias("frame_id"), F.lit(None).cast("long").alias("key"), (F.col("id") % 7).alias("point3D_id"), *(F.array(*[F.lit(1.0)] * n).alias(c) for c, n in (("jf", 6), ("ja", 2), ("jp", 3))), F.lit(0.5).alias("e"))
    held = packs.packed(many)
    assert held is not None and len(held.frames) == 5000
    rows = solver._derivatives(reproj, depth, state, solver.Options(), solver._gauge(state, None))
    step = lambda: {(r.kind, r.id): r.x for r in packs.step(packs.packed(rows), 1e-2, 4, 1e-6)[0].collect()}
    whole = step()
    monkeypatch.setattr(packs, "PIECE", 40)
    monkeypatch.setattr(packs, "AT_ONCE", 0)
    pieces = step()
    assert set(whole) == set(pieces) and all(np.allclose(whole[k], pieces[k], rtol=1e-9, atol=1e-12) for k in whole)
