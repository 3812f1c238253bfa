"""Readers and writers of databases, models, scenes and metrics, against files made by hand."""

import json
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline import schemas
from plumbline.functions import depth as D
from plumbline.functions import geometry as G
from plumbline.functions import naming
from plumbline.sources import files


def test_feature_databases(spark, tmp_path):
    points = np.arange(8, dtype="<f4").reshape(4, 2) + 0.5
    shaped = np.arange(12, dtype="<f4").reshape(2, 6)
    with sqlite3.connect(tmp_path / "rig.db") as db:
        db.execute("CREATE TABLE images (image_id, name, camera_id)")
        db.execute("CREATE TABLE cameras (camera_id, model, width, height, params)")
        db.execute("CREATE TABLE keypoints (image_id, rows, cols, data)")
        db.executemany("INSERT INTO images VALUES (?, ?, ?)", [(1, "x/one.png", 4), (2, "two.png", 4), (3, "none.png", 4)])
        db.execute("INSERT INTO cameras VALUES (4, 1, 640, 480, ?)", (np.array([500.0, 501.0, 320.0, 240.0]).tobytes(),))
        db.executemany("INSERT INTO keypoints VALUES (?, ?, ?, ?)", [(1, 4, 2, points.tobytes()), (2, 2, 6, shaped.tobytes()), (3, 0, 6, None)])
    images = files.read_database(spark, str(tmp_path), "images").orderBy("image_id").collect()
    assert [(r.image_id, r.name, r.camera_id, r.database) for r in images] == [(1, "x/one.png", 4, "rig"), (2, "two.png", 4, "rig"), (3, "none.png", 4, "rig")]
    camera = files.read_database(spark, str(tmp_path), "cameras").first()
    assert (camera.model, camera.width, camera.params) == (1, 640, [500.0, 501.0, 320.0, 240.0])
    kp = files.read_database(spark, str(tmp_path), "keypoints").orderBy("image_id", "point2D_idx").collect()
    assert [(r.x, r.y, r.a11) for r in kp[:4]] == [(*map(float, p), 0.0) for p in points]
    assert [[r.x, r.y, r.a11, r.a12, r.a21, r.a22] for r in kp[4:]] == shaped.tolist()


def test_models_are_written_and_read(spark, tmp_path):
    cameras = spark.createDataFrame([(3, "PINHOLE", 64, 48, [50.0, 51.5, 32.0, 24.0])], "camera_id long, model string, width int, height int, params array<double>")
    images = spark.createDataFrame([(i, [1.0, 0.0, 0.0, 0.0], [0.5 * i, -1.0, 2.25], 3, f"im_{i}.png") for i in (2, 1)], "image_id long, q_wxyz array<double>, translation array<double>, camera_id long, name string")
    points = spark.createDataFrame([(7, [1.0, 2.0, 3.5], 0.25), (8, [0.0, -1.0, 4.0], None)], "point3D_id long, xyz array<double>, error double")
    files.write_model(cameras, images, points, str(tmp_path))
    got = files.read_model(spark, str(tmp_path))
    assert [tuple(r) for r in got["cameras"].select("camera_id", "model", "width", "height", "params").collect()] == [tuple(r) for r in cameras.collect()]
    assert sorted(map(tuple, got["images"].select(images.columns).collect())) == sorted(map(tuple, images.collect()))
    assert {r.point3D_id: (r.xyz, r.error) for r in got["points"].collect()} == {7: ([1.0, 2.0, 3.5], 0.25), 8: ([0.0, -1.0, 4.0], -1.0)}
    assert got["observations"].count() == 0


def test_observations_of_a_model(spark, tmp_path):
    (tmp_path / "cameras.txt").write_text("# cameras\n1 PINHOLE 10 10 5 5 5 5\n")
    (tmp_path / "images.txt").write_text("# images\n4 1 0 0 0 0.5 0.5 0.5 1 a.png\n1.5 2.5 9 3.5 4.5 -1\n5 1 0 0 0 0 0 0 1 b.png\n\n")
    (tmp_path / "points3D.txt").write_text("# points\n9 1 2 3 10 20 30 0.75 4 0\n")
    got = files.read_model(spark, str(tmp_path))
    assert [tuple(r) for r in got["observations"].orderBy("point2D_idx").collect()] == [(4, 0, 1.5, 2.5, 9), (4, 1, 3.5, 4.5, None)]
    assert sorted(r.name for r in got["images"].collect()) == ["a.png", "b.png"] and got["points"].first().error == 0.75


def test_scenes_and_their_depths(spark, tmp_path):
    rng = np.random.default_rng(3)
    pts = rng.normal(size=(3, 2, 4, 3))
    pose = np.tile(np.eye(4), (3, 1, 1))
    pose[1, :3, :3] = [[0, 0, 1], [1, 0, 0], [0, 1, 0]]
    pose[:, :3, 3] = rng.normal(size=(3, 3))
    conf, sky = rng.uniform(0, 2e-4, size=(3, 2, 4)), rng.uniform(size=(3, 2, 4)) > 0.7
    np.savez_compressed(tmp_path / "room.npz", pts=pts, pose=pose, conf=conf, sky_mask=sky, unmapped_frames=np.array([2]), intrinsics=np.eye(3))
    depths = files.scene_depths(files.read_scenes(spark, str(tmp_path)))
    rows = {r.frame: r for r in depths.collect()}
    assert set(rows) == {0, 1}
    for i, r in rows.items():
        z = ((pts[i].astype(np.float32).reshape(-1, 3) - pose[i, :3, 3]) @ pose[i, :3, :3])[:, 2]
        assert np.allclose(r.estimated_depth, z, atol=1e-5) and r.valid == (~sky[i] & (conf[i].astype(np.float32) > 1e-4)).ravel().tolist()
    (given,) = files.scene_intrinsics(files.read_scenes(spark, str(tmp_path))).collect()
    assert given.scene == "room" and json.loads(given.text) == {"fx": 1.0, "fy": 1.0, "cx": 0.0, "cy": 0.0}
    share = files.positive_share(depths).first()
    values = [d for r in rows.values() for d, ok in zip(r.estimated_depth, r.valid, strict=True) if ok]
    assert share.positive == pytest.approx(np.mean(np.array(values) > 0)) and share.all_finite


def test_metrics_and_tables(spark, tmp_path):
    (tmp_path / "views.json").write_text(json.dumps({"ours_9": {"PSNR": {"a.png": 30.5, "b.png": 28.0}, "SSIM": {"a.png": 0.9}}}))
    got = files.read_view_metrics(spark, str(tmp_path / "views.json"), "ours_9").collect()
    assert {(r.metric, r.view, r.value) for r in got} == {("PSNR", "a.png", 30.5), ("PSNR", "b.png", 28.0), ("SSIM", "a.png", 0.9)}
    (tmp_path / "results.json").write_text(json.dumps({"ours_9": {"PSNR": 29.25, "LPIPS": 0.125}}))
    assert {(r.metric, r.value) for r in files.read_results(spark, str(tmp_path / "results.json"), "ours_9").collect()} == {("PSNR", 29.25), ("LPIPS", 0.125)}
    (tmp_path / "table.csv").write_text("scene,base_PSNR,gmm_all_PSNR,base_SSIM\nk1,20.5,,0.75\nMEAN,20.5,0,0.75\nN_SCENES,1,0,1\n")
    got = files.read_scene_table(spark, str(tmp_path / "table.csv"), ["PSNR", "SSIM"]).collect()
    assert {(r.scene, r.arm, r.metric, r.value) for r in got} == {("k1", "base", "PSNR", 20.5), ("k1", "gmm_all", "PSNR", None), ("k1", "base", "SSIM", 0.75)}
    (tmp_path / "m.txt").write_text("2 0 0 1\n0 2 0 -3\n0 0 2 0.5\n0 0 0 1\n")
    m = files.read_matrix(spark, str(tmp_path / "m.txt"))
    assert m.select(G.metric_scale(F.col("m")).alias("s")).first().s == pytest.approx(2.0) and m.first().m[7] == -3.0
    assert files.sampled_points(spark.range(50), 7).distinct().count() == 7 and files.sampled_points(spark.range(3), 7).count() == 3


def test_names_and_matrices(spark):
    row = spark.range(1).select(naming.utc_stamp(F.timestamp_seconds(F.lit(1_700_000_000))).alias("t")).first()
    assert row.t == "2023-11-14T22:13:20Z"
    a, b = np.arange(16.0).reshape(4, 4) + np.eye(4), np.arange(16.0)[::-1].reshape(4, 4)
    lit = lambda m: F.array(*(F.lit(float(x)) for x in np.ravel(m)))
    got = spark.range(1).select(G.left_multiply(lit(a), lit(b)).alias("p")).first().p
    assert np.allclose(np.reshape(got, (4, 4)), a @ b)


def test_missing_sigmas_take_the_given_one(spark):
    rows = spark.createDataFrame([([2.0, 3.0], [0.5, 0.25]), ([2.0, 3.0], None)], "modes array<double>, sigmas array<double>")
    assert [r.s for r in rows.select(D.sigmas_or(F.col("sigmas"), 0.1, F.col("modes")).alias("s")).collect()] == [[0.5, 0.25], [0.1, 0.1]]


def test_tables_are_made_once(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS made_once")
    try:
        for _ in range(2):
            schemas.create_tables(spark, str(tmp_path), "made_once")
            spark.sql("INSERT INTO made_once.keypoints VALUES (1, 2, 0.5, 0.5, 1, 0, 0, 1)")
        assert spark.table("made_once.keypoints").count() == 2
        assert {t.name for t in spark.catalog.listTables("made_once")} == set(schemas.TABLES)
        got = spark.table("made_once.measurements").schema
        assert {(f.name, f.dataType) for f in got} == {(f.name, f.dataType) for f in schemas.MEASUREMENT}
    finally:
        spark.sql("DROP DATABASE made_once CASCADE")
