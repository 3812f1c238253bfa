"""Points, poses and two-view geometry: exact on scenes without noise, against numpy and the truth with wrong observations."""

import numpy as np
import pytest

from plumbline.operators import registration

FOCAL, CX, CY = 500.0, 320.0, 240.0
ROW = "frame_id long, point3D_id long, x double, y double, fx double, fy double, cx double, cy double"
FRAME = "frame_id long, rotation array<double>, translation array<double>"
POINT = "point3D_id long, xyz array<double>"


def rotation(rng, size):
    axis = rng.normal(size=3)
    axis *= size / np.linalg.norm(axis)
    k = np.array([[0, -axis[2], axis[1]], [axis[2], 0, -axis[0]], [-axis[1], axis[0], 0]])
    return np.eye(3) + np.sin(size) / size * k + (1 - np.cos(size)) / size**2 * k @ k


@pytest.fixture(scope="module")
def world():
    rng = np.random.default_rng(8)
    points = {i: rng.uniform([-3, -3, 6], [3, 3, 12]) for i in range(80)}
    frames = {i: (rotation(rng, 0.3), rng.uniform(-1.5, 1.5, 3)) for i in range(12)}
    return points, frames


def pixels(points, frames, wrong=(), noise=0.0, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for f, (r, t) in frames.items():
        for p, x in points.items():
            c = r @ x + t
            at = FOCAL * c[:2] / c[2] + [CX, CY] + noise * rng.normal(size=2)
            if (f, p) in wrong:
                at += rng.uniform(40, 200, 2) * rng.choice([-1, 1], 2)
            rows.append((f, p, float(at[0]), float(at[1]), FOCAL, FOCAL, CX, CY))
    return rows


def frame_rows(frames):
    return [(f, r.reshape(-1).tolist(), t.tolist()) for f, (r, t) in frames.items()]


def point_rows(points):
    return [(p, x.tolist()) for p, x in points.items()]


def some_wrong(points, frames, share, seed=3):
    rng = np.random.default_rng(seed)
    return {(f, p) for f in frames for p in points if rng.random() < share}


@pytest.mark.parametrize("share", [0.0, 0.2])
def test_points_are_found_exactly(spark, world, share):
    points, frames = world
    wrong = some_wrong(points, frames, share)
    rows = pixels(points, frames, wrong)
    rows += [(0, 900, 10.0, 10.0, FOCAL, FOCAL, CX, CY), (1, None, 1.0, 1.0, FOCAL, FOCAL, CX, CY), (None, 3, 1.0, 1.0, FOCAL, FOCAL, CX, CY), rows[0]]
    got = registration.triangulate(spark.createDataFrame(rows, ROW), spark.createDataFrame(frame_rows(frames), FRAME)).collect()
    assert {r.point3D_id for r in got} == set(points)  # 900 is seen once
    for r in got:
        assert np.allclose(r.xyz, points[r.point3D_id], atol=1e-6)
        assert r.n == len(frames) and r.n_inliers == len(frames) - sum((f, r.point3D_id) in wrong for f in frames) and r.rms < 1e-6
        seen = [f for f in sorted(frames) if (f, r.point3D_id) not in wrong]
        rays = [points[r.point3D_id] + frames[f][0].T @ frames[f][1] for f in seen]
        angles = [np.degrees(np.arccos(np.clip(a @ rays[0] / np.linalg.norm(a) / np.linalg.norm(rays[0]), -1, 1))) for a in rays]
        assert r.angle == pytest.approx(max(angles), abs=1e-4)


def test_points_without_hypotheses_are_numpy_least_squares(spark, world):
    points, frames = world
    rows = pixels(points, frames, noise=0.5)
    o = registration.Triangulation(hypotheses=1, draw=100, refits=0)
    got = {r.point3D_id: r.xyz for r in registration.triangulate(spark.createDataFrame(rows, ROW), spark.createDataFrame(frame_rows(frames), FRAME), o).collect()}
    for p in points:
        lines = []
        for f, q, x, y, *_ in rows:
            if q == p:
                u, v = (x - CX) / FOCAL, (y - CY) / FOCAL
                m = np.column_stack([frames[f][0], frames[f][1]])
                lines += [(u * m[2] - m[0]) / np.sqrt(1 + u * u + v * v), (v * m[2] - m[1]) / np.sqrt(1 + u * u + v * v)]
        h = np.linalg.svd(np.array(lines))[2][-1]
        assert np.allclose(got[p], h[:3] / h[3], atol=1e-6)


def test_narrow_points_and_points_behind_are_left_out(spark):
    frames = {1: (np.eye(3), np.zeros(3)), 2: (np.eye(3), np.array([-0.001, 0, 0])), 3: (np.eye(3), np.array([-2.0, 0, 0]))}
    near, behind = {1: np.array([0.1, 0.2, 5.0])}, {2: np.array([0.1, 0.2, -5.0])}
    rows = pixels(near, {k: frames[k] for k in (1, 2)}) + pixels(behind, frames)
    poses = spark.createDataFrame(frame_rows(frames), FRAME)
    assert registration.triangulate(spark.createDataFrame(rows, ROW), poses).collect() == []
    rows += pixels(near, {3: frames[3]})
    assert [r.point3D_id for r in registration.triangulate(spark.createDataFrame(rows, ROW), poses).collect()] == [1]
    assert registration.triangulate(spark.createDataFrame([], ROW), poses).collect() == []


@pytest.mark.parametrize("share", [0.0, 0.3])
def test_poses_are_found_exactly(spark, world, share):
    points, frames = world
    wrong = some_wrong(points, frames, share)
    few = {p: points[p] for p in list(points)[:5]}
    rows = pixels(points, frames, wrong) + pixels(few, {100: frames[0]})
    flat = {1000 + i: np.array([i % 4, i // 4, 8.0]) for i in range(16)}
    rows += pixels(flat, {101: frames[1]})
    got = registration.resect(spark.createDataFrame(rows, ROW), spark.createDataFrame(point_rows(points | flat), POINT)).collect()
    assert {r.frame_id for r in got} == set(frames)  # five points and one plane are not enough
    for r in got:
        turn, move = frames[r.frame_id]
        assert np.allclose(np.reshape(r.rotation, (3, 3)), turn, atol=1e-6) and np.allclose(r.translation, move, atol=1e-6)
        assert r.n == len(points) and r.n_inliers == len(points) - sum((r.frame_id, p) in wrong for p in points)


def test_poses_with_noise_are_close(spark, world):
    points, frames = world
    rows = pixels(points, frames, some_wrong(points, frames, 0.2), noise=0.5)
    for r in registration.resect(spark.createDataFrame(rows, ROW), spark.createDataFrame(point_rows(points), POINT)).collect():
        turn, move = frames[r.frame_id]
        assert np.abs(np.reshape(r.rotation, (3, 3)) - turn).max() < 0.01 and np.abs(np.subtract(r.translation, move)).max() < 0.1
        assert np.allclose(np.reshape(r.rotation, (3, 3)) @ np.reshape(r.rotation, (3, 3)).T, np.eye(3), atol=1e-9)


@pytest.mark.parametrize("share", [0.0, 0.2])
def test_relative_poses_are_found_exactly(spark, world, share):
    points, frames = world
    rng = np.random.default_rng(5)
    rows, pairs = [], [(0, 1), (2, 7), (4, 3)]
    for a, b in pairs:
        for p, x in points.items():
            ca, cb = (frames[f][0] @ x + frames[f][1] for f in (a, b))
            off = rng.uniform(0.1, 0.4, 2) * (rng.random() < share)
            rows.append((a, b, p, *map(float, ca[:2] / ca[2]), *map(float, cb[:2] / cb[2] + off), FOCAL))
    got = registration.relative_poses(spark.createDataFrame(rows, "id_a long, id_b long, match_id long, ua double, va double, ub double, vb double, focal double"), registration.TwoView(most_error=0.01)).collect()
    assert sorted((r.id_a, r.id_b) for r in got) == sorted(pairs)
    for r in got:
        (ra, ta), (rb, tb) = frames[r.id_a], frames[r.id_b]
        turn, move = rb @ ra.T, tb - rb @ ra.T @ ta
        assert np.allclose(np.reshape(r.rotation, (3, 3)), turn, atol=1e-5) and np.allclose(r.translation, move / np.linalg.norm(move), atol=1e-5)
        assert r.n_front == r.n_inliers
        centre = lambda f: -frames[f][0].T @ frames[f][1]
        rays = [(x - centre(r.id_a), x - centre(r.id_b)) for x in points.values()]
        assert abs(r.angle - np.mean([np.degrees(np.arccos(a @ b / np.linalg.norm(a) / np.linalg.norm(b))) for a, b in rays])) < (0.01 if share == 0 else 2)
