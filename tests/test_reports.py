"""Reports and pose transfer against numpy; exact signed ranks against all sign patterns."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import evaluation as E
from plumbline.operators import reports as R

POSE = "scene string, frame long, rotation array<double>, translation array<double>"


def turned(rng, size=1.0):
    """A rotation by a random vector."""
    w = rng.normal(size=3) * size
    a = np.linalg.norm(w)
    k = np.array([[0, -w[2], w[1]], [w[2], 0, -w[0]], [-w[1], w[0], 0]]) / a
    return np.eye(3) + np.sin(a) * k + (1 - np.cos(a)) * k @ k


def angle(a, b):
    return np.degrees(np.arccos(np.clip((np.trace(a @ b.T) - 1) / 2, -1, 1)))


@pytest.fixture(scope="module")
def cameras(spark):
    """True poses of two scenes, and the same under a similarity of the world with one camera far off."""
    rng = np.random.default_rng(14)
    truth, moved = {}, {}
    for scene in "ab":
        s, r, t = rng.uniform(0.5, 2), turned(rng), rng.normal(size=3)
        for frame in range(12):
            q, c = turned(rng), rng.normal(size=3) * 3
            truth[scene, frame] = (q, c)
            c = c + (8 if frame == 5 else 0.01) * rng.normal(size=3)
            moved[scene, frame] = (turned(rng, 0.01) @ q @ r.T, s * r @ c + t)
    table = lambda held: spark.createDataFrame([(*k, r.ravel().tolist(), (-r @ c).tolist()) for k, (r, c) in held.items()], POSE)
    return truth, moved, table(truth), table(moved)


def similarity(src, dst):
    a, b = src - src.mean(0), dst - dst.mean(0)
    u, d, v = np.linalg.svd(b.T @ a / len(a))
    sign = np.diag([1, 1, np.sign(np.linalg.det(u @ v))])
    r = u @ sign @ v
    s = np.trace(np.diag(d) @ sign) / (a * a).sum(1).mean()
    return s, r, dst.mean(0) - s * r @ src.mean(0)


def errors_by_hand(truth, moved, scene, most=None):
    names = [k for k in truth if k[0] == scene]
    src, dst = (np.array([x[k][1] for k in names]) for x in (moved, truth))
    s, r, t = similarity(src, dst)
    if most is not None:
        near = np.linalg.norm(s * src @ r.T + t - dst, axis=1) <= most
        if near.sum() >= 3:
            s, r, t = similarity(src[near], dst[near])
    pos = np.linalg.norm(s * src @ r.T + t - dst, axis=1)
    rot = np.array([angle(moved[k][0] @ r.T, truth[k][0]) for k in names])
    return dict(zip((k[1] for k in names), zip(pos, rot, strict=True), strict=True))


@pytest.mark.parametrize("most", [None, 2.5])
def test_errors_after_alignment(cameras, most):
    truth, moved, true, estimated = cameras
    errors, fits = R.aligned_errors(estimated, true, ["scene"], "frame", most)
    got = {(r.scene, r.frame): (r.pos, r.rot) for r in errors.collect()}
    assert fits.count() == 2 and len(got) == 24
    for scene in "ab":
        for frame, e in errors_by_hand(truth, moved, scene, most).items():
            assert got[scene, frame] == pytest.approx(e, abs=1e-5)
    report = {r.scene: r for r in R.truth_report(errors, ["scene"], "frame").collect()}
    for scene in "ab":
        pos, rot = (np.array(x) for x in zip(*errors_by_hand(truth, moved, scene, most).values(), strict=True))
        r = report[scene]
        assert (r.n, r.worst) == (12, int(pos.argmax()))
        assert (r.pos_mean, r.pos_median, r.pos_max, r.rot_mean) == pytest.approx((pos.mean(), np.median(pos), pos.max(), rot.mean()), abs=1e-5)


def test_poses_are_transferred_by_common_frames(cameras):
    truth, moved, true, estimated = cameras
    got = {(r.scene, r.frame): r for r in R.transferred_poses(true, estimated.filter("frame % 2 = 0"), ["scene"], "frame").collect()}
    assert len(got) == 24
    for scene in "ab":
        names = [k for k in truth if k[0] == scene and k[1] % 2 == 0]
        s, r, t = similarity(*(np.array([x[k][1] for k in names]) for x in (truth, moved)))
        for k in (k for k in truth if k[0] == scene):
            new = np.array(got[k].rotation).reshape(3, 3)
            assert np.allclose(new, truth[k][0] @ r.T, atol=1e-9) and np.allclose(-new.T @ got[k].translation, s * r @ truth[k][1] + t, atol=1e-8)


def test_lines_of_cells(spark):
    rows = spark.createDataFrame([(1, 2.345, None), (20, None, 1000.5)], "n long, a double, b double")
    got = rows.select(R.report_cells([(F.col("n"), 4, 0), (F.col("a"), 7, 2), (F.col("b"), 8, 1)]).alias("line")).collect()
    assert [r.line for r in got] == ["   1   2.35       -", "  20      -  1000.5"]


def test_exact_signed_ranks(spark):
    for n in (1, 4, 9):
        sums = [sum(r for r, s in zip(range(1, n + 1), signs, strict=True) if s) for signs in itertools.product((0, 1), repeat=n)]
        for least in range(n * (n + 1) // 4 + 1):
            assert E.exact_p(n, least) == pytest.approx(min(1.0, 2 * sum(s <= least for s in sums) / 2**n))
    rows = [("small", d) for d in (1.5, -0.25, 3.0, 4.5, 2.25, -0.5)] + [("tied", d) for d in (1.0, -1.0, 2.0, 3.0)] + [("large", (i - 20) * 1.01 + 0.3) for i in range(60)]
    got = {r.k: r for r in E.signed_rank_test(spark.createDataFrame(rows, "k string, diff double"), ["k"]).collect()}
    assert got["small"].p == pytest.approx(E.exact_p(6, 3)) and got["small"].w_minus == 3
    for k in ("tied", "large"):
        import math

        assert got[k].p == pytest.approx(math.erfc(abs(got[k].z) / math.sqrt(2)))
