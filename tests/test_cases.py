"""Rasters, mixtures, checks, the store, alignment, files and the stream, against their definitions on small scenes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline import schemas
from plumbline.functions import depth as D
from plumbline.functions import geometry as G
from plumbline.operators import alignment, checks, mixture, sampling
from plumbline.operators.store import Store, attach

KP = "image_id long, point2D_idx int, x float, y float, a11 float, a12 float, a21 float, a22 float"
#: a raster of 4 rows and 9 columns whose every pixel differs
DEPTH = 3 + 0.5 * np.arange(9)[None, :] + 7.25 * np.arange(4)[:, None] ** 2
PROBES = [(2.25, 1.5), (2.99, 1.01), (3.0, 1.99), (8.5, 3.5), (9.75, 0.5), (4.5, 11.0), (-3.25, 2.0), (-0.01, -0.01), (0.0, 0.0)]


def at_pixel(raster, x, y):
    """The definition: floored, and clipped into the raster."""
    v, u = (int(np.clip(math.floor(c), 0, n - 1)) for c, n in zip((y, x), raster.shape, strict=True))
    return float(raster[v, u])


def keypoints(spark, points, image=1):
    return spark.createDataFrame([(image, i, x, y, 0.0, 0.0, 0.0, 0.0) for i, (x, y) in enumerate(points)], KP)


def bundle(spark, depth, image=1, **more):
    h, w = depth.shape
    row = {"image_id": image, "h": h, "w": w, "k": 1, "estimated_depth": depth.astype(float).ravel().tolist()} | more
    kinds = {"image_id": "long", "h": "int", "w": "int", "k": "int", "sky_mask": "array<boolean>"}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} {kinds.get(c, 'array<float>')}" for c in row))


def test_pixels_are_floored_and_clipped(spark):
    got = sampling.unimodal(bundle(spark, DEPTH), keypoints(spark, PROBES)).orderBy("point2D_idx").collect()
    assert [r.estimated_depth for r in got] == [at_pixel(DEPTH, x, y) for x, y in PROBES]
    assert all(list(r.weights) == [1.0] and list(r.modes) == [r.estimated_depth] and r.sigmas is None and r.is_sky is None for r in got)


def test_optional_rasters_pass_through(spark):
    sure, sky = 1 / DEPTH, DEPTH > 60
    more = {"confidence": sure.ravel().tolist(), "sky_mask": sky.ravel().tolist()}
    got = sampling.unimodal(bundle(spark, DEPTH, **more), keypoints(spark, PROBES)).orderBy("point2D_idx").collect()
    assert [r.confidence for r in got] == pytest.approx([at_pixel(sure, *p) for p in PROBES])
    assert [r.is_sky for r in got] == [bool(at_pixel(sky, *p)) for p in PROBES] and {r.is_sky for r in got} == {True, False}


def test_mixture_stack(spark):
    planes = np.stack([DEPTH, 2 * DEPTH, DEPTH**2])
    shares = np.stack([np.full(DEPTH.shape, s) for s in (0.6, 0.3, 0.1)])
    more = {"means": planes.ravel().tolist(), "weights": shares.ravel().tolist(), "sigmas": (planes / 8).ravel().tolist()}
    got = sampling.mixture_stack(bundle(spark, DEPTH, **more).withColumn("k", F.lit(3)), keypoints(spark, PROBES)).orderBy("point2D_idx").collect()
    for r, p in zip(got, PROBES, strict=True):
        assert list(r.modes) == pytest.approx([at_pixel(x, *p) for x in planes]) and list(r.sigmas) == pytest.approx([at_pixel(x, *p) / 8 for x in planes])
        assert list(r.weights) == pytest.approx([0.6, 0.3, 0.1])
    with pytest.raises(Exception):
        sampling.mixture_stack(bundle(spark, DEPTH), keypoints(spark, PROBES)).collect()


def test_mixture_branches():
    fit = lambda y, mu0, rounds=30: mixture.fit_block(np.array([y]), np.ones((1, len(y))), np.array([mu0]), 0.05, 0.05, 0.1, rounds)[0]
    assert fit([1.5], 1.5).tolist() == [1.5, 0.05, 0.05, 0.95, 0.05]  # too few samples
    assert fit([0.7] * 11, 0.7)[0] == 0.7  # flat
    mu1, s0, s1, w0, w1 = fit([0.25] * 24 + [1.75] * 8, 0.25)
    assert mu1 == pytest.approx(1.75) and w1 == pytest.approx(1 / 4, abs=1e-6) and s0 == s1 == 0.05 and w0 + w1 == pytest.approx(1)


def test_patch_mixture_finds_the_second_surface(spark):
    """An edge between two flat surfaces: the keypoint's own depth is one mode, the other surface the second."""
    depth = np.where(np.arange(21)[None, :] < 11, 2.0, 6.0) * np.ones((21, 1))
    shaped = [(10.5, 10.5), (2.5, 10.5)]
    points = spark.createDataFrame([(1, i, x, y, 3.0, 0.0, 0.0, 3.0) for i, (x, y) in enumerate(shaped)], KP)
    edge, flat = sampling.patch_mixture(bundle(spark, depth), points).orderBy("point2D_idx").collect()
    assert edge.modes[0] == pytest.approx(2.0) and edge.modes[1] == pytest.approx(6.0, rel=0.05) and sum(edge.weights) == pytest.approx(1)
    assert list(flat.modes) == pytest.approx([2.0, 2.0])


GOOD = {"modes": [4.5], "weights": [0.8], "estimated_depth": 4.5, "sigmas": [0.2]}
MEASURES = [({}, None)] + [({c: v}, rule) for c, v, rule in (("modes", [-0.5], "modes"), ("modes", [math.nan], "modes"), ("estimated_depth", math.inf, "estimated_depth"), ("estimated_depth", 0.0, "estimated_depth"), ("weights", [-0.1], "weights"), ("weights", [1.01], "weight_sum"), ("weights", [1.0005], None), ("sigmas", [0.0], "sigmas"))]
MEASURES += [({"modes": [-0.5], "sigmas": [-1.0], "is_sky": True}, None)]


def measured(spark, rows):
    base = {"image_id": 1, "point2D_idx": 0, "confidence": None, "is_sky": None, "sensor": "s"} | GOOD
    made = [tuple((base | {"point2D_idx": i} | r)[c] for c in schemas.MEASUREMENT.fieldNames()) for i, r in enumerate(rows)]
    return spark.createDataFrame(made, schemas.MEASUREMENT)


def test_measurement_rules(spark):
    found = {r.point2D_idx: r.rule for r in checks.broken_measurements(measured(spark, [m for m, _ in MEASURES])).collect()}
    assert found == {i: rule for i, (_, rule) in enumerate(MEASURES) if rule}


def scene(spark):
    """Two images with their own rasters, and the depth of each keypoint by the definition."""
    rasters = {1: DEPTH, 2: DEPTH[::-1] * 3}
    probes = {1: PROBES[:4], 2: PROBES[4:6]}
    images = spark.createDataFrame([(1, "left.JPG"), (2, "right.JPG")], "image_id long, name string")
    kp = keypoints(spark, probes[1]).unionByName(keypoints(spark, probes[2], image=2))
    stems = lambda i, s: bundle(spark, rasters[i], image=i).drop("image_id").withColumn("stem", F.lit(s))
    depths = {i: [at_pixel(rasters[i], *p) for p in probes[i]] for i in rasters}
    return images, kp, stems(1, "left").unionByName(stems(2, "right")), depths


def test_ingest_publishes_checks_and_replaces(spark, tmp_path):
    images, kp, bundles, depths = scene(spark)
    store = Store(spark, str(tmp_path / "store"))
    attach(store, images, kp, bundles, "lidar a/b", "unimodal")
    assert sorted(r.estimated_depth for r in store.rows("lidar a/b").collect()) == pytest.approx(sorted(depths[1] + depths[2])) and store.count_rows("lidar a/b") == 6
    assert sorted(r.estimated_depth for r in store.for_image(2, "lidar a/b").collect()) == pytest.approx(sorted(depths[2]))
    with pytest.raises(ValueError, match="force"):
        attach(store, images, kp, bundles, "lidar a/b", "unimodal")
    attach(store, images, kp, bundles, "lidar a/b", "unimodal", force=True)
    assert store.count_rows("lidar a/b") == 6
    with pytest.raises(ValueError, match="right"):
        attach(store, images, kp, bundles.filter("stem = 'left'"), "other", "unimodal")
    bad = bundles.withColumn("estimated_depth", F.transform("estimated_depth", lambda x: -x))
    with pytest.raises(ValueError, match="values"):
        attach(store, images, kp, bad, "other", "unimodal")
    assert [r.sensor for r in store.sensors().collect()] == ["lidar a/b"] and store.count_rows("other") == 0
    with pytest.raises(KeyError, match="lidar"):
        store.sensor_meta("other")
    attach(store, images, kp, bundles, "other", "unimodal")
    before = sorted(str(p) for p in (tmp_path / "store" / "measurements" / "sensor_other").iterdir())
    store.delete("lidar a/b")
    assert [r.sensor for r in store.sensors().collect()] == ["other"] and store.count_rows("lidar a/b") == 0 and store.count_rows("other") == 6
    assert sorted(str(p) for p in (tmp_path / "store" / "measurements" / "sensor_other").iterdir()) == before  # no other sensor is rewritten
    assert len(list((tmp_path / "store" / "measurements").glob("*/*"))) == 1  # nothing that failed or was deleted is left
    store.delete("other")
    assert store.sensors().count() == 0


def test_rows_and_meta_change_together(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "store"))
    meta = {"sensor": "s", "num_modes": 1, "method": "unimodal", "sigma_space": "log", "has_confidence": False}
    store.write(measured(spark, [{}, {}]), meta | {"dump_hash": "first"})
    seen = lambda: (store.count_rows("s"), store.sensor_meta("s").dump_hash)
    assert seen() == (2, "first")

    def fails(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(Store, "_publish", fails)
        with pytest.raises(OSError, match="lost"):
            store.write(measured(spark, [{}]), meta | {"dump_hash": "second"}, force=True)
    assert seen() == (2, "first") and len(list((tmp_path / "store" / "measurements" / "sensor_s").iterdir())) == 1
    begun = store.rows("s")
    store.write(measured(spark, [{}]), meta | {"dump_hash": "third"}, force=True)
    assert seen() == (1, "third") and begun.count() == 2  # a reader that has begun goes on
    for n in range(3):
        store.write(measured(spark, [{}] * 3), meta | {"dump_hash": f"more {n}"}, force=True)
    assert seen() == (3, "more 2") and len(list((tmp_path / "store" / "measurements" / "sensor_s").iterdir())) == 2
    store.write(measured(spark, [{}]).limit(0), meta | {"sigma_space": None, "dump_hash": "none"}, force=True)
    assert seen() == (0, "none") and store.rows().count() == 0 and store.meta().count() == 1


def walk(plan):
    yield plan
    for i in range(plan.children().size()):
        yield from walk(plan.children().apply(i))


def test_no_raster_goes_through_the_fit(spark):
    """What meets the Python worker is a keypoint's samples and what was read at its pixel."""
    _, kp, bundles, _ = scene(spark)
    named = bundles.withColumn("image_id", F.when(F.col("stem") == "left", 1).otherwise(2).cast("long"))
    plan = sampling.EXTRACTORS["gmm_patch"](named, kp)._jdf.queryExecution().optimizedPlan()
    fits = [n for n in walk(plan) if n.nodeName() == "MapInArrow"]
    assert len(fits) == 1
    held = {a.split("#")[0] for a in fits[0].children().apply(0).output().mkString(" ").split()}
    assert "ys" in held and "estimated_depth" in held and not any(c.startswith("b_") for c in held)


@pytest.mark.parametrize("size", [1, 3, 100])
def test_tiles_give_the_rows_of_whole_rasters(spark, size):
    rng = np.random.default_rng(6)
    h, w, k = 9, 14, 2
    floats = lambda n: rng.uniform(1, 9, n).round(3).tolist()
    rows = [(i, h, w, k, floats(h * w), floats(h * w), (rng.random(h * w) > 0.7).tolist(), floats(k * h * w), [0.5] * (k * h * w), floats(k * h * w)) for i in (1, 2)]
    rows.append((3, 2, 3, 1, floats(6), None, None, None, None, None))
    bundles = spark.createDataFrame(rows, "image_id long, h int, w int, k int, estimated_depth array<float>, confidence array<float>, sky_mask array<boolean>, means array<float>, weights array<float>, sigmas array<float>")
    probes = [(i, n, float(x), float(y), float(s), 0.0, 0.0, float(s)) for i in (1, 2, 3) for n, (x, y, s) in enumerate(zip(rng.uniform(-1, w + 1, 40), rng.uniform(-1, h + 1, 40), rng.choice([0.2, 0.5, 1.1], 40), strict=True))]
    kp = spark.createDataFrame(probes, "image_id long, point2D_idx int, x double, y double, a11 double, a12 double, a21 double, a22 double")
    for method in ("unimodal", "gmm_patch", "mda_native"):
        some = bundles if method != "mda_native" else bundles.filter("k > 1")
        whole = {(r.image_id, r.point2D_idx): tuple(r) for r in sampling.EXTRACTORS[method](some, kp).collect()}
        cut = sampling.EXTRACTORS[method](some, kp, {"tile": size})
        got = {(r.image_id, r.point2D_idx): tuple(r) for r in cut.collect()}
        assert got == whole and len(got) == (120 if method != "mda_native" else 80)
    sized = sampling.tiles(bundles, 4, 1).filter("image_id = 1").collect()
    assert len(sized) == 12 and all(r.th <= 6 and r.tw <= 6 and len(r.estimated_depth) == r.th * r.tw for r in sized)


def test_duplicates_and_unknown_spaces_are_refused(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    meta = {"sensor": "s", "num_modes": 1, "method": "unimodal", "sigma_space": "log", "has_confidence": False}
    with pytest.raises(ValueError, match="duplicate"):
        store.write(measured(spark, [{"point2D_idx": 4}, {"point2D_idx": 4}]), meta)
    with pytest.raises(ValueError, match="cubic"):
        store.write(measured(spark, [{}]), meta | {"sigma_space": "cubic"})
    with pytest.raises(ValueError, match="num_modes"):
        store.write(measured(spark, [{}]), meta | {"num_modes": 2})
    with pytest.raises(ValueError, match="NaN"):
        store.write(measured(spark, [{"confidence": math.nan}]), meta)
    store.write(measured(spark, [{}, {}]), meta)
    assert store.factors("s", "log").count() == 2
    with pytest.raises(NotImplementedError, match="linear"):
        store.factors("s", "linear")


def rotation(rng):
    q, r = np.linalg.qr(rng.normal(size=(3, 3)))
    q = q * np.sign(np.diag(r))
    return q if np.linalg.det(q) > 0 else -q


SCALE, SHIFT = 0.83, np.array([4.0, 0.25, -7.5])


def corresponding(spark, n, seed, wrong=0):
    rng = np.random.default_rng(seed)
    r, p = rotation(rng), rng.uniform(-2, 2, size=(n, 3))
    q = SCALE * p @ r.T + SHIFT
    q[:wrong] += rng.choice([-1, 1], size=(wrong, 3)) * rng.uniform(20, 60, size=(wrong, 3))
    rows = [("g", i, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(p, q, strict=True))]
    return spark.createDataFrame(rows, "g string, i long, sx double, sy double, sz double, dx double, dy double, dz double"), r


def test_similarity_is_recovered(spark):
    pairs, r = corresponding(spark, 60, 21)
    fit = alignment.align(pairs, ["g"]).first()
    assert fit.scale == pytest.approx(SCALE, abs=1e-10)
    assert np.allclose(np.array(fit.rotation).reshape(3, 3), r, atol=1e-10) and np.allclose(fit.translation, SHIFT, atol=1e-9)


def test_gross_errors_are_trimmed(spark):
    pairs, r = corresponding(spark, 150, 22, wrong=12)
    _, judged = alignment.align_robust(pairs, ["g"])
    inliers = {x.i for x in judged.filter("inlier").collect()}
    assert len(inliers) >= 100 and not inliers & set(range(12))
    again, judged = alignment.align_robust(judged.filter("inlier").drop("residual", "inlier"), ["g"])
    assert again.first().scale == pytest.approx(SCALE, rel=1e-6)
    assert alignment.inlier_rms(judged, ["g"]).first().rms < 1e-6


def test_poses_move_with_a_similarity(spark):
    rng = np.random.default_rng(31)
    r, r_cw, t, t_cw, s = rotation(rng), rotation(rng), rng.normal(size=3), rng.normal(size=3), 0.6
    lit = lambda a: F.array(*(F.lit(float(x)) for x in np.ravel(a)))
    made = spark.range(1).select(G.pose_in_similarity(F.lit(s), lit(r), lit(t), lit(r_cw), lit(t_cw)).alias("p"), G.quaternion_of(lit(r)).alias("q")).first()
    new = np.array(made.p.rotation).reshape(3, 3)
    centre = s * r @ (-r_cw.T @ t_cw) + t
    assert np.allclose(new, r_cw @ r.T) and np.allclose(-new.T @ np.array(made.p.translation), centre)
    w, x, y, z = made.q
    back = spark.range(1).select(G.rotation_of(lit([x, y, z, w])).alias("r")).first().r
    assert np.allclose(np.array(back).reshape(3, 3), r)


def tie(modes, sigma, weights):
    """The log depth at which two modes of one sigma cost the same: where (L - l0)^2 - (L - l1)^2 = 2 sigma^2 ln(w0 / w1)."""
    l0, l1 = map(math.log, modes)
    return (l1 * l1 - l0 * l0 + 2 * sigma**2 * math.log(weights[0] / weights[1])) / (2 * (l1 - l0))


TIE = tie((1.5, 2.4), 0.2, (0.7, 0.3))


@pytest.mark.parametrize(
    ("z", "modes", "sigmas", "weights", "alpha", "beta", "winner", "wh"),
    [
        (4.0, [4.0, 9.0], [0.2, 0.2], [0.5, 0.5], 1.0, 0.0, 0, 0.0),
        (9.0, [4.0, 9.0], [0.2, 0.2], [0.5, 0.5], 1.0, 0.0, 1, 0.0),
        (3.3, [3.0, 3.3], [0.04, 0.9], [0.5, 0.5], 1.0, 0.0, 0, (math.log(3.3) - math.log(3)) / 0.04),  # exact, but too wide to win
        (math.exp(TIE - 0.005), [1.5, 2.4], [0.2, 0.2], [0.7, 0.3], 1.0, 0.0, 0, None),
        (math.exp(TIE + 0.005), [1.5, 2.4], [0.2, 0.2], [0.7, 0.3], 1.0, 0.0, 1, None),
        (5.0, [4.0], [0.3], [1.0], 1.25, 0.0, 0, 0.0),
        (5.0, [4.0], [0.3], [1.0], 0.5, 3.0, 0, 0.0),
    ],
)
def test_winning_mode(spark, z, modes, sigmas, weights, alpha, beta, winner, wh):
    lit = lambda a: F.array(*(F.lit(x) for x in a))
    r = spark.range(1).select(D.max_mixture(F.lit(z), lit(modes), lit(sigmas), lit(weights), F.lit(alpha), F.lit(beta)).alias("m")).first().m
    assert r.mode == winner
    if wh is not None:
        assert r.wh == pytest.approx(wh, abs=1e-10)


def save(path, **arrays):
    np.savez_compressed(path, **arrays)


def full_bundle():
    rng = np.random.default_rng(41)
    return {"estimated_depth": rng.uniform(2, 5, (3, 10)), "means": rng.uniform(2, 5, (2, 3, 10)), "weights": np.full((2, 3, 10), 0.5), "sigmas": rng.uniform(0.1, 0.4, (2, 3, 10)), "confidence": rng.uniform(size=(3, 10)), "sky_mask": rng.uniform(size=(3, 10)) > 0.5}


def test_bundle_files(spark, tmp_path):
    from plumbline.sources.files import bundle_files, bundle_stems, dump_digest, read_bundles, write_bundles

    full, folder = full_bundle(), tmp_path / "in"
    folder.mkdir()
    save(folder / "full.npz", **full)
    save(folder / "least.npz", estimated_depth=np.full((3, 10), 2.5))
    read = read_bundles(spark, str(folder), (3, 10))
    rows = {r.stem: r for r in read.collect()}
    assert rows["full"].k == 2 and all(np.allclose(getattr(rows["full"], c), v.ravel(), rtol=1e-6) for c, v in full.items())
    assert rows["least"].means is None and (rows["least"].h, rows["least"].w) == (3, 10)
    assert {r.stem for r in bundle_stems(spark, str(folder)).collect()} == {"full", "least"}
    assert len(dump_digest(spark, str(folder))) == 64
    with pytest.raises(Exception, match="grid"):
        read_bundles(spark, str(folder), (3, 9)).collect()
    # written as a table, and as files again
    write_bundles(read, str(tmp_path / "table"), (3, 10))
    assert {r.stem: r for r in spark.read.parquet(str(tmp_path / "table")).collect()} == rows
    with pytest.raises(ValueError, match="grid"):
        write_bundles(read, str(tmp_path / "other"), (3, 9))
    back = tmp_path / "back"
    back.mkdir()
    for r in bundle_files(read).collect():
        (back / f"{r.stem}.npz").write_bytes(r.content)
    assert {r.stem: r for r in read_bundles(spark, str(back)).collect()} == rows


BROKEN = [{"means": np.ones((2, 3, 10))}, {"odd": np.ones(3)}, {"confidence": np.ones((4, 10))}, {"sigmas": np.ones((2, 3, 10))}, {"means": np.ones((2, 3, 10)), "weights": np.ones((3, 3, 10))}]


@pytest.mark.parametrize("arrays", BROKEN)
def test_broken_bundles(spark, tmp_path, arrays):
    from plumbline.sources.files import read_bundles

    save(tmp_path / "a.npz", estimated_depth=np.ones((3, 10)), **arrays)
    with pytest.raises(Exception):
        read_bundles(spark, str(tmp_path)).collect()


def test_rules_of_bundle_rows(spark):
    pixels, half = [1.0] * 6, [1.0] * 3
    rows = [  # id, h, w, k, estimated_depth, means, weights, sigmas, confidence, sky
        (1, 2, 3, 1, pixels, None, None, None, None, None, []),
        (2, 2, 3, 1, half, None, None, None, None, None, ["estimated_depth"]),
        (3, 2, 3, 2, pixels, pixels * 2, pixels * 2, pixels, None, None, ["sigmas"]),
        (4, 2, 3, 1, pixels, pixels, None, None, half, [True], ["confidence", "sky_mask", "pairing"]),
        (5, 2, 3, 2, pixels, None, None, pixels * 2, None, None, ["lone_sigmas"]),
        (6, 3, 2, 1, pixels, None, None, None, None, None, ["grid"]),
    ]
    schema = "image_id long, h int, w int, k int, estimated_depth array<float>, means array<float>, weights array<float>, sigmas array<float>, confidence array<float>, sky_mask array<boolean>"
    got = checks.bundle_problems(spark.createDataFrame([r[:-1] for r in rows], schema), (2, 3)).collect()
    assert sorted((r.image_id, r.rule) for r in got) == sorted((r[0], rule) for r in rows for rule in r[-1])


def test_streamed_ingest_is_the_batch_one(spark, tmp_path):
    from plumbline.streaming.ingest import bundle_stream, start_ingest

    folder = tmp_path / "in"
    folder.mkdir()
    images, kp, _, depths = scene(spark)
    found = lambda: sorted(r.estimated_depth for r in spark.read.parquet(str(tmp_path / "out")).collect())
    for name, raster, expected in (("left", DEPTH, depths[1]), ("right", DEPTH[::-1] * 3, depths[1] + depths[2])):
        save(folder / f"{name}.npz", estimated_depth=raster)
        start_ingest(bundle_stream(spark, str(folder)), images, kp, "unimodal", str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        assert found() == pytest.approx(sorted(expected))


def test_settings_refuse_unknown_keys():
    from plumbline.config import DepthAdjustment

    with pytest.raises(ValueError):
        DepthAdjustment.from_dict({"sigmas": 1})
    with pytest.raises(ValueError):
        DepthAdjustment(depth_space="cubic")
    assert DepthAdjustment(placement="local").active(False) and not DepthAdjustment(placement="local").active(True)
