"""Binary and text models and point clouds, read in small parts, against readers by plain loops."""

import hashlib
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.operators.samples import exact_sample
from plumbline.sources import bytes as parts_of
from plumbline.sources import clouds, files, records


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "5000", "spark.sql.files.openCostInBytes": "1000"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def _scene(rng, n_images=40, n_points=400):
    cameras = [(i, m, 640 + i, 480, [float(x) for x in rng.uniform(1, 900, records.MODELS[m][1])]) for i, m in enumerate([1, 4, 0, 6], 1)]
    images = []
    for i in range(n_images):
        n = int(rng.choice([0, 1, 7, 60])) if i != 11 else 1500  # one list longer than a few parts
        seen = [(float(x), float(y), int(p)) for x, y, p in zip(rng.uniform(0, 640, n), rng.uniform(0, 480, n), rng.integers(-1, n_points, n), strict=True)]
        images.append((i + 1, *[float(x) for x in rng.normal(size=7)], int(rng.integers(1, 5)), f"seq {i % 3}/ünder_{i}.png" if i % 5 == 0 else f"im_{i}.png", seen))
    points = [(int(p), [float(x) for x in rng.normal(size=3)], float(rng.uniform()), [(int(a), int(b)) for a, b in rng.integers(0, 200, (int(rng.integers(0, 9)), 2))]) for p in range(n_points)]
    return cameras, images, points


def _write_binary(folder, cameras, images, points):
    with open(folder / "cameras.bin", "wb") as f:
        f.write(struct.pack("<Q", len(cameras)))
        for i, m, w, h, params in cameras:
            f.write(struct.pack(f"<IiQQ{len(params)}d", i, m, w, h, *params))
    with open(folder / "images.bin", "wb") as f:
        f.write(struct.pack("<Q", len(images)))
        for i, *pose, camera, name, seen in images:
            f.write(struct.pack("<I7dI", i, *pose, camera) + name.encode() + b"\0" + struct.pack("<Q", len(seen)))
            f.write(b"".join(struct.pack("<ddq", *s) for s in seen))
    with open(folder / "points3D.bin", "wb") as f:
        f.write(struct.pack("<Q", len(points)))
        for p, xyz, error, track in points:
            f.write(struct.pack("<Q3d3BdQ", p, *xyz, 9, 10, 11, error, len(track)) + b"".join(struct.pack("<II", *t) for t in track))


def _write_text(folder, cameras, images, points):
    words = lambda *values: " ".join(map(str, values)) + "\n"
    (folder / "cameras.txt").write_text("# cameras\n" + "".join(words(i, records.MODELS[m][0], w, h, *p) for i, m, w, h, p in cameras))
    lines = [words(i, *pose, camera, name) + words(*(v for s in seen for v in s)) for i, *pose, camera, name, seen in images]
    (folder / "images.txt").write_text("# images\n# two lines each\n" + "".join(lines))
    (folder / "points3D.txt").write_text("# points\n" + "".join(words(p, *xyz, 9, 10, 11, error, *(v for t in track for v in t)) for p, xyz, error, track in points))


def _held(model):
    plain = lambda r: tuple(tuple(v) if isinstance(v, list) else v for v in r)
    return {name: sorted(map(plain, df.collect()), key=repr) for name, df in model.items()}


def test_both_forms_of_a_model_give_the_same_tables(small_splits, tmp_path):
    spark = small_splits
    cameras, images, points = _scene(np.random.default_rng(5))
    for form, write in (("binary", _write_binary), ("text", _write_text)):
        (tmp_path / form).mkdir()
        write(tmp_path / form, cameras, images, points)
        assert files.model_form(spark, str(tmp_path / form)) == form
    text = files.read_model(spark, str(tmp_path / "text"))
    assert spark.read.text(str(tmp_path / "text" / "images.txt")).rdd.getNumPartitions() > 5
    want = {
        "cameras": [(i, records.MODELS[m][0], w, h, tuple(p)) for i, m, w, h, p in cameras],
        "images": [(i, tuple(pose[:4]), tuple(pose[4:]), camera, name) for i, *pose, camera, name, _ in images],
        "observations": [(r[0], k, x, y, None if p == -1 else p) for r in images for k, (x, y, p) in enumerate(r[-1])],
        "points": [(p, tuple(xyz), error) for p, xyz, error, _ in points],
        "tracks": [(p, *t) for p, _, _, track in points for t in track],
    }
    want = {k: sorted(v, key=repr) for k, v in want.items()}
    assert _held(text) == want
    assert _held(files.read_model(spark, str(tmp_path / "binary"), part=4096)) == want
    assert _held(files.read_model(spark, str(tmp_path / "binary"))) == want


def test_parts_hold_the_bytes_of_files(small_splits, tmp_path):
    spark = small_splits
    rng = np.random.default_rng(8)
    contents = {"a": rng.bytes(40_001), "b": b"\n" * 3 + bytes(20_000) + b"\n", "c": b"\xef\xbb\xbf" + rng.bytes(9_000), "d": b"", "e": b"\xef\xbb\xbfx\n", "f": b"x" * 8192}
    for name, content in contents.items():
        (tmp_path / f"{name}.bin").write_bytes(content)
    for length, halo, origin in ((4096, 0, 0), (1000, 1000, 0), (777, 13, 10)):
        got = {}
        for r in parts_of.parts(spark, str(tmp_path), length, halo, origin).collect():
            name = r.path[-5]
            assert r.start == origin + r.part * length and r.size == len(contents[name])
            assert bytes(r.content) == contents[name][r.start : r.start + length + halo]
            got.setdefault(name, []).append(r.part)
        for name, content in contents.items():
            assert sorted(got.get(name, [])) == list(range(-(-max(0, len(content) - origin) // length)))


def test_lines_are_numbered_across_splits(small_splits, tmp_path):
    lines = [f"{'#' if i % 7 == 0 else ''}line {i} " + "x" * (i % 90) for i in range(2000)]
    (tmp_path / "a.txt").write_text("\n".join(lines))
    (tmp_path / "b.txt").write_text("")
    got = parts_of.numbered_lines(small_splits, str(tmp_path), "#").orderBy("no").collect()
    assert [(r.no, r.line) for r in got] == list(enumerate(x for x in lines if not x.startswith("#")))


def test_broken_and_empty_models(spark, tmp_path):
    cameras, images, points = _scene(np.random.default_rng(6), 6, 30)
    _write_binary(tmp_path, cameras, images, points)
    whole = (tmp_path / "points3D.bin").read_bytes()
    (tmp_path / "points3D.bin").write_bytes(whole[:-5])
    with pytest.raises(ValueError, match="are stated"):
        files.read_model(spark, str(tmp_path))
    (tmp_path / "points3D.bin").write_bytes(struct.pack("<Q", 0))
    empty = files.read_model(spark, str(tmp_path))
    assert empty["points"].count() == 0 and empty["tracks"].count() == 0 and empty["images"].count() == 6
    with pytest.raises(FileNotFoundError):
        files.read_model(spark, str(tmp_path / "none"))


@pytest.mark.parametrize("order", ["<", ">"])
def test_point_clouds_of_both_forms(small_splits, tmp_path, order):
    spark = small_splits
    rng = np.random.default_rng(9)
    n = 3001
    record = np.dtype([("x", order + "f4"), ("y", order + "f4"), ("z", order + "f8"), ("red", "u1"), ("tag", order + "i2")])
    held = np.zeros(n, record)
    for c in "xyz":
        held[c] = rng.normal(size=n)
    held["red"], held["tag"] = rng.integers(0, 256, n), rng.integers(-999, 999, n)
    body = "comment made by hand\nelement frame 2\nproperty double s\nelement vertex {n}\nproperty float x\nproperty float32 y\nproperty double z\nproperty uchar red\nproperty short tag\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"
    name = "binary_little_endian" if order == "<" else "binary_big_endian"
    head = lambda form, n: f"ply\nformat {form} 1.0\n{body.format(n=n)}"
    binary = head(name, n).encode() + np.array([1.5, 2.5], order + "f8").tobytes() + held.tobytes() + struct.pack("B3i", 3, 0, 1, 2)
    (tmp_path / "b.ply").write_bytes(binary)
    rows = "".join(" ".join(map(str, r.tolist())) + "\n" for r in held)
    (tmp_path / "a.ply").write_text(head("ascii", n) + "1.5\n2.5\n" + rows + "3 0 1 2\n")
    want = [(i, *r.tolist()) for i, r in enumerate(held)]
    got = {f: clouds.read_points(spark, str(tmp_path / f"{f}.ply"), 4096) for f in "ab"}
    assert got["a"].schema == got["b"].schema
    for df in got.values():
        assert [tuple(r) for r in df.orderBy("index").collect()] == want
    picked = {f: sorted(r["index"] for r in exact_sample(df, ["index"], 700, 3, edge=10).collect()) for f, df in got.items()}
    assert picked["a"] == picked["b"] and len(set(picked["a"])) == 700
    (tmp_path / "b.ply").write_bytes(binary[: len(binary) // 2])
    with pytest.raises(ValueError, match="too short"):
        clouds.read_points(spark, str(tmp_path / "b.ply"))
    (tmp_path / "none.ply").write_text(head("ascii", 0) + "1.5\n2.5\n")
    assert clouds.read_points(spark, str(tmp_path / "none.ply")).count() == 0
    (tmp_path / "none.ply").write_text("solid\n")
    with pytest.raises(ValueError, match="no header"):
        clouds.read_points(spark, str(tmp_path / "none.ply"))


@pytest.mark.parametrize("n", [0, 1, 37, 499, 500, 900])
def test_samples_have_an_exact_size(spark, n):
    df = spark.range(500).select(F.when(F.col("id") != 4, F.col("id")).alias("id"), F.lit("x").alias("_order"), F.lit(1).alias("LEAD"))
    key = lambda i: hashlib.md5(f"5:{'' if i == 4 else i}".encode()).hexdigest()
    want = {None if i == 4 else i for i in sorted(range(500), key=key)[:n]}
    for edge in (1, 100_000):
        got = exact_sample(df, ["id"], n, 5, edge)
        assert got.columns == df.columns and {r.id for r in got.collect()} == want and got.count() == min(n, 500)
    same = spark.range(60).select(F.lit(7).alias("id"))
    assert exact_sample(same, ["id"], 13, edge=5).count() == 13 and exact_sample(same.limit(0), ["id"], 13).count() == 0


def test_poses_as_seven_numbers(spark):
    rng = np.random.default_rng(2)
    q = rng.normal(size=(40, 4))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    rows = [(i, [float(v) for v in a], [float(v) for v in t]) for i, (a, t) in enumerate(zip(q, rng.normal(size=(40, 3)), strict=True))]
    df = spark.createDataFrame(rows, "i int, q array<double>, t array<double>").withColumn("r", G.rotation_of(F.col("q")))
    df = df.withColumn("p", G.pose_vector(F.col("r"), F.col("t"))).withColumn("b", G.pose_of_vector(F.col("p")))
    for r in df.collect():
        assert r.p[4:] == r.t and min(np.abs(np.subtract(r.p[:4], r.q)).max(), np.abs(np.add(r.p[:4], r.q)).max()) < 1e-9
        assert np.allclose(r.b.rotation, r.r) and r.b.translation == r.t
