"""Models made in tasks against those made by tables, and what staged tables leave."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_registration import FRAME, POINT, ROW, frame_rows, pixels, point_rows, some_wrong, world  # noqa: F401

from plumbline.operators import groups, registration
from plumbline.staging import staged


@pytest.mark.parametrize("most", [0, 9])
def test_groups_in_tasks_are_those_by_tables(spark, world, monkeypatch, most):  # noqa: F811
    """Most rows of a group: none (all go by tables) and nine (points of twelve views do, those of eight do not)."""
    points, frames = world
    few = {f: frames[f] for f in range(8)}
    half = [{p: x for p, x in points.items() if p % 2 == i} for i in (0, 1)]
    wrong = some_wrong(points, frames, 0.2)
    rows = pixels(half[0], frames, wrong, 0.3) + pixels(half[1], few, wrong, 0.3, 2)
    seen, at, known = spark.createDataFrame(rows + rows[:5], ROW), spark.createDataFrame(frame_rows(frames), FRAME), spark.createDataFrame(point_rows(points), POINT)

    def both():
        order = lambda df, k: {r[k]: (r.n, r.n_inliers, r.rms, *(v for c in df.columns if isinstance(r[c], list) for v in r[c]), r["angle"] if "angle" in df.columns else 0) for r in df.collect()}
        return order(registration.triangulate(seen, at), "point3D_id"), order(registration.resect(seen, known), "frame_id")

    here = both()
    monkeypatch.setattr(groups, "MOST_ROWS", most)
    for a, b in zip(here, both(), strict=True):
        assert set(a) == set(b) and len(a) in (80, 12)
        assert all(a[k][:2] == b[k][:2] and np.allclose(a[k], b[k], rtol=1e-7, atol=1e-7) for k in a)


def test_drawn_rows_are_those_of_the_tables_hash(spark):
    df = spark.range(-20, 20).select("id", (F.col("id") * 1.5).alias("x"))
    got = df.select(F.xxhash64("id", "x").alias("s"), F.xxhash64("id", "x", F.lit(1)).alias("h1"), F.xxhash64("id", "x", F.lit(128)).alias("h128")).collect()
    seeds = np.array([r.s for r in got]).view(np.uint64)
    for h in (1, 128):
        assert groups.hashed(seeds, h).view(np.int64).tolist() == [r[f"h{h}"] for r in got]


def test_staged_tables_leave_no_exchanges(spark):
    files = lambda: sum(f.getName().startswith("shuffle") for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()))
    before = files()
    held = staged(spark.range(10_000).groupBy((F.col("id") % 7).alias("k")).count().repartition(3, "count"), "counts")
    assert files() <= before
    assert held.count() == 7
