"""Pairs over whole tables, against brute force on small fixtures."""

from collections import Counter

import pytest

from plumbline.operators import pairing
from plumbline.plans import registry


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("pairs"))
    spark.createDataFrame([(k, k % 3) for k in range(1, 621)], "c_custkey long, c_nationkey long").write.parquet(f"{d}/customer.parquet")
    spark.createDataFrame([(n, 1 + n % 70 * 9) for n in range(400)], "o_orderkey long, o_custkey long").write.parquet(f"{d}/orders.parquet")
    lines = [(n, (n * m * m) % 1201, float(n * m % 13 + 1)) for n in range(400) for m in range(1, 6)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_quantity double").write.parquet(f"{d}/lineitem.parquet")
    return d


def _pairs(scenes):
    return Counter((s, a, b) for s, ids in scenes.items() for a in ids for b in ids if a < b)


def test_exhaustive_pairs_of_all_customers(spark, folder):
    got = Counter(tuple(r) for r in registry.QUERIES["exhaustive_pairs"](spark, folder).select("scene", "id_a", "id_b").collect())
    assert got == _pairs({s: [k for k in range(1, 621) if k % 3 == s] for s in range(3)})


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_exhaustive_pairs_in_blocks(spark, block):
    scenes = {1: [*range(40), 5, 5], 2: [9], None: [1, 2]}
    rows = [(s, i) for s, ids in scenes.items() for i in ids] + [(1, None)]
    got = pairing.exhaustive_pairs(spark.createDataFrame(rows, "scene long, image_id long"), ["scene"], block)
    assert Counter(tuple(r) for r in got.collect()) == _pairs({s: scenes[s] for s in (1, 2)})


def test_initial_pairs_of_all_images(spark, folder):
    points = {}
    for n in range(400):
        for m in range(1, 6):
            if n * m % 13 + 1 > 5:
                points.setdefault(1 + n % 70 * 9, set()).add((n * m * m) % 1201)
    expected = {(a, b, len(points[a] & points[b])) for a in points for b in points if a < b and len(points[a] & points[b]) >= 2}
    got = registry.QUERIES["initial_pairs"](spark, folder).select("id_a", "id_b", "shared").collect()
    assert len(got) == len(expected) and {tuple(r) for r in got} == expected and any(a > 60 for a, _, _ in expected)


def test_blocks_are_not_sent_to_all_tasks(spark, folder):
    """The sides of the pairs' join are many times the table they come from, which alone the planner knows."""
    plan = registry.QUERIES["exhaustive_pairs"](spark, folder)._jdf.queryExecution().sparkPlan().toString()
    assert any("SortMergeJoin" in line and "_p#" in line and "_q#" in line for line in plan.splitlines())
