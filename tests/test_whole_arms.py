"""Scenes with all arms over all images of the view, with misses that whole tables do not have."""

from plumbline.plans import registry
from plumbline.plans import views as V


def test_scenes_with_all_arms_through_any_image(spark, tmp_path):
    d = str(tmp_path)
    # scene 1: all arms through image 40 only; 2: the fifth arm in image 49 only; 3: four arms; 4: one arm in many images; 5: no orders
    seen = {1: [(40, V.ARMS)], 2: [(1, V.ARMS[:4]), (49, V.ARMS[4:])], 3: [(0, V.ARMS[:4]), (30, V.ARMS[:4])], 4: [(i, V.ARMS[:1]) for i in range(50)], 5: []}
    spark.createDataFrame([(scene * 50 + i, scene) for scene in seen for i in range(50)], "c_custkey long, c_nationkey long").write.parquet(f"{d}/customer.parquet")
    orders = [(scene * 50 + i, a, 1.0) for scene, images in seen.items() for i, arms in images for a in arms]
    spark.createDataFrame(orders, "o_custkey long, o_orderpriority string, o_totalprice double").write.parquet(f"{d}/orders.parquet")
    assert sorted(r.scene for r in registry.QUERIES["all_arms_scenes"](spark, d).collect()) == [1, 2]
