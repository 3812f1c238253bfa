"""Derived views: the driver's tables read as rasters, keypoints, measurements, arms, poses and observations.

Each view is defined twice by the same arithmetic, as a DataFrame and as a DuckDB CTE of the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGES = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SQL: dict[str, str] = {}


def bundle(spark, d) -> DataFrame:
    """8x8 rasters: the exponential of embedding components."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.lit(8).alias("h"), F.lit(8).alias("w"), F.lit(1).alias("k"), F.transform("embedding", lambda e: F.exp(e.cast("double"))).alias("estimated_depth"))


SQL["bundle"] = "SELECT vec_id AS image_id, 8 AS h, 8 AS w, list_transform(embedding, lambda e: exp(e::DOUBLE)) AS estimated_depth FROM embeddings"


def stack(spark, d) -> DataFrame:
    """Four planes of 4x4: the same numbers as a mixture."""
    depth = F.transform("embedding", lambda e: F.exp(e.cast("double")))
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("image_id"), F.lit(4).alias("h"), F.lit(4).alias("w"), F.lit(4).alias("k"),
        F.slice(depth, 1, 16).alias("estimated_depth"), depth.alias("means"),
        F.transform(depth, lambda x: F.lit(0.25)).alias("weights"), F.transform(depth, lambda x: 0.1 * x).alias("sigmas"),
    )


SQL["stack"] = """SELECT vec_id AS image_id, list_transform(embedding, lambda e: exp(e::DOUBLE)) AS means FROM embeddings"""


def kp(spark, d) -> DataFrame:
    """Keypoints of 500 images, some outside the raster, with isotropic to elongated shapes."""
    e = F.col("event_id")
    return table(spark, d, "events").select(
        (e % IMAGES).alias("image_id"), F.floor(e / IMAGES).cast("int").alias("point2D_idx"),
        ((e * 53) % 97 / 10.0 - 0.5).alias("x"), ((e * 37) % 91 / 10.0 - 0.5).alias("y"),
        (0.3 + (F.col("user_id") % 5) * 0.2).alias("a11"), F.lit(0.0).alias("a12"), F.lit(0.0).alias("a21"), (0.3 + (F.col("user_id") % 3) * 0.2).alias("a22"),
        (F.col("event_type") == "error").alias("is_sky"), "event_id", "event_type", "value", "user_id",
    )


SQL["kp"] = """SELECT event_id % 500 AS image_id, (event_id // 500)::INT AS point2D_idx,
    ((event_id * 53) % 97)::DOUBLE / 10.0::DOUBLE - 0.5::DOUBLE AS x, ((event_id * 37) % 91)::DOUBLE / 10.0::DOUBLE - 0.5::DOUBLE AS y,
    0.3::DOUBLE + (user_id % 5) * 0.2::DOUBLE AS a11, 0.3::DOUBLE + (user_id % 3) * 0.2::DOUBLE AS a22,
    event_type = 'error' AS is_sky, event_id, event_type, value, user_id FROM events"""


def meas(spark, d) -> DataFrame:
    """Two-mode measurements with broken rows among them."""
    li = table(spark, d, "lineitem")
    return li.select(
        F.col("l_returnflag").alias("sensor"), (F.col("l_orderkey") % IMAGES).alias("image_id"), F.col("l_partkey").cast("int").alias("point2D_idx"),
        F.array(F.col("l_quantity") - 1, F.col("l_extendedprice") / 1000).alias("modes"),
        F.array(F.col("l_discount") * 8, F.lit(0.5)).alias("weights"), (F.col("l_quantity") - 2).alias("estimated_depth"),
        F.array(F.col("l_tax"), F.lit(0.1)).alias("sigmas"), F.col("l_discount").alias("confidence"), (F.col("l_linestatus") == "O").alias("is_sky"),
    )


SQL["meas"] = """SELECT l_returnflag AS sensor, l_orderkey % 500 AS image_id, l_partkey::INT AS point2D_idx,
    [l_quantity - 1, l_extendedprice / 1000] AS modes, [l_discount * 8, 0.5::DOUBLE] AS weights, l_quantity - 2 AS estimated_depth,
    [l_tax, 0.1::DOUBLE] AS sigmas, l_linestatus = 'O' AS is_sky FROM lineitem"""


def arm(spark, d) -> DataFrame:
    """Metric of an image in a scene under an arm: mean order prices."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").alias("scene"), F.col("o_orderpriority").alias("arm"), (F.col("o_custkey") % 50).alias("img")).agg((F.avg("o_totalprice") / 9973).alias("psnr"))


SQL["arm"] = "SELECT c_nationkey AS scene, o_orderpriority AS arm, o_custkey % 50 AS img, avg(o_totalprice) / 9973 AS psnr FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL"
ARMS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
BASELINE = ARMS[0]

QUATERNION = "qx, qy, qz, qw"


def _rotation(k, a: int, b: int, c: int):
    """Unit quaternion and rotation of a number, with factors that set how rotations differ."""
    x, y, z = (k * a % 101) / 101.0 - 0.5, (k * b % 97) / 97.0 - 0.5, (k * c % 89) / 89.0 - 0.5
    n = F.sqrt(1 + x * x + y * y + z * z)
    return [x / n, y / n, z / n, 1 / n]


def pose(spark, d) -> DataFrame:
    """Estimated and true camera-from-world poses of customers by nation: the truth is close to the estimate."""
    from plumbline.functions import geometry as G

    c, k = table(spark, d, "customer"), F.col("c_custkey")
    est, gt = _rotation(k, 37, 53, 29), _rotation(k, 37, 53, 29)
    gt = [gt[0] + (k % 7) * 0.001, *gt[1:]]
    n = F.sqrt(sum((q * q for q in gt[1:]), gt[0] * gt[0]))
    gt = [q / n for q in gt]
    t = [(k * m % 71) / 7.0 for m in (3, 5, 11)]
    return c.select(
        F.col("c_nationkey").alias("scene"), k.alias("frame"), F.array(*est).alias("est_q"), G.rotation_of(F.array(*est)).alias("est_r"), G.rotation_of(F.array(*gt)).alias("gt_r"),
        F.array(*t).alias("est_t"), F.array(t[0] + (k % 5) * 0.01, t[1], t[2] - (k % 3) * 0.01).alias("gt_t"),
    )


def sql_rotation(q: str) -> str:
    x, y, z, w = (f"{q}[{i}]" for i in (1, 2, 3, 4))
    return (
        f"[1 - 2 * ({y}*{y} + {z}*{z}), 2 * ({x}*{y} - {z}*{w}), 2 * ({x}*{z} + {y}*{w}), "
        f"2 * ({x}*{y} + {z}*{w}), 1 - 2 * ({x}*{x} + {z}*{z}), 2 * ({y}*{z} - {x}*{w}), "
        f"2 * ({x}*{z} - {y}*{w}), 2 * ({y}*{z} + {x}*{w}), 1 - 2 * ({x}*{x} + {y}*{y})]"
    )


SQL["pose"] = f"""SELECT scene, frame, est_q, {sql_rotation("est_q")} AS est_r, {sql_rotation("gt_q")} AS gt_r,
    [t0, t1, t2] AS est_t, [t0 + (frame % 5) * 0.01::DOUBLE, t1, t2 - (frame % 3) * 0.01::DOUBLE] AS gt_t FROM (
  SELECT *, [e[1] / n, e[2] / n, e[3] / n, 1 / n] AS est_q,
    list_transform([e[1] / n + (frame % 7) * 0.001::DOUBLE, e[2] / n, e[3] / n, 1 / n], lambda v: v / sqrt((e[1] / n + (frame % 7) * 0.001::DOUBLE) ** 2 + (e[2] / n) ** 2 + (e[3] / n) ** 2 + (1 / n) ** 2)) AS gt_q FROM (
  SELECT *, sqrt(1 + e[1] * e[1] + e[2] * e[2] + e[3] * e[3]) AS n FROM (
  SELECT c_nationkey AS scene, c_custkey AS frame, [(c_custkey * 37 % 101)::DOUBLE / 101 - 0.5::DOUBLE, (c_custkey * 53 % 97)::DOUBLE / 97 - 0.5::DOUBLE, (c_custkey * 29 % 89)::DOUBLE / 89 - 0.5::DOUBLE] AS e,
    (c_custkey * 3 % 71)::DOUBLE / 7 AS t0, (c_custkey * 5 % 71)::DOUBLE / 7 AS t1, (c_custkey * 11 % 71)::DOUBLE / 7 AS t2 FROM customer)))"""


def obs(spark, d) -> DataFrame:
    """Observation graph: line items see points (parts), ten orders are an image; some are not triangulated."""
    li = table(spark, d, "lineitem")
    point = F.when(F.col("l_quantity") > 5, F.col("l_partkey"))
    seen = li.select(F.expr("l_orderkey div 10").alias("image_id"), point.alias("point3D_id"), "l_extendedprice").groupBy("image_id", "point3D_id").agg(F.min("l_extendedprice").alias("x"))
    return seen.select("image_id", F.coalesce(F.col("point3D_id") + 1, F.lit(0)).alias("point2D_idx"), "point3D_id", "x")


SQL["obs"] = """SELECT image_id, coalesce(point3D_id + 1, 0) AS point2D_idx, point3D_id, x FROM (
    SELECT l_orderkey // 10 AS image_id, CASE WHEN l_quantity > 5 THEN l_partkey END AS point3D_id, min(l_extendedprice) AS x FROM lineitem GROUP BY ALL)"""


def seen(spark, d) -> DataFrame:
    """Observation graph that grows with the tables: every customer is an image, every part it ordered a point."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    rows = li.join(o, li.l_orderkey == o.o_orderkey)
    return rows.select(F.col("o_custkey").alias("image_id"), F.when(F.col("l_quantity") > 5, F.col("l_partkey")).alias("point3D_id")).distinct()


SQL["seen"] = """SELECT DISTINCT o_custkey AS image_id, CASE WHEN l_quantity > 5 THEN l_partkey END AS point3D_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


def images(spark, d) -> DataFrame:
    """Images of ten orders: a frame for every image, four cameras to two hundred images."""
    n = F.expr("o_orderkey div 10")
    return table(spark, d, "orders").select(n.alias("image_id"), n.alias("frame_id"), F.expr("o_orderkey div 10 div 200 * 4 + o_orderkey div 10 % 4").alias("camera_id")).distinct()


SQL["images"] = "SELECT DISTINCT o_orderkey // 10 AS image_id, o_orderkey // 10 AS frame_id, o_orderkey // 10 // 200 * 4 + o_orderkey // 10 % 4 AS camera_id FROM orders"


def factor(spark, d) -> DataFrame:
    """Depth factors: z, two modes, sigmas, weights, and an affine block an image."""
    li = table(spark, d, "lineitem")
    return li.select(
        F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), (F.col("l_orderkey") % IMAGES).alias("image_id"), F.col("l_returnflag").alias("kind"),
        (1 + F.col("l_quantity") / 10).alias("z"), F.array(1 + F.col("l_quantity") / 11, 1 + F.col("l_extendedprice") / 20000).alias("modes"),
        F.array(0.05 + F.col("l_tax"), 0.05 + F.col("l_discount")).alias("sigmas"), F.array(0.1 + F.col("l_discount") * 5, 0.9 - F.col("l_discount") * 5).alias("weights"),
        (0.9 + (F.col("l_orderkey") % 5) * 0.05).alias("alpha"), ((F.col("l_orderkey") % 3) * 0.01).alias("beta"),
        (1 + F.col("l_quantity") / 12).alias("estimated_depth"), (F.col("l_linestatus") == "O").alias("is_sky"),
    )


SQL["factor"] = """SELECT l_orderkey, l_linenumber, l_partkey, l_orderkey % 500 AS image_id, l_returnflag AS kind, 1 + l_quantity / 10 AS z,
    [1 + l_quantity / 11, 1 + l_extendedprice / 20000] AS modes, [0.05::DOUBLE + l_tax, 0.05::DOUBLE + l_discount] AS sigmas,
    [0.1::DOUBLE + l_discount * 5, 0.9::DOUBLE - l_discount * 5] AS weights, 0.9::DOUBLE + (l_orderkey % 5) * 0.05::DOUBLE AS alpha,
    (l_orderkey % 3) * 0.01::DOUBLE AS beta, 1 + l_quantity / 12 AS estimated_depth, l_linestatus = 'O' AS is_sky FROM lineitem"""


def named(spark, d) -> DataFrame:
    """File names of documents in folders, with several suffixes."""
    i = F.col("doc_id").cast("string")
    return table(spark, d, "documents").select("doc_id", "n_chars", F.concat(F.lit("dir/"), F.col("source"), F.lit("_v.1/"), F.col("lang"), F.lit("_"), i, F.element_at(F.array(F.lit(".JPG"), F.lit(".jpg"), F.lit(".tar.png"), F.lit("")), (F.col("doc_id") % 4 + 1).cast("int"))).alias("name"))


SQL["named"] = """SELECT doc_id, n_chars, 'dir/' || source || '_v.1/' || lang || '_' || doc_id::VARCHAR || ['.JPG', '.jpg', '.tar.png', ''][doc_id % 4 + 1] AS name FROM documents"""


def sql(views: list[str], body: str) -> str:
    return "WITH " + ",\n".join(f"{v} AS ({SQL[v]})" for v in views) + "\n" + body
