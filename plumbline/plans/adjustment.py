"""Queries of the residual layer, problem assembly, pairing and the block solver."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import depth as D
from plumbline.functions import geometry as G
from plumbline.operators import pairing, problem, solver
from plumbline.plans import views as V
from plumbline.plans.declare import r6, registrar
from plumbline.staging import staged

QUERIES, ORACLE_SQL, query = registrar()
KEY = ["l_orderkey", "l_linenumber", "l_partkey"]
KEY_SQL = "l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey"


def _keys():
    return [F.col("l_orderkey"), F.col("l_linenumber").cast("long").alias("l_linenumber"), F.col("l_partkey")]


def _residual(spark, d, space):
    wh = D.residual(F.col("z"), F.get("modes", 0), F.get("sigmas", 0), F.col("alpha"), F.col("beta"), space)
    return V.factor(spark, d).select(*_keys(), r6(wh, "wh"))


@query(V.sql(["factor"], f"SELECT {KEY_SQL}, round((ln(z) - ln(alpha * modes[1] + beta)) / sigmas[1], 6) AS wh FROM factor"))
def log_residual(spark, d):
    return _residual(spark, d, "log")


@query(V.sql(["factor"], f"SELECT {KEY_SQL}, round((z - (alpha * modes[1] + beta)) / sigmas[1], 6) AS wh FROM factor"))
def linear_residual(spark, d):
    return _residual(spark, d, "linear")


@query(V.sql(["factor"], f"SELECT {KEY_SQL}, round((1 / z - 1 / (alpha * modes[1] + beta)) / sigmas[1], 6) AS wh FROM factor"))
def inverse_residual(spark, d):
    return _residual(spark, d, "inverse")


WINNER = """scored AS (SELECT *, (ln(z) - ln(alpha * modes[1] + beta)) / sigmas[1] AS w0, (ln(z) - ln(alpha * modes[2] + beta)) / sigmas[2] AS w1 FROM factor),
won AS (SELECT *, w0 * w0 + 2 * ln(sigmas[1] / greatest(weights[1], 1e-20)) <= w1 * w1 + 2 * ln(sigmas[2] / greatest(weights[2], 1e-20)) AS first FROM scored)"""


@query(V.sql(["factor"], f", {WINNER} SELECT {KEY_SQL}, CASE WHEN first THEN 0 ELSE 1 END::BIGINT AS mode, round(CASE WHEN first THEN w0 ELSE w1 END, 6) AS wh FROM won").replace("\n, scored", ",\nscored"))
def maxmix_winner(spark, d):
    best = D.max_mixture(F.col("z"), F.col("modes"), F.col("sigmas"), F.col("weights"), F.col("alpha"), F.col("beta"))
    return V.factor(spark, d).withColumn("b", best).select(*_keys(), F.col("b.mode").cast("long").alias("mode"), r6(F.col("b.wh"), "wh"))


def _robust(name, sql):
    def f(spark, d):
        rows = V.factor(spark, d).withColumn("wh", D.residual(F.col("z"), F.get("modes", 0), F.get("sigmas", 0), F.col("alpha"), F.col("beta")))
        return rows.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum(0.5 * D.robust(F.col("wh") * F.col("wh"), name, 2.0)), 3).alias("cost"))

    f.__name__ = f"{name}_cost"
    return query(V.sql(["factor"], f"SELECT kind, count(*) AS n, round(sum(0.5 * ({sql})), 3) AS cost FROM (SELECT kind, ((ln(z) - ln(alpha * modes[1] + beta)) / sigmas[1]) ** 2 AS s FROM factor) GROUP BY kind"))(f)


for _name, _sql in (
    ("trivial", "s"),
    ("huber", "CASE WHEN s <= 4 THEN s ELSE 4 * sqrt(s) - 4 END"),
    ("soft_l1", "8 * (sqrt(1 + s / 4) - 1)"),
    ("cauchy", "4 * ln(1 + s / 4)"),
):
    _robust(_name, _sql)


@query(V.sql(["factor"], "SELECT image_id, round(coalesce(median(CASE WHEN NOT is_sky AND z > 0 AND estimated_depth > 0 THEN z / estimated_depth END), 1.0), 6) AS alpha FROM factor GROUP BY image_id"))
def median_depth_ratio(spark, d):
    return problem.median_depth_ratio(V.factor(spark, d), ["image_id"]).select("image_id", r6(F.col("alpha"), "alpha"))


@query(V.sql(["factor"], "SELECT DISTINCT image_id, round(alpha * 2.5, 6) AS alpha, round(beta * 2.5, 6) AS beta FROM factor"))
def affine_rescale(spark, d):
    affine = V.factor(spark, d).select("image_id", "alpha", "beta").distinct()
    return problem.rescaled(affine, 2.5).select("image_id", r6(F.col("alpha"), "alpha"), r6(F.col("beta"), "beta")).distinct()


@query(V.sql(["factor"], """, ratios AS (SELECT image_id, coalesce(median(CASE WHEN NOT is_sky THEN z / estimated_depth END), 1.0) AS alpha FROM factor GROUP BY 1)
SELECT image_id, round(CASE WHEN image_id < 100 THEN 2.0 ELSE alpha END, 6) AS alpha, CASE WHEN image_id < 100 THEN 0.5 ELSE 0.0 END::DOUBLE AS beta FROM ratios""").replace("\n, ratios", ",\nratios"))
def affine_start(spark, d):
    ratios = problem.median_depth_ratio(V.factor(spark, d), ["image_id"])
    held = ratios.filter("image_id < 100").select("image_id", F.lit(2.0).alias("alpha"), F.lit(0.5).alias("beta"))
    return problem.started(held, ratios, ["image_id"]).select("image_id", r6(F.col("alpha"), "alpha"), "beta")


@query(V.sql(["factor"], "SELECT image_id, alpha, round(0.5 * (((alpha - 1) / 0.1) ** 2 + (beta / 0.02) ** 2), 6) AS prior FROM (SELECT DISTINCT image_id, round(alpha, 6) AS alpha, beta FROM factor)"))
def prior_costs(spark, d):
    affine = V.factor(spark, d).select("image_id", F.round("alpha", 6).alias("alpha"), "beta").distinct()
    return problem.prior_cost(affine, 0.1, 0.02).select("image_id", "alpha", r6(F.col("prior"), "prior"))


@query(V.sql(["factor"], f", {WINNER} SELECT kind, count(*) AS n, round(0.5 * sum(CASE WHEN w * w <= 4 THEN w * w ELSE 4 * abs(w) - 4 END), 3) AS cost FROM (SELECT kind, CASE WHEN first THEN w0 ELSE w1 END AS w FROM won) GROUP BY kind").replace("\n, scored", ",\nscored"))
def objective_split(spark, d):
    rows = problem.depth_costs(V.factor(spark, d), "log", 2.0)
    got = problem.objective_split(rows.select("kind", (2 * F.col("cost")).alias("rho")), [])
    return got.select("kind", "n", F.round("cost", 3).alias("cost"))


CONFIG = "image_id % 5 < 2"
RESIDUALS = f"""listed AS (SELECT DISTINCT point3D_id FROM obs WHERE point3D_id % 10 = 3),
res AS (SELECT o.*, i.frame_id, i.camera_id, 1 AS phase FROM obs o JOIN images i USING (image_id) WHERE point3D_id IS NOT NULL AND {CONFIG}
  UNION ALL SELECT o.*, i.frame_id, i.camera_id, 2 FROM obs o JOIN images i USING (image_id) WHERE point3D_id IN (SELECT point3D_id FROM listed) AND NOT ({CONFIG}))"""


def _problem(spark, d):
    o, i = V.obs(spark, d), V.images(spark, d)
    config = i.filter(CONFIG).select("image_id")
    listed = o.filter("point3D_id % 10 = 3").select("point3D_id").distinct()
    return o, i, listed, problem.residual_table(o, i, config, listed)


def _problem_sql(body):
    return V.sql(["obs", "images"], f", {RESIDUALS} {body}").replace("\n, listed", ",\nlisted")


@query(_problem_sql("SELECT phase::BIGINT AS phase, count(*) AS n, count(DISTINCT point3D_id) AS n_points, count(DISTINCT frame_id) AS n_frames FROM res GROUP BY phase"))
def residual_phases(spark, d):
    return _problem(spark, d)[3].groupBy(F.col("phase").cast("long").alias("phase")).agg(F.count("*").alias("n"), F.countDistinct("point3D_id").alias("n_points"), F.countDistinct("frame_id").alias("n_frames"))


@query(_problem_sql("SELECT image_id, point3D_id FROM res WHERE phase = 2"))
def outside_observations(spark, d):
    return _problem(spark, d)[3].filter("phase = 2").select("image_id", "point3D_id")


@query(_problem_sql("SELECT frame_id, max(phase) > 1 AS is_constant FROM res GROUP BY frame_id"))
def frame_constness(spark, d):
    return problem.frame_flags(_problem(spark, d)[3])


@query(_problem_sql("SELECT camera_id, min(phase) > 1 OR camera_id = 2 AS is_constant FROM res GROUP BY camera_id"))
def camera_constness(spark, d):
    held = spark.createDataFrame([(2,)], "camera_id long")
    return problem.camera_flags(_problem(spark, d)[3], held)


POINTS = """tracks AS (SELECT point3D_id, count(*) AS track_length FROM obs WHERE point3D_id IS NOT NULL GROUP BY 1),
points AS (SELECT point3D_id, count(*) FILTER (WHERE phase = 1) AS num_obs, any_value(track_length) AS track_length, count(*) FILTER (WHERE phase = 1) < any_value(track_length) AND NOT point3D_id % 10 = 3 AS is_constant FROM res JOIN tracks USING (point3D_id) GROUP BY 1)"""


@query(_problem_sql(f", {POINTS} SELECT * FROM points").replace(" , tracks", ", tracks"))
def point_constness(spark, d):
    o, _, listed, res = _problem(spark, d)
    return problem.point_flags(res, o, variable=listed)


@query(_problem_sql(f""", {POINTS}, frames AS (SELECT frame_id, max(phase) > 1 AS is_constant FROM res GROUP BY frame_id)
SELECT r.image_id, r.point3D_id FROM res r JOIN frames f USING (frame_id) JOIN points p USING (point3D_id)
WHERE phase = 1 AND r.point2D_idx % 3 > 0 AND NOT r.point2D_idx % 3 = 2 AND NOT (f.is_constant AND p.is_constant)""").replace(" , tracks", ", tracks"))
def eligible_factors(spark, d):
    o, _, listed, res = _problem(spark, d)
    rows = o.filter("point2D_idx % 3 > 0").select("image_id", "point2D_idx", (F.col("point2D_idx") % 3 == 2).alias("is_sky"))
    got = problem.depth_factors(res, rows, problem.frame_flags(res), problem.point_flags(res, o, variable=listed))
    return got.select("image_id", "point3D_id")


@query(V.sql(["obs"], "SELECT point3D_id, count(*) AS track_length FROM obs WHERE point3D_id IS NOT NULL GROUP BY 1 HAVING point3D_id % 7 = 0 OR count(*) <= 25"))
def track_length_cap(spark, d):
    o = V.obs(spark, d)
    points = o.filter("point3D_id IS NOT NULL").select("point3D_id").distinct().withColumn("error", F.when(F.col("point3D_id") % 7 == 0, -1.0).otherwise(0.5))
    return problem.variable_points(points, o, 25)


@query(V.sql(["images"], "SELECT camera_id, count(*) AS n_images FROM images GROUP BY 1"))
def images_per_camera(spark, d):
    i = V.images(spark, d)
    return pairing.rig_counts(i, i.select(F.col("camera_id").alias("rig_id")))[1]


@query(V.sql(["seen"], """SELECT a.image_id AS id_a, b.image_id AS id_b, count(*) AS shared FROM seen a JOIN seen b ON a.point3D_id = b.point3D_id AND a.image_id < b.image_id GROUP BY ALL HAVING count(*) >= 2"""))
def initial_pairs(spark, d):
    return pairing.initial_pairs(V.seen(spark, d), 2)


@query(V.sql(["obs"], """SELECT image_id, count(DISTINCT point3D_id) AS visible FROM obs WHERE image_id % 10 > 0 AND point3D_id IN (SELECT point3D_id FROM obs WHERE image_id % 10 = 0) GROUP BY 1 HAVING count(DISTINCT point3D_id) >= 2"""))
def next_images(spark, d):
    o = V.obs(spark, d)
    ours = o.filter("image_id % 10 = 0")
    return pairing.next_images(o, ours.select("image_id").distinct(), ours.select("point3D_id").distinct(), 2)


@query("SELECT c_nationkey AS scene, a.c_custkey AS id_a, b.c_custkey AS id_b FROM customer a JOIN customer b USING (c_nationkey) WHERE a.c_custkey < b.c_custkey")
def exhaustive_pairs(spark, d):
    images = V.table(spark, d, "customer").select(F.col("c_nationkey").alias("scene"), F.col("c_custkey").alias("image_id"))
    return pairing.exhaustive_pairs(images, ["scene"])


@query("""SELECT a.scene, a.id AS id_a, b.id AS id_b FROM (SELECT c_nationkey AS scene, c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name) AS rn FROM customer) a
JOIN (SELECT c_nationkey AS scene, c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name) AS rn FROM customer) b ON a.scene = b.scene AND b.rn BETWEEN a.rn + 1 AND a.rn + 5""")
def sequential_pairs(spark, d):
    images = V.table(spark, d, "customer").select(F.col("c_nationkey").alias("scene"), F.col("c_custkey").alias("image_id"), "c_name")
    return pairing.sequential_pairs(pairing.strided(images, ["scene"], "c_name", 1), ["scene"], 5)


@query("SELECT c_nationkey AS scene, c_custkey AS image_id, (rn // 3)::BIGINT AS seq FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name) - 1 AS rn FROM customer) WHERE rn % 3 = 0")
def strided_images(spark, d):
    images = V.table(spark, d, "customer").select(F.col("c_nationkey").alias("scene"), F.col("c_custkey").alias("image_id"), "c_name")
    return pairing.strided(images, ["scene"], "c_name", 3).select("scene", "image_id", F.col("seq").cast("long").alias("seq"))


@query("SELECT (r_regionkey * 25 + n_nationkey)::BIGINT AS task, r_name AS arm, n_name AS sequence FROM region, nation")
def arm_grid(spark, d):
    arms = V.table(spark, d, "region").select(F.col("r_name").alias("arm"), F.col("r_regionkey").alias("arm_no"))
    sequences = V.table(spark, d, "nation").select(F.col("n_name").alias("sequence"), F.col("n_nationkey").alias("sequence_no"))
    return pairing.grid(arms, sequences).select(F.col("task").cast("long").alias("task"), "arm", "sequence")


def scene_of(seen, noise: float = 0.05, fixed: int = 2):
    """A scene for an observation graph (image_id, point3D_id): true cameras and points by formulas of their ids, and a start off by ``noise``.

    Frames with an id of up to ``fixed`` are constant and true.  Gives (reprojections, start, depth rows, true frames).
    """
    k = F.col("point3D_id")
    p = seen.select("point3D_id").distinct().withColumn("xyz", F.array((k * 37 % 41) / 10.0 - 2, (k * 17 % 23) / 8.0 - 1.4, 5 + (k * 29 % 31) / 10.0))
    n = F.col("frame_id")
    f = seen.select(F.col("image_id").alias("frame_id")).distinct()
    f = f.withColumn("rotation", F.array(*(F.lit(float(i % 4 == 0)) for i in range(9)))).withColumn("translation", F.array(-(n % 37) * 0.05, (n % 23) * 0.04, (n % 11) * 0.05))
    z = lambda i: F.get("xyz", i) + F.get("translation", i)
    rows = seen.select(F.col("image_id").alias("frame_id"), "point3D_id").join(f, "frame_id").join(p, "point3D_id")
    pixels = rows.select("frame_id", "point3D_id", (500 * z(0) / z(2) + 320).alias("x"), (500 * z(1) / z(2) + 240).alias("y"), F.lit(500.0).alias("fx"), F.lit(500.0).alias("fy"), F.lit(320.0).alias("cx"), F.lit(240.0).alias("cy"), z(2).alias("z"))
    off = lambda c, k: F.transform(c, lambda v, i: v + noise * (((F.col(k) * 13 + i * 7) % 11) / 11.0 - 0.5))
    frames = f.withColumn("is_constant", n <= fixed).withColumn("translation", F.when(n <= fixed, F.col("translation")).otherwise(off("translation", "frame_id")))
    points = p.withColumn("xyz", off("xyz", "point3D_id")).withColumn("is_constant", F.lit(False))
    affine = f.select(n.alias("key"), F.lit(1.1).alias("alpha"), F.lit(0.0).alias("beta"), F.lit(False).alias("is_constant"))
    m = pixels.select("frame_id", "point3D_id", F.col("frame_id").alias("key"), F.array(F.col("z"), F.col("z") * 1.5).alias("modes"), F.array(F.lit(0.9), F.lit(0.1)).alias("weights"), F.array(F.lit(0.05), F.lit(0.05)).alias("sigmas"))
    return pixels.drop("z"), solver.State(frames, points, affine), m, f


@query()
def adjusted_scene(spark, d):
    """The scene of all customers (frames) and the parts they ordered (points), adjusted jointly with depth factors.

    Per frame: its observations, and the distance of its centre from the true one before and after.  Rounds go on until no
    component of the gradient is above 10 (pixels times pixels a unit), at most the operator's 20.  The step is tested against
    a dense solve.
    """
    seen = staged(V.seen(spark, d).filter("point3D_id IS NOT NULL"), "seen")
    reproj, start, depth, truth = scene_of(seen)
    reproj, depth = staged(reproj, "pixels"), staged(depth, "depths")
    got, _, _ = solver.solve(reproj, start, solver.Options(gradient_tolerance=10.0), depth)
    apart = lambda t: G.norm(G.sub(F.col(t), F.col("true")))
    both = start.frames.select("frame_id", F.col("translation").alias("before")).join(got.frames.select("frame_id", F.col("translation").alias("after")), "frame_id").join(truth.select("frame_id", F.col("translation").alias("true")), "frame_id")
    return both.join(seen.groupBy(F.col("image_id").alias("frame_id")).agg(F.count("*").alias("n")), "frame_id").select("frame_id", "n", apart("before").alias("error_before"), apart("after").alias("error_after"))
