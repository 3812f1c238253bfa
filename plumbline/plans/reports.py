"""Queries of whole reports: against truth, trajectory, sweep over arms, and the figures beside them."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import reports as R
from plumbline.plans import views as V
from plumbline.plans.declare import r6, registrar
from plumbline.plans.geometry import REL, s_angle, s_mv, s_t

QUERIES, ORACLE_SQL, query = registrar()

CENTRES = f"""centres AS (SELECT scene, frame, {s_angle('est_r', 'gt_r')} AS rot, {s_mv('ert', 'est_t')} AS a, {s_mv('grt', 'gt_t')} AS b FROM (SELECT *, {s_t('est_r')} AS ert, {s_t('gt_r')} AS grt FROM pose)),
errors AS (SELECT scene, frame, rot, sqrt((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2) AS pos FROM centres)"""


def _poses(spark, d, which):
    return V.pose(spark, d).select("scene", "frame", F.col(f"{which}_r").alias("rotation"), F.col(f"{which}_t").alias("translation"))


@query(V.sql(["pose"], f""", {CENTRES} SELECT scene, count(*) AS n, {", ".join(f"round({f}({c}), 4) AS {c}_{n}" for c in ("pos", "rot") for n, f in (("mean", "avg"), ("median", "median"), ("max", "max")))},
  arg_min(frame, (-round(pos, 6), frame)) AS worst FROM errors GROUP BY scene""").replace("\n, centres", ",\ncentres"))
def truth_report(spark, d):
    got = R.truth_report(R.camera_errors(_poses(spark, d, "est"), _poses(spark, d, "gt"), ["scene", "frame"]), ["scene"], "frame")
    return got.select("scene", "n", "worst", *(F.round(f"{c}_{n}", 4).alias(f"{c}_{n}") for c in ("pos", "rot") for n in ("mean", "median", "max")))


@query()
def aligned_truth_report(spark, d):
    """The same after a similarity of camera centres, refitted on cameras within 0.2; tested against numpy."""
    errors, _ = R.aligned_errors(_poses(spark, d, "est"), _poses(spark, d, "gt"), ["scene"], "frame", 0.2)
    return R.truth_report(errors, ["scene"], "frame")


@query(V.sql(["pose"], f""", {REL}, src AS (SELECT scene, greatest(rot_err, trans_err) AS err FROM rpe WHERE trans_err IS NOT NULL), thr AS (SELECT unnest([1.0, 5.0, 20.0])::DOUBLE AS t),
curve AS (SELECT scene, err, row_number() OVER w AS i, count(*) OVER (PARTITION BY scene) AS n, coalesce(lag(err) OVER w, 0) AS e0 FROM src WINDOW w AS (PARTITION BY scene ORDER BY err)),
area AS (SELECT scene, t, sum(CASE WHEN err <= t THEN (err - e0) * (i / n + (i - 1) / n) / 2 ELSE 0 END) AS a, coalesce(max(CASE WHEN err <= t THEN err END), 0) AS le, coalesce(max(CASE WHEN err <= t THEN i / n END), 0) AS lr FROM curve, thr GROUP BY ALL),
auc AS (SELECT scene, max(CASE WHEN t = 1 THEN v END) AS auc_1, max(CASE WHEN t = 5 THEN v END) AS auc_5, max(CASE WHEN t = 20 THEN v END) AS auc_20 FROM (SELECT scene, t, 100 * (a + (t - le) * lr) / t AS v FROM area) GROUP BY scene)
SELECT scene, count(*) AS n, round(avg(rot_err), 3) AS mean, round(median(rot_err), 3) AS median, round(quantile_cont(rot_err, 0.9), 3) AS p90, round(max(rot_err), 3) AS max, round(any_value(auc_1), 2) AS auc_1, round(any_value(auc_5), 2) AS auc_5, round(any_value(auc_20), 2) AS auc_20
FROM rpe LEFT JOIN auc USING (scene) GROUP BY scene""").replace("\n, pairs", ",\npairs"))
def trajectory_report(spark, d):
    got = R.trajectory_report(V.pose(spark, d), ["scene"], "frame")
    return got.select("scene", "n", *(F.round(c, 3).alias(c) for c in ("mean", "median", "p90", "max")), *(F.round(c, 2).alias(c) for c in ("auc_1", "auc_5", "auc_20")))


# cameras of arms: a place and a rotation error for each image of a scene under an arm
CAMERA = """camera AS (SELECT scene, arm, img, psnr AS x, psnr / 2 AS y, img * 0.125::DOUBLE AS z FROM arm WHERE img % 7 <> 3),
cam_error AS (SELECT scene, arm, sqrt((x - 10) ** 2 + (y - 5) ** 2 + (z - img * 0.125::DOUBLE) ** 2) AS pos, abs(x - y) AS rot FROM camera WHERE scene <> 4)"""
BASE = "base AS (SELECT a.scene, a.arm, median(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)) AS dbase FROM camera a JOIN camera b ON a.scene = b.scene AND a.img = b.img AND b.arm = '1-URGENT' WHERE a.arm <> '1-URGENT' GROUP BY ALL)"
FIGURES = "count(*) AS n, avg(pos) AS pos_mean, median(pos) AS pos_median, quantile_cont(pos, 0.9) AS pos_p90, max(pos) AS pos_max, 100 * avg((pos > 4)::INT) AS bad_pct, median(rot) AS rot_median, quantile_cont(rot, 0.9) AS rot_p90"
NAMES = ("dbase", "pos_mean", "pos_median", "pos_p90", "pos_max", "bad_pct", "rot_median", "rot_p90")


def _cameras(spark, d):
    rows = V.arm(spark, d).filter("img % 7 <> 3").select("scene", "arm", "img", F.col("psnr").alias("x"), (F.col("psnr") / 2).alias("y"), (F.col("img") * 0.125).alias("z"))
    square = lambda c: F.pow(c, F.lit(2.0))
    pos = F.sqrt(square(F.col("x") - 10) + square(F.col("y") - 5) + square(F.col("z") - F.col("img") * 0.125))
    return rows, rows.filter("scene <> 4").select("scene", "arm", pos.alias("pos"), F.abs(F.col("x") - F.col("y")).alias("rot"))


SWEEP = f"""{CAMERA}, {BASE}, sweep AS (SELECT c.scene, c.arm, n_cameras, dbase, f.* EXCLUDE (scene, arm) FROM (SELECT scene, arm, count(*) AS n_cameras FROM camera GROUP BY ALL) c LEFT JOIN base USING (scene, arm) LEFT JOIN (SELECT scene, arm, {FIGURES} FROM cam_error GROUP BY ALL) f USING (scene, arm))"""


def _sweep(spark, d):
    cameras, errors = _cameras(spark, d)
    return R.sweep_report(cameras, errors, ["scene"], "arm", V.BASELINE, "img", 4.0)


@query(V.sql(["arm"], f", {SWEEP} SELECT scene, arm, n_cameras, n, {', '.join(f'round({c}, 5) AS {c}' for c in NAMES)} FROM sweep").replace("\n, camera", ",\ncamera"))
def sweep_report(spark, d):
    return _sweep(spark, d).select("scene", "arm", "n_cameras", "n", *(F.round(c, 5).alias(c) for c in NAMES))


@query(V.sql(["arm"], f", {SWEEP} SELECT scene, arm, lpad(n_cameras::VARCHAR, 5, ' ') || {' || '.join(f'''lpad(coalesce(printf('%.3f', {c}), '-'), 9, ' ')''' for c in NAMES)} AS line FROM sweep").replace("\n, camera", ",\ncamera"))
def sweep_lines(spark, d):
    cells = [(F.col("n_cameras"), 5, 0), *((F.col(c), 9, 3) for c in NAMES)]
    return _sweep(spark, d).select("scene", "arm", R.report_cells(cells).alias("line"))


@query(V.sql(["factor"], "SELECT kind, count(*) AS n, round(avg(alpha), 6) AS alpha_mean, round(stddev_pop(alpha), 6) AS alpha_std, round(avg(beta), 6) AS beta_mean, round(stddev_pop(beta), 6) AS beta_std FROM factor GROUP BY kind"))
def affine_spread(spark, d):
    got = R.affine_spread(V.factor(spark, d), ["kind"])
    return got.select("kind", "n", *(r6(F.col(c), c) for c in ("alpha_mean", "alpha_std", "beta_mean", "beta_std")))


PIXELS = "pixels AS (SELECT image_id, unnest(estimated_depth) AS x FROM bundle UNION ALL SELECT image_id, unnest(list_transform(estimated_depth, lambda v: v * 1.5)) FROM bundle)"


def _variants(spark, d):
    one = V.bundle(spark, d).select("image_id", F.explode("estimated_depth").alias("x"))
    return one.unionByName(one.withColumn("x", F.col("x") * 1.5))


@query(V.sql(["bundle"], f", {PIXELS} SELECT image_id, round(quantile_cont(x, 0.95), 6) AS vmax FROM pixels GROUP BY image_id").replace("\n, pixels", ",\npixels"))
def shared_colour_range(spark, d):
    return R.shared_range(_variants(spark, d), ["image_id"]).select("image_id", r6(F.col("vmax"), "vmax"))


@query(V.sql(["bundle"], f", {PIXELS} SELECT image_id, count(*) AS n, round(avg(least(x / vmax, 1.0)), 6) AS brightness FROM pixels JOIN (SELECT image_id, quantile_cont(x, 0.95) AS vmax FROM pixels GROUP BY 1) USING (image_id) GROUP BY image_id").replace("\n, pixels", ",\npixels"))
def colour_values(spark, d):
    rows = _variants(spark, d)
    shown = rows.join(R.shared_range(rows, ["image_id"]), "image_id").withColumn("shade", R.in_range(F.col("x"), F.col("vmax")))
    return shown.groupBy("image_id").agg(F.count("*").alias("n"), r6(F.avg("shade"), "brightness"))


@query("""SELECT coalesce(m.s, k.s)::BIGINT AS scene, coalesce(n_missing, 0) AS n_missing, coalesce(n_models, 0) AS n_models FROM
  (SELECT c_nationkey AS s, count(*) AS n_missing FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) GROUP BY 1) m FULL JOIN (SELECT s_nationkey AS s, count(*) AS n_models FROM supplier GROUP BY 1) k ON m.s = k.s
  WHERE coalesce(n_missing, 0) > 0 OR coalesce(n_models, 0) > 1""")
def assembly_report(spark, d):
    expected = V.table(spark, d, "customer").select(F.col("c_nationkey").alias("scene"), F.col("c_custkey").alias("name"))
    files = expected.join(V.table(spark, d, "orders").select(F.col("o_custkey").alias("name")), "name", "left_semi")
    models = V.table(spark, d, "supplier").select(F.col("s_nationkey").alias("scene"))
    return R.assembly_report(expected, files, models, ["scene"]).withColumn("scene", F.col("scene").cast("long"))


@query("SELECT c_custkey AS frame_id FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 4 > 0 AND s_suppkey % 5 = 0)")
def unknown_sensor_frames(spark, d):
    rigs = V.table(spark, d, "supplier").select(F.col("s_nationkey").alias("rig_id"), F.col("s_suppkey").alias("camera_id"), (F.col("s_suppkey") % 4 == 0).alias("is_reference"), F.when(F.col("s_suppkey") % 5 != 0, F.array(F.lit(0.0))).alias("sensor_from_rig"))
    frames = V.table(spark, d, "customer").select(F.col("c_custkey").alias("frame_id"), F.col("c_nationkey").alias("rig_id"))
    return R.unknown_sensors(rigs, frames)


@query()
def transferred_poses(spark, d):
    """All estimated poses in the frame of the true ones, fitted on two of three; tested against numpy."""
    return R.transferred_poses(_poses(spark, d, "est"), _poses(spark, d, "gt").filter("frame % 3 > 0"), ["scene"], "frame")
