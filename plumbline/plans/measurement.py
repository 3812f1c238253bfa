"""Queries of sampling, checks, naming and the measurement store."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import depth as D
from plumbline.functions import naming, raster
from plumbline.operators import checks, mixture, sampling
from plumbline.operators.store import Store
from plumbline.plans import views as V
from plumbline.plans.declare import r6, registrar
from plumbline.staging import fresh

QUERIES, ORACLE_SQL, query = registrar()
PIXEL = "least(greatest(floor({0})::INT, 0), {1})"
LOCATED = f"located AS (SELECT k.*, b.h, b.w, b.estimated_depth AS d, {PIXEL.format('k.x', 7)} AS u, {PIXEL.format('k.y', 7)} AS v FROM kp k JOIN bundle b USING (image_id))"


@query(V.sql(["kp"], f"SELECT image_id, point2D_idx::BIGINT AS point2D_idx, {PIXEL.format('y', 7)}::BIGINT AS v, {PIXEL.format('x', 7)}::BIGINT AS u FROM kp"))
def pixel_index_clip(spark, d):
    eight = F.lit(8)
    return V.kp(spark, d).select("image_id", F.col("point2D_idx").cast("long").alias("point2D_idx"), raster.pixel(F.col("y"), eight).cast("long").alias("v"), raster.pixel(F.col("x"), eight).cast("long").alias("u"))


@query(V.sql(["bundle", "kp"], f", {LOCATED} SELECT image_id, count(*) AS n, round(median((d[v * 8 + u + 1])::FLOAT::DOUBLE), 5) AS median_depth FROM located WHERE NOT is_sky GROUP BY image_id").replace("\n, located", ",\nlocated"))
def unimodal_depth(spark, d):
    keypoints = V.kp(spark, d).filter(checks.not_sky(F.col("is_sky"))).drop("is_sky")
    return sampling.unimodal(V.bundle(spark, d), keypoints).groupBy("image_id").agg(F.count("*").alias("n"), F.round(F.median(F.get("modes", 0).cast("double")), 5).alias("median_depth"))


@query(V.sql(["stack", "kp"], f"""SELECT image_id, point2D_idx::BIGINT AS point2D_idx, m::BIGINT AS mode, round(means[m * 16 + v * 4 + u + 1]::FLOAT::DOUBLE, 5) AS depth, round((0.1::DOUBLE * means[m * 16 + v * 4 + u + 1])::FLOAT::DOUBLE, 5) AS sigma
FROM (SELECT k.image_id, point2D_idx, means, {PIXEL.format('x', 3)} AS u, {PIXEL.format('y', 3)} AS v FROM kp k JOIN stack USING (image_id)), range(4) r(m)"""))
def mixture_stack_depth(spark, d):
    rows = sampling.mixture_stack(V.stack(spark, d), V.kp(spark, d))
    each = rows.select("image_id", F.col("point2D_idx").cast("long").alias("point2D_idx"), F.posexplode(F.arrays_zip("modes", "sigmas")).alias("mode", "m"))
    return each.select("image_id", "point2D_idx", F.col("mode").cast("long").alias("mode"), F.round(F.col("m.modes").cast("double"), 5).alias("depth"), F.round(F.col("m.sigmas").cast("double"), 5).alias("sigma"))


@query("SELECT r::BIGINT AS r, dv::BIGINT AS dv, du::BIGINT AS du FROM range(1, 7) a(r), range(-6, 7) b(dv), range(-6, 7) c(du) WHERE dv * dv + du * du <= r * r")
def disk_offsets(spark, d):
    radii = spark.range(1, 7).withColumnRenamed("id", "r")
    each = radii.select("r", F.explode(raster.disk(F.col("r"))).alias("o"))
    return each.select("r", F.col("o.dv").cast("long").alias("dv"), F.col("o.du").cast("long").alias("du"))


PATCHES = f"""{LOCATED}, scaled AS (SELECT *, sqrt(greatest(a11 * a22, 0)) AS s FROM located),
sized AS (SELECT *, greatest(round_even(4 * s, 0)::INT, 2) AS r, greatest(s, 1e-12) AS ss, ln(greatest(d[v * 8 + u + 1], 1e-12)) AS mu0 FROM scaled),
samples AS (SELECT image_id, point2D_idx, mu0, dv, du, ln(d[(v + dv) * 8 + u + du + 1]) AS y, exp(-(dv * dv + du * du) / (2 * ss * ss)) AS w
  FROM sized, range(-8, 9) a(dv), range(-8, 9) b(du)
  WHERE dv * dv + du * du <= r * r AND v + dv BETWEEN 0 AND 7 AND u + du BETWEEN 0 AND 7)"""


@query(V.sql(["bundle", "kp"], f""",{PATCHES} SELECT image_id, point2D_idx::BIGINT AS point2D_idx, round(w, 6) AS W, round(ybar, 6) AS ybar, round(greatest(yy / w - ybar * ybar, 0), 6) AS yvar FROM (
  SELECT image_id, point2D_idx, sum(w) AS w, sum(w * y) / sum(w) AS ybar, sum(w * y * y) AS yy FROM samples GROUP BY ALL)""").replace("\n,located", ",\nlocated"))
def patch_moments(spark, d):
    rows = sampling.patches(V.bundle(spark, d), V.kp(spark, d)).select("image_id", "point2D_idx", F.explode("samples").alias("s"))
    got = mixture.weighted_moments(rows.select("image_id", "point2D_idx", "s.y", "s.w"), ["image_id", "point2D_idx"])
    return got.select("image_id", F.col("point2D_idx").cast("long").alias("point2D_idx"), r6(F.col("W"), "W"), r6(F.col("ybar"), "ybar"), r6(F.col("yvar"), "yvar"))


EM = """
lists AS (SELECT image_id, point2D_idx, any_value(mu0) AS m0, list(y ORDER BY dv, du) AS ys, list(w ORDER BY dv, du) AS ws FROM samples GROUP BY image_id, point2D_idx),
spread AS (SELECT *, list_sum(ws) AS tw, list_sum(list_transform(list_zip(ys, ws), lambda p: p[1] * p[2])) / list_sum(ws) AS yb FROM lists),
start AS (SELECT *, list_sum(list_transform(list_zip(ys, ws), lambda p: p[2] * (p[1] - yb) ** 2)) / tw AS yv FROM spread),
em AS (
  SELECT image_id, point2D_idx, 0 AS step, m0, ys, ws, tw, yv, ys[list_position(list_transform(ys, lambda q: abs(q - m0)), list_max(list_transform(ys, lambda q: abs(q - m0))))] AS m1,
    greatest(sqrt(yv), 0.05::DOUBLE) AS s0, greatest(sqrt(yv), 0.05::DOUBLE) AS s1, 0.5::DOUBLE AS p0, 0.5::DOUBLE AS p1 FROM start WHERE yv >= 0.05::DOUBLE * 0.05::DOUBLE AND len(ys) >= 2
  UNION ALL
  SELECT image_id, point2D_idx, step + 1, m0, ys, ws, tw, yv, nm, greatest(sqrt(list_sum(list_transform(list_zip(ys, a0), lambda p: p[2] * (p[1] - m0) ** 2)) / greatest(n0, 1e-12)), 0.05::DOUBLE),
    greatest(sqrt(list_sum(list_transform(list_zip(ys, a1), lambda p: p[2] * (p[1] - nm) ** 2)) / greatest(n1, 1e-12)), 0.05::DOUBLE), n0 / tw, n1 / tw
  FROM (SELECT *, list_sum(list_transform(list_zip(ys, a1), lambda p: p[1] * p[2])) / greatest(n1, 1e-12) AS nm FROM (
    SELECT *, list_sum(a0) AS n0, list_sum(a1) AS n1 FROM (
    SELECT *, list_transform(list_zip(ws, g0, g1), lambda t: t[1] * t[2] / (t[2] + t[3] + 1e-12)) AS a0, list_transform(list_zip(ws, g0, g1), lambda t: t[1] * t[3] / (t[2] + t[3] + 1e-12)) AS a1 FROM (
    SELECT *, list_transform(ys, lambda q: p0 * exp(-0.5 * ((q - m0) / s0) ** 2) / s0) AS g0, list_transform(ys, lambda q: p1 * exp(-0.5 * ((q - m1) / s1) ** 2) / s1) AS g1 FROM em WHERE step < 30))))
)
SELECT s.image_id, s.point2D_idx::BIGINT AS point2D_idx, round(CASE WHEN e.step IS NULL OR e.p1 < 0.05 OR abs(e.m1 - e.m0) < 0.1 THEN s.m0 ELSE e.m1 END, 4) AS mu1,
  round(CASE WHEN e.step IS NULL THEN greatest(sqrt(s.yv), 0.05) ELSE e.s0 END, 4) AS s0,
  round(CASE WHEN e.step IS NULL THEN greatest(sqrt(s.yv), 0.05) WHEN e.p1 < 0.05 OR abs(e.m1 - e.m0) < 0.1 THEN e.s0 ELSE e.s1 END, 4) AS s1,
  round(CASE WHEN e.step IS NULL OR e.p1 < 0.05 OR abs(e.m1 - e.m0) < 0.1 THEN 0.05 ELSE e.p1 END, 4) AS w1
FROM start s LEFT JOIN em e ON e.image_id = s.image_id AND e.point2D_idx = s.point2D_idx AND e.step = 30"""


@query("WITH RECURSIVE " + V.sql(["bundle", "kp"], f",{PATCHES},{EM}").removeprefix("WITH ").replace("\n,located", ",\nlocated"))
def anchored_em(spark, d):
    rows = mixture.with_fit(sampling.patches(V.bundle(spark, d), V.kp(spark, d)).select("image_id", "point2D_idx", "ys", "ws", "mu0"), "ys", "ws", "mu0")
    return rows.select("image_id", F.col("point2D_idx").cast("long").alias("point2D_idx"), *(F.round(f"fit.{c}", 4).alias(c) for c in ("mu1", "s0", "s1", "w1")))


@query(V.sql(["meas"], """SELECT sensor, rule, count(*) AS n FROM (
  SELECT sensor, unnest(list_filter([
    CASE WHEN modes[1] <= 0 OR modes[2] <= 0 THEN 'modes' END, CASE WHEN estimated_depth <= 0 THEN 'estimated_depth' END,
    CASE WHEN weights[1] < 0 OR weights[2] < 0 THEN 'weights' END, CASE WHEN weights[1] + weights[2] > 1 + 1e-3 THEN 'weight_sum' END,
    CASE WHEN sigmas[1] <= 0 OR sigmas[2] <= 0 THEN 'sigmas' END], lambda r: r IS NOT NULL)) AS rule FROM meas WHERE NOT is_sky) GROUP BY ALL"""))
def check_measurements(spark, d):
    rows = V.meas(spark, d)
    broken = F.explode(F.array_compact(F.array(*(F.when(bad, F.lit(rule)) for rule, bad in checks.measurement_rules().items())))).alias("rule")
    return rows.filter(checks.not_sky(F.col("is_sky"))).select("sensor", broken).groupBy("sensor", "rule").agg(F.count("*").alias("n"))


@query("SELECT doc_id AS image_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def coverage_missing(spark, d):
    images = V.table(spark, d, "documents").select(F.col("doc_id").alias("stem"))
    return checks.missing_stems(images, V.table(spark, d, "labels").select(F.col("doc_id").alias("stem"))).select(F.col("stem").alias("image_id"))


@query("SELECT doc_id AS image_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY 1 LIMIT 10")
def first_missing(spark, d):
    images = V.table(spark, d, "documents").select(F.col("doc_id").alias("stem"))
    return checks.first_missing(images, V.table(spark, d, "labels").select(F.col("doc_id").alias("stem"))).select(F.col("stem").alias("image_id"))


@query(V.sql(["kp"], """SELECT image_id, coalesce(a.n, 0) AS n_keypoints, coalesce(b.n, 0) AS n_rows FROM
  (SELECT image_id, count(*) AS n FROM kp GROUP BY 1) a FULL JOIN (SELECT image_id, count(*) AS n FROM kp WHERE user_id % 40 <> 0 GROUP BY 1) b USING (image_id) WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)"""))
def row_completeness(spark, d):
    keypoints = V.kp(spark, d)
    return checks.incomplete_images(keypoints, keypoints.filter("user_id % 40 <> 0"))


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def pk_duplicates(spark, d):
    rows = V.table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"))
    return checks.duplicate_keys(rows, ["l_orderkey", "l_linenumber"])


@query("SELECT l_returnflag AS sensor, count(DISTINCT CASE WHEN l_quantity > 1 THEN 2 ELSE 1 END) AS n_k, count(DISTINCT l_tax > 0) AS n_confidence, 1::BIGINT AS n_sigmas, count(DISTINCT CASE WHEN l_quantity > 1 THEN 2 ELSE 1 END) = 1 AND count(DISTINCT l_tax > 0) = 1 AS consistent FROM lineitem GROUP BY 1")
def sensor_shape(spark, d):
    li = V.table(spark, d, "lineitem")
    modes = F.when(F.col("l_quantity") > 1, F.array("l_quantity", "l_tax")).otherwise(F.array("l_quantity"))
    rows = li.select(F.col("l_returnflag").alias("sensor"), modes.alias("modes"), F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("confidence"), F.array("l_tax").alias("sigmas"))
    return checks.sensor_shape(rows)


@query(V.sql(["meas"], """SELECT kind, count(*) AS n_images, sum(n)::BIGINT AS n FROM (
  SELECT 'num_modes' AS kind, image_id, count(*) AS n FROM meas WHERE sensor = 'R' GROUP BY image_id
  UNION ALL SELECT 'no_meta', image_id, count(*) FROM meas WHERE sensor = 'N' AND estimated_depth > 3 GROUP BY image_id
  UNION ALL SELECT 'row_count', image_id, n - m FROM (SELECT image_id, count(*) AS n, count(*) FILTER (WHERE estimated_depth > 3) AS m FROM meas GROUP BY 1) WHERE n <> m
  UNION ALL SELECT rule, image_id, count(*) FROM (SELECT image_id, unnest(list_filter([CASE WHEN modes[1] <= 0 OR modes[2] <= 0 THEN 'modes' END, CASE WHEN weights[1] + weights[2] > 1 + 1e-3 THEN 'weight_sum' END,
    CASE WHEN sigmas[1] <= 0 OR sigmas[2] <= 0 THEN 'sigmas' END], lambda r: r IS NOT NULL)) AS rule FROM meas WHERE NOT is_sky AND estimated_depth > 3) GROUP BY ALL) GROUP BY kind""").replace("WHERE sensor = 'R' GROUP", "WHERE sensor = 'R' AND estimated_depth > 3 GROUP"))
def audit_problems(spark, d):
    rows = V.meas(spark, d)
    meta = spark.createDataFrame([("A", 2), ("R", 3)], "sensor string, num_modes int")  # N was never recorded
    return checks.audit(rows, rows.filter("estimated_depth > 3"), meta).groupBy("kind").agg(F.count("*").alias("n_images"), F.sum("n").alias("n"))


@query(V.sql(["meas"], """SELECT sensor, count(*) AS n, count(DISTINCT image_id) AS n_images, min(estimated_depth) AS min_depth, median(estimated_depth) AS median_depth, max(estimated_depth) AS max_depth,
  round(avg((abs(ln(modes[2] / modes[1])) > 1e-6)::INT), 6) AS bimodal_rate FROM meas WHERE NOT is_sky AND modes[1] > 0 GROUP BY sensor"""))
def audit_statistics(spark, d):
    rows = V.meas(spark, d).filter(F.get("modes", 0) > 0)
    return checks.audit_statistics(rows, ["sensor"]).withColumn("bimodal_rate", F.round("bimodal_rate", 6))


@query("SELECT lang, sha256(string_agg(doc_id::VARCHAR || ':' || n_chars::VARCHAR || chr(10), '' ORDER BY doc_id::VARCHAR)) AS digest FROM documents GROUP BY lang")
def dump_hash(spark, d):
    docs = V.table(spark, d, "documents")
    return docs.groupBy("lang").agg(naming.file_digest(F.col("doc_id").cast("string"), F.col("n_chars")).alias("digest"))


@query("""WITH lines AS (SELECT lang, doc_id::VARCHAR AS name, doc_id::VARCHAR || ':' || n_chars::VARCHAR || chr(10) AS line FROM documents),
buckets AS (SELECT lang, sha256(name)[:3] AS bucket, sha256(string_agg(line, '' ORDER BY name)) AS digest FROM lines WHERE line IS NOT NULL GROUP BY ALL)
SELECT lang, sha256(string_agg(bucket || ':' || digest || chr(10), '' ORDER BY bucket)) AS digest FROM buckets GROUP BY lang""")
def dump_hash_buckets(spark, d):
    docs = V.table(spark, d, "documents").select("lang", F.col("doc_id").cast("string").alias("name"), "n_chars")
    return naming.bucket_digest(docs, ["lang"], "name", "n_chars")


STORED = "stored AS (SELECT CASE WHEN event_type = 'error' THEN 'faults' ELSE 'rest' END AS sensor, image_id, point2D_idx, 1.0::DOUBLE + user_id % 7 AS estimated_depth FROM kp)"


def _stored_sql(body):
    return V.sql(["kp"], f", {STORED} {body}").replace("\n, stored", ",\nstored")


def _store(spark, d):
    """A store of its own in the shared folder, to which all keypoints are published as two sensors."""
    store = Store(spark, fresh(spark, "store"))
    depth = 1.0 + F.col("user_id") % 7
    rows = V.kp(spark, d).select("image_id", "point2D_idx", F.array(depth).cast("array<float>").alias("modes"), F.array(F.lit(1.0)).cast("array<float>").alias("weights"), depth.alias("estimated_depth"),
                                 F.lit(None).cast("array<float>").alias("sigmas"), F.lit(None).cast("double").alias("confidence"), "is_sky", (F.col("event_type") == "error").alias("fault"))
    for sensor, which in (("faults", F.col("fault")), ("rest", ~F.col("fault"))):
        store.write(rows.filter(which).drop("fault"), {"sensor": sensor, "num_modes": 1, "method": "unimodal", "sigma_space": None, "has_confidence": False})
    return store


@query(_stored_sql("SELECT sensor, 1::BIGINT AS num_modes, 'unimodal' AS method FROM stored GROUP BY sensor"))
def list_sensors(spark, d):
    return _store(spark, d).meta().select("sensor", F.col("num_modes").cast("long").alias("num_modes"), "method")


@query(_stored_sql("SELECT sensor, count(*) AS n FROM stored WHERE sensor <> 'faults' GROUP BY sensor"))
def delete_sensor(spark, d):
    store = _store(spark, d)
    store.delete("faults")
    return store.rows().groupBy("sensor").agg(F.count("*").alias("n"))


@query(_stored_sql("SELECT sensor, count(*) AS n, sum(estimated_depth) AS depths FROM stored WHERE image_id % 2 = 0 AND sensor = 'rest' GROUP BY sensor"))
def replaced_sensor(spark, d):
    """One sensor is replaced by the rows of every other image and the other by none; readers see the new versions."""
    store = _store(spark, d)
    for sensor, kept in (("rest", "image_id % 2 = 0"), ("faults", "false")):
        meta = store.sensor_meta(sensor).asDict() | {"method_params": None}
        store.write(store.rows(sensor).filter(kept), meta, force=True)
    return store.rows().groupBy("sensor").agg(F.count("*").alias("n"), F.sum("estimated_depth").alias("depths"))


@query(_stored_sql("SELECT count(*) AS n FROM stored WHERE sensor = 'rest'"))
def count_sensor_rows(spark, d):
    return _store(spark, d).rows("rest").agg(F.count("*").alias("n"))


@query(_stored_sql("SELECT image_id, point2D_idx::BIGINT AS point2D_idx, estimated_depth FROM stored WHERE sensor = 'rest' AND image_id = 7"))
def rows_for_image(spark, d):
    return _store(spark, d).for_image(7, "rest").select("image_id", F.col("point2D_idx").cast("long").alias("point2D_idx"), "estimated_depth")


@query(V.sql(["kp"], "SELECT image_id, count(*) AS n FROM kp GROUP BY image_id"))
def keypoint_counts(spark, d):
    return V.kp(spark, d).groupBy("image_id").agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, '{"brand":"' || p_brand || '","size":"' || p_size::VARCHAR || '"}' AS params FROM part""")
def meta_json_sorted(spark, d):
    part = V.table(spark, d, "part")
    return part.select("p_partkey", naming.sorted_json(F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand"))).alias("params"))


@query(V.sql(["named"], """SELECT doc_id, regexp_replace(regexp_extract(name, '([^/]+)$', 1), '(.)\\.[^.]*$', '\\1') AS stem, try_cast(regexp_extract(name, '(\\d+)', 1) AS BIGINT) AS number, split_part(name, '_', 1) AS scene, lower(name) LIKE '%.jpg' AS is_jpeg FROM named"""))
def name_parts(spark, d):
    n = F.col("name")
    return V.named(spark, d).select("doc_id", naming.stem(n).alias("stem"), naming.first_number(n).alias("number"), naming.scene_of(n).alias("scene"), naming.is_jpeg(n).alias("is_jpeg"))


@query(V.sql(["named"], """SELECT a.doc_id, b.item_id FROM (SELECT doc_id, regexp_replace(regexp_extract(name, '([^/]+)$', 1), '(.)\\.[^.]*$', '\\1') AS stem FROM named) a JOIN (SELECT item_id, 'en_' || item_id::VARCHAR AS stem FROM benchmark) b USING (stem)"""))
def stem_join(spark, d):
    docs = V.named(spark, d).select("doc_id", naming.stem(F.col("name")).alias("stem"))
    truth = V.table(spark, d, "benchmark").select("item_id", naming.stem(F.concat(F.lit("gt/en_"), F.col("item_id").cast("string"), F.lit(".png"))).alias("stem"))
    return docs.join(truth, "stem").select("doc_id", "item_id")


@query("SELECT s_suppkey AS a, c_custkey AS b FROM supplier JOIN customer ON regexp_extract(s_name, '(\\d+)', 1)::BIGINT = regexp_extract(c_name, '(\\d+)', 1)::BIGINT")
def digit_join(spark, d):
    a = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("a"), naming.first_number(F.col("s_name")).alias("n"))
    b = V.table(spark, d, "customer").select(F.col("c_custkey").alias("b"), naming.first_number(F.col("c_name")).alias("n"))
    return a.join(b, "n").select("a", "b")


@query(V.sql(["named"], """SELECT stem, count(*) AS n FROM (SELECT regexp_replace(regexp_extract(name, '([^/_]+)$', 1), '(.)\\.[^.]*$', '\\1')[1:2] AS stem FROM named) GROUP BY stem HAVING count(*) > 1"""))
def stem_collisions(spark, d):
    stems = V.named(spark, d).select(F.substring(naming.stem(F.substring_index(F.col("name"), "_", -1)), 1, 2).alias("stem"))
    return checks.stem_collisions(stems)


@query("SELECT o_orderkey, lpad(epoch_ms(o_orderdate)::VARCHAR, 13, '0') AS snapshot FROM orders")
def snapshot_names(spark, d):
    return V.table(spark, d, "orders").select("o_orderkey", naming.snapshot_name(F.col("o_orderdate").cast("timestamp")).alias("snapshot"))


@query("SELECT e AS model FROM (SELECT unnest([o_orderstatus, o_orderkey::VARCHAR, 'x' || o_orderkey::VARCHAR]) AS e FROM orders) WHERE regexp_matches(e, '^[0-9]+$')")
def submodels(spark, d):
    names = V.table(spark, d, "orders").select(F.explode(F.array("o_orderstatus", F.col("o_orderkey").cast("string"), F.concat(F.lit("x"), F.col("o_orderkey").cast("string")))).alias("model"))
    return names.filter(naming.is_submodel(F.col("model")))


@query("SELECT n_nationkey::BIGINT AS n, CASE WHEN n_nationkey % 2 = 0 THEN replace('out/{sequence}/db', '{sequence}', n_name) END AS path FROM nation")
def sequence_template(spark, d):
    n = V.table(spark, d, "nation")
    t = F.when(F.col("n_nationkey") % 2 == 0, F.lit("out/{sequence}/db")).otherwise(F.lit("out/db"))
    return n.select(F.col("n_nationkey").cast("long").alias("n"), naming.fill_template(t, F.col("n_name")).alias("path"))


@query(V.sql(["bundle"], """SELECT image_id, round(quantile_cont(x, 0.02), 6) AS low, round(quantile_cont(x, 0.98), 6) AS high FROM (SELECT image_id, unnest(estimated_depth) AS x FROM bundle) GROUP BY image_id"""))
def depth_range(spark, d):
    pixels = V.bundle(spark, d).select("image_id", F.explode("estimated_depth").alias("x")).filter("x > 0 AND NOT isnan(x)")
    got = pixels.groupBy("image_id").agg(F.percentile("x", F.array(F.lit(0.02), F.lit(0.98))).alias("p"))
    return got.select("image_id", r6(F.get("p", 0), "low"), r6(F.get("p", 1), "high"))


@query(V.sql(["bundle"], """SELECT image_id, v::BIGINT AS v, u::BIGINT AS u, round(sqrt(gv * gv + gu * gu), 6) AS gradient FROM (
  SELECT image_id, v, u, (d[least(v + 1, 7) * 8 + u + 1] - d[greatest(v - 1, 0) * 8 + u + 1]) / (least(v + 1, 7) - greatest(v - 1, 0)) AS gv, (d[v * 8 + least(u + 1, 7) + 1] - d[v * 8 + greatest(u - 1, 0) + 1]) / (least(u + 1, 7) - greatest(u - 1, 0)) AS gu
  FROM (SELECT image_id, estimated_depth AS d FROM bundle), range(8) a(v), range(8) b(u))"""))
def gradient_magnitude(spark, d):
    at = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("p")
    rows = V.bundle(spark, d).select("image_id", "estimated_depth", at).select("image_id", "estimated_depth", F.floor(F.col("p") / 8).cast("int").alias("v"), (F.col("p") % 8).alias("u"))
    g = raster.gradient_magnitude(F.col("estimated_depth"), F.col("v"), F.col("u"), F.lit(8), F.lit(8))
    return rows.select("image_id", F.col("v").cast("long").alias("v"), F.col("u").cast("long").alias("u"), r6(g, "gradient"))


@query("SELECT vec_id, list_sum(list_transform(embedding, lambda e: trunc(least(greatest((e::DOUBLE + 1) / 2 * 255 + 0.5, 0), 255))::BIGINT))::BIGINT AS total FROM embeddings")
def byte_images(spark, d):
    q = F.transform("embedding", lambda e: raster.to_byte(e.cast("double")))
    return V.table(spark, d, "embeddings").select("vec_id", F.aggregate(q, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query(V.sql(["factor"], """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, round(list_min(weights) * abs(ln(greatest(modes[1], 1e-12)) - ln(greatest(modes[2], 1e-12))), 6) AS ambiguity FROM factor ORDER BY 4 DESC, 1, 2, 3 LIMIT 50"""))
def most_ambiguous(spark, d):
    rows = V.factor(spark, d).select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey", r6(D.ambiguity(F.col("modes"), F.col("weights")), "ambiguity"))
    return rows.orderBy(F.desc("ambiguity"), "l_orderkey", "l_linenumber", "l_partkey").limit(50)


@query(V.sql(["factor"], """SELECT kind, bin, count(*) AS n, round(sum(w), 4) AS weight FROM (SELECT kind, least(greatest(floor((z - 1) / 5 * 24)::BIGINT, 0), 23) AS bin, weights[1] AS w FROM factor) GROUP BY ALL"""))
def weighted_histogram(spark, d):
    bin_ = F.least(F.greatest(F.floor((F.col("z") - 1) / 5 * 24).cast("long"), F.lit(0).cast("long")), F.lit(23).cast("long"))
    rows = V.factor(spark, d).select("kind", bin_.alias("bin"), F.get("weights", 0).alias("w"))
    return rows.groupBy("kind", "bin").agg(F.count("*").alias("n"), F.round(F.sum("w"), 4).alias("weight"))


@query(V.sql(["factor"], """SELECT kind, count(*) AS n, round(avg(abs(modes[2] - modes[1])), 6) AS separation, round(avg(abs(modes[2] - modes[1]) / modes[1]), 6) AS relative, round(100 * avg((abs(ln(modes[2] / modes[1])) > 1e-6)::INT), 6) AS bimodal_pct FROM factor GROUP BY kind"""))
def population_statistics(spark, d):
    a, b = F.get("modes", 0), F.get("modes", 1)
    return V.factor(spark, d).groupBy("kind").agg(F.count("*").alias("n"), r6(F.avg(F.abs(b - a)), "separation"), r6(F.avg(F.abs(b - a) / a), "relative"), r6(100 * F.avg((F.abs(F.ln(b / a)) > 1e-6).cast("int")), "bimodal_pct"))
