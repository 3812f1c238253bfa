"""Queries of the evaluation reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import evaluation as E
from plumbline.plans import views as V
from plumbline.plans.declare import r6, registrar

QUERIES, ORACLE_SQL, query = registrar()


def _errors(spark, d):
    return V.table(spark, d, "events").select("event_type", "event_id", "user_id", F.abs(F.col("value")).alias("err"))


SUMMARY = "round(avg(err), 6) AS mean, round(median(err), 6) AS median, round(quantile_cont(err, 0.9), 6) AS p90, round(max(err), 6) AS max"
ERR = "err AS (SELECT event_type, event_id, user_id, abs(value) AS err FROM events)"


@query(f"WITH {ERR} SELECT event_type, count(*) AS n, {SUMMARY}, round(100 * avg((err > 20)::INT), 6) AS bad_pct FROM err GROUP BY event_type")
def error_summary(spark, d):
    got = E.error_summary(_errors(spark, d), ["event_type"], "err", 20.0)
    return got.select("event_type", "n", *(r6(F.col(c), c) for c in ("mean", "median", "p90", "max", "bad_pct")))


@query(f"""WITH {ERR}, seq AS (SELECT event_type AS arm, user_id % 7 AS s, median(err) AS scale, avg(err) AS dbase FROM err GROUP BY ALL),
cam AS (SELECT event_type AS arm, count(*) AS n, round(avg(err), 6) AS pos_mean, round(median(err), 6) AS pos_median, round(quantile_cont(err, 0.9), 6) AS pos_p90, round(max(err), 6) AS pos_max,
  round(100 * avg((err > 20)::INT), 6) AS bad_pct, round(median(err * 2), 6) AS rot_median, round(quantile_cont(err * 2, 0.9), 6) AS rot_p90 FROM err GROUP BY 1)
SELECT cam.*, n_seq, round(scale, 6) AS scale, round(dbase, 6) AS dbase FROM cam LEFT JOIN (SELECT arm, count(*) AS n_seq, median(scale) AS scale, median(dbase) AS dbase FROM seq GROUP BY 1) USING (arm)""")
def pooled_errors(spark, d):
    cameras = _errors(spark, d).select(F.col("event_type").alias("arm"), (F.col("user_id") % 7).alias("s"), F.col("err").alias("pos"), (F.col("err") * 2).alias("rot"))
    sequences = cameras.groupBy("arm", "s").agg(F.median("pos").alias("scale"), F.avg("pos").alias("dbase"))
    got = E.pooled(cameras, sequences, 20.0)
    return got.select("arm", "n", "n_seq", *(r6(F.col(c), c) for c in ("pos_mean", "pos_median", "pos_p90", "pos_max", "bad_pct", "rot_median", "rot_p90", "scale", "dbase")))


AUC = """curve AS (SELECT k, err, row_number() OVER w AS i, count(*) OVER (PARTITION BY k) AS n, coalesce(lag(err) OVER w, 0) AS e0 FROM src WINDOW w AS (PARTITION BY k ORDER BY err)),
area AS (SELECT k, t, sum(CASE WHEN err <= t THEN (err - e0) * (i / n + (i - 1) / n) / 2 ELSE 0 END) AS a, coalesce(max(CASE WHEN err <= t THEN err END), 0) AS le, coalesce(max(CASE WHEN err <= t THEN i / n END), 0) AS lr FROM curve, thr GROUP BY ALL)
SELECT k AS {0}, t AS threshold, round((a + (t - le) * lr) / t, 6) AS auc FROM area"""


@query(f"WITH {ERR}, src AS (SELECT event_type AS k, err FROM err), thr AS (SELECT unnest([1.0, 5.0, 20.0])::DOUBLE AS t), " + AUC.format("event_type"))
def pose_auc(spark, d):
    got = E.pose_auc(_errors(spark, d), ["event_type"], "err", [1, 5, 20])
    return got.select("event_type", "threshold", r6(F.col("auc"), "auc"))


@query(f"WITH {ERR} SELECT event_type, part::BIGINT AS part, round(median(err), 6) AS median FROM (SELECT event_type, err, ntile(10) OVER (PARTITION BY event_type ORDER BY event_id) AS part FROM err) GROUP BY ALL")
def drift_profile(spark, d):
    got = E.drift_profile(_errors(spark, d), ["event_type"], "event_id", "err")
    return got.select("event_type", F.col("part").cast("long").alias("part"), r6(F.col("median"), "median"))


@query(f"WITH {ERR} SELECT event_type, event_id, err FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY err DESC, event_id) AS r FROM err) WHERE r = 1")
def worst_row(spark, d):
    return E.worst_row(_errors(spark, d), ["event_type"], "event_id", "err").select("event_type", "event_id", "err")


@query("""SELECT label::BIGINT AS label, round(CASE WHEN count(*) >= 2 THEN sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2 + (max(z) - min(z)) ** 2) END, 5) AS extent FROM (
  SELECT label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings) GROUP BY label""")
def centre_extent(spark, d):
    centres = V.table(spark, d, "embeddings").select(F.col("label").cast("long").alias("label"), *(F.get("embedding", i).cast("double").alias(c) for i, c in enumerate("xyz")))
    return E.centre_extent(centres, ["label"]).select("label", F.round("extent", 5).alias("extent"))


@query("""WITH arms AS (SELECT s_suppkey AS sequence, CASE s_suppkey % 3 WHEN 0 THEN 'baseline' ELSE 'gmm' END AS arm, s_suppkey % 4 AS n_models, s_suppkey % 5 > 0 AS has_cameras, s_suppkey % 7 > 0 AS aligned, CASE WHEN s_suppkey % 6 = 0 THEN 0.0 WHEN s_suppkey % 6 = 1 THEN NULL ELSE 0.1 END AS dbase FROM supplier)
SELECT sequence, arm, unnest(list_filter([CASE WHEN n_models = 0 THEN 'no model' END, CASE WHEN n_models > 0 AND NOT has_cameras THEN 'no cameras' END, CASE WHEN n_models > 1 THEN 'fragmented' END,
  CASE WHEN n_models > 0 AND has_cameras AND NOT aligned THEN 'alignment failed' END, CASE WHEN coalesce(dbase < 1e-9, false) AND arm <> 'baseline' THEN 'no-op' END], lambda p: p IS NOT NULL)) AS problem FROM arms""")
def structure_problems(spark, d):
    k = F.col("s_suppkey")
    arms = V.table(spark, d, "supplier").select(k.alias("sequence"), F.when(k % 3 == 0, "baseline").otherwise("gmm").alias("arm"), (k % 4).alias("n_models"), (k % 5 > 0).alias("has_cameras"), (k % 7 > 0).alias("aligned"), F.when(k % 6 == 0, 0.0).when(k % 6 != 1, 0.1).alias("dbase"))
    return E.structure_problems(arms)


# ---- novel-view tables -------------------------------------------------------

PLACED = "placed AS (SELECT scene, arm, img, row_number() OVER (PARTITION BY scene, arm ORDER BY img) - 1 AS p FROM arm), renders AS (SELECT scene, arm, img, (p // 8)::BIGINT AS render FROM placed WHERE p % 8 = 0)"


@query(V.sql(["arm"], f", {PLACED} SELECT * FROM renders").replace("\n, placed", ",\nplaced"))
def test_split_every8(spark, d):
    got = E.every_nth(V.arm(spark, d).select("scene", "arm", "img"), ["scene", "arm"], "img")
    return got.select("scene", "arm", "img", F.col("render").cast("long").alias("render"))


@query(V.sql(["arm"], f", {PLACED} SELECT scene, img FROM renders GROUP BY ALL HAVING count(DISTINCT arm) = 5").replace("\n, placed", ",\nplaced"))
def common_views(spark, d):
    return E.common_items(E.every_nth(V.arm(spark, d).select("scene", "arm", "img"), ["scene", "arm"], "img"), ["scene", "img"], "arm", 5)


@query(V.sql(["arm"], f""", {PLACED} SELECT scene, img, {', '.join(f'max(CASE WHEN arm = {a!r} THEN render END) AS "{a}"' for a in V.ARMS)} FROM renders GROUP BY scene, img HAVING count(DISTINCT arm) = 5""").replace("\n, placed", ",\nplaced"))
def render_index_map(spark, d):
    renders = E.every_nth(V.arm(spark, d).select("scene", "arm", "img"), ["scene", "arm"], "img").withColumn("render", F.col("render").cast("long"))
    return E.view_map(renders, ["scene", "img"], "arm", V.ARMS)


@query(V.sql(["arm"], "SELECT scene FROM arm GROUP BY scene HAVING count(DISTINCT arm) = 5"))
def all_arms_scenes(spark, d):
    return E.complete_groups(V.arm(spark, d), "scene", "arm", 5)


@query(V.sql(["arm"], "SELECT arm, round(avg(psnr), 6) AS psnr FROM arm GROUP BY arm"))
def arm_means(spark, d):
    return E.arm_means(V.arm(spark, d), "arm", ["psnr"]).select("arm", r6(F.col("psnr"), "psnr"))


DELTA = "delta AS (SELECT a.scene, a.img, a.arm, round(a.psnr - b.psnr, 9) AS delta FROM arm a JOIN arm b ON a.scene = b.scene AND a.img = b.img AND b.arm = '1-URGENT' WHERE a.arm <> '1-URGENT')"


def _deltas(spark, d):
    got = E.paired_deltas(V.arm(spark, d), ["scene", "img"], "arm", V.BASELINE, "psnr")
    return got.withColumn("delta", F.round("delta", 9))


def _delta_sql(body):
    return V.sql(["arm"], f", {DELTA} {body}").replace("\n, delta", ",\ndelta")


@query(_delta_sql("SELECT * FROM delta"))
def paired_delta(spark, d):
    return _deltas(spark, d)


_cells = ", ".join(f"round(avg(CASE WHEN arm = '{a}' THEN delta END), 5) AS \"{a}\"" for a in V.ARMS[1:])
_inner = ", ".join(f"avg(CASE WHEN arm = '{a}' THEN delta END) AS \"{a}\"" for a in V.ARMS[1:])
_foot = lambda f: ", ".join(f'round({f}("{a}"), 5)' for a in V.ARMS[1:])


@query(_delta_sql(f"SELECT scene::VARCHAR AS scene, {_cells} FROM delta GROUP BY scene UNION ALL SELECT 'MEAN', {_foot('avg')} FROM (SELECT {_inner} FROM delta GROUP BY scene) UNION ALL SELECT 'MEDIAN', {_foot('median')} FROM (SELECT {_inner} FROM delta GROUP BY scene)"))
def scene_arm_pivot(spark, d):
    got = E.scene_table(_deltas(spark, d), "scene", "arm", V.ARMS[1:])
    return got.select("scene", *(F.round(F.col(f"`{a}`"), 5).alias(a) for a in V.ARMS[1:]))


@query(_delta_sql("SELECT arm, count_if(delta > 0.5) AS win, count_if(delta BETWEEN -0.5 AND 0.5) AS neutral, count_if(delta < -0.5) AS loss, round(avg(delta), 5) AS mean, round(median(delta), 5) AS median, round(CASE WHEN count_if(delta < -0.5) > 0 THEN count_if(delta > 0.5) / count_if(delta < -0.5) END, 5) AS ratio FROM delta GROUP BY arm"))
def win_loss(spark, d):
    got = E.win_loss(_deltas(spark, d), "arm", 0.5)
    return got.select("arm", "win", "neutral", "loss", *(F.round(c, 5).alias(c) for c in ("mean", "median")), F.round("ratio", 5).alias("ratio"))


DIFF = "diff AS (SELECT g.scene % 3 AS placement, round(g.delta - u.delta, 3) AS diff FROM delta g JOIN delta u USING (scene, img) WHERE g.arm = '3-MEDIUM' AND u.arm = '2-HIGH')"


def _diffs(spark, d):
    deltas = _deltas(spark, d)
    u, g = (deltas.filter(F.col("arm") == a).select("scene", "img", F.col("delta").alias(n)) for a, n in (("2-HIGH", "u"), ("3-MEDIUM", "g")))
    return g.join(u, ["scene", "img"]).select((F.col("scene") % 3).alias("placement"), F.round(F.col("g") - F.col("u"), 3).alias("diff"))


@query(_delta_sql(f""", {DIFF}, ranked AS (SELECT placement, diff, rank() OVER (PARTITION BY placement ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY placement, abs(diff)) - 1) / 2 AS r FROM diff WHERE diff <> 0)
SELECT placement::BIGINT AS placement, n, better, worse, median_diff, n_nonzero, w_plus, w_minus FROM (SELECT placement, count(*) AS n, count_if(diff > 0) AS better, count_if(diff < 0) AS worse, round(median(diff), 5) AS median_diff FROM diff GROUP BY 1)
JOIN (SELECT placement, count(*) AS n_nonzero, sum(CASE WHEN diff > 0 THEN r ELSE 0 END)::DOUBLE AS w_plus, sum(CASE WHEN diff < 0 THEN r ELSE 0 END)::DOUBLE AS w_minus FROM ranked GROUP BY 1) USING (placement)""").replace(" , diff AS", ", diff AS"))
def signed_rank_w(spark, d):
    got = E.signed_ranks(_diffs(spark, d), ["placement"])
    return got.select(F.col("placement").cast("long").alias("placement"), "n", "better", "worse", F.round("median_diff", 5).alias("median_diff"), "n_nonzero", "w_plus", "w_minus")


@query()
def signed_rank_p(spark, d):
    """The p needs the error function, which SQL lacks; tested against a direct computation."""
    return E.signed_rank_test(_diffs(spark, d), ["placement"])


@query(_delta_sql("SELECT 'win' AS side, * FROM (SELECT * FROM delta WHERE arm <> '5-LOW' AND scene <> 3 ORDER BY delta DESC, scene, img, arm LIMIT 20) UNION ALL SELECT 'loss', * FROM (SELECT * FROM delta WHERE arm <> '5-LOW' AND scene <> 3 ORDER BY delta, scene, img, arm LIMIT 20)"))
def top_extremes(spark, d):
    kept = _deltas(spark, d).filter("arm <> '5-LOW' AND scene <> 3")
    return E.extremes(kept, ["scene", "img", "arm"])


@query(V.sql(["arm"], f", {PLACED}, common AS (SELECT scene, img FROM renders GROUP BY ALL HAVING count(DISTINCT arm) = 5) SELECT scene, (SELECT count(*) FROM common c WHERE c.scene = r.scene)::VARCHAR || '/' || count(*)::VARCHAR AS ratio FROM renders r WHERE arm = '1-URGENT' GROUP BY scene").replace("\n, placed", ",\nplaced"))
def registered_ratio(spark, d):
    renders = E.every_nth(V.arm(spark, d).select("scene", "arm", "img"), ["scene", "arm"], "img")
    common = E.common_items(renders, ["scene", "img"], "arm", 5).groupBy("scene").agg(F.count("*").alias("c"))
    base = renders.filter(F.col("arm") == V.BASELINE).groupBy("scene").agg(F.count("*").alias("b"))
    return base.join(common, "scene", "left").select("scene", F.concat_ws("/", F.coalesce("c", F.lit(0)).cast("string"), F.col("b").cast("string")).alias("ratio"))
