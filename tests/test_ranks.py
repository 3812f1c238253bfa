"""Row numbers over a whole table."""

from pyspark.sql import functions as F


def test_numbers_follow_the_order(spark):
    from plumbline.operators.ranks import numbered

    df = spark.range(5000).select("id", (F.col("id") * 7919 % 311).alias("value"), F.lit("own").alias("number_at"), F.lit(1).alias("number_at_range"))
    rows = numbered(df, [F.col("value").desc(), F.col("id").asc()]).collect()
    want = sorted(((r.value, r.id) for r in rows), key=lambda x: (-x[0], x[1]))
    assert [(r.value, r.id) for r in sorted(rows, key=lambda r: r.number)] == want
    assert sorted(r.number for r in rows) == list(range(1, 5001))
    assert {r.number_at for r in rows} == {"own"}


def test_numbers_of_one_value_and_of_nothing(spark):
    from plumbline.operators.ranks import numbered

    same = spark.range(1000).select(F.lit(3).alias("value"))
    assert sorted(r.number for r in numbered(same, [F.col("value").asc()]).collect()) == list(range(1, 1001))
    assert numbered(same.filter("value > 3"), [F.col("value").asc()]).collect() == []


def test_quantiles_are_numpy_quantiles(spark):
    import numpy as np

    from plumbline.operators.ranks import quantiles

    rng = np.random.default_rng(2)
    rows = [(None if i % 11 == 0 else f"g{i % 3}", i % 2, float(x), None if i % 5 == 0 else float(round(x))) for i, x in enumerate(rng.normal(size=4000) * 10)]
    rows += [("one", 0, 7.0, None), ("none", 1, None, None)]
    df = spark.createDataFrame(rows, "k string, p int, a double, b double")
    wanted = {"a_median": ("a", 0.5), "a_p90": ("a", 0.9), "b_low": ("b", 0.0), "b_max": ("b", 1.0), "b_q": (F.col("b") * 2, 0.37)}
    got = {(r.k, r.p): r for r in quantiles(df, ["k", "p"], wanted).collect()}
    groups = {}
    for k, p, a, b in rows:
        groups.setdefault((k, p), []).append((a, b))
    assert set(got) == set(groups) - {("none", 1)}
    for key, values in groups.items():
        if key in got:
            a, b = ([v[i] for v in values if v[i] is not None] for i in (0, 1))
            expected = [np.quantile(a, 0.5), np.quantile(a, 0.9), *((np.quantile(b, 0.0), np.quantile(b, 1.0), 2 * np.quantile(b, 0.37)) if b else (None,) * 3)]
            assert [got[key][n] is None if e is None else np.isclose(got[key][n], e) for n, e in zip(wanted, expected, strict=True)] == [True] * 5
    whole = quantiles(df, [], {"m": ("a", 0.5)}).collect()
    assert len(whole) == 1 and np.isclose(whole[0].m, np.median([r[2] for r in rows if r[2] is not None]))


def test_a_group_that_holds_all_rows_is_spread_over_tasks(spark):
    import numpy as np

    from plumbline.operators.ranks import PLACE_BITS, ranked_within
    from plumbline.staging import staged

    df = spark.range(40_000).select(F.lit("all").alias("g"), (F.col("id") * 7919 % 40_009).cast("double").alias("v"))
    got = ranked_within(df, ["g"], [F.col("v").asc()], "r")
    assert got.filter("r_of <> 40000").count() == 0 and got.agg(F.min("r"), F.max("r"), F.countDistinct("r")).first() == (1, 40_000, 40_000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        order = [F.col("g").asc(), F.col("v").asc()]
        placed = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "spread")
        sizes = [r.n for r in placed.groupBy(F.shiftright("at", PLACE_BITS)).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 8 and max(sizes) < 3 * np.median(sizes)


def test_pose_auc_is_the_area_under_the_curve(spark):
    import numpy as np

    from plumbline.operators.evaluation import pose_auc

    rng = np.random.default_rng(4)
    errors = np.round(rng.exponential(6, 500), 2)
    got = {r.threshold: r.auc for r in pose_auc(spark.createDataFrame([(1, float(e)) for e in errors], "k int, e double"), ["k"], "e", [1, 5, 20, 0.001]).collect()}
    for t, auc in got.items():
        e = np.sort(errors)
        x, y = np.concatenate([[0], e[e <= t], [t]]), np.concatenate([[0], np.arange(1, len(e) + 1)[e <= t] / len(e)])
        assert np.isclose(auc, np.trapezoid(np.append(y, y[-1]), x) / t)
