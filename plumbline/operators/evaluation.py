"""Evaluation reports: error distributions, pose AUC, drift, tail rates, paired comparisons, novel-view tables."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.operators import ranks
from plumbline.staging import discard, staged


def bad_percent(error: str, tail: float) -> Column:
    return (100 * F.avg((F.col(error) > tail).cast("double"))).alias("bad_pct")


def error_figures(errors: DataFrame, keys: list[str], prefixes: dict[str, str], others: list[Column] = [], more: dict[str, tuple[str, float]] | None = None) -> DataFrame:  # noqa: B006
    """keys, n, mean, median, 90th percentile (linear interpolation, exact) and maximum of each error, ``others`` and ``more`` quantiles."""
    sums = [f(F.col(e)).alias(f"{p}{n}") for e, p in prefixes.items() for n, f in (("mean", F.avg), ("max", F.max))]
    middle = {f"{p}{n}": (e, q) for e, p in prefixes.items() for n, q in (("median", 0.5), ("p90", 0.9))}
    base = errors.groupBy(*keys).agg(F.count("*").alias("n"), *sums, *others)
    return ranks.beside(base, ranks.quantiles(errors, keys, middle | (more or {})), keys)


def error_summary(errors: DataFrame, keys: list[str], error: str, tail: float | None = None) -> DataFrame:
    return error_figures(errors, keys, {error: ""}, [] if tail is None else [bad_percent(error, tail)])


def pooled(cameras: DataFrame, sequences: DataFrame, tail: float) -> DataFrame:
    """Per arm: cameras of all sequences pooled (columns pos, rot), and medians over sequences of scale and dbase."""
    by_camera = error_figures(cameras, ["arm"], {"pos": "pos_"}, [bad_percent("pos", tail)], {"rot_median": ("rot", 0.5), "rot_p90": ("rot", 0.9)})
    middle = ranks.quantiles(sequences, ["arm"], {"scale": ("scale", 0.5), "dbase": ("dbase", 0.5)})
    by_sequence = ranks.beside(sequences.groupBy("arm").agg(F.count("*").alias("n_seq")), middle, ["arm"])
    return by_camera.join(by_sequence, "arm", "left")


def pose_auc(errors: DataFrame, keys: list[str], error: str, thresholds: list[float]) -> DataFrame:
    """Area under the recall curve up to each threshold, over the threshold: keys, threshold, auc.

    The curve goes from (0, 0) through (e_i, i / n) for the sorted errors e_i.  Summed by parts, the area under it up to the
    largest error m of the k that are at most t is (m (2 k + 1) - 2 * their sum) / 2 n, so nothing need be sorted.
    """
    e = F.col(error)
    cut = lambda f, t: f(F.when(e <= float(t), e))
    sums = [x for i, t in enumerate(thresholds) for x in (F.count_if(e <= float(t)).alias(f"_k{i}"), F.coalesce(cut(F.max, t), F.lit(0.0)).alias(f"_m{i}"), F.coalesce(cut(F.sum, t), F.lit(0.0)).alias(f"_s{i}"))]
    got = errors.groupBy(*keys).agg(F.count("*").alias("_n"), *sums)
    at = lambda i, t: F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_k{i}").alias("_k"), F.col(f"_m{i}").alias("_m"), F.col(f"_s{i}").alias("_s"))
    got = got.select(*keys, "_n", F.explode(F.array(*(at(i, t) for i, t in enumerate(thresholds)))).alias("_t")).select(*keys, "_n", "_t.*")
    area = (F.col("_m") * (2 * F.col("_k") + 1) - 2 * F.col("_s")) / (2 * F.col("_n"))
    return got.select(*keys, "threshold", ((area + (F.col("threshold") - F.col("_m")) * F.col("_k") / F.col("_n")) / F.col("threshold")).alias("auc"))


def drift_profile(errors: DataFrame, keys: list[str], order: str, error: str, parts: int = 10) -> DataFrame:
    """Median error of each tenth of a trajectory, in frame order; of uneven tenths the first are longer by one."""
    ranked = ranks.ranked_within(errors.select(*keys, order, error), keys, [F.col(order).asc()], "_i")
    i, each, longer = F.col("_i") - 1, F.floor(F.col("_i_of") / parts), F.col("_i_of") % parts
    cut = longer * (each + 1)
    part = F.when(i < cut, F.floor(i / (each + 1))).otherwise(longer + F.floor((i - cut) / F.greatest(each, F.lit(1)))) + 1
    cells = ranked.withColumn("part", part.cast("int"))
    found = ranks.quantiles(cells, [*keys, "part"], {"median": (error, 0.5)})
    whole = ranks.beside(staged(cells.select(*keys, "part").distinct(), "parts"), found, [*keys, "part"])
    discard(ranked)
    return whole


def worst_row(errors: DataFrame, keys: list[str], name: str, error: str) -> DataFrame:
    """The row of the largest error, the first by name among equals."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(error).desc(), name))
    return errors.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def centre_extent(centres: DataFrame, keys: list[str]) -> DataFrame:
    """Diagonal of the box around camera centres (x, y, z); null for fewer than two."""
    side = lambda c: F.max(c) - F.min(c)
    diagonal = F.sqrt(side("x") * side("x") + side("y") * side("y") + side("z") * side("z"))
    return centres.groupBy(*keys).agg(F.when(F.count("*") >= 2, diagonal).alias("extent"))


def relative_pose_errors(poses: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Errors of relative poses of neighbouring frames, by rotation and direction of translation.

    ``poses`` has est_r, gt_r (arrays of 9) and est_t, gt_t (arrays of 3), camera from world.  rot_err is there for
    every pair; trans_err and pose_err are null for a pair without a baseline.
    """
    follow = Window.partitionBy(*keys).orderBy(order)
    lead = {f"{c}_next": F.lead(c).over(follow) for c in ("est_r", "gt_r", "est_t", "gt_t")}
    pairs = poses.withColumns(lead).filter(F.col("est_r_next").isNotNull())
    rot = G.rotation_angle(G.relative_rotation(F.col("est_r"), F.col("est_r_next")), G.relative_rotation(F.col("gt_r"), F.col("gt_r_next")))
    move = lambda k: G.relative_translation(F.col(f"{k}_r"), F.col(f"{k}_t"), F.col(f"{k}_r_next"), F.col(f"{k}_t_next"))
    pairs = pairs.withColumn("rot_err", rot).withColumn("trans_err", G.direction_angle(move("est"), move("gt")))
    pose = F.when(F.col("trans_err").isNotNull(), F.greatest("rot_err", "trans_err"))
    return pairs.select(*keys, order, "rot_err", "trans_err", pose.alias("pose_err"))


# ---- paired comparisons of arms --------------------------------------------


def every_nth(names: DataFrame, keys: list[str], name: str, n: int = 8) -> DataFrame:
    """Every nth name of a sorted list, from the first; with its place among those taken."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(name)) - 1
    taken = names.withColumn("_place", place).filter(F.col("_place") % n == 0)
    return taken.withColumn("render", (F.col("_place") / n).cast("int")).drop("_place")


def complete_groups(rows: DataFrame, group: str, member: str, n: int) -> DataFrame:
    """Groups that have all ``n`` members (relational division)."""
    return rows.groupBy(group).agg(F.countDistinct(member).alias("m")).filter(F.col("m") == n).select(group)


def common_items(rows: DataFrame, keys: list[str], arm: str, n_arms: int) -> DataFrame:
    """Items (keys) that every arm has."""
    return rows.groupBy(*keys).agg(F.countDistinct(arm).alias("m")).filter(F.col("m") == n_arms).select(*keys)


def view_map(renders: DataFrame, keys: list[str], arm: str, arms: list[str]) -> DataFrame:
    """For each item that all arms share, its render number in every arm (one column an arm)."""
    wide = renders.groupBy(*keys).pivot(arm, arms).agg(F.first("render"))
    return wide.dropna(subset=arms)


def paired_deltas(values: DataFrame, keys: list[str], arm: str, baseline: str, value: str) -> DataFrame:
    """keys, arm, delta of each arm's value to the baseline's on the same item."""
    base = values.filter(F.col(arm) == baseline).select(*keys, F.col(value).alias("_base"))
    others = values.filter(F.col(arm) != baseline)
    return others.join(base, keys).select(*keys, arm, (F.col(value) - F.col("_base")).alias("delta"))


def arm_means(values: DataFrame, arm: str, metrics: list[str]) -> DataFrame:
    return values.groupBy(arm).agg(*(F.avg(m).alias(m) for m in metrics))


def scene_table(deltas: DataFrame, scene: str, arm: str, arms: list[str]) -> DataFrame:
    """Mean delta per scene, one column an arm, with rows MEAN and MEDIAN over scenes."""
    table = deltas.groupBy(F.col(scene).cast("string").alias("scene")).pivot(arm, arms).agg(F.avg("delta"))
    table = staged(table, "scene-table")
    mean = table.groupBy().agg(*(F.avg(F.col(f"`{a}`")).alias(a) for a in arms))
    middle = ranks.quantiles(table, [], {a: (F.col(f"`{a}`"), 0.5) for a in arms})
    foot = [df.select(F.lit(name).alias("scene"), *(F.col(f"`{a}`") for a in arms)) for name, df in (("MEAN", mean), ("MEDIAN", middle))]
    return table.unionByName(foot[0]).unionByName(foot[1])


def win_loss(deltas: DataFrame, arm: str, threshold: float) -> DataFrame:
    d = F.col("delta")
    got = deltas.groupBy(arm).agg(
        F.count_if(d > threshold).alias("win"),
        F.count_if(d.between(-threshold, threshold)).alias("neutral"),
        F.count_if(d < -threshold).alias("loss"),
        F.avg(d).alias("mean"),
    )
    got = ranks.beside(got, ranks.quantiles(deltas, [arm], {"median": ("delta", 0.5)}), [arm])
    return got.withColumn("ratio", F.try_divide(F.col("win").cast("double"), F.col("loss").cast("double")))


def signed_ranks(diffs: DataFrame, keys: list[str], diff: str = "diff") -> DataFrame:
    """Per key: pairs, signs, median difference, W+ and W- over average ranks of non-zero differences, and the ties' term."""
    sized = diffs.filter(F.col(diff) != 0).select(*keys, F.abs(diff).alias("_size"), (F.col(diff) > 0).alias("_up"))
    placed = ranks.ranked_within(sized, keys, [F.col("_size").asc()], "_at")
    # rows of one size share the mean of their places
    tied = placed.groupBy(*keys, "_size").agg(F.min("_at").alias("_low"), F.count("*").alias("_ties"), F.count_if("_up").alias("_ups"))
    rank = F.col("_low") + (F.col("_ties") - 1) / 2
    w = tied.groupBy(*keys).agg(
        F.sum("_ties").alias("n_nonzero"),
        F.sum(rank * F.col("_ups")).alias("w_plus"),
        F.sum(rank * (F.col("_ties") - F.col("_ups"))).alias("w_minus"),
        F.sum((F.col("_ties") * (F.col("_ties") * F.col("_ties") - 1)).cast("double")).alias("tie_term"),
    )
    signs = diffs.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col(diff) > 0).alias("better"), F.count_if(F.col(diff) < 0).alias("worse"))
    signs = ranks.beside(signs, ranks.quantiles(diffs, keys, {"median_diff": (diff, 0.5)}), keys)
    held = staged(w, "signed-ranks")
    discard(placed)
    return ranks.beside(signs, held, keys)


EXACT = 50


def exact_p(n: int, least: int) -> float:
    """Twice the chance, at most 1, that the ranks 1..n with random signs sum to ``least`` or less on one side."""
    ways = [1] + [0] * (n * (n + 1) // 2)
    for rank in range(1, n + 1):
        for total in range(len(ways) - 1, rank - 1, -1):
            ways[total] += ways[total - rank]
    return min(1.0, 2 * sum(ways[: least + 1]) / 2**n)


def signed_rank_test(diffs: DataFrame, keys: list[str], diff: str = "diff") -> DataFrame:
    """Adds the two-sided p of the signed-rank statistic.

    It is exact for up to ``EXACT`` differences without ties or zeros, and that of the normal form otherwise.
    """
    found = signed_ranks(diffs, keys, diff)
    n = F.col("n_nonzero").cast("double")
    variance = n * (n + 1) * (2 * n + 1) / 24 - F.col("tie_term") / 48
    z = F.when(variance > 0, (F.least("w_plus", "w_minus") - n * (n + 1) / 4) / F.sqrt(variance))

    @F.pandas_udf("double")
    def two_sided(z: pd.Series, n: pd.Series, w: pd.Series, plain: pd.Series) -> pd.Series:
        held = [math.nan if pd.isna(v) else exact_p(int(k), int(least)) if ok and k <= EXACT else math.erfc(abs(v) / math.sqrt(2)) for v, k, least, ok in zip(z, n, w, plain, strict=True)]
        return pd.Series(held).where(z.notna().to_numpy())

    plain = (F.col("tie_term") == 0) & (F.col("n") == F.col("n_nonzero"))
    return found.withColumn("z", z).withColumn("p", two_sided("z", "n_nonzero", F.least("w_plus", "w_minus"), F.coalesce(plain, F.lit(False))))


def extremes(deltas: DataFrame, order: list[str], n: int = 20) -> DataFrame:
    """The n largest and n smallest deltas; ``order`` breaks ties."""
    top = deltas.orderBy(F.col("delta").desc(), *order).limit(n).withColumn("side", F.lit("win"))
    return top.unionByName(deltas.orderBy("delta", *order).limit(n).withColumn("side", F.lit("loss")))


def structure_problems(arms: DataFrame) -> DataFrame:
    """Problems of reconstructions (sequence, arm, n_models, has_cameras, aligned, dbase): sequence, arm, problem."""
    rules = {
        "no model": F.col("n_models") == 0,
        "no cameras": (F.col("n_models") > 0) & ~F.col("has_cameras"),
        "fragmented": F.col("n_models") > 1,
        "alignment failed": (F.col("n_models") > 0) & F.col("has_cameras") & ~F.col("aligned"),
        "no-op": F.coalesce(F.col("dbase") < 1e-9, F.lit(False)) & (F.col("arm") != "baseline"),
    }
    broken = F.array_compact(F.array(*(F.when(bad, F.lit(rule)) for rule, bad in rules.items())))
    return arms.select("sequence", "arm", F.explode(broken).alias("problem"))
