"""Exact evaluation of scores against binary labels.

Everything starts from one aggregate by distinct score, so the ordered part is as small as the number of
distinct scores, and that part runs as distributed running totals. A rate without a denominator is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argusframe.checkpoints import materialize
from argusframe.functions.columns import rate_or_null, safe_ratio
from argusframe.operators.ordering import running_totals


def confusion(scored: DataFrame, threshold: float, by: list[str] | None = None) -> DataFrame:
    """tn, fp, fn, tp, precision, recall, f1, fpr of score >= threshold; empty denominators give 0.0."""
    hit, bad = F.col("score") >= threshold, F.col("label") == 1
    counted = scored.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), F.count_if(~hit & ~bad).alias("tn"), F.count_if(hit & ~bad).alias("fp"), F.count_if(~hit & bad).alias("fn"), F.count_if(hit & bad).alias("tp")
    )
    p, r = safe_ratio(F.col("tp"), F.col("tp") + F.col("fp")), safe_ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counted.select(
        "*", p.alias("precision"), r.alias("recall"), safe_ratio(2 * p * r, p + r).alias("f1"), safe_ratio(F.col("fp"), F.col("fp") + F.col("tn")).alias("fpr")
    )


def three_way(scored: DataFrame, allow: float, block: float) -> DataFrame:
    """Per label: n_allow (score < allow), n_block (score >= block), n_alert (between)."""
    low, high = F.col("score") < allow, F.col("score") >= block
    return scored.groupBy("label").agg(
        F.count("*").alias("n"), F.count_if(low).alias("n_allow"), F.count_if(~low & ~high).alias("n_alert"), F.count_if(high).alias("n_block")
    )


def by_score(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """pos and neg of each distinct score; NaN scores take no part."""
    return scored.where(~F.isnan("score")).groupBy(*(by or []), "score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg")
    )


def curve(scored: DataFrame) -> DataFrame:
    """Cumulative tp and fp by falling distinct score, with the totals p and n on each row."""
    counted = by_score(scored)
    run = running_totals(counted, [F.desc("score")], {"tp": F.col("pos"), "fp": F.col("neg")}, "curve")
    totals = counted.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return run.join(F.broadcast(totals))  # one row


def auc(scored: DataFrame) -> DataFrame:
    """n_pos, n_neg, auc: each positive counts the negatives of lower score, and half of those of its own."""
    ranks = curve(scored)
    wins = F.sum(F.col("pos") * ((F.col("n") - F.col("fp")).cast("double") + F.col("neg") / 2.0))
    totals = ranks.agg(F.max("p").alias("n_pos"), F.max("n").alias("n_neg"), wins.alias("w"))
    return totals.select("n_pos", "n_neg", rate_or_null(F.col("w"), F.col("n_pos") * F.col("n_neg")).alias("auc"))


def aucs_by(scored: DataFrame, by: list[str]) -> DataFrame:
    """by, n_pos, n_neg, auc: ``auc`` for each key. One order over (key, score), dealt in ranges, so a key with most
    of the scores is summed by many tasks."""
    counted = by_score(scored, by)
    run = materialize(running_totals(counted, [*map(F.col, by), F.col("score")], {"upto": F.col("neg")}, "aucs"), "aucs-summed")
    starts = run.groupBy(*by).agg(F.min(F.col("upto") - F.col("neg")).alias("base"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by]
    below = run.alias("l").join(starts.alias("r"), same).select(
        *[F.col(f"l.{c}") for c in by], "pos", "neg", (F.col("upto") - F.col("neg") - F.col("base")).alias("below")
    )
    got = below.groupBy(*by).agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(F.col("pos") * (F.col("below").cast("double") + F.col("neg") / 2.0)).alias("w")
    )
    return got.select(*by, "n_pos", "n_neg", rate_or_null(F.col("w"), F.col("n_pos") * F.col("n_neg")).alias("auc"))


def feature_aucs(features: DataFrame, columns: dict[str, Column], label: Column) -> DataFrame:
    """feature, auc, separation = max(auc, 1 - auc) of each column alone, all in one pass over the rows."""
    stacked = features.select(
        label.alias("label"), F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), c.cast("double").alias("score")) for k, c in columns.items()])).alias("x")
    ).select("label", "x.*")
    a = F.col("auc")
    return aucs_by(stacked, ["feature"]).select("feature", "auc", F.greatest(a, 1 - a).alias("separation"))


def roc_points(scored: DataFrame, corners_only: bool = True) -> DataFrame:
    """threshold, tp, fp, p, n by falling threshold; with ``corners_only`` without the points inside straight
    stretches (same step before and after), which threshold choice skips as well."""
    points = materialize(curve(scored), "roc")
    if corners_only:
        step = running_totals(points.select("score", "tp", "fp", "pos", "neg", "p", "n"), [F.desc("score")], {"i": F.lit(1)}, "roc-steps")
        step = materialize(step, "roc-numbered")
        after = step.select((F.col("i") - 1).alias("i"), F.col("pos").alias("next_pos"), F.col("neg").alias("next_neg"))
        turned = step.join(after, "i", "left")
        points = turned.where((F.col("i") == 1) | F.col("next_pos").isNull() | (F.col("pos") != F.col("next_pos")) | (F.col("neg") != F.col("next_neg")))
    return points.select(F.col("score").alias("threshold"), "tp", "fp", "p", "n")


def targets_table(scored: DataFrame, targets: list[float]) -> DataFrame:
    return scored.sparkSession.createDataFrame([(t,) for t in targets], "target double")


def thresholds_for_fpr(scored: DataFrame, targets: list[float], exact: bool = False) -> DataFrame:
    """target, threshold, fp, tp, n_benign, n_malicious: the last point of the curve whose false-positive
    rate is at most the target. No such point: null threshold and no hits. Curve points only fall in
    threshold as fp and tp rise, so extremes over the qualifying points find it in one aggregate."""
    points = materialize(roc_points(scored, corners_only=not exact), "points")
    goals = F.broadcast(targets_table(scored, targets))  # the caller's list
    ok = F.col("fp") <= F.col("target") * F.col("n")
    chosen = points.join(goals).groupBy("target").agg(
        F.min(F.when(ok, F.col("threshold"))).alias("threshold"), F.coalesce(
            F.max(F.when(ok, F.col("fp"))), F.lit(0)
        ).alias("fp"), F.coalesce(F.max(F.when(ok, F.col("tp"))), F.lit(0)).alias("tp"),
        F.max("n").alias("n_benign"), F.max("p").alias("n_malicious"),
    )
    return chosen


def sweep(scored: DataFrame, targets: list[float]) -> DataFrame:
    """Thresholds for many targets with actual rates and the number of rows exactly at each cut."""
    chosen = thresholds_for_fpr(scored, targets)
    ties = by_score(scored).select(F.col("score").alias("threshold"), (F.col("pos") + F.col("neg")).alias("n_tied"))
    out = ties.join(F.broadcast(chosen), "threshold", "right")  # a row a target
    return out.select(
        "target", "threshold", rate_or_null(F.col("fp"), F.col("n_benign")).alias("actual_fpr"), F.col("fp").alias("n_fp"), "n_benign",
        rate_or_null(F.col("tp"), F.col("n_malicious")).alias("detection_rate"), F.col("tp").alias("n_tp"), "n_malicious",
        F.coalesce("n_tied", F.lit(0)).alias("n_tied")
    )


def pr_areas(scored: DataFrame) -> DataFrame:
    """pr_auc (trapezoids between the points of the curve, from recall 0 at precision 1) and
    average_precision (steps)."""
    run = curve(scored)
    before_tp, before_fp = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    was = F.when(before_tp + before_fp == 0, F.lit(1.0)).otherwise(before_tp / F.nullif(before_tp + before_fp, F.lit(0)))
    gain = F.col("pos") / F.nullif(F.col("p"), F.lit(0)).cast("double")
    return run.agg(F.sum(gain * (precision + was) / 2).alias("pr_auc"), F.sum(gain * precision).alias("average_precision"))


def per_class_detection(scored: DataFrame, threshold: float, support: DataFrame, margin: float = 0.05, least: int = 5000) -> DataFrame:
    """Per label_raw: n, detected, rate, n_train (from ``support``: label_raw, n_train), flags for rates far
    below the mean of all malicious rows and for small support."""
    hit = F.col("score") >= threshold
    each = scored.groupBy("label_raw", "label").agg(F.count("*").alias("n"), F.count_if(hit).alias("detected"))
    overall = scored.where("label = 1").agg(safe_ratio(F.count_if(hit), F.count("*")).alias("aggregate"))
    out = each.join(support, "label_raw", "left").join(F.broadcast(overall))  # one row
    rate = safe_ratio(F.col("detected"), F.col("n"))
    low = (F.col("label") == 1) & (rate < F.col("aggregate") - margin)
    n_train = F.coalesce("n_train", F.lit(0))
    return out.select(
        "label_raw", "label", "n", "detected", rate.alias("rate"), n_train.alias("n_train"), low.cast("int").alias("is_low"),
        (low & (n_train < least)).cast("int").alias("is_low_support")
    )


def error_statistics(pairs: DataFrame, threshold: float, near: float = 1e-6) -> DataFrame:
    """Of score pairs a, b: max, mean and median absolute difference, flips and near ties at a threshold, correlation."""
    gap = F.abs(F.col("a") - F.col("b"))
    flip = (F.col("a") >= threshold) != (F.col("b") >= threshold)
    return pairs.agg(
        F.count("*").alias("n"), F.max(gap).alias("max_abs"), F.avg(gap).alias("mean_abs"), F.percentile(gap, 0.5).alias("median_abs"),
        F.count_if(flip).alias("n_flips"), F.count_if(F.abs(F.col("a") - threshold) <= near).alias("n_ties"), F.corr("a", "b").alias("correlation")
    )


def worst_row(pairs: DataFrame, key: list[str]) -> DataFrame:
    """The row (key, a, b, gap) whose scores differ most; of equals the smallest key. A NaN is no difference."""
    gap = F.abs(F.col("a") - F.col("b"))
    order = F.struct(F.coalesce(F.nanvl(gap, F.lit(-1.0)), F.lit(-1.0)).alias("g"))
    best = pairs.select(*key, "a", "b", order["g"].alias("gap")).where("gap >= 0")
    return best.agg(
        F.min(F.struct((-F.col("gap")).alias("_g"), *key, "a", "b", "gap")).alias("w")
    ).where("w IS NOT NULL").select(*[f"w.{k}" for k in key], "w.a", "w.b", "w.gap")
