"""Projecting measured rates to a realistic share of malicious rows, and intervals for rates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argusframe.checkpoints import materialize
from argusframe.functions.columns import safe_ratio
from argusframe.operators.metrics import roc_points

PREVALENCES = [1e-3, 1e-4, 1e-5]
VOLUMES = [10_000, 100_000]


def ppv(fpr: Column, tpr: Column, prevalence: Column) -> Column:
    return safe_ratio(tpr * prevalence, tpr * prevalence + fpr * (1 - prevalence))


def alert_rate(fpr: Column, tpr: Column, prevalence: Column) -> Column:
    return tpr * prevalence + fpr * (1 - prevalence)


def project(rates: DataFrame, prevalences: list[float] = PREVALENCES, volumes: list[int] = VOLUMES) -> DataFrame:
    """Each row of ``rates`` (fp, tn, tp, fn) at each prevalence: ppv, alert_rate, expected counts in each
    volume, and the rule-of-three bound on the false-positive rate where none was seen."""
    fpr, tpr, pi = safe_ratio(F.col("fp"), F.col("fp") + F.col("tn")), safe_ratio(F.col("tp"), F.col("tp") + F.col("fn")), F.col("prevalence")
    at = rates.select("*", F.explode(F.array(*map(F.lit, prevalences))).alias("prevalence"))
    counts = [c for v in volumes for c in ((fpr * (1 - pi) * v).alias(f"fp_per_{v}"), (tpr * pi * v).alias(f"tp_per_{v}"))]
    bound = F.when(F.col("fp") == 0, safe_ratio(F.lit(3.0), F.col("tn") + F.col("fp")))
    return at.select(
        *rates.columns, "prevalence", ppv(fpr, tpr, pi).alias("ppv"), alert_rate(fpr, tpr, pi).alias("alert_rate"), *counts, bound.alias("fpr_upper")
    )


def threshold_for_ppv(scored: DataFrame, targets: list[float], prevalence: float) -> DataFrame:
    """target, threshold, tp, fp: of the curve's points whose projected precision reaches the target, the one
    of highest recall, and of those the highest threshold. No row where none does."""
    points = materialize(roc_points(scored), "ppv-points")
    goals = F.broadcast(scored.sparkSession.createDataFrame([(t,) for t in targets], "target double"))  # the caller's list
    good = ppv(F.col("fp") / F.col("n"), F.col("tp") / F.col("p"), F.lit(prevalence)) >= F.col("target")
    kept = points.join(goals).where(good & (F.col("tp") > 0))
    best = kept.groupBy("target").agg(F.max(F.struct("tp", "threshold", "fp")).alias("b"))
    return best.select("target", "b.threshold", "b.tp", "b.fp")


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / (d or 1e-300)
    c, value = 1.0, d
    for m in range(1, 1000):
        for up in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + up * d) or 1e-300)
            c = (1 + up / c) or 1e-300
            value *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * value


def beta_quantile(p: float, a: float, b: float) -> float:
    low, high = 0.0, 1.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if incomplete_beta(a, b, mid) < p else (low, mid)
    return (low + high) / 2


def clopper_pearson(k: int, n: int, confidence: float = 0.95) -> tuple[float, float]:
    """Exact interval of a rate of k in n; NaN for n = 0."""
    if n == 0:
        return math.nan, math.nan
    tail = (1 - confidence) / 2
    return (0.0 if k == 0 else beta_quantile(tail, k, n - k + 1)), (1.0 if k == n else beta_quantile(1 - tail, k + 1, n - k))


def with_intervals(counts: DataFrame, k: str, n: str, name: str) -> DataFrame:
    """Two columns more, <name>_low and <name>_high; for small tables such as sweeps."""

    @F.pandas_udf("low double, high double")
    def interval(ks, ns):
        import pandas as pd

        return pd.DataFrame([clopper_pearson(int(a), int(b)) for a, b in zip(ks, ns, strict=True)], columns=["low", "high"])

    return counts.withColumn("_ci", interval(k, n)).select(*counts.columns, F.col("_ci.low").alias(f"{name}_low"), F.col("_ci.high").alias(f"{name}_high"))
