"""Evaluation of each signal on its splits, by a registry: what a report of all models is composed of.

Scored rows are id, split, label, score, and for some signals label_raw (attack types) or n_calls (length bands).
Every part is one row a split: counts, precision, recall, F1, false-positive rate, area under the curve, and precision
projected to a real prevalence. Only what is asked for is read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argusframe.operators import metrics, prevalence
from argusframe.operators.policy import Thresholds

SPLITS = ("val", "test")
REAL_PREVALENCE = 1e-4
#: Lengths of traces: too short to be scored in deployment, short, and whole.
BANDS = {"too_short": (None, 10), "short": (10, 100), "ok+truncated": (100, None)}


def part(scored: DataFrame, name: str, threshold: float, positive: float = REAL_PREVALENCE) -> DataFrame:
    """One row a split: the evaluation of ``scored`` at a threshold, called ``name``. NaN scores are no hits."""
    rows = scored.where(F.col("split").isin(*SPLITS))
    cells = metrics.confusion(rows.withColumn("score", F.nanvl("score", F.lit(float("-inf")))), threshold, ["split"])
    areas = metrics.aucs_by(rows.where(F.col("score").isNotNull()), ["split"]).select("split", "auc")
    out = cells.join(areas, "split", "left")
    return out.select(
        F.lit(name).alias("part"), "split", "n", "tn", "fp", "fn", "tp", "precision", "recall", "f1", "fpr", "auc",
        prevalence.ppv(F.col("fpr"), F.col("recall"), F.lit(positive)).alias("ppv")
    )


def together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def static(scored: DataFrame, t: Thresholds) -> DataFrame:
    """Both cuts: escalated is whatever isn't allowed, blocked what reaches the upper one."""
    return together([part(scored, "allow_boundary", t.static_allow), part(scored, "block_boundary", t.static_block)])


def one_cut(cut: Callable[[Thresholds], float]) -> Callable[[DataFrame, Thresholds], DataFrame]:
    return lambda scored, t: part(scored, "all", cut(t))


def in_band(n: Column, low: int | None, high: int | None) -> Column:
    return (F.lit(True) if low is None else n >= low) & (F.lit(True) if high is None else n < high)


def behavioral(scored: DataFrame, t: Thresholds) -> DataFrame:
    """Each band of lengths, all rows, and what deployment scores: all but the too short."""
    n = F.col("n_calls")
    bands = [part(scored.where(in_band(n, *limits)), f"band:{name}", t.behavioral) for name, limits in BANDS.items()]
    deployed = scored.where(~in_band(n, *BANDS["too_short"]))
    return together([*bands, part(deployed, "deployment_total", t.behavioral), part(scored, "model_raw_total", t.behavioral)])


EVALUATORS: dict[str, Callable[[DataFrame, Thresholds], DataFrame]] = {
    "static": static,
    "memory": one_cut(lambda t: t.memory),
    "network": one_cut(lambda t: t.network),
    "behavioral": behavioral,
    "emulation": one_cut(lambda t: t.emulation),
}


def evaluate(scored: dict[str, Callable[[], DataFrame]], t: Thresholds, only: list[str] | None = None) -> DataFrame:
    """signal, part, split and measures of the signals asked for (all that there are, if none is named); an unknown
    name is an error. ``scored`` gives each signal's rows when called, so what isn't asked for is never read."""
    asked = list(scored) if only is None else only
    unknown = [s for s in asked if s not in EVALUATORS or s not in scored]
    if unknown or not asked:
        raise ValueError(f"no such signals: {unknown}; there are {[s for s in EVALUATORS if s in scored]}")
    return together([EVALUATORS[s](scored[s](), t).select(F.lit(s).alias("signal"), "*") for s in asked])
