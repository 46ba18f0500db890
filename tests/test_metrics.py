"""Known values of intervals, projections, curves and sweeps."""

import math
import random

import pytest
from pyspark.sql import functions as F

from argusframe.components import connected_components
from argusframe.operators import metrics, prevalence
from argusframe.operators.ordering import running_totals


def test_clopper_pearson():
    assert prevalence.clopper_pearson(0, 10)[0] == 0 and prevalence.clopper_pearson(10, 10)[1] == 1
    assert all(map(math.isnan, prevalence.clopper_pearson(0, 0)))
    assert prevalence.clopper_pearson(5, 20) == pytest.approx((0.0866, 0.4910), abs=1e-4)


def test_ppv_anchors(spark):
    one = spark.range(1)
    ppv = lambda f, t, p: one.select(prevalence.ppv(F.lit(f), F.lit(t), F.lit(p)).alias("x")).first().x
    assert ppv(32 / 2930, 1.0, 3000 / 5930) == pytest.approx(0.9894, abs=1e-4)
    assert ppv(0.01, 1.0, 1e-4) == pytest.approx(0.00990198, abs=1e-8)
    assert ppv(0.0, 0.0, 0.5) == 0.0 and ppv(0.3, 1.0, 1.0) == 1.0


def test_rule_of_three(spark):
    got = prevalence.project(spark.createDataFrame([(0, 126, 765, 11)], "fp long, tn long, tp long, fn long")).first()
    assert got.fpr_upper == pytest.approx(3 / 126)


def test_sweep_example(spark):
    rows = [(0.10, 0)] * 18 + [(0.96, 0)] * 2 + [(0.05 + i * 0.95 / 19, 1) for i in range(20)]
    scored = spark.createDataFrame(rows, "score double, label int")
    got = metrics.sweep(scored, [0.1]).first()
    assert (got.n_fp, got.n_tp, got.n_tied) == (2, 18, 1) and got.threshold == pytest.approx(0.15)
    low = metrics.three_way(scored, 0.05, 0.97).where("label = 0").first()
    assert (low.n_allow, low.n_alert, low.n_block) == (0, 20, 0)


def test_one_class_and_empty(spark):
    rows = spark.createDataFrame([(0.5, 1), (0.7, 1)], "score double, label int")
    assert metrics.auc(rows).first().auc is None
    assert metrics.confusion(rows.limit(0), 0.5).first().precision == 0.0
    assert metrics.thresholds_for_fpr(rows.where("false"), [0.1]).count() == 0


def test_with_intervals(spark):
    got = prevalence.with_intervals(spark.createDataFrame([(5, 20)], "k long, n long"), "k", "n", "ci").first()
    assert (got.ci_low, got.ci_high) == pytest.approx((0.0866, 0.4910), abs=1e-4)


def test_running_totals(spark):
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 9)) for i in range(500)]
    got = running_totals(spark.createDataFrame(rows, "k int, v int"), [F.col("k")], {"s": F.col("v")}).orderBy("k").collect()
    total = 0
    for r in got:
        total += r.v
        assert r.s == total


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(20)], [(1, 1)], [], [(random.Random(5).randint(0, 60), i % 60) for i in range(50)]])
def test_components(spark, edges):
    name: dict[int, int] = {}

    def top(x):
        while name.setdefault(x, x) != x:
            x = name[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((top(a), top(b)))
            name[b] = a
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in name}


def test_worst_row_and_areas_by_key(spark):
    nan = float("nan")
    rows = spark.createDataFrame([(1, 0.1, 0.2), (2, 0.9, 0.1), (3, 0.1, 0.9), (4, nan, 0.5), (5, None, 0.1)], "i int, a double, b double")
    assert tuple(metrics.worst_row(rows, ["i"]).first())[:3] == (2, 0.9, 0.1) and metrics.worst_row(rows.where("i > 3"), ["i"]).isEmpty()
    scored = spark.createDataFrame([(k, i % 2, float(i % 5)) for k in ("x", "y") for i in range(20 + 10 * (k == "y"))] + [("z", 1, 1.0)], "k string, label int, score double")
    by = {r.k: r.auc for r in metrics.aucs_by(scored, ["k"]).collect()}
    assert by["z"] is None and all(abs(by[k] - metrics.auc(scored.where(F.col("k") == k)).first().auc) < 1e-12 for k in ("x", "y"))


def test_evaluators(spark):
    from argusframe.operators import evaluators
    from argusframe.operators.policy import Thresholds

    rows = spark.createDataFrame([(i, ("val", "test", "train")[i % 3], i % 2, (i * 37 % 100) / 100, i % 130) for i in range(600)], "id int, split string, label int, score double, n_calls int")
    read = []
    given = {n: (lambda n=n: (read.append(n), rows)[1]) for n in evaluators.EVALUATORS}
    got = evaluators.evaluate(given, Thresholds(), ["behavioral", "static"]).collect()
    assert sorted(read) == ["behavioral", "static"] and {r.split for r in got} == {"val", "test"}
    by = {(r.signal, r.part, r.split): r for r in got}
    for split in ("val", "test"):
        bands = [by["behavioral", f"band:{b}", split] for b in evaluators.BANDS]
        assert sum(b.n for b in bands) == by["behavioral", "model_raw_total", split].n and bands[1].n + bands[2].n == by["behavioral", "deployment_total", split].n
        assert by["static", "block_boundary", split].tp <= by["static", "allow_boundary", split].tp
        assert all(r.n == r.tn + r.fp + r.fn + r.tp and 0 <= r.ppv <= 1 and 0 <= r.auc <= 1 for r in got)
    for bad in (["other"], []):
        with pytest.raises(ValueError):
            evaluators.evaluate(given, Thresholds(), bad)


def test_memory_split_never_leaks(spark):
    from argusframe.operators import splits

    rows = [(i, f"Fam{i % 3}-Kind-{i // 4 % 40:08x}-{i % 4}.raw", f"v{i}", 1) for i in range(480)] + [(1000 + i, "Benign", f"b{i % 250}", 0) for i in range(300)]
    rows += [(2000, "Fam0-Kind-0000ffff-1.raw", "v1", 1)]  # shares a vector with another family's sample
    df = spark.createDataFrame(rows, "id int, category string, vector string, label int")
    got = splits.memory_split(df, ["id"], "category", "vector").collect()
    assert len(got) == len(rows)
    by_vector, by_sample, sizes = {}, {}, {}
    for r in got:
        by_vector.setdefault(r.vector, set()).add(r.split)
        if r.label:
            by_sample.setdefault(r.category.rsplit("-", 1)[0], set()).add(r.split)
        sizes[r.label, r.split] = sizes.get((r.label, r.split), 0) + 1
    assert all(len(s) == 1 for s in [*by_vector.values(), *by_sample.values()])
    assert all(abs(sizes[0, s] / 300 - f) < 0.03 for s, f in splits.FRACTIONS.items())
    bad = spark.createDataFrame([(1, "A-B-abcdef01-1.raw", "same", 1), (2, "Benign", "same", 0)], "id int, category string, vector string, label int")
    with pytest.raises(Exception, match="two labels"):
        splits.memory_split(bad, ["id"], "category", "vector").collect()


def test_sample_falls_back_where_digests_are_not_even(spark):
    from argusframe.operators import splits

    rows = spark.range(4000).select((F.col("id") % 2).alias("s"), F.lit(7).alias("k"))
    assert splits.stratified_sample(rows, ["s"], ["k"], 1000, 10, "x").count() == 1000
