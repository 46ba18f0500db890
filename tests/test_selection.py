"""Percentiles by selection, matches of token sets, and encoding by large vocabularies, beside brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from argusframe.operators import percentiles, sequences, setjoin


def test_percentiles_equal_those_of_gathered_values(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, 0.0, -1.5, rng.random() * 100, float(rng.randint(0, 5))])) for _ in range(3000)] + [("one", 7.0), ("none", None)]
    wanted = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = {r.k: r for r in percentiles.percentiles(spark.createDataFrame(rows, "k string, v double"), ["k"], F.col("v"), wanted).collect()}
    assert set(got) == {k for k, _ in rows}
    for key in got:
        values = [v for k, v in rows if k == key and v is not None]
        for name, share in wanted.items():
            assert got[key][name] is None if not values else abs(got[key][name] - np.quantile(values, share)) < 1e-9


def test_percentiles_of_an_empty_table_and_a_hot_group(spark):
    assert percentiles.percentiles(spark.createDataFrame([], "k int, v double"), ["k"], F.col("v"), {"p": 0.5}).count() == 0
    rows = spark.range(200_000).select((F.col("id") % 100 == 0).cast("int").alias("k"), F.col("id").alias("v"))
    found = {r.k: r.p for r in percentiles.percentiles(rows, ["k"], F.col("v"), {"p": 0.5}).collect()}
    assert found == {0: 100_000.0, 1: 99_950.0}


def test_percentiles_gather_nothing(spark):
    rows = spark.range(1000).select(F.col("id").alias("v"), F.lit(1).alias("k"))
    plan = percentiles.with_percentiles(rows, ["k"], F.col("v"), {"p": 0.5}, [F.count("*").alias("n")])._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan.lower().replace("percentiles", "") and "collect_list" not in plan


def random_sets(rng, n, tokens, always=None):
    return [sorted({rng.choice(tokens) for _ in range(rng.randint(1, 9))} | ({always} if always else set())) for _ in range(n)]


def brute(left, right):
    best = {}
    for a in map(set, left):
        found = max((len(a & b) / len(a | b) for b in map(set, right)), default=0)
        if found:
            best[tuple(sorted(a))] = found
    return best


def matches(spark, left, right):
    a, b = (spark.createDataFrame([(s,) for s in side], f"{name} array<string>") for side, name in ((left, "a"), (right, "b")))
    return {tuple(r.a): r.best for r in setjoin.best_matches(a, b).collect()}


def test_best_matches_equal_brute_force(spark):
    rng = random.Random(2)
    tokens = [f"t{int(rng.paretovariate(0.7)) % 60}" for _ in range(300)]
    left, right = random_sets(rng, 150, tokens), random_sets(rng, 200, tokens)
    left += [["alone"], [], ["t1"], ["t1", "t1"]]
    got, want = matches(spark, left, right), brute(left, right)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_a_token_in_all_sets_makes_no_pairs(spark):
    rng = random.Random(3)
    counts = []
    for n in (200, 400, 800):
        sides = []
        for side, name in enumerate("ab"):
            rows = [([f"{side}-{i}-{j}" for j in range(rng.randint(3, 8))] + ["all"],) for i in range(n)]
            sides.append(spark.createDataFrame(rows, f"{name} array<string>"))
        tokens = sides[1].select(F.explode("b").alias("_t")).groupBy("_t").agg(F.count("*").alias("_df"))
        a, b = setjoin.by_rarity(sides[0], "a", tokens), setjoin.by_rarity(sides[1], "b", tokens)
        counts.append(sum(setjoin.candidates(a, b, t).count() for t in (*setjoin.THRESHOLDS, 0.0)))
        if n == 200:
            left, right = ([r[0] for r in s.collect()] for s in sides)
            got, want = matches(spark, left, right), brute(left, right)
            assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert counts == [0, 0, 0]


def test_encoding_by_a_large_vocabulary(spark):
    vocab = spark.range(1_000_000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("token"), (F.col("id") + 2).cast("int").alias("token_id"))
    rows = spark.createDataFrame([(1, ["w0", "w999999", "never", "w150000", "w7"]), (2, ["w1"]), (3, []), (4, None), (5, [None, "w500000"] + ["w2"] * 9), (2, ["w1"]), (6, ["never"] * 3)], "k long, tokens array<string>")
    got = sorted((r.k, r.ids) for r in sequences.encode(rows, vocab, 5).collect())
    want = [(1, [2, 1_000_001, 1, 150_002, 9]), (2, [3, 0, 0, 0, 0]), (2, [3, 0, 0, 0, 0]), (3, [0] * 5), (4, None), (5, [1, 500_002, 4, 4, 4]), (6, [1, 1, 1, 0, 0])]
    assert got == want
    small = vocab.where("token_id < 5000")
    cut = spark.createDataFrame([(i, [f"w{(i * 7 + j * 13) % 6000}" for j in range(8)]) for i in range(200)], "k long, tokens array<string>")
    both = [sorted((r.k, r.ids) for r in sequences.encode(cut, small, 6, heavy=h).collect()) for h in (100, 10_000)]
    assert both[0] == both[1]
