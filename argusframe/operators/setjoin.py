"""The best match of each token set among other sets by Jaccard similarity, exactly and without comparing all pairs.

Tokens are ordered by rarity. Two sets of similarity t share one of the first n - ceil(t n) + 1 tokens of each, and
their sizes differ by a factor of 1 / t at most: a round at threshold t meets only such pairs, and a set whose best one
reaches t is settled, as no other can be better. The rest go on to lower thresholds. What a pair of one common token can
reach is known before, from the smallest set that holds each token; only pairs of two common tokens can beat it, so
the most frequent token of a set never finds candidates, be it in all sets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argusframe.checkpoints import materialize, scratch

THRESHOLDS = (0.8, 0.5, 0.2)


def by_rarity(sets: DataFrame, column: str, counts: DataFrame) -> DataFrame:
    """_set, _n, _tokens (rarest first) of the distinct sets of a column; empty and null ones match nothing and go."""
    distinct = sets.select(F.array_sort(F.array_distinct(F.array_compact(column))).alias("_set")).where("size(_set) > 0").distinct()
    each = distinct.select("_set", F.explode("_set").alias("_t")).join(counts, "_t", "left")
    order = F.struct(F.coalesce("_df", F.lit(0)).alias("df"), F.col("_t").alias("t"))
    return each.groupBy("_set").agg(F.array_sort(F.collect_list(order))["t"].alias("_tokens")).withColumn("_n", F.size("_tokens"))


def prefixes(sets: DataFrame, length: Column, side: str) -> DataFrame:
    """A row for each of the first ``length`` tokens of a set, with columns named for a side."""
    return sets.select(*[F.col(c).alias(f"{c}{side}") for c in ("_set", "_n")], F.explode(F.slice("_tokens", 1, F.greatest(length, F.lit(0)))).alias("_t"))


def candidates(left: DataFrame, right: DataFrame, t: float) -> DataFrame:
    """Pairs that may reach similarity ``t`` by two common tokens or more."""
    length = F.least(F.col("_n") - F.ceil(F.lit(float(t)) * F.col("_n") - 1e-9) + 1, F.col("_n") - 1).cast("int")
    pairs = prefixes(left, length, "a").join(prefixes(right, length, "b"), "_t")
    near = (F.col("_nb") >= t * F.col("_na") - 1e-9) & (F.col("_na") >= t * F.col("_nb") - 1e-9)
    return pairs.where(near).select("_seta", "_na", "_setb", "_nb")


def scored(pairs: DataFrame) -> DataFrame:
    """The best similarity of each left set among candidate pairs."""
    common = F.size(F.array_intersect("_seta", "_setb"))
    return pairs.groupBy(F.col("_seta").alias("_set")).agg(F.max(common / (F.col("_na") + F.col("_nb") - common)).alias("_best"))


def best_matches(left: DataFrame, right: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(``a`` sorted, best): the similarity of each distinct set of ``left`` to the nearest of ``right``; only sets that share a token have one."""
    with scratch() as held:
        tokens = right.select(F.explode(F.array_distinct(F.array_compact(b))).alias("_t"))
        counts = materialize(tokens.groupBy("_t").agg(F.count("*").alias("_df")), "token-counts")
        asked, known = materialize(by_rarity(left, a, counts), "asked-sets"), materialize(by_rarity(right, b, counts), "known-sets")
        smallest = known.select("_n", F.explode("_tokens").alias("_t")).groupBy("_t").agg(F.min("_n").alias("_least"))
        single = asked.select("_set", "_n", F.explode("_tokens").alias("_t")).join(smallest, "_t").groupBy("_set").agg(F.max(1 / (F.col("_n") + F.col("_least") - 1)).alias("_single"))
        asked = materialize(asked.join(single, "_set"), "asked-sets")  # what shares no token has no match
        settled = []
        for t in (*THRESHOLDS, 0.0):
            found = asked.join(scored(candidates(asked, known, t)), "_set", "left")
            best = materialize(found.withColumn("_best", F.greatest("_best", "_single")), "matches")
            settled.append(best.where(F.col("_best") >= t - 1e-12).select("_set", "_best"))
            asked = best.where(F.col("_best") < t - 1e-12).drop("_best")
        out = reduce(DataFrame.unionByName, settled)
        out = materialize(out.select(F.col("_set").alias(a), F.col("_best").alias("best")), "best-matches")
        held.pass_on(out)
    return out
