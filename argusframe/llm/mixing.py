"""Mixing sources to target weights: hash thresholds found in nested histograms.

Every row has a place, 60 bits of a digest of its id and text. Words are summed by source and by the upper bits
of the place; a source's budget falls into one bucket of its histogram, and only the rows of that bucket are
summed again by the next bits, until one place is left. Rows below it are taken and that row gives what is still
missing, so a source takes its target to the word. Nothing is sorted but histograms; what a filter keeps depends on
the rows alone, so reruns agree, and a smaller budget keeps a part of what a larger one keeps.

A hot source is summed by partial aggregates; its rows meet their threshold by a join that is broadcast only
if the table of sources was measured to be small, else split by the adaptive planner. The order of sources and the level
at which shares settle come of running totals over ranges, however many sources there are.

Nulls: null text has no words; a null source is a source, the last one; a null doc_id is a row like any other. Empty
texts take nothing. Rows that agree in doc_id and text share a place, and at the boundary each gives the same
part, rounded down. Very long texts: a row may be cut, so none overshoots its source's target. An empty table
gives no rows, and a table without words targets of 0. Extra columns of any name are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from argusframe.checkpoints import materialize, scratch
from argusframe.operators.ordering import running_totals
from argusframe.sizing import join_checked

WEIGHTS = (5, 2, 1)
#: Words of the mix for each word of the input.
SHARE = 1.5
#: Times that a source's words may be taken.
MOST_TIMES = 2
PLACE_BITS = 60
#: Bits that one level of histograms tells apart.
LEVEL_BITS = 12


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the text) and place, the digest that thresholds are compared with."""
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        F.conv(F.substring(F.md5(key), 1, PLACE_BITS // 4), 16, 10).cast("long").alias("place"),
    )


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most_times: int = MOST_TIMES) -> DataFrame:
    """source, source_size, target: shares by weight, none above ``most_times`` its source's size.

    By rising ratio of size to weight, a source is capped if its cap lies below the level that the sources from it
    on would settle at; the capped ones come first, so their sums give the final level.
    """
    numbered = running_totals(sources, [F.col("source").isNull(), F.col("source")], {"n": F.lit(1)}, "mix-sources")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("n") - 1) % len(weights) + 1).cast("int"))
    weighed = numbered.select("source", "source_size", weight.cast("long").alias("weight"))
    order = [F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source")]
    summed = materialize(running_totals(weighed, order, {"s": F.col("source_size"), "w": F.col("weight")}, "mix-ratios"), "mix-levels")
    size, heft = summed.agg(F.sum("source_size"), F.sum("weight")).first()
    before = (F.lit(share * (size or 0)) - most_times * (F.col("s") - F.col("source_size"))) / (F.lit(heft or 0) - F.col("w") + F.col("weight"))
    capped, capped_heft = summed.where(most_times * F.col("source_size") / F.col("weight") < before).agg(F.sum("source_size"), F.sum("weight")).first()
    free = (heft or 0) - (capped_heft or 0)
    level = (share * (size or 0) - most_times * (capped or 0)) / free if free else math.inf
    return summed.select("source", "source_size", F.least(F.lit(float(most_times)) * F.col("source_size"), F.col("weight") * F.lit(level)).alias("target"))


def with_source(rows: DataFrame, few: DataFrame, how: str, *more: tuple[str, str]) -> DataFrame:
    """Join with a materialised table of a row for each source at most; null is a source. more: columns that must be equal too."""
    named = few.withColumnRenamed("source", "_source")
    on = F.col("source").eqNullSafe(F.col("_source"))
    for mine, other in more:
        on = on & (F.col(mine) == F.col(other))
    return join_checked(rows, named, on, how).drop("_source")


def boundaries(rows: DataFrame, budgets: DataFrame, bits: int) -> DataFrame:
    """source, prefix, rest: the bucket of ``bits`` more bits of the place in which a source's budget ends, and the
    words of it that lie there. rows: source, size, place; budgets: source, budget, shift (bits below those seen so far)."""
    buckets = rows.groupBy("source", F.shiftright("place", bits).alias("prefix")).agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(W.partitionBy("source").orderBy("prefix"))  # a source has 2 ** LEVEL_BITS buckets at most
    held = with_source(buckets.withColumn("upto", upto), budgets, "inner").where(F.col("upto") > F.col("budget"))
    return held.groupBy("source").agg(F.min("prefix").alias("prefix"), F.min_by(F.col("budget") - F.col("upto") + F.col("words"), "prefix").alias("rest"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most_times: int = MOST_TIMES) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row: what the mix takes of it, repeats counted."""
    with scratch() as held:
        rows = materialize(sized(docs), "mix-rows")
        sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
        times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
        goals = materialize(targets(sources, weights, share, most_times).withColumn("times", times.cast("long")), "mix-targets")
        budget = F.floor(F.col("target") + 0.5) - F.col("times") * F.col("source_size")
        inside, left, bits = rows.select("source", "size", "place"), materialize(goals.select("source", budget.alias("budget")), "mix-budgets"), PLACE_BITS
        while True:
            bits = max(0, bits - LEVEL_BITS)
            edges = materialize(boundaries(inside, left, bits), "mix-edges")
            inside = materialize(with_source(inside.withColumn("_prefix", F.shiftright("place", bits)), edges, "inner", ("_prefix", "prefix")).select("source", "size", "place"), "mix-inside")
            left = edges.select("source", F.col("rest").alias("budget"))
            edge = inside.groupBy("source").agg(F.min("place").alias("edge"), F.max("place").alias("last"), F.sum("size").alias("words"))
            if not bits or edge.where("edge < last").isEmpty():
                break
        edges = materialize(with_source(edges.select("source", "rest"), materialize(edge.drop("last"), "mix-edge"), "inner"), "mix-edges")
        held.pass_on(rows, goals, edges)
    part = F.expr("CAST(CAST(size AS DECIMAL(19, 0)) * CAST(rest AS DECIMAL(19, 0)) div words AS LONG)")
    more = F.when(F.col("edge").isNull() | (F.col("place") < F.col("edge")), F.col("size")).when(F.col("place") == F.col("edge"), part).otherwise(0)
    joined = with_source(with_source(rows, goals, "inner"), edges, "left")
    return joined.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size") + more).cast("long").alias("taken"))
