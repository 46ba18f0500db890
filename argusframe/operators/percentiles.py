"""Exact percentiles of many groups and ranks at once, by selection instead of gathering a group's values.

Distinct values are counted, dealt into ranges and summed by range; that tells in which range each wanted rank lies. Only
those ranges are ordered, by a sort that may spill; nothing holds the values of a group, however many there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from argusframe.checkpoints import materialize, scratch
from argusframe.sizing import BROADCAST_BYTES, bytes_of


def same(keys: list[str], names: list[str]) -> Column:
    """Equality of key columns, where null is a value."""
    on = F.lit(True)
    for key, name in zip(keys, names, strict=True):
        on = on & F.col(key).eqNullSafe(F.col(name))
    return on


def percentiles(rows: DataFrame, by: list[str], value: Column, wanted: dict[str, float]) -> DataFrame:
    """``by`` and a column of each wanted share: its percentile of the values that aren't null, between the two values
    around its rank in proportion. A group without values has nulls. A null key is a key."""
    keys = [f"_k{i}" for i in range(len(by))]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    with scratch() as held:
        counted = rows.groupBy(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], value.cast("double").alias("_v")).agg(F.count("*").alias("_n"))
        dealt = materialize(counted.repartitionByRange(n, *keys, F.col("_v")).withColumn("_range", F.spark_partition_id()), "value-counts")
        valued = dealt.where("_v IS NOT NULL")
        group = W.partitionBy(*keys)
        totals = valued.groupBy(*keys, "_range").agg(F.sum("_n").alias("_total"))  # a group has a row a range at most
        based = totals.withColumn("_upto", F.sum("_total").over(group.orderBy("_range"))).withColumn("_all", F.sum("_total").over(group))
        ranks = []
        for i, share in enumerate(wanted.values()):
            at = F.lit(float(share)) * (F.col("_all") - 1)
            for near, weight in ((F.floor(at), F.when(F.floor(at) == at, 1.0).otherwise(F.ceil(at) - at)), (F.ceil(at), F.when(F.floor(at) == at, 0.0).otherwise(at - F.floor(at)))):
                ranks.append(F.struct(F.lit(i).alias("_i"), near.alias("_rank"), weight.cast("double").alias("_weight")))
        asked = based.select(*keys, "_range", "_upto", "_total", F.inline(F.array(*ranks)))
        base = F.col("_upto") - F.col("_total")
        asked = materialize(asked.where((F.col("_rank") >= base) & (F.col("_rank") < F.col("_upto"))).select(*keys, "_range", "_i", (F.col("_rank") - base).alias("_rank"), "_weight"), "wanted-ranks")
        held.pass_on(dealt, asked)
    named = [f"_a{i}" for i in range(len(by))]
    renamed = [F.col(k).alias(a) for k, a in zip(keys, named, strict=True)]
    small = F.broadcast if bytes_of(asked) <= BROADCAST_BYTES else lambda df: df
    few = asked.select(*renamed, F.col("_range").alias("_at"), "_i", "_rank", "_weight")
    there = same(keys, named) & (F.col("_range") == F.col("_at"))
    inside = valued.join(small(few.select(*named, "_at").distinct()), there, "left_semi")
    ordered = inside.withColumn("_end", F.sum("_n").over(W.partitionBy(*keys, "_range").orderBy("_v")))
    hit = (F.col("_rank") >= F.col("_end") - F.col("_n")) & (F.col("_rank") < F.col("_end"))
    found = ordered.join(small(few), there & hit)
    part = lambda i: F.when(F.col("_i") == i, F.when(F.col("_weight") > 0, F.col("_weight") * F.col("_v")).otherwise(0.0))
    sums = found.select(*keys, *[part(i).alias(f"_p{i}") for i in range(len(wanted))]).unionByName(dealt.select(*keys).distinct(), allowMissingColumns=True)
    return sums.groupBy(*[F.col(k).alias(b) for k, b in zip(keys, by, strict=True)]).agg(*[F.sum(f"_p{i}").alias(name) for i, name in enumerate(wanted)])


def with_percentiles(rows: DataFrame, by: list[str], value: Column, wanted: dict[str, float], aggregates: list[Column]) -> DataFrame:
    """``by``, other aggregates of each group, and its percentiles."""
    found = percentiles(rows, by, value, wanted)
    names = [f"_b{i}" for i in range(len(by))]
    other = found.select(*[F.col(b).alias(n) for b, n in zip(by, names, strict=True)], *wanted)
    summed = rows.groupBy(*by).agg(*aggregates)
    return summed.join(other, same(by, names), "left").drop(*names)
