"""Running totals over a total order, without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from argusframe.checkpoints import materialize


def running_totals(rows: DataFrame, order: list[Column], sums: dict[str, Column], label: str = "ordered") -> DataFrame:
    """``rows`` with inclusive running sums by ``order`` (a total order). Rows are dealt into ranges, summed in
    each range, and moved up by the total of the ranges before, of which there are as many as partitions."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), label)
    totals = dealt.groupBy("_range").agg(*[F.sum(e).alias(f"_t_{k}") for k, e in sums.items()])
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select("_range", *[F.coalesce(F.sum(f"_t_{k}").over(earlier), F.lit(0)).alias(f"_b_{k}") for k in sums])
    inside = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = dealt.join(F.broadcast(bases), "_range")  # one row a partition
    return out.select(*rows.columns, *[(F.sum(e).over(inside) + F.col(f"_b_{k}")).alias(k) for k, e in sums.items()])


def seeded(key: Column, seed: str) -> Column:
    """A reproducible order: the digest of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))
