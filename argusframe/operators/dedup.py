"""Duplicates by key: which row stands for its group, what groups look like, and which contradict themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from argusframe.checkpoints import materialize, scratch
from argusframe.operators.percentiles import with_percentiles


def keep_first(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``. A minimum over whole rows: partial in every task, so a key
    with very many rows is reduced before it is shuffled."""
    rest = [c for c in rows.columns if c not in key and c not in order]
    first = rows.groupBy(*key).agg(F.min(F.struct(*order, *rest)).alias("_first"))
    return first.select(*[F.col(c) if c in key else F.col(f"_first.{c}") for c in rows.columns])


def representative(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``keep_first`` with duplicate_count, the size of the group it stands for."""
    rest = [c for c in rows.columns if c not in key and c not in order]
    first = rows.groupBy(*key).agg(F.min(F.struct(*order, *rest)).alias("_first"), F.count("*").alias("duplicate_count"))
    return first.select(*[F.col(c) if c in key else F.col(f"_first.{c}") for c in rows.columns], "duplicate_count")


def groups(rows: DataFrame, key: list[str], label: str = "label", split: str | None = None) -> DataFrame:
    """One row a key: size, and whether labels (and splits) differ in it."""
    extra = [(F.min(split) != F.max(split)).alias("is_cross_split")] if split else []
    return rows.groupBy(*key).agg(F.count("*").alias("size"), (F.min(label) != F.max(label)).alias("is_ambiguous"), *extra)


def duplicate_profile(rows: DataFrame, key: list[str], label: str = "label") -> DataFrame:
    """One row: rows, groups, rows in groups of several, such groups, their least and largest size, ambiguous ones."""
    several = F.col("size") > 1
    return groups(rows, key, label).agg(
        F.sum("size").alias("n_rows"), F.count("*").alias("n_groups"), F.coalesce(
            F.sum(F.when(several, F.col("size"))), F.lit(0)
        ).alias("n_duplicate_rows"), F.count_if(several).alias("n_duplicate_groups"),
        F.min(
            F.when(several, F.col("size"))
        ).alias("min_size"), F.max(F.when(several, F.col("size"))).alias("max_size"), F.count_if("is_ambiguous").alias("n_ambiguous"),
    )


def split_ambiguous(rows: DataFrame, key: list[str], label: str = "label") -> tuple[DataFrame, DataFrame]:
    """(clean, excluded): rows of keys with one label, and of keys with several. Both stay available."""
    bad = groups(rows, key, label).where("is_ambiguous").select(*key)
    return rows.join(bad, key, "left_anti"), rows.join(bad, key, "left_semi")


def key_validation(rows: DataFrame, given: Column, computed: Column) -> DataFrame:
    """One row: how many given keys cover several computed ones (false merges), and the other way (false splits)."""
    pairs = rows.select(given.alias("g"), computed.alias("c")).distinct()
    merges = pairs.groupBy("g").agg(F.count("*").alias("n")).agg(F.count("*").alias("n_given"), F.count_if(F.col("n") > 1).alias("n_false_merges"))
    splits = pairs.groupBy("c").agg(F.count("*").alias("n")).agg(F.count("*").alias("n_computed"), F.count_if(F.col("n") > 1).alias("n_false_splits"))
    return merges.join(F.broadcast(splits))  # one row each


def group_sizes(rows: DataFrame, group: Column, label: str = "label") -> DataFrame:
    """Per label: rows, groups, and least, mean, median and largest group size."""
    with scratch() as held:
        sizes = materialize(rows.groupBy(label, group.alias("_g")).agg(F.count("*").alias("size")).drop("_g"), "group-sizes")
        held.pass_on(sizes)
    told = [F.sum("size").alias("n_rows"), F.count("*").alias("n_groups"), F.min("size").alias("min_size"), F.avg("size").alias("mean_size"), F.max("size").alias("max_size")]
    return with_percentiles(sizes, [label], F.col("size"), {"median_size": 0.5}, told)


def by_sample(sizes: DataFrame) -> DataFrame:
    """From ``group_sizes``: whether a label is grouped by sample id (larger groups, several ids) or by row."""
    return sizes.select("*", ((F.col("median_size") > 1) & (F.col("n_groups") > 1)).cast("int").alias("is_grouped_by_sample"))


def majority(rows: DataFrame, group: list[str], value: list[str], times: Column | None = None) -> DataFrame:
    """The most frequent ``value`` of each group; of equals the smallest. ``times``: how many rows each row stands for."""
    counted = rows.groupBy(*group, *value).agg(F.sum(F.lit(1) if times is None else times).alias("_n"))
    best = counted.groupBy(*group).agg(F.min(F.struct((-F.col("_n")).alias("_n"), *value)).alias("_m"))
    return best.select(*group, *[F.col(f"_m.{v}") for v in value])


def head_share(rows: DataFrame, key: list[str], heads: list[int]) -> DataFrame:
    """One row: number of groups and the share of rows in the k largest, for each k. Only the largest
    k groups are ordered."""
    sizes = rows.groupBy(*key).agg(F.count("*").alias("size"))
    totals = sizes.agg(F.sum("size").alias("n_rows"), F.count("*").alias("n_groups"))
    top = sizes.orderBy(F.desc("size"), *key).limit(max(heads)).select("size", *key)
    ranked = top.withColumn("_r", F.row_number().over(W.orderBy(F.desc("size"), *key)))
    share = ranked.agg(*[F.sum(F.when(F.col("_r") <= k, F.col("size"))).alias(f"_h{k}") for k in heads])
    return totals.join(F.broadcast(share)).select("n_rows", "n_groups", *[(F.col(f"_h{k}") / F.col("n_rows")).alias(f"top{k}_share") for k in heads])
