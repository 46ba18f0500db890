"""Leakage-free splits: whole groups go to one side, in a reproducible order, by running size."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from argusframe.checkpoints import materialize, scratch
from argusframe.components import connected_components
from argusframe.functions.columns import family_of, half_even, strip_dump_suffix
from argusframe.operators.dedup import by_sample, group_sizes, majority
from argusframe.operators.ordering import running_totals, seeded
from argusframe.sizing import BROADCAST_BYTES, bytes_of, join_checked

FRACTIONS = {"val": 0.1, "test": 0.1, "cal": 0.2}


def _all_of(conditions: list[Column]) -> Column:
    return reduce(operator.and_, conditions, F.lit(True))


def in_seeded_order(rows: DataFrame, bucket: list[str], key: list[str], size: Column, seed: str) -> DataFrame:
    """``rows`` with _before and _total: sizes of the earlier rows of its bucket in seeded order, and of all.
    The order is one over (bucket, digest, key), so a bucket with most rows is summed by many tasks."""
    hashed = rows.withColumn("_h", seeded(F.concat_ws("|", *key), seed)).withColumn("_size", size)
    order = [F.col(c) for c in (*bucket, "_h", *key)]
    run = materialize(running_totals(hashed, order, {"_upto": F.col("_size")}, "split-order"), "split-sums")
    ends = run.groupBy(*bucket).agg(F.min(F.col("_upto") - F.col("_size")).alias("_base"), F.sum("_size").alias("_total"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in bucket]
    joined = join_checked(run.alias("l"), materialize(ends, "split-ends").alias("r"), _all_of(same))
    return joined.select(*[F.col(f"l.{c}") for c in hashed.columns], (F.col("_upto") - F.col("_size") - F.col("_base")).alias("_before"), "_total")


def allocate(groups: DataFrame, bucket: list[str], key: list[str], size: str, seed: str, fractions: dict[str, float] = FRACTIONS) -> DataFrame:
    """``groups`` with split: per bucket, in seeded order, groups fill val up to its share of rows, then test,
    then cal; the rest is train. A group that crosses a share's end still goes there whole."""
    run = in_seeded_order(groups, bucket, key, F.col(size), seed)
    share = lambda name: half_even(F.col("_total") * F.lit(fractions[name]))
    edge = lambda ok: F.coalesce(F.max(F.when(ok, F.col("_before") + F.col("_size"))), F.lit(0))
    run = materialize(run.select(*groups.columns, "_before", "_size", "_total"), "allocate")
    same = lambda a, b: _all_of([F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in bucket])
    vals = run.groupBy(*bucket).agg(edge(F.col("_before") < share("val")).alias("_vend"))
    run = join_checked(run.alias("l"), materialize(vals, "val-ends").alias("v"), same("l", "v")).select("l.*", "_vend")
    left = F.col("_before") - F.col("_vend")
    tests = run.groupBy(*bucket).agg(F.max("_vend").alias("_v"), edge((left >= 0) & (left < share("test"))).alias("_tend"))
    tests = tests.withColumn("_tend", F.greatest("_tend", "_v")).drop("_v")
    run = join_checked(run.alias("l"), materialize(tests, "test-ends").alias("t"), same("l", "t")).select("l.*", "_tend")
    split = F.when(F.col("_before") < F.col("_vend"), "val").when(F.col("_before") < F.col("_tend"), "test").when(
        F.col("_before") - F.col("_tend") < share("cal"), "cal"
    ).otherwise("train")
    return run.select(*groups.columns, split.alias("split"))


def carve(rows: DataFrame, bucket: list[str], key: list[str], fraction: float, seed: str) -> DataFrame:
    """``rows`` with split val or train: the first round(n * fraction) of each bucket in seeded order."""
    run = in_seeded_order(rows, bucket, key, F.lit(1), seed)
    return run.select(*rows.columns, F.when(F.col("_before") < half_even(F.col("_total") * F.lit(fraction)), "val").otherwise("train").alias("split"))


def permute(rows: DataFrame, key: list[str], val: float, cal: float, seed: str) -> DataFrame:
    """``rows`` with split by one permutation: the first floor(n * val) val, then floor(n * cal) cal, then train."""
    run = in_seeded_order(rows, [], key, F.lit(1), seed)
    n_val, n_cal = F.floor(F.col("_total") * F.lit(val)), F.floor(F.col("_total") * F.lit(cal))
    return run.select(*rows.columns, F.when(F.col("_before") < n_val, "val").when(F.col("_before") < n_val + n_cal, "cal").otherwise("train").alias("split"))


def leaks(rows: DataFrame, key: Column, over: str = "split") -> DataFrame:
    """Keys that stand in more than one split; empty if nothing leaks."""
    return rows.groupBy(key.alias("leak_key")).agg(F.min(over).alias("a"), F.max(over).alias("b"), F.count("*").alias("n_rows")).where("a <> b")


def report(rows: DataFrame, fractions: dict[str, float], times: Column | None = None) -> DataFrame:
    """Per split: rows, share, target and difference in percentage points. ``times``: how many rows each row stands for."""
    times = F.lit(1) if times is None else times
    target = F.coalesce(F.create_map(*[F.lit(x) for k, v in fractions.items() for x in (k, float(v))])[F.col("split")], F.lit(1.0 - sum(fractions.values())))
    sizes = rows.groupBy("split").agg(F.sum(times).alias("n"), F.sum(F.when(F.col("label") == 1, times).otherwise(0)).alias("n_malicious"))
    total = sizes.agg(F.sum("n").alias("_total"))
    share = F.col("n") / F.col("_total")
    return sizes.join(F.broadcast(total)).select("split", "n", "n_malicious", share.alias("share"), target.alias("target"), ((share - target) * 100).alias("delta_pp"))  # one row


def plan_of(counts: DataFrame, strata: list[str], target: int, protect: int) -> DataFrame:
    """From n of each stratum: n and plan."""
    small = F.col("n") <= protect
    sums = counts.agg(
        F.coalesce(F.sum(F.when(small, F.col("n"))), F.lit(0)).alias("_kept"), F.coalesce(F.sum(F.when(~small, F.col("n"))), F.lit(0)).alias("_pool")
    )
    rate = F.least(F.greatest((F.lit(target) - F.col("_kept")) / F.nullif(F.col("_pool"), F.lit(0)), F.lit(0.0)), F.lit(1.0))
    return counts.join(F.broadcast(sums)).select(*strata, "n", F.when(small, F.col("n")).otherwise(half_even(F.col("n") * rate)).cast("long").alias("plan"))  # one row


def sampling_plan(rows: DataFrame, strata: list[str], target: int, protect: int) -> DataFrame:
    """Per stratum: n and plan. Strata of at most ``protect`` rows stay whole; the others give the same share."""
    return plan_of(rows.groupBy(*strata).agg(F.count("*").alias("n")), strata, target, protect)


#: Hexadecimal digits of the digest by which rows are counted; only rows of one such slot in a stratum are ranked.
SLOT_DIGITS = 3


def stratified_sample(rows: DataFrame, strata: list[str], key: list[str], target: int, protect: int, seed: str) -> DataFrame:
    """The planned number of rows of each stratum, first in seeded order. One pass counts rows by stratum and the first
    digits of the digest; its sums give the plan and the slot in which it ends. Rows of earlier slots stay, later ones
    go, and only that slot is ordered."""
    hashed = rows.withColumn("_h", seeded(F.concat_ws("|", *key), seed))
    slot = F.substring("_h", 1, SLOT_DIGITS)
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in strata]
    with scratch() as held:
        slots = materialize(hashed.groupBy(*strata, slot.alias("_slot")).agg(F.count("*").alias("_c")), "sample-slots")
        plan = plan_of(slots.groupBy(*strata).agg(F.sum("_c").alias("n")), strata, target, protect)
        upto = slots.withColumn("_upto", F.sum("_c").over(W.partitionBy(*strata).orderBy("_slot")))  # 4,096 rows a stratum at most
        over = upto.alias("l").join(plan.alias("r"), same("l", "r")).where(F.col("_upto") > F.col("plan"))
        cut = over.groupBy(*[F.col(f"l.{c}").alias(c) for c in strata]).agg(F.min("_slot").alias("_cut"), F.min_by(F.col("plan") - F.col("_upto") + F.col("_c"), "_slot").alias("_take"))
        cuts = materialize(cut, "sample-cuts")
        held.pass_on(cuts)
    few = F.broadcast(cuts) if bytes_of(cuts) <= BROADCAST_BYTES else cuts
    marked = hashed.alias("l").join(few.alias("r"), same("l", "r"), "left").select(*[F.col(f"l.{c}") for c in hashed.columns], "_cut", "_take")
    sure = marked.where(F.col("_cut").isNull() | (slot < F.col("_cut"))).select(*rows.columns)
    sliver = marked.where(slot == F.col("_cut"))
    ranked = sliver.withColumn("_i", F.row_number().over(W.partitionBy(*strata).orderBy("_h", *key)))
    return sure.unionByName(ranked.where(F.col("_i") <= F.col("_take")).select(*rows.columns))


def memory_split(
    rows: DataFrame, key: list[str], category: str, vector: str, label: str = "label", seed: str = "42", fractions: dict[str, float] = FRACTIONS
) -> DataFrame:
    """``rows`` with split: four ways, by groups that never leak. Dumps of one sample are a group where a label's
    samples have several dumps, else each row is one; groups that share a feature vector are merged; a merged group
    goes whole to the bucket of its most frequent family. A group of two labels is an error."""
    named = rows.select(
        *key, label, F.col(vector).alias("_vector"), family_of(F.col(category)).alias("_family"), strip_dump_suffix(F.col(category)).alias("_sample")
    )
    decided = by_sample(group_sizes(named, F.col("_sample"), label)).select(label, "is_grouped_by_sample")
    own = F.when(F.col("is_grouped_by_sample") == 1, F.concat_ws("|", F.lit("s"), F.col(label), "_sample")).otherwise(F.concat_ws("|", F.lit("r"), *key))
    named = materialize(named.join(F.broadcast(decided), label).withColumn("_group", own), "memory-groups")  # a row a label
    links = named.select(F.col("_group").alias("a"), F.concat(F.lit("v|"), F.sha2(F.col("_vector").cast("string"), 256)).alias("b"))
    parts = connected_components(links)
    merged = materialize(named.join(parts, F.col("_group") == F.col("node")).drop("node"), "memory-merged")
    sizes = merged.groupBy("component").agg(F.count("*").alias("_n"), F.min(label).alias(label), F.max(label).alias("_other"))
    checked = F.when(F.col(label) == F.col("_other"), F.col(label)).otherwise(F.raise_error(F.concat(F.lit("a group of two labels: "), "component")))
    buckets = sizes.withColumn(label, checked).drop("_other").join(majority(merged, ["component"], ["_family"]), "component")
    split = allocate(buckets, ["_family", label], ["component"], "_n", seed, fractions).select("component", "split")
    return rows.join(merged.select(*key, "component").join(split, "component").select(*key, "split"), key)
