"""Token sequences: traces, vocabularies, encoding, and what repeated sequences tell."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from argusframe.checkpoints import materialize, scratch
from argusframe.functions.columns import PAD, UNKNOWN, half_even
from argusframe.operators.ordering import running_totals

#: Vocabularies up to this size are ranked on one task; of larger ones so many tokens travel as a hash table.
MOST_TOKENS = 100_000
#: Marks a place whose token the table doesn't hold.
OPEN = -1


def traces(events: DataFrame, by: list[str], order: list[str], token: str, most: int | None = None) -> DataFrame:
    """One ordered list of tokens for each key, the first ``most`` if given, and n, its full length. With a
    limit only that many rows a key are gathered, however many it has."""
    if most is not None:
        first = W.partitionBy(*by).orderBy(*order)
        counts = events.groupBy(*by).agg(F.count("*").alias("n"))
        events = events.withColumn("_i", F.row_number().over(first)).where(F.col("_i") <= most).drop("_i")
        lists = events.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, token))).alias("_l"))
        return lists.join(counts, by).select(*by, F.col("_l")[token].alias("tokens"), "n")
    lists = events.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, token))).alias("_l"))
    return lists.select(*by, F.col("_l")[token].alias("tokens"), F.size("_l").alias("n"))


def vocabulary(tokens: DataFrame, token: str, least: int = 1, reserved: int = 2, n: str | None = None) -> DataFrame:
    """token, freq, token_id: dense ids by falling frequency, then by the token's bytes. Only distinct tokens are
    ranked: few in one window, many in ranges. ``n`` is a column that tells how often a row counts."""
    times = F.count("*") if n is None else F.sum(n)
    counted = tokens.where(F.col(token).isNotNull()).groupBy(F.col(token).alias("token")).agg(times.alias("freq")).where(F.col("freq") >= least)
    counted = materialize(counted, "vocabulary")
    if counted.count() <= MOST_TOKENS:
        return counted.withColumn("token_id", F.row_number().over(W.orderBy(F.desc("freq"), "token")) + (reserved - 1))
    ranked = running_totals(counted, [F.desc("freq"), F.col("token")], {"i": F.lit(1)}, "vocabulary-order")
    return ranked.select("token", "freq", (F.col("i") + (reserved - 1)).cast("int").alias("token_id"))


def encode(sequences: DataFrame, vocab: DataFrame, length: int, tokens: str = "tokens", heavy: int = MOST_TOKENS) -> DataFrame:
    """``sequences`` with ids: the fixed-length encoding, whatever the size of the vocabulary (token, token_id by falling
    frequency). The ``heavy`` most frequent tokens travel as a hash table and settle most places. Where tokens are left
    over, only those among the first ``length`` are looked up by a join and put back by position; sequences without any are done."""
    spark = sequences.sparkSession
    first = vocab.agg(F.min("token_id")).first()[0]
    known = {r.token: r.token_id for r in vocab.where(F.col("token_id") < (first or 0) + heavy).select("token", "token_id").collect()}
    shared = spark.sparkContext.broadcast(known)
    rest = vocab.where(F.col("token_id") >= (first or 0) + heavy).select("token", "token_id")
    is_whole = rest.isEmpty()
    missing = UNKNOWN if is_whole else OPEN

    @F.pandas_udf("array<int>")
    def ids(rows: pd.Series) -> pd.Series:
        get, blank = shared.value.get, [PAD] * length
        return pd.Series([None if r is None else ([get(t, missing) for t in r] + blank)[:length] for r in rows])

    looked = sequences.withColumn("ids", ids(F.slice(tokens, 1, length)))
    if is_whole:
        return looked
    with scratch() as held:
        rows = materialize(looked.withColumn("_row", F.monotonically_increasing_id()), "encoded")
        is_open = F.coalesce(F.array_contains("ids", OPEN), F.lit(False))
        held.pass_on(rows)
    places = rows.where(is_open).select("_row", F.posexplode(F.arrays_zip(F.slice(tokens, 1, length).alias("t"), F.slice("ids", 1, length).alias("i"))).alias("_at", "_p"))
    found = places.where(F.col("_p.i") == OPEN).select("_row", "_at", F.col("_p.t").alias("token")).join(rest, "token")
    told = found.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("_at", "token_id"))).alias("_ids"))  # at most length entries
    put = F.transform("ids", lambda x, k: F.when(x == OPEN, F.coalesce(F.element_at("_ids", k), F.lit(UNKNOWN))).otherwise(x).cast("int"))
    mended = rows.where(is_open).join(told, "_row", "left").withColumn("ids", put)
    return rows.where(~is_open).drop("_row").unionByName(mended.drop("_row", "_ids"))


def lookup_baseline(train: DataFrame, test: DataFrame, sequence: str = "seq") -> DataFrame:
    """``test`` with predicted: the rounded mean label of the equal sequence in train, 0 where there is none."""
    known = train.groupBy(sequence).agg(half_even(F.avg("label")).cast("int").alias("_p"))
    return test.join(known, sequence, "left").withColumn("predicted", F.coalesce("_p", F.lit(0))).drop("_p")


def ablate(tokens: Column, gone: list[str]) -> Column:
    return F.transform(tokens, lambda t: F.when(t.isin(gone), F.lit("<UNK>")).otherwise(t))


def jaccard(a: Column, b: Column) -> Column:
    """Token-set similarity of two lists; 0 for two empty ones."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1)).cast("double")


def early_stopping(log: DataFrame, patience: int = 15, gap: float = 0.05, run: int = 3) -> DataFrame:
    """An epoch log (epoch, train_auc, val_auc) with best (so far), since_best, gap_run (consecutive epochs
    whose gap is over the limit) and is_stop. One log is one ordered history."""
    w = W.orderBy("epoch")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    wide = (F.col("train_auc") - F.col("val_auc") > gap).cast("int")
    best = F.max("val_auc").over(upto)
    marked = log.select("*", best.alias("best"), wide.alias("is_wide")).select("*", F.lag("best").over(w).alias("_was"))
    marked = marked.select(
        "*", F.max(F.when(F.col("_was").isNull() | (F.col("best") > F.col("_was")), F.col("epoch"))).over(upto).alias("_best_at"),
        F.sum(1 - F.col("is_wide")).over(upto).alias("_island")
    )
    out = marked.select(
        "epoch", "best", (F.col("epoch") - F.col("_best_at")).alias("since_best"),
        F.sum("is_wide").over(W.partitionBy("_island").orderBy("epoch")).alias("gap_run")
    )
    return out.withColumn("is_stop", ((F.col("since_best") >= patience) | (F.col("gap_run") >= run)).cast("int"))
