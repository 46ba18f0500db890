"""Supplied tables in the roles that detection data have, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argusframe.functions.columns import SEPARATOR


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as scored rows with many ties: id, split, label_raw, label, score."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_linestatus").alias("split"),
        F.concat("l_returnflag", F.lit("-"), "l_linestatus").alias("label_raw"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        F.col("l_quantity").alias("score"),
    )


SCORED = """scored AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_linestatus AS split, l_returnflag || '-' || l_linestatus AS label_raw,
  CAST(l_returnflag = 'R' AS INT) AS label, l_quantity AS score FROM lineitem)"""

#: By distinct score, then cumulative from the top, with the totals.
CURVE = (
    SCORED
    + """, g AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label <> 1) AS neg FROM scored GROUP BY score),
 curve AS (SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,
  sum(pos) OVER () AS p, sum(neg) OVER () AS n, row_number() OVER (ORDER BY score DESC) AS i,
  lead(pos) OVER (ORDER BY score DESC) AS next_pos, lead(neg) OVER (ORDER BY score DESC) AS next_neg FROM g),
 points AS (SELECT * FROM curve WHERE i = 1 OR next_pos IS NULL OR pos <> next_pos OR neg <> next_neg)"""
)


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as flows: a low-cardinality vector, so there are duplicate and contradictory groups."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_linestatus").alias("day"),
        F.col("l_returnflag").alias("label_raw"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        F.concat_ws(
            "|", F.col("l_quantity").cast("long"), F.round(F.col("l_discount") * 100).cast("long"), F.round(F.col("l_tax") * 100).cast("long"),
            F.col("l_partkey") % 5
        ).alias("vec"),
    )


FLOWS = """flows AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_linestatus AS day, l_returnflag AS label_raw, CAST(l_returnflag = 'R' AS INT) AS label,
  concat_ws('|', CAST(l_quantity AS BIGINT), CAST(round(l_discount * 100) AS BIGINT), CAST(round(l_tax * 100) AS BIGINT), l_partkey % 5) AS vec FROM lineitem)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as samples: sample_id, family (source), label (quality 0 or toxic 1), digest of the text."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select(
        "doc_id", "lang", F.col("source").alias("family"), F.col("toxic").cast("int").alias("label"), F.sha2("text", 256).alias("digest")
    )


SAMPLES = """samples AS (SELECT doc_id, lang, source AS family, CAST(toxic AS INT) AS label, sha256(text) AS digest FROM documents JOIN labels USING (doc_id))"""


def user_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as API traces: user_id and day, the tokens in order."""
    from argusframe.operators.sequences import traces

    events = table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return traces(events, ["user_id", "day"], ["ts", "event_id"], "event_type")


TRACES = f"""traces AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, list(event_type ORDER BY ts, event_id) AS tokens, count(*) AS n,
  string_agg(event_type, chr({ord(SEPARATOR)}) ORDER BY ts, event_id) AS seq FROM events GROUP BY ALL)"""


def dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as traces of roles: conv_id, tokens, n, seq (joined), label (odd number of turns), split."""
    from argusframe.operators.sequences import traces

    rows = traces(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "role")
    return rows.select(
        "conv_id", "tokens", "n", F.array_join("tokens", SEPARATOR).alias("seq"), (F.col("n") % 2).cast("int").alias("label"),
        F.when(F.col("conv_id") % 4 == 0, "test").otherwise("train").alias("split")
    )


DIALOGUES = f"""dialogues AS (SELECT conv_id, list(role ORDER BY turn) AS tokens, count(*) AS n, string_agg(role, chr({ord(SEPARATOR)}) ORDER BY turn) AS seq,
  CAST(count(*) % 2 AS INT) AS label, CASE WHEN conv_id % 4 = 0 THEN 'test' ELSE 'train' END AS split FROM conversations GROUP BY conv_id)"""
