"""Trained models and parsed files: rows without SQL, tested by invariants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argusframe import models
from argusframe.checkpoints import materialize
from argusframe.operators import metrics, sequences, splits
from argusframe.plans.tables import table
from argusframe.sources import pe
from argusframe.streaming import scoring

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "days"]


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items split by order: the days since the first shipment say something about the return flag."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("double").alias("days"),
        (F.col("l_returnflag") == "R").cast("int").alias("label")
    )
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.lit("all").alias("bucket"), F.lit(1).alias("size"))
    return rows.join(splits.allocate(orders, ["bucket"], ["l_orderkey"], "size", "42").select("l_orderkey", "split"), "l_orderkey")


def scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(labelled(spark, sf_dir), "labelled")
    detector = models.train(rows, FEATURES, rounds=8, depth=3)
    return detector.score(rows).select("l_orderkey", "l_linenumber", "split", "label", "margin", "score")


def m01_calibrated_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_rows(spark, sf_dir)


def m02_model_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds chosen on cal, applied once to test."""
    rows = materialize(scored_rows(spark, sf_dir), "scored")
    chosen = metrics.thresholds_for_fpr(rows.where("split = 'cal'"), [0.01, 0.05, 0.1]).select("target", "threshold")
    hit = F.col("score") >= F.coalesce("threshold", F.lit(float("inf")))
    test = rows.where("split = 'test'").join(F.broadcast(chosen))  # a row a target
    return test.groupBy("target", "threshold").agg(
        F.count("*").alias("n"), F.count_if(hit & (F.col("label") == 0)).alias("fp"), F.count_if(hit & (F.col("label") == 1)).alias("tp")
    )


def m03_pe_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature vector of every document's bytes: none is an executable, so only byte-level groups are set."""
    files = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "utf-8").alias("content"))
    out = pe.pe_features(files, "doc_id")
    return out.select(
        "doc_id", "is_pe", F.size("features").alias("n_features"),
        F.round(F.aggregate(F.slice("features", 8, 256), F.lit(0.0), lambda a, x: a + x), 3).alias("histogram_sum"),
        F.array_join("degraded", ",").alias("degraded")
    )


def m04_session_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming traces run as a batch: watermarks have no effect there."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return scoring.session_traces(events, "6 hours").select(
        "user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.array_join("tokens", " ").alias("tokens"), F.col("n").cast("long").alias("n")
    )


def m06_sequence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces of events by user: a classifier trained on runs of tokens, stopped on val, scores them all."""
    traces = sequences.traces(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    rows = traces.select(
        "user_id", "tokens", (F.array_position("tokens", "purchase") % 2).cast("int").alias("label"),
        F.when(F.col("user_id") % 5 < 3, "train").when(F.col("user_id") % 5 == 3, "val").otherwise("test").alias("split")
    )
    rows = materialize(rows, "sequence-rows")
    return models.train_sequences(rows).score(rows).select("user_id", "split", "label", "margin", "score")


SHARES = {"spaces": " ", "e": "e", "a": "a", "o": "o", "t": "t", "digits": "0-9", "capitals": "A-Z", "accents": "\\x{C0}-\\x{17F}"}


def letter_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with shares of kinds of letters, and whether they are German; split by a checksum of the id."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL AND lang IS NOT NULL")
    n = F.greatest(F.length("text"), F.lit(1))
    shares = [(F.length(F.regexp_replace("text", f"[^{kind}]", "")) / n).alias(name) for name, kind in SHARES.items()]
    part = F.crc32(F.col("doc_id").cast("string")) % 10
    split = F.when(part < 6, "train").when(part == 6, "val").when(part == 7, "cal").otherwise("test")
    return docs.select("doc_id", *shares, F.length("text").cast("double").alias("n"), (F.col("lang") == "de").cast("int").alias("label"), split.alias("split"))


QUERIES = {f.__name__: f for f in (m01_calibrated_scores, m02_model_evaluation, m03_pe_features, m04_session_traces, m06_sequence_scores)}
ORACLE_SQL = {
    "m04_session_traces": """WITH l AS (SELECT user_id, ts, event_id, event_type, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM l) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, string_agg(event_type, ' ' ORDER BY ts, event_id) AS tokens, count(*) AS n FROM s GROUP BY user_id, s""",
}
