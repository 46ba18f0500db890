"""The decision ladder over streams: the same expressions as in batch, on rows as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from argusframe.operators import policy


def decide_stream(scores: DataFrame, thresholds: policy.Thresholds | None = None) -> DataFrame:
    """A stream of rows with static_score, n_calls, behavioral_score, memory_score and network_score, with
    verdicts, final_decision and reason_codes. Stateless: nothing is kept between rows."""
    t = thresholds or policy.Thresholds()
    rows = scores.withColumn("static", policy.static_verdict(F.col("static_score"), t))
    rows = rows.withColumn("behavioral", policy.behavioral_verdict(F.col("static"), F.col("n_calls"), F.col("behavioral_score"), t))
    rows = rows.withColumn("memory", policy.binary_verdict(F.col("memory_score"), t.memory)).withColumn(
        "network", policy.binary_verdict(F.col("network_score"), t.network)
    )
    return policy.with_decision(rows)


def session_traces(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Traces by user and session: rows more than ``gap`` apart start a new one. Rows later than ``late`` are
    dropped, and a session's state goes when the watermark has passed it."""
    rows = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    lists = rows.agg(F.collect_list(F.struct("ts", "event_id", "event_type")).alias("l"))
    return lists.select(
        "user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.array_sort("l")["event_type"].alias("tokens"), F.size("l").alias("n")
    )


def windowed_alerts(decided: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Decisions counted by window of event time ``ts``."""
    return decided.withWatermark("ts", late).groupBy(
        F.window("ts", window).alias("w"), "final_decision"
    ).agg(F.count("*").alias("n")).select("w.start", "final_decision", "n")


def run_batches(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand each micro-batch to ``sink`` (made idempotent by the batch number it gets), then stop."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
