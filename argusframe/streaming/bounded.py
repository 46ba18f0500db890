"""Traces bounded by keyed state: the first tokens of every key and how many there were, however events arrive.

A key's state is at most ``most`` events and one count, so it does not grow with the key's events. The first tokens are
those of the smallest order, not of the earliest arrival, so every batching of the same events ends with the same rows.
A key that has been silent for ``idle`` is closed by a timer of event time: its last row is marked and its state goes.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType
from pyspark.sql.types import ArrayType as Array


class FirstTokens(StatefulProcessor):
    """Rows are key, at (event time in microseconds), tie (orders events of one time) and token."""

    def __init__(self, columns: list[str], most: int, idle_ms: int | None):
        self.columns, self.most, self.idle_ms = columns, most, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getListState("first", "at long, tie long, token string")
        self.counts = handle.getValueState("counts", "n long, last long")

    def row(self, key: tuple, kept: list[tuple], n: int, is_closed: bool) -> pd.DataFrame:
        tokens = [token for _, _, token in sorted(kept, key=lambda e: e[:2])]
        return pd.DataFrame([(*key, tokens, n, is_closed)], columns=self.columns)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = [tuple(e) for e in self.first.get()] if self.first.exists() else []
        n, last = tuple(self.counts.get()) if self.counts.exists() else (0, 0)
        for batch in rows:
            n += len(batch)
            last = max(last, int(batch["at"].max()))
            events = zip(batch["at"].tolist(), batch["tie"].tolist(), batch["token"].tolist(), strict=True)
            kept = heapq.nsmallest(self.most, [*kept, *events], key=lambda e: e[:2])
        self.first.put(kept)
        self.counts.update((n, last))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(last // 1000 + self.idle_ms)
        yield self.row(key, kept, n, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.counts.exists():
            yield self.row(key, [tuple(e) for e in self.first.get()], tuple(self.counts.get())[0], True)
        self.first.clear()
        self.counts.clear()

    def close(self) -> None:
        pass


def bounded_traces(events: DataFrame, by: list[str], ts: str, tie: str, token: str, most: int = 100, idle_ms: int | None = None, late: str = "1 hour") -> DataFrame:
    """A stream of ``by``, tokens, n and closed: a key's row as of each batch that held any of its events, the latest of
    which counts. With ``idle_ms`` events later than ``late`` are dropped and silent keys are closed; without it nothing
    is dropped and state is kept. Events of null time or order are no part of a trace. The state store must be RocksDB."""
    fields = [events.schema[c] for c in by]
    out = StructType([*fields, StructField("tokens", Array(StringType())), StructField("n", LongType()), StructField("closed", BooleanType())])
    timed = events.where(F.col(ts).isNotNull() & F.col(tie).isNotNull())
    timed = timed.withWatermark(ts, late) if idle_ms is not None else timed
    narrow = timed.select(*by, F.col(ts), F.unix_micros(F.col(ts)).alias("at"), F.col(tie).cast("long").alias("tie"), F.col(token).cast("string").alias("token"))
    return narrow.groupBy(*by).transformWithStateInPandas(
        statefulProcessor=FirstTokens(out.names, most, idle_ms), outputStructType=out, outputMode="Update", timeMode="None" if idle_ms is None else "EventTime"
    )
