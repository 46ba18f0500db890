"""Streaming traces with bounded state, beside the same traces of a batch."""

import pytest
from oracle import SF
from pyspark.sql import functions as F

from argusframe.operators import sequences
from argusframe.streaming import bounded

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def run(stream, folder):
    """The last row of each key, over all batches, and the rows that closed one."""
    seen, closed = {}, []

    def sink(batch, _):
        for r in batch.collect():
            seen[r.user_id] = (r.tokens, r.n)
            if r.closed:
                closed.append(r.user_id)

    query = stream.writeStream.foreachBatch(sink).outputMode("update").option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    assert query.awaitTermination(120) and query.exception() is None
    return seen, closed


def dealt(spark, events, folder, parts, key):
    """Events written as files that arrive one by one."""
    for i in range(parts):
        events.where(F.pmod(key, F.lit(parts)) == i).coalesce(1).write.parquet(f"{folder}/{i}")
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


@pytest.mark.parametrize("parts", [1, 3])
def test_any_batching_gives_the_traces_of_the_batch(rocks, tmp_path, parts):
    events = rocks.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).select("user_id", "ts", "event_id", "event_type")
    stream = dealt(rocks, events, tmp_path / "in", parts, F.xxhash64("event_id"))
    seen, closed = run(bounded.bounded_traces(stream, ["user_id"], "ts", "event_id", "event_type", most=5), tmp_path / "state")
    want = sequences.traces(events, ["user_id"], ["ts", "event_id"], "event_type", most=5).collect()
    assert seen == {r.user_id: (r.tokens, r.n) for r in want} and not closed


def test_silent_keys_are_closed_and_their_state_goes(rocks, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 1, "a"), (1, "2024-01-01 00:01:00", 2, "b"), (2, "2024-01-03 00:00:00", 3, "c"), (2, "2024-01-05 00:00:00", 4, "d"), (1, "2024-01-05 00:00:00", 5, "e"), (3, None, 6, "f")]
    events = rocks.createDataFrame(rows, "user_id long, ts string, event_id long, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
    part = F.when(F.col("event_id") <= 2, 0).when(F.col("event_id") == 3, 1).otherwise(2)
    for i in range(3):  # one after the other, on one checkpoint
        events.where(part == i).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        stream = rocks.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        traces = bounded.bounded_traces(stream, ["user_id"], "ts", "event_id", "event_type", most=5, idle_ms=3_600_000, late="1 hour")
        seen, closed = run(traces, tmp_path / "state")
        if i == 1:
            assert closed == [1] and seen[1] == (["a", "b"], 2)
    assert 3 not in seen and seen[1][0] == ["e"]  # the trace of a key that was closed starts anew
