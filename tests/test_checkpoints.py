"""Intermediate tables: whose they are, when they go, and which may be broadcast."""

import os

import pytest
from pyspark.errors import PySparkRuntimeError
from pyspark.sql import functions as F

from argusframe import checkpoints, sizing
from argusframe.checkpoints import discard, materialize, scratch
from argusframe.components import connected_components


def left(spark):
    return set(os.listdir(checkpoints.shared_dir(spark)))


def test_scope_deletes_what_it_does_not_pass_on(spark):
    before = left(spark)
    with scratch():
        with scratch() as inner:
            gone, kept = materialize(spark.range(5), "a"), materialize(spark.range(7), "b")
            inner.pass_on(kept)
        assert kept.count() == 7 and len(left(spark) - before) == 1
        extra = materialize(gone.sparkSession.range(3), "c")
        discard(extra)
        assert len(left(spark) - before) == 1
    assert left(spark) == before


def test_scope_deletes_after_an_error(spark):
    before = left(spark)
    with pytest.raises(ZeroDivisionError), scratch():
        materialize(spark.range(5), "a")
        raise ZeroDivisionError
    assert left(spark) == before


def test_components_leave_one_table(spark):
    before = left(spark)
    with scratch() as held:
        parts = connected_components(spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "a long, b long"))
        held.pass_on(parts)
        assert len(left(spark) - before) == 1
    assert sorted(map(tuple, parts.collect())) == [(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)]
    discard(parts)
    assert left(spark) == before


def test_no_local_folder_on_a_cluster():
    class Conf:
        get = staticmethod(lambda *_: None)

    class Context:
        master = "local-cluster[2,1,1024]"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(PySparkRuntimeError, match="spark.checkpoint.dir"):
        checkpoints.shared_dir(Session)


def test_broadcasts_are_bounded_in_bytes(spark):
    few = materialize(spark.range(1000).select(F.col("id").alias("k"), F.array("id").alias("v"), F.repeat(F.lit("x"), 100).alias("s")), "few")
    n = sizing.bytes_of(few)
    assert 100_000 < n < 400_000
    big = spark.range(10)
    plan = lambda most: sizing.join_checked(big, few, big["id"] == few["k"], most=most)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(n) and "strategy=broadcast" not in plan(n - 1)
    assert sizing.bytes_of(spark.range(1000)) == 1000 * (sizing.ROW_BYTES + 8)
