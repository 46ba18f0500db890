"""Shared plumbing: reading tables and running Arrow batches through a per-worker object."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from argusframe.checkpoints import materialize
from argusframe.operators.membership import Filter

#: ASCII white space: what the contracts write as [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\f\r"
#: Bytes of one column chunk that a task hands from Python to the JVM at once.
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that extra columns of any name neither travel nor clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


class Listed:
    """Which rows may stand on a list: a Bloom filter of at most 8 MiB over its keys, kept as a table of one row.

    Whole texts meet a list of documents by it: those it turns away are settled where they are read, and only those
    that may be on the list travel to an exact join with it. The plan is the same for lists of every length; one too
    long for the filter lets more texts travel."""

    make = staticmethod(Filter.of)

    def __init__(self, few: DataFrame, names: list[str]):
        made = self.make(few.select(F.xxhash64(*names).alias("digest")), few.count())
        self.words = materialize(made.words, "list-filter")
        self.filter = Filter(self.words, made.bits)

    def possible(self, *key: Column) -> Column:
        """Never null. The key's columns have the types and the order of the list's."""
        return self.filter.possible(F.xxhash64(*key))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until ``df`` has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def emit(columns: list[str], rows: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [()] * len(columns)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=columns)


ARROW = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}


def map_rows(df: DataFrame, make: Callable[[], Callable[..., Iterator[tuple]]], schema: str) -> DataFrame:
    """Stream ``df`` through Python. ``make()`` is called once a task and gives a function of one row's
    values that yields output rows; batches are cut at ``BATCH_BYTES`` of strings and bytes."""
    names, kinds = zip(*(field.strip().split(" ") for field in schema.split(",")), strict=True)
    types = [ARROW[k] for k in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, out, held = make(), [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for made in one(*row):
                    out.append(made)
                    held += 64 + sum(len(v) for v in made if isinstance(v, (str, bytes)))
                    if held >= BATCH_BYTES or len(out) >= 20_000:
                        yield emit(names, out, types)
                        out, held = [], 0
        if out:
            yield emit(names, out, types)

    return df.mapInArrow(run, schema)
