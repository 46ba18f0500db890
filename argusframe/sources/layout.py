"""Tables laid out by group: written once in buckets of the group's key, so that whatever works by group reads them without
a shuffle."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def lay_out(rows: DataFrame, key: str, name: str, buckets: int) -> DataFrame:
    """Write ``rows`` as the table ``name`` in buckets by ``key``, sorted by it, and read it. Every task writes a file a bucket, so
    no group meets in a task here; a reader takes a bucket in one, in a stream. A group that holds much of a table makes its
    bucket as long, so a table of such groups is better left to joins that can be split."""
    rows.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return rows.sparkSession.table(name)


@contextlib.contextmanager
def laid_out(rows: DataFrame, key: str, buckets: int) -> Iterator[DataFrame]:
    """The same for a while: the table goes at the end."""
    spark: SparkSession = rows.sparkSession
    name = f"laid_out_{uuid.uuid4().hex}"
    try:
        yield lay_out(rows, key, name, buckets)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
