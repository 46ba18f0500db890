"""Lineage cuts that survive a lost executor, and the tables they leave.

Every cut goes to the folder the cluster names in ``spark.checkpoint.dir``, which driver and executors
share. Only a local session that names none (tests, a notebook) gets a folder of its own; a cluster
without one is an error, since each machine would write to its own disk.

A cut table belongs to the innermost open :func:`scratch` scope and is deleted when that closes, unless
it was passed on to the scope around it. What belongs to none is deleted when the process ends.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark import SparkContext
from pyspark.errors import PySparkRuntimeError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Scope:
    """The folders of intermediate tables that are to go together."""

    def __init__(self, around: Scope | None = None):
        self.around = around
        self.folders: list[str] = []

    def pass_on(self, *tables: DataFrame | None) -> None:
        """Leave these tables to the scope around, because a lazy result still reads them."""
        wanted = names_of(*tables)
        for folder in [f for f in self.folders if name_of(f) in wanted]:
            self.folders.remove(folder)
            if self.around is not None:
                self.around.folders.append(folder)

    def close(self) -> None:
        while self.folders:
            delete(self.folders.pop())


_outermost = Scope()
_open: list[Scope] = [_outermost]


def name_of(folder: str) -> str:
    """The last part of a path: unique, however the rest is written."""
    return folder.rstrip("/").rsplit("/", 1)[-1]


def names_of(*tables: DataFrame | None) -> set[str]:
    return {name_of(f.rsplit("/", 1)[0]) for t in tables if t is not None for f in t.inputFiles()}


def delete(folder: str) -> None:
    jvm = SparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    active = SparkContext._active_spark_context
    conf = active._jsc.hadoopConfiguration() if active else jvm.org.apache.hadoop.conf.Configuration()
    path.getFileSystem(conf).delete(path, True)


@atexit.register
def _at_end() -> None:
    if SparkContext._jvm is not None:
        with contextlib.suppress(Exception):  # the session may be gone; nothing can be reported here
            _outermost.close()


@contextlib.contextmanager
def scratch() -> Iterator[Scope]:
    """A scope whose intermediate tables are deleted at its end."""
    scope = Scope(_open[-1])
    _open.append(scope)
    try:
        yield scope
    finally:
        _open.remove(scope)
        scope.close()


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; one of its own only for a local session that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise PySparkRuntimeError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        named = tempfile.mkdtemp(prefix="argusframe-checkpoints-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def materialize(df: DataFrame, label: str, kinds: dict[str, T.DataType] | None = None) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back: one job, no lineage left. ``kinds`` are columns
    that are read back as another type which is stored alike, as a vector is as its parts."""
    spark = df.sparkSession
    path = reserve(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    schema = T.StructType([T.StructField(f.name, (kinds or {}).get(f.name, f.dataType), f.nullable) for f in df.schema])
    return spark.read.schema(schema).parquet(path)


def reserve(spark: SparkSession, label: str) -> str:
    """A new folder's path below the shared folder, which belongs to the innermost scope as a cut table does."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _open[-1].folders.append(path)
    return path


def move(folder: str, to: str) -> bool:
    """Give a folder another name on its file system; False if there is none."""
    jvm = SparkContext._jvm
    source, target = jvm.org.apache.hadoop.fs.Path(folder), jvm.org.apache.hadoop.fs.Path(to)
    files = source.getFileSystem(SparkContext._active_spark_context._jsc.hadoopConfiguration())
    files.mkdirs(target.getParent())
    return files.exists(source) and files.rename(source, target)


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`materialize` wrote, once nothing reads them any more."""
    wanted = names_of(*tables)
    for scope in _open:
        for folder in [f for f in scope.folders if name_of(f) in wanted]:
            scope.folders.remove(folder)
            delete(folder)
