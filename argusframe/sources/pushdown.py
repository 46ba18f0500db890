"""Python data sources that are told of filters before they read: tables of SQLite, heads of files, members of zips.

A filter is used to leave out what cannot match, and left to Spark as well, so that both agree on every row. Paths
may be of any file system that pyarrow reaches.
"""

from __future__ import annotations

import operator
import zipfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringContains,
    StringEndsWith, StringStartsWith,
)

HEAD_BYTES = 4096
COMPARISONS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
TESTS = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}
TEXT_TESTS = {StringStartsWith: str.startswith, StringEndsWith: str.endswith, StringContains: str.__contains__}


class Some(InputPartition):
    """A part of a source: whatever its reader needs to know of it."""

    def __init__(self, *what):
        self.what = what


class Told(DataSourceReader):
    """A reader that keeps the filters it is told and hands all of them back."""

    def __init__(self, options: dict[str, str]):
        self.options, self.filters = options, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        self.filters = list(filters)
        return self.filters

    def keeps(self, column: str, value) -> bool:
        """Whether the filters on a column let a value through; those that aren't understood do."""
        for f in self.filters:
            if getattr(f, "attribute", None) != (column,):
                continue
            if value is None and isinstance(f, (IsNotNull, In, *TESTS, *TEXT_TESTS)):
                return False
            if type(f) in TESTS and not TESTS[type(f)](value, f.value) or type(f) in TEXT_TESTS and not TEXT_TESTS[type(f)](value, f.value):
                return False
            if isinstance(f, In) and value not in f.value:
                return False
        return True


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class SqliteReader(Told):
    def connect(self):
        import sqlite3

        return sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True)

    def where(self) -> tuple[str, list]:
        """The filters as SQL: those that mean the same there."""
        parts, values = [], []
        for f in self.filters:
            column = quoted(f.attribute[0]) if len(getattr(f, "attribute", ())) == 1 else None
            if column is None:
                continue
            if isinstance(f, IsNotNull):
                parts.append(f"{column} IS NOT NULL")
            elif type(f) in COMPARISONS and isinstance(f.value, (str, int, float)):
                parts.append(f"{column} {COMPARISONS[type(f)]} ?")
                values.append(f.value)
            elif isinstance(f, In) and 0 < len(f.value) <= 500 and all(isinstance(v, (str, int, float)) for v in f.value):
                parts.append(f"{column} IN ({', '.join('?' * len(f.value))})")
                values += f.value
            elif isinstance(f, StringStartsWith):
                parts.append(f"substr({column}, 1, ?) = ?")
                values += [len(f.value), f.value]
        return "".join(f" AND {p}" for p in parts), values

    def partitions(self) -> list[Some]:
        name, step = self.options["table"], int(self.options.get("rows", "200000"))
        with self.connect() as con:
            if not con.execute("SELECT 1 FROM sqlite_master WHERE name = ?", (name,)).fetchone():
                raise ValueError(f"{self.options['path']} has no {name}")
            low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(name)}").fetchone()
        return [Some(i, i + step) for i in range(low, high + 1, step)] if high is not None else []

    def read(self, part: Some) -> Iterator[tuple]:
        columns = ", ".join(quoted(c.strip().split(" ")[0]) for c in self.options["columns"].split(","))
        where, values = self.where()
        with self.connect() as con:
            yield from con.execute(f"SELECT {columns} FROM {quoted(self.options['table'])} WHERE rowid >= ? AND rowid < ?{where}", (*part.what, *values))


class SqliteTable(DataSource):
    """Columns of an SQLite table, read in ranges of rows; options path, table, columns (``name type, ...``) and rows (a range's)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        return self.options["columns"]

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SqliteReader(dict(self.options))


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


class HeadReader(Told):
    def partitions(self) -> list[Some]:
        files, root = opened(self.options["path"])
        found = files.get_file_info(fs.FileSelector(root, recursive=True))
        kept = [(f.path, f.size) for f in found if f.type == fs.FileType.File and self.keeps("path", f.path) and self.keeps("length", f.size)]
        step = int(self.options.get("files", "512"))
        return [Some(kept[i : i + step]) for i in range(0, len(kept), step)]

    def read(self, part: Some) -> Iterator[pa.RecordBatch]:
        files, _ = opened(self.options["path"])
        whole = self.options.get("content") == "true"
        for path, length in part.what[0]:
            with files.open_input_file(path) as file:
                data = file.read(length if whole else HEAD_BYTES)
            columns = [pa.array([path]), pa.array([length], pa.int64()), pa.array([data[:HEAD_BYTES]], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array([data], pa.binary())] * whole, names=["path", "length", "head"] + ["content"] * whole)


class FileHeads(DataSource):
    """path, length and head (4 KiB) of the files below a folder, and with the option content their bytes. Files that
    filters on path or length rule out are never opened."""

    @classmethod
    def name(cls) -> str:
        return "file_heads"

    def schema(self) -> str:
        return "path string, length long, head binary" + ", content binary" * (self.options.get("content") == "true")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return HeadReader(dict(self.options))


class ZipReader(Told):
    def partitions(self) -> list[Some]:
        out, step = [], int(self.options.get("members", "1"))
        for path in self.options["paths"].split("\n"):
            files, inner = opened(path)
            with files.open_input_file(inner) as file, zipfile.ZipFile(file) as held:  # reads the central directory alone
                names = [i.filename for i in held.infolist() if not i.is_dir() and self.keeps("member", i.filename)]
            out += [Some(path, names[i : i + step]) for i in range(0, len(names), step)]
        return out

    def read(self, part: Some) -> Iterator[pa.RecordBatch]:
        path, names = part.what
        files, inner = opened(path)
        with files.open_input_file(inner) as file, zipfile.ZipFile(file) as held:
            for name in names:
                with held.open(name) as stream:
                    lines: list[str] = []
                    for line in stream:
                        lines.append(line.decode().rstrip("\n").removesuffix("\r"))
                        if len(lines) >= 1000:
                            yield self.batch(path, name, lines)
                            lines = []
                    if lines:
                        yield self.batch(path, name, lines)

    @staticmethod
    def batch(path: str, name: str, lines: list[str]) -> pa.RecordBatch:
        n = len(lines)
        return pa.RecordBatch.from_arrays([pa.array([path.rsplit("/", 1)[-1]] * n), pa.array([name] * n), pa.array(lines)], names=["file", "member", "line"])


class ZipLines(DataSource):
    """file, member and line of the text members of zips (option paths, one a line), a task for every ``members`` of them:
    members are streamed, and no zip is held as a whole."""

    @classmethod
    def name(cls) -> str:
        return "zip_lines"

    def schema(self) -> str:
        return "file string, member string, line string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ZipReader(dict(self.options))


def source(spark: SparkSession, kind: type[DataSource], **options: str) -> DataFrame:
    """A table of one of these sources, which Spark tells of filters."""
    spark.dataSource.register(kind)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(kind.name()).options(**options).load()


def read_sqlite(spark: SparkSession, path: str, table: str, columns: str, rows: int = 200_000) -> DataFrame:
    return source(spark, SqliteTable, path=path, table=table, columns=columns, rows=str(rows))


def read_heads(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    return source(spark, FileHeads, path=path, content=str(content).lower())


def read_zips(spark: SparkSession, paths: list[str], members: int = 1) -> DataFrame:
    return source(spark, ZipLines, paths="\n".join(paths), members=str(members))


def is_executable(head: Column) -> Column:
    """Whether a head names itself an executable: both signatures, or null where the second lies beyond the head."""
    byte = lambda i: F.conv(F.hex(F.substring(head, i, 1)), 16, 10).cast("long")
    at = byte(61) + 256 * byte(62) + 65536 * byte(63) + 16777216 * byte(64)
    first = (F.octet_length(head) >= 64) & (F.hex(F.substring(head, 1, 2)) == "4D5A")
    second = F.hex(F.call_function("substring", head, (F.least(at, F.lit(HEAD_BYTES)) + 1).cast("int"), F.lit(4))) == "50450000"
    beyond = (at + 4 > F.octet_length(head)) & (F.octet_length(head) == HEAD_BYTES)
    return F.when(~first, False).when(beyond, None).otherwise(second)
