"""Sources that are told of filters: what they leave unread, and that rows stay the same."""

import json
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from argusframe.plans.scans import HEAD
from argusframe.sources import pushdown, records


@pytest.fixture
def database(tmp_path):
    path = str(tmp_path / "h.db")
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE F (name TEXT, size INTEGER)")
        con.executemany("INSERT INTO F VALUES (?, ?)", [(None if i % 10 == 9 else f"n{i:04}", i) for i in range(1000)])
    return path


def test_sqlite_filters_are_asked_of_the_database(spark, database):
    rows = pushdown.read_sqlite(spark, database, "F", "name string, size long", rows=300)
    for wanted, n in (("name = 'n0007'", 1), ("name IN ('n0001', 'n0002', 'x')", 2), ("size >= 990", 10), ("name IS NULL", 100), ("name LIKE 'n00%' AND size < 50", 45), ("NOT name = 'n0001'", 899), ("length(name) = 5", 900)):
        assert rows.where(wanted).count() == n
    reader = pushdown.SqliteReader({"path": database, "table": "F", "columns": "name string, size long", "rows": "10000"})
    reader.pushFilters([pushdown.EqualTo(("name",), "n0007"), pushdown.IsNotNull(("name",))])
    (part,) = reader.partitions()
    assert list(reader.read(part)) == [("n0007", 7)]  # no other row reaches the worker


def test_only_heads_of_files_that_may_match_are_read(spark, tmp_path):
    folder = tmp_path / "d"
    folder.mkdir()
    for i in range(40):
        (folder / f"{i}.bin").write_bytes((HEAD if i % 4 == 0 else b"text") + b"x" * (10 if i % 2 else 1_000_000))
    heads = pushdown.read_heads(spark, str(folder))
    got = heads.where("length > 1000").select("path", "length", pushdown.is_executable(F.col("head")).alias("pe"), F.octet_length("head").alias("n")).collect()
    total = sum(f.stat().st_size for f in folder.iterdir())
    assert len(got) == 20 and sum(r.pe for r in got) == 10 and sum(r.n for r in got) < 0.01 * total
    reader = pushdown.HeadReader({"path": str(folder)})
    reader.pushFilters([pushdown.GreaterThan(("length",), 2_000_000)])
    assert reader.partitions() == []
    whole = pushdown.read_heads(spark, str(folder), content=True).where("path LIKE '%/1.bin'").first()
    assert whole.content == b"text" + b"x" * 10 and whole.head == whole.content


def test_format_is_told_from_the_head(spark):
    far = bytearray(b"MZ" + b"\0" * 5000)
    far[60:64] = (6000).to_bytes(4, "little")
    cases = [(HEAD, True), (HEAD[:66], False), (b"MZ", False), (b"", False), (b"PK" + HEAD[2:], False), (bytes(far)[:4096], None), (None, False)]
    rows = spark.createDataFrame([(i, bytearray(h) if h is not None else None) for i, (h, _) in enumerate(cases)], "i int, h binary")
    got = [r.p for r in rows.select("i", pushdown.is_executable(F.col("h")).alias("p")).orderBy("i").collect()]
    assert got[:-1] == [x for _, x in cases[:-1]] and not got[-1]


def test_a_zip_has_a_partition_a_member(spark, tmp_path):
    lines = {}
    with zipfile.ZipFile(tmp_path / "Win32_train.zip", "w", zipfile.ZIP_DEFLATED) as held:
        for i in range(50):
            lines[f"m/{i}.jsonl"] = [json.dumps({"sha256": f"{i}-{j}"}) for j in range(i)]
            held.writestr(f"m/{i}.jsonl", "".join(x + "\n" for x in lines[f"m/{i}.jsonl"]))
    rows = pushdown.read_zips(spark, [str(tmp_path / "Win32_train.zip")])
    assert rows.rdd.getNumPartitions() == 50 and pushdown.read_zips(spark, [str(tmp_path / "Win32_train.zip")], members=8).rdd.getNumPartitions() == 7
    assert sorted((r.member, r.line) for r in rows.collect()) == sorted((m, x) for m, own in lines.items() for x in own)
    assert rows.where("member = 'm/7.jsonl'").count() == 7
    kept = records.read_lines(spark, str(tmp_path), "train", ("Win32",)).collect()
    assert sorted(r.line for r in kept) == sorted(x for own in lines.values() for x in own) and {r.file for r in kept} == {"Win32_train.zip"}


def test_checks_by_group_read_a_layout_without_a_shuffle(spark):
    from argusframe.operators import splits
    from argusframe.sources import layout

    rows = spark.range(2000).select((F.col("id") % 97).alias("g"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("split"))
    with layout.laid_out(rows, "g", 4) as held:
        found = splits.leaks(held, F.col("g"))
        assert found.count() == 97 and held.count() == 2000
        other = held.groupBy("g").agg(F.count("*").alias("n"))
        for df in (found, found.join(other.hint("merge"), found.leak_key == other.g)):
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        name = held._jdf.queryExecution().analyzed().toString()
    assert "laid_out_" in name and not [t.name for t in spark.catalog.listTables() if t.name.startswith("laid_out_")]
