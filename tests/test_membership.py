"""The filter and the exact look-up behind it."""

import hashlib

import pytest
from pyspark.sql import functions as F

from argusframe.functions import warnings
from argusframe.operators import membership, scan
from argusframe.plans import scans

SF = "/root/testdata/sf0.001"


def digests(spark, low, high):
    return spark.range(low, high).select(F.sha2(F.col("id").cast("string"), 256).alias("sha256"))


def test_exact_and_few_pass_the_filter(spark, tmp_path):
    known = membership.write(digests(spark, 0, 20_000), str(tmp_path / "a"))
    asked = digests(spark, 10_000, 60_000).select(F.col("sha256").alias("digest"))
    assert known.listed(asked).count() == 10_000
    strangers = digests(spark, 20_000, 60_000).select(known.filter.possible(F.col("sha256")).alias("p"))
    assert strangers.where("p").count() < 0.02 * 40_000
    assert digests(spark, 0, 20_000).where(~known.filter.possible(F.col("sha256"))).isEmpty()


def test_exact_where_the_filter_is_full(spark, tmp_path):
    known = membership.write(digests(spark, 0, 3_000), str(tmp_path / "a"), most_bits=256)
    assert known.listed(digests(spark, 2_900, 4_000).select(F.col("sha256").alias("digest"))).count() == 100


def test_malformed_digests_are_not_listed(spark, tmp_path):
    one = hashlib.sha256(b"x").hexdigest()
    rows = spark.createDataFrame([(one.upper(),), ("zz" * 32,), ("ab",), ("",), (None,)], "sha256 string")
    known = membership.write(rows, str(tmp_path / "a"))
    assert [r.digest for r in known.listed(rows.select(membership.normal(F.col("sha256")).alias("digest"))).collect()] == [one]


def test_artifacts_missing_empty_and_damaged(spark, tmp_path):
    assert membership.load(spark, str(tmp_path / "none")) is None
    empty = membership.write(digests(spark, 0, 0), str(tmp_path / "e"))
    assert empty.listed(digests(spark, 0, 10).select(F.col("sha256").alias("digest"))).count() == 0
    membership.write(digests(spark, 0, 5_000), str(tmp_path / "d"))
    next((tmp_path / "d" / "digests").glob("part=*/*.parquet")).unlink()
    with pytest.raises(RuntimeError):
        membership.load(spark, str(tmp_path / "d"))


def test_scan_reads_contents_once_and_never_shuffles_them(spark, monkeypatch):
    plans = []
    keep = scan.materialize

    def told(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, label)

    monkeypatch.setattr(scan, "materialize", told)
    out = scans.q90_file_decisions(spark, SF)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert sum(p.count("MapInArrow") for p in plans) == 1
    for plan in plans:
        assert not [line for line in plan.splitlines() if "Exchange" in line and "content" in line]


def test_every_warning_form_is_told():
    for form in warnings.WARNINGS:
        raw = "section 7: " + form[3:] if form.startswith("...") else form[:-3] + " 0x12"
        assert warnings.known(raw) == form
    two = [w for w in warnings.WARNINGS if "Delay import directory" in w]
    made = warnings.flags_of_forms([*two, "unheard of"])
    assert len(two) >= 2 and made[-1] == len(two) + 1 and all(made[warnings.WARNINGS.index(w)] == 1 for w in two) and sum(made[:-1]) == len(two)
