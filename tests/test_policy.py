"""The whole product of verdicts against a rule model in plain Python, and the cuts of each verdict."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from argusframe.operators import policy
from argusframe.plans.decisions import verdict_product


def expected(static, behavioral, memory, network):
    errors = [f"{n}_scan_error" for n, v in zip(policy.SIGNALS, (static, behavioral, memory, network)) if v == "ERROR"]
    others = [f"{n}_malicious" for n, v in (("memory", memory), ("network", network)) if v == "MALICIOUS"]
    flag = ["corroborated_multi_signal"] if len(others) + (static in ("ALERT", "BLOCK")) >= 2 else []
    if behavioral == "MALICIOUS":
        return "TERMINATE", ["behavioral_malicious", *flag, *errors]
    if static == "BLOCK" and others:
        return "BLOCK", ["static_block_corroborated", *others, *flag, *errors]
    if others:
        return "ALERT", [others[0], *flag, *errors]
    if static in ("ALERT", "BLOCK"):
        return "ALERT", ["static_alert" if static == "ALERT" else "static_block_capped_at_alert", *flag, *errors]
    return ("NEEDS_REVIEW", errors) if errors else ("ALLOW", ["no_malicious_evidence"])


def test_all_320(spark):
    rows = policy.with_decision(verdict_product(spark)).collect()
    assert len(rows) == 320
    for r in rows:
        assert (r.final_decision, r.reason_codes) == expected(r.static, r.behavioral, r.memory, r.network), r
    assert Counter(r.final_decision for r in rows) == {"ALERT": 156, "TERMINATE": 64, "NEEDS_REVIEW": 60, "BLOCK": 28, "ALLOW": 12}


def test_cuts(spark):
    t = policy.Thresholds()
    rows = spark.createDataFrame([(t.static_allow,), (t.static_allow - 1e-9,), (t.static_block,), (t.static_block - 1e-9,), (0.0,), (1.0,), (None,), (float("nan"),)], "s double")
    got = [r.v for r in rows.select(policy.static_verdict(F.col("s"), t).alias("v")).collect()]
    assert got == ["ALERT", "ALLOW", "BLOCK", "ALERT", "ALLOW", "BLOCK", "ERROR", "ERROR"]
    rows = spark.createDataFrame([(t.network,), (t.network - 1e-9,), (None,)], "s double")
    assert [r.v for r in rows.select(policy.binary_verdict(F.col("s"), t.network).alias("v")).collect()] == ["MALICIOUS", "BENIGN", "NOT_PROVIDED"]


@pytest.mark.parametrize("text", [None, "{", "- 1", "static_allow: yes", "static_allow: 0.1"])
def test_thresholds_fail_loudly(tmp_path, text):
    path = tmp_path / "t.yaml"
    if text is not None:
        path.write_text(text)
    with pytest.raises(RuntimeError):
        policy.load_thresholds(str(path))


def test_thresholds_load(tmp_path):
    path = tmp_path / "t.yaml"
    path.write_text("\n".join(f"{k}: {v}" for k, v in vars(policy.Thresholds()).items()))
    assert policy.load_thresholds(str(path)) == policy.Thresholds()


def test_scan_from_files(spark, tmp_path):
    """Missing paths, folders, other files, executables, a raising model and one that isn't there."""
    import numpy as np
    from argusframe.operators import scan
    from argusframe.plans.scans import HEAD
    from argusframe.sources import readers

    (tmp_path / "d").mkdir()
    for name, data in (("a.exe", HEAD), ("b.exe", HEAD + b"over"), ("c.exe", HEAD + b"raise"), ("e.exe", HEAD + b"listed"), ("t.txt", b"text"), ("l.txt", b"listed text")):
        (tmp_path / "d" / name).write_bytes(data)
    names = ["a.exe", "b.exe", "c.exe", "e.exe", "t.txt", "l.txt", "gone.exe", ""]
    wanted = spark.createDataFrame([(f"{tmp_path}/d/{n}".rstrip("/"),) for n in names], "path string")
    found = readers.read_files(spark, str(tmp_path / "d"))
    digests = found.where("path LIKE '%/e.exe' OR path LIKE '%/l.txt'").select("sha256")

    def predict(matrix):
        if any(int(v[0]) == len(HEAD) + 5 for v in matrix):
            raise RuntimeError
        return np.where(matrix[:, 0] > len(HEAD), 0.99, 0.1)

    def score(parsed):
        return parsed.withColumn("s", scan.guarded(predict)(F.col("features"))).select("path", F.col("s.score").alias("static_score"))

    rows = scan.with_static(scan.manifest(found, wanted), "path", score, digests)
    rows = rows.withColumns({"n_calls": F.when(F.col("path").like("%a.exe"), 50), "behavioral_score": F.lit(0.9), "memory_score": F.lit(None).cast("double"), "network_score": F.when(F.col("path").like("%b.exe"), 0.99)})
    got = {r.path.rsplit("/", 1)[-1]: r for r in scan.decide_scans(rows, policy.Thresholds()).collect()}
    assert got["a.exe"].static == "ALLOW" and got["a.exe"].final_decision == "TERMINATE" and got["a.exe"].reason_codes[0] == "behavioral_short_trace"
    assert got["b.exe"].static == "BLOCK" and got["b.exe"].final_decision == "BLOCK"
    assert got["c.exe"].static == "ERROR" and got["c.exe"].reason_codes[0] == "static_scan_exception" and got["c.exe"].final_decision == "NEEDS_REVIEW"
    assert got["e.exe"].static == "ALLOW" and got["e.exe"].reason_codes[0] == "static_allowlisted_nsrl" and got["e.exe"].static_score is None
    assert got["t.txt"].reason_codes[0] == "invalid_or_non_pe_file" and got["gone.exe"].reason_codes[0] == "path_not_found" and got["d"].reason_codes[0] == "not_a_file"
    assert got["l.txt"].reason_codes == got["t.txt"].reason_codes and got["l.txt"].final_decision == "NEEDS_REVIEW"  # the format comes first
    assert all(got[n].static == "ERROR" for n in ("t.txt", "gone.exe", "d"))
    neutral = {r.path.rsplit("/", 1)[-1]: r for r in scan.decide_scans(rows, policy.Thresholds(), {"behavioral": False, "network": False}).collect()}
    assert neutral["a.exe"].behavioral == "NOT_PROVIDED" and neutral["a.exe"].signal_health == {"behavioral": "model_not_configured"}
    assert neutral["b.exe"].final_decision == "ALERT" and neutral["b.exe"].signal_health == {"network": "model_not_configured"}
