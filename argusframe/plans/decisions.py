"""Scan decisions end to end, and the full product of verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argusframe.operators import policy
from argusframe.plans.tables import table

T = policy.Thresholds()
# Scores are integer arithmetic and one division, so that every engine computes the same.
MODULUS = 10007


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as scanned files: scores by arithmetic on the id, traces counted from events."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("sha256"), F.octet_length("text").alias("length"))
    calls = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc_id")).agg((F.count("*") % 130).alias("n_calls"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    d = F.col("doc_id")
    unit = lambda k: (d * k % MODULUS).cast("double") / float(MODULUS)
    joined = docs.join(calls, "doc_id", "left").join(labels, "doc_id", "left")
    return joined.select(
        "doc_id", "sha256", "length", "n_calls", unit(7919).alias("static_score"), unit(104729).alias("behavioral_score"),
        F.when(
            F.col("toxic").isNotNull(), (d * 31 % 1009).cast("double") / 200000.0
        ).alias("memory_score"), F.when(d % 3 != 0, unit(1299709)).alias("network_score"),
        (d % 50 != 49).alias("exists"), F.when(d % 29 == 0, F.array(F.lit("header"))).when(
            d % 31 == 0, F.array(F.lit("exports"))
        ).otherwise(F.array().cast("array<string>")).alias("degraded"),
    )


def allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("source = 'src7'").select(F.sha2("text", 256).alias("sha256"))


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage of a scan is one projection; the allowlist is the only join besides the inputs'."""
    rows = policy.allowlisted(scans(spark, sf_dir), allowlist(spark, sf_dir))
    problem = policy.path_problem(F.col("exists"), F.lit(True), F.lit(True), F.col("length"), 30_000)
    rows = rows.withColumn("problem", problem)
    fine = F.col("problem").isNull()
    listed = fine & F.col("is_allowlisted")
    rows = rows.withColumn("score", F.when(fine & ~F.col("is_allowlisted"), F.col("static_score")))
    rows = rows.withColumn("static_first", F.when(~fine, "ERROR").when(listed, "ALLOW").otherwise(policy.static_verdict(F.col("static_score"), T)))
    behavioral = policy.behavioral_verdict(F.col("static_first"), F.col("n_calls"), F.col("behavioral_score"), T)
    rows = rows.withColumn("behavioral", F.when(fine, behavioral).otherwise("NOT_PROVIDED"))
    marked = F.when(fine & ~listed, F.col("degraded")).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("marked", marked).withColumn("static", policy.critical_override(F.col("static_first"), F.col("marked")))
    rows = rows.withColumn("memory", policy.binary_verdict(F.col("memory_score"), T.memory)).withColumn(
        "network", policy.binary_verdict(F.col("network_score"), T.network)
    )
    rows = policy.with_decision(rows)
    short = F.col("behavioral").isin("BENIGN", "MALICIOUS") & (F.col("n_calls") < 100)
    early = F.array_compact(
        F.array(
            F.col("problem"), F.when(listed, "static_allowlisted_nsrl"), F.when(short, "behavioral_short_trace"),
            F.when(F.arrays_overlap("marked", F.array(*map(F.lit, policy.CRITICAL_GROUPS))), "static_features_degraded")
        )
    )
    return rows.withColumn("reason_codes", F.concat(early, "reason_codes"))


def q01_scan_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(spark, sf_dir).select(
        "doc_id", "static", "behavioral", "memory", "network", "final_decision", F.array_join("reason_codes", ",").alias("reason_codes")
    )


def q02_decision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(spark, sf_dir).groupBy("final_decision").agg(F.count("*").alias("n"))


def q03_reason_code_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(spark, sf_dir).select(F.explode("reason_codes").alias("reason_code")).groupBy("reason_code").agg(F.count("*").alias("n"))


def verdict_product(spark: SparkSession) -> DataFrame:
    """All combinations of verdicts, 4 * 5 * 4 * 4 constants, unfolded from one row: no tables that are multiplied by partitions."""
    out = spark.range(0, 1, 1, 1)
    for name, values in zip(policy.SIGNALS, (policy.STATIC, policy.BEHAVIORAL, policy.OTHER, policy.OTHER), strict=True):
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return out.drop("id")


def q04_verdict_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.with_decision(verdict_product(spark)).select(*policy.SIGNALS, "final_decision", F.array_join("reason_codes", ",").alias("reason_codes"))


def q05_signal_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decided(spark, sf_dir)
    configured = {s: F.col("doc_id") % k != 0 for s, k in zip(policy.SIGNALS, (1009, 11, 13, 17), strict=True)}
    health = policy.signal_health(configured, {s: F.col(s) for s in policy.SIGNALS}, F.col("marked"))
    return rows.select(F.explode(health).alias("signal", "state")).groupBy("signal", "state").agg(F.count("*").alias("n"))


def q06_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.allowlisted(scans(spark, sf_dir), allowlist(spark, sf_dir)).groupBy("is_allowlisted").agg(F.count("*").alias("n")).select(
        F.col("is_allowlisted").cast("int").alias("is_allowlisted"), "n"
    )


def q07_path_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    rows = scans(spark, sf_dir).select(policy.path_problem(d % 7 != 0, d % 5 != 0, d % 3 != 0, F.col("length"), 2000).alias("problem"))
    return rows.groupBy(F.coalesce("problem", F.lit("ok")).alias("problem")).agg(F.count("*").alias("n"))


def q08_emulation_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry alone: the emulation verdict never enters a decision."""
    score = F.when(F.col("doc_id") % 4 != 0, 0.9990 + (F.col("doc_id") % 1000).cast("double") / 1000000.0)
    return scans(spark, sf_dir).select(policy.binary_verdict(score, T.emulation).alias("emulation")).groupBy("emulation").agg(F.count("*").alias("n"))


DECISION = """CASE WHEN behavioral = 'MALICIOUS' THEN 'TERMINATE'
  WHEN static = 'BLOCK' AND (memory = 'MALICIOUS' OR network = 'MALICIOUS') THEN 'BLOCK'
  WHEN memory = 'MALICIOUS' OR network = 'MALICIOUS' OR static IN ('ALERT', 'BLOCK') THEN 'ALERT'
  WHEN 'ERROR' IN (static, behavioral, memory, network) THEN 'NEEDS_REVIEW' ELSE 'ALLOW' END"""
REASONS = """concat_ws(',', CASE final_decision WHEN 'TERMINATE' THEN 'behavioral_malicious' WHEN 'BLOCK' THEN 'static_block_corroborated' WHEN 'ALLOW' THEN 'no_malicious_evidence'
   WHEN 'ALERT' THEN CASE WHEN memory = 'MALICIOUS' THEN 'memory_malicious' WHEN network = 'MALICIOUS' THEN 'network_malicious' WHEN static = 'BLOCK' THEN 'static_block_capped_at_alert' ELSE 'static_alert' END END,
  CASE WHEN final_decision = 'BLOCK' AND memory = 'MALICIOUS' THEN 'memory_malicious' END, CASE WHEN final_decision = 'BLOCK' AND network = 'MALICIOUS' THEN 'network_malicious' END,
  CASE WHEN final_decision IN ('TERMINATE', 'BLOCK', 'ALERT') AND CAST(static IN ('ALERT', 'BLOCK') AS INT) + CAST(memory = 'MALICIOUS' AS INT) + CAST(network = 'MALICIOUS' AS INT) >= 2 THEN 'corroborated_multi_signal' END,
  CASE WHEN static = 'ERROR' THEN 'static_scan_error' END, CASE WHEN behavioral = 'ERROR' THEN 'behavioral_scan_error' END,
  CASE WHEN memory = 'ERROR' THEN 'memory_scan_error' END, CASE WHEN network = 'ERROR' THEN 'network_scan_error' END)"""
SCANS = f"""scans AS (SELECT doc_id, sha256(text) AS sha256, octet_length(encode(text)) AS length, n_calls,
  CAST(doc_id * 7919 % 10007 AS DOUBLE) / 10007.0 AS static_score, CAST(doc_id * 104729 % 10007 AS DOUBLE) / 10007.0 AS behavioral_score,
  CASE WHEN toxic IS NOT NULL THEN CAST(doc_id * 31 % 1009 AS DOUBLE) / 200000.0 END AS memory_score,
  CASE WHEN doc_id % 3 <> 0 THEN CAST(doc_id * 1299709 % 10007 AS DOUBLE) / 10007.0 END AS network_score, doc_id % 50 <> 49 AS found,
  CASE WHEN doc_id % 29 = 0 THEN 'header' WHEN doc_id % 31 = 0 THEN 'exports' END AS degraded
  FROM documents LEFT JOIN (SELECT user_id AS doc_id, count(*) % 130 AS n_calls FROM events GROUP BY 1) USING (doc_id) LEFT JOIN labels USING (doc_id)),
 a AS (SELECT *, sha256 IN (SELECT sha256(text) FROM documents WHERE source = 'src7') AS listed, CASE WHEN NOT found THEN 'path_not_found' WHEN length > 30000 THEN 'file_too_large' END AS problem FROM scans),
 b AS (SELECT *, CASE WHEN problem IS NOT NULL THEN 'ERROR' WHEN listed THEN 'ALLOW' WHEN static_score < {T.static_allow}::DOUBLE THEN 'ALLOW' WHEN static_score < {T.static_block}::DOUBLE THEN 'ALERT' ELSE 'BLOCK' END AS static_first FROM a),
 c AS (SELECT *, CASE WHEN problem IS NOT NULL OR n_calls IS NULL THEN 'NOT_PROVIDED' WHEN n_calls < 10 THEN 'PENDING' WHEN behavioral_score >= {T.behavioral}::DOUBLE THEN 'MALICIOUS' ELSE 'BENIGN' END AS behavioral,
  CASE WHEN problem IS NULL AND NOT listed THEN degraded END AS marked FROM b),
 e AS (SELECT *, CASE WHEN marked = 'header' THEN 'ERROR' ELSE static_first END AS static,
  CASE WHEN memory_score IS NULL THEN 'NOT_PROVIDED' WHEN memory_score >= {T.memory}::DOUBLE THEN 'MALICIOUS' ELSE 'BENIGN' END AS memory,
  CASE WHEN network_score IS NULL THEN 'NOT_PROVIDED' WHEN network_score >= {T.network}::DOUBLE THEN 'MALICIOUS' ELSE 'BENIGN' END AS network FROM c),
 f AS (SELECT *, {DECISION} AS final_decision FROM e),
 decided AS (SELECT *, concat_ws(',', problem, CASE WHEN problem IS NULL AND listed THEN 'static_allowlisted_nsrl' END,
  CASE WHEN behavioral IN ('BENIGN', 'MALICIOUS') AND n_calls < 100 THEN 'behavioral_short_trace' END, CASE WHEN marked = 'header' THEN 'static_features_degraded' END, {REASONS}) AS reason_codes FROM f)"""
HEALTH = " UNION ALL ".join(
    f"SELECT '{s}' AS signal, CASE WHEN doc_id % {k} = 0 THEN 'model_not_configured' WHEN {s} = 'ERROR' THEN 'model_error'{
        " WHEN marked IS NOT NULL THEN 'degraded'" if s == 'static' else ''
    } END AS state FROM decided"
    for s, k in zip(policy.SIGNALS, (1009, 11, 13, 17), strict=True)
)

QUERIES = {
    f.__name__: f for f in (
        q01_scan_decisions, q02_decision_counts, q03_reason_code_counts, q04_verdict_product, q05_signal_health, q06_allowlist, q07_path_checks,
        q08_emulation_verdicts
    )
}
ORACLE_SQL = {
    "q01_scan_decisions": f"WITH {SCANS} SELECT doc_id, static, behavioral, memory, network, final_decision, reason_codes FROM decided",
    "q02_decision_counts": f"WITH {SCANS} SELECT final_decision, count(*) AS n FROM decided GROUP BY 1",
    "q03_reason_code_counts": f"WITH {SCANS} SELECT reason_code, count(*) AS n FROM (SELECT unnest(string_split(reason_codes, ',')) AS reason_code FROM decided) GROUP BY 1",
    "q04_verdict_product": "WITH v AS (SELECT static, behavioral, memory, network FROM "
    + ", ".join(
        f"(SELECT unnest([{', '.join(repr(v) for v in values)}]) AS {name})" for name,
        values in zip(policy.SIGNALS, (policy.STATIC, policy.BEHAVIORAL, policy.OTHER, policy.OTHER), strict=True)
    )
    + f"), w AS (SELECT *, {DECISION} AS final_decision FROM v) SELECT *, {REASONS} AS reason_codes FROM w",
    "q05_signal_health": f"WITH {SCANS} SELECT signal, state, count(*) AS n FROM ({HEALTH}) WHERE state IS NOT NULL GROUP BY 1, 2",
    "q06_allowlist": "WITH s AS (SELECT sha256(text) IN (SELECT sha256(text) FROM documents WHERE source = 'src7') AS k FROM documents) SELECT CAST(k AS INT) AS is_allowlisted, count(*) AS n FROM s GROUP BY 1",
    "q07_path_checks": "SELECT CASE WHEN doc_id % 7 = 0 THEN 'path_not_found' WHEN doc_id % 5 = 0 THEN 'not_a_file' WHEN doc_id % 3 = 0 THEN 'unreadable' WHEN octet_length(encode(text)) > 2000 THEN 'file_too_large' ELSE 'ok' END AS problem, count(*) AS n FROM documents GROUP BY 1",
    "q08_emulation_verdicts": f"SELECT CASE WHEN doc_id % 4 = 0 THEN 'NOT_PROVIDED' WHEN 0.9990::DOUBLE + CAST(doc_id % 1000 AS DOUBLE) / 1000000.0 >= {T.emulation}::DOUBLE THEN 'MALICIOUS' ELSE 'BENIGN' END AS emulation, count(*) AS n FROM documents GROUP BY 1",
}
