"""From files to decisions: bytes made from documents, parsed, scored and decided, in Spark and in SQL."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from argusframe import models
from argusframe.checkpoints import materialize, scratch
from argusframe.functions import columns as C
from argusframe.functions.warnings import DOTS, WARNINGS, normalised
from argusframe.operators import evaluators, membership, metrics, policy, scan
from argusframe.plans.decisions import DECISION, REASONS
from argusframe.plans.tables import table
from argusframe.sources import signatures

T = policy.Thresholds()
MOST_BYTES = 30_000


def executable_head() -> bytes:
    """A minimal unsigned 64-bit executable that imports one function; what follows it is its overlay."""
    rva = 0x1000
    body = bytearray(0x200)
    struct.pack_into("<5I", body, 0x00, rva + 0x40, 0, 0, rva + 0x80, rva + 0x60)
    struct.pack_into("<Q", body, 0x40, rva + 0x90)
    body[0x80:0x8D] = b"KERNEL32.dll\0"
    body[0x92:0x9E] = b"CreateFileW\0"
    directories = [(0, 0), (rva, 0x28)] + [(0, 0)] * 14
    optional = struct.pack("<H2B5I", 0x20B, 14, 0, 512, 0, 0, rva, rva) + struct.pack(
        "<Q2I6H4I2H4Q2I", 0x140000000, 4096, 512, 6, 0, 0, 0, 6, 0, 0, 8192, 0x200, 0, 3, 0x160, 1, 1, 1, 1, 0, 16
    )
    optional += b"".join(struct.pack("<2I", *d) for d in directories)
    coff = struct.pack("<2H3I2H", 0x8664, 1, 1234, 0, 0, len(optional), 0x22)
    section = struct.pack("<8s4I12xI", b".text", 0x200, rva, 0x200, 0x200, 0x60000020)
    head = struct.pack("<14H8x2H20xI", 0x5A4D, *[0] * 15, 0x40) + b"PE\0\0" + coff + optional + section
    return head.ljust(0x200, b"\0") + bytes(body)


HEAD = executable_head()


def files(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """Documents as files: four of five are executables with the text as overlay, the others the text alone; some
    are missing, and the longest too large. ``more`` are columns besides."""
    d = F.col("doc_id")
    text = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    content = F.when(d % 5 != 1, F.concat(F.unhex(F.lit(HEAD.hex())), text)).otherwise(text)
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (d % 13 != 12).alias("exists"), F.lit(True).alias("is_file"), F.lit(True).alias("readable"), content.alias("content"), *more
    )
    found, base = F.col("exists"), ["doc_id", "exists", "is_file", "readable", "content"]
    return rows.select(
        "doc_id", "exists", "is_file", "readable", F.when(found, F.octet_length("content").cast("long")).alias("length"),
        F.when(found, F.col("content")).alias("content"), F.when(found, F.sha2("content", 256)).alias("sha256"),
        *[c for c in rows.columns if c not in base]
    )


def by_size(parsed: DataFrame) -> DataFrame:
    """A scorer whose score SQL can tell: the first feature is the size."""
    return parsed.select("doc_id", (F.col("features")[0].cast("double") / 8000.0).alias("static_score"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What else is known of each file: length of its trace and scores of the other models, by arithmetic."""
    d = F.col("doc_id")
    unit = lambda k: (d * k % 10007).cast("double") / 10007.0
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.when(d % 3 == 0, d % 140).alias("n_calls"), unit(104729).alias("behavioral_score"), F.when(d % 11 == 0, unit(31)).alias("memory_score"),
        F.when(d % 7 != 0, unit(1299709)).alias("network_score")
    )


def scanned(spark: SparkSession, sf_dir: str, score=by_size, seen: DataFrame | None = None) -> DataFrame:
    digests = files(spark, sf_dir).where("doc_id % 17 = 3").select("sha256")
    rows = scan.with_static(files(spark, sf_dir), "doc_id", score, digests, most=MOST_BYTES, seen=seen)
    return scan.decide_scans(rows.join(signals(spark, sf_dir), "doc_id"), T, {"network": True})


def q90_file_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes to decisions: an unsigned executable gets a verdict, not an error."""
    return scanned(spark, sf_dir).select(
        "doc_id", "static", "behavioral", "memory", "network", "final_decision", F.array_join("reason_codes", ",").alias("reason_codes")
    )


def q91_signature_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = signatures.with_trust(files(spark, sf_dir), "doc_id")
    return found.groupBy(F.coalesce("trust", F.lit("no file")).alias("trust")).agg(F.count("*").alias("n"))


def q92_warning_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings made by wrapping known parts and some that are none, brought to their known forms."""
    known = F.array(*map(F.lit, WARNINGS))
    i = (F.col("doc_id") % (len(WARNINGS) + 5)).cast("int")
    one = F.get(known, i)
    made = F.when(one.isNull(), F.concat(F.lit("unheard of "), F.col("doc_id").cast("string"))).when(
        F.startswith(one, F.lit(DOTS)), F.concat(F.lit("section 7: "), F.expr("substring(w, 4)"))
    ).otherwise(F.concat(F.expr("substring(w, 1, length(w) - 3)"), F.col("doc_id").cast("string")))
    rows = table(spark, sf_dir, "documents").withColumn("w", one).select(made.alias("w"))
    return rows.groupBy(F.coalesce(normalised(F.col("w")), F.lit("unknown")).alias("form")).agg(F.count("*").alias("n"))


def q97_listed_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents of each source a list of digests holds: filter first, exact look-up of what passes."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("source", F.sha2("text", 256).alias("sha256"))
    with scratch() as held:
        known = membership.of(docs.where(F.col("source").isin("src3", "src7")))
        flagged = materialize(policy.allowlisted(docs, known), "flagged")
        held.pass_on(flagged)
    return flagged.groupBy("source").agg(F.count("*").alias("n"), F.count_if("is_allowlisted").alias("n_listed"))


def q93_worst_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_extendedprice") * F.col("l_discount")).alias("a"), (F.col("l_extendedprice") * F.col("l_tax")).alias("b")
    )
    return metrics.worst_row(rows, ["l_orderkey", "l_linenumber"])


def q94_prevalence_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``1 in N`` of each event type's share."""
    events = table(spark, sf_dir, "events")
    counted = events.groupBy("event_type").agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    shares = counted.join(F.broadcast(total)).select("event_type", (F.col("n") / (F.col("total") * 1000)).alias("share"))  # one row
    return shares.select("event_type", C.odds_label(F.col("share")).alias("odds"))


def evaluated(spark: SparkSession, sf_dir: str) -> dict:
    """Line items as scored rows of each signal."""
    rows = table(spark, sf_dir, "lineitem").select(
        (
            F.col("l_orderkey") * 10 + F.col("l_linenumber")
        ).alias("id"), F.when(F.col("l_linestatus") == "O", "val").otherwise("test").alias("split"), (F.col("l_returnflag") == "R").cast("int").alias("label"),
        (F.col("l_quantity") / 50.0).alias("score"), (F.col("l_orderkey") % 150).alias("n_calls"),
    )
    return {name: lambda: rows for name in evaluators.EVALUATORS}


def q95_signal_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two signals picked by name: one cut for one, bands and totals for the other."""
    out = evaluators.evaluate(evaluated(spark, sf_dir), T, ["static", "behavioral"])
    return out.select("signal", "part", "split", "n", "tn", "fp", "fn", "tp", F.round("auc", 9).alias("auc"))


def m05_trained_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files under a detector fitted on their own feature vectors: trained, calibrated, then decided. Each file
    is parsed once: what is trained on is scored too."""
    label = (F.col("n_chars") > 600).cast("int").alias("label")
    split = F.when(F.col("doc_id") % 10 < 6, "train").when(F.col("doc_id") % 10 < 8, "val").otherwise("cal").alias("split")
    held = files(spark, sf_dir, label, split).where("content IS NOT NULL").withColumn("skip", F.lit(False))
    seen = scan.examined(held, "doc_id", carry=["label", "split"])
    detector = models.train(seen.where("is_pe"), ["vector"], rounds=5, depth=3)
    out = scanned(spark, sf_dir, lambda parsed: detector.score(parsed).select("doc_id", F.col("score").alias("static_score")), seen)
    return out.select("doc_id", "static_score", "static", "final_decision", F.array_join("reason_codes", ",").alias("reason_codes"))


QUERIES = {
    f.__name__: f for f in (
        q90_file_decisions, q91_signature_trust, q92_warning_forms, q93_worst_rows, q94_prevalence_labels, q95_signal_reports, q97_listed_digests, m05_trained_scan
    )
}
FILES = f"""files AS (SELECT doc_id, doc_id % 13 <> 12 AS found, doc_id % 5 <> 1 AS pe, octet_length(encode(coalesce(text, ''))) + CASE WHEN doc_id % 5 <> 1 THEN {len(HEAD)} ELSE 0 END AS length,
  concat(doc_id % 5 <> 1, coalesce(text, '')) AS bytes FROM documents),
 listed AS (SELECT DISTINCT bytes FROM files WHERE found AND doc_id % 17 = 3),
 a AS (SELECT *, bytes IN (SELECT bytes FROM listed) AS is_listed, CASE WHEN NOT found THEN 'path_not_found' WHEN length > {MOST_BYTES} THEN 'file_too_large' WHEN NOT pe THEN 'invalid_or_non_pe_file' END AS problem,
  length / 8000.0::DOUBLE AS score, CASE WHEN doc_id % 3 = 0 THEN doc_id % 140 END AS n_calls, CAST(doc_id * 104729 % 10007 AS DOUBLE) / 10007.0 AS bs,
  CASE WHEN doc_id % 11 = 0 THEN CAST(doc_id * 31 % 10007 AS DOUBLE) / 10007.0 END AS ms, CASE WHEN doc_id % 7 <> 0 THEN CAST(doc_id * 1299709 % 10007 AS DOUBLE) / 10007.0 END AS ns FROM files),
 b AS (SELECT *, CASE WHEN problem IS NOT NULL THEN 'ERROR' WHEN is_listed OR score < {T.static_allow}::DOUBLE THEN 'ALLOW' WHEN score < {T.static_block}::DOUBLE THEN 'ALERT' ELSE 'BLOCK' END AS static FROM a),
 c AS (SELECT *, CASE WHEN static = 'ERROR' OR n_calls IS NULL THEN 'NOT_PROVIDED' WHEN n_calls < 10 THEN 'PENDING' WHEN bs >= {T.behavioral}::DOUBLE THEN 'MALICIOUS' ELSE 'BENIGN' END AS behavioral,
  CASE WHEN ms IS NULL THEN 'NOT_PROVIDED' WHEN ms >= {T.memory}::DOUBLE THEN 'MALICIOUS' ELSE 'BENIGN' END AS memory, CASE WHEN ns IS NULL THEN 'NOT_PROVIDED' WHEN ns >= {T.network}::DOUBLE THEN 'MALICIOUS' ELSE 'BENIGN' END AS network FROM b),
 f AS (SELECT *, {DECISION} AS final_decision FROM c)"""
LISTED = ", ".join("'" + w.replace("'", "''") + "'" for w in WARNINGS)
PARTS = [
    ("static", "allow_boundary", T.static_allow, "true"), ("static", "block_boundary", T.static_block, "true"),
    ("behavioral", "band:too_short", T.behavioral, "k < 10"), ("behavioral", "band:short", T.behavioral, "k >= 10 AND k < 100")
]
PARTS += [
    ("behavioral", "band:ok+truncated", T.behavioral, "k >= 100"), ("behavioral", "deployment_total", T.behavioral, "k >= 10"),
    ("behavioral", "model_raw_total", T.behavioral, "true")
]
EVALUATED = " UNION ALL ".join(
    f"""(WITH x AS (SELECT *, rank() OVER (PARTITION BY split ORDER BY score) + (count(*) OVER (PARTITION BY split, score) - 1) / 2.0::DOUBLE AS ar FROM r WHERE {where}),
 y AS (SELECT split, count(*) AS n, count(*) FILTER (label = 0 AND score < {cut}::DOUBLE) AS tn, count(*) FILTER (label = 0 AND score >= {cut}::DOUBLE) AS fp, count(*) FILTER (label = 1 AND score < {cut}::DOUBLE) AS fn,
  count(*) FILTER (label = 1 AND score >= {cut}::DOUBLE) AS tp, count(*) FILTER (label = 1)::DOUBLE AS p, count(*) FILTER (label = 0)::DOUBLE AS q, sum(ar) FILTER (label = 1) AS w FROM x GROUP BY split)
 SELECT '{signal}' AS signal, '{part}' AS part, split, n, tn, fp, fn, tp, round((w - p * (p + 1) / 2) / nullif(p * q, 0), 9) AS auc FROM y)"""
    for signal, part, cut, where in PARTS
)
ORACLE_SQL = {
    "q90_file_decisions": f"""WITH {FILES} SELECT doc_id, static, behavioral, memory, network, final_decision, concat_ws(',', problem, CASE WHEN problem IS NULL AND is_listed THEN 'static_allowlisted_nsrl' END,
 CASE WHEN behavioral IN ('BENIGN', 'MALICIOUS') AND n_calls < 100 THEN 'behavioral_short_trace' END, {REASONS}) AS reason_codes FROM f""",
    "q91_signature_trust": "SELECT CASE WHEN doc_id % 13 = 12 THEN 'no file' WHEN doc_id % 5 = 1 THEN 'parse_error' ELSE 'not_signed' END AS trust, count(*) AS n FROM documents GROUP BY 1",
    "q92_warning_forms": f"""WITH k AS (SELECT [{LISTED}][doc_id % {len(WARNINGS) + 5} + 1] AS w FROM documents) SELECT coalesce(w, 'unknown') AS form, count(*) AS n FROM k GROUP BY 1""",
    "q97_listed_digests": "WITH l AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE source IN ('src3', 'src7')), d AS (SELECT source, sha256(text) IN (SELECT h FROM l) AS is_in FROM documents WHERE text IS NOT NULL) SELECT source, count(*) AS n, count(*) FILTER (is_in) AS n_listed FROM d GROUP BY source",
    "q93_worst_rows": "SELECT l_orderkey, l_linenumber, l_extendedprice * l_discount AS a, l_extendedprice * l_tax AS b, abs(l_extendedprice * l_discount - l_extendedprice * l_tax) AS gap FROM lineitem ORDER BY gap DESC, l_orderkey, l_linenumber LIMIT 1",
    "q94_prevalence_labels": "SELECT event_type, '1 in ' || format('{:,}', round_even(1 / (count(*)::DOUBLE / (sum(count(*)) OVER () * 1000)), 0)::BIGINT) AS odds FROM events GROUP BY event_type",
    "q95_signal_reports": f"WITH r AS (SELECT CASE WHEN l_linestatus = 'O' THEN 'val' ELSE 'test' END AS split, CAST(l_returnflag = 'R' AS INT) AS label, l_quantity / 50.0::DOUBLE AS score, l_orderkey % 150 AS k FROM lineitem) {EVALUATED}",
}
