"""From scores to verdicts to one decision with its reasons: an ordered ladder, never an average."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argusframe.checkpoints import materialize
from argusframe.operators import membership

# Verdicts, decisions and reason codes of the decision contract, and the groups of features
# without which a static score does not count.
STATIC = ("ALLOW", "ALERT", "BLOCK", "ERROR")
BEHAVIORAL = ("NOT_PROVIDED", "PENDING", "BENIGN", "MALICIOUS", "ERROR")
OTHER = ("NOT_PROVIDED", "BENIGN", "MALICIOUS", "ERROR")
DECISIONS = ("TERMINATE", "BLOCK", "ALERT", "NEEDS_REVIEW", "ALLOW")
SIGNALS = ("static", "behavioral", "memory", "network")
CRITICAL_GROUPS = ("general", "histogram", "byteentropy", "strings", "header", "section", "imports", "datadirectories", "authenticode")
MAX_FILE_BYTES = 104_857_600


@dataclass(frozen=True)
class Thresholds:
    static_allow: float = 0.4789517595186417
    static_block: float = 0.9811748406902472
    behavioral: float = 0.60
    memory: float = 0.0024964628
    network: float = 0.6672636218
    emulation: float = 0.999358594417572


def load_thresholds(path: str) -> Thresholds:
    """Thresholds of a YAML mapping; anything missing, unreadable or no number is a RuntimeError."""
    import yaml

    try:
        given = yaml.safe_load(Path(path).read_text())
    except (OSError, yaml.YAMLError) as error:
        raise RuntimeError(f"thresholds cannot be read: {path}") from error
    if not isinstance(given, dict):
        raise RuntimeError(f"thresholds are not a mapping: {path}")
    out = {}
    for name in Thresholds.__dataclass_fields__:
        value = given.get(name)
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            raise RuntimeError(f"threshold {name} is missing or no number: {value!r}")
        out[name] = float(value)
    return Thresholds(**out)


def static_verdict(score: Column, t: Thresholds) -> Column:
    return F.when(score.isNull() | F.isnan(score), "ERROR").when(score < t.static_allow, "ALLOW").when(score < t.static_block, "ALERT").otherwise("BLOCK")


def binary_verdict(score: Column, threshold: float) -> Column:
    return F.when(score.isNull(), "NOT_PROVIDED").when(F.isnan(score), "ERROR").when(score >= threshold, "MALICIOUS").otherwise("BENIGN")


def behavioral_verdict(static: Column, n_calls: Column, score: Column, t: Thresholds) -> Column:
    """The gate: only after a static verdict and with a trace; short traces wait."""
    asked = static.isin("ALLOW", "ALERT", "BLOCK") & n_calls.isNotNull()
    return F.when(~F.coalesce(asked, F.lit(False)), "NOT_PROVIDED").when(n_calls < 10, "PENDING").otherwise(
        F.when(score.isNull(), "ERROR").otherwise(binary_verdict(score, t.behavioral))
    )


def corroborators(static: Column, memory: Column, network: Column) -> Column:
    return static.isin("ALERT", "BLOCK").cast("int") + (memory == "MALICIOUS").cast("int") + (network == "MALICIOUS").cast("int")


def decide(static: Column, behavioral: Column, memory: Column, network: Column) -> Column:
    """The first rung that holds decides."""
    bad = lambda c: c == "MALICIOUS"
    error = (static == "ERROR") | (behavioral == "ERROR") | (memory == "ERROR") | (network == "ERROR")
    return (
        F.when(bad(behavioral), "TERMINATE")
        .when((static == "BLOCK") & (bad(memory) | bad(network)), "BLOCK")
        .when(bad(memory) | bad(network) | static.isin("ALERT", "BLOCK"), "ALERT")
        .when(error, "NEEDS_REVIEW")
        .otherwise("ALLOW")
    )


def reasons(static: Column, behavioral: Column, memory: Column, network: Column) -> Column:
    """Codes in their order: what drove the decision, corroborators, errors."""
    decision = decide(static, behavioral, memory, network)
    driver = (
        F.when(decision == "TERMINATE", "behavioral_malicious")
        .when(decision == "BLOCK", "static_block_corroborated")
        .when(memory == "MALICIOUS", "memory_malicious")
        .when(network == "MALICIOUS", "network_malicious")
        .when(static == "BLOCK", "static_block_capped_at_alert")
        .when(static == "ALERT", "static_alert")
        .when(decision == "ALLOW", "no_malicious_evidence")
    )
    blocked = decision == "BLOCK"
    codes = [driver, F.when(blocked & (memory == "MALICIOUS"), "memory_malicious"), F.when(blocked & (network == "MALICIOUS"), "network_malicious")]
    codes.append(F.when(decision.isin("TERMINATE", "BLOCK", "ALERT") & (corroborators(static, memory, network) >= 2), "corroborated_multi_signal"))
    codes += [F.when(v == "ERROR", f"{name}_scan_error") for name, v in zip(SIGNALS, (static, behavioral, memory, network), strict=True)]
    return F.array_compact(F.array(*codes))


def with_decision(scans: DataFrame) -> DataFrame:
    """``scans`` with verdict columns named like the signals, plus final_decision and reason_codes."""
    v = [F.col(s) for s in SIGNALS]
    return scans.withColumn("final_decision", decide(*v)).withColumn("reason_codes", reasons(*v))


def signal_health(configured: dict[str, Column], verdicts: dict[str, Column], degraded: Column) -> Column:
    """A map of the signals that are not well: model_error, model_not_configured or degraded."""
    entries = []
    for name, verdict in verdicts.items():
        state = F.when(~configured[name], "model_not_configured").when(verdict == "ERROR", "model_error")
        if name == "static":
            state = F.coalesce(state, F.when(F.size(degraded) > 0, "degraded"))
        entries.append(F.struct(F.lit(name).alias("key"), state.alias("value")))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))


def critical_override(static: Column, degraded: Column) -> Column:
    """A static verdict on features of which a critical group is degraded is an error."""
    return F.when(F.arrays_overlap(degraded, F.array(*map(F.lit, CRITICAL_GROUPS))), "ERROR").otherwise(static)


def path_problem(exists: Column, is_file: Column, readable: Column, length: Column, most: int = MAX_FILE_BYTES) -> Column:
    """The first thing wrong with a path of a manifest, or null."""
    return F.when(~exists, "path_not_found").when(~is_file, "not_a_file").when(~readable, "unreadable").when(length > most, "file_too_large")


def allowlisted(files: DataFrame, digests: DataFrame | membership.Artifact, on: str = "sha256") -> DataFrame:
    """``files`` with the flag is_allowlisted, for narrow rows: what the list's filter passes is looked up exactly, and
    the few listed digests are joined back. Rows with contents: see ``scan.with_static``."""
    held = membership.of(digests, on)
    found = materialize(held.listed(files.select(membership.normal(F.col(on)).alias("digest"))), "listed")
    listed = found.select(F.col("digest").alias("_digest"))
    return files.join(listed, membership.normal(F.col(on)) == F.col("_digest"), "left").select(*files.columns, F.col("_digest").isNotNull().alias("is_allowlisted"))
