"""A scan from a file's bytes to one decision: path, digest, format, allowlist, features, model, gates, ladder.

Every stage adds columns; only bytes that need it are parsed, and only parsed rows are scored. The score comes
from the caller: a function from a table with ``features`` to one with ``static_score`` (a fitted Detector, or any
expression). A model that raises on a row makes that row's verdict an error, and a model that isn't there a neutral
one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argusframe.checkpoints import materialize, scratch
from argusframe.operators import membership, policy
from argusframe.sources import pe, signatures

SHORT_TRACE = 100


def guarded(predict: Callable[[np.ndarray], np.ndarray]) -> Callable[[Column], Column]:
    """A column function from feature arrays to struct(score, failed). ``predict`` is given a matrix; where it
    raises, its rows are tried one by one, and those that raise again, or give no finite number, have failed."""

    @F.pandas_udf("score double, failed boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            given = rows.notna().to_numpy()
            scores, failed = np.full(len(rows), np.nan), np.zeros(len(rows), bool)
            if given.any():
                matrix = np.stack(rows[given].to_list())
                try:
                    scores[given] = predict(matrix)
                except Exception:  # one row's harm must not be all rows'
                    for i, row in zip(np.flatnonzero(given), matrix, strict=True):
                        try:
                            scores[i] = predict(row[None])[0]
                        except Exception:
                            failed[i] = True
                failed |= given & ~np.isfinite(scores)
            yield pd.DataFrame({"score": np.where(np.isfinite(scores), scores, np.nan), "failed": failed}).astype({"score": "Float64"}, errors="ignore")

    return run


def manifest(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted paths with what a listing holds of them: exists, is_file, readable, length, content, sha256. A path
    that no file has, but lies above one, is a folder; one that neither has does not exist."""
    bare = lambda c: F.regexp_replace(c, "^file:/*", "/")
    held = files.select(bare(F.col("path")).alias("_path"), "length", "content", "sha256")
    steps = F.split("_path", "/")
    above = held.select(
        F.explode(F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))).alias("_folder")
    ).distinct()
    asked = wanted.select("path", bare(F.col("path")).alias("_asked"))
    found = asked.join(held, F.col("_asked") == F.col("_path"), "left").join(above, F.col("_asked") == F.col("_folder"), "left")
    is_file, is_folder = F.col("_path").isNotNull(), F.col("_folder").isNotNull()
    return found.select(
        "path", (is_file | is_folder).alias("exists"), is_file.alias("is_file"), (~is_file | F.col("length").isNotNull()).alias("readable"), "length",
        "content", "sha256"
    )


def examined(files: DataFrame, key: str, verify=None, carry: Sequence[str] = ()) -> DataFrame:
    """key, is_pe, trust, vector, degraded of a table of key, content and skip, and its columns to carry, in one pass over
    the bytes, stored. Of a file to skip, or one whose signature is verified, only the format is told. Vectors are
    sparse, since few of the 2,568 features of a file are set."""

    def one(data: bytes, skip: bool) -> tuple:
        try:
            pe.parse(data)
        except pe.NotPE:
            return False, None, None, None
        if skip:
            return True, None, None, None
        found = signatures.trust(data, verify)
        if found == "verified":
            return True, found, None, None
        return True, found, *pe.vector(data)[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                cut = batch.slice(i, 64)
                made = (one(data, skip) for data, skip in zip(cut.column(1).to_pylist(), cut.column(2).to_pylist(), strict=True))
                ok, found, features, degraded = zip(*made, strict=True)
                arrays = [cut.column(0), pa.array(ok, pa.bool_()), pa.array(found, pa.string()), pe.sparse_vectors(features), pa.array(degraded, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*arrays, *cut.columns[3:]], names=[*names, *carry])

    names, kind = [key, "is_pe", "trust", "vector", "degraded"], lambda c: f"`{c}` {files.schema[c].dataType.simpleString()}"
    schema = ", ".join([kind(key), f"is_pe boolean, trust string, vector {pe.SPARSE}, degraded array<string>", *map(kind, carry)])
    return materialize(files.select(key, "content", "skip", *carry).mapInArrow(run, schema), "examined", {"vector": VectorUDT()})


def with_static(
    files: DataFrame, key: str, score: Callable[[DataFrame], DataFrame], digests: DataFrame | membership.Artifact | None = None, verify=None, most: int = policy.MAX_FILE_BYTES,
    seen: DataFrame | None = None
) -> DataFrame:
    """``files`` (key, exists, is_file, readable, length, content, sha256) without content, but with problem,
    allowlist_reason, is_pe, degraded and static_score. A file must be executable before any list is asked. ``score`` is
    given features as a list of numbers, and as a sparse vector. ``seen`` is what ``examined`` told of all the contents,
    where that is known already: they are not parsed again.

    Contents are read once and never shuffled. Whether a file is listed is found from keys and digests; the pass over
    contents knows it by two filters: what the list's filter turns away is parsed, and so is what a second filter holds
    of the digests that passed the first but aren't listed. A listed file is parsed only if it meets one of its bits by chance.
    """
    rows = files.withColumn("problem", policy.path_problem(F.col("exists"), F.col("is_file"), F.col("readable"), F.col("length"), most))
    rows = rows.withColumn("problem", F.coalesce("problem", F.when(F.col("content").isNull(), "unreadable")))
    fine, digest = F.col("problem").isNull(), membership.normal(F.col("sha256"))
    with scratch() as held:
        if digests is None:
            flags, skip = None, F.lit(False)
        else:
            known = membership.of(digests)
            asked = materialize(rows.where(fine).select(key, digest.alias("digest")).where(known.filter.possible(F.col("digest"))), "asked")
            listed = materialize(known.listed(asked), "listed")
            flags = materialize(asked.join(listed, "digest", "left_semi").select(key, F.lit(True).alias("_listed")), "listed-keys")
            if seen is None:
                strays = materialize(asked.join(listed, "digest", "left_anti").select("digest").distinct(), "strays")
                again = membership.Filter.of(strays, strays.count())
                again = membership.Filter(materialize(again.words, "stray-filter"), again.bits)
                skip = F.coalesce(known.filter.possible(digest) & ~again.possible(digest), F.lit(False))
        if seen is None:
            seen = examined(rows.where(fine).withColumn("skip", skip), key, verify)
        held.pass_on(seen, flags)
    vectors = seen.where("vector IS NOT NULL").select(key, "vector", vector_to_array("vector", "float32").alias("features"))
    scored = score(vectors).select(key, "static_score")
    told = seen.select(key, "is_pe", "trust", "degraded")
    out = rows.drop("content").join(told, key, "left").join(scored, key, "left").withColumn("is_pe", F.when(fine, F.col("is_pe")))
    out = out.join(flags, key, "left").withColumn("is_allowlisted", F.col("_listed").isNotNull()).drop("_listed") if flags is not None else out.withColumn("is_allowlisted", F.lit(False))
    out = out.withColumn("problem", F.coalesce("problem", F.when(~F.col("is_pe"), "invalid_or_non_pe_file")))
    fine = F.col("problem").isNull()
    reason = F.when(fine & F.col("is_allowlisted"), "static_allowlisted_nsrl").when(fine & (F.col("trust") == "verified"), "static_allowlisted_authenticode_chain")
    out = out.withColumn("allowlist_reason", reason)
    no_groups = F.array().cast("array<string>")
    used = fine & F.col("allowlist_reason").isNull()
    return out.withColumn("static_score", F.when(used, F.col("static_score"))).withColumn(
        "degraded", F.when(used, F.coalesce("degraded", no_groups)).otherwise(no_groups)
    )


def decide_scans(rows: DataFrame, t: policy.Thresholds, configured: dict[str, bool] | None = None) -> DataFrame:
    """``rows`` of ``with_static`` plus n_calls, behavioral_score, memory_score, network_score with the four verdicts,
    final_decision, reason_codes and signal_health. A supplied signal whose model isn't configured is neutral, and
    told; a NaN score says that its model raised."""
    has = {s: True for s in policy.SIGNALS} | (configured or {})
    fine = F.col("problem").isNull()
    scored = F.when(F.col("static_score").isNull(), "ERROR").otherwise(policy.static_verdict(F.col("static_score"), t))
    rows = rows.withColumn("static_first", F.when(~fine, "ERROR").when(F.col("allowlist_reason").isNotNull(), "ALLOW").otherwise(scored))
    behavioral = policy.behavioral_verdict(F.col("static_first"), F.col("n_calls"), F.col("behavioral_score"), t)
    rows = rows.withColumn("behavioral", behavioral if has["behavioral"] else F.lit("NOT_PROVIDED"))
    rows = rows.withColumn("static", policy.critical_override(F.col("static_first"), F.col("degraded")))
    for name, cut in (("memory", t.memory), ("network", t.network)):
        rows = rows.withColumn(name, policy.binary_verdict(F.col(f"{name}_score"), cut) if has[name] else F.lit("NOT_PROVIDED"))
    rows = policy.with_decision(rows)
    raised = fine & F.col("allowlist_reason").isNull() & F.col("static_score").isNull()
    short = F.col("behavioral").isin("BENIGN", "MALICIOUS") & (F.col("n_calls") < SHORT_TRACE)
    early = [
        F.col("problem"), F.col("allowlist_reason"), F.when(raised, "static_scan_exception"), F.when(short, "behavioral_short_trace"),
        F.when((F.col("static") == "ERROR") & (F.col("static_first") != "ERROR"), "static_features_degraded")
    ]
    rows = rows.withColumn("reason_codes", F.concat(F.array_compact(F.array(*early)), "reason_codes"))
    supplied = {
        "behavioral": F.col("n_calls").isNotNull() & F.col("static_first").isin("ALLOW", "ALERT", "BLOCK"), "memory": F.col("memory_score").isNotNull(),
        "network": F.col("network_score").isNotNull()
    }
    states = [F.struct(F.lit("static").alias("key"), F.when(F.size("degraded") > 0, "degraded").alias("value"))]
    for name, is_given in supplied.items():
        state = F.when(F.col(name) == "ERROR", "model_error").when(is_given & F.lit(not has[name]), "model_not_configured")
        states.append(F.struct(F.lit(name).alias("key"), state.alias("value")))
    health = F.map_from_entries(F.filter(F.array(*states), lambda e: e["value"].isNotNull()))
    return rows.withColumn("signal_health", health).drop("static_first")
