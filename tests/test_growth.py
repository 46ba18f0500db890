"""Steps whose largest task must not grow with a table: looked at in plans, partitions and files."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import functions as F

from argusframe import models
from argusframe.checkpoints import materialize
from argusframe.functions import byteops
from argusframe.operators import scan, splits
from argusframe.operators import sequences as encoded
from argusframe.plans import decisions, groups, roundtrips, scans, sequences
from argusframe.sources import pe, pushdown
from oracle import SF


def test_a_source_is_written_by_more_than_one_task(spark, tmp_path, monkeypatch):
    """Before, all rows of a source went to one task; and a cut through a character of two bytes was an error."""
    text = F.concat(F.repeat(F.lit("é"), F.col("id").cast("int") % 9 + 1), F.lit(" text"))
    spark.range(0, 40, 1, 4).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("src1").alias("source")).write.parquet(f"{tmp_path}/documents.parquet")
    seen, read = [], pushdown.read_heads

    def watched(session, path):
        heads = read(session, path)
        seen.append(heads.where("path LIKE '%.txt'").count())
        return heads

    monkeypatch.setattr(pushdown, "read_heads", watched)
    got = roundtrips.s14_file_heads(spark, str(tmp_path)).collect()
    wanted = sum(len(f"src1 {'é' * (i % 9 + 1)} text\n".encode()) for i in range(40))
    assert seen[0] > 1 and [tuple(r) for r in got] == [("src1", wanted, 1)]


def test_constants_are_not_multiplied_by_partitions(spark):
    product = decisions.verdict_product(spark)
    assert product.rdd.getNumPartitions() == 1 and product.count() == product.distinct().count() == 320


def test_flows_are_counted_before_they_are_joined(spark, tmp_path):
    """Copies of flows add to counts, not to the rows that are split."""
    rows = spark.range(0, 4000, 1, 4).select(
        F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit("O").alias("l_linestatus"), F.when(F.col("id") % 10 == 3, "R").otherwise("N").alias("l_returnflag"),
        (F.col("id") % 10).cast("double").alias("l_quantity"), F.lit(0.1).alias("l_discount"), F.lit(0.2).alias("l_tax"), F.lit(5).alias("l_partkey")
    )
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    held = groups._split_rows(spark, str(tmp_path))
    assert held.count() == 10 and held.agg(F.sum("n")).first()[0] == 4000
    sizes = {r.split: r.n for r in groups.q40_split_report(spark, str(tmp_path)).collect()}
    assert sum(sizes.values()) == 4000


def test_ends_of_few_buckets_are_broadcast(spark):
    """One bucket with all rows is no key to shuffle by."""
    orders = spark.range(0, 3000, 1, 4).select(F.col("id").alias("key"), F.lit("all").alias("bucket"), F.lit(1).alias("size"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the table were too large to be broadcast unmeasured
    try:
        split = splits.allocate(orders, ["bucket"], ["key"], "size", "42")
        plan = split._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan or "BroadcastNestedLoopJoin" in plan
        assert "SortMergeJoin" not in plan and "hashpartitioning(bucket" not in plan
        assert {r.split: r["count"] for r in split.groupBy("split").count().collect()} == {"val": 300, "test": 300, "cal": 600, "train": 1800}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_files_of_a_trained_scan_are_parsed_once(spark, monkeypatch):
    """Before, vectors were made for the training and made again for the scan, and dense ones were joined by a shuffle."""
    passes = []
    for module, name in ((scan, "examined"), (pe, "pe_features")):
        monkeypatch.setattr(module, name, lambda *a, _f=getattr(module, name), _n=name, **k: passes.append(_n) or _f(*a, **k))
    rows = scans.m05_trained_scan(spark, SF).where("static_score IS NOT NULL")
    assert passes == ["examined"] and rows.count() > 50


def test_vectors_are_stored_sparse(spark):
    """What a scorer is given equals the dense vector, and a file to skip has none."""
    made = [pe.vector(scans.HEAD + b"some words of text " * k)[1] for k in range(1, 4)]
    parts = pe.sparse_vectors([made[0], None, made[1]])
    assert len(pe.sparse_vectors([])) == 0 and pe.sparse_vectors([None]).null_count == 1
    assert all(np.array_equal(np.bincount(p["indices"], p["values"], p["size"]).astype(np.float32), v) for p, v in zip(parts.to_pylist()[::2], made, strict=False))
    assert len(parts[0]["values"]) < pe.DIMENSIONS / 4 and pa.types.is_struct(parts.type)
    files = spark.createDataFrame([(k, scans.HEAD + b"some words of text " * k, k == 3) for k in range(1, 4)] + [(4, b"no executable", False)], "doc_id long, content binary, skip boolean")
    seen = {r.doc_id: r for r in scan.examined(files, "doc_id", carry=["skip"]).collect()}
    assert np.array_equal(seen[2].vector.toArray().astype(np.float32), made[1]) and seen[3].is_pe and seen[3].vector is None and not seen[4].is_pe and seen[3].skip


def test_places_without_a_difference_are_not_trained_on(spark):
    """Of a wide vector only places that differ are binned and kept in memory; margins are those of all places."""
    varied = [F.col("id") % 7, F.col("id") % 5, (F.col("id") * 31 % 11)]
    wide = [F.lit(3.0), varied[0], F.lit(0.0), varied[1], *[F.lit(float(k)) for k in range(50)], varied[2]]
    rows = spark.range(0, 600, 1, 4).select(
        "id", F.array(*[c.cast("float") for c in wide]).alias("features"), *[c.cast("double").alias(f"x{i}") for i, c in enumerate(varied)],
        ((F.col("id") % 7 > 3) | (F.col("id") % 5 == 1)).cast("int").alias("label"), F.element_at(F.array(*map(F.lit, ["train", "train", "val", "cal"])), (F.hash("id") % 4 + 4).cast("int") % 4 + 1).alias("split")
    )
    rows = materialize(rows, "wide")
    one, other = models.train(rows, ["features"], rounds=3, depth=2), models.train(rows, ["x0", "x1", "x2"], rounds=3, depth=2)
    assert one.kept == [1, 3, len(wide) - 1] and one.trees.numFeatures == 3
    margins = [[r.margin for r in d.margins(rows).orderBy("id").collect()] for d in (one, other)]
    assert margins[0] == margins[1] and len(set(margins[0])) > 2
    assert isinstance(models.with_vector(rows, ["features"], one.kept).schema["_x"].dataType, VectorUDT)


def test_a_model_of_kept_places_is_saved_with_them(spark, tmp_path):
    rows = materialize(spark.range(0, 200, 1, 2).select(
        F.array(F.lit(1.0), (F.col("id") % 3).cast("double")).alias("f"), (F.col("id") % 3 == 1).cast("int").alias("label"),
        F.when(F.col("id") % 4 == 0, "cal").when(F.col("id") % 4 == 1, "val").otherwise("train").alias("split")
    ), "narrow")
    made = models.train(rows, ["f"], rounds=2, depth=1)
    made.save(str(tmp_path / "m"))
    again = models.Detector.load(spark, str(tmp_path / "m"))
    assert again.kept == made.kept == [1] and again.fingerprint() == made.fingerprint()
    assert [r.margin for r in again.margins(rows).collect()] == [r.margin for r in made.margins(rows).collect()]


def test_flows_are_written_as_one_field_a_line(spark, tmp_path):
    """The files equal those of a writer that is given all 80 cells, which took most of the time, null and missing ones too."""
    rows = spark.range(-5, 60, 1, 3).select(F.when(F.col("id") != 7, F.col("id")).alias("l_orderkey"), (F.col("id") % 4).alias("l_linenumber"))
    cells = roundtrips.flow_cells()
    roundtrips.write_flows(rows, cells, f"{tmp_path}/lines")
    each = [(F.lit(c) if isinstance(c, str) else c).alias(n) for n, c in cells.items()]
    rows.select(*each).write.option("header", True).option("emptyValue", "").csv(f"{tmp_path}/cells")
    told = [sorted(f.read_bytes() for f in (tmp_path / kind).glob("part-*.csv")) for kind in ("lines", "cells")]
    assert told[0] == told[1] and len(told[0]) == 3


def test_words_are_counted_in_tasks_and_only_first_ones_kept(spark, tmp_path, monkeypatch):
    """Before, all words of a document were kept beside its first 64 ids, and each was a row before it was counted."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda k: letters[k % 26] + letters[k // 26 % 26] * (k % 3 + 1)
    texts = [lead.join(["", *map(word, range(n))]) + end for n in (0, 1, 63, 64, 65, 66, 400) for lead, end in ((" ", ""), ("-É\u0130\u212a ", "!"))]
    texts += [" ".join(map(word, range(n))) + end for n in (1, 63, 64, 65, 66, 67, 700) for end in ("", ".")] + [None, "", "...", "\u212aelvin K Straße"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    low = docs.select(F.lower(F.coalesce("text", F.lit(""))).alias("t"))
    words = [[w for w in re.split("[^a-z]+", r.t) if w] for r in low.collect()]
    counts = Counter(w for ws in words for w in ws)
    found: Counter = Counter()
    for r in byteops.word_counts(low, "t").collect():
        found[r.token] += r.n
    assert found == counts
    kept, write = [], encoded.materialize
    monkeypatch.setattr(encoded, "materialize", lambda df, label: kept.append((label, write(df, label))) or kept[-1][1])
    encode = encoded.encode
    monkeypatch.setattr(encoded, "encode", lambda rows, vocab, length, heavy: encode(rows, vocab, length, heavy=5))
    got = {r.doc_id: r.ids for r in sequences.q98_encode_words(spark, str(tmp_path)).collect()}
    rank = {w: i + 2 for i, w in enumerate(sorted((w for w in counts if counts[w] >= 2), key=lambda w: (-counts[w], w)))}
    assert got == {i: ",".join(str(rank.get(w, 1)) for w in ws[:64]) + ",0" * (64 - len(ws)) if ws else ",".join(["0"] * 64) for i, ws in enumerate(words)}
    assert all(t.agg(F.max(F.size("tokens"))).first()[0] <= 64 for label, t in kept if label == "encoded") and len(kept) > 1
