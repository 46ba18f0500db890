"""Training and streaming by their invariants."""

import numpy as np
from oracle import SF
from pyspark.sql import functions as F

from argusframe import models
from argusframe.checkpoints import materialize
from argusframe.operators import metrics, policy
from argusframe.plans import learned
from argusframe.streaming import scoring


def test_train_calibrate_threshold(spark, tmp_path):
    rows = materialize(learned.labelled(spark, SF), "rows")
    assert rows.groupBy("l_orderkey").agg(F.count_distinct("split").alias("n")).where("n > 1").isEmpty()
    detector = models.train(rows, learned.FEATURES, rounds=4, depth=2)
    scored = materialize(detector.score(rows), "scored")
    cal = scored.where("split = 'cal'")
    assert 0 <= metrics.auc(cal).first().auc <= 1
    got = metrics.thresholds_for_fpr(cal, [0.05]).first()
    assert got.fp <= 0.05 * got.n_benign
    assert abs(cal.agg(F.avg("score") - F.avg("label")).first()[0]) < 0.02  # calibrated in the mean
    detector.save(str(tmp_path / "m"))
    again = models.Detector.load(spark, str(tmp_path / "m"))
    assert again.fingerprint() == detector.fingerprint()
    ours, theirs = (sorted(r.score for r in x.select("score").collect()) for x in (scored, again.score(rows)))
    assert np.allclose(ours, theirs, rtol=0, atol=1e-12)


def test_sequence_net_masks_padding_in_attention_and_pooling():
    net = models.SequenceNet.initial(20, 20, 16, heads=4, seed=1)
    ids = np.zeros((1, 20), int)
    ids[0, :5] = range(2, 7)
    states, real = net.attended(ids), (ids != 0)[:, :, None]
    masked, full = (states * real).sum(1) / real.sum(1), states.mean(1)
    assert np.allclose(net.margins(ids), net.classify(masked)) and not np.allclose(net.margins(ids), net.classify(full), atol=1e-4)
    # what stands at padded places can be no key: changing their places' embedding beyond the convolutions' reach does nothing
    moved = models.SequenceNet(net.w | {"place": np.concatenate([net.w["place"][:13], net.w["place"][13:] + 5])}, 4)
    assert np.allclose(moved.margins(ids), net.margins(ids), atol=1e-5)
    assert np.isfinite(net.margins(np.zeros((2, 20), int))).all()


def test_sequence_net_without_padding_is_unmasked():
    net = models.SequenceNet.initial(20, 10, 16, heads=2, seed=2)
    ids = np.random.default_rng(0).integers(1, 20, (3, 10))
    assert np.allclose(net.margins(ids), net.classify(net.attended(ids).mean(1)))
    one_by_one = np.concatenate([net.margins(ids[i : i + 1]) for i in range(3)])
    assert np.allclose(one_by_one, net.margins(ids), atol=1e-5)


def test_sequence_net_in_spark(spark):
    net = models.SequenceNet.initial(20, 12, 8, seed=3)
    rows = spark.createDataFrame([(1, [2, 3, 4] + [0] * 9), (2, None), (3, [5] * 12)], "i int, ids array<int>")
    got = {r.i: r for r in net.score(rows).collect()}
    assert got[2].margin is None and got[2].score is None
    assert np.isclose(got[1].margin, net.margins(np.array([[2, 3, 4] + [0] * 9]))[0], atol=1e-5) and 0 < got[3].score < 1


def test_trained_sequences(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        bad = i % 4 == 0
        tokens = [f"t{x}" for x in rng.integers(0, 30, rng.integers(10, 40))]
        if bad:  # an order of common tokens, not a token, tells
            at = int(rng.integers(0, len(tokens) - 2))
            tokens[at : at + 3] = ["t1", "t2", "t3"]
        rows.append((i, int(bad), ("train", "train", "val", "test")[(i // 4) % 4], tokens))
    df = spark.createDataFrame([*rows, (1000, 0, "test", None)], "id int, label int, split string, tokens array<string>")
    found = models.train_sequences(df)
    test = {r.id: r for r in found.score(df.where("split = 'test'")).collect()}
    bad, good = [r.score for r in test.values() if r.label], [r.score for r in test.values() if not r.label]
    assert np.mean([b > g for b in bad for g in good]) > 0.9 and test[1000].score is not None
    assert found.losses[models.STRENGTHS.index(found.strength)] == min(found.losses)



def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(200).select(F.col("id"), (F.col("id") % 101 / 100.0).alias("static_score"), (F.col("id") % 130).alias("n_calls"), (F.col("id") % 77 / 76.0).alias("behavioral_score"), F.when(F.col("id") % 3 > 0, F.col("id") % 7 / 1000.0).alias("memory_score"), (F.col("id") % 11 / 10.0).alias("network_score"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = scoring.run_batches(scoring.decide_stream(stream).select("id", "final_decision", "reason_codes"), lambda df, n: df.write.mode("overwrite").parquet(str(tmp_path / f"out/{n}")), str(tmp_path / "cp"))
    query.awaitTermination(120)
    got = sorted(map(str, spark.read.parquet(str(tmp_path / "out/*")).collect()))
    assert got == sorted(map(str, scoring.decide_stream(rows).select("id", "final_decision", "reason_codes").collect()))
    assert {r.final_decision for r in scoring.decide_stream(rows).collect()} <= {*policy.DECISIONS}


def test_windowed_alerts_close_by_watermark(spark, tmp_path):
    rows = spark.createDataFrame([(i * 60, "ALERT" if i % 2 else "ALLOW") for i in range(60)], "s long, final_decision string").select(F.timestamp_seconds("s").alias("ts"), "final_decision")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = scoring.windowed_alerts(stream).writeStream.outputMode("append").format("memory").queryName("alerts").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table("alerts").collect()
    assert got and all(r.n in (2, 3) for r in got)
