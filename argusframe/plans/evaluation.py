"""Metrics, curves, thresholds and projections over scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argusframe.operators import metrics, prevalence
from argusframe.operators.sequences import early_stopping
from argusframe.plans.tables import CURVE, SCORED, scored, table

CUT = 25.0
TARGETS = [0.001, 0.01, 0.05, 0.25, 0.5]
PPV_TARGETS = [0.0001, 0.0005, 0.001]


def q10_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(scored(spark, sf_dir), CUT)


def q11_three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.three_way(scored(spark, sf_dir), 15.0, 40.0)


def q12_confusion_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(scored(spark, sf_dir), CUT, ["split"])


def q13_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.auc(scored(spark, sf_dir))


def q14_feature_auc_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    columns = {f"f{i:02d}": F.col("embedding")[i] for i in range(64)}
    best = metrics.feature_aucs(rows, columns, (F.col("label") < 5).cast("int"))
    return best.orderBy(F.desc("separation"), "feature").limit(15)


def q15_roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.roc_points(scored(spark, sf_dir))


def q16_threshold_for_fpr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.thresholds_for_fpr(scored(spark, sf_dir), [0.05])


def q17_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.sweep(scored(spark, sf_dir), TARGETS)


def q18_threshold_cliffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    chosen = metrics.thresholds_for_fpr(scored(spark, sf_dir), TARGETS)
    drop = F.lag("threshold").over(W.orderBy("target")) - F.col("threshold")  # a row a target
    return chosen.select("target", "threshold", drop.alias("drop_from_previous"), F.coalesce(drop > 0.1, F.lit(False)).cast("int").alias("is_cliff"))


def q19_threshold_monotone(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    chosen = metrics.thresholds_for_fpr(scored(spark, sf_dir), TARGETS)
    falls = chosen.select((F.lag("threshold").over(W.orderBy("target")) >= F.col("threshold")).alias("ok"))
    return falls.agg(F.coalesce(F.bool_and("ok"), F.lit(True)).cast("int").alias("is_monotone"), F.count("*").alias("n_targets"))


def q20_pr_auc_trapezoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.pr_areas(scored(spark, sf_dir)).select(F.round("pr_auc", 9).alias("pr_auc"))


def q21_average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.pr_areas(scored(spark, sf_dir)).select(F.round("average_precision", 9).alias("average_precision"))


def q22_prevalence_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = metrics.confusion(scored(spark, sf_dir), CUT).select("fp", "tn", "tp", "fn")
    out = prevalence.project(rates)
    return out.select("prevalence", *[F.round(c, 9).alias(c) for c in ("ppv", "alert_rate", "fp_per_10000", "tp_per_10000", "fp_per_100000", "tp_per_100000")])


def q23_threshold_for_ppv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prevalence.threshold_for_ppv(scored(spark, sf_dir), PPV_TARGETS, 0.001)


def q24_per_class_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir)
    support = rows.where("split = 'F'").groupBy("label_raw").agg(F.count("*").alias("n_train"))
    return metrics.per_class_detection(rows, CUT, support)


def q25_error_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("a"), F.col("l_extendedprice").cast("float").cast("double").alias("b"))
    out = metrics.error_statistics(pairs, 50000.0)
    return out.select(
        "n", F.round("max_abs", 9).alias("max_abs"), F.round("mean_abs", 9).alias("mean_abs"), F.round("median_abs", 9).alias("median_abs"), "n_flips",
        "n_ties", F.round("correlation", 6).alias("correlation")
    )


def q26_class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall, F1 and support of either class, and accuracy."""
    c = metrics.confusion(scored(spark, sf_dir), CUT)
    each = F.explode(
        F.array(
            F.struct(F.lit(0).alias("label"), F.col("tn").alias("hit"), F.col("fn").alias("wrong"), F.col("fp").alias("missed")),
            F.struct(F.lit(1).alias("label"), F.col("tp").alias("hit"), F.col("fp").alias("wrong"), F.col("fn").alias("missed"))
        )
    )
    from argusframe.functions.columns import safe_ratio

    rows = c.select(safe_ratio(F.col("tp") + F.col("tn"), F.col("n")).alias("accuracy"), each.alias("c")).select("accuracy", "c.*")
    p, r = safe_ratio(F.col("hit"), F.col("hit") + F.col("wrong")), safe_ratio(F.col("hit"), F.col("hit") + F.col("missed"))
    return rows.select(
        "label", "accuracy", p.alias("precision"), r.alias("recall"), safe_ratio(2 * p * r, p + r).alias("f1"),
        (F.col("hit") + F.col("missed")).alias("support")
    )


def q27_source_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = ((F.col("score") >= CUT).cast("int") == F.col("label")).cast("int")
    return scored(spark, sf_dir).groupBy("label_raw", "label").agg(
        F.count("*").alias("n"), (F.sum(right) / F.count("*")).alias("accuracy"), F.round(F.avg("score"), 9).alias("mean_score")
    )


def q28_band_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion cells in each price band, and their total: the bands the deployed signal covers."""
    price = table(spark, sf_dir, "lineitem")
    band = F.when(F.col("l_extendedprice") < 10000, "low").when(F.col("l_extendedprice") < 50000, "middle").otherwise("high")
    rows = price.select(band.alias("band"), (F.col("l_returnflag") == "R").cast("int").alias("label"), F.col("l_quantity").alias("score"))
    hit = F.col("score") >= CUT
    return rows.rollup("band").agg(
        F.count("*").alias("n"), F.count_if(hit & (F.col("label") == 1)).alias("tp"), F.count_if(hit & (F.col("label") == 0)).alias("fp")
    ).select(F.coalesce("band", F.lit("deployment_total")).alias("band"), "n", "tp", "fp")


LOG = [(i, 0.80 + 0.01 * min(i, 12) + 0.002 * i, 0.79 + 0.011 * min(i, 9)) for i in range(1, 31)]


def q82_early_stopping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return early_stopping(spark.createDataFrame(LOG, "epoch int, train_auc double, val_auc double"))


RATE = "coalesce({0}::DOUBLE / nullif(({1})::DOUBLE, 0), 0.0)"
CELLS = "count(*) AS n, count(*) FILTER (score < 25 AND label = 0) AS tn, count(*) FILTER (score >= 25 AND label = 0) AS fp, count(*) FILTER (score < 25 AND label = 1) AS fn, count(*) FILTER (score >= 25 AND label = 1) AS tp"
PR = f"{RATE.format('tp', 'tp + fp')} AS precision, {RATE.format('tp', 'tp + fn')} AS recall"
CONFUSION = f"c AS (SELECT {CELLS} FROM scored), r AS (SELECT *, {PR} FROM c)"
F1 = "coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1"
GOALS = "goals AS (SELECT unnest([{}])::DOUBLE AS target)"
CHOSEN = "chosen AS (SELECT target, min(score) FILTER (fp <= target * n) AS threshold, coalesce(max(fp) FILTER (fp <= target * n), 0)::BIGINT AS fp, coalesce(max(tp) FILTER (fp <= target * n), 0)::BIGINT AS tp, max(n)::BIGINT AS n_benign, max(p)::BIGINT AS n_malicious FROM points, goals GROUP BY target)"
SWEPT = f"WITH {CURVE}, {GOALS.format(', '.join(map(str, TARGETS)))}, {CHOSEN}"
AREAS = """areas AS (SELECT sum(gain * (precision + was) / 2) AS pr_auc, sum(gain * precision) AS average_precision FROM (SELECT pos::DOUBLE / p AS gain, tp::DOUBLE / (tp + fp) AS precision,
  CASE WHEN tp - pos + fp - neg = 0 THEN 1.0 ELSE (tp - pos)::DOUBLE / (tp - pos + fp - neg) END AS was FROM curve))"""

QUERIES = {
    f.__name__: f
    for f in (
        q10_confusion, q11_three_way, q12_confusion_by_split, q13_auc, q14_feature_auc_topk, q15_roc_points, q16_threshold_for_fpr, q17_threshold_sweep, q18_threshold_cliffs, q19_threshold_monotone, q20_pr_auc_trapezoid,
        q21_average_precision, q22_prevalence_projection, q23_threshold_for_ppv, q24_per_class_detection, q25_error_statistics, q26_class_report, q27_source_scores, q28_band_totals, q82_early_stopping,
    )
}
ORACLE_SQL = {
    "q10_confusion": f"WITH {SCORED}, {CONFUSION} SELECT n, tn, fp, fn, tp, precision, recall, {F1}, {RATE.format('fp', 'fp + tn')} AS fpr FROM r",
    "q11_three_way": f"WITH {SCORED} SELECT label, count(*) AS n, count(*) FILTER (score < 15) AS n_allow, count(*) FILTER (score >= 15 AND score < 40) AS n_alert, count(*) FILTER (score >= 40) AS n_block FROM scored GROUP BY label",
    "q12_confusion_by_split": f"WITH {SCORED}, c AS (SELECT split, {CELLS} FROM scored GROUP BY split), r AS (SELECT *, {PR} FROM c) SELECT split, n, tn, fp, fn, tp, precision, recall, {F1}, {
        RATE.format('fp', 'fp + tn')
    } AS fpr FROM r",
    "q13_auc": f"WITH {SCORED}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS ar FROM scored), t AS (SELECT count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg, sum(ar) FILTER (label = 1) AS w FROM r) SELECT n_pos, n_neg, (w - n_pos * (n_pos + 1) / 2.0::DOUBLE) / (n_pos::DOUBLE * n_neg) AS auc FROM t",
    "q14_feature_auc_topk": """WITH x AS (SELECT CAST(label < 5 AS INT) AS label, unnest(range(64)) AS i, embedding FROM embeddings), y AS (SELECT label, 'f' || lpad(i::VARCHAR, 2, '0') AS feature, embedding[i + 1]::DOUBLE AS score FROM x),
 r AS (SELECT feature, label, rank() OVER (PARTITION BY feature ORDER BY score) + (count(*) OVER (PARTITION BY feature, score) - 1) / 2.0::DOUBLE AS ar FROM y), t AS (SELECT feature, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n, sum(ar) FILTER (label = 1) AS w FROM r GROUP BY feature),
 a AS (SELECT feature, (w - p * (p + 1) / 2.0::DOUBLE) / (p::DOUBLE * n) AS auc FROM t) SELECT feature, auc, greatest(auc, 1 - auc) AS separation FROM a ORDER BY separation DESC, feature LIMIT 15""",
    "q15_roc_points": f"WITH {CURVE} SELECT score AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, p::BIGINT AS p, n::BIGINT AS n FROM points",
    "q16_threshold_for_fpr": f"WITH {CURVE}, {GOALS.format('0.05')}, {CHOSEN} SELECT * FROM chosen",
    "q17_threshold_sweep": f"{SWEPT} SELECT target, threshold, fp::DOUBLE / n_benign AS actual_fpr, fp AS n_fp, n_benign, tp::DOUBLE / n_malicious AS detection_rate, tp AS n_tp, n_malicious, coalesce((SELECT pos + neg FROM g WHERE g.score = threshold), 0) AS n_tied FROM chosen",
    "q18_threshold_cliffs": f"{SWEPT} SELECT target, threshold, lag(threshold) OVER (ORDER BY target) - threshold AS drop_from_previous, CAST(coalesce(lag(threshold) OVER (ORDER BY target) - threshold > 0.1, false) AS INT) AS is_cliff FROM chosen",
    "q19_threshold_monotone": f"{SWEPT} SELECT CAST(coalesce(bool_and(ok), true) AS INT) AS is_monotone, count(*) AS n_targets FROM (SELECT lag(threshold) OVER (ORDER BY target) >= threshold AS ok FROM chosen)",
    "q20_pr_auc_trapezoid": f"WITH {CURVE}, {AREAS} SELECT round(pr_auc, 9) AS pr_auc FROM areas",
    "q21_average_precision": f"WITH {CURVE}, {AREAS} SELECT round(average_precision, 9) AS average_precision FROM areas",
    "q22_prevalence_projection": f"""WITH {SCORED}, {CONFUSION}, x AS (SELECT unnest([0.001, 0.0001, 0.00001])::DOUBLE AS prevalence, fp::DOUBLE / (fp + tn) AS f, tp::DOUBLE / (tp + fn) AS t FROM r)
 SELECT prevalence, round(t * prevalence / (t * prevalence + f * (1 - prevalence)), 9) AS ppv, round(t * prevalence + f * (1 - prevalence), 9) AS alert_rate, round(f * (1 - prevalence) * 10000, 9) AS fp_per_10000, round(t * prevalence * 10000, 9) AS tp_per_10000, round(f * (1 - prevalence) * 100000, 9) AS fp_per_100000, round(t * prevalence * 100000, 9) AS tp_per_100000 FROM x""",
    "q23_threshold_for_ppv": f"WITH {CURVE}, {
        GOALS.format(', '.join(map(str, PPV_TARGETS)))
    }, k AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY tp DESC, score DESC) AS o FROM points, goals WHERE tp > 0 AND (tp::DOUBLE / p * 0.001::DOUBLE) / (tp::DOUBLE / p * 0.001::DOUBLE + fp::DOUBLE / n * (1 - 0.001::DOUBLE)) >= target) SELECT target, score AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp FROM k WHERE o = 1",
    "q24_per_class_detection": f"""WITH {SCORED}, a AS (SELECT count(*) FILTER (score >= 25)::DOUBLE / count(*) AS aggregate FROM scored WHERE label = 1), s AS (SELECT label_raw, count(*) AS n_train FROM scored WHERE split = 'F' GROUP BY 1),
 e AS (SELECT label_raw, label, count(*) AS n, count(*) FILTER (score >= 25) AS detected FROM scored GROUP BY 1, 2), o AS (SELECT label_raw, label, n, detected, detected::DOUBLE / n AS rate, coalesce(n_train, 0) AS n_train, label = 1 AND detected::DOUBLE / n < aggregate - 0.05::DOUBLE AS low FROM e LEFT JOIN s USING (label_raw), a)
 SELECT label_raw, label, n, detected, rate, n_train, CAST(low AS INT) AS is_low, CAST(low AND n_train < 5000 AS INT) AS is_low_support FROM o""",
    "q25_error_statistics": "WITH p AS (SELECT l_extendedprice AS a, l_extendedprice::FLOAT::DOUBLE AS b FROM lineitem) SELECT count(*) AS n, round(max(abs(a - b)), 9) AS max_abs, round(avg(abs(a - b)), 9) AS mean_abs, round(quantile_cont(abs(a - b), 0.5), 9) AS median_abs, count(*) FILTER ((a >= 50000) <> (b >= 50000)) AS n_flips, count(*) FILTER (abs(a - 50000) <= 0.000001::DOUBLE) AS n_ties, round(corr(a, b), 6) AS correlation FROM p",
    "q26_class_report": f"""WITH {SCORED}, {CONFUSION}, x AS (SELECT 0 AS label, (tp + tn)::DOUBLE / n AS accuracy, tn AS hit, fn AS wrong, fp AS missed FROM r UNION ALL SELECT 1, (tp + tn)::DOUBLE / n, tp, fp, fn FROM r),
 y AS (SELECT *, hit::DOUBLE / (hit + wrong) AS precision, hit::DOUBLE / (hit + missed) AS recall FROM x) SELECT label, accuracy, precision, recall, {F1}, hit + missed AS support FROM y""",
    "q27_source_scores": f"WITH {SCORED} SELECT label_raw, label, count(*) AS n, count(*) FILTER (CAST(score >= 25 AS INT) = label)::DOUBLE / count(*) AS accuracy, round(avg(score), 9) AS mean_score FROM scored GROUP BY 1, 2",
    "q28_band_totals": "WITH b AS (SELECT CASE WHEN l_extendedprice < 10000 THEN 'low' WHEN l_extendedprice < 50000 THEN 'middle' ELSE 'high' END AS band, l_returnflag = 'R' AS bad, l_quantity >= 25 AS hit FROM lineitem) SELECT coalesce(band, 'deployment_total') AS band, count(*) AS n, count(*) FILTER (hit AND bad) AS tp, count(*) FILTER (hit AND NOT bad) AS fp FROM b GROUP BY ROLLUP (band)",
    "q82_early_stopping": f"""WITH l AS (SELECT * FROM (VALUES {', '.join(f'({e}, {a!r}::DOUBLE, {b!r}::DOUBLE)' for e, a, b in LOG)}) t(epoch, train_auc, val_auc)),
 a AS (SELECT epoch, max(val_auc) OVER (ORDER BY epoch) AS best, CAST(train_auc - val_auc > 0.05::DOUBLE AS INT) AS wide FROM l), b AS (SELECT *, lag(best) OVER (ORDER BY epoch) AS was FROM a),
 c AS (SELECT *, max(CASE WHEN was IS NULL OR best > was THEN epoch END) OVER (ORDER BY epoch) AS best_at, sum(1 - wide) OVER (ORDER BY epoch) AS island FROM b),
 d AS (SELECT epoch, best, epoch - best_at AS since_best, sum(wide) OVER (PARTITION BY island ORDER BY epoch)::BIGINT AS gap_run FROM c) SELECT *, CAST(since_best >= 15 OR gap_run >= 3 AS INT) AS is_stop FROM d""",
}
