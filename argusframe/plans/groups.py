"""Duplicates, groups, splits, samples and their invariants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argusframe.checkpoints import materialize, scratch
from argusframe.components import connected_components
from argusframe.operators import dedup, splits
from argusframe.plans.tables import FLOWS, SAMPLES, flows, samples, table
from argusframe.sources import layout

SEED = "42"


def q30_dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("digest"), "doc_id", "source")
    return dedup.keep_first(docs, ["digest"], ["doc_id"])


def q31_duplicate_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.duplicate_profile(flows(spark, sf_dir), ["vec"])


def q32_ambiguous_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.split_ambiguous(flows(spark, sf_dir), ["vec"])[1].select("id", "vec", "label")


def q33_ambiguous_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.split_ambiguous(flows(spark, sf_dir), ["vec"])[0].groupBy("day", "label_raw").agg(F.count("*").alias("n"))


def q34_collapse_with_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("digest"), "doc_id", "source")
    return dedup.representative(docs, ["digest"], ["doc_id"]).where("duplicate_count > 1")


def q35_key_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return dedup.key_validation(docs, F.md5(F.lower("text")), F.sha2("text", 256))


def q36_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.group_sizes(samples(spark, sf_dir), F.col("family"))


def q37_group_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.by_sample(dedup.group_sizes(samples(spark, sf_dir), F.col("digest"))).select("label", "median_size", "n_groups", "is_grouped_by_sample")


def q38_connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources linked by equal texts: groups that share a text are one group. Texts are named by their
    first document, below zero."""
    docs = table(spark, sf_dir, "documents").select(
        F.regexp_extract("source", "([0-9]+)$", 1).cast("long").alias("source"), "doc_id", F.sha2("text", 256).alias("digest")
    )
    names = docs.groupBy("digest").agg((-F.min("doc_id") - 1).alias("text"))
    parts = connected_components(docs.join(names, "digest").select("source", "text"), "source", "text")
    return parts.groupBy("component").agg(F.count("*").alias("n_nodes"), F.count_if(F.col("node") >= 0).alias("n_sources"))


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many flows of each vector there are, by what is asked of them: counted in every task before anything is shuffled."""
    return materialize(flows(spark, sf_dir).groupBy("vec", "label", "day", "label_raw").agg(F.count("*").alias("n")), "flow-counts")


def _groups(counted: DataFrame) -> DataFrame:
    """Vectors of one label with their size, label and most frequent day and raw label."""
    sizes = counted.groupBy("vec").agg(F.sum("n").alias("size"), F.min("label").alias("_least"), F.max("label").alias("label"))
    clean = sizes.where(~F.coalesce(F.col("_least") != F.col("label"), F.lit(False))).drop("_least")
    return clean.join(dedup.majority(counted, ["vec"], ["day", "label_raw"], F.col("n")), "vec")


def _allocated(counted: DataFrame) -> DataFrame:
    return splits.allocate(_groups(counted), ["day", "label_raw"], ["vec"], "size", SEED)


def q39_greedy_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _allocated(_counted(spark, sf_dir)).select("vec", "day", "label_raw", "size", "split")


def _split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows with their split, those of one vector, label, day and raw label as one row with n."""
    counted = _counted(spark, sf_dir)
    return counted.join(_allocated(counted).select("vec", "split"), "vec")


def q40_split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = splits.report(_split_rows(spark, sf_dir), splits.FRACTIONS, F.col("n"))
    return out.select("split", "n", "n_malicious", F.round("share", 9).alias("share"), "target", F.round("delta_pp", 7).alias("delta_pp"))


def q41_leak_check_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.leaks(_split_rows(spark, sf_dir), F.col("vec")).agg(F.count("*").alias("n_leaks"))


def q42_leak_check_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The check must find something where rows are split without their groups."""
    rows = flows(spark, sf_dir).withColumn("split", F.when(F.col("id") % 5 == 0, "test").otherwise("train"))
    return splits.leaks(rows, F.col("vec")).agg(F.count("*").alias("n_leaks"), F.sum("n_rows").alias("n_rows"))


def q99_leaks_by_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two checks over one layout by group, without a shuffle of rows: groups in several splits, and groups of both labels."""
    rows = flows(spark, sf_dir).withColumn("split", F.when(F.col("id") % 5 == 0, "test").otherwise("train")).select("id", "label", "vec", "split")
    with layout.laid_out(rows, "vec", 16) as held, scratch() as scope:
        both = splits.leaks(held, F.col("vec")).join(splits.leaks(held, F.col("vec"), "label").select("leak_key", F.col("n_rows").alias("n")), "leak_key", "full")
        counts = both.agg(F.count("n_rows").alias("n_leaks"), F.sum("n_rows").alias("n_rows"), F.count("n").alias("n_ambiguous"))
        kept = materialize(counts, "leaks")
        scope.pass_on(kept)
    return kept


def q43_carve_val(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return splits.carve(docs, ["lang", "source"], ["doc_id"], 0.1, SEED)


def q44_permutation_carve(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return splits.permute(docs, ["doc_id"], 0.1, 0.1, SEED)


def q45_sampling_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.sampling_plan(flows(spark, sf_dir).withColumn("tens", F.col("id") % 97 % 12), ["day", "label_raw", "tens"], 9000, 900)


def q46_stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flows(spark, sf_dir).withColumn("tens", F.col("id") % 97 % 12)
    return splits.stratified_sample(rows, ["day", "label_raw", "tens"], ["id"], 9000, 900, SEED).select("id", "day", "label_raw", "tens")


def q47_stratum_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows(spark, sf_dir).groupBy("day", "label_raw").agg(
        F.count("*").alias("n"), F.count_if(F.col("label") == 0).alias("n_benign"), F.count_if(F.col("label") == 1).alias("n_malicious"),
        F.count_distinct("vec").alias("n_vec")
    )


def q48_sequence_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of identical sequences, bucketed by source and majority label."""
    rows = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("seq"), "source", (F.col("n_chars") % 2).cast("int").alias("label"))
    sizes = rows.groupBy("seq").agg(F.count("*").alias("size"))
    return sizes.join(dedup.majority(rows, ["seq"], ["source", "label"]), "seq").groupBy("source", "label").agg(
        F.count("*").alias("n_groups"), F.sum("size").alias("n_rows")
    )


def q49_era_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authored sides stay: each is collapsed by itself, and val is carved from train."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("digest"), (F.col("doc_id") % 3 == 0).alias("is_test"))
    test = dedup.representative(docs.where("is_test").select("digest", "doc_id", "lang"), ["digest"], ["doc_id"]).withColumn("split", F.lit("test"))
    train = splits.carve(
        dedup.representative(docs.where("NOT is_test").select("digest", "doc_id", "lang"), ["digest"], ["doc_id"]), ["lang"], ["doc_id"], 0.1, SEED
    )
    return train.unionByName(test).select("doc_id", "lang", "duplicate_count", "split")


def q70_label_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = ["click", "view", "purchase"]
    events = table(spark, sf_dir, "events")
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.max(F.col("event_type").isin(allowed).cast("int")).alias("is_kept"))


def q71_finite_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = F.col("l_extendedprice") / F.nullif(F.col("l_quantity") % 10, F.lit(0.0))
    odd = F.when(F.col("l_linenumber") == 7, F.lit(float("nan"))).when(F.col("l_linenumber") == 6, F.lit(float("inf"))).otherwise(rate)
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", odd.alias("rate"))
    fine = F.col("rate").isNotNull() & ~F.isnan("rate") & (F.abs("rate") < float("inf"))
    return rows.where(fine).groupBy("l_returnflag").agg(F.count("*").alias("n"))


def q72_dropped_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples that lose all their rows by the restriction, one row each."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag")
    kept = lines.where("l_returnflag = 'R'").select("l_orderkey")
    return lines.join(kept, "l_orderkey", "left_anti").groupBy("l_orderkey").agg(F.min("l_returnflag").alias("first_flag"), F.count("*").alias("n"))


def q73_set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k")
    ).distinct(), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    missing, extra = orders.exceptAll(lines), lines.exceptAll(orders)
    counted = missing.agg(F.count("*").alias("n_missing")).join(F.broadcast(extra.agg(F.count("*").alias("n_extra"))))  # one row each
    return counted.select("n_missing", "n_extra", ((F.col("n_missing") + F.col("n_extra")) == 0).cast("int").alias("is_equal"))


def q74_unlabeled_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("int").alias("label"))
    docs = table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left").select("doc_id", F.coalesce("label", F.lit(-1)).alias("label"))
    return docs.where("label <> -1").groupBy("label").agg(F.count("*").alias("n"))


def q75_union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of different kinds under one schema."""
    docs = table(spark, sf_dir, "documents").select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), F.length("text").cast("long").alias("n"))
    pages = table(spark, sf_dir, "pages").select(F.lit("pages").alias("origin"), F.col("page_id").alias("id"), F.length("html").cast("long").alias("n"))
    talk = table(spark, sf_dir, "conversations").select(
        F.lit("conversations").alias("origin"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.length("text").cast("long").alias("n")
    )
    return docs.unionByName(pages).unionByName(talk).groupBy("origin").agg(F.count("*").alias("rows"), F.sum("n").alias("n_chars"))


def q76_prefix_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of each split: the limit is the feature."""
    from pyspark.sql import Window as W

    rows = flows(spark, sf_dir).select("day", "id")
    return rows.withColumn("i", F.row_number().over(W.partitionBy("day").orderBy("id"))).where("i <= 25").select("day", "id")


def q77_sorted_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest artifact: valid 32-byte digests in byte order, others counted out."""
    from argusframe.functions.columns import digest_or_null

    raw = table(spark, sf_dir, "documents").select(
        F.when(F.col("doc_id") % 10 == 3, F.lit("zz")).when(
            F.col("doc_id") % 10 == 4, F.substring(F.sha2("text", 256), 1, 20)
        ).otherwise(F.sha2("text", 256)).alias("h")
    )
    return raw.select(digest_or_null(F.col("h")).alias("d")).where("d IS NOT NULL").orderBy("d").select(F.lower(F.hex("d")).alias("sha256"))


def q80_rollup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir)
    return rows.rollup("family", "label").agg(F.count("*").alias("n"), F.count_distinct("digest").alias("n_distinct")).select(
        F.coalesce("family", F.lit("all")).alias("family"), F.coalesce(F.col("label").cast("string"), F.lit("all")).alias("label"), "n", "n_distinct"
    )


def q81_approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows(spark, sf_dir).agg(F.approx_count_distinct("vec", 0.02).alias("n_about"))


def q83_distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir)
    return rows.agg(F.count_distinct("digest").alias("n_digests"), F.count_distinct("family").alias("n_families"), F.count("*").alias("n_rows"))


CLEAN = f"{FLOWS}, bad AS (SELECT vec FROM flows GROUP BY vec HAVING min(label) <> max(label)), clean AS (SELECT * FROM flows WHERE vec NOT IN (SELECT vec FROM bad))"
ALLOCATED = f"""{CLEAN}, m AS (SELECT vec, day, label_raw, row_number() OVER (PARTITION BY vec ORDER BY count(*) DESC, day, label_raw) AS o FROM clean GROUP BY vec, day, label_raw),
 gr AS (SELECT vec, day, label_raw, size FROM (SELECT vec, count(*) AS size FROM clean GROUP BY vec) JOIN m USING (vec) WHERE o = 1),
 r1 AS (SELECT *, sum(size) OVER (PARTITION BY day, label_raw ORDER BY md5('{SEED}|' || vec), vec) - size AS before, sum(size) OVER (PARTITION BY day, label_raw) AS total FROM gr),
 r2 AS (SELECT *, coalesce(max(CASE WHEN before < round_even(total * 0.1::DOUBLE, 0) THEN before + size END) OVER (PARTITION BY day, label_raw), 0) AS vend FROM r1),
 r3 AS (SELECT *, greatest(vend, coalesce(max(CASE WHEN before >= vend AND before - vend < round_even(total * 0.1::DOUBLE, 0) THEN before + size END) OVER (PARTITION BY day, label_raw), 0)) AS tend FROM r2),
 allocated AS (SELECT vec, day, label_raw, size, CASE WHEN before < vend THEN 'val' WHEN before < tend THEN 'test' WHEN before - tend < round_even(total * 0.2::DOUBLE, 0) THEN 'cal' ELSE 'train' END AS split FROM r3)"""
SPLIT_ROWS = f"{ALLOCATED}, s AS (SELECT f.*, a.split FROM flows f JOIN allocated a USING (vec))"
PLAN = f"""{FLOWS}, x AS (SELECT *, id % 97 % 12 AS tens FROM flows), k AS (SELECT day, label_raw, tens, count(*) AS n FROM x GROUP BY ALL),
 rate AS (SELECT least(greatest((9000 - coalesce(sum(n) FILTER (n <= 900), 0))::DOUBLE / nullif(sum(n) FILTER (n > 900), 0), 0.0), 1.0) AS r FROM k),
 plan AS (SELECT day, label_raw, tens, n, CASE WHEN n <= 900 THEN n ELSE round_even(n * r, 0) END::BIGINT AS plan FROM k, rate)"""

QUERIES = {
    f.__name__: f
    for f in (
        q30_dedup_keep_first, q31_duplicate_profile, q32_ambiguous_excluded, q33_ambiguous_clean, q34_collapse_with_count, q35_key_validation, q36_group_sizes, q37_group_decision, q38_connected_components, q39_greedy_split,
        q40_split_report, q41_leak_check_group, q42_leak_check_control, q99_leaks_by_layout, q43_carve_val, q44_permutation_carve, q45_sampling_plan, q46_stratified_sample, q47_stratum_counts, q48_sequence_groups, q49_era_split,
        q70_label_filter, q71_finite_filter, q72_dropped_entities, q73_set_equality, q74_unlabeled_filter, q75_union_sources, q76_prefix_limit, q77_sorted_digests, q80_rollup_report, q81_approx_distinct, q83_distinct_counts,
    )
}
ORACLE_SQL = {
    "q30_dedup_keep_first": "SELECT digest, doc_id, source FROM (SELECT sha256(text) AS digest, doc_id, source, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS i FROM documents) WHERE i = 1",
    "q31_duplicate_profile": f"""WITH {FLOWS}, g AS (SELECT vec, count(*) AS size, min(label) <> max(label) AS amb FROM flows GROUP BY vec) SELECT sum(size)::BIGINT AS n_rows, count(*) AS n_groups, coalesce(sum(size) FILTER (size > 1), 0)::BIGINT AS n_duplicate_rows,
 count(*) FILTER (size > 1) AS n_duplicate_groups, min(size) FILTER (size > 1) AS min_size, max(size) FILTER (size > 1) AS max_size, count(*) FILTER (amb) AS n_ambiguous FROM g""",
    "q32_ambiguous_excluded": f"WITH {CLEAN} SELECT id, vec, label FROM flows WHERE vec IN (SELECT vec FROM bad)",
    "q33_ambiguous_clean": f"WITH {CLEAN} SELECT day, label_raw, count(*) AS n FROM clean GROUP BY 1, 2",
    "q34_collapse_with_count": "SELECT sha256(text) AS digest, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, count(*) AS duplicate_count FROM documents GROUP BY text HAVING count(*) > 1",
    "q35_key_validation": "WITH p AS (SELECT DISTINCT md5(lower(text)) AS g, sha256(text) AS c FROM documents) SELECT (SELECT count(DISTINCT g) FROM p) AS n_given, (SELECT count(*) FROM (SELECT g FROM p GROUP BY g HAVING count(*) > 1)) AS n_false_merges, (SELECT count(DISTINCT c) FROM p) AS n_computed, (SELECT count(*) FROM (SELECT c FROM p GROUP BY c HAVING count(*) > 1)) AS n_false_splits",
    "q36_group_sizes": f"WITH {SAMPLES}, g AS (SELECT label, family, count(*) AS size FROM samples GROUP BY 1, 2) SELECT label, sum(size)::BIGINT AS n_rows, count(*) AS n_groups, min(size) AS min_size, avg(size) AS mean_size, quantile_cont(size, 0.5) AS median_size, max(size) AS max_size FROM g GROUP BY label",
    "q37_group_decision": f"WITH {SAMPLES}, g AS (SELECT label, digest, count(*) AS size FROM samples GROUP BY 1, 2) SELECT label, quantile_cont(size, 0.5) AS median_size, count(*) AS n_groups, CAST(quantile_cont(size, 0.5) > 1 AND count(*) > 1 AS INT) AS is_grouped_by_sample FROM g GROUP BY label",
    "q38_connected_components": """WITH RECURSIVE e AS (SELECT DISTINCT CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) AS a, -min(doc_id) OVER (PARTITION BY text) - 1 AS b FROM documents), x AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
 r AS (SELECT a AS node, a AS seen FROM x UNION SELECT r.node, x.b FROM r JOIN x ON r.seen = x.a), c AS (SELECT node, min(seen) AS component FROM r GROUP BY node) SELECT component, count(*) AS n_nodes, count(*) FILTER (node >= 0) AS n_sources FROM c GROUP BY component""",
    "q39_greedy_split": f"WITH {ALLOCATED} SELECT * FROM allocated",
    "q40_split_report": f"WITH {SPLIT_ROWS}, n AS (SELECT split, count(*) AS n, count(*) FILTER (label = 1) AS n_malicious FROM s GROUP BY split), t AS (SELECT *, n::DOUBLE / sum(n) OVER () AS share, CASE split WHEN 'val' THEN 0.1 WHEN 'test' THEN 0.1 WHEN 'cal' THEN 0.2 ELSE 0.6 END::DOUBLE AS target FROM n) SELECT split, n, n_malicious, round(share, 9) AS share, target, round((share - target) * 100, 7) AS delta_pp FROM t",
    "q41_leak_check_group": f"WITH {SPLIT_ROWS} SELECT count(*) AS n_leaks FROM (SELECT vec FROM s GROUP BY vec HAVING min(split) <> max(split))",
    "q42_leak_check_control": f"WITH {FLOWS}, s AS (SELECT vec, CASE WHEN id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM flows) SELECT count(*) AS n_leaks, sum(n)::BIGINT AS n_rows FROM (SELECT vec, count(*) AS n FROM s GROUP BY vec HAVING min(split) <> max(split))",
    "q99_leaks_by_layout": f"WITH {FLOWS}, g AS (SELECT vec, count(*) AS n, count(DISTINCT id % 5 = 0) > 1 AS leaks, min(label) <> max(label) AS amb FROM flows GROUP BY vec) SELECT count(*) FILTER (leaks) AS n_leaks, (sum(n) FILTER (leaks))::BIGINT AS n_rows, count(*) FILTER (amb) AS n_ambiguous FROM g",
    "q43_carve_val": f"SELECT doc_id, lang, source, CASE WHEN row_number() OVER (PARTITION BY lang, source ORDER BY md5('{SEED}|' || doc_id), doc_id) - 1 < round_even(count(*) OVER (PARTITION BY lang, source) * 0.1::DOUBLE, 0) THEN 'val' ELSE 'train' END AS split FROM documents",
    "q44_permutation_carve": f"WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('{SEED}|' || doc_id), doc_id) - 1 AS i, floor(count(*) OVER () * 0.1::DOUBLE) AS v FROM documents) SELECT doc_id, CASE WHEN i < v THEN 'val' WHEN i < 2 * v THEN 'cal' ELSE 'train' END AS split FROM r",
    "q45_sampling_plan": f"WITH {PLAN} SELECT * FROM plan",
    "q46_stratified_sample": f"WITH {PLAN}, o AS (SELECT x.*, plan, row_number() OVER (PARTITION BY day, label_raw, tens ORDER BY md5('{SEED}|' || id), id) AS i FROM x JOIN plan USING (day, label_raw, tens)) SELECT id, day, label_raw, tens FROM o WHERE i <= plan",
    "q47_stratum_counts": f"WITH {FLOWS} SELECT day, label_raw, count(*) AS n, count(*) FILTER (label = 0) AS n_benign, count(*) FILTER (label = 1) AS n_malicious, count(DISTINCT vec) AS n_vec FROM flows GROUP BY 1, 2",
    "q48_sequence_groups": "WITH r AS (SELECT sha256(text) AS seq, source, CAST(n_chars % 2 AS INT) AS label FROM documents), m AS (SELECT seq, source, label, sum(count(*)) OVER (PARTITION BY seq) AS size, row_number() OVER (PARTITION BY seq ORDER BY count(*) DESC, source, label) AS o FROM r GROUP BY seq, source, label) SELECT source, label, count(*) AS n_groups, sum(size)::BIGINT AS n_rows FROM m WHERE o = 1 GROUP BY 1, 2",
    "q49_era_split": f"""WITH d AS (SELECT doc_id % 3 = 0 AS t, min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, count(*) AS duplicate_count FROM documents GROUP BY doc_id % 3 = 0, text)
 SELECT doc_id, lang, duplicate_count, CASE WHEN t THEN 'test' WHEN row_number() OVER (PARTITION BY t, lang ORDER BY md5('{SEED}|' || doc_id), doc_id) - 1 < round_even(count(*) OVER (PARTITION BY t, lang) * 0.1::DOUBLE, 0) THEN 'val' ELSE 'train' END AS split FROM d""",
    "q70_label_filter": "SELECT event_type, count(*) AS n, CAST(event_type IN ('click', 'view', 'purchase') AS INT) AS is_kept FROM events GROUP BY event_type",
    "q71_finite_filter": "WITH r AS (SELECT l_returnflag, CASE l_linenumber WHEN 7 THEN 'nan'::DOUBLE WHEN 6 THEN 'inf'::DOUBLE ELSE l_extendedprice / nullif(l_quantity % 10, 0) END AS rate FROM lineitem) SELECT l_returnflag, count(*) AS n FROM r WHERE isfinite(rate) GROUP BY 1",
    "q72_dropped_entities": "SELECT l_orderkey, min(l_returnflag) AS first_flag, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) FILTER (l_returnflag = 'R') = 0",
    "q73_set_equality": "WITH m AS (SELECT count(*) AS n_missing FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)), x AS (SELECT count(*) AS n_extra FROM (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders)) SELECT n_missing, n_extra, CAST(n_missing + n_extra = 0 AS INT) AS is_equal FROM m, x",
    "q74_unlabeled_filter": "SELECT CAST(toxic AS INT) AS label, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1",
    "q75_union_sources": "SELECT 'documents' AS origin, count(*) AS rows, sum(length(text))::BIGINT AS n_chars FROM documents UNION ALL SELECT 'pages', count(*), sum(length(html))::BIGINT FROM pages UNION ALL SELECT 'conversations', count(*), sum(length(text))::BIGINT FROM conversations",
    "q76_prefix_limit": f"WITH {FLOWS} SELECT day, id FROM (SELECT day, id, row_number() OVER (PARTITION BY day ORDER BY id) AS i FROM flows) WHERE i <= 25",
    "q77_sorted_digests": "SELECT sha256(text) AS sha256 FROM documents WHERE doc_id % 10 NOT IN (3, 4) ORDER BY 1",
    "q80_rollup_report": f"WITH {SAMPLES} SELECT coalesce(family, 'all') AS family, coalesce(label::VARCHAR, 'all') AS label, count(*) AS n, count(DISTINCT digest) AS n_distinct FROM samples GROUP BY ROLLUP (family, label)",
    "q83_distinct_counts": f"WITH {SAMPLES} SELECT count(DISTINCT digest) AS n_digests, count(DISTINCT family) AS n_families, count(*) AS n_rows FROM samples",
}
