"""Vocabularies, encodings and repeated sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argusframe.functions import byteops
from argusframe.functions import columns as C
from argusframe.operators import dedup, metrics, sequences, setjoin
from argusframe.plans.tables import DIALOGUES, TRACES, dialogues, table, user_traces


def q50_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.vocabulary(table(spark, sf_dir, "events"), "event_type", least=2)


def q51_encode_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary is learned from one side alone, so the other has unknown tokens."""
    rows = dialogues(spark, sf_dir)
    vocab = sequences.vocabulary(rows.where("split = 'train'").select(F.explode("tokens").alias("t")).where("t <> 'system'"), "t")
    return sequences.encode(rows, vocab, 6).select("conv_id", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


def q98_encode_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 64 words of each document by a vocabulary of all words, of which a table holds but the most frequent 500."""
    docs, text = table(spark, sf_dir, "documents"), F.lower(F.coalesce("text", F.lit("")))
    vocab = sequences.vocabulary(byteops.word_counts(docs.select(text.alias("text")), "text"), "token", least=2, n="n")
    words = F.filter(F.slice(F.split(text, r"[^a-z]+", 66), 1, 65), lambda w: w != "")  # the first may be empty; the 66th is all the rest
    ids = sequences.encode(docs.select("doc_id", F.slice(words, 1, 64).alias("tokens")), vocab, 64, heavy=500).select("doc_id", "ids")
    return ids.select("doc_id", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"), F.size(F.filter("ids", lambda i: i == 1)).cast("long").alias("n_unknown"))


def q52_sequence_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return counts.groupBy(
        C.behavioral_status(F.col("n")).alias("behavioral"), C.emulation_status(F.col("n") * 7).alias("emulation")
    ).agg(F.count("*").alias("n"))


def q53_length_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    return table(spark, sf_dir, "documents").groupBy(C.length_band(n).alias("band")).agg(F.count("*").alias("n"), F.sum(n).cast("long").alias("n_words"))


def q54_sequence_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_traces(spark, sf_dir).select("user_id", "day", C.sequence_hash(F.col("tokens")).alias("sequence_sha256"), F.col("n").cast("long").alias("n"))


def q55_lookup_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dialogues(spark, sf_dir)
    out = sequences.lookup_baseline(rows.where("split = 'train'"), rows.where("split = 'test'"))
    return out.agg(F.count("*").alias("n"), F.count_if(F.col("predicted") == F.col("label")).alias("n_right"), F.count_if(F.col("label") == 0).alias("n_zero"))


def q56_token_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dialogues(spark, sf_dir)
    return rows.select("conv_id", F.array_join(sequences.ablate(F.col("tokens"), ["system", "assistant"]), " ").alias("tokens"))


def q57_head_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.head_share(dialogues(spark, sf_dir), ["seq"], [1, 5])


def q58_class_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").agg(
        F.count_if(F.col("toxic") == 0).alias("n_neg"), F.count_if(F.col("toxic") == 1).alias("n_pos"),
        (F.count_if(F.col("toxic") == 0) / F.greatest(F.count_if(F.col("toxic") == 1), F.lit(1))).alias("pos_weight")
    )


def q59_separability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether length alone, or a few common sequences, separate the classes."""
    rows = dialogues(spark, sf_dir)
    a = metrics.auc(rows.select("label", F.col("n").cast("double").alias("score")))
    unique = rows.agg(F.count("*").alias("n"), F.count_distinct("seq").alias("n_unique"))
    return unique.join(F.broadcast(a)).select("n", "n_unique", (F.col("n_unique") / F.col("n")).alias("unique_share"), F.greatest("auc", 1 - F.col("auc")).alias("length_auc"))  # one row each


def q84_bounded_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten tokens of each user, and how many there were: the prefix is the feature."""
    rows = sequences.traces(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type", most=10)
    return rows.select("user_id", F.array_join("tokens", " ").alias("tokens"), "n")


def q85_token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each distinct test sequence, the best token-set similarity to a train sequence (distinct sets only)."""
    sets = dialogues(spark, sf_dir).select("split", F.array_sort(F.array_distinct("tokens")).alias("s")).distinct()
    near = setjoin.best_matches(sets.where("split = 'test'").select(F.col("s").alias("a")), sets.where("split = 'train'").select(F.col("s").alias("b")))
    return near.select(F.array_join("a", ",").alias("tokens"), "best", (F.col("best") >= 0.9).cast("int").alias("is_near"))


SEP = "chr(31)"
QUERIES = {
    f.__name__: f for f in (
        q50_vocabulary, q51_encode_prefix, q52_sequence_status, q53_length_bands, q54_sequence_hash, q55_lookup_baseline, q56_token_ablation, q57_head_share,
        q58_class_weight, q59_separability, q84_bounded_traces, q85_token_sets, q98_encode_words
    )
}
ORACLE_SQL = {
    "q50_vocabulary": "SELECT event_type AS token, count(*) AS freq, CAST(row_number() OVER (ORDER BY count(*) DESC, event_type) + 1 AS INT) AS token_id FROM events GROUP BY event_type HAVING count(*) >= 2",
    "q51_encode_prefix": f"""WITH {DIALOGUES}, v AS (SELECT t, row_number() OVER (ORDER BY count(*) DESC, t) + 1 AS id FROM (SELECT unnest(tokens) AS t FROM dialogues WHERE split = 'train') WHERE t <> 'system' GROUP BY t),
 p AS (SELECT conv_id, i, tokens[i] AS t FROM dialogues, (SELECT unnest(range(1, 7)) AS i)) SELECT conv_id, string_agg(CASE WHEN t IS NULL THEN 0 ELSE coalesce(id, 1) END::VARCHAR, ',' ORDER BY i) AS ids FROM p LEFT JOIN v USING (t) GROUP BY conv_id""",
    "q52_sequence_status": "WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT CASE WHEN n = 0 THEN 'empty' WHEN n < 10 THEN 'too_short' WHEN n < 100 THEN 'short' WHEN n = 100 THEN 'ok' ELSE 'truncated' END AS behavioral, CASE WHEN n = 0 THEN 'empty' WHEN n * 7 < 500 THEN 'insufficient' WHEN n * 7 = 500 THEN 'ok' ELSE 'truncated' END AS emulation, count(*) AS n FROM c GROUP BY 1, 2",
    "q53_length_bands": r"WITH w AS (SELECT len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n FROM documents) SELECT CASE WHEN n < 10 THEN '<10' WHEN n < 100 THEN '10-99' ELSE '>=100' END AS band, count(*) AS n, sum(n)::BIGINT AS n_words FROM w GROUP BY 1",
    "q54_sequence_hash": f"WITH {TRACES} SELECT user_id, day, sha256(seq) AS sequence_sha256, n FROM traces",
    "q55_lookup_baseline": f"WITH {DIALOGUES}, k AS (SELECT seq, round_even(avg(label), 0)::INT AS p FROM dialogues WHERE split = 'train' GROUP BY seq) SELECT count(*) AS n, count(*) FILTER (coalesce(p, 0) = label) AS n_right, count(*) FILTER (label = 0) AS n_zero FROM dialogues LEFT JOIN k USING (seq) WHERE split = 'test'",
    "q56_token_ablation": f"WITH {DIALOGUES} SELECT conv_id, array_to_string(list_transform(tokens, lambda t: CASE WHEN t IN ('system', 'assistant') THEN '<UNK>' ELSE t END), ' ') AS tokens FROM dialogues",
    "q57_head_share": f"WITH {DIALOGUES}, s AS (SELECT seq, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, seq) AS r FROM dialogues GROUP BY seq) SELECT sum(size)::BIGINT AS n_rows, count(*) AS n_groups, (sum(size) FILTER (r <= 1))::DOUBLE / sum(size) AS top1_share, (sum(size) FILTER (r <= 5))::DOUBLE / sum(size) AS top5_share FROM s",
    "q58_class_weight": "SELECT count(*) FILTER (toxic = 0) AS n_neg, count(*) FILTER (toxic = 1) AS n_pos, count(*) FILTER (toxic = 0)::DOUBLE / greatest(count(*) FILTER (toxic = 1), 1) AS pos_weight FROM labels",
    "q59_separability": f"WITH {DIALOGUES}, r AS (SELECT label, rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0::DOUBLE AS ar FROM dialogues), t AS (SELECT count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS q, sum(ar) FILTER (label = 1) AS w FROM r), a AS (SELECT (w - p * (p + 1) / 2.0::DOUBLE) / (p::DOUBLE * q) AS auc FROM t) SELECT count(*) AS n, count(DISTINCT seq) AS n_unique, count(DISTINCT seq)::DOUBLE / count(*) AS unique_share, max(greatest(auc, 1 - auc)) AS length_auc FROM dialogues, a",
    "q98_encode_words": """WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z]+'), lambda w: w <> '') AS t FROM documents),
 v AS (SELECT w, row_number() OVER (ORDER BY count(*) DESC, w) + 1 AS id FROM (SELECT unnest(t) AS w FROM d) GROUP BY w HAVING count(*) >= 2),
 p AS (SELECT doc_id, i, t[i] AS w FROM d, (SELECT unnest(range(1, 65)) AS i)), x AS (SELECT doc_id, i, CASE WHEN p.w IS NULL THEN 0 ELSE coalesce(id, 1) END AS id FROM p LEFT JOIN v ON p.w = v.w)
 SELECT doc_id, string_agg(id::VARCHAR, ',' ORDER BY i) AS ids, count(*) FILTER (id = 1) AS n_unknown FROM x GROUP BY doc_id""",
    "q84_bounded_traces": "WITH o AS (SELECT user_id, event_type, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, string_agg(event_type, ' ' ORDER BY ts, event_id) AS tokens, max(n) AS n FROM o WHERE i <= 10 GROUP BY user_id",
    "q85_token_sets": f"""WITH {DIALOGUES}, s AS (SELECT DISTINCT split, list_sort(list_distinct(tokens)) AS s FROM dialogues), p AS (SELECT x.s AS a, max(len(list_intersect(x.s, y.s))::DOUBLE / len(list_distinct(list_concat(x.s, y.s)))) AS best FROM s x, s y WHERE x.split = 'test' AND y.split = 'train' GROUP BY x.s)
 SELECT array_to_string(a, ',') AS tokens, best, CAST(best >= 0.9 AS INT) AS is_near FROM p""",
}
