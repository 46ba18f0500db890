"""Derived features of rows, texts and bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argusframe.functions import byteops
from argusframe.functions import columns as C
from argusframe.functions import strings
from argusframe.operators.percentiles import with_percentiles
from argusframe.plans.tables import table


def q60_safe_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("a"), F.count_if(F.col("o_orderstatus") == "P").alias("b"), F.sum(F.lit(1)).alias("n")
    )
    return orders.select(
        "o_custkey", C.safe_ratio(F.col("a"), F.col("b")).alias("a_per_b"), C.safe_ratio(F.col("b"), F.col("a")).alias("b_per_a"),
        C.safe_ratio(F.col("a"), F.col("n")).alias("a_share")
    )


def q61_zscores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population mean and deviation of each component (a deviation of 0 counts as 1), and the extremes."""
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.posexplode("embedding").alias("i", "x")
    ).select("vec_id", "i", F.col("x").cast("double").alias("x"))
    sums = rows.groupBy("i").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std")).select(
        "i", "mean", F.when(F.col("std") == 0, 1.0).otherwise(F.col("std")).alias("std")
    )
    z = rows.join(F.broadcast(sums), "i").withColumn("z", (F.col("x") - F.col("mean")) / F.col("std"))  # one row a component
    return z.groupBy("i").agg(
        F.round(F.max("mean"), 9).alias("mean"), F.round(F.max("std"), 9).alias("std"), F.round(F.max("z"), 6).alias("max_z"),
        F.round(F.min("z"), 6).alias("min_z")
    )


def q62_byte_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text <> ''")
    return byteops.byte_profile(docs, "doc_id", "text").select("doc_id", "size", F.round("entropy", 9).alias("entropy"))


def q63_byte_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = byteops.byte_histogram(table(spark, sf_dir, "documents"), "text").groupBy("byte").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("byte", "n", (F.col("n") / F.col("total")).alias("share"))  # one row


def q64_string_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = C.printable_runs(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", runs.alias("runs"))
    n, chars = F.size("runs"), F.length(F.array_join("runs", ""))
    return rows.select("doc_id", n.cast("long").alias("n_strings"), chars.cast("long").alias("n_printable"), C.safe_ratio(chars, n).alias("mean_length"))


def q65_category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = byteops.category_counts(table(spark, sf_dir, "pages"), "html")
    return counts.groupBy("category").agg(F.sum("n_strings").alias("n_strings"), F.sum("n_rows").alias("n_pages"))


def q66_length_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = [F.count("*").alias("n"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.avg("n_chars").alias("mean")]
    docs = table(spark, sf_dir, "documents").select("source", "n_chars")
    return with_percentiles(docs, ["source"], F.col("n_chars"), {f"p{int(p * 100)}": p for p in (0.5, 0.9, 0.95, 0.99)}, told)


KNOWN_TYPES = ["click", "view", "purchase", "login", "logout", "signup", "search"]


def q67_multi_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("s"))
    return rows.select("user_id", F.array_join(F.transform(C.multi_hot(F.col("s"), KNOWN_TYPES), lambda x: x.cast("string")), "").alias("flags"))


def q68_json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count(k).alias("n_with_k"), F.sum(k.cast("double")).alias("sum_k"), F.max(k.cast("double")).alias("max_k")
    )


def q69_family_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(
        "source", F.lit("-"), F.substring(F.md5(F.col("doc_id").cast("string")), 1, 10), F.lit("-"), (F.col("doc_id") % 7).cast("string"), F.lit(".raw")
    )
    rows = table(spark, sf_dir, "documents").select(name.alias("category"))
    return rows.select(
        C.family_of(F.col("category")).alias("family"), C.strip_dump_suffix(F.col("category")).alias("sample")
    ).groupBy("family").agg(F.count("*").alias("n"), F.count_distinct("sample").alias("n_samples"))


def q86_category_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")).select(
        "event_type", C.category_index(F.col("event_type"), KNOWN_TYPES).alias("idx"), "n"
    )


def q87_sigmoid_logit(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = (F.col("doc_id") % 1001).cast("double") / 1000.0
    return table(spark, sf_dir, "documents").select("doc_id", F.round(C.logit(p), 9).alias("margin"), F.round(C.sigmoid(C.logit(p)), 9).alias("p"))


def q88_float32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that single precision makes equal though double precision tells them apart."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("x"))
    return rows.agg(F.count_distinct("x").alias("n_double"), F.count_distinct(F.col("x").cast("float")).alias("n_single"))


def q89_window_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joint histogram of local entropy and byte value over windows of 2048 bytes at steps of 1024 (a shorter
    file is one window, its counts still over 2048), summed over all documents: 16 entropy rows, 16 nibbles."""
    return byteops.window_entropy(table(spark, sf_dir, "documents"), "text").groupBy("row", "nibble").agg(F.sum("n").alias("n"))


def q96_printable_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the printable characters of each page's strings are spread."""
    got = byteops.printable_profile(table(spark, sf_dir, "pages"), "page_id", "html")
    return got.select("page_id", "n_strings", "n_printable", F.round("entropy", 9).alias("entropy"), "n_kinds")


QUERIES = {
    f.__name__: f
    for f in (
        q60_safe_ratios, q61_zscores, q62_byte_entropy, q63_byte_histogram, q64_string_stats, q65_category_counts, q66_length_percentiles, q67_multi_hot, q68_json_extract, q69_family_parse, q86_category_index, q87_sigmoid_logit, q88_float32, q89_window_entropy, q96_printable_spread,
    )
}
PAIRS = "p AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS byte FROM documents), c AS (SELECT doc_id, byte, count(*) AS n FROM p GROUP BY ALL)"
RUNS = r"r AS (SELECT *, regexp_extract_all({0}, '([\x20-\x7f]{{5,}})') AS runs FROM {1})"
COUNTED = " UNION ALL ".join(
    f"SELECT '{name}' AS category, len(list_filter(runs, lambda s: regexp_matches(s, '{pattern.replace(chr(39), chr(39) * 2)}'))) AS n FROM r"
    for name, pattern in ((k, v.replace("#[\\]", "#\\[\\]").replace("0-9-._", "0-9\\-._")) for k, v in strings.categories().items())
)
ORACLE_SQL = {
    "q60_safe_ratios": "WITH o AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F')::DOUBLE AS a, count(*) FILTER (o_orderstatus = 'P')::DOUBLE AS b, count(*)::DOUBLE AS n FROM orders GROUP BY 1) SELECT o_custkey, coalesce(a / nullif(b, 0), 0.0) AS a_per_b, coalesce(b / nullif(a, 0), 0.0) AS b_per_a, coalesce(a / nullif(n, 0), 0.0) AS a_share FROM o",
    "q61_zscores": """WITH x AS (SELECT i::INT AS i, embedding[i + 1]::DOUBLE AS x FROM embeddings, (SELECT unnest(range(64)) AS i)), s AS (SELECT i, avg(x) AS mean, coalesce(nullif(stddev_pop(x), 0), 1) AS std FROM x GROUP BY i)
 SELECT i, round(max(mean), 9) AS mean, round(max(std), 9) AS std, round(max((x - mean) / std), 6) AS max_z, round(min((x - mean) / std), 6) AS min_z FROM x JOIN s USING (i) GROUP BY i""",
    "q62_byte_entropy": f"WITH {PAIRS} SELECT doc_id, sum(n)::BIGINT AS size, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 9) AS entropy FROM c GROUP BY doc_id",
    "q63_byte_histogram": f"WITH {PAIRS} SELECT ('0x' || byte)::INT AS byte, sum(n)::BIGINT AS n, sum(n)::DOUBLE / sum(sum(n)) OVER () AS share FROM c GROUP BY byte",
    "q64_string_stats": f"WITH {
        RUNS.format('text', 'documents')
    } SELECT doc_id, len(runs)::BIGINT AS n_strings, length(array_to_string(runs, ''))::BIGINT AS n_printable, coalesce(length(array_to_string(runs, ''))::DOUBLE / nullif(len(runs), 0), 0.0) AS mean_length FROM r",
    "q65_category_counts": f"WITH {
        RUNS.format('html', 'pages')
    }, m AS ({COUNTED}) SELECT category, sum(n)::BIGINT AS n_strings, count(*) AS n_pages FROM m WHERE n > 0 GROUP BY category",
    "q66_length_percentiles": "SELECT source, count(*) AS n, min(n_chars) AS least, max(n_chars) AS most, avg(n_chars) AS mean, quantile_cont(n_chars, 0.5) AS p50, quantile_cont(n_chars, 0.9) AS p90, quantile_cont(n_chars, 0.95) AS p95, quantile_cont(n_chars, 0.99) AS p99 FROM documents GROUP BY source",
    "q96_printable_spread": f"""WITH {RUNS.format('html', 'pages')}, j AS (SELECT page_id, len(runs)::BIGINT AS n_strings, array_to_string(runs, '') AS s FROM r), x AS (SELECT page_id, unnest(string_split(s, '')) AS c FROM j),
 c AS (SELECT page_id, c, count(*) AS n FROM x WHERE c <> '' GROUP BY ALL), e AS (SELECT page_id, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 9) AS entropy, count(*) AS k FROM c GROUP BY page_id)
 SELECT page_id, n_strings, length(s)::BIGINT AS n_printable, coalesce(entropy, 0.0) AS entropy, coalesce(k, 0) AS n_kinds FROM j LEFT JOIN e USING (page_id)""",
    "q67_multi_hot": "SELECT user_id, " + " || ".join(
        f"CAST(bool_or(event_type = '{t}') AS INT)::VARCHAR" for t in KNOWN_TYPES
    ) + " AS flags FROM events GROUP BY user_id",
    "q68_json_extract": "SELECT event_type, count(json_extract_string(props, '$.k')) AS n_with_k, sum(json_extract_string(props, '$.k')::DOUBLE) AS sum_k, max(json_extract_string(props, '$.k')::DOUBLE) AS max_k FROM events GROUP BY event_type",
    "q69_family_parse": "WITH c AS (SELECT regexp_replace(source || '-' || substr(md5(doc_id::VARCHAR), 1, 10) || '-' || (doc_id % 7) || '.raw', '^(.+)-([0-9]+)\\.raw$', '\\1') AS sample FROM documents) SELECT regexp_replace(sample, '-[0-9a-fA-F]{6,}$', '') AS family, count(*) AS n, count(DISTINCT sample) AS n_samples FROM c GROUP BY 1",
    "q86_category_index": "SELECT event_type, CAST(coalesce(list_position([" + ", ".join(
        f"'{t}'" for t in KNOWN_TYPES
    ) + "], event_type) - 1, 0) AS BIGINT) AS idx, count(*) AS n FROM events GROUP BY event_type",
    "q87_sigmoid_logit": "WITH p AS (SELECT doc_id, greatest(least((doc_id % 1001)::DOUBLE / 1000.0, 1 - 1e-7::DOUBLE), 1e-7::DOUBLE) AS q FROM documents), m AS (SELECT doc_id, ln(q / (1 - q)) AS z FROM p) SELECT doc_id, round(z, 9) AS margin, round(1 / (1 + exp(-z)), 9) AS p FROM m",
    "q88_float32": "WITH x AS (SELECT l_extendedprice * (1 - l_discount) AS x FROM lineitem) SELECT count(DISTINCT x) AS n_double, count(DISTINCT x::FLOAT) AS n_single FROM x",
    "q89_window_entropy": """WITH h AS (SELECT doc_id, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM documents WHERE text <> ''), b AS (SELECT doc_id, h, unnest(CASE WHEN n < 2048 THEN [0::BIGINT] ELSE range(0, n - 2047, 1024) END) AS "at" FROM h),
 x AS (SELECT doc_id, "at", substr(pair, 1, 1) AS nibble FROM (SELECT doc_id, "at", unnest(regexp_extract_all(substr(h, "at" * 2 + 1, 4096), '..')) AS pair FROM b)), c AS (SELECT doc_id, "at", nibble, count(*) AS c FROM x GROUP BY ALL),
 e AS (SELECT *, round(-sum(c / 2048.0::DOUBLE * log2(c / 2048.0::DOUBLE)) OVER (PARTITION BY doc_id, "at") * 4, 9) AS h2 FROM c) SELECT least(floor(h2), 15)::INT AS row, ('0x' || nibble)::INT AS nibble, sum(c)::BIGINT AS n FROM e GROUP BY 1, 2""",
}
