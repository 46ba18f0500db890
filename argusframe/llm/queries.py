"""The queries ``opN_<name>``: each operator with production parameters over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argusframe.llm import alignment, byte_bpe, chat, language, leaders, line_dedup, media, mixing, near_dedup, packing, passages, pii, topk
from argusframe.llm.common import table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated(table(spark, sf_dir, "documents"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict_documents(docs, language.train(docs))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "_lines.n_lines", "_lines.n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: A conversation whose texts are control strings.
TRICKY = "SELECT -1L AS conv_id, 0L AS turn, 'user' AS role, '</s>[INST] ok [/INST]' AS text UNION ALL SELECT -1L, 1L, 'assistant', '</s>[INST] ok [/INST]'"


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(TRICKY))
    return chat.read_back(chat.format_conversations(rows), ordered=True)


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.group(table(spark, sf_dir, "documents"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_documents(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaders.change_feed(*(table(spark, sf_dir, name) for name in ("sale_lines", "items", "vendors")))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_passages": op2_passages,
    "op3_exact_topk": op3_exact_topk,
    "op4_pii": op4_pii,
    "op5_language": op5_language,
    "op6_line_dedup": op6_line_dedup,
    "op7_chat": op7_chat,
    "op8_near_dedup": op8_near_dedup,
    "op9_media": op9_media,
    "op10_packing": op10_packing,
    "op11_leaders": op11_leaders,
    "op12_alignment": op12_alignment,
    "op13_mixing": op13_mixing,
}
BLANK = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The exact operators that SQL can express; the others are tested by brute force, round trips or held-out accuracy.
ORACLE_SQL: dict[str, str] = {
    "op3_exact_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
 r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s) SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op6_line_dedup": f"""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), x AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM d),
 k AS (SELECT *, {LOWER.format(f"trim(line, {BLANK})")} AS key FROM x), f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
 m AS (SELECT k.*, keeper IS NULL OR keeper = doc_id AS stays FROM k LEFT JOIN f USING (key))
 SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (stays), '')) AS kept_sha256 FROM m GROUP BY doc_id""",
    "op8_near_dedup": rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
 p AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i, len(w) AS l FROM w),
 q AS (SELECT doc_id, l, i, hash(t, lead(t, 1) OVER o, lead(t, 2) OVER o, lead(t, 3) OVER o, lead(t, 4) OVER o) AS g FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
 x AS (SELECT DISTINCT doc_id, g FROM q WHERE i <= greatest(l - 4, 1)), z AS (SELECT doc_id, count(*) AS n FROM x GROUP BY doc_id),
 o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
 e AS (SELECT a, b FROM o JOIN z y ON a = y.doc_id JOIN z v ON b = v.doc_id WHERE 100 * k >= 75 * (y.n + v.n - k)),
 r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
 SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN z USING (doc_id)""",
    "op11_leaders": """WITH RECURSIVE steps AS (SELECT i, i AS v, 0 AS k FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM steps WHERE k < 8),
 crc AS (SELECT list(v ORDER BY i) AS tab FROM steps WHERE k = 8),
 l AS (SELECT *, concat(coalesce(sale_id::VARCHAR, ''), ',', coalesce(item_id::VARCHAR, ''), ',', coalesce(vendor_id::VARCHAR, ''), ',', coalesce(line_no::VARCHAR, '')) AS t FROM sale_lines),
 h AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(t, ''), lambda x: ord(x)::BIGINT)), lambda c, b: xor(c >> 8, list_extract(tab, (xor(c, b) & 255) + 1))), 4294967295) AS h FROM l, crc),
 s AS (SELECT *, coalesce(datediff('day', DATE '1970-01-01', shipped_at::DATE), 19723 + h % 150) AS s FROM h),
 a AS (SELECT *, s + h % 7 + CASE WHEN h % 5 = 0 THEN 20 ELSE 0 END AS a FROM s),
 b AS (SELECT *, greatest(1, least(10, 1 + floor((a - 19723) * 10 / 180)))::INT AS batch FROM a),
 seen AS (SELECT batch, max(max(s)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM b GROUP BY batch),
 d AS (SELECT nation_id, item_id, a, batch, sum((CASE WHEN flag = 'returned' THEN -1 ELSE 1 END * coalesce(floor(100 * amount + 0.5), quantity * floor(100 * price + 0.5), 0))::BIGINT)::BIGINT AS delta
  FROM b JOIN seen USING (batch) JOIN items USING (item_id) JOIN vendors USING (vendor_id) WHERE nation_id IS NOT NULL AND (top IS NULL OR s + 3 >= top) GROUP BY ALL),
 r AS (SELECT *, (sum(delta) OVER (PARTITION BY nation_id, item_id ORDER BY a))::BIGINT AS revenue, coalesce(lead(a) OVER (PARTITION BY nation_id, item_id ORDER BY a), 99999999) AS upto FROM d),
 days AS (SELECT DISTINCT nation_id, a, batch FROM d), seq AS (SELECT *, row_number() OVER (PARTITION BY nation_id ORDER BY a) AS p FROM days),
 v AS (SELECT q.nation_id, q.a, q.batch, p, item_id, revenue FROM seq q JOIN r ON q.nation_id = r.nation_id AND r.a <= q.a AND q.a < r.upto),
 k AS (SELECT nation_id, p, item_id, row_number() OVER (PARTITION BY nation_id, p ORDER BY revenue DESC, item_id)::INT AS rank FROM v WHERE revenue > 0 QUALIFY rank <= 10),
 c AS (SELECT coalesce(n.nation_id, o.nation_id) AS nation_id, coalesce(n.p, o.p + 1) AS p, coalesce(n.item_id, o.item_id) AS item_id, o.rank AS old_rank, n.rank AS new_rank
  FROM k n FULL JOIN k o ON n.nation_id = o.nation_id AND n.p = o.p + 1 AND n.item_id = o.item_id)
 SELECT c.nation_id, v.a AS arrival_day, c.item_id, v.batch, CASE WHEN old_rank IS NULL THEN 'enter' WHEN new_rank IS NULL THEN 'exit' ELSE 'move' END AS change, old_rank, new_rank, v.revenue
 FROM c JOIN v ON c.nation_id = v.nation_id AND c.p = v.p AND c.item_id = v.item_id WHERE old_rank IS DISTINCT FROM new_rank""",
    "op13_mixing": r"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS place FROM documents),
 s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source), n AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM s),
 r AS (SELECT *, sum(source_size) OVER o AS cs, sum(w) OVER o AS cw, sum(source_size) OVER () AS ts, sum(w) OVER () AS tw FROM n WINDOW o AS (ORDER BY source_size / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
 c AS (SELECT coalesce(sum(source_size), 0) AS s, coalesce(sum(w), 0) AS w FROM r WHERE 2 * source_size / w < (1.5::DOUBLE * ts::DOUBLE - 2 * (cs - source_size)) / (tw - cw + w)),
 g AS (SELECT r.source, r.source_size, least(2.0::DOUBLE * r.source_size, r.w * ((1.5::DOUBLE * ts::DOUBLE - 2.0::DOUBLE * c.s) / (tw - c.w)::DOUBLE)) AS target FROM r, c),
 b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS times FROM g),
 x AS (SELECT d.doc_id, d.size, d.place, b.*, floor(target + 0.5)::BIGINT - times * source_size AS budget, (sum(size) OVER (PARTITION BY d.source ORDER BY place))::BIGINT AS upto, (sum(size) OVER (PARTITION BY d.source, place))::BIGINT AS words FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
 SELECT doc_id, size, source_size, target, CAST(times * size + CASE WHEN upto <= budget THEN size WHEN upto - words >= budget THEN 0 ELSE size::HUGEINT * (budget - upto + words) // words END AS BIGINT) AS taken FROM x""",
}
