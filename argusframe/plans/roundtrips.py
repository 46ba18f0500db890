"""Sources and sinks: rows of the supplied tables written in a foreign layout below the shared folder, read back by
their reader, and compared with SQL over the tables. The files go once the result is kept."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from argusframe.checkpoints import delete, materialize, scratch, shared_dir
from argusframe.operators import sequences
from argusframe.plans.scans import HEAD, files
from argusframe.plans.tables import table
from argusframe.sources import pe, pushdown, readers


@contextlib.contextmanager
def folder(spark: SparkSession) -> Iterator[str]:
    path = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        delete(path)


def rename_parts(spark: SparkSession, path: str, pattern: str) -> None:
    """Name the part files of a folder by a pattern with their number."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(at))
    for i, name in enumerate(n for n in names if n.startswith("part-")):
        fs.rename(jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"), jvm.org.apache.hadoop.fs.Path(f"{path}/{pattern.format(i)}"))
    for name in names:
        if not name.startswith("part-"):
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"), True)


NEEDED = sorted({n for a, b in readers.MEMORY_RATIOS.values() for n in a + b})
MEMORY_NAMES = NEEDED + [f"x{i}" for i in range(readers.MEMORY_FEATURES - len(NEEDED))]


def memory_cell(j: int) -> Column:
    return (F.col("doc_id") * (j + 3) % 97).cast("double")


def s01_memory_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV with a header a file, validated, with the derived ratios."""
    docs = table(spark, sf_dir, "documents")
    cells = [memory_cell(j).alias(n) for j, n in enumerate(MEMORY_NAMES)]
    rows = docs.select(
        F.concat(F.lit("Fam-"), F.col("doc_id").cast("string")).alias("Category"), *cells,
        F.when(F.col("doc_id") % 3 == 0, "Benign").otherwise("Malware").alias("Class")
    )
    with folder(spark) as path:
        rows.write.option("header", True).csv(path)
        got = readers.with_memory_ratios(readers.read_memory(spark, path))
        return materialize(got.select("Category", "label", *[F.round(r, 9).alias(r) for r in readers.MEMORY_RATIOS]), "memory-snapshots")


def flow_cells() -> dict[str, Column | str]:
    """Line items as flows, by column, constants as they are: unknown labels, and rates that are no numbers, among them."""
    i = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    labels = F.array(*map(F.lit, [*readers.FLOW_LABELS, "Label", "odd"]))
    rate = F.when(i % 11 == 0, "Infinity").when(i % 13 == 0, "NaN").when(i % 17 == 0, "").otherwise((i % 1000).cast("string"))
    own = {"Timestamp": "t", "Label": F.get(labels, (i % 17).cast("int")), "Flow Byts/s": rate, "Flow Duration": (i % 5000).cast("string")}
    return {c: own.get(c, "2") for c in readers.FLOW_COLUMNS}


def write_flows(rows: DataFrame, cells: dict[str, Column | str], path: str) -> None:
    """Comma-separated files with a header each, of cells without commas, quotes and ends of lines. Most of the 80 cells
    are constants, so a line is put together from a few pieces and written as one field."""
    pieces, fixed = [], ""
    for i, cell in enumerate(cells.values()):
        fixed += "," if i else ""
        if isinstance(cell, str):
            fixed += cell
        else:
            pieces += [F.lit(fixed), F.coalesce(cell, F.lit(""))]
            fixed = ""
    line = F.concat(*pieces, F.lit(fixed)).alias(",".join(cells))
    rows.select(line).write.option("header", True).option("sep", "\x01").option("quote", "").csv(path)


def s02_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both layouts of flow captures, named by day; what can't be used goes."""
    rows = table(spark, sf_dir, "lineitem")
    with folder(spark) as path:
        for day, status, extra in (("Monday-01", "F", []), ("Tuesday-02", "O", readers.IDENTITY_COLUMNS)):
            write_flows(rows.where(F.col("l_linestatus") == status), dict.fromkeys(extra, "m") | flow_cells(), f"{path}/{day}")
            rename_parts(spark, f"{path}/{day}", f"{day}_{{}}.csv")
        got = readers.read_flows(spark, [f"{path}/Monday-01", f"{path}/Tuesday-02"])
        return materialize(
            got.groupBy("capture_day", "label_raw", "label").agg(F.count("*").alias("n"), F.sum(F.col("Flow Duration").cast("long")).alias("duration")), "flows"
        )


def s03_dropped_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows go for their label, by label."""
    with folder(spark) as path:
        write_flows(table(spark, sf_dir, "lineitem"), flow_cells(), path)
        return materialize(readers.dropped_labels(spark, [path]), "dropped-flows")


def s04_text_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces one a line, joined by line number with families one a line."""
    items = table(spark, sf_dir, "benchmark").orderBy("item_id").coalesce(1)  # a file has one order
    with folder(spark) as path:
        items.select(F.regexp_replace("text", r"\s+", " ").alias("value")).write.text(f"{path}/traces")
        items.select(F.concat(F.lit("fam"), (F.col("item_id") % 7).cast("string")).alias("value")).write.text(f"{path}/labels")
        got = readers.read_text_traces(spark, f"{path}/traces", f"{path}/labels")
        return materialize(got.select("id", "family_raw", "label", F.size("api_calls").alias("n_calls")), "text-traces")


def s05_ragged_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide table whose numbered columns are out of order and partly empty."""
    words = F.split(F.regexp_replace("text", r"[^A-Za-z ]", ""), " +")
    cells = [F.coalesce(F.get(words, F.lit(i)), F.lit("")).alias(str(i)) for i in (0, 1, 10, 2, 3, 11, 4)]
    items = table(spark, sf_dir, "benchmark").select(F.sha2("text", 256).alias("sha256"), (F.col("item_id") % 2).alias("labels"), *cells)
    with folder(spark) as path:
        items.write.option("header", True).option("emptyValue", "").csv(path)
        got = readers.read_ragged_traces(spark, path)
        return materialize(got.select("id", "label", F.array_join("api_calls", " ").alias("api_calls")), "ragged-traces")


def s06_json_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One object of benign traces a file."""
    calls = F.filter(F.split("text", " +"), lambda w: w.rlike("^[A-Za-z]+$"))
    objects = table(spark, sf_dir, "benchmark").select(F.to_json(F.struct(F.lit("benign").alias("name"), F.array(calls).alias("apis"))).alias("value"))
    with folder(spark) as path:
        objects.write.option("maxRecordsPerFile", 1).text(path)
        got = readers.read_json_traces(spark, path)
        return materialize(got.select("source", "label", F.array_join("api_calls", " ").alias("api_calls")), "json-traces")


def s07_emulation_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of reports by split and family, a JSON list a file."""
    i = F.col("item_id")
    blank = {k: F.lit("") for k in readers.EMULATION_KEYS}
    apis = F.transform(F.sequence(F.lit(1), (i % 4 + 1).cast("int")), lambda k: F.struct(F.concat(F.lit("Api"), k.cast("string")).alias("api_name")))
    entry = blank | {
        "ep_type": F.lit("module_entry"), "apihash": F.md5(i.cast("string")), "apis": apis, "error": F.when(i % 5 == 0, F.lit("fault")).otherwise("")
    }
    lists = table(spark, sf_dir, "benchmark").select("item_id", F.to_json(F.array(F.struct(*[c.alias(k) for k, c in entry.items()]))).alias("value"))
    with folder(spark) as path:
        for n, (split, family) in enumerate((("train_a", "clean"), ("train_a", "worm"), ("test_b", "trojan"))):
            own = f"{path}/{split}/report_{family}"
            lists.where(i % 3 == n).select("value").write.option("maxRecordsPerFile", 1).text(own)
            rename_parts(spark, own, "odd{}.json")
        got = readers.read_emulation(spark, path)
        return materialize(got.select("split", "family", "label", "ep_index", "ep_type", "apihash", "n_apis", "has_error"), "emulation-reports")


def s08_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a folder with their digests; long ones are left out unread."""
    with folder(spark) as path:
        table(spark, sf_dir, "benchmark").select(F.regexp_replace("text", r"\n", " ").alias("value")).write.option("maxRecordsPerFile", 1).text(path)
        rename_parts(spark, path, "f{}.txt")
        return materialize(readers.read_files(spark, path, 400).groupBy("sha256", "length").agg(F.count("*").alias("n")), "files")


def s09_digest_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid digests as bytes in order, from hexadecimal text among which are others."""
    digest = F.when(F.col("doc_id") % 9 == 0, F.lit("no digest")).when(F.col("doc_id") % 10 == 0, None).otherwise(F.sha2("text", 256))
    with folder(spark) as path:
        readers.write_digests(table(spark, sf_dir, "documents").select(digest.alias("sha256")), "sha256", path)
        return materialize(spark.read.parquet(path).groupBy(F.lower(F.hex("sha256")).alias("sha256")).agg(F.count("*").alias("n")), "digests")


def s10_split_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One folder a split, read back with the split from the folder's name, and what was excluded beside them."""
    rows = table(spark, sf_dir, "orders").withColumn(
        "split", F.when(F.col("o_orderkey") % 10 < 7, "train").when(F.col("o_orderkey") % 10 < 9, "val").otherwise("test")
    )
    with folder(spark) as path:
        readers.write_splits(rows.where("o_orderstatus <> 'P'"), path, rows.where("o_orderstatus = 'P'"))
        kept, gone = spark.read.parquet(f"{path}/splits"), spark.read.parquet(f"{path}/excluded").withColumn("split", F.lit("excluded"))
        both = kept.select("split", "o_totalprice").unionByName(gone.select("split", "o_totalprice"))
        return materialize(both.groupBy("split").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")), "splits")


def s11_vocabulary_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = sequences.vocabulary(table(spark, sf_dir, "events"), "event_type")
    with folder(spark) as path:
        readers.write_vocabulary(vocab, path)
        return materialize(readers.read_vocabulary(spark, path), "vocabulary-file")


def s12_security_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions as JSON events: the fields come back, stamps are times in UTC, and ids are all different."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "ALLOW").otherwise("ALERT").alias("final_decision"))
    events = materialize(readers.security_events(rows), "security-events")
    field = lambda k: F.get_json_object("event", f"$.{k}")
    stamps = F.count_if(
        F.to_timestamp(field("timestamp")).between(F.current_timestamp() - F.expr("INTERVAL 1 DAY"), F.current_timestamp() + F.expr("INTERVAL 1 DAY"))
    )
    return events.groupBy(field("final_decision").alias("final_decision")).agg(
        F.count("*").alias("n"), F.sum(field("doc_id").cast("long")).alias("ids"), F.count_distinct(field("correlation_id")).alias("n_ids"),
        stamps.alias("n_stamps")
    )


def s13_feature_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of each group of the vector that follow from how the files were made."""
    got = pe.pe_features(files(spark, sf_dir).where("exists"), "doc_id")
    at = dict(zip(pe.GROUPS, accumulate([0, *pe.GROUPS.values()]), strict=False))
    f = lambda group, i=0: F.col("features")[at[group] + i].cast("long")
    total = lambda group: F.round(F.aggregate(F.slice("features", at[group] + 1, pe.GROUPS[group]), F.lit(0.0), lambda a, x: a + x), 3)
    return got.select(
        "doc_id", F.col("is_pe").cast("int").alias("is_pe"), f("general").alias("size"), f("general", 3).alias("first_byte"), total("histogram").alias("histogram"), total("byteentropy").alias("byteentropy"), f("header").alias("stamp"),
        f("section").alias("n_sections"), f("section", 221).alias("overlay"), f("imports").alias("n_imports"), f("imports", 1).alias("n_libraries"), f("exports").alias("n_exports"), f(
            "datadirectories", 2
        ).alias("import_size"), f("richheader").alias("n_tools"),
        f("authenticode").alias("n_signatures"), F.array_join("degraded", ",").alias("degraded"),
    )


def s14_file_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written as text files, each beginning with its source, and told by size and first bytes alone.
    Each task writes what it read, a file a source: no source is gathered in one task."""
    text = F.concat_ws(" ", "source", F.regexp_replace(F.coalesce("text", F.lit("")), r"[\n\r]", " "))
    with folder(spark) as path, scratch() as held:
        table(spark, sf_dir, "documents").select("source", text.alias("value")).write.partitionBy("source").text(path)
        heads = pushdown.read_heads(spark, path).where(F.col("path").endswith(".txt") & (F.col("length") > 0))
        source = F.regexp_extract("path", "source=([^/]*)/", 1)
        named = F.startswith("head", F.encode(F.concat(source, F.lit(" ")), "utf-8"))
        told = heads.groupBy(source.alias("source")).agg(F.sum("length").alias("n_bytes"), F.min(named.cast("int")).alias("is_named"))
        kept = materialize(told, "heads")
        held.pass_on(kept)
    return kept


QUERIES = {
    f.__name__: f
    for f in (
        s01_memory_snapshots, s02_flows, s03_dropped_flows, s04_text_traces, s05_ragged_traces, s06_json_traces, s07_emulation_reports, s08_files, s09_digest_artifact, s10_split_folders, s11_vocabulary_file, s12_security_events, s13_feature_groups, s14_file_heads,
    )
}
CELL = {n: f"(doc_id * {j + 3} % 97)::DOUBLE" for j, n in enumerate(MEMORY_NAMES)}
RATIOS = ", ".join(
    f"round(coalesce(({' + '.join(CELL[n] for n in a)}) / nullif({' + '.join(CELL[n] for n in b)}, 0), 0.0), 9) AS {k}" for k,
    (a, b) in readers.MEMORY_RATIOS.items()
)
LABELS = ", ".join(f"'{x}'" for x in [*readers.FLOW_LABELS, "Label", "odd"])
FLOWS = f"f AS (SELECT l_orderkey * 10 + l_linenumber AS i, l_linestatus, [{LABELS}][(l_orderkey * 10 + l_linenumber) % 17 + 1] AS label_raw FROM lineitem)"
ORACLE_SQL = {
    "s14_file_heads": "SELECT source, sum(octet_length(encode(concat(source, ' ', coalesce(text, '')))) + 1)::BIGINT AS n_bytes, 1 AS is_named FROM documents GROUP BY source",
    "s01_memory_snapshots": f"SELECT 'Fam-' || doc_id AS \"Category\", CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS label, {RATIOS} FROM documents",
    "s02_flows": f"""WITH {FLOWS} SELECT CASE WHEN l_linestatus = 'F' THEN 'Monday-01' ELSE 'Tuesday-02' END AS capture_day, label_raw, CAST(label_raw <> 'Benign' AS INT) AS label, count(*) AS n, sum(i % 5000)::BIGINT AS duration
 FROM f WHERE label_raw NOT IN ('Label', 'odd') AND i % 11 <> 0 AND i % 13 <> 0 AND i % 17 <> 0 GROUP BY ALL""",
    "s03_dropped_flows": f"WITH {FLOWS} SELECT label_raw, count(*) AS n FROM f WHERE label_raw IN ('Label', 'odd') GROUP BY 1",
    "s04_text_traces": r"SELECT sha256(regexp_replace(text, '\s+', ' ', 'g')) AS id, 'fam' || (item_id % 7) AS family_raw, 1 AS label, len(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> ''))::INT AS n_calls FROM benchmark",
    "s05_ragged_traces": "WITH w AS (SELECT text, item_id, regexp_split_to_array(regexp_replace(text, '[^A-Za-z ]', '', 'g'), ' +') AS w FROM benchmark) SELECT sha256(text) AS id, (item_id % 2)::INT AS label, array_to_string(list_filter(list_transform([w[1], w[2], w[3], w[4], w[5], w[11], w[12]], lambda x: lower(x)), lambda x: x IS NOT NULL AND x <> ''), ' ') AS api_calls FROM w",
    "s06_json_traces": "SELECT 'benign' AS source, 0 AS label, array_to_string(list_transform(list_filter(regexp_split_to_array(text, ' +'), lambda w: regexp_full_match(w, '[A-Za-z]+')), lambda w: lower(w)), ' ') AS api_calls FROM benchmark",
    "s07_emulation_reports": "SELECT CASE item_id % 3 WHEN 2 THEN 'test' ELSE 'train' END AS split, ['clean', 'worm', 'trojan'][item_id % 3 + 1] AS family, CASE item_id % 3 WHEN 0 THEN 0 ELSE 1 END AS label, 0 AS ep_index, 'module_entry' AS ep_type, md5(item_id::VARCHAR) AS apihash, (item_id % 4 + 1)::INT AS n_apis, item_id % 5 = 0 AS has_error FROM benchmark",
    "s08_files": "WITH c AS (SELECT replace(text, chr(10), ' ') || chr(10) AS c FROM benchmark) SELECT sha256(c) AS sha256, octet_length(encode(c))::BIGINT AS length, count(*) AS n FROM c WHERE octet_length(encode(c)) <= 400 GROUP BY 1, 2",
    "s09_digest_artifact": "SELECT sha256(text) AS sha256, count(*) AS n FROM documents WHERE doc_id % 9 <> 0 AND doc_id % 10 <> 0 AND text IS NOT NULL GROUP BY 1",
    "s10_split_folders": "SELECT CASE WHEN o_orderstatus = 'P' THEN 'excluded' WHEN o_orderkey % 10 < 7 THEN 'train' WHEN o_orderkey % 10 < 9 THEN 'val' ELSE 'test' END AS split, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1",
    "s11_vocabulary_file": "SELECT CAST(row_number() OVER (ORDER BY count(*) DESC, event_type) + 1 AS INT) AS token_id, event_type AS token FROM events GROUP BY event_type",
    "s12_security_events": "SELECT CASE WHEN doc_id % 2 = 0 THEN 'ALLOW' ELSE 'ALERT' END AS final_decision, count(*) AS n, sum(doc_id)::BIGINT AS ids, count(*) AS n_ids, count(*) AS n_stamps FROM documents GROUP BY 1",
    "s13_feature_groups": f"""WITH d AS (SELECT doc_id, doc_id % 5 <> 1 AS pe, octet_length(encode(coalesce(text, ''))) AS n, coalesce(text, '') AS text FROM documents WHERE doc_id % 13 <> 12)
 SELECT doc_id, pe::INT AS is_pe, (n + CASE WHEN pe THEN {len(HEAD)} ELSE 0 END)::BIGINT AS size, CASE WHEN pe THEN 77 WHEN n = 0 THEN 0 ELSE ('0x' || substr(hex(encode(text)), 1, 2))::INT END::BIGINT AS first_byte,
 CASE WHEN pe OR n > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS histogram, CASE WHEN pe OR n > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS byteentropy, CASE WHEN pe THEN 1234 ELSE 0 END::BIGINT AS stamp, pe::BIGINT AS n_sections, CASE WHEN pe THEN n ELSE 0 END::BIGINT AS overlay,
 pe::BIGINT AS n_imports, pe::BIGINT AS n_libraries, 0::BIGINT AS n_exports, CASE WHEN pe THEN 40 ELSE 0 END::BIGINT AS import_size, 0::BIGINT AS n_tools, 0::BIGINT AS n_signatures, '' AS degraded FROM d""",
}
