"""Readers that validate: schemas are given, never inferred, and what does not fit fails loudly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from argusframe.functions.columns import digest_or_null, is_error, safe_ratio
from argusframe.sources import pushdown

# The columns of flow captures, those that identify machines, and the labels that occur.
IDENTITY_COLUMNS = ["Flow ID", "Src IP", "Src Port", "Dst IP"]
FLOW_COLUMNS = [
    "Dst Port", "Protocol", "Timestamp", "Flow Duration", "Tot Fwd Pkts", "Tot Bwd Pkts", "TotLen Fwd Pkts", "TotLen Bwd Pkts", "Fwd Pkt Len Max", "Fwd Pkt Len Min", "Fwd Pkt Len Mean", "Fwd Pkt Len Std",
    "Bwd Pkt Len Max", "Bwd Pkt Len Min", "Bwd Pkt Len Mean", "Bwd Pkt Len Std", "Flow Byts/s", "Flow Pkts/s", "Flow IAT Mean", "Flow IAT Std", "Flow IAT Max", "Flow IAT Min", "Fwd IAT Tot", "Fwd IAT Mean", "Fwd IAT Std",
    "Fwd IAT Max", "Fwd IAT Min", "Bwd IAT Tot", "Bwd IAT Mean", "Bwd IAT Std", "Bwd IAT Max", "Bwd IAT Min", "Fwd PSH Flags", "Bwd PSH Flags", "Fwd URG Flags", "Bwd URG Flags", "Fwd Header Len", "Bwd Header Len",
    "Fwd Pkts/s", "Bwd Pkts/s", "Pkt Len Min", "Pkt Len Max", "Pkt Len Mean", "Pkt Len Std", "Pkt Len Var", "FIN Flag Cnt", "SYN Flag Cnt", "RST Flag Cnt", "PSH Flag Cnt", "ACK Flag Cnt", "URG Flag Cnt", "CWE Flag Count",
    "ECE Flag Cnt", "Down/Up Ratio", "Pkt Size Avg", "Fwd Seg Size Avg", "Bwd Seg Size Avg", "Fwd Byts/b Avg", "Fwd Pkts/b Avg", "Fwd Blk Rate Avg", "Bwd Byts/b Avg", "Bwd Pkts/b Avg", "Bwd Blk Rate Avg",
    "Subflow Fwd Pkts", "Subflow Fwd Byts", "Subflow Bwd Pkts", "Subflow Bwd Byts", "Init Fwd Win Byts", "Init Bwd Win Byts", "Fwd Act Data Pkts", "Fwd Seg Size Min", "Active Mean", "Active Std", "Active Max", "Active Min",
    "Idle Mean", "Idle Std", "Idle Max", "Idle Min", "Label",
]
FLOW_FEATURES = [c for c in FLOW_COLUMNS if c not in ("Timestamp", "Label")]
FLOW_LABELS = [
    "Benign", "Bot", "Brute Force -Web", "Brute Force -XSS", "DDOS attack-HOIC", "DDOS attack-LOIC-UDP", "DDoS attacks-LOIC-HTTP", "DoS attacks-GoldenEye", "DoS attacks-Hulk", "DoS attacks-SlowHTTPTest", "DoS attacks-Slowloris",
    "FTP-BruteForce", "Infilteration", "SQL Injection", "SSH-Bruteforce",
]
MEMORY_FEATURES = 55
EMULATION_KEYS = ["ep_type", "start_addr", "ep_args", "apihash", "apis", "ret_val", "error", "dynamic_code_segments"]
BENIGN_FAMILIES = ["clean", "windows_syswow64"]


class BadSource(ValueError):
    """A source that is not what its reader was built for."""


def header_of(spark: SparkSession, path: str) -> list[str]:
    first = spark.read.text(path).limit(1).collect()
    if not first:
        raise BadSource(f"{path} is empty")
    return first[0].value.split(",")


def day_of(path: Column) -> Column:
    """A file's name up to its first underscore."""
    return F.split_part(F.element_at(F.split(path, "/"), -1), F.lit("_"), F.lit(1))


def read_memory(spark: SparkSession, path: str) -> DataFrame:
    """Snapshots: Category, 55 numeric columns, Class (Benign or Malware), plus label. A number that does not
    parse fails the read; a Class outside the two fails when the row is read."""
    names = header_of(spark, path)
    if not names or names[0] != "Category" or names[-1] != "Class" or len(names) != MEMORY_FEATURES + 2 or len(set(names)) != len(names):
        raise BadSource(f"{path}: expected Category, {MEMORY_FEATURES} features, Class; got {len(names)} columns")
    schema = T.StructType([T.StructField(n, T.StringType() if n in ("Category", "Class") else T.DoubleType()) for n in names])
    rows = spark.read.csv(path, schema=schema, header=True, mode="FAILFAST")
    bad = F.raise_error(F.concat(F.lit("unknown Class: "), F.coalesce("`Class`", F.lit("null"))))
    return rows.withColumn("label", F.when(F.col("Class").isin("Benign", "Malware"), (F.col("Class") == "Malware").cast("int")).otherwise(bad.cast("int")))


# Each derived ratio by the columns that are added up above and below the line.
MEMORY_RATIOS = {
    "callbacks_anonymous_ratio": (["callbacks.nanonymous"], ["callbacks.ncallbacks"]),
    "svcscan_driver_ratio": (["svcscan.kernel_drivers", "svcscan.fs_drivers"], ["svcscan.nservices"]),
    "handles_file_ratio": (["handles.nfile"], ["handles.nhandles"]),
    "handles_mutant_ratio": (["handles.nmutant"], ["handles.nhandles"]),
    "psxview_hiding_score": (
        [f"psxview.not_in_{x}" for x in ("pslist", "eprocess_pool", "ethread_pool", "pspcid_list", "csrss_handles", "session", "deskthrd")], ["pslist.nproc"]
    ),
    "ldrmodules_hidden_ratio": (["ldrmodules.not_in_load", "ldrmodules.not_in_init", "ldrmodules.not_in_mem"], ["dlllist.ndlls"]),
    "malfind_injection_rate": (["malfind.ninjections"], ["pslist.nproc"]),
}


def with_memory_ratios(rows: DataFrame) -> DataFrame:
    add = lambda names: sum((F.col(f"`{n}`") for n in names[1:]), F.col(f"`{names[0]}`"))
    return rows.withColumns({k: safe_ratio(add(a), add(b)) for k, (a, b) in MEMORY_RATIOS.items()})


def memory_features(columns: list[str]) -> list[str]:
    """Feature columns in their order: raw ones as they come, derived ones once, at the end."""
    return [c for c in columns if c not in ("Category", "Class", "label", *MEMORY_RATIOS)] + list(MEMORY_RATIOS)


def flow_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All columns of both layouts as text, with capture_day; columns that name machines are dropped."""
    out = None
    for path in paths:
        names = header_of(spark, path)
        if names not in (FLOW_COLUMNS, IDENTITY_COLUMNS + FLOW_COLUMNS):
            raise BadSource(f"{path}: neither layout; got {len(names)} columns")
        raw = spark.read.csv(
            path, schema=T.StructType([T.StructField(n, T.StringType()) for n in names]), header=True, mode="FAILFAST", ignoreLeadingWhiteSpace=False
        )
        raw = raw.select("*", day_of(F.col("_metadata.file_path")).alias("capture_day")).drop(*IDENTITY_COLUMNS)
        out = raw if out is None else out.unionByName(raw)
    if out is None:
        raise BadSource("no files")
    return out


def dropped_labels(spark: SparkSession, paths: list[str]) -> DataFrame:
    """label_raw and n of the rows that ``read_flows`` leaves out for their label."""
    rows = flow_lines(spark, paths)
    known = F.coalesce(F.col("Label").isin(FLOW_LABELS), F.lit(False))
    return rows.where(~known).groupBy(F.col("Label").alias("label_raw")).agg(F.count("*").alias("n"))


def read_flows(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Flows of files in either layout: capture_day, Timestamp, 78 floats, label_raw, label. Rows of unknown label
    (repeated headers; ``dropped_labels`` counts them) and of unusable rates are left out."""
    known = flow_lines(spark, paths).where(F.col("Label").isin(FLOW_LABELS))
    number = lambda c: F.when(F.trim(F.col(f"`{c}`")) != "", F.regexp_replace(F.trim(F.col(f"`{c}`")), "(?i)^([+-]?)inf(inity)?$", "$1Infinity")).cast("double")
    typed = known.select("capture_day", "Timestamp", *[number(c).alias(c) for c in FLOW_FEATURES], F.col("Label").alias("label_raw"))
    usable = lambda c: F.col(f"`{c}`").isNotNull() & ~F.isnan(F.col(f"`{c}`")) & (F.abs(F.col(f"`{c}`")) < float("inf"))
    fine = typed.where(usable("Flow Byts/s") & usable("Flow Pkts/s"))
    return fine.select(
        "capture_day", "Timestamp", *[F.col(f"`{c}`").cast("float").alias(c) for c in FLOW_FEATURES], "label_raw",
        (F.lower(F.trim("label_raw")) != "benign").cast("int").alias("label")
    )


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """value and line, counted from 0 across the file. A file's lines stand in order in its partitions, so a line's
    number is its place there plus the lines of the partitions before, of which only the counts meet."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("_id"))
    lines = lines.select("value", F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"))
    before = F.coalesce(F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = lines.groupBy("_part").agg(F.count("*").alias("n")).select("_part", before.alias("_before"))
    return lines.join(F.broadcast(bases), "_part").select("value", (F.col("_before") + F.col("_at")).alias("line"))  # a row a partition


def read_text_traces(spark: SparkSession, traces: str, labels: str) -> DataFrame:
    """Traces one a line, families one a line, joined by line number: id (digest of the line), family_raw, label 1, api_calls."""
    t, f = numbered_lines(spark, traces), numbered_lines(spark, labels).withColumnRenamed("value", "family_raw")
    calls = F.filter(F.split(F.lower("value"), r"\s+"), lambda x: x != "")
    return t.join(f, "line", "left").select(
        F.sha2("value", 256).alias("id"), F.lit("text").alias("source"), F.trim("family_raw").alias("family_raw"), F.lit(1).alias("label"),
        calls.alias("api_calls")
    )


def read_ragged_traces(spark: SparkSession, path: str) -> DataFrame:
    """A wide table of sha256, labels, 0, 1, ...: the numbered columns in numeric order, without empty cells."""
    names = header_of(spark, path)
    numbered = sorted((n for n in names if n.isdigit()), key=int)
    if not {"sha256", "labels"} <= {*names} or not numbered:
        raise BadSource(f"{path}: expected sha256, labels and numbered columns")
    rows = spark.read.csv(path, schema=T.StructType([T.StructField(n, T.StringType()) for n in names]), header=True)
    calls = F.transform(F.filter(F.array(*[F.col(f"`{n}`") for n in numbered]), lambda x: x.isNotNull() & (F.trim(x) != "")), lambda x: F.lower(F.trim(x)))
    return rows.select(
        F.col("sha256").alias("id"), F.lit("ragged").alias("source"), F.lit(None).cast("string").alias("family_raw"),
        F.col("labels").cast("int").alias("label"), calls.alias("api_calls")
    )


def read_json_traces(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object {name: benign, apis: [[...], ...]}: every list is a row of label 0."""
    one = spark.read.json(path, schema="name string, apis array<array<string>>", multiLine=True, mode="FAILFAST")
    name = F.when(F.col("name") == "benign", F.col("name")).otherwise(F.raise_error(F.lit("name is not benign")))
    lists = one.select(name.alias("name"), F.explode("apis").alias("c"))
    calls = F.transform("c", lambda x: F.lower(x))
    return lists.select(
        F.sha2(F.array_join("c", " "), 256).alias("id"), F.col("name").alias("source"), F.lit(None).cast("string").alias("family_raw"), F.lit(0).alias("label"),
        calls.alias("api_calls")
    )


def parse_trace(text: Column) -> Column:
    """A flat JSON list of strings; anything else is null."""
    flat = F.from_json(text, "array<string>")
    return F.when(text.rlike(r'^\s*\[\s*("(?:[^"\\]|\\.)*"\s*(,\s*"(?:[^"\\]|\\.)*"\s*)*)?\]\s*$'), flat)


def split_of(path: Column) -> Column:
    return F.regexp_extract(path, r".*/(train|test)[^/]*/", 1)


def emulation_family(path: Column) -> Column:
    return F.regexp_extract(path, r"/report_([^/]+)/", 1)


def sample_of(path: Column) -> Column:
    """The 64 hexadecimal digits a file's name starts with, else the name without its endings."""
    name = F.element_at(F.split(path, "/"), -1)
    digest = F.regexp_extract(name, "^([0-9a-fA-F]{64})", 1)
    return F.when(digest != "", digest).otherwise(F.regexp_replace(name, r"(\.dat)?\.json$", ""))


def read_emulation(spark: SparkSession, root: str) -> DataFrame:
    """A tree of reports, each a JSON list of entry points with all required keys: one row an entry point, the
    entry itself kept as text."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json").select("value", F.col("_metadata.file_path").alias("path"))
    files = files.select("path", F.from_json("value", "array<string>").alias("entries"))
    fine = F.when(F.col("entries").isNotNull(), F.col("entries")).otherwise(F.raise_error(F.concat(F.lit("not a list: "), F.col("path"))))
    parsed = F.transform(fine, lambda raw: F.struct(raw.alias("raw"), F.parse_json(raw).alias("entry")))  # the one parse of an entry
    rows = files.select("path", F.posexplode(parsed).alias("ep_index", "e")).select("path", "ep_index", "e.*")
    missing = F.array_compact(F.array(*[F.when(F.try_variant_get("entry", f"$.{k}", "variant").isNull(), F.lit(k)) for k in EMULATION_KEYS]))
    whole = F.when(F.size(missing) == 0, True).otherwise(F.raise_error(F.concat(F.lit("keys missing: "), F.col("path"))).cast("boolean"))
    rows = rows.where(whole)  # a filter, so that no choice of columns goes round it
    text = lambda k: F.try_variant_get("entry", f"$.{k}", "string")
    rows = rows.select(
        sample_of(F.col("path")).alias("sample_id"), "ep_index", text("ep_type").alias("ep_type"), emulation_family(F.col("path")).alias("family"), split_of(F.col("path")).alias("split"),
        text("apihash").alias("apihash"), F.try_variant_get("entry", "$.apis", "array<struct<api_name:string>>")["api_name"].alias("api_names"),
        is_error(text("error")).alias("has_error"), F.col("raw").alias("raw_entry_json"),
    )
    return rows.withColumn("n_apis", F.size("api_names")).withColumn("label", (~F.col("family").isin(BENIGN_FAMILIES)).cast("int"))


def read_files(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """path, length, content, sha256 of binary files; longer ones are left out before their bytes are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if most is not None:
        files = files.where(F.col("length") <= most)
    return files.select("path", "length", "content", F.sha2("content", 256).alias("sha256"))


def read_digests(spark: SparkSession, path: str, table: str = "FILE", column: str = "sha256") -> DataFrame:
    """One text column of an SQLite table, in ranges of rows; null and empty values are left out there, as is whatever a
    later filter on the column rules out."""
    return pushdown.read_sqlite(spark, path, table, f"{column} string").where(F.col(column) > "")


def write_digests(digests: DataFrame, column: str, path: str) -> None:
    """The allowlist artifact: valid digests as 32 bytes in byte order. Nothing valid is an error."""
    valid = digests.select(digest_or_null(F.col(column)).alias("sha256")).where("sha256 IS NOT NULL")
    if valid.isEmpty():
        raise BadSource("no valid digest")
    valid.orderBy("sha256").write.mode("overwrite").parquet(path)


def write_splits(rows: DataFrame, path: str, excluded: DataFrame | None = None) -> None:
    """One folder a split, and what was excluded beside them, so nothing is lost silently."""
    rows.write.mode("overwrite").partitionBy("split").option("maxRecordsPerFile", 1_000_000).parquet(f"{path}/splits")
    if excluded is not None:
        excluded.write.mode("overwrite").parquet(f"{path}/excluded")


def write_vocabulary(vocab: DataFrame, path: str) -> None:
    vocab.select("token_id", "token").write.mode("overwrite").json(path)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema="token_id int, token string", mode="FAILFAST")


def security_events(decided: DataFrame) -> DataFrame:
    """Each row as JSON with a time stamp and an id of its own."""
    row = F.struct(*decided.columns, F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("timestamp"), F.uuid().alias("correlation_id"))
    return decided.select(F.to_json(row).alias("event"))
