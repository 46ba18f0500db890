"""Raw files written here, read back under their rules."""

import hashlib
import json
import sqlite3
import struct

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from argusframe.functions import byteops, hashing, warnings
from argusframe.operators import policy
from argusframe.sources import driver, pe, readers, records, signatures


def small_pe(wide: bool = True, sections: int = 1, overlay: bytes = b"") -> bytes:
    """A minimal executable with one import by name, one by number, and one export."""
    dos = struct.pack("<14H8x2H20xI", 0x5A4D, *[0] * 15, 0x40)
    body = bytearray(0x200)
    rva = 0x1000
    size, big = (8, 1 << 63) if wide else (4, 1 << 31)
    form = "<Q" if wide else "<I"
    struct.pack_into("<5I", body, 0x00, rva + 0x40, 0, 0, rva + 0x80, rva + 0x60)
    struct.pack_into(form, body, 0x40, rva + 0x90)
    struct.pack_into(form, body, 0x40 + size, big | 7)
    body[0x80:0x8D] = b"KERNEL32.dll\0"
    body[0x92:0x9E] = b"CreateFileW\0"
    struct.pack_into("<16x6I", body, 0x100, 1, 1, 1, rva + 0x130, rva + 0x134, rva + 0x138)
    struct.pack_into("<IIH", body, 0x130, rva + 5, rva + 0x140, 0)
    body[0x140:0x146] = b"hello\0"
    directories = [(rva + 0x100, 0x40), (rva, 0x28)] + [(0, 0)] * 14
    if wide:
        optional = struct.pack("<H2B5I", 0x20B, 14, 0, 512, 0, 0, rva, rva) + struct.pack("<Q2I6H4I2H4Q2I", 0x140000000, 4096, 512, 6, 0, 0, 0, 6, 0, 0, 8192, 0x200, 0, 3, 0x160, 1, 1, 1, 1, 0, 16)
    else:
        optional = struct.pack("<H2B5I", 0x10B, 14, 0, 512, 0, 0, rva, rva) + struct.pack("<4I6H4I2H6I", 0, 0x400000, 4096, 512, 6, 0, 0, 0, 6, 0, 0, 8192, 0x200, 0, 3, 0x160, 1, 1, 1, 1, 0, 16)
    optional += b"".join(struct.pack("<2I", *d) for d in directories)
    coff = struct.pack("<2H3I2H", 0x8664 if wide else 0x14C, sections, 1234, 0, 0, len(optional), 0x22)
    table = b"".join(struct.pack("<8s4I12xI", b".text", 0x200, rva, 0x200, 0x200, 0x60000020) for _ in range(sections))
    head = (dos + b"PE\0\0" + coff + optional + table).ljust(0x200, b"\0")
    return head + bytes(body) + overlay


def test_pe_structures():
    data = small_pe(overlay=b"tail of data")
    got = pe.parse(data)
    assert got.coff[0] == 0x8664 and got.sections[0].name == ".text"
    assert pe.imports(got) == {"KERNEL32.dll": ["CreateFileW", "KERNEL32.dll:ordinal7"]}
    assert pe.exports(got) == ["hello"]


def test_pe_vector():
    data = small_pe(overlay=b"tail of data")
    ok, v, degraded = pe.vector(data)
    assert ok and v.shape == (2568,) and v.dtype == np.float32 and np.isfinite(v).all()
    assert degraded == []
    assert v[0] == len(data) and v[2] == 1 and v[7:263].sum() == pytest.approx(1, abs=1e-3)
    assert (v == pe.vector(data)[1]).all()
    at = sum(list(pe.GROUPS.values())[:6])
    assert v[at] == 2 and v[at + 1] == 1 and v[at + 2 : at + 258].sum() == 1 and v[at + 258 : at + 1282].sum() == 2
    assert pe.self_test(data) == [] and "reference_not_parsed" in pe.self_test(b"no") and pe.self_test(None) == ["reference_pe_not_found"]
    assert pe.self_test(data, signed=True) == ["authenticode_all_zero_on_signed_pe"]
    assert pe.blocking(["degraded_group:exports", "reference_pe_not_found"], policy.CRITICAL_GROUPS) == [] and pe.blocking(["degraded_group:header", "vector_nonfinite"], policy.CRITICAL_GROUPS) == ["degraded_group:header", "vector_nonfinite"]


def der(tag: int, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return bytes([tag]) + signatures.encoded_length(len(body)) + body


def signed_message(counter: bool = True, program: bool = True, self_issued: bool = False) -> bytes:
    """A message of the structure of a signature, with two certificates; nothing in it is signed."""
    name = lambda s: der(0x30, der(0x31, der(0x30, der(6, b"\x55\x04\x03"), der(0x0C, s))))
    oid = lambda b: der(6, b)
    certificate = lambda issuer, subject: der(0x30, der(0x30, der(0xA0, der(2, b"\2")), der(2, b"\1"), der(0x30, oid(b"\x2a")), name(issuer), der(0x30), name(subject)), der(0x30, oid(b"\x2a")), der(3, b"\0"))
    info = der(0x30, oid(signatures.PROGRAM_INFO), der(0x31, der(0x30, *([der(0xA0, der(0x80, b"tool"))] if program else []))))
    stamp = der(0x30, oid(signatures.SIGNING_TIME), der(0x31, der(0x17, b"200102030405Z")))
    inner = der(0x30, der(2, b"\1"), der(0x30), der(0x30), der(0xA0, stamp))
    unsigned = [der(0xA1, der(0x30, oid(signatures.COUNTER_SIGNATURE), der(0x31, inner)))] if counter else []
    signer = der(0x30, der(2, b"\1"), der(0x30), der(0x30), der(0xA0, info), der(0x30), der(4, b"x"), *unsigned)
    first = certificate(b"me", b"me") if self_issued else certificate(b"root", b"me")
    body = der(0x30, der(2, b"\1"), der(0x31), der(0x30, oid(b"\x2a")), der(0xA0, first, certificate(b"root", b"root")), der(0x31, signer))
    return der(0x30, oid(signatures.SIGNED_DATA), der(0xA0, body))


def signed_pe(message: bytes) -> bytes:
    data = bytearray(small_pe())
    entry = struct.pack("<IHH", 8 + len(message), 0x200, 2) + message
    at = data.index(struct.pack("<2I", 0x1100, 0x40)) + 8 * signatures.SECURITY
    struct.pack_into("<2I", data, at, len(data), len(entry))
    return bytes(data) + entry


def test_signatures_and_trust():
    good = signed_pe(signed_message())
    ok, v, degraded = pe.vector(good)
    at = sum(list(pe.GROUPS.values())[:10])
    assert ok and degraded == [] and v[at : at + 8].tolist() == [1, 0, 0, 0, 0, 2, np.float32(1577934245), np.float32(1577934245 - 1234)]
    odd = signatures.authenticode(signed_pe(signed_message(False, False, True)), pe.parse(signed_pe(signed_message(False, False, True))))
    assert odd == [1, 1.0, 1.0, 1.0, 0.0, 2, 0.0, 0.0]
    assert signatures.trust(good) == "chain_untrusted" and signatures.trust(good, lambda data, found: len(found) == 1) == "verified"
    assert signatures.trust(small_pe()) == "not_signed" and signatures.trust(good[:1024]) == "not_signed" and signatures.trust(None) is None
    assert signatures.trust(b"") == "parse_error" == signatures.trust(b"not a pe file at all" * 20) == signatures.trust(signed_pe(b"\x30\x84\xff\xff\xff\xffjunk"))
    assert signatures.trust(good, lambda data, found: 1 / 0) == "chain_untrusted"
    rng = np.random.default_rng(0)
    for i in range(300):  # whatever happens to a signature, it is not trusted and nothing is raised
        harmed = bytearray(good)
        harmed[int(rng.integers(1024, len(good)))] = int(rng.integers(256))
        assert signatures.trust(bytes(harmed)) in signatures.TRUST
        pe.vector(bytes(harmed))
    broken = pe.vector(signed_pe(b"\x30\x10junk"))
    assert broken[2] == ["authenticode"] and not broken[1][at : at + 8].any()


def test_warnings():
    data = small_pe(sections=2)
    found = {warnings.known(w) for w in pe.warnings_of(pe.parse(data))}
    assert None not in found and found == {"Byte 0x..."}
    flags = warnings.flags(pe.warnings_of(pe.parse(data)))
    assert len(flags) == 88 and flags[-1] == 1 and flags[2] == 1
    shifted = bytearray(data)
    at = data.index(b".text")
    struct.pack_into("<4I12xI", shifted, at + 8, 0x20000000, 0x1000, 0x90000, 0x201, 0xE0000020)
    forms = {warnings.known(w) for w in pe.warnings_of(pe.parse(bytes(shifted)))}
    assert {"...SizeOfRawData is larger than file.", "...VirtualSize is extremely large > 256MiB", "Suspicious flags set for section..."} <= forms
    assert warnings.flags(["...Contents are null-bytes.", "nothing known"])[-1] == 1


def record_of(data: bytes) -> dict:
    """The groups of a file as a record of another tool would have them."""
    p = pe.parse(data)
    o, c = p.optional, p.coff
    raw_strings = __import__("re").findall(rb"[\x20-\x7f]{5,}", data)
    joined = b"".join(raw_strings)
    spread = np.bincount(np.frombuffer(joined, np.uint8) - 0x20, minlength=96)
    values = pe.strings(data, p)
    names = list(__import__("argusframe.functions.strings", fromlist=["x"]).categories())
    header = {
        "coff": {"timestamp": c[2], "machine": "IMAGE_FILE_MACHINE_AMD64", "number_of_sections": c[1], "number_of_symbols": c[4], "sizeof_optional_header": c[5], "pointer_to_symbol_table": c[3], "characteristics": ["EXECUTABLE_IMAGE", "LARGE_ADDRESS_AWARE"]},
        "optional": {k: o[k] for k in records.OPTIONAL_MEMBERS} | {"subsystem": "IMAGE_SUBSYSTEM_WINDOWS_CUI", "dll_characteristics": ["DYNAMIC_BASE", "HIGH_ENTROPY_VA", "NX_COMPAT"]},
        "dos": dict(zip(records.DOS_MEMBERS, p.dos, strict=True)),
    }
    sections = [{"name": s.name, "size": s.size, "vsize": s.vsize, "entropy": pe.entropy(pe.counts_of(s.content), len(s.content)), "size_ratio": s.size / len(data), "vsize_ratio": s.size / s.vsize, "props": ["CNT_CODE", "MEM_EXECUTE", "MEM_READ"]} for s in p.sections]
    over = data[0x400:]
    return {
        "sha256": hashlib.sha256(data).hexdigest(), "label": 1, "general": {"size": len(data), "entropy": pe.entropy(pe.counts_of(data), len(data)), "is_pe": 1, "start_bytes": list(data[:4])}, "histogram": pe.counts_of(data).tolist(),
        "byteentropy": byteops.window_counts(np.frombuffer(data, np.uint8)).ravel().tolist(),
        "strings": {"numstrings": len(raw_strings), "avlength": len(joined) / len(raw_strings), "printabledist": spread.tolist(), "printables": len(joined), "entropy": values[99], "string_counts": {k: n for k, n in zip(names, values[100:], strict=True) if n}},
        "header": header, "section": {"entry": ".text", "sections": sections, "overlay": {"size": len(over), "size_ratio": len(over) / len(data), "entropy": pe.entropy(pe.counts_of(over), len(over))}},
        "imports": pe.imports(p), "exports": pe.exports(p), "datadirectories": [{"has_relocs": 0, "has_dynamic_relocs": 0}, *({"name": n, "size": s, "virtual_address": a} for n, (a, s) in zip(records.DIRECTORIES, p.directories, strict=True))],
        "richheader": p.rich, "authenticode": {}, "pefilewarnings": sorted(filter(None, {warnings.known(w) for w in pe.warnings_of(p)})),
    }


def test_records_make_the_vector_of_their_bytes(spark, tmp_path):
    import zipfile

    files = [small_pe(overlay=b"tail of data http://x.y " * i) for i in (1, 2, 3)]
    made = [record_of(f) for f in files]
    for data, record in zip(files, made, strict=True):
        assert np.allclose(records.vector(json.loads(json.dumps(record))), pe.vector(data)[1], rtol=1e-6)
    lines = [json.dumps(r) for r in made]
    (tmp_path / "Win32_train.jsonl").write_text("\n".join([*lines[:2], "", lines[0]]))
    (tmp_path / "ELF_train.jsonl").write_text("not for us")
    (tmp_path / "Win64_test.jsonl").write_text("not this split")
    with zipfile.ZipFile(tmp_path / "Dot_Net_train.zip", "w") as held:
        held.writestr("a.jsonl", "\n".join(lines[1:]))
    got = {r.sha256: r for r in records.read_records(spark, str(tmp_path), "train").collect()}
    assert got.keys() == {r["sha256"] for r in made}
    assert all(np.allclose(got[r["sha256"]].features, records.vector(r)) and got[r["sha256"]].label == 1 for r in made)
    unknown = [{"has_relocs": 0, "has_dynamic_relocs": 0}, {"name": "ODD", "size": 1, "virtual_address": 1}, {"name": "EXPORT", "size": 1, "virtual_address": 1}]
    for harm in ({"datadirectories": unknown}, {"histogram": [1, 2]}):
        with pytest.raises(ValueError):
            records.vector(made[0] | harm)
    assert not records.section({}).count(1.0)
    with pytest.raises(KeyError):
        records.vector({k: v for k, v in made[0].items() if k != "imports"})


def test_byte_statistics(spark):
    rows = spark.createDataFrame([(1, "abab"), (2, ""), (3, None), (4, "é")], "i int, t string")
    got = {r.i: (r.size, r.entropy) for r in byteops.byte_profile(rows, "i", "t").collect()}
    assert got == {1: (4, 1.0), 2: (0, 0.0), 3: (None, None), 4: (2, 1.0)}
    counts = {r.byte: r.n for r in byteops.byte_histogram(rows, "t").groupBy("byte").agg(F.sum("n").alias("n")).collect()}
    assert counts == {97: 2, 98: 2, 0xC3: 1, 0xA9: 1}


def test_driver_helpers(tmp_path):
    with pytest.raises(readers.BadSource):
        driver.one_database(str(tmp_path))
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.db").touch()
    assert driver.one_database(str(tmp_path)).name == "x.db"
    (tmp_path / "y.sqlite").touch()
    with pytest.raises(readers.BadSource):
        driver.one_database(str(tmp_path))
    assert driver.fetched(str(tmp_path / "y.sqlite"), 0).name == "y.sqlite" and driver.fetched(str(tmp_path / "y.sqlite"), None)
    for name, size in (("y.sqlite", 5), ("z", None)):
        with pytest.raises(readers.BadSource):
            driver.fetched(str(tmp_path / name), size)
    assert driver.write_report("text", str(tmp_path / "r.txt"), str(tmp_path / "a")).read_text() == "text"
    with pytest.raises(ValueError):
        driver.write_report("text", str(tmp_path / "a" / ".." / "a" / "r.txt"), str(tmp_path / "a"))
    assert driver.numbers("0.1, 0.5,", 0, 1) == (0.1, 0.5) and driver.counts("1e5,3") == (100_000, 3)
    for bad in ("", "x", "0,0.5", "1"):
        with pytest.raises(ValueError):
            driver.numbers(bad, 0, 1)
    with pytest.raises(ValueError):
        driver.counts("0.5")
    took = driver.latency(lambda: None, 50, 5)
    assert 0 <= took["mean_ms"] and took["p95_ms"] <= took["p99_ms"]


@pytest.mark.parametrize("data", [b"", b"MZ", b"text", small_pe()[:300], b"MZ" + b"\xff" * 400, small_pe()[:600]])
def test_pe_broken_files(data):
    _, v, degraded = pe.vector(data)
    assert v.shape == (2568,) and np.isfinite(v).all() and "authenticode" not in degraded


def test_pe_failing_group_is_named():
    def broken(data, parsed):
        raise RuntimeError

    _, v, degraded = pe.vector(small_pe(), pe.EXTRACTORS | {"header": broken, "section": lambda d, p: [float("nan")] * 224})
    assert degraded == ["header", "section"]
    assert not v[696:993].any()


def test_pe_in_spark(spark, tmp_path):
    (tmp_path / "a.exe").write_bytes(small_pe())
    (tmp_path / "b.exe").write_bytes(small_pe(wide=False))
    (tmp_path / "c.txt").write_bytes(b"no executable")
    files = readers.read_files(spark, str(tmp_path), 10_000)
    rows = {r.path[-5:]: r for r in pe.pe_features(files, "path").collect()}
    assert rows["a.exe"].is_pe and not rows["c.txt"].is_pe and len(rows["c.txt"].features) == 2568
    assert {r.sha256 for r in files.collect()} >= {hashlib.sha256(b"no executable").hexdigest()}
    assert pe.pe_features(spark.createDataFrame([(1, None)], "id int, content binary"), "id").first().features is None


def test_murmur_known_values():
    assert [hashing.murmur3_32(x) & 0xFFFFFFFF for x in (b"", b"a", b"hello", b"hello, world", b"The quick brown fox jumps over the lazy dog")] == [0, 0x3C2569B2, 0x248BFA47, 0x149BBB7F, 0x2E4FF723]
    assert hashing.hashed([("a", 2.0), ("a", 1.0)], 8).tolist().count(0.0) == 7


def memory_csv(path, rows, classes=("Benign", "Malware"), extra=0):
    needed = sorted({n for a, b in readers.MEMORY_RATIOS.values() for n in a + b})
    names = needed + [f"x{i}" for i in range(55 - len(needed) + extra)]
    lines = [",".join(["Category", *names, "Class"])] + [",".join([f"Fam-{i}", *["0" if i == 0 else str(j + 1) for j in range(len(names))], classes[i % len(classes)]]) for i in range(rows)]
    path.write_text("\n".join(lines))
    return str(path)


def test_memory(spark, tmp_path):
    rows = readers.with_memory_ratios(readers.read_memory(spark, memory_csv(tmp_path / "m.csv", 4)))
    assert len(readers.memory_features(rows.columns)) == 62 == len(set(readers.memory_features(readers.with_memory_ratios(rows).columns)))
    got = rows.orderBy("Category").collect()
    assert [r.label for r in got] == [0, 1, 0, 1] and got[0].handles_file_ratio == 0.0 and got[1].handles_file_ratio > 0
    with pytest.raises(readers.BadSource):
        readers.read_memory(spark, memory_csv(tmp_path / "n.csv", 2, extra=1))
    with pytest.raises(PySparkException):
        readers.read_memory(spark, memory_csv(tmp_path / "o.csv", 2, classes=("Benign", "Other"))).collect()


def test_flows(spark, tmp_path):
    def line(label, rate="1.5", lead=()):
        return ",".join([*lead, *[("t" if c == "Timestamp" else label if c == "Label" else rate if c == "Flow Byts/s" else "2") for c in readers.FLOW_COLUMNS]])

    a, b = tmp_path / "Monday-01_x.csv", tmp_path / "Tuesday-02_x.csv"
    a.write_text("\n".join([",".join(readers.FLOW_COLUMNS), line("Benign"), line("Bot", "Infinity"), line("Bot", "NaN"), line("Bot", ""), ",".join(readers.FLOW_COLUMNS), line("Bot")]))
    b.write_text("\n".join([",".join(readers.IDENTITY_COLUMNS + readers.FLOW_COLUMNS), line("DoS attacks-Hulk", lead=["i", "s", "1", "d"])]))
    got = readers.read_flows(spark, [str(a), str(b)]).orderBy("capture_day", "label").collect()
    assert [(r.capture_day, r.label_raw, r.label) for r in got] == [("Monday-01", "Benign", 0), ("Monday-01", "Bot", 1), ("Tuesday-02", "DoS attacks-Hulk", 1)]
    assert len(got[0]) == 2 + 78 + 2
    b.write_text("a,b\n1,2")
    with pytest.raises(readers.BadSource):
        readers.read_flows(spark, [str(b)])


def test_traces(spark, tmp_path):
    (tmp_path / "t.txt").write_text("NtOpen  ntread\nntclose\n")
    (tmp_path / "f.txt").write_text("Trojan\nWorm\n")
    got = readers.read_text_traces(spark, str(tmp_path / "t.txt"), str(tmp_path / "f.txt")).orderBy("family_raw").collect()
    assert [(r.family_raw, r.api_calls, r.label) for r in got] == [("Trojan", ["ntopen", "ntread"], 1), ("Worm", ["ntclose"], 1)]
    assert got[1].id == hashlib.sha256(b"ntclose").hexdigest()
    (tmp_path / "r.csv").write_text("sha256,labels,0,1,10,2\na,1,X,,Z,y\nb,0,,,,\n")
    got = readers.read_ragged_traces(spark, str(tmp_path / "r.csv")).orderBy("id").collect()
    assert [(r.id, r.label, r.api_calls) for r in got] == [("a", 1, ["x", "y", "z"]), ("b", 0, [])]
    (tmp_path / "b.json").write_text(json.dumps({"name": "benign", "apis": [["A", "b"], []]}))
    assert sorted(r.api_calls for r in readers.read_json_traces(spark, str(tmp_path / "b.json")).collect()) == [[], ["a", "b"]]
    (tmp_path / "c.json").write_text(json.dumps({"name": "other", "apis": [["a"]]}))
    with pytest.raises(PySparkException):
        readers.read_json_traces(spark, str(tmp_path / "c.json")).collect()
    rows = spark.createDataFrame([('["a", "b"]',), ("[]",), ('["a", 1]',), ('{"a": 1}',), ("x",), (None,)], "t string")
    assert [r.c for r in rows.select(readers.parse_trace(F.col("t")).alias("c")).collect()] == [["a", "b"], [], None, None, None, None]


def test_emulation(spark, tmp_path):
    entry = {k: "" for k in readers.EMULATION_KEYS} | {"ep_type": "module_entry", "apis": [{"pc": 1, "api_name": "X", "args": [], "ret_val": 0}, {"api_name": "Y"}], "error": {}}
    for folder, name, content in (("train_a/report_clean", "f" * 64 + ".dat.json", [entry, entry | {"error": {"type": "e"}}]), ("test_b/report_worm", "odd.dat.json", [entry])):
        (tmp_path / "d" / folder).mkdir(parents=True)
        (tmp_path / "d" / folder / name).write_text(json.dumps(content))
    got = readers.read_emulation(spark, str(tmp_path / "d")).orderBy("split", "ep_index").collect()
    assert [(r.sample_id, r.split, r.family, r.label, r.api_names, r.n_apis, r.has_error) for r in got] == [
        ("odd", "test", "worm", 1, ["X", "Y"], 2, False), ("f" * 64, "train", "clean", 0, ["X", "Y"], 2, False), ("f" * 64, "train", "clean", 0, ["X", "Y"], 2, True),
    ]
    plan = readers.read_emulation(spark, str(tmp_path / "d"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson(") == 1 and "get_json_object" not in plan
    (tmp_path / "d" / "test_b/report_worm" / "bad.json").write_text(json.dumps([{"ep_type": "x"}]))
    with pytest.raises(PySparkException):
        readers.read_emulation(spark, str(tmp_path / "d")).select("family").collect()


def test_digests(spark, tmp_path):
    path = str(tmp_path / "h.db")
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE FILE (sha256 TEXT)")
        good = [bytes([i] + [0x11] * 31).hex() for i in range(10)] + ["ab" * 31 + "00", "ab" * 31 + "01"]
        con.executemany("INSERT INTO FILE VALUES (?)", [(x,) for x in [*good, None, "", "zz", "abcd"]])
    raw = readers.read_digests(spark, path)
    assert raw.count() == 14
    readers.write_digests(raw, "sha256", str(tmp_path / "out"))
    kept = [bytes(r.sha256).hex() for r in spark.read.parquet(str(tmp_path / "out")).orderBy("sha256").collect()]
    assert kept == sorted(good)
    with pytest.raises(readers.BadSource):
        readers.write_digests(raw.where("sha256 = 'zz'"), "sha256", str(tmp_path / "none"))


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "train"), (2, "val")], "id int, split string")
    readers.write_splits(rows, str(tmp_path / "s"), rows.where("id = 2"))
    assert spark.read.parquet(str(tmp_path / "s" / "splits")).where("split = 'val'").count() == 1
    vocab = spark.createDataFrame([(2, "a"), (3, "b")], "token_id int, token string")
    readers.write_vocabulary(vocab, str(tmp_path / "v"))
    assert sorted(map(tuple, readers.read_vocabulary(spark, str(tmp_path / "v")).collect())) == [(2, "a"), (3, "b")]
    event = json.loads(readers.security_events(rows).first().event)
    assert {"id", "split", "timestamp", "correlation_id"} == {*event}
