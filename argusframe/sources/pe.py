"""Portable executables: a bounded parser of their structures, and the feature vector models take.

The vector has twelve groups. Each group is computed by itself; one that fails is left zero and named in
``degraded``, never passed off as a real zero, while an unsigned file's signatures or a clean file's warnings are
truly zero. Warnings are those this parser can tell, in the words of the vocabulary. Only bytes are read, offsets
are tested, and loops are bounded, so hostile files end quickly.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from argusframe.functions.byteops import RUNS
from argusframe.functions.hashing import hashed
from argusframe.functions.strings import matching_counts
from argusframe.functions.warnings import flags

# Groups of the vector in order with their sizes, and the names of header fields and flags.
GROUPS = {
    "general": 7, "histogram": 256, "byteentropy": 256, "strings": 177, "header": 74, "section": 224, "imports": 1282, "exports": 129, "datadirectories": 34, "richheader": 33, "authenticode": 8, "pefilewarnings": 88,
}
DIMENSIONS = sum(GROUPS.values())
#: Machine numbers in the order of their index in the vector; unknown ones count as the first.
MACHINES = [
    0x0, 0x14C, 0x162, 0x166, 0x168, 0x169, 0x184, 0x1A2, 0x1A3, 0x1A4, 0x1A6, 0x1A8, 0x1C0, 0x1C2, 0x1C4, 0x1D3, 0x1F0, 0x1F1, 0x200, 0x266, 0x284, 0x284, 0x366, 0x466, 0x520, 0xCEF, 0xEBC,
    0x5032, 0x5064, 0x5128, 0x6232, 0x6264, 0x8664, 0x9041, 0xAA64, 0xC0EE,
]
SUBSYSTEMS = [0, 1, 2, 3, 5, 7, 8, 9, 10, 11, 12, 13, 14, 16]
IMAGE_FLAGS = [0x1, 0x2, 0x4, 0x8, 0x10, 0x20, 0x40, 0x80, 0x100, 0x200, 0x400, 0x800, 0x1000, 0x2000, 0x4000, 0x8000]
DLL_FLAGS = [0x20, 0x40, 0x80, 0x100, 0x200, 0x400, 0x800, 0x1000, 0x2000, 0x4000, 0x8000]
SECTION_FLAGS = {
    "TYPE_NO_PAD": 0x8, "CNT_CODE": 0x20, "CNT_INITIALIZED_DATA": 0x40, "CNT_UNINITIALIZED_DATA": 0x80, "LNK_OTHER": 0x100, "LNK_INFO": 0x200, "LNK_REMOVE": 0x800, "LNK_COMDAT": 0x1000, "NO_DEFER_SPEC_EXC": 0x4000,
    "GPREL": 0x8000, "LNK_NRELOC_OVFL": 0x1000000, "MEM_DISCARDABLE": 0x2000000, "MEM_NOT_CACHED": 0x4000000, "MEM_NOT_PAGED": 0x8000000, "MEM_SHARED": 0x10000000, "MEM_EXECUTE": 0x20000000, "MEM_READ": 0x40000000, "MEM_WRITE": 0x80000000,
}
MOST_SECTIONS, MOST_NAMES, LONGEST_NAME = 2048, 65536, 10_000
WINDOW, STEP = 2048, 1024


class NotPE(ValueError):
    """Bytes that are no portable executable."""


@dataclass
class Section:
    name: str
    size: int
    offset: int
    vsize: int
    address: int
    flags: int
    content: bytes


@dataclass
class PE:
    dos: tuple[int, ...]
    coff: tuple[int, ...]
    optional: dict[str, int]
    directories: list[tuple[int, int]]
    sections: list[Section]
    data: bytes
    rich: list[int] = field(default_factory=list)

    def at(self, rva: int) -> int | None:
        """File offset of a relative virtual address."""
        for s in self.sections:
            if s.address <= rva < s.address + max(s.vsize, s.size):
                where = rva - s.address + s.offset
                return where if where < len(self.data) else None
        return rva if rva < min(self.optional["sizeof_headers"], len(self.data)) else None

    def text(self, rva: int) -> str:
        where = self.at(rva)
        if where is None:
            return ""
        end = self.data.find(b"\0", where, where + LONGEST_NAME)
        return self.data[where : end if end >= 0 else where + LONGEST_NAME].decode(errors="ignore")

    def number(self, rva: int, form: str) -> int | None:
        where = self.at(rva)
        return None if where is None or where + struct.calcsize(form) > len(self.data) else struct.unpack_from(form, self.data, where)[0]


COMMON = [
    "magic", "major_linker_version", "minor_linker_version", "sizeof_code", "sizeof_initialized_data", "sizeof_uninitialized_data", "address_of_entrypoint",
    "base_of_code"
]
WINDOWS = [
    "image_base", "section_alignment", "file_alignment", "major_operating_system_version", "minor_operating_system_version", "major_image_version", "minor_image_version", "major_subsystem_version", "minor_subsystem_version",
    "reserved", "sizeof_image", "sizeof_headers", "checksum", "subsystem", "dll_characteristics", "sizeof_stack_reserve", "sizeof_stack_commit", "sizeof_heap_reserve", "sizeof_heap_commit", "loader_flags", "number_of_rvas_and_sizes",
]


def parse(data: bytes) -> PE:
    """Headers, directories and sections; NotPE if they aren't there."""
    try:
        dos = struct.unpack_from("<14H8x2H20xI", data)
        if dos[0] != 0x5A4D or data[dos[-1] : dos[-1] + 4] != b"PE\0\0":
            raise NotPE("no signature")
        at = dos[-1] + 4
        coff = struct.unpack_from("<2H3I2H", data, at)
        at += 20
        common = struct.unpack_from("<H2B5I", data, at)
        if common[0] == 0x10B:
            rest, form = at + 28, "<3I6H4I2H6I"
        elif common[0] == 0x20B:
            rest, form = at + 24, "<Q2I6H4I2H4Q2I"
        else:
            raise NotPE("unknown optional header")
        optional = dict(zip(COMMON, common, strict=True)) | dict(zip(WINDOWS, struct.unpack_from(form, data, rest), strict=True))
        rest += struct.calcsize(form)
        n = min(optional["number_of_rvas_and_sizes"], 16, (len(data) - rest) // 8)
        directories = [struct.unpack_from("<2I", data, rest + 8 * i) for i in range(n)]
        sections, at = [], at + coff[5]
        for i in range(min(coff[1], MOST_SECTIONS)):
            if at + 40 * i + 40 > len(data):
                break
            name, vsize, address, size, offset, flags = struct.unpack_from("<8s4I12xI", data, at + 40 * i)
            sections.append(Section(name.strip(b"\0").decode(errors="ignore").lower(), size, offset, vsize, address, flags, data[offset : offset + size]))
    except struct.error as error:
        raise NotPE(str(error)) from error
    return PE(dos, coff, optional, directories, sections, data, rich_header(data, dos[-1]))


def rich_header(data: bytes, end: int) -> list[int]:
    """Alternating tool ids and counts of the build header between the stub and the signature."""
    close = data.rfind(b"Rich", 0, end)
    if close < 0 or close + 8 > len(data):
        return []
    key = data[close + 4 : close + 8]
    open_ = data.rfind(bytes(a ^ b for a, b in zip(b"DanS", key, strict=True)), 0, close)
    if open_ < 0 or (close - open_) % 4:
        return []
    mask = int.from_bytes(key, "little")
    return [x ^ mask for (x,) in struct.iter_unpack("<I", data[open_ + 16 : close])]


def imports(pe: PE) -> dict[str, list[str]]:
    found: dict[str, list[str]] = {}
    if len(pe.directories) < 2 or not pe.directories[1][0]:
        return found
    wide = pe.optional["magic"] == 0x20B
    form, size, by_number = ("<Q", 8, 1 << 63) if wide else ("<I", 4, 1 << 31)
    at, left = pe.directories[1][0], MOST_NAMES
    while left > 0:
        where = pe.at(at)
        if where is None or where + 20 > len(pe.data):
            break
        lookup, _, _, name, table = struct.unpack_from("<5I", pe.data, where)
        if not name and not table:
            break
        dll = pe.text(name)
        names = found.setdefault(dll, [])
        thunk = lookup or table
        while left > 0 and (value := pe.number(thunk, form)):
            names.append(f"{dll}:ordinal{value & 0xFFFF}" if value & by_number else pe.text((value & 0x7FFFFFFF) + 2))
            thunk += size
            left -= 1
        at += 20
        left -= 1
    return found


def exports(pe: PE) -> list[str]:
    if not pe.directories or not pe.directories[0][0]:
        return []
    where = pe.at(pe.directories[0][0])
    if where is None or where + 40 > len(pe.data):
        return []
    base, n_functions, n_names, functions, names, ordinals = struct.unpack_from("<6I", pe.data, where + 16)
    by_place = {}
    for i in range(min(n_names, MOST_NAMES)):
        place, name = pe.number(ordinals + 2 * i, "<H"), pe.number(names + 4 * i, "<I")
        if place is None or name is None:
            break
        by_place[place] = pe.text(name)
    out = []
    for i in range(min(n_functions, MOST_NAMES)):
        if pe.number(functions + 4 * i, "<I"):
            out.append(by_place.get(i) or f"ordinal{base + i}")
    return out


def entropy(counts: np.ndarray, total: float) -> float:
    if not total:
        return 0.0
    p = counts[counts > 0] / total
    return float(-np.add.reduce(p * np.log2(p))) + 0.0


@lru_cache(maxsize=2)
def counts_of(data: bytes) -> np.ndarray:
    """How often each byte occurs; several groups ask that of one file in turn. Not to be changed in place."""
    return np.bincount(np.frombuffer(data, np.uint8), minlength=256)


def shares(counts: np.ndarray) -> np.ndarray:
    total = counts.sum()
    return counts / total if total else counts.astype(float)


def general(data: bytes, pe: PE | None) -> list[float]:
    return [len(data), entropy(counts_of(data), len(data)), float(pe is not None), *data[:4].ljust(4, b"\0")]


def histogram(data: bytes, pe: PE | None) -> np.ndarray:
    return shares(counts_of(data))


def byteentropy(data: bytes, pe: PE | None) -> np.ndarray:
    """Nibble counts by local entropy. A short file is one window, but its shares are still of a whole one."""
    high = np.frombuffer(data, np.uint8) >> 4
    out = np.zeros((16, 16))
    for at in range(0, max(len(high) - WINDOW, 0) + 1, STEP) if len(high) else ():
        counts = np.bincount(high[at : at + WINDOW], minlength=16)
        out[min(int(entropy(counts, WINDOW) * 4), 15)] += counts
    return shares(out).ravel()


def strings(data: bytes, pe: PE | None) -> np.ndarray:
    found = RUNS.findall(data)
    joined = b"".join(found)
    spread = np.bincount(np.frombuffer(joined, np.uint8) - 0x20, minlength=96)[:96]
    lengths = [len(found), len(joined) / len(found) if found else 0.0, len(joined)]
    return np.concatenate([lengths, spread / max(len(joined), 1), [entropy(spread, len(joined))], matching_counts(found)])


def header(data: bytes, pe: PE | None) -> list[float] | np.ndarray:
    if pe is None:
        return np.zeros(GROUPS["header"])
    machine, n_sections, stamp, symbols_at, n_symbols, optional_size, flags = pe.coff
    o = pe.optional
    names = [
        "major_image_version", "minor_image_version", "major_linker_version", "minor_linker_version", "major_operating_system_version", "minor_operating_system_version", "major_subsystem_version", "minor_subsystem_version",
        "sizeof_code", "sizeof_headers", "sizeof_image", "sizeof_initialized_data", "sizeof_uninitialized_data", "sizeof_stack_reserve", "sizeof_stack_commit", "sizeof_heap_reserve", "sizeof_heap_commit",
        "address_of_entrypoint", "base_of_code", "image_base", "section_alignment", "checksum", "number_of_rvas_and_sizes",
    ]
    place = lambda value, known: known.index(value) if value in known else 0

    return [
        stamp, n_sections, n_symbols, optional_size, symbols_at, place(machine, MACHINES), place(o["subsystem"], SUBSYSTEMS), *(o[n] for n in names),
        *(float(bool(flags & f)) for f in IMAGE_FLAGS), *(float(bool(o["dll_characteristics"] & f)) for f in DLL_FLAGS), *pe.dos,
    ]


def section_entropy(content: bytes) -> float:
    """Of a short section it is remembered: such sections recur from file to file."""
    return known_entropy(content) if len(content) <= 4096 else entropy(counts_of(content), len(content))


@lru_cache(maxsize=1024)
def known_entropy(content: bytes) -> float:
    return entropy(counts_of(content), len(content))


def section(data: bytes, pe: PE | None) -> np.ndarray:
    if pe is None:
        return np.zeros(GROUPS["section"])
    at = pe.optional["address_of_entrypoint"]
    entry = next((s.name for s in reversed(pe.sections) if s.address <= at < s.address + max(s.vsize, s.size)), "")
    entry = entry or next((s.name for s in pe.sections if s.flags & SECTION_FLAGS["MEM_EXECUTE"] and s.name), "")
    end = max([s.offset + s.size for s in pe.sections], default=len(data))
    overlay = data[end:]
    over = [len(overlay), len(overlay) / len(data), entropy(counts_of(overlay), len(overlay))]
    entropies = [section_entropy(s.content) for s in pe.sections]
    ratios, vratios = [s.size / len(data) for s in pe.sections], [s.size / max(s.vsize, 1) for s in pe.sections]
    props = [[k for k, f in SECTION_FLAGS.items() if s.flags & f] for s in pe.sections]
    most = [*(f(x) for x in ([*entropies, over[2], 0], [*ratios, over[1], 0], [*vratios, 0]) for f in (max, min))]
    counts = [
        len(pe.sections), sum(s.size == 0 for s in pe.sections), sum(s.name == "" for s in pe.sections),
        sum({"MEM_READ", "MEM_EXECUTE"} <= {*p} for p in props), sum("MEM_WRITE" in p for p in props)
    ]
    named = lambda values: hashed(zip((s.name for s in pe.sections), values, strict=True), 50)
    flagged = hashed(((f"{s.name}:{p}", 1.0) for s, ps in zip(pe.sections, props, strict=True) for p in ps), 50)
    return np.concatenate(
        [counts, most, named([s.size for s in pe.sections]), named([s.vsize for s in pe.sections]), named(entropies), flagged, hashed([(entry, 1.0)], 10), over]
    )


def imported(data: bytes, pe: PE | None) -> np.ndarray:
    found = imports(pe) if pe else {}
    if not found:
        return np.zeros(GROUPS["imports"])
    libraries = sorted({name.lower() for name in found})
    pairs = [f"{name.lower()}:{e}" for name, names in found.items() for e in names]
    return np.concatenate([[len(pairs), len(libraries)], hashed(((x, 1.0) for x in libraries), 256, False), hashed(((p, 1.0) for p in pairs), 1024, False)])


def exported(data: bytes, pe: PE | None) -> np.ndarray:
    names = exports(pe) if pe else []
    return np.concatenate([[len(names)], hashed(((n, 1.0) for n in names), 128)]) if names else np.zeros(GROUPS["exports"])


def datadirectories(data: bytes, pe: PE | None) -> list[float]:
    """Size and address of each directory but the last given, which the models never saw, and two flags."""
    out = [0.0] * GROUPS["datadirectories"]
    if pe is None:
        return out
    for i, (address, size) in enumerate(pe.directories[:-1]):
        out[2 * i : 2 * i + 2] = [size, address]
    out[-2] = float(len(pe.directories) > 5 and pe.directories[5][1] > 0)
    return out


def richheader(data: bytes, pe: PE | None) -> list[float]:
    values = pe.rich if pe else []
    pairs = [(str(values[i]), float(values[i + 1])) for i in range(0, len(values) - 1, 2)]
    return [len(values) // 2, *hashed(pairs, 32)] if values else [0.0] * GROUPS["richheader"]


def authenticode(data: bytes, pe: PE | None) -> list[float]:
    from argusframe.sources import signatures

    return signatures.authenticode(data, pe)


def warnings_of(pe: PE) -> Iterator[str]:
    """What is odd about a file's headers, sections and bytes, in the words of the vocabulary."""
    o, n = pe.optional, len(pe.data)
    for byte, count in enumerate(counts_of(pe.data).tolist()):
        if count > n * (0.15 if byte else 0.5):
            yield f"Byte 0x{byte:02x} makes up {100 * count / n:.4f}% of the file's contents."
    entry = o["address_of_entrypoint"]
    if entry < o["sizeof_headers"]:
        yield "SizeOfHeaders is smaller than AddressOfEntryPoint: this file cannot run under Windows 8."
    if o["number_of_rvas_and_sizes"] > 16:
        yield "Suspicious NumberOfRvaAndSizes in the Optional Header. Normal values are never larger than 0x10"
    if o["file_alignment"] > 0x200 and o["file_alignment"] & (o["file_alignment"] - 1):
        yield f"If FileAlignment > 0x200 it should be a power of 2. Value: {o['file_alignment']:x}"
    if o["section_alignment"] < 0x1000 and o["section_alignment"] != o["file_alignment"]:
        yield f"If SectionAlignment({o['section_alignment']:x}) < 0x1000 it should equal FileAlignment({o['file_alignment']:x})"
    inside = [s for s in pe.sections if s.address <= entry < s.address + max(s.vsize, s.size)]
    if entry and not inside:
        yield f"AddressOfEntryPoint lies outside the sections' boundaries. AddressOfEntryPoint: 0x{entry:x}"
    elif inside and entry - inside[0].address + inside[0].offset > n:
        yield f"Possibly corrupt file. AddressOfEntryPoint lies outside the file. AddressOfEntryPoint: 0x{entry:x}"
    if pe.coff[1] > MOST_SECTIONS:
        yield f"Too many sections {pe.coff[1]}"
    for i, s in enumerate(pe.sections):
        if s.size and s.content and not any(s.content):
            yield f"Suspicious value found parsing section {i}. Contents are null-bytes."
        if s.size + s.offset > n:
            yield f"Error parsing section {i}. SizeOfRawData is larger than file."
        if s.offset > n:
            yield f"Error parsing section {i}. PointerToRawData points beyond the end of the file."
        if s.vsize > 0x10000000:
            yield f"Suspicious value found parsing section {i}. VirtualSize is extremely large > 256MiB"
        if s.address > 0x10000000:
            yield f"Suspicious value found parsing section {i}. VirtualAddress is beyond 0x10000000"
        if o["file_alignment"] and s.offset % o["file_alignment"]:
            yield f"Error parsing section {i}. PointerToRawData should normally be a multiple of FileAlignment, this might imply the file is trying to confuse tools which parse this incorrectly."
        if s.flags & SECTION_FLAGS["MEM_WRITE"] and s.flags & SECTION_FLAGS["MEM_EXECUTE"]:
            yield f"Suspicious flags set for section {i}. Both IMAGE_SCN_MEM_WRITE and IMAGE_SCN_MEM_EXECUTE are set."


def pefilewarnings(data: bytes, pe: PE | None) -> list[float]:
    return flags(warnings_of(pe)) if pe else [0.0] * GROUPS["pefilewarnings"]


EXTRACTORS: dict[str, Callable] = dict(
    zip(
        GROUPS, (general, histogram, byteentropy, strings, header, section, imported, exported, datadirectories, richheader, authenticode, pefilewarnings),
        strict=True
    )
)


def vector(data: bytes, extractors: dict[str, Callable] = EXTRACTORS) -> tuple[bool, np.ndarray, list[str]]:
    """Whether the bytes are a PE file, all features in single precision, and the sorted names of degraded groups."""
    try:
        pe = parse(data)
    except NotPE:
        pe = None
    out, at, degraded = np.zeros(DIMENSIONS, np.float32), 0, []
    with np.errstate(over="ignore"):
        for name, size in GROUPS.items():
            try:
                got = np.asarray(extractors[name](data, pe), np.float64)
                if got.shape != (size,):
                    raise ValueError(name)
                out[at : at + size] = got
            except Exception:  # whatever a hostile file does to one group, the others stand
                degraded.append(name)
            at += size
    if not np.isfinite(out).all():
        at = 0
        for name, size in GROUPS.items():
            if not np.isfinite(out[at : at + size]).all():
                out[at : at + size] = 0
                degraded.append(name)
            at += size
    return pe is not None, out, sorted(degraded)


def feature_lists(vectors: Sequence[np.ndarray | None]) -> pa.Array:
    """Vectors, some of them null, as lists of floats: joined and handed over as one buffer."""
    ends = np.cumsum([0] + [0 if v is None else len(v) for v in vectors]).astype(np.int32)
    known = [v for v in vectors if v is not None]
    values = np.concatenate(known) if known else np.zeros(0, np.float32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.float32()), mask=pa.array([v is None for v in vectors], pa.bool_()))


#: A sparse vector as its parts, which read as a vector column once they are stored.
SPARSE = "struct<type: tinyint, size: int, indices: array<int>, values: array<double>>"


def sparse_vectors(vectors: Sequence[np.ndarray | None]) -> pa.Array:
    """Vectors, some of them null, as the parts of sparse ones: most features of a file are zero."""
    at = [np.zeros(0, np.intp) if v is None else np.flatnonzero(v) for v in vectors]
    ends = pa.array(np.cumsum([0, *map(len, at)]).astype(np.int32))
    values = np.concatenate([np.zeros(0), *(v[a] for v, a in zip(vectors, at, strict=True) if v is not None)])
    lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int32), *at]).astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(values))]
    sizes = pa.array(np.array([0 if v is None else len(v) for v in vectors], np.int32))
    missing = pa.array([v is None for v in vectors], pa.bool_())
    return pa.StructArray.from_arrays([pa.array(np.zeros(len(at), np.int8)), sizes, *lists], names=["type", "size", "indices", "values"], mask=missing)


def pe_features(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """key, is_pe, features (2,568 floats), degraded, of a table of binary contents; null content gives nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                cut = batch.slice(i, 64)
                made = [(None, None, None) if b is None else vector(b) for b in cut.column(1).to_pylist()]
                ok, features, degraded = zip(*made, strict=True)
                arrays = [cut.column(0), pa.array(ok, pa.bool_()), feature_lists(features), pa.array(degraded, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(arrays, names=[key, "is_pe", "features", "degraded"])

    kind = files.schema[key].dataType.simpleString()
    return files.select(key, content).mapInArrow(run, f"`{key}` {kind}, is_pe boolean, features array<float>, degraded array<string>")


def self_test(data: bytes | None, signed: bool = False) -> list[str]:
    """What is wrong with extraction on a known good file; empty if nothing is. ``signed``: the file has a signature."""
    if data is None:
        return ["reference_pe_not_found"]
    try:
        ok, features, degraded = vector(data)
    except Exception as error:
        return [f"extraction_raised:{error!r}"]
    out = [f"degraded_group:{g}" for g in degraded] + ["reference_not_parsed"] * (not ok)
    if features.shape != (DIMENSIONS,):
        return [*out, f"vector_shape:{features.shape}"]
    at = dict(zip(GROUPS, np.cumsum([0, *GROUPS.values()]).tolist(), strict=False))
    of = lambda g: features[at[g] : at[g] + GROUPS[g]]
    wrong = {
        "vector_nonfinite": not np.isfinite(features).all(), "authenticode_all_zero_on_signed_pe": signed and not of("authenticode").any(), "imports_pair_count_zero": of("imports")[0] <= 0,
        "histogram_not_normalised": abs(float(of("histogram").sum()) - 1) > 1e-4, "general_size_mismatch": float(features[0]) != float(np.float32(len(data))),
    }
    return out + [name for name, is_so in wrong.items() if is_so]


def blocking(failures: list[str], critical: tuple[str, ...]) -> list[str]:
    """Those failures that must stop a scanner: not a missing reference file, nor a group that isn't critical."""
    group = lambda f: f.partition(":")[2] if f.startswith("degraded_group:") else None
    return [f for f in failures if f != "reference_pe_not_found" and (group(f) is None or group(f) in critical)]
