"""Statistics of bytes, counted by numpy in Arrow batches: nothing is exploded, and only counts leave a task."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argusframe.functions import strings

WINDOW, STEP = 2048, 1024


def as_bytes(column: pa.Array) -> Iterator[np.ndarray | None]:
    """Each value's bytes, without a copy; null stays None."""
    binary = column.cast(pa.large_binary())
    ends, data = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset :], binary.buffers()[2]
    values = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    known = binary.is_valid().to_pylist()
    for i, is_known in enumerate(known):
        yield values[ends[i] : ends[i + 1]] if is_known else None


def entropy_of(counts: np.ndarray) -> float:
    n = counts[counts > 0].astype(float)
    total = n.sum()
    return float(np.log2(total) - (n * np.log2(n)).sum() / total) if total else 0.0


def byte_profile(rows: DataFrame, key: str, content: str) -> DataFrame:
    """key, size and entropy (bits a byte; 0 for nothing) of a column of text (as UTF-8) or bytes; null gives nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(None, None) if b is None else (len(b), entropy_of(np.bincount(b, minlength=256))) for b in as_bytes(batch.column(1))]
            sizes, entropies = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(entropies, pa.float64())], names=[key, "size", "entropy"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, content).mapInArrow(run, f"`{key}` {kind}, size long, entropy double")


RUNS = re.compile(rb"[\x20-\x7f]{5,}")


def printable_profile(rows: DataFrame, key: str, content: str) -> DataFrame:
    """key, n_strings, n_printable, entropy of the 96 printable characters in runs of five or more, and how many of
    these characters occur; null gives nulls."""

    def one(data: np.ndarray) -> tuple[int, int, float, int]:
        found = RUNS.findall(data.tobytes())
        counts = np.bincount(np.frombuffer(b"".join(found), np.uint8), minlength=128)[32:128]
        return len(found), int(counts.sum()), entropy_of(counts), int(np.count_nonzero(counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(None,) * 4 if b is None else one(b) for b in as_bytes(batch.column(1))]
            columns = zip(*found, strict=True) if found else ((),) * 4
            types = (pa.int64(), pa.int64(), pa.float64(), pa.int64())
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[key, "n_strings", "n_printable", "entropy", "n_kinds"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, content).mapInArrow(run, f"`{key}` {kind}, n_strings long, n_printable long, entropy double, n_kinds long")


def category_counts(rows: DataFrame, content: str) -> DataFrame:
    """category, n_strings (printable runs that match it) and n_rows (contents with such runs), partial as in
    ``byte_histogram``; categories without a match are absent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = list(strings.categories())
        n_strings, n_rows = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        for batch in batches:
            for b in as_bytes(batch.column(0)):
                if b is not None:
                    counts = np.array(strings.matching_counts(RUNS.findall(b)), np.int64)
                    n_strings += counts
                    n_rows += counts > 0
        at = np.flatnonzero(n_rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array([names[i] for i in at], pa.string()), pa.array(n_strings[at]), pa.array(n_rows[at])], names=["category", "n_strings", "n_rows"]
        )

    return rows.select(content).mapInArrow(run, "category string, n_strings long, n_rows long")


#: Bytes other than a to z part words.
LETTERS = bytes(b if ord("a") <= b <= ord("z") else ord(" ") for b in range(256))


def word_counts(rows: DataFrame, content: str) -> DataFrame:
    """token and n, partial, a row a word and batch: how often each run of the letters a to z occurs in a column of text or bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spaced = pa.array([(b or b"").translate(LETTERS) for b in batch.column(0).to_pylist()], pa.binary()).cast(pa.string())
            words = pc.ascii_split_whitespace(spaced).flatten()
            counts = words.filter(pc.not_equal(words, "")).value_counts()
            yield pa.RecordBatch.from_arrays([counts.field(0), counts.field(1)], names=["token", "n"])

    return rows.select(F.col(content).cast("binary").alias("content")).mapInArrow(run, "token string, n long")


def byte_histogram(rows: DataFrame, content: str) -> DataFrame:
    """byte and n, partial: one row a byte value and task, to be summed by byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(256, np.int64)
        for batch in batches:
            for b in as_bytes(batch.column(0)):
                if b is not None:
                    counts += np.bincount(b, minlength=256)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["byte", "n"])

    return rows.select(content).mapInArrow(run, "byte int, n long")


def window_counts(data: np.ndarray, window: int = WINDOW, step: int = STEP) -> np.ndarray:
    """Counts of high nibbles by local entropy, 16 by 16. Shorter data is one window, its shares still of a whole one."""
    out = np.zeros((16, 16), np.int64)
    high = data >> 4
    for at in range(0, max(len(high) - window, 0) + 1, step) if len(high) else ():
        counts = np.bincount(high[at : at + window], minlength=16)
        share = counts[counts > 0] / window
        out[min(int(np.floor(round(float(-(share * np.log2(share)).sum()) * 4, 9))), 15)] += counts
    return out


def window_entropy(rows: DataFrame, content: str) -> DataFrame:
    """row (of local entropy), nibble and n, partial as in ``byte_histogram``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((16, 16), np.int64)
        for batch in batches:
            for b in as_bytes(batch.column(0)):
                if b is not None:
                    counts += window_counts(b)
        row, nibble = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(row, pa.int32()), pa.array(nibble, pa.int32()), pa.array(counts[row, nibble], pa.int64())], names=["row", "nibble", "n"]
        )

    return rows.select(content).mapInArrow(run, "row int, nibble int, n long")
