"""Packing tokenised documents into fixed windows: non-negative least squares over length combinations.

Work goes in blocks of at most ``BLOCK_TOKENS`` tokens of one input partition, so memory is bounded and
nothing is shuffled, however the lengths are spread. In a block every document is cut at the window; what
is left over is a set of items shorter than it. Their histogram is matched by shallow combinations that
fill a window exactly (one, two or three items): non-negative least squares gives how often each is used,
counts are rounded and lowered to what there is, and the items no combination takes are packed greedily, cut where a
window ends. The last window of a block is cut into powers of two, which need no padding.

Nulls: null or empty text is a document of the closing id alone; a null doc_id stays null. Repeated rows are packed
as often as they occur. Ties of length go in order of input. Very long texts are cut at the window; the ids of one
text are held at once. An empty table gives no pieces. Extra columns of any name are not looked at.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from argusframe.llm.common import BATCH_BYTES, doc_texts, emit
from argusframe.llm.pieces import GPT_SPLIT, latin_only

WINDOW = 2048
CLOSING_ID = 1
#: A block is packed when it holds so many tokens.
BLOCK_TOKENS = 1 << 22
#: Triples are enumerated around so many of a block's most frequent lengths.
TRIPLE_LENGTHS = 48
STEPS = 60


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def plain_byte_level(spec: dict, byte: dict[str, int]) -> bool:
    """Whether a vocabulary file is byte-level BPE and nothing else: bytes, every longer token made by a merge, merges
    in the order of their ids, the usual split, and no step that changes a text or an id list."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    odd = [spec.get("normalizer"), spec.get("truncation"), spec.get("padding"), model.get("continuing_subword_prefix"), model.get("end_of_word_suffix"), model.get("dropout"), model.get("byte_fallback"), model.get("ignore_merges")]
    if model.get("type", "BPE") != "BPE" or any(odd) or split.get("type") != "ByteLevel" or split.get("add_prefix_space", True) or not split.get("use_regex", True):
        return False
    added = {t["content"] for t in spec.get("added_tokens", [])}
    merged = [a + b for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
    ids = [model["vocab"].get(m, -1) for m in merged]
    return ids == sorted(set(ids)) and ids[:1] != [-1] and set(model["vocab"]) - added == set(byte) | set(merged)


class LibraryIds:
    """Ids as the tokenizers library gives them. For a text of Latin characters without special tokens a
    second library, given the same vocabulary, finds the same ids several times faster, as long as the file says
    nothing else than byte-level BPE; every other text goes to the first. special_as_text: their strings are plain text."""

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; the library's threads would only spin
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.special = [] if special_as_text else sorted(added)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        byte = byte_symbols()
        self.vocabulary = spec["model"]["vocab"]
        self.fast = None
        if plain_byte_level(spec, byte):
            ranks = {bytes(map(byte.__getitem__, token)): i for token, i in self.vocabulary.items() if token not in added}
            self.fast = tiktoken.Encoding("packing", pat_str=GPT_SPLIT, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or not latin_only(text) or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


def combinations(histogram: np.ndarray, window: int) -> np.ndarray:
    """Rows of up to three item lengths that fill a window exactly (0: no item), all of lengths that occur."""
    lengths = np.flatnonzero(histogram)
    present = histogram > 0
    pairs = lengths[(lengths * 2 <= window) & present[window - lengths]]
    rows = [np.stack([pairs, window - pairs, 0 * pairs], 1)]
    common = np.sort(lengths[np.argsort(-histogram[lengths], kind="stable")][:TRIPLE_LENGTHS])
    for a in common.tolist():
        b = lengths[(lengths >= a) & (2 * lengths <= window - a)]
        b = b[present[window - a - b]]
        rows.append(np.stack([np.full(len(b), a), b, window - a - b], 1))
    return np.concatenate(rows)


def repeat_counts(histogram: np.ndarray, combos: np.ndarray) -> np.ndarray:
    """Whole repeat counts: non-negative least squares of the histogram by multiplicative steps
    (which keep signs), rounded, then lowered where they would use more items than there are."""
    if not len(combos):
        return np.zeros(0, np.int64)
    size = len(histogram)
    used = lambda x: np.bincount(combos.ravel(), np.repeat(x, combos.shape[1]), size)
    target = histogram.astype(float)
    target[0] = 0
    back = lambda v: v[combos].sum(1)
    x = np.ones(len(combos))
    wish = back(target)
    for _ in range(STEPS):
        now = used(x)
        now[0] = 0
        x *= wish / np.maximum(back(now), 1e-12)
    counts = np.floor(x + 0.5).astype(np.int64)
    left = histogram.astype(np.int64).copy()
    left[0] = np.iinfo(np.int64).max // 4
    for i in np.argsort(-counts, kind="stable").tolist():
        if counts[i] == 0:
            break
        row = combos[i]
        need = np.bincount(row)
        at = np.flatnonzero(need[1:]) + 1
        counts[i] = min(counts[i], int((left[at] // need[at]).min()))
        left[at] -= counts[i] * need[at]
    return counts


def powers(length: int) -> list[int]:
    """Cuts of a length into falling powers of two."""
    return [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]


def pack_lengths(sizes: list[int], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) for each piece; sequences are numbered from 0."""
    pieces, sequence = [], 0
    by_length: dict[int, list[int]] = {}
    for d, size in enumerate(sizes):
        for start in range(0, size - size % window, window):
            pieces.append((d, start, window, sequence, 0))
            sequence += 1
        if size % window:
            by_length.setdefault(size % window, []).append(d)
    histogram = np.zeros(window + 1, np.int64)
    for length, who in by_length.items():
        histogram[length] = len(who)
    combos = combinations(histogram, window)
    for row, count in zip(combos.tolist(), repeat_counts(histogram, combos).tolist(), strict=True):
        for _ in range(count):
            offset = 0
            for length in row:
                if length:
                    d = by_length[length].pop()
                    pieces.append((d, sizes[d] - length, length, sequence, offset))
                    offset += length
            sequence += 1
    rest = sorted((d for who in by_length.values() for d in who), key=lambda d: (-(sizes[d] % window), d))
    total = sum(sizes[d] % window for d in rest)
    rooms = chain([window] * (total // window), powers(total % window))
    room = offset = 0
    for d in rest:
        start = sizes[d] - sizes[d] % window
        while start < sizes[d]:
            if offset == room:
                sequence += room > 0
                room, offset = next(rooms), 0
            length = min(sizes[d] - start, room - offset)
            pieces.append((d, start, length, sequence, offset))
            start += length
            offset += length
    return pieces


@lru_cache(maxsize=2)
def ids_of(tokenizer_path: str) -> LibraryIds:
    """One for a worker process, whose tasks share it."""
    return LibraryIds(tokenizer_path)


COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, closing_id: int = CLOSING_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start (ids of its document before it), length, ids_crc32 (of its
    little-endian unsigned 32-bit ids), doc_tokens, sequence_id, offset, and with ``with_ids`` the ids.
    A sequence's number holds its input partition in the upper bits, so numbers never meet."""
    schema = SCHEMA + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ids_of(tokenizer_path)
        base = TaskContext.get().partitionId() << 40
        keys, ids, held = [], [], 0
        types = [pa.int64()] * len(COLUMNS) + [pa.list_(pa.int32())] * with_ids

        def block() -> Iterator[pa.RecordBatch]:
            nonlocal base
            rows, top = [], -1
            for d, start, length, sequence, offset in pack_lengths([len(x) for x in ids], window):
                cut = ids[d][start : start + length]
                rows.append(
                    (
                        keys[d], start, length, zlib.crc32(cut.astype("<u4").tobytes()), len(ids[d]), base + sequence, offset,
                        *([cut.astype(np.int32)] * with_ids)
                    )
                )
                top = max(top, sequence)
                if len(rows) * (1 + with_ids * 100) >= BATCH_BYTES >> 6:
                    yield emit(COLUMNS + ["ids"] * with_ids, rows, types)
                    rows = []
            if rows:
                yield emit(COLUMNS + ["ids"] * with_ids, rows, types)
            base += top + 1

        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys.append(doc_id)
                ids.append(np.append(encode(text or ""), np.uint32(closing_id)))
                held += len(ids[-1])
                if held >= BLOCK_TOKENS:
                    yield from block()
                    keys, ids, held = [], [], 0
        if keys:
            yield from block()

    return doc_texts(docs).mapInArrow(run, schema)
