"""Alignment of two tokenizers over the same bytes, and how often their tokens meet in a corpus.

Both token sequences of a text are laid over its bytes: ends are cumulative sums of token lengths, the ends they
share cut the text into groups, and the pairs of tokens that overlap are expanded from first and last partner by
repetition, all in numpy. A document's distinct pairs are kept as one compact value; a task counts the documents of
each pair before anything is shuffled, and counts meet in two stages, by pair and salt and then by pair.

To bring counts back, the most frequent pairs, at most ``HEAVY_PAIRS`` of them however large the corpus, go to every
task as a small table, which settles most links where they are; links of rarer pairs are joined by pair. Which pairs
are sent depends on their counts alone, and no text is shuffled or encoded again.

Nulls: null or empty text has no tokens; neither has a text whose tokens don't spell it out; a null doc_id stays
null. Repeated rows are documents of their own. Ties: every pair that reaches the highest count of its left token
counts as best. Very long texts: work and memory grow with the text, one at a time. An empty table gives no rows. Extra
columns of any name are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argusframe.checkpoints import materialize, scratch
from argusframe.llm.common import BATCH_BYTES, doc_texts, emit
from argusframe.llm.packing import LibraryIds, byte_symbols
from argusframe.llm.pieces import latin_only, splitter

#: Pairs that every task gets a table of, at 24 bytes each.
HEAVY_PAIRS = 1 << 16
#: Pairs a task counts before it hands them on.
PARTIAL_PAIRS = 1 << 21
SALTS = 16
#: Words or pieces of words whose ids a worker remembers, and the longest that it does.
MEMO_ENTRIES, MEMO_CHARS = 300_000, 40


class Memo(dict):
    """Piece of text -> its ids, packed, filled on demand; emptied when full. Whether a piece's tokens spell it out is
    tested once, when it is met first; those that do not are kept in ``strange``."""

    def __init__(self, encode: Callable[[str], list[int]], bytes_of: list[bytes]):
        self.encode, self.bytes_of, self.strange = encode, bytes_of, set()

    def __missing__(self, text: str) -> bytes:
        ids = np.array(self.encode(text), np.int64)
        packed = ids.tobytes()
        if not spells(ids, self.bytes_of, text.encode("utf-8", "surrogatepass")):
            self.strange.add(text)
        if len(text) <= MEMO_CHARS:
            self[text] = packed
        return packed

    def ids_of(self, pieces: list[str], text: str, spelled: bytes) -> tuple[np.ndarray, bool]:
        """Ids of the pieces one after the other, and whether they spell out the text."""
        if len(self) >= MEMO_ENTRIES or len(self.strange) >= MEMO_ENTRIES:
            self.clear()
            self.strange.clear()
        ids = np.frombuffer(b"".join(map(self.__getitem__, pieces)), np.int64)
        is_sure = self.strange.isdisjoint(pieces) and "".join(pieces) == text
        return ids, is_sure or spells(ids, self.bytes_of, spelled)


class ByteLevel:
    """A byte-level vocabulary file of the tokenizers library, without special tokens."""

    def __init__(self, path: str):
        self.library = LibraryIds(path, special_as_text=True)
        byte = byte_symbols()
        self.bytes_of = [b""] * (max(self.library.vocabulary.values()) + 1)
        for token, i in self.library.vocabulary.items():
            self.bytes_of[i] = bytes(map(byte.__getitem__, token)) if all(c in byte for c in token) else token.encode()
        self.split = splitter()
        self.memo = Memo(self.library.fast.encode_ordinary, self.bytes_of) if self.library.fast else None

    def encode(self, text: str, spelled: bytes) -> tuple[np.ndarray, bool]:
        """Ids of the text, and whether they spell it out; pieces of the usual split are encoded one by one and remembered."""
        if self.memo is None or not latin_only(text):
            ids = self.library(text).astype(np.int64)
            return ids, spells(ids, self.bytes_of, spelled)
        return self.memo.ids_of(self.split(text), text, spelled)


class Pieced:
    """A model file of the sentencepiece library, which puts a space before a text itself."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.model, self.bytes_of = model, []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            self.bytes_of.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
        # no token goes on past the end of a word, so words may be encoded one by one
        by_words = not any(re.search("[^▁]▁", model.id_to_piece(i)) for i in range(model.get_piece_size()))
        self.memo = Memo(lambda word: model.encode(word[1:], num_threads=1), self.bytes_of) if by_words else None
        self.words = re.compile(" +[^ ]*").findall

    def encode(self, text: str, spelled: bytes) -> tuple[np.ndarray, bool]:
        """Ids of a text that begins with the space, and whether they spell it out: word by word and remembered if they do,
        else as a whole."""
        if self.memo is not None and not text.endswith(" "):
            ids, is_spelled = self.memo.ids_of(self.words(text), text, spelled)
            if is_spelled:
                return ids, True
        ids = np.array(self.model.encode(text[1:], num_threads=1), np.int64)
        return ids, spells(ids, self.bytes_of, spelled)


def spells(ids: np.ndarray, bytes_of: list[bytes], text: bytes) -> bool:
    return b"".join(map(bytes_of.__getitem__, ids.tolist())) == text


class Aligner:
    """Both vocabularies, with the sizes and decimal forms of their tokens."""

    def __init__(self, left_path: str, right_path: str):
        self.sides = ByteLevel(left_path), Pieced(right_path)
        self.sizes = [np.array([len(b) for b in side.bytes_of]) for side in self.sides]
        self.forms = [np.array([[f"{i}{end}" for end in ends] for i in range(len(side.bytes_of))], object) for side, ends in zip(self.sides, (",|", ",;"), strict=True)]

    def align(self, text: str | None) -> tuple[int, int, int, int, str, np.ndarray, np.ndarray]:
        """n_a, n_b, n_groups, n_links, groups_sha256, distinct pairs (left << 32 | right) and how often each is linked."""
        none = np.zeros(0, np.int64)
        if not text:
            return 0, 0, 0, 0, "", none, none
        spaced = " " + text
        spelled = spaced.encode("utf-8", "surrogatepass")
        (a, is_a), (b, is_b) = (side.encode(spaced, spelled) for side in self.sides)
        if not (is_a and is_b):
            return 0, 0, 0, 0, "", none, none
        size_a, size_b = self.sizes[0][a], self.sizes[1][b]
        ends_a, ends_b = np.cumsum(size_a), np.cumsum(size_b)
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        of_a, of_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        first = np.searchsorted(ends_b, ends_a - size_a, "right")
        many = np.searchsorted(ends_b - size_b, ends_a, "left") - first
        n_links = int(many.sum())
        partner = np.arange(n_links) + np.repeat(first - (np.cumsum(many) - many), many)
        pairs, times = np.unique(np.repeat(a, many) << 32 | b[partner], return_counts=True)
        return len(a), len(b), len(cuts), n_links, self.digest(a, b, of_a, of_b), pairs, times

    def digest(self, a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray) -> str:
        """Of ``a1,a2|b1;a3|b2,b3``: the ids of each group, left then right."""
        last_a, last_b = np.append(of_a[1:] != of_a[:-1], True), np.append(of_b[1:] != of_b[:-1], True)
        upto_a, upto_b = np.cumsum(np.bincount(of_a)), np.cumsum(np.bincount(of_b))  # tokens of the groups so far
        parts = np.empty(len(a) + len(b), object)
        parts[np.arange(len(a)) + np.append(0, upto_b)[of_a]] = self.forms[0][a, last_a.astype(int)]
        parts[np.arange(len(b)) + upto_a[of_b]] = self.forms[1][b, last_b.astype(int)]
        return hashlib.sha256("".join(parts.tolist())[:-1].encode()).hexdigest()


@lru_cache(maxsize=2)
def aligner_of(left_path: str, right_path: str) -> Aligner:
    """One for a worker process, whose tasks share it."""
    return Aligner(left_path, right_path)


def pressed(pairs: np.ndarray, times: np.ndarray) -> bytes:
    """Sorted pairs and their counts as 32-bit numbers that compress well: steps of left ids, right ids, counts."""
    return np.concatenate([np.diff(pairs >> 32, prepend=0), pairs & 0xFFFFFFFF, times]).astype("<i4").tobytes()


def loosened(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """What :func:`pressed` was given."""
    steps, right, times = np.frombuffer(data, "<i4").reshape(3, -1).astype(np.int64)
    return np.cumsum(steps) << 32 | right, times


DOCUMENT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
NAMES = [c.split(" ")[0] for c in DOCUMENT.split(", ")]
TYPES = [pa.int64()] * 5 + [pa.string()]


def aligned(docs: DataFrame, left_path: str, right_path: str) -> DataFrame:
    """A row for each document: its counts and digest, row (a number of its own) and links (pairs, pressed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, names, types = aligner_of(left_path, right_path), ["row", *NAMES, "links"], [pa.int64(), *TYPES, pa.binary()]
        row, out, held = TaskContext.get().partitionId() << 40, [], 0
        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                *counts, pairs, times = aligner.align(text)
                out.append((row, doc_id, *counts, pressed(pairs, times)))
                row += 1
                held += len(out[-1][-1]) + 200
                if held >= BATCH_BYTES:
                    yield emit(names, out, types)
                    out, held = [], 0
        if out:
            yield emit(names, out, types)

    return doc_texts(docs).mapInArrow(run, f"row long, {DOCUMENT}, links binary")


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, n (documents that hold it linked): counted in each task, then by pair and salt, then by pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId() % SALTS
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            pairs, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(np.full(len(pairs), salt, np.int32)), pa.array(n)], names=["pair", "salt", "n"])

        for batch in batches:
            for data in batch.column(0).to_pylist():
                pairs = loosened(data)[0]
                held.append(pairs)
                size += len(pairs)
                if size >= PARTIAL_PAIRS:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    partial = rows.select("links").mapInArrow(run, "pair long, salt int, n long")
    return partial.groupBy("pair", "salt").agg(F.sum("n").alias("n")).groupBy("pair").agg(F.sum("n").alias("n"))


def heavy_from(counts: DataFrame, most: int) -> int:
    """The least count from which on there are at most ``most`` pairs; counts are told apart by their upper bits, so few rows decide."""
    bits = F.greatest(F.floor(F.log2("n")).cast("int") - 4, F.lit(0))
    step = F.expr("shiftleft(shiftright(n, bits), bits)")
    steps = counts.withColumn("bits", bits).groupBy(step.alias("n")).agg(F.count("*").alias("pairs")).orderBy(F.desc("n")).collect()  # 16 for each doubling
    least, total = 1 << 62, 0
    for n, pairs in steps:
        total += pairs
        if total > most:
            break
        least = n
    return least


def align_documents(docs: DataFrame, left_path: str, right_path: str, heavy_pairs: int = HEAVY_PAIRS) -> DataFrame:
    """For each row: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose count is the highest of their left token),
    count_sum (counts of all its links), groups_sha256."""
    with scratch() as held:
        rows = materialize(aligned(docs, left_path, right_path), "aligned")
        counts = materialize(pair_counts(rows), "pair-counts")
        highest = counts.groupBy(F.shiftright("pair", 32).alias("left")).agg(F.max("n").alias("top"))
        judged = counts.withColumn("left", F.shiftright("pair", 32)).join(highest, "left").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
        judged = materialize(judged, "pair-ranks")
        held.pass_on(rows, judged)
    least = heavy_from(judged, heavy_pairs)
    heavy = judged.where(F.col("n") >= least).toPandas().sort_values("pair")  # at most heavy_pairs rows
    table = docs.sparkSession.sparkContext.broadcast(tuple(heavy[c].to_numpy() for c in ("pair", "n", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, best = table.value
        for batch in batches:
            columns, links = batch.columns[:-1], batch.column(batch.num_columns - 1).to_pylist()
            sums, rare = [], []
            for i, data in enumerate(links):
                pairs, times = loosened(data)
                at = np.minimum(np.searchsorted(known, pairs), len(known) - 1) if len(known) else np.zeros(len(pairs), np.int64)
                found = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
                hit, many = at[found], times[found]
                sums.append((int(many[best[hit]].sum()), int((many * counts[hit]).sum())) if len(known) else (0, 0))
                if not found.all():
                    rare.append((np.full(int((~found).sum()), columns[0][i].as_py()), pairs[~found], times[~found]))
            n = batch.num_rows
            none = [pa.nulls(n, pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.int64()) for x in zip(*sums, strict=True)), *none], names=ALL) if n else emit(ALL, [], KINDS)
            for row, pairs, times in rare:
                k = len(row)
                blank = [pa.nulls(k, t) for t in [*TYPES, pa.int64(), pa.int64()]]
                yield pa.RecordBatch.from_arrays([pa.array(row), *blank, pa.array(pairs), pa.array(times)], names=ALL)

    ALL, KINDS = ["row", *NAMES, "n_best", "count_sum", "pair", "times"], [pa.int64(), *TYPES, *[pa.int64()] * 4]
    with scratch() as held:
        told = materialize(rows.mapInArrow(run, f"row long, {DOCUMENT}, n_best long, count_sum long, pair long, times long"), "alignment-sums")
        held.pass_on(told)
    rare = told.where("pair IS NOT NULL").select("row", "pair", "times").join(judged.where(F.col("n") < least), "pair")
    rare = rare.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    both = told.where("pair IS NULL").drop("pair", "times").unionByName(rare, allowMissingColumns=True)
    return both.groupBy("row").agg(*[F.max(c).alias(c) for c in NAMES], F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")).drop("row")
