"""Substring dedup: paragraphs that recur across documents, whole or nearly so.

A paragraph is a line of five words or more, however long. Equal lines form a class; the shingles of each class
are banded by minimum hashing, colliding classes are confirmed by exact Jaccard similarity through hubs and,
where a bucket's members are still apart, by matching them with each other in blocks (near_dedup.links), so no
link inside a bucket is lost. Components of confirmed links are clusters.

Passages that are no line of their own, or break differently, are found over the words of the whole text, across
its lines: of every WINDOWS neighbouring windows of WINDOW_WORDS words the one of least hash is kept, so two
texts that share WINDOW_WORDS + WINDOWS - 1 words in a row share a kept window for certain, and a kept window
that two documents hold is WINDOW_WORDS repeated words.

Clusters and windows that occur in two documents or more mark their words there; neighbouring marks join, and
what holds a repeated window, or PASSAGE_WORDS words of repeated lines, is a passage. A passage stays in a document
that is the first with any of its marks.

Nulls: null or empty text has no paragraph; a null doc_id is no document. Repeats: rows that share a doc_id are
one document with the passages of each of its texts, and what repeats inside one document alone does not count.
Ties go to the smaller doc_id. Very long texts: their marks are streamed in order, never gathered in a row.
An empty table gives no rows. Extra columns of any name are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argusframe.checkpoints import discard, materialize, scratch
from argusframe.llm.common import Listed, doc_texts
from argusframe.llm.near_dedup import links
from argusframe.llm.shingles import WORDS, WordHashes, mixed, word_hashes
from argusframe.sizing import join_checked

PERCENT = 75
#: Two minima a band and eight bands miss a pair of lines at the threshold about once in 750.
BANDS = 8
ROWS = 2
WINDOW_WORDS = 33
WINDOWS = 17
#: Marked lines join across so many words, such as those of lines too short to be paragraphs.
GAP_WORDS = 8
#: Words of repeated lines that make a passage without a repeated window.
PASSAGE_WORDS = 45
BATCH_SHINGLES = 1 << 21

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)
_SEEDS = np.random.default_rng(11).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


class Paragraphs:
    """Lines and kept windows of a text in a few passes over its word hashes, however many lines it has."""

    def __init__(self, text: str | None, memo: WordHashes):
        lines = [line.split() for line in (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n")]
        sizes = np.array([len(line) for line in lines])
        ends = np.cumsum(sizes)
        self.hashes = word_hashes([w for line in lines for w in line], memo)
        n = len(self.hashes)
        self.shingles = self.hashes[:0]
        if n >= WORDS:
            total = self.hashes[: n - WORDS + 1].copy()
            for i in range(1, WORDS):
                total = (total << np.uint64(13) | total >> np.uint64(51)) ^ self.hashes[i : n - WORDS + 1 + i] * _STEP
            self.shingles = mixed(total)
        whole = sizes >= WORDS
        self.first, self.words = (ends - sizes)[whole], sizes[whole]
        powers, self.backs = (np.cumprod(np.full(n + 1, x, np.uint64)) for x in (_STEP, _BACK))
        self.sums = [np.append(np.zeros(1, np.uint64), np.cumsum(x * powers[:n], dtype=np.uint64)) for x in (mixed(self.hashes), mixed(self.hashes ^ _OTHER))]

    def names(self, first: np.ndarray, words: np.ndarray, which: int = 0) -> np.ndarray:
        """One of two independent signed 64-bit names of each of the word sequences, by sums of powers."""
        sums = self.sums[which]
        return mixed((sums[first + words] - sums[first]) * self.backs[first] + words.astype(np.uint64)).view(np.int64)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """First word and name of every kept window."""
        n = len(self.hashes) - WINDOW_WORDS + 1
        if n < WINDOWS:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        named = self.names(np.arange(n), np.full(n, WINDOW_WORDS))
        around = np.lib.stride_tricks.sliding_window_view(named, WINDOWS)
        kept = np.unique(around.argmin(1) + np.arange(len(around)))
        return kept, named[kept]

    def keys(self) -> np.ndarray:
        """Band keys of each line, from the minima of several hashes of its shingles."""
        if not len(self.first):
            return np.zeros((0, BANDS), np.int64)
        at = np.stack([self.first, self.first + self.words - WORDS + 1], 1).ravel()
        padded = np.append(self.shingles, np.uint64(0))
        minima = np.stack([np.minimum.reduceat(mixed(padded ^ seed), at)[::2] for seed in _SEEDS], 1)
        bands = minima.reshape(-1, BANDS, ROWS) * np.array([1, 3], np.uint64)[:ROWS]
        return mixed(bands.sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _STEP).view(np.int64)

    def sizes(self) -> np.ndarray:
        """Number of distinct shingles of each line."""
        if not len(self.first):
            return np.zeros(0, np.int64)
        counts = self.words - WORDS + 1
        owner = np.repeat(np.arange(len(counts)), counts)
        at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(self.first, counts)
        own = self.shingles[at]
        order = np.lexsort((own, owner))
        own, owner = own[order], owner[order]
        fresh = np.append(True, (own[1:] != own[:-1]) | (owner[1:] != owner[:-1]))
        return np.bincount(owner[fresh], minlength=len(counts))


UNIT = "doc_id long, first_word long, n_words long, c1 long, c2 long, n long, keys array<long>"


def units(docs: DataFrame) -> DataFrame:
    """Every line (its two names, n distinct shingles and band keys) and every kept window (n_words 0, one name)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            for part in range(0, batch.num_rows, 200):
                cut = batch.slice(part, 200)
                out: list[list[np.ndarray]] = [[] for _ in range(6)]
                keys, counts = [], []
                for doc_id, text in zip(*(c.to_pylist() for c in cut.columns), strict=True):
                    p = Paragraphs(text, memo)
                    at, named = p.windows()
                    a, b = len(p.first), len(at)
                    none = np.zeros(b, np.int64)
                    columns = (
                        np.full(a + b, doc_id), np.append(p.first, at), np.append(p.words, none), np.append(p.names(p.first, p.words), named),
                        np.append(p.names(p.first, p.words, 1), none), np.append(p.sizes(), none)
                    )
                    for held, column in zip(out, columns, strict=True):
                        held.append(column)
                    keys.append(p.keys().ravel())
                    counts.append(np.append(np.full(a, BANDS), none))
                ends = np.append(0, np.cumsum(np.concatenate(counts)))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys), pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(np.concatenate(x).astype(np.int64), pa.int64()) for x in out), lists],
                    names=["doc_id", "first_word", "n_words", "c1", "c2", "n", "keys"]
                )

    return doc_texts(docs).where("doc_id IS NOT NULL").mapInArrow(run, UNIT)


def line_classes(found: DataFrame) -> DataFrame:
    """One numbered row a class of equal lines: where it stands first, its set's size and keys, the first and last
    document that hold it, and in how many places."""
    grouped = found.where("n_words > 0").groupBy("c1", "c2")
    first = F.min(F.struct("doc_id", "first_word", "n_words")).alias("first")
    classes = grouped.agg(first, F.max("doc_id").alias("last"), F.count("*").alias("places"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    return classes.select("c1", "c2", "first.*", "last", "places", "n", "keys", F.monotonically_increasing_id().alias("node"))


def shingles_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and set (its sorted shingles) of the wanted lines: node, doc_id, first_word, n_words, c1, c2."""
    item = F.struct("node", "first_word", "n_words", "c1", "c2")
    lists = materialize(wanted.groupBy("doc_id").agg(F.collect_list(item).alias("lines")), "passage-wanted")  # lines of one document
    again = doc_texts(docs).where(Listed(lists, ["doc_id"]).possible(F.col("doc_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            nodes, sets, held = [], [], 0
            for i, text in enumerate(batch.column(0).to_pylist()):
                p = Paragraphs(text, memo)
                node, first, words, *named = (np.array(batch.column(1)[i].values.field(k)) for k in range(5))
                inside = first + words <= len(p.hashes)  # of another text of its doc_id
                node, first, words, named = node[inside], first[inside], words[inside], [x[inside] for x in named]
                equal = (p.names(first, words) == named[0]) & (p.names(first, words, 1) == named[1])
                for k, a, w in zip(node[equal].tolist(), first[equal].tolist(), words[equal].tolist(), strict=True):
                    found = np.unique(p.shingles[a : a + w - WORDS + 1])
                    nodes.append(k)
                    sets.append(found.tobytes())
                    held += len(found)
                if held >= BATCH_SHINGLES or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "set"])
                    nodes, sets, held = [], [], 0

    sets = materialize(again.join(lists.hint("merge"), "doc_id").select("text", "lines").mapInArrow(run, "node long, set binary"), "passage-sets")
    return sets if sets.count() <= wanted.count() else materialize(sets.dropDuplicates(["node"]), "passage-sets")


def clusters(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, component) of the classes of lines that link with any other."""
    in_buckets = classes.select("node", "n", F.explode("keys").alias("bucket"))
    shared = materialize(in_buckets.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1"), "passage-buckets")
    members = materialize(join_checked(in_buckets, shared, "bucket").select("bucket", "c", "node", "n"), "passage-members")
    wanted = materialize(members.select("node").distinct(), "passage-wanted")
    discard(shared)
    wanted = materialize(join_checked(classes.select("node", "doc_id", "first_word", "n_words", "c1", "c2"), wanted, "node", "left_semi"), "passage-wanted")
    return materialize(links(members, shingles_of(docs, wanted), PERCENT), "passage-parts")


def line_marks(docs: DataFrame, found: DataFrame) -> DataFrame:
    """c1, c2 of the classes whose cluster stands in two documents, with cluster_id, keeper and places."""
    with scratch() as held:
        classes = materialize(line_classes(found), "passage-classes")
        parts = clusters(docs, classes)
        # A class of one document without a link is a cluster by itself, and never of two documents.
        named = join_checked(
            classes.select("c1", "c2", "node", F.col("doc_id").alias("first"), "last", "places"), parts, "node", "left"
        ).where("first <> last OR component IS NOT NULL")
        named = materialize(named.select("c1", "c2", F.coalesce("component", "node").alias("cluster"), "first", "last", "places"), "passage-named")
        totals = named.groupBy("cluster").agg(
            F.min("c1").alias("cluster_id"), F.min("first").alias("keeper"), F.max("last").alias("last"), F.sum("places").alias("places")
        ).where("keeper <> last")
        marks = materialize(
            named.select("c1", "c2", "cluster").join(totals, "cluster").select("c1", "c2", "cluster_id", "keeper", "places"), "passage-line-marks"
        )
        held.pass_on(marks)
    return marks


def window_marks(found: DataFrame) -> DataFrame:
    """c1 of the kept windows that two documents hold, with keeper and places. Counting before any join keeps a hot
    window small."""
    counted = found.where("n_words = 0").groupBy("c1").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last"), F.count("*").alias("places"))
    return materialize(counted.where("keeper <> last").drop("last"), "passage-window-marks")


def joined(marks: DataFrame, passage_words: int) -> DataFrame:
    """Passages from the marks (doc_id, first_word, n_words or 0 for a window, cluster_id, keeper, places), which are
    streamed by document and word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "first_word", "n_words", "cluster_id", "n_places", "kept"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        # of the passage at hand: document, first word and end, whether it has a window, cluster, places, whether it stays
        doc, begin, end, sure, cluster, most, stays = None, 0, 0, False, 0, 0, False
        out = []
        for batch in batches:
            for doc_id, first, words, cluster_id, keeper, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if doc_id != doc or first > end + GAP_WORDS:
                    if doc is not None and (sure or end - begin >= passage_words):
                        out.append((doc, begin, end - begin, cluster, most, stays))
                    doc, begin, end, sure, cluster, most, stays = doc_id, first, first, False, cluster_id, 0, False
                sure, end = sure or not words, max(end, first + (words or WINDOW_WORDS))
                cluster, most, stays = min(cluster, cluster_id), max(most, places), stays or keeper == doc_id
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                out = []
        if doc is not None and (sure or end - begin >= passage_words):
            out.append((doc, begin, end - begin, cluster, most, stays))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    ordered = marks.repartition("doc_id").sortWithinPartitions("doc_id", "first_word", "n_words", "cluster_id")
    return ordered.mapInArrow(run, "doc_id long, first_word long, n_words long, cluster_id long, n_places long, kept boolean")


def repeated(docs: DataFrame, passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """One row a passage that other documents have too: doc_id, first_word, n_words, cluster_id, n_places (where
    its most frequent part stands), kept (whether this document is the first with any part of it)."""
    with scratch() as held:
        found = materialize(units(docs), "passage-units")
        lines, windows = line_marks(docs, found), window_marks(found)
        of_lines = join_checked(found.where("n_words > 0").drop("n", "keys"), lines, ["c1", "c2"])
        of_windows = join_checked(
            found.where("n_words = 0").select("doc_id", "first_word", "n_words", "c1"), windows, "c1"
        ).withColumn("cluster_id", F.col("c1"))
        names = ["doc_id", "first_word", "n_words", "cluster_id", "keeper", "places"]
        marks = of_lines.select(*names).unionByName(of_windows.select(*names))
        out = materialize(joined(marks, passage_words), "passages")
        held.pass_on(out)
    return out
