"""Near-duplicates: one-permutation hashing with optimal densification, banding, star-shaped candidates.

Documents of equal shingle sets form a class, and only one of each class goes on; classes are numbered, and
these numbers are the nodes. A class's signature is cut into bands; classes that share a band's key share a
bucket. In each bucket the best-connected class and one more are hubs, and only hub and member are
candidates, so candidates grow with the members of buckets, not with their pairs. Candidates are confirmed on
their whole sets, those of one hub in blocks that hold its set once. Where a bucket still holds more than one
component then, members outside its hub's component are matched with all the others in blocks, over an
inverted index of whole sets, so that no link between members of a bucket is lost. A pair at the threshold
shares no bucket with a chance of about five in a million.

Nulls: null text is the empty text, and texts without words have the empty set and link with nothing; a null
doc_id links with nothing and is kept. Repeats: rows that share a doc_id each get the component of their own
text, and each text counts; a component is named by the smallest doc_id of its rows. Ties: of the rows of a
component that share its smallest doc_id, keep_one keeps that of the smallest text hash, once. Very long
texts: sets are of 8 bytes a shingle, one text at a time. Empty tables give no rows. Extra columns of any
name pass through keep_one and do not travel otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argusframe.checkpoints import discard, materialize, scratch
from argusframe.components import connected_components
from argusframe.llm.common import Listed, doc_texts, unused
from argusframe.llm.shingles import WORDS, WordHashes, band_keys, one_permutation, shingle_set, similar, word_hashes, words_of
from argusframe.sizing import join_checked

PERCENT = 75
BANDS = 32
ROWS = 4
#: Members that meet one copy of their hub's set.
STAR_BLOCK = 128
#: Sizes of the blocks in which unresolved families are matched, and of what a task holds of one at once.
ASKED_A_BLOCK = 384
HELD_A_BLOCK = 384
HELD_SHINGLES = 1 << 21
#: Shingles of the sets that leave Python in one batch.
BATCH_SHINGLES = 1 << 21


def text_key(text: Column) -> Column:
    """Tells apart the texts of one doc_id."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def signatures(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, key (of the text), n (size of the set), class (128-bit hash of the set), keys (one a band; none
    for no set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            for part in range(0, batch.num_rows, 2_000):
                cut = batch.slice(part, 2_000)
                sizes, classes, keys = [], [], []
                for text in cut.column(2).to_pylist():
                    found = shingle_set(word_hashes(words_of(text), memo), k)
                    sizes.append(len(found))
                    classes.append(xxhash.xxh3_128_digest(found.tobytes()))
                    keys.append(band_keys(one_permutation(found), bands, rows) if len(found) else np.zeros(0, np.int64))
                columns = [cut.column(0), cut.column(1), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "n", "class", "keys"])

    texts = doc_texts(docs).select("doc_id", text_key(F.col("text")).alias("key"), "text")
    return texts.mapInArrow(run, "doc_id long, key long, n long, class binary, keys array<long>")


def shingle_table(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """node and set (its shingle hashes, little-endian) of ``wanted``: doc_id, key, node. Repeated rows repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            sets, held, first = [], 0, 0
            for i, text in enumerate(batch.column(1).to_pylist()):
                found = shingle_set(word_hashes(words_of(text), memo), k)
                sets.append(found.tobytes())
                held += len(found)
                if held >= BATCH_SHINGLES or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(sets)), pa.array(sets, pa.binary())], names=["node", "set"])
                    sets, held, first = [], 0, i + 1

    texts = doc_texts(docs).select("doc_id", text_key(F.col("text")).alias("key"), "text")
    asked = texts.where(Listed(wanted, ["doc_id", "key"]).possible(F.col("doc_id"), F.col("key")))
    return asked.join(wanted.hint("merge"), ["doc_id", "key"]).select("node", "text").mapInArrow(run, "node long, set binary")


def cells_of(rows: DataFrame, sets: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` (key, side, node, ...) with the set of each node, every cell of equal key in one task and there
    in order of side. The join sorts both at any size, and the planner may split it where a node is hot."""
    rows = materialize(rows, "near-cells")
    filled = sets.join(rows.hint("merge"), "node").select(*rows.columns, "set")
    return filled.repartition(*key).sortWithinPartitions(*key, "side")


def streamed(
    width: int, start: Callable[[tuple], None], take: Callable[..., None], flush: Callable[[], list[tuple]], batches: Iterator[pa.RecordBatch]
) -> Iterator[pa.RecordBatch]:
    """Rows of cells in order: the first ``width`` columns are the key of a cell, the others are given to ``take``;
    ``flush`` gives the links found so far."""
    now, out = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:width] != now:
                out += flush()
                now = row[:width]
                start(now)
            take(*row[width:])
        if len(out) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])
            out = []
    out += flush()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar. A hub a may have members b without bound: they are
    dealt in blocks, each with one copy of the hub's set, past which a task streams them."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR_BLOCK).cast("int").alias("blocks"))
    sizes = materialize(sizes, "near-stars")
    hubs = sizes.select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.lit(0).alias("side"), F.col("a").alias("node"))
    members = join_checked(pairs, sizes, "a").select(
        "a", F.pmod(F.xxhash64("b"), "blocks").cast("int").alias("i"), F.lit(1).alias("side"), F.col("b").alias("node")
    )
    cells = cells_of(hubs.unionByName(members), sets, ["a", "i"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own, out = 0, np.zeros(0, np.uint64), []

        def start(cell: tuple) -> None:
            nonlocal hub
            hub = cell[0]

        def take(side: int, node: int, found: bytes) -> None:
            nonlocal own
            if side == 0:
                own = np.frombuffer(found, np.uint64)
            elif similar(own, np.frombuffer(found, np.uint64), percent):
                out.append((hub, node))

        def flush() -> list[tuple]:
            nonlocal out
            got, out = out, []
            return got

        yield from streamed(2, start, take, flush, batches)

    return cells.mapInArrow(run, "a long, b long")


def range_rows(low: np.ndarray, high: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The entries of ``at`` in each of the ranges low..high, one after the other."""
    sizes = high - low
    return at[np.repeat(low - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]


class Parts:
    """Which parts are joined by the links found so far."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, part: int) -> int:
        while (above := self.up.get(part, part)) != part:
            self.up[part] = part = self.up.get(above, above)
        return part

    def join(self, a: int, b: int) -> bool:
        """Whether they were apart before."""
        a, b = self.root(a), self.root(b)
        self.up[a] = b
        return a != b


def match_block(asked: list[tuple[int, np.ndarray]], held: list[tuple[int, np.ndarray]], percent: int, parts: Parts) -> Iterator[tuple[int, int]]:
    """Pairs of parts that similar ones among the (part, set) asked and held join, but none that others join already.
    Overlaps are counted through an inverted index of the block, so pairs without a common shingle cost nothing."""
    shingles = np.concatenate([x[1] for x in held])
    owner = np.repeat(np.arange(len(held)), [len(x[1]) for x in held])
    order = np.argsort(shingles, kind="stable")
    shingles, owner = shingles[order], owner[order]
    part_of, sizes = np.array([x[0] for x in held]), np.array([len(x[1]) for x in held])
    for part, own in asked:
        both = np.bincount(range_rows(np.searchsorted(shingles, own, "left"), np.searchsorted(shingles, own, "right"), owner), minlength=len(held))
        hits = np.flatnonzero((100 * both >= percent * (len(own) + sizes - both)) & (part_of != part))
        for found in np.unique(part_of[hits]).tolist():
            if parts.join(part, found):
                yield part, found


def match_families(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of parts of each family that a link joins; rows are (family, node, part, is_asked), one a node
    and family. The nodes asked meet all nodes of their family, block by block: a task takes the asked of one
    block, then streams the others past them, and yields no more links than join the parts it sees."""
    sizes = rows.groupBy("family").agg(F.count_if("is_asked").alias("n_asked"), F.count("*").alias("n_held"))
    sizes = sizes.select(
        "family", F.ceil(F.col("n_asked") / ASKED_A_BLOCK).cast("int").alias("asked_blocks"),
        F.ceil(F.col("n_held") / HELD_A_BLOCK).cast("int").alias("held_blocks")
    )
    rows = join_checked(rows, materialize(sizes, "near-families"), "family")
    block = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    names = ["family", "i", "j", "side", "node", "part"]
    asked = rows.where("is_asked").select(
        "family", block(F.col("asked_blocks")).alias("i"), every(F.col("held_blocks")).alias("j"), F.lit(0).alias("side"), "node", "part"
    )
    held = rows.where("asked_blocks > 0").select(
        "family", every(F.col("asked_blocks")).alias("i"), block(F.col("held_blocks")).alias("j"), F.lit(1).alias("side"), "node", "part"
    )
    cells = cells_of(asked.unionByName(held).select(*names), sets, ["family", "i", "j"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, held, n, out, parts = [], [], 0, [], Parts()

        def match() -> None:
            nonlocal held, n
            if asked and held:
                out.extend(match_block(asked, held, percent, parts))
            held, n = [], 0

        def start(cell: tuple) -> None:
            nonlocal parts
            asked.clear()
            parts = Parts()

        def take(side: int, node: int, part: int, found: bytes) -> None:
            nonlocal n
            shingles = np.frombuffer(found, np.uint64)
            if side == 0:
                asked.append((part, shingles))
                return
            held.append((part, shingles))
            n += len(shingles)
            if n >= HELD_SHINGLES:
                match()

        def flush() -> list[tuple]:
            nonlocal out
            match()
            got, out = out, []
            return got

        yield from streamed(3, start, take, flush, batches)

    return cells.mapInArrow(run, "a long, b long")


def links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, component) of all nodes that link with any; members are (bucket, c, node, n) of shared buckets
    of c nodes each."""
    # How crowded a node's buckets are: the centre of a family of copies collides most, and makes the best hub.
    crowd = materialize(members.groupBy("node").agg(F.sum("c").alias("crowd")), "near-crowd")
    members = materialize(join_checked(members.drop("c"), crowd, "node"), "near-members")
    fits = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent
    best, other = F.max(F.struct("crowd", "node", "n")), F.max(F.struct(F.xxhash64("node"), "node", "n"))
    hubs = members.groupBy("bucket").agg(best.alias("h"), other.alias("o")).select(
        "bucket", F.array("h.node", "o.node").alias("hub"), F.array("h.n", "o.n").alias("hub_n")
    )
    hubs = materialize(hubs, "near-hubs")
    stars = join_checked(members.select("bucket", "node", "n"), hubs, "bucket").select("node", "n", F.explode(F.arrays_zip("hub", "hub_n")).alias("h"))
    stars = stars.where((F.col("node") != F.col("h.hub")) & fits(F.col("n"), F.col("h.hub_n")))
    low, high = F.least("node", "h.hub").alias("low"), F.greatest("node", "h.hub").alias("high")
    tested = stars.groupBy(low, high).agg(F.max("h.hub").alias("a"))  # one of two hubs of each other has the pair
    tested = materialize(tested.select("a", F.when(F.col("a") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("b")), "near-tested")
    found = materialize(confirm(tested, sets, percent), "near-links")
    parts = materialize(connected_components(found), "near-parts")
    discard(crowd, hubs, tested)

    now = join_checked(members, parts, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
    open_ = now.groupBy("bucket").agg(
        F.min("part").alias("p"), F.max("part").alias("q"), F.max(F.struct("crowd", "node", "part"))["part"].alias("main")
    ).where("p <> q").select("bucket", "main")
    open_ = materialize(open_, "near-open")
    now = join_checked(now, open_, "bucket").groupBy(F.col("main").alias("family"), "node").agg(F.first("part").alias("part"))
    now = materialize(now.withColumn("is_asked", F.col("part") != F.col("family")), "near-unresolved")
    if not now.count():
        return parts
    last = materialize(match_families(now, sets, percent), "near-links")
    if not last.count():
        return parts
    # Parts are joined as wholes: only they, and nodes that were parts by themselves, get new names.
    joined = materialize(connected_components(last), "near-joined")
    wider = join_checked(parts, joined.select(F.col("node").alias("component"), F.col("component").alias("whole")), "component", "left")
    alone = join_checked(joined, parts.select("node"), "node", "left_anti")
    return wider.select("node", F.coalesce("whole", "component").alias("component")).unionByName(alone)


def assign(docs: DataFrame, k: int, percent: int, bands: int, rows: int) -> DataFrame:
    """Per row: doc_id, key (of its text), n, component (its smallest doc_id), kept, and part, which tells apart
    components of the same smallest doc_id."""
    with scratch() as held:
        signed = materialize(signatures(docs, k, bands, rows), "near-signatures")
        some = signed.where("n > 0 AND doc_id IS NOT NULL").groupBy("class")
        # A class is numbered, since one doc_id may hold several texts and so stand first in several classes.
        classes = some.agg(F.min(F.struct("doc_id", "key")).alias("first"), F.first("n").alias("n"), F.first("keys").alias("keys"))
        classes = materialize(classes.select("class", "first.*", "n", "keys", F.monotonically_increasing_id().alias("node")), "near-classes")
        in_buckets = classes.select("node", "n", F.explode("keys").alias("bucket"))
        shared = in_buckets.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1")
        shared = materialize(shared, "near-buckets")
        members = materialize(join_checked(in_buckets, shared, "bucket").select("bucket", "c", "node", "n"), "near-members")
        discard(shared)
        names = classes.select("class", F.col("doc_id").alias("component"), F.col("node").alias("part"))
        if members.count():
            wanted = materialize(
                join_checked(classes.drop("class", "n", "keys"), materialize(members.select("node").distinct(), "near-wanted"), "node", "left_semi"),
                "near-wanted"
            )
            sets = materialize(shingle_table(docs, wanted, k), "near-sets")
            if sets.count() > wanted.count():  # rows repeat
                sets = materialize(sets.dropDuplicates(["node"]), "near-sets")
            parts = materialize(links(members, sets, percent), "near-parts")
            discard(sets)
            least = join_checked(classes.select("node", "doc_id"), parts, "node").groupBy("component").agg(F.min("doc_id").alias("least"))
            parts = materialize(join_checked(parts, materialize(least, "near-least"), "component"), "near-parts")
            names = join_checked(classes.select("class", "doc_id", "node"), parts, "node", "left")
            names = materialize(
                names.select("class", F.coalesce("least", "doc_id").alias("component"), F.coalesce("component", "node").alias("part")), "near-names"
            )
        held.pass_on(signed, names)
        out = signed.drop("keys").join(names, "class", "left")
        component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
        return out.select("doc_id", "key", "n", component.alias("component"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"), "part")


def group(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id reachable), kept."""
    return assign(docs, k, percent, bands, rows).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "kept")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group of near-duplicates, of the smallest doc_id."""
    gone_id, gone_key, is_first = unused(docs, "_gone_id", "_gone_key", "_is_first")
    with scratch() as held:
        named = materialize(assign(docs, WORDS, PERCENT, BANDS, ROWS), "near-named")
        as_found = lambda rows: rows.select(F.col("doc_id").alias(gone_id), F.col("key").alias(gone_key))
        own = docs["doc_id"].cast("long"), text_key(docs["text"])
        same = (own[0] == F.col(gone_id)) & (own[1] == F.col(gone_key))

        def without(out: DataFrame) -> DataFrame:
            listed = Listed(out, [gone_id, gone_key])
            held.pass_on(out, listed.words)
            maybe = docs.where(listed.possible(*own))
            return docs.where(~listed.possible(*own)).unionByName(maybe.join(out.hint("merge"), same, "left_anti"))

        gone = materialize(as_found(named.where("NOT kept")).distinct(), "near-gone")
        # Several rows may share a component's smallest doc_id: equal ones, or near copies of each other.
        heads = named.where("kept AND n > 0 AND doc_id IS NOT NULL")
        again = materialize(heads.groupBy("part").agg(F.min("key").alias("least"), F.count("*").alias("rows")).where("rows > 1"), "near-again")
        if not again.count():
            return without(gone)
        heads = join_checked(heads.select("part", "doc_id", "key").distinct(), again, "part")
        extra = as_found(heads.where("key <> least"))
        firsts = materialize(as_found(heads.where("key = least")), "near-firsts")
        out_of_rows = materialize(gone.unionByName(extra).unionByName(firsts), "near-gone")
        listed = Listed(firsts, [gone_id, gone_key])
        held.pass_on(firsts, listed.words)
        one = docs.where(listed.possible(*own)).join(firsts.hint("merge"), same)
        one = one.groupBy(gone_id, gone_key).agg(F.first(F.struct(*[docs[c] for c in docs.columns])).alias(is_first))
        return without(out_of_rows).unionByName(one.select(f"{is_first}.*"))
