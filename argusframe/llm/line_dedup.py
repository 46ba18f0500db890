"""Line dedup: lines that many documents hold stay in one of them.

Each document gives the distinct hashes of its long normalised lines; documents are counted per hash; the
hashes over the threshold go back to the documents that lose them, and texts are put together again from
their lines in order. A hash held by a third of all documents is counted by partial aggregates, and joined
by broadcast if the frequent lines are few, else by a join that may be split. Of the texts only those travel
to their lists that a filter of bounded size doesn't turn away; the others stay as they are read.

Nulls: null or empty text is one empty line; a row of null doc_id is no document: it isn't counted and keeps its
lines. Repeats: rows that share a doc_id are one document. Ties cannot occur: of the documents that hold a line, the
largest doc_id keeps it. Very long texts: a text is split into its lines in one task, in memory linear in its length.
An empty table gives no rows. Extra columns of any name pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argusframe.checkpoints import materialize, scratch
from argusframe.llm.common import BLANKS, Listed, doc_texts, map_rows, unused
from argusframe.sizing import join_checked

MIN_CHARS = 40
MIN_DOCS = 5


def line_key(line: str, min_chars: int) -> bytes | None:
    """128-bit hash of a line without blanks at its ends, A-Z lower-cased; None if that is too short."""
    bare = line.strip(BLANKS)
    return xxhash.xxh3_128_digest(bare.encode("utf-8", "surrogatepass").lower()) if len(bare) >= min_chars else None


def frequent_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id and dropped (hashes of the lines it loses), for the documents that lose any."""

    def make():
        def one(doc_id: int | None, text: str | None) -> Iterator[tuple]:
            for key in {line_key(line, min_chars) for line in (text or "").split("\n")} - {None}:
                yield doc_id, key

        return one

    held = materialize(map_rows(doc_texts(docs).where("doc_id IS NOT NULL"), make, "doc_id long, line_hash binary"), "line-hashes")
    counts = held.groupBy("line_hash").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("keeper"))
    frequent = materialize(counts.where(F.col("n_docs") >= min_docs).select("line_hash", "keeper"), "frequent-lines")
    lost = join_checked(held, frequent, "line_hash").where(F.col("doc_id") != F.col("keeper"))
    return lost.groupBy("doc_id").agg(F.collect_set("line_hash").alias("dropped"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The rows of ``docs`` with their text shortened, and the added column _lines: n_lines before, n_dropped."""
    lost_id, lost_lines, made_name = unused(docs, "_lost_id", "_lost", "_made")
    with scratch() as held:
        lost = materialize(frequent_lines(docs, min_chars, min_docs).select(F.col("doc_id").alias(lost_id), F.col("dropped").alias(lost_lines)), "lost-lines")
        listed = Listed(lost, [lost_id])
        held.pass_on(lost, listed.words)

    @F.pandas_udf("text string, n_lines long, n_dropped long")
    def reassemble(texts: pd.Series, dropped: pd.Series) -> pd.DataFrame:
        out = []
        for text, gone in zip(texts, dropped, strict=True):
            lines = (text or "").split("\n")
            if gone is None or not len(gone):
                out.append((text, len(lines), 0))
                continue
            gone = set(gone)
            kept = [line for line in lines if line_key(line, min_chars) not in gone]
            out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
        return pd.DataFrame(out, columns=["text", "n_lines", "n_dropped"])

    text, doc_id = F.col("text").cast("string"), F.col("doc_id").cast("long")
    joined = docs.where(listed.possible(doc_id)).join(lost.hint("merge"), doc_id == F.col(lost_id), "left")
    made = joined.withColumn(made_name, reassemble(text, F.col(lost_lines)))
    n_lines = F.size(F.split(F.coalesce(text, F.lit("")), "\n", -1)).cast("long")
    whole = F.struct(text.alias("text"), n_lines.alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
    settled = docs.where(~listed.possible(doc_id)).withColumn(made_name, whole)
    names = [F.col(made_name)["text"].alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    counts = F.struct(F.col(made_name)["n_lines"].alias("n_lines"), F.col(made_name)["n_dropped"].alias("n_dropped"))
    out = [*names, counts.alias(unused(docs, "_lines")[0])]
    return settled.select(*out).unionByName(made.select(*out))
