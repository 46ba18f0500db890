"""Membership in a large list of digests: a Bloom filter of bounded size first, then an exact look-up of what passes it.

The list is kept as an artifact: distinct digests in sorted ranges, partitioned by their first digits (digests are
uniform, so these are its range index), and beside them a filter built by partial aggregation. Rows that the filter turns
away are settled where they stand; only keys and digests of the others meet the list, and of the list only the ranges
they fall into. Answers are exact at any size: a list too long for the filter's bound passes more digests on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from argusframe.checkpoints import materialize, reserve

DIGEST_DIGITS = 64
#: The filter takes at most so many bits, 8 MiB, which every task holds.
FILTER_BITS = 1 << 26
BITS_A_KEY = 10
HASHES = 7
PART_DIGITS = 2


def normal(digest: Column) -> Column:
    """A digest in lower-case hexadecimal, or null for anything else: a malformed one is never listed."""
    low = F.lower(digest)
    return F.when(low.rlike(f"^[0-9a-f]{{{DIGEST_DIGITS}}}$"), low)


def places(digest: Column, bits: int) -> list[Column]:
    """The bits of the filter that a digest sets."""
    h = F.xxhash64(digest)
    first, step = h.bitwiseAND(0x7FFFFFFF), F.shiftrightunsigned(h, 33)
    return [(first + i * step) % bits for i in range(HASHES)]


def mask(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))


@dataclass(frozen=True)
class Filter:
    """A Bloom filter: a table of one row with its words, and how many bits they are."""

    words: DataFrame
    bits: int

    @classmethod
    def of(cls, digests: DataFrame, n: int, most_bits: int = FILTER_BITS) -> Filter:
        """Of the column ``digest``: bits are gathered in 64-bit words, by partial aggregates."""
        bits = min(most_bits, max(64, 1 << (n * BITS_A_KEY).bit_length()))
        each = digests.select(F.explode(F.array(*places(F.col("digest"), bits))).alias("place"))
        ones = each.select(F.shiftright("place", 6).alias("word"), mask(F.col("place")).alias("bits"))
        all_words = digests.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
        words = ones.unionByName(all_words).groupBy("word").agg(F.bit_or("bits").alias("bits"))
        row = words.agg(F.array_sort(F.collect_list(F.struct("word", "bits")))["bits"].alias("words"))  # of bounded length
        return cls(row, bits)

    def possible(self, digest: Column) -> Column:
        """False: surely not in it. True: likely. Null for a null digest."""
        words = self.words.select("words").scalar()
        hits = [F.get(words, F.shiftright(p, 6).cast("int")).bitwiseAND(mask(p)) != 0 for p in places(digest, self.bits)]
        found = hits[0]
        for hit in hits[1:]:
            found = found & hit
        return F.when(digest.isNotNull(), found)


@dataclass(frozen=True)
class Artifact:
    """A list of digests (digest, part) and its filter."""

    digests: DataFrame
    filter: Filter

    def listed(self, asked: DataFrame) -> DataFrame:
        """The distinct digests of ``asked`` (column digest) that are listed. Only ranges that hold one are read."""
        wanted = materialize(asked.select("digest").where(self.filter.possible(F.col("digest"))).distinct().withColumn("part", F.substring("digest", 1, PART_DIGITS)), "asked")
        parts = [r.part for r in wanted.select("part").distinct().collect()]  # 256 at most
        return wanted.join(self.digests.where(F.col("part").isin(parts)), ["part", "digest"], "left_semi").select("digest")


def write(digests: DataFrame, path: str, on: str = "sha256", most_bits: int = FILTER_BITS) -> Artifact:
    """Write the artifact of a column of digests to ``path`` and open it."""
    known = digests.select(normal(F.col(on)).alias("digest")).where("digest IS NOT NULL").distinct().withColumn("part", F.substring("digest", 1, PART_DIGITS))
    known.repartitionByRange("digest").sortWithinPartitions("digest").write.partitionBy("part").parquet(f"{path}/digests")
    spark = digests.sparkSession
    kept = spark.read.schema("digest string, part string").parquet(f"{path}/digests")
    n = kept.count()
    made = Filter.of(kept, n, most_bits)
    made.words.select("words", F.lit(made.bits).cast("long").alias("bits"), F.lit(n).cast("long").alias("n")).write.parquet(f"{path}/filter")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> Artifact | None:
    """The artifact at ``path``; None where there is none; an error if it is cut short."""
    try:
        stored = spark.read.parquet(f"{path}/filter")
    except AnalysisException:
        return None
    digests = spark.read.schema("digest string, part string").parquet(f"{path}/digests")
    rows = stored.select(F.size("words").alias("words"), "bits", "n").take(2)
    if len(rows) != 1 or rows[0].words * 64 != rows[0].bits or digests.count() != rows[0].n:
        raise RuntimeError(f"the list of digests at {path} is damaged or cut short")
    return Artifact(digests, Filter(stored.select("words"), rows[0].bits))


def of(digests: DataFrame | Artifact, on: str = "sha256") -> Artifact:
    """An artifact, made below the shared folder for the innermost scope unless given."""
    return digests if isinstance(digests, Artifact) else write(digests, reserve(digests.sparkSession, "digests"), on)
