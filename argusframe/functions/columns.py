"""Scalar expressions: ratios, rounding, text and byte statistics, sequences. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAD, UNKNOWN = 0, 1
SEPARATOR = "\x1f"


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """0.0 where the denominator is 0 or null, or the quotient is not a number."""
    q = numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))
    return F.coalesce(F.when(~F.isnan(q), q), F.lit(0.0))


def rate_or_null(numerator: Column, denominator: Column) -> Column:
    """Null where the denominator is 0."""
    return numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))


def half_even(x: Column) -> Column:
    return F.bround(x, 0)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column, clip: float = 1e-7) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - clip)), F.lit(clip))
    return F.ln(q / (1 - q))


def strip_dump_suffix(name: Column) -> Column:
    """``<sample>-<n>.raw`` without its dump number."""
    return F.regexp_replace(name, r"^(.+)-([0-9]+)\.raw$", "$1")


def family_of(name: Column) -> Column:
    """The sample's name without dump number and trailing hexadecimal digest."""
    return F.regexp_replace(strip_dump_suffix(name), r"-[0-9a-fA-F]{6,}$", "")


def printable_runs(text: Column, least: int = 5) -> Column:
    return F.regexp_extract_all(text, F.lit(f"([\\x20-\\x7f]{{{least},}})"), F.lit(1))


def sequence_hash(items: Column) -> Column:
    return F.sha2(F.array_join(items, SEPARATOR), 256)


def behavioral_status(n: Column) -> Column:
    return F.when(n == 0, "empty").when(n < 10, "too_short").when(n < 100, "short").when(n == 100, "ok").otherwise("truncated")


def emulation_status(n: Column) -> Column:
    return F.when(n == 0, "empty").when(n < 500, "insufficient").when(n == 500, "ok").otherwise("truncated")


def length_band(n: Column) -> Column:
    return F.when(n < 10, "<10").when(n < 100, "10-99").otherwise(">=100")


def odds_label(prevalence: Column) -> Column:
    """``1 in N`` with thousands separated."""
    return F.concat(F.lit("1 in "), F.format_number(half_even(1 / prevalence).cast("long"), 0))


def multi_hot(names: Column, vocabulary: list[str]) -> Column:
    return F.array(*[F.array_contains(names, v).cast("int") for v in vocabulary])


def category_index(value: Column, vocabulary: list[str]) -> Column:
    """Place of a value in a fixed vocabulary; unknown values get 0, as the first entry does."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, vocabulary)), value), F.lit(0)) - 1, F.lit(0))


def is_error(error: Column) -> Column:
    """Whether a JSON error value is more than nothing."""
    return error.isNotNull() & ~F.trim(error).isin("{}", "null", '""', "", "[]", "0", "false")


def digest_or_null(hex_text: Column) -> Column:
    """32 bytes of a hexadecimal SHA-256; null for anything else."""
    raw = F.try_to_binary(F.trim(hex_text), F.lit("hex"))
    return F.when(F.length(raw) == 32, raw)
