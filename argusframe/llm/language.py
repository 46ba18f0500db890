"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is its lower-cased words; each run of two to four letters, word ends included, is hashed to a
bucket with a learned embedding. The mean embedding goes through a linear softmax, all trained together
by stochastic gradient descent in numpy. One more class of the softmax stands for none of the languages: it
learns from sample texts whose letters were put out of order or replaced by others, of the same alphabet or not.
A temperature fitted on rows kept from training turns scores into probabilities, and a probability below the
calibrated threshold is a rejection: it lies between what clean and what spoilt texts of those rows score.

The classifier is fitted on at most ``SAMPLE_ROWS`` labelled rows (those of the smallest hashes of doc_id and
text), each read whole: tasks count its subwords, at most 2**BITS numbers a text, and only these travel, packed, to
the task that fits. It unpacks one example a step; the driver gets the fitted model and no example.
Predictions read whole texts as well, slice after slice, however long.

Nulls: text that is null or has no letter is ``und`` with score 0 and rejected; null lang is never learned from,
nor is a row of null doc_id. With nothing to learn from, every text is ``und``. Repeats: equal rows get equal
predictions; rows that share a doc_id are learned from and predicted each by its own text. Ties between languages
go to the first in order. Empty tables give no rows. Extra columns of any name pass through keep_recognised and
do not travel otherwise.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argusframe.llm.common import doc_texts, emit, map_rows

UNKNOWN = "und"
SAMPLE_ROWS = 6000
BITS = 16
WIDTH = 16
EPOCHS = 3
#: Small samples are gone through more often, until there were so many steps.
LEAST_STEPS = 12_000
RATE = 0.3
#: One row in so many of the sample calibrates and is not trained on.
CALIBRATE = 5
#: One row in so many of the sample is spoilt as well, for the class of no language.
SPOIL = 3
#: Shares of the clean texts kept from training that the threshold keeps, and of the spoilt ones that it rejects;
#: where both are possible it lies a quarter of the way up from these to those, since clean texts come first.
KEPT_SHARE = 0.995
SPOILT_SHARE = 0.95
#: First letters and sizes of the alphabets that replace letters: Latin, Greek, Cyrillic, Hebrew, Devanagari, Kana, Han.
ALPHABETS = ((0x61, 26), (0x3B1, 25), (0x430, 32), (0x5D0, 27), (0x904, 54), (0x3041, 86), (0x4E00, 20_000))
SLICE = 1 << 18
SPACE = 32

_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000))
    return _letters[0]


def words(text: str) -> np.ndarray:
    """Code points of the lower-cased letters, with one space before, between and after words; empty without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letter_table()[codes]
    if not letter.any():
        return codes[:0]
    closing = ~letter
    closing[1:] &= letter[:-1]
    closing[0] = False
    kept = np.where(letter, codes, np.uint32(SPACE))[letter | closing]
    ends = np.full(1, SPACE, np.uint32)
    return np.concatenate([ends, kept, ends] if letter[-1] else [ends, kept])


def buckets(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of a text's subwords, slice after slice."""
    codes = words(text)
    for at in range(0, len(codes) - 1, SLICE):
        c = codes[at : at + SLICE + 3]
        n = min(SLICE, len(codes) - at)
        inner = c != SPACE
        two = (c[:-1] * np.uint32(0x9E3779B1)) ^ (c[1:] * np.uint32(0x85EBCA77))
        three = (two[:-1] * np.uint32(0xC2B2AE3D)) ^ (c[2:] * np.uint32(0x27D4EB2F))
        four = (three[:-1] * np.uint32(0x165667B1)) ^ (c[3:] * np.uint32(0x9E3779B1))
        parts = [two[:n], three[:n][inner[1:-1][:n]], four[:n][(inner[1:-2] & inner[2:-1])[:n]]]
        hashed = np.concatenate(parts)
        hashed ^= hashed >> np.uint32(15)
        hashed *= np.uint32(0x2C1B3C6D)
        yield hashed >> np.uint32(32 - BITS)


def spoilt(text: str, rng: np.random.Generator) -> str:
    """The text with its letters in another order, or with some or all of its alphabet replaced by other letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    at = np.flatnonzero(letter_table()[codes])
    if rng.random() < 0.4:
        codes[at] = codes[rng.permutation(at)]
    else:
        own, which = np.unique(codes[at], return_inverse=True)
        first, size = ALPHABETS[0] if rng.random() < 0.6 else ALPHABETS[rng.integers(1, len(ALPHABETS))]
        share = rng.uniform(0.4, 1) if first == ALPHABETS[0][0] else 1
        codes[at] = np.where(rng.random(len(own)) < share, first + rng.integers(0, size, len(own)), own).astype(np.uint32)[which]
    return codes.tobytes().decode("utf-32-le", "surrogatepass")


#: An example: distinct buckets of a text and how often each occurs, packed; empty for a text without a letter.
Example = bytes


def packed(which: np.ndarray, counts: np.ndarray) -> Example:
    """Gaps between ascending buckets, and counts, first bytes first: most others are zeros then, in one run."""
    if not len(which):
        return b""
    planes = [x.view(np.uint8).reshape(len(x), -1).T.ravel() for x in (np.diff(which, prepend=which[:1] * 0), counts)]
    return zlib.compress(np.concatenate(planes), 1)


def unpacked(example: Example) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zlib.decompress(example), np.uint8).reshape(6, -1)
    gaps, counts = (np.ascontiguousarray(part.T).view(kind).ravel() for part, kind in ((planes[:2], np.uint16), (planes[2:], np.uint32)))
    return gaps.cumsum(dtype=np.uint16), counts


def weighted(example: Example) -> tuple[np.ndarray, np.ndarray]:
    """Buckets, and the share of each in the text."""
    which, counts = unpacked(example)
    return which, (counts / counts.sum()).astype(np.float32)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets are summed slice by slice, so that a very long text takes no more than their number."""
    total = None
    for part in buckets(text):
        n = np.bincount(part, minlength=1 << BITS)
        total = n if total is None else total + n
    which = np.flatnonzero(total) if total is not None else np.zeros(0, np.int64)
    return which.astype(np.uint16), (total[which] if total is not None else which).astype(np.uint32)


def examples_of(text: str, seed: int) -> list[Example]:
    """The text, a few words of it (short texts must be known as well), and both spoilt, or empty for most seeds."""
    rng = np.random.default_rng(seed & 0xFFFFFFFFFFFFFFFF)
    parts = text.split()
    few = int(rng.integers(1, 13))
    at = int(rng.integers(0, max(1, len(parts) - few + 1)))
    short = " ".join(parts[at : at + few])
    bad = (spoilt(text, rng), spoilt(short, rng)) if rng.integers(SPOIL) == 0 else ("", "")
    return [packed(*counted(x)) for x in (text, short, *bad)]


class Model:
    """Languages, the score each bucket adds to each of them and to none, temperature and threshold."""

    def __init__(self, languages: list[str], scores: np.ndarray, bias: np.ndarray, temperature: float, threshold: float):
        self.languages, self.scores, self.bias, self.temperature, self.threshold = languages, scores, bias, temperature, threshold

    def logits(self, text: str) -> np.ndarray | None:
        total, n = np.zeros(len(self.bias)), 0
        for part in buckets(text):
            total += self.scores.take(part, axis=0).sum(0, dtype=np.float64)
            n += len(part)
        return total / n + self.bias if n else None

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated probability, and whether the text is rejected."""
        z = self.logits(text) if text and self.languages else None
        if z is None:
            return UNKNOWN, 0.0, True
        z = z / self.temperature
        best = int(z[:-1].argmax())
        score = float(softmax(z)[best])
        return self.languages[best], score, score < self.threshold


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def threshold_between(clean: np.ndarray, bad: np.ndarray) -> float:
    """A score that keeps KEPT_SHARE of the clean scores and, where that is possible, rejects SPOILT_SHARE of the bad."""
    low = float(np.quantile(clean, 1 - KEPT_SHARE, method="lower")) if len(clean) else 0.0
    high = float(np.quantile(bad, SPOILT_SHARE, method="higher")) if len(bad) else 0.0
    return high + (low - high) / 4 if high < low else low


def fit(rows: list[tuple[str, str]], seed: int = 7) -> Model:
    """Train on (text, language) rows, in their order but for a seeded shuffle."""
    return fit_counted([(examples_of(text, i), lang) for i, (text, lang) in enumerate(rows)], seed)


def fit_counted(rows: list[tuple[list[Example], str]], seed: int = 7) -> Model:
    """Train on the examples of each row (clean ones, then spoilt ones) and its language. They stay packed but for the
    one of a step, since they are most of what fitting holds."""
    rng = np.random.default_rng(seed)
    languages = sorted({lang for _, lang in rows})
    index = {lang: i for i, lang in enumerate(languages)}
    none = len(languages)
    examples: list[tuple[Example, int]] = []
    held: list[tuple[Example, int]] = []
    held_whole: list[bool] = []
    for i, (made, lang) in enumerate(rows):
        kept = i % CALIBRATE == 0 and len(rows) >= 5 * CALIBRATE
        for j, example in enumerate(made):
            if example:
                if kept:
                    held_whole.append(j % 2 == 0)
                (held if kept else examples).append((example, none if j >= 2 else index[lang]))
    embed = rng.uniform(-1 / WIDTH, 1 / WIDTH, (1 << BITS, WIDTH)).astype(np.float32)
    out, bias = np.zeros((WIDTH, none + 1), np.float32), np.zeros(none + 1, np.float32)
    epochs = max(EPOCHS, -(-LEAST_STEPS // max(len(examples), 1))) if examples else 0
    steps, done = epochs * len(examples), 0
    for _ in range(epochs):
        for i in rng.permutation(len(examples)).tolist():
            example, y = examples[i]
            which, weight = weighted(example)
            rate = np.float32(RATE * (1 - done / steps) + 1e-4)
            own = embed[which]
            mean = weight @ own
            error = softmax(mean @ out + bias)
            error[y] -= 1
            back = out @ error
            out -= rate * np.outer(mean, error)
            bias -= rate * np.float32(0.1) * error
            own -= np.multiply.outer((rate * len(which) ** 0.5) * weight, back)
            embed[which] = own
            done += 1
    model = Model(languages, (embed @ out).astype(np.float32), bias.astype(np.float64), 1.0, 0.0)
    if held:
        z = np.array([w @ model.scores[which] + model.bias for which, w in (weighted(example) for example, _ in held)])
        y = np.array([label for _, label in held])
        loss = lambda t: -np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean()
        model.temperature = min((math.exp(t) for t in np.linspace(-3, 3, 121)), key=loss)
        best = softmax(z / model.temperature)[:, :none].max(1)
        whole = np.array(held_whole)  # documents are rejected, not parts of them
        model.threshold = threshold_between(best[whole & (y < none)], best[whole & (y == none)])
    return model


def held_out(doc_id: Column) -> Column:
    """Whether a document is never learned from: a quarter of all, by checksum of its id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame) -> Model:
    """Fit on the bounded sample of the rows that may be learned from."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    # Rows of one doc_id differ by their texts, so that few ids make no small sample.
    rows = rows.withColumn("h", F.xxhash64("doc_id", "text"))
    low = F.pmod("h", F.lit(1 << 30))
    names = [f"example{j}" for j in range(4)]

    def make():
        def one(h: int, doc_id: int, text: str, lang: str) -> Iterator[tuple]:
            yield (h, doc_id, lang, *examples_of(text, h))

        return one

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fit_counted([(made, lang) for batch in batches for lang, *made in zip(*(c.to_pylist() for c in batch.columns), strict=True)])
        row = model.languages, model.scores.tobytes(), model.bias.tobytes(), model.temperature, model.threshold
        types = [pa.list_(pa.string()), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
        yield emit(["languages", "scores", "bias", "temperature", "threshold"], [row], types)

    n = rows.count()
    # Only about twice the rows of the sample are ordered, by hash alone, so what tasks send does not grow with their
    # number; where equal rows hash so unevenly that fewer are found, all are. Examples are made up to the last hash.
    for share in (2 * SAMPLE_ROWS / max(n, 1), 1.0):
        drawn = rows.where(low < F.lit(int(min(share, 1) * (1 << 30)))).select("h", "doc_id", "text", "lang")
        first = drawn.select(low.alias("low"), "h").orderBy("low", "h").limit(SAMPLE_ROWS)
        found, last = first.agg(F.count("*"), F.max(F.struct("low", "h"))).first()
        if found >= min(SAMPLE_ROWS, n):
            break
    if last is None:
        return fit_counted([])
    drawn = drawn.where((low < last.low) | ((low == last.low) & (F.col("h") <= last.h)))
    made = map_rows(drawn, make, ", ".join(["h long, doc_id long, lang string", *(f"{c} binary" for c in names)]))
    few = made.orderBy(low, "h", "doc_id", "lang", *names).limit(SAMPLE_ROWS).select("lang", *names)  # one partition, in this order
    schema = "languages array<string>, scores binary, bias binary, temperature double, threshold double"
    model = few.coalesce(1).mapInArrow(fitted, schema).first()
    scores = np.frombuffer(model.scores, np.float32).reshape(1 << BITS, -1)
    return Model(list(model.languages), scores, np.frombuffer(model.bias), model.temperature, model.threshold)


def predict_documents(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS rows of one float a language

    def make():
        predict = shared.value.predict

        def one(doc_id: int | None, text: str | None) -> Iterator[tuple]:
            yield (doc_id, *predict(text))

        return one

    found = map_rows(doc_texts(docs), make, "doc_id long, lang_pred string, score double, rejected boolean")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def keep_recognised(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose language the model does not reject; all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def recognised(texts: pd.Series) -> pd.Series:
        predict = shared.value.predict
        return pd.Series([not predict(t)[2] for t in texts], dtype=bool)

    return docs.where(recognised(F.col("text").cast("string")))
