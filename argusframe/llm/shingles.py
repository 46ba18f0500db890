"""Word shingles as sorted 64-bit hashes, their one-permutation signatures, and exact overlap tests."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
BINS = 128
MEMO_ENTRIES = 300_000
_BIN_SHIFT = np.uint64(57)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_EDGES = np.arange(BINS, dtype=np.uint64) << _BIN_SHIFT
#: For an empty bin, the order in which it looks at the others: the first that isn't empty lends its value.
_LOOKS = np.stack([np.random.default_rng(1000 + i).permutation(BINS) for i in range(BINS)])


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


def words_of(text: str | None) -> list[bytes]:
    """Runs of other than ASCII blanks, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_hashes(words: list[bytes], memo: WordHashes) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def shingle_set(hashes: np.ndarray, k: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of fewer words, the one of them all; of none, none."""
    n = len(hashes)
    if n == 0:
        return hashes
    k = min(k, n)
    total = hashes[: n - k + 1] * _ODD[0]
    for i in range(1, k):
        total = total + hashes[i : n - k + 1 + i] * _ODD[i]
    return np.unique(mixed(total + np.uint64(k)))


def one_permutation(shingles: np.ndarray) -> np.ndarray:
    """One minimum for each of ``BINS`` bins of the hash range; every empty bin borrows from a full one,
    which it finds by looks of its own (optimal densification)."""
    first = np.searchsorted(shingles, _EDGES)
    full = np.append(first[1:], len(shingles)) > first
    signature = shingles[np.minimum(first, len(shingles) - 1)]
    if not full.all():
        empty, lenders = np.flatnonzero(~full), np.flatnonzero(full)
        signature[empty] = signature[lenders[_LOOKS[np.ix_(empty, lenders)].argmin(1)]]
    return signature


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One signed 64-bit key a band; keys of different bands differ."""
    parts = signature[: bands * rows].reshape(bands, rows) * _ODD[:rows]
    return mixed(parts.sum(1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * _ODD[4]).view(np.int64)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if not len(a) or not len(b):
        return 0
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = common(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)
