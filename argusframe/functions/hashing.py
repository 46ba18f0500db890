"""Signed feature hashing: 32-bit MurmurHash3 of a token picks a bucket and a sign."""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

import numpy as np

_FIRST, _SECOND = np.uint32(0xCC9E2D51), np.uint32(0x1B873593)


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint32(by) | x >> np.uint32(32 - by)


def murmur3_32_of(items: list[bytes], seed: int = 0) -> np.ndarray:
    """MurmurHash3, x86, 32 bits, of each item, as signed integers. Items of one length are hashed together, four
    bytes of all at a time."""
    out = np.zeros(len(items), np.uint32)
    lengths = np.fromiter(map(len, items), np.int64, len(items))
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        block = np.zeros((len(at), (n + 3) // 4 * 4), np.uint8)
        block[:, :n] = np.frombuffer(b"".join(items[i] for i in at.tolist()), np.uint8).reshape(len(at), n)
        words = block.view("<u4")
        h = np.full(len(at), seed, np.uint32)
        for j in range(n // 4):
            h = _turned(h ^ _turned(words[:, j] * _FIRST, 15) * _SECOND, 13) * np.uint32(5) + np.uint32(0xE6546B64)
        if n % 4:
            h = h ^ _turned(words[:, -1] * _FIRST, 15) * _SECOND
        h = h ^ np.uint32(n & 0xFFFFFFFF)
        h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
        h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
        out[at] = h ^ h >> np.uint32(16)
    return out.view(np.int32)


def murmur3_32(data: bytes, seed: int = 0) -> int:
    return int(murmur3_32_of([data], seed)[0])


#: Up to so many tokens are hashed one by one and remembered: section names and libraries recur from file to file.
FEW_TOKENS = 16


@lru_cache(maxsize=1 << 16)
def _token_hash(token: str) -> int:
    return murmur3_32(token.encode("utf-8", "surrogatepass"))


def hashed(pairs: Iterable[tuple[str, float]], buckets: int, alternate_sign: bool = True) -> np.ndarray:
    """Sum of weights by bucket; half of the tokens count negatively if signs alternate."""
    found = list(pairs)
    if not found:
        return np.zeros(buckets)
    if len(found) <= FEW_TOKENS:
        out = np.zeros(buckets)
        for token, weight in found:
            h = _token_hash(token)
            out[abs(h) % buckets] += -weight if alternate_sign and h < 0 else weight
        return out
    h = murmur3_32_of([token.encode("utf-8", "surrogatepass") for token, _ in found]).astype(np.int64)
    weights = np.array([weight for _, weight in found], float)
    if alternate_sign:
        weights = np.where(h < 0, -weights, weights)
    return np.bincount(np.abs(h) % buckets, weights, buckets)
