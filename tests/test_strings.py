"""Categories of printable strings, counted without trying every expression on every string."""

import random
import re

import numpy as np
import pyarrow as pa

from argusframe.functions import hashing, strings
from argusframe.sources import pe

PARTS = [
    b"http://a.b/c", b"ftp://x", b"1.2.3.4", b"999.1.1.1", b"256.10.3.44.5", b"::", b"fe80::1", b"a:b:c:d:e:f:1:2", b":12:ab ", b"ab:cd:ef:01:23:45", b"AB-CD-EF-01-23-45",
    b"13xyzabcdefghijkmnpqrstuvwxyzABCD", b" C:/", b"xC:/", b"KHEY_", b" HKCU ", b"xHKCU", b"onclick", b"click", b".CLICK", b"GeT /", b"Crypt", b"\n", b"\x80", b"\x00", b" word ",
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz01234567899/", *(k.encode() for k in strings.PATTERNS),
]


def test_counts_of_categories_follow_their_expressions():
    rng = random.Random(7)
    expressions = [re.compile(p) for p in strings.categories().values()]
    some = np.zeros(len(expressions), int)
    for _ in range(400):
        data = b"".join(rng.choice(PARTS) for _ in range(rng.randrange(40)))
        runs = re.findall(rb"[\x20-\x7f]{5,}", data)
        wanted = [sum(1 for r in runs if e.search(r.decode())) for e in expressions]
        assert strings.matching_counts(runs) == wanted
        some += np.array(wanted) > 0
    assert (some > 0).sum() >= len(expressions) - 12


def test_most_expressions_are_never_tried(monkeypatch):
    """A text that holds nothing of a category's plain text costs no search for it."""
    tried = []
    finders = [(a, p, h, lambda t, *at, n=n, s=s: tried.append(n) or s(t, *at)) if s else (a, p, h, s) for n, (a, p, h, s) in zip(strings.categories(), strings._finders(), strict=True)]
    monkeypatch.setattr(strings, "_finders", lambda: finders)
    assert not any(strings.matching_counts([b"nothing here of note, but words"] * 3))
    assert set(tried) <= {"btc_wallet"}


def test_features_are_handed_over_as_lists_with_nulls():
    vectors = [np.arange(3, dtype=np.float32), None, np.zeros(0, np.float32)]
    assert pe.feature_lists(vectors).equals(pa.array(vectors, pa.list_(pa.float32())))
    assert pe.feature_lists([None, None]).to_pylist() == [None, None] and pe.feature_lists([]).to_pylist() == []


def test_few_tokens_are_hashed_as_many_are():
    pairs = [(f"token{i}", float(i)) for i in range(hashing.FEW_TOKENS + 1)]
    one_by_one = sum(hashing.hashed([p], 50) for p in pairs)
    assert np.array_equal(hashing.hashed(pairs, 50), one_by_one)
