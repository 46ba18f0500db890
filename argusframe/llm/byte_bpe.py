"""Byte-level BPE by longest-match backtracking.

A token sequence is the BPE encoding of a piece exactly when every two neighbouring tokens are the
encoding of their own concatenation. So the encoder walks the piece with the longest vocabulary match
that is compatible with its left neighbour, and steps back where none is. One Aho-Corasick pass finds
the longest match at each byte (bytes stand as Latin-1 characters), compatibility is memoised, and dead
positions are marked, so that no position is entered twice: time is linear in the piece.

Nulls: null text encodes as the empty text (no ids, the digest of nothing); a null doc_id stays null. Repeated
rows give repeated rows, and ties cannot occur. Very long texts: work and memory are linear in the text, one text
at a time. Empty tables give no rows. Extra columns of any name are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick

from pyspark.sql import DataFrame

from argusframe.llm.common import doc_texts, map_rows
from argusframe.llm.pieces import splitter

#: Entries of each memo; a full memo is emptied, which costs time but never changes a result.
MEMO_ENTRIES = 800_000
#: Pieces of more bytes than this are encoded anew each time.
MEMO_PIECE = 48


class Pieces(dict):
    """Piece of text -> its ids, filled on demand."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(self.encode(piece.encode("utf-8", "surrogatepass")))
        if len(piece) <= MEMO_PIECE:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[piece] = ids
        return ids


class ByteBPE:
    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        self.matcher = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
            self.matcher.add_word(token.decode("latin-1"), (len(token), rank))
        self.matcher.make_automaton()
        self.size_of = [len(token) for token in self.bytes_of]
        self.split = splitter(pattern)
        self.pieces = Pieces(self.encode_piece)
        self.compatible_memo: dict[tuple[int, int], bool] = {}
        self.shorter_memo: dict[int, int] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The definition itself: merge the adjacent pair of lowest rank until none is left. Only for short pieces."""
        rank_of, never = self.ranks.get, len(self.bytes_of)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [rank_of(a + b, never) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (lowest := min(pairs)) < never:
            at = pairs.index(lowest)
            parts[at : at + 2] = [self.bytes_of[lowest]]
            del pairs[at]
            if at:
                pairs[at - 1] = rank_of(parts[at - 1] + parts[at], never)
            if at < len(pairs):
                pairs[at] = rank_of(parts[at] + parts[at + 1], never)
        return [self.ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        if len(self.compatible_memo) >= MEMO_ENTRIES:
            self.compatible_memo.clear()
        known = self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        self.compatible_memo[left, right] = known
        return known

    def shorter(self, token: int) -> int:
        """The longest proper prefix of a token that is a token itself; -1 if it has none."""
        known = self.shorter_memo.get(token)
        if known is None:
            text = self.bytes_of[token]
            known = next((self.ranks[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.ranks), -1)
            self.shorter_memo[token] = known
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        if not piece:
            return []
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        longest = [-1] * len(piece)
        for end, (size, token) in self.matcher.iter(piece.decode("latin-1")):
            longest[end - size + 1] = token  # ends ascend, so the last one written is the longest
        alive, ids, at, memo = bytearray(b"\x01") * (len(piece) + 1), [], 0, self.compatible_memo
        token = longest[0]
        while at < len(piece):
            while token >= 0:
                end = at + self.size_of[token]
                if alive[end]:
                    if not ids:
                        break
                    fits = memo.get((ids[-1], token))
                    if fits or fits is None and self.compatible(ids[-1], token):
                        break
                token = self.shorter(token)
            if token >= 0:
                ids.append(token)
                at = end
                token = longest[at] if at < len(piece) else -1
            else:  # nothing goes on from here with this left neighbour
                alive[at] = 0
                last = ids.pop()
                at -= self.size_of[last]
                token = self.shorter(last)
        return ids

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.split(text))))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def codec_of(ranks_path: str, pattern: str) -> ByteBPE:
    """One for a worker process, whose tasks share its automaton and memos."""
    return ByteBPE(ranks_path, pattern)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (hex digest of the decimal ids joined by a space), decoded_sha256
    (hex digest of the bytes the ids decode to), for each row. A map over partitions: nothing is shuffled."""

    def make():
        codec = codec_of(ranks_path, pattern)
        decimal = [str(i) for i in range(len(codec.bytes_of))]

        def one(doc_id: int | None, text: str | None) -> Iterator[tuple]:
            ids = codec.encode(text or "")
            yield (
                doc_id,
                len(ids),
                hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest(),
                hashlib.sha256(codec.decode(ids)).hexdigest(),
            )

        return one

    return map_rows(doc_texts(docs), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
