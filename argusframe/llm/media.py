"""Media columns: bytes kept as PNG images, read back, and hashed by their low frequencies.

A payload is a text's UTF-8 padded with spaces to a positive multiple of ``ROW`` bytes; it becomes an
8-bit RGB image of 64 pixels a row. The encoder picks a filter for each image; the decoder tests the
signature, every chunk's checksum and the sizes, and undoes all five filters in numpy.

Nulls: null text is the empty text, one row of spaces; a null doc_id stays null. Equal texts give equal files, and
repeated rows repeat. Very long texts are one image each, in memory linear in their length. Empty tables give no
rows. Extra columns of any name are not looked at.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from argusframe.llm.common import doc_texts, map_rows

# The signature, the bytes of a pixel and of a row, and the side of hashed thumbnails.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = 3
ROW = 192
SIDE = 32
LEVEL = 1


class BadImage(ValueError):
    """A file that is not a whole, unharmed image of the kind written here."""


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_payload(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(1, -(-len(raw) // ROW)) * ROW, b" ")


def write_png(payload: bytes) -> bytes:
    """An RGB image whose samples are the payload, rows of ``ROW`` bytes. Rows that repeat the one above
    (long runs, tables) shrink under the filter Up; other text does best unfiltered."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    filtered = np.zeros((len(rows), ROW + 1), np.uint8)
    filtered[:, 1:] = rows
    same = np.flatnonzero((rows[1:] == rows[:-1]).all(1)) + 1
    filtered[same, 0] = 2
    filtered[same, 1:] = 0
    head = struct.pack(">IIBBBBB", ROW // CHANNELS, len(rows), 8, 2, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(filtered.tobytes(), LEVEL)) + chunk(b"IEND", b"")


def unfilter(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Undo the filters of rows, top down. Runs of None and Sub rows are undone together."""
    out = rows.copy()
    if (kinds > 4).any():
        raise BadImage("unknown filter")
    sub = np.flatnonzero(kinds == 1)
    if len(sub):
        out[sub] = np.cumsum(rows[sub].reshape(len(sub), -1, CHANNELS), axis=1, dtype=np.uint8).reshape(len(sub), -1)
    for y in np.flatnonzero(kinds > 1).tolist():
        above = out[y - 1] if y else np.zeros(rows.shape[1], np.uint8)
        if kinds[y] == 2:
            out[y] = rows[y] + above
            continue
        line, up = rows[y].reshape(-1, CHANNELS).astype(np.int16), above.reshape(-1, CHANNELS).astype(np.int16)
        left = corner = np.zeros(CHANNELS, np.int16)
        for x in range(len(line)):
            if kinds[y] == 3:
                guess = (left + up[x]) >> 1
            else:
                base = left + up[x] - corner
                a, b, c = abs(base - left), abs(base - up[x]), abs(base - corner)
                guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up[x], corner))
            left, corner = (line[x] + guess) & 255, up[x]
            line[x] = left
        out[y] = line.reshape(-1)
    return out


def read_png(data: bytes) -> bytes:
    """The samples of an 8-bit RGB image, after all its checks."""
    if data[:8] != SIGNATURE:
        raise BadImage("no signature")
    at, head, body, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise BadImage("cut short")
        size, kind = struct.unpack_from(">I4s", data, at)
        if at + 12 + size > len(data):
            raise BadImage("cut short")
        part = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + part) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise BadImage(f"checksum of {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        ended = kind == b"IEND"
        at += 12 + size
    if head is None or not ended or head[2:] != (8, 2, 0, 0, 0):
        raise BadImage("not a whole 8-bit RGB image")
    width, height = head[:2]
    try:
        raw = zlib.decompress(b"".join(body))
    except zlib.error as error:
        raise BadImage(str(error)) from error
    if len(raw) != height * (width * CHANNELS + 1):
        raise BadImage("sizes differ")
    rows = np.frombuffer(raw, np.uint8).reshape(height, -1)
    return unfilter(rows[:, 0], rows[:, 1:]).tobytes()


def cosine_basis(size: int, kept: int) -> np.ndarray:
    k, x = np.arange(kept)[:, None], np.arange(size)[None, :]
    return np.cos(np.pi * (2 * x + 1) * k / (2 * size))


BASIS = cosine_basis(SIDE, 9)


def spectrum_hash(samples: bytes) -> str:
    """64 bits in hex: the image, averaged to 32 x 32 grey cells (cells of less than one sample repeat it),
    its 8 x 8 lowest cosine frequencies but the constant ones, each above the median or not."""
    grey = np.frombuffer(samples, np.uint8).reshape(-1, ROW // CHANNELS, CHANNELS).mean(2)
    tall = np.arange(SIDE) * len(grey) // SIDE
    cells = np.add.reduceat(grey, np.unique(tall), axis=0)
    counts = np.diff(np.append(np.unique(tall), len(grey)))
    cells = (cells / counts[:, None])[np.unique(tall, return_inverse=True)[1]]
    cells = cells.reshape(SIDE, SIDE, -1).mean(2)
    low = (BASIS @ cells @ BASIS.T)[1:9, 1:9].round(6)
    return np.packbits((low > np.median(low)).ravel()).tobytes().hex()


def media_documents(docs: DataFrame, with_media: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, payload_bytes, payload_sha256 and tail_crc32 of the samples read back,
    media_bytes, media_sha256 of the file, feature (hex of ``spectrum_hash``), and with ``with_media`` the
    file and its 8-byte hash as binary columns."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def make():
        def one(doc_id: int | None, text: str | None) -> Iterator[tuple]:
            stored = write_png(to_payload(text))
            back = read_png(stored)
            mark = spectrum_hash(back)
            row = (
                doc_id, len((text or "").encode("utf-8", "surrogatepass")), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored),
                hashlib.sha256(stored).hexdigest(), mark
            )
            yield (*row, stored, bytes.fromhex(mark)) if with_media else row

        return one

    return map_rows(doc_texts(docs), make, schema + ", media binary, media_hash binary" * with_media)
