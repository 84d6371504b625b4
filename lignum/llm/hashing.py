"""Vectorised hashing of substrings and words over Arrow string columns (numpy inside tasks).

A polynomial hash modulo 2**64 over prefix sums gives the hash of any substring
from two reads; byte values go through a fixed random table first and results
through a finaliser.  Equality of strings is judged by 128 bits where it decides
a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

U = np.uint64
M1, M2 = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def byte_table(mult: int) -> np.ndarray:
    return np.random.default_rng(mult & 0xFFFFFFFF).integers(1, 1 << 63, 256, dtype=U) | U(1)


def powers(mult: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``mult`` and of its inverse modulo 2**64, at least ``n``."""
    have = _POWERS.get(mult)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        out = []
        for m in (mult, pow(mult, -1, 1 << 64)):
            p = np.full(size, m, U)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _POWERS[mult] = (out[0], out[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


class Prefix:
    """Hashes of substrings ``[s, e)`` of a buffer."""

    def __init__(self, buf: np.ndarray, mult: int = M1):
        self.up, self.down = powers(mult, len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, U)
        v = byte_table(mult)[buf]
        v *= self.up[:len(buf)]
        np.cumsum(v, out=self.sums[1:])

    def of(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return mix((self.sums[e] - self.sums[s]) * self.down[s] + (e - s).astype(U) * U(0xA24BAED4963EE407))

    def fixed(self, k: int) -> np.ndarray:
        """Hash of every substring of length ``k``, by start."""
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, U)
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _valid, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0]:off[-1]], off - off[0]


def portions(batch: pa.RecordBatch, text: int, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about ``limit`` bytes; at least one row each."""
    if not batch.num_rows:
        return
    _buf, off = utf8(batch.column(text))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def word_spans(buf: np.ndarray, off: np.ndarray, breaks: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every word, and the number of words of each row; ``breaks`` flags the bytes between words."""
    inside = ~breaks[buf]
    rows = off[(off > 0) & (off < len(buf))]
    begin, end = inside.copy(), inside
    if len(buf):
        cut = np.zeros(len(buf), bool)
        cut[rows] = True
        begin[1:] &= ~inside[:-1] | cut[1:]
        stop = np.ones(len(buf), bool)
        stop[:-1] = ~inside[1:] | cut[1:]
        end = inside & stop
    b, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return b, e, np.diff(np.searchsorted(b, off))


def shingles(buf: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each row's word shingles in order, and how many each row has.

    A row of fewer words than ``width`` (and at least one) has one shingle of all its words.
    """
    b, e, n = word_spans(buf, off)
    w = Prefix(buf).of(b, e)
    first = np.concatenate(([0], np.cumsum(n)))[:-1]
    count = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    total = int(count.sum())
    begin = np.concatenate(([0], np.cumsum(count)))[:-1]
    at = np.arange(total) - np.repeat(begin, count) + np.repeat(first, count)
    size = np.repeat(np.minimum(n, width), count)
    h = np.full(total, 0x2545F4914F6CDD1D, U)
    for k in range(width):
        use = size > k
        more = w[np.minimum(at + k, max(len(w) - 1, 0))] if len(w) else np.zeros(total, U)
        h = np.where(use, mix(h * U(M2) + more), h)
    return h, count


BITMAP = 26


def bit_of(h: np.ndarray) -> np.ndarray:
    """Place of a hash in a bitmap."""
    return (mix(h) >> U(64 - BITMAP)).astype(np.int64)


def in_bitmap(bits: bytes, h: np.ndarray) -> np.ndarray:
    """Which hashes may be in the bitmap (all that are, and a few others)."""
    at = bit_of(h)
    return (np.frombuffer(bits, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def bitmap(hashes: DataFrame) -> bytes:
    """Bitmap of ``2 ** BITMAP`` bits (8 MB whatever the input) of a column of longs."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = np.unique(bit_of(batch.column(0).to_numpy().view(U)))
            yield pa.RecordBatch.from_arrays([pa.array(b >> 16), pa.array(b & 0xFFFF)], ["chunk", "bit"])

    def pack(key, table):
        bits = np.zeros(1 << 16, bool)
        bits[table.column("bit").to_numpy()] = True
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array(
            [np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    marked = hashes.mapInArrow(mark, "chunk long, bit long").distinct()
    out = bytearray(1 << BITMAP - 3)
    # a chunk has at most 65536 rows and packs to 8 kB
    for r in marked.groupBy("chunk").applyInArrow(pack, "chunk long, bits binary").collect():
        out[r["chunk"] << 13:(r["chunk"] + 1) << 13] = r["bits"]
    return bytes(out)
