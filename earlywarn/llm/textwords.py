"""Words of Arrow string columns as numpy arrays, and their fingerprints.

A text is read as UTF-8 bytes: every separator is an ASCII byte, and all bytes
of other characters belong to words, so byte runs are exactly the words.
Fingerprints are prefix polynomials modulo 2^64: with S the running sum of
value[i] * base^i, the polynomial of any span is (S[end] - S[start]) /
base^start, so all spans of one length cost one subtraction each.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 2 << 20  # text bytes handled at once (one text at least)
SPAN_BYTES = (1 << 18) - 1  # bytes under one run of powers (one word at least)
SEEDS = (11, 23)  # of the two independent families of fingerprints


def byte_set(*parts: tuple[int, int]) -> np.ndarray:
    """A table over bytes that is true within the given inclusive ranges."""
    out = np.zeros(256, dtype=bool)
    for lo, hi in parts:
        out[lo : hi + 1] = True
    return out


BLANK = byte_set((0x20, 0x20), (0x09, 0x0D))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


@dataclass
class Words:
    """The words of some texts: bytes ``data[start[i]:end[i]]`` of row
    ``doc[i]``; row r holds the words ``first[r]`` to ``first[r + 1]``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    def text(self, i: int, j: int) -> bytes:
        """Words i to j - 1, joined by one blank."""
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.start[i:j], self.end[i:j]))

    def array(self) -> pa.Array:
        """The words as a binary column, without a Python object per word."""
        size = self.end - self.start
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        at = np.repeat(self.start - offsets[:-1], size) + np.arange(offsets[-1])
        return pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(self.data[at])]
        )


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column of at most ``limit`` bytes, one row at least."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    done = np.cumsum(sizes)
    begin = 0
    while begin < len(column):
        past = int(done[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(done, past + limit, side="right")))
        yield begin, end
        begin = end


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column in a row, and where each text begins; null texts are empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8)[offsets[0] : offsets[-1]] if body else np.zeros(0, dtype=np.uint8)
    return data, offsets - offsets[0]


def split(column: pa.Array, gap: np.ndarray, lower: bool = False) -> Words:
    """Words of a string column between bytes of ``gap``; null texts have none."""
    data, offsets = text_bytes(column)
    if lower:
        data = LOWER[data]
    outside = gap[data]
    inside = ~outside
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= outside[:-1]
    ends[:-1] &= outside[1:]
    held = offsets[1:] > offsets[:-1]
    edge = offsets[:-1][held]
    begins[edge] = inside[edge]
    edge = offsets[1:][held] - 1
    ends[edge] = inside[edge]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets)
    return Words(data, start, end, np.repeat(np.arange(len(offsets) - 1), np.diff(first)), first)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer, so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@functools.lru_cache(maxsize=8)
def _family(seed: int) -> tuple[int, np.ndarray]:
    """An odd base and a value for every byte."""
    rng = np.random.default_rng(seed)
    return int(rng.integers(1 << 62, 1 << 63)) * 2 + 1, rng.integers(1, 1 << 63, size=256, dtype=np.uint64)


_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        step = np.full(size, base, dtype=np.uint64)
        step[0] = 1
        have = np.multiply.accumulate(step)
        if size <= 1 << 20:
            _powers[base] = have
    return have[:n]


def _spans(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    up = _powers_of(base, len(values) + 1)
    down = _powers_of(pow(base, -1, 1 << 64), len(values) + 1)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values * up[:-1], dtype=np.uint64)])
    return (sums[end] - sums[start]) * down[start]


def word_prints(words: Words, seed: int) -> np.ndarray:
    """A 64-bit fingerprint of every word's bytes."""
    base, value = _family(seed)
    out = np.empty(len(words.start), dtype=np.uint64)
    i = 0
    while i < len(out):
        low = int(words.start[i])
        j = max(i + 1, int(np.searchsorted(words.end, low + SPAN_BYTES, side="right")))
        part = value[words.data[low : int(words.end[j - 1])]]
        out[i:j] = _spans(part, words.start[i:j] - low, words.end[i:j] - low, base)
        i = j
    return mixed(out)


def gram_prints(prints: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Polynomials of all runs of ``n`` words, by the place of the first."""
    if len(prints) < n:
        return np.zeros(0, dtype=np.uint64)
    base = _family(seed + 1000)[0]
    at = np.arange(len(prints) - n + 1)
    return mixed(_spans(prints, at, at + n, base) + np.uint64(n))


def text_hash64(value: str) -> int:
    """A 64-bit hash of a short string, the same in every process."""
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "little")


def key_filter(keys: DataFrame, key: Column, bits: int) -> np.ndarray:
    """A bitmap of 2^bits places in which the place (the leading bits) of every
    key is set.  Its size is fixed, whatever the number of keys."""
    place = F.shiftrightunsigned(key, 64 - bits)
    rows = keys.select(F.shiftright(place, 6).alias("w"), place.bitwiseAND(F.lit(63)).cast("int").alias("b"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b"))
    got = rows.groupBy("w").agg(F.bit_or(one).alias("x")).toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    out[got["w"].to_numpy()] = got["x"].to_numpy().astype(np.int64).view(np.uint64)
    return out


def in_filter(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the place of each key (uint64) is set."""
    bits = (len(bitmap) * 64).bit_length() - 1
    place = keys >> np.uint64(64 - bits)
    return (bitmap[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
