"""Vectorised words, word hashes and window hashes over Arrow text, without a Python object per word.

A word is ``[^\\x20\\x09-\\x0D]+``. Those separators are single bytes in UTF-8, so
words are cut on the raw bytes. Hashes are 64-bit polynomials over randomised
byte values, taken from prefix sums modulo 2**64 and finished by a mixer.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 0xD1342543DE82EF95 | 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds)."""
    x = x ^ U((salt * 0xA0761D6478BD642F + 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTES = mix(np.arange(1, 257, dtype=U), 7)


class _Powers:
    """Powers of an odd base and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (np.concatenate([[U(1)], np.cumprod(np.full(n + n // 4, U(b)), dtype=U)]) for b in (self.base, self.inverse))
        return self.up, self.down


_AT, _IN = _Powers(_BASE), _Powers(_STEP)


@dataclass
class Words:
    data: np.ndarray  # bytes of all texts of the chunk
    text: np.ndarray  # byte offset of each text, one more at the end
    start: np.ndarray  # byte offsets of words
    end: np.ndarray
    first: np.ndarray  # index of each text's first word, one more at the end

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        up, down = _AT.upto(len(self.data) + 1)
        prefix = np.zeros(len(self.data) + 1, dtype=U)
        np.cumsum(_BYTES[self.data] * up[: len(self.data)], out=prefix[1:])
        raw = (prefix[self.end] - prefix[self.start]) * down[self.start]
        return mix(raw + (self.end - self.start).astype(U) * U(0x9FB21C651E98DF25))


def split(column: pa.Array) -> Words:
    """Words of a null-free string array."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, dtype=np.uint8)
    offsets = offsets - offsets[0]
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = ~_SPACE[data]
    left, right = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]  # a text's end also ends its word
    left[edge] |= inside[1:-1][edge]
    right[edge - 1] |= inside[1:-1][edge - 1]
    start = np.flatnonzero(left)
    return Words(data, offsets, start, np.flatnonzero(right) + 1, np.searchsorted(start, offsets))


def coded(w: Words) -> tuple[np.ndarray, pa.Array]:
    """Exact code of each word, and the distinct words by code, as bytes."""
    size = w.end - w.start
    offsets = np.concatenate([[0], np.cumsum(size)])
    inside = np.zeros(len(w.data) + 1, np.int8)
    inside[w.start] = 1
    np.add.at(inside, w.end, -1)
    body = w.data[np.cumsum(inside[:-1], dtype=np.int8) > 0]
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(body)]).dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), found.dictionary


def strong(w: Words) -> np.ndarray:
    """A hash of each word that isn't linear in its bytes: words made to collide under ``hashes`` differ here."""
    import xxhash

    codes, distinct = coded(w)
    return np.fromiter((xxhash.xxh64_intdigest(x, 0x5EED) for x in distinct.to_pylist()), U, len(distinct))[codes]


def windows(hashes: np.ndarray, length: int, salt: int) -> np.ndarray:
    """Hash of each run of ``length`` consecutive hashes; runs may cross texts, callers mask those."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    prefix, down = prefixes(hashes, salt)
    return mix((prefix[length:] - prefix[:-length]) * down[:n], salt)


def prefixes(hashes: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums from which the hash of any run [a, b) is mix((p[b] - p[a]) * down[a])."""
    up, down = _IN.upto(len(hashes) + 1)
    prefix = np.zeros(len(hashes) + 1, dtype=U)
    np.cumsum(mix(hashes, salt) * up[: len(hashes)], out=prefix[1:])
    return prefix, down


def valid_windows(first: np.ndarray, length: int) -> np.ndarray:
    """Start positions of windows that lie inside one text."""
    total = int(first[-1])
    ok = np.zeros(max(total, 0) + 1, dtype=np.int32)
    n = np.diff(first)
    full = n >= length
    np.add.at(ok, first[:-1][full], 1)
    np.add.at(ok, first[1:][full] - length + 1, -1)
    return np.flatnonzero(np.cumsum(ok[:total]) > 0)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out
