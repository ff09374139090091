"""Vectorised word splitting and hashing for Arrow batches of text.

Everything here works on the UTF-8 bytes of whole texts inside one task: words
are found with byte masks and hashed eight bytes at a time, each step through a
bijective finaliser; prefix sums over the hashes of words make the hash of any run
of words a constant number of numpy operations.  A second hash of words, with other
constants, is there to confirm what the first one finds.  No function keeps more than
one block (about a MB of text, or one longer document) in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

_U = np.uint64
_WORD_BASE = 0xD1342543DE82EF95 | 1
#: Bytes up to which words are hashed together; longer ones one by one.
_TOGETHER = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (new array)."""
    x = x ^ (x >> _U(33))
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def mix2(x: np.ndarray) -> np.ndarray:
    """Another bijective finaliser (new array)."""
    x = x + _U(0x9E3779B97F4A7C15)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], _U)


def hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray, second: bool = False) -> np.ndarray:
    """64 bits for each byte range; the second hash shares no constants with the first."""
    final = mix2 if second else mix
    size = end - start
    padded = np.concatenate([data, np.zeros(_TOGETHER, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))  # the eight bytes from each byte on
    out = final((eight[start] & _MASKS[np.minimum(size, 8)]) ^ (size.view(_U) * _U(0xA24BAED4963EE407)))
    for k in range(8, _TOGETHER, 8):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        out[more] = final((out[more] * _U(0xD6E8FEB86659FD93)) ^ (eight[start[more] + k] & _MASKS[np.minimum(size[more] - k, 8)]))
    raw = data.data
    for i in np.flatnonzero(size > _TOGETHER).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[start[i] : end[i]], digest_size=8, key=b"second" if second else b"").digest(), "little")
    return out


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**k and base**-k modulo 2**64 for k < n (n: a power of two)."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, dtype=_U)
        p[0] = 1
        out.append(np.cumprod(p, dtype=_U))
    return out[0], out[1]


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(base, 1 << max(16, int(n - 1).bit_length()))


def _mask(members) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(members)] = True
    return out


#: The bytes of words under ``[^\x20\x09-\x0D]+``.
SPACED = ~_mask([0x20, *range(0x09, 0x0E)])
#: The bytes of words under ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
ALNUM = _mask([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: The bytes of terms under ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+`` after lower-casing A-Z.
LETTERS = _mask([*range(0x61, 0x7B), *range(0x80, 0x100)])
#: A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column and n + 1 offsets into them; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64, count=n + 1, offset=8 * column.offset)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(batch: pa.RecordBatch, text: str, max_bytes: int = BLOCK_BYTES, max_rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of about max_bytes of text (a longer row is a slice of its own) and at most max_rows."""
    column = batch.column(batch.schema.get_field_index(text))
    sizes = np.diff(utf8(column)[1])
    first = 0
    while first < len(sizes):
        ends = np.cumsum(sizes[first:])
        n = max(1, int(np.searchsorted(ends, max_bytes, side="right")))
        n = min(n, max_rows or n)
        yield batch.slice(first, n)
        first += n


class Words:
    """The words of a block of documents.

    data: the (possibly lower-cased) bytes; start, end: byte range of each word;
    hash: 64 bits for each word; first: word range of each document (n + 1 offsets).
    """

    def __init__(self, column, members: np.ndarray = SPACED, lower: bool = False):
        raw, self.at = utf8(column)
        self.data = LOWER[raw] if lower else raw
        inside = members[self.data]
        n = len(inside)
        edge = np.zeros(n + 1, dtype=bool)
        edge[self.at] = True  # words end where documents do
        before = np.zeros(n, dtype=bool)
        before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.zeros(n, dtype=bool)
        after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, self.at)
        # an empty document at the edge shares its offset with the next one, and so has no word
        self.hash = hashed(self.data, self.start, self.end)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def told(self) -> pa.DictionaryArray:
        """The words themselves (binary), each different one once in the dictionary."""
        size = self.end - self.start
        change = np.zeros(len(self.data) + 1, np.int8)
        change[self.start] += 1
        change[self.end] -= 1
        only = self.data[np.cumsum(change[:-1], dtype=np.int8).astype(bool)]
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(only.tobytes())])
        return words.dictionary_encode()

    def second(self) -> np.ndarray:
        """An independent hash of each word."""
        return hashed(self.data, self.start, self.end, second=True)

    def doc(self) -> np.ndarray:
        """The document (position in the block) of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each run of n words that lies within one document."""
        at = np.flatnonzero(self.room() >= n)
        return at, self.window_hash(at, n)

    def room(self) -> np.ndarray:
        """Words from each word to the end of its document, itself included."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self))

    def window_hash(self, at: np.ndarray, n: int) -> np.ndarray:
        """Hash of the n words from each word in at on."""
        total = getattr(self, "_total", None)
        if total is None:
            total = np.empty(len(self) + 1, dtype=_U)
            total[0] = 0
            if len(self):
                np.cumsum(self.hash * powers(_WORD_BASE, len(self))[0][: len(self)], out=total[1:])
            self._total = total
        if not len(at):
            return np.zeros(0, _U)
        return mix((total[at + n] - total[at]) * powers(_WORD_BASE, len(self))[1][at])

    def text(self, words: np.ndarray) -> bytes:
        """Some words of one document, joined by single spaces."""
        data = self.data
        return b" ".join([data[s:e].tobytes() for s, e in zip(self.start[words].tolist(), self.end[words].tolist())])


def covered(at: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of size words lie in a window of n words that starts at a word in at."""
    change = np.zeros(size + 1, dtype=np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, np.minimum(at + n, size), -1)
    return np.cumsum(change[:-1]) > 0
