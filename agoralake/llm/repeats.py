"""Repeated word sequences, found level by level.

A window of ``n`` words is removed where the same words also start in a document
with a smaller id.  Levels double the window length from ``START`` words up to ``n``
(13: 4, 8, then 13); shorter windows are nearly all repeated, so they would tell
nothing apart.  Only windows whose two parts, of the length before, both occur in
more than one document are extended, so the long windows of unrepeated text are
never shuffled, and a chunk without candidates sends nothing more.  Doubling ends
at ``n``: longer windows can remove nothing more.

One level, in Spark terms:

* Documents are dealt once to chunks by a hash of the id; every level reads the
  same exchange.  A chunk reduces its windows to distinct hashes, each with the
  smallest document of the chunk (so a passage in a third of all documents is one
  entry in each chunk), and sends each bucket of the hash range one compressed
  block of sorted hashes.
* A bucket finds the hashes that occur in more than one document and answers each
  chunk with one bit for each of its entries, in the order they were sent.

Levels before the last send 48 bits of a hash, since they only filter; the last one
the 64 bits of it, 64 more that come from a second, independent hash of the words,
and the smallest document, and its bit says that an earlier document in another
chunk has the window.  Bits of former levels travel with the blocks, so a
chunk can always rebuild its candidates.

Null texts have no words.  A null id counts as larger than all others; rows with
equal ids are one document to each other's windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import text_pairs
from .words import SPACED, Words, blocks, covered, mix2

_U = np.uint64
_NULL = np.iinfo(np.int64).max
#: Words in the windows of the first level.
START = 4
#: Text in a chunk and in a bucket of the hash range.  Each chunk sends each bucket one block, so beyond MOST_CHUNKS
#: chunks they grow, up to LARGEST_CHUNK of text, whose words and hashes a worker holds at a time.
CHUNK_BYTES, BUCKET_BYTES, MOST_CHUNKS, LARGEST_CHUNK = 4 << 20, 16 << 20, 500_000, 16 << 20

_SENT = "chunk int, bucket int, history binary, size int, hashes binary, checks binary, docs binary, several binary"
_REPLY = "chunk int, bucket int, history binary"
_KEPT = "doc_id bigint, n_words bigint, n_removed bigint, kept string"


def levels(n: int) -> list[int]:
    """Window lengths: START, each twice the one before, and n at last."""
    out = [min(n, START)]
    while out[-1] < n:
        out.append(min(n, 2 * out[-1]))
    return out


def squeeze(values: np.ndarray) -> bytes:
    """64-bit numbers by byte planes, without the planes above the largest number, compressed."""
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)
    used = max(1, -(-int(values.max()).bit_length() // 8)) if len(values) else 1
    return bytes([used]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes[:, :used].T).tobytes())


def unsqueeze(data: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], size)
    out = np.zeros((size, 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.reshape(-1).view("<u8").astype(_U)


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(data: bytes, size: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=size).astype(bool)


def _histories(history: bytes) -> list[bytes]:
    out = []
    while history:
        n = int.from_bytes(history[:4], "little")
        out.append(history[4 : 4 + n])
        history = history[4 + n :]
    return out


class _Level:
    """The windows of one length in a chunk: distinct hashes with their documents."""

    def __init__(self, hashes: list[np.ndarray], checks: list[np.ndarray] | None, docs: list[np.ndarray], bits: int):
        self.of = np.cumsum([0, *[len(h) for h in hashes]])
        h = np.concatenate(hashes) >> _U(64 - bits)
        d = np.concatenate(docs)
        c = None if checks is None else np.concatenate(checks)
        order = np.lexsort((d, h)) if c is None else np.lexsort((d, c, h))
        sh = h[order]
        new = np.ones(len(h), bool)
        new[1:] = sh[1:] != sh[:-1]
        if c is not None:
            new[1:] |= c[order][1:] != c[order][:-1]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(h)) - 1
        self.inverse = np.empty(len(h), np.int64)
        self.inverse[order] = np.cumsum(new) - 1
        self.hash, self.check, self.least = sh[first], None if c is None else c[order][first], d[order][first]
        self.several = d[order][last] != self.least if len(h) else new
        self.bits, self.doc = bits, d

    def cuts(self, buckets: int) -> np.ndarray:
        """Where each bucket of the hash range begins among the sorted hashes."""
        edges = [(k << self.bits) // buckets for k in range(buckets)]
        return np.append(np.searchsorted(self.hash, np.array(edges, _U)), len(self.hash))


class _Chunk:
    """The documents of one chunk, and what former levels have told about them."""

    def __init__(self, rows: pa.Table, n: int, buckets: int):
        self.n, self.buckets = n, buckets
        self.parts: list[Words] = []
        self.docs: list[np.ndarray] = []
        self.ids: list[list[int | None]] = []
        for batch in rows.combine_chunks().to_batches():
            for part in blocks(batch, "text"):
                ids = part.column(part.schema.get_field_index("doc_id")).to_pylist()
                words = Words(part.column(part.schema.get_field_index("text")), SPACED)
                self.parts.append(words)
                self.ids.append(ids)
                self.docs.append(np.repeat(np.array([_NULL if i is None else i for i in ids], np.int64), words.counts))

    def first(self) -> list[np.ndarray]:
        size = levels(self.n)[0]
        return [np.flatnonzero(w.room() >= size) for w in self.parts]

    def level(self, k: int, at: list[np.ndarray]) -> _Level:
        size, last = levels(self.n)[k], k == len(levels(self.n)) - 1
        hashes = [w.window_hash(a, size) for w, a in zip(self.parts, at)]
        checks = None
        if last:  # a second sum over the words, so that equal entries have equal words
            checks = [self._check(w, a, size) for w, a in zip(self.parts, at)]
        return _Level(hashes, checks, [d[a] for d, a in zip(self.docs, at)], 64 if last else 48)

    @staticmethod
    def _check(words: Words, at: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(len(at), _U)
        if len(at):
            other = words.second()
            for i in range(size):
                out = mix2(out * _U(0x2545F4914F6CDD1D) + other[at + i])
        return out

    def replay(self, replies: dict[int, list[bytes]], upto: int) -> tuple[list[np.ndarray], _Level | None, np.ndarray | None]:
        """Candidates of level upto; the level before it and its bits."""
        at, level, told = self.first(), None, None
        sizes = levels(self.n)
        for k in range(upto):
            level = self.level(k, at)
            cuts = level.cuts(self.buckets)
            told = np.zeros(len(level.hash), bool)
            for b, history in replies.items():
                told[cuts[b] : cuts[b + 1]] = _flags(history[k], int(cuts[b + 1] - cuts[b]))
            if k == len(sizes) - 1:
                break
            step, repeated = sizes[k + 1] - sizes[k], told[level.inverse]
            for i, words in enumerate(self.parts):
                live = np.zeros(len(words) + step, bool)
                live[at[i][repeated[level.of[i] : level.of[i + 1]]]] = True
                at[i] = np.flatnonzero(live[: len(words)] & live[step:] & (words.room() >= sizes[k + 1]))
        return at, level, told

    def send(self, k: int, at: list[np.ndarray], chunk: int, replies: dict[int, list[bytes]]) -> pa.Table:
        level = self.level(k, at)
        cuts = level.cuts(self.buckets)
        rows: list[tuple] = []
        for b in range(self.buckets):
            lo, hi = int(cuts[b]), int(cuts[b + 1])
            past = b"".join([len(x).to_bytes(4, "little") + x for x in replies.get(b, [])])
            if hi == lo and not past:
                continue
            own = level.hash[lo:hi]
            checks = docs = None
            if level.check is not None:
                checks, docs = level.check[lo:hi].astype("<u8").tobytes(), squeeze((level.least[lo:hi] ^ np.int64(-(1 << 63))).view(_U) if (level.least[lo:hi] < 0).any() else level.least[lo:hi].view(_U))
                docs = bytes([int((level.least[lo:hi] < 0).any())]) + docs
            rows.append((chunk, b, past, hi - lo, squeeze(np.diff(own, prepend=_U(0))), checks, docs, _bits(level.several[lo:hi])))
        names = ["chunk", "bucket", "history", "size", "hashes", "checks", "docs", "several"]
        types = [pa.int32(), pa.int32(), pa.binary(), pa.int32(), *[pa.binary()] * 4]
        return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(names, types))})

    def kept(self, replies: dict[int, list[bytes]]) -> Iterator[pa.Table]:
        sizes = levels(self.n)
        at, level, told = self.replay(replies, len(sizes))
        # an earlier document in another chunk, or in this one
        gone = told[level.inverse] | (level.doc > level.least[level.inverse])
        for i, words in enumerate(self.parts):
            mine = at[i][gone[level.of[i] : level.of[i + 1]]]
            removed = covered(mine, self.n, len(words))
            count = np.bincount(words.doc()[removed], minlength=len(self.ids[i]))
            yield pa.table({"doc_id": pa.array(self.ids[i], pa.int64()), "n_words": pa.array(words.counts, pa.int64()), "n_removed": pa.array(count, pa.int64()), "kept": joined(words, ~removed)})


def joined(words: Words, chosen: np.ndarray) -> pa.Array:
    """The chosen words of each document, joined by single spaces."""
    n, at = len(words.data), np.flatnonzero(chosen)
    doc = words.doc()[at]
    change = np.zeros(n + 1, np.int8)
    change[words.start[at]] += 1
    change[words.end[at]] -= 1  # words end at different bytes
    mask = np.cumsum(change[:n], dtype=np.int8).astype(bool)
    data = words.data
    if len(at):
        gaps = words.end[at[:-1][doc[1:] == doc[:-1]]]  # a later word of the document follows, so a byte does
        data = data.copy()
        data[gaps] = 0x20
        mask[gaps] = True
    total = np.concatenate([[0], np.cumsum(mask)])
    return pa.LargeStringArray.from_buffers(len(words.at) - 1, pa.py_buffer(total[words.at].astype(np.int64).tobytes()), pa.py_buffer(data[mask].tobytes())).cast(pa.string())


def _replies(table: pa.Table) -> dict[int, list[bytes]]:
    return {b: _histories(h) for b, h in zip(table.column("bucket").to_pylist(), table.column("history").to_pylist())}


def _first(n: int, buckets: int):
    def run(key, rows):
        chunk = _Chunk(rows, n, buckets)
        return chunk.send(0, chunk.first(), key[0].as_py(), {})

    return run


def _next(n: int, buckets: int, k: int):
    def run(key, rows, replies):
        chunk, told = _Chunk(rows, n, buckets), _replies(replies)
        return chunk.send(k, chunk.replay(told, k)[0], key[0].as_py(), told)

    return run


def _last(n: int, buckets: int):
    def run(key, rows, replies):
        return pa.concat_tables(list(_Chunk(rows, n, buckets).kept(_replies(replies))))

    return run


def _answer(last: bool):
    def run(key, sent):
        sizes = np.array(sent.column("size").to_pylist(), np.int64)
        of = np.append(0, np.cumsum(sizes))
        rows = {name: sent.column(name).to_pylist() for name in ("chunk", "bucket", "history", "hashes", "checks", "docs", "several")}
        h = np.concatenate([np.cumsum(unsqueeze(x, s), dtype=_U) for x, s in zip(rows["hashes"], sizes.tolist())])
        several = np.concatenate([_flags(x, s) for x, s in zip(rows["several"], sizes.tolist())])
        if last:
            c = np.concatenate([np.frombuffer(x, "<u8") for x in rows["checks"]])
            docs = np.concatenate([_signed(x, s) for x, s in zip(rows["docs"], sizes.tolist())])
            order = np.lexsort((docs, c, h))
        else:
            order = np.argsort(h, kind="stable")
        new = np.ones(len(h), bool)
        new[1:] = h[order][1:] != h[order][:-1]
        if last:
            new[1:] |= c[order][1:] != c[order][:-1]
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        bit = np.zeros(len(h), bool)
        if last:
            bit[order] = docs[order] > docs[order][first][group]
        elif len(h):
            runs = np.diff(np.append(first, len(h)))
            bit[order] = ((runs > 1) | np.maximum.reduceat(several[order], first))[group]
        out = []
        for i, past in enumerate(rows["history"]):
            own = _bits(bit[of[i] : of[i + 1]])
            out.append(past + len(own).to_bytes(4, "little") + own)
        return pa.table({"chunk": pa.array(rows["chunk"], pa.int32()), "bucket": pa.array(rows["bucket"], pa.int32()), "history": pa.array(out, pa.binary())})

    return run


def _signed(data: bytes, size: int) -> np.ndarray:
    out = unsqueeze(data[1:], size).view(np.int64)
    return out ^ np.int64(-(1 << 63)) if data[0] else out


def remove_repeats(docs: DataFrame, *, n: int = 13, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed and kept (the words left, joined by single spaces)."""
    pairs = text_pairs(docs, id_col, text_col)
    size = pairs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, buckets = max(min(MOST_CHUNKS, 1 + size // chunk_bytes), size // LARGEST_CHUNK), 1 + size // bucket_bytes
    chunk = F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text"))), F.lit(chunks)).cast("int")
    dealt = pairs.withColumn("chunk", chunk)
    steps = len(levels(n))
    sent = dealt.groupBy("chunk").applyInArrow(_first(n, buckets), _SENT)
    for k in range(steps):
        if k:
            sent = dealt.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_next(n, buckets, k), _SENT)
        replies = sent.groupBy("bucket").applyInArrow(_answer(k == steps - 1), _REPLY)
    return dealt.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_last(n, buckets), _KEPT)
