"""Token ids in fixed-width bit-packed files.

A file is a run of blocks and a footer; every block and the footer end with one
newline byte, which is part of the format.  All numbers are little-endian.

block   4 bytes "TPB1", u8 bits per id, 3 zero bytes, u32 documents, u64 ids,
        i64 document ids, u8 flags (1: the document id is null),
        u64 offsets (documents + 1) of the first id of each document in the block,
        the ids: bits each, most significant bit first, padded to a byte
footer  u64 byte offset of each block, u64 ids before each block in the file,
        u32 blocks, 4 bytes "TPF1"

Id k of a block lies at bit k * bits of its payload, so a reader unpacks any
range with a few vectorised numpy operations and reaches any document over
footer, block offsets and document offsets.

Documents are dealt by ranges of doc_id (Spark samples the bounds), as many as hold
about FILE_BYTES of text each, sorted within a range, encoded where they land and
written by Spark's own writer, so files work on every file system that Spark reaches.
File names ascend with doc_id.  A null text is empty: it holds the end id alone.
Equal doc_ids are neighbours, ordered by a hash of the text, so ranges split them too.
An empty table gives files without blocks.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import checkpoint, checkpoint_dir, text_pairs
from .units import UnitTable
from .words import blocks, utf8

MAGIC, FOOTER = b"TPB1", b"TPF1"
_HEAD = np.dtype([("magic", "S4"), ("bits", "u1"), ("zero", "u1", 3), ("docs", "<u4"), ("ids", "<u8")])


#: Text in a file, of which a reader holds the packed ids at a time.
FILE_BYTES = 16 << 20


def bits_for(vocabulary: int) -> int:
    """The least width that holds every id below vocabulary."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids (unsigned, below 2**bits) as consecutive bits-wide fields."""
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    shifts = np.arange(bits - 1, -1, -1, dtype=np.uint32)
    out = []
    for i in range(0, len(ids), 1 << 16):  # a multiple of eight ids fills whole bytes
        out.append(np.packbits(((ids[i : i + (1 << 16), None].astype(np.uint32) >> shifts) & 1).astype(np.uint8)).tobytes())
    return b"".join(out)


def unpack(data: bytes | memoryview, bits: int, first: int, count: int) -> np.ndarray:
    """Ids first to first + count of a packed payload."""
    raw = np.frombuffer(data, dtype=np.uint8)
    if bits in (8, 16, 32):
        n = bits // 8
        return raw[first * n : (first + count) * n].view(f">u{n}").astype(np.uint32)
    at = (np.arange(count, dtype=np.int64) + first) * bits
    byte, shift = at >> 3, at & 7
    padded = np.concatenate([raw[: int(byte[-1]) + 5] if count else raw[:0], np.zeros(8, np.uint8)])
    word = np.zeros(count, dtype=np.uint64)
    for k in range(5):
        word = (word << np.uint64(8)) | padded[byte + k]
    return ((word >> (40 - bits - shift).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def block_bytes(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    head = np.zeros(1, _HEAD)
    head["magic"], head["bits"], head["docs"], head["ids"] = MAGIC, bits, len(doc_ids), len(ids)
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype("<u8")
    known = np.array([0 if d is None else d for d in doc_ids], "<i8")
    flags = np.array([d is None for d in doc_ids], np.uint8)
    return b"".join([head.tobytes(), known.tobytes(), flags.tobytes(), offsets.tobytes(), pack(ids, bits)])


def footer_bytes(offsets: list[int], ids_before: list[int]) -> bytes:
    return np.array(offsets, "<u8").tobytes() + np.array(ids_before, "<u8").tobytes() + np.uint32(len(offsets)).tobytes() + FOOTER


class TokenFile:
    """Random access to the bytes of one file."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        if bytes(self.data[-5:]) != FOOTER + b"\n":
            raise ValueError("not a token file, or cut short")
        self.blocks = int(np.frombuffer(self.data[-9:-5], "<u4")[0])
        start = len(data) - 9 - 16 * self.blocks
        self.offsets, self.ids_before = np.frombuffer(self.data[start : start + 16 * self.blocks], "<u8").reshape(2, -1).astype(np.int64)

    def block(self, k: int) -> tuple[list[int | None], np.ndarray, memoryview, int]:
        """Document ids, their offsets, the payload and its width."""
        at = int(self.offsets[k])
        head = np.frombuffer(self.data[at : at + _HEAD.itemsize], _HEAD)[0]
        if head["magic"] != MAGIC:
            raise ValueError("no block at this offset")
        n, at = int(head["docs"]), at + _HEAD.itemsize
        ids = np.frombuffer(self.data[at : at + 8 * n], "<i8").tolist()
        null = np.frombuffer(self.data[at + 8 * n : at + 9 * n], np.uint8)
        offsets = np.frombuffer(self.data[at + 9 * n : at + 17 * n + 8], "<u8").astype(np.int64)
        at += 17 * n + 8
        size = -(-int(head["ids"]) * int(head["bits"]) // 8)
        return [None if z else d for d, z in zip(ids, null)], offsets, self.data[at : at + size], int(head["bits"])

    def document(self, k: int, i: int) -> np.ndarray:
        """The ids of document i of block k, nothing else is unpacked."""
        _, offsets, payload, bits = self.block(k)
        return unpack(payload, bits, int(offsets[i]), int(offsets[i + 1] - offsets[i]))


# The characters whose classes are the same in every Unicode version of the last ten years.
_KNOWN = (range(0x500), range(0x2010, 0x2028), range(0x3041, 0x3097), range(0x30A1, 0x30FB), range(0x4E00, 0x9FA6), range(0xAC00, 0xD7A4))
#: White space as Unicode has it; Python's \s has four control characters more.
_SPACE = r"\t-\r \x85\xa0"


def _ranges(chars: Iterator[str]) -> str:
    """Characters in ascending order as the ranges of a pattern's class."""
    out: list[list[int]] = []
    for c in map(ord, chars):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in out)


def _of(category: str) -> str:
    return _ranges(chr(c) for r in _KNOWN for c in r if unicodedata.category(chr(c))[0] == category)


_LETTER, _NUMBER = _of("L"), _of("N")
#: The pre-tokens of a byte-level tokenizer, for texts of known characters.
_UNITS = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_OTHER = re.compile(f"[^{_ranges(chr(c) for r in _KNOWN for c in r)}]")
#: A space between visible ASCII characters begins a pre-token, whatever else a text holds.
_CUTS = re.compile("(?<=[!-~])(?= [!-~])")


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(rest)) for b in range(256)]


_BYTE_LETTERS = _byte_letters()
# What a tokenizer file must say so that its pre-tokens are those of _UNITS.
_PLAIN = {"normalizer": None, "truncation": None, "padding": None, "pre_tokenizer": ("ByteLevel", False, True), "model": ("BPE", None, False)}


#: Classes of bytes in texts of ASCII and the letters U+00C0 to U+017F: other, letter, digit, white space.
_OTHERS, _LETTERS, _DIGITS, _SPACES = range(4)
_CLASS = np.full(256, _OTHERS, np.uint8)
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5]] = _LETTERS
_CLASS[0x30:0x3A] = _DIGITS
_CLASS[[*range(0x09, 0x0E), 0x20]] = _SPACES
#: Bytes that show a character outside; U+00D7 and U+00F7 are no letters either.
_OUTSIDE = np.zeros(256, bool)
_OUTSIDE[[0xC2, *range(0xC6, 0x100)]] = True


def outside(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which documents (byte ranges at) hold a character that _CLASS does not know."""
    where = np.flatnonzero(_OUTSIDE[raw])
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    signs = lead[(raw[lead + 1] == 0x97) | (raw[lead + 1] == 0xB7)]
    out = np.zeros(len(at) - 1, bool)
    out[np.searchsorted(at, np.concatenate([where, signs]), side="right") - 1] = True
    return out


def unit_starts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first byte of each pre-token, as _UNITS finds them, of documents without outside characters."""
    n = len(raw)
    first = np.zeros(n + 1, bool)
    first[at] = True
    kind = _CLASS[raw]
    white = kind == _SPACES
    start = np.ones(n, bool)
    start[1:] = kind[1:] != kind[:-1]
    # a run goes with one space before it
    start[1:] &= white[1:] | (raw[:-1] != 0x20)
    # the last of white space stands apart from the rest where a run follows
    start[:-1] |= white[:-1] & ~white[1:] & ~first[1:n]
    start |= first[:n]
    marks = np.flatnonzero((raw == 0x27) & start)
    marks = marks[marks + 1 < n]
    marks = marks[~first[marks + 1]]
    if len(marks):
        one = raw[marks + 1]
        two = np.where(marks + 2 < n, raw[np.minimum(marks + 2, n - 1)], 0)
        two = np.where(first[marks + 2], 0, two)
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long_ = ((one == 0x6C) & (two == 0x6C)) | (((one == 0x72) | (one == 0x76)) & (two == 0x65))
        for own, size in ((marks[short], 2), (marks[long_], 3)):
            start[own + 1] = False
            ends = own + size
            start[ends[ends < n]] = True
    return np.flatnonzero(start)


class UnitEncoder:
    """tokenizers' ids for whole texts, with the library's model called once for each new pre-token.

    A text falls into pre-tokens by the classes of its characters alone, and the
    model encodes each pre-token by itself, so the ids of a text are those of its
    pre-tokens in a row, whatever is known already.  Pre-tokens of Latin texts are
    found and looked up with numpy, those of other known characters by a pattern.
    Parts of a text with characters outside the known ranges go to the library as
    they are, and so do texts that hold the content of an added token, and all texts
    where the tokenizer is of another kind than byte-level BPE.
    """

    LIMIT = 300_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.library = Tokenizer.from_file(path)
        # the library finds these anywhere in a text, spaces and all
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values() if t.content]
        said = json.loads(self.library.to_str())
        pre, model = said["pre_tokenizer"] or {}, said["model"]
        told = {k: said[k] for k in ("normalizer", "truncation", "padding")}
        told["pre_tokenizer"] = (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex"))
        told["model"] = (model["type"], model.get("dropout"), model.get("ignore_merges"))
        self.plain = told == _PLAIN
        self.model = self.library.model
        self.table = UnitTable(self.LIMIT)
        self.cache: dict[str, list[int]] = {}

    def _whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _unit(self, unit: str) -> list[int]:
        """The ids of one pre-token of known characters."""
        if unit.isascii() and unit.isprintable():  # of these bytes only the space has another letter
            return [t.id for t in self.model.tokenize(unit.replace(" ", _BYTE_LETTERS[0x20]))]
        return [t.id for t in self.model.tokenize("".join([_BYTE_LETTERS[b] for b in unit.encode()]))]

    def _mixed(self, text: str) -> list[int]:
        """The ids of a text with characters that are not Latin, or with an added token."""
        if not self.plain or any(a in text for a in self.added):
            return self._whole(text)
        out: list[int] = []
        for part in _CUTS.split(text) if _OTHER.search(text) else [text]:
            if _OTHER.search(part):
                out += self._whole(part)
                continue
            for unit in _UNITS.findall(part):
                ids = self.cache.get(unit)
                if ids is None:
                    if len(self.cache) >= self.LIMIT // 4:
                        self.cache.clear()
                    ids = self.cache[unit] = self._unit(unit)
                out += ids
        return out

    def _latin(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of documents of Latin characters, and how many each has."""
        table, start = self.table, unit_starts(raw, at)
        entry = table.entries(raw, start, lambda units: [self._unit(u.decode()) for u in units])
        count = np.concatenate([[0], np.cumsum(table.count[entry])])
        return table.joined(entry), np.diff(count[np.searchsorted(start, at)])

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row (null: empty), and how many each has."""
        raw, at = utf8(column)
        apart = outside(raw, at)
        data = raw.tobytes()
        if not self.plain or any(a.encode() in data for a in self.added):
            texts = column.to_pylist()
            apart |= np.array([not self.plain or any(a in (t or "") for a in self.added) for t in texts], bool)
        if not apart.any():
            return self._latin(raw, at)
        coded = [np.array(self._mixed(t or ""), "<u4") for t in column.filter(pa.array(apart)).to_pylist()]
        ids, counts = self._latin(*utf8(column.filter(pa.array(~apart))))
        rest = iter(np.split(ids, np.cumsum(counts)[:-1])) if len(counts) else iter(())
        mixed = iter(coded)
        parts = [next(mixed) if x else next(rest) for x in apart.tolist()]
        return np.concatenate(parts).astype("<u4"), np.array([len(p) for p in parts], np.int64)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        if not texts:
            return []
        ids, counts = self.encode_column(pa.array(texts, pa.string()))
        return [p.tobytes() for p in np.split(ids, np.cumsum(counts)[:-1])]


@lru_cache(maxsize=2)
def encoder_for(path: str) -> UnitEncoder:
    """One encoder for each worker process, so its cache outlives a task."""
    return UnitEncoder(path)


def _writer(path: str, bits: int, end_id: int | None, make: Callable[[str], UnitEncoder]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, at, before = make(path), 0, 0
        offsets: list[int] = []
        befores: list[int] = []
        for batch in batches:
            for part in blocks(batch, "text", max_bytes=2 << 20):
                ids, counts = encoder.encode_column(part.column(1))
                if end_id is not None:
                    ids, counts = np.insert(ids, np.cumsum(counts), end_id), counts + 1
                block = block_bytes(part.column(0).to_pylist(), counts, ids, bits)
                offsets.append(at)
                befores.append(before)
                at += len(block) + 1
                before += int(counts.sum())
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.binary())], names=["block"])
        yield pa.RecordBatch.from_arrays([pa.array([footer_bytes(offsets, befores)], pa.binary())], names=["block"])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, *, vocabulary: int, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES, make: Callable[[str], UnitEncoder] = encoder_for) -> None:
    """Encode the documents and write the files below path, in ascending doc_id order."""
    pairs = text_pairs(docs, id_col, text_col)
    size = pairs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a hash of the text splits many rows of one id
    pairs = pairs.withColumn("copy", F.xxhash64("text"))
    dealt = pairs.repartitionByRange(1 + size // file_bytes, "doc_id", "copy").sortWithinPartitions("doc_id", "copy", "text").drop("copy")
    rows = dealt.mapInArrow(_writer(tokenizer, bits_for(vocabulary), end_id, make), "block binary")
    rows.select(F.col("block").cast("string").alias("value")).write.option("lineSep", "\n").text(path)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            file = TokenFile(content.as_buffer().to_pybytes())
            for k in range(file.blocks):
                doc_ids, offsets, payload, bits = file.block(k)
                ids = unpack(payload, bits, 0, int(offsets[-1])).astype("<u4")
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                n = len(doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(offsets[:-1] + file.ids_before[k]), pa.array(np.diff(offsets)), pa.array(crc, pa.int64())],
                    names=["file", "doc_id", "at", "n_tokens", "ids_crc32"],
                )


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: doc_id, start (ids before it in all files), n_tokens, ids_crc32."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    files = files.select(F.regexp_extract("path", r"part-(\d+)[^/]*$", 1).cast("int").alias("file"), "content")
    digests = checkpoint(files.mapInArrow(_reader, "file int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint"))
    # one row for each file: a few thousand, in one window
    totals = digests.groupBy("file").agg(F.sum("n_tokens").alias("ids"))
    earlier = totals.alias("a").select("file", (F.sum("ids").over(_by_file()) - F.col("ids")).alias("before"))
    return digests.join(earlier, "file").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def _by_file():
    from pyspark.sql import Window

    return Window.orderBy("file").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
