"""SentencePiece encoding and decoding of whole documents, giant ones in parallel.

The model file at hand is of the BPE kind, whose merges are no sum of piece
scores, so a max-plus search over scores would give other ids than the library.
What is additive is validity: a sequence of tokens is the library's encoding
exactly when each token encodes to itself and each two neighbours, written
together, encode to those two.  So the max-plus weights are 0 (a valid step) and
minus infinity, the best path is the only valid one, and its ids are the
library's; the tests hold them against it.

A giant document is cut into chunks of ``CHUNK`` characters at any place.  A
boundary state is the token that ends at a cut or straddles it, given by its
characters before and after the cut.  Each chunk computes, alone, the transfer
matrix from its entry states to its exit states.  Max-plus products are associative,
so ``FAN`` neighbouring matrices become one, level by level, until a document has one
matrix; on the way back each level fixes the states between its matrices from the
states at the ends of their product.  No task holds more than FAN matrices of a
document.  Then each chunk backtraces its own ids, alone.

No piece holds the space mark after another character, so no token crosses the
place before a space mark, and a line end is in no piece of several characters.
Between such places the ids of a unit are the library's own, cached by unit;
lattices are only needed at a chunk's ends, or throughout where a chunk has none.

Null and empty texts have no ids.  Repeated rows are encoded like any other.  Columns
of the input named ids or decoded are replaced.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import appended, checkpoint, numbered, position
from .units import UnitTable
from .words import blocks, utf8

MARK = "▁"
CHUNK, GIANT = 1 << 15, 1 << 16
#: Matrices that one product combines.
FAN = 16
_UNITS = re.compile(rf"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
NEVER = -np.inf

State = tuple[int, int]
START: State = (0, 0)


class Codec:
    """The library with a cache of units, and what the lattices need to know of the model."""

    LIMIT = 300_000

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        with open(path, "rb") as f:
            model = f.read()
        # The last value of a repeated field counts: no mark is put before a unit.
        self.library = SentencePieceProcessor(model_proto=model + bytes([0x1A, 2, 0x18, 0]))
        lib = self.library
        n = lib.get_piece_size()
        names = lib.id_to_piece(list(range(n)))
        plain = [not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)) for i in range(n)]
        self.ids = {name: i for i, (name, ok) in enumerate(zip(names, plain)) if ok}
        self.longest = max(map(len, self.ids))
        if any(MARK in p.lstrip(MARK) or ("\n" in p and len(p) > 1) for p in self.ids):
            raise ValueError("a piece of this model crosses the places where texts are cut")
        self.bytes = [bytes([int(name[3:5], 16)]) if lib.is_byte(i) else name.replace(MARK, " ").encode() if ok else b"" for i, (name, ok) in enumerate(zip(names, plain))]
        self.table = UnitTable(self.LIMIT)
        self.cache: dict[str, bytes] = {}
        self.steps: dict[tuple[str, str], bool] = {}

    # -- ordinary texts

    @staticmethod
    def marked(text: str) -> str:
        return MARK + text.replace(" ", MARK) if text else ""

    def units(self, marked: list[str]) -> list[bytes]:
        """Ids (32 bits each) of marked texts that begin and end where no token crosses."""
        split = [_UNITS.findall(t) for t in marked]
        new = set().union(*split)
        if len(self.cache) > self.LIMIT // 4:
            self.cache = {u: self.cache[u] for u in new.intersection(self.cache)}
        todo = list(new.difference(self.cache))
        for i in range(0, len(todo), 20_000):
            own = todo[i : i + 20_000]
            for u, ids in zip(own, self.library.encode(own, out_type=int, num_threads=1)):
                self.cache[u] = array("i", ids).tobytes()
        get = self.cache.__getitem__
        return [b"".join(map(get, parts)) for parts in split]

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row (null: empty), and how many each has."""
        raw, at = utf8(column)
        if MARK.encode() in raw.tobytes():  # a mark in a text is a space to the library
            column = pa.array([None if t is None else t.replace(MARK, " ") for t in column.to_pylist()], pa.string())
            raw, at = utf8(column)
        # the mark before each text that is not empty
        full = np.flatnonzero(np.diff(at))
        raw = np.insert(raw, at[full], np.uint8(0x20))
        at = at + np.searchsorted(full, np.arange(len(at)))
        space, line = raw == 0x20, raw == 0x0A
        start = line.copy()
        start[1:] |= line[:-1] | (space[1:] & ~space[:-1])
        start[at[full]] = True
        first = np.flatnonzero(start)
        entry = self.table.entries(raw, first, self._units)
        count = np.concatenate([[0], np.cumsum(self.table.count[entry])])
        return self.table.joined(entry), np.diff(count[np.searchsorted(first, at)])

    def _units(self, units: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = []
        for i in range(0, len(units), 20_000):
            out += self.library.encode([u.decode().replace(" ", MARK) for u in units[i : i + 20_000]], out_type=int, num_threads=1)
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: bytes of pieces, marks as spaces, without the mark before the text."""
        text = b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text

    # -- lattices

    def of(self, token: str) -> list[int]:
        return np.frombuffer(self.units([token])[0] if "\n" not in token else self._raw(token), "<i4").tolist()

    def _raw(self, token: str) -> bytes:
        return array("i", self.library.encode(token, out_type=int)).tobytes()

    def step(self, one: str, two: str) -> bool:
        """Whether token two may follow token one."""
        key = (one, two)
        if key not in self.steps:
            if len(self.steps) > 1_000_000:
                self.steps.clear()
            both = np.frombuffer(self._raw(one + two), "<i4").tolist()
            self.steps[key] = both == self.of(one) + self.of(two)
        return self.steps[key]

    def token(self, text: str) -> bool:
        """Whether text is a token by itself: a piece that its own encoding is, or a character outside the pieces."""
        return (text in self.ids and self.of(text) == [self.ids[text]]) or (len(text) == 1 and text not in self.ids)

    def states(self, left: str, right: str) -> list[State]:
        """The states at a cut between left and right (characters of the document around it)."""
        if not left:
            return [START]
        return [(k, s) for k in range(1, min(self.longest, len(left)) + 1) for s in range(0, min(self.longest - k, len(right)) + 1) if self.token(left[len(left) - k :] + right[:s])]

    def reach(self, text: str, first: int, last: int, before: list[str], ahead: list[int]) -> list[dict[int, int]]:
        """For each end position the tokens (by start) that end there, with the entries they are reached from as bits.

        Entry i is the token before[i] (empty: none) and leaves off at first + ahead[i]; tokens begin in [first, last).
        """
        size = len(text)
        out: list[dict[int, int]] = [{} for _ in range(size + 1)]
        entries: dict[int, list[int]] = {}
        for i, a in enumerate(ahead):
            entries.setdefault(first + a, []).append(i)
        for at in range(first, last):
            waiting = entries.get(at, [])
            if not out[at] and not waiting:
                continue
            for end in range(at + 1, min(size, at + self.longest) + 1):
                two = text[at:end]
                if not self.token(two):
                    continue
                bits = 0
                for start, from_ in out[at].items():
                    if from_ & ~bits and self.step(text[start:at], two):
                        bits |= from_
                for i in waiting:
                    if not before[i] or self.step(before[i], two):
                        bits |= 1 << i
                if bits:
                    out[end][at] = out[end].get(at, 0) | bits
        return out

    def back(self, text: str, table: list[dict[int, int]], start: int, end: int, entry: int, first: int, before: str) -> list[int]:
        """Ids on the path from an entry (token before, ending at first) to the token [start, end)."""
        tokens: list[str] = []
        while True:
            tokens.append(text[start:end])
            if start == first and (not before or self.step(before, tokens[-1])):
                return [i for t in reversed(tokens) for i in self.of(t)]
            start, end = next(s for s, bits in table[start].items() if bits >> entry & 1 and self.step(text[s:start], tokens[-1])), start


class Chunk:
    """A chunk of a marked document with the characters around it."""

    def __init__(self, codec: Codec, left: str, own: str, right: str):
        self.codec, self.left, self.own, self.right = codec, left, own, right
        self.entries, self.exits = codec.states(left, own + right), codec.states(left + own, right)
        # where no token crosses: the first and the last such place within the chunk
        around = left[-1:] + own + right[:1]
        shift = len(left[-1:])
        safe = [m.end() - shift for m in re.finditer(rf"[^{MARK}](?={MARK})|\n|.(?=\n)", around, re.S)]
        safe = [p for p in safe if 0 <= p <= len(own)]
        if not left:
            safe.insert(0, 0)
        if not right:
            safe.append(len(own))
        self.first, self.last = (safe[0], safe[-1]) if safe else (None, None)

    def _entry(self, state: State) -> str:
        k, s = state
        return self.left[len(self.left) - k :] + (self.own + self.right)[:s] if k else ""

    def _head(self, upto: int, extra: str) -> tuple[str, list[dict[int, int]]]:
        text = self.own[:upto] + extra
        return text, self.codec.reach(text, 0, upto, [self._entry(e) for e in self.entries], [e[1] for e in self.entries])

    def _tail(self, start: int) -> tuple[str, list[dict[int, int]]]:
        text = self.own[start:] + self.right[: self.codec.longest]
        return text, self.codec.reach(text, 0, len(self.own) - start, [""], [0])

    def _arrives(self, table: list[dict[int, int]], at: int) -> int:
        """Entries that come to a safe place: by a token that ends there, or by themselves."""
        bits = 0
        for b in table[at].values():
            bits |= b
        for i, (_, s) in enumerate(self.entries):
            bits |= (s == at) << i
        return bits

    def matrix(self) -> np.ndarray:
        """Entry states x exit states: 0 where a valid path leads from one to the other."""
        out = np.full((len(self.entries), len(self.exits)), NEVER)
        size = len(self.own)
        if self.first is not None:
            _, head = self._head(self.first, "")
            bits = self._arrives(head, self.first)
            _, tail = self._tail(self.last)
            rows = np.array([bool(bits >> i & 1) for i in range(len(self.entries))])
            for j, (k, s) in enumerate(self.exits):
                start = size - self.last - k
                ok = bool(tail[size - self.last + s].get(start, 0)) if start >= 0 else s == 0 and self.last == size
                out[:, j] = np.where(rows & ok, 0.0, NEVER)
            return out
        _, table = self._head(size, self.right[: self.codec.longest])
        for j, (k, s) in enumerate(self.exits):
            bits = table[size + s].get(size - k, 0) if k <= size else 0
            for i, (ke, se) in enumerate(self.entries):
                passes = (ke + size, se - size) == (k, s)  # one token covers the whole chunk
                out[i, j] = 0.0 if bits >> i & 1 or passes else NEVER
        return out

    def ids(self, entry: State, exit_: State) -> bytes:
        """Ids of the tokens that begin in the chunk, between the states at its ends."""
        codec, size = self.codec, len(self.own)
        i = self.entries.index(entry)
        k, s = exit_
        out: list[int] = []
        if self.first is None:
            text, table = self._head(size, self.right[: codec.longest])
            if size - k >= 0 and not (entry[0] + size, entry[1] - size) == exit_:
                out = codec.back(text, table, size - k, size + s, i, entry[1], self._entry(entry))
            return array("i", out).tobytes()
        text, table = self._head(self.first, "")
        if entry[1] < self.first:
            start = next(a for a, bits in table[self.first].items() if bits >> i & 1)
            out = codec.back(text, table, start, self.first, i, entry[1], self._entry(entry))
        middle = codec.units([self.own[self.first : self.last]])[0]
        text, table = self._tail(self.last)
        end: list[int] = []
        if self.last < size or s:
            end = codec.back(text, table, size - self.last - k, size - self.last + s, 0, 0, "")
        return array("i", out).tobytes() + middle + array("i", end).tobytes()


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def boundary_states(matrices: list[np.ndarray], entry: int, exit_: int) -> list[int]:
    """The states at the cuts of a run of matrices, from the entry at its start to the exit at its end."""
    after = np.full((matrices[-1].shape[1], 1), NEVER)
    after[exit_] = 0.0
    rest = [after]
    for m in reversed(matrices[1:]):
        rest.append(max_plus(m, rest[-1]))
    out = [entry]
    for m, to_end in zip(matrices, reversed(rest)):
        value = m[out[-1]] + to_end[:, 0]
        if value.max() == NEVER:
            raise ValueError("no valid path through the document")
        out.append(int(value.argmax()))
    return out


@lru_cache(maxsize=2)
def codec_for(path: str) -> Codec:
    """One codec for each worker process."""
    return Codec(path)


def _encode_rows(path: str, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(path)
        for batch in batches:
            for part in blocks(batch, text):
                ids, counts = codec.encode_column(part.column(part.schema.get_field_index(text)))
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype("<i4")
                yield appended(part, {"ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype("<i4")))})

    return run


def _id_lists(coded: list[bytes]) -> pa.Array:
    offsets = np.cumsum([0, *[len(c) // 4 for c in coded]]).astype("<i4")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(coded), "<i4")))


_CUT = "doc string, k int, before string, own string, after string"
_MATRIX = "doc string, k int, entries array<int>, exits array<int>, matrix array<double>"
_STATES = "doc string, k int, entry array<int>, exit array<int>"


def _cut(longest: int, chunk: int):
    """Texts (doc, text) in chunks with the characters around them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(*(batch.column(i) for i in range(2))):
                marked = Codec.marked(text.as_py())
                for k, at in enumerate(range(0, len(marked), chunk)):
                    row = (doc.as_py(), k, marked[max(0, at - longest) : at], marked[at : at + chunk], marked[at + chunk : at + chunk + longest])
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.int32() if i == 1 else pa.string()) for i, x in enumerate(row)], names=["doc", "k", "before", "own", "after"])

    return run


def _matrices(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, k, before, own, after in zip(*(batch.column(i).to_pylist() for i in range(5))):
                c = Chunk(codec_for(path), before, own, after)
                states = [pa.array([[x for e in own_ for x in e]], pa.list_(pa.int32())) for own_ in (c.entries, c.exits)]
                matrix = pa.array([c.matrix().reshape(-1).tolist()], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array([doc], pa.string()), pa.array([k], pa.int32()), *states, matrix], names=["doc", "k", "entries", "exits", "matrix"])

    return run


def _run_of(rows: pa.Table) -> tuple[pa.Table, list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Neighbouring matrices in order: the rows, entry and exit states, matrices."""
    rows = rows.sort_by("k")
    entries, exits = ([np.array(x).reshape(-1, 2) for x in rows.column(c).to_pylist()] for c in ("entries", "exits"))
    return rows, entries, exits, [np.array(m).reshape(len(a), len(b)) for m, a, b in zip(rows.column("matrix").to_pylist(), entries, exits)]


def _product(key, rows):
    rows, entries, exits, matrices = _run_of(rows)
    out = matrices[0]
    for m in matrices[1:]:
        out = max_plus(out, m)
    arrays = [pa.array([x.reshape(-1).tolist()], pa.list_(t)) for x, t in ((entries[0], pa.int32()), (exits[-1], pa.int32()), (out, pa.float64()))]
    return pa.table([pa.array([key[0].as_py()], pa.string()), pa.array([key[1].as_py()], pa.int32()), *arrays], names=["doc", "k", "entries", "exits", "matrix"])


def _fixed(key, rows, ends):
    """The states at both ends of each matrix of a run; ends has them for the whole run."""
    rows, entries, exits, matrices = _run_of(rows)
    at = lambda states, state: next(i for i, s in enumerate(states.tolist()) if s == state)
    own = boundary_states(matrices, at(entries[0], ends.column("entry")[0].as_py()), at(exits[-1], ends.column("exit")[0].as_py()))
    return pa.table({"doc": rows.column("doc"), "k": rows.column("k"), "entry": pa.array([e[i].tolist() for e, i in zip(entries, own[:-1])], pa.list_(pa.int32())), "exit": pa.array([e[i].tolist() for e, i in zip(exits, own[1:])], pa.list_(pa.int32()))})


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states at the ends of whole documents (one matrix each): nothing before, and the exit that is reached."""
    for batch in batches:
        for doc, k, entries, exits, matrix in zip(*(batch.column(i).to_pylist() for i in range(5))):
            best = int(np.argmax(matrix[: len(exits) // 2]))
            yield pa.RecordBatch.from_arrays([pa.array([doc], pa.string()), pa.array([k], pa.int32()), pa.array([entries[:2]], pa.list_(pa.int32())), pa.array([exits[2 * best : 2 * best + 2]], pa.list_(pa.int32()))], names=["doc", "k", "entry", "exit"])


def _scanned(told: DataFrame, chunks: int) -> DataFrame:
    """The states at the ends of each chunk (doc, k, entry, exit): products up, states down."""
    levels = [told]
    while chunks > 1:
        chunks = -(-chunks // FAN)
        # each level is small and used twice
        levels.append(checkpoint(levels[-1].groupBy("doc", F.floor(F.col("k") / FAN).cast("int").alias("of")).applyInArrow(_product, _MATRIX)))
    states = levels.pop().mapInArrow(_whole, _STATES)
    for level in reversed(levels):
        run = level.withColumn("of", F.floor(F.col("k") / FAN).cast("int")).groupBy("doc", "of")
        states = run.cogroup(states.withColumn("of", F.col("k")).groupBy("doc", "of")).applyInArrow(_fixed, _STATES)
    return states


def _backtrace(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, k, before, own, after, entry, exit_ in zip(*(batch.column(i).to_pylist() for i in range(7))):
                ids = Chunk(codec_for(path), before, own, after).ids(tuple(entry), tuple(exit_))
                yield pa.RecordBatch.from_arrays([pa.array([doc]), pa.array([k], pa.int32()), _id_lists([ids])], names=["doc", "k", "ids"])

    return run


def _giant_ids(texts: DataFrame, path: str, chunk: int) -> DataFrame:
    """(doc, ids) of distinct giant texts (doc, text), chunk by chunk."""
    cut = checkpoint(texts.select("doc", "text").mapInArrow(_cut(codec_for(path).longest, chunk), _CUT).repartition("doc", "k"))
    told = checkpoint(cut.mapInArrow(_matrices(path), _MATRIX))
    states = _scanned(told, (told.agg(F.max("k")).first()[0] or 0) + 1)
    traced = cut.join(states, ["doc", "k"]).select("doc", "k", "before", "own", "after", "entry", "exit").mapInArrow(_backtrace(path), "doc string, k int, ids array<int>")
    return traced.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("parts")).select("doc", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))


def encode(docs: DataFrame, path: str, *, text_col: str = "text", chunk: int = CHUNK, giant: int = GIANT) -> DataFrame:
    """The columns of docs, then ids (array<int>)."""
    docs = docs.drop("ids")
    text, names = position(docs, text_col), [f"c{i}" for i in range(len(docs.columns))]
    rows = numbered(docs)
    long_ = F.coalesce(F.length(text) > giant, F.lit(False))
    schema = rows.withColumn("ids", F.array().cast("array<int>")).schema
    short = rows.where(~long_).mapInArrow(_encode_rows(path, text), schema)
    giants = rows.where(long_).withColumn("doc", F.sha2(text, 256))
    ids = _giant_ids(giants.select("doc", F.col(text).alias("text")).dropDuplicates(["doc"]), path, chunk)
    return short.unionByName(giants.join(ids, "doc").select(*names, "ids")).toDF(*docs.columns, "ids")


def _decode_rows(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(path)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids"))
            for at in range(0, batch.num_rows, 1000):
                own = ids.slice(at, 1000)
                ends = own.offsets.to_numpy()
                flat, known = own.values.to_numpy(zero_copy_only=False), own.is_valid().to_numpy(zero_copy_only=False)
                texts = [codec.decode(flat[a:b]) if ok else None for a, b, ok in zip(ends[:-1].tolist(), ends[1:].tolist(), known.tolist())]
                yield appended(batch.slice(at, 1000), {"decoded": pa.array(texts, pa.string())})

    return run


def decode(coded: DataFrame, path: str) -> DataFrame:
    """The columns of coded (one is ids), then decoded; null ids stay null."""
    coded = coded.drop("decoded")
    return coded.mapInArrow(_decode_rows(path), coded.withColumn("decoded", F.lit(None).cast("string")).schema)
