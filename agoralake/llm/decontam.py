"""Benchmark decontamination.

Every run of ``n`` consecutive item words (a shorter item is one run) is hashed
on the driver and sent to the tasks as a hash set; documents are scanned where
they lie, without a shuffle.  A hash hit is verified word for word.  The set is sent
while all item texts together hold at most ``max_bytes``.

A larger benchmark is never gathered.  Its windows stay a table; what is sent is a
filter of ``FILTER_BITS`` bits on their hashes, of the same size for any benchmark.  One
pass over the documents emits the windows that pass the filter, with their words, and
these meet the item windows in a join on hash and words.  The documents are written to the
shared folder once and read twice more, however large the benchmark is.

Nulls, empty texts and texts without words have no words and no hits; items
without words have no window.  Repeated rows are judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import appended, checkpoint, numbered, position
from .words import ALNUM, Words, blocks

#: Item text up to which a hash set is sent, which takes about ten times as much; bits of the filter that is sent beyond.
MAX_BYTES = 16 << 20
FILTER_BITS = 27
_BITS = 20
_SPANS = pa.list_(pa.struct([("word", pa.int32()), ("end_word", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
_SPANS_SQL = "array<struct<word:int,end_word:int,start:bigint,end:bigint>>"


def window_table(items: list[tuple[str, str | None]], n: int) -> dict[int, dict]:
    """{window length: sorted hashes, a filter on their low bits, exact words and item ids}."""
    words = Words(pa.array([t for _, t in items], pa.string()), ALNUM, lower=True)
    by: dict[int, dict[int, dict[bytes, set[str]]]] = {}
    for i, (name, _) in enumerate(items):
        lo, hi = int(words.first[i]), int(words.first[i + 1])
        if hi == lo:
            continue
        size = min(n, hi - lo)
        at = np.arange(lo, hi - size + 1)
        for a, h in zip(at.tolist(), words.window_hash(at, size).tolist()):
            by.setdefault(size, {}).setdefault(h, {}).setdefault(words.text(np.arange(a, a + size)), set()).add(name)
    out = {}
    for size, exact in by.items():
        hashes = np.sort(np.fromiter(exact, dtype=np.uint64, count=len(exact)))
        low = np.zeros(1 << _BITS, dtype=bool)
        low[(hashes & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True
        out[size] = {"hashes": hashes, "low": low, "exact": exact}
    return out


def _item_windows(n: int):
    """(item, text) to (size, hash, words, item) of each different window of an item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                for name, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    words = Words(pa.array([text], pa.string()), ALNUM, lower=True)
                    if not len(words):
                        continue
                    size = min(n, len(words))
                    at = np.arange(len(words) - size + 1)
                    found = {(h, words.text(np.arange(a, a + size))) for a, h in zip(at.tolist(), words.window_hash(at, size).view(np.int64).tolist())}
                    hashes, texts = zip(*sorted(found))
                    yield pa.RecordBatch.from_arrays([pa.array([size] * len(texts), pa.int32()), pa.array(hashes, pa.int64()), pa.array(texts, pa.binary()), pa.array(["" if name is None else name] * len(texts), pa.string())], names=["size", "hash", "words", "item"])

    return run


def _filter(windows: DataFrame) -> np.ndarray:
    """Which low bits of a hash some item window has: FILTER_BITS bits, in pieces of 32,768."""
    low = F.col("hash").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    pieces = windows.groupBy(F.shiftright(low, 15).alias("piece")).agg(F.bitmap_construct_agg(low.bitwiseAND(F.lit((1 << 15) - 1))).alias("bits"))
    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for r in pieces.toLocalIterator():
        out[r["piece"] << 12 : (r["piece"] + 1) << 12] = np.frombuffer(r["bits"], np.uint8)
    return out


def _passing(sizes: list[int], sent: Broadcast):
    """(key, text) to (key, size, hash, words, word, start, end) of the windows that pass the filter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for batch in batches:
            for part in blocks(batch, "text"):
                words = Words(part.column(1), ALNUM, lower=True)
                keys, doc = part.column(0).to_numpy(), words.doc()
                for size in sizes:
                    at, h = words.windows(size)
                    low = (h & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
                    some = (bits[low >> 3] >> (low & 7).astype(np.uint8)) & 1 > 0
                    at, h = at[some], h[some]
                    for lo in range(0, len(at), 4096):
                        a = at[lo : lo + 4096]
                        d = doc[a]
                        base, byte = words.first[d], words.at[d]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(keys[d]), pa.array(np.full(len(a), size, np.int32)), pa.array(h[lo : lo + 4096].view(np.int64)), pa.array([words.text(np.arange(i, i + size)) for i in a.tolist()], pa.binary()), pa.array((a - base).astype(np.int32)), pa.array(words.start[a] - byte), pa.array(words.end[a + size - 1] - byte)],
                            names=["key", "size", "hash", "words", "word", "start", "end"],
                        )

    return run


def merged(spans: list[dict]) -> list[dict]:
    """Spans in order, those that overlap or touch as one."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: (s["word"], s["end_word"])):
        if out and s["word"] <= out[-1]["end_word"]:
            if s["end_word"] > out[-1]["end_word"]:
                out[-1] |= {"end_word": s["end_word"], "end": s["end"]}
        else:
            out.append(dict(s))
    return out


def _finish(text: str):
    """Counts words and merges the spans of each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, text):
                at = part.schema.get_field_index
                counts = Words(part.column(at(text)), ALNUM, lower=True).counts
                spans = [merged(s) if s else [] for s in part.column(at("spans")).to_pylist()]
                yield appended(part, {"n_words": pa.array(counts, pa.int64()), "spans": pa.array(spans, _SPANS)})

    return run


def _joined(out: DataFrame, items: DataFrame, n: int, text: str) -> DataFrame:
    """Numbered columns of out (which has n_words, spans and items), by a join of windows."""
    windows = checkpoint(items.mapInArrow(_item_windows(n), "size int, hash bigint, words binary, item string"))
    sizes = [r["size"] for r in windows.select("size").distinct().collect()]  # at most n
    sent = out.sparkSession.sparkContext.broadcast(_filter(windows))
    keyed = checkpoint(out.drop("spans", "items").withColumn("_key", F.monotonically_increasing_id()))
    passing = keyed.select(F.col("_key").alias("key"), F.col(text).alias("text")).where("text is not null").mapInArrow(_passing(sizes, sent), "key bigint, size int, hash bigint, words binary, word int, start bigint, end bigint")
    # a window of many items meets each document's window once; items meet each document's different windows
    hits = checkpoint(passing.join(windows.select("size", "hash", "words").distinct(), ["size", "hash", "words"]))
    span = F.struct("word", (F.col("word") + F.col("size")).alias("end_word"), "start", "end")
    spans = hits.groupBy(F.col("key").alias("_key")).agg(F.collect_list(span).alias("spans"))
    named = hits.select("key", "size", "hash", "words").distinct().join(windows, ["size", "hash", "words"]).groupBy(F.col("key").alias("_key")).agg(F.array_sort(F.collect_set("item")).alias("items"))
    whole = keyed.join(spans, "_key", "left").join(named, "_key", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    whole = whole.withColumn("spans", F.coalesce("spans", F.array().cast(_SPANS_SQL))).select(*out.columns)
    return whole.mapInArrow(_finish(text), out.schema)


def _hits(words: Words, tables: dict[int, dict]) -> Iterator[tuple[int, int, set[str]]]:
    """Verified (first word, length, item ids)."""
    for size, t in tables.items():
        at, h = words.windows(size)
        maybe = t["low"][(h & np.uint64((1 << _BITS) - 1)).astype(np.int64)]
        at, h = at[maybe], h[maybe]
        if not len(at):
            continue
        i = np.minimum(np.searchsorted(t["hashes"], h), len(t["hashes"]) - 1)
        found = t["hashes"][i] == h
        for a, x in zip(at[found].tolist(), h[found].tolist()):
            names = t["exact"][x].get(words.text(np.arange(a, a + size)))
            if names:
                yield a, size, names


def _scan(text: str, sent: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = sent.value
        for batch in batches:
            for part in blocks(batch, text):
                words = Words(part.column(part.schema.get_field_index(text)), ALNUM, lower=True)
                spans, names = part.column(part.schema.get_field_index("spans")).to_pylist(), part.column(part.schema.get_field_index("items")).to_pylist()
                found: dict[int, list[tuple[int, int]]] = {}
                for a, size, ids in _hits(words, tables):
                    d = int(np.searchsorted(words.first, a, side="right")) - 1
                    found.setdefault(d, []).append((a - int(words.first[d]), a - int(words.first[d]) + size))
                    names[d] = names[d] or []
                    names[d].extend(ids)
                for d, ranges in found.items():
                    ranges += [(s["word"], s["end_word"]) for s in spans[d] or []]
                    merged: list[list[int]] = []
                    for s, e in sorted(ranges):
                        if merged and s <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], e)
                        else:
                            merged.append([s, e])
                    base, byte = int(words.first[d]), int(words.at[d])
                    spans[d] = [{"word": s, "end_word": e, "start": int(words.start[base + s]) - byte, "end": int(words.end[base + e - 1]) - byte} for s, e in merged]
                    names[d] = sorted(set(names[d]))
                yield appended(part, {"n_words": pa.array(words.counts, pa.int64()), "spans": pa.array(spans, _SPANS), "items": pa.array(names, pa.list_(pa.string()))})

    return run


def _scanned(docs: DataFrame, benchmark: DataFrame, n: int, text_col: str, item_id: str, item_text: str, max_bytes: int) -> DataFrame:
    """Numbered columns of docs, then n_words, spans and items."""
    out = numbered(docs).withColumns({"n_words": F.lit(0).cast("long"), "spans": F.array().cast(_SPANS_SQL), "items": F.array().cast("array<string>")})
    schema = out.schema
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("string").alias("text")).where("text is not null").distinct()
    text = position(docs, text_col)
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > max_bytes:
        return _joined(out, items, n, text)
    rows = [("" if r["item"] is None else r["item"], r["text"]) for r in items.collect()]
    return out.mapInArrow(_scan(text, docs.sparkSession.sparkContext.broadcast(window_table(rows, n))), out.schema)


def find_overlaps(docs: DataFrame, benchmark: DataFrame, *, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", max_bytes: int = MAX_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items (sorted ids) and spans (merged hit words and their UTF-8 byte ranges)."""
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = _scanned(chosen, benchmark, n, "text", item_id, item_text, max_bytes)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end_word"] - s["word"])
    return out.select(F.col("c0").alias("doc_id"), "n_words", n_hit.alias("n_hit"), "items", "spans")


def _cut(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(batch.schema.get_field_index("spans")).to_pylist()
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            for i, own in enumerate(spans):
                if own:
                    raw, kept, last = texts[i].encode(), [], 0
                    for s in own:
                        kept.append(raw[last : s["start"]])
                        last = s["end"]
                    texts[i] = b"".join([*kept, raw[last:]]).decode()
            yield appended(batch, {text: pa.array(texts, pa.string())})

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, remove: str = "documents", n: int = 10, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", max_bytes: int = MAX_BYTES) -> DataFrame:
    """The columns of docs without contaminated documents, or (remove="spans") without the hit words."""
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove: documents or spans, not {remove}")
    out = _scanned(docs, benchmark, n, text_col, item_id, item_text, max_bytes)
    if remove == "documents":
        out = out.where(F.size("spans") == 0)
    else:
        out = out.mapInArrow(_cut(position(docs, text_col)), out.schema)
    return out.select(*[F.col(f"c{i}") for i in range(len(docs.columns))]).toDF(*docs.columns)
