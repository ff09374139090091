"""MinHash near-duplicates with tensored banding.

``m`` collections of ``r`` minhashes each are combined in pairs: every pair of
collections is one table, so m(m-1)/2 tables of 2r-hash keys need m*r minhashes
instead of m(m-1)*r.  Two documents meet when two of their collections agree;
``plan`` picks the least m whose miss rate at the threshold is below ``MISS``.

1. One pass over whole texts gives each document the size of its shingle set, a
   fingerprint of the set (128 bits of BLAKE2b over its sorted shingle hashes) and the
   minhashes.  Equal sets are one node from here on.
2. Table keys are grouped; each key's smallest and largest node are its two hubs.  A
   node that agrees with a hub on enough minhashes to have a similarity near ``LOOSE``
   or more is loosely linked with it.  Two documents above the threshold meet the hubs
   of some 25 shared keys, which resemble both or neither, so they share a loose
   component.
3. Loose components of more than one block first confirm, on full sets, the link of
   each node with the hub it agrees with most.  Sets that this joins need no further
   comparison with each other, so a large group of near copies costs one comparison a
   set; only what is outside a component's largest joined class meets all its sets.
4. Those, and the sets of smaller loose components, are compared in blocks of ``BLOCK``
   sets against each other: a product of 0/1 matrices counts common shingles, which are
   told apart by their words, not by hashes.  A pair of blocks returns the links of a
   spanning forest, never its pairs.
5. Components of the confirmed links are the result.

Null texts and texts without words have an empty set and link with nothing.
Repeated rows, and rows with equal or null ids, are nodes by their sets like any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .frames import appended, checkpoint, numbered, position, text_pairs
from .words import SPACED, Words, blocks, mix

_U = np.uint64
MISS = 2.5e-4
LOOSE = 0.5
BLOCK = 384
#: Shingles in a block, for sets of very long documents.
BLOCK_SHINGLES = 1 << 20


@dataclass(frozen=True)
class Plan:
    """Shingle length, threshold as a ratio of whole numbers, collections and minhashes in each."""

    words: int
    above: int
    of: int
    collections: int
    rows: int

    @property
    def hashes(self) -> int:
        return self.collections * self.rows


def plan(words: int, above: int, of: int, rows: int = 3, miss: float = MISS) -> Plan:
    """The least number of collections whose pairs miss a pair at the threshold with a chance below miss."""
    q = (above / of) ** rows
    m = 2
    while (1 - q) ** m + m * q * (1 - q) ** (m - 1) > miss:
        m += 1
    return Plan(words, above, of, m, rows)


@lru_cache(maxsize=4)
def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
    return x[:n] | _U(1), x[n:]


def shingle_sets(column, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, one after the other, and n + 1 offsets."""
    w = Words(column, SPACED, lower=True)
    at, h = w.windows(words)
    counts = w.counts
    short = np.flatnonzero((counts > 0) & (counts < words))
    doc = w.doc()[at]
    if len(short):
        extra = np.concatenate([w.window_hash(w.first[short[counts[short] == n]], n) for n in range(1, words)])
        owner = np.concatenate([short[counts[short] == n] for n in range(1, words)])
        h, doc = np.concatenate([h, extra]), np.concatenate([doc, owner])
        order = np.argsort(doc, kind="stable")
        h, doc = h[order], doc[order]
    edges = np.searchsorted(doc, np.arange(len(counts) + 1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.concatenate([[0], np.cumsum(new)])[edges]


def _per_document(ufunc: np.ufunc, values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """ufunc over each non-empty range that begins at first."""
    return ufunc.reduceat(values, first) if len(first) else values[:0]


def fingerprints(h: np.ndarray, at: np.ndarray) -> list[bytes | None]:
    """128 bits for each set; null for an empty one."""
    raw = h.astype("<u8").tobytes()
    return [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() if b > a else None for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def exact_sets(column, words: int) -> list[np.ndarray]:
    """Sorted distinct numbers of each document's shingles; within the column, numbers are equal where the words are."""
    w = Words(column, SPACED, lower=True)
    size = w.end - w.start
    change = np.zeros(len(w.data) + 1, np.int8)
    change[w.start] += 1
    change[w.end] -= 1
    only = w.data[np.cumsum(change[:-1], dtype=np.int8).astype(bool)]
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    told = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(w), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(only.tobytes())]).dictionary_encode()
    none = len(told.dictionary)  # stands after the words of a shorter document
    word = np.append(told.indices.to_numpy(zero_copy_only=False).astype(np.int64), [none] * words)
    room = w.room()
    doc = w.doc()
    at = np.flatnonzero((room >= words) | (np.arange(len(w)) == w.first[doc]))
    code, codes = np.zeros(len(at), np.int64), 1
    for i in range(words):
        own = np.where(room[at] > i, word[at + i], none)
        if codes * (none + 1) >= 1 << 62:
            values, code = np.unique(code, return_inverse=True)
            codes = len(values)
        code, codes = code * (none + 1) + own, codes * (none + 1)
    edges = np.searchsorted(doc[at], np.arange(len(w.counts) + 1))
    return [np.unique(code[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]


def _sketch(p: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _multipliers(p.hashes)
        for batch in batches:
            for part in blocks(batch, "text"):
                h, at = shingle_sets(part.column(1), p.words)
                sizes = np.diff(at)
                full = np.flatnonzero(sizes)
                low = np.zeros((len(full), p.hashes), "<u4")
                for k in range(p.hashes):
                    low[:, k] = _per_document(np.minimum, ((h * a[k] + b[k]) >> _U(32)).astype(np.uint32), at[full])
                minhash = [None] * len(sizes)
                for i, row in zip(full.tolist(), low):
                    minhash[i] = row.tobytes()
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(sizes, pa.int64()), pa.array(fingerprints(h, at), pa.binary()), pa.array(minhash, pa.binary())], names=["doc_id", "text_key", "n_shingles", "set", "minhash"])

    return run


def _keys(p: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = np.triu_indices(p.collections, 1)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                low = np.frombuffer(b"".join(part.column(1).to_pylist()), "<u4").reshape(-1, p.collections, p.rows).astype(_U)
                c = np.zeros(low.shape[:2], _U)
                for k in range(p.rows):
                    c = mix(c * _U(0x2545F4914F6CDD1D) + low[:, :, k])
                key = mix((c[:, one] * _U(3)) ^ (c[:, two] * _U(5) + np.arange(len(one), dtype=_U)))
                node = np.repeat(part.column(0).to_numpy(), len(one))
                yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(node)], names=["key", "node"])

    return run


def _agree(p: Plan, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u4").reshape(-1, p.hashes) for i in (2, 3))
            agree = (x == y).sum(axis=1)
            near = pa.array(agree >= least)
            out = batch.select([0, 1]).filter(near)
            yield appended(out, {"agree": pa.array(agree, pa.int32()).filter(near)})

    return run


def linked(p: Plan, sizes: np.ndarray, others: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes with so many common elements reach the threshold."""
    return p.of * both >= p.above * (sizes + others - both)


def _confirm(p: Plan):
    """Pairs (u, v, text, other) whose full sets are linked."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text", max_rows=BLOCK):
                n = part.num_rows
                sets = exact_sets(pa.concat_arrays([part.column(2), part.column(3)]), p.words)
                both = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(sets[:n], sets[n:])], np.int64)
                sizes = np.array([len(x) for x in sets], np.int64)
                yield part.select([0, 1]).filter(pa.array(linked(p, sizes[:n], sizes[n:], both)))

    return run


def forest(pairs: np.ndarray, n: int) -> np.ndarray:
    """A spanning forest (rows of pairs) of a graph on n nodes."""
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    used = []
    for k, (i, j) in enumerate(pairs.tolist()):
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            used.append(k)
    return pairs[used]


def common(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Numbers of common elements of sets[rows] and sets[columns], by products of 0/1 matrices."""
    sizes = np.array([len(s) for s in sets])
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = np.bincount(code, minlength=len(values)) > 1  # an element of one set alone is common to none
    number = np.cumsum(shared) - 1
    keep = shared[code]
    code, owner = number[code[keep]], owner[keep]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    out = np.zeros((len(rows), len(columns)), np.float32)
    for lo in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(code, [lo, lo + 4096])
        part = np.zeros((len(sets), 4096), np.float32)
        part[owner[a:b], code[a:b] - lo] = 1
        out += part[rows] @ part[columns].T
    return out.astype(np.int64)


def _links(p: Plan):
    def run(key, rows):
        rows = rows.sort_by("node")
        node, side = rows.column("node").to_numpy(), rows.column("side").to_numpy()
        sets = exact_sets(rows.column("text"), p.words)
        itself = key[1].as_py() == key[2].as_py()
        left = np.flatnonzero(side == 0)
        right = left if itself else np.flatnonzero(side == 1)
        if not len(left) or not len(right):
            pairs = np.zeros((0, 2), np.int64)
        else:
            sizes = np.array([len(s) for s in sets], np.int64)
            x, y = np.nonzero(linked(p, sizes[left][:, None], sizes[right][None, :], common(sets, left, right)))
            pairs = np.stack([left[x], right[y]], axis=1)
            pairs = forest(pairs[pairs[:, 0] != pairs[:, 1]], len(node))
        return pa.table({"u": pa.array(node[pairs[:, 0]], pa.int64()), "v": pa.array(node[pairs[:, 1]], pa.int64())})

    return run


def _loose_links(nodes: DataFrame, p: Plan) -> DataFrame:
    keys = nodes.select("node", "minhash").mapInArrow(_keys(p), "key bigint, node bigint")
    hubs = keys.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b")
    met = keys.join(hubs, "key").select("node", F.explode(F.array("a", "b")).alias("hub")).where("node <> hub").distinct()
    sketch = nodes.select("node", "minhash")
    met = met.join(sketch, "node").join(sketch.select(F.col("node").alias("hub"), F.col("minhash").alias("other")), "hub")
    # four standard deviations below the loose similarity
    least = max(1, int(p.hashes * LOOSE - 2 * (p.hashes * LOOSE * (1 - LOOSE)) ** 0.5))
    return met.select(F.col("node").alias("u"), F.col("hub").alias("v"), "minhash", "other").mapInArrow(_agree(p, least), "u bigint, v bigint, agree int")


def _blocks(count: str, shingles: str) -> Column:
    return F.greatest(F.ceil(F.col(count) / F.lit(BLOCK)), F.ceil(F.col(shingles) / F.lit(BLOCK_SHINGLES))).cast("int")


def _dealt(members: DataFrame) -> DataFrame:
    """The pairs of blocks that each set goes to: (loose, i, j, side, node, text).

    Blocks 0 to rest - 1 hold the sets outside the main class, which meet all; blocks
    from rest on hold the main class, which meets the others only.
    """
    main = F.col("main")
    own = F.when(main, F.col("rest") + F.pmod(F.xxhash64("node"), F.greatest("mains", F.lit(1)))).otherwise(F.pmod(F.xxhash64("node"), F.greatest("rest", F.lit(1)))).cast("int")
    # without others, a main class meets nothing
    upto = F.when(main, F.col("rest")).otherwise(F.col("rest") + F.col("mains"))
    other = F.explode(F.when(upto > 0, F.sequence(F.lit(0), upto - 1)).otherwise(F.array().cast("array<int>")))
    each = members.where(~main | (F.col("rest") > 0)).withColumn("own", own).withColumn("met", other)
    i, j = F.least("own", "met"), F.greatest("own", "met")
    return each.select("loose", i.alias("i"), j.alias("j"), F.when(F.col("own") == i, 0).otherwise(1).alias("side"), "node", "text")


def near_duplicates(docs: DataFrame, p: Plan, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text_key (a hash of the text), n_shingles, component_id (smallest doc_id of its component) and kept."""
    pairs = text_pairs(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text"))
    sketches = checkpoint(pairs.mapInArrow(_sketch(p), "doc_id bigint, text_key bigint, n_shingles bigint, set binary, minhash binary"))
    sets = sketches.where("set is not null").groupBy("set").agg(F.min("doc_id").alias("id"), F.min(F.struct("text_key", "doc_id")).alias("row"), F.first("n_shingles").alias("n_shingles"), F.first("minhash").alias("minhash"))
    # numbers are shorter than fingerprints; the checkpoint fixes them
    nodes = checkpoint(sets.withColumn("node", F.monotonically_increasing_id()))
    near = checkpoint(_loose_links(nodes, p))
    loose = components(near.select("u", "v")).withColumnRenamed("component", "loose")
    members = checkpoint(loose.join(nodes.select("node", "row", "n_shingles"), "node"))
    sizes = members.groupBy("loose").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"))
    # few enough to be sent: one for BLOCK sets, or BLOCK_SHINGLES shingles, at most
    several = F.broadcast(sizes.where(_blocks("n", "shingles") > 1).select("loose"))
    large = members.join(several, "loose", "left_semi").select("loose", "node", "n_shingles")
    texts = members.join(pairs, F.col("row.doc_id").eqNullSafe(pairs["doc_id"]) & (F.col("row.text_key") == pairs["text_key"])).select("loose", "node", "n_shingles", "text")
    texts = checkpoint(texts.dropDuplicates(["node"]))
    # large components: the link of each node with its best hub, on full sets
    best = near.join(large.select(F.col("node").alias("u")), "u").groupBy("u").agg(F.max(F.struct("agree", "v"))["v"].alias("v"))
    both = best.join(texts.select(F.col("node").alias("u"), "text"), "u").join(texts.select(F.col("node").alias("v"), F.col("text").alias("other")), "v")
    sure = checkpoint(both.select("u", "v", "text", "other").mapInArrow(_confirm(p), "u bigint, v bigint"))
    joined = components(sure).withColumnRenamed("component", "class")
    counts = large.join(joined, "node", "left").groupBy("loose", F.coalesce("class", "node").alias("class")).agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"))
    top = counts.groupBy("loose").agg(F.max(F.struct("n", "class", "shingles")).alias("main"), F.sum("n").alias("n"), F.sum("shingles").alias("shingles"))
    split = top.select("loose", F.col("main.class").alias("top"), _blocks("main.n", "main.shingles").alias("mains"), (F.col("n") - F.col("main.n")).alias("rest_n"), (F.col("shingles") - F.col("main.shingles")).alias("rest_shingles"))
    split = F.broadcast(split.select("loose", "top", "mains", _blocks("rest_n", "rest_shingles").alias("rest")))
    known = joined.select("node", "class")
    dealt = texts.join(split, "loose", "left").join(known, "node", "left").select("loose", "node", "text", F.coalesce(F.coalesce("class", "node") == F.col("top"), F.lit(False)).alias("main"), F.coalesce("rest", F.lit(1)).alias("rest"), F.coalesce("mains", F.lit(0)).alias("mains"))
    links = _dealt(dealt).groupBy("loose", "i", "j").applyInArrow(_links(p), "u bigint, v bigint")
    confirmed = components(sure.unionByName(links))
    own = nodes.select("node", "set", "id").join(confirmed, "node", "left").select("set", "id", F.coalesce("component", "node").alias("component"))
    least = own.groupBy("component").agg(F.min("id").alias("component_id"))
    named = own.join(least, "component").select("set", "component_id")
    out = sketches.select("doc_id", "text_key", "n_shingles", "set").join(named, "set", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "text_key", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def deduplicate(docs: DataFrame, p: Plan, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of docs; of each component the rows with the smallest id stay, and rows without id.

    Rows are dropped by id and text, so another text under the id of a dropped one stays.
    """
    found = near_duplicates(docs, p, id_col=id_col, text_col=text_col)
    dropped = found.where(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id", "text_key").distinct()
    rows = numbered(docs)
    own = (F.col(position(docs, id_col)).cast("long") == F.col("doc_id")) & (F.xxhash64(F.col(position(docs, text_col)).cast("string")) == F.col("text_key"))
    return rows.join(dropped, own, "left_anti").toDF(*docs.columns)
