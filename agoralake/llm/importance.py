"""Resampling documents by importance for a target distribution of hashed word runs.

Features are runs of 1 to ``longest`` consecutive words; a feature's bucket is a checksum
of its bytes.  A bucket's gain is the logarithm of its smoothed share in the target
corpus over its share in the documents; a document's weight is the sum of its features'
gains, and noise keyed by its id turns the weights into a draw without replacement.

1. One pass over the texts inverts each block of documents into postings
   (bucket, document, count), packed by shelf: a shelf is a range of 512 buckets.
2. Buckets' totals are sums of sums of each task: at most one row for each bucket.
3. The postings of a shelf meet its totals in both corpora, in parts of bounded size
   (a large shelf is dealt by block), and each bucket's gain is computed there.  Each
   part gives one packed row of contributions for a block: the sums by document.
4. Contributions meet their block, a bounded number of documents, and are added up.
5. Documents are ranked where they lie: ranges by score, counts of the ranges (one
   number each reaches the driver) and places within a range.

Null and empty texts and texts without words have no features and a weight of 0.
Each row is a document; rows of equal ids share their noise.  A null id is read as ''.
Ties of score go to the smaller id (null first), then the smaller weight and fewer
features.  Very long texts are blocks of their own.  Extra columns aren't read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import checkpoint, partitions, text_pairs
from .words import ALNUM, Words, blocks

#: A posting is one 32-bit number: bucket within its shelf, document within its block, count.
SHELF_BITS, DOC_BITS, COUNT_BITS = 9, 12, 11
BLOCK_BYTES = 4 << 20
#: Bytes of postings that meet in one group.
PART_BYTES = 8 << 20

_POSTINGS = "block bigint, shelf int, postings binary, doc_ids array<bigint>, n_words array<bigint>, n_features array<bigint>"
_SUMS = "block bigint, docs binary, weights binary"


def feature_buckets(words: Words, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of run: the word at which each run begins, and its bucket."""
    if not len(words):
        return
    told = words.told()
    code, plain = told.indices.to_numpy(zero_copy_only=False).astype(np.int64), told.dictionary.to_pylist()
    sums = np.array([zlib.crc32(w) for w in plain], np.int64)
    at, run, run_sums = np.arange(len(words)), code, sums
    room = words.room()
    for length in range(1, longest + 1):
        yield at, run_sums[run] % buckets
        if length < longest:
            more = room[at] > length
            at, run = at[more], run[more]
            pairs, run = np.unique(run * len(plain) + code[at + length], return_inverse=True)
            run_sums = np.array([zlib.crc32(b" " + plain[p % len(plain)], int(run_sums[p // len(plain)])) for p in pairs.tolist()], np.int64)


def _invert(longest: int, buckets: int, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in blocks(batch, "text", block_bytes, 1 << DOC_BITS):
                words = Words(part.column(1), ALNUM, lower=True)
                doc, size = words.doc(), part.num_rows
                n_features = np.zeros(size, np.int64)
                keys = []
                for at, bucket in feature_buckets(words, longest, buckets):
                    n_features += np.bincount(doc[at], minlength=size)
                    keys.append(bucket << DOC_BITS | doc[at])
                key, n = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_counts=True)
                most = (1 << COUNT_BITS) - 1
                pieces = -(-n // most)  # a count beyond the bits is several postings
                last = np.cumsum(pieces) - 1
                key, count = np.repeat(key, pieces), np.full(int(pieces.sum()), most, np.int64)
                count[last] = n - (pieces - 1) * most
                packed = ((key & ((1 << SHELF_BITS + DOC_BITS) - 1)) << COUNT_BITS | count).astype("<u4")
                shelves, first = np.unique(key >> SHELF_BITS + DOC_BITS, return_index=True)
                postings = [p.tobytes() for p in np.split(packed, first[1:])] if len(shelves) else []
                none = [None] * len(shelves)
                per_doc = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block] * (len(shelves) + 1), pa.int64()),
                        pa.array([None, *shelves.tolist()], pa.int32()),
                        pa.array([None, *postings], pa.binary()),
                        pa.array([part.column(0).to_pylist(), *none], per_doc),
                        pa.array([words.counts.tolist(), *none], per_doc),
                        pa.array([n_features.tolist(), *none], per_doc),
                    ],
                    names=["block", "shelf", "postings", "doc_ids", "n_words", "n_features"],
                )
                block += 1

    return run


def _unpacked(postings: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    packed = np.frombuffer(postings, "<u4").astype(np.int64)
    return packed >> DOC_BITS + COUNT_BITS, packed >> COUNT_BITS & (1 << DOC_BITS) - 1, packed & (1 << COUNT_BITS) - 1


def _task_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for shelf, postings in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            bucket, _, count = _unpacked(postings)
            sums = totals.setdefault(shelf, np.zeros(1 << SHELF_BITS, np.int64))
            sums += np.bincount(bucket, count, 1 << SHELF_BITS).astype(np.int64)
    for shelf, sums in totals.items():
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array((shelf << SHELF_BITS) + some), pa.array(sums[some])], names=["bucket", "n"])


def _totals(postings: DataFrame) -> DataFrame:
    each = postings.where("shelf is not null").select("shelf", "postings").mapInArrow(_task_totals, "bucket bigint, n bigint")
    return each.groupBy("bucket").agg(F.sum("n").alias("n"))


def gain(s: int, t: int, all_s: int, all_t: int, buckets: int) -> int:
    """The floor of 1,000 times the logarithm of a bucket's smoothed share in the target over that in the documents."""
    return math.floor(1000 * math.log(float(t + 1) * float(all_s + buckets) / (float(s + 1) * float(all_t + buckets))))


def _contribute(all_s: int, all_t: int, buckets: int):
    def run(key, postings: pa.Table, totals: pa.Table) -> pa.Table:
        gains = np.zeros(1 << SHELF_BITS, np.int64)
        for bucket, s, t in zip(*(totals.column(c).to_pylist() for c in ("bucket", "s", "t"))):
            gains[bucket & (1 << SHELF_BITS) - 1] = gain(s, t, all_s, all_t, buckets)
        docs, weights = [], []
        for packed in postings.column("postings").to_pylist():
            bucket, doc, count = _unpacked(packed)
            own, place = np.unique(doc, return_inverse=True)
            sums = np.zeros(len(own), np.int64)
            np.add.at(sums, place, gains[bucket] * count)
            docs.append(own.astype("<u2").tobytes())
            weights.append(sums.astype("<i8").tobytes())
        return pa.table({"block": postings.column("block"), "docs": pa.array(docs, pa.binary()), "weights": pa.array(weights, pa.binary())})

    return run


def _add_up(table: pa.Table) -> pa.Table:
    """The rows of one block: its documents, and their contributions."""
    names = ("doc_ids", "n_words", "n_features")
    ids, n_words, n_features = (next(v for v in table.column(c).to_pylist() if v is not None) for c in names)
    weights = np.zeros(len(ids), np.int64)
    for docs, sums in zip(table.column("docs").to_pylist(), table.column("weights").to_pylist()):
        if docs is not None:
            weights[np.frombuffer(docs, "<u2")] += np.frombuffer(sums, "<i8")
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(n_words, pa.int64()), "n_features": pa.array(n_features, pa.int64()), "weight": pa.array(weights)})


def noise(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u between 0 and 1 by the hash of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weigh(docs: DataFrame, target: DataFrame, *, longest: int = 1, buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight): one row per document."""
    columns = ["block", "shelf", "postings"]
    postings = checkpoint(text_pairs(docs, id_col, text_col).mapInArrow(_invert(longest, buckets, BLOCK_BYTES), _POSTINGS))
    aims = target.select(F.lit(None).cast("bigint").alias("doc_id"), F.col(target_text).cast("string").alias("text")).mapInArrow(_invert(longest, buckets, BLOCK_BYTES), _POSTINGS)
    totals = _totals(postings).withColumnRenamed("n", "s").join(_totals(aims).withColumnRenamed("n", "t"), "bucket", "left").select("bucket", "s", F.coalesce("t", F.lit(0).cast("long")).alias("t"))
    totals = checkpoint(totals)
    all_s = totals.agg(F.sum("s")).first()[0] or 0
    all_t = _totals(aims).agg(F.sum("n")).first()[0] or 0
    shelved = postings.where("shelf is not null").select(*columns)
    # a large shelf is dealt by block; each part gets the shelf's totals
    parts = shelved.groupBy("shelf").agg(F.ceil(F.sum(F.octet_length("postings")) / PART_BYTES).alias("parts"))
    dealt = shelved.join(parts, "shelf").withColumn("part", F.pmod(F.xxhash64("block"), "parts"))
    met = totals.withColumn("shelf", F.shiftright("bucket", SHELF_BITS).cast("int")).join(parts, "shelf").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    met = met.select("shelf", "part", "bucket", "s", "t").toDF("shelf", "part", "bucket", "s", "t")
    sums = dealt.groupBy("shelf", "part").cogroup(met.groupBy("shelf", "part")).applyInArrow(_contribute(all_s, all_t, buckets), _SUMS)
    rows = sums.unionByName(postings.where("shelf is null").drop("shelf", "postings"), allowMissingColumns=True)
    return rows.groupBy("block").applyInArrow(_add_up, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def _place(before: dict[int, int], drawn: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = dict(before)
        for batch in batches:
            part, able = batch.column(batch.num_columns - 1).to_numpy(), batch.column(batch.num_columns - 2).to_numpy(zero_copy_only=False)
            rank = np.zeros(batch.num_rows, np.int64)
            for p in np.unique(part).tolist():
                own = (part == p) & able
                rank[own] = seen.get(p, 0) + 1 + np.arange(int(own.sum()))
                seen[p] = seen.get(p, 0) + int(own.sum())
            ranks = pa.array(rank, pa.int64(), mask=~able | (rank > drawn))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], ranks], names=[*batch.schema.names[:-2], "rank"])

    return run


def resample(docs: DataFrame, target: DataFrame, *, percent: int = 10, least_words: int = 20, seed: int = 2024, longest: int = 1, buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank): floor(percent * N / 100) of the N documents of enough words have a rank."""
    spark = docs.sparkSession
    weighed = weigh(docs, target, longest=longest, buckets=buckets, id_col=id_col, text_col=text_col, target_text=target_text)
    scored = checkpoint(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("able", F.col("n_words") >= least_words))
    order = [F.desc("able"), F.desc("score"), F.asc("doc_id"), F.asc("weight"), F.asc("n_features")]
    ranged = scored.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    ranged = checkpoint(ranged.withColumn("part", F.spark_partition_id()))
    counts = {r["part"]: r["n"] for r in ranged.groupBy("part").agg(F.count_if("able").alias("n")).collect()}
    before, n = {}, 0
    for part in sorted(counts):
        before[part] = n
        n += counts[part]
    return ranged.mapInArrow(_place(before, percent * n // 100), "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint, rank bigint")
