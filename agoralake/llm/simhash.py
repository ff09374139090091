"""Document fingerprints (SimHash) with DataFrame functions alone, no Python on the executors.

A text's terms are its runs of ``words`` consecutive words (a shorter text is one run),
each weighted by its occurrences.  A term's 64-bit hash votes on every bit of the
fingerprint, for it where the hash has the bit and against it elsewhere; the bits with
more votes for than against are set.  Votes are counted four bits to a number: every
16th bit of a hash has a lane of 16 bits, so 16 additions count 64 bits.  Terms are
counted in slices of 32,768, so that no lane overflows, whatever the length of a text.

``within`` finds all fingerprints in a Hamming radius by permuted block tables: the bits
are cut into more blocks than the radius, and two fingerprints within it agree on all
blocks but at most ``radius``.  Each choice of the blocks that agree is a table, whose
key is their bits moved to the front.  Tables hold different fingerprints only, with
the number of their documents; a key's fingerprints are listed in lists of bounded size,
and a query meets the lists of its keys, not single fingerprints.

Texts without words (null and empty ones too) have no terms and the fingerprint 0.
"""

from __future__ import annotations

from itertools import combinations
from math import log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import checkpoint, partitions, sha256_hex

BITS = 64
#: Fixed value: the bytes between words, in lower-cased text.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Terms that are counted together; lanes of 16 bits hold as many votes.
SLICE = 1 << 15
_LANES = 0x0001000100010001
#: Fingerprints in one list of a table.
LIST = 1024
#: Text in one range of documents that are put in order together.
RANGE_BYTES = 8 << 20


def terms(text: Column, words: int) -> Column:
    """array<bigint>: hashes of the runs of consecutive words, in order."""
    found = F.filter(F.split(F.lower(text), BETWEEN), lambda w: w != "")
    hashes = F.transform(found, lambda w: F.xxhash64(w))

    def runs(h: Column) -> Column:
        out = h
        for k in range(1, words):
            out = F.zip_with(F.slice(out, F.lit(1), F.size(h) - k), F.slice(h, F.lit(k + 1), F.size(h) - k), lambda run, word: F.xxhash64(run, word))
        return F.when(F.size(h) >= words, out).when(F.size(h) > 0, F.array(F.aggregate(h, F.lit(0).cast("long"), lambda run, word: F.xxhash64(run, word)))).otherwise(F.array().cast("array<bigint>"))

    # the array of one element lets later steps name the hashes without computing them again
    return F.element_at(F.transform(F.array(hashes), runs), 1)


def _votes(hashes: Column) -> Column:
    """array<int>: of up to 32,768 hashes, how many have bit 0, 16, 32, 48, 1, 17, ..."""
    lanes = F.aggregate(
        hashes,
        F.struct(*[F.lit(0).cast("long").alias(f"v{i}") for i in range(16)]),
        lambda v, h: F.struct(*[(v[f"v{i}"] + F.shiftrightunsigned(h, i).bitwiseAND(F.lit(_LANES))).alias(f"v{i}") for i in range(16)]),
        lambda v: F.array(*[v[f"v{i}"] for i in range(16)]),
    )
    return F.flatten(F.transform(lanes, lambda x: F.array(*[F.shiftrightunsigned(x, 16 * k).bitwiseAND(F.lit(0xFFFF)).cast("int") for k in range(4)])))


def fingerprint(text: Column, words: int = 3) -> Column:
    """bigint: the SimHash of a text."""

    def voted(hashes: Column) -> Column:
        slices = F.sequence(F.lit(0), F.floor((F.size(hashes) - 1) / SLICE).cast("int"))
        many = F.aggregate(slices, F.array_repeat(F.lit(0), BITS), lambda sums, k: F.zip_with(sums, _votes(F.slice(hashes, k * SLICE + 1, F.lit(SLICE))), lambda a, b: a + b))
        votes = F.when(F.size(hashes) <= SLICE, _votes(hashes)).otherwise(many)
        bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.floor(k / 4).cast("int") + k % 4 * 16)
        set_bits = F.transform(votes, lambda n, k: F.when(2 * n > F.size(hashes), bit(k)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(set_bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))

    return F.element_at(F.transform(F.array(terms(text, words)), voted), 1)


def likeness(a: Column, b: Column) -> Column:
    """The share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def hex_digits(f: Column) -> Column:
    return F.lower(F.lpad(F.hex(f), BITS // 4, "0"))


def blocks_for(n: int, radius: int) -> int:
    """The least number of blocks whose keys tell n fingerprints apart to a few a key."""
    blocks = radius + 1
    while blocks < 2 * radius + 4 and BITS * (blocks - radius) / blocks < log2(max(n, 2)) - 2:
        blocks += 1
    return blocks


def _tables(f: Column, radius: int, blocks: int) -> Column:
    """array<struct<table, key>>: the bits of the blocks that must agree, for each choice of them."""
    edges = [BITS * b // blocks for b in range(blocks + 1)]
    masks = [((1 << edges[b + 1] - edges[b]) - 1) << edges[b] for b in range(blocks)]
    signed = lambda m: m - (1 << BITS) if m >> BITS - 1 else m
    keys = [signed(sum(masks[b] for b in chosen)) for chosen in combinations(range(blocks), blocks - radius)]
    return F.array(*[F.struct(F.lit(t).alias("table"), f.bitwiseAND(F.lit(m).cast("long")).alias("key")) for t, m in enumerate(keys)])


def _first_table(a: Column, b: Column, table: Column, radius: int, blocks: int) -> Column:
    """Whether no earlier table holds both under one key."""
    pairs = F.arrays_zip(_tables(a, radius, blocks).alias("x"), _tables(b, radius, blocks).alias("y"))
    return ~F.exists(pairs, lambda p: (p["x"]["table"] < table) & (p["x"]["key"] == p["y"]["key"]))


def _met(fingerprints: DataFrame, queries: DataFrame, radius: int, blocks: int | None) -> DataFrame:
    """(fingerprint, others): for each query and list that it meets, those in the radius that no earlier table holds."""
    every = checkpoint(fingerprints.where("fingerprint is not null").groupBy("fingerprint").agg(F.count("*").alias("copies")))
    blocks = blocks or blocks_for(every.count(), radius)
    placed = every.select(F.explode(_tables(F.col("fingerprint"), radius, blocks)).alias("at"), "fingerprint", "copies").select("at.*", "fingerprint", "copies")
    sizes = placed.groupBy("table", "key").agg(F.ceil(F.count("*") / LIST).alias("lists"))
    dealt = placed.join(sizes, ["table", "key"]).withColumn("list", F.pmod(F.xxhash64("fingerprint"), "lists"))
    lists = dealt.groupBy("table", "key", "list").agg(F.collect_list(F.struct(F.col("fingerprint").alias("other"), "copies")).alias("others"))
    asked = queries.where("fingerprint is not null").select("fingerprint").distinct()
    asked = asked.select(F.explode(_tables(F.col("fingerprint"), radius, blocks)).alias("at"), "fingerprint").select("at.*", "fingerprint")
    f = F.col("fingerprint")
    near = lambda o: (F.bit_count(f.bitwiseXOR(o["other"])) <= radius) & _first_table(f, o["other"], F.col("table"), radius, blocks)
    return asked.join(lists, ["table", "key"]).select("fingerprint", F.filter("others", near).alias("others"))


def within(fingerprints: DataFrame, queries: DataFrame, *, radius: int = 3, blocks: int | None = None) -> DataFrame:
    """(fingerprint, other, copies, distance): every different fingerprint of fingerprints (one row a document) in the
    radius of each different query, the same one included; copies counts its documents.  Nulls are ignored."""
    found = _met(fingerprints, queries, radius, blocks).select("fingerprint", F.explode("others").alias("o")).select("fingerprint", "o.*")
    return found.withColumn("distance", F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("other"))))


def count_within(fingerprints: DataFrame, queries: DataFrame, *, radius: int = 3, blocks: int | None = None) -> DataFrame:
    """(fingerprint, n_within): how many documents have a fingerprint in the radius of each different query."""
    n = F.aggregate("others", F.lit(0).cast("long"), lambda n, o: n + o["copies"])
    return _met(fingerprints, queries, radius, blocks).groupBy("fingerprint").agg(F.sum(n).alias("n_within"))


def _range_of(rank: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most rank, by binary search."""
    if not bounds:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    sorted_bounds = F.array(*[F.lit(b).cast("long") for b in bounds])
    last = F.lit(len(bounds))
    take = lambda at, step: F.when((at + step <= last) & (F.element_at(sorted_bounds, F.least(at + step, last)) <= rank), at + step).otherwise(at)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), take)


def in_ranges(docs: DataFrame) -> tuple[DataFrame, list[int]]:
    """docs (doc_id, text) with rank (the id), part, a range of ranks, and tie, which orders rows of one id; and the ranges' first ranks.

    Only these first ranks, one number each, reach the driver; no range is empty."""
    rank = F.coalesce("doc_id", F.lit(-(1 << 63)))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(8 * partitions(docs.sparkSession), -(-size // RANGE_BYTES))
    near = docs.select(rank.alias("rank")).agg(F.percentile_approx("rank", [k / ranges for k in range(1, ranges)], 10 * ranges)).first()[0] or []
    firsts = docs.groupBy(_range_of(rank, sorted(set(near))).alias("part")).agg(F.min(rank).alias("first")).collect()
    firsts = sorted(r["first"] for r in firsts)
    return docs.select("doc_id", "text", rank.alias("rank"), _range_of(rank, firsts[1:]).alias("part"), F.xxhash64("text").alias("tie")), firsts


def _next(rows: DataFrame, column: str, firsts: list[int]) -> DataFrame:
    """rows with the column next_<column>: that of the next row by rank and tie, after the last one that of the first."""
    value = F.struct(F.col(column).alias("value"))
    ranges = max(len(firsts), 1)
    at_first = F.array_contains(F.array(*[F.lit(x).cast("long") for x in firsts]), F.col("rank")) if firsts else F.lit(False)
    heads = rows.where(at_first).groupBy("part").agg(F.min_by(value, "tie").alias("_head"))
    heads = heads.select(F.pmod(F.col("part") - 1, F.lit(ranges)).alias("part"), "_head")
    ahead = rows.withColumn("_ahead", F.lead(value).over(Window.partitionBy("part").orderBy("rank", "tie")))
    return ahead.join(heads, "part").withColumn(f"next_{column}", F.coalesce("_ahead", "_head")["value"]).drop("_ahead", "_head")


def audit(docs: DataFrame, *, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_chars, the text with its last quarter replaced (by sha256), the fingerprints
    (bigint) of both texts and of the next document, and the likeness of the first with the others.

    The last floor(n_chars / 4) code points give way to the first as many (or all) of the next document in ascending
    order of id, after the last of the first.  Null ids come first; rows of one id are in the order of a hash of
    their texts.  Null texts are empty; repeated rows are rows like others.  No rows give no rows; extra columns
    aren't read."""
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows, firsts = in_ranges(chosen)
    n, cut = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    pairs = _next(rows, "text", firsts).select("doc_id", "part", "rank", "tie", "text", n.cast("long").alias("n_chars"), edited.alias("edited"))
    prints = pairs.select("doc_id", "part", "rank", "tie", "n_chars", sha256_hex(F.col("edited")).alias("edited_sha256"), fingerprint(F.col("text"), words).alias("fingerprint"), fingerprint(F.col("edited"), words).alias("edited_fingerprint"))
    out = _next(checkpoint(prints), "fingerprint", firsts)
    near = lambda other: likeness(F.col("fingerprint"), F.col(other))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near("edited_fingerprint").alias("near_edited"), near("next_fingerprint").alias("near_next"))
