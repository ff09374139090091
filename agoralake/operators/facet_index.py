"""A facet index of bitmaps: selections, hits and counts without reading the rows again.

For each value of an axis and each bucket of 32,768 ids the index holds one bitmap of the
rows that have the value; one more axis, EVERY, holds all rows.  A selection takes the union
of an axis's chosen values and the intersection over axes, bucket by bucket; hits and counts
are counts of bits.  Building is one pass and one aggregate; a value of most rows is as many
groups as there are buckets.  Ids are whole numbers, one for each row; rows without an
id are in no bitmap.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .facets import message_of, values_of

EVERY = ""
BITS, BYTES = 15, 1 << 12


def build(df: DataFrame, axes: list[str], id_col: str) -> DataFrame:
    """(axis, value, bucket, bits) of a table's axes (scalars or arrays; nulls are no values)."""
    pair = lambda axis, value: F.struct(F.lit(axis).alias("axis"), value.cast("string").alias("value"))
    pairs_of = lambda axis: F.transform(F.array_distinct(F.array_compact(values_of(df, axis))), lambda v: pair(axis, v))
    i = F.col(id_col).cast("long")
    each = df.where(i.isNotNull()).select(i.alias("id"), F.explode(F.concat(F.array(pair(EVERY, F.lit(""))), *map(pairs_of, axes))).alias("p"))
    grouped = each.groupBy("p.axis", "p.value", F.shiftright("id", BITS).alias("bucket"))
    return grouped.agg(F.bitmap_construct_agg(F.col("id").bitwiseAND(F.lit((1 << BITS) - 1))).alias("bits"))


def write_index(index: DataFrame, path: str) -> None:
    """A file folder for each axis, so that a selection opens those of its axes only."""
    index.write.partitionBy("axis").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    # the axis of all rows has no name, which a folder's name can't tell from null
    return spark.read.schema("value string, bucket bigint, bits binary, axis string").parquet(path).withColumn("axis", F.coalesce("axis", F.lit(EVERY))).select("axis", "value", "bucket", "bits")


def select(index: DataFrame, selection: dict[str, list]) -> DataFrame:
    """(bucket, bits) of the rows that have, on every axis with chosen values, one of them."""
    chosen = {a: [str(v) for v in values] for a, values in selection.items() if values} or {EVERY: [""]}
    wanted = reduce(lambda x, y: x | y, [(F.col("axis") == a) & F.col("value").isin(*v) for a, v in chosen.items()])
    union = index.where(wanted).groupBy("bucket", "axis").agg(F.bitmap_or_agg("bits").alias("bits"))
    both = union.groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("axes"))
    return both.where(F.col("axes") == len(chosen)).select("bucket", "bits")


def _positions(bits: Column) -> Column:
    """array<int>: the places of the bits that are set."""
    byte = lambda k: F.substring(bits, k + 1, F.lit(1))
    some = F.filter(F.sequence(F.lit(0), F.lit(BYTES - 1)), lambda k: byte(k) != F.lit(b"\x00"))

    def of_byte(k: Column) -> Column:
        value = F.conv(F.hex(byte(k)), 16, 10).cast("int")
        return F.transform(F.filter(F.sequence(F.lit(0), F.lit(7)), lambda b: F.getbit(value, b) == 1), lambda b: k * 8 + b)

    return F.flatten(F.transform(some, of_byte))


def ids(selected: DataFrame) -> DataFrame:
    """(id) of the rows of a selection; a task meets one bucket at a time."""
    return selected.select("bucket", F.explode(_positions(F.col("bits"))).alias("at")).select((F.shiftleft("bucket", BITS) + F.col("at")).alias("id"))


def hits(index: DataFrame, selection: dict[str, list]) -> DataFrame:
    """One row: (hits, total)."""
    count = lambda df, name: df.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias(name))
    return count(select(index, selection), "hits").join(count(select(index, {}), "total"))


def counts(index: DataFrame, axes: list[str]) -> DataFrame:
    """(axis, value, n) over all rows, whatever is selected."""
    return index.where(F.col("axis").isin(*axes)).groupBy("axis", "value").agg(F.sum(F.bitmap_count("bits")).alias("n"))


def counts_within(index: DataFrame, axes: list[str], selection: dict[str, list]) -> DataFrame:
    """(axis, value, n) of the selected rows alone; values of none of them are left out."""
    own = select(index, selection).withColumnRenamed("bits", "selected")
    both = index.where(F.col("axis").isin(*axes)).join(own, "bucket").select("axis", "value", "bucket", F.explode(F.array("bits", "selected")).alias("bits"))
    return both.groupBy("axis", "value", "bucket").agg(F.bitmap_and_agg("bits").alias("bits")).groupBy("axis", "value").agg(F.sum(F.bitmap_count("bits")).alias("n")).where("n > 0")


def cardinalities(index: DataFrame, axes: list[str]) -> DataFrame:
    """(axis, values): how many values each axis has; 0 for one without any."""
    names = F.explode(F.array(*map(F.lit, axes)))
    found = index.where(F.col("axis").isin(*axes)).groupBy("axis").agg(F.count_distinct("value").alias("values"))
    return index.sparkSession.range(1).select(names.alias("axis")).join(found, "axis", "left").select("axis", F.coalesce("values", F.lit(0)).cast("long").alias("values"))


def message(index: DataFrame, selection: dict[str, list]) -> DataFrame:
    """The lines above the results, as facets.message has them."""
    return message_of(hits(index, selection), any(selection.values()))
