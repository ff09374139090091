"""Connected components of a links table by alternating stars.

Each round turns every node's links to its smallest neighbour, first from its
larger neighbours (large star), then from its smaller ones (small star), until
each component is one star around its smallest node.  Smallest neighbours are
aggregates with partial sums before the shuffle, and they meet the links in plain
joins, which Spark splits where one node holds many of them.  Every round is
written to the shared checkpoint folder; nothing but two numbers reaches the driver.
A round has a task for each ``LINKS`` links, so that small tables, of which a round
makes many, are not dealt over all shuffle partitions where Spark is told to keep these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import checkpoint, freed

LINKS = 1 << 14


def _mirror(links: DataFrame) -> DataFrame:
    return links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def _gathered(links: DataFrame, tasks: int) -> DataFrame:
    """The links without repetition, in so many tasks at most."""
    return links.coalesce(tasks).distinct().coalesce(tasks)


def _large_star(links: DataFrame) -> DataFrame:
    both = _mirror(links)
    return both.join(_least(both), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v"))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for each node of links (u, v: same ordered type); component is its smallest node.

    Loops (u = v), nulls and repeated links are ignored; without links the result is empty.
    """
    now = checkpoint(links.select("u", "v").where(F.col("u") != F.col("v")).distinct())
    before = None
    for _ in range(rounds):
        state = freed(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))).collect()[0]
        if tuple(state) == before or not state[0]:
            break
        before = tuple(state)
        tasks = -(-state[0] // LINKS)
        now = checkpoint(_gathered(_small_star(_gathered(_large_star(now.coalesce(tasks)), tasks)), tasks))
    else:
        raise RuntimeError(f"components: not done after {rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
