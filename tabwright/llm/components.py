"""Connected components of a link table, as alternating star steps.

Each round hangs every node below the smallest node it knows (large star), then joins what hung below one
node to the smallest of them (small star). The rounds needed grow with the logarithm of a component's
size. Links stay in distributed tables; the driver sees one checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.scratch import Scratch


def _checksum(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(links: DataFrame, scratch: Scratch) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # A stored table of minima lets Spark split a hot node's links in the join.
    least = scratch.table(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "star-minima")
    out = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    stored = scratch.table(out.distinct(), "star-large")
    scratch.drop(least)
    return stored


def _small_star(links: DataFrame, scratch: Scratch) -> DataFrame:
    least = scratch.table(links.groupBy("u").agg(F.min("v").alias("m")), "star-minima")
    met = links.join(least, "u")
    out = met.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
        least.select("u", F.col("m").alias("v"))
    )
    stored = scratch.table(out.distinct(), "star-small")
    scratch.drop(least)
    return stored


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``node``, ``root`` for every node with a link except the roots themselves; a root is its component's smallest.

    ``links`` has columns ``a`` and ``b`` of one orderable type; loops and repeats do no harm, no links give no rows.
    """
    now = scratch.table(
        links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    before = _checksum(now)
    while before[0]:
        large = _large_star(now, scratch)
        small = _small_star(large, scratch)
        scratch.drop(now, large)
        now, after = small, _checksum(small)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
