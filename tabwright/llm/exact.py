"""Exact duplicates through an extendible-hash index kept in shared files, with DataFrame operations only.

The index maps the 64-bit hash of a text to a bucket. Buckets hold at most ``capacity`` keys: while one is overfull,
the directory doubles and that bucket splits by one more bit of the key, the others are just pointed to twice.
The index file is dealt to owner tasks by ranges of the key. Texts under one key form a chain; its members are told
apart by grouping on the bytes of the texts themselves, so a collision never merges different texts. Only texts
whose key occurs more than once take part in that.

Copies are counted before the shuffle, and joins with a hot key can be split, so a text that holds a third of all
rows stays harmless.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.scratch import Scratch, broadcast_if_small, numbered, rows_of

#: Keys that occur more than once, up to which they are sent to the texts; beyond, texts are shuffled by key.
_BROADCAST_KEYS = 500_000


@dataclass
class HashIndex:
    """``directory``: slot, bucket, depth; ``buckets``: bucket, key, n, sorted by key within ranges of the slot."""

    directory: DataFrame
    buckets: DataFrame
    depth: int


def _prefix(key: Column, depth: int) -> Column:
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def text_key(text: Column, bits: int = 64) -> Column:
    """The leading ``bits`` of the text's hash, as a long."""
    h = F.xxhash64(text)
    return h if bits == 64 else F.shiftleft(F.shiftrightunsigned(h, 64 - bits), 64 - bits)


def build_index(keys: DataFrame, scratch: Scratch, capacity: int = 4096, bits: int = 64) -> HashIndex:
    """Index over distinct ``key`` with counts ``n``.

    The directory starts at the depth at which buckets are about full; keys that agree in all ``bits`` share a bucket
    however many they are (they are one key). An empty table gives an empty index.
    """
    depth = first = min(bits, max(0, math.ceil(math.log2(max(keys.count(), 1) / capacity))))
    pending, levels = keys.select("key"), []
    while True:
        sizes = scratch.table(pending.groupBy(_prefix(F.col("key"), depth).alias("bucket")).count(), "index-sizes")
        levels.append((depth, sizes))
        overfull = sizes.where(F.col("count") > capacity)
        if depth == bits or overfull.isEmpty():
            break
        pending = pending.join(overfull.select("bucket"), _prefix(F.col("key"), depth) == F.col("bucket"), "left_semi")
        depth += 1
    slots = None
    for d, sizes in levels:
        leaves = sizes if d == depth else sizes.where(F.col("count") <= capacity)
        start = F.shiftleft(F.col("bucket"), depth - d)
        part = leaves.select(
            F.explode(F.sequence(start, start + F.lit((1 << (depth - d)) - 1))).alias("slot"),
            F.concat_ws("/", F.lit(d), F.col("bucket")).alias("bucket"),
            F.lit(d).alias("depth"),
        )
        slots = part if slots is None else slots.union(part)
    directory = scratch.table(slots, "index-directory")
    placed = keys.withColumn("slot", _prefix(F.col("key"), depth)).join(directory, "slot")
    buckets = scratch.table(
        placed.repartitionByRange("slot", "key").sortWithinPartitions("slot", "key").select("bucket", "key", "n"), "index-buckets"
    )
    scratch.drop(*(s for _, s in levels))
    return HashIndex(directory, buckets, depth)


def exact_duplicates(docs: DataFrame, uid: str | None = None, capacity: int = 4096, bits: int = 64) -> DataFrame:
    """One row per document: uid, doc_id, keep_id, group_size, kept, text_sha256.

    Texts are compared as they are; NULL counts as empty. Of equal texts the row with the largest doc_id stays; of
    repeated rows with that doc_id the first. NULL doc_ids lose against any other; a group of NULLs has a NULL keep_id and
    keeps its first row. An empty table gives no rows. Extra columns are ignored. ``bits`` below 64 make keys
    collide, which only tests need.
    """
    scratch = Scratch(docs.sparkSession)
    rows = rows_of(docs, uid)
    entries = scratch.table(
        rows.select(
            "uid", "doc_id", text_key(F.col("text"), bits).alias("key"), F.unhex(F.sha2("text", 256)).alias("sha")
        ),
        "exact-entries",
    )
    keys = scratch.table(entries.groupBy("key").agg(F.count("*").alias("n")), "exact-keys")
    index = build_index(keys, scratch, capacity, bits)
    scratch.drop(keys)

    chained = index.buckets.where("n > 1").select("bucket", "key")
    texts = rows.select("doc_id", "text", text_key(F.col("text"), bits).alias("key")).join(
        broadcast_if_small(chained, chained.count(), _BROADCAST_KEYS), "key"
    )
    chain = scratch.table(
        texts.groupBy("bucket", "key", "text")
        .agg(F.count("*").alias("n"), F.max("doc_id").alias("keep"))
        .select("key", F.unhex(F.sha2("text", 256)).alias("sha"), "n", "keep"),
        "exact-chains",
    )
    owners = entries.join(chain, ["key", "sha"]).where("doc_id <=> keep")
    first = scratch.table(owners.groupBy("key", "sha").agg(F.min("uid").alias("first")), "exact-first")
    settled = scratch.table(chain.join(first, ["key", "sha"]), "exact-settled")
    scratch.drop(chain, first)
    met = entries.join(settled, ["key", "sha"], "left")
    return met.select(
        "uid",
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("first").isNull() | (F.col("first") == F.col("uid"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The documents whose row stays, with all their columns."""
    scratch = Scratch(docs.sparkSession)
    rows, uid = numbered(docs, scratch, "exact-docs")
    gone = scratch.table(exact_duplicates(rows, uid).where("not kept").select(F.col("uid").alias(uid)), "exact-gone")
    return rows.join(broadcast_if_small(gone, gone.count(), _BROADCAST_KEYS), uid, "left_anti").select(*docs.columns)
