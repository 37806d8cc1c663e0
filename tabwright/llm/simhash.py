"""SimHash near-duplicates found with BK-trees.

Fingerprints of 64 bits are dealt to shards: the bits are cut into ``radius + 2`` blocks, and a shard holds
the fingerprints that agree in two of them. Two fingerprints at most ``radius`` bits apart agree in at least two
blocks, so they meet in a shard. Of each shard a BK-tree is built (children keyed by their Hamming distance to the
parent) and searched by following only the edges within the radius. Shards above ``tree_size`` are cut into
several trees, and each tree is sent to every block of the shard's fingerprints, so no task holds more than two
such blocks. A block returns one link per member (a spanning forest), never all pairs.

Equal fingerprints count once, so a group of exact copies of any size is one node.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.components import components
from tabwright.llm.scratch import Scratch, broadcast_if_small, numbered, rows_of
from tabwright.llm.words import shingles, words

SEED = 42
#: Dropped rows whose numbers may be broadcast to leave their texts out.
_BROADCAST_ROWS = 500_000
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_BYTE_BASE = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned fingerprint of the lower-cased text's shingles; 0 without words."""
    grams = shingles(words(text, lower=True), width)
    if not grams:
        return 0
    h = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), grams), np.uint64, len(grams))
    # Counting byte values first is cheaper than counting 64 bits for every shingle.
    seen = np.bincount((h.view(np.uint8).reshape(-1, 8) + _BYTE_BASE).ravel(), minlength=2048).reshape(8, 256)
    bits = (seen @ _BYTE_BITS).ravel() * 2 > len(grams)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = np.fromiter((fingerprint(t.as_py(), width) for t in b.column(2)), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(prints.view(np.int64))], ["uid", "doc_id", "fp"])


def fingerprints(docs: DataFrame, uid: str | None = None, width: int = 3) -> DataFrame:
    """uid, doc_id and the fingerprint (as a signed long) of every row."""
    return rows_of(docs, uid).mapInArrow(
        lambda batches: _fingerprint_batches(batches, width), "uid long, doc_id long, fp long"
    )


class BKTree:
    """Integers under Hamming distance; a child hangs below its parent at the key of their distance."""

    def __init__(self, radius: int):
        self.radius, self.values, self.children = radius, [], []

    def add(self, value: int) -> int:
        at, new = 0, len(self.values)
        self.values.append(value)
        self.children.append({})
        while new:
            d = (self.values[at] ^ value).bit_count()
            nxt = self.children[at].setdefault(d, new)
            if nxt == new:
                break
            at = nxt
        return new

    def near(self, value: int) -> list[int]:
        """Places of all members within the radius."""
        found, todo, r = [], [0] if self.values else [], self.radius
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= r:
                found.append(at)
            kids = self.children[at]
            if kids:
                todo.extend(kids[e] for e in range(d - r, d + r + 1) if e in kids)
        return found


def _forest(tree_side: list[int], query_side: list[int] | None, radius: int) -> list[tuple[int, int]]:
    """Links that join all members within reach of each other; without a query side, the tree's members among themselves."""
    tree, members = BKTree(radius), list(tree_side)
    parent = list(range(len(tree_side) + len(query_side or ())))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    if query_side is None:
        for i, v in enumerate(tree_side):
            for j in tree.near(v):
                parent[top(i)] = top(j)
            tree.add(v)
    else:
        for v in tree_side:
            tree.add(v)
        for i, v in enumerate(query_side, len(tree_side)):
            for j in tree.near(v):
                parent[top(i)] = top(j)
        members += query_side
    return [(members[i], members[t]) for i in range(len(parent)) if (t := top(i)) != i]


def _link_blocks(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block; only the block at hand is held."""
    key, left, right = None, [], []

    def links() -> list[tuple[int, int]]:
        if key is None or key[1] != key[2] and not (left and right):
            return []
        return _forest(left, right if key[1] != key[2] else None, radius)

    def packed(found: list[tuple[int, int]]) -> pa.RecordBatch:
        pairs = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    out: list[tuple[int, int]] = []
    for b in batches:
        prints = b.column(4).to_numpy(zero_copy_only=False).view(np.uint64).tolist()
        for shard, i, j, chunk, fp in zip(*(b.column(c).to_pylist() for c in range(4)), prints):
            if (shard, i, j) != key:
                out += links()
                key, left, right = (shard, i, j), [], []
                if len(out) > 50_000:
                    yield packed(out)
                    out = []
            (left if chunk == i else right).append(fp)
    out += links()
    yield packed(out)


def _shard_keys(fp: Column, radius: int) -> Column:
    """One number per pair of blocks, made of the pair and the bits in both."""
    n = radius + 2
    cuts = [64 * k // n for k in range(n + 1)]
    part = [F.shiftrightunsigned(fp, cuts[k]).bitwiseAND((1 << (cuts[k + 1] - cuts[k])) - 1) for k in range(n)]
    width = [cuts[k + 1] - cuts[k] for k in range(n)]
    keys = [
        F.shiftleft(F.lit(t).cast("long"), 54).bitwiseOR(F.shiftleft(part[a], width[b])).bitwiseOR(part[b])
        for t, (a, b) in enumerate(combinations(range(n), 2))
    ]
    return F.array(*keys)


def near_links(prints: DataFrame, scratch: Scratch, radius: int = 3, tree_size: int = 1024) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints (column ``fp``) whose closure joins all within ``radius`` bits."""
    if not 1 <= radius <= 8:
        raise ValueError("radius must lie between 1 and 8")
    shards = prints.select("fp", F.explode(_shard_keys(F.col("fp"), radius)).alias("shard"))
    crowded = scratch.table(shards.groupBy("shard").count().where("count > 1"), "simhash-shards")
    members = shards.join(crowded, "shard").select(
        "shard", "fp", F.ceil(F.col("count") / tree_size).cast("int").alias("trees")
    )
    members = members.withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("trees")).cast("int"))
    blocks = members.select(
        "shard", "chunk", "fp", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("other")
    ).select("shard", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "fp")
    dealt = blocks.repartition("shard", "i", "j").sortWithinPartitions("shard", "i", "j")
    return dealt.mapInArrow(lambda batches: _link_blocks(batches, radius), "a long, b long")


def near_duplicates(
    docs: DataFrame, uid: str | None = None, width: int = 3, radius: int = 3, tree_size: int = 1024
) -> DataFrame:
    """One row per document: uid, doc_id, fp, component_id (smallest doc_id reachable over links).

    A NULL or wordless text has fingerprint 0 and is linked like any other. NULL doc_ids take part; a component
    without any doc_id has a NULL component_id. Repeated rows come out repeated. An empty table gives no rows.
    Extra columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.table(fingerprints(docs, uid, width), "simhash-rows")
    prints = scratch.table(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-prints")
    found = components(near_links(prints.select("fp"), scratch, radius, tree_size), scratch)
    rooted = prints.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_print = scratch.table(rooted.join(least, "root").select("fp", "component_id", "root"), "simhash-components")
    return rows.join(of_print, "fp").select("uid", "doc_id", "fp", "component_id", "root")


def drop_near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """The documents with one of each near-duplicate group: the one with the smallest doc_id, the first of repeated rows.

    All columns stay. A group without any doc_id keeps its first row.
    """
    scratch = Scratch(docs.sparkSession)
    rows, uid = numbered(docs, scratch, "simhash-docs")
    found = scratch.table(near_duplicates(rows, uid, width, radius), "simhash-found")
    keep = scratch.table(found.where("doc_id <=> component_id").groupBy("root").agg(F.min("uid").alias("uid")), "simhash-kept")
    gone = scratch.table(found.select(F.col("uid").alias(uid)).join(keep.select(F.col("uid").alias(uid)), uid, "left_anti"), "simhash-gone")
    scratch.drop(found, keep)
    return rows.join(broadcast_if_small(gone, gone.count(), _BROADCAST_ROWS), uid, "left_anti").select(*docs.columns)
