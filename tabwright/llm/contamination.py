"""Benchmark items found inside documents by size-partitioned MinHash containment, verified exactly.

A document contains an item if it has at least ``threshold`` of the item's distinct word shingles. Items are partitioned by
their number of shingles into classes (1, 2-3, 4-7, ...). An item's sketch holds its smallest shingle hashes; how many is set by
its class: more than a containing document may lack, counted for the largest size of the class. So a containing
document shows at least one of them however long it is, and nothing is lost, while most documents show none. Those that show
enough of a sketch are compared by the shingles themselves.

The items are a stated query set: they are sent to the tasks in blocks of at most ``block_bytes`` of text, one pass over the
documents per block.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.memory import released
from tabwright.llm.words import WordHashes, shingle_hashes

#: ASCII punctuation separates words like white space does.
_SPACED = bytes(b if b > 126 or chr(b).isalnum() or b < 9 or 13 < b < 32 else 32 for b in range(256))
_BITS = 20


def plain_words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPACED).split()


def distinct_shingles(ws: list[bytes], width: int) -> set[bytes]:
    if len(ws) < width:
        return {b" ".join(ws)} if ws else set()
    return set(map(b" ".join, zip(*(ws[i:] for i in range(width)))))


def required(size: int, threshold: float) -> int:
    """How many of an item's shingles a containing document has at least."""
    return max(1, math.ceil(threshold * size - 1e-9))


def sketch_size(size: int, threshold: float) -> int:
    """Enough for every item of the size class, so that a containing document shows at least one."""
    largest = (1 << size.bit_length()) - 1
    return min(size, largest - required(largest, threshold) + 1)


class ItemIndex:
    """Sketches of a block of items, looked up by hash, and the items' shingles for the exact comparison."""

    def __init__(self, items: list[tuple], width: int, threshold: float):
        self.width, self.threshold, self.known = width, threshold, WordHashes()
        self.items = []
        holders = defaultdict(list)
        for item_id, text in items:
            ws = plain_words(text)
            grams = distinct_shingles(ws, width)
            if not grams:
                continue
            hashes = np.unique(shingle_hashes(ws, width, self.known))
            k = sketch_size(len(grams), threshold)
            for h in hashes[:k].tolist():
                holders[h].append(len(self.items))
            # Hash collisions within an item would shorten its sketch; one hit always suffices then.
            need = k - (len(grams) - required(len(grams), threshold)) if len(hashes) == len(grams) else 1
            self.items.append((item_id, grams, max(1, need)))
        self.holders = dict(holders)
        self.maybe = np.zeros(1 << _BITS, bool)
        if holders:
            self.maybe[np.fromiter(holders, np.uint64) & np.uint64((1 << _BITS) - 1)] = True

    def contained(self, text: str | None) -> list[tuple[object, int, int]]:
        """(item_id, shared shingles, the item's shingles) of every item that the text contains."""
        ws = plain_words(text)
        hashes = shingle_hashes(ws, self.width, self.known)
        hashes = hashes[self.maybe[hashes & np.uint64((1 << _BITS) - 1)]]
        seen = Counter(i for h in set(hashes.tolist()) if h in self.holders for i in self.holders[h])
        near = [i for i, n in seen.items() if n >= self.items[i][2]]
        if not near:
            return []
        grams = distinct_shingles(ws, self.width)
        out = []
        for i in sorted(near):
            item_id, own, _ = self.items[i]
            shared = len(own & grams)
            if shared >= required(len(own), self.threshold):
                out.append((item_id, shared, len(own)))
        return out


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple]]:
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, math.ceil(size / block_bytes))
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else rows
        yield sorted(tuple(r) for r in part.collect())


def contaminated(
    docs: DataFrame, items: DataFrame, width: int = 5, threshold: float = 0.8, block_bytes: int = 8_000_000
) -> DataFrame:
    """One row per document and contained item: doc_id, item_id, shared, item_size, containment.

    Words are lower-cased, ASCII punctuation separates them. Items of fewer than ``width`` words are found only as whole
    documents. Texts that are NULL or have no words contain nothing and are contained in nothing; items without item_id are
    ignored. Repeated documents give repeated rows. Extra columns are ignored.
    """
    out = None
    for block in _blocks(items, block_bytes):

        def search(batches, block=block):
            index = ItemIndex(block, width, threshold)
            for b in batches:
                hits = [(d, *hit) for d, t in zip(b.column(0).to_pylist(), b.column(1)) for hit in index.contained(t.as_py())]
                columns = list(zip(*hits)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "shared", "item_size"])

        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
            released(search), "doc_id long, item_id long, shared long, item_size long"
        )
        out = found if out is None else out.union(found)
    return out.withColumn("containment", F.col("shared") / F.col("item_size"))


def drop_contaminated(
    docs: DataFrame, items: DataFrame, width: int = 5, threshold: float = 0.8, block_bytes: int = 8_000_000
) -> DataFrame:
    """The documents that contain no item, with all their columns, without a shuffle."""
    at = docs.columns.index("text")
    for block in _blocks(items, block_bytes):

        def clean(batches, block=block):
            index = ItemIndex(block, width, threshold)
            for b in batches:
                yield b.filter(pa.array([not index.contained(t.as_py()) for t in b.column(at)], pa.bool_()))

        docs = docs.mapInArrow(released(clean), docs.schema)
    return docs
