"""Ranked lexical search: the best documents of every item, through blocked posting lists with exact bounds.

Index. The items are a stated query set, taken in blocks of bounded size. One scan counts each document's terms and how often it has the
terms of the block; the counts of all documents give the weights. Documents are then dealt into shards of bounded size. Within a shard
every term has a posting list, and each list is cut geometrically: its documents are clustered around members spread
over the list by the similarity of their weighted term vectors (through a random projection), and a block is a run of one cluster.
A block stores its summary, the coordinatewise maximum over its documents' vectors, in all terms that an item has beside the list's own.
Shards are stored as a table.

Search. Per shard and item the lists go from the largest bound down. A block whose summary gives less than the score of the k-th best
document so far is skipped, the documents of the others are scored in full; lists stop counting when those left can't reach that score together.
A bound is a sum of maxima in the same integers as the scores, so nothing is ever skipped wrongly, equal scores included. Each task sends its k
best documents per item, and these are ranked.
"""

from __future__ import annotations

import io
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabwright.llm.memory import released
from tabwright.llm.scratch import Scratch

#: ASCII letters lower-cased, other ASCII but digits as blanks; bytes of other characters stay.
_TERMS = bytes(b if b > 127 or chr(b).isalnum() and not 65 <= b <= 90 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: Documents of one block of a posting list, blocks of one list, documents of a shard.
BLOCK, MOST_BLOCKS, SHARD = 64, 24, 8192
_DIMENSIONS = 16
#: Vector entries or summary places that are worked on at once while an index is built.
_AT_ONCE = 1_000_000
_LAST = np.iinfo(np.int64).max


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and characters beyond ASCII; only A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERMS).split()


@dataclass
class Items:
    """A block of items: ids, each item's term numbers and how often it has them, and the numbers of the terms."""

    ids: list
    numbers: list[np.ndarray]
    repeats: list[np.ndarray]
    vocabulary: dict[bytes, int]


def item_block(rows: list[tuple]) -> Items:
    vocabulary: dict[bytes, int] = {}
    ids, numbers, repeats = [], [], []
    for item_id, text in rows:
        counted = Counter(terms(text))
        if counted:
            ids.append(item_id)
            numbers.append(np.array([vocabulary.setdefault(t, len(vocabulary)) for t in counted], np.int64))
            repeats.append(np.array(list(counted.values()), np.int64))
    return Items(ids, numbers, repeats, vocabulary)


def item_blocks(items: DataFrame, per_block: int, block_bytes: int) -> Iterator[Items]:
    """The distinct items, at most about ``per_block`` and ``block_bytes`` of text at a time."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL").distinct()
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, math.ceil(n / per_block), math.ceil(size / block_bytes))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for k in range(blocks):
        yield item_block(sorted(map(tuple, (rows.where(part == k) if blocks > 1 else rows).collect()), key=repr))


def _counted(batches: Iterator[pa.RecordBatch], vocabulary: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """doc_id, number of terms, and the vocabulary's terms with their counts."""
    for b in batches:
        sizes, numbers, counts = [], [], []
        for text in b.column(1):
            found = terms(text.as_py())
            met = Counter(map(vocabulary.get, found))
            met.pop(None, None)
            sizes.append(len(found))
            numbers.append(list(met))
            counts.append(list(met.values()))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(sizes, pa.int64()), pa.array(numbers, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))],
            ["doc_id", "n", "terms", "tf"],
        )


@dataclass
class Weights:
    """Counts over all documents: how many have terms, their terms in all, and per term number its weight."""

    n_docs: int
    n_terms: int
    term: np.ndarray

    def saturated(self, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What a term with ``tf`` occurrences in a document of ``n`` terms counts, before its weight."""
        m = 75 + (25 * n * self.n_docs) // self.n_terms
        return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def weights_of(counted: DataFrame, size: int) -> Weights:
    n_docs, n_terms = counted.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequency = dict(map(tuple, counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect()))  # one row per term of the items
    return Weights(
        n_docs, n_terms, np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * frequency.get(t, 0) + 1))) for t in range(size)], np.int64)
    )


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of the given ranges, one range after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


class Shard:
    """Documents with their vectors over the items' terms, posting lists cut into blocks, and the blocks' summaries.

    ``doc_ids``; ``at``/``term``/``value``: vectors by document; ``lists``: first block per term; ``blocks``: first posting per block;
    ``posts``: documents; ``sums``/``sum_term``/``sum_value``: summaries by block; ``peaks``: largest value per term.
    """

    PARTS = ("doc_ids", "at", "term", "value", "lists", "blocks", "posts", "sums", "sum_term", "sum_value", "peaks")

    def __init__(self, **parts: np.ndarray):
        for name in self.PARTS:
            setattr(self, name, parts[name])

    def image(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{name: getattr(self, name) for name in self.PARTS})
        return zstandard.compress(out.getvalue(), 1)

    @classmethod
    def opened(cls, image: bytes) -> Shard:
        return cls(**np.load(io.BytesIO(zstandard.decompress(image))))

    @classmethod
    def build(cls, doc_ids: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, term: np.ndarray, tf: np.ndarray, weights: Weights, together: np.ndarray) -> Shard:
        """``term`` and ``tf`` hold ``lengths`` entries per document; ``together[t]`` marks the terms that some item has beside ``t``."""
        n_terms = len(weights.term)
        value = weights.saturated(tf, np.repeat(sizes, lengths))
        useful = (weights.term[term] > 0) & (value > 0)
        doc = np.repeat(np.arange(len(doc_ids), dtype=np.int32), lengths)[useful]
        term, value = term[useful].astype(np.int32), value[useful].astype(np.int32)  # values stay below 1,000,000
        at = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(doc_ids)))])
        places = cls._places(at, term, weights.term[term] * value, n_terms)
        by_term = np.argsort(term, kind="stable")
        first = np.searchsorted(term[by_term], np.arange(n_terms + 1))
        lists, blocks, posts = [0], [], []
        for t in range(n_terms):
            docs = doc[by_term[first[t] : first[t + 1]]]
            if len(docs):
                docs, starts = cls._cut(docs, places)
                blocks.extend((first[t] + starts).tolist())
                posts.append(docs)
            lists.append(len(blocks))
        posts, blocks, lists = np.concatenate([np.empty(0, np.int32), *posts]), np.array([*blocks, len(posts) and first[-1]], np.int64), np.array(lists)
        sums, sum_term, sum_value = cls._summaries(blocks, np.repeat(np.arange(n_terms), np.diff(lists)), posts, at, term, value, together)
        peaks = np.zeros(n_terms, np.int64)
        np.maximum.at(peaks, term, value)
        return cls(doc_ids=doc_ids, at=at, term=term, value=value, lists=lists, blocks=blocks, posts=posts, sums=sums, sum_term=sum_term, sum_value=sum_value, peaks=peaks)

    @staticmethod
    def _places(at: np.ndarray, term: np.ndarray, strength: np.ndarray, n_terms: int) -> np.ndarray:
        """Every document's weighted vector in a few random directions, of length 1."""
        directions = np.random.default_rng(7).standard_normal((n_terms, _DIMENSIONS)).astype(np.float32)
        places, filled = np.zeros((len(at) - 1, _DIMENSIONS), np.float32), np.flatnonzero(np.diff(at))
        if len(filled):
            for d in range(_DIMENSIONS):
                places[filled, d] = np.add.reduceat(directions[term, d] * strength.astype(np.float32), at[filled])
        return places / np.maximum(np.linalg.norm(places, axis=1, keepdims=True), 1e-9)

    @staticmethod
    def _cut(docs: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A list's documents by cluster, and where its blocks begin."""
        n = min(MOST_BLOCKS, -(-len(docs) // BLOCK))
        if n == 1:
            return docs, np.zeros(1, np.int64)
        centres = places[docs[np.arange(n) * len(docs) // n]]
        nearest = np.argmax(places[docs] @ centres.T, axis=1)
        sizes = np.bincount(nearest, minlength=n)
        largest = max(BLOCK, -(-len(docs) // MOST_BLOCKS))
        within = np.arange(len(docs)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return docs[np.argsort(nearest, kind="stable")], np.flatnonzero(within % largest == 0)

    @staticmethod
    def _summaries(blocks: np.ndarray, list_of: np.ndarray, posts: np.ndarray, at: np.ndarray, term: np.ndarray, value: np.ndarray, together: np.ndarray):
        """Per block the maximum of each coordinate that an item with the list's term asks for, a few MB of blocks at a time."""
        n_blocks, n_terms = len(blocks) - 1, len(together)
        lengths = np.diff(at)[posts]
        entries = np.concatenate([[0], np.cumsum(lengths)])[blocks]
        sizes, out_term, out_value, low = np.zeros(n_blocks, np.int64), [np.empty(0, np.int32)], [np.empty(0, np.int32)], 0
        while low < n_blocks:
            high = min(low + max(1, _AT_ONCE // n_terms), max(low + 1, int(np.searchsorted(entries, entries[low] + _AT_ONCE, "right")) - 1), n_blocks)
            p, q = blocks[low], blocks[high]
            rows = _spread(at[posts[p:q]], lengths[p:q])
            dense = np.zeros((high - low) * n_terms, np.int32)
            block = np.repeat(np.arange(high - low) * n_terms, np.diff(entries[low : high + 1]))
            np.maximum.at(dense, block + term[rows], value[rows])
            dense = np.where(together[list_of[low:high]], dense.reshape(high - low, n_terms), 0)
            of, met = np.nonzero(dense)
            sizes[low:high] = np.bincount(of, minlength=high - low)
            out_term.append(met.astype(np.int32))
            out_value.append(dense[of, met])
            low = high
        return np.concatenate([[0], np.cumsum(sizes)]), np.concatenate(out_term), np.concatenate(out_value)

    def bounds(self, t: int, wanted: np.ndarray) -> np.ndarray:
        """Per block of a term's list the most that one of its documents can score; ``wanted`` weighs the item's terms."""
        low, high = self.lists[t], self.lists[t + 1]
        a, b = self.sums[low], self.sums[high]
        return np.add.reduceat(self.sum_value[a:b] * wanted[self.sum_term[a:b]], self.sums[low:high] - a)

    def scores(self, docs: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        lengths = self.at[docs + 1] - self.at[docs]
        rows = _spread(self.at[docs], lengths)
        return np.add.reduceat(self.value[rows] * wanted[self.term[rows]], np.cumsum(lengths) - lengths)

    def search(self, numbers: np.ndarray, wanted: np.ndarray, best: Best) -> int:
        """Put the documents that may be among the item's best into ``best``; returns how many were scored."""
        peaks = self.peaks[numbers] * wanted[numbers]
        order = np.argsort(-peaks, kind="stable")
        rest, seen = int(peaks.sum()), np.zeros(len(self.doc_ids), bool)
        for peak, t in zip(peaks[order].tolist(), numbers[order].tolist()):
            if rest < best.least or not peak:
                break
            rest -= peak
            bounds = self.bounds(t, wanted)
            by_bound = np.argsort(-bounds, kind="stable")
            done, step = 0, 1
            while done < len(by_bound) and bounds[by_bound[done]] >= best.least:
                some = by_bound[done : done + step]
                some = some[bounds[some] >= best.least] + self.lists[t]
                docs = self.posts[_spread(self.blocks[some], self.blocks[some + 1] - self.blocks[some])]
                docs = docs[~seen[docs]]
                seen[docs] = True
                if len(docs):
                    best.add(self.scores(docs, wanted), self.doc_ids[docs])
                done, step = done + step, 2 * step
        return int(np.count_nonzero(seen))


class Best:
    """The k best documents so far: highest scores, equal ones by ascending doc_id."""

    def __init__(self, k: int):
        self.k, self.score, self.doc = k, np.empty(0, np.int64), np.empty(0, np.int64)

    @property
    def least(self) -> int:
        """A document below this score is not among the best."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        at = score >= self.least
        score, doc = np.concatenate([self.score, score[at]]), np.concatenate([self.doc, doc[at]])
        order = np.lexsort((doc, -score))[: self.k]
        self.score, self.doc = score[order], doc[order]


def _shards(batches: Iterator[pa.RecordBatch], weights: Weights, items: Items) -> Iterator[pa.RecordBatch]:
    together = np.zeros((len(weights.term), len(weights.term)), bool)
    for numbers in items.numbers:
        together[np.ix_(numbers, numbers)] = True
    held, rows = [], 0

    def stored() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        doc_id, n, terms, tf = (table.column(c).combine_chunks() for c in ("doc_id", "n", "terms", "tf"))
        shard = Shard.build(
            doc_id.fill_null(_LAST).to_numpy(), n.to_numpy(), np.diff(terms.offsets.to_numpy()), terms.flatten().to_numpy(), tf.flatten().to_numpy(), weights, together
        )
        return pa.RecordBatch.from_arrays([pa.array([rows]), pa.array([shard.image()], pa.binary())], ["n_docs", "image"])

    for b in batches:
        for k in range(0, b.num_rows, SHARD):
            part = b.slice(k, SHARD)
            if rows and rows + part.num_rows > SHARD:
                yield stored()
                held, rows = [], 0
            held.append(part)
            rows += part.num_rows
    if rows:
        yield stored()


def build_index(counted: DataFrame, items: Items, weights: Weights, scratch: Scratch) -> DataFrame:
    """One row per shard: n_docs and the image of a ``Shard``. Documents without any of the items' terms are left out."""
    some = counted.where("size(terms) > 0").select("doc_id", "n", "terms", "tf")
    return scratch.table(some.mapInArrow(released(lambda batches: _shards(batches, weights, items)), "n_docs long, image binary"), "search-index")


def _found(batches: Iterator[pa.RecordBatch], items: Items, weights: Weights, k: int) -> Iterator[pa.RecordBatch]:
    best, wanted = [Best(k) for _ in items.ids], np.zeros(len(weights.term), np.int64)
    for b in batches:
        for row in range(b.num_rows):
            shard = Shard.opened(b.column("image")[row].as_py())
            for i, (numbers, repeats) in enumerate(zip(items.numbers, items.repeats)):
                wanted[numbers] = weights.term[numbers] * repeats
                shard.search(numbers[wanted[numbers] > 0], wanted, best[i])
                wanted[numbers] = 0
    which = np.repeat(np.arange(len(best)), [len(x.doc) for x in best])
    doc = np.concatenate([x.doc for x in best]) if best else np.empty(0, np.int64)
    score = np.concatenate([x.score for x in best]) if best else doc
    yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(doc, mask=doc == _LAST), pa.array(score)], ["item", "doc_id", "score"])


def ranked(docs: DataFrame, items: DataFrame, k: int = 20, per_block: int = 512, block_bytes: int = 4_000_000) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's ``k`` documents of highest score above 0, equal scores by ascending doc_id.

    NULL and empty texts have no terms; such documents count nowhere and such items find nothing. Repeated documents are ranked
    one by one. Repeated items (same id and text) are one; of items that share an id each is ranked by itself. NULL doc_ids
    come last among equal scores. Empty tables give no rows. Extra columns are ignored.
    """
    scratch, out = Scratch(docs.sparkSession), None
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for block in item_blocks(items, per_block, block_bytes):

        def count(batches, vocabulary=block.vocabulary):
            return _counted(batches, vocabulary)

        counted = scratch.table(rows.mapInArrow(released(count), "doc_id long, n long, terms array<int>, tf array<long>"), "search-terms")
        weights = weights_of(counted, len(block.vocabulary))
        index = build_index(counted, block, weights, scratch)
        scratch.drop(counted)

        def search(batches, block=block, weights=weights):
            return _found(batches, block, weights, k)

        ids = docs.sparkSession.createDataFrame(list(enumerate(block.ids)), "item long, item_id long")
        per_item = W.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        top = index.mapInArrow(released(search), "item long, doc_id long, score long").withColumn("rank", F.row_number().over(per_item)).where(F.col("rank") <= k)
        found = scratch.table(top.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score"), "search-found")
        scratch.drop(index)
        out = found if out is None else out.unionByName(found)
    return out
