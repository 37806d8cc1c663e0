"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

Candidates share one of 40 bands of five MinHash values; every candidate is verified on its whole shingle sets. A pair of
similarity s shares no band with chance (1 - s^5)^40: 1.2e-7 at 0.8, less above. Fingerprints within a radius give no such
bound: at 0.8 the 64 bits of two texts differ by any number of places.

Equal sets count once. Of each band first the members against its two ends are verified, then, in a few rounds, against one drawn
member (a pivot) as long as the band still has members of different components: a large group of near copies is joined without all its
pairs. What is left apart are mostly texts that share a band but no more than a passage. Among these an exact prefix filter finds the pairs: two sets of
similarity 0.8 share one of the rarest fifth (and one more) of either's shingles, which passages that many texts share are not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabwright.llm.components import components
from tabwright.llm.memory import released
from tabwright.llm.scratch import Scratch, broadcast_if_small, numbered, rows_of
from tabwright.llm.words import WordHashes, shingle_hashes, words

BANDS, BAND_ROWS = 40, 5
_draw = np.random.default_rng(42)
_FLIP, _TIMES = (_draw.integers(0, 2**64, BANDS * BAND_ROWS, dtype=np.uint64)[:, None] for _ in range(2))
_TIMES |= np.uint64(1)
_MIX, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)
#: Rounds in which the members of a band meet a drawn one.
_ROUNDS = 2
#: Candidates whose numbers may be broadcast to pick their texts.
_BROADCAST_ROWS = 500_000


def shingle_set(text: str | None, width: int, known: dict) -> np.ndarray:
    """Sorted distinct hashes of the lower-cased text's shingles."""
    return np.unique(shingle_hashes(words(text, lower=True), width, known))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One number per band of the set's MinHash values; none for an empty set."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    least = np.full(BANDS * BAND_ROWS, ~np.uint64(0))
    for at in range(0, len(hashes), 512):
        np.minimum(least, ((hashes[at : at + 512] ^ _FLIP) * _TIMES).min(axis=1), out=least)
    key = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, BAND_ROWS).T:
        key = (key ^ column) * _MIX
        key ^= key >> _SHIFT
    return key


def _sketch_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for b in batches:
        sets = [shingle_set(t.as_py(), width, known) for t in b.column(2)]
        yield pa.RecordBatch.from_arrays(
            [
                b.column(0), b.column(1), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.array(list(map(len, sets)), pa.int32()), pa.array([band_keys(s).view(np.int64) for s in sets], pa.list_(pa.int64())),
            ],
            ["uid", "doc_id", "digest", "n", "keys"],
        )


def _set_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for b in batches:
        sets = [shingle_set(t.as_py(), width, known).view(np.int64) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "grams"])


def _verified(pairs: DataFrame, texts: DataFrame, scratch: Scratch, width: int, similarity: float) -> DataFrame:
    """Of the pairs ``a``, ``b`` those whose sets are at least so similar."""
    pairs = scratch.table(pairs.distinct(), "near-pairs")
    sets = _sets_of(pairs.select(F.col("a").alias("uid")).union(pairs.select("b")).distinct(), texts, scratch, width)
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("of_a")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("grams").alias("of_b")), "b"
    )
    shared = F.size(F.array_intersect("of_a", "of_b"))
    alike = both.select("a", "b", shared.alias("shared"), (F.size("of_a") + F.size("of_b")).alias("total")).where(
        F.col("shared") / (F.col("total") - F.col("shared")) >= similarity
    )
    links = scratch.table(alike.select("a", "b"), "near-links")
    scratch.drop(pairs, sets)
    return links


def _sets_of(nodes: DataFrame, texts: DataFrame, scratch: Scratch, width: int) -> DataFrame:
    """node, grams: the shingle sets of the texts whose ``uid`` is among the nodes."""
    nodes = scratch.table(nodes, "near-nodes")
    chosen = texts.join(broadcast_if_small(nodes, nodes.count(), _BROADCAST_ROWS), "uid", "left_semi").select("uid", "text")
    sets = scratch.table(chosen.mapInArrow(released(lambda batches: _set_batches(batches, width)), "node long, grams array<long>"), "near-sets")
    scratch.drop(nodes)
    return sets


def _prefix_pairs(nodes: DataFrame, texts: DataFrame, scratch: Scratch, width: int, similarity: float) -> DataFrame:
    """a, b: pairs of nodes (node, n, root) of different roots that may be so similar, none missed.

    A set of n shingles shares at least ``similarity`` * n of them with such a partner, so one of any n - that + 1 too. The
    rarest are taken; a shingle that no other node has needs no partner to be looked for.
    """
    sets = _sets_of(nodes.select(F.col("node").alias("uid")), texts, scratch, width)
    exploded = sets.select("node", F.explode("grams").alias("gram"))
    shared = scratch.table(exploded.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1"), "near-frequencies")
    own = W.partitionBy("node")
    met = exploded.join(shared, "gram").join(nodes, "node").withColumn("alone", F.col("n") - F.count("*").over(own))
    taken = F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1 - F.col("alone")
    prefixes = scratch.table(
        met.withColumn("place", F.row_number().over(own.orderBy("df", "gram"))).where(F.col("place") <= taken).select("gram", "node", "n", "root"), "near-prefixes"
    )
    other = prefixes.select("gram", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("root").alias("root_b"))
    apart = (F.col("a") < F.col("b")) & (F.col("root") != F.col("root_b")) & (F.least("n", "n_b") >= F.greatest("n", "n_b") * (similarity - 1e-9))
    pairs = scratch.table(prefixes.withColumnRenamed("node", "a").join(other, "gram").where(apart).select("a", "b").distinct(), "near-prefix-pairs")
    scratch.drop(sets, shared, prefixes)
    return pairs


def near_copies(docs: DataFrame, uid: str, scratch: Scratch, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per distinct shingle set: root (equal for all sets connected by links of at least ``similarity``) and best,
    the first of the set's rows by doc_id (NULLs last) and ``uid``.

    A text of fewer words than ``width`` has them all as its one shingle; NULL and wordless texts share the empty set.
    ``similarity`` must lie between 0.8, for which the bands are laid out, and 1.
    """
    if not 0.8 <= similarity <= 1:
        raise ValueError("similarity must lie between 0.8 and 1")
    texts = rows_of(docs, uid)
    rows = texts.mapInArrow(released(lambda batches: _sketch_batches(batches, width)), "uid long, doc_id long, digest binary, n int, keys array<long>")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "uid")).alias("best")
    sets = scratch.table(
        rows.groupBy("digest").agg(best, F.first("n").alias("n"), F.first("keys").alias("keys")).select(F.col("best.uid").alias("node"), "best", "n", "keys"),
        "near-sketches",
    )
    keyed = sets.select("node", "n", F.explode("keys").alias("key"))
    crowded = scratch.table(
        keyed.groupBy("key").agg(F.min(F.struct("node", "n")).alias("lo"), F.max(F.struct("node", "n")).alias("hi")).where("lo.node < hi.node"), "near-bands"
    )
    members = scratch.table(keyed.join(crowded, "key"), "near-members")
    fits = lambda m, n: F.least(m, n) >= F.greatest(m, n) * (similarity - 1e-9)
    ends = [
        members.where((F.col("node") != F.col(f"{e}.node")) & fits(F.col("n"), F.col(f"{e}.n"))).select(
            F.least("node", f"{e}.node").alias("a"), F.greatest("node", f"{e}.node").alias("b")
        )
        for e in ("lo", "hi")
    ]
    links = _verified(ends[0].union(ends[1]), texts, scratch, width, similarity)
    for turn in range(_ROUNDS + 1):
        roots = scratch.table(components(links, scratch), "near-roots")
        rooted = scratch.table(members.join(roots, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root")), "near-rooted")
        pivot = F.min(F.struct(F.xxhash64(F.lit(turn), "node").alias("ticket"), "node", "n", "root")).alias("pivot")
        mixed = rooted.groupBy("key").agg(pivot, F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("key", "pivot")
        apart = scratch.table(rooted.join(mixed, "key"), "near-apart")
        scratch.drop(roots, rooted)
        if turn == _ROUNDS:
            break
        met = apart.where((F.col("root") != F.col("pivot.root")) & fits(F.col("n"), F.col("pivot.n")))
        new = _verified(met.select(F.least("node", "pivot.node").alias("a"), F.greatest("node", "pivot.node").alias("b")), texts, scratch, width, similarity)
        if new.isEmpty():
            break
        links = links.union(new)
    nodes = scratch.table(apart.select("node", "n", "root").distinct(), "near-left")
    scratch.drop(crowded, members, apart)
    last = _verified(_prefix_pairs(nodes, texts, scratch, width, similarity), texts, scratch, width, similarity)
    found = components(links.union(last), scratch)
    return sets.join(found, "node", "left").select(F.coalesce("root", "node").alias("root"), "best")


def drop_near_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents with one of each group of near copies: the one with the smallest doc_id, the first of repeated rows.

    All columns stay. A group without any doc_id keeps its first row. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    rows, uid = numbered(docs, scratch, "near-docs")
    keep = near_copies(rows, uid, scratch, width, similarity).groupBy("root").agg(F.min("best").alias("best"))
    kept = scratch.table(keep.select(F.col("best.uid").alias(uid)), "near-kept")
    gone = scratch.table(rows.select(uid).join(kept, uid, "left_anti"), "near-gone")
    scratch.drop(kept)
    return rows.join(broadcast_if_small(gone, gone.count(), _BROADCAST_ROWS), uid, "left_anti").select(*docs.columns)
