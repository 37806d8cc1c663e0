"""Passages that occur in an earlier document, found with a count-min prefilter over windows of words.

A window is represented by its smallest hash among its runs of ``run`` words, so equal windows share it, and neighbouring windows
mostly do too: a text has about one such anchor per twenty windows. The anchor's count never lies below that
of any of its windows. Pass one counts in how many documents each anchor occurs in a count-min sketch of two rows: tasks sum
their own cells, the sums are merged, and cells with at least two stay, as a table that grows with the input and is never
broadcast whole. Pass two reads the windows of anchors that the sketch estimates at two or more (all windows that really repeat,
and a few more) and groups them exactly by a 128-bit digest of their words.

Documents with the same sequence of words are one: all but the smallest doc_id lose every window, so only that one takes part,
and a group of copies of any size costs one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabwright.llm.scratch import Scratch, broadcast_if_small
from tabwright.llm.words import WordHashes, shingle_hashes, words

#: Cells of the sketch per anchor, and the least number of cells (a power of two).
_CELLS_PER_ANCHOR, _LEAST_CELLS = 8, 1 << 16
#: Values that a broadcast join may hold (8 bytes each).
_BROADCAST_VALUES = 2_000_000


def window_anchors(ws: list[bytes], window: int, run: int, known: dict) -> np.ndarray:
    """Per window its smallest run hash, as signed 64-bit numbers; empty for shorter texts."""
    if len(ws) < window:
        return np.empty(0, np.int64)
    low, size, span = shingle_hashes(ws, run, known), 1, window - run + 1
    while size * 2 <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < span:
        low = np.minimum(low[: len(low) - (span - size)], low[span - size :])
    return low.view(np.int64)


def _read(batches: Iterator[pa.RecordBatch], window: int, run: int) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for b in batches:
        n, whole, sequence, anchors = [], [], [], []
        for t in b.column("text"):
            ws = words(t.as_py())
            joined = b" ".join(ws)
            n.append(len(ws))
            whole.append(hashlib.sha256(joined).digest())
            sequence.append(xxhash.xxh3_128_digest(joined))
            anchors.append(np.unique(window_anchors(ws, window, run, known)))
        yield pa.RecordBatch.from_arrays(
            [b.column("uid"), b.column("doc_id"), b.column("text_key"), pa.array(n, pa.int64()), pa.array(whole, pa.binary()),
             pa.array(sequence, pa.binary()), pa.array(anchors, pa.list_(pa.int64()))],
            ["uid", "doc_id", "text_key", "n_words", "whole", "sequence", "anchors"],
        )


def _windows(batches: Iterator[pa.RecordBatch], window: int, run: int) -> Iterator[pa.RecordBatch]:
    """One row per window whose anchor is among the document's flagged ones."""
    known = WordHashes()
    for b in batches:
        for uid, doc_id, flagged, t in zip(b.column("uid").to_pylist(), b.column("doc_id").to_pylist(), b.column("flagged"), b.column("text")):
            ws = words(t.as_py())
            joined = b" ".join(ws)
            at = np.flatnonzero(np.isin(window_anchors(ws, window, run, known), flagged.values.to_numpy()))
            starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1)])
            digests = b"".join(
                xxhash.xxh3_128_digest(joined[i:j]) for i, j in zip(starts[at].tolist(), (starts[at + window] - 1).tolist())
            )
            pairs = np.frombuffer(digests, "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1])), pa.array(np.full(len(at), doc_id, np.int64)),
                 pa.array(np.full(len(at), uid, np.int64)), pa.array(at.astype(np.int32))],
                ["high", "low", "doc_id", "uid", "at"],
            )


def _without(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        removed, kept = [], []
        for t, runs in zip(b.column("text"), b.column("runs")):
            ws = words(t.as_py())
            change = np.zeros(len(ws) + 1, np.int32)
            np.add.at(change, runs.values.field("first").to_numpy(), 1)
            np.add.at(change, runs.values.field("last").to_numpy() + window, -1)
            covered = np.cumsum(change[:-1]) > 0
            removed.append(int(covered.sum()))
            kept.append(hashlib.sha256(b" ".join(w for w, c in zip(ws, covered.tolist()) if not c)).digest())
        yield pa.RecordBatch.from_arrays(
            [b.column("uid"), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], ["uid", "n_removed", "kept"]
        )


def _estimated_repeats(anchors: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """The rows whose anchor the sketch puts at two documents or more."""
    cells = max(_LEAST_CELLS, 1 << (n * _CELLS_PER_ANCHOR - 1).bit_length())
    cell = [F.xxhash64(F.lit(r), "anchor").bitwiseAND(F.lit(cells - 1)).alias("cell") for r in range(2)]
    for c in cell:
        sketch = scratch.table(anchors.groupBy(c).count().where("count > 1").select("cell"), "repeats-sketch")
        anchors = anchors.withColumn("cell", c).join(
            broadcast_if_small(sketch, sketch.count(), _BROADCAST_VALUES), "cell", "left_semi"
        ).drop("cell")
    return anchors


def repeated_words(docs: DataFrame, window: int = 50, run: int = 8) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by a space).

    A word goes if it lies in a run of ``window`` words that also starts in a document with a smaller doc_id. Documents with a
    NULL doc_id come neither before nor after others and stay whole; rows with equal doc_ids don't affect each other.
    NULL texts have no words. An empty table gives no rows. Extra columns are ignored.
    """
    if not 1 <= run <= window:
        raise ValueError("a run must fit in a window")
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    read = scratch.table(
        texts.withColumn("uid", F.monotonically_increasing_id()).mapInArrow(
            lambda batches: _read(batches, window, run),
            "uid long, doc_id long, text_key long, n_words long, whole binary, sequence binary, anchors array<long>",
        ),
        "repeats-documents",
    )
    usable = read.where((F.col("n_words") >= window) & F.col("doc_id").isNotNull())
    first = scratch.table(
        usable.groupBy("sequence").agg(F.min(F.struct("doc_id", "uid")).alias("lead")).select("sequence", "lead.doc_id", "lead.uid"),
        "repeats-sequences",
    )
    leads = usable.join(broadcast_if_small(first.select("uid"), first.count(), _BROADCAST_VALUES), "uid", "left_semi")
    n = leads.agg(F.coalesce(F.sum(F.size("anchors")), F.lit(0))).first()[0]
    anchors = leads.select("uid", F.explode("anchors").alias("anchor"))
    repeats = scratch.table(
        _estimated_repeats(anchors, max(n, 1), scratch).groupBy("uid").agg(F.collect_set("anchor").alias("flagged")), "repeats-flagged"
    )
    flagged = scratch.table(repeats.join(leads.select("uid", "doc_id", "text_key"), "uid"), "repeats-wanted")
    scratch.drop(repeats)
    n_flagged = flagged.agg(F.coalesce(F.sum(F.size("flagged") + 4), F.lit(0))).first()[0]
    # Rows repeated with their doc_id give their windows twice, which changes nothing.
    windows = scratch.table(
        texts.join(broadcast_if_small(flagged, n_flagged, _BROADCAST_VALUES), ["doc_id", "text_key"]).mapInArrow(
            lambda batches: _windows(batches, window, run), "high long, low long, doc_id long, uid long, at int"
        ),
        "repeats-windows",
    )
    earliest = scratch.table(
        windows.groupBy("high", "low").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
        .select("high", "low", "first"),
        "repeats-earliest",
    )
    hits = windows.join(earliest, ["high", "low"]).where("doc_id > first").select("uid", "at")
    # Neighbouring starts become one run, so a long passage costs two numbers.
    place = F.dense_rank().over(W.partitionBy("uid").orderBy("at"))
    runs = hits.withColumn("run", F.col("at") - place).groupBy("uid", "run").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    spans = runs.groupBy("uid").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    wanted = scratch.table(spans.join(flagged.select("uid", "doc_id", "text_key"), "uid"), "repeats-spans")
    n_spans = wanted.agg(F.coalesce(F.sum(2 * F.size("runs") + 4), F.lit(0))).first()[0]
    changed = texts.join(broadcast_if_small(wanted, n_spans, 2 * _BROADCAST_VALUES), ["doc_id", "text_key"]).mapInArrow(
        lambda batches: _without(batches, window), "uid long, n_removed long, kept binary"
    )
    settled = scratch.table(
        first.join(changed.dropDuplicates(["uid"]), "uid", "left").select("sequence", F.col("doc_id").alias("lead"), "n_removed", "kept"),
        "repeats-settled",
    )
    scratch.drop(first, flagged, windows, earliest, wanted)
    met = read.drop("anchors").join(settled, "sequence", "left")
    copy, own = F.col("doc_id") > F.col("lead"), F.col("doc_id") == F.col("lead")
    nothing = F.unhex(F.sha2(F.lit(""), 256))
    return met.select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).when(own, F.coalesce("n_removed", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.lower(F.hex(F.when(copy, nothing).when(own, F.coalesce("kept", "whole")).otherwise(F.col("whole")))).alias("kept_sha256"),
    )
