"""Vectors as short codes: each of eight parts is replaced by the number of its nearest codebook entry.

The nearest entry is found exactly by slices and bitmasks. Per part position and dimension the entries' coordinates are sorted, and each
place in that order carries a mask (uint64) of the entries before it. For a part an initial radius is the distance to one probed
entry; in every dimension two binary searches give the slice of entries within the radius, the masks of its ends differ
in just these entries, and the masks of all dimensions are ANDed. The entries left include every one that is not farther than the
probed one, so comparing their distances gives the nearest, ties to the lower number.

All arithmetic is on integers. A round assigns all parts in the tasks, which send sums and counts per entry (a few hundred rows each) to
be added up; the driver holds the codebooks alone, 8 x 16 entries by default.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.scratch import Scratch, join_hot

#: Components beyond this size could overflow the sums of squares; they raise an error.
LARGEST = 1 << 27


class SliceIndex:
    """The entries of one part position (at most 64), for exact nearest-entry searches."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        n, width = entries.shape
        if n > 64:
            raise ValueError("at most 64 entries fit a mask")
        self.sorted, self.before = [], []
        for d in range(width):
            order = np.argsort(entries[:, d], kind="stable")
            self.sorted.append(entries[order, d])
            self.before.append(np.concatenate([np.zeros(1, np.uint64), np.bitwise_or.accumulate(np.uint64(1) << order.astype(np.uint64))]))
        #: The dimension in which the entries lie farthest apart picks the probe.
        self.widest = int(np.argmax(entries.max(axis=0) - entries.min(axis=0))) if n else 0
        self.probe = np.argsort(entries[:, self.widest], kind="stable") if n else None

    def _squares(self, parts: np.ndarray, at: np.ndarray) -> np.ndarray:
        gap = parts - self.entries[at]
        return np.einsum("ij,ij->i", gap, gap)

    def candidates(self, parts: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Mask of the entries that lie within ``radius`` of each part in every dimension."""
        masks = np.full(len(parts), ~np.uint64(0))
        for d, (coordinates, before) in enumerate(zip(self.sorted, self.before)):
            low = np.searchsorted(coordinates, parts[:, d] - radius, "left")
            high = np.searchsorted(coordinates, parts[:, d] + radius, "right")
            masks &= before[high] & ~before[low]
        return masks

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry's number and squared distance per row of ``parts``."""
        place = np.searchsorted(self.sorted[self.widest], parts[:, self.widest])
        best = self.probe[np.minimum(place, len(self.entries) - 1)]
        least = self._squares(parts, best)
        radius = np.floor(np.sqrt(least.astype(np.float64))).astype(np.int64) + 1  # never below the distance
        masks = self.candidates(parts, radius)
        for k in range(len(self.entries)):
            rows = np.flatnonzero(masks >> np.uint64(k) & np.uint64(1))
            d = self._squares(parts[rows], np.full(len(rows), k))
            closer = (d < least[rows]) | (d == least[rows]) & (k < best[rows])
            best[rows[closer]], least[rows[closer]] = k, d[closer]
        return best, least


@dataclass
class Codebooks:
    """``entries``: part position, entry, component."""

    entries: np.ndarray

    def indexes(self) -> list[SliceIndex]:
        return [SliceIndex(e) for e in self.entries]

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _as_long(x: Column) -> Column:
    scaled = F.floor(x.cast("double") * 4096)
    return F.when(F.abs(scaled) > LARGEST, F.raise_error(F.lit("vector component out of range"))).otherwise(scaled).cast("long")


def usable(vectors: DataFrame) -> Column:
    """Not NULL and without NULL, NaN or infinite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf"))
    return F.coalesce(F.forall("embedding", finite), F.lit(False))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _sums(batches: Iterator[pa.RecordBatch], books: Codebooks) -> Iterator[pa.RecordBatch]:
    """Sums and counts of the parts nearest to each entry, over all batches of a task."""
    n_parts, k, width = books.entries.shape
    total, count, indexes = np.zeros((n_parts, k, width), np.int64), np.zeros((n_parts, k), np.int64), books.indexes()
    for b in batches:
        rows = _matrix(b.column(0), n_parts * width)
        for p, index in enumerate(indexes):
            parts = rows[:, p * width : (p + 1) * width]
            at, _ = index.nearest(parts)
            order = np.argsort(at, kind="stable")
            met, first = np.unique(at[order], return_index=True)
            if len(met):
                total[p, met] += np.add.reduceat(parts[order], first, axis=0)
            count[p] += np.bincount(at, minlength=k)
    p, e = np.nonzero(count)
    yield pa.RecordBatch.from_arrays(
        [pa.array(p), pa.array(e), pa.array(count[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "total"]
    )


def _refined(stored: DataFrame, books: Codebooks) -> Codebooks:
    """Each entry replaced by the componentwise floor of its parts' mean; entries without parts stay."""
    width = books.entries.shape[2]
    per_task = stored.select("ints").mapInArrow(lambda batches: _sums(batches, books), "part long, entry long, n long, total array<long>")
    added = per_task.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("total")[d]).alias(f"t{d}") for d in range(width)))
    entries = books.entries.copy()
    for r in added.collect():  # at most one row per entry
        entries[r["part"], r["entry"]] = [r[f"t{d}"] // r["n"] for d in range(width)]
    return Codebooks(entries)


def fit_codebooks(stored: DataFrame, width: int, n_parts: int = 8, size: int = 16, rounds: int = 6) -> Codebooks:
    """Codebooks from all rows of ``ints``; they start as the parts of the ``size`` rows first by vec_id (NULLs last, ties by content)."""
    first = stored.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(size).collect()
    start = np.array([r["ints"] for r in first], np.int64).reshape(len(first), n_parts, width // n_parts)
    books = Codebooks(start.transpose(1, 0, 2).copy())
    for _ in range(rounds):
        books = _refined(stored, books)
    return books


def _encoded(batches: Iterator[pa.RecordBatch], books: Codebooks) -> Iterator[pa.RecordBatch]:
    n_parts, _, width = books.entries.shape
    indexes = books.indexes()
    for b in batches:
        rows = _matrix(b.column(2), n_parts * width)
        code, error = np.zeros((len(rows), n_parts), np.uint8), np.zeros(len(rows), np.int64)
        for p, index in enumerate(indexes):
            at, squares = index.nearest(rows[:, p * width : (p + 1) * width])
            code[:, p] = at
            error += squares
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error)], ["vec_id", "label", "code", "error"])


def compress(vectors: DataFrame, n_parts: int = 8, size: int = 16, rounds: int = 6) -> tuple[DataFrame, Codebooks]:
    """One row per usable vector (vec_id, label, code of ``n_parts`` bytes, error), and the codebooks.

    Rows whose vector is NULL or has NULL or non-finite components are left out. Components become ``floor(4096 * x)``; beyond +-32768 they raise an
    error. All vectors must have one length that ``n_parts`` divides (ValueError otherwise). NULL and repeated vec_ids and labels
    are rows like any other. With fewer than ``size`` vectors the codebooks are that small; without any the result is empty.
    Extra columns are ignored.
    """
    scratch = Scratch(vectors.sparkSession)
    ints = F.transform("embedding", _as_long).alias("ints")
    stored = scratch.table(vectors.where(usable(vectors)).select(F.col("vec_id").cast("long").alias("vec_id"), "label", ints), "vectors")
    shortest, longest = stored.agg(F.min(F.size("ints")), F.max(F.size("ints"))).first()
    if shortest != longest or (longest or n_parts) % n_parts:
        raise ValueError(f"vectors of one length, divisible by {n_parts}, are needed; found {shortest} to {longest}")
    width = longest or n_parts
    books = fit_codebooks(stored, width, n_parts, size, rounds)
    label = stored.schema["label"].dataType.simpleString()
    coded = stored.mapInArrow(lambda batches: _encoded(batches, books), f"vec_id long, label {label}, code binary, error long")
    return scratch.table(coded, "vector-codes"), books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with label_error: the errors added up over rows of equal label, NULLs together."""
    scratch = Scratch(coded.sparkSession)
    sums = scratch.table(coded.groupBy("label").agg(F.count("*").alias("copies"), F.sum("error").alias("label_error")), "label-errors")
    return join_hot(coded, sums, "label", F.col("copies"), coded.count()).drop("copies")
