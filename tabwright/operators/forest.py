"""Random forest for classes, grown level by level over counted cells.

Rows are counted once by class and the bin of every feature, which is all that a tree sees of them; a cell is never more than its rows. A bootstrap
draws each row a Poisson(1) number of times, so it draws a cell of n rows a Poisson(n) number of times, which is the same forest.
Cells are stored in numbered blocks, and the draws of a block come from a generator seeded with its number: every level draws the same ones again and no count
per tree is kept. A level is one pass: tasks walk their cells down the known splits and add up histograms by tree, which are shuffled by tree, where the best
splits are found. Only splits, at most 2^depth per tree, reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.session import materialise

#: Cells of a block, and numbers of the histograms that a task holds.
_BLOCK, _HELD = 8192, 4_000_000


@dataclass
class Cells:
    """Blocks (no, is_test, m, class_index, n and the bins of ``width`` features as bytes)."""

    blocks: DataFrame
    width: int
    bins: int
    classes: int


@dataclass
class Trees:
    """Per tree and node (as in a heap from 1): feature (-1 at a leaf), last bin to the left, shares of the classes; gains by tree and feature."""

    feature: np.ndarray
    cut: np.ndarray
    share: np.ndarray
    gain: np.ndarray

    def importances(self) -> np.ndarray:
        """Gains as shares of their tree, then of all."""
        whole = self.gain.sum(1, keepdims=True)
        parts = np.divide(self.gain, whole, out=np.zeros_like(self.gain), where=whole > 0).sum(0)
        return parts / parts.sum() if parts.sum() > 0 else parts


def bin_splits(rows: DataFrame, columns: Sequence[str], bins: int) -> list[list[float]]:
    """Per column the borders of at most ``bins`` bins: between all values where they are so few, else between quantiles of all rows."""
    about = rows.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
    narrow, ends = [i for i, c in enumerate(columns) if about[c] <= 2 * bins], {}
    if narrow:
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(columns[i]).alias("x")) for i in narrow])).alias("s")
        for r in rows.select(each).select("s.*").distinct().collect():  # some 2 * bins a column
            ends.setdefault(r["f"], []).append(r["x"])
    ends = {i: sorted(e)[:-1] or e for i, e in ends.items() if len(e) <= bins}
    wide = [i for i in range(len(columns)) if i not in ends]
    if wide:
        found = rows.approxQuantile([columns[i] for i in wide], [k / bins for k in range(1, bins)], 1 / (8 * bins))
        ends |= {i: sorted(set(e)) for i, e in zip(wide, found)}
    return [[-math.inf, *(math.nextafter(e, math.inf) for e in ends[i] or [0.0]), math.inf] for i in range(len(columns))]


def count_cells(rows: DataFrame, keep: Sequence[str], columns: Sequence[str], classes: int, bins: int) -> Cells:
    """Stored rows counted by ``keep`` (class_index and is_test) and the bins of the columns, which follow the rows not ``is_test``."""
    names = [f"__b{i}" for i in range(len(columns))]
    splits = bin_splits(rows.filter(~F.col("is_test")), columns, bins)
    binned = Bucketizer(splitsArray=splits, inputCols=list(columns), outputCols=names).transform(rows)
    kind = "int" if bins > 256 else "short"
    counted = binned.select(*keep, *[F.col(b).cast(kind).alias(b) for b in names]).groupBy(*keep, *names).agg(F.count(F.lit(1)).alias("n"))
    stored = counted.select("is_test", F.col("class_index").cast("int").alias("c"), "n", *names).sortWithinPartitions("is_test", "c", *names)
    per, held = max(1, min(_BLOCK, (1 << 22) // max(1, len(columns)))), np.dtype("<u2" if bins > 256 else "u1")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            test, c, n, *x = [col.to_numpy(zero_copy_only=False) for col in b.columns]
            for flag in (False, True):
                at = np.flatnonzero(test == flag)
                for k in range(0, len(at), per):
                    some = at[k : k + per]
                    cells = b"".join(col[some].astype(held).tobytes() for col in x)
                    values = [[flag], [len(some)], [c[some].astype("<i4").tobytes()], [n[some].astype("<i8").tobytes()], [cells]]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names_of)

    names_of, types = ["is_test", "m", "c", "n", "x"], [pa.bool_(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    blocks = stored.mapInArrow(pack, "is_test boolean, m int, c binary, n binary, x binary")
    return Cells(materialise(blocks.select(F.monotonically_increasing_id().alias("no"), "*"), "cells"), len(columns), bins, classes)


def _opened(batches: Iterator[pa.RecordBatch], width: int, bins: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    held = np.dtype("<u2" if bins > 256 else "u1")
    for b in batches:
        for no, c, n, x in zip(*(b.column(k).to_pylist() for k in ("no", "c", "n", "x"))):
            n = np.frombuffer(n, "<i8")
            yield no, np.frombuffer(c, "<i4").astype(np.int64), n, np.frombuffer(x, held).reshape(width, len(n)).astype(np.int64)


def _walk(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, steps: int) -> np.ndarray:
    """The node of each cell after at most ``steps`` splits of a tree."""
    node, rows = np.ones(x.shape[1], np.int64), np.arange(x.shape[1])
    for _ in range(steps):
        f = feature[node]
        below = 2 * node + (x[np.maximum(f, 0), rows] > cut[node])
        node = np.where(f >= 0, below, node)
    return node


def _offered(seed: int, tree: int, node: int, width: int, some: int) -> np.ndarray:
    """The features that a node may split on."""
    return np.sort(np.random.default_rng([seed, 1, tree, node]).choice(width, some, replace=False))


def _best(sums: np.ndarray, offered: np.ndarray) -> tuple[int, int, float]:
    """Feature, last bin to the left and gain (Gini, weighted by rows) of the best split; sums by feature, bin and class."""
    left = sums.cumsum(1)[:, :-1]
    whole = sums[0].sum(0)
    right = whole - left
    a, b, n = left.sum(2), right.sum(2), whole.sum()
    pure = lambda counts, size: np.divide((counts.astype(float) ** 2).sum(-1), size, out=np.zeros(np.shape(size)), where=size > 0)
    gain = pure(left, a) + pure(right, b) - (whole.astype(float) ** 2).sum() / n
    gain[(a < 1) | (b < 1)] = -1
    at = int(gain.argmax()) if gain.size else 0
    f, k = divmod(at, max(1, gain.shape[1]))
    return (int(offered[f]), k, float(gain[f, k])) if gain.size and gain[f, k] > 1e-12 * n else (-1, 0, 0.0)


def _level(cells: Cells, feature: np.ndarray, cut: np.ndarray, open_: np.ndarray, first: int, depth: int, some: int, seed: int) -> list:
    """tree, node, feature, cut, gain, counts of the classes: the best splits of the ``open_`` nodes of a level, for trees from ``first`` on."""
    width, bins, classes, low = cells.width, cells.bins, cells.classes, 1 << depth
    shape = (low, some, bins, classes)
    offered = [{int(v): _offered(seed, first + t, int(v), width, some) for v in np.flatnonzero(open_[t])} for t in range(len(feature))]
    trees = [t for t, nodes in enumerate(offered) if nodes]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {t: np.zeros(low * some * bins * classes) for t in trees}
        of = {t: np.zeros((some, 2 * low), np.int64) for t in trees}
        for t in trees:
            for node, chosen in offered[t].items():
                of[t][:, node] = chosen
        for no, c, n, x in _opened(batches, width, bins):
            rows = np.arange(len(n))
            for t in trees:
                drawn = np.random.default_rng([seed, 0, first + t, no]).poisson(n)
                node = _walk(x, feature[t], cut[t], depth)
                live = np.flatnonzero(open_[t][node] & (drawn > 0))
                node, times = node[live], drawn[live].astype(float)
                base, at, cls = (node - low) * some, rows[live], c[live]
                for j in range(some):
                    place = ((base + j) * bins + x[of[t][j][node], at]) * classes + cls
                    sums[t] += np.bincount(place, times, len(sums[t]))
        for t in trees:
            yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([sums[t].tobytes()], pa.binary())], ["tree", "sums"])

    def choose(table: pa.Table) -> pa.Table:
        t, sums = table.column("tree")[0].as_py(), np.zeros(shape)
        for part in table.column("sums"):
            sums += np.frombuffer(part.as_py()).reshape(shape)
        out = []
        for node, chosen in offered[t].items():
            held = sums[node - low]
            out.append((t, node, *(_best(held, chosen) if held.any() else (-1, 0, 0.0)), held[0].sum(0).tolist()))
        return pa.Table.from_arrays([pa.array(v, k.type) for v, k in zip(zip(*out), known)], schema=known)

    known = pa.schema([("tree", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("cut", pa.int32()), ("gain", pa.float64()), ("counts", pa.list_(pa.float64()))])
    parts = cells.blocks.filter(~F.col("is_test")).select("no", "c", "n", "x").mapInArrow(gather, "tree int, sums binary")
    return parts.groupBy("tree").applyInArrow(choose, "tree int, node int, feature int, cut int, gain double, counts array<double>").collect()


def grow(cells: Cells, trees: int, depth: int, seed: int) -> Trees:
    """Trees on bootstraps of the rows not ``is_test``; a node is offered the square root of the features, a single tree all."""
    some = cells.width if trees == 1 else math.ceil(math.sqrt(cells.width))
    per = max(1, _HELD // max(1, (1 << max(0, depth - 1)) * some * cells.bins * cells.classes))
    feature, cut = np.full((trees, 2 << depth), -1), np.zeros((trees, 2 << depth), np.int64)
    counts, gain = np.zeros((trees, 2 << depth, cells.classes)), np.zeros((trees, cells.width))
    for first in range(0, trees, per):
        last = min(first + per, trees)
        open_ = np.zeros((last - first, 2 << depth), bool)
        open_[:, 1] = True
        for d in range(depth):
            found = _level(cells, feature[first:last], cut[first:last], open_, first, d, some, seed)
            open_ = np.zeros_like(open_)
            for r in found:
                t = first + r["tree"]
                counts[t, r["node"]] = r["counts"]
                if r["feature"] >= 0:
                    feature[t, r["node"]], cut[t, r["node"]] = r["feature"], r["cut"]
                    gain[t, r["feature"]] += r["gain"]
                    open_[r["tree"], [2 * r["node"], 2 * r["node"] + 1]] = True
            if not open_.any():
                break
        if open_.any():  # the last level is only counted
            _count_leaves(cells, feature[first:last], cut[first:last], counts[first:last], first, depth, seed)
    whole = counts.sum(2, keepdims=True)
    return Trees(feature, cut, np.divide(counts, whole, out=np.zeros_like(counts), where=whole > 0), gain)


def _count_leaves(cells: Cells, feature: np.ndarray, cut: np.ndarray, counts: np.ndarray, first: int, depth: int, seed: int) -> None:
    """Drawn rows by class of the nodes at ``depth``, into ``counts``."""
    size, classes, width, bins, n_trees = 2 << depth, cells.classes, cells.width, cells.bins, len(feature)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((n_trees, size * classes))
        for no, c, n, x in _opened(batches, width, bins):
            for t in range(n_trees):
                drawn = np.random.default_rng([seed, 0, first + t, no]).poisson(n).astype(float)
                sums[t] += np.bincount(_walk(x, feature[t], cut[t], depth) * classes + c, drawn, size * classes)
        t, at = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(at), pa.array(sums[t, at])], ["tree", "place", "n"])

    parts = cells.blocks.filter(~F.col("is_test")).select("no", "c", "n", "x").mapInArrow(gather, "tree long, place long, n double")
    for r in parts.groupBy("tree", "place").agg(F.sum("n").alias("n")).collect():  # at most a number per leaf and class
        node, c = divmod(r["place"], classes)
        if node >= 1 << depth:
            counts[r["tree"], node, c] = r["n"]


def predict(cells: Cells, trees: Trees) -> DataFrame:
    """class_index, predicted, n: the cells ``is_test`` with the class of the largest mean share, the first of equals."""
    steps, width, bins, classes = trees.feature.shape[1].bit_length() - 2, cells.width, cells.bins, cells.classes

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, int] = {}
        for _, c, n, x in _opened(batches, width, bins):
            sums = np.zeros((len(n), classes))
            for t in range(len(trees.feature)):
                sums += trees.share[t][_walk(x, trees.feature[t], trees.cut[t], steps)]
            pair, back = np.unique(c * classes + sums.argmax(1), return_inverse=True)
            for p, m in zip(pair.tolist(), np.bincount(back, n).tolist()):
                met[p] = met.get(p, 0) + int(m)
        pairs = [divmod(p, classes) for p in met]
        columns = [[float(a) for a, _ in pairs], [float(b) for _, b in pairs]]
        yield pa.RecordBatch.from_arrays([*(pa.array(v, pa.float64()) for v in columns), pa.array(list(met.values()), pa.int64())], ["class_index", "predicted", "n"])

    parts = cells.blocks.filter("is_test").select("no", "c", "n", "x").mapInArrow(scored, "class_index double, predicted double, n long")
    return parts.groupBy("class_index", "predicted").agg(F.sum("n").alias("n"))
