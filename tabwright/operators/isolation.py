"""Isolation forest: trees grown from the top over all their rows, several levels in a pass, scoring on every row.

A node's split is drawn from a hash of its number: one of the features that differ among its rows, and a cut anywhere between their least and
greatest value. These are known only after a pass over the rows, but the parent's cut bounds them. So splits are drawn ahead within the bounds, some levels
below every open node, and one pass counts all rows of all trees by the cells they fall in, with each cell's least and greatest values. What is
true of a node follows from its cells; a split drawn ahead stands if its feature is the one to take and its cut parts the rows. Such a cut is as
likely as one drawn between the true values. Otherwise the node is drawn again in the next pass. Rows are not stored again: they walk down the splits found so far,
of which there is at most one per ``IN_TASK`` rows and level. A node that is down to ``IN_TASK`` rows is finished by one task, all nodes of a level
at a time; its rows are shuffled once, as blocks. Nodes are numbered as in a heap (root 1, children 2i and 2i + 1), so no level has to know another.
Forests of few nodes travel to the rows as arrays; for others the rows go down the stored node table, level by level.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions.scalars import finite_or_zero, percent, severity
from tabwright.operators.clustering import pca_2d
from tabwright.operators.columns import numeric_columns, numeric_matrix
from tabwright.operators.quantiles import exact_quantiles
from tabwright.operators.ranking import top_n
from tabwright.operators.sampling import mark_smallest
from tabwright.session import materialise, spread

#: Rows of a node that one task grows on by itself, and numbers they hold in wide tables; rows of a tree's sample that go to one task right away;
#: nodes that are sent to the rows as arrays; splits of a level sent to the rows.
IN_TASK, TASK_VALUES, DRAWN, ARRAY_NODES, FEW_SPLITS = 1 << 19, 1 << 21, 4096, 2_000_000, 20_000
#: Numbers of all cells of a pass, unless the open nodes alone have more; rows that walk down together; numbers of the rows dealt out together.
_CELL_VALUES, _TOGETHER, _DEALT = 1 << 17, 8192, 1 << 21
_OPEN, _SPLIT, _LEAF, _TASK = range(4)
RESULT_COLUMNS = ["is_anomaly", "anomaly_score", "decision_score", "raw_score", "severity"]

_NODES = "tree int, node long, feature int, threshold double, size long, depth int"
_ROW = "__row"


def average_path(n: float) -> float:
    """Mean path length of an unsuccessful search among ``n`` points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


@dataclass
class StoredForest:
    """A forest as a table of nodes (``feature`` is -1 at a leaf), of any size."""

    features: list[str]
    rows_per_tree: int
    trees: int
    nodes: DataFrame
    offset: float = -0.5
    fit_range: tuple[float, float] | None = None

    def save(self, spark, path: str) -> None:
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        low, high = self.fit_range or (None, None)
        spark.createDataFrame(
            [(self.features, self.rows_per_tree, self.trees, self.offset, low, high)],
            "features array<string>, rows_per_tree long, trees int, offset double, low double, high double",
        ).coalesce(1).write.mode("overwrite").parquet(f"{path}/record")


@dataclass
class Forest:
    """Node arrays of all trees, each padded to the size of the largest.

    ``feature`` is -1 at a leaf. There are at most ``ARRAY_NODES`` nodes, so the arrays travel inside the scoring function.
    """

    features: list[str]
    rows_per_tree: int
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    size: np.ndarray
    depth: np.ndarray
    offset: float = -0.5
    fit_range: tuple[float, float] | None = None
    nodes: DataFrame | None = None  # the table the arrays come from

    def __getstate__(self) -> dict:
        return {**self.__dict__, "nodes": None}  # tables don't travel to the rows

    @property
    def leaf_value(self) -> np.ndarray:
        extra = np.vectorize(average_path)(self.size.astype(float))
        return np.where(self.feature < 0, self.depth + extra, 0.0)

    def stored(self, spark) -> StoredForest:
        """The same forest as a table of nodes."""
        if self.nodes is not None:
            return StoredForest(self.features, self.rows_per_tree, len(self.feature), self.nodes, self.offset, self.fit_range)
        rows = []
        for t in range(len(self.feature)):
            todo = [(0, 1)]
            while todo:
                i, node = todo.pop()
                f = int(self.feature[t, i])
                rows.append((t, node, f, float(self.threshold[t, i]), int(self.size[t, i]), int(self.depth[t, i])))
                if f >= 0:
                    todo += [(int(self.left[t, i]), 2 * node), (int(self.right[t, i]), 2 * node + 1)]
        return StoredForest(self.features, self.rows_per_tree, len(self.feature), spark.createDataFrame(rows, _NODES), self.offset, self.fit_range)

    def save(self, spark, path: str) -> None:
        self.stored(spark).save(spark, path)

    @staticmethod
    def load(spark, path: str) -> Forest | StoredForest:
        r = spark.read.parquet(f"{path}/record").first()
        forest = _held(StoredForest(list(r["features"]), r["rows_per_tree"], r["trees"], spark.read.parquet(f"{path}/nodes")))
        forest.offset = r["offset"]
        forest.fit_range = None if r["low"] is None else (r["low"], r["high"])
        return forest


def fit_forest(df: DataFrame, trees: int = 200, max_samples: str | int | float = "auto", seed: int = 42,
               contamination: str | float = "auto", n_rows: int | None = None) -> Forest | StoredForest:
    """Grow ``trees`` trees, each on its own sample without replacement, of any number of rows.

    ``contamination`` sets the offset to that quantile of the raw scores, "auto" to -0.5.
    """
    features = numeric_columns(df)
    points = _numbered(numeric_matrix(df.select(*features)), features)
    n = points.count() if n_rows is None else n_rows
    size = _tree_rows(max_samples, n)
    limit = max(1, math.ceil(math.log2(max(size, 2))))
    if size <= min(IN_TASK, DRAWN):
        grown = _drawn_trees(_draw(points, len(features), n, trees, size, seed), size, limit, seed)
    else:
        rows = points if size >= n else materialise(_draw(points, len(features), n, trees, size, seed), "taken")
        grown = _grown(rows, len(features), size, trees, limit, seed)
    nodes = materialise(grown, "forest-nodes")
    forest = _held(StoredForest(list(features), size, trees, nodes))
    if contamination != "auto":
        raw = materialise(score(df.select(*features), forest).select("raw_score"), "raw-scores")
        forest.offset = exact_quantiles(raw, ["raw_score"], [float(contamination)])["raw_score"][0]
    return forest


def _tree_rows(max_samples, n: int) -> int:
    if max_samples == "auto":
        return min(256, n)
    if isinstance(max_samples, float):
        return max(1, int(max_samples * n))
    return min(int(max_samples), n)


def _numbered(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Stored rows with a number of their own (__row) and the features (x0, x1, ...), missing values as 0."""
    x = [finite_or_zero(F.col(f).cast("double")).alias(f"x{i}") for i, f in enumerate(features)]
    return materialise(df.select(F.monotonically_increasing_id().alias(_ROW), *x), "points")


def _x(n_features: int) -> list[str]:
    return [f"x{i}" for i in range(n_features)]


def _draw(points: DataFrame, n_features: int, n: int, trees: int, size: int, seed: int) -> DataFrame:
    """tree, ticket, x: at least ``size`` rows per tree (all but surely); tree, x0, x1, ... of exactly ``size`` where a tree outgrows one task.

    A row's ticket for a tree is a hash of both; those below a cut a little above size / n are offered.
    """
    points = points.select(_ROW, F.array(*_x(n_features)).alias("x"))
    share = min(1.0, (size + 8 * math.sqrt(size) + 50) / max(n, 1))
    cut = np.uint64(min(2**63 - 1, int(share * 2**63)))

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = _mixed(np.arange(trees, dtype=np.uint64) + np.uint64(seed << 20))
        for b in batches:
            for k in range(0, b.num_rows, 2048):
                part = b.slice(k, 2048)
                number, met = part.column(0).to_numpy().view(np.uint64), []
                for i in range(0, len(number), 128):  # tickets of some rows, which stay in the cache
                    ticket = _mixed(number[i : i + 128, None] ^ tree) >> np.uint64(1)
                    row, of = np.nonzero(ticket <= cut)
                    met.append((row + i, of, ticket[row, of]))
                row, of, ticket = map(np.concatenate, zip(*met))
                for j in range(0, len(row), 50_000):
                    some, whose = row[j : j + 50_000], of[j : j + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(whose, pa.int32()), pa.array(ticket[j : j + 50_000].astype(np.int64)), part.column(1).take(pa.array(some))], ["tree", "ticket", "x"]
                    )

    drawn = materialise(points.mapInArrow(offer, "tree int, ticket long, x array<double>"), "drawn")
    if size <= min(IN_TASK, DRAWN):
        return drawn
    taken = mark_smallest(drawn, lambda _: F.lit(size), "taken", ["tree"], "ticket").filter("taken")
    return taken.select("tree", *[F.get("x", F.lit(i)).alias(c) for i, c in enumerate(_x(n_features))])


def _mixed(h: np.ndarray) -> np.ndarray:
    for times, shift in ((0xBF58476D1CE4E5B9, 30), (0x94D049BB133111EB, 27)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(times)
    return h ^ (h >> np.uint64(31))


def _down(rows: DataFrame, splits: DataFrame, n_splits: int) -> DataFrame:
    """Rows of split nodes at the child they belong to."""
    few = splits.select("tree", "node", "feature", "threshold")
    met = rows.join(F.broadcast(few) if n_splits <= FEW_SPLITS else few, ["tree", "node"])
    child = F.col("node") * 2 + (F.get("x", F.col("feature")) > F.col("threshold")).cast("long")
    return met.withColumn("node", child).select(*rows.columns)


def _drawn_trees(drawn: DataFrame, size: int, limit: int, seed: int) -> DataFrame:
    """The nodes of trees whose samples go to one task each."""

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        tree = int(group["tree"].iloc[0])
        picked = group.sort_values("ticket", kind="stable").head(size)
        return _grow(tree, 1, 0, np.vstack(picked["x"].to_numpy()), limit, np.random.default_rng([seed, tree, 1]))

    return drawn.groupBy("tree").applyInPandas(grow, _NODES)


def _hashed(seed: int, tree: np.ndarray, node: np.ndarray, turn: np.ndarray | int) -> np.ndarray:
    """An even 64-bit number for each node and turn."""
    of = _mixed(np.asarray(tree).astype(np.uint64) + np.uint64((seed << 20) + 1 & (1 << 64) - 1))
    return _mixed(_mixed(of + np.asarray(node).astype(np.uint64)) + np.asarray(turn).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _splits(tree: np.ndarray, node: np.ndarray, low: np.ndarray, high: np.ndarray, tried: np.ndarray | int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature (-1 where none differs) and cut of a random split of each node, whose least and greatest values lie in a column.

    The feature is the first that differs in an order which belongs to the node, so it doesn't depend on how it was come by. A cut lies at or above the least
    value and below the greatest one, so both sides have rows.
    """
    n_features = len(low)
    order = np.stack([_hashed(seed, tree, node, 1 + f) for f in range(n_features)])
    order = np.where(high > low, order | np.uint64(1), np.uint64(0))
    feature = order.argmax(0)
    at = np.arange(len(feature))
    feature[order[feature, at] == 0] = -1
    least, most = low[feature, at], high[feature, at]
    share = (_hashed(seed, tree, node, 1 + n_features + np.asarray(tried)) >> np.uint64(11)) * 2.0**-53
    cut = np.clip(least * (1 - share) + most * share, least, np.maximum(least, np.nextafter(most, -np.inf)))
    return feature, np.where(feature >= 0, cut, 0.0)


@dataclass
class _Nodes:
    """Nodes of all trees, the first one of each at its own number: ``child`` is the place of the left one, the right one follows (-1: not split).

    ``low`` and ``high`` have a line per feature and bound the rows' values; those of decided nodes are not kept up.
    """

    tree: np.ndarray
    node: np.ndarray
    low: np.ndarray
    high: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    size: np.ndarray
    state: np.ndarray
    tried: np.ndarray

    def joined(self, other: _Nodes) -> _Nodes:
        return _Nodes(*[np.concatenate([a, b], axis=-1) for a, b in zip(vars(self).values(), vars(other).values())])

    def at(self, places: np.ndarray) -> _Nodes:
        return _Nodes(*[a[..., places] for a in vars(self).values()])

    @property
    def depth(self) -> np.ndarray:
        return np.frexp(self.node.astype(float))[1] - 1

    def walk(self, cell: np.ndarray) -> _Descent:
        """For rows on their way down: nodes are numbered twice, so that a right child is one further; the last ones are their own children."""
        inner = self.feature >= 0
        child = np.repeat(2 * np.where(inner, self.child, np.arange(len(inner))), 2)
        child[1::2] += 2 * inner
        twice = lambda a: np.repeat(a, 2)
        return _Descent(twice(np.where(inner, self.feature, 0) * _TOGETHER), twice(self.cut), child, twice(inner), twice(cell), int(self.depth.max()) + 1)


def _fresh(tree: np.ndarray, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> _Nodes:
    none = np.full(len(tree), -1)
    return _Nodes(tree, node, low, high, none, np.zeros(len(tree)), none.copy(), np.zeros(len(tree), np.int64), np.full(len(tree), _OPEN), np.zeros(len(tree), np.int64))


@dataclass
class _Descent:
    """Where rows go: the feature's place in a block of ``_TOGETHER`` rows, the cut, the child, whether it goes on, and the last node's cell (-1: none)."""

    spot: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    inner: np.ndarray
    cell: np.ndarray
    steps: int

    def cells(self, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The cells that the rows of a block come to from the nodes ``at``."""
        out, rows = np.empty(len(at), np.intp), np.arange(len(at))
        at, live = 2 * at, rows
        for step in range(self.steps):
            right = flat.take(self.spot.take(at) + rows) > self.cut.take(at)
            at = self.child.take(at + right)
            if step % 3 == 2:  # rows that have arrived are left out
                on = np.flatnonzero(self.inner.take(at))
                if len(on) < 0.8 * len(at):
                    out[live] = at
                    at, rows, live = at[on], rows[on], live[on]
                    if not len(on):
                        break
        out[live] = at
        return self.cell.take(out)


def _blocks(batches: Iterator[pa.RecordBatch], n_features: int) -> Iterator[tuple[np.ndarray | None, np.ndarray, int]]:
    """Some rows at a time: their trees (None: all), the features after one another, ``_TOGETHER`` places each, and the number of rows."""
    for b in batches:
        x = [b.column(i).to_numpy(zero_copy_only=False) for i in range(n_features)]
        tree = b.column(n_features).to_numpy(zero_copy_only=False) if b.num_columns > n_features else None
        for k in range(0, b.num_rows, _TOGETHER):
            size = min(_TOGETHER, b.num_rows - k)
            flat = np.zeros(n_features * _TOGETHER)
            for i, column in enumerate(x):
                flat[i * _TOGETHER : i * _TOGETHER + size] = column[k : k + size]
            yield None if tree is None else tree[k : k + size].astype(np.intp), flat, size


def _cell_stats(rows: DataFrame, n_features: int, walk: _Descent, trees: np.ndarray, n_cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, least and greatest values of each cell, one pass over the rows; added up in the tasks."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, low, high = np.zeros(n_cells, np.int64), np.full((n_features, n_cells), np.inf), np.full((n_features, n_cells), -np.inf)
        for tree, flat, size in _blocks(batches, n_features):
            for t in trees if tree is None else [tree]:
                cell = walk.cells(flat, np.full(size, t, np.intp))
                live = np.flatnonzero(cell >= 0)
                cell = cell[live]
                np.add.at(count, cell, 1)
                for f in range(n_features):
                    column = flat.take(live + f * _TOGETHER)
                    np.minimum.at(low[f], cell, column)
                    np.maximum.at(high[f], cell, column)
        met = np.flatnonzero(count)
        for k in range(0, len(met), 20_000):
            some = met[k : k + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in (some, count[some], *low[:, some], *high[:, some])], names)

    ends = [f"{e}{i}" for e in ("lo", "hi") for i in range(n_features)]
    names = ["cell", "size", *ends]
    parts = rows.mapInArrow(gather, "cell long, size long, " + ", ".join(f"{c} double" for c in ends))
    found = _pandas(parts.groupBy("cell").agg(F.sum("size").alias("size"), *[(F.min if c.startswith("lo") else F.max)(c).alias(c) for c in ends]))
    count, low, high = np.zeros(n_cells, np.int64), np.full((n_features, n_cells), np.inf), np.full((n_features, n_cells), -np.inf)
    cell = found["cell"].to_numpy()
    count[cell] = found["size"].to_numpy()
    for i in range(n_features):
        low[i, cell], high[i, cell] = found[f"lo{i}"].to_numpy(), found[f"hi{i}"].to_numpy()
    return count, low, high


def _ahead(nodes: _Nodes, reach: np.ndarray, limit: int, seed: int) -> tuple[_Nodes, list[slice]]:
    """Splits drawn ahead below the given nodes, at most ``reach`` levels: the nodes and those below, level by level, and the levels."""
    most, out, levels, at = _CELL_VALUES // len(nodes.low), None, [], nodes
    ended = 0
    while True:
        at.feature, at.cut = _splits(at.tree, at.node, at.low, at.high, at.tried, seed)
        on = (at.feature >= 0) & (at.depth < limit) & (len(levels) < reach)
        if levels and ended + len(on) + on.sum() > most:
            on[:] = False
        at.feature[~on] = -1
        ended += len(on) - on.sum()
        begin = 0 if out is None else len(out.tree)
        levels.append(slice(begin, begin + len(on)))
        parent, feature = np.flatnonzero(on), at.feature[on]
        at.child[on] = begin + len(on) + 2 * np.arange(len(parent))
        out = at if out is None else out.joined(at)
        if not len(parent):
            return out, levels
        low, high = (np.repeat(a[:, parent], 2, axis=1) for a in (at.low, at.high))
        left = 2 * np.arange(len(parent))
        high[feature, left] = at.cut[parent]
        low[feature, left + 1] = at.cut[parent]
        below = 2 * np.repeat(at.node[parent], 2) + np.tile([0, 1], len(parent))
        reach = np.repeat(reach[parent], 2)
        at = _fresh(np.repeat(at.tree[parent], 2), below, low, high)


def _settled(ahead: _Nodes, levels: list[slice], most: int, limit: int, seed: int) -> np.ndarray:
    """Decides what can be of nodes whose last ones know their rows and values: marks those whose parents' splits all stand."""
    for level in levels[::-1]:
        inner = np.flatnonzero(ahead.child[level] >= 0) + level.start
        child = ahead.child[inner]
        ahead.size[inner] = ahead.size[child] + ahead.size[child + 1]
        ahead.low[:, inner] = np.minimum(ahead.low[:, child], ahead.low[:, child + 1])
        ahead.high[:, inner] = np.maximum(ahead.high[:, child], ahead.high[:, child + 1])
    stands = np.zeros(len(ahead.tree), bool)
    stands[levels[0]] = True
    for level in levels:
        at = np.flatnonzero(stands[level]) + level.start
        part = ahead.at(at)
        feature, _ = _splits(part.tree, part.node, part.low, part.high, part.tried, seed)
        place = np.arange(len(at))
        held = (part.child >= 0) & (part.feature == feature) & (part.low[feature, place] <= part.cut) & (part.cut < part.high[feature, place])
        small, shut = part.size <= most, (feature < 0) | (part.depth >= limit)
        ahead.state[at] = np.select([small, shut, held], [_TASK, _LEAF, _SPLIT], _OPEN)
        ahead.tried[at] += part.child >= 0
        split = at[ahead.state[at] == _SPLIT]
        stands[ahead.child[split]] = stands[ahead.child[split] + 1] = True
    ended = ahead.state != _SPLIT
    ahead.feature[ended], ahead.child[ended], ahead.cut[ended] = -1, -1, 0.0
    return stands


def _top(rows: DataFrame, n_features: int, size: int, trees: int, limit: int, seed: int, most: int) -> _Nodes:
    """The nodes of over ``most`` rows and those right below them."""
    x = _x(n_features)
    ends = rows.agg(*[f(c).alias(f"{k}{c}") for c in x for k, f in (("lo", F.min), ("hi", F.max))]).first()
    low, high = (np.repeat(np.array([[ends[f"{k}{c}"]] for c in x], float), trees, axis=1) for k in ("lo", "hi"))
    nodes = _fresh(np.arange(trees), np.ones(trees, np.int64), low, high)
    nodes.size[:] = size
    rows = rows.select(*x, *[c for c in rows.columns if c == "tree"])
    while len(open_ := np.flatnonzero(nodes.state == _OPEN)):
        # A pass looks no further below a node than it may well have over ``most`` rows.
        reach = np.ceil(3 * np.log2(np.maximum(nodes.size[open_] / most, 1.0))).astype(int) + 1
        ahead, levels = _ahead(nodes.at(open_), reach, limit, seed)
        place = np.concatenate([open_, len(nodes.tree) + np.arange(len(ahead.tree) - len(open_))])
        whole = nodes.joined(ahead.at(np.arange(len(open_), len(ahead.tree))))
        whole.feature[place], whole.cut[place], whole.child[place] = ahead.feature, ahead.cut, np.where(ahead.child >= 0, place[ahead.child], -1)
        last = np.flatnonzero(ahead.child < 0)
        cell = np.full(len(whole.tree), -1)
        cell[place[last]] = np.arange(len(last))
        ahead.size[last], ahead.low[:, last], ahead.high[:, last] = _cell_stats(rows, n_features, whole.walk(cell), np.unique(nodes.tree[open_]), len(last))
        stands = _settled(ahead, levels, most, limit, seed)
        # Nodes that stand keep their order, so siblings stay neighbours.
        new = np.flatnonzero(stands[len(open_) :]) + len(open_)
        place[new] = len(nodes.tree) + np.arange(len(new))
        ahead.child = np.where(ahead.child >= 0, place[ahead.child], -1)
        found = ahead.at(np.arange(len(open_)))
        for to, of in zip(vars(nodes).values(), vars(found).values()):
            to[..., open_] = of
        nodes = nodes.joined(ahead.at(new))
    return nodes


def _grown(rows: DataFrame, n_features: int, size: int, trees: int, limit: int, seed: int) -> DataFrame:
    """The nodes of all trees. ``rows`` are x0, x1, ... and the tree they belong to, or without it rows of every tree."""
    most = min(IN_TASK, max(DRAWN, TASK_VALUES // n_features))
    if size > most:
        top = _top(rows, n_features, size, trees, limit, seed, most)
    else:
        top = _fresh(np.arange(trees), np.ones(trees, np.int64), *np.zeros((2, n_features, trees)))
        top.state[:] = _TASK
    walk, number = top.walk(np.where(top.state == _TASK, np.arange(len(top.tree)), -1)), np.arange(trees)
    tree_of, node_of = top.tree.astype(np.int32), top.node

    def deal(flats: list[tuple[np.ndarray | None, np.ndarray, int]]) -> Iterator[pa.RecordBatch]:
        """Rows of the nodes for one task each, as the bytes of their features row by row."""
        x = np.concatenate([flat.reshape(n_features, -1)[:, :k] for _, flat, k in flats], axis=1).T.copy()
        for t in [None] if flats[0][0] is not None else number:
            cell = np.concatenate([walk.cells(flat, tree if t is None else np.full(k, t, np.intp)) for tree, flat, k in flats])
            live = np.flatnonzero(cell >= 0)
            if not len(live):
                continue
            live = live[np.argsort(cell[live], kind="stable")]
            cell = cell[live]
            first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            offsets = (np.append(first, len(live)) * 8 * n_features).astype(np.int32)
            held = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(x[live])])
            yield pa.RecordBatch.from_arrays([pa.array(tree_of[cell[first]]), pa.array(node_of[cell[first]]), held], ["tree", "node", "x"])

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flats, n = [], 0
        for block in _blocks(batches, n_features):
            flats.append(block)
            n += block[2]
            if n * n_features >= _DEALT:
                yield from deal(flats)
                flats, n = [], 0
        if flats:
            yield from deal(flats)

    def grow(key: tuple, group: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(group.column("x").to_pylist())).reshape(-1, n_features)
        return _grow_levels(key[0].as_py(), key[1].as_py(), x, limit, seed)

    rows = rows.select(*_x(n_features), *[c for c in rows.columns if c == "tree"])
    nodes = rows.mapInArrow(below, "tree int, node long, x binary").groupBy("tree", "node").applyInArrow(grow, _NODES)
    known = np.flatnonzero(top.state != _TASK)
    if not len(known):
        return nodes
    part = top.at(known)
    lines = zip(*[a.tolist() for a in (part.tree, part.node, part.feature, part.cut, part.size, part.depth)])
    return nodes.unionByName(rows.sparkSession.createDataFrame(list(lines), _NODES))


def _grow_levels(tree: int, root: int, x: np.ndarray, limit: int, seed: int) -> pa.Table:
    """Random splits below ``root`` until a point is alone, all points are equal or the depth limit; the nodes of a level together."""
    x, node, size, found = np.ascontiguousarray(x.T), np.array([root]), np.array([x.shape[0]]), []
    for depth in range(root.bit_length() - 1, limit + 1):
        start = np.cumsum(size) - size
        low, high = np.minimum.reduceat(x, start, axis=1), np.maximum.reduceat(x, start, axis=1)
        feature, cut = _splits(np.full(len(node), tree), node, low, high, 0, seed)
        if depth == limit:
            feature[:], cut[:] = -1, 0.0
        found.append((node, feature, cut, size, np.full(len(node), depth)))
        on = feature >= 0
        if not on.any():
            break
        if not on.all():
            x = x.take(np.flatnonzero(np.repeat(on, size)), axis=1)
        node, size, feature, cut = node[on], size[on], feature[on], cut[on]
        right = x.ravel().take(np.repeat(feature * x.shape[1], size) + np.arange(x.shape[1])) > np.repeat(cut, size)
        rights = np.add.reduceat(right, np.cumsum(size) - size, dtype=np.int64)
        x = x.take(np.concatenate([np.flatnonzero(~right), np.flatnonzero(right)]), axis=1)  # all left children, then all right ones
        node, size = np.concatenate([2 * node, 2 * node + 1]), np.concatenate([size - rights, rights])
    columns = [np.concatenate(c) for c in zip(*found)]
    types = [pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int32()]
    arrays = [pa.array(np.full(len(columns[0]), tree, np.int32)), *[pa.array(c.astype(t.to_pandas_dtype())) for c, t in zip(columns, types)]]
    return pa.table(arrays, names=["tree", "node", "feature", "threshold", "size", "depth"])


def _grow(tree: int, root: int, depth: int, x: np.ndarray, limit: int, rng: np.random.Generator) -> pd.DataFrame:
    """Random splits below ``root`` until a point is alone, all points are equal or the depth limit."""
    nodes, todo = [], [(x, root, depth)]
    while todo:
        rows, me, depth = todo.pop()
        low, high = rows.min(0), rows.max(0)
        open_features = np.flatnonzero(high > low) if depth < limit and len(rows) > 1 else ()
        if not len(open_features):
            nodes.append((tree, me, -1, 0.0, len(rows), depth))
            continue
        f = int(rng.choice(open_features))
        cut = float(rng.uniform(low[f], high[f]))
        goes_left = rows[:, f] <= cut
        nodes.append((tree, me, f, cut, len(rows), depth))
        todo.append((rows[~goes_left], 2 * me + 1, depth + 1))
        todo.append((rows[goes_left], 2 * me, depth + 1))
    return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "size", "depth"])


def _held(forest: StoredForest) -> Forest | StoredForest:
    """The forest as arrays if it has at most ``ARRAY_NODES`` nodes."""
    if forest.nodes.count() > ARRAY_NODES:
        return forest
    nodes = _pandas(forest.nodes).sort_values(["tree", "node"], kind="stable")
    groups = [part for _, part in nodes.groupby("tree")]
    shape = (len(groups), max(map(len, groups), default=1))
    arrays = {
        "feature": np.full(shape, -1, "int32"), "threshold": np.zeros(shape), "left": np.zeros(shape, "int32"),
        "right": np.zeros(shape, "int32"), "size": np.zeros(shape, "int64"), "depth": np.zeros(shape, "int32"),
    }
    for t, part in enumerate(groups):
        number, inner = part["node"].to_numpy(), part["feature"].to_numpy() >= 0
        for name in ("feature", "threshold", "size", "depth"):
            arrays[name][t, : len(part)] = part[name].to_numpy()
        for name, child in (("left", 2 * number), ("right", 2 * number + 1)):
            arrays[name][t, : len(part)] = np.where(inner, np.searchsorted(number, child), -1)
    return Forest(forest.features, forest.rows_per_tree, offset=forest.offset, fit_range=forest.fit_range, nodes=forest.nodes, **arrays)


def _pandas(df: DataFrame) -> pd.DataFrame:
    """The table by way of Arrow, whatever the session's setting."""
    return df.toArrow().to_pandas() if isinstance(df, DataFrame) else df.toPandas()


def _walk(forest: Forest) -> list[tuple]:
    """Per tree the arrays for walking down. A node's number is doubled, so its right child follows its left one; a leaf is its own child."""
    out = []
    for t in range(len(forest.feature)):
        inner = forest.feature[t] >= 0
        self_ = np.arange(len(inner), dtype=np.intp)
        child = np.empty(2 * len(inner), np.intp)
        child[0::2] = 2 * np.where(inner, forest.left[t], self_)
        child[1::2] = 2 * np.where(inner, forest.right[t], self_)
        out.append((np.repeat(np.where(inner, forest.feature[t], 0), 2).astype(np.intp), np.repeat(forest.threshold[t], 2), child, int(forest.depth[t].max())))
    return out


def _path_lengths(x: np.ndarray, trees: list[tuple], leaf: np.ndarray) -> np.ndarray:
    """Mean depth over the trees; the rows of a block go down a tree together."""
    n = len(x)
    total, leaf = np.zeros(n), np.repeat(leaf, 2, axis=1)
    for start in range(0, n, 4096):  # a block and its indexes stay in the cache
        flat = np.ascontiguousarray(x[start : start + 4096].T).ravel()
        size = len(x[start : start + 4096])
        rows, at, spot = np.arange(size), np.empty(size, np.intp), np.empty(size, np.intp)
        value, bound, right = np.empty(size), np.empty(size), np.empty(size, bool)
        for t, (feature, cut, child, depth) in enumerate(trees):
            offset = feature * size
            at[:] = 0
            for _ in range(depth):  # all places are valid: "clip" spares a copy
                offset.take(at, out=spot, mode="clip")
                np.add(spot, rows, out=spot)
                flat.take(spot, out=value, mode="clip")
                cut.take(at, out=bound, mode="clip")
                np.greater(value, bound, out=right)
                np.add(at, right, out=at)
                child.take(at, out=spot, mode="clip")
                at, spot = spot, at
            total[start : start + size] += leaf[t].take(at)
    return total / len(trees)


def _extra_path(n: Column) -> Column:
    """``average_path`` of a leaf's size."""
    many = 2.0 * (F.log(n - 1.0) + F.lit(float(np.euler_gamma))) - 2.0 * (n - 1.0) / n
    return F.when(n <= 1, 0.0).when(n == 2, 1.0).otherwise(many)


def _raw_by_descent(df: DataFrame, forest: StoredForest) -> DataFrame:
    """``df`` with raw_score: all rows go down all trees of the stored table together, one level a step."""
    numbered = materialise(df.withColumn(_ROW, F.monotonically_increasing_id()), "unscored")
    x = F.array(*[finite_or_zero(F.col(f).cast("double")) for f in forest.features]).alias("x")
    trees = F.explode(F.sequence(F.lit(0), F.lit(forest.trees - 1))).alias("tree")
    state, ended = numbered.select(_ROW, x, trees, F.lit(1).cast("long").alias("node")), []
    for depth in range((forest.nodes.agg(F.max("depth")).first()[0] or 0) + 1):
        level = forest.nodes.filter(F.col("depth") == depth)
        leaves = level.filter("feature < 0").select("tree", "node", (F.col("depth") + _extra_path(F.col("size").cast("double"))).alias("path"))
        ended.append(materialise(state.join(leaves, ["tree", "node"]).groupBy(_ROW).agg(F.sum("path").alias("path")), "paths"))
        splits = level.filter("feature >= 0")
        n_splits = splits.count()
        if not n_splits:
            break
        state = materialise(_down(state, splits, n_splits), "descent")
    paths = ended[0]
    for part in ended[1:]:
        paths = paths.unionByName(part)
    mean = paths.groupBy(_ROW).agg((F.sum("path") / forest.trees).alias("path"))
    scale = average_path(forest.rows_per_tree) or 1.0
    raw = -F.pow(F.lit(2.0), -F.col("path") / F.lit(scale))
    return numbered.join(mean, _ROW).withColumn("raw_score", raw).drop(_ROW, "path")


def score(df: DataFrame, forest: Forest | StoredForest) -> DataFrame:
    """Add raw_score, decision_score and is_anomaly; only the features leave the JVM, missing values as 0."""
    scored = _raw_by_descent(df, forest) if isinstance(forest, StoredForest) else _raw_by_arrays(df, forest)
    return scored.withColumn("decision_score", F.col("raw_score") - F.lit(forest.offset)).withColumn(
        "is_anomaly", (F.col("decision_score") < 0).cast("int")
    )


def _raw_by_arrays(df: DataFrame, forest: Forest) -> DataFrame:
    leaf = forest.leaf_value
    trees = _walk(forest)
    scale = average_path(forest.rows_per_tree) or 1.0

    @F.pandas_udf("double")
    def raw(points: pd.DataFrame) -> pd.Series:
        return pd.Series(-(2.0 ** (-_path_lengths(points.to_numpy("float64"), trees, leaf) / scale)))

    return df.withColumn("raw_score", raw(F.struct(*[finite_or_zero(F.col(f)).alias(f) for f in forest.features])))


def min_max_score(df: DataFrame, decision: str = "decision_score", fit_range: tuple[float, float] | None = None) -> DataFrame:
    """Add ``anomaly_score`` in [0, 1], 1 the most abnormal of the batch.

    The range is the batch's own unless ``fit_range`` fixes it, which is what a
    stream needs; values are then clipped.
    """
    inverted = -F.col(decision)
    if fit_range is not None:
        low, high = fit_range
        if high == low:
            return df.withColumn("anomaly_score", F.lit(0.0))
        scaled = (inverted - F.lit(low)) / F.lit(high - low)
        return df.withColumn("anomaly_score", F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0)))
    bounds = df.agg(F.min(inverted).alias("__lo"), F.max(inverted).alias("__hi"))
    width = F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0))
    return (
        df.crossJoin(F.broadcast(bounds))  # one row
        .withColumn("anomaly_score", F.coalesce((inverted - F.col("__lo")) / width, F.lit(0.0)))
        .drop("__lo", "__hi")
    )


def with_severity(df: DataFrame, bounds: dict[str, float] | None = None) -> DataFrame:
    return df.withColumn("severity", severity(F.col("anomaly_score"), F.col("is_anomaly"), bounds))


def detect(df: DataFrame, forest: Forest | StoredForest, normalise: str = "batch", bounds: dict[str, float] | None = None) -> DataFrame:
    """Rows with all result columns; ``normalise`` is "batch" or "fit"."""
    fit_range = forest.fit_range if normalise == "fit" else None
    return with_severity(min_max_score(score(df, forest), fit_range=fit_range), bounds)


def anomalies_only(df: DataFrame) -> DataFrame:
    return df.filter(F.col("is_anomaly") == 1)


def top_anomalies(df: DataFrame, n: int = 50, ties: Sequence[str] | None = None) -> DataFrame:
    return top_n(anomalies_only(df), n, "anomaly_score", ties)


def filter_anomalies(df: DataFrame, severities: Sequence[str], least: float = 0.0) -> DataFrame:
    return df.filter(F.col("severity").isin(list(severities)) & (F.col("anomaly_score") >= least))


def anomaly_summary(df: DataFrame) -> DataFrame:
    """One row: counts, rate, score mean and maximum, and rows per severity."""
    per = df.groupBy("severity").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("is_anomaly").cast("long")).alias("a"),
        F.sum("anomaly_score").alias("s"), F.max("anomaly_score").alias("m"),
    )
    total = F.sum("n")
    return per.agg(
        total.alias("total_rows"), F.sum("a").alias("anomaly_count"),
        percent(F.sum("a"), total).alias("anomaly_ratio"),
        F.round(F.sum("s") / total, 4).alias("avg_anomaly_score"),
        F.round(F.max("m"), 4).alias("max_anomaly_score"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("severity", "n")))).alias("severity_counts"),
    )


def anomaly_plane(rows: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """PC1, PC2, anomaly_score, is_anomaly, severity and ``keep`` of every scored row: where the anomalies lie on the principal plane."""
    shown = [*keep, "anomaly_score", "is_anomaly", "severity"]
    return pca_2d(rows.select(*shown, *features), shown)


@dataclass
class Anomalies:
    forest: Forest | StoredForest
    rows: DataFrame
    summary: DataFrame
    top: DataFrame
    plane: DataFrame


def anomaly_table(df: DataFrame, contamination: str | float = "auto", trees: int = 200,
                  max_samples: str | int | float = "auto", seed: int = 42, top: int = 50,
                  keep: Sequence[str] = ()) -> Anomalies:
    """Fit, score every row once, and summarise; ``keep`` columns are carried along."""
    x = materialise(spread(numeric_matrix(df, keep)), "features")
    plain = x.drop(*keep)
    forest = fit_forest(plain, trees, max_samples, seed, contamination)
    scored = materialise(score(x, forest), "scored")
    low, high = scored.agg(F.min(-F.col("decision_score")), F.max(-F.col("decision_score"))).first()
    forest.fit_range = (low, high)
    rows = with_severity(min_max_score(scored, fit_range=(low, high)))
    return Anomalies(forest, rows, anomaly_summary(rows), top_anomalies(rows, top), anomaly_plane(rows, forest.features, keep))
