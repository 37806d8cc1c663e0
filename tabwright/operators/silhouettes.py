"""Euclidean silhouettes of all rows between exact bounds, from cells instead of pairs.

Every cluster is quantised into cells, of which the number of rows, mean, mean squared radius v and largest radius R are kept. With d the
distance of a row to a cell's mean, its mean distance to the cell's rows lies between max(d, (d^2 + v) / (d + R))
and sqrt(d^2 + v): the norm is convex, the root concave, and no row of the cell is farther than d + R. Cells of equal rows leave
no gap, so a table of no more rows than cells is measured exactly. The cost is rows times cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.operators.columns import numeric_columns, numeric_matrix
from tabwright.operators.ranking import rank_values
from tabwright.operators.sampling import sample_rows
from tabwright.session import materialise, spread

#: Rows dealt to cells and rows measured at once: few enough for their distances to stay in the cache.
_DEALT, _MEASURED = 256, 128


@dataclass
class Cells:
    """``group`` per cell, and the other measures in the same order; cells without rows are left out."""

    group: np.ndarray
    count: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    radius: np.ndarray


def _distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    d = x @ (-2 * points.T)
    d += (x * x).sum(1)[:, None]
    d += (points * points).sum(1)
    np.maximum(d, 0.0, out=d)
    return np.sqrt(d, out=d)


def _arrays(b: pa.RecordBatch, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The groups and points of a batch, a part at a time."""
    for k in range(0, b.num_rows, rows):
        part = b.slice(k, rows)
        yield part.column(0).to_numpy(), part.column(1).flatten().to_numpy().reshape(part.num_rows, -1)


def _nearest(group: np.ndarray, x: np.ndarray, cell_group: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The nearest cell of its own group for each row."""
    at = np.empty(len(x), np.int64)
    for g in np.unique(group):
        mine, cells = np.flatnonzero(group == g), np.flatnonzero(cell_group == g)
        at[mine] = cells[_distances(x[mine], points[cells]).argmin(1)]
    return at


def _gathered(rows: DataFrame, cell_group: np.ndarray, points: np.ndarray, around: np.ndarray | None = None) -> pd.DataFrame:
    """Per cell its number of rows and their sum; with ``around`` (the means) also squared and largest distances. Added up within tasks first."""
    width = points.shape[1]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = len(points)
        count, total, squares, largest = np.zeros(m, np.int64), np.zeros((m, width)), np.zeros(m), np.zeros(m)
        for b in batches:
            for group, x in _arrays(b, _DEALT):
                at = _nearest(group, x, cell_group, points)
                count += np.bincount(at, minlength=m)
                for i in range(width):
                    total[:, i] += np.bincount(at, x[:, i], m)
                if around is not None:
                    d = np.sqrt(((x - around[at]) ** 2).sum(1))
                    squares += np.bincount(at, d * d, m)
                    np.maximum.at(largest, at, d)
        met = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(met), pa.array(count[met]), pa.array(list(total[met]), pa.list_(pa.float64())), pa.array(squares[met]), pa.array(largest[met])],
            ["cell", "n", "total", "squares", "largest"],
        )

    parts = rows.mapInArrow(gather, "cell long, n long, total array<double>, squares double, largest double")
    sums = [F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(width)]
    return parts.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("squares").alias("squares"), F.max("largest").alias("largest"), *sums).toPandas().sort_values("cell")


def fit_cells(rows: DataFrame, n_groups: int, cells: int, seed: int, rounds: int = 2) -> Cells:
    """Cells of the stored rows (``group``, ``x``): around sampled rows, moved to their rows' mean ``rounds`` times."""
    drawn = sample_rows(rows.select("group", "x"), cells, seed).dropDuplicates().toPandas()
    missing = sorted(set(range(n_groups)) - set(drawn["group"]))
    if missing:  # small groups that no sampled row falls into start from one of their rows
        first = rows.filter(F.col("group").isin(missing)).groupBy("group").agg(F.min("x").alias("x")).toPandas()
        drawn = pd.concat([drawn, first], ignore_index=True)
    drawn = drawn.sort_values(["group"], kind="stable")
    group, points = drawn["group"].to_numpy("int64"), np.vstack(drawn["x"].to_numpy())
    width = points.shape[1]
    for _ in range(rounds):
        got = _gathered(rows, group, points)
        at = got["cell"].to_numpy()
        group, points = group[at], got[[f"t{i}" for i in range(width)]].to_numpy() / got["n"].to_numpy()[:, None]
    got = _gathered(rows, group, points)
    at = got["cell"].to_numpy()
    means = points.copy()
    means[at] = got[[f"t{i}" for i in range(width)]].to_numpy() / got["n"].to_numpy()[:, None]
    last = _gathered(rows, group, points, means)
    n = last["n"].to_numpy()
    return Cells(group[at], n, means[at], last["squares"].to_numpy() / n, last["largest"].to_numpy())


def bounds(group: np.ndarray, x: np.ndarray, cells: Cells, n_groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower bound, upper bound and estimate of each row's silhouette; 0 for the only row of a group."""
    d = _distances(x, cells.mean)
    squares = d * d
    squares += cells.spread
    low = d + cells.radius
    np.maximum(low, 1e-300, out=low)
    np.divide(squares, low, out=low)
    np.maximum(low, d, out=low)
    high = np.sqrt(squares, out=squares)
    np.minimum(low, high, out=low)
    member = np.zeros((len(cells.group), n_groups))
    member[np.arange(len(cells.group)), cells.group] = cells.count
    size = member.sum(0)
    own = np.arange(len(x)), group

    def parts(total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = total[own] / np.maximum(size[group] - 1, 1)
        mean = total / np.maximum(size, 1)
        mean[own] = np.inf
        mean[:, size == 0] = np.inf
        return a, mean.min(1)

    nearer, farther = low @ member, high @ member
    (a_low, b_low), (a_high, b_high), (a, b) = parts(nearer), parts(farther), parts((nearer + farther) / 2)

    def silhouette(inner: np.ndarray, outer: np.ndarray) -> np.ndarray:
        widest = np.maximum(inner, outer)
        return np.where((widest > 0) & (size[group] > 1), (outer - inner) / np.where(widest > 0, widest, 1), 0.0)

    return silhouette(a_high, b_low), silhouette(a_low, b_high), silhouette(a, b)


def silhouette_bounds(df: DataFrame, label: str = "cluster", cells: int = 1024, seed: int = 42) -> DataFrame | None:
    """One row: low, high, silhouette (the estimate in between) and rows, over all rows with a label; NULL below two groups.

    The exact mean Euclidean silhouette lies between ``low`` and ``high``. ``cells`` bounds what the driver and the tasks hold.
    Missing and infinite values count as 0.
    """
    features = numeric_columns(df, exclude=[label])
    given = df.filter(F.col(label).isNotNull())
    groups = rank_values(given.select(label).distinct(), label, "group")
    n_groups = groups.count()
    if n_groups < 2:
        return None
    x = F.array(*[F.col(f).cast("double") for f in features]).alias("x")
    joined = numeric_matrix(given.select(label, *features), [label]).join(groups, label)
    rows = materialise(spread(joined.select("group", x)), "silhouette")
    found = fit_cells(rows, n_groups, cells, seed)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(3), 0
        for b in batches:
            for group, points in _arrays(b, _MEASURED):
                sums += [v.sum() for v in bounds(group, points, found, n_groups)]
                n += len(group)
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*sums, n)], ["low", "high", "estimate", "n"])

    per_task = rows.mapInArrow(measure, "low double, high double, estimate double, n long")
    total = F.sum("n")
    return per_task.agg(*[(F.sum(c) / total).alias(to) for c, to in (("low", "low"), ("high", "high"), ("estimate", "silhouette"))], total.alias("rows"))
