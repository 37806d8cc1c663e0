"""A hint at the number of dense groups: every row is counted into a cell of the principal plane, and dense cells are linked.

The cells are the only thing the driver sees, at most ``side`` x ``side`` of them however many rows there are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SIDE = 64


@dataclass
class DensityHint:
    n_clusters: int | None
    n_noise: int | None
    noise_ratio: float | None


def cell_counts(plane: DataFrame, side: int = _SIDE) -> DataFrame:
    """(i, j, n): rows per cell of a ``side`` x ``side`` grid over the range of PC1 and PC2."""
    low = plane.agg(F.min("PC1").alias("a"), F.max("PC1").alias("b"), F.min("PC2").alias("c"), F.max("PC2").alias("d"))

    def place(v: str, least: str, most: str):
        at = F.floor((F.col(v) - F.col(least)) / F.nullif(F.col(most) - F.col(least), F.lit(0.0)) * side)
        return F.coalesce(F.least(at, F.lit(side - 1)), F.lit(0)).cast("int")

    return plane.crossJoin(F.broadcast(low)).select(place("PC1", "a", "b").alias("i"), place("PC2", "c", "d").alias("j")).groupBy("i", "j").agg(  # one row
        F.count(F.lit(1)).alias("n")
    )


def _neighbours(grid: np.ndarray, reach: int = 1) -> np.ndarray:
    """Rows within ``reach`` cells of each cell."""
    padded = np.pad(grid, reach)
    n, m = grid.shape
    return sum(padded[a : a + n, b : b + m] for a in range(2 * reach + 1) for b in range(2 * reach + 1))


def dense_groups(grid: np.ndarray, min_cluster_size: int) -> tuple[int, int]:
    """How many groups of touching dense cells hold at least ``min_cluster_size`` rows, and the rows outside of them.

    Of all density levels the one with the most such groups counts (the lowest of equals), as long as half of the rows are in them.
    """
    total, best = int(grid.sum()), (0, int(grid.sum()))
    smooth = _neighbours(grid)
    for level in np.unique(np.quantile(smooth[grid > 0], np.linspace(0, 0.9, 19))) if total else ():
        sizes = _sizes(smooth >= level, grid)
        kept = sizes[sizes >= min_cluster_size]
        noise = total - int(kept.sum())
        if len(kept) > best[0] and 2 * noise <= total:
            best = len(kept), noise
    return best


def _sizes(dense: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """Rows per group of dense cells that touch, corners included."""
    label = np.where(dense & (grid > 0), np.arange(1, grid.size + 1).reshape(grid.shape), 0)
    while True:
        padded = np.pad(label, 1)
        n, m = grid.shape
        highest = np.maximum.reduce([padded[a : a + n, b : b + m] for a in range(3) for b in range(3)])
        spread = np.where(label > 0, highest, 0)
        if (spread == label).all():
            break
        label = spread
    return np.array([int(grid[label == g].sum()) for g in np.unique(label[label > 0])], np.int64)


def density_hint(plane: DataFrame, min_cluster_size: int = 100, side: int = _SIDE) -> DensityHint:
    """Dense groups and the share of rows outside them, from the rows' PC1 and PC2; all counts are NULL without rows."""
    grid = np.zeros((side, side), np.int64)
    for r in cell_counts(plane, side).collect():  # at most side * side rows
        grid[r["i"], r["j"]] = r["n"]
    total = int(grid.sum())
    if not total:
        return DensityHint(None, None, None)
    found, noise = dense_groups(grid, min_cluster_size)
    return DensityHint(found, noise, round(100.0 * noise / total, 2))
