"""Skewness, power transforms, outliers, moments and correlation of many columns.

Each function scans once for all columns; what comes back to the driver is a
fixed number of scalars per column or column pair.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions import scalars as S
from tabwright.session import materialise, spread

# What is done about the outliers of a column.
WINSORISED = "Winsorized"
FLAGGED = "Flagged only - delegated to Isolation Forest"
UNTREATED = "None"


def _long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, x): one aggregate over this serves all columns with little code."""
    return df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "column", "x")


def skew_stats(df: DataFrame, columns: Sequence[str]) -> dict[str, dict]:
    """Skewness before and after log1p, and the minimum, of each column."""
    if not columns:
        return {}
    x = F.col("x")
    rows = _long(df, columns).groupBy("column").agg(
        S.adjusted_skewness(x).alias("skew"), S.adjusted_skewness(S.log1p_clipped(x)).alias("skew_log1p"),
        F.min(x).alias("min"),
    ).collect()
    found = {r["column"]: {k: r[k] for k in ("skew", "skew_log1p", "min")} for r in rows}
    return {c: found[c] for c in columns}


def skew_report(stats: dict[str, dict]) -> list[dict]:
    rows = [
        {"column": c, "skewness": None if s["skew"] is None else round(s["skew"], 3),
         "abs_skewness": None if s["skew"] is None else round(abs(s["skew"]), 3)}
        for c, s in stats.items()
    ]
    return sorted(rows, key=lambda r: (-(r["abs_skewness"] or 0.0), r["column"]))


def skewness_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, skewness, abs_skewness), most skewed first."""
    return (
        _long(df, columns).groupBy("column").agg(S.adjusted_skewness(F.col("x")).alias("__s"))
        .select("column", F.round("__s", 3).alias("skewness"), F.round(F.abs("__s"), 3).alias("abs_skewness"))
        .orderBy(F.desc_nulls_last("abs_skewness"), "column")
    )


#: Lambdas of the first scan, and their distance; the second scan has as many in between, around the best.
_COARSE, _STEP, _FINE = np.arange(-6.0, 6.01, 0.5), 0.5, 10


def _power_moments(rows: DataFrame, columns: Sequence[str], grids: dict[str, np.ndarray]) -> dict[str, tuple[float, float, np.ndarray]]:
    """Per column the number of values, the sum of their log-Jacobians and the variance at every lambda of its grid, in one scan.

    Tasks add up (n, mean, M2) for the whole grid batch by batch, missing and infinite values left out; the tasks' rows are
    merged around the common means, so nothing cancels.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(next(iter(grids.values())))
        n, jacobian = np.zeros(len(columns)), np.zeros(len(columns))
        mean, m2 = np.zeros((len(columns), size)), np.zeros((len(columns), size))
        for b in batches:
            for i, c in enumerate(columns):
                x = b.column(i).to_numpy(zero_copy_only=False)
                x = x[np.isfinite(x)]
                if not len(x):
                    continue
                log, lam = np.log1p(np.abs(x)), grids[c]
                jacobian[i] += (np.sign(x) * log).sum()
                total = n[i] + len(x)
                for j, power in enumerate(lam):
                    with np.errstate(over="ignore", invalid="ignore"):
                        y = _yeo_johnson(x, log, power)
                        own = y.mean()
                        gap = own - mean[i, j]
                        m2[i, j] += ((y - own) ** 2).sum() + gap * gap * n[i] * len(x) / total
                        mean[i, j] += gap * len(x) / total
                n[i] = total
        at = np.repeat(np.arange(len(columns)), size)
        yield pa.RecordBatch.from_arrays(
            [pa.array(v) for v in (at, np.tile(np.arange(size), len(columns)), n[at], jacobian[at], mean.ravel(), m2.ravel())],
            ["column", "place", "n", "g", "mean", "m2"],
        )

    parts = materialise(rows.mapInArrow(gather, "column long, place long, n double, g double, mean double, m2 double").filter("n > 0"), "power-moments")
    key = ["column", "place"]
    common = parts.groupBy(*key).agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("common"))  # a row per column and lambda
    merged = parts.join(F.broadcast(common), key).groupBy(*key).agg(
        F.sum("n").alias("n"), F.sum("g").alias("g"), (F.sum(F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("common"), 2)) / F.sum("n")).alias("v"),
        F.first("common").alias("common"),
    ).withColumn("v", F.when(F.col("v") > 1e-24 * (1 + F.col("common") * F.col("common")), F.col("v")))  # below that it is rounding
    out = {}
    for r in merged.collect():
        n, g, v = out.setdefault(columns[r["column"]], (r["n"], r["g"], np.full(len(next(iter(grids.values()))), np.nan)))
        v[r["place"]] = np.nan if r["v"] is None else r["v"]
    return out


def _yeo_johnson(x: np.ndarray, log: np.ndarray, power: float) -> np.ndarray:
    """The transform of values whose log1p(|x|) is known."""
    above = log if power == 0 else np.expm1(power * log) / power
    below = -log if power == 2 else -np.expm1((2 - power) * log) / (2 - power)
    return np.where(x >= 0, above, below)


def _likelihoods(found: tuple[float, float, np.ndarray], grid: np.ndarray) -> np.ndarray:
    n, g, v = found
    usable = np.isfinite(v) & (v > 0)
    return np.where(usable, -n / 2 * np.log(np.where(usable, v, 1.0)) + (grid - 1) * g, -np.inf)


def _peak(grid: np.ndarray, height: np.ndarray) -> float:
    """Where the curve through the five points around the highest one has its maximum."""
    top = int(np.argmax(height))
    low = min(max(top - 2, 0), len(grid) - 5)
    near, values = grid[low : low + 5] - grid[top], height[low : low + 5]
    if not np.isfinite(values).all():
        return float(grid[top])
    curve = np.polynomial.Polynomial.fit(near, values - values.max(), 4)
    turns = [r.real for r in curve.deriv().roots() if abs(r.imag) < 1e-9 and near[0] <= r.real <= near[-1]]
    return float(grid[top] + max([0.0, *turns], key=curve))


def fit_yeo_johnson(df: DataFrame, columns: Sequence[str]) -> dict[str, dict]:
    """Lambda of highest likelihood per column (between -6.5 and 6.5), with moments of the result.

    Two scans find it to well below 1e-3: one over a coarse grid, one over a fine grid around each column's best, whose peak is
    read off a curve. A third takes the moments of the transformed columns. A column without a usable lambda gets 0.
    """
    if not columns:
        return {}
    columns = list(columns)
    rows = spread(df.select(*[F.col(c).cast("double").alias(c) for c in columns]))
    grids = dict.fromkeys(columns, _COARSE)
    found = _power_moments(rows, columns, grids)
    best = {c: float(_COARSE[int(np.argmax(_likelihoods(found[c], _COARSE)))]) for c in found if np.isfinite(_likelihoods(found[c], _COARSE)).any()}
    fine = np.linspace(-_STEP, _STEP, 2 * _FINE + 1)
    grids = {c: best.get(c, 0.0) + fine for c in columns}
    found = _power_moments(rows, columns, grids)
    centers = {c: _peak(grids[c], _likelihoods(found[c], grids[c])) if c in best else 0.0 for c in columns}
    aggs = []
    for i, c in enumerate(columns):
        y = S.yeo_johnson(F.col(c), centers[c])
        aggs += [F.avg(y).alias(f"m{i}"), F.stddev_pop(y).alias(f"d{i}"), S.adjusted_skewness(y).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    return {
        c: {"lambda": centers[c], "mean": row[f"m{i}"], "std": row[f"d{i}"] or 1.0, "skew": row[f"s{i}"]}
        for i, c in enumerate(columns)
    }


def outliers(df: DataFrame, quartiles: dict[str, list], n_rows: int) -> tuple[list[dict], dict[str, dict]]:
    """Share of rows beyond 1.5 IQR and the treatment it leads to."""
    fences, flat = {}, {}
    for c, (q1, _, q3) in quartiles.items():
        if q1 is None:
            continue
        if q3 == q1:
            flat[c] = {"lower": q1, "upper": q3, "ratio": 0.0, "action": UNTREATED}
        else:
            fences[c] = (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    counts = {}
    if fences:
        row = df.agg(
            *[F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias(f"o{i}") for i, (c, (lo, hi)) in enumerate(fences.items())]
        ).first()
        counts = {c: row[f"o{i}"] for i, c in enumerate(fences)}
    report, treated = [], {}
    for c in quartiles:
        if c in flat:
            treated[c] = flat[c]
        elif c in fences:
            ratio = counts[c] * 100 / n_rows
            action = WINSORISED if 5 <= ratio <= 15 else FLAGGED if ratio > 15 else UNTREATED
            lo, hi = fences[c]
            treated[c] = {"lower": lo, "upper": hi, "ratio": ratio, "action": action}
            report.append({"column": c, "lower_bound": round(lo, 3), "upper_bound": round(hi, 3),
                           "outlier_count": counts[c], "outlier_ratio": round(ratio, 2)})
    return report, treated


def choose_scaler(ratios: Sequence[float]) -> str:
    rounded = [round(r, 2) for r in ratios]
    return "RobustScaler" if rounded and sum(rounded) / len(rounded) >= 5 else "StandardScaler"


def moments_and_correlation(df: DataFrame, columns: Sequence[str]):
    """Mean, population deviation, range per column and correlation per pair.

    The second pass sums products of centred values: each task keeps one square
    matrix, and only the matrices' cells are shuffled.
    """
    columns = list(columns)
    x = F.col("x")
    rows = _long(df, columns).groupBy("column").agg(
        F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max")
    ).collect()
    moments = {r["column"]: {k: r[k] for k in ("mean", "std", "min", "max")} for r in rows}
    means = np.array([moments[c]["mean"] or 0.0 for c in columns])
    width = len(columns)

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for batch in batches:
            centred = np.nan_to_num(batch.to_numpy("float64") - means)
            total += centred.T @ centred
        i, j = np.triu_indices(width)
        yield pd.DataFrame({"i": i, "j": j, "s": total[i, j]})

    cells = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).mapInPandas(products, "i int, j int, s double")
    sums = {(r["i"], r["j"]): r["s"] for r in cells.groupBy("i", "j").agg(F.sum("s").alias("s")).collect()}
    corr: dict[tuple[str, str], float | None] = {}
    for i, j in itertools.combinations(range(width), 2):
        flat = any(moments[columns[k]]["min"] == moments[columns[k]]["max"] for k in (i, j))
        corr[(columns[i], columns[j])] = None if flat else sums[(i, j)] / math.sqrt(sums[(i, i)] * sums[(j, j)])
    moments = {c: moments[c] for c in columns}
    return moments, corr


def correlated(columns: Sequence[str], corr: dict, threshold: float) -> list[str]:
    """Columns too close to any earlier one, whether or not that one is dropped."""
    return [
        c for k, c in enumerate(columns)
        if any(abs(corr[(a, c)] or 0.0) > threshold for a in columns[:k])
    ]


def correlation_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(left, right, correlation) of every pair of columns, NULL where either is constant or they share no rows.

    One scan for any number of columns: tasks add up square matrices (rows with both values: count, sums, squares, products) around a value of
    the first batch, so large means don't cancel; only the matrices' cells are shuffled.
    """
    columns = list(columns)
    width = len(columns)
    first = df.select(*[F.first(F.col(c).cast("double"), ignorenulls=True).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    centre = np.array([first[f"c{i}"] or 0.0 for i in range(width)], float)
    centre[~np.isfinite(centre)] = 0.0
    names = ["n", "a", "b", "aa", "bb", "ab"]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {name: np.zeros((width, width)) for name in names}
        for batch in batches:
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(width)]) - centre
            there = (~np.isnan(x)).astype("float64")
            x = np.nan_to_num(x)
            squares = x * x
            for name, left, right in (("n", there, there), ("a", x, there), ("b", there, x), ("aa", squares, there), ("bb", there, squares), ("ab", x, x)):
                total[name] += left.T @ right
        i, j = np.triu_indices(width, 1)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), *(pa.array(total[name][i, j]) for name in names)], ["i", "j", *names])

    cells = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).mapInArrow(gather, "i long, j long, " + ", ".join(f"{n} double" for n in names))
    sums = cells.groupBy("i", "j").agg(*[F.sum(n).alias(n) for n in names])
    part = lambda product, one, other: F.col(product) - F.col(one) * F.col(other) / F.col("n")
    over = lambda c: F.when(part(c + c, c, c) > F.col(c + c) * 1e-13, part(c + c, c, c))
    titles = F.array(*[F.lit(c) for c in columns])
    return sums.select(
        F.get(titles, F.col("i").cast("int")).alias("left"), F.get(titles, F.col("j").cast("int")).alias("right"),
        (part("ab", "a", "b") / F.sqrt(over("a") * over("b"))).alias("correlation"),
    )


def scale_expr(c: Column, center: float, scale: float) -> Column:
    return (c - F.lit(center)) / F.lit(scale if scale else 1.0)
