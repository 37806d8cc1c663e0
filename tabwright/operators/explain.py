"""Why a row is an anomaly and what sets a cluster apart."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tabwright.operators.aggregates import weighted_means
from tabwright.operators.isolation import Forest

_LONG = "row_key long, feature string, value double, contribution double"


def contributions(df: DataFrame, forest: Forest, key: str, method: str = "shap") -> DataFrame:
    """(key, feature, value, contribution) of every row and feature.

    ``shap`` gives Shapley values of the mean path length under the trees' own
    row counts (negative: isolates the row sooner). ``depth`` adds, for every
    split on the row's paths, 1 / (depth + 1) to the split's feature.
    """
    names = forest.features
    kernel = {"shap": shapley_paths, "depth": depth_weights}[method]

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 64):
                part = batch.iloc[start : start + 64]
                x = part[names].to_numpy("float64")
                out = kernel(x, forest)
                yield pd.DataFrame(
                    {"row_key": np.repeat(part["row_key"].to_numpy(), len(names)),
                     "feature": np.tile(names, len(part)), "value": x.ravel(), "contribution": out.ravel()}
                )

    rows = df.select(F.col(key).alias("row_key"), *names)
    return rows.mapInPandas(explain, _LONG).withColumnRenamed("row_key", key)


def depth_weights(x: np.ndarray, forest: Forest) -> np.ndarray:
    out = np.zeros((len(x), len(forest.features)))
    rows = np.arange(len(x))
    for t in range(len(forest.feature)):
        at = np.zeros(len(x), "int32")
        for depth in range(int(forest.depth[t].max())):
            f = forest.feature[t][at]
            inner = f >= 0
            np.add.at(out, (rows[inner], f[inner]), 1.0 / (depth + 1))
            down = np.where(x[rows, f] <= forest.threshold[t][at], forest.left[t][at], forest.right[t][at])
            at = np.where(inner, down, at)
    return out


def shapley_paths(x: np.ndarray, forest: Forest) -> np.ndarray:
    """Shapley values of the mean leaf value, summed leaf by leaf.

    For one leaf, the features on its path are players: with the row's value
    known, player i lets the row through with o_i in {0, 1}; unknown, with z_i,
    the share of training rows. The value of a set is the product, so a player's
    Shapley value is (o_i - z_i) times the average, over set sizes, of the
    elementary products of the others.
    """
    out = np.zeros((len(x), len(forest.features)))
    values = forest.leaf_value
    for t in range(len(forest.feature)):
        for leaf, path in _leaf_paths(forest, t):
            players = sorted({f for f, *_ in path})
            if not players:
                continue
            o = np.ones((len(x), len(players)))
            z = np.ones(len(players))
            for f, cut, is_left, share in path:
                i = players.index(f)
                o[:, i] *= (x[:, f] <= cut) == is_left
                z[i] *= share
            out[:, players] += values[t][leaf] * _shapley_product(o, z)
    return out / len(forest.feature)


def _leaf_paths(forest: Forest, t: int):
    todo = [(0, [])]
    while todo:
        node, path = todo.pop()
        f = forest.feature[t][node]
        if f < 0:
            yield node, path
            continue
        for child, is_left in ((forest.left[t][node], True), (forest.right[t][node], False)):
            share = forest.size[t][child] / forest.size[t][node]
            todo.append((child, path + [(f, forest.threshold[t][node], is_left, share)]))


def _shapley_product(o: np.ndarray, z: np.ndarray) -> np.ndarray:
    m = o.shape[1]
    weights = np.array([1.0 / (m * math.comb(m - 1, s)) for s in range(m)])
    out = np.empty_like(o)
    for i in range(m):
        # poly[s]: sum over sets of s known players among the others.
        poly = np.zeros((len(o), m))
        poly[:, 0] = 1.0
        for j in range(m):
            if j != i:
                shifted = np.zeros_like(poly)
                shifted[:, 1:] = poly[:, :-1] * o[:, [j]]
                poly = poly * z[j] + shifted
        out[:, i] = (o[:, i] - z[i]) * (poly @ weights)
    return out


def top_contributions(long: DataFrame, key: str, n: int = 3, method: str = "shap") -> DataFrame:
    """The ``n`` features that push a row furthest towards being an anomaly."""
    strength = -F.col("contribution") if method == "shap" else F.col("contribution")
    rows = long if method == "shap" else long.filter("contribution > 0")
    order = W.partitionBy(key).orderBy(F.desc(strength), "feature")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).withColumn(
        "direction", F.when(F.col("value") > 0, "above").otherwise("below")
    )


def with_real_values(long: DataFrame, scaling: DataFrame, value: str, into: str, digits: int = 3) -> DataFrame:
    """Undo scaling and skew correction of a long (feature, value) column."""
    x = F.col(value) * F.col("scale") + F.col("center")
    lam = F.col("lambda")
    y = x * F.col("std") + F.col("mean_")
    up = F.when(lam == 0, F.expm1(y)).otherwise(F.pow(F.greatest(y * lam + 1, F.lit(0.0)), 1 / F.nullif(lam, F.lit(0.0))) - 1)
    two = 2 - lam
    down = F.when(lam == 2, -F.expm1(-y)).otherwise(1 - F.pow(F.greatest(1 - y * two, F.lit(0.0)), 1 / F.nullif(two, F.lit(0.0))))
    real = (
        F.when(F.col("method") == "Log1p", F.expm1(x))
        .when(F.col("method") == "Yeo-Johnson", F.when(y >= 0, up).otherwise(down))
        .otherwise(x)
    )
    side = scaling.withColumnRenamed("mean", "mean_")
    return long.join(F.broadcast(side), "feature", "left").withColumn(into, F.round(real, digits)).drop(  # one row per feature
        "center", "scale", "method", "lambda", "mean_", "std"
    )


def counterfactuals(rows: DataFrame, centers: DataFrame, features: list[str], key: str, n: int = 2) -> DataFrame:
    """Per row the features furthest from its own cluster centre and their targets.

    The centres come as one row per cluster; the features are ranked within the row.
    """
    aims = centers.groupBy("cluster").agg(F.map_from_entries(F.collect_list(F.struct("feature", "center"))).alias("__aims"))
    met = rows.select(key, "cluster", *features).join(aims, "cluster")
    gap = lambda f: F.abs(F.col(f) - F.col("__aims")[f])
    spots = [
        F.struct(F.coalesce(-gap(f), F.lit(float("inf"))).alias("order"), F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"),
                 F.col("__aims")[f].alias("target"), gap(f).alias("gap"))
        for f in sorted(features)
    ]
    known = F.filter(F.array(*spots), lambda s: s["target"].isNotNull())
    best = met.select(key, "cluster", F.posexplode(F.slice(F.array_sort(known), 1, n)).alias("i", "s"))
    return best.select(key, "cluster", (F.col("i") + 1).alias("rank"), "s.feature", "s.value", "s.target", "s.gap")


def cluster_traits(profile: DataFrame, n: int = 3) -> DataFrame:
    """For the leading features of each cluster, the side of the weighted mean it lies on."""
    overall = weighted_means(profile)
    m = F.col("weighted_mean")
    direction = F.when(m.isNull() | (m == 0), F.lit(None)).when(F.col("mean") > m, "above").otherwise("below")
    order = W.partitionBy("cluster").orderBy("rank")
    return (
        profile.join(overall, "feature").withColumn("trait", F.row_number().over(order))
        .filter(F.col("trait") <= n)
        .select("cluster", "size", "percentage", "trait", "feature", "mean", direction.alias("direction"))
    )
