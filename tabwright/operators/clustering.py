"""Segmentation: k-means, the search for k, quality measures and profiles."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tabwright.functions.scalars import finite_or_zero, percent
from tabwright.operators.aggregates import long_group_means
from tabwright.operators.columns import numeric_columns, numeric_matrix
from tabwright.operators.density import DensityHint, density_hint
from tabwright.operators.lloyd import Points, Run, moments, run_together, silhouettes, store_points
from tabwright.operators.sampling import row_hash
from tabwright.operators.silhouettes import silhouette_bounds
from tabwright.session import materialise, spread

#: From here on the report calls a table large; nothing else depends on it.
LARGE_ROWS = 100_000
_VECTOR = "__features"


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=_VECTOR).transform(df)


@dataclass
class KMeansFit:
    """Centres found by k-means, in the order of ``features``."""

    features: list[str]
    centers: list[list[float]]
    sizes: list[int]
    cost: float
    iterations: int

    @property
    def k(self) -> int:
        return len(self.centers)

    def assign(self, df: DataFrame) -> DataFrame:
        """Add ``cluster``, the nearest centre of each row, missing values as 0; works on streams too."""
        centers = np.array(self.centers)

        @F.pandas_udf("int")
        def nearest(points: pd.DataFrame) -> pd.Series:
            return pd.Series(_squares(points.to_numpy("float64"), centers).argmin(1).astype("int32"))

        return df.withColumn("cluster", nearest(F.struct(*[finite_or_zero(F.col(f)).alias(f) for f in self.features])))

    def center_table(self, spark) -> DataFrame:
        """(cluster, feature, center): k times the number of features rows."""
        rows = [(i, f, c[j]) for i, c in enumerate(self.centers) for j, f in enumerate(self.features)]
        return spark.createDataFrame(rows, "cluster int, feature string, center double")

    def save(self, spark, path: str) -> None:
        self.center_table(spark).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark, path: str, features: Sequence[str]) -> KMeansFit:
        table = spark.read.parquet(path).toPandas()
        wide = table.pivot(index="cluster", columns="feature", values="center").sort_index()
        centers = wide[list(features)].to_numpy().tolist()
        return KMeansFit(list(features), centers, [], 0.0, 0)


def _squares(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (centers * centers).sum(1) - 2 * x @ centers.T, 0.0)


def _fitted(points: Points, run: Run) -> KMeansFit:
    return KMeansFit(points.features, (run.centers + np.array(points.means)).tolist(), run.sizes.tolist(), run.cost, run.iterations)


def _fit_stored(points: Points, k: int, seeds: Sequence[Sequence[int]], max_iter: int = 100, tol: float = 1e-4) -> list[KMeansFit]:
    """For each list of seeds the cheapest of its runs; all runs go over the stored rows together."""
    if k == 1:
        return [KMeansFit(points.features, [points.means], [points.n], points.n * sum(points.variances), 0) for _ in seeds]
    runs = iter(run_together(points, [(k, s) for group in seeds for s in group], max_iter, tol))
    return [_fitted(points, min([next(runs) for _ in group], key=lambda r: r.cost)) for group in seeds]


def fit_kmeans(df: DataFrame, k: int, seed: int = 42, inits: int = 2, n_rows: int | None = None,
               max_iter: int = 100, tol: float = 1e-4) -> KMeansFit:
    """k-means over every row, the cheapest of ``inits`` runs from k-means|| starts.

    Missing and infinite values count as 0, as in ``numeric_matrix``. ``k`` never
    exceeds the row count; fewer distinct rows give fewer clusters. ``tol`` is relative to the mean variance of the columns.
    """
    points = store_points(df, numeric_columns(df))
    k = max(1, min(k, points.n if n_rows is None else n_rows))
    return _fit_stored(points, k, [[seed + i for i in range(inits)]], max_iter, tol)[0]


def _near_sums(part: DataFrame, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Per centre the number and sum of the rows (array column x) nearest to it, and all squared distances; added up in the tasks."""
    k, width = centers.shape

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, cost = np.zeros(k, np.int64), np.zeros((k, width)), 0.0
        for b in batches:
            x = b.column(0).flatten().to_numpy().reshape(-1, width)
            squares = _squares(x, centers)
            at = squares.argmin(1)
            cost += float(squares[np.arange(len(x)), at].sum())
            count += np.bincount(at, minlength=k)
            order = np.argsort(at, kind="stable")
            met, first = np.unique(at[order], return_index=True)
            if len(met):
                total[met] += np.add.reduceat(x[order], first, axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(k)), pa.array(count), pa.array(list(total), pa.list_(pa.float64())), pa.array(np.where(np.arange(k) == 0, cost, 0.0))],
            ["centre", "n", "total", "cost"],
        )

    parts = part.select("x").mapInArrow(gather, "centre long, n long, total array<double>, cost double")
    sums = [F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(width)]
    got = parts.groupBy("centre").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), *sums).toPandas().sort_values("centre")  # k rows
    if got.empty:
        return np.zeros(k, np.int64), np.zeros((k, width)), 0.0
    return got["n"].to_numpy(), got[[f"t{i}" for i in range(width)]].to_numpy(), float(got["cost"].sum())


def fit_minibatch(df: DataFrame, k: int, seed: int = 42, batches: int = 8, epochs: int = 2, n_rows: int | None = None,
                  tol: float = 1e-3, max_start: int = 10) -> KMeansFit:
    """Mini-batch k-means: every row is dealt to one of ``batches`` batches by a hash, and after each batch every centre moves
    towards its rows' mean by the share they have in all rows it has met so far.

    An epoch reads every row once: the stored rows are ordered by batch within their files, so a batch reads its own part. It ends after
    ``epochs`` or when an epoch moves the centres by no more than ``tol`` times the mean variance. Starts are found on the first batch. Sizes
    and cost are those of all rows under the final centres. Missing and infinite values count as 0.
    """
    features = numeric_columns(df)
    rows = numeric_matrix(df.select(*features))
    x = F.array(*[F.col(f).cast("double") for f in features]).alias("x")
    numbered = spread(rows.select(x)).withColumn("__row", F.monotonically_increasing_id())
    dealt = numbered.select("x", F.pmod(row_hash(["__row"], seed), F.lit(batches)).cast("int").alias("batch"))
    stored = materialise(dealt.sortWithinPartitions("batch"), "batches")
    n = stored.count() if n_rows is None else n_rows
    k = max(1, min(k, n))
    first = stored.filter(F.col("batch") == 0).select(*[F.col("x")[i].alias(f) for i, f in enumerate(features)])
    if k == 1 or first.limit(k).count() < k:  # fewer rows than one batch needs
        return fit_kmeans(df, k, seed, 1, n)
    _, _, variances = moments(rows, features)
    start = fit_kmeans(first, k, seed, 1, max_iter=max_start)
    centers, done = np.array(start.centers), 0
    for _ in range(epochs):
        before, met = centers.copy(), np.zeros(len(centers))
        for b in range(batches):
            count, total, _ = _near_sums(stored.filter(F.col("batch") == b), centers)
            met += count
            moved = count > 0
            centers[moved] += (total[moved] - count[moved, None] * centers[moved]) / met[moved, None]
        done += 1
        if ((centers - before) ** 2).sum() <= tol * np.mean(variances):
            break
    count, _, cost = _near_sums(stored, centers)
    return KMeansFit(features, centers.tolist(), count.tolist(), cost, done)


def silhouette(df: DataFrame, label: str = "cluster", cells: int = 1024, seed: int = 42) -> float | None:
    """Mean Euclidean silhouette of all rows, estimated between the bounds of ``silhouette_bounds``; null for one cluster."""
    found = silhouette_bounds(df, label, cells, seed)
    return None if found is None else round(found.first()["silhouette"], 4)


def silhouette_squared(df: DataFrame, label: str = "cluster") -> float:
    """Silhouette with squared distances over all rows, linear in their number."""
    vectors = assemble(df, numeric_columns(df, exclude=[label])).withColumn(label, F.col(label).cast("double"))
    return ClusteringEvaluator(featuresCol=_VECTOR, predictionCol=label).evaluate(vectors)


def _gap(a: str, b: str):
    """Euclidean distance of two array columns."""
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))


def davies_bouldin(df: DataFrame, label: str = "cluster") -> DataFrame:
    """One row: mean over clusters of the worst (spread_i + spread_j) / distance_ij."""
    features = numeric_columns(df, exclude=[label])
    centers = df.groupBy(label).agg(F.array(*[F.avg(f) for f in features]).alias("__center"))
    spread = (
        df.select(label, F.array(*[F.col(f).cast("double") for f in features]).alias("__x"))
        .join(centers, label)
        .groupBy(label).agg(F.avg(_gap("__x", "__center")).alias("s"))
    )
    one = centers.join(spread, label)
    a = one.toDF("a", "ca", "sa")
    b = one.toDF("b", "cb", "sb")
    pairs = a.join(b, F.col("a") != F.col("b"))  # one row per pair of clusters
    ratio = (F.col("sa") + F.col("sb")) / F.nullif(_gap("ca", "cb"), F.lit(0.0))
    worst = pairs.groupBy("a").agg(F.max(ratio).alias("w"))
    return worst.agg(F.round(F.avg("w"), 4).alias("davies_bouldin"))


def search_k(df: DataFrame, low: int = 2, high: int = 10, seed: int = 42,
             n_rows: int | None = None, max_iter: int = 20) -> tuple[int, dict[int, float], float | None]:
    """Best k by the squared-distance silhouette of all rows; the smallest wins a tie.

    The fits of all k go over every row together. A k that leaves a single cluster gets no score.
    """
    n = df.count() if n_rows is None else n_rows
    if n < 3:
        return 1, {}, None
    low, points = max(2, low), store_points(df, numeric_columns(df))
    ks = range(low, max(low, min(high, n - 1)) + 1)
    runs = run_together(points, [(k, seed) for k in ks], max_iter, 1e-4)
    several = [(k, run) for k, run in zip(ks, runs) if (run.sizes > 0).sum() > 1]
    found = silhouettes(points, [run for _, run in several]) if several else []
    scores = {k: round(score, 4) for (k, _), score in zip(several, found)}
    if not scores:
        return low, {}, None
    best = max(scores, key=lambda k: (scores[k], -k))
    return best, scores, scores[best]


def hinted_k(found: int | None, default: int = 3, low: int = 2, high: int = 10) -> int:
    if found is None or found < low:
        return default
    return min(found, high)


def profile_clusters(df: DataFrame, label: str = "cluster", top: int = 5) -> DataFrame:
    """(cluster, size, percentage, rank, feature, mean, delta) of the top features.

    Features are ranked by how far the cluster mean lies from the overall mean.
    Everything after the first aggregate has one row per cluster and feature.
    """
    features = numeric_columns(df, exclude=[label])
    long = long_group_means(df, label, features)
    total = W.partitionBy("feature")
    overall = F.sum(F.col("mean") * F.col("size")).over(total) / F.sum("size").over(total)
    ranked = long.withColumn("delta", F.abs(F.col("mean") - overall)).withColumn(
        "percentage", percent(F.col("size"), F.sum("size").over(total))
    )
    order = W.partitionBy(label).orderBy(F.desc(F.round("delta", 9)), "feature")
    return (
        ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        .select(label, "size", "percentage", "rank", "feature", F.round("mean", 4).alias("mean"),
                F.round("delta", 4).alias("delta"))
    )


def dominant_features(profile: DataFrame, label: str = "cluster") -> DataFrame:
    """(cluster, size, percentage, dominant_features) in rank order."""
    ordered = F.transform(
        F.sort_array(F.collect_list(F.struct("rank", "feature"))), lambda s: s["feature"]
    )
    return profile.groupBy(label, "size", "percentage").agg(ordered.alias("dominant_features"))


def pca_2d(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` plus PC1 and PC2 of the centred numeric columns.

    The sign of a component is free; its largest loading is made positive. With
    a single feature PC1 is that feature and PC2 is 0.
    """
    features = numeric_columns(df, exclude=keep)
    if len(features) < 2:
        return df.select(*keep, F.col(features[0]).cast("double").alias("PC1"), F.lit(0.0).alias("PC2"))
    means = df.agg(*[F.avg(f).alias(f) for f in features]).first()
    centred = df.select(*keep, *[(F.col(f) - F.lit(means[f])).alias(f) for f in features])
    vectors = assemble(centred, features)
    model = PCA(k=2, inputCol=_VECTOR, outputCol="__pcs").fit(vectors)
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[np.abs(loadings[:, i]).argmax(), i] > 0 else -1.0 for i in range(2)]
    pcs = vector_to_array("__pcs")
    return model.transform(vectors).select(
        *keep, (pcs[0] * signs[0]).alias("PC1"), (pcs[1] * signs[1]).alias("PC2")
    )


def adjusted_rand(df: DataFrame, a: str, b: str, by: str | None = None, weight: str | None = None) -> DataFrame:
    """Agreement of two labelings from their table of counts (per value of ``by``); a row stands for ``weight`` rows."""
    pair = lambda n: n * (n - 1) / 2
    keys = [by] if by else []
    size = F.count(F.lit(1)) if weight is None else F.sum(weight)
    cells = df.groupBy(*keys, a, b).agg(size.cast("double").alias("n"))
    rows = cells.groupBy(*keys, a).agg(F.sum("n").alias("n"))
    cols = cells.groupBy(*keys, b).agg(F.sum("n").alias("n"))
    zero = F.lit(0.0)
    parts = (
        cells.select(*keys, "n", pair(F.col("n")).alias("sab"), zero.alias("sa"), zero.alias("sb"))
        .unionByName(rows.select(*keys, zero.alias("n"), zero.alias("sab"), pair(F.col("n")).alias("sa"), zero.alias("sb")))
        .unionByName(cols.select(*keys, zero.alias("n"), zero.alias("sab"), zero.alias("sa"), pair(F.col("n")).alias("sb")))
    )
    totals = parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "sab", "sa", "sb")])
    expected = F.col("sa") * F.col("sb") / F.nullif(pair(F.col("n")), zero)
    span = (F.col("sa") + F.col("sb")) / 2 - expected
    ari = (F.col("sab") - expected) / F.nullif(span, zero)
    return totals.select(*keys, F.round(F.coalesce(ari, F.lit(1.0)), 4).alias("ari"))


def cluster_stability(df: DataFrame, label: str, k: int, runs: int = 5, seed: int = 42, n_rows: int | None = None) -> list[float]:
    """Agreement of re-seeded runs over all rows with the given clusters."""
    if k < 2:
        return []
    features = numeric_columns(df, exclude=[label])
    points = store_points(df, features)
    k = max(1, min(k, points.n if n_rows is None else n_rows))
    fits = _fit_stored(points, k, [[1000 * (seed + run) + i for i in range(2)] for run in range(1, runs + 1)])
    rows = df.select(F.col(label).alias("given"), *features)
    for i, again in enumerate(fits):
        rows = again.assign(rows).withColumnRenamed("cluster", f"__again{i}")
    met = [f"__again{i}" for i in range(runs)]
    cells = materialise(rows.groupBy("given", *met).agg(F.count(F.lit(1)).alias("__rows")), "agreement")
    return [adjusted_rand(cells, "given", c, weight="__rows").first()["ari"] for c in met]


@dataclass
class Clustering:
    """Everything the segmentation step decides and measures."""

    rows: DataFrame
    fit: KMeansFit
    k: int
    hint: DensityHint
    k_hint: int
    scores: dict[int, float]
    best_score: float | None
    silhouette: float | None
    davies_bouldin: float | None
    metrics_rows: int
    high_noise: bool
    is_large: bool
    algorithm: str
    profile: DataFrame
    pca: DataFrame
    options: dict = field(default_factory=dict)

    def report(self) -> DataFrame:
        spark = self.rows.sparkSession
        schema = (
            "algorithm string, n_clusters int, k_hint int, silhouette double, davies_bouldin double, "
            "metrics_rows long, noise_ratio double, high_noise boolean, is_large boolean, "
            "best_score double, scores map<int,double>"
        )
        return spark.createDataFrame(
            [(self.algorithm, self.k, self.k_hint, self.silhouette, self.davies_bouldin, self.metrics_rows,
              self.hint.noise_ratio, self.high_noise, self.is_large, self.best_score, self.scores)], schema
        )


def cluster_table(
    df: DataFrame,
    use_density: bool = True,
    search: bool = True,
    default_k: int = 3,
    min_cluster_size: int = 100,
    max_k: int = 10,
    seed: int = 42,
    high_noise: float = 40.0,
    minibatch: bool = False,
) -> Clustering:
    """Silhouette search over every k from 2 to ``max_k``, k-means (or mini-batches) and measures, all on every row.

    The density hint is a remark and sets k only where there is no search.
    """
    x = materialise(spread(numeric_matrix(df)), "features")
    n = x.count()
    hint = density_hint(pca_2d(x), min_cluster_size) if use_density else DensityHint(None, None, None)
    k_hint = hinted_k(hint.n_clusters, default_k, 2, max_k)
    scores, best_score, k = {}, None, k_hint
    if search and n >= 3:
        k, scores, best_score = search_k(x, 2, max_k, seed, n)
    fit = fit_minibatch(x, k, seed, n_rows=n) if minibatch else fit_kmeans(x, k, seed, n_rows=n)
    rows = materialise(fit.assign(x), "clustered")
    several = sum(size > 0 for size in fit.sizes) > 1
    sil = round(silhouette_squared(rows), 4) if several else None
    db = davies_bouldin(rows).first()[0] if several else None
    return Clustering(
        rows=rows, fit=fit, k=fit.k, hint=hint, k_hint=k_hint, scores=scores, best_score=best_score,
        silhouette=sil, davies_bouldin=db, metrics_rows=n if several else 0,
        high_noise=hint.noise_ratio is not None and hint.noise_ratio >= high_noise, is_large=n >= LARGE_ROWS,
        algorithm="MiniBatchKMeans" if minibatch else "KMeans", profile=profile_clusters(rows), pca=pca_2d(rows, ["cluster"]),
        options={"max_k": max_k, "min_cluster_size": min_cluster_size},
    )
