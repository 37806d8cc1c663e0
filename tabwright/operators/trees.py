"""Tree models: a surrogate that explains clusters, and a supervised forest."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml.classification import (
    DecisionTreeClassificationModel,
    DecisionTreeClassifier,
)
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.functions.scalars import FIDELITY_BANDS, band, percent
from tabwright.operators.clustering import assemble
from tabwright.operators.columns import numeric_columns, numeric_matrix
from tabwright.operators.explain import with_real_values
from tabwright.operators.forest import count_cells, grow, predict
from tabwright.operators.ranking import rank_values
from tabwright.operators.sampling import stratified_folds, stratified_split
from tabwright.session import materialise

_VECTOR = "__features"
#: Bins of a feature of the surrogate tree.
_BINS = 64
#: Bins of a feature and levels of splits of the supervised forest.
_FOREST_BINS, _FOREST_DEPTH = 32, 5


def class_indexes(df: DataFrame, label: str) -> DataFrame:
    """(label, index): classes in order, numbered from 0."""
    return rank_values(df.select(label).distinct(), label, "class_index")


def _indexed(df: DataFrame, label: str, features: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    classes = materialise(class_indexes(df.filter(F.col(label).isNotNull()), label), "classes")
    rows = numeric_matrix(df.select(label, *features), [label]).join(F.broadcast(classes), label)
    return assemble(rows, features).withColumn("class_index", F.col("class_index").cast("double")), classes


def importances(values: Sequence[float], features: Sequence[str], spark) -> DataFrame:
    return spark.createDataFrame(
        [(f, float(v)) for f, v in zip(features, values)], "feature string, importance double"
    ).orderBy(F.desc("importance"), "feature")


@dataclass
class Surrogate:
    model: DecisionTreeClassificationModel
    features: list[str]
    classes: DataFrame
    fidelity_train: float
    fidelity_cv: float | None
    leaves: DataFrame
    conditions: DataFrame

    def importance(self) -> DataFrame:
        return importances(self.model.featureImportances.toArray(), self.features, self.classes.sparkSession)

    def fidelity(self) -> DataFrame:
        spark = self.classes.sparkSession
        row = spark.createDataFrame([(self.fidelity_train, self.fidelity_cv)], "train double, cv double")
        used = F.coalesce("cv", "train")
        return row.select(
            "train", "cv", used.alias("fidelity"), band(used, FIDELITY_BANDS).alias("label"),
            band(used, FIDELITY_BANDS, "tone").alias("tone"),
        )


def fit_surrogate(df: DataFrame, label: str = "cluster", depth: int = 4, leaf_rows: int = 5,
                  folds: int = 3, seed: int = 42) -> Surrogate | None:
    """A shallow tree that predicts the cluster; null below two clusters."""
    features = numeric_columns(df, exclude=[label])
    indexed, classes = _indexed(df, label, features)
    sizes = [r["n"] for r in indexed.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()]  # one per cluster
    if len(sizes) < 2:
        return None
    n_folds = max(2, min(folds, min(sizes)))
    cells, cuts = _cells(stratified_folds(indexed.select(label, "class_index", _VECTOR, *features), "class_index", n_folds, seed, by=[label, "class_index", _VECTOR]),
                         [label, "class_index", "fold"], features)
    per_fold = {r["fold"]: r["n"] for r in cells.groupBy("fold").agg(F.sum("n").alias("n")).collect()}
    total = sum(per_fold.values())

    def learner(n: int) -> DecisionTreeClassifier:
        """A leaf's least rows are a share of the ``n`` rows, as a cell stands for several."""
        return DecisionTreeClassifier(
            featuresCol=_VECTOR, labelCol="class_index", predictionCol="predicted", weightCol="n", maxDepth=depth,
            minWeightFractionPerNode=min((leaf_rows - 0.5) / n, 0.4999), maxBins=_BINS, seed=seed,
        )

    hit = F.sum(F.when(F.col("predicted") == F.col("class_index"), F.col("n")).otherwise(0)) / F.sum("n")
    model = learner(total).setLeafCol("leaf").fit(cells)
    scored = model.transform(cells)
    train = round(scored.agg(hit).first()[0], 4)
    cv = None
    if min(sizes) >= 2:
        parts = []
        for k in range(n_folds):
            if per_fold.get(k, 0) in (0, total):  # few different rows can share one fold
                continue
            others = cells.filter(F.col("fold") != k)
            parts.append(learner(total - per_fold[k]).fit(others).transform(cells.filter(F.col("fold") == k)).agg(hit).first()[0])
        cv = round(sum(parts) / len(parts), 4) if parts else None
    leaves = leaf_table(scored, label, "leaf", "n")
    return Surrogate(model, list(features), classes, train, cv, leaves, leaf_conditions(model, features, df.sparkSession, cuts))


def _cells(rows: DataFrame, keep: Sequence[str], features: Sequence[str]) -> tuple[DataFrame, Callable[[int, float], float]]:
    """Rows counted by ``keep`` and the bin of every feature, all that a tree sees of them, and where a cut between bins lies in a feature.

    A feature has at most ``_BINS`` bins, between quantiles of all rows; a bin holds its upper end. Cells never outnumber the rows.
    """
    stored = materialise(rows.select(*keep, *[F.col(f).cast("double").alias(f"__x{i}") for i, f in enumerate(features)]), "surrogate")
    xs = [f"__x{i}" for i in range(len(features))]
    found = stored.approxQuantile(xs, [k / _BINS for k in range(1, _BINS)], 1 / (8 * _BINS))
    splits = [[-math.inf, *(math.nextafter(q, math.inf) for q in sorted(set(ends))), math.inf] for ends in found]
    bins = [f"__b{i}" for i in range(len(features))]
    binned = Bucketizer(splitsArray=splits, inputCols=xs, outputCols=bins).transform(stored)
    binned = binned.select(*keep, *xs, *[F.col(b).cast("int").alias(b) for b in bins])  # the bins are ordered, not nominal
    ends = [f(x).alias(f"{name}{x}") for x in xs for name, f in (("lo", F.min), ("hi", F.max))]
    cells = materialise(binned.groupBy(*keep, *bins).agg(F.count(F.lit(1)).alias("n"), *ends), "cells")
    spots = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(b).alias("b"), F.col(f"lo{x}").alias("lo"), F.col(f"hi{x}").alias("hi"))
                                for i, (b, x) in enumerate(zip(bins, xs))])).alias("s")
    held = cells.select(spots).groupBy("s.f", "s.b").agg(F.min("s.lo").alias("lo"), F.max("s.hi").alias("hi")).collect()  # bins of all features

    def cut(feature: int, between: float) -> float:
        below = max(r["hi"] for r in held if r["f"] == feature and r["b"] <= between)
        above = min(r["lo"] for r in held if r["f"] == feature and r["b"] > between)
        middle = below + (above - below) / 2
        return middle if below <= middle < above else below

    return VectorAssembler(inputCols=bins, outputCol=_VECTOR).transform(cells).select(*keep, "n", _VECTOR), cut


def leaf_table(scored: DataFrame, label: str, leaf: str, weight: str | None = None) -> DataFrame:
    """(leaf, winner, n, purity, counts per class); a row stands for ``weight`` rows."""
    cells = scored.groupBy(leaf, label).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n"))
    total = F.sum("n")
    return cells.groupBy(leaf).agg(
        F.min_by(F.col(label), F.struct(-F.col("n"), F.col(label))).alias("winner"),
        total.alias("n"),
        F.round(F.max("n") / total, 4).alias("purity"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(label, "n")))).alias("class_counts"),
    )


def leaf_conditions(model: DecisionTreeClassificationModel, features: Sequence[str], spark, cut: Callable[[int, float], float]) -> DataFrame:
    """(leaf, position, feature, operator, threshold), from the root down; ``cut`` gives the feature's value for a threshold between bins.

    Leaves are numbered as the model's leaf column does, in pre-order over leaves.
    """
    rows, path, leaf = [], [], 0
    for line in model.toDebugString.splitlines()[1:]:
        depth = (len(line) - len(line.lstrip())) // 1
        text = line.strip()
        while path and path[-1][0] >= depth:
            path.pop()
        test = re.match(r"(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", text)
        if test:
            path.append((depth, features[int(test[1])], test[2], cut(int(test[1]), float(test[3]))))
        elif text.startswith("Predict"):
            rows += [(float(leaf), i, f, op, cut) for i, (_, f, op, cut) in enumerate(path)]
            leaf += 1
    return spark.createDataFrame(rows, "leaf double, position int, feature string, operator string, threshold double")


def cluster_rules(surrogate: Surrogate, sizes: DataFrame, scaling: DataFrame | None = None,
                  label: str = "cluster", n: int = 3) -> DataFrame:
    """Per cluster the leaf it wins that holds most of its rows, with up to ``n`` conditions."""
    won = surrogate.leaves.withColumn("held", F.col("class_counts")[F.col("winner")])
    best = won.groupBy(F.col("winner").alias(label)).agg(
        F.min_by(F.struct("leaf", "n", "purity", "held"), F.struct(-F.col("held"), F.col("leaf"))).alias("b")
    ).select(label, "b.*")
    conditions = surrogate.conditions.filter(F.col("position") < n)
    if scaling is not None:
        conditions = with_real_values(conditions, scaling, "threshold", "real_threshold")
    else:
        conditions = conditions.withColumn("real_threshold", F.lit(None).cast("double"))
    path = F.sort_array(F.collect_list(F.struct("position", "feature", "operator", "threshold", "real_threshold")))
    return (
        best.join(conditions.groupBy("leaf").agg(path.alias("conditions")), "leaf", "left")
        .join(sizes.select(label, "size"), label, "left")
        .select(label, "conditions", "purity", "n", percent(F.col("held"), F.col("size"), 1).alias("coverage_pct"))
    )


@dataclass
class Supervised:
    report: DataFrame
    importance: DataFrame
    accuracy: float


def classification_report(scored: DataFrame, label: str, predicted: str, weight: str | None = None) -> DataFrame:
    """Precision, recall, f1 and support per class, then macro and weighted means; a row stands for ``weight`` rows."""
    cells = scored.groupBy(label, predicted).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n"))
    row = cells.groupBy(F.col(label).alias("class")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col(label) == F.col(predicted), F.col("n")).otherwise(0)).alias("hit")
    )
    col = cells.groupBy(F.col(predicted).alias("class")).agg(F.sum("n").alias("called"))
    both = row.join(col, "class", "outer").na.fill(0, ["support", "hit", "called"])
    zero = F.lit(0.0)
    p = F.coalesce(F.col("hit") / F.nullif(F.col("called"), F.lit(0)), zero)
    r = F.coalesce(F.col("hit") / F.nullif(F.col("support"), F.lit(0)), zero)
    per = both.withColumn("precision", p).withColumn("recall", r).withColumn(
        "f1", F.coalesce(2 * p * r / F.nullif(p + r, zero), zero)
    ).select(F.col("class").cast("string").alias("class"), "precision", "recall", "f1", "support")
    names = ["precision", "recall", "f1"]
    macro = per.agg(*[F.avg(c).alias(c) for c in names], F.sum("support").alias("support"))
    whole = F.sum("support")
    weighted = per.agg(*[(F.sum(F.col(c) * F.col("support")) / whole).alias(c) for c in names], whole.alias("support"))
    rounded = [F.round(c, 4).alias(c) for c in names]
    return (
        per.unionByName(macro.withColumn("class", F.lit("macro avg")))
        .unionByName(weighted.withColumn("class", F.lit("weighted avg")))
        .select("class", *rounded, "support")
    )


def train_supervised(df: DataFrame, label: str, test_share: float = 0.2, trees: int = 100, seed: int = 42) -> Supervised:
    """Random forest on a stratified split, evaluated on the held-out part."""
    features = numeric_columns(df, exclude=[label])
    indexed, classes = _indexed(df.filter(F.col(label).isNotNull()), label, features)
    xs = [f"__x{i}" for i in range(len(features))]
    by = [label, "class_index", _VECTOR]
    split = stratified_split(indexed.select(*by, *[F.col(f).cast("double").alias(x) for f, x in zip(features, xs)]), "class_index", test_share, seed, by)
    rows = materialise(split.select("class_index", "is_test", *xs), "supervised")
    cells = count_cells(rows, ["class_index", "is_test"], xs, classes.count(), _FOREST_BINS)
    forest = grow(cells, trees, _FOREST_DEPTH, seed)
    named = F.broadcast(classes.select(F.col("class_index").cast("double").alias("class_index"), label))
    called = named.select(F.col("class_index").alias("predicted"), F.col(label).alias("__p"))
    scored = materialise(predict(cells, forest).join(named, "class_index").join(F.broadcast(called), "predicted").select(label, "__p", "n"), "scored")
    accuracy = scored.agg(F.sum(F.when(F.col(label) == F.col("__p"), F.col("n")).otherwise(0)) / F.sum("n")).first()[0]
    return Supervised(classification_report(scored, label, "__p", "n"), importances(forest.importances(), features, df.sparkSession), accuracy)
