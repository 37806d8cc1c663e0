import numpy as np
import pandas as pd
import pytest
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler

from tabwright.operators import lloyd as L


@pytest.fixture(scope="module")
def stored(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(c, 1, (150, 2)) for c in ([0, 0], [9, 0], [0, 9], [9, 9])] + [np.ones((40, 2))])  # repeated rows
    return x, L.store_points(spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"])).repartition(3), ["a", "b"])


def test_runs_go_over_the_rows_together(stored, monkeypatch):
    """Nine runs need no more passes than the longest of them, and each ends where its rows' means are."""
    x, points = stored
    passes, plain = [], L.sums
    monkeypatch.setattr(L, "sums", lambda p, c: passes.append(len(c)) or plain(p, c))
    runs = L.run_together(points, [(k, 42) for k in range(2, 11)], 20, 1e-12)
    assert len(passes) == max(r.iterations for r in runs) + 2 and passes[-1] == 9
    for k, run in zip(range(2, 11), runs):
        centers = run.centers + points.means
        at = ((x[:, None] - centers) ** 2).sum(2).argmin(1)
        assert len(centers) == k and run.sizes.tolist() == np.bincount(at, minlength=k).tolist()
        assert run.cost == pytest.approx(((x - centers[at]) ** 2).sum())
        if run.iterations < 20:
            assert centers == pytest.approx(np.array([x[at == i].mean(0) for i in range(k)]))
    assert runs[2].cost < 1.05 * 2 * len(x)


def test_silhouettes_are_those_of_the_evaluator(spark, stored):
    x, points = stored
    runs = L.run_together(points, [(k, 7) for k in (2, 4)], 20, 1e-4)
    for run, value in zip(runs, L.silhouettes(points, runs)):
        at = ((x[:, None] - run.centers - points.means) ** 2).sum(2).argmin(1)
        df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(prediction=at.astype(float))))
        assert value == pytest.approx(ClusteringEvaluator().evaluate(df), abs=1e-9)


def test_equal_rows_give_one_centre(spark):
    points = L.store_points(spark.createDataFrame([(2.0, 3.0)] * 30, "a double, b double"), ["a", "b"])
    (run,) = L.run_together(points, [(3, 1)], 5, 1e-4)
    assert len(run.centers) == 1 and run.sizes.tolist() == [30]
