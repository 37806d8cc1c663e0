from pyspark.sql import functions as F

from tabwright.operators import trees as R


def test_surrogate_is_fitted_on_counted_cells(spark, monkeypatch):
    """Equal rows are one weighted row of the tree's input; leaves and shares still count all rows."""
    met, fit = [], R.DecisionTreeClassifier.fit
    monkeypatch.setattr(R.DecisionTreeClassifier, "fit", lambda self, rows, params=None: met.append(rows.count()) or fit(self, rows, params))
    rows = spark.range(4000).selectExpr("CAST(id % 10 AS DOUBLE) AS x", "CAST(id % 7 AS DOUBLE) AS y", "CAST(id % 10 >= 6 AS INT) AS cluster")
    s = R.fit_surrogate(rows)
    assert max(met) <= 70 and s.leaves.agg(F.sum("n")).first()[0] == 4000
    assert s.fidelity_train == 1.0 and s.fidelity_cv == 1.0
    assert {(r["feature"], r["threshold"]) for r in s.conditions.collect()} == {("x", 5.5)}


def test_leaves_hold_five_rows(spark):
    """Four rows of a class are too few for a leaf, although they lie in a cell of their own."""
    rows = spark.createDataFrame([(1.0, 0)] * 60 + [(2.0, 1)] * 4, "x double, cluster int")
    assert R.fit_surrogate(rows).leaves.count() == 1
    more = spark.createDataFrame([(1.0, 0)] * 60 + [(2.0, 1)] * 5, "x double, cluster int")
    assert R.fit_surrogate(more).leaves.count() == 2
