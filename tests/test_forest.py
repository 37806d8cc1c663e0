"""The counted forest: as many draws as rows, no count per row, and as good as the data allow."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.operators import forest as T
from tabwright.operators import trees as R
from tabwright.session import materialise


def rows_of(spark, values):
    return materialise(spark.createDataFrame(values, "class_index double, is_test boolean, a double, b double"), "rows")


@pytest.fixture(scope="module")
def repeated(spark):
    """Two rows, many times over, and a test row of each class."""
    rows = [(0.0, False, 1.0, 5.0)] * 3000 + [(1.0, False, 2.0, 5.0)] * 1000 + [(0.0, True, 1.0, 5.0), (1.0, True, 9.0, 5.0)]
    return T.count_cells(rows_of(spark, rows), ["class_index", "is_test"], ["a", "b"], 2, 32)


def test_repeated_rows_are_one_cell_that_is_drawn_as_often(repeated):
    assert repeated.blocks.agg(F.sum("m")).first()[0] == 4
    grown = T.grow(repeated, 40, 3, 7)
    draws = [0.0] * 40
    for t in range(40):
        assert (grown.feature[t, 1], grown.cut[t, 1]) == (0, 0) or grown.feature[t, 1] == -1
        draws[t] = grown.share[t, 1, 0]
    assert abs(np.mean(draws) - 0.75) < 0.01 and 0 < np.std(draws) < 3 * math.sqrt(0.75 * 0.25 / 4000)
    assert grown.importances().tolist() == [1.0, 0.0]
    assert sorted(map(tuple, T.predict(repeated, grown).collect())) == [(0.0, 0.0, 1), (1.0, 1.0, 1)]


def test_best_split_against_all_splits():
    draw = np.random.default_rng(2)
    for _ in range(50):
        sums = draw.integers(0, 6, (3, 5, 4)).astype(float)
        sums[1:] = 0
        for f in (1, 2):  # the same rows, dealt to other bins
            for c in range(4):
                sums[f, :, c] = draw.multinomial(int(sums[0, :, c].sum()), [0.2] * 5)
        gini = lambda v: v.sum() - (v**2).sum() / v.sum() if v.sum() else 0.0
        gains = {(f, k): gini(sums[0].sum(0)) - gini(sums[f, : k + 1].sum(0)) - gini(sums[f, k + 1 :].sum(0))
                 for f in range(3) for k in range(4) if sums[f, : k + 1].sum() and sums[f, k + 1 :].sum()}
        f, k, gain = T._best(sums, np.array([4, 6, 9]))
        assert gain == pytest.approx(max(gains.values())) == pytest.approx(gains[[4, 6, 9].index(f), k])


def test_few_values_are_all_bins_and_many_are_quantiles(spark):
    rows = spark.createDataFrame([(float(i), 5.0 if i == 3 else float(i % 2) * 9) for i in range(1000)], "a double, b double")
    wide, narrow = T.bin_splits(rows, ["a", "b"], 32)
    assert 30 <= len(wide) - 1 <= 32 and [math.floor(s) for s in narrow[1:-1]] == [0, 5]


def test_tree_groups_and_task_parts_make_no_difference(spark, monkeypatch):
    draw = np.random.default_rng(1)
    data = [(float(a + b > 1), bool(i % 5 == 0), float(a), float(b)) for i, (a, b) in enumerate(draw.random((3000, 2)))]
    cells = T.count_cells(rows_of(spark, data), ["class_index", "is_test"], ["a", "b"], 2, 32)
    whole = T.grow(cells, 6, 5, 3)
    monkeypatch.setattr(T, "_HELD", 1)
    again = T.grow(T.Cells(cells.blocks.repartition(3), 2, 32, 2), 6, 5, 3)
    assert np.array_equal(whole.feature, again.feature) and np.array_equal(whole.cut, again.cut) and np.allclose(whole.share, again.share)
    scored = T.predict(cells, whole)
    assert scored.agg(F.sum("n")).first()[0] == 600
    assert scored.filter("class_index = predicted").agg(F.sum("n")).first()[0] > 520


def test_supervised_forest_stores_no_draws_of_rows(spark):
    """Rows differ from one another only in classes and two features, so cells are few however many rows there are."""
    rows = spark.range(20_000).select((F.col("id") % 3).alias("kind"), (F.col("id") % 6).cast("double").alias("a"), (F.col("id") % 4).cast("double").alias("b"))
    seen = []
    keep = T.Cells
    try:
        T.Cells = lambda *args: seen.append(keep(*args)) or seen[-1]
        done = R.train_supervised(rows, "kind", trees=8)
    finally:
        T.Cells = keep
    assert seen[0].blocks.agg(F.sum("m")).first()[0] <= 24
    assert done.accuracy == 1.0 and done.report.count() == 5 and done.importance.first()["feature"] == "a"
