import itertools
import math
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabwright.operators import clustering as C
from tabwright.operators import explain as X
from tabwright.operators import isolation as A
from tabwright.operators import trees as R
from tabwright.operators.density import density_hint
from tabwright.operators.sampling import stratified_split
from tabwright.operators import silhouettes as S
from tabwright.operators.silhouettes import silhouette_bounds
from tabwright.plans.analysis import analyse
from tabwright.streaming.history import History


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(0)
    centers = ([0, 0, 0], [12, 0, 0], [0, 12, 0])
    x = np.vstack([rng.normal(c, 1, (200, 3)) for c in centers])
    return spark.createDataFrame(pd.DataFrame(x, columns=list("abc"))).cache()


@pytest.fixture(scope="module")
def planted(spark):
    """A ring of readings, and twenty far off it with a pressure that no other has."""
    rng = np.random.default_rng(11)
    angle = rng.uniform(0, 2 * np.pi, 500)
    ring = np.column_stack([8 * np.cos(angle), 8 * np.sin(angle), rng.uniform(0.9, 1.1, 500)]) + rng.normal(0, 0.3, (500, 3))
    far = rng.uniform(25, 40, (20, 2)) * rng.choice([-1, 1], (20, 2))
    odd = np.column_stack([far, rng.uniform(7, 9, 20)])
    df = spark.createDataFrame(pd.DataFrame(np.vstack([ring, odd]), columns=["east", "north", "pressure"]))
    return A.anomaly_table(df)


def test_kmeans_finds_the_blobs(blobs):
    fit = C.fit_kmeans(blobs, 3)
    assert sorted(fit.sizes) == [200, 200, 200]
    rows = fit.assign(blobs)
    gap = lambda c: (F.col("a") - c[0]) ** 2 + (F.col("b") - c[1]) ** 2 + (F.col("c") - c[2]) ** 2
    near = F.least(*[gap(c) for c in fit.centers])
    own = F.when(F.lit(False), 0.0)
    for i, c in enumerate(fit.centers):
        own = own.when(F.col("cluster") == i, gap(c))
    assert rows.filter(F.abs(own - near) > 1e-9).count() == 0
    assert C.fit_kmeans(blobs, 5).cost < fit.cost
    assert C.fit_kmeans(blobs.limit(2), 5).k == 2


def test_missing_values_count_as_zero(spark):
    df = spark.createDataFrame([(1.0,)] * 500 + [(100.0,)] * 499 + [(None,), (float("nan"),)], "x double").repartition(4)
    fit = C.fit_kmeans(df, 2)
    assert sorted(fit.sizes) == [499, 502] and not np.isnan(fit.centers).any()
    got = fit.assign(df).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("x").isNull() | F.isnan("x")).alias("gone"))
    assert sorted(map(tuple, got.select("n", "gone").collect())) == [(499, 0), (502, 2)]
    assert C.fit_kmeans(df, 1).sizes == [1001]


def test_stored_centres(spark, blobs, tmp_path):
    fit = C.fit_kmeans(blobs, 3)
    fit.save(spark, str(tmp_path / "centres"))
    again = C.KMeansFit.load(spark, str(tmp_path / "centres"), fit.features)
    assert again.centers == fit.centers


def test_whole_segmentation(blobs):
    found = C.cluster_table(blobs, min_cluster_size=50)
    assert found.k == 3 and found.hint.n_clusters == 3
    assert found.silhouette > 0.7 and not found.high_noise
    assert found.report().count() == 1
    assert min(C.cluster_stability(found.rows, "cluster", 3)) > 0.99


def test_few_rows_are_all_noise(blobs):
    hint = density_hint(C.pca_2d(blobs.limit(10)), 50)
    assert (hint.n_clusters, hint.noise_ratio) == (0, 100.0)
    assert density_hint(C.pca_2d(blobs).limit(0)).n_clusters is None


def plain_silhouette(x, labels):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    out = []
    for i, own in enumerate(labels):
        same = labels == own
        if same.sum() == 1:
            out.append(0.0)
            continue
        a = d[i, same].sum() / (same.sum() - 1)
        b = min(d[i, labels == g].mean() for g in set(labels) - {own})
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return float(np.mean(out))


@pytest.mark.parametrize("width, spread", [(1, 0.5), (3, 3.0), (20, 2.0)])
def test_silhouette_bounds_hold_the_exact_value(spark, width, spread):
    rng = np.random.default_rng(width)
    labels = np.repeat([0, 1, 2, 3], [400, 150, 50, 1])
    x = rng.normal(rng.normal(0, 4, (4, width))[labels], spread)
    x[5:60] = x[5]  # repeated rows
    df = spark.createDataFrame(pd.DataFrame(x, columns=[f"f{i}" for i in range(width)]).assign(cluster=labels)).repartition(5)
    exact = plain_silhouette(x, labels)
    for cells in (8, 40, 5000):
        r = silhouette_bounds(df, cells=cells).first()
        assert r["low"] - 1e-6 <= exact <= r["high"] + 1e-6 and r["low"] <= r["silhouette"] <= r["high"] and r["rows"] == len(x)
    assert r["high"] - r["low"] < 1e-6
    assert C.silhouette(df.withColumn("cluster", F.lit(1))) is None


def test_silhouette_of_single_rows(spark):
    df = spark.createDataFrame([(0.0, 0), (1.0, 0), (10.0, 1)], "x double, cluster int")
    assert C.silhouette(df) == pytest.approx((0.9 + 8 / 9) / 3, abs=1e-4)


def test_minibatch_costs_little_more(spark, blobs):
    full, mini = C.fit_kmeans(blobs, 3), C.fit_minibatch(blobs, 3, batches=5)
    assert sorted(mini.sizes) == [200, 200, 200] and mini.cost <= 1.05 * full.cost
    assert C.fit_minibatch(blobs.limit(4), 3).k == 3
    assert C.cluster_table(blobs, min_cluster_size=50, minibatch=True).algorithm == "MiniBatchKMeans"


def test_tolerance_follows_the_scale(spark, blobs):
    wide = blobs.select(*[(F.col(c) * 1e5).alias(c) for c in blobs.columns])
    assert C.fit_kmeans(wide, 5).iterations == C.fit_kmeans(blobs, 5).iterations


def test_pca_is_centred_and_uncorrelated(blobs):
    r = C.pca_2d(blobs).agg(F.avg("PC1"), F.avg("PC2"), F.corr("PC1", "PC2"), F.var_pop("PC1"), F.var_pop("PC2")).first()
    assert max(map(abs, r[:3])) < 1e-9 and r[3] >= r[4]
    one = C.pca_2d(blobs.select("a")).filter("PC2 <> 0")
    assert one.count() == 0


def test_planted_outliers_rank_first(planted):
    assert A.top_anomalies(planted.rows, 20).filter("pressure > 5").count() >= 19
    assert A.top_anomalies(planted.rows, 25).filter("pressure > 5").count() == 20
    assert planted.rows.agg(F.min("anomaly_score"), F.max("anomaly_score")).first() == (0.0, 1.0)
    assert planted.summary.first()["total_rows"] == 520


def test_contamination_sets_the_rate(spark, planted):
    rows = planted.rows.select("east", "north", "pressure")
    assert A.anomaly_table(rows, contamination=0.05).summary.first()["anomaly_count"] == pytest.approx(26, abs=1)


def test_forest_round_trip(spark, planted, tmp_path):
    planted.forest.save(spark, str(tmp_path / "forest"))
    again = A.Forest.load(spark, str(tmp_path / "forest"))
    a = A.score(planted.rows.select("east", "north", "pressure"), again).agg(F.sum("raw_score")).first()[0]
    assert a == pytest.approx(planted.rows.agg(F.sum("raw_score")).first()[0])


def nodes_of(forest, spark):
    stored = forest if isinstance(forest, A.StoredForest) else forest.stored(spark)
    return stored.nodes.toPandas()


@pytest.mark.parametrize("in_task", [8, 100])
def test_trees_of_all_rows_grow_by_levels(spark, planted, monkeypatch, tmp_path, in_task):
    monkeypatch.setattr(A, "IN_TASK", in_task)
    rows = planted.rows.select("east", "north", "pressure")
    forest = A.fit_forest(rows, trees=12, max_samples=1.0)
    nodes = nodes_of(forest, spark)
    limit = math.ceil(math.log2(520))
    for _, tree in nodes.groupby("tree"):
        size = dict(zip(tree["node"], tree["size"]))
        assert size[1] == 520 and len(size) == len(tree)
        inner = tree[tree["feature"] >= 0]
        assert all(size[n] == size[2 * n] + size[2 * n + 1] for n in inner["node"])
        leaves = tree[tree["feature"] < 0]
        assert leaves["size"].sum() == 520 and ((leaves["size"] == 1) | (leaves["depth"] == limit)).all()
        assert (tree["depth"] == [int(n).bit_length() - 1 for n in tree["node"]]).all()
    top = A.score(rows, forest).orderBy("raw_score").limit(20)
    assert top.filter("pressure > 5").count() >= 19
    monkeypatch.setattr(A, "ARRAY_NODES", 0)
    stored = forest.stored(spark)
    both = A.score(rows, forest).select("east", "raw_score").join(A.score(rows, stored).select("east", F.col("raw_score").alias("other")), "east")
    assert both.count() == 520 and both.filter(F.abs(F.col("raw_score") - F.col("other")) > 1e-12).count() == 0
    stored.save(spark, str(tmp_path / "wide"))
    assert isinstance(A.Forest.load(spark, str(tmp_path / "wide")), A.StoredForest)
    assert A.fit_forest(rows, trees=3, max_samples=0.5).nodes.filter("node = 1").select("size").distinct().collect() == [(260,)]


def test_equal_rows_end_in_one_leaf(spark, monkeypatch):
    monkeypatch.setattr(A, "IN_TASK", 4)
    same = spark.createDataFrame([(1.0, 2.0)] * 50, "a double, b double")
    nodes = nodes_of(A.fit_forest(same, trees=3, max_samples=1.0), spark)
    assert nodes[["node", "feature", "size"]].to_numpy().tolist() == [[1, -1, 50]] * 3


def test_split_is_exact_and_repeatable(spark):
    rows = spark.range(1000).selectExpr("id % 100 AS x", "id % 3 AS c")
    done = [stratified_split(rows.repartition(n), "c", 0.25) for n in (1, 7)]
    counts = [sorted(map(tuple, d.groupBy("c").agg(F.count_if("is_test"), F.count("*")).collect())) for d in done]
    assert counts[0] == counts[1] == [(0, 84, 334), (1, 83, 333), (2, 83, 333)]
    assert done[0].groupBy("x", "c", "is_test").count().exceptAll(done[1].groupBy("x", "c", "is_test").count()).count() == 0


def test_folds_without_rows_are_skipped(spark):
    rows = spark.createDataFrame([(1.0, 0)] * 50 + [(9.0, 1)] * 50, "x double, cluster int")
    s = R.fit_surrogate(rows)
    assert s.fidelity_train == 1.0 and (s.fidelity_cv is None or 0 <= s.fidelity_cv <= 1)


def test_shapley_values_match_the_definition(planted):
    forest = A.Forest(**{**planted.forest.__dict__})
    for name in ("feature", "threshold", "left", "right", "size", "depth"):
        setattr(forest, name, getattr(planted.forest, name)[:5])
    values, row, m = forest.leaf_value, np.array([30.0, -28.0, 8.0]), 3

    def expected(t, known, node=0):
        f = forest.feature[t][node]
        if f < 0:
            return values[t][node]
        a, b = forest.left[t][node], forest.right[t][node]
        if f in known:
            return expected(t, known, a if row[f] <= forest.threshold[t][node] else b)
        sizes = forest.size[t]
        return (sizes[a] * expected(t, known, a) + sizes[b] * expected(t, known, b)) / sizes[node]

    want = np.zeros(m)
    for t in range(5):
        for i in range(m):
            others = [j for j in range(m) if j != i]
            for n in range(m):
                for known in itertools.combinations(others, n):
                    gain = expected(t, {*known, i}) - expected(t, set(known))
                    want[i] += gain / (m * math.comb(m - 1, n)) / 5
    assert X.shapley_paths(row[None, :], forest)[0] == pytest.approx(want)


def test_surrogate(blobs):
    rows = C.fit_kmeans(blobs, 3).assign(blobs)
    s = R.fit_surrogate(rows)
    assert s.fidelity_train > 0.95 and s.leaves.agg(F.sum("n")).first()[0] == 600
    assert s.fidelity().first()["label"] == "élevée"
    sizes = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    rules = R.cluster_rules(s, sizes).collect()
    assert len(rules) == 3 and all(r["coverage_pct"] > 90 for r in rules)
    leaf = s.leaves.filter("winner = 0").orderBy(F.desc("n")).first()["leaf"]
    path = s.conditions.filter(F.col("leaf") == leaf).orderBy("position").collect()
    inside = rows
    for c in path:
        inside = inside.filter(f"{c['feature']} {c['operator']} {c['threshold']}")
    assert inside.count() == s.leaves.filter(F.col("leaf") == leaf).first()["n"]
    assert R.fit_surrogate(rows.withColumn("cluster", F.lit(0))) is None


def test_supervised(blobs):
    rows = C.fit_kmeans(blobs, 3).assign(blobs).withColumn("kind", F.concat(F.lit("k"), F.col("cluster"))).drop("cluster")
    done = R.train_supervised(rows, "kind", trees=10)
    assert done.accuracy > 0.95
    report = {r["class"]: r for r in done.report.collect()}
    assert report["macro avg"]["support"] == 120 and set(report) == {"k0", "k1", "k2", "macro avg", "weighted avg"}


def test_analysis_from_end_to_end(spark, folder, tmp_path):
    parts = spark.read.parquet(f"{folder}/part.parquet")
    done = analyse(parts, history=str(tmp_path / "history"), clustering={"min_cluster_size": 20})
    counts = {name: df.count() for name, df in done.explanation.items()}
    assert all(n > 0 for n in counts.values())
    assert done.explanation["findings"].select("finding").distinct().count() == 7
    store = History(spark, str(tmp_path / "history"))
    assert store.kpis().first()["last_run"] == done.run_id
    assert store.read("cluster_history").count() == 1
    assert store.read("anomaly_history").first()["total_rows"] == parts.count()


def test_trees_of_all_rows_store_no_rows_by_level(spark, monkeypatch):
    """Splits are walked again for each level: what is stored beside the points are nodes, and no row is lost on the way."""
    monkeypatch.setattr(A, "IN_TASK", 16)
    stored, write = [], A.materialise
    monkeypatch.setattr(A, "materialise", lambda df, label: stored.append((label, write(df, label))) or stored[-1][1])
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(400, 2)), np.zeros((100, 2))])  # equal rows end in one leaf of many
    rows = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]))
    nodes = A.fit_forest(rows, trees=2, max_samples=1.0).stored(spark).nodes.toPandas()
    for _, tree in nodes.groupby("tree"):
        size = dict(zip(tree["node"], tree["size"]))
        assert size[1] == 500 == tree[tree["feature"] < 0]["size"].sum()
        assert all(size[k] == size[2 * k] + size[2 * k + 1] for k in tree[tree["feature"] >= 0]["node"])
    assert sum(df.count() for label, df in stored if label not in ("points", "forest-nodes")) <= len(nodes)


def test_cells_of_a_group_are_searched_alone():
    """A row is compared with its own group's cells only, and comes to the nearest of them."""
    rng = np.random.default_rng(4)
    x, points, group, cell_group = rng.normal(size=(300, 3)), rng.normal(size=(40, 3)), rng.integers(0, 4, 300), np.sort(rng.integers(0, 4, 40))
    met, plain = [], S._distances
    S._distances = lambda a, b: met.append(len(a) * len(b)) or plain(a, b)
    try:
        at = S._nearest(group, x, cell_group, points)
    finally:
        S._distances = plain
    far = np.where(group[:, None] == cell_group, ((x[:, None] - points) ** 2).sum(2), np.inf)
    assert (at == far.argmin(1)).all() and sum(met) < 300 * 40


def test_rows_go_down_the_trees_as_one_by_one():
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(5000, 3)), 1)
    nodes = pd.concat([A._grow(t, 1, 0, x[rng.choice(len(x), 40 + 60 * t, replace=False)], 7, np.random.default_rng(t)) for t in range(4)] + [A._grow(4, 1, 0, x[:1], 7, rng)])
    forest = A._held(SimpleNamespace(nodes=SimpleNamespace(count=lambda: len(nodes), toPandas=lambda: nodes), features=list("abc"), rows_per_tree=40, offset=-0.5, fit_range=None))
    trees = A._walk(forest)
    assert all(feature.dtype == child.dtype == np.intp for feature, _, child, _ in trees)  # numpy would copy other indexes at every step
    got = A._path_lengths(x, trees, forest.leaf_value)
    for i in (0, 1, 4095, 4096, 4999):
        paths = []
        for t in range(5):
            at = 0
            while (f := forest.feature[t, at]) >= 0:
                at = forest.left[t, at] if x[i, f] <= forest.threshold[t, at] else forest.right[t, at]
            paths.append(forest.depth[t, at] + A.average_path(forest.size[t, at]))
        assert got[i] == pytest.approx(np.mean(paths), abs=1e-12)


def test_levels_of_trees_of_all_rows_are_grown_together(spark, monkeypatch):
    """Fewer passes over the rows than levels; every split parts its own rows between their least and greatest value."""
    monkeypatch.setattr(A, "IN_TASK", 40)
    passes, plain = [], A._cell_stats
    monkeypatch.setattr(A, "_cell_stats", lambda *a: passes.append(1) or plain(*a))
    rng = np.random.default_rng(6)
    x = np.column_stack([rng.lognormal(0, 2, 3000), rng.integers(0, 4, 3000), np.ones(3000)])
    rows = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")))
    nodes, limit = nodes_of(A.fit_forest(rows, trees=3, max_samples=1.0), spark), math.ceil(math.log2(3000))
    for _, tree in nodes.groupby("tree"):
        found, todo = {r.node: r for r in tree.itertuples()}, [(1, x)]
        while todo:
            node, part = todo.pop()
            r = found.pop(node)
            assert r.size == len(part) and r.depth == node.bit_length() - 1
            if r.feature < 0:
                assert r.depth == limit or (part == part[0]).all()
                continue
            column = part[:, r.feature]
            assert r.depth < limit and column.min() <= r.threshold < column.max()
            todo += [(2 * node, part[column <= r.threshold]), (2 * node + 1, part[column > r.threshold])]
        assert not found
    assert 1 < len(passes) < nodes[nodes["size"] > 40]["depth"].max() + 1
    half = nodes_of(A.fit_forest(rows, trees=3, max_samples=0.5), spark)
    assert (half[half["node"] == 1]["size"] == 1500).all() and half[half["feature"] < 0].groupby("tree")["size"].sum().tolist() == [1500] * 3


def test_splits_take_all_open_features_and_cuts_alike():
    m = 6000
    low, high = np.zeros((3, m)), np.tile([[1.0], [0.0], [1e308]], m)
    low[2] = -1e308
    feature, cut = A._splits(np.arange(m) % 7, np.arange(1, m + 1), low, high, 0, 42)
    assert abs((feature == 0).mean() - 0.5) < 0.03 and not (feature == 1).any()
    shares = np.concatenate([cut[feature == 0], cut[feature == 2] / 1e308 / 2 + 0.5])
    assert np.histogram(shares, 10, (0, 1))[0].min() > 500
    assert A._splits(np.zeros(1, int), np.ones(1, int), np.zeros((2, 1)), np.zeros((2, 1)), 0, 1)[0].tolist() == [-1]
    one, next_ = np.ones((1, 50)), np.nextafter(np.ones((1, 50)), 2)
    assert (A._splits(np.zeros(50), np.arange(1, 51), one, next_, 0, 1)[1] == 1).all()
