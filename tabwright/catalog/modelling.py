"""Clusters, anomalies, explanations and supervised models."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tabwright.catalog.base import query, steady, table
from tabwright.operators import aggregates as G
from tabwright.operators import clustering as C
from tabwright.operators import explain as X
from tabwright.operators import isolation as A
from tabwright.operators import trees as R
from tabwright.operators.columns import expand_array
from tabwright.operators.density import cell_counts, density_hint
from tabwright.operators.silhouettes import silhouette_bounds
from tabwright.plans.analysis import analyse
from tabwright.plans.analysis import k_choice as explain_k
from tabwright.session import materialise

_WIDTH = 64
_FEATURES = [f"e{i}" for i in range(_WIDTH)]
_EXPAND = ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in range(_WIDTH))
_LONG = ("(SELECT vec_id, label, 'e' || (i - 1) AS feature, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, "
         f"(SELECT unnest(range(1, {_WIDTH + 1})) AS i))")
_MEANS = f"(SELECT label, feature, avg(x) AS mean, count(*) AS size FROM {_LONG} GROUP BY label, feature)"
_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def embedded(spark, folder):
    """Embeddings as one column per dimension, with their given labels."""
    return expand_array(table(spark, folder, "embeddings"), "embedding", "e", _WIDTH)


def labelled(spark, folder):
    return embedded(spark, folder).drop("vec_id")


@query(f"SELECT label, feature, size, round(mean + 1e-9, 6) AS mean FROM {_MEANS}")
def group_means(spark, folder):
    return G.long_group_means(labelled(spark, folder), "label", _FEATURES).withColumn("mean", steady("mean", 6))


@query("""
SELECT l_returnflag, round(median(l_extendedprice) + 1e-9, 4) AS median, round(avg(l_extendedprice) + 1e-9, 4) AS mean,
  round(stddev_samp(l_extendedprice) + 1e-9, 4) AS std, min(l_extendedprice) AS minimum, max(l_extendedprice) AS maximum,
  count(l_extendedprice) AS count FROM lineitem GROUP BY l_returnflag
""")
def group_stats(spark, folder):
    out = G.group_stats(table(spark, folder, "lineitem"), "l_returnflag", "l_extendedprice")
    return out.select(
        "l_returnflag", *[steady(c, 4).alias(c) for c in ("median", "mean", "std")], "minimum", "maximum", "count"
    )


@query("""
SELECT event_type, min(value) AS minimum, round(quantile_cont(value, 0.25) + 1e-9, 4) AS q1,
  round(quantile_cont(value, 0.5) + 1e-9, 4) AS median, round(quantile_cont(value, 0.75) + 1e-9, 4) AS q3,
  max(value) AS maximum FROM events GROUP BY event_type
""")
def five_numbers(spark, folder):
    out = G.five_numbers(table(spark, folder, "events"), "event_type", "value")
    return out.select("event_type", "minimum", *[steady(c, 4).alias(c) for c in ("q1", "median", "q3")], "maximum")


@query("""
SELECT CAST(least(floor((value - lo) / ((hi - lo) / 50)), 49) AS BIGINT) AS bin, event_type, count(*) AS n
FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events) GROUP BY 1, 2
""")
def histogram(spark, folder):
    return G.histogram(table(spark, folder, "events"), "value", "event_type", 50)


@query(f"""
SELECT feature, round(var_samp(mean) * 1e4 + 1e-9, 6) AS variance FROM {_MEANS} GROUP BY feature ORDER BY var_samp(mean) DESC, feature LIMIT 20
""")
def between_group_variance(spark, folder):
    means = G.long_group_means(labelled(spark, folder), "label", _FEATURES)
    return G.between_group_variance(means, 20).withColumn("variance", steady(F.col("variance") * 1e4, 6))


_PROFILE = f"""
SELECT label, size, percentage, rank, feature, round(mean, 4) AS mean, round(delta, 4) AS delta FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY round(delta, 9) DESC, feature) AS INTEGER) AS rank FROM (
    SELECT m.*, abs(mean - o.overall) AS delta, round(size * 100.0 / o.n, 2) AS percentage
    FROM {_MEANS} m JOIN (SELECT feature, avg(x) AS overall, count(*) AS n FROM {_LONG} GROUP BY feature) o USING (feature)))
WHERE rank <= 5"""


@query(_PROFILE)
def cluster_profile(spark, folder):
    return C.profile_clusters(labelled(spark, folder), "label")


@query(f"""
SELECT label, size, percentage, string_agg(feature, ',' ORDER BY rank) AS dominant_features FROM ({_PROFILE})
GROUP BY label, size, percentage
""")
def dominant_features(spark, folder):
    out = C.dominant_features(C.profile_clusters(labelled(spark, folder), "label"), "label")
    return out.withColumn("dominant_features", F.array_join("dominant_features", ","))


@query(f"SELECT feature, count(*) AS n FROM ({_PROFILE}) GROUP BY feature")
def dominant_feature_counts(spark, folder):
    out = C.dominant_features(C.profile_clusters(labelled(spark, folder), "label"), "label")
    return G.count_items(out, "dominant_features", "feature")


@query(f"""
WITH p AS ({_PROFILE}), t AS (SELECT sum(size) AS total FROM (SELECT DISTINCT label, size FROM p))
SELECT feature, round(sum(mean * size) / any_value(total) * 1e3 + 1e-9, 5) AS weighted_mean,
       round(sum(mean * size) / sum(size) * 1e3 + 1e-9, 5) AS true_mean FROM p, t GROUP BY feature
""")
def weighted_means(spark, folder):
    profile = C.profile_clusters(labelled(spark, folder), "label").withColumnRenamed("label", "cluster")
    out = G.weighted_means(profile)
    return out.select("feature", *[steady(F.col(c) * 1e3, 5).alias(c) for c in ("weighted_mean", "true_mean")])


@query(f"""
WITH p AS ({_PROFILE}), t AS (SELECT sum(size) AS total FROM (SELECT DISTINCT label, size FROM p)),
o AS (SELECT feature, sum(mean * size) / any_value(total) AS m FROM p, t GROUP BY feature)
SELECT label AS cluster, rank AS trait, feature, CASE WHEN m = 0 THEN NULL WHEN mean > m THEN 'above' ELSE 'below' END AS direction
FROM p JOIN o USING (feature) WHERE rank <= 3
""")
def cluster_traits(spark, folder):
    profile = C.profile_clusters(labelled(spark, folder), "label").withColumnRenamed("label", "cluster")
    return X.cluster_traits(profile).select("cluster", "trait", "feature", "direction")


@query(f"""
WITH m AS (SELECT label, list(mean ORDER BY feature) AS c FROM {_MEANS} GROUP BY label),
x AS (SELECT vec_id, label, list(x ORDER BY feature) AS v FROM {_LONG} GROUP BY vec_id, label),
s AS (SELECT m.label, m.c, avg(list_distance(v, c)) AS s FROM x JOIN m USING (label) GROUP BY m.label, m.c)
SELECT round(avg(w), 4) AS davies_bouldin FROM (
  SELECT a.label, max((a.s + b.s) / list_distance(a.c, b.c)) AS w FROM s a JOIN s b ON a.label <> b.label GROUP BY a.label)
""")
def davies_bouldin(spark, folder):
    return C.davies_bouldin(labelled(spark, folder), "label")


def _silhouette_sql(distance, digits):
    return f"""
WITH d AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum({distance}) AS s, count(*) AS n
           FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3),
w AS (SELECT vec_id, max(s / n) FILTER (own = other) AS a, min(s / n) FILTER (own <> other) AS b FROM d GROUP BY vec_id)
SELECT round(avg((b - a) / greatest(a, b)), {digits}) AS silhouette FROM w"""


@query(_silhouette_sql("list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))", 4))
def silhouette(spark, folder):
    """Euclidean silhouette of all rows; exact where there are no more rows than cells, else between bounds."""
    return spark.createDataFrame([(C.silhouette(labelled(spark, folder), "label"),)], "silhouette double")


@query("SELECT count(*) AS n, TRUE AS ordered, TRUE AS narrower FROM lineitem")
def silhouette_interval(spark, folder):
    """Bounds on the silhouette of the order lines by return flag: the estimate lies between them, more cells draw them closer."""
    rows = table(spark, folder, "lineitem").select("l_returnflag", *_LINE)
    few, many = (silhouette_bounds(rows, "l_returnflag", cells).first() for cells in (64, 512))
    ordered = all(-1 <= r["low"] <= r["silhouette"] <= r["high"] <= 1 for r in (few, many)) and many["low"] <= few["high"] and few["low"] <= many["high"]
    return spark.createDataFrame([(many["rows"], ordered, many["high"] - many["low"] < few["high"] - few["low"])], "n long, ordered boolean, narrower boolean")


@query(_silhouette_sql("pow(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 2)", 4))
def silhouette_squared(spark, folder):
    value = C.silhouette_squared(labelled(spark, folder), "label")
    return spark.createDataFrame([(round(value, 4),)], "silhouette double")


@query("""
WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2),
s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS ab, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY a)) AS sa,
  (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY b)) AS sb, (SELECT sum(n) * (sum(n) - 1) / 2 FROM c) AS t)
SELECT round((ab - sa * sb / t) / ((sa + sb) / 2 - sa * sb / t), 4) AS ari FROM s
""")
def adjusted_rand(spark, folder):
    return C.adjusted_rand(table(spark, folder, "lineitem"), "l_returnflag", "l_linestatus")


@query("SELECT vec_id, label, TRUE AS shortened, TRUE AS independent FROM embeddings")
def pca_plane(spark, folder):
    """Every vector's place on the principal plane: no farther from the middle than the vector is, the components centred and uncorrelated."""
    rows = embedded(spark, folder)
    means = rows.agg(*[F.avg(f).alias(f) for f in _FEATURES]).first()
    length = sum((F.col(f) - F.lit(means[f])) ** 2 for f in _FEATURES)
    plane = materialise(C.pca_2d(rows, ["vec_id", "label"]), "plane")
    r = plane.agg(F.avg("PC1"), F.avg("PC2"), F.corr("PC1", "PC2"), F.var_pop("PC1"), F.var_pop("PC2")).first()
    independent = max(abs(x) for x in r[:3]) < 1e-6 and r[3] >= r[4]
    lengths = rows.select("vec_id", length.alias("length"))
    return plane.join(lengths, "vec_id").select("vec_id", "label", (F.col("PC1") ** 2 + F.col("PC2") ** 2 <= F.col("length") + 1e-9).alias("shortened"), F.lit(independent).alias("independent"))


@query("SELECT CAST(4 AS BIGINT) AS clusters, count(*) AS n, TRUE AS settled FROM lineitem")
def kmeans_clusters(spark, folder):
    """Four clusters of the order lines hold every line, and each centre is the mean of its rows up to the tolerance."""
    rows = table(spark, folder, "lineitem").select(*_LINE)
    fit = C.fit_kmeans(rows, 4)
    found = fit.assign(rows).groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), *[F.avg(c).alias(c) for c in _LINE])
    deviation = rows.agg(F.stddev_pop("l_extendedprice")).first()[0]
    near = F.lit(True)
    for i, center in enumerate(fit.centers):
        away = sum((F.col(c).cast("double") - x) ** 2 for c, x in zip(fit.features, center))
        near = near & ((F.col("cluster") != i) | (away <= (0.01 * deviation) ** 2))
    return found.agg(F.count(F.lit(1)).alias("clusters"), F.sum("size").alias("n"), F.bool_and(near).alias("settled"))


@query("SELECT count(*) AS n, TRUE AS nearest, TRUE AS in_range FROM embeddings")
def kmeans_assign(spark, folder):
    """Every row goes to its own nearest centre."""
    fit = C.fit_kmeans(labelled(spark, folder).drop("label"), 5)
    rows = fit.assign(embedded(spark, folder))
    gaps = [sum((F.col(f).cast("double") - c) ** 2 for f, c in zip(fit.features, center)) for center in fit.centers]
    own = F.element_at(F.array(*gaps), F.col("cluster") + 1)
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(own <= F.least(*gaps) + 1e-6).alias("nearest"),
        F.bool_and(F.col("cluster").between(0, fit.k - 1)).alias("in_range"),
    )


@query("SELECT CAST(k AS INTEGER) AS k, TRUE AS in_range, TRUE AS best_is_highest FROM range(2, 11) r(k)")
def k_search(spark, folder):
    """A silhouette for every k from 2 to 10; the chosen one has the highest, the smallest k of equals."""
    best, scores, _ = C.search_k(labelled(spark, folder).drop("label"), 2, 10)
    highest = best == min(k for k, s in scores.items() if s == max(scores.values()))
    return spark.createDataFrame([(k, -1 <= s <= 1, highest) for k, s in scores.items()], "k int, in_range boolean, best_is_highest boolean")


@query("SELECT CAST(i AS INTEGER) AS run, TRUE AS in_range FROM range(5) r(i)")
def cluster_stability(spark, folder):
    """Agreement of five runs from other starts with the given clusters."""
    rows = table(spark, folder, "lineitem").select(*_LINE)
    given = materialise(C.fit_kmeans(rows, 3).assign(rows), "clustered")
    scores = C.cluster_stability(given, "cluster", 3)
    return spark.createDataFrame([(i, -0.5 <= s <= 1) for i, s in enumerate(scores)], "run int, in_range boolean")


_PLANE = """SELECT least(CAST(floor((l_quantity - a) / (b - a) * 64) AS INTEGER), 63) AS i,
  least(CAST(floor((l_extendedprice - c) / (d - c) * 64) AS INTEGER), 63) AS j, count(*) AS n FROM lineitem,
  (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_extendedprice) AS c, max(l_extendedprice) AS d FROM lineitem) GROUP BY 1, 2"""


@query(_PLANE)
def density_cells(spark, folder):
    """Order lines per cell of a grid over quantity and price."""
    return cell_counts(table(spark, folder, "lineitem").select(F.col("l_quantity").alias("PC1"), F.col("l_extendedprice").alias("PC2")))


@query("SELECT count(*) AS n, TRUE AS whole FROM embeddings")
def density_groups(spark, folder):
    """Groups and noise on the principal plane account for every vector."""
    rows = labelled(spark, folder).drop("label")
    hint = density_hint(C.pca_2d(rows), 20)
    whole = hint.n_clusters >= 0 and abs(hint.noise_ratio - 100.0 * hint.n_noise / rows.count()) < 0.01
    return spark.createDataFrame([(rows.count(), whole and 0 <= hint.n_noise <= rows.count())], "n long, whole boolean")


@query("SELECT count(*) AS n, TRUE AS close, TRUE AS nearest FROM lineitem")
def minibatch_clusters(spark, folder):
    """Mini-batch centres cost at most a twentieth more than full k-means, and every row is at its nearest centre."""
    rows = materialise(table(spark, folder, "lineitem").select(*_LINE), "lines")
    full, fit = C.fit_kmeans(rows, 4, inits=1), C.fit_minibatch(rows, 4)
    gaps = [sum((F.col(f).cast("double") - c) ** 2 for f, c in zip(fit.features, center)) for center in fit.centers]
    own = F.element_at(F.array(*gaps), F.col("cluster") + 1)
    return fit.assign(rows).agg(
        F.count(F.lit(1)).alias("n"), (F.sum(own) <= 1.05 * full.cost).alias("close"), F.bool_and(own <= F.least(*gaps) * (1 + 1e-6) + 1e-6).alias("nearest")
    )


# A fixed score over the events: min-max of the value, the top tenth of the range flagged.
_SCORED = """(SELECT event_id, user_id, event_type, anomaly_score, is_anomaly,
  CASE WHEN is_anomaly = 0 THEN 'normal' WHEN anomaly_score >= 0.95 THEN 'critique' WHEN anomaly_score >= 0.85 THEN 'élevé'
       WHEN anomaly_score >= 0.7 THEN 'moyen' ELSE 'faible' END AS severity,
  CAST(user_id % 4 AS INTEGER) AS cluster FROM (
  SELECT *, (value - lo) / (hi - lo) AS anomaly_score, CAST((value - lo) / (hi - lo) > 0.5 AS INTEGER) AS is_anomaly
  FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events)))"""


def scored_events(spark, folder):
    rows = table(spark, folder, "events").withColumn("decision_score", -F.col("value"))
    scored = A.min_max_score(rows).withColumn("is_anomaly", (F.col("anomaly_score") > 0.5).cast("int"))
    return A.with_severity(scored).withColumn("cluster", (F.col("user_id") % 4).cast("int"))


@query(f"SELECT event_id, round(anomaly_score + 1e-9, 6) AS anomaly_score, is_anomaly, severity FROM {_SCORED}")
def severity(spark, folder):
    return scored_events(spark, folder).select("event_id", steady("anomaly_score", 6).alias("anomaly_score"), "is_anomaly", "severity")


@query(f"""
SELECT count(*) AS total_rows, CAST(sum(is_anomaly) AS BIGINT) AS anomaly_count,
  round(sum(is_anomaly) * 100.0 / count(*), 2) AS anomaly_ratio, round(avg(anomaly_score), 4) AS avg_anomaly_score,
  round(max(anomaly_score), 4) AS max_anomaly_score FROM {_SCORED}
""")
def anomaly_summary(spark, folder):
    return A.anomaly_summary(scored_events(spark, folder)).drop("severity_counts")


@query(f"SELECT severity, count(*) AS n FROM {_SCORED} GROUP BY severity")
def severity_counts(spark, folder):
    return A.anomaly_summary(scored_events(spark, folder)).select(F.explode("severity_counts").alias("severity", "n"))


@query(f"SELECT event_id, severity FROM {_SCORED} WHERE is_anomaly = 1 ORDER BY anomaly_score DESC, event_id LIMIT 50")
def top_anomalies(spark, folder):
    return A.top_anomalies(scored_events(spark, folder), 50, ["event_id"]).select("event_id", "severity")


@query(f"SELECT event_id, severity FROM {_SCORED} WHERE severity IN ('critique', 'élevé') AND anomaly_score >= 0.9")
def filtered_anomalies(spark, folder):
    return A.filter_anomalies(scored_events(spark, folder), ["critique", "élevé"], 0.9).select("event_id", "severity")


CROSS_SQL = f"""
SELECT cluster, size, anomaly_count, r AS anomaly_ratio_pct, g AS global_ratio_pct, round(r - g, 2) AS gap_pct,
  r > g * 1.5 + 1 AS to_watch FROM (
  SELECT cluster, count(*) AS size, CAST(sum(is_anomaly) AS BIGINT) AS anomaly_count,
    round(sum(is_anomaly) * 100.0 / count(*), 2) AS r, (SELECT round(sum(is_anomaly) * 100.0 / count(*), 2) FROM {_SCORED}) AS g
  FROM {_SCORED} GROUP BY cluster)"""


@query(CROSS_SQL)
def cross_table(spark, folder):
    return G.cross_table(scored_events(spark, folder))


@query(f"""
WITH g AS (SELECT vec_id, label, feature, x, mean, abs(x - mean) AS gap FROM {_LONG} JOIN {_MEANS} m USING (label, feature))
SELECT vec_id, label AS cluster, rank, feature, round(x, 5) AS value, round(mean + 1e-9, 5) AS target FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY gap DESC, feature) AS INTEGER) AS rank FROM g) WHERE rank <= 2
""")
def counterfactuals(spark, folder):
    """For every vector the two dimensions furthest from its group's centre."""
    rows = embedded(spark, folder).withColumnRenamed("label", "cluster")
    centers = G.long_group_means(rows.drop("vec_id"), "cluster", _FEATURES).select(
        "cluster", "feature", F.col("mean").alias("center")
    )
    out = X.counterfactuals(rows, centers, _FEATURES, "vec_id")
    return out.select("vec_id", "cluster", "rank", "feature", F.round("value", 5).alias("value"), steady("target", 5).alias("target"))


def _forest(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_orderkey", *_LINE)
    return A.anomaly_table(rows, keep=["l_orderkey"])


_WHOLE = "SELECT count(*) AS n, TRUE AS flagged, TRUE AS graded FROM lineitem"


def _statements(rows):
    """Scores of every row: raw scores within (-1, 0), the flag and the severity follow from the scores."""
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_and((F.col("is_anomaly") == (F.col("decision_score") < 0).cast("int")) & F.col("raw_score").between(-1, 0)).alias("flagged"),
        F.bool_and(F.col("anomaly_score").between(0, 1) & ((F.col("severity") == "normal") == (F.col("is_anomaly") == 0))).alias("graded"),
    )


@query(_WHOLE)
def isolation_scores(spark, folder):
    return _statements(_forest(spark, folder).rows)


@query("SELECT count(*) AS total_rows, TRUE AS near FROM lineitem")
def isolation_contamination(spark, folder):
    """The share of flagged rows follows the wanted contamination."""
    rows = table(spark, folder, "lineitem").select(*_LINE)
    return A.anomaly_table(rows, contamination=0.02).summary.select("total_rows", F.col("anomaly_ratio").between(1.9, 2.1).alias("near"))


@query("SELECT count(*) AS n, TRUE AS graded, TRUE AS centred FROM lineitem")
def anomaly_plane(spark, folder):
    """Every scored line on the principal plane, with its score and severity."""
    plane = materialise(_forest(spark, folder).plane, "plane")
    found = plane.agg(
        F.count(F.lit(1)).alias("n"), F.bool_and((F.col("severity") == "normal") == (F.col("is_anomaly") == 0)).alias("graded"),
        (F.abs(F.avg("PC1")) < 1e-6 * F.stddev_pop("PC1")).alias("centred"),
    )
    return found


@query(_WHOLE + " WHERE l_shipdate >= DATE '1998-01-01'")
def isolation_new_rows(spark, folder):
    """A forest fitted on the older lines scores the later ones."""
    lines = table(spark, folder, "lineitem")
    forest = A.anomaly_table(lines.filter(F.col("l_shipdate") < "1998-01-01").select(*_LINE)).forest
    return _statements(A.detect(lines.filter(F.col("l_shipdate") >= "1998-01-01").select(*_LINE), forest, "fit"))


@query("""
SELECT CAST(t AS INTEGER) AS tree, CAST(count(*) AS BIGINT) AS root_rows, TRUE AS consistent FROM lineitem, range(4) r(t) GROUP BY t
""")
def isolation_levels(spark, folder):
    """Trees over all rows, grown level by level: leaves hold every row, and a split node's rows are those of its children."""
    rows = table(spark, folder, "lineitem").select(*_LINE)
    forest = A.fit_forest(rows, trees=4, max_samples=1.0)
    nodes = (forest if isinstance(forest, A.StoredForest) else forest.stored(spark)).nodes
    children = nodes.groupBy("tree", F.shiftright("node", 1).alias("node")).agg(F.sum("size").alias("below"), F.count(F.lit(1)).alias("m"))
    inner = nodes.filter("feature >= 0").join(children, ["tree", "node"], "left").groupBy("tree").agg(
        F.bool_and(F.coalesce((F.col("size") == F.col("below")) & (F.col("m") == 2), F.lit(False))).alias("parted")
    )
    per = nodes.groupBy("tree").agg(F.max(F.when(F.col("node") == 1, F.col("size"))).alias("root_rows"), F.sum(F.when(F.col("feature") < 0, F.col("size"))).alias("held"))
    return per.join(inner, "tree").select("tree", "root_rows", (F.col("parted") & (F.col("held") == F.col("root_rows"))).alias("consistent"))


def _contributions(spark, folder, method):
    found = _forest(spark, folder)
    top = materialise(A.top_anomalies(found.rows, 15), "top").withColumn("row_key", F.monotonically_increasing_id())
    return X.top_contributions(X.contributions(top, found.forest, "row_key", method), "row_key", 3, method)


def _pushes(rows):
    """Per rank how many anomalies have a feature there, and whether ranks follow the strength."""
    before = F.lag(F.abs("contribution")).over(W.partitionBy("row_key").orderBy("rank"))
    ranked = rows.withColumn("falling", F.coalesce(before >= F.abs("contribution") - 1e-12, F.lit(True)))
    return ranked.groupBy("rank").agg(F.count_distinct("row_key").alias("n"), F.bool_and("falling").alias("falling"))


@query("SELECT TRUE AS efficient, CAST(least(15, count(*)) AS BIGINT) AS n FROM lineitem")
def shap_contributions(spark, folder):
    """Shapley values of the 15 top anomalies add up to how far the mean path lies from the expected one."""
    found = _forest(spark, folder)
    top = materialise(A.top_anomalies(found.rows, 15), "top").withColumn("row_key", F.monotonically_increasing_id())
    long = X.contributions(top, found.forest, "row_key", "shap")
    scale = A.average_path(found.forest.rows_per_tree)
    path = top.select("row_key", (-F.log2(-F.col("raw_score")) * F.lit(scale)).alias("path"))
    gaps = long.groupBy("row_key").agg(F.sum("contribution").alias("moved")).join(path, "row_key").select((F.col("path") - F.col("moved")).alias("expected"))
    return gaps.agg((F.max("expected") - F.min("expected") < 1e-6).alias("efficient"), F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(1 AS INTEGER) AS rank, CAST(least(15, count(*)) AS BIGINT) AS n, TRUE AS falling FROM lineitem")
def depth_contributions(spark, folder):
    """Every top anomaly has a feature that its paths split on most."""
    return _pushes(_contributions(spark, folder, "depth")).filter("rank = 1")


def _surrogate(spark, folder):
    rows = materialise(table(spark, folder, "lineitem").select(*_LINE), "lines")
    clustered = materialise(C.fit_kmeans(rows, 3).assign(rows), "clustered")
    return clustered, R.fit_surrogate(clustered)


@query("SELECT count(*) AS n, TRUE AS counted, TRUE AS won FROM lineitem")
def surrogate_leaves(spark, folder):
    """The leaves of the surrogate tree hold every line; a leaf's classes add up to its rows and its winner has most of them."""
    leaves = _surrogate(spark, folder)[1].leaves
    held = F.map_values("class_counts")
    return leaves.agg(
        F.sum("n").alias("n"), F.bool_and(F.aggregate(held, F.lit(0).cast("long"), lambda a, x: a + x) == F.col("n")).alias("counted"),
        F.bool_and((F.col("class_counts")[F.col("winner")] == F.array_max(held)) & (F.col("purity") == F.round(F.array_max(held) / F.col("n"), 4))).alias("won"),
    )


@query("SELECT TRUE AS in_range, TRUE AS same FROM lineitem LIMIT 1")
def surrogate_fidelity(spark, folder):
    """The share of lines whose cluster the tree names is what its leaves say, and the folds give about as much."""
    surrogate = _surrogate(spark, folder)[1]
    told = surrogate.leaves.agg(F.sum(F.array_max(F.map_values("class_counts"))) / F.sum("n")).first()[0]
    return surrogate.fidelity().select(
        (F.col("train").between(0, 1) & F.col("cv").between(F.col("train") - 0.1, F.col("train") + 0.1)).alias("in_range"), (F.abs(F.col("train") - F.lit(told)) < 1e-3).alias("same")
    )


@query("SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS feature, TRUE AS in_range, TRUE AS adds_up FROM lineitem LIMIT 4")
def surrogate_importance(spark, folder):
    rows = _surrogate(spark, folder)[1].importance()
    whole = abs(rows.agg(F.sum("importance")).first()[0] - 1) < 1e-9
    return rows.select("feature", F.col("importance").between(0, 1).alias("in_range"), F.lit(whole).alias("adds_up"))


@query("SELECT count(*) AS n, TRUE AS covered FROM lineitem")
def cluster_rules(spark, folder):
    """Per cluster its best leaf: clusters together hold all lines, each rule covers a part of its cluster."""
    clustered, surrogate = _surrogate(spark, folder)
    sizes = clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    rules = R.cluster_rules(surrogate, sizes).join(sizes, "cluster")
    return rules.agg(F.sum("size").alias("n"), F.bool_and(F.col("coverage_pct").between(0.1, 100) & (F.size("conditions") > 0)).alias("covered"))


@query("""
WITH c AS (SELECT l_quantity AS leaf, l_returnflag AS k, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT leaf, arg_min(k, (-n, k)) AS winner, CAST(sum(n) AS BIGINT) AS n, round(max(n) / sum(n), 4) AS purity FROM c GROUP BY leaf
""")
def leaf_table(spark, folder):
    """Winner, size and purity of given leaves."""
    rows = table(spark, folder, "lineitem").withColumnRenamed("l_quantity", "leaf")
    return R.leaf_table(rows, "l_returnflag", "leaf").drop("class_counts")


@query("""
WITH c AS (SELECT quality AS k, toxic AS p, count(*) AS n FROM labels GROUP BY 1, 2),
r AS (SELECT k, sum(n) AS support, coalesce(sum(n) FILTER (k = p), 0) AS hit FROM c GROUP BY k),
q AS (SELECT p AS k, sum(n) AS called FROM c GROUP BY p),
m AS (SELECT k, support, coalesce(hit / nullif(called, 0), 0) AS precision, coalesce(hit / nullif(support, 0), 0) AS recall
      FROM r LEFT JOIN q USING (k)),
f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM m)
SELECT CAST(k AS VARCHAR) AS class, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1,
  CAST(support AS BIGINT) AS support FROM f
UNION ALL SELECT 'macro avg', round(avg(precision), 4), round(avg(recall), 4), round(avg(f1), 4), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 4), round(sum(recall * support) / sum(support), 4),
  round(sum(f1 * support) / sum(support), 4), CAST(sum(support) AS BIGINT) FROM f
""")
def classification_report(spark, folder):
    return R.classification_report(table(spark, folder, "labels"), "quality", "toxic")


@query("""
WITH held AS (SELECT l_linestatus AS class, CAST(round(count(*) * 0.2) AS BIGINT) AS support FROM lineitem GROUP BY 1)
SELECT class, support, TRUE AS in_range FROM held
UNION ALL SELECT unnest(['macro avg', 'weighted avg']), CAST(sum(support) AS BIGINT), TRUE FROM held
""")
def supervised_report(spark, folder):
    """Random forest for the line status, evaluated on exactly a fifth of each class."""
    rows = table(spark, folder, "lineitem").select("l_linestatus", *_LINE, F.year("l_shipdate").alias("y"))
    report = R.train_supervised(rows, "l_linestatus").report
    return report.select("class", "support", (F.col("precision").between(0, 1) & F.col("recall").between(0, 1) & F.col("f1").between(0, 1)).alias("in_range"))


@query()
def analysis_findings(spark, folder):
    """Every step on the parts table, ending in the table of findings."""
    return analyse(table(spark, folder, "part")).explanation["findings"]


@query("SELECT TRUE AS searched, TRUE AS best FROM lineitem LIMIT 1")
def k_choice(spark, folder):
    """The k used for the order lines scores at least as much as the hinted one."""
    rows = table(spark, folder, "lineitem").select(*_LINE)
    found = explain_k(C.cluster_table(rows))
    return found.select("searched", (F.col("k").between(2, 10) & (F.col("best_score") >= F.coalesce("score_at_hint", F.lit(-1.0)))).alias("best"))
