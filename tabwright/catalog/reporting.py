"""Findings, history, growth checks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.catalog.base import query, steady, table
from tabwright.catalog.modelling import (
    _MEANS, _SCORED, CROSS_SQL, _FEATURES, labelled, scored_events,
)
from tabwright.operators import aggregates as G
from tabwright.operators import clustering as C
from tabwright.operators import findings as N
from tabwright.operators import isolation as A
from tabwright.plans import preparation as P
from tabwright.session import materialise, scratch_path
from tabwright.streaming import incremental as I
from tabwright.streaming.history import History


@query(f"""
WITH c AS (SELECT cluster, count(*) AS n FROM {_SCORED} GROUP BY cluster)
SELECT arg_max(cluster, (n, -cluster)) AS largest_cluster, arg_min(cluster, (n, cluster)) AS smallest_cluster,
  round(max(n) * 100.0 / sum(n) + 1e-9, 4) AS largest_pct, round(min(n) * 100.0 / sum(n) + 1e-9, 4) AS smallest_pct,
  round((max(n) - min(n)) * 100.0 / sum(n) + 1e-9, 4) AS gap_pct,
  CASE WHEN max(n) * 100.0 / sum(n) >= 80 THEN 'danger' WHEN max(n) * 100.0 / sum(n) >= 60 THEN 'warning' ELSE 'success' END AS tone
FROM c
""")
def cluster_balance(spark, folder):
    out = N.cluster_balance(scored_events(spark, folder))
    return out.select("largest_cluster", "smallest_cluster", *[steady(c, 4).alias(c) for c in ("largest_pct", "smallest_pct", "gap_pct")], "tone")


@query(f"""
SELECT count(*) AS total_rows, CAST(sum(is_anomaly) AS BIGINT) AS anomaly_count, round(sum(is_anomaly) * 100.0 / count(*), 2) AS anomaly_ratio,
 CASE WHEN anomaly_ratio >= 10 THEN 'critique' WHEN anomaly_ratio >= 5 THEN 'élevé' WHEN anomaly_ratio >= 1 THEN 'modéré' ELSE 'faible' END AS label,
 CASE WHEN anomaly_ratio >= 10 THEN 'danger' WHEN anomaly_ratio >= 5 THEN 'warning' WHEN anomaly_ratio >= 1 THEN 'neutral' ELSE 'success' END AS tone
FROM {_SCORED}
""")
def anomaly_rate(spark, folder):
    return N.anomaly_rate(scored_events(spark, folder))


@query(f"""
SELECT count(*) FILTER (severity = 'critique') AS critical_count, count(*) FILTER (severity = 'élevé') AS high_count,
  CASE WHEN critical_count > 0 THEN 'critique' WHEN high_count > 0 THEN 'élevé' ELSE 'none' END AS priority FROM {_SCORED}
""")
def priority(spark, folder):
    return N.priority(scored_events(spark, folder))


@query(f"""
SELECT count(*) FILTER (severity = 'critique') AS critical_count, count(*) FILTER (severity = 'élevé') AS high_count,
  count(*) FILTER (severity = 'moyen') AS medium_count, count(*) FILTER (severity = 'faible') AS low_count,
  count(*) FILTER (severity = 'normal') AS normal_count, critical_count + high_count AS priority_count,
  round((critical_count + high_count) * 100.0 / count(*), 2) AS priority_pct,
  CASE WHEN critical_count > 0 THEN 'danger' WHEN high_count > 0 THEN 'warning' ELSE 'success' END AS tone FROM {_SCORED}
""")
def severity_spread(spark, folder):
    return N.severity_spread(scored_events(spark, folder))


@query(f"""
SELECT round(avg(anomaly_score), 6) AS mean_score, round(median(anomaly_score), 6) AS median_score,
  round(avg(CAST(anomaly_score >= 0.85 AS INTEGER)) * 100, 4) AS high_pct, round(avg(CAST(anomaly_score >= 0.95 AS INTEGER)) * 100, 4) AS critical_pct,
  CASE WHEN avg(CAST(anomaly_score >= 0.95 AS INTEGER)) >= 0.05 THEN 'danger' WHEN avg(CAST(anomaly_score >= 0.85 AS INTEGER)) >= 0.05 THEN 'warning'
       ELSE 'success' END AS tone FROM {_SCORED}
""")
def score_spread(spark, folder):
    out = N.score_spread(materialise(scored_events(spark, folder), "scored"))
    return out.select(F.round("mean_score", 6).alias("mean_score"), F.round("median_score", 6).alias("median_score"),
                      F.round("high_pct", 4).alias("high_pct"), F.round("critical_pct", 4).alias("critical_pct"), "tone")


@query(f"""
SELECT feature, round((max(mean) - min(mean)) * 100 + 1e-9, 5) AS "range", arg_max(label, (mean, -label)) AS highest_cluster,
  arg_min(label, (mean, label)) AS lowest_cluster FROM {_MEANS} GROUP BY feature ORDER BY max(mean) - min(mean) DESC, feature LIMIT 5
""")
def distinguishing_features(spark, folder):
    means = G.long_group_means(labelled(spark, folder), "label", _FEATURES)
    return N.distinguishing_features(means, "label").withColumn("range", steady(F.col("range") * 100, 5))


@query("""
WITH s AS (SELECT l_linenumber AS k, median(l_extendedprice) AS med, stddev_samp(l_extendedprice) AS sd FROM lineitem GROUP BY 1)
SELECT arg_max(k, (med, -k)) AS highest_cluster, round(max(med) + 1e-9, 4) AS highest_median, arg_min(k, (med, k)) AS lowest_cluster,
  round(min(med) + 1e-9, 4) AS lowest_median, arg_max(k, (sd, -k)) AS most_variable_cluster, round(max(sd) + 1e-9, 4) AS highest_std FROM s
""")
def feature_by_cluster(spark, folder):
    out = N.feature_by_cluster(table(spark, folder, "lineitem"), "l_extendedprice", "l_linenumber")
    digits = ("highest_median", "lowest_median", "highest_std")
    return out.select(*[steady(c, 4).alias(c) if c in digits else F.col(c) for c in out.columns])


@query("""
WITH r AS (SELECT count(*) AS n, corr(l_quantity, l_extendedprice) AS c FROM lineitem)
SELECT n, round(c + 1e-9, 6) AS correlation,
  CASE WHEN abs(c) >= 0.8 THEN 'très forte' WHEN abs(c) >= 0.6 THEN 'forte' WHEN abs(c) >= 0.3 THEN 'modérée' ELSE 'faible' END AS strength,
  CASE WHEN c >= 0 THEN 'positive' ELSE 'négative' END AS direction,
  CASE WHEN abs(c) >= 0.8 THEN 'warning' WHEN abs(c) >= 0.3 THEN 'neutral' ELSE 'success' END AS tone FROM r
""")
def pair_correlation(spark, folder):
    out = N.pair_correlation(table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice")
    return out.withColumn("correlation", steady("correlation", 6))


@query(f"""
WITH p AS (SELECT s.is_anomaly, s.user_id / 10.0 AS x, s.anomaly_score * 10 AS y FROM {_SCORED} s),
d AS (SELECT sum(is_anomaly) AS a, count(*) - sum(is_anomaly) AS n, sqrt(pow(avg(x) FILTER (is_anomaly = 1) - avg(x) FILTER (is_anomaly = 0), 2)
  + pow(avg(y) FILTER (is_anomaly = 1) - avg(y) FILTER (is_anomaly = 0), 2)) AS dist FROM p)
SELECT CAST(a AS BIGINT) AS anomaly_count, CAST(n AS BIGINT) AS normal_count, round(dist + 1e-9, 5) AS center_distance,
  CASE WHEN a = 0 THEN 'neutral' WHEN n = 0 THEN 'warning' WHEN dist >= 2 THEN 'success' ELSE 'neutral' END AS tone FROM d
""")
def plane_distance(spark, folder):
    points = scored_events(spark, folder).select(
        "is_anomaly", (F.col("user_id") / 10).alias("PC1"), (F.col("anomaly_score") * 10).alias("PC2")
    )
    return N.pca_distance(points).withColumn("center_distance", steady("center_distance", 5))


@query(f"""
SELECT arg_max(cluster, (anomaly_ratio_pct, -cluster)) AS cluster, max(anomaly_ratio_pct) AS cluster_pct, max(global_ratio_pct) AS global_pct,
  round(max(anomaly_ratio_pct) - max(global_ratio_pct), 6) AS difference,
  CASE WHEN round(max(anomaly_ratio_pct) - max(global_ratio_pct), 6) >= 5 THEN 'danger'
       WHEN round(max(anomaly_ratio_pct) - max(global_ratio_pct), 6) >= 2 THEN 'warning' ELSE 'success' END AS tone FROM ({CROSS_SQL})
""")
def concentration(spark, folder):
    return N.concentration(G.cross_table(scored_events(spark, folder))).withColumn("difference", F.round("difference", 6))


# One metrics row per event type, from the data, to exercise the bands.
_METRICS = "(SELECT event_type, avg(value) / 120 - 0.3 AS silhouette, avg(value) AS noise_ratio FROM events GROUP BY event_type)"


def _metrics(spark, folder):
    return table(spark, folder, "events").groupBy("event_type").agg(
        (F.avg("value") / 120 - 0.3).alias("silhouette"), F.avg("value").alias("noise_ratio")
    )


@query(f"""
SELECT round(silhouette + 1e-9, 6) AS silhouette, CASE WHEN silhouette >= 0.5 THEN 'excellente' WHEN silhouette >= 0.25 THEN 'correcte'
  WHEN silhouette >= 0.1 THEN 'faible' ELSE 'très faible / clusters non séparés' END AS label, CASE WHEN silhouette >= 0.5 THEN 'success' WHEN silhouette >= 0.25 THEN 'success'
  WHEN silhouette >= 0.1 THEN 'warning' ELSE 'danger' END AS tone FROM {_METRICS}
""")
def quality_bands(spark, folder):
    return N.quality(_metrics(spark, folder)).withColumn("silhouette", steady("silhouette", 6))


@query(f"""
SELECT round(noise_ratio + 1e-9, 6) AS noise_ratio, CASE WHEN noise_ratio >= 60 THEN 'critique' WHEN noise_ratio >= 40 THEN 'élevé'
  WHEN noise_ratio >= 15 THEN 'modéré' ELSE 'faible' END AS label, CASE WHEN noise_ratio >= 60 THEN 'danger' WHEN noise_ratio >= 40 THEN 'warning'
  WHEN noise_ratio >= 15 THEN 'neutral' ELSE 'success' END AS tone FROM {_METRICS}
""")
def noise_bands(spark, folder):
    return N.noise(_metrics(spark, folder)).withColumn("noise_ratio", steady("noise_ratio", 6))


@query(f"""
WITH x AS ({CROSS_SQL}), t AS (SELECT round(sum(anomaly_count) * 100.0 / sum(size), 2) AS r, round(min(size) * 100.0 / sum(size), 2) AS s FROM x),
k AS (SELECT count(*) FILTER (severity = 'critique') AS c FROM {_SCORED})
SELECT 'many_anomalies' AS rule, 'danger' AS tone, CAST(NULL AS VARCHAR) AS subject, r AS value FROM t WHERE r > 10
UNION ALL SELECT 'tiny_cluster', 'neutral', NULL, s FROM t WHERE s < 2
UNION ALL SELECT 'critical_anomalies', 'danger', NULL, c FROM k WHERE c > 0
UNION ALL SELECT 'cluster_to_watch', 'warning', CAST(cluster AS VARCHAR), anomaly_ratio_pct FROM x WHERE to_watch
UNION ALL SELECT 'weak_separation', 'warning', NULL, 0.2 UNION ALL SELECT 'weak_fidelity', 'warning', NULL, 0.7
""")
def recommendations(spark, folder):
    rows = scored_events(spark, folder)
    sizes = G.value_counts(rows, "cluster")
    total = rows.agg(F.count(F.lit(1)).alias("t"))
    shares = sizes.crossJoin(F.broadcast(total)).select("cluster", F.round(F.col("n") * 100.0 / F.col("t"), 2).alias("percentage"))
    metrics = spark.createDataFrame([(0.2, False, 10.0)], "silhouette double, high_noise boolean, noise_ratio double")
    fidelity = spark.createDataFrame([(0.7, "warning")], "fidelity double, tone string")
    return N.recommendations(metrics, shares, N.anomaly_rate(rows), N.priority(rows), G.cross_table(rows), fidelity,
                             N.stability_table(spark, [0.9, 0.8]))


# One run per month of orders; the second save replaces the runs of 1998.
_RUNS = """(SELECT 'run-' || strftime(o_orderdate, '%Y%m') AS run_id, max(o_orderdate) AS created_at, count(*) AS input_rows,
  CAST(count(DISTINCT o_custkey) AS BIGINT) AS output_rows, CASE WHEN year(max(o_orderdate)) = 1998 THEN 'redone' ELSE 'success' END AS status
  FROM orders GROUP BY 1)"""


def _runs(spark, folder, status="success"):
    return table(spark, folder, "orders").groupBy(F.concat(F.lit("run-"), F.date_format("o_orderdate", "yyyyMM")).alias("run_id")).agg(
        F.max("o_orderdate").alias("created_at"), F.count(F.lit(1)).alias("input_rows"),
        F.count_distinct("o_custkey").alias("output_rows"), F.lit(status).alias("status"),
    )


def _history(spark, folder):
    store = History(spark, scratch_path(spark, "history"))
    store.upsert("pipeline_runs", _runs(spark, folder))
    again = _runs(spark, folder, "redone").filter(F.year("created_at") == 1998)
    store.upsert("pipeline_runs", again)
    return store


@query(f"SELECT * FROM {_RUNS}")
def history_upsert(spark, folder):
    return _history(spark, folder).read("pipeline_runs").select("run_id", "created_at", "input_rows", "output_rows", "status")


@query(f"SELECT count(*) AS n_runs, arg_max(run_id, (created_at, run_id)) AS last_run, arg_max(status, (created_at, run_id)) AS last_status, max(created_at) AS last_created_at FROM {_RUNS}")
def history_kpis(spark, folder):
    return _history(spark, folder).kpis()


@query(f"""
WITH t AS (SELECT count(*) AS n, CAST(arg_min(input_rows, (created_at, run_id)) AS DOUBLE) AS a,
  CAST(arg_max(input_rows, (created_at, run_id)) AS DOUBLE) AS b FROM {_RUNS})
SELECT n AS n_runs, a AS first_value, b AS last_value, b - a AS variation,
  CASE WHEN n < 2 OR abs(b - a) < 0.5 THEN 'neutral' WHEN b - a > 0 THEN 'success' ELSE 'warning' END AS tone FROM t
""")
def history_trend(spark, folder):
    return N.metric_trend(_history(spark, folder).read("pipeline_runs"), "input_rows", True, 0.5)


@query("""
SELECT 'run-' || strftime(o_orderdate, '%Y') AS run_id, o_orderstatus AS column_name FROM orders GROUP BY 1, 2
""")
def history_append(spark, folder):
    """Detail rows appended run by run and read back through the feature reader."""
    store = History(spark, scratch_path(spark, "history"))
    rows = table(spark, folder, "orders").groupBy(
        F.concat(F.lit("run-"), F.date_format("o_orderdate", "yyyy")).alias("run_id"), F.col("o_orderstatus").alias("column_name")
    ).agg(F.max("o_orderdate").alias("created_at"))
    early = rows.filter(F.year("created_at") < 1998)
    store.append("excluded_features", early)
    store.append("excluded_features", rows.filter(F.year("created_at") >= 1998))
    return store.features("excluded_features").select("run_id", "column_name")


@query("""
WITH y AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS n FROM orders GROUP BY 1),
c AS (SELECT y, CAST(sum(n) OVER (ORDER BY y) AS BIGINT) AS current_rows FROM y),
b AS (SELECT *, lag(current_rows) OVER (ORDER BY y) AS baseline_rows FROM c)
SELECT *, round((current_rows - baseline_rows) * 100.0 / baseline_rows, 2) AS growth_pct,
  CASE WHEN baseline_rows IS NULL THEN 'baseline' WHEN (current_rows - baseline_rows) * 100.0 / baseline_rows >= 20 THEN 'run' ELSE 'wait' END AS decision
FROM b
""")
def growth_check(spark, folder):
    """Yearly growth of the orders against the year before."""
    from pyspark.sql.window import Window as W

    years = table(spark, folder, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    order = W.orderBy("y")  # one row per year
    counts = years.select("y", F.sum("n").over(order).alias("current_rows")).withColumn(
        "baseline_rows", F.lag("current_rows").over(order)
    )
    return I.growth_check(counts, 20.0)


@query("""
SELECT count(*) FILTER (o_orderdate < TIMESTAMP '1998-01-01') AS current_rows, CAST(NULL AS BIGINT) AS baseline_rows, 'baseline' AS decision FROM orders
UNION ALL SELECT count(*), count(*) FILTER (o_orderdate < TIMESTAMP '1998-01-01'), 'run' FROM orders
UNION ALL SELECT count(*), count(*), 'wait' FROM orders
""")
def volume_checks(spark, folder):
    """Three checks in a row: first count, enough growth, no growth."""
    path = scratch_path(spark, "checks")
    orders = table(spark, folder, "orders")
    for rows in (orders.filter(F.col("o_orderdate") < "1998-01-01"), orders, orders):
        I.check_volume(rows, spark, path)
    return I.checks(spark, path).select("current_rows", "baseline_rows", "decision")


def _stream(spark, folder, name):
    schema = table(spark, folder, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


@query("SELECT o_orderkey, o_custkey FROM orders")
def stream_append(spark, folder):
    """A stream of all orders lands in a table that already holds the older ones."""
    path = scratch_path(spark, "target")
    old = table(spark, folder, "orders").filter(F.col("o_orderdate") < "1997-01-01")
    old.withColumn("ingested_at", F.current_timestamp()).write.parquet(path)
    running = I.append_stream(_stream(spark, folder, "orders"), path, "o_orderkey", scratch_path(spark, "stream"))
    running.awaitTermination()
    return spark.read.parquet(path).select("o_orderkey", "o_custkey")


@query("SELECT p_partkey % 1 = 0 AS scored, count(*) AS n FROM part GROUP BY 1")
def stream_score(spark, folder):
    """Parts arrive as a stream and are prepared, assigned and scored with stored models."""
    done = P.fit(table(spark, folder, "part"))
    ready = materialise(done.features, "ready")
    kmeans, found = C.fit_kmeans(ready, 3), A.anomaly_table(ready)
    out = scratch_path(spark, "scored")
    running = I.score_stream(_stream(spark, folder, "part"), done.state, kmeans, found.forest, out, scratch_path(spark, "stream"))
    running.awaitTermination()
    good = F.col("cluster").isNotNull() & F.col("anomaly_score").between(0, 1)
    return spark.read.parquet(out).groupBy(good.alias("scored")).agg(F.count(F.lit(1)).alias("n"))
