"""Measured findings: each is one row (or a few) of numbers with a label and a tone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions import scalars as S
from tabwright.functions.scalars import band, percent
from tabwright.operators.aggregates import group_stats
from tabwright.operators.quantiles import exact_quantiles

_LOW = float("-inf")


def _tone(value: Column, *bounds: tuple[float, str]) -> Column:
    return band(value, [(b, t, t) for b, t in bounds], "tone")


def quality(metrics: DataFrame, score: str = "silhouette") -> DataFrame:
    return metrics.select(
        F.col(score).alias("silhouette"), band(F.col(score), S.SILHOUETTE_BANDS).alias("label"),
        band(F.col(score), S.SILHOUETTE_BANDS, "tone").alias("tone"),
    )


def noise(metrics: DataFrame, ratio: str = "noise_ratio") -> DataFrame:
    return metrics.select(
        F.col(ratio).alias("noise_ratio"), band(F.col(ratio), S.NOISE_BANDS).alias("label"),
        band(F.col(ratio), S.NOISE_BANDS, "tone").alias("tone"),
    )


def anomaly_rate(rows: DataFrame, flag: str = "is_anomaly") -> DataFrame:
    """Rate of flagged rows with its band."""
    ratio = percent(F.sum(F.col(flag).cast("long")), F.count(F.lit(1)))
    return (
        rows.agg(F.count(F.lit(1)).alias("total_rows"), F.sum(F.col(flag).cast("long")).alias("anomaly_count"),
                 ratio.alias("anomaly_ratio"))
        .withColumn("label", band(F.col("anomaly_ratio"), S.ANOMALY_RATE_BANDS))
        .withColumn("tone", band(F.col("anomaly_ratio"), S.ANOMALY_RATE_BANDS, "tone"))
    )


def priority(rows: DataFrame) -> DataFrame:
    """Critical and high counts and which of them takes priority."""
    critical, high = F.count_if(F.col("severity") == "critique"), F.count_if(F.col("severity") == "élevé")
    return rows.agg(
        critical.alias("critical_count"), high.alias("high_count"),
        F.when(critical > 0, "critique").when(high > 0, "élevé").otherwise("none").alias("priority"),
    )


def severity_spread(rows: DataFrame) -> DataFrame:
    """Rows per level, the share of critical and high, and its tone."""
    of = lambda level: F.count_if(F.col("severity") == level)
    urgent = of("critique") + of("élevé")
    return rows.agg(
        of("critique").alias("critical_count"), of("élevé").alias("high_count"), of("moyen").alias("medium_count"),
        of("faible").alias("low_count"), of("normal").alias("normal_count"), urgent.alias("priority_count"),
        percent(urgent, F.count(F.lit(1))).alias("priority_pct"),
        F.when(of("critique") > 0, "danger").when(of("élevé") > 0, "warning").otherwise("success").alias("tone"),
    )


def score_spread(rows: DataFrame, score: str = "anomaly_score") -> DataFrame:
    """Mean, median and the shares of high and critical scores."""
    median = exact_quantiles(rows, [score], [0.5])[score][0]
    c = F.col(score)
    base = rows.filter(c.isNotNull()).agg(
        F.avg(c).alias("mean_score"), F.lit(median).alias("median_score"),
        (F.avg((c >= 0.85).cast("double")) * 100).alias("high_pct"),
        (F.avg((c >= 0.95).cast("double")) * 100).alias("critical_pct"),
    )
    tone = F.when(F.col("critical_pct") >= 5, "danger").when(F.col("high_pct") >= 5, "warning").otherwise("success")
    return base.withColumn("tone", tone)


def cluster_balance(rows: DataFrame, label: str = "cluster") -> DataFrame:
    """Largest and smallest cluster, their shares and the gap between them."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    most = F.struct(F.col("n"), -F.col(label))
    least = F.struct(F.col("n"), F.col(label))
    total = F.sum("n")
    return (
        counts.agg(
            F.max_by(label, most).alias("largest_cluster"), F.min_by(label, least).alias("smallest_cluster"),
            (F.max("n") * 100.0 / total).alias("largest_pct"), (F.min("n") * 100.0 / total).alias("smallest_pct"),
        )
        .withColumn("gap_pct", F.col("largest_pct") - F.col("smallest_pct"))
        .withColumn("tone", _tone(F.col("largest_pct"), (80, "danger"), (60, "warning"), (_LOW, "success")))
    )


def separation(metrics: DataFrame, score: str = "silhouette", db: str = "davies_bouldin") -> DataFrame:
    return metrics.select(
        F.col(score).alias("silhouette"), F.col(db).alias("davies_bouldin"),
        _tone(F.col(score), (0.5, "success"), (0.25, "neutral"), (0.1, "warning"), (_LOW, "danger")).alias("tone"),
    )


def distinguishing_features(means: DataFrame, group: str = "cluster", n: int = 5) -> DataFrame:
    """Features by the range of their cluster means, with the clusters at both ends.

    ``means`` is long: (group, feature, mean).
    """
    return (
        means.groupBy("feature").agg(
            (F.max("mean") - F.min("mean")).alias("range"),
            F.max_by(group, F.struct(F.col("mean"), -F.col(group))).alias("highest_cluster"),
            F.min_by(group, F.struct(F.col("mean"), F.col(group))).alias("lowest_cluster"),
        )
        .orderBy(F.desc("range"), "feature").limit(n)
    )


def feature_by_cluster(rows: DataFrame, feature: str, group: str = "cluster") -> DataFrame:
    """Clusters with the highest and lowest median and the widest spread."""
    stats = group_stats(rows, group, feature)
    first = -F.col(group)
    return stats.agg(
        F.max_by(group, F.struct(F.col("median"), first)).alias("highest_cluster"),
        F.max("median").alias("highest_median"),
        F.min_by(group, F.struct(F.col("median"), F.col(group))).alias("lowest_cluster"),
        F.min("median").alias("lowest_median"),
        F.max_by(group, F.when(F.col("std").isNotNull(), F.struct(F.col("std"), first))).alias("most_variable_cluster"),
        F.max("std").alias("highest_std"),
    )


def pair_correlation(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation of two features over complete pairs; one row, null under two."""
    pairs = rows.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).na.drop()
    r = F.col("correlation")
    return (
        pairs.agg(F.count(F.lit(1)).alias("n"), S.safe_corr(F.col("x"), F.col("y")).alias("correlation"))
        .withColumn("correlation", F.when(F.col("n") >= 2, r))
        .withColumn("strength", band(F.abs(r), S.CORRELATION_BANDS))
        .withColumn("direction", F.when(r >= 0, "positive").when(r < 0, "négative"))
        .withColumn("tone", band(F.abs(r), S.CORRELATION_BANDS, "tone"))
    )


def pca_distance(points: DataFrame, flag: str = "is_anomaly") -> DataFrame:
    """Distance between the centres of anomalies and normal rows in the plane."""
    is_a = F.col(flag) == 1
    parts = points.agg(
        F.count_if(is_a).alias("anomaly_count"), F.count_if(~is_a).alias("normal_count"),
        *[F.avg(F.when(c, F.col(p))).alias(f"{n}{p}") for n, c in (("a", is_a), ("n", ~is_a)) for p in ("PC1", "PC2")],
    )
    d = F.sqrt((F.col("aPC1") - F.col("nPC1")) ** 2 + (F.col("aPC2") - F.col("nPC2")) ** 2)
    tone = (
        F.when(F.col("anomaly_count") == 0, "neutral").when(F.col("normal_count") == 0, "warning")
        .when(d >= 2, "success").otherwise("neutral")
    )
    return parts.select("anomaly_count", "normal_count", d.alias("center_distance"), tone.alias("tone"))


def concentration(cross: DataFrame, group: str = "cluster") -> DataFrame:
    """The cluster with the highest anomaly rate against the overall rate."""
    pick = F.struct(F.col("anomaly_ratio_pct"), -F.col(group))
    return (
        cross.agg(F.max_by(group, pick).alias("cluster"), F.max("anomaly_ratio_pct").alias("cluster_pct"),
                  F.max("global_ratio_pct").alias("global_pct"))
        .withColumn("difference", F.col("cluster_pct") - F.col("global_pct"))
        .withColumn("tone", _tone(F.round("difference", 9), (5, "danger"), (2, "warning"), (_LOW, "success")))
    )


def metric_trend(history: DataFrame, metric: str, higher_is_better: bool = True, significant: float = 0.01,
                 when: str = "created_at", tie: str = "run_id") -> DataFrame:
    """First and last value of a metric over the runs and what the change means."""
    valid = history.filter(F.col(metric).isNotNull())
    order = F.struct(F.col(when), F.col(tie))
    base = valid.agg(
        F.count(F.lit(1)).alias("n_runs"), F.min_by(metric, order).cast("double").alias("first_value"),
        F.max_by(metric, order).cast("double").alias("last_value"),
    )
    change = F.col("last_value") - F.col("first_value")
    better = change > 0 if higher_is_better else change < 0
    tone = (
        F.when((F.col("n_runs") < 2) | (F.abs(change) < significant), "neutral").when(better, "success").otherwise("warning")
    )
    return base.select(
        "n_runs", "first_value", "last_value", F.when(F.col("n_runs") >= 2, change).alias("variation"), tone.alias("tone")
    )


def as_findings(name: str, df: DataFrame, *measures: str) -> DataFrame:
    """A finding as rows (finding, metric, value, tone)."""
    doubles = df.select("tone", *[F.col(m).cast("double").alias(m) for m in measures])
    return doubles.unpivot(["tone"], list(measures), "metric", "value").select(
        F.lit(name).alias("finding"), "metric", "value", "tone"
    )


def finding_table(clusters: DataFrame, metrics: DataFrame, anomalies: DataFrame, points: DataFrame,
                  cross: DataFrame) -> DataFrame:
    """The seven standing findings of a run in one table."""
    rate = anomaly_rate(anomalies)
    parts = [
        as_findings("cluster_distribution", cluster_balance(clusters), "largest_pct", "smallest_pct", "gap_pct"),
        as_findings("cluster_separation", separation(metrics), "silhouette", "davies_bouldin"),
        as_findings("anomaly_ratio", rate, "total_rows", "anomaly_count", "anomaly_ratio"),
        as_findings("severity_distribution", severity_spread(anomalies), "critical_count", "high_count", "priority_pct"),
        as_findings("score_distribution", score_spread(anomalies), "mean_score", "median_score", "high_pct", "critical_pct"),
        as_findings("anomaly_plane", pca_distance(points), "anomaly_count", "normal_count", "center_distance"),
        as_findings("cross_analysis", concentration(cross), "cluster_pct", "global_pct", "difference"),
    ]
    return reduce(DataFrame.unionByName, parts)


def _rule(df: DataFrame, condition: Column, rule: str, tone: Column | str, subject: Column | None, value: Column) -> DataFrame:
    shown = F.lit(tone) if isinstance(tone, str) else tone
    return df.filter(condition).select(
        F.lit(rule).alias("rule"), shown.alias("tone"),
        (F.lit(None).cast("string") if subject is None else subject.cast("string")).alias("subject"),
        value.cast("double").alias("value"),
    )


def recommendations(metrics: DataFrame, sizes: DataFrame, rate: DataFrame, severities: DataFrame, cross: DataFrame,
                    fidelity: DataFrame, stability: DataFrame) -> DataFrame:
    """The rules that fired, with what they fired on; one success row if none did.

    Inputs are small summary tables: ``metrics`` (silhouette, high_noise,
    noise_ratio), ``sizes`` (cluster, percentage), ``rate`` (anomaly_ratio),
    ``severities`` (critical_count), a cross table, and fidelity and stability
    with their tones.
    """
    c = F.col
    smallest = sizes.agg(F.min("percentage").alias("percentage"))
    poor = c("tone").isin("warning", "danger")
    parts = [
        _rule(metrics, c("silhouette") < 0.25, "weak_separation", "warning", None, c("silhouette")),
        _rule(metrics, c("high_noise"), "high_noise", "warning", None, c("noise_ratio")),
        _rule(smallest, c("percentage") < 2, "tiny_cluster", "neutral", None, c("percentage")),
        _rule(rate, c("anomaly_ratio") > 10, "many_anomalies", "danger", None, c("anomaly_ratio")),
        _rule(severities, c("critical_count") > 0, "critical_anomalies", "danger", None, c("critical_count")),
        _rule(cross, c("to_watch"), "cluster_to_watch", "warning", c("cluster"), c("anomaly_ratio_pct")),
        _rule(fidelity, poor, "weak_fidelity", c("tone"), None, c("fidelity")),
        _rule(stability, poor, "weak_stability", c("tone"), None, c("mean_ari")),
    ]
    fired = reduce(DataFrame.unionByName, parts)
    none = fired.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(
        F.lit("no_concern").alias("rule"), F.lit("success").alias("tone"),
        F.lit(None).cast("string").alias("subject"), F.lit(None).cast("double").alias("value"),
    )
    return fired.unionByName(none)


def stability_table(spark, scores: list[float]) -> DataFrame:
    """Mean agreement of the re-runs with its band."""
    mean = round(sum(scores) / len(scores), 4) if scores else None
    v = F.col("mean_ari")
    return spark.createDataFrame([(mean, scores)], "mean_ari double, scores array<double>").select(
        "mean_ari", "scores", band(v, S.STABILITY_BANDS).alias("label"), band(v, S.STABILITY_BANDS, "tone").alias("tone")
    )
