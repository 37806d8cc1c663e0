"""Whole-table and grouped summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.functions.scalars import percent
from tabwright.operators.quantiles import grouped_quantiles


def _long(df: DataFrame, columns: Sequence[str], value) -> DataFrame:
    """One row per column from a one-row aggregate, in a single scan."""
    row = df.agg(
        F.count(F.lit(1)).alias("n_rows"), *[value(F.col(c)).alias(f"v{i}") for i, c in enumerate(columns)]
    )
    entries = F.array(
        *[F.struct(F.lit(i).alias("column_index"), F.lit(c).alias("column"), F.col(f"v{i}").alias("value"))
          for i, c in enumerate(columns)]
    )
    return row.select("n_rows", F.inline(entries))


def null_counts(df: DataFrame) -> DataFrame:
    """(column_index, column, n_rows, null_count) for every column."""
    return _long(df, df.columns, lambda c: F.count(F.when(c.isNull(), 1))).select(
        "column_index", "column", "n_rows", F.col("value").alias("null_count")
    )


def missing_report(df: DataFrame) -> DataFrame:
    """Columns with nulls, their count and percentage, worst first."""
    return (
        null_counts(df)
        .filter("null_count > 0")
        .select(
            "column",
            F.col("null_count").alias("missing_count"),
            percent(F.col("null_count"), F.col("n_rows")).alias("missing_percentage"),
        )
        .orderBy(F.desc("missing_percentage"), "column")
    )


def missing_summary(df: DataFrame) -> DataFrame:
    return missing_report(df).agg(
        F.count(F.lit(1)).alias("columns_with_missing"),
        F.coalesce(F.max("missing_percentage"), F.lit(0.0)).alias("max_missing_percentage"),
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Number of rows that repeat an earlier row.

    Rows meet by a 128-bit digest, so long texts are not shuffled; the NULL flags
    in it keep (NULL, x) and (x, NULL) apart.
    """
    gone = [F.col(f"`{c}`").isNull() for c in df.columns]
    values = [F.col(f"`{c}`") for c in df.columns]
    digest = [F.xxhash64(F.lit(seed), *gone, *values).alias(f"__d{seed}") for seed in (1, 2)]
    groups = df.select(*digest).groupBy("__d1", "__d2").agg(F.count(F.lit(1)).alias("__n"))
    return groups.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_rows"))


def dataset_info(df: DataFrame, name: str = "dataset") -> DataFrame:
    """One row: size, names, nulls and repeated rows."""
    totals = null_counts(df).agg(
        F.max("n_rows").alias("n_rows"), F.sum("null_count").alias("missing_values")
    )
    return totals.crossJoin(duplicate_rows(df)).select(
        F.lit(name).alias("source"),
        "n_rows",
        F.lit(len(df.columns)).cast("long").alias("n_columns"),
        F.array(*map(F.lit, df.columns)).alias("columns"),
        "missing_values",
        "duplicate_rows",
    )


def datasets_info(frames: Mapping[str, DataFrame]) -> DataFrame:
    parts = [dataset_info(df, name) for name, df in frames.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def integration_report(df: DataFrame) -> DataFrame:
    """Per-column nulls with table size and repeated rows alongside."""
    return null_counts(df).crossJoin(duplicate_rows(df)).withColumn(
        "n_columns", F.lit(len(df.columns)).cast("long")
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact non-null distinct values of several columns.

    Unpivoting first keeps one partial aggregate per (column, value) instead of
    one expanded copy of the row per distinct aggregate.
    """
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], list(columns), "column", "value"
    )
    return (
        long.filter(F.col("value").isNotNull())
        .groupBy("column", "value").agg(F.lit(1).alias("one"))
        .groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))
    )


def group_means(df: DataFrame, group: str, features: Sequence[str]) -> DataFrame:
    return df.groupBy(group).agg(*[F.avg(f).alias(f) for f in features])


def long_group_means(df: DataFrame, group: str, features: Sequence[str]) -> DataFrame:
    """(group, size, feature, mean): one row per group and feature."""
    wide = df.groupBy(group).agg(F.count(F.lit(1)).alias("size"), *[F.avg(f).alias(f) for f in features])
    return wide.unpivot([group, "size"], list(features), "feature", "mean")


def group_stats(df: DataFrame, group: str, feature: str) -> DataFrame:
    """Median, mean, spread, range and count of a feature per group; rows without a group are left out."""
    df, x = df.filter(F.col(group).isNotNull()), F.col(feature)
    basic = df.groupBy(group).agg(
        F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("minimum"),
        F.max(x).alias("maximum"), F.count(x).alias("count"),
    )
    return basic.join(grouped_quantiles(df, [group], feature, [0.5], ["median"]), group, "left")


def five_numbers(df: DataFrame, group: str, feature: str) -> DataFrame:
    names = ["minimum", "q1", "median", "q3", "maximum"]
    return grouped_quantiles(df, [group], feature, [0.0, 0.25, 0.5, 0.75, 1.0], names)


def histogram(df: DataFrame, value: str, by: str, bins: int = 50) -> DataFrame:
    """Counts in equal-width bins over the column's range; the top edge is closed."""
    bounds = df.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    width = F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0)) / bins
    raw = F.coalesce(F.floor((F.col(value) - F.col("__lo")) / width), F.lit(0))
    return (
        df.select(value, by).filter(F.col(value).isNotNull())
        .crossJoin(F.broadcast(bounds))  # one row
        .withColumn("bin", F.least(raw, F.lit(bins - 1)).cast("long"))
        .groupBy("bin", by).agg(F.count(F.lit(1)).alias("n"))
    )


def between_group_variance(means: DataFrame, n: int | None = None) -> DataFrame:
    """Features by the variance of their group means, largest first."""
    out = means.groupBy("feature").agg(F.var_samp("mean").alias("variance"))
    out = out.orderBy(F.desc_nulls_last("variance"), "feature")
    return out.limit(n) if n else out


def weighted_means(profile: DataFrame) -> DataFrame:
    """Size-weighted mean per feature over sparse profile rows.

    A null mean adds nothing to the sum while its group still counts in the
    total size; ``true_mean`` leaves such groups out of both.
    """
    total = profile.select("cluster", "size").distinct().agg(F.sum("size").alias("__all"))
    sums = profile.groupBy("feature").agg(
        F.sum(F.col("mean") * F.col("size")).alias("__s"),
        F.sum(F.when(F.col("mean").isNotNull(), F.col("size"))).alias("__w"),
    )
    return sums.crossJoin(F.broadcast(total)).select(  # one row
        "feature",
        (F.col("__s") / F.col("__all")).alias("weighted_mean"),
        (F.col("__s") / F.col("__w")).alias("true_mean"),
    )


def count_items(df: DataFrame, column: str, into: str) -> DataFrame:
    """Frequency of the elements of an array column, most frequent first."""
    return (
        df.select(F.explode(column).alias(into)).groupBy(into).agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), into)
    )


def mean_importance(df: DataFrame, n: int = 15) -> DataFrame:
    return (
        df.groupBy("feature").agg(F.avg("importance").alias("importance"))
        .orderBy(F.desc("importance"), "feature").limit(n)
    )


def cross_table(df: DataFrame, group: str = "cluster", flag: str = "is_anomaly") -> DataFrame:
    """Anomaly rate per group against the whole, with groups to watch."""
    per = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("size"), F.sum(F.col(flag).cast("long")).alias("anomaly_count")
    )
    whole = per.agg(F.sum("anomaly_count").alias("__a"), F.sum("size").alias("__n"))
    rate, overall = F.col("anomaly_ratio_pct"), F.col("global_ratio_pct")
    return (
        per.crossJoin(F.broadcast(whole))  # one row
        .select(
            group, "size", "anomaly_count",
            percent(F.col("anomaly_count"), F.col("size")).alias("anomaly_ratio_pct"),
            percent(F.col("__a"), F.col("__n")).alias("global_ratio_pct"),
        )
        .withColumn("gap_pct", F.round(rate - overall, 2))
        .withColumn("to_watch", rate > overall * 1.5 + 1)
        .orderBy(F.desc("anomaly_ratio_pct"), group)
    )
