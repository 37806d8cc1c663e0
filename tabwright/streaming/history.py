"""Run history as Parquet tables: upsert by run, append details, read newest first."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "pipeline_runs": (
        "run_id string, created_at timestamp, ended_at timestamp, duration_seconds double, status string, "
        "input_rows long, input_columns long, output_rows long, output_columns long, label_column string, "
        "scaler_used string, artifacts_path string, reports_path string"
    ),
    "excluded_features": "run_id string, column_name string, reason string, created_at timestamp",
    "reintegrated_features": "run_id string, column_name string, created_at timestamp",
    "final_features": "run_id string, feature_name string, created_at timestamp",
    "technical_reports": "run_id string, report_type string, report_json string, created_at timestamp",
    "ml_runs": (
        "run_id string, created_at timestamp, ended_at timestamp, duration_seconds double, status string, "
        "input_rows long, input_columns long, enable_clustering boolean, enable_anomaly_detection boolean, "
        "models_dir string, reports_dir string"
    ),
    "cluster_history": (
        "run_id string, n_clusters int, algorithm_used string, is_large_dataset boolean, silhouette_score double, "
        "davies_bouldin_score double, metrics_sample_size long, created_at timestamp"
    ),
    "cluster_profiles_history": (
        "run_id string, cluster_id int, size long, percentage double, dominant_features array<string>, "
        "created_at timestamp"
    ),
    "anomaly_history": (
        "run_id string, total_rows long, anomaly_count long, anomaly_ratio double, avg_anomaly_score double, "
        "max_anomaly_score double, severity_counts map<string,long>, created_at timestamp"
    ),
}
FEATURE_TABLES = ("excluded_features", "reintegrated_features", "final_features")
_KEYED = ("pipeline_runs", "ml_runs")


class History:
    """The nine history tables under one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    def _conform(self, table: str, rows: DataFrame) -> DataFrame:
        fields = self.spark.createDataFrame([], SCHEMAS[table]).schema.fields
        return rows.select(
            *[
                (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in fields
            ]
        )

    def upsert(self, table: str, rows: DataFrame) -> None:
        """Replace the runs present in ``rows``, leave all other runs alone."""
        self._conform(table, rows).write.mode("overwrite").partitionBy("run_id").option(
            "partitionOverwriteMode", "dynamic"
        ).parquet(f"{self.path}/{table}")

    def append(self, table: str, rows: DataFrame) -> None:
        self._conform(table, rows).write.mode("append").partitionBy("run_id").parquet(f"{self.path}/{table}")

    def save(self, tables: Mapping[str, DataFrame]) -> None:
        """Run tables are upserted, detail tables appended."""
        for name, rows in tables.items():
            (self.upsert if name in _KEYED else self.append)(name, rows)

    def read(self, table: str) -> DataFrame:
        """A history table, newest first."""
        if table not in SCHEMAS:
            raise ValueError(f"unknown history table: {table}")
        schema = self.spark.createDataFrame([], SCHEMAS[table]).schema
        return self.spark.read.schema(schema).parquet(f"{self.path}/{table}").select(*schema.names).orderBy(
            F.desc("created_at"), "run_id"
        )

    def features(self, table: str, run_id: str | None = None) -> DataFrame:
        if table not in FEATURE_TABLES:
            raise ValueError(f"not a feature table: {table}")
        rows = self.read(table)
        return rows.filter(F.col("run_id") == run_id) if run_id else rows

    def kpis(self, table: str = "pipeline_runs") -> DataFrame:
        """Number of runs and the last one with its status."""
        last = F.struct("created_at", "run_id")
        return self.read(table).agg(
            F.count(F.lit(1)).alias("n_runs"), F.max_by("run_id", last).alias("last_run"),
            F.max_by("status", last).alias("last_status"), F.max("created_at").alias("last_created_at"),
        )


def preparation_tables(spark: SparkSession, run_id: str, started: datetime, ended: datetime, prepared, structure,
                       status: str = "success") -> dict[str, DataFrame]:
    """Rows of the preparation history for one finished run."""
    state = prepared.state
    shape = prepared.reports["shape"][0]
    run = [(run_id, started, ended, (ended - started).total_seconds(), status, structure.n_rows, len(structure.columns),
            shape["final_rows"], shape["final_columns"], state.label, state.scaler, state.categories_path, None)]
    reasons = {p["column"]: p["exclusion_reason"] for p in structure.profile}
    reports = [(run_id, k, json.dumps(v, default=str), ended) for k, v in prepared.reports.items()]
    make = lambda name, rows: spark.createDataFrame(rows, SCHEMAS[name])
    return {
        "pipeline_runs": make("pipeline_runs", run),
        "excluded_features": make("excluded_features", [(run_id, c, reasons.get(c), ended) for c in state.excluded]),
        "reintegrated_features": make("reintegrated_features", [(run_id, c, ended) for c in state.reintegrated]),
        "final_features": make("final_features", [(run_id, c, ended) for c in state.final_features]),
        "technical_reports": make("technical_reports", reports),
    }


def model_tables(spark: SparkSession, run_id: str, started: datetime, ended: datetime, clustering, anomalies,
                 n_rows: int, columns: Sequence[str], status: str = "success") -> dict[str, DataFrame]:
    """Rows of the model history for one finished run."""
    run = [(run_id, started, ended, (ended - started).total_seconds(), status, n_rows, len(columns),
            clustering is not None, anomalies is not None, None, None)]
    out = {"ml_runs": spark.createDataFrame(run, SCHEMAS["ml_runs"])}
    stamp = [F.lit(run_id).alias("run_id"), F.lit(ended).alias("created_at")]
    if clustering is not None:
        row = [(run_id, clustering.k, clustering.algorithm, clustering.is_large, clustering.silhouette,
                clustering.davies_bouldin, clustering.metrics_rows, ended)]
        out["cluster_history"] = spark.createDataFrame(row, SCHEMAS["cluster_history"])
        from tabwright.operators.clustering import dominant_features

        out["cluster_profiles_history"] = dominant_features(clustering.profile).withColumnRenamed(
            "cluster", "cluster_id"
        ).select("*", *stamp)
    if anomalies is not None:
        out["anomaly_history"] = anomalies.summary.select("*", *stamp)
    return out
