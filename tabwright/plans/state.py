"""Fitted preparation state: a JSON record and one Parquet table of categories."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class PrepState:
    excluded: list[str] = field(default_factory=list)
    reintegrated: list[str] = field(default_factory=list)
    label: str | None = None
    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    date_formats: dict[str, str | None] = field(default_factory=dict)
    dropped_sparse: list[str] = field(default_factory=list)
    medians: dict[str, float] = field(default_factory=dict)
    indicators: list[str] = field(default_factory=list)
    skew: dict[str, dict] = field(default_factory=dict)
    bounds: dict[str, dict] = field(default_factory=dict)
    class_counts: dict[str, int] = field(default_factory=dict)
    value_counts: dict[str, int] = field(default_factory=dict)
    unknown_codes: dict[str, int] = field(default_factory=dict)
    scaler: str = "StandardScaler"
    centers: dict[str, float] = field(default_factory=dict)
    scales: dict[str, float] = field(default_factory=dict)
    scaled: list[str] = field(default_factory=list)
    low_variance: list[str] = field(default_factory=list)
    correlated: list[str] = field(default_factory=list)
    final_features: list[str] = field(default_factory=list)
    options: dict[str, float] = field(default_factory=dict)
    categories_path: str | None = None
    references_path: str | None = None

    def categories(self, spark: SparkSession) -> DataFrame:
        """(column, value, corrected, code) of every value seen when fitting."""
        return spark.read.schema("column string, value string, corrected string, code long").parquet(
            self.categories_path
        )

    def references(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("column string, value string, n long").parquet(self.references_path)

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the record and its tables under ``path``."""
        record = PrepState(**asdict(self))
        if self.categories_path:
            record.categories_path = f"{path}/categories"
            record.references_path = f"{path}/references"
            self.categories(spark).write.mode("overwrite").parquet(record.categories_path)
            self.references(spark).write.mode("overwrite").parquet(record.references_path)
        text = json.dumps(asdict(record))
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/record")

    @staticmethod
    def load(spark: SparkSession, path: str) -> PrepState:
        return PrepState(**json.loads(spark.read.text(f"{path}/record", wholetext=True).first()[0]))
