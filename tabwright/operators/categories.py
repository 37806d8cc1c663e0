"""Standardising near-equal category spellings and label encoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.functions.similarity import best_references
from tabwright.functions.text import normalise_value
from tabwright.operators.ranking import rank_values


def category_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n) of the normalised values of several text columns."""
    return value_counts(df.select(*[normalise_value(c).alias(c) for c in columns]), columns)


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n) of the values of several text columns as they are."""
    return df.unpivot([], list(columns), "column", "value").groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("n")
    )


def reference_values(counts: DataFrame, min_frequency: int = 3) -> DataFrame:
    return counts.filter(F.col("n") >= min_frequency)


def corrections(counts: DataFrame, references: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Values that are not references but close enough to one."""
    others = counts.join(references.select("column", "value"), ["column", "value"], "left_anti")
    return best_references(others, references, threshold)


def standardise(counts: DataFrame, fixes: DataFrame) -> DataFrame:
    """(column, value, corrected) for every known value."""
    return counts.select("column", "value").join(
        fixes.select("column", "value", "corrected"), ["column", "value"], "left"
    ).withColumn("corrected", F.coalesce("corrected", "value"))


def encode(mapping: DataFrame) -> DataFrame:
    """Add ``code``: the rank of the corrected value among its column's classes."""
    classes = mapping.select("column", "corrected").distinct()
    coded = rank_values(classes, "corrected", "code", groups=["column"])
    return mapping.join(coded, ["column", "corrected"]).select("column", "value", "corrected", "code")
