"""Column names, casts, row and column cleaning."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.scalars import finite_or_zero, nan_to_null

# Patterns a text date column may follow; the first one wins a tie.
DATE_FORMATS = [
    "yyyy-M-d", "yyyy/M/d", "M/d/yyyy", "d/M/yyyy", "M-d-yyyy", "d-M-yyyy",
    "yyyy-M", "yyyy/M", "yyyy-M-d H:m:s", "yyyy-M-d'T'H:m:s",
]


def normalise_name(text: str | None) -> str:
    """ASCII lower-case identifier with single underscores."""
    if text is None:
        return ""
    ascii_text = unicodedata.normalize("NFKD", str(text).strip().lower()).encode("ascii", "ignore").decode()
    words = re.sub(r"[^a-zA-Z0-9_]", "", re.sub(r"\s+", "_", ascii_text))
    return re.sub(r"_+", "_", words).strip("_")


def standardise_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[normalise_name(c) for c in df.columns])


def rename_columns(df: DataFrame, mapping: Mapping[str, str] | None) -> DataFrame:
    """Rename by normalised names; several old names may share a new one."""
    wanted = {normalise_name(k): normalise_name(v) for k, v in (mapping or {}).items()}
    return df.toDF(*[wanted.get(c, c) for c in df.columns])


def drop_repeated_columns(df: DataFrame) -> DataFrame:
    """Keep the first column of each name."""
    names = df.columns
    if len(set(names)) == len(names):
        return df
    slots = [f"__c{i}" for i in range(len(names))]
    first = {}
    for slot, name in zip(slots, names):
        first.setdefault(name, slot)
    return df.toDF(*slots).select(*[F.col(s).alias(n) for n, s in first.items()])


def choose_date_formats(df: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    """For each text column the pattern that parses most values (one job)."""
    columns = [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)]
    if not columns:
        return {}
    row = df.agg(
        *[
            F.count(F.try_to_timestamp(F.trim(F.col(c)), F.lit(f))).alias(f"h{i}_{j}")
            for i, c in enumerate(columns)
            for j, f in enumerate(DATE_FORMATS)
        ]
    ).first()
    chosen = {}
    for i, c in enumerate(columns):
        hits = [row[f"h{i}_{j}"] for j in range(len(DATE_FORMATS))]
        chosen[c] = DATE_FORMATS[hits.index(max(hits))] if max(hits) else None
    return chosen


def parse_date(df_type: T.DataType, column: Column, fmt: str | None) -> Column:
    if isinstance(df_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return column.cast("timestamp")
    if fmt is None:
        return F.lit(None).cast("timestamp")
    return F.try_to_timestamp(F.trim(column.cast("string")), F.lit(fmt))


def cast_columns(df: DataFrame, types: Mapping[str, str] | None) -> DataFrame:
    """Cast by name; a value that does not fit becomes NULL, never an error."""
    wanted = {normalise_name(k): v.strip().lower() for k, v in (types or {}).items()}
    names = df.columns
    slots = [f"__c{i}" for i in range(len(names))]
    inner = df.toDF(*slots)
    dates = [s for s, n in zip(slots, names) if wanted.get(n) == "datetime"]
    formats = choose_date_formats(inner, dates)
    out = []
    for slot, name in zip(slots, names):
        c, kind, source = F.col(slot), wanted.get(name), inner.schema[slot].dataType
        if kind in ("str", "category"):
            c = c.cast("string")
        elif kind == "int":
            # Through double, so that text such as "12.0" is accepted.
            c = c.cast("bigint") if isinstance(source, T.IntegralType) else c.try_cast("double").try_cast("bigint")
        elif kind in ("float", "numeric"):
            c = nan_to_null(c.try_cast("double"))
        elif kind == "datetime":
            c = parse_date(source, c, formats.get(slot))
        out.append(c.alias(slot))
    return inner.select(*out).toDF(*names)


def standardise_source(
    df: DataFrame,
    mapping: Mapping[str, str] | None = None,
    types: Mapping[str, str] | None = None,
) -> DataFrame:
    """Names, renames, casts, then the first of each repeated column."""
    return (
        df.transform(standardise_names)
        .transform(rename_columns, mapping)
        .transform(cast_columns, types)
        .transform(drop_repeated_columns)
    )


def nans_to_null(df: DataFrame) -> DataFrame:
    """NaN and NULL both mean missing; keep only NULL."""
    floats = (T.DoubleType, T.FloatType)
    return df.select(
        *[
            nan_to_null(F.col(f.name)).alias(f.name) if isinstance(f.dataType, floats) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.na.drop("all")


def drop_empty_columns(df: DataFrame) -> DataFrame:
    row = df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(df.columns)]).first()
    return df.select(*[c for i, c in enumerate(df.columns) if row[f"n{i}"] > 0])


def clean(df: DataFrame) -> DataFrame:
    """Drop empty rows, empty columns and repeated rows."""
    return drop_empty_columns(drop_empty_rows(nans_to_null(plain_numbers(df)))).dropDuplicates()


def plain_numbers(df: DataFrame) -> DataFrame:
    """Decimals as doubles, short and byte integers as int, so that every step sees the same few number types."""
    kinds = {T.DecimalType: "double", T.ShortType: "int", T.ByteType: "int"}
    return df.select(*[F.col(f.name).cast(kinds[type(f.dataType)]).alias(f.name) if type(f.dataType) in kinds else F.col(f.name)
                       for f in df.schema.fields])


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Integer, float and decimal columns of any width; booleans are no numbers."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def numeric_matrix(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Numeric columns only, infinite and missing values as 0, plus ``keep``."""
    numeric = numeric_columns(df, exclude=keep)
    if not numeric:
        raise ValueError("no numeric column")
    return df.select(*keep, *[finite_or_zero(F.col(c)).alias(c) for c in numeric])


def align_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Exactly ``names`` in that order; missing ones are 0."""
    return df.select(*[F.col(n) if n in df.columns else F.lit(0.0).alias(n) for n in names])


def expand_array(df: DataFrame, column: str, prefix: str, size: int) -> DataFrame:
    """One double column per position of a fixed-size array column."""
    kept = [c for c in df.columns if c != column]
    return df.select(
        *kept, *[F.get(F.col(column), i).cast("double").alias(f"{prefix}{i}") for i in range(size)]
    )
