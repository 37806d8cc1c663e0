"""CSV, SQL, JDBC and Parquet sources with the checks every source gets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from pathlib import PurePath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.text import CSV_NULL_WORDS
from tabwright.operators.columns import nans_to_null
from tabwright.sources.split_csv import lines_of, looked_over, plain_encoding, read_records


class SourceError(ValueError):
    """A source is missing, empty or badly described."""


def check_table(df: DataFrame | None, name: str) -> DataFrame:
    if not isinstance(df, DataFrame):
        raise SourceError(f"{name}: not a table")
    if df.limit(1).isEmpty():
        raise SourceError(f"{name}: no rows")
    return df


def check_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    if not found:
        raise SourceError(f"not found: {path}")


def source_name(path: str) -> str:
    """Table name for a file: no extension, spaces as underscores, lower case."""
    name = PurePath(path).name
    return (name[:-4] if name.lower().endswith(".csv") else name).replace(" ", "_").lower()


def read_csv(spark: SparkSession, path: str, sep: str = ",", encoding: str = "utf-8") -> DataFrame:
    """CSV with a header; missing-value words become NULL before types are inferred.

    Bytes that are not valid UTF-8 make the file Latin-1. Files stay splittable, with line breaks in quoted values too
    (``split_csv``); only encodings in which those are not single bytes need whole files for that.
    """
    check_path(spark, path)
    plain = plain_encoding(encoding)
    if plain is None:
        raw = _reader(spark, sep, encoding).option("multiLine", True).csv(path)
    else:
        breaks, valid = looked_over(lines_of(spark, path))
        used = "ISO-8859-1" if plain == "UTF-8" and not valid else plain
        raw = read_records(spark, path, sep, used) if breaks else _reader(spark, sep, used).csv(path)
    return check_table(infer_types(nulls_by_word(raw)), path)


def _reader(spark: SparkSession, sep: str, encoding: str):
    return spark.read.option("header", True).option("sep", sep).option("encoding", encoding).option("quote", '"').option("escape", '"')


def nulls_by_word(df: DataFrame) -> DataFrame:
    return df.select(
        *[F.when(F.col(c).isin(CSV_NULL_WORDS), F.lit(None)).otherwise(F.col(c)).alias(c) for c in df.columns]
    )


def infer_types(df: DataFrame) -> DataFrame:
    """Whole-column inference over text: integer, float or boolean, else text."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(df.columns):
        x = F.trim(F.col(c))
        aggs += [
            F.count(c).alias(f"v{i}"),
            F.count_if(x.rlike(r"^[+-]?\d{1,19}$") & x.try_cast("bigint").isNotNull()).alias(f"i{i}"),
            F.count(x.try_cast("double")).alias(f"d{i}"),
            F.count_if(x.isin("True", "False", "true", "false", "TRUE", "FALSE")).alias(f"b{i}"),
        ]
    row = df.agg(*aggs).first()
    out = []
    for i, c in enumerate(df.columns):
        values, x = row[f"v{i}"], F.trim(F.col(c))
        if values and row[f"i{i}"] == values:
            out.append(x.cast("bigint").alias(c))
        elif values and row[f"d{i}"] == values:
            out.append(x.cast("double").alias(c))
        elif values and row[f"b{i}"] == values:
            out.append(x.cast("boolean").alias(c))
        else:
            out.append(F.col(c))
    return nans_to_null(df.select(*out))


def read_sql(spark: SparkSession, query: str, views: Mapping[str, str] | None = None) -> DataFrame:
    """Result of a Spark SQL query, after registering Parquet tables as views."""
    if not query or not query.strip():
        raise SourceError("empty query")
    for name, path in (views or {}).items():
        spark.read.parquet(path).createOrReplaceTempView(name)
    return check_table(spark.sql(query), "query")


def read_jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """Result of a query run by a database; its JDBC driver must be on the class path."""
    if not query or not query.strip():
        raise SourceError("empty query")
    return check_table(spark.read.format("jdbc").options(url=url, query=query, **options).load(), url)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    check_path(spark, path)
    return nans_to_null(spark.read.parquet(path))


def read_source(spark: SparkSession, kind: str, path: str | None = None, query: str | None = None,
                sep: str = ",", encoding: str = "utf-8", views: Mapping[str, str] | None = None) -> DataFrame:
    """Read by kind: csv, sql or parquet, in any case and with spaces around.

    For ``sql`` the path is a JDBC address, or a folder of Parquet tables that
    the query may name.
    """
    kind = (kind or "").strip().lower()
    if kind == "csv":
        return read_csv(spark, path, sep, encoding)
    if kind == "parquet":
        return read_parquet(spark, path)
    if kind == "sql":
        if not query:
            raise SourceError("a sql source needs a query")
        if path and path.startswith("jdbc:"):
            return read_jdbc(spark, path, query)
        return read_sql(spark, query, views if views is not None else tables_in(spark, path))
    raise SourceError(f"unknown source type: {kind}")


def tables_in(spark: SparkSession, folder: str | None) -> dict[str, str]:
    """Parquet tables of a folder by name."""
    if not folder:
        return {}
    target = spark._jvm.org.apache.hadoop.fs.Path(folder.rstrip("/") + "/*.parquet")
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target) or []
    return {f.getPath().getName()[: -len(".parquet")]: f.getPath().toString() for f in found}


def read_sources(spark: SparkSession, descriptors: Sequence[Mapping]) -> dict[str, DataFrame]:
    """Tables by name in the given order; an error names its source."""
    if not descriptors:
        raise SourceError("no source given")
    out: dict[str, DataFrame] = {}
    for d in descriptors:
        missing = [k for k in ("name", "type", "path") if not d.get(k)]
        if missing:
            raise SourceError(f"source {d.get('name', '?')}: missing {', '.join(missing)}")
        try:
            out[d["name"]] = read_source(
                spark, d["type"], d["path"], d.get("query"), d.get("sep", ","), d.get("encoding", "utf-8")
            )
        except Exception as e:
            raise SourceError(f"source {d['name']}: {e}") from e
    return out


def schema_of(df: DataFrame) -> DataFrame:
    """(position, column, type) of a table."""
    fields: list[T.StructField] = df.schema.fields
    return df.sparkSession.createDataFrame(
        [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(fields)], "position int, column string, type string"
    )
