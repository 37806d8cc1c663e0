"""Sorts, limits and row numbers that never put a whole table in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tabwright.session import materialise

_SLOT, _PART, _POS, _SALT = "__slot", "__part", "__pos", "__salt"


def top_n(df: DataFrame, n: int, by: str, ties: Sequence[str] | None = None) -> DataFrame:
    """First ``n`` rows by ``by`` descending; ties are broken by the other columns."""
    ties = [c for c in (ties if ties is not None else df.columns) if c != by]
    return df.orderBy(F.col(by).desc_nulls_last(), *[F.col(c) for c in ties]).limit(n)


def number_rows(
    df: DataFrame,
    order: Sequence[Column | str],
    into: str,
    groups: Sequence[str] = (),
    start: int = 1,
    repeated_rows: bool = False,
) -> DataFrame:
    """Exact row numbers by ``order`` (restarting per ``groups``).

    A window without partitions would sort everything in one task, and a window
    per group would do the same to a hot group. Here the rows are range-sorted
    across partitions and written once; each row then gets its position in its
    partition, and the per-partition counts (one row per partition and group)
    supply the offsets. With ``repeated_rows`` equal rows carry a stored salt,
    so that a row repeated many times does not fill one partition.
    """
    groups = list(groups)
    columns = df.columns
    keys = [*map(F.col, groups), *[F.col(c) if isinstance(c, str) else c for c in order]]
    if repeated_rows:
        df = materialise(df.withColumn(_SALT, F.monotonically_increasing_id()), "salted")
        keys += [F.xxhash64(*columns), F.col(_SALT)]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = materialise(
        df.repartitionByRange(parts, *keys)
        .sortWithinPartitions(*keys)
        .withColumn(_SLOT, F.monotonically_increasing_id())
        .select(
            *columns,
            F.shiftright(_SLOT, 33).alias(_PART),
            F.col(_SLOT).bitwiseAND((1 << 33) - 1).alias(_POS),
        ),
        "numbered",
    )
    counts = table.groupBy(*groups, _PART).agg(F.count(F.lit(1)).alias("__n"), F.min(_POS).alias("__first"))
    offsets = _offsets(counts, groups, "__n")
    number = F.col("__before") + F.col(_POS) - F.col("__first") + F.lit(start)
    return table.join(offsets, _same(groups) & (F.col("__p") == F.col(_PART))).select(
        *columns, number.cast("long").alias(into)
    )


def rank_values(df: DataFrame, order: str, into: str, groups: Sequence[str] = (), window_rows: int = 100_000) -> DataFrame:
    """Number distinct values from 0: a window when they are counted to be few, else range sort."""
    if df.count() > window_rows:
        return number_rows(df, [order], into, groups=groups, start=0)
    within = W.partitionBy(F.lit(0), *groups).orderBy(order)
    return df.withColumn(into, (F.row_number().over(within) - 1).cast("long"))


def running_total(df: DataFrame, order: Sequence[str], weight: str, into: str, groups: Sequence[str]) -> DataFrame:
    """Sum of ``weight`` over the rows before each row of its group, by ``order``.

    The (group, order) keys must be distinct; counts of equal rows belong in
    ``weight``. Work is spread as in :func:`number_rows`.
    """
    groups = list(groups)
    keys = [*groups, *order]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = materialise(
        df.repartitionByRange(parts, *keys).withColumn(_PART, F.spark_partition_id().cast("long")), "ranged"
    )
    counts = table.groupBy(*groups, _PART).agg(F.sum(weight).alias("__n"))
    inside = W.partitionBy(*groups, _PART).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = table.withColumn(_POS, F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return local.join(_offsets(counts, groups, "__n"), _same(groups) & (F.col("__p") == F.col(_PART))).select(
        *df.columns, (F.col("__before") + F.col(_POS)).alias(into)
    )


def _offsets(counts: DataFrame, groups: list[str], weight: str) -> DataFrame:
    """Running sums over partitions; a group has at most one row per partition."""
    earlier = W.partitionBy(F.lit(0), *groups).orderBy(_PART).rowsBetween(W.unboundedPreceding, -1)
    extra = ["__first"] if "__first" in counts.columns else []
    return counts.select(
        *[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)],
        F.col(_PART).alias("__p"),
        *extra,
        F.coalesce(F.sum(weight).over(earlier), F.lit(0)).alias("__before"),
    )


def _same(groups: list[str]) -> Column:
    out = F.lit(True)
    for i, g in enumerate(groups):
        out = out & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    return out
