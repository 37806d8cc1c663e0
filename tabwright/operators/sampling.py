"""Exact seeded samples and splits: the rows with the smallest tickets, found by counting, then a plain filter."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tabwright.operators.ranking import number_rows
from tabwright.session import materialise

_TICKET, _CUT, _LEFT, _COPIES = "__ticket", "__cut", "__left", "__copies"
#: Bits of the ticket settled per count of the rows; the last bits are settled on the few rows left.
_BITS = 16
#: Up to so many groups their cuts are sent to the rows; beyond, the join is left to Spark.
_FEW_GROUPS = 10_000


def row_hash(columns: Sequence[str], seed: int) -> Column:
    """Hash of a row's values and their positions, NULLs too, in 63 bits."""
    parts = [p for i, c in enumerate(columns) for p in (F.lit(i), F.col(c).isNull(), F.col(c))]
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 1)


def _same(groups: Sequence[str]) -> Column:
    out = F.lit(True)
    for i, g in enumerate(groups):
        out = out & F.col(g).eqNullSafe(F.col(f"__of{i}"))
    return out


def _joined(rows: DataFrame, cuts: DataFrame, groups: Sequence[str], how: str) -> DataFrame:
    if not groups:
        return rows.join(F.broadcast(cuts), how=how) if how == "left" else rows.crossJoin(F.broadcast(cuts))  # one row
    named = cuts.select(*[F.col(g).alias(f"__of{i}") for i, g in enumerate(groups)], *[c for c in cuts.columns if c not in groups])
    if cuts.count() <= _FEW_GROUPS:
        named = F.broadcast(named)
    return rows.join(named, _same(groups), how).drop(*[f"__of{i}" for i in range(len(groups))])


def ticket_cuts(rows: DataFrame, wanted: Callable[[Column], Column], groups: Sequence[str] = (), ticket: str = _TICKET) -> DataFrame:
    """Per group the ticket at which the ``wanted(group size)`` smallest end.

    Columns: the groups, __cut (the last ticket taken), __left (how many rows with that ticket are taken) and __copies
    (how many there are). Groups of which nothing is wanted have no row. ``rows`` should be stored, as its tickets
    (63 bits, nearly even) are counted three times: by their first bits, by the next bits of those at the border, then one by one.
    """
    groups, ticket_of = list(groups), F.col(ticket)
    per = W.partitionBy(*groups) if groups else W.partitionBy(F.lit(0))

    def border(counted: DataFrame, need: Column, by: str) -> DataFrame:
        """The value of ``by`` in which the wanted count is reached, and how many are wanted of it."""
        upto = F.sum("__n").over(per.orderBy(by).rowsBetween(W.unboundedPreceding, W.currentRow))
        before = counted.withColumn(_LEFT, need - (upto - F.col("__n")))
        return before.filter((F.col(_LEFT) > 0) & (F.col(_LEFT) <= F.col("__n")))

    def counts(part: DataFrame, by: Column, *more: str) -> DataFrame:
        return part.groupBy(*groups, *more, by.alias("__b")).agg(F.count(F.lit(1)).alias("__n"))

    first = F.shiftrightunsigned(ticket_of, 63 - _BITS)
    second = F.shiftrightunsigned(ticket_of, 63 - 2 * _BITS).bitwiseAND((1 << _BITS) - 1)
    sized = counts(rows, first).withColumn("__need", wanted(F.sum("__n").over(per)).cast("long"))
    one = materialise(border(sized, F.col("__need"), "__b").select(*groups, F.col("__b").alias("__b1"), F.col(_LEFT).alias("__need")), "cuts")
    near = _joined(rows, one, groups, "inner").filter(first == F.col("__b1"))
    two = materialise(
        border(counts(near, second, "__b1", "__need"), F.col("__need"), "__b").select(*groups, "__b1", F.col("__b").alias("__b2"), F.col(_LEFT).alias("__need")), "cuts"
    )
    last = _joined(rows, two, groups, "inner").filter((first == F.col("__b1")) & (second == F.col("__b2")))
    exact = border(counts(last, ticket_of, "__need"), F.col("__need"), "__b")
    return materialise(exact.select(*groups, F.col("__b").alias(_CUT), _LEFT, F.col("__n").alias(_COPIES)), "cuts")


def mark_smallest(rows: DataFrame, wanted: Callable[[Column], Column], into: str, groups: Sequence[str] = (), ticket: str = _TICKET) -> DataFrame:
    """Add ``into``: whether a row is among the ``wanted(group size)`` rows of smallest ticket of its group, exactly that many.

    Rows of one ticket are taken from the first on where not all of them are wanted.
    """
    cuts = ticket_cuts(rows, wanted, groups, ticket)
    met = _joined(rows, cuts, groups, "left")
    marked = met.withColumn(into, F.coalesce(F.col(ticket) <= F.col(_CUT), F.lit(False)))
    if cuts.filter(F.col(_COPIES) > F.col(_LEFT)).isEmpty():
        return marked.select(*rows.columns, into)
    torn = F.coalesce((F.col(ticket) == F.col(_CUT)) & (F.col(_COPIES) > F.col(_LEFT)), F.lit(False))
    numbered = number_rows(met.filter(torn), [ticket], "__number", groups=groups, repeated_rows=True)
    return marked.filter(~torn).select(*rows.columns, into).unionByName(
        numbered.withColumn(into, F.col("__number") <= F.col(_LEFT)).select(*rows.columns, into)
    )


def sample_rows(df: DataFrame, n: int, seed: int = 42, n_rows: int | None = None, key: Sequence[str] = ()) -> DataFrame:
    """Exactly ``n`` rows at random, or all rows when there are no more than that; the same ones in every plan.

    A row's ticket is the hash of its ``key`` columns, all columns by default; equal rows without a key that tells them apart are
    drawn together, as far as ``n`` allows.
    """
    total = df.count() if n_rows is None else n_rows
    if total <= n:
        return df
    rows = df.withColumn(_TICKET, row_hash(key or df.columns, seed))
    return mark_smallest(rows, lambda size: F.lit(n), "__taken", ticket=_TICKET).filter("__taken").select(*df.columns)


def stratified_split(df: DataFrame, label: str, test_share: float, seed: int = 42, by: Sequence[str] = ()) -> DataFrame:
    """Add ``is_test``: exactly round(share * size) rows of each class, those of smallest hash (of the row or its columns ``by``); NULLs are a class.

    Equal rows stay together but for one row value per class, which is cut where the number demands it.
    """
    rows = df.withColumn(_TICKET, row_hash(by or df.columns, seed))
    return mark_smallest(rows, lambda size: F.round(size * F.lit(test_share)), "is_test", [label]).select(*df.columns, "is_test")


def stratified_folds(df: DataFrame, label: str, folds: int, seed: int = 42, by: Sequence[str] = ()) -> DataFrame:
    """Add ``fold``, drawn by a hash of the row (or of its columns ``by``), so each class is spread about evenly; equal rows share a fold."""
    return df.withColumn("fold", F.pmod(row_hash(by or df.columns, seed), F.lit(folds)).cast("int"))
