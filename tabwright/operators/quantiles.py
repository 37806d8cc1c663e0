"""Exact, linearly interpolated quantiles at any row count.

``percentile`` keeps one map of all distinct values per column in a single
reducer, so it is used only where a counted bound allows it. Above the bound a
bracket around each wanted rank is narrowed with ``approx_percentile`` splitters
until what is left inside is small; counts are exact, so the result is too.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.operators.ranking import running_total

EXACT_ROWS = 1_000_000
_INSIDE = 20_000
_SPLITS = 256
_ACCURACY = 4_000


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    small: int = EXACT_ROWS,
    sizes: dict[str, int] | None = None,
) -> dict[str, list[float | None]]:
    """Quantiles of several columns; null where a column has no value.

    ``sizes`` are the columns' non-null counts, where the caller knows them.
    """
    columns = list(columns)
    if not columns:
        return {}
    probs = F.array(*[F.lit(float(p)) for p in probabilities])
    if sizes is None:
        counts = df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)]).first()
        sizes = {c: counts[f"n{i}"] for i, c in enumerate(columns)}
    out: dict[str, list[float | None]] = {}
    few = [c for c in columns if sizes[c] <= small]
    if few:
        row = df.agg(
            *[
                F.percentile(F.col(c).cast("double"), probs).alias(f"q{i}")
                for i, c in enumerate(few)
            ]
        ).first()
        for i, c in enumerate(few):
            out[c] = list(row[f"q{i}"]) if row[f"q{i}"] is not None else [None] * len(probabilities)
    many = [c for c in columns if sizes[c] > small]
    if many:
        out.update(_narrowed(df, many, sizes, list(probabilities)))
    return out


def _narrowed(df, columns, sizes, probabilities):
    """Order statistics k and k+1 of each (column, probability) by narrowing."""
    targets = {}
    for c in columns:
        for p in probabilities:
            h = (sizes[c] - 1) * p
            for rank in {math.floor(h), math.ceil(h)}:
                targets[(c, rank)] = [-math.inf, math.inf]
    found: dict[tuple[str, int], float] = {}
    steps = F.array(*[F.lit(i / _SPLITS) for i in range(_SPLITS + 1)])
    while targets:
        keys = list(targets)
        aggs = []
        for i, (c, _) in enumerate(keys):
            lo, hi = targets[keys[i]]
            x = F.col(c).cast("double")
            inside = (x >= F.lit(lo)) & (x <= F.lit(hi))
            aggs += [
                F.count(F.when(x < F.lit(lo), 1)).alias(f"b{i}"),
                F.count(F.when(inside, 1)).alias(f"n{i}"),
                F.percentile_approx(F.when(inside, x), steps, _ACCURACY).alias(f"s{i}"),
                F.min(F.when(inside, x)).alias(f"min{i}"),
                F.max(F.when(inside, x)).alias(f"max{i}"),
            ]
        row = df.agg(*aggs).first()
        ready = {}
        for i, key in enumerate(keys):
            before, n, splits = row[f"b{i}"], row[f"n{i}"], row[f"s{i}"]
            rank = key[1] - before
            lo, hi = targets[key]
            if row[f"min{i}"] == row[f"max{i}"]:
                found[key] = row[f"min{i}"]
                del targets[key]
            elif n <= _INSIDE:
                ready[key] = (lo, hi, rank)
                del targets[key]
            else:
                at = rank / n * _SPLITS
                slack = 2 + math.ceil(2 * _SPLITS / _ACCURACY)
                left = max(0, math.floor(at) - slack)
                right = min(_SPLITS, math.ceil(at) + slack)
                new = [splits[left], splits[right]]
                if left == 0:
                    new[0] = lo
                if right == _SPLITS:
                    new[1] = hi
                if new == [lo, hi]:
                    # A few heavy values fill the bracket: test the value itself.
                    new = [splits[round(at)]] * 2
                targets[key] = new
        if targets:
            found.update(_checked(df, targets))
        if ready:
            items = list(ready.items())
            aggs = []
            for i, ((c, _), (lo, hi, rank)) in enumerate(items):
                x = F.col(c).cast("double")
                held = F.collect_list(F.when((x >= lo) & (x <= hi), x))  # at most _INSIDE values
                aggs.append(F.sort_array(held)[rank].alias(f"v{i}"))
            row = df.agg(*aggs).first()
            for i, (key, _) in enumerate(items):
                found[key] = row[f"v{i}"]
    out = {}
    for c in columns:
        values = []
        for p in probabilities:
            h = (sizes[c] - 1) * p
            a, b = found[(c, math.floor(h))], found[(c, math.ceil(h))]
            values.append(a + (b - a) * (h - math.floor(h)))
        out[c] = values
    return out


def _checked(df, targets):
    """Verify that each new bracket still holds its rank; widen it if it does not."""
    keys = list(targets)
    aggs = []
    for i, (c, _) in enumerate(keys):
        lo, hi = targets[keys[i]]
        x = F.col(c).cast("double")
        aggs += [
            F.count(F.when(x < F.lit(lo), 1)).alias(f"b{i}"),
            F.count(F.when(x <= F.lit(hi), 1)).alias(f"e{i}"),
            F.max(F.when(x < F.lit(lo), x)).alias(f"lo{i}"),
            F.min(F.when(x > F.lit(hi), x)).alias(f"hi{i}"),
        ]
    row = df.agg(*aggs).first()
    found = {}
    for i, key in enumerate(keys):
        lo, hi = targets[key]
        if row[f"b{i}"] > key[1]:
            targets[key] = [-math.inf, row[f"lo{i}"]]
        elif row[f"e{i}"] <= key[1]:
            targets[key] = [row[f"hi{i}"], math.inf]
        elif lo == hi:
            found[key] = lo
            del targets[key]
    return found


def grouped_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    column: str,
    probabilities: Sequence[float],
    into: Sequence[str],
    small: int = EXACT_ROWS,
) -> DataFrame:
    """Exact quantiles of ``column`` per group, one output column per probability.

    Groups up to ``small`` rows use ``percentile``. A group above it would put
    its whole value map in one reducer, so its distinct values are counted by
    (group, value) and the ranks are read off cumulative counts whose offsets
    come from range partitions.
    """
    keys = list(keys)
    probs = F.array(*[F.lit(float(p)) for p in probabilities])
    base = df.select(*keys, F.col(column).cast("double").alias("__x")).filter(
        F.col("__x").isNotNull()
    )
    sizes = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    hot = sizes.filter(F.col("__n") > small)
    unpack = [F.col("__q")[i].alias(name) for i, name in enumerate(into)]
    if hot.isEmpty():
        return base.groupBy(*keys).agg(F.percentile("__x", probs).alias("__q")).select(*keys, *unpack)
    # At most a ``small``-th of the rows; a join by the groups would bring all rows of one into one task.
    marks = F.broadcast(hot.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__n"))
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    on = same[0]
    for s in same[1:]:
        on = on & s
    cold = (
        base.join(marks, on, "left_anti")
        .groupBy(*keys)
        .agg(F.percentile("__x", probs).alias("__q"))
        .select(*keys, *unpack)
    )
    return cold.unionByName(_hot_quantiles(base.join(marks, on, "left_semi"), keys, probabilities, into))


def hot_groups(df: DataFrame, key: str, columns: Sequence[str], small: int = EXACT_ROWS) -> DataFrame | None:
    """The groups with more than ``small`` values in one of the columns, as a broadcast (at most a ``small``-th of the rows); None if there are none."""
    most = F.greatest(*[F.count(c) for c in columns], F.lit(0))
    hot = df.groupBy(key).agg(most.alias("__n")).filter(F.col("__n") > small).select(key)
    return None if hot.isEmpty() else F.broadcast(hot.withColumn("__hot", F.lit(True)))


def hot_medians(rows: DataFrame, key: str, columns: Sequence[str], into: Sequence[str]) -> DataFrame:
    """Exact medians of all columns per group, however large, in one pass over (group, column, value) counts."""
    long = rows.select(key, *[F.col(c).cast("double").alias(f"__v{i}") for i, c in enumerate(columns)]).unpivot(
        [key], [f"__v{i}" for i in range(len(columns))], "__column", "__x"
    ).filter(F.col("__x").isNotNull())
    found = _hot_quantiles(long, [key, "__column"], [0.5], ["__median"])
    return found.groupBy(key).agg(*[F.max(F.when(F.col("__column") == f"__v{i}", F.col("__median"))).alias(name) for i, name in enumerate(into)])


def _hot_quantiles(rows, keys, probabilities, into):
    values = rows.groupBy(*keys, "__x").agg(F.count(F.lit(1)).alias("__c"))
    ranked = running_total(values, ["__x"], "__c", "__r", keys)
    sizes = values.groupBy(*keys).agg(F.sum("__c").alias("__n"))
    named = sizes.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__n")
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    aggs = []
    for p, name in zip(probabilities, into):
        h = (F.col("__n") - 1) * F.lit(float(p))
        ends = []
        for rank in (F.floor(h), F.ceil(h)):
            covers = (F.col("__r") <= rank) & (rank < F.col("__r") + F.col("__c"))
            ends.append(F.max(F.when(covers, F.col("__x"))))
        lo, hi = ends
        aggs.append((lo + (hi - lo) * F.max(h - F.floor(h))).alias(name))
    return ranked.join(F.broadcast(named), on).groupBy(*keys).agg(*aggs)  # hot groups alone
