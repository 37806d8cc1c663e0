"""Aggregating event tables, joining sources and appending new rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.operators.columns import drop_repeated_columns, normalise_name, standardise_source
from tabwright.operators.quantiles import EXACT_ROWS, hot_groups, hot_medians

# Join keys looked for, in this order.
KEY_CANDIDATES = ["user_id", "customer_id", "client_id", "id_user", "id_client"]

_SIMPLE = {
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
    "mean": F.avg,
    "count": F.count,
    "size": lambda c: F.count(F.lit(1)),
    "min": F.min,
    "max": F.max,
    "std": F.stddev_samp,
    "var": F.var_samp,
    "nunique": F.count_distinct,
}


def aggregate_events(
    df: DataFrame,
    key: str,
    aggregations: Mapping[str, Sequence[str]],
    order_by: str | None = None,
    small: int = EXACT_ROWS,
) -> DataFrame:
    """One row per non-null key with columns ``{column}_{function}``.

    ``first`` and ``last`` need ``order_by``: a distributed table has no row
    order of its own. All medians are part of the one aggregate; groups of more than ``small`` values would
    fill a task there, so theirs come from one pass over counts of their values.
    """
    key = normalise_name(key)
    if key not in df.columns:
        raise ValueError(f"group key not found: {key}")
    wanted = [
        (normalise_name(c), f) for c, funcs in aggregations.items() for f in funcs
        if normalise_name(c) in df.columns
    ]
    if not wanted:
        raise ValueError("no column to aggregate")
    rows = df.filter(F.col(key).isNotNull())
    aggs, medians = [], []
    for column, func in wanted:
        name = f"{column}_{func}"
        if func in _SIMPLE:
            aggs.append(_SIMPLE[func](F.col(column)).alias(name))
        elif func == "median":
            medians.append((column, name))
        elif func in ("first", "last"):
            if order_by is None:
                raise ValueError(f"{func} needs order_by")
            pick = F.min_by if func == "first" else F.max_by
            present = F.when(F.col(column).isNotNull(), F.col(order_by))
            aggs.append(pick(F.col(column), present).alias(name))
        else:
            raise ValueError(f"unknown aggregation: {func}")
    columns, names = [c for c, _ in medians], [n for _, n in medians]
    hot = hot_groups(rows, key, columns, small) if medians else None
    if hot is None:
        aggs += [F.percentile(F.col(c).cast("double"), 0.5).alias(n) for c, n in medians]
        return rows.groupBy(key).agg(*aggs).select(key, *[f"{c}_{f}" for c, f in wanted])
    marked = rows.join(hot, key, "left")
    aggs += [F.percentile(F.when(F.col("__hot").isNull(), F.col(c).cast("double")), 0.5).alias(n) for c, n in medians]
    large = F.broadcast(hot_medians(rows.join(hot, key, "left_semi"), key, columns, [f"__{n}" for n in names]))
    out = marked.groupBy(key).agg(*aggs).join(large, key, "left").withColumns({n: F.coalesce(n, f"__{n}") for n in names})
    return out.select(key, *[f"{c}_{f}" for c, f in wanted])


def default_aggregations(name: str, df: DataFrame) -> dict[str, list[str]]:
    """Aggregations offered for a table by its name and columns."""
    out: dict[str, list[str]] = {}
    lowered = name.lower()
    if "transaction" in lowered or "amount" in df.columns:
        if "amount" in df.columns:
            out["amount"] = ["sum", "mean", "count"]
        if "transaction_id" in df.columns:
            out["transaction_id"] = ["count"]
    elif "login" in lowered and "login_id" in df.columns:
        out["login_id"] = ["count"]
    return out


def detect_join_key(
    frames: Mapping[str, DataFrame], candidates: Sequence[str] | None = None
) -> list[str]:
    """Candidate keys present in at least two tables."""
    keys = [normalise_name(k) for k in (candidates or KEY_CANDIDATES)]
    return [k for k in keys if sum(k in df.columns for df in frames.values()) >= 2]


def join_on_key(left: DataFrame, right: DataFrame, key: str, how: str, suffix: str) -> DataFrame:
    """Equi-join in which NULL keys match; colliding right columns get a suffix.

    A full outer join is the left join plus the unmatched right rows, because
    adaptive execution can split a hot key in those two but not in an outer join.
    """
    taken = set(left.columns)
    right = right.select(
        F.col(key).alias("__key"),
        *[
            F.col(c).alias(f"{c}{suffix}" if c in taken else c)
            for c in right.columns
            if c != key
        ],
    )
    added = [c for c in right.columns if c != "__key"]
    on = F.col(key).eqNullSafe(F.col("__key"))
    how = {"full": "outer", "full_outer": "outer"}.get(how, how)
    if how in ("left", "inner"):
        return left.join(right, on, how).select(*left.columns, *added)
    if how == "right":
        joined = left.join(right, on, "right")
        return joined.select(*[F.col("__key").alias(key) if c == key else F.col(c) for c in left.columns], *added)
    if how != "outer":
        raise ValueError(f"unknown join: {how}")
    matched = left.join(right, on, "left").select(*left.columns, *added)
    lone = right.join(left.select(key), on, "left_anti")
    blank = [
        F.col("__key").alias(key) if f.name == key else F.lit(None).cast(f.dataType).alias(f.name)
        for f in left.schema.fields
    ]
    return matched.unionByName(lone.select(*blank, *added))


def merge_sources(frames: Mapping[str, DataFrame], key: str, how: str = "left") -> DataFrame:
    """Join the tables in order on ``key``; tables without the key are skipped."""
    if not frames:
        raise ValueError("no source to merge")
    key = normalise_name(key)
    (base, merged), *others = frames.items()
    if key not in merged.columns:
        raise ValueError(f"key {key} is missing from the main source {base}")
    for name, df in others:
        if key in df.columns:
            merged = join_on_key(merged, df, key, how, f"_{name}")
    return merged


def integrate_sources(
    frames: Mapping[str, DataFrame],
    mappings: Mapping[str, Mapping[str, str]] | None = None,
    types: Mapping[str, Mapping[str, str]] | None = None,
    join_key: str | None = None,
    events: Mapping[str, Mapping] | None = None,
) -> DataFrame:
    """Standardise each table, aggregate event tables, left-join on one key."""
    if not frames:
        raise ValueError("no source to integrate")
    ready = {
        name: standardise_source(df, (mappings or {}).get(name), (types or {}).get(name))
        for name, df in frames.items()
    }
    for name, plan in (events or {}).items():
        if name in ready and plan.get("group_key") and plan.get("aggregations"):
            ready[name] = aggregate_events(
                ready[name], plan["group_key"], plan["aggregations"], plan.get("order_by")
            )
    if join_key is None:
        keys = detect_join_key(ready)
        if not keys:
            raise ValueError("no join key found; give join_key")
        join_key = keys[0]
    return drop_repeated_columns(merge_sources(ready, join_key))


def unify(data: DataFrame | Mapping[str, DataFrame], config: Mapping | None = None) -> DataFrame:
    """One table from a frame or from several named frames."""
    config = config or {}
    if isinstance(data, DataFrame):
        return standardise_source(data, config.get("mapping"), config.get("types"))
    if isinstance(data, Mapping):
        return integrate_sources(
            data, config.get("mappings"), config.get("types"), config.get("join_key"), config.get("events")
        )
    raise TypeError("expected a DataFrame or a mapping of DataFrames")


def new_rows(target: DataFrame, pending: DataFrame, key: str) -> DataFrame:
    """Pending rows whose key is not in the target; one row per new key, the first by its other columns.

    NULL is a key like any other. Maps and other types without an order don't take part in choosing.
    """
    known = target.select(F.col(key).alias("__known")).distinct()
    fresh = pending.join(known, F.col(key).eqNullSafe(F.col("__known")), "left_anti")
    plain = [f.name for f in pending.schema.fields if f.name != key and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    others = [c for c in pending.columns if c != key]
    if not others:
        return fresh.distinct()
    order = F.struct(*(plain or [F.lit(0).alias("none")]))
    chosen = fresh.groupBy(key).agg(F.min_by(F.struct(*others), order).alias("__row"))
    return chosen.select(*[F.col(key) if c == key else F.col("__row")[c].alias(c) for c in pending.columns])


def append_report(target: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows before, inserted and after, and the growth in percent."""
    before = target.agg(F.count(F.lit(1)).alias("rows_before"))
    inserted = fresh.agg(F.count(F.lit(1)).alias("rows_inserted"))
    b, i = F.col("rows_before"), F.col("rows_inserted")
    rate: Column = F.when(b == 0, F.lit(100.0)).otherwise(F.round(i * 100.0 / F.nullif(b, F.lit(0)), 2))
    return before.crossJoin(inserted).select(
        b, i, (b + i).alias("rows_after"), rate.alias("growth_pct")
    )
