"""Fit the preparation of a table once, then replay it on other rows.

Fitting runs a handful of aggregate jobs, each covering all columns at once,
over a cleaned copy of the table in Parquet. The result is a state of scalars
and one category table; applying it is a projection plus joins with that table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions import scalars as S
from tabwright.functions.text import UNKNOWN, invalid_to_null, normalise_value
from tabwright.operators import categories as K
from tabwright.operators import statistics as Z
from tabwright.operators.columns import align_columns, clean, drop_empty_rows, nans_to_null, parse_date, plain_numbers
from tabwright.operators.profile import Structure, check_requested, detect_structure
from tabwright.operators.quantiles import exact_quantiles
from tabwright.plans.state import PrepState
from tabwright.session import materialise, scratch_path

DATE_PARTS = {
    "year": F.year,
    "month": F.month,
    "day": F.dayofmonth,
    "dayofweek": F.weekday,
}
_LITERAL_VALUES = 64


@dataclass
class Prepared:
    """Result of a fit: the table before and after, the state and the reports."""

    source: DataFrame
    features: DataFrame
    labelled: DataFrame
    state: PrepState
    reports: dict[str, list[dict]] = field(default_factory=dict)

    def report(self) -> DataFrame:
        """Every step's report in one long table."""
        rows = []
        for section, entries in self.reports.items():
            for e in entries:
                for metric, value in e.items():
                    if metric != "column":
                        number = float(value) if isinstance(value, (int, float)) else None
                        rows.append((section, e.get("column"), metric, number, None if value is None else str(value)))
        schema = "section string, column string, metric string, value double, text string"
        return self.features.sparkSession.createDataFrame(rows, schema)


def fit(
    df: DataFrame,
    structure: Structure | None = None,
    missing_threshold: float = 60.0,
    skew_threshold: float = 1.0,
    corr_threshold: float = 0.9,
    variance_threshold: float = 0.0,
    min_frequency: int = 3,
    similarity_threshold: float = 0.9,
    keep: Sequence[str] | None = None,
    allow_high_risk: bool = False,
) -> Prepared:
    spark = df.sparkSession
    structure = structure or detect_structure(df)
    base = materialise(clean(df), "clean")
    reports: dict[str, list[dict]] = {}
    state = PrepState(
        options={
            "missing_threshold": missing_threshold, "skew_threshold": skew_threshold,
            "corr_threshold": corr_threshold, "variance_threshold": variance_threshold,
            "min_frequency": min_frequency, "similarity_threshold": similarity_threshold,
        }
    )
    allowed = _allowed(spark, structure, keep, allow_high_risk, reports)
    state.label = structure.labels[0] if structure.labels and structure.labels[0] in base.columns else None
    state.reintegrated = [c for c in allowed if c in base.columns]
    state.excluded = [c for c in structure.excluded if c not in state.reintegrated]
    usable = [c for c in base.columns if c not in state.excluded]
    state.numeric = [c for c in structure.numeric if c in usable]
    state.categorical = [c for c in structure.categorical if c in usable]
    state.date_formats = {c: f for c, f in structure.date_formats.items() if c in usable}

    raw = _typed(base, state)
    n_rows, gaps = _fit_missing(base, raw, state, missing_threshold, reports)
    _fit_medians(_typed(base, state), state, gaps)
    whole = _kept(_filled(_typed(base, state, keep_label=True), state), state, "filled")
    filled = whole.drop(_LABEL)
    _fit_categories(filled, state, min_frequency, similarity_threshold, reports)
    numeric = [c for c in filled.columns if c not in state.categorical]
    _fit_skew(filled, numeric, state, skew_threshold, reports)
    unskewed = _unskewed(filled, state)
    quartiles = _fit_outliers(unskewed, numeric, state, n_rows, reports)
    _complete_medians(filled, quartiles, state, n_rows)
    whole = _kept(_encoded(_clipped(_unskewed(whole, state), state), state, spark), state, "encoded")
    _fit_scaling(whole.drop(_LABEL), quartiles, state, corr_threshold, variance_threshold, reports)
    labelled = _finish(whole, state)
    features = labelled.select(*state.final_features)
    reports["shape"] = [
        {"initial_columns": len(df.columns), "final_rows": n_rows, "final_columns": len(state.final_features),
         "scaler": state.scaler, "label": state.label}
    ]
    reports["final_features"] = [{"column": c, "position": i} for i, c in enumerate(state.final_features)]
    return Prepared(base, features, labelled, state, reports)


def transform(df: DataFrame, state: PrepState, match_new: bool = True, distinct: bool = True) -> DataFrame:
    """Replay a fitted preparation on a batch of rows.

    ``match_new`` corrects category spellings not seen when fitting against the
    stored references, which needs the batch's distinct values; without it such
    values become "unknown" and the replay is a pure row-wise plan.
    """
    rows = drop_empty_rows(nans_to_null(plain_numbers(df)))
    rows = rows.dropDuplicates() if distinct else rows
    filled = _filled(_typed(rows, state), state)
    encoded = _encoded(_clipped(_unskewed(filled, state), state), state, df.sparkSession, match_new)
    return align_columns(_scaled(encoded, state), state.final_features)


def prepare(df: DataFrame, mode: str, state: PrepState | None = None, **options):
    """``fit`` or ``transform`` by name."""
    if mode == "fit":
        return fit(df, **options)
    if mode == "transform" and state is not None:
        return transform(df, state, **options)
    raise ValueError("mode must be 'fit', or 'transform' with a state")


def _allowed(spark, structure, keep, allow_high_risk, reports) -> list[str]:
    if not keep:
        return []
    rows = check_requested(structure.frame(spark), list(keep), allow_high_risk).collect()
    reports["requested"] = [
        {"column": r["column"], "risk": r["risk_level"], "allowed": r["allowed"]} for r in rows
    ]
    return [r["column"] for r in rows if r["allowed"]]


def _typed(df: DataFrame, state: PrepState, keep_label: bool = False) -> DataFrame:
    """Numbers as double, dates as four parts, categories as text, in final order."""
    out: list[Column] = []
    present = [c for c in df.columns if c not in state.dropped_sparse]
    for c in present:
        if c in state.numeric:
            out.append(F.col(c).try_cast("double").alias(c))
        elif c in state.categorical:
            out.append(invalid_to_null(F.col(c)).alias(c))
    for c, fmt in state.date_formats.items():
        if c in present:
            stamp = parse_date(df.schema[c].dataType, F.col(c), fmt)
            out += [f(stamp).cast("double").alias(f"{c}_{part}") for part, f in DATE_PARTS.items()]
    if keep_label and state.label:
        out.append(F.col(state.label).alias(_LABEL))
    return df.select(*out)


_LABEL = "__label"


def _date_columns(state: PrepState) -> list[str]:
    return [f"{c}_{part}" for c in state.date_formats for part in DATE_PARTS]


def _fit_missing(base, raw, state, threshold, reports):
    """Nulls of the usable columns; sparse columns leave, the others may get an indicator."""
    plain = [c for c in base.columns if c in state.numeric or c in state.categorical]
    row = base.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(c).alias(f"p{i}") for i, c in enumerate(plain)],
        *[F.count(invalid_to_null(F.col(c))).alias(f"v{i}") for i, c in enumerate(plain) if c in state.categorical],
    ).first()
    parts = raw.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(c) for c in _date_columns(state)]).first()
    n = row["n"]
    missing = {c: n - row[f"p{i}"] for i, c in enumerate(plain)}
    entries = [
        {"column": c, "missing_count": m, "missing_percentage": round(m * 100 / n, 2)}
        for c, m in missing.items() if m > 0
    ]
    reports["missing"] = sorted(entries, key=lambda e: (-e["missing_percentage"], e["column"]))
    state.dropped_sparse = [c for c, m in missing.items() if m * 100 / n > threshold]
    reports["dropped_sparse"] = [{"column": c, "missing_count": missing[c]} for c in state.dropped_sparse]
    state.numeric = [c for c in state.numeric if c not in state.dropped_sparse]
    state.categorical = [c for c in state.categorical if c not in state.dropped_sparse]
    gaps = {c: n - row[f"v{i}"] if c in state.categorical else missing[c] for i, c in enumerate(plain)
            if c not in state.dropped_sparse}
    state.indicators = [c for c in state.numeric if gaps[c] > 0] + [c for c in state.categorical if gaps[c] > 0]
    gaps.update({c: n - parts[c] for c in _date_columns(state)})
    return n, gaps


def _fit_medians(raw: DataFrame, state: PrepState, gaps: dict[str, int]) -> None:
    """Medians of the columns with gaps; the others follow from the quartile pass."""
    columns = [c for c in (*state.numeric, *_date_columns(state)) if gaps[c] > 0]
    found = exact_quantiles(raw, columns, [0.5])
    state.medians = {c: (found[c][0] if found[c][0] is not None else 0.0) for c in columns}


def _complete_medians(filled: DataFrame, quartiles: dict, state: PrepState, n_rows: int) -> None:
    """Medians of the columns without gaps, which later batches may need."""
    rest = [c for c in (*state.numeric, *_date_columns(state)) if c not in state.medians]
    moved = [c for c in rest if c in state.skew]
    found = exact_quantiles(filled, moved, [0.5], sizes=dict.fromkeys(moved, n_rows))
    state.medians.update({c: found[c][0] if c in found else quartiles[c][1] for c in rest})


def _filled(raw: DataFrame, state: PrepState) -> DataFrame:
    """Medians and "unknown" for missing values, indicators where fitting saw any."""
    out = []
    for c in raw.columns:
        if c in state.medians:
            out.append(F.coalesce(F.col(c), F.lit(state.medians[c])).alias(c))
        elif c in state.categorical:
            out.append(normalise_value(F.coalesce(F.col(c), F.lit(UNKNOWN))).alias(c))
        else:
            out.append(F.col(c))
    out += [
        F.col(c).isNull().cast("double").alias(f"{c}_missing") for c in state.indicators if c in raw.columns
    ]
    return raw.select(*out)


def _kept(df: DataFrame, state: PrepState, label: str) -> DataFrame:
    """A step's rows, stored if they hold categories, whose texts are normalised and coded but once."""
    return materialise(df, label) if state.categorical else df


def _fit_categories(filled, state, min_frequency, threshold, reports) -> None:
    """Distinct values, references, corrections and codes of all categories together."""
    reports["corrections"] = []
    if not state.categorical:
        return
    spark = filled.sparkSession
    counts = materialise(K.value_counts(filled, state.categorical), "category-counts")
    state.references_path = scratch_path(spark, "references")
    K.reference_values(counts, min_frequency).write.parquet(state.references_path)
    references = state.references(spark)
    rare = counts.filter(F.col("n") < min_frequency).limit(1)
    if rare.isEmpty():
        fixes = spark.createDataFrame([], "column string, value string, corrected string, score double")
    else:
        fixes = materialise(K.corrections(counts, references, threshold), "corrections")
    state.categories_path = scratch_path(spark, "categories")
    K.encode(K.standardise(counts, fixes)).write.parquet(state.categories_path)
    table = state.categories(spark)
    rows = table.groupBy("column").agg(
        F.count(F.lit(1)).alias("values"), F.max("code").alias("top"),
        F.max(F.when(F.col("corrected") == UNKNOWN, F.col("code"))).alias("unknown"),
    ).collect()
    fixed = {r["column"]: r["n"] for r in fixes.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    for r in rows:
        c = r["column"]
        state.value_counts[c] = r["values"]
        state.class_counts[c] = r["top"] + 1
        state.unknown_codes[c] = r["unknown"] if r["unknown"] is not None else r["top"] + 1
        reports["corrections"].append(
            {"column": c, "values": r["values"], "classes": r["top"] + 1, "corrected": fixed.get(c, 0)}
        )


def _fit_skew(filled, numeric, state, threshold, reports) -> None:
    stats = Z.skew_stats(filled, numeric)
    reports["skewness"] = Z.skew_report(stats)
    high = {c: s for c, s in stats.items() if s["skew"] is not None and abs(s["skew"]) >= threshold}
    lambdas = Z.fit_yeo_johnson(filled, [c for c, s in high.items() if s["min"] < 0])
    after = {c: s["skew_log1p"] for c, s in high.items() if s["min"] >= 0}
    after.update({c: y["skew"] for c, y in lambdas.items()})
    reports["skew_transformations"] = []
    for c, s in high.items():
        if after.get(c) is None or not abs(after[c]) < abs(s["skew"]):
            continue
        y = lambdas.get(c)
        state.skew[c] = {"method": "Yeo-Johnson", **{k: y[k] for k in ("lambda", "mean", "std")}} if y else {
            "method": "Log1p"
        }
        reports["skew_transformations"].append(
            {"column": c, "method": state.skew[c]["method"], "skew_before": round(abs(s["skew"]), 3),
             "skew_after": round(abs(after[c]), 3)}
        )


def unskew(c: Column, entry: dict | None) -> Column:
    if entry is None:
        return c
    if entry["method"] == "Log1p":
        return S.log1p_clipped(c)
    return (S.yeo_johnson(c, entry["lambda"]) - entry["mean"]) / entry["std"]


def _unskewed(df: DataFrame, state: PrepState) -> DataFrame:
    return df.select(*[unskew(F.col(c), state.skew.get(c)).alias(c) for c in df.columns])


def _fit_outliers(df, numeric, state, n_rows, reports):
    quartiles = exact_quantiles(df, numeric, [0.25, 0.5, 0.75], sizes=dict.fromkeys(numeric, n_rows))
    found, treated = Z.outliers(df, quartiles, n_rows)
    state.bounds = treated
    reports["outliers"] = found
    reports["outlier_treatment"] = [
        {"column": c, "outlier_ratio": round(b["ratio"], 2), "action": b["action"]} for c, b in treated.items()
    ]
    return quartiles


def _clipped(df: DataFrame, state: PrepState) -> DataFrame:
    out = []
    for c in df.columns:
        b = state.bounds.get(c)
        treat = b is not None and b["action"] == Z.WINSORISED
        out.append((S.clip(F.col(c), b["lower"], b["upper"]) if treat else F.col(c)).alias(c))
    return df.select(*out)


def _encoded(df: DataFrame, state: PrepState, spark, match_new: bool = False) -> DataFrame:
    """Category codes: literal maps for few values, joins with the table otherwise."""
    columns = [c for c in state.categorical if c in df.columns]
    if not columns:
        return df
    table = state.categories(spark)
    new = _new_values(df, columns, table, state) if match_new else None
    few = [c for c in columns if state.value_counts[c] <= _LITERAL_VALUES and new is None]
    if new is not None:
        table = table.unionByName(new)
    codes: dict[str, Column] = {}
    if few:
        known: dict[str, list] = {c: [] for c in few}
        for r in table.filter(F.col("column").isin(few)).collect():  # at most 64 per column
            known[r["column"]] += [F.lit(r["value"]), F.lit(float(r["code"]))]
        codes = {c: F.try_element_at(F.create_map(*known[c]), F.col(c)) for c in few}
    for i, c in enumerate(columns):
        if c not in codes:
            side = table.filter(F.col("column") == c).select(
                F.col("value").alias(f"__v{i}"), F.col("code").cast("double").alias(f"__k{i}")
            )
            df = df.join(side, F.col(c) == F.col(f"__v{i}"), "left")
            codes[c] = F.col(f"__k{i}")
    return df.select(
        *[
            F.coalesce(codes[c], F.lit(float(state.unknown_codes[c]))).alias(c) if c in codes else F.col(c)
            for c in df.columns
            if not c.startswith(("__v", "__k"))
        ]
    )


def _new_values(df, columns, table, state) -> DataFrame | None:
    """Codes of values not seen when fitting that are close to a reference; None if there are none."""
    spark = df.sparkSession
    seen = df.select(*columns).unpivot([], columns, "column", "value").distinct()
    fresh = materialise(seen.join(table.select("column", "value"), ["column", "value"], "left_anti"), "fresh")
    if fresh.isEmpty():
        return None
    fixes = K.best_references(fresh, state.references(spark), state.options["similarity_threshold"])
    classes = table.select("column", "corrected", "code").distinct()
    found = fixes.join(classes, ["column", "corrected"]).select("column", "value", "corrected", "code")
    return materialise(found, "matched")


def _fit_scaling(encoded, quartiles, state, corr_threshold, variance_threshold, reports) -> None:
    columns = encoded.columns
    state.scaler = Z.choose_scaler([b["ratio"] for b in state.bounds.values()])
    moments, corr = Z.moments_and_correlation(encoded, columns)
    if state.scaler == "RobustScaler":
        rest = [c for c in columns if c not in quartiles]
        quartiles = {**quartiles, **exact_quantiles(encoded, rest, [0.25, 0.5, 0.75])}
        # Clipping keeps the quartiles and the median: its bounds lie outside them.
        state.centers = {c: quartiles[c][1] for c in columns}
        state.scales = {c: (quartiles[c][2] - quartiles[c][0]) or 1.0 for c in columns}
    else:
        state.centers = {c: moments[c]["mean"] for c in columns}
        state.scales = {c: moments[c]["std"] or 1.0 for c in columns}
    state.scaled = list(columns)
    state.low_variance = [
        c for c in columns
        if moments[c]["min"] == moments[c]["max"]
        or (moments[c]["std"] / state.scales[c]) ** 2 <= variance_threshold
    ]
    kept = [c for c in columns if c not in state.low_variance]
    state.correlated = Z.correlated(kept, corr, corr_threshold)
    state.final_features = [c for c in kept if c not in state.correlated]
    reports["low_variance"] = [{"column": c, "std": moments[c]["std"]} for c in state.low_variance]
    reports["correlated"] = [{"column": c, "max_correlation": max(abs(corr[(a, c)] or 0.0) for a in kept[: kept.index(c)])}
                             for c in state.correlated]


def _scaled(df: DataFrame, state: PrepState) -> DataFrame:
    """Centre and scale; a column the batch lacks enters as 0 before scaling."""
    out = []
    for c in state.scaled:
        x = F.col(c) if c in df.columns else F.lit(0.0)
        out.append(((x - F.lit(state.centers[c])) / F.lit(state.scales[c])).alias(c))
    extra = [F.col(_LABEL)] if _LABEL in df.columns else []
    return df.select(*out, *extra)


def _finish(df: DataFrame, state: PrepState) -> DataFrame:
    scaled = _scaled(df, state)
    label = [F.col(_LABEL).alias(state.label)] if _LABEL in scaled.columns else []
    return scaled.select(*state.final_features, *[c for c in label if state.label not in state.final_features])


def real_value(scaled: Column, feature: str, state: PrepState, digits: int = 3) -> Column:
    """A scaled value back in the units of the source; NULL for unknown features."""
    if feature not in state.scales:
        return F.lit(None).cast("double")
    x = scaled * F.lit(state.scales[feature]) + F.lit(state.centers[feature])
    entry = state.skew.get(feature)
    if entry is not None:
        if entry["method"] == "Log1p":
            x = F.expm1(x)
        else:
            x = S.yeo_johnson_inverse(x * entry["std"] + entry["mean"], entry["lambda"])
    return F.round(x, digits)


def scaling_table(spark, state: PrepState) -> DataFrame:
    """(feature, center, scale, method, lambda, mean, std), one row per scaled column."""
    rows = []
    for c in state.scaled:
        e = state.skew.get(c, {})
        rows.append((c, state.centers[c], state.scales[c], e.get("method"), e.get("lambda"), e.get("mean"), e.get("std")))
    return spark.createDataFrame(
        rows, "feature string, center double, scale double, method string, lambda double, mean double, std double"
    )


def scaler_evidence(spark, state: PrepState) -> DataFrame:
    """How many columns had notable outliers, beside the scaler chosen."""
    rows = [(c, b["action"]) for c, b in state.bounds.items()]
    notable = F.count_if(F.col("action").isin(Z.WINSORISED, Z.FLAGGED))
    return spark.createDataFrame(rows, "column string, action string").agg(
        F.lit(state.scaler).alias("scaler"), notable.alias("notable_columns"),
        F.count(F.lit(1)).alias("n_columns"),
        S.percent(notable, F.count(F.lit(1)), 1).alias("notable_pct"),
    )
