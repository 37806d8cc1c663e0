"""Inferring the role of every column from one table profile."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.operators.aggregates import distinct_counts
from tabwright.operators.columns import DATE_FORMATS, numeric_columns, plain_numbers
from tabwright.session import spread

# Words in column names and values that mark a role.
DATE_WORDS = [
    "date", "time", "datetime", "created_at", "updated_at", "signup", "login", "birth", "timestamp",
]
ID_NAMES = [
    "id", "user_id", "customer_id", "client_id", "uuid", "identifier", "transaction_id", "order_id",
]
LABEL_WORDS = [
    "label", "target", "class", "classe", "status", "result", "outcome", "is_anomaly", "anomaly",
    "fraud", "is_fraud", "churn", "is_churn", "target_class", "prediction",
]
LABEL_VALUES = [
    "0", "1", "yes", "no", "true", "false", "normal", "anomaly", "fraud", "not_fraud", "churn",
    "not_churn", "active", "inactive",
]
DATE_SHAPE = (
    r"^(\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{4}|\d{4}[-/]\d{1,2})$"
)
UUID_SHAPE = r"(?i)^[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}$"

# Why a column is left out.
ID_REASON = "Identifiant détecté automatiquement"
LABEL_REASON = "Label potentiel détecté automatiquement"

_RSD = 0.02
_DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)

PROFILE_SCHEMA = (
    "column_index int, column string, data_type string, n_rows long, null_count long, "
    "n_distinct long, is_numeric boolean, is_categorical boolean, is_date boolean, "
    "date_format string, is_id boolean, label_score int, label_reasons array<string>, "
    "is_label boolean, is_excluded boolean, exclusion_reason string, is_feature boolean, "
    "feature_type string, risk_level string"
)


@dataclass
class Structure:
    """Roles of the columns of one table, all lists in column order."""

    n_rows: int
    columns: list[str]
    profile: list[dict] = field(default_factory=list)

    def _where(self, flag: str) -> list[str]:
        return [p["column"] for p in self.profile if p[flag]]

    @property
    def numeric(self):
        return self._where("is_numeric")

    @property
    def categorical(self):
        return self._where("is_categorical")

    @property
    def dates(self):
        return self._where("is_date")

    @property
    def ids(self):
        return self._where("is_id")

    @property
    def labels(self):
        return self._where("is_label")

    @property
    def excluded(self):
        return self._where("is_excluded")

    @property
    def features(self):
        return self._where("is_feature")

    @property
    def date_formats(self):
        return {p["column"]: p["date_format"] for p in self.profile if p["is_date"]}

    def frame(self, spark) -> DataFrame:
        """The profile as a table, one row per column."""
        names = [f.split()[0] for f in PROFILE_SCHEMA.split(", ")]
        return spark.createDataFrame([tuple(p[n] for n in names) for p in self.profile], PROFILE_SCHEMA)


def detect_structure(df: DataFrame, id_ratio: float = 0.95) -> Structure:
    """Profile every column in one scan, then settle what that scan left open.

    Distinct counts are estimated first. They are counted exactly only where a
    decision is near its threshold, where the count is small, or where the
    column is reported as a label; elsewhere ``n_distinct`` stays null.
    """
    df = spread(plain_numbers(df))
    columns = df.columns
    types = {f.name: f.dataType for f in df.schema.fields}
    numeric = set(numeric_columns(df))
    texts = [c for c in columns if isinstance(types[c], T.StringType)]
    row = df.agg(*_scan(df, columns, texts)).first()
    n = row["n"]
    if n == 0:
        raise ValueError("the table is empty")
    dates, formats = _date_columns(df, columns, types, texts, row)
    estimate = {c: row[f"d{i}"] for i, c in enumerate(columns)}
    typical = {c: bool(row[f"t{i}"]) for i, c in enumerate(columns)}
    uuids = {c: row[f"u{i}"] for i, c in enumerate(columns) if c in texts}
    nulls = {c: row[f"nulls{i}"] for i, c in enumerate(columns)}
    return _settled(df, columns, types, n, nulls, estimate, typical, uuids, numeric, dates, formats, id_ratio)


def _settled(df, columns, types, n, nulls, estimate, typical, uuids, numeric, dates, formats, id_ratio) -> Structure:
    """Roles from what the scan found; columns near a decision are counted exactly in ``df``, if there is one."""
    unsure = [c for c in columns if _needs_count(c, estimate[c], n, id_ratio, typical[c], c == columns[-1])] if df is not None else []
    exact = {r["column"]: r["n_distinct"] for r in distinct_counts(df, unsure).collect()} if unsure else {}
    for c in unsure:
        exact.setdefault(c, 0)
    out = []
    for i, c in enumerate(columns):
        distinct = exact.get(c, estimate[c])
        uuid = uuids.get(c, 0) > 0 and uuids[c] == n - nulls[c]
        is_id = _id_name(c) or (n > 20 and distinct / n > id_ratio) or uuid
        score, reasons = _label_score(c, distinct, n, c == columns[-1], typical[c])
        out.append(
            _entry(i, c, types[c], n, nulls[c], exact.get(c), c in numeric, c in dates,
                   formats.get(c), is_id, score, reasons)
        )
    return Structure(n, list(columns), out)


#: One row per column; ``formats`` counts the values that parse by each of DATE_FORMATS.
SKETCH_SCHEMA = (
    "position int, column string, data_type string, n_rows long, nulls long, sketch binary, typical boolean, "
    "shaped long, uuids long, formats array<long>"
)


def column_sketches(df: DataFrame) -> DataFrame:
    """What a profile needs to know of each column, in a form that can be stored and merged with that of other rows.

    Distinct values are kept as a sketch of typed hashes, everything else as counts, so a new batch updates a stored
    profile without the older rows being read again.
    """
    df = plain_numbers(df)
    n, rows = F.count(F.lit(1)), []
    for i, f in enumerate(df.schema.fields):
        c, text = F.col(f.name), isinstance(f.dataType, T.StringType)
        shaped = F.length(F.trim(c)).between(6, 10) & F.trim(c).rlike(DATE_SHAPE) if text else F.lit(False)
        hits = [F.count(F.when(shaped, F.try_to_timestamp(F.trim(c), F.lit(p)))) if text else F.lit(0) for p in DATE_FORMATS]
        rows.append(F.struct(
            F.lit(i).alias("position"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("data_type"), n.alias("n_rows"),
            F.count_if(c.isNull()).alias("nulls"), F.hll_sketch_agg(F.when(c.isNotNull(), F.xxhash64(c)), F.lit(12)).alias("sketch"),
            F.coalesce(F.max(_label_like(c, f.dataType)), F.lit(False)).alias("typical"), F.count_if(shaped).alias("shaped"),
            (F.count_if((F.length(c) == 36) & c.rlike(UUID_SHAPE)) if text else F.lit(0)).cast("long").alias("uuids"),
            F.array(*[h.cast("long") for h in hits]).alias("formats"),
        ))
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def merge_sketches(sketches: DataFrame, *others: DataFrame) -> DataFrame:
    """The sketches of all rows together; columns go by name, and their types must agree."""
    for o in others:
        sketches = sketches.unionByName(o)
    merged = sketches.groupBy("column").agg(
        F.min("position").alias("position"), F.min("data_type").alias("data_type"), F.sum("n_rows").alias("n_rows"), F.sum("nulls").alias("nulls"),
        F.hll_union_agg("sketch").alias("sketch"), F.max("typical").alias("typical"), F.sum("shaped").alias("shaped"), F.sum("uuids").alias("uuids"),
        F.array(*[F.sum(F.col("formats")[j]) for j in range(len(DATE_FORMATS))]).alias("formats"), F.count_distinct("data_type").alias("types"),
    )
    checked = F.when(F.col("types") == 1, F.col("data_type")).otherwise(F.raise_error(F.concat(F.lit("types differ: "), F.col("column"))))
    return merged.withColumn("data_type", checked).select(*[f.split()[0] for f in SKETCH_SCHEMA.split(", ")])


def structure_of(sketches: DataFrame, df: DataFrame | None = None, id_ratio: float = 0.95) -> Structure:
    """Roles from (merged) sketches alone; with ``df`` columns near a decision are counted exactly in it, as ``detect_structure`` does."""
    spark = sketches.sparkSession
    rows = sketches.withColumn("estimate", F.hll_sketch_estimate("sketch")).drop("sketch").orderBy("position").collect()  # one per column
    if not rows or not rows[0]["n_rows"]:
        raise ValueError("the table is empty")
    n, columns = rows[0]["n_rows"], [r["column"] for r in rows]
    types = {r["column"]: T.DataType.fromDDL(r["data_type"]) for r in rows}
    numeric = set(numeric_columns(spark.createDataFrame([], T.StructType([T.StructField(c, t) for c, t in types.items()]))))
    nulls = {r["column"]: r["nulls"] for r in rows}
    formats = {}
    for r in rows:
        if r["shaped"] > 0 and r["shaped"] >= 0.5 * (n - r["nulls"]):
            share = 0.5 if any(w in r["column"].strip().lower() for w in DATE_WORDS) else 0.8
            if max(r["formats"]) >= share * n:
                formats[r["column"]] = DATE_FORMATS[r["formats"].index(max(r["formats"]))]
    dates = {c for c in columns if isinstance(types[c], _DATES)} | set(formats)
    return _settled(
        None if df is None else plain_numbers(df), columns, types, n, nulls, {r["column"]: r["estimate"] for r in rows}, {r["column"]: r["typical"] for r in rows},
        {r["column"]: r["uuids"] for r in rows}, numeric, dates, formats, id_ratio,
    )


def _scan(df, columns, texts):
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(columns):
        aggs += [
            F.count(F.when(F.col(c).isNull(), 1)).alias(f"nulls{i}"),
            # A sketch has one binary buffer; approx_count_distinct plans one per register word.
            F.hll_sketch_estimate(
                F.hll_sketch_agg(F.when(F.col(c).isNotNull(), F.xxhash64(c)), F.lit(12))
            ).alias(f"d{i}"),
            F.max(_label_like(F.col(c), df.schema[c].dataType)).alias(f"t{i}"),
        ]
        if c in texts:
            aggs += [
                # The lengths spare most values the regular expressions.
                F.count(F.when(F.length(F.trim(c)).between(6, 10) & F.trim(c).rlike(DATE_SHAPE), 1)).alias(f"s{i}"),
                F.count(F.when((F.length(c) == 36) & F.col(c).rlike(UUID_SHAPE), 1)).alias(f"u{i}"),
            ]
    return aggs


def _label_like(c, dtype):
    """Whether the value's text is a typical label; only some types can write one."""
    if isinstance(dtype, T.IntegralType):
        return c.isin(0, 1)
    if isinstance(dtype, T.BooleanType):
        return c.isNotNull()
    if isinstance(dtype, T.StringType):
        return F.lower(F.trim(c)).isin(LABEL_VALUES)
    return F.lit(False)


def _date_columns(df, columns, types, texts, row):
    """Native dates, and texts that look like dates and parse often enough."""
    native = [c for c in columns if isinstance(types[c], _DATES)]
    shaped = [
        (i, c) for i, c in enumerate(columns)
        if c in texts and row[f"s{i}"] > 0 and row[f"s{i}"] >= 0.5 * (row["n"] - row[f"nulls{i}"])
    ]
    formats = {}
    if shaped:
        hits = df.agg(
            *[
                F.count(F.try_to_timestamp(F.trim(F.col(c)), F.lit(f))).alias(f"h{i}_{j}")
                for i, c in shaped
                for j, f in enumerate(DATE_FORMATS)
            ]
        ).first()
        for i, c in shaped:
            counts = [hits[f"h{i}_{j}"] for j in range(len(DATE_FORMATS))]
            share = 0.5 if any(w in c.strip().lower() for w in DATE_WORDS) else 0.8
            if max(counts) >= share * row["n"]:
                formats[c] = DATE_FORMATS[counts.index(max(counts))]
    return {*native, *formats}, formats


def _id_name(column: str) -> bool:
    name = column.strip().lower()
    return name in ID_NAMES or name.endswith("_id") or "uuid" in name or "identifier" in name


def _needs_count(column, estimate, n, id_ratio, typical, last) -> bool:
    slack = 4 * _RSD
    if estimate <= 20:
        return True
    at_id = not _id_name(column) and n > 20 and abs(estimate / n - id_ratio) <= slack
    at_label = abs(estimate / n - 0.05) <= 0.05 * slack * 2
    score, _ = _label_score(column, estimate, n, last, typical)
    return at_id or at_label or score >= 3


def _label_score(column, distinct, n, last, typical):
    score, reasons = 0, []
    name = column.strip().lower()
    word = next((w for w in LABEL_WORDS if w in name), None)
    if word:
        score += 3
        reasons.append(f"name contains {word}")
    if distinct <= 2:
        score += 2
        reasons.append("binary")
    elif distinct <= 10:
        score += 1
        reasons.append("few classes")
    if distinct / n < 0.05:
        score += 1
        reasons.append("low share of distinct values")
    if last:
        score += 1
        reasons.append("last column")
    if typical:
        score += 1
        reasons.append("typical label values")
    return score, reasons


def _entry(i, c, dtype, n, nulls, exact, numeric, date, fmt, is_id, score, reasons):
    categorical = not numeric and not date and isinstance(dtype, (T.StringType, T.BooleanType))
    label = score >= 3
    kind = next(
        (k for k, on in (("id", is_id), ("label", label), ("date", date), ("numeric", numeric),
                         ("categorical", categorical)) if on),
        "unknown",
    )
    risk = {"id": "élevé", "label": "élevé", "date": "moyen", "unknown": "moyen"}.get(kind, "faible")
    return {
        "column_index": i, "column": c, "data_type": dtype.simpleString(), "n_rows": n,
        "null_count": nulls, "n_distinct": exact, "is_numeric": numeric,
        "is_categorical": categorical, "is_date": date, "date_format": fmt, "is_id": is_id,
        "label_score": score, "label_reasons": reasons, "is_label": label,
        "is_excluded": is_id or label,
        "exclusion_reason": LABEL_REASON if label else ID_REASON if is_id else None,
        "is_feature": not (is_id or label), "feature_type": kind, "risk_level": risk,
    }


def structure_summary(profile: DataFrame) -> DataFrame:
    """The nine totals of a profile."""
    flag = lambda c: F.count_if(F.col(c))
    return profile.agg(
        F.max("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_columns"),
        flag("is_numeric").alias("n_numeric"), flag("is_categorical").alias("n_categorical"),
        flag("is_date").alias("n_dates"), flag("is_id").alias("n_ids"),
        flag("is_label").alias("n_labels"), flag("is_excluded").alias("n_excluded"),
        flag("is_feature").alias("n_features"),
    )


def label_candidates(profile: DataFrame) -> DataFrame:
    return profile.filter("is_label").select(
        "column_index", "column", "label_score", "n_distinct", "label_reasons"
    ).orderBy("column_index")


def exclusions(profile: DataFrame) -> DataFrame:
    return profile.filter("is_excluded").select("column", "exclusion_reason")


def check_requested(profile: DataFrame, requested: Sequence[str], allow_high_risk: bool = False,
                    warn_medium: bool = False) -> DataFrame:
    """Whether columns asked for by hand may be used, with the risk of each.

    ``warning`` is set for missing and high-risk columns, and with
    ``warn_medium`` also for dates and untyped columns.
    """
    spark = profile.sparkSession
    wanted = spark.createDataFrame([(i, c) for i, c in enumerate(requested)], "position int, column string")
    joined = wanted.join(profile.select("column", "feature_type", F.col("risk_level").alias("__risk")),
                         "column", "left")
    known = F.col("feature_type").isNotNull()
    risk = F.when(known, F.col("__risk")).otherwise("invalide")
    warned = ["invalide", "élevé"] + (["moyen"] if warn_medium else [])
    return joined.select(
        "position", "column", risk.alias("risk_level"),
        (known & ((F.col("__risk") != "élevé") | F.lit(allow_high_risk))).alias("allowed"),
        risk.isin(warned).alias("warning"),
    ).orderBy("position")


def reintegrate(profile: DataFrame, requested: Sequence[str], allow_high_risk: bool = False) -> DataFrame:
    """The profile with allowed excluded columns turned back into features."""
    checked = check_requested(profile, requested, allow_high_risk).filter("allowed").select(
        "column", F.lit(True).alias("__in")
    )
    back = F.col("__in").isNotNull() & F.col("is_excluded")
    return (
        profile.join(checked, "column", "left")
        .withColumn("is_reintegrated", back)
        .withColumn("is_excluded", F.col("is_excluded") & ~F.col("is_reintegrated"))
        .withColumn("is_feature", F.col("is_feature") | F.col("is_reintegrated"))
        .drop("__in")
    )


def registry_summary(profile: DataFrame) -> DataFrame:
    """Totals of the feature registry of a (reintegrated) profile."""
    return profile.agg(
        F.count(F.lit(1)).alias("total_columns"),
        F.count_if("is_feature").alias("features"),
        F.count_if("is_excluded").alias("excluded"),
        F.count_if("is_reintegrated").alias("reintegrated"),
        F.count_if(F.col("risk_level") == "élevé").alias("high_risk"),
    )
