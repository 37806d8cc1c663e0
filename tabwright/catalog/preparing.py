"""Preparation steps one by one, and whole preparations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.catalog.base import query, steady, table
from tabwright.catalog.relational import sparse_events
from tabwright.functions import scalars as S
from tabwright.operators import categories as K
from tabwright.operators import statistics as Z
from tabwright.operators.profile import detect_structure
from tabwright.operators.quantiles import exact_quantiles
from tabwright.plans import preparation as P
from tabwright.session import materialise, scratch_path

_STATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _steady_all(df, digits=5, keep=()):
    return df.select(*keep, *[steady(c, digits).alias(c) for c in df.columns if c not in keep])


@query("""
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m,
       CAST(day(o_orderdate) AS INTEGER) AS d, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS w FROM orders
""")
def date_parts(spark, folder):
    stamp = F.col("o_orderdate")
    return table(spark, folder, "orders").select(
        "o_orderkey", *[f(stamp).alias(n) for n, f in zip("ymdw", P.DATE_PARTS.values())]
    )


@query("""
SELECT event_id, coalesce(CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END,
  (SELECT median(value) FROM events WHERE event_id % 7 <> 0)) AS value,
  CAST(event_id % 7 = 0 AS INTEGER) AS value_missing FROM events
""")
def impute_median(spark, folder):
    rows = sparse_events(spark, folder)
    median = exact_quantiles(rows, ["value"], [0.5])["value"][0]
    return rows.select(
        "event_id", F.coalesce("value", F.lit(median)).alias("value"),
        F.col("value").isNull().cast("int").alias("value_missing"),
    )


@query("""
SELECT "column", round(s, 3) AS skewness, round(abs(s), 3) AS abs_skewness FROM (
  SELECT 'value' AS "column", skewness(value) AS s FROM events UNION ALL
  SELECT 'user_id', skewness(user_id) FROM events)
""")
def skewness_events(spark, folder):
    return Z.skewness_table(table(spark, folder, "events"), ["value", "user_id"])


@query("""
SELECT "column", round(s, 3) AS skewness, round(abs(s), 3) AS abs_skewness FROM (
  SELECT 'n_chars' AS "column", skewness(n_chars) AS s FROM documents UNION ALL
  SELECT 'doc_id', skewness(doc_id) FROM documents)
""")
def skewness_documents(spark, folder):
    return Z.skewness_table(table(spark, folder, "documents"), ["n_chars", "doc_id"])


@query("SELECT doc_id, round(ln(1 + greatest(n_chars, 0)) + 1e-9, 6) AS n_chars FROM documents")
def log1p_documents(spark, folder):
    return table(spark, folder, "documents").select("doc_id", steady(S.log1p_clipped(F.col("n_chars")), 6).alias("n_chars"))


@query("""
SELECT "column", round(s + 1e-9, 6) AS skew_before, TRUE AS peaked FROM (
  SELECT 'value' AS "column", skewness(value - 50) AS s FROM events UNION ALL SELECT 'user_id', skewness(CAST(user_id AS DOUBLE)) FROM events)
""")
def yeo_johnson_events(spark, folder):
    """Fitted lambda per column: a thousandth to either side the likelihood is lower."""
    names = ["value", "user_id"]
    rows = table(spark, folder, "events").select((F.col("value") - 50).alias("value"), F.col("user_id").cast("double").alias("user_id"))
    before, fits = Z.skew_stats(rows, names), Z.fit_yeo_johnson(rows, names)
    near = {(c, d): F.lit(fits[c]["lambda"] + d) for c in names for d in (-1e-3, 0.0, 1e-3)}
    height = {
        k: (-F.count(k[0]) / 2 * F.log(F.var_pop(S.yeo_johnson_at(F.col(k[0]), lam))) + (lam - 1) * F.sum(F.signum(k[0]) * F.log1p(F.abs(k[0])))).alias(f"h{i}")
        for i, (k, lam) in enumerate(near.items())
    }
    found = dict(zip(near, rows.agg(*height.values()).first()))
    done = [
        (c, before[c]["skew"], found[c, 0.0] >= max(found[c, -1e-3], found[c, 1e-3]))
        for c in names
    ]
    return spark.createDataFrame(done, "column string, skew_before double, peaked boolean").withColumn("skew_before", steady("skew_before", 6))


@query("""
SELECT event_id, round(CASE WHEN value - 50 >= 0 THEN (pow(value - 49, 0.4) - 1) / 0.4
       ELSE -(pow(51 - value, 1.6) - 1) / 1.6 END + 1e-9, 6) AS value FROM events
""")
def yeo_johnson_fixed(spark, folder):
    return table(spark, folder, "events").select(
        "event_id", steady(S.yeo_johnson(F.col("value") - 50, 0.4), 6).alias("value")
    )


def _outlier_sql(column, source):
    return f"""
SELECT '{column}' AS "column", round(lo + 1e-9, 3) AS lower_bound, round(hi + 1e-9, 3) AS upper_bound,
  count(*) FILTER ({column} < lo OR {column} > hi) AS outlier_count,
  round(count(*) FILTER ({column} < lo OR {column} > hi) * 100.0 / count(*) + 1e-9, 2) AS outlier_ratio,
  CASE WHEN count(*) FILTER ({column} < lo OR {column} > hi) * 100.0 / count(*) > 15 THEN 'Flagged only - delegated to Isolation Forest'
       WHEN count(*) FILTER ({column} < lo OR {column} > hi) * 100.0 / count(*) >= 5 THEN 'Winsorized'
       ELSE 'None' END AS action
FROM {source}, (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (
  SELECT quantile_cont(CAST({column} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({column} AS DOUBLE), 0.75) AS q3 FROM {source}))
GROUP BY lo, hi"""


def _outliers(spark, rows, columns):
    found, treated = Z.outliers(rows, exact_quantiles(rows, columns, [0.25, 0.5, 0.75]), rows.count())
    named = {r["column"]: treated[r["column"]] for r in found}
    report = spark.createDataFrame(
        [(r["column"], named[r["column"]]["lower"], named[r["column"]]["upper"], r["outlier_count"], named[r["column"]]["ratio"],
          named[r["column"]]["action"]) for r in found],
        "column string, lower_bound double, upper_bound double, outlier_count long, outlier_ratio double, action string",
    )
    return report.withColumns({c: steady(c, d) for c, d in (("lower_bound", 3), ("upper_bound", 3), ("outlier_ratio", 2))})


@query(" UNION ALL ".join(_outlier_sql(c, "lineitem") for c in _STATS))
def outliers_lineitem(spark, folder):
    return _outliers(spark, table(spark, folder, "lineitem"), _STATS)


@query(_outlier_sql("n_chars", "documents") + " UNION ALL " + _outlier_sql("value", "events"))
def outliers_skewed(spark, folder):
    return _outliers(spark, table(spark, folder, "documents"), ["n_chars"]).unionByName(
        _outliers(spark, table(spark, folder, "events"), ["value"])
    )


@query("""
SELECT doc_id, least(greatest(CAST(n_chars AS DOUBLE), q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)) AS n_chars
FROM documents, (SELECT quantile_cont(CAST(n_chars AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(n_chars AS DOUBLE), 0.75) AS q3
                 FROM documents)
""")
def winsorise_documents(spark, folder):
    rows = table(spark, folder, "documents")
    q1, q3 = exact_quantiles(rows, ["n_chars"], [0.25, 0.75])["n_chars"]
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    return rows.select("doc_id", S.clip(F.col("n_chars").cast("double"), low, high).alias("n_chars"))


_DIRTY = ("CASE WHEN event_id % 5 = 0 THEN upper(event_type) || '!' WHEN event_id % 7 = 0 THEN ' É' || event_type "
          "ELSE event_type END")
_CLEAN = "trim(regexp_replace(strip_accents(lower(event_type)), '[^a-zA-Z0-9]+', ' ', 'g'))"


@query(f"""
SELECT 'event_type' AS "column", {_CLEAN} AS value, {_CLEAN} AS corrected,
       CAST(dense_rank() OVER (ORDER BY {_CLEAN}) - 1 AS BIGINT) AS code
FROM (SELECT {_DIRTY} AS event_type FROM events) GROUP BY {_CLEAN}
""")
def category_codes(spark, folder):
    rows = table(spark, folder, "events").selectExpr(f"{_DIRTY} AS event_type")
    counts = materialise(K.category_counts(rows, ["event_type"]), "counts")
    references = K.reference_values(counts)
    return K.encode(K.standardise(counts, K.corrections(counts, references, 0.95)))


@query()
def category_corrections(spark, folder):
    """Rare misspellings of part names, each corrected to a frequent spelling."""
    rows = table(spark, folder, "part").select(
        F.when(F.col("p_partkey") % 97 == 0, F.concat(F.col("p_name"), F.hex(F.col("p_partkey"))))
        .otherwise(F.col("p_name")).alias("p_name"),
        F.when(F.col("p_partkey") % 89 == 0, F.regexp_replace("p_brand", "r", F.hex(F.col("p_partkey"))))
        .otherwise(F.col("p_brand")).alias("p_brand"),
    )
    counts = materialise(K.category_counts(rows, ["p_name", "p_brand"]), "counts")
    return K.corrections(counts, K.reference_values(counts, 3), 0.8)


@query("""
SELECT p_partkey, round((p_size - (SELECT avg(p_size) FROM part)) / (SELECT stddev_pop(p_size) FROM part) + 1e-9, 6) AS p_size,
  round((p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (SELECT stddev_pop(p_retailprice) FROM part) + 1e-9, 6)
  AS p_retailprice FROM part
""")
def scale_standard(spark, folder):
    rows = table(spark, folder, "part").select("p_partkey", "p_size", "p_retailprice")
    moments, _ = Z.moments_and_correlation(rows, ["p_size", "p_retailprice"])
    return rows.select(
        "p_partkey", *[steady(Z.scale_expr(F.col(c), m["mean"], m["std"]), 6).alias(c) for c, m in moments.items()]
    )


@query("""
SELECT doc_id, round((n_chars - m) / (q3 - q1) + 1e-9, 6) AS n_chars FROM documents,
 (SELECT quantile_cont(CAST(n_chars AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(n_chars AS DOUBLE), 0.5) AS m,
         quantile_cont(CAST(n_chars AS DOUBLE), 0.75) AS q3 FROM documents)
""")
def scale_robust(spark, folder):
    rows = table(spark, folder, "documents")
    q1, q2, q3 = exact_quantiles(rows, ["n_chars"], [0.25, 0.5, 0.75])["n_chars"]
    return rows.select("doc_id", steady(Z.scale_expr(F.col("n_chars"), q2, q3 - q1), 6).alias("n_chars"))


_PAIRS = [(a, b) for i, a in enumerate(_STATS) for b in _STATS[i + 1 :]]


@query(" UNION ALL ".join(
    f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", round(corr({a}, {b}) + 1e-9, 6) AS correlation FROM lineitem"
    for a, b in _PAIRS))
def correlation_lineitem(spark, folder):
    return Z.correlation_table(table(spark, folder, "lineitem"), _STATS).withColumn("correlation", steady("correlation", 6))


_DERIVED = {"q": "l_quantity", "q2": "l_quantity * 2 + l_tax", "price": "l_extendedprice", "one": "CAST(1 AS DOUBLE)",
            "d": "l_discount - 0.2 * l_discount"}


@query("""
WITH d AS (SELECT l_quantity AS q, l_quantity * 2 + l_tax AS q2, l_extendedprice AS price, 1 AS one, l_discount * 0.8 AS d FROM lineitem)
SELECT 'one' AS "column", 'constant' AS reason FROM d HAVING var_pop(one) = 0
UNION ALL SELECT 'q2', 'correlated' FROM d HAVING abs(corr(q, q2)) > 0.9
UNION ALL SELECT 'price', 'correlated' FROM d HAVING abs(corr(q, price)) > 0.9 OR abs(corr(q2, price)) > 0.9
""")
def dropped_features(spark, folder):
    """Constant columns and columns too close to an earlier one."""
    rows = table(spark, folder, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in _DERIVED.items()])
    moments, corr = Z.moments_and_correlation(rows, rows.columns)
    flat = [c for c in rows.columns if moments[c]["min"] == moments[c]["max"]]
    kept = [c for c in rows.columns if c not in flat]
    close = Z.correlated(kept, corr, 0.9)
    return spark.createDataFrame(
        [(c, "constant") for c in flat] + [(c, "correlated") for c in close], "column string, reason string"
    )


def _z(expr, source):
    """Standard scaling as SQL over a subquery that names the raw columns."""
    return ", ".join(
        f"round(({e} - (SELECT avg({e}) FROM {source})) / (SELECT stddev_pop({e}) FROM {source}) + 1e-9, 5) AS {n}"
        for n, e in expr.items()
    )


_PARTS = {
    "year": "CAST(year({c}) AS DOUBLE)", "month": "CAST(month({c}) AS DOUBLE)", "day": "CAST(day({c}) AS DOUBLE)",
    "dayofweek": "CAST(isodow({c}) - 1 AS DOUBLE)",
}


def _date_exprs(column):
    return {f"{column}_{p}": e.format(c=column) for p, e in _PARTS.items()}


@query(f"SELECT {_z({'o_custkey': 'o_custkey', **_date_exprs('o_orderdate')}, 'orders')}, o_orderstatus FROM orders")
def prepare_orders(spark, folder):
    """Fit on the whole table: ids and labels out, dates expanded, standard scaling."""
    done = P.fit(table(spark, folder, "orders"))
    return _steady_all(done.labelled, keep=["o_orderstatus"])


def _code(column, source):
    clean = f"trim(regexp_replace(lower({column}), '[^a-zA-Z0-9]+', ' ', 'g'))"
    return f"(dense_rank() OVER (ORDER BY {clean}) - 1)"


_PART_SOURCE = f"""(SELECT {', '.join(f"{_code(c, 'part')} AS {c}" for c in ('p_name', 'p_brand', 'p_type'))}, p_size, p_retailprice
FROM part)"""


_PART_COLUMNS = ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


_PART_SQL = f"WITH s AS {_PART_SOURCE} SELECT {_z({c: c for c in _PART_COLUMNS}, 's')} FROM s"


@query(_PART_SQL)
def prepare_part(spark, folder):
    """Three text columns encoded, two numbers, all scaled."""
    return _steady_all(P.fit(table(spark, folder, "part"), keep=_PART_COLUMNS, allow_high_risk=True, min_frequency=1).features)


_LINE_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_shipdate"]


_LINE_SQL = f"""
WITH s AS (SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_discount, l_tax,
  {_code('l_returnflag', 'lineitem')} AS l_returnflag, l_shipdate FROM (SELECT DISTINCT * FROM lineitem))
SELECT {_z({**{c: c for c in ('l_orderkey', 'l_partkey', 'l_suppkey', 'l_quantity', 'l_discount', 'l_tax', 'l_returnflag')},
            **_date_exprs('l_shipdate')}, 's')} FROM s"""


@query(_LINE_SQL)
def prepare_lineitem(spark, folder):
    return _steady_all(P.fit(table(spark, folder, "lineitem"), keep=_LINE_COLUMNS, allow_high_risk=True).features)


@query("""
WITH base AS (SELECT DISTINCT CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value,
                CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS event_type, user_id % 13 AS grp FROM events),
m AS (SELECT median(value) AS med FROM base),
f AS (SELECT ln(1 + coalesce(value, med)) AS value, coalesce(event_type, 'unknown') AS event_type, grp,
        CAST(value IS NULL AS INTEGER) AS value_missing, CAST(event_type IS NULL AS INTEGER) AS event_type_missing FROM base, m),
s AS (SELECT value, dense_rank() OVER (ORDER BY event_type) - 1 AS event_type, grp,
        CASE WHEN (SELECT abs(skewness(value_missing)) FROM f) >= 1
              AND (SELECT abs(skewness(ln(1 + value_missing))) < abs(skewness(value_missing)) FROM f)
             THEN ln(1 + value_missing) ELSE value_missing END AS value_missing, event_type_missing FROM f)
SELECT round((value - (SELECT avg(value) FROM s)) / (SELECT stddev_pop(value) FROM s) + 1e-9, 5) AS value,
 round((event_type - (SELECT avg(event_type) FROM s)) / (SELECT stddev_pop(event_type) FROM s) + 1e-9, 5) AS event_type,
 round((grp - (SELECT avg(grp) FROM s)) / (SELECT stddev_pop(grp) FROM s) + 1e-9, 5) AS grp,
 round((value_missing - (SELECT avg(value_missing) FROM s)) / (SELECT stddev_pop(value_missing) FROM s) + 1e-9, 5) AS value_missing,
 round((event_type_missing - (SELECT avg(event_type_missing) FROM s)) / (SELECT stddev_pop(event_type_missing) FROM s) + 1e-9, 5)
   AS event_type_missing FROM s
""")
def prepare_sparse_events(spark, folder):
    """Missing numbers and categories: medians, indicators, log1p of a skewed column."""
    rows = sparse_events(spark, folder).select("value", "event_type", (F.col("user_id") % 13).alias("grp"))
    structure = detect_structure(rows.withColumn("grp", F.col("grp")))
    structure.profile = [
        {**p, "is_label": False, "is_excluded": False, "is_feature": True, "is_id": False} for p in structure.profile
    ]
    return _steady_all(P.fit(rows, structure).features)


@query(f"""
WITH old AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'),
new AS (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01')
SELECT {', '.join(
    f"round(({e} - (SELECT avg({e}) FROM old)) / (SELECT stddev_pop({e}) FROM old) + 1e-9, 5) AS {n}"
    for n, e in {'o_custkey': 'o_custkey', **_date_exprs('o_orderdate')}.items())} FROM new
""")
def replay_orders(spark, folder):
    """Fit on the orders before 1998, replay on the later ones."""
    orders = table(spark, folder, "orders")
    done = P.fit(orders.filter(F.col("o_orderdate") < "1998-01-01"))
    return _steady_all(P.transform(orders.filter(F.col("o_orderdate") >= "1998-01-01"), done.state))


@query("SELECT count(*) AS n, TRUE AS complete FROM (SELECT DISTINCT * FROM documents)")
def prepare_documents(spark, folder):
    """Whole texts as a category, with a skewed length: one row of numbers per different document, none missing."""
    features = P.fit(table(spark, folder, "documents")).features
    names = [f.name for f in features.schema.fields if f.dataType.typeName() in ("double", "float", "integer", "long")]
    complete = F.lit(True)
    for c in names:
        complete = complete & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return features.agg(F.count(F.lit(1)).alias("n"), F.bool_and(complete).alias("complete"))


@query()
def preparation_report(spark, folder):
    return P.fit(table(spark, folder, "part")).report()


@query(" UNION ALL ".join(
    f"SELECT '{name}' AS \"table\", CASE WHEN outlier_ratio >= 5 THEN 'RobustScaler' ELSE 'StandardScaler' END AS scaler FROM ({_outlier_sql(column, name)})"
    for name, column in (("documents", "n_chars"), ("lineitem", "l_extendedprice"))
))
def scaler_by_outliers(spark, folder):
    """The scaler that follows from the share of outliers, robust and standard."""
    found = []
    for name, column in (("documents", "n_chars"), ("lineitem", "l_extendedprice")):
        rows = table(spark, folder, name)
        report, _ = Z.outliers(rows, exact_quantiles(rows, [column], [0.25, 0.5, 0.75]), rows.count())
        found.append((name, Z.choose_scaler([r["outlier_ratio"] for r in report])))
    return spark.createDataFrame(found, "table string, scaler string")


@query("""
SELECT 'rare' AS "column", round(100.0 * count(*) FILTER (event_id % 5 <> 0) / count(*), 2) AS missing_percentage,
  100.0 * count(*) FILTER (event_id % 5 <> 0) / count(*) > 60 AS dropped FROM events
""")
def sparse_column_dropped(spark, folder):
    """A column missing in four fifths of the rows is left out of the features."""
    rows = table(spark, folder, "events").select("event_id", "value", "event_type", F.when(F.col("event_id") % 5 == 0, F.col("value") * 2 + F.col("user_id")).alias("rare"))
    fit = P.fit(rows)
    missing = rows.agg(F.round(100.0 * F.count_if(F.col("rare").isNull()) / F.count(F.lit(1)), 2)).first()[0]
    return spark.createDataFrame([("rare", missing, "rare" in fit.state.dropped_sparse and "rare" not in fit.features.columns)], "column string, missing_percentage double, dropped boolean")


@query("SELECT count(*) AS n, TRUE AS same_columns FROM (SELECT DISTINCT p_partkey, p_size, p_retailprice, p_brand FROM part)")
def prepare_by_mode(spark, folder):
    """Fitting and replaying by name give the same columns; a replay keeps every different row."""
    rows = table(spark, folder, "part").select("p_partkey", "p_size", "p_retailprice", "p_brand")
    fit = P.prepare(rows, "fit")
    again = P.prepare(rows, "transform", fit.state)
    same = [c for c in fit.features.columns if c in again.columns] == again.columns
    return again.agg(F.count(F.lit(1)).alias("n")).select("n", F.lit(same).alias("same_columns"))


@query("SELECT 'StandardScaler' AS scaler, CAST(0 AS BIGINT) AS notable_columns, CAST(5 AS BIGINT) AS n_columns, CAST(0 AS DOUBLE) AS notable_pct FROM orders LIMIT 1")
def scaler_choice(spark, folder):
    return P.scaler_evidence(spark, P.fit(table(spark, folder, "orders")).state)


@query("SELECT p_partkey, p_size, p_retailprice FROM part")
def real_values(spark, folder):
    """Scaled values taken back to their own units."""
    rows = table(spark, folder, "part").select("p_partkey", "p_size", "p_retailprice")
    moments, _ = Z.moments_and_correlation(rows, ["p_size", "p_retailprice"])
    state = P.PrepState(
        centers={c: m["mean"] for c, m in moments.items()}, scales={c: m["std"] for c, m in moments.items()}
    )
    scaled = rows.select("p_partkey", *[Z.scale_expr(F.col(c), m["mean"], m["std"]).alias(c) for c, m in moments.items()])
    return scaled.select(
        "p_partkey", P.real_value(F.col("p_size"), "p_size", state).cast("int").alias("p_size"),
        P.real_value(F.col("p_retailprice"), "p_retailprice", state).alias("p_retailprice"),
    )


@query(_PART_SQL)
def stored_state_replay(spark, folder):
    """Fit, store the state, load it and replay it on the same table."""
    parts = table(spark, folder, "part")
    path = scratch_path(spark, "state")
    P.fit(parts, keep=_PART_COLUMNS, allow_high_risk=True, min_frequency=1).state.save(spark, path)
    return _steady_all(P.transform(parts, P.PrepState.load(spark, path)))
