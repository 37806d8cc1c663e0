"""Column roles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.catalog.base import query, table
from tabwright.operators import profile as P
from tabwright.session import materialise

_WORDS = ", ".join(f"'{w}'" for w in P.LABEL_VALUES)
_COLUMNS = {
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
                 "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "labels": ["doc_id", "quality", "toxic"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
}


def _any(words, column):
    return " OR ".join(f"contains({column}, '{w}')" for w in words)


def profile_sql(name: str, columns: list[str], source: str | None = None) -> str:
    """The role rules as SQL over one aggregate per column."""
    source = source or name
    parts = " UNION ALL ".join(
        f"""SELECT {i} AS column_index, '{c}' AS "column", count(*) AS n_rows, count(*) - count({c}) AS null_count,
        count(DISTINCT {c}) AS d, any_value(typeof({c})) AS kind,
        coalesce(bool_or(lower(trim(CAST({c} AS VARCHAR))) IN ({_WORDS})), false) AS typical,
        coalesce(avg(CASE WHEN regexp_full_match(trim(CAST({c} AS VARCHAR)), '(\\d{{4}}[-/]\\d{{1,2}}[-/]\\d{{1,2}}|\\d{{1,2}}[-/]\\d{{1,2}}[-/]\\d{{4}}|\\d{{4}}[-/]\\d{{1,2}})')
          THEN 1.0 ELSE 0.0 END), 0) AS shaped,
        {str(i == len(columns) - 1).lower()} AS is_last FROM {source}"""
        for i, c in enumerate(columns)
    )
    return f"""
WITH raw AS ({parts}),
typed AS (SELECT *, kind IN ('BIGINT', 'INTEGER', 'DOUBLE', 'FLOAT') AS is_numeric,
  kind = 'TIMESTAMP' OR (kind = 'VARCHAR' AND shaped >= 0.8) AS is_date FROM raw),
roles AS (SELECT *, kind = 'VARCHAR' AND NOT is_date AS is_categorical,
  (ends_with("column", '_id') OR "column" = 'id' OR contains("column", 'uuid') OR contains("column", 'identifier')
   OR (n_rows > 20 AND d / n_rows > 0.95)) AS is_id,
  CAST((CASE WHEN {_any(P.LABEL_WORDS, '"column"')} THEN 3 ELSE 0 END)
  + (CASE WHEN d <= 2 THEN 2 WHEN d <= 10 THEN 1 ELSE 0 END) + (CASE WHEN d / n_rows < 0.05 THEN 1 ELSE 0 END)
  + CAST(is_last AS INTEGER) + CAST(typical AS INTEGER) AS INTEGER) AS label_score FROM typed),
flags AS (SELECT *, label_score >= 3 AS is_label FROM roles)
SELECT column_index, "column", n_rows, null_count, is_numeric, is_categorical, is_date, is_id, label_score, is_label,
  is_id OR is_label AS is_excluded, NOT (is_id OR is_label) AS is_feature,
  CASE WHEN is_id THEN 'id' WHEN is_label THEN 'label' WHEN is_date THEN 'date' WHEN is_numeric THEN 'numeric'
       WHEN is_categorical THEN 'categorical' ELSE 'unknown' END AS feature_type,
  CASE WHEN is_id OR is_label THEN 'élevé' WHEN is_date THEN 'moyen' WHEN is_numeric OR is_categorical THEN 'faible'
       ELSE 'moyen' END AS risk_level
FROM flags"""


_SHOWN = [
    "column_index", "column", "n_rows", "null_count", "is_numeric", "is_categorical", "is_date", "is_id", "label_score",
    "is_label", "is_excluded", "is_feature", "feature_type", "risk_level",
]


def _profile(spark, folder, name):
    return P.detect_structure(table(spark, folder, name)).frame(spark)


def _register(name):
    def run(spark, folder):
        return _profile(spark, folder, name).select(*_SHOWN)

    run.__name__ = f"profile_{name}"
    query(profile_sql(name, _COLUMNS[name]))(run)


for _name in _COLUMNS:
    _register(_name)

@query(profile_sql("lineitem", _COLUMNS["lineitem"]))
def profile_incremental(spark, folder):
    """The profile of the order lines from sketches of two halves, the first of them stored."""
    rows = table(spark, folder, "lineitem")
    first, second = (rows.filter(F.col("l_orderkey") % 2 == k) for k in (0, 1))
    merged = P.merge_sketches(materialise(P.column_sketches(first), "sketches"), P.column_sketches(second))
    return P.structure_of(merged, rows).frame(spark).select(*_SHOWN)


_TEXT_DATES = ["o_orderkey", "order_date", "slashed", "note"]
_TEXT_SOURCE = """(SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END
AS order_date, strftime(o_orderdate, '%d/%m/%Y') AS slashed, o_orderpriority AS note FROM orders)"""


@query(profile_sql("orders", _TEXT_DATES, _TEXT_SOURCE))
def profile_text_dates(spark, folder):
    """Dates held as text in two notations, one of them with gaps."""
    rows = table(spark, folder, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 10 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("order_date"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("slashed"), F.col("o_orderpriority").alias("note"),
    )
    return P.detect_structure(rows).frame(spark).select(*_SHOWN)


@query(f"""
SELECT max(n_rows) AS n_rows, count(*) AS n_columns, count(*) FILTER (is_numeric) AS n_numeric,
  count(*) FILTER (is_categorical) AS n_categorical, count(*) FILTER (is_date) AS n_dates, count(*) FILTER (is_id) AS n_ids,
  count(*) FILTER (is_label) AS n_labels, count(*) FILTER (is_excluded) AS n_excluded, count(*) FILTER (is_feature) AS n_features
FROM ({profile_sql('lineitem', _COLUMNS['lineitem'])})
""")
def structure_summary(spark, folder):
    return P.structure_summary(_profile(spark, folder, "lineitem"))


@query(f"""
SELECT p.column_index, p."column", p.label_score, d.n_distinct
FROM ({profile_sql('lineitem', _COLUMNS['lineitem'])}) p JOIN (
  {' UNION ALL '.join(f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS n_distinct FROM lineitem""" for c in _COLUMNS['lineitem'])}
  ) d ON p."column" = d."column"
WHERE p.is_label
""")
def label_candidates(spark, folder):
    return P.label_candidates(_profile(spark, folder, "lineitem")).drop("label_reasons")


@query(f"""
SELECT "column", CASE WHEN is_label THEN '{P.LABEL_REASON}' ELSE '{P.ID_REASON}' END AS exclusion_reason
FROM ({profile_sql('orders', _COLUMNS['orders'])}) WHERE is_excluded
""")
def excluded_columns(spark, folder):
    return P.exclusions(_profile(spark, folder, "orders"))


@query(f"""
SELECT w.position, w."column", coalesce(p.risk_level, 'invalide') AS risk_level,
  p."column" IS NOT NULL AND p.risk_level <> 'élevé' AS allowed,
  coalesce(p.risk_level, 'invalide') <> 'faible' AS warning
FROM (VALUES (0, 'o_custkey'), (1, 'o_orderdate'), (2, 'o_orderkey'), (3, 'nowhere')) w(position, "column")
LEFT JOIN ({profile_sql('orders', _COLUMNS['orders'])}) p ON w."column" = p."column"
""")
def requested_columns(spark, folder):
    asked = ["o_custkey", "o_orderdate", "o_orderkey", "nowhere"]
    return P.check_requested(_profile(spark, folder, "orders"), asked, warn_medium=True)


@query(f"""
SELECT count(*) AS total_columns, count(*) FILTER (is_feature OR "column" = 'o_totalprice') AS features,
  count(*) FILTER (is_excluded AND "column" <> 'o_totalprice') AS excluded, count(*) FILTER (is_excluded AND "column" = 'o_totalprice')
  AS reintegrated, count(*) FILTER (risk_level = 'élevé') AS high_risk
FROM ({profile_sql('orders', _COLUMNS['orders'])})
""")
def registry_summary(spark, folder):
    profile = _profile(spark, folder, "orders")
    return P.registry_summary(P.reintegrate(profile, ["o_totalprice", "nowhere"], allow_high_risk=True))
