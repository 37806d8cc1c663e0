"""Sources, columns, joins and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.catalog.base import query, steady, table
from tabwright.functions.text import invalid_to_null, normalise_value
from tabwright.operators import aggregates as G
from tabwright.operators import columns as C
from tabwright.operators import integrate as J
from tabwright.operators.ranking import number_rows, top_n
from tabwright.operators.sampling import sample_rows
from tabwright.session import materialise, scratch_path, spread
from tabwright.sources import readers, writers

SPARSE_EVENTS = [
    "event_id", "user_id", "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value",
    "CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS event_type",
    "CASE WHEN event_id % 4 = 0 THEN props END AS props",
]
_SPARSE_SQL = f"(SELECT {', '.join(SPARSE_EVENTS)} FROM events)"


def sparse_events(spark, folder):
    """Events with values missing by a fixed rule; every row is kept."""
    return table(spark, folder, "events").selectExpr(*SPARSE_EVENTS)


def customer_orders(spark, folder):
    return J.unify(
        {"customers": table(spark, folder, "customer"), "orders": table(spark, folder, "orders")},
        {
            "mappings": {"customers": {"c_custkey": "customer_id"}, "orders": {"o_custkey": "customer_id"}},
            "events": {
                "orders": {
                    "group_key": "customer_id",
                    "aggregations": {"o_totalprice": ["sum", "mean"], "o_orderkey": ["count"]},
                }
            },
        },
    )


@query("""
SELECT c_custkey AS customer_id, c_name, c_nationkey, c_acctbal, c_mktsegment,
       round(o_totalprice_sum + 1e-9, 2) AS o_totalprice_sum, round(o_totalprice_mean + 1e-9, 4) AS o_totalprice_mean,
       o_orderkey_count
FROM customer LEFT JOIN (
  SELECT o_custkey, coalesce(sum(o_totalprice), 0) AS o_totalprice_sum, avg(o_totalprice) AS o_totalprice_mean,
         count(o_orderkey) AS o_orderkey_count
  FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1) o ON c_custkey IS NOT DISTINCT FROM o_custkey
""")
def unify_customer_orders(spark, folder):
    unified = customer_orders(spark, folder)
    return unified.withColumn("o_totalprice_sum", steady("o_totalprice_sum", 2)).withColumn(
        "o_totalprice_mean", steady("o_totalprice_mean", 4)
    )


@query("""
SELECT s.k AS nation_key, s.s_suppkey, n.n_name
FROM (SELECT CASE WHEN s_nationkey % 5 = 0 THEN NULL ELSE s_nationkey END AS k, s_suppkey FROM supplier) s
LEFT JOIN (SELECT CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_nationkey END AS k, n_name FROM nation) n
ON s.k IS NOT DISTINCT FROM n.k
""")
def join_null_keys(spark, folder):
    left = table(spark, folder, "supplier").selectExpr(
        "CASE WHEN s_nationkey % 5 = 0 THEN NULL ELSE s_nationkey END AS nation_key", "s_suppkey"
    )
    right = table(spark, folder, "nation").selectExpr(
        "CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_nationkey END AS nation_key", "n_name"
    )
    return J.merge_sources({"supplier": left, "nation": right}, "nation_key")


def _users_and_labels(spark, folder):
    labels = table(spark, folder, "labels").withColumnRenamed("doc_id", "client_id")
    users = table(spark, folder, "events").groupBy(F.col("user_id").alias("client_id")).agg(
        F.count(F.lit(1)).alias("quality"), F.round(F.max("value"), 4).alias("top_value")
    )
    return {"labels": labels, "events": users}


_USERS = "(SELECT user_id, count(*) AS quality, round(max(value), 4) AS top_value FROM events GROUP BY user_id)"


@query(f"""
SELECT coalesce(doc_id, user_id) AS client_id, l.quality, l.toxic, u.quality AS quality_events, u.top_value
FROM labels l FULL JOIN {_USERS} u ON doc_id = user_id
""")
def join_outer_suffix(spark, folder):
    return J.merge_sources(_users_and_labels(spark, folder), "client_id", "outer")


@query(f"""
SELECT user_id AS client_id, l.quality, l.toxic, u.quality AS quality_events, u.top_value
FROM labels l RIGHT JOIN {_USERS} u ON doc_id = user_id
""")
def join_right_suffix(spark, folder):
    return J.merge_sources(_users_and_labels(spark, folder), "client_id", "right")


@query(f"""
SELECT user_id AS client_id, l.quality, l.toxic, u.quality AS quality_events, u.top_value
FROM labels l JOIN {_USERS} u ON doc_id = user_id
""")
def join_inner_suffix(spark, folder):
    return J.merge_sources(_users_and_labels(spark, folder), "client_id", "inner")


@query("""
SELECT user_id, round(coalesce(sum(value), 0) + 1e-9, 4) AS value_sum, round(avg(value) + 1e-9, 6) AS value_mean,
       count(value) AS value_count, count(*) AS value_size, min(value) AS value_min, max(value) AS value_max,
       round(median(value) + 1e-9, 6) AS value_median, round(stddev_samp(value) + 1e-9, 6) AS value_std,
       round(var_samp(value) + 1e-9, 4) AS value_var, count(DISTINCT value) AS value_nunique,
       arg_min(value, ts) AS value_first, arg_max(value, ts) AS value_last
FROM events WHERE user_id IS NOT NULL GROUP BY user_id
""")
def aggregate_events_all(spark, folder):
    funcs = ["sum", "mean", "count", "size", "min", "max", "median", "std", "var", "nunique", "first", "last"]
    out = J.aggregate_events(table(spark, folder, "events"), "user_id", {"value": funcs}, order_by="ts")
    digits = {"value_sum": 4, "value_mean": 6, "value_median": 6, "value_std": 6, "value_var": 4}
    return out.select(*[steady(c, digits[c]).alias(c) if c in digits else F.col(c) for c in out.columns])


@query("""
SELECT o_orderkey, o_custkey, o_totalprice FROM orders n WHERE o_orderdate >= TIMESTAMP '1997-01-01'
AND NOT EXISTS (SELECT 1 FROM orders t WHERE t.o_orderdate < TIMESTAMP '1999-01-01' AND t.o_orderkey = n.o_orderkey)
""")
def append_new_orders(spark, folder):
    orders = table(spark, folder, "orders")
    target = orders.filter(F.col("o_orderdate") < "1999-01-01")
    pending = orders.filter(F.col("o_orderdate") >= "1997-01-01")
    return J.new_rows(target, pending, "o_orderkey").select("o_orderkey", "o_custkey", "o_totalprice")


@query("""
SELECT b AS rows_before, n - b AS rows_inserted, n AS rows_after, round((n - b) * 100.0 / b, 2) AS growth_pct
FROM (SELECT count(*) FILTER (o_orderdate < TIMESTAMP '1999-01-01') AS b, count(*) AS n FROM orders)
""")
def append_report(spark, folder):
    orders = table(spark, folder, "orders")
    target = orders.filter(F.col("o_orderdate") < "1999-01-01")
    pending = orders.filter(F.col("o_orderdate") >= "1997-01-01")
    return J.append_report(target, J.new_rows(target, pending, "o_orderkey"))


@query("""
SELECT o_orderkey, o_custkey, n AS transaction_id,
       CASE WHEN n <= 100 THEN 'target' WHEN n <= 150 THEN 'pending' ELSE 'rest' END AS part
FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS n FROM orders)
""")
def number_and_split(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    n = F.col("transaction_id")
    return number_rows(orders, ["o_orderdate", "o_orderkey"], "transaction_id", repeated_rows=True).select(
        "o_orderkey", "o_custkey", "transaction_id",
        F.when(n <= 100, "target").when(n <= 150, "pending").otherwise("rest").alias("part"),
    )


@query(f"""
SELECT 'events' AS source, count(*) AS n_rows, CAST(5 AS BIGINT) AS n_columns,
       CAST(count(*) * 5 - count(event_id) - count(user_id) - count(value) - count(event_type) - count(props) AS BIGINT)
         AS missing_values,
       CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {_SPARSE_SQL})) AS BIGINT) AS duplicate_rows
FROM {_SPARSE_SQL}
""")
def dataset_info(spark, folder):
    return G.dataset_info(sparse_events(spark, folder), "events").drop("columns")


def _info_sql(name, columns):
    row = ", ".join(columns)
    return f"""SELECT '{name}' AS source, count(*) AS n_rows, CAST({len(columns)} AS BIGINT) AS n_columns,
    (SELECT count(*) FROM {name}) - (SELECT count(*) FROM (SELECT DISTINCT {row} FROM {name})) AS duplicate_rows
    FROM {name}"""


_INFO = {
    "labels": ["quality", "toxic"], "documents": ["text", "lang", "source"],
    "conversations": ["role", "text"], "pages": ["url", "html"],
}


@query(" UNION ALL ".join(_info_sql(n, c) for n, c in _INFO.items()))
def datasets_info(spark, folder):
    frames = {n: table(spark, folder, n).select(*c) for n, c in _INFO.items()}
    return G.datasets_info(frames).select("source", "n_rows", "n_columns", "duplicate_rows")


@query(f"""
SELECT column_index, "column", n_rows, null_count, CAST(0 AS BIGINT) AS duplicate_rows, CAST(5 AS BIGINT) AS n_columns FROM (
  SELECT {', '.join(f"(SELECT count(*) - count({c}) FROM {_SPARSE_SQL}) AS c{i}" for i, c in
                    enumerate(['event_id', 'user_id', 'value', 'event_type', 'props']))},
         (SELECT count(*) FROM events) AS n_rows)
CROSS JOIN LATERAL (VALUES (0, 'event_id', c0), (1, 'user_id', c1), (2, 'value', c2), (3, 'event_type', c3),
  (4, 'props', c4)) t(column_index, "column", null_count)
""")
def integration_report(spark, folder):
    return G.integration_report(sparse_events(spark, folder))


@query(f"""
SELECT * FROM (
  SELECT 'value' AS "column", count(*) - count(value) AS missing_count,
         round((count(*) - count(value)) * 100.0 / count(*), 2) AS missing_percentage FROM {_SPARSE_SQL}
  UNION ALL SELECT 'event_type', count(*) - count(event_type),
         round((count(*) - count(event_type)) * 100.0 / count(*), 2) FROM {_SPARSE_SQL}
  UNION ALL SELECT 'props', count(*) - count(props), round((count(*) - count(props)) * 100.0 / count(*), 2)
  FROM {_SPARSE_SQL})
""")
def missing_report(spark, folder):
    return G.missing_report(sparse_events(spark, folder))


@query(f"""
SELECT CAST(3 AS BIGINT) AS columns_with_missing, round((count(*) - count(props)) * 100.0 / count(*), 2) AS max_missing_percentage
FROM {_SPARSE_SQL}
""")
def missing_summary(spark, folder):
    return G.missing_summary(sparse_events(spark, folder))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def value_counts(spark, folder):
    return G.value_counts(table(spark, folder, "events"), "event_type")


_LINE = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
]


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM lineitem" for c in _LINE))
def distinct_counts(spark, folder):
    return G.distinct_counts(table(spark, folder, "lineitem"), _LINE)


@query("""
SELECT o_orderkey AS cle_client_no, CAST(o_custkey AS VARCHAR) AS user_id, CAST(trunc(o_totalprice) AS BIGINT) AS montant,
       CAST(o_orderdate AS TIMESTAMP) AS jour FROM orders
""")
def standardise_source(spark, folder):
    """Odd names, a rename, casts of text numbers and text dates, a repeated column."""
    raw = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias(" Clé  Client-(N°o) "), F.col("o_custkey").alias("ID_User"),
        F.col("o_totalprice").cast("string").alias("Montant"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("Jour"),
        F.col("o_orderstatus").alias("montant "),
    )
    return C.standardise_source(
        raw, {"id_user": "user_id", "cle_clientno": "cle_client_no"}, {"user_id": "str", "montant": "int", "jour": "datetime"}
    )


@query("SELECT DISTINCT event_type, user_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE user_id % 3 END AS grp FROM events")
def clean_rows(spark, folder):
    rows = table(spark, folder, "events").selectExpr(
        "event_type", "user_id", "CASE WHEN event_id % 7 = 0 THEN NULL ELSE user_id % 3 END AS grp",
        "CAST(NULL AS STRING) AS nothing",
    )
    return C.clean(rows)


@query("""
SELECT CAST(event_id AS DOUBLE) AS event_id, CAST(user_id AS DOUBLE) AS user_id,
       CASE WHEN event_id % 7 = 0 OR event_id % 5 = 0 THEN 0.0 ELSE value END AS value FROM events
""")
def numeric_matrix(spark, folder):
    rows = table(spark, folder, "events").selectExpr(
        "event_id", "user_id",
        "CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 5 = 0 THEN double('Infinity') ELSE value END AS value",
        "event_type",
    )
    return C.numeric_matrix(rows)


@query("SELECT o_totalprice, o_custkey, CAST(0 AS DOUBLE) AS extra FROM orders")
def align_columns(spark, folder):
    return C.align_columns(table(spark, folder, "orders"), ["o_totalprice", "o_custkey", "extra"])


@query("""
SELECT doc_id, lang, md5(w) AS words_md5, length(w) AS n FROM (
  SELECT doc_id, lang, CASE WHEN w IN ('', 'nan', 'none', 'null', 'na') THEN 'unknown' ELSE w END AS w FROM (
    SELECT doc_id, lang, trim(regexp_replace(strip_accents(lower(text)), '[^a-zA-Z0-9]+', ' ', 'g')) AS w FROM documents))
""")
def normalise_values(spark, folder):
    words = normalise_value("text")
    documents = spread(table(spark, folder, "documents").select("doc_id", "lang", "text"))
    return documents.select("doc_id", "lang", words.alias("w")).select(
        "doc_id", "lang", F.md5("w").alias("words_md5"), F.length("w").cast("long").alias("n")
    )


@query("""
SELECT event_id, CASE WHEN event_id % 6 = 0 THEN NULL ELSE event_type END AS event_type FROM events
""")
def invalid_words(spark, folder):
    rows = table(spark, folder, "events").selectExpr(
        "event_id", "CASE WHEN event_id % 6 = 0 THEN element_at(array('NA', 'n/a', '', 'None', 'null'), "
        "int(event_id % 5) + 1) ELSE event_type END AS event_type"
    )
    return rows.select("event_id", invalid_to_null("event_type").alias("event_type"))


@query("SELECT * FROM events ORDER BY value DESC, event_id LIMIT 50")
def top_values(spark, folder):
    return top_n(table(spark, folder, "events"), 50, "value", ["event_id"])


@query("SELECT event_id, ts, event_type FROM events ORDER BY event_id DESC LIMIT 10")
def preview_last(spark, folder):
    return table(spark, folder, "events").orderBy(F.desc("event_id")).limit(10).select("event_id", "ts", "event_type")


@query("""
SELECT n_name, count(*) AS n_customers, round(avg(c_acctbal), 4) AS balance
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name
""")
def sql_source(spark, folder):
    text = """SELECT n_name, count(*) AS n_customers, round(avg(c_acctbal), 4) AS balance
              FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"""
    return readers.read_source(spark, " SQL ", folder, text)


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders")
def csv_round_trip(spark, folder):
    """Write a table as CSV with spelled-out nulls and read it back with inferred types."""
    path = scratch_path(spark, "orders-csv")
    rows = table(spark, folder, "orders").selectExpr(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
        "CASE WHEN o_orderkey % 9 = 0 THEN element_at(array('NA', 'N/A', 'null'), int(o_orderkey % 3) + 1) "
        "ELSE o_orderpriority END AS o_orderpriority",
    )
    writers.write_csv(rows, path)
    return readers.read_csv(spark, path)


@query("SELECT doc_id, length(text) AS length, sha256(text) AS digest, lang FROM documents")
def csv_line_breaks(spark, folder):
    """Texts with quotes and line breaks, written as CSV and read back in splits."""
    path = scratch_path(spark, "documents-csv")
    rows = table(spark, folder, "documents").select("doc_id", "lang", F.concat(F.lit("x"), "text").alias("text"))
    rows.write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    found = materialise(readers.read_csv(spark, path), "documents-read")
    text = F.substring("text", 2, 1 << 30)
    return found.select("doc_id", F.length(text).cast("long").alias("length"), F.sha2(text, 256).alias("digest"), "lang")


@query("""
SELECT l_suppkey, median(l_quantity) AS l_quantity_median, round(median(l_extendedprice) + 1e-9, 4) AS l_extendedprice_median,
  round(median(l_tax) + 1e-9, 6) AS l_tax_median, count(*) AS l_tax_size FROM lineitem GROUP BY l_suppkey
""")
def three_medians(spark, folder):
    """Several medians per supplier in one aggregate."""
    wanted = {"l_quantity": ["median"], "l_extendedprice": ["median"], "l_tax": ["median", "size"]}
    out = J.aggregate_events(table(spark, folder, "lineitem"), "l_suppkey", wanted)
    return out.withColumns({"l_extendedprice_median": steady("l_extendedprice_median", 4), "l_tax_median": steady("l_tax_median", 6)})


@query("""
SELECT 'transactions' AS name, o_custkey, round(sum(o_totalprice) + 1e-9, 2) AS amount_sum, round(avg(o_totalprice) + 1e-9, 6) AS amount_mean,
  count(o_totalprice) AS amount_count, count(o_orderkey) AS transaction_id_count FROM orders GROUP BY o_custkey
""")
def default_aggregates(spark, folder):
    """The aggregations offered for a table of transactions, carried out."""
    rows = table(spark, folder, "orders").select("o_custkey", F.col("o_totalprice").alias("amount"), F.col("o_orderkey").alias("transaction_id"))
    out = J.aggregate_events(rows, "o_custkey", J.default_aggregations("transactions", rows))
    return out.withColumns({"amount_sum": steady("amount_sum", 2), "amount_mean": steady("amount_mean", 6), "name": F.lit("transactions")})


@query("""
SELECT 'orders' AS name, count(*) AS n, CAST(count(DISTINCT o_orderstatus) AS BIGINT) AS kinds FROM orders
UNION ALL SELECT 'nations', count(*), CAST(count(DISTINCT n_name) AS BIGINT) FROM nation
UNION ALL SELECT 'segments', count(DISTINCT c_mktsegment), count(DISTINCT c_mktsegment) FROM customer
""")
def several_sources(spark, folder):
    """A CSV file, a Parquet table and an SQL query loaded by one list of descriptions."""
    path = scratch_path(spark, "orders-csv")
    writers.write_csv(table(spark, folder, "orders").select("o_orderkey", "o_orderstatus"), path)
    found = readers.read_sources(spark, [
        {"name": "orders", "type": " CSV", "path": path}, {"name": "nations", "type": "parquet", "path": f"{folder}/nation.parquet"},
        {"name": "segments", "type": "sql", "path": folder, "query": "SELECT DISTINCT c_mktsegment FROM customer"},
    ])
    kinds = {"orders": "o_orderstatus", "nations": "n_name", "segments": "c_mktsegment"}
    parts = [df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(kinds[name]).alias("kinds")).select(F.lit(name).alias("name"), "n", "kinds") for name, df in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""
SELECT CAST(ordinal_position - 1 AS INTEGER) AS position, column_name AS "column",
  CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' ELSE data_type END AS type,
  (SELECT count(*) FROM documents) AS n FROM (SELECT row_number() OVER () AS ordinal_position, column_name, column_type AS data_type FROM (DESCRIBE documents))
""")
def table_schema(spark, folder):
    """Position, name and type of every column, beside the row count."""
    rows = table(spark, folder, "documents")
    return readers.schema_of(rows).crossJoin(rows.agg(F.count(F.lit(1)).alias("n")))  # one row


@query("SELECT least(10000, count(*)) AS n, TRUE AS within FROM lineitem")
def sample_lineitem(spark, folder):
    """A seeded sample of 10,000 rows, or the whole table when it is smaller: exactly so many, all of the table."""
    rows = table(spark, folder, "lineitem")
    taken = materialise(sample_rows(rows, 10_000), "sample")
    return taken.agg(F.count(F.lit(1)).alias("n")).select("n", F.lit(taken.exceptAll(rows).isEmpty()).alias("within"))


@query()
def sample_rows_drawn(spark, folder):
    """The rows of that sample."""
    return sample_rows(table(spark, folder, "lineitem"), 10_000)


@query("SELECT event_id, event_type, value, [user_id, user_id + 1] AS pair FROM events")
def json_round_trip(spark, folder):
    """Write records with a nested column as JSON and read them back."""
    path = scratch_path(spark, "events-json")
    rows = table(spark, folder, "events").select(
        "event_id", "event_type", "value", F.array(F.col("user_id"), F.col("user_id") + 1).alias("pair")
    )
    writers.write_json(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query("""
SELECT o_orderkey, o_orderdate AS stamp, o_totalprice FROM orders WHERE o_orderkey % 6 <> 0 AND o_orderkey % 11 <> 0
""")
def valid_dates(spark, folder):
    """Rows whose text date parses and whose amount is present."""
    rows = table(spark, folder, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 6 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("text"),
        F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice")).alias("o_totalprice"),
    )
    fmt = C.choose_date_formats(rows, ["text"])["text"]
    stamp = C.parse_date(rows.schema["text"].dataType, F.col("text"), fmt)
    return rows.select("o_orderkey", stamp.alias("stamp"), "o_totalprice").na.drop(subset=["stamp", "o_totalprice"])


@query("""
SELECT event_type AS feature, round(avg(value) + 1e-9, 5) AS importance FROM events GROUP BY 1 ORDER BY avg(value) DESC, 1 LIMIT 15
""")
def mean_importance(spark, folder):
    rows = table(spark, folder, "events").select(F.col("event_type").alias("feature"), F.col("value").alias("importance"))
    return G.mean_importance(rows, 15).withColumn("importance", steady("importance", 5))
