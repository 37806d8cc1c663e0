import csv
import random
import statistics

import pytest

from tabwright.functions.text import normalise_value
from tabwright.operators import columns as C
from tabwright.operators import integrate as J
from tabwright.operators.aggregates import dataset_info
from tabwright.operators.quantiles import exact_quantiles, grouped_quantiles
from tabwright.operators.ranking import number_rows
from tabwright.operators.sampling import sample_rows, stratified_split
from tabwright.sources import readers


def test_names():
    assert C.normalise_name(" User  ID ") == "user_id"
    assert C.normalise_name("Prénom-Été (n°)") == "prenomete_n"
    assert C.normalise_name(None) == ""


def test_rename_and_cast(spark):
    df = spark.createDataFrame([("7", "3,5 m", "31.12.2020"), ("8", "4.25", "2020-12-30")], "`Boat No` string, Length string, built string")
    out = C.standardise_source(df, {"boat_no": "boat", "length": "metres"}, {"boat": "int", "metres": "float", "built": "datetime"})
    assert out.columns == ["boat", "metres", "built"]
    first, second = out.orderBy("boat").collect()
    assert (first["boat"], first["metres"], second["metres"]) == (7, None, 4.25)
    assert second["built"].day == 30


def test_repeated_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a long, b long, c long").toDF("a", "b", "a")
    assert C.drop_repeated_columns(df).columns == ["a", "b"]


def test_boats_and_trips(spark):
    boats = spark.createDataFrame([("a", 9.5), ("b", 12.0), ("c", 7.0)], "boat_id string, metres double")
    trips = spark.createDataFrame([("b", 40), ("a", 5), ("b", 10), ("b", None), ("d", 1)], "boat_id string, miles long")
    out = J.unify({"boats": boats, "trips": trips}, {"join_key": "boat_id", "events": {"trips": {"group_key": "boat_id", "aggregations": {"miles": ["max", "sum"]}}}})
    assert out.columns == ["boat_id", "metres", "miles_max", "miles_sum"]
    assert [tuple(r) for r in out.orderBy("boat_id").collect()] == [("a", 9.5, 5, 5), ("b", 12.0, 40, 50), ("c", 7.0, None, None)]


def test_null_keys_are_appended_once(spark):
    target = spark.createDataFrame([(1, "x"), (None, "y")], "k long, v string")
    pending = spark.createDataFrame([(None, "z"), (2, "b"), (2, "a"), (1, "q")], "k long, v string")
    assert [tuple(r) for r in J.new_rows(target, pending, "k").collect()] == [(2, "a")]
    assert sorted((r.k or 0, r.v) for r in J.new_rows(target.filter("k = 1"), pending, "k").collect()) == [(0, "z"), (2, "a")]


def test_rows_without_a_group_are_left_out(spark):
    from tabwright.operators.aggregates import group_stats
    df = spark.createDataFrame([("g", 1.0), ("g", 3.0), (None, 8.0)], "g string, x double")
    assert [(r.g, r.median, r["count"]) for r in group_stats(df, "g", "x").collect()] == [("g", 2.0, 2)]


def test_aggregate_rules(spark):
    df = spark.createDataFrame([(1, None), (None, 5.0)], "k long, v double")
    row = J.aggregate_events(df, "k", {"v": ["sum", "mean", "count"], "gone": ["sum"]}).first()
    assert tuple(row) == (1, 0.0, None, 0)
    with pytest.raises(ValueError):
        J.aggregate_events(df, "k", {"gone": ["sum"]})
    with pytest.raises(ValueError):
        J.aggregate_events(df, "k", {"v": ["first"]})


def test_missing_key_raises(spark):
    df = spark.createDataFrame([(1,)], "a long")
    with pytest.raises(ValueError):
        J.integrate_sources({"x": df, "y": df})
    with pytest.raises(TypeError):
        J.unify([df])


@pytest.mark.parametrize("how", ["left", "right", "inner", "outer"])
def test_null_keys_match(spark, how):
    left = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "k long, v string")
    right = spark.createDataFrame([(1, "x"), (None, "y"), (4, "z")], "k long, v string")
    got = {tuple(r) for r in J.merge_sources({"l": left, "r": right}, "k", how).collect()}
    both = {(1, "a", "x"), (None, "b", "y")}
    extra = {"left": {(3, "c", None)}, "right": {(4, None, "z")}, "inner": set(), "outer": {(3, "c", None), (4, None, "z")}}
    assert got == both | extra[how]


def test_quantiles_beyond_the_small_path(spark):
    df = spark.range(5000).selectExpr("id % 7 AS g", "double(id * id % 4999) AS x", "double(id % 3) AS ties", "CAST(NULL AS double) AS gone")
    columns, probs = ["x", "ties", "gone"], [0.0, 0.1, 0.5, 0.77, 1.0]
    assert exact_quantiles(df, columns, probs, small=0) == exact_quantiles(df, columns, probs)
    many = grouped_quantiles(df, ["g"], "x", [0.25, 0.5], ["a", "b"], small=0).orderBy("g").collect()
    assert many == grouped_quantiles(df, ["g"], "x", [0.25, 0.5], ["a", "b"]).orderBy("g").collect()


def test_numbers_are_dense_with_a_hot_group(spark):
    df = spark.range(3000).selectExpr("IF(id % 3 = 0, 1, id) AS g", "id % 5 AS v")
    out = number_rows(df, ["v"], "n", groups=["g"], repeated_rows=True)
    hot = out.filter("g = 1")
    assert hot.count() == hot.select("n").distinct().count() == hot.agg({"n": "max"}).first()[0]
    assert out.filter("g <> 1").agg({"n": "max"}).first()[0] <= 2


def test_sample_and_split(spark):
    df = spark.range(20000).selectExpr("id", "id % 4 AS c")
    assert sample_rows(df, 500).select("id").distinct().count() == 500
    assert sample_rows(df, 50000).count() == 20000
    parts = stratified_split(df, "c", 0.2).groupBy("c").agg({"is_test": "count"}).count()
    assert parts == 4
    assert stratified_split(df, "c", 0.2).filter("is_test").groupBy("c").count().select("count").distinct().collect() == [(1000,)]


@pytest.mark.parametrize("small", [1_000_000, 50, 0])
def test_medians_of_hot_groups(spark, small):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, None, *range(3, 30)]), rng.choice([None, rng.random()]), rng.randint(0, 5)) for _ in range(900)] + [(77, None, 1)]
    df = spark.createDataFrame(rows, "k int, a double, b int")
    got = {r["k"]: (r["a_median"], r["b_median"], r["b_size"]) for r in J.aggregate_events(df, "k", {"a": ["median"], "b": ["median", "size"]}, small=small).collect()}
    for k in {r[0] for r in rows} - {None}:
        a, b = ([r[i] for r in rows if r[0] == k and r[i] is not None] for i in (1, 2))
        want = (statistics.median(a) if a else None, statistics.median(b), sum(r[0] == k for r in rows))
        assert got[k] == pytest.approx(want)
    assert None not in got


def test_text_values(spark):
    words = [" Été  2024!", "N/A", "", None, "nan", "ﬁn ½", "™x", "éte"]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string")
    got = [r[0] for r in df.orderBy("i").select(normalise_value("w")).collect()]
    assert got == ["ete 2024", "n a", "unknown", "unknown", "unknown", "fin 1 2", "TMx", "ete"]


def test_csv(spark, tmp_path):
    path = tmp_path / "ports.csv"
    path.write_bytes("port;depth;town\n3;14;Ålesund\n9;NA;Bodø\n".encode("latin-1"))
    df = readers.read_source(spark, " CSV ", str(path), sep=";")
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["bigint", "bigint", "string"]
    assert [tuple(r) for r in df.orderBy("port").collect()] == [(3, 14, "Ålesund"), (9, None, "Bodø")]
    assert dataset_info(df).first()["missing_values"] == 1
    assert readers.source_name("/x/My Ports.csv") == "my_ports"


def test_csv_records_across_splits(spark, tmp_path):
    rng = random.Random(8)
    bits = ["a", '"', "\n", "\r\n", ",", "é", "", " word ", "\n\n", '""', "x" * 40]
    rows = [[str(i), "v" + "".join(rng.choices(bits, k=rng.randint(0, 9))) + "w", rng.choice(["k", 'q"q', "two\nlines"])] for i in range(400)]
    rows[7][1] = "long" + "\nline of text" * 300 + "end"  # over several splits
    for name, part in (("a.csv", rows[:250]), ("b.csv", rows[250:])):
        with open(tmp_path / name, "w", newline="", encoding="utf-8") as f:
            out = csv.writer(f, lineterminator="\r\n" if name == "b.csv" else "\n")
            out.writerows([["id", "text", "two\nline name"], *part])
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 700)
    try:
        df = readers.read_csv(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 1 and df.columns == ["id", "text", "two\nline name"]
        assert sorted([str(r[0]), r[1], r[2]] for r in df.collect()) == sorted(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_a_replacement_character_is_no_bad_byte(spark, tmp_path):
    (tmp_path / "r.csv").write_text("a,b\n1,ok \ufffd ü\n", encoding="utf-8")
    assert readers.read_csv(spark, str(tmp_path / "r.csv")).first()["b"] == "ok \ufffd ü"


def test_several_sources(spark, folder, tmp_path):
    (tmp_path / "p.csv").write_text("id;n\n1;5\n", encoding="utf-8")
    found = readers.read_sources(spark, [
        {"name": "ports", "type": "CSV ", "path": str(tmp_path / "p.csv"), "sep": ";"},
        {"name": "nations", "type": "parquet", "path": f"{folder}/nation.parquet"},
        {"name": "regions", "type": "sql", "path": folder, "query": "SELECT r_name FROM region"},
    ])
    assert list(found) == ["ports", "nations", "regions"] and [d.count() for d in found.values()] == [1, 25, 5]
    assert [tuple(r) for r in readers.schema_of(found["ports"]).collect()] == [(0, "id", "bigint"), (1, "n", "bigint")]


def test_bad_sources(spark, tmp_path):
    with pytest.raises(readers.SourceError):
        readers.read_csv(spark, str(tmp_path / "none.csv"))
    with pytest.raises(readers.SourceError):
        readers.read_source(spark, "xml", "x")
    with pytest.raises(readers.SourceError):
        readers.read_source(spark, "sql", "x")
    with pytest.raises(readers.SourceError, match="source u"):
        readers.read_sources(spark, [{"name": "u", "type": "csv", "path": str(tmp_path / "none.csv")}])
    with pytest.raises(readers.SourceError):
        readers.check_table(spark.createDataFrame([], "a int"), "empty")


def test_hot_groups_are_not_brought_into_one_task(spark):
    """The quantiles of large groups need no join that shuffles rows by their group."""
    rows = spark.createDataFrame([(g, float(i * 7 % 101)) for g in "ab" for i in range(200)] + [("c", 1.0)], "g string, v double")
    out = grouped_quantiles(rows, ["g"], "v", [0.5], ["m"], small=50)
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    values = sorted(float(i * 7 % 101) for i in range(200))
    assert {r.g: r.m for r in out.collect()} == {"a": (values[99] + values[100]) / 2, "b": (values[99] + values[100]) / 2, "c": 1.0}
