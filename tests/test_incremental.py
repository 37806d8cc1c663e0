import pytest
from pyspark.sql import functions as F

from tabwright.operators import findings as N
from tabwright.streaming import incremental as I
from tabwright.streaming.history import History


def rows(spark, n):
    return spark.range(n).selectExpr("id AS transaction_id", "id * 2 AS amount")


def test_growth_starts_a_run(spark, tmp_path):
    path, ran = str(tmp_path / "checks"), []
    assert I.check_volume(rows(spark, 3), spark, path, run=lambda: ran.append(1)).first()["decision"] == "baseline"
    assert not ran
    grown = I.check_volume({"a": rows(spark, 4)}, spark, path, run=lambda: ran.append(1)).first()
    assert (grown["decision"], grown["growth_pct"], ran) == ("run", 33.33, [1])
    assert I.check_volume(rows(spark, 4), spark, path).first()["decision"] == "wait"
    assert I.checks(spark, path).count() == 3


def test_a_failing_run_is_recorded(spark, tmp_path):
    path = str(tmp_path / "checks")
    I.check_volume(rows(spark, 3), spark, path)

    def fail():
        raise RuntimeError("broken")

    assert "broken" in I.check_volume(rows(spark, 9), spark, path, run=fail).first()["error"]


def test_append_new(spark, tmp_path):
    path = str(tmp_path / "target")
    rows(spark, 100).withColumn("ingested_at", F.current_timestamp()).write.parquet(path)
    report = I.append_new(path, rows(spark, 150), "transaction_id").first()
    assert tuple(report) == (100, 50, 150, 50.0)
    assert I.append_new(path, rows(spark, 150), "transaction_id").first()["rows_inserted"] == 0


def test_history_replaces_one_run(spark, tmp_path):
    store = History(spark, str(tmp_path))
    make = lambda run, status: spark.createDataFrame([(run, status)], "run_id string, status string").withColumn(
        "created_at", F.lit("2024-01-01").cast("timestamp"))
    store.upsert("pipeline_runs", make("a", "success").union(make("b", "success")))
    store.upsert("pipeline_runs", make("b", "failed"))
    assert {r["run_id"]: r["status"] for r in store.read("pipeline_runs").collect()} == {"a": "success", "b": "failed"}
    with pytest.raises(ValueError):
        store.features("ml_runs")
    with pytest.raises(ValueError):
        store.read("nothing")


def test_trend(spark):
    history = spark.createDataFrame([("a", 1, 0.3), ("b", 2, None), ("c", 3, 0.5)], "run_id string, created_at int, s double")
    assert N.metric_trend(history, "s").first()["tone"] == "success"
    assert N.metric_trend(history, "s", higher_is_better=False).first()["tone"] == "warning"
    assert N.metric_trend(history.limit(1), "s").first()["tone"] == "neutral"
    assert N.metric_trend(history, "s", significant=0.5).first()["tone"] == "neutral"


def test_no_concern(spark):
    empty = lambda schema: spark.createDataFrame([], schema)
    out = N.recommendations(
        spark.createDataFrame([(0.6, False, 1.0)], "silhouette double, high_noise boolean, noise_ratio double"),
        spark.createDataFrame([(0, 50.0), (1, 50.0)], "cluster int, percentage double"),
        spark.createDataFrame([(1.0,)], "anomaly_ratio double"), spark.createDataFrame([(0,)], "critical_count long"),
        empty("cluster int, to_watch boolean, anomaly_ratio_pct double"), empty("fidelity double, tone string"),
        N.stability_table(spark, [0.9]),
    )
    assert [r["rule"] for r in out.collect()] == ["no_concern"]
