"""Growth checks, appending new rows and scoring streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tabwright.operators.integrate import new_rows
from tabwright.operators.isolation import Forest, detect
from tabwright.plans.preparation import transform
from tabwright.plans.state import PrepState

CHECK_SCHEMA = (
    "checked_at timestamp, current_rows long, baseline_rows long, growth_pct double, decision string, "
    "reason string, error string"
)


def growth(current: Column, baseline: Column) -> Column:
    """Growth in percent; NULL without a positive baseline."""
    return (current - baseline) * 100.0 / F.nullif(baseline.cast("double"), F.lit(0.0))


def growth_check(counts: DataFrame, threshold: float = 10.0, current: str = "current_rows",
                 baseline: str = "baseline_rows") -> DataFrame:
    """Add growth_pct and decision: baseline (nothing to compare), run or wait."""
    pct = growth(F.col(current), F.col(baseline))
    decision = F.when(pct.isNull(), "baseline").when(pct >= threshold, "run").otherwise("wait")
    return counts.withColumn("growth_pct", F.round(pct, 2)).withColumn("decision", decision)


def check_volume(sources: dict[str, DataFrame] | DataFrame, spark: SparkSession, state_path: str,
                 threshold: float = 10.0, run: Callable[[], None] | None = None) -> DataFrame:
    """One check: compare the row count with the last baseline, run if it grew enough.

    The state table gets one row per check. The baseline moves when it is first
    stored and after a run; several sources count together.
    """
    frames = [sources] if isinstance(sources, DataFrame) else list(sources.values())
    current = sum(df.count() for df in frames)
    baseline = last_baseline(spark, state_path)
    counts = spark.createDataFrame([(current, baseline)], "current_rows long, baseline_rows long")
    row = growth_check(counts, threshold).first()
    error = None
    if row["decision"] == "run" and run is not None:
        try:
            run()
        except Exception as e:  # recorded, as the next check must still happen
            error = f"{type(e).__name__}: {e}"
    reason = {"baseline": "first count", "run": "enough new rows", "wait": "too few new rows"}[row["decision"]]
    check = spark.createDataFrame(
        [(current, baseline, row["growth_pct"], row["decision"], reason, error)],
        "current_rows long, baseline_rows long, growth_pct double, decision string, reason string, error string",
    ).select(F.current_timestamp().alias("checked_at"), "*")
    check.write.mode("append").parquet(state_path)
    return check


def checks(spark: SparkSession, state_path: str, n: int = 50) -> DataFrame:
    """The last ``n`` checks, newest first."""
    return spark.read.schema(CHECK_SCHEMA).parquet(state_path).orderBy(F.desc("checked_at")).limit(n)


def last_baseline(spark: SparkSession, state_path: str) -> int | None:
    """Row count at the last stored baseline or run."""
    path = spark._jvm.org.apache.hadoop.fs.Path(state_path)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    moved = spark.read.schema(CHECK_SCHEMA).parquet(state_path).filter(F.col("decision").isin("baseline", "run"))
    return moved.agg(F.max_by("current_rows", "checked_at")).first()[0]


def append_new(target_path: str, pending: DataFrame, key: str) -> DataFrame:
    """Append pending rows with unseen keys to a Parquet table, stamped; one report row."""
    spark = pending.sparkSession
    target = spark.read.parquet(target_path)
    before = target.count()
    fresh = new_rows(target, pending, key).withColumn("ingested_at", F.current_timestamp())
    fresh.select(*target.columns).write.mode("append").parquet(target_path)
    after = spark.read.parquet(target_path).count()
    pct = growth(F.lit(after), F.lit(before))
    return spark.createDataFrame([(before, after - before, after)], "rows_before long, rows_inserted long, rows_after long").withColumn(
        "growth_pct", F.coalesce(F.round(pct, 2), F.lit(100.0))
    )


def append_stream(stream: DataFrame, target_path: str, key: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to a table, each batch without the keys already there."""

    def write(batch: DataFrame, _: int) -> None:
        target = batch.sparkSession.read.parquet(target_path)
        fresh = new_rows(target, batch, key).withColumn("ingested_at", F.current_timestamp())
        fresh.select(*target.columns).write.mode("append").parquet(target_path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def score_stream(stream: DataFrame, state: PrepState, kmeans, forest: Forest, out_path: str,
                 checkpoint: str) -> StreamingQuery:
    """Prepare, assign and score arriving rows with stored models.

    Each batch is prepared exactly as a new table would be; scores use the range
    seen when fitting, so that batches are comparable. A batch is written under its
    number and replaces what an interrupted attempt left there.
    """

    def write(batch: DataFrame, number: int) -> None:
        ready = transform(batch, state)
        scored = detect(kmeans.assign(ready), forest, normalise="fit")
        scored.write.mode("overwrite").parquet(f"{out_path}/batch_id={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
