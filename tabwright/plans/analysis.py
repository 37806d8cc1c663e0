"""The whole analysis of a dataset: prepare, segment, score, explain, record."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tabwright.operators import clustering as C
from tabwright.operators import explain as X
from tabwright.operators import findings as N
from tabwright.operators import isolation as A
from tabwright.operators.aggregates import cross_table
from tabwright.operators.integrate import unify
from tabwright.operators.profile import Structure, detect_structure
from tabwright.operators.trees import Surrogate, cluster_rules, fit_surrogate
from tabwright.plans import preparation as P
from tabwright.session import materialise
from tabwright.streaming.history import History, model_tables, preparation_tables

EXPLAINED = 15


@dataclass
class Analysis:
    run_id: str
    structure: Structure
    prepared: P.Prepared
    clustering: C.Clustering
    anomalies: A.Anomalies
    explanation: dict[str, DataFrame]
    surrogate: Surrogate | None


def analyse(
    data: DataFrame | Mapping[str, DataFrame],
    config: Mapping | None = None,
    history: str | None = None,
    keep: Sequence[str] | None = None,
    allow_high_risk: bool = False,
    preparation: Mapping | None = None,
    clustering: Mapping | None = None,
    anomalies: Mapping | None = None,
) -> Analysis:
    """Run every step on one table or several; rows of all results stay together.

    Clusters and scores are columns of the same rows, so nothing is ever matched
    by position.
    """
    started = _now()
    unified = unify(data, config)
    structure = detect_structure(unified)
    prepared = P.fit(unified, structure, keep=keep, allow_high_risk=allow_high_risk, **(preparation or {}))
    ready = materialise(prepared.features, "ready")
    fitted = _now()
    clusters = C.cluster_table(ready, **(clustering or {}))
    scored = A.anomaly_table(clusters.rows, keep=["cluster"], **(anomalies or {}))
    surrogate = fit_surrogate(scored.rows.drop(*A.RESULT_COLUMNS))
    explanation = explain(prepared, clusters, scored, surrogate)
    run_id = f"{started:%Y%m%d-%H%M%S}-{uuid.uuid4().hex[:8]}"
    if history:
        spark = unified.sparkSession
        store = History(spark, history)
        store.save(preparation_tables(spark, run_id, started, fitted, prepared, structure))
        store.save(model_tables(spark, run_id, fitted, _now(), clusters, scored, structure.n_rows, ready.columns))
    return Analysis(run_id, structure, prepared, clusters, scored, explanation, surrogate)


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def explain(prepared: P.Prepared, clusters: C.Clustering, scored: A.Anomalies, surrogate: Surrogate | None,
            method: str = "shap") -> dict[str, DataFrame]:
    """Every explanation as a table by name."""
    rows = scored.rows
    spark = rows.sparkSession
    features = clusters.fit.features
    scaling = P.scaling_table(spark, prepared.state)
    cross = cross_table(rows)
    plane = materialise(C.pca_2d(rows.select("is_anomaly", *features), ["is_anomaly"]), "plane")
    stability = N.stability_table(spark, C.cluster_stability(rows.select("cluster", *features), "cluster", clusters.k))
    order = W.partitionBy(F.lit(0)).orderBy(F.desc("anomaly_score"), *features)
    top = materialise(
        A.top_anomalies(rows, EXPLAINED).withColumn("row_key", F.row_number().over(order).cast("long")), "explained"
    )  # EXPLAINED rows
    long = X.contributions(top, scored.forest, "row_key", method)
    metrics = clusters.report()
    out = {
        "cluster_quality": N.quality(metrics),
        "noise": N.noise(metrics),
        "cluster_profile": X.with_real_values(clusters.profile, scaling, "mean", "real_mean"),
        "cluster_traits": X.cluster_traits(clusters.profile),
        "anomaly_rate": N.anomaly_rate(rows),
        "priority": N.priority(rows),
        "cross_table": cross,
        "contributions": X.with_real_values(X.top_contributions(long, "row_key", 3, method), scaling, "value", "real_value"),
        "counterfactuals": X.with_real_values(
            X.with_real_values(
                X.counterfactuals(top, clusters.fit.center_table(spark), features, "row_key"), scaling, "value", "real_value"
            ), scaling, "target", "real_target",
        ),
        "scaler_choice": P.scaler_evidence(spark, prepared.state),
        "k_choice": k_choice(clusters),
        "stability": stability,
        "findings": N.finding_table(rows, metrics, rows, plane, cross),
    }
    fidelity = spark.createDataFrame([], "fidelity double, tone string")
    if surrogate is not None:
        fidelity = surrogate.fidelity()
        out["fidelity"] = fidelity
        out["surrogate_importance"] = surrogate.importance()
        out["cluster_rules"] = cluster_rules(surrogate, clusters.profile.select("cluster", "size").distinct(), scaling)
    out["recommendations"] = N.recommendations(
        metrics, clusters.profile, N.anomaly_rate(rows), N.priority(rows), cross, fidelity, stability
    )
    return out


def k_choice(clusters: C.Clustering) -> DataFrame:
    """The k used, the k hinted at, and the scores that decided between them."""
    spark = clusters.rows.sparkSession
    return spark.createDataFrame(
        [(clusters.k, clusters.k_hint, clusters.best_score, clusters.scores.get(clusters.k_hint), bool(clusters.scores))],
        "k int, hinted_k int, best_score double, score_at_hint double, searched boolean",
    )
