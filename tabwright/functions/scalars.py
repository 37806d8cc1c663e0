"""Numeric, date and banding expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (lower bound, label, tone), first match wins.
SILHOUETTE_BANDS = [
    (0.50, "excellente", "success"),
    (0.25, "correcte", "success"),
    (0.10, "faible", "warning"),
    (float("-inf"), "très faible / clusters non séparés", "danger"),
]
NOISE_BANDS = [
    (60.0, "critique", "danger"),
    (40.0, "élevé", "warning"),
    (15.0, "modéré", "neutral"),
    (float("-inf"), "faible", "success"),
]
ANOMALY_RATE_BANDS = [
    (10.0, "critique", "danger"),
    (5.0, "élevé", "warning"),
    (1.0, "modéré", "neutral"),
    (float("-inf"), "faible", "success"),
]
FIDELITY_BANDS = [
    (0.90, "élevée", "success"),
    (0.75, "correcte", "success"),
    (0.60, "modérée", "warning"),
    (float("-inf"), "faible", "danger"),
]
STABILITY_BANDS = [
    (0.75, "élevée", "success"),
    (0.50, "modérée", "warning"),
    (float("-inf"), "faible", "danger"),
]
CORRELATION_BANDS = [
    (0.80, "très forte", "warning"),
    (0.60, "forte", "neutral"),
    (0.30, "modérée", "neutral"),
    (float("-inf"), "faible", "success"),
]
# Severity of an anomaly by normalised score.
SEVERITY_BOUNDS = {"critique": 0.95, "élevé": 0.85, "moyen": 0.70}


def band(value: Column, bands: Sequence[tuple[float, str, str]], part: str = "label") -> Column:
    """Label or tone of the first band whose bound ``value`` reaches."""
    at = 1 if part == "label" else 2
    out = F.when(value.isNull(), F.lit("indisponible" if part == "label" else "neutral"))
    for entry in bands:
        out = out.when(value >= F.lit(entry[0]), F.lit(entry[at]))
    return out


def severity(score: Column, is_anomaly: Column, bounds: dict[str, float] | None = None) -> Column:
    bounds = {**SEVERITY_BOUNDS, **(bounds or {})}
    out = F.when(is_anomaly == 0, F.lit("normal"))
    for label in ("critique", "élevé", "moyen"):
        out = out.when(score >= F.lit(bounds[label]), F.lit(label))
    return out.otherwise(F.lit("faible"))


def finite_or_zero(c: Column) -> Column:
    x = c.cast("double")
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(x)


def nan_to_null(c: Column) -> Column:
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def log1p_clipped(c: Column) -> Column:
    return F.log1p(F.greatest(c, F.lit(0.0)))


def yeo_johnson(c: Column, lam: float) -> Column:
    """Power transform of the column for a fixed lambda (not standardised)."""
    if abs(lam) < 1e-12:
        up = F.log1p(c)
    else:
        up = (F.pow(c + 1.0, F.lit(lam)) - 1.0) / F.lit(lam)
    if abs(lam - 2.0) < 1e-12:
        down = -F.log1p(-c)
    else:
        down = -(F.pow(1.0 - c, F.lit(2.0 - lam)) - 1.0) / F.lit(2.0 - lam)
    return F.when(c >= 0, up).otherwise(down)


def yeo_johnson_at(c: Column, lam: Column) -> Column:
    """Power transform with lambda taken from a column."""
    two = 2.0 - lam
    up = F.when(F.abs(lam) < 1e-12, F.log1p(c)).otherwise((F.pow(c + 1.0, lam) - 1.0) / lam)
    down = F.when(F.abs(two) < 1e-12, -F.log1p(-c)).otherwise(-(F.pow(1.0 - c, two) - 1.0) / two)
    return F.when(c >= 0, up).otherwise(down)


def yeo_johnson_inverse(c: Column, lam: float) -> Column:
    if abs(lam) < 1e-12:
        up = F.expm1(c)
    else:
        up = F.pow(c * F.lit(lam) + 1.0, F.lit(1.0 / lam)) - 1.0
    if abs(lam - 2.0) < 1e-12:
        down = -F.expm1(-c)
    else:
        down = 1.0 - F.pow(1.0 - c * F.lit(2.0 - lam), F.lit(1.0 / (2.0 - lam)))
    return F.when(c >= 0, up).otherwise(down)


def adjusted_skewness(c: Column) -> Column:
    """Sample skewness; 0 for a constant column, NULL under three values."""
    n = F.count(c).cast("double")
    factor = F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
    flat = F.min(c) == F.max(c)
    return F.when(n < 3, F.lit(None)).when(flat, F.lit(0.0)).otherwise(F.skewness(c) * factor)


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """Rounded percentage; NULL when the whole is zero."""
    return F.round(part * 100.0 / F.nullif(whole.cast("double"), F.lit(0.0)), digits)


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation; NULL instead of a division error on a constant."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))
