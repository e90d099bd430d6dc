"""Quality dimensions, their composite and publication policy, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the dimensions, policy bands, decay per day by type, weights of source authorities.
WEIGHTS = {"accuracy": 0.25, "completeness": 0.15, "consistency": 0.2, "timeliness": 0.15, "provenance": 0.15, "confidence": 0.1}
AUTO_PUBLISH, REVIEW = 0.8, 0.6
DECAY = {"RegulatoryRequirement": 0.001, "VendorProduct": 0.005, "Service": 0.02, "Event": 0.02}
DEFAULT_DECAY = 0.005
AUTHORITY = {"regulatory": 1.0, "scheme": 0.97, "vendor": 0.9, "project": 0.85, "operational": 0.8}
DEFAULT_AUTHORITY = 0.85


def clamp(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def round_up_half(value: Column, digits: int = 6) -> Column:
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / scale


def lookup(table: dict[str, float], key: Column, default: float) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def present(value: Column, kind: str = "string") -> Column:
    """Neither null nor empty."""
    filled = F.length(value) > 0 if kind == "string" else F.size(value) > 0 if kind.startswith("array") else F.lit(True)
    return F.coalesce(value.isNotNull() & filled, F.lit(False))


def completeness(*flags: Column) -> Column:
    """Share of the required fields that are present; 1 if none is required."""
    if not flags:
        return F.lit(1.0)
    return sum((f.cast("int") for f in flags), F.lit(0)) / len(flags)


def field_completeness(*flags: Column) -> Column:
    """Share of the optional fields that are present; one half if there are none."""
    return completeness(*flags) if flags else F.lit(0.5)


def timeliness(days: Column, kind: Column) -> Column:
    """Exponential decay with the age of the latest evidence; 1 without any date."""
    return F.when(days.isNull(), F.lit(1.0)).otherwise(F.exp(-lookup(DECAY, kind, DEFAULT_DECAY) * F.greatest(days, F.lit(0.0))))


def consistency(contradictions: Column) -> Column:
    return clamp(F.lit(1.0) - 0.25 * F.coalesce(contradictions, F.lit(0)))


def composite(dimensions: dict[str, Column], weights: dict[str, float] = WEIGHTS) -> Column:
    total = sum(weights[d] for d in dimensions)
    return round_up_half(sum((dimensions[d] * weights[d] for d in dimensions), F.lit(0.0)) / total)


def policy(score: Column) -> Column:
    return F.when(score >= AUTO_PUBLISH, "auto-publish").when(score >= REVIEW, "review").otherwise("reject")


def alerts(dimensions: dict[str, Column]) -> Column:
    """(dimension, severity) of every dimension that is too low."""
    each = [F.struct(F.lit(d).alias("dimension"), F.when(v < 0.4, "critical").when(v < 0.6, "warning").alias("severity")) for d, v in dimensions.items()]
    return F.filter(F.array(*each), lambda a: a["severity"].isNotNull())


def bucket(score: Column) -> Column:
    return F.when(score >= 0.9, "excellent").when(score >= 0.8, "good").when(score >= 0.6, "acceptable").otherwise("poor")


def extraction_confidence(model: Column, authority: Column, complete: Column) -> Column:
    return F.round(clamp(clamp(model) * lookup(AUTHORITY, authority, DEFAULT_AUTHORITY) + 0.05 * (clamp(complete) - 0.5)), 4)


def corroborated(confidence: Column, sources: Column, boost: float = 0.05, most: float = 0.15) -> Column:
    """Confidence raised for every further source that says the same, up to a bound."""
    return F.round(clamp(confidence + F.least(F.lit(most), boost * F.greatest(sources - 1, F.lit(0)))), 4)


def aggregates(scores, dimensions: list[str]):
    """n, average of the composite and of each dimension (six digits), rows per bucket, and alerts in all."""
    flat = alerts({d: F.col(d) for d in dimensions})
    return scores.agg(
        F.count(F.lit(1)).alias("n"),
        round_up_half(F.avg("composite")).alias("composite"),
        *[round_up_half(F.avg(d)).alias(d) for d in dimensions],
        *[F.count_if(bucket(F.col("composite")) == b).alias(b) for b in ("excellent", "good", "acceptable", "poor")],
        F.sum(F.size(flat)).alias("alerts"),
    )
