"""The risk scale: one set of bands for scores, levels and verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MEDIUM_FROM, HIGH_FROM, MOST = 25, 60, 99


def clamp(risk: Column) -> Column:
    return F.when(risk.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(MOST), risk)))


def band(risk: Column) -> Column:
    return F.when(risk.isNull(), None).when(risk >= HIGH_FROM, "high").when(risk >= MEDIUM_FROM, "medium").otherwise("low")


def level(risk: Column) -> Column:
    return F.when(risk.isNull(), None).when(risk >= HIGH_FROM, "dangerous").when(risk >= MEDIUM_FROM, "suspicious").otherwise("safe")


def coherent(verdict: Column, risk: Column) -> Column:
    """The number shown beside a verdict: pulled into the verdict's band.

    A missing number stays missing for Uncertain and for an unknown verdict; a Scam
    without one gets its band's edge, Not a Scam gets 0.
    """
    value = clamp(risk)
    given = (
        F.when(verdict == "Scam", F.greatest(value, F.lit(HIGH_FROM)))
        .when(verdict == "Uncertain", F.least(F.greatest(value, F.lit(MEDIUM_FROM)), F.lit(HIGH_FROM - 1)))
        .when(verdict == "Not a Scam", F.least(value, F.lit(MEDIUM_FROM - 1)))
        .otherwise(value)
    )
    missing = F.when(verdict == "Scam", HIGH_FROM).when(verdict == "Not a Scam", 0)
    return F.when(risk.isNull(), missing).otherwise(given).cast("int")


def similarity(left: Column, right: Column) -> Column:
    """Cosine of two double arrays, both norms taken; 0 for null, empty or zero vectors."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    scale = F.sqrt(dot(left, left)) * F.sqrt(dot(right, right))
    return F.when((scale > 0) & (F.size(left) == F.size(right)), dot(left, right) / scale).otherwise(0.0)
