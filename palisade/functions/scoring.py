"""Score arithmetic: severity weights, bands, grades and rounding as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Severity order, weights and lower band limits. The product has two scoring profiles.
SEVERITIES = ("critical", "high", "medium", "low", "info")
WEIGHTS = {
    "calculator": {"critical": 40, "high": 25, "medium": 10, "low": 5, "info": 1},
    "model": {"critical": 25, "high": 15, "medium": 8, "low": 3, "info": 0},
}
BANDS = {
    "calculator": ((90, "info"), (75, "low"), (50, "medium"), (25, "high")),
    "model": ((90, "info"), (70, "low"), (50, "medium"), (30, "high")),
}
GRADES = ((95, "A+"), (90, "A"), (80, "B"), (70, "C"), (60, "D"), (40, "E"))


def _ladder(score: Column, steps, last: str) -> Column:
    chain = F.when(score >= steps[0][0], F.lit(steps[0][1]))
    for limit, label in steps[1:]:
        chain = chain.when(score >= limit, F.lit(label))
    return chain.otherwise(F.lit(last))


def weight(severity: Column, profile: str) -> Column:
    chain = None
    for name, points in WEIGHTS[profile].items():
        chain = F.when(severity == name, F.lit(points)) if chain is None else chain.when(severity == name, F.lit(points))
    return chain.otherwise(F.lit(0))


def severity_rank(severity: Column) -> Column:
    chain = None
    for rank, name in enumerate(SEVERITIES):
        chain = F.when(severity == name, F.lit(rank)) if chain is None else chain.when(severity == name, F.lit(rank))
    return chain.otherwise(F.lit(99))


def band(score: Column, profile: str) -> Column:
    return _ladder(clamp(score, 0, 100), BANDS[profile], "critical")


def grade(score: Column) -> Column:
    return _ladder(score, GRADES, "F")


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def half_even(value: Column) -> Column:
    """Server-side rounding: ties go to the even neighbour."""
    return F.bround(value, 0).cast("bigint")


def half_even_places(value: Column, places: int) -> Column:
    """Rounding of the binary value to some decimals, as the report does (not of its printed form)."""
    scale = float(10**places)
    return F.rint(value * scale) / scale


def half_up(value: Column) -> Column:
    """Dashboard rounding: ties go up."""
    return F.floor(value + F.lit(0.5)).cast("bigint")


def posture(score: Column, critical: Column, high: Column, medium: Column, low: Column) -> Column:
    return (
        F.when(critical > 0, F.lit("Critical"))
        .when(high > 0, F.lit("High Risk"))
        .when((medium > 0) | (score < 70), F.lit("Needs Review"))
        .when((low > 0) | (score < 85), F.lit("Moderate"))
        .otherwise(F.lit("Secure"))
    )
