"""Rounding, weights, gate arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

__all__ = [
    "round_half_up",
    "ratio",
    "confidence_weight",
    "confidence_bucket",
    "minimum_tracks",
    "unit_fraction",
    "count_value",
]

# Weight of each confidence level and the bucket floors.
CONFIDENCE_WEIGHTS = {"documented": 1.0, "strongly_associated": 0.75, "estimated": 0.45}
CONFIDENCE_FLOORS = (("documented", 0.9), ("strongly_associated", 0.65))
MAX_SAFE_INTEGER = 9007199254740991


def round_half_up(c: Column, places: int) -> Column:
    """Half-up rounding with a tolerance that absorbs the last bits of a sum of doubles."""
    scale = float(10**places)
    return F.floor(c * F.lit(scale) + F.lit(0.500000001)).cast("double") / F.lit(scale)


def ratio(part: Column, whole: Column, places: int | None = None) -> Column:
    """part / whole, zero where whole is zero."""
    value = F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole.cast("double"))
    return value if places is None else round_half_up(value, places)


def confidence_weight(c: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, weight in CONFIDENCE_WEIGHTS.items():
        out = F.when(c == name, F.lit(weight)).otherwise(out)
    return out


def confidence_bucket(weighted_mean: Column) -> Column:
    out = F.lit("estimated")
    for name, floor in reversed(CONFIDENCE_FLOORS):
        # The tolerance matches round_half_up: a mean of 0.9 summed as 0.8999... is 0.9.
        out = F.when(weighted_mean >= floor - 1e-9, F.lit(name)).otherwise(out)
    return out


def minimum_tracks(total: Column, share: float, floor: int) -> Column:
    needed = F.greatest(F.lit(floor).cast("bigint"), F.ceil(total * F.lit(share)).cast("bigint"))
    return F.when(total <= 0, F.lit(0).cast("bigint")).otherwise(F.least(total.cast("bigint"), needed))


def unit_fraction(c: Column) -> Column:
    """True for a number in [0, 1]; false for null and NaN."""
    return F.coalesce(~F.isnan(c) & (c >= 0) & (c <= 1), F.lit(False))


def count_value(c: Column, limit: int = MAX_SAFE_INTEGER) -> Column:
    """True for an integer in [0, limit]; false for null."""
    return F.coalesce((c >= 0) & (c <= limit), F.lit(False))
