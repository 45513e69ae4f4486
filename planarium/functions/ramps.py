"""Piecewise penalties of a score between two thresholds, and other scalar costs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def ramp(score: Column, low, high) -> Column:
    """0 up to low, 1 from high on, linear between; a step above low where high is not larger."""
    low, high = _c(low), _c(high)
    return F.when(high - low <= 0, (score > low).cast("double")).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (score - low) / F.nullif(high - low, F.lit(0.0)))))


def signed_ramp(score: Column, low, high) -> Column:
    """As ramp, but falling to -1 at score 0 below a positive low."""
    low = _c(low)
    return F.when((low > 0) & (score < low), (score - low) / F.nullif(low, F.lit(0.0))).otherwise(ramp(score, low, high))


def log_ramp(score: Column, low, high=None, alpha: float = 10.0, most: float = 0.99) -> Column:
    """Logarithmic rise from low to 1, with the score cut at `most`; `high` isn't used."""
    low = _c(low)
    s = F.least(score, F.lit(most))
    return F.when(s <= low, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.log1p(alpha * (s - low)) / F.log1p(alpha * (1 - low)))))


def signed_log_ramp(score: Column, low, high=None, alpha: float = 10.0) -> Column:
    low = _c(low)
    return F.when((low > 0) & (score < low), (score - low) / F.nullif(low, F.lit(0.0))).otherwise(log_ramp(score, low, high, alpha))


def choose(log: bool, signed: bool):
    """The ramp for two switches."""
    return {(False, False): ramp, (False, True): signed_ramp, (True, False): log_ramp, (True, True): signed_log_ramp}[log, signed]


def rbf(d2: Column, sigma) -> Column:
    return F.exp(-d2 / (2 * _c(sigma) * _c(sigma)))


def argmin(costs: Column) -> Column:
    """First index of the least cost."""
    return (F.array_position(costs, F.array_min(costs)) - 1).cast("int")


def posterior(costs: Column) -> Column:
    """Softmax of negated costs."""
    low = F.array_min(costs)
    e = F.transform(costs, lambda c: F.exp(low - c))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def joint_cost(costs: Column) -> Column:
    """-log of the summed likelihoods behind several costs."""
    low = F.array_min(costs)
    return low - F.log(F.aggregate(F.transform(costs, lambda c: F.exp(low - c)), F.lit(0.0), lambda a, b: a + b))
