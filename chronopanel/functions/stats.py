"""Reusable aggregate columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def median(x: str) -> Column:
    return F.expr(f"percentile({x}, 0.5)")


def quantile(x: str, q: float) -> Column:
    return F.expr(f"percentile({x}, {q})")


def share(condition: Column) -> Column:
    """Fraction of rows meeting a condition (NULL conditions are skipped)."""
    return F.avg(condition.cast("double"))


def robust_score(x: str) -> Column:
    """median + mean/2 - std/2 - 0.02 * share of non-positive values."""
    return median(x) + 0.5 * F.avg(x) - 0.5 * F.stddev_pop(x) - 0.02 * share(F.col(x) <= 0)


def hhi(weight: Column) -> Column:
    """Herfindahl index of non-negative weights."""
    return F.sum(weight * weight) / F.nullif(F.sum(weight) * F.sum(weight), F.lit(0.0))


def wilson(successes: Column, total: Column) -> tuple[Column, Column]:
    """Two-sided 95% Wilson interval, clipped to [0, 1]; (0, 0) for no trials."""
    n = F.nullif(total.cast("double"), F.lit(0.0))
    p = successes / n
    denominator = 1 + Z95 * Z95 / n
    center = (p + Z95 * Z95 / (2 * n)) / denominator
    radius = Z95 * F.sqrt((p * (1 - p) + Z95 * Z95 / (4 * n)) / n) / denominator
    return (F.coalesce(F.greatest(F.lit(0.0), center - radius), F.lit(0.0)),
            F.coalesce(F.least(F.lit(1.0), center + radius), F.lit(0.0)))


def sign_test(successes: Column, total: Column) -> Column:
    """One-sided binomial p-value P(X >= successes) at p = 1/2, summed from log-binomial terms.

    ``total`` counts outer folds, so the summed sequence is short.
    """
    def log_fact(n: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0).cast("long"), n.cast("long")), F.lit(0.0),
                           lambda acc, i: acc + F.when(i > 1, F.log(i.cast("double"))).otherwise(0.0))

    term = lambda k: F.exp(log_fact(total) - log_fact(k) - log_fact(total - k) - total * F.log(F.lit(2.0)))
    tail = F.aggregate(F.sequence(successes.cast("long"), total.cast("long")), F.lit(0.0), lambda acc, k: acc + term(k))
    return F.when(total <= 0, 1.0).otherwise(tail)


def expected_shortfall_rows(n: Column, alpha: float = 0.05) -> Column:
    """Tail size: max(1, ceil(n * alpha))."""
    return F.greatest(F.lit(1), F.ceil(n * F.lit(alpha)))
