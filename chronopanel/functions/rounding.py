"""Stable rounding of published doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(value: Column | str, digits: int = 6) -> Column:
    """Round away float noise: a nudge below the last digit settles decimal ties, ``+ 0.0`` drops -0.0."""
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value.cast("double") + F.lit(1e-9), digits) + F.lit(0.0)


def clean(value: Column | str) -> Column:
    """NaN and infinities become NULL, so aggregates skip them."""
    value = F.col(value) if isinstance(value, str) else value
    return F.when(F.isnan(value) | (F.abs(value) == F.lit(float("inf"))), None).otherwise(value)
