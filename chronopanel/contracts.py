"""Run-time contracts: required columns, unique keys, join cardinality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A table broke a declared contract."""


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ContractError(f"missing columns: {missing}")
    return df


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def assert_unique(df: DataFrame, keys: Sequence[str], what: str = "table") -> DataFrame:
    if not duplicate_keys(df, keys).isEmpty():
        raise ContractError(f"{what}: duplicate keys on {list(keys)}")
    return df


def guard(value: Column, ok: Column, message: str) -> Column:
    """``value`` where ``ok`` holds, else a failing task; checks inside the running plan."""
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)))


def checked_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner",
                 cardinality: str = "m:1") -> DataFrame:
    """Join whose declared cardinality is enforced by the plan itself.

    The right side is reduced to one row per key with a count next to it; a
    count above one fails the task that sees it. No extra pass or action.
    """
    if cardinality not in ("m:1", "1:1"):
        raise ContractError(f"unknown cardinality {cardinality}")

    def unique(df: DataFrame, side: str) -> DataFrame:
        payload = [c for c in df.columns if c not in on]
        grouped = df.groupBy(*on).agg(
            F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in payload])
        head = guard(F.col(on[0]), F.col("_n") == 1, f"{side} side is not unique on {list(on)}")
        return grouped.select(head.alias(on[0]), *on[1:], *payload)

    if cardinality == "1:1":
        left = unique(left, "left")
    return left.join(unique(right, "right"), list(on), how)
