"""Time-series windows over session-grain series.

Inputs hold one row per (key, session): their length is bounded by the
calendar, so a window per key never sees raw-row skew.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def series(keys: Sequence[str], order: str):
    return Window.partitionBy(*keys).orderBy(order)


def pct_change(x: str, n: int, w) -> Column:
    return F.try_divide(F.col(x), F.lag(x, n).over(w)) - 1


def rolling(agg, x: str | Column, n: int, min_periods: int, w) -> Column:
    """``agg`` over the last n rows; NULL until min_periods non-NULL values are seen."""
    col = F.col(x) if isinstance(x, str) else x
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(col).over(frame) >= min_periods, agg(col).over(frame))


def running_max(x: str | Column, w) -> Column:
    return F.max(x).over(w.rowsBetween(Window.unboundedPreceding, 0))


def drawdown(x: str, w) -> Column:
    return F.col(x) / running_max(x, w) - 1


def period_end_rows(df: DataFrame, keys: Sequence[str], date: str, unit: str) -> DataFrame:
    """Last row per (keys, period): max_by over a struct, so no window and no sort of the history."""
    payload = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys, F.trunc(date, unit).alias("_period")).agg(
        F.max_by(F.struct(*payload), F.col(date)).alias("_p"))
    return best.select(*keys, "_p.*")


def islands(df: DataFrame, keys: Sequence[str], order: str, flag: str) -> DataFrame:
    """Runs of consecutive TRUE flags: (keys, first, last, length)."""
    w = series(keys, order)
    marked = (df.withColumn("_pos", F.row_number().over(w)).where(F.col(flag))
              .withColumn("_grp", F.col("_pos") - F.row_number().over(w)))
    return marked.groupBy(*keys, "_grp").agg(
        F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("length")).drop("_grp")


def business_days_between(a: Column, b: Column) -> Column:
    """Weekdays in [a, b): whole weeks count 5, the remainder is counted from day-of-week arithmetic."""
    days = F.datediff(b, a)
    dow = F.weekday(a)                                     # Monday = 0
    rest = days % 7
    weekend_hits = F.greatest(F.lit(0), F.least(dow + rest, F.lit(7)) - F.greatest(dow, F.lit(5))) + \
        F.greatest(F.lit(0), F.least(dow + rest, F.lit(14)) - F.greatest(dow, F.lit(12)))
    return F.floor(days / 7) * 5 + rest - weekend_hits


def episodes(df: DataFrame, keys: Sequence[str], order: str, gap: int) -> DataFrame:
    """Episode number per row; a new one starts when more than ``gap`` business days passed."""
    w = series(keys, order)
    new = F.when(F.lag(order).over(w).isNull()
                 | (business_days_between(F.lag(order).over(w), F.col(order)) > gap), 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("episode", F.sum("_new").over(w)).drop("_new")


def compounded(r: str, w) -> Column:
    """Running product of 1 + r; the path is wiped out (0) from the first r <= -1 on."""
    dead = F.max(F.when(F.col(r) <= -1, 1).otherwise(0)).over(w)
    return F.when(dead == 1, 0.0).otherwise(F.exp(F.sum(F.when(F.col(r) > -1, F.log1p(r))).over(w)))
