"""Wealth-path metrics of relative curves, at the end or at every month-end prefix.

A curve has one row per session, so every window here is bounded by the calendar.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

YEAR = 252


def relative_path(nav: DataFrame, keys: Sequence[str], date: str = "date") -> DataFrame:
    """Per session: return, drawdown, underwater run length, finished recovery length, running sums."""
    w = Window.partitionBy(*keys).orderBy(date)
    x = nav.select(*keys, date, "rel").withColumns({
        "pos": F.row_number().over(w), "ret": F.col("rel") / F.lag("rel").over(w) - 1, "dd": F.col("rel") / F.max("rel").over(w) - 1})
    x = x.withColumn("uw", F.col("dd") < 0)
    last_clear = F.last(F.when(~F.col("uw"), F.col("pos")), ignorenulls=True).over(w)
    x = x.withColumn("run", F.when(F.col("uw"), F.col("pos") - F.coalesce(last_clear, F.lit(0))).otherwise(0))
    return x.withColumn("recovery", F.when(~F.col("uw") & (F.lag("run").over(w) > 0), F.lag("run").over(w)))


def prefix_metrics(path: DataFrame, keys: Sequence[str], date: str = "date") -> DataFrame:
    """Running (prefix) values of every metric that a running sum, max or min can carry."""
    w = Window.partitionBy(*keys).orderBy(date)
    s = lambda c: F.sum(c).over(w)
    n = F.count("ret").over(w)
    down = F.sqrt(s(F.pow(F.least(F.col("ret"), F.lit(0.0)), 2)) / F.nullif(n, F.lit(0)))
    return path.withColumns({
        "sessions": F.col("pos"), "downside_deviation": F.coalesce(down, F.lit(0.0)),
        "annual_excess": F.coalesce(F.avg("ret").over(w) * YEAR, F.lit(0.0)), "max_drawdown": F.min("dd").over(w),
        "current_drawdown": F.col("dd"), "drawdown_sessions": F.col("run"), "max_drawdown_sessions": F.max("run").over(w),
        "time_under_water": s(F.col("uw").cast("int")) / F.col("pos"), "impairment_area": s(-F.least(F.col("dd"), F.lit(0.0))),
        "impaired_5pct": s((F.col("dd") <= -0.05).cast("int")) / F.col("pos"),
        "impaired_10pct": s((F.col("dd") <= -0.10).cast("int")) / F.col("pos"),
        "period_days": F.datediff(date, F.min(date).over(w))}).withColumn(
        "sortino", F.when(F.col("downside_deviation") > 0, F.col("annual_excess") / F.nullif(
            F.col("downside_deviation") * F.sqrt(F.lit(float(YEAR))), F.lit(0.0))).otherwise(F.when(F.col("annual_excess") > 0, F.lit(float("inf"))).otherwise(0.0)))


class OrderStatistics:
    """The smallest of the values added so far: their sum and the one of a given rank, in logarithmic time.

    All values are known beforehand, so a value's place is its rank among them; a Fenwick tree holds counts and sums by place.
    """

    def __init__(self, values: np.ndarray):
        self.order = np.argsort(values, kind="stable")
        self.place = np.empty(len(values), np.int64)
        self.place[self.order] = np.arange(1, len(values) + 1)
        self.values, self.size, self.top = values, 0, 1 << max(0, len(values).bit_length() - 1)
        self.counts, self.sums = [0] * (len(values) + 1), [0.0] * (len(values) + 1)

    def add(self, k: int) -> None:
        at, value = int(self.place[k]), float(self.values[k])
        self.size += 1
        while at < len(self.counts):
            self.counts[at] += 1
            self.sums[at] += value
            at += at & -at

    def smallest(self, m: int) -> tuple[float, float]:
        """Sum of the ``m`` smallest, and the m-th of them."""
        at, left, total, step = 0, m, 0.0, self.top
        while step:
            if at + step < len(self.counts) and self.counts[at + step] < left:
                at += step
                left -= self.counts[at]
                total += self.sums[at]
            step >>= 1
        value = float(self.values[self.order[at]])
        return total + value * left, value


def tail_sweep(ret: np.ndarray, dd: np.ndarray, recovery: np.ndarray, ends: np.ndarray, alpha: float) -> list[tuple[float, float, float]]:
    """Expected shortfall, CDaR and median recovery of the rows up to each row of ``ends`` (rising), in one sweep."""
    losses, depths, back = OrderStatistics(ret), OrderStatistics(dd), OrderStatistics(recovery)
    worst = lambda tree, n: tree.smallest(m)[0] / m if (m := min(tree.size, max(1, math.ceil(n * alpha)))) else 0.0
    out, seen = [], 0
    for end in ends:
        for k in range(seen, end + 1):
            if ret[k] < 0:                                              # gains and missing returns never enter a mean of losses
                losses.add(k)
            if dd[k] < 0:
                depths.add(k)
            if recovery[k] == recovery[k]:
                back.add(k)
        seen = end + 1
        middle = 0.0
        if back.size:
            middle = (back.smallest((back.size + 1) // 2)[1] + back.smallest(back.size // 2 + 1)[1]) / 2
        out.append((worst(losses, end), worst(depths, end + 1), middle))
    return out


def tail_means(path: DataFrame, keys: Sequence[str], end: str, alpha: float = 0.05) -> DataFrame:
    """ES and CDaR (mean of the worst ceil(n * alpha) losses) and median recovery at each row where ``end`` holds.

    The worst k of a growing prefix are no running aggregate. A sweep per curve keeps them in order-statistic trees, so its rows
    are linear in the curve's history, which is as long as the calendar.
    """
    keys = list(keys)
    fields = [f"{f.name} {f.dataType.simpleString()}" for k in keys for f in path.schema.fields if f.name == k]

    def sweep(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        number = lambda c: table.column(c).cast(pa.float64()).to_numpy()
        ends = np.flatnonzero(table.column("end").to_numpy())
        found = tail_sweep(number("ret"), number("dd"), number("recovery"), ends, alpha)
        at = table.select([*keys, "pos"]).take(ends)
        for c, name in enumerate(("expected_shortfall", "cdar", "median_recovery")):
            at = at.append_column(name, pa.array([f[c] for f in found], pa.float64()))
        return at

    rows = path.select(*keys, F.col("pos").cast("long").alias("pos"), "ret", "dd", F.col("recovery").cast("double").alias("recovery"), F.col(end).alias("end"))
    return rows.groupBy(*keys).applyInArrow(sweep, ", ".join([*fields, "pos long, expected_shortfall double, cdar double, median_recovery double"]))


def wealth_metrics(nav: DataFrame, keys: Sequence[str], ends: str = "last", date: str = "date") -> DataFrame:
    """Full metric row per curve end (``last``) or per month end (``month``)."""
    path = relative_path(nav, keys, date)
    pre = prefix_metrics(path, keys, date)
    unit = Window.partitionBy(*keys) if ends == "last" else Window.partitionBy(*keys, F.trunc(date, "month"))
    marked = pre.withColumn("_e", F.max("pos").over(unit) == F.col("pos"))
    return marked.where("_e").drop("_e").join(tail_means(marked, keys, "_e"), [*keys, "pos"])


def max_drawdown_episode(nav: DataFrame, keys: Sequence[str], date: str = "date") -> DataFrame:
    """Peak and trough date of the deepest drawdown, and an in-episode flag per session."""
    w = Window.partitionBy(*keys).orderBy(date)
    x = nav.select(*keys, date, "rel").withColumn("peak", F.max("rel").over(w)).withColumn("dd", F.col("rel") / F.col("peak") - 1)
    x = x.withColumn("peak_at", F.last(F.when(F.col("rel") == F.col("peak"), F.col(date)), ignorenulls=True).over(w))
    trough = x.groupBy(*keys).agg(F.min_by(F.struct(F.col(date).alias("trough_date"), F.col("peak_at").alias("peak_date"), "dd"),
                                           F.struct("dd", date)).alias("_t")).select(*keys, "_t.trough_date", "_t.peak_date", F.col("_t.dd").alias("max_drawdown"))
    return x.select(*keys, date).join(trough, list(keys)).withColumn("in_episode", F.col(date).between(F.col("peak_date"), F.col("trough_date")))
