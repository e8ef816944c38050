"""As-of and interval joins without a global sort of the fact side.

A schedule becomes non-overlapping validity intervals per key, and these one row per key: an array over consecutive coarse
time slots, each holding the intervals that touch it. The first slot is the schedule's first one, and what is valid in
its last slot is valid in every later one. A fact meets the row of its key, takes the element of its own slot (the last
one at most) and filters its few intervals, so both sides are read once, neither is sorted by time, and a fact row never
multiplies. The schedule side has one row per key: Spark broadcasts it when its measured size allows, and AQE splits a
hot key's facts otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _slot(value: Column, grain: str) -> Column:
    return F.date_trunc(grain, value).cast("date")


def validity_intervals(schedule: DataFrame, keys: Sequence[str], start: str) -> DataFrame:
    """Half-open [_from, _to) validity of each schedule row; the last one stays open (NULL). Two rows of one start fail the query."""
    w = Window.partitionBy(*keys).orderBy(start)
    once = F.when(F.col("_to") == F.col(start), F.raise_error(F.lit(f"schedule is not unique on {', '.join([*keys, start])}"))).otherwise(F.col("_to"))
    return schedule.withColumn("_from", F.col(start)).withColumn("_to", F.lead(start).over(w)).withColumn("_to", once)


def asof_join(left: DataFrame, schedule: DataFrame, keys: Sequence[str], left_time: str, start: str, *,
              strict: bool = False, how: str = "left", grain: str = "month", fan_out: Sequence[str] = ()) -> DataFrame:
    """Latest schedule row with ``start <= left_time`` (``<`` when strict) for the same keys.

    ``schedule`` must be unique on (keys, fan_out, start).
    ``fan_out`` names schedule-only keys: each left row meets the latest row of every such group. A NULL key or time meets nothing.
    """
    keys = list(keys)
    payload = [c for c in schedule.columns if c not in keys]
    row = F.struct("_from", "_to", *[F.col(c).alias(f"_p_{c}") for c in payload])
    names = [f"_r_{k}" for k in keys] or ["_r_"]
    iv = validity_intervals(schedule.where(F.col(start).isNotNull()), [*keys, *fan_out], start)
    iv = iv.select(*([F.col(k).alias(n) for k, n in zip(keys, names)] or [F.lit(0).alias("_r_")]), _slot(F.col("_from"), grain).alias("_a"), _slot(F.col("_to"), grain).alias("_b"), row.alias("_v"))
    iv = iv.withColumn("_last", F.max("_a").over(Window.partitionBy(*names)))
    cells = (iv.select(*names, F.explode(F.sequence("_a", F.least(F.coalesce("_b", "_last"), "_last"), F.expr(f"interval 1 {grain}"))).alias("_slot"), "_v")
             .groupBy(*names, "_slot").agg(F.collect_list("_v").alias("_in")).groupBy(*names)
             .agg(F.min("_slot").alias("_first"), F.array_sort(F.collect_list(F.struct("_slot", "_in"))).alias("_cells")))
    t = F.col(left_time)
    slot = _slot(t, grain)
    place = F.when(slot >= F.col("_first"), F.least(F.size("_cells"), 1 + (F.months_between(slot, F.col("_first")).cast("int") if grain == "month" else F.datediff(slot, F.col("_first")))))
    inside = (lambda v: (v["_from"] < t) & (v["_to"].isNull() | (t <= v["_to"]))) if strict else (lambda v: (v["_from"] <= t) & (v["_to"].isNull() | (t < v["_to"])))
    cond = F.lit(0) == F.col("_r_")
    if keys:
        cond = reduce(lambda x, y: x & y, (left[k] == F.col(n) for k, n in zip(keys, names)))
    met = left.join(cells, cond, "inner" if how == "inner" else "left")
    here = F.when(place.isNotNull(), F.element_at("_cells", place)["_in"])          # element_at alone is not nullable in ANSI mode
    met = met.withColumn("_hit", F.filter(here, inside)).drop(*names, "_first", "_cells")
    hit = (F.explode if how == "inner" else F.explode_outer)("_hit").alias("_v")
    return met.select(*left.columns, hit).select(*left.columns, *[F.col(f"_v._p_{c}").alias(c) for c in payload])


def forward_asof(left: DataFrame, right: DataFrame, left_time: str, right_time: str) -> DataFrame:
    """First right time >= left time, for calendar-sized right sides.

    Resolved at the distinct-date grain (calendar-sized), then joined back by equality.
    """
    days = left.select(F.col(left_time).alias("_t")).distinct().withColumn("_hit", F.lit(None).cast("date"))
    marks = right.select(F.col(right_time).alias("_t"), F.col(right_time).alias("_hit")).distinct()
    both = days.unionByName(marks).groupBy("_t").agg(F.max("_hit").alias("_hit"))
    w = Window.orderBy("_t").rowsBetween(0, Window.unboundedFollowing)
    found = both.select(F.col("_t").alias(left_time), F.first("_hit", ignorenulls=True).over(w).alias(right_time))
    return left.join(found, left_time, "left")


def interval_join(left: DataFrame, points: DataFrame, keys: Sequence[str], start: str, end: str, point: str, *,
                  how: str = "inner", grain: str = "month") -> DataFrame:
    """Pairs with start < point <= end, equi-joined on keys and the time slot of the point."""
    keys = list(keys)
    spread = left.withColumn("_slot", F.explode(F.sequence(
        _slot(F.col(start), grain), _slot(F.col(end), grain), F.expr(f"interval 1 {grain}"))))
    pts = points.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                        *[c for c in points.columns if c not in keys],
                        _slot(F.col(point), grain).alias("_pslot"))
    cond = (F.col("_slot") == F.col("_pslot")) & (F.col(point) > F.col(start)) & (F.col(point) <= F.col(end))
    for k in keys:
        cond = cond & (spread[k] == F.col(f"_r_{k}"))
    return spread.join(pts, cond, how).drop("_slot", "_pslot", *[f"_r_{k}" for k in keys])
