"""Session calendar and maturity: positions are session counts, never calendar days.

The session table has one row per trading day, so ordering it in one window is
bounded by the calendar; fact tables only ever meet it through equi-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def session_index(dates: DataFrame, date: str = "date") -> DataFrame:
    """Number the distinct sessions 0, 1, 2, ..."""
    distinct = dates.select(F.col(date).alias("date")).where(F.col(date).isNotNull()).distinct()
    return distinct.select("date", (F.row_number().over(Window.orderBy("date")) - 1).cast("long").alias("idx"))


def shift_sessions(sessions: DataFrame, by: int, name: str) -> DataFrame:
    """Calendar-sized map date -> date ``by`` sessions later (NULL past the end)."""
    w = Window.orderBy("idx")
    moved = F.lead("date", by) if by >= 0 else F.lag("date", -by)
    return sessions.select("date", moved.over(w).alias(name))


def attach_terminal(df: DataFrame, sessions: DataFrame, horizon: int | Column,
                    decision: str = "decision_date", name: str = "terminal_date") -> DataFrame:
    """Session ``horizon`` positions after each decision; NULL when the calendar ends first."""
    at = sessions.select(F.col("date").alias(decision), F.col("idx").alias("_idx"))
    to = sessions.select(F.col("idx").alias("_to"), F.col("date").alias(name))
    h = F.lit(horizon) if isinstance(horizon, int) else horizon
    return (df.join(at, decision, "left").withColumn("_to", F.col("_idx") + h)
            .join(to, "_to", "left").drop("_idx", "_to"))


def latest_matured(cutoffs: DataFrame, sessions: DataFrame, horizons: list[int],
                   cutoff: str = "cutoff") -> DataFrame:
    """Latest decision whose +H session has happened by each cutoff (NULL before the first)."""
    from chronopanel.operators.asof import asof_join
    here = asof_join(cutoffs.select(cutoff).distinct(), sessions.withColumnRenamed("date", "_session"), [],
                     cutoff, "_session", how="inner")
    wanted = here.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    back = sessions.select(F.col("idx").alias("_at"), F.col("date").alias("latest_decision"))
    return (wanted.withColumn("_at", F.col("idx") - F.col("horizon")).join(back, "_at", "left")
            .select(cutoff, "horizon", "latest_decision"))


def matured(df: DataFrame, cutoff: Column, terminal: str = "terminal_date") -> DataFrame:
    """Rows whose outcome is known at the cutoff: terminal <= cutoff; unknown terminals never are."""
    return df.where(F.col(terminal) <= cutoff)


def fold_availability(df: DataFrame, fold: str = "fold_id", terminal: str = "terminal_date") -> DataFrame:
    """When a fold becomes evidence: its last terminal, NULL while any terminal is unknown."""
    known = F.bool_and(F.col(terminal).isNotNull())
    return df.groupBy(fold).agg(F.when(known, F.max(terminal)).alias("available_at"),
                                F.count(F.lit(1)).alias("n_rows"))


def period_dates(sessions: DataFrame, unit: str = "month") -> DataFrame:
    """First and last session of every period."""
    return (sessions.groupBy(F.trunc("date", unit).alias("period"))
            .agg(F.min("date").alias("first_session"), F.max("date").alias("last_session")))


def every_nth(sessions: DataFrame, n: int) -> DataFrame:
    """Assessment sessions n-1, 2n-1, ... plus the last one."""
    top = sessions.agg(F.max("idx"))
    flagged = sessions.withColumn("_last", top.scalar())
    return flagged.where(((F.col("idx") + 1) % n == 0) | (F.col("idx") == F.col("_last"))).drop("_last")


def expanding_folds(sessions: DataFrame, train: int, validation: int, step: int, purge: int,
                    embargo: int = 0) -> DataFrame:
    """Expanding walk-forward folds as index ranges (train | purge | validation).

    Fold k validates sessions [train + purge + k*step, +validation) and trains
    on everything up to ``purge`` sessions before; only complete folds count.
    """
    last = sessions.agg(F.max("idx").alias("last"))
    start = train + purge
    folds = last.select("last", F.explode(F.expr(
        f"if(last + 1 >= {start + validation}, sequence(0L, (last + 1 - {start + validation}) div {step}), "
        "cast(array() as array<bigint>))")).alias("k"))
    first = F.lit(start) + F.col("k") * step
    return folds.select(
        F.col("k").alias("fold"), F.lit(0).cast("long").alias("train_start"),
        (first - purge - 1).alias("train_end"), (first + embargo).alias("valid_start"),
        (first + validation - 1).alias("valid_end"))


def cohorts(sessions: DataFrame, length: int = 21) -> DataFrame:
    """Fixed-length session cohorts, counted from the second session."""
    return sessions.where("idx >= 1").withColumn("cohort", F.floor((F.col("idx") - 1) / length))


def every_nth_only(sessions: DataFrame, n: int, name: str = "assessment_date") -> DataFrame:
    return sessions.where((F.col("idx") + 1) % n == 0).select(F.col("date").alias(name))
