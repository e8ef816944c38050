"""Realised outcomes on the session calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def realized_outcomes(prices: DataFrame, bench: DataFrame, sessions: DataFrame, horizon: int,
                      cost: float = 0.0) -> DataFrame:
    """Next-open to +H-close returns per (decision session, ticker).

    Built on the price grid, one row per (session, ticker), so each signal row
    later needs a single join; each bar feeds the decision it opens and the one
    it closes, so both price legs meet in one aggregation, without a join.
    """
    bar = prices.join(sessions, "date")
    none = lambda t: F.lit(None).cast(t)
    legs = bar.select("ticker", F.inline(F.array(
        F.struct((F.col("idx") - 1).alias("idx"), F.col("open").alias("entry_open"), none("double").alias("terminal_close")),
        F.struct((F.col("idx") - horizon).alias("idx"), none("double").alias("entry_open"), F.col("close").alias("terminal_close")))))
    both = (legs.groupBy("ticker", "idx").agg(F.max("entry_open").alias("entry_open"), F.max("terminal_close").alias("terminal_close"))
            .where("entry_open > 0 AND terminal_close > 0"))
    # one calendar-sized table of dates and benchmark marks per decision session
    w = Window.orderBy("idx")
    marks = sessions.join(bench, "date", "left").select(
        "idx", F.col("date").alias("decision_date"), F.lead("date", 1).over(w).alias("entry_date"), F.lead("date", horizon).over(w).alias("terminal_date"),
        F.lead("open", 1).over(w).alias("bench_open"), F.lead("close", horizon).over(w).alias("bench_close")).where(
        "bench_open > 0 AND bench_close > 0")
    gross = F.col("terminal_close") / F.col("entry_open")
    bgross = F.col("bench_close") / F.col("bench_open")
    return (both.join(marks, "idx")
            .select("decision_date", "ticker", "entry_date", "terminal_date", "entry_open", "terminal_close",
                    "bench_open", "bench_close", (gross - 1).alias("stock_return"), (bgross - 1).alias("bench_return"),
                    (gross / bgross - 1 - F.lit(cost)).alias("excess")))
