"""Composed evidence flows: family evidence, opportunity panel, gated trades by month."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.operators.asof import asof_join
from chronopanel.operators.joins import causal_schedule_expansion, executed_flag
from chronopanel.operators.ordered import rank_columns, rank_ic
from chronopanel.operators.trades import next_open_trades
from chronopanel.operators.wealth import wealth_metrics


def family_evidence(nav: DataFrame, schedule: DataFrame, trades: DataFrame, periods: dict[str, int] | None = None, recent: int = 4, span: int = 13) -> DataFrame:
    """Month-end evidence per curve of a family: wealth metrics, trailing and decayed excess, the family's active generation, its matured trades.

    ``periods`` names trailing windows in sessions. Trades reduce to (family, arm, ticker, exit session) sums before any
    prefix is taken; a month end then meets one prefix per ticker of its family.
    """
    from chronopanel.operators.folds import ewma
    keys = ["family_id", "arm"]
    w = Window.partitionBy(*keys).orderBy("date")
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    path = nav.select(*keys, "date", "rel", (F.col("rel") / F.lag("rel").over(w) - 1).alias("_x"))
    tail = path.select(*keys, "date", *[(F.col("rel") / F.lag("rel", n).over(w) - 1).alias(f"excess_{p}") for p, n in (periods or {"1m": 4, "3m": 13, "6m": 26, "12m": 52}).items()],
                       (F.avg("_x").over(w.rowsBetween(1 - recent, 0)) - F.avg("_x").over(past)).alias("recent_minus_long_run_excess"))
    decayed = ewma(path.where("_x IS NOT NULL"), keys, "date", "_x", span).withColumnRenamed("ewma", "ewma_excess")
    last = Window.partitionBy(*keys, F.trunc("date", "month")).orderBy(F.desc("date"))
    ends = path.withColumn("_k", F.row_number().over(last)).where("_k = 1").withColumn("_up", (F.col("rel") > F.lag("rel").over(w)).cast("int"))
    months = ends.select(*keys, "date", F.avg("_up").over(past).alias("positive_period_fraction"))
    base = wealth_metrics(nav, keys, "month").join(tail, [*keys, "date"]).join(months, [*keys, "date"]).join(decayed, [*keys, "date"], "left")
    active = asof_join(base, schedule, ["family_id"], "date", "activation_date", how="inner")
    day = trades.groupBy(*keys, "ticker", "exit_date").agg(
        F.count(F.lit(1)).alias("n"), F.sum("excess").alias("s"), F.sum(F.greatest("excess", F.lit(0.0))).alias("p"), F.max("excess").alias("m"))
    wt = Window.partitionBy(*keys, "ticker").orderBy("exit_date")
    state = day.select(*keys, "ticker", "exit_date", *[f(c).over(wt).alias(c) for c, f in (("n", F.sum), ("s", F.sum), ("p", F.sum), ("m", F.max))])
    seen = asof_join(base.select(*keys, "date"), state, keys, "date", "exit_date", how="inner", fan_out=["ticker"])
    matured = seen.groupBy(*keys, "date").agg(
        F.sum("n").alias("matured_trades"), F.sum("s").alias("_s"), F.sum("p").alias("_p"), F.max("m").alias("_m"), F.max("p").alias("_tp"), F.count_if(F.col("s") > 0).alias("independent_winners"),
        (F.max(F.abs("s")) / F.nullif(F.sum(F.abs("s")), F.lit(0.0))).alias("ticker_concentration"))
    out = active.join(matured, [*keys, "date"], "left").na.fill({"matured_trades": 0, "independent_winners": 0, "ticker_concentration": 0.0})
    share = lambda c: F.coalesce(F.greatest(c, F.lit(0.0)) / F.nullif("_p", F.lit(0.0)), F.lit(0.0))
    return (out.withColumn("top_trade_contribution", share("_m")).withColumn("top_ticker_contribution", share("_tp"))
            .withColumn("leave_best_out", F.coalesce((F.col("_s") - F.col("_m")) / F.greatest(F.lit(1), F.col("matured_trades") - 1), F.lit(0.0)))
            .withColumn("sample_weight", F.least(F.lit(1.0), F.sqrt(F.col("matured_trades") / 30.0))).drop("_s", "_p", "_m", "_tp"))


def opportunity_panel(signals: DataFrame, arms: DataFrame, outcomes: DataFrame, executed: DataFrame, holdout: str) -> DataFrame:
    """Distinct rows before the holdout, expanded to arms, percentile-ranked, gated, with outcomes and executed flags."""
    boundary = F.to_date(F.lit(holdout))
    base = signals.dropDuplicates().where(F.col("decision_date") < boundary)
    ranked = rank_columns(base, ["decision_date", "family_id"], "score", pct="score_percentile")
    rows = causal_schedule_expansion(ranked, arms)
    live = rows.where(F.col("score") >= F.col("threshold")).withColumn("distance", F.col("score") - F.col("threshold"))
    out = live.join(outcomes, ["decision_date", "ticker"], "left")
    out = out.withColumn("has_target", F.coalesce(F.col("excess").isNotNull() & (F.col("terminal_date") < boundary), F.lit(False)))
    return executed_flag(out, executed, ["ticker", "decision_date"])


def gated_trades_by_month(signals: DataFrame, prices: DataFrame, bench: DataFrame, sessions: DataFrame, panel: DataFrame, *,
                          threshold: float, top_fraction: float, max_names: int, hold: int) -> DataFrame:
    """Threshold-gated next-open trades with rank IC and mean excess per decision month; ``authoritative_signals`` picks the scores that count."""
    trades = next_open_trades(signals, prices, bench, sessions, threshold=threshold, top_fraction=top_fraction, max_names=max_names, hold=hold)
    month = F.trunc("decision_date", "month").alias("month")
    per = trades.groupBy(month).agg(
        F.count(F.lit(1)).alias("trades"), F.count_if("is_open").alias("open_trades"), F.avg("stock_return").alias("mean_return"),
        F.avg("excess").alias("mean_excess"), F.avg("net_return").alias("mean_net_return"))
    ic = rank_ic(panel.withColumn("month", F.trunc("decision_date", "month")), ["month"], "score", "excess").drop("n_rows")
    return per.join(ic, "month", "left")
