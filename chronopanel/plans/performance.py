"""Performance metrics, funnels and selector rules over panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.functions.domain import annualized
from chronopanel.functions.rounding import rnd
from chronopanel.functions.stats import share
from chronopanel.operators.ordered import quantiles


def performance_metrics(nav: DataFrame, trades: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Return, risk and trade statistics per curve; trades join by arm after their own aggregation."""
    w = Window.partitionBy(*keys).orderBy("date")
    run = lambda c: F.col(c) / F.max(c).over(w) - 1
    x = nav.withColumns({"sr": F.col("strategy_value") / F.lag("strategy_value").over(w) - 1, "br": F.col("bench_value") / F.lag("bench_value").over(w) - 1,
                         "sd": run("strategy_value"), "bd": run("bench_value"), "rd": run("rel")})
    first, last = (lambda c: F.min_by(c, "date")), (lambda c: F.max_by(c, "date"))
    a = x.groupBy(*keys).agg(
        first("strategy_value").alias("s0"), last("strategy_value").alias("s1"), first("bench_value").alias("b0"), last("bench_value").alias("b1"),
        F.datediff(F.max("date"), F.min("date")).cast("long").alias("period_days"), F.min("sd").alias("md"), F.min("bd").alias("bmd"), F.min("rd").alias("rmd"),
        (F.stddev_samp("sr") * F.sqrt(F.lit(252.0))).alias("sv"), (F.stddev_samp("br") * F.sqrt(F.lit(252.0))).alias("bv"), F.avg("positions").alias("ap"), F.max("positions").alias("max_positions"))
    t = trades.groupBy("arm").agg(F.count(F.lit(1)).alias("trade_count"), share(F.col("excess") > 0).alias("wr"), F.avg("stock_return").alias("mtr"), F.avg("hold").alias("mh"))
    t = t.join(quantiles(trades, ["arm"], "excess", {"mte": 0.5}), "arm")
    c, b = annualized(F.col("s0"), F.col("s1"), F.col("period_days")), annualized(F.col("b0"), F.col("b1"), F.col("period_days"))
    cols = {"total_return": F.col("s1") / F.col("s0") - 1, "bench_total_return": F.col("b1") / F.col("b0") - 1, "cagr": c, "cagr_excess": c - b, "max_drawdown": F.col("md"),
            "bench_max_drawdown": F.col("bmd"), "worst_relative_drawdown": F.col("rmd"), "volatility": F.col("sv"), "bench_volatility": F.col("bv"), "average_positions": F.col("ap"),
            "win_rate": F.col("wr"), "mean_trade_return": F.col("mtr"), "median_trade_excess": F.col("mte"), "mean_holding": F.col("mh")}
    return a.join(t, "arm").select(*keys, "period_days", "max_positions", "trade_count", *[rnd(v).alias(k) for k, v in cols.items()])


def activation_funnel(signals: DataFrame, entries: DataFrame, threshold: float) -> DataFrame:
    """Prediction days, days and tickers above the threshold, entries and the reason a fold stayed inactive.

    Distinct days and tickers are counted from (fold, day) and (fold, ticker) groups, so no distinct set grows in one task.
    """
    hot = F.col("score") >= threshold
    days = signals.groupBy("fold_id", "decision_date").agg(F.max(hot.cast("int")).alias("h")).groupBy("fold_id").agg(F.count(F.lit(1)).alias("prediction_days"), F.sum("h").alias("days_above"))
    names = signals.groupBy("fold_id", "ticker").agg(F.max(hot.cast("int")).alias("h")).groupBy("fold_id").agg(F.sum("h").alias("tickers_above"))
    x = days.join(names, "fold_id").join(entries, "fold_id", "left").withColumn("entries", F.coalesce("entries", F.lit(0)))
    reason = F.when(F.col("entries") > 0, "ACTIVE_FOLD").when(F.col("days_above") == 0, "NO_SCORE_ABOVE_THRESHOLD").otherwise("OTHER")
    return x.select("fold_id", "prediction_days", "days_above", rnd(F.col("days_above") / F.col("prediction_days")).alias("activation_fraction"), "tickers_above", "entries", reason.alias("reason"))


def state_selector_rules(state: DataFrame, target: str) -> DataFrame:
    """Oracle, equal, current-winner, top-quartile and persistent-top (second consecutive TOP) rules per level and arm."""
    w = Window.partitionBy("cluster_level", "arm", "cluster_id").orderBy("date_pos")
    was_top = (F.lag("quartile").over(w) == "TOP") & (F.lag("date_pos").over(w) == F.col("date_pos") - 1)
    x = state.withColumn("_was", was_top)
    v, top = F.col(target), F.col("quartile") == "TOP"
    d = x.groupBy("cluster_level", "arm", "assessment_date").agg(
        F.count(v).alias("_n"), F.max(v).alias("oracle"), F.avg(v).alias("equal_weight"), F.max(F.when(F.col("rank") == 1, v)).alias("current_winner"),
        F.avg(F.when(top, v)).alias("top_quartile"), F.coalesce(F.avg(F.when(top & F.col("_was"), v)), F.lit(0.0)).alias("persistent_top")).where("_n > 0")
    long = d.unpivot(["cluster_level", "arm", "assessment_date"], ["oracle", "equal_weight", "current_winner", "top_quartile", "persistent_top"], "rule", "v")
    return long.where("v IS NOT NULL").groupBy("cluster_level", "arm", "rule").agg(F.count("v").alias("observations"), rnd(F.avg("v")).alias("mean_excess"), rnd(F.product(1 + F.col("v")) - 1).alias("compounded"))


def baseline_comparison(panel: DataFrame, prediction: str, trailing: str, target: str, costs: Sequence[int]) -> DataFrame:
    """Predicted-best selector against equal weight, the trailing winner and the oracle at several switch costs."""
    best = lambda out, by: F.max_by(out, F.struct(F.round(by, 9), "family_id"))
    g = panel.groupBy("arm", "assessment_date").agg(best("family_id", prediction).alias("selected"), best(target, prediction).alias("gross"), F.avg(target).alias("eq"), F.max(target).alias("oracle"), best(target, trailing).alias("tr"))
    w = Window.partitionBy("arm").orderBy("assessment_date")
    x = g.withColumn("sw", F.coalesce(F.lag("selected").over(w) != F.col("selected"), F.lit(False)).cast("int")).withColumn("bps", F.explode(F.array(*[F.lit(c) for c in costs])))
    net = F.col("gross") - F.col("sw") * F.col("bps") / 10000.0
    return x.groupBy("arm", "bps").agg(F.count(F.lit(1)).alias("months"), F.sum("sw").alias("switches"), rnd(F.avg(net)).alias("selector_excess"), rnd(F.avg("eq")).alias("equal_weight"),
                                       rnd(F.avg("tr")).alias("trailing_1m"), rnd(F.avg(F.col("oracle") - net)).alias("oracle_regret"), rnd(F.avg(net - F.col("eq"))).alias("incremental"))
