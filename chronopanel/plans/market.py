"""Market state, regimes, total-return index, momentum universe, allocation path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.operators.asof import forward_asof
from chronopanel.operators.joins import date_positions
from chronopanel.operators.ordered import quantiles, top_rows
from chronopanel.operators.windows import drawdown, pct_change, period_end_rows, rolling


def monthly_market_state(prices: DataFrame, bench: DataFrame) -> DataFrame:
    """Trend, volatility, breadth, dispersion and liquidity at each month end; long form, no wide pivot."""
    w = Window.partitionBy("ticker").orderBy("date")
    t = prices.withColumns({"r1": pct_change("close", 1, w), "r20": pct_change("close", 20, w), "lv": F.log1p("volume")})
    cross = t.groupBy("date").agg(F.avg((F.coalesce("r20", F.lit(-1.0)) > 0).cast("int")).alias("market_breadth"),
                                  F.stddev_pop("r1").alias("cross_sectional_dispersion"))
    cross = cross.join(quantiles(t, ["date"], "lv", {"liquidity_state": 0.5}), "date")
    b = Window.orderBy("date")
    m = bench.withColumn("r", pct_change("close", 1, b)).withColumns({
        "benchmark_trend": F.col("close") / rolling(F.avg, "close", 63, 20, b) - 1, "market_volatility": rolling(F.stddev_pop, "r", 21, 10, b)})
    days = m.join(cross, "date").select("date", "benchmark_trend", "market_volatility", "market_breadth", "cross_sectional_dispersion", "liquidity_state")
    return period_end_rows(days, [], "date", "month").withColumnRenamed("date", "assessment_date")


def lagged_features(bench: DataFrame) -> DataFrame:
    """Benchmark features shifted by one session, so a decision never sees its own close."""
    w = Window.orderBy("date")
    x = bench.withColumn("ret", pct_change("close", 1, w)).withColumns({"c1": F.lag("close").over(w), "r1": F.lag("ret").over(w)})
    return x.select(F.col("date").alias("decision_date"), (F.col("c1") / F.lag("close", 21).over(w) - 1).alias("trailing_20"),
                    (rolling(F.stddev_samp, "r1", 20, 20, w) * F.sqrt(F.lit(252.0))).alias("volatility_20"),
                    (F.col("c1") / rolling(F.max, "c1", 252, 252, w) - 1).alias("drawdown_252"))


def regime_label(ret: Column, distance: Column, vol: Column, bull: float, bear: float, dist: float, max_vol: float) -> Column:
    """Ordered masks, later ones win; unknown inputs are TRANSITION."""
    sideways = (F.abs(ret) < abs(bull) / 2) & (F.abs(distance) < dist * 1.5) & (vol < max_vol)
    return (F.when(ret.isNull() | distance.isNull(), "TRANSITION").when(sideways, "SIDEWAYS")
            .when((ret <= bear) & (distance <= -dist), "STRONG_BEAR").when((ret >= bull) & (distance >= dist), "STRONG_BULL").otherwise("TRANSITION"))


def benchmark_regimes(bench: DataFrame, *, momentum: int, ma: tuple[int, int], vol: tuple[int, int], bull: float, bear: float,
                      distance: float, max_vol: float, value: str = "bench_value") -> DataFrame:
    w = Window.orderBy("date")
    x = bench.withColumn("_r", pct_change(value, 1, w)).withColumns({
        "ret": pct_change(value, momentum, w), "distance": F.col(value) / rolling(F.avg, value, *ma, w) - 1,
        "drawdown": drawdown(value, w), "vol": rolling(F.stddev_samp, "_r", *vol, w)})
    return x.withColumn("regime", regime_label(F.col("ret"), F.col("distance"), F.col("vol"), bull, bear, distance, max_vol))


def total_return_index(prices: DataFrame, cash: DataFrame, sessions: DataFrame) -> DataFrame:
    """Units grow by cash / open on the payment session (first session at or after the payable date)."""
    paid = forward_asof(cash, sessions.select(F.col("date").alias("pay_session")), "payable_date", "pay_session").where(
        "pay_session IS NOT NULL").groupBy("ticker", F.col("pay_session").alias("date")).agg(F.sum("cash").alias("cash"))
    w = Window.partitionBy("ticker").orderBy("date")
    x = prices.join(paid, ["ticker", "date"], "left")
    return x.withColumn("units", F.exp(F.sum(F.log1p(F.coalesce("cash", F.lit(0.0)) / F.col("open"))).over(w))).withColumn(
        "total_return_value", F.col("units") * F.col("close"))


def momentum_universe(prices: DataFrame, *, skip: int, lookback: int, adv: int, universe: int, keep: int, top: int) -> DataFrame:
    """Liquid universe ranked by skip-momentum; the two daily rankings are capped, so Spark limits them per task."""
    w = Window.partitionBy("ticker").orderBy("date")
    frame = w.rowsBetween(-(adv - 1), 0)
    x = prices.withColumns({
        "momentum": F.lag("close", skip).over(w) / F.lag("close", lookback).over(w) - 1,
        "_adv": F.avg(F.col("close") * F.col("volume")).over(frame), "_n": F.count(F.lit(1)).over(frame)}).where(
        (F.col("_n") >= adv) & F.col("momentum").isNotNull())
    liquid = top_rows(x, ["date"], [F.desc(F.round("_adv", 6)), F.asc("ticker")], universe, "_liq")
    return top_rows(liquid, ["date"], [F.desc(F.round("momentum", 9)), F.asc("ticker")], keep, "rank").withColumn("fresh_pick", F.col("rank") <= top)


def market_state(bench: DataFrame, high_vol: float, value: str = "bench_value") -> DataFrame:
    """As-of state with partial windows: missing momentum is 0."""
    w = Window.orderBy("date")
    mom = lambda n: F.coalesce(F.col(value) / F.lag(value, n).over(w) - 1, F.lit(0.0))
    x = bench.withColumn("_r", pct_change(value, 1, w)).withColumns({
        "m20": mom(20), "m60": mom(60), "m120": mom(120), "trend100": F.col(value) / F.avg(value).over(w.rowsBetween(-99, 0)) - 1,
        "vol20": F.when(F.row_number().over(w) > 2, F.stddev_pop("_r").over(w.rowsBetween(-19, 0))).otherwise(0.0)})
    x = x.withColumn("stress", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("vol20") * 10 + F.greatest(F.lit(0.0), -F.col("m20")) * 2)))
    up, hot = F.col("m20") > 0, F.col("vol20") > high_vol
    return x.withColumn("regime", F.when(F.col("stress") > 0.7, "STRESS").when(up & hot, "UP_HIGH_VOL").when(up, "UP_LOW_VOL")
                        .when(hot, "DOWN_HIGH_VOL").otherwise("DOWN_LOW_VOL"))


def allocation_path(weights: DataFrame, cost_rate: float) -> DataFrame:
    """Half the absolute weight change between consecutive decisions, its cost, and the net wealth path.

    Each weight row is emitted for its own date (+w) and the next one (-w); summing per (date, member)
    gives the change, including members that enter or leave, in one aggregation.
    """
    pos = date_positions(weights, ["arm"], "assessment_date", "pos")
    x = weights.join(pos, ["arm", "assessment_date"])
    change = x.select("arm", "family_id", F.inline(F.array(
        F.struct(F.col("pos").alias("pos"), F.col("w").alias("dw")), F.struct((F.col("pos") + 1).alias("pos"), (-F.col("w")).alias("dw")))))
    turn = (change.groupBy("arm", "pos", "family_id").agg(F.abs(F.sum("dw")).alias("a")).groupBy("arm", "pos").agg((F.sum("a") * 0.5).alias("turnover")))
    gross = x.groupBy("arm", "pos", "assessment_date").agg(F.sum(F.col("w") * F.col("ret")).alias("gross"))
    w = Window.partitionBy("arm").orderBy("pos")
    y = gross.join(turn, ["arm", "pos"]).withColumn("cost", F.col("turnover") * cost_rate).withColumn("net", F.col("gross") - F.col("cost"))
    return y.withColumn("nav", F.exp(F.sum(F.log1p("net")).over(w)))
