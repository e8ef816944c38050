"""Trade tables and exit timing; set-based, no cash ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.operators.gates import entry_candidates
from chronopanel.operators.joins import position_sessions
from chronopanel.operators.ordered import top_rows


def open_to_open(trades: DataFrame, prices: DataFrame, bench: DataFrame) -> DataFrame:
    """Stock, benchmark-relative return between entry and exit opens (trades without both bars drop out)."""
    bar = lambda side: prices.select("ticker", F.col("date").alias(f"{side}_date"), F.col("open").alias(f"{side}_price"))
    mark = lambda side: bench.select(F.col("date").alias(f"{side}_date"), F.col("open").alias(f"{side}_bench"))
    out = (trades.join(bar("entry"), ["ticker", "entry_date"]).join(bar("exit"), ["ticker", "exit_date"])
           .join(mark("entry"), "entry_date").join(mark("exit"), "exit_date"))
    gross = F.col("exit_price") / F.col("entry_price")
    return out.withColumn("stock_return", gross - 1).withColumn(
        "excess", gross / (F.col("exit_bench") / F.col("entry_bench")) - 1)


def next_open_trades(signals: DataFrame, prices: DataFrame, bench: DataFrame, sessions: DataFrame, *, threshold: float,
                     top_fraction: float, max_names: int, hold: int, roundtrip_bps: float = 20.0) -> DataFrame:
    """Gated picks entered at the next open and left at the open after the D-th held close.

    Positions whose exit session lies beyond the calendar stay open (NULL exit).
    """
    picks = entry_candidates(signals, threshold, top_fraction, max_names)
    at = sessions.select(F.col("date").alias("decision_date"), "idx")
    to = lambda name: sessions.select(F.col("idx").alias(f"_{name}"), F.col("date").alias(f"{name}_date"))
    t = (picks.join(at, "decision_date").withColumn("_entry", F.col("idx") + 1).withColumn("_exit", F.col("idx") + 1 + hold)
         .join(to("entry"), "_entry").join(to("exit"), "_exit", "left").drop("_entry", "_exit", "idx"))
    bar = lambda side: prices.select("ticker", F.col("date").alias(f"{side}_date"), F.col("open").alias(f"{side}_price"))
    mark = lambda side: bench.select(F.col("date").alias(f"{side}_date"), F.col("open").alias(f"{side}_bench"))
    t = (t.join(bar("entry"), ["ticker", "entry_date"]).join(bar("exit"), ["ticker", "exit_date"], "left")
         .join(mark("entry"), "entry_date").join(mark("exit"), "exit_date", "left"))
    gross = F.col("exit_price") / F.col("entry_price")
    side = roundtrip_bps / 2 / 10000.0
    return (t.withColumn("is_open", F.col("exit_price").isNull()).withColumn("stock_return", gross - 1)
            .withColumn("excess", gross / (F.col("exit_bench") / F.col("entry_bench")) - 1)
            .withColumn("net_return", gross * (1 - side) * (1 - side) - 1))


def path_exits(trades: DataFrame, prices: DataFrame, bench: DataFrame, sessions: DataFrame, rules: dict[str, tuple[str, float]], valid: DataFrame | None = None) -> DataFrame:
    """First held session meeting each rule, else the planned last session.

    Rules: RELATIVE_STOP (excess <= x), TRAILING (excess <= peak excess - x), TAKE_PROFIT (excess >= x), SIGNAL_DECAY (the name is
    not among the day's ``valid`` picks: decision_date, ticker). The held path is at most the holding length, so its window is short.
    """
    bars = prices
    if valid is not None:
        picks = valid.select(F.col("decision_date").alias("date"), "ticker").distinct()
        bars = prices.join(picks.withColumn("picked", F.lit(True)), ["date", "ticker"], "left")
    # what bars know goes along with them, so the held path is shuffled once, by trade
    path = position_sessions(trades, bars, sessions, marks=[] if valid is None else ["picked"]).where("entry_open IS NOT NULL")
    marks = bench.join(sessions, "date")
    b_close = marks.select("idx", F.col("close").alias("bench_close"))
    b_open = marks.select(F.col("idx").alias("entry_idx"), F.col("open").alias("bench_open"))
    x = (path.where("idx < exit_idx").join(b_close, "idx").join(b_open, "entry_idx")
         .withColumn("excess", F.col("close") / F.col("entry_open") / (F.col("bench_close") / F.col("bench_open")) - 1))
    w = Window.partitionBy("trade_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("peak", F.greatest(F.lit(0.0), F.max("excess").over(w)))
    test = {"RELATIVE_STOP": lambda v: F.col("excess") <= v, "TRAILING": lambda v: F.col("excess") <= F.col("peak") - v,
            "TAKE_PROFIT": lambda v: F.col("excess") >= v, "SIGNAL_DECAY": lambda v: F.col("picked").isNull()}
    hits = [F.struct(F.lit(n).alias("rule"), F.min(F.when(test[kind](v), F.col("idx"))).alias("hit")) for n, (kind, v) in rules.items()]
    out = x.groupBy("trade_id", "ticker", "entry_idx", "exit_idx").agg(F.array(*hits).alias("_h"))
    return out.select("trade_id", "ticker", F.inline("_h"), "entry_idx", "exit_idx").withColumn(
        "exit_session", F.coalesce("hit", F.col("exit_idx") - 1)).withColumn(
        "held_sessions", F.col("exit_session") - F.col("entry_idx") + 1).withColumn("early", F.col("hit").isNotNull())


def true_range_atr(prices: DataFrame, n: int = 14) -> DataFrame:
    """True range and its n-session mean (0 until n ranges exist)."""
    w = Window.partitionBy("ticker").orderBy("date")
    prior = F.lag("close").over(w)
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prior), F.abs(F.col("low") - prior))
    frame = w.rowsBetween(-(n - 1), 0)
    return (prices.withColumn("true_range", tr).withColumn(
        "atr", F.when(F.count("true_range").over(frame) >= n, F.avg("true_range").over(frame)).otherwise(0.0)))


def stop_overlay(trades: DataFrame, prices: DataFrame, sessions: DataFrame, specs: list[dict]) -> DataFrame:
    """First stop per (trade, spec) from prior-known high and ATR; gap fills at the open, touch fills at the level."""
    x = position_sessions(trades, true_range_atr(prices), sessions, marks=["atr"])
    w = Window.partitionBy("trade_id").orderBy("idx")
    entry = F.first("open").over(w.rowsBetween(Window.unboundedPreceding, 0))
    x = (x.withColumn("entry_price", entry).withColumn("held", F.row_number().over(w) - 1)
         .withColumn("known_high", F.greatest(F.col("entry_price"), F.max("high").over(w.rowsBetween(Window.unboundedPreceding, -1))))
         .withColumn("known_atr", F.coalesce(F.lag("atr").over(w), F.lit(0.0))).where("held >= 1 AND idx < exit_idx"))

    def level(s: dict) -> Column:
        parts = []
        if s.get("hard"):
            parts.append(F.col("entry_price") * (1 - s["hard"]))
        if s.get("trail"):
            parts.append(F.col("known_high") * (1 - s["trail"]))
        if s.get("atr"):
            parts.append(F.col("known_high") - s["atr"] * F.col("known_atr"))
        return F.when(F.col("held") >= s.get("min_hold", 0), F.greatest(*parts) if len(parts) > 1 else parts[0])

    aggs = []
    for s in specs:
        lv = level(s)
        fill = F.when(F.col("open") <= lv, F.struct(F.lit("STOP_GAP").alias("reason"), F.col("open").alias("price"))).when(
            F.col("low") <= lv, F.struct(F.lit("STOP_TOUCH").alias("reason"), lv.alias("price")))
        aggs.append(F.struct(F.lit(s["id"]).alias("spec"), F.min(F.when(fill.isNotNull(), F.col("idx"))).alias("stop_idx"),
                             F.min_by(fill, F.when(fill.isNotNull(), F.col("idx"))).alias("fill")))
    out = x.groupBy("trade_id", "ticker").agg(F.first("entry_idx").alias("entry_idx"), F.array(*aggs).alias("_s"))
    return (out.select("trade_id", "ticker", "entry_idx", F.inline("_s")).where("stop_idx IS NOT NULL")
            .select("trade_id", "ticker", "spec", (F.col("stop_idx") - F.col("entry_idx")).alias("held_sessions"),
                    F.col("fill.reason").alias("reason"), F.col("fill.price").alias("price")))


def learned_exits(keys: DataFrame, predictions: DataFrame, threshold: float) -> DataFrame:
    """First planned day with predicted continuation <= threshold; flags trades with any missing prediction."""
    j = keys.join(predictions, ["date", "ticker"], "left")
    hit = F.when(F.col("continuation") <= threshold, F.col("idx"))
    return j.groupBy("trade_id").agg(
        F.bool_or(F.col("continuation").isNull()).alias("fallback"), F.min(hit).alias("_hit"), F.max("idx").alias("_last"),
        F.count(F.lit(1)).alias("planned_days")).select(
        "trade_id", "fallback", "planned_days",
        F.when(F.col("fallback"), F.col("_last")).otherwise(F.coalesce("_hit", "_last")).alias("exit_idx"))


def batch_weights(df: DataFrame, date: str, threshold: float, strength: float, max_names: int) -> DataFrame:
    """Weights inside one entry batch under four allocation families; a batch holds at most ``max_names`` rows."""
    best = top_rows(df, [date], [F.desc("score"), F.asc("ticker")], max_names, "rank")
    b = Window.partitionBy(date)
    n = F.count(F.lit(1)).over(b)
    excess = F.greatest(F.col("score") - threshold, F.lit(0.0))
    eps = F.coalesce(F.greatest(F.min(F.when(excess > 0, excess)).over(b) * 1e-6, F.lit(1e-12)), F.lit(1e-12))
    sd = F.stddev_pop("score").over(b)
    z = F.when(sd <= 1e-15, 0.0).otherwise((F.col("score") - F.avg("score").over(b)) / F.nullif(sd, F.lit(0.0)))
    raw = best.withColumns({"_n": n, "_p": F.pow(F.col("rank"), F.lit(-strength)), "_e": F.pow(excess + eps, F.lit(strength)),
                            "_z": F.coalesce(z, F.lit(0.0)) * strength})
    raw = raw.withColumn("_s", F.exp(F.col("_z") - F.max("_z").over(b)))
    share = lambda c: F.col(c) / F.sum(c).over(b)
    return raw.withColumns({"w_equal": 1.0 / F.col("_n"), "w_rank_power": share("_p"), "w_excess_power": share("_e"),
                            "w_softmax": share("_s")}).drop("_n", "_p", "_e", "_z", "_s")


def basket_outcomes(members: DataFrame, outcomes: DataFrame, cost: float) -> DataFrame:
    """Equal-weight basket per decision; NULL when any member has no complete price path."""
    j = members.join(outcomes, ["decision_date", "ticker"], "left")
    complete = F.bool_and(F.col("stock_return").isNotNull())
    mean = lambda c: F.when(complete, F.avg(c))
    return j.groupBy("decision_date").agg(
        F.count(F.lit(1)).alias("members"), complete.alias("complete"), mean("stock_return").alias("gross_return"),
        mean("bench_return").alias("benchmark_return")).withColumn(
        "net_excess", F.col("gross_return") - F.col("benchmark_return") - cost)
