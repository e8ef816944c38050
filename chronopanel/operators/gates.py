"""Threshold, rank and quantile gates on daily cross-sections.

A session may hold a third of all rows: picks use capped row numbers, which
Spark limits per task before shuffling, and day statistics come from count
tables or plain partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.functions.rounding import rnd
from chronopanel.functions.stats import median, quantile, share
from chronopanel.session import stage
from chronopanel.operators.ordered import quantiles, top_rows, value_counts


def day_counts(df: DataFrame, date: str = "decision_date") -> DataFrame:
    return df.groupBy(date).agg(F.count(F.lit(1)).alias("universe"), F.max("score").alias("top"))


def fraction_limit(n: Column, fraction) -> Column:
    f = F.lit(fraction) if isinstance(fraction, float) else fraction
    return F.greatest(F.lit(1), F.ceil(n * f))


def entry_candidates(df: DataFrame, threshold: float | Column, top_fraction: float, max_names: int,
                     date: str = "decision_date") -> DataFrame:
    """Picks per day: score >= threshold, rank <= min(max_names, ceil(n * fraction)), score desc then ticker."""
    limit = F.least(F.lit(max_names), fraction_limit(F.col("universe"), top_fraction))
    best = top_rows(df.where(F.col("score").isNotNull()), [date], [F.desc("score"), F.asc("ticker")], max_names, "score_rank")
    th = F.lit(threshold) if isinstance(threshold, float) else threshold
    return (best.join(day_counts(df, date), date).where((F.col("score_rank") <= limit) & (F.col("score") >= th))
            .withColumn("threshold_distance", F.col("score") - th))


def relative_ranks(df: DataFrame, date: str = "decision_date") -> DataFrame:
    """Exact row number by (score desc, ticker) for every row, without one window per whole day.

    Rows are ordered inside (day, score range) cells; cell sizes are prefix-summed per day.
    """
    from chronopanel.operators.ordered import with_range
    ranged = with_range(df, [date], "score")
    inner = Window.partitionBy(date, "_range").orderBy(F.desc("score"), F.asc("ticker"))
    cells = ranged.groupBy(date, "_range").agg(F.count(F.lit(1)).alias("_c"))
    above = Window.partitionBy(date).orderBy(F.desc("_range"))
    cells = cells.select(date, "_range", (F.sum("_c").over(above) - F.col("_c")).alias("_before"),
                         F.sum("_c").over(Window.partitionBy(date)).alias("universe"))
    return (ranged.withColumn("_in", F.row_number().over(inner)).join(cells, [date, "_range"])
            .withColumn("daily_rank", F.col("_before") + F.col("_in")).drop("_range", "_in", "_before"))


def gate_flags(df: DataFrame, threshold: float, top_fraction: float) -> DataFrame:
    """Relative, accepted and shadow-rejected flags per row."""
    ranked = relative_ranks(df)
    relative = F.col("daily_rank") <= fraction_limit(F.col("universe"), top_fraction)
    accepted = F.col("score") >= threshold
    return (ranked.withColumn("relative", relative).withColumn("accepted", accepted)
            .withColumn("accepted_relative", relative & accepted).withColumn("shadow_rejected", relative & ~accepted))


def daily_gate_summary(panel: DataFrame, threshold: float, top_fraction: float) -> DataFrame:
    """One row per day with the counts and sums every trailing window needs."""
    panel = stage(panel, "gate-panel")
    f = gate_flags(panel, threshold, top_fraction)
    day = f.groupBy("decision_date").agg(
        F.max("terminal_date").alias("terminal_date"), F.count(F.lit(1)).alias("n_rows"),
        F.max(F.col("accepted").cast("int")).alias("crossing"),
        F.count_if("shadow_rejected").alias("n_shadow"),
        F.sum(F.when(F.col("shadow_rejected"), F.col("excess")).otherwise(0.0)).alias("s_shadow"),
        F.count_if(F.col("shadow_rejected") & (F.col("excess") > 0)).alias("h_shadow"))
    return day.join(quantiles(panel, ["decision_date"], "score", {"p99": 0.99}), "decision_date")


def _lookback_rows(day: DataFrame, assessments: DataFrame, lookbacks) -> DataFrame:
    from chronopanel.operators.schedules import trailing_window
    rows = trailing_window(day, assessments, "assessment_date", [], max(lookbacks))
    return rows.withColumn("lookback", F.explode(F.array(*[F.lit(x) for x in lookbacks]))).where("_rn <= lookback")


def collapse(rate: Column, historical_rate: float) -> Column:
    return F.lit(historical_rate >= 0.01) & (rate < max(0.005, 0.25 * historical_rate))


def threshold_verdict(days: Column, shadow_count: Column, rate: Column, shadow_mean: Column, *, historical_rate: float,
                      min_days: int, min_shadow: int) -> Column:
    return (F.when((days < min_days) | (shadow_count < min_shadow), "INSUFFICIENT_EVIDENCE")
            .when(~collapse(rate, historical_rate), "NO_RESTRICTION_EVIDENCE")
            .when(shadow_mean > 0, "TOO_RESTRICTIVE").otherwise("RARE_SIGNAL"))


def threshold_windows(day, assessments, lookbacks, *, historical_rate, min_days, min_shadow, threshold) -> DataFrame:
    rows = _lookback_rows(day, assessments, lookbacks).withColumn("_pr", F.lit(threshold) / F.col("p99"))
    shadow_n = F.nullif(F.sum("n_shadow"), F.lit(0))
    agg = rows.groupBy("assessment_date", "lookback").agg(
        F.count(F.lit(1)).alias("matured_days"), F.sum("n_rows").alias("evaluated_rows"), F.avg("crossing").alias("rate"),
        F.sum("n_shadow").alias("shadow_count"), (F.sum("s_shadow") / shadow_n).alias("sm"),
        (F.sum("h_shadow") / shadow_n).alias("sh"), median("_pr").alias("pressure"))
    verdict = threshold_verdict(F.col("matured_days"), F.col("shadow_count"), F.col("rate"), F.col("sm"),
                                historical_rate=historical_rate, min_days=min_days, min_shadow=min_shadow)
    return agg.select("assessment_date", "lookback", "matured_days", "evaluated_rows", rnd("rate").alias("crossing_rate"),
                      "shadow_count", rnd("sm").alias("shadow_mean"), rnd("sh").alias("shadow_hit"),
                      rnd("pressure").alias("median_pressure"), verdict.alias("verdict"))


def weighted_evidence(day, assessments, weights: dict[int, float], *, historical_rate, pressure, trigger,
                      min_fraction, min_shadow) -> DataFrame:
    """Lookback signals averaged with weights re-normalised over the available ones."""
    rows = _lookback_rows(day, assessments, list(weights))
    agg = rows.groupBy("assessment_date", "lookback").agg(
        F.count(F.lit(1)).alias("days"), F.avg("crossing").alias("rate"), F.sum("n_shadow").alias("k"),
        (F.sum("s_shadow") / F.nullif(F.sum("n_shadow"), F.lit(0))).alias("sm"), median("p99").alias("p99"))
    available = (F.col("days") >= F.ceil(F.col("lookback") * min_fraction)) & (F.col("k") >= min_shadow)
    hit = collapse(F.col("rate"), historical_rate) & (F.coalesce("sm", F.lit(-1.0)) > 0)
    wt = F.element_at(F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v))]), F.col("lookback"))
    s = agg.withColumn("signal", F.when(available, hit.cast("int"))).withColumn("w", wt)
    out = s.groupBy("assessment_date").agg(
        (F.sum(F.col("w") * F.col("signal")) / F.sum(F.when(F.col("signal").isNotNull(), F.col("w")))).alias("evidence"),
        (F.sum(F.col("w") * F.col("p99")) / F.sum("w")).alias("anchor"))
    adapt = F.coalesce((F.col("evidence") >= trigger) & (F.col("anchor") > 0), F.lit(False))
    return out.select("assessment_date", rnd("evidence").alias("weighted_evidence"), rnd("anchor").alias("weighted_p99"),
                      adapt.alias("adapt_active"),
                      rnd(F.when(adapt, F.col("anchor") * pressure)).alias("replacement_threshold"))


def entry_policy_search(panel: DataFrame, qs: list[float], fractions: list[float], max_names: int,
                        minimum_active: int) -> DataFrame:
    """Score a (quantile x fraction) grid by monthly pick means and rank it.

    The panel is read once: only the top ``max_names`` rows per day survive, then the small grid is
    applied to them.
    """
    days = day_counts(panel)
    cut = days.agg(F.expr(f"percentile(top, array({','.join(map(str, qs))}))").alias("_t"))
    grid = F.array(*[F.struct(F.lit(i).alias("qi"), F.lit(q).alias("quantile"), F.lit(f).alias("top_fraction"))
                     for i, q in enumerate(qs, 1) for f in fractions])
    best = top_rows(panel, ["decision_date"], [F.desc("score"), F.asc("ticker")], max_names, "_rn").select(
        "decision_date", "score", "excess", "_rn")
    base = (days.join(best, "decision_date", "left").withColumn("_t", cut.scalar()).select("*", F.inline(grid))
            .withColumn("threshold", F.element_at("_t", F.col("qi"))))
    ok = (F.col("score") >= F.col("threshold")) & (
        F.col("_rn") <= F.least(F.lit(max_names), fraction_limit(F.col("universe"), F.col("top_fraction"))))
    daily = (base.groupBy("quantile", "top_fraction", "threshold", "decision_date")
             .agg(F.avg(F.when(ok, F.col("excess"))).alias("_v")))
    monthly = daily.groupBy("quantile", "top_fraction", "threshold", F.trunc("decision_date", "month").alias("_m")).agg(
        F.avg(F.coalesce("_v", F.lit(0.0))).alias("mv"), F.count("_v").alias("active"))
    s = monthly.groupBy("quantile", "top_fraction", "threshold").agg(
        F.sum("active").alias("active_dates"), F.count(F.lit(1)).alias("month_count"), rnd(median("mv")).alias("median_month"),
        rnd(quantile("mv", 0.25)).alias("q25_month"), rnd(share(F.col("mv") > 0)).alias("positive_fraction"),
        rnd(F.min("mv")).alias("worst_month")).where(F.col("active_dates") >= minimum_active)
    order = Window.orderBy(F.desc("median_month"), F.desc("q25_month"), F.desc("positive_fraction"), F.desc("worst_month"),
                           "active_dates", F.desc("quantile"), "top_fraction")
    return s.select("quantile", "top_fraction", rnd("threshold").alias("threshold"), "active_dates", "month_count",
                    "median_month", "q25_month", "positive_fraction", "worst_month",
                    F.row_number().over(order).cast("long").alias("rank"))


def required_exit_keys(signals: DataFrame, sessions: DataFrame, top: int, hold: int) -> DataFrame:
    """(date, ticker, remaining) keys an exit model must cover for every possible entry."""
    picks = top_rows(signals, ["decision_date"], [F.desc("score"), F.asc("ticker")], top, "_rn")
    at = sessions.select(F.col("date").alias("decision_date"), "idx")
    ahead = picks.join(at, "decision_date").select("ticker", "idx", F.explode(F.sequence(F.lit(0), F.lit(hold - 2))).alias("k"))
    return (ahead.select("ticker", (F.col("idx") + 1 + F.col("k")).alias("idx"), (F.lit(hold - 1) - F.col("k")).alias("remaining"))
            .join(sessions.select("idx", F.col("date").alias("exit_check_date")), "idx")
            .select("exit_check_date", "ticker", "remaining").distinct())
