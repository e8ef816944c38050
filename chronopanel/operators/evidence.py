"""Evidence aggregates: rank IC, spreads, activation, concentration, attribution, persistence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.functions.rounding import rnd
from chronopanel.functions.stats import hhi, median, quantile, robust_score, share
from chronopanel.operators.ordered import quantiles, rank_columns, rank_ic, safe_corr, value_counts
from chronopanel.operators.windows import islands


def fold_predictive_metrics(df: DataFrame, keys: Sequence[str], prediction: str, outcome: str, min_obs: int) -> DataFrame:
    """Per fold: Spearman (0 when constant), MAE, R2, mean outcome; folds below ``min_obs`` rows drop out."""
    ic = rank_ic(df, keys, prediction, outcome, min_rows=1, name="spearman").drop("n_rows")
    p, y = F.col(prediction), F.col(outcome)
    agg = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("observations"), F.avg(F.abs(p - y)).alias("mae"), F.sum((p - y) * (p - y)).alias("_sse"),
        (F.var_pop(y) * F.count(y)).alias("_sst"), F.avg(y).alias("mean_outcome")).where(F.col("observations") >= min_obs)
    r2 = F.when(F.col("_sst") > 0, 1 - F.col("_sse") / F.nullif("_sst", F.lit(0.0))).otherwise(0.0)
    return (agg.join(ic, list(keys)).withColumn("r2", r2).withColumn("spearman", F.coalesce("spearman", F.lit(0.0))).drop("_sse", "_sst"))


def robust_fold_statistics(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(x).alias("n"), rnd(F.avg(x)).alias("mean"), rnd(median(x)).alias("median"), rnd(F.stddev_pop(x)).alias("std"),
        rnd(share(F.col(x) <= 0)).alias("negative_rate"), rnd(F.avg(F.abs(x))).alias("mean_abs"), rnd(robust_score(x)).alias("robust_score"))


def top_spread(df: DataFrame, by: Sequence[str], x: str, y: str, q: float = 0.75, min_rows: int = 4) -> DataFrame:
    """Mean outcome of rows at or above the q-quantile minus the rest, per group with enough rows."""
    cut = quantiles(df, by, x, {"_cut": q})
    top = F.col(x) >= F.col("_cut")
    g = df.join(cut, list(by)).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), (F.avg(F.when(top, F.col(y))) - F.avg(F.when(~top, F.col(y)))).alias("spread"))
    return g.where((F.col("n_rows") >= min_rows) & F.col("spread").isNotNull())


def daily_activation(df: DataFrame, thresholds: DataFrame, top_fraction: float) -> DataFrame:
    """Score distribution and threshold crossings per day."""
    q = quantiles(df, ["decision_date"], "score", {"score_median": 0.5, "score_p90": 0.9, "score_p95": 0.95, "score_p97_5": 0.975, "score_p99": 0.99})
    base = df.join(thresholds, "decision_date").groupBy("decision_date").agg(
        F.count(F.lit(1)).alias("universe"), F.min("score").alias("score_min"), F.max("score").alias("score_max"),
        F.first("threshold").alias("threshold"), F.count_if(F.col("score") >= F.col("threshold")).alias("crossings"))
    limit = F.greatest(F.lit(1), F.ceil(F.col("universe") * top_fraction))
    return (base.join(q, "decision_date").withColumn("limit", limit)
            .withColumn("final_eligible", F.least("limit", "crossings"))
            .withColumn("max_margin", F.col("score_max") - F.col("threshold"))
            .withColumn("threshold_over_p99", F.when(F.abs("score_p99") > 1e-15, F.col("threshold") / F.nullif("score_p99", F.lit(0.0)))))


def period_activation(daily: DataFrame, unit: str) -> DataFrame:
    return daily.groupBy(F.trunc("decision_date", unit).alias("period")).agg(
        F.count(F.lit(1)).alias("days"), F.count_if(F.col("crossings") > 0).alias("days_with_crossing"),
        rnd(share(F.col("crossings") > 0)).alias("crossing_day_rate"), F.sum("crossings").alias("total_crossings"),
        F.sum("final_eligible").alias("total_eligible"), rnd(median("universe")).alias("median_universe"),
        rnd(median("score_p99")).alias("median_p99"), rnd(median("max_margin")).alias("median_margin"))


def alpha_table(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Realised excess of the top score percentiles and the decile spread; ``df`` carries ``pct`` within its day."""
    top = lambda p: F.when(F.col("pct") >= p, F.col("excess"))
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for p, name in ((0.995, "top_0_5pct"), (0.99, "top_1pct"), (0.95, "top_5pct"), (0.9, "top_10pct")):
        aggs += [F.count(top(p)).alias(f"{name}_rows"), rnd(F.avg(top(p))).alias(f"{name}_mean"), rnd(share(top(p) > 0)).alias(f"{name}_hit")]
    aggs.append(rnd(F.avg(top(0.9)) - F.avg(F.when(F.col("pct") <= 0.1, F.col("excess")))).alias("decile_spread"))
    return df.groupBy(*by).agg(*aggs)


def trade_concentration(trades: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Positive-contribution shares, ticker shares, HHI and leave-best-out means.

    The top-10 lists are kept by a bounded ``max_by`` style window limit; totals come from partial aggregation.
    """
    pos = F.greatest(F.col(value), F.lit(0.0))
    w = Window.partitionBy(*by).orderBy(F.desc("_pos"), F.asc("trade_id"))
    top = (trades.withColumn("_pos", pos).withColumn("_rn", F.row_number().over(w)).where("_rn <= 10").groupBy(*by).agg(
        *[F.sum(F.when(F.col("_rn") <= k, F.col("_pos"))).alias(f"_t{k}") for k in (1, 5, 10)]))
    total = trades.groupBy(*by).agg(F.count(F.lit(1)).alias("trades"), F.sum(pos).alias("_p"), F.sum(value).alias("_s"), F.max(value).alias("_m"))
    tick = trades.groupBy(*by, "ticker").agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_tv"))
    t = tick.groupBy(*by).agg(F.count(F.lit(1)).alias("tickers"), F.max("_n").alias("_maxn"), hhi(F.col("_n").cast("double")).alias("_h"),
                              F.count_if(F.col("_tv") > 0).alias("independent_winners"),
                              (F.max(F.abs("_tv")) / F.nullif(F.sum(F.abs("_tv")), F.lit(0.0))).alias("_tc"))
    j = total.join(top, list(by)).join(t, list(by))
    ratio = lambda k: rnd(F.coalesce(F.col(f"_t{k}") / F.nullif("_p", F.lit(0.0)), F.lit(0.0)))
    return j.select(*by, "trades", "tickers", "independent_winners", ratio(1).alias("top1_share"), ratio(5).alias("top5_share"),
                    ratio(10).alias("top10_share"), rnd(F.col("_maxn") / F.col("trades")).alias("top_ticker_share"),
                    rnd("_h").alias("hhi"), rnd(1 / F.col("_h")).alias("effective_names"), rnd("_tc").alias("ticker_concentration"),
                    rnd((F.col("_s") - F.col("_m")) / F.greatest(F.lit(1), F.col("trades") - 1)).alias("leave_best_out"))


def leave_one_out(folds: DataFrame, keys: Sequence[str], fold: str) -> DataFrame:
    """Recompute fold statistics with each fold removed; folds per key are few, held in one small array."""
    arr = folds.groupBy(*keys).agg(F.collect_list(F.struct(F.col(fold).alias("fold"), "cagr_excess", "trade_count", "total_return", "bench_return")).alias("_a"))
    cross = folds.select(*keys, F.col(fold).alias("removed")).join(arr, list(keys)).select(
        *keys, "removed", F.inline(F.filter("_a", lambda s: s["fold"] != F.col("removed"))))
    v = F.when(F.col("trade_count") > 0, F.col("cagr_excess"))
    cross = cross.withColumn("_v", v)
    return cross.groupBy(*keys, "removed").agg(
        F.count("_v").alias("active_folds"), rnd(F.coalesce(share(F.col("_v") > 0), F.lit(0.0))).alias("positive_active"),
        rnd(median("_v")).alias("median_active"), rnd(quantile("_v", 0.25)).alias("q25_active"), rnd(F.min("_v")).alias("worst_active"),
        rnd(F.product(1 + F.col("total_return")) - F.product(1 + F.col("bench_return"))).alias("chained_excess"))


def compounded_by(df: DataFrame, keys: Sequence[str], returns: Sequence[str]) -> DataFrame:
    """Compounded return per segment; product combines map-side."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("sessions"), *[rnd(F.product(1 + F.col(r)) - 1).alias(r) for r in returns])


def attribution(df: DataFrame, keys: Sequence[str], dimensions: dict[str, Column], value: str, session: str, trade: str) -> DataFrame:
    """Negative and net contribution by several dimensions in one unpivot, with the share of all losses of the key (an arm).

    ``df`` holds the positions inside the key's drawdown episode only. A missing dimension value counts as UNKNOWN.
    """
    loss = -F.least(F.col(value), F.lit(0.0))
    whole = df.groupBy(*keys).agg(F.sum(loss).alias("_w"))
    dims = F.array(*[F.struct(F.lit(n).alias("dimension"), F.coalesce(c.cast("string"), F.lit("UNKNOWN")).alias("key")) for n, c in dimensions.items()])
    long = df.select(*keys, F.col(value).alias("_v"), loss.alias("_l"), F.col(session).alias("_s"), F.col(trade).alias("_t"), F.inline(dims))
    g = long.groupBy(*keys, "dimension", "key").agg(F.sum("_v").alias("net"), F.sum("_l").alias("losses"), F.countDistinct("_s").alias("sessions"),
                                                    F.countDistinct("_t").alias("trades"))
    return g.join(whole, list(keys)).withColumn("share", F.coalesce(F.col("losses") / F.nullif("_w", F.lit(0.0)), F.lit(0.0))).drop("_w")


def dominant_cause(shares: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Class of the largest loss source of each key; labels and cuts are fixed values."""
    top = lambda d: F.max(F.when(F.col("dimension") == d, F.col("share")))
    key = lambda d: F.max_by("key", F.when(F.col("dimension") == d, F.struct("share", "key")))
    s = shares.groupBy(*keys).agg(top("ticker").alias("t"), top("generation").alias("g"), key("ticker").alias("top_ticker"), key("generation").alias("top_generation"))
    cause = F.when(F.col("t") >= 0.5, "A_SINGLE_TICKER_OUTLIER").when(F.col("g") >= 0.6, "B_GENERATION_CLUSTER").otherwise("C_MULTI_NAME_OR_MARKET_CLUSTER")
    return s.select(*keys, cause.alias("cause"), "top_ticker", rnd("t").alias("top_ticker_share"), "top_generation", rnd("g").alias("top_generation_share"))


def feature_associations(df: DataFrame, features: Sequence[str], target: str, min_rows: int = 3) -> DataFrame:
    """Spearman association of many features with one target: unpivot, then one rank pass per side."""
    long = df.select(F.col(target).alias("_y"), F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("_x")) for f in features])))
    return rank_ic(long, ["feature"], "_x", "_y", min_rows=min_rows, name="spearman")


def quintile_bins(df: DataFrame, feature: str, target: str, bins: int = 5) -> DataFrame:
    """Equal-frequency bins (duplicate edges dropped): range, mean, median and positive rate of the target per bin."""
    edges = quantiles(df, [], feature, {f"e{i}": i / bins for i in range(bins + 1)})
    arr = edges.select(F.array_distinct(F.array(*[f"e{i}" for i in range(bins + 1)])).alias("_e"))
    x = df.withColumn("_e", arr.scalar())
    # right-closed bins, the first one also closed on the left
    idx = sum((F.col(feature) > F.get("_e", F.lit(i))).cast("int") for i in range(bins))
    x = x.withColumn("bin", F.greatest(F.lit(1), F.least(idx, F.size("_e") - 1)).cast("long")).drop("_e")
    med = quantiles(x, ["bin"], target, {"median_target": 0.5})
    agg = x.groupBy("bin").agg(F.count(F.lit(1)).alias("n_rows"), F.min(feature).alias("feature_min"), F.max(feature).alias("feature_max"),
                               F.avg(target).alias("mean_target"), share(F.col(target) > 0).alias("positive_rate"))
    return agg.join(med, "bin")


def bin_monotonicity(bins: DataFrame) -> DataFrame:
    """Slope and rank agreement of bin means (a handful of bins)."""
    ranked = bins.withColumn("_r", F.rank().over(Window.orderBy("mean_target")))
    return ranked.agg(F.count(F.lit(1)).alias("bins"), rnd(F.regr_slope("mean_target", F.col("bin"))).alias("slope"),
                      rnd(safe_corr(F.col("bin").cast("double"), F.col("_r").cast("double"))).alias("spearman"))


def persistence(pairs: DataFrame) -> DataFrame:
    """Rank, quartile and winner persistence per (level, arm, lag) from lagged state pairs.

    Date-level statistics first, then their averages; ranks are already unique per date, so Spearman is a plain
    correlation of re-ranked positions.
    """
    cross = Window.partitionBy("cluster_level", "arm", "lag", "assessment_date")
    x = pairs.withColumns({"_ra": F.row_number().over(cross.orderBy("rank")), "_rb": F.row_number().over(cross.orderBy("future_rank"))})
    winner = lambda n: F.avg(F.when(F.col("rank") <= n, (F.col("future_rank") <= n).cast("double")))
    day = x.groupBy("cluster_level", "arm", "lag", "assessment_date").agg(
        safe_corr(F.col("_ra").cast("double"), F.col("_rb").cast("double")).alias("rc"),
        F.avg(F.when(F.col("quartile") == "TOP", (F.col("future_quartile") == "TOP").cast("double"))).alias("qp"),
        F.avg(F.abs(F.col("rank_pct") - F.col("future_rank_pct"))).alias("turn"),
        *[winner(n).alias(f"w{n}") for n in (1, 3, 5)])
    return day.groupBy("cluster_level", "arm", "lag").agg(
        F.count("rc").alias("observations"), rnd(F.avg("rc")).alias("mean_rank_autocorrelation"), rnd(median("rc")).alias("median_rank_autocorrelation"),
        rnd(share(F.col("rc") > 0)).alias("positive_fraction"), rnd(F.avg("qp")).alias("top_quartile_persistence"),
        *[rnd(F.avg(f"w{n}")).alias(f"winner_persistence_{n}") for n in (1, 3, 5)],
        rnd(F.avg("turn")).alias("mean_rank_turnover"), rnd(quantile("turn", 0.95)).alias("p95_rank_turnover"))


def transitions(pairs: DataFrame) -> DataFrame:
    counts = pairs.groupBy("cluster_level", "arm", F.col("quartile").alias("from_state"), F.col("future_quartile").alias("to_state")).agg(
        F.count(F.lit(1)).alias("n"))
    return counts.withColumn("probability", rnd(F.col("n") / F.sum("n").over(Window.partitionBy("cluster_level", "arm"))))


def top_durations(state: DataFrame) -> DataFrame:
    runs = islands(state.withColumn("_top", F.col("quartile") == "TOP"), ["cluster_level", "arm", "cluster_id"], "assessment_date", "_top")
    return runs.groupBy("cluster_level", "arm").agg(
        F.count(F.lit(1)).alias("runs"), rnd(median("length")).alias("median_months"), rnd(quantile("length", 0.75)).alias("p75_months"),
        rnd(quantile("length", 0.9)).alias("p90_months"), F.max("length").alias("max_months"))


def future_spread(state: DataFrame, target: str, conditions: dict[str, Column]) -> DataFrame:
    """Future top-minus-rest spread per activity condition, averaged over dates."""
    flags = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in conditions.items()]))
    x = state.withColumn("condition", F.explode(flags))
    top = F.col("quartile") == "TOP"
    day = x.groupBy("cluster_level", "arm", "condition", "assessment_date").agg(
        (F.avg(F.when(top, F.col(target))) - F.avg(F.when(~top, F.col(target)))).alias("s")).where("s IS NOT NULL")
    return day.groupBy("cluster_level", "arm", "condition").agg(
        F.count(F.lit(1)).alias("observations"), rnd(F.avg("s")).alias("mean_spread"), rnd(median("s")).alias("median_spread"))
