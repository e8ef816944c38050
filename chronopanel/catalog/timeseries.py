"""Time-series windows and wealth paths."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronopanel.catalog.aggregates import AVG_RANK
from chronopanel.catalog.registry import R, query
from chronopanel.functions.rounding import rnd
from chronopanel.functions.stats import median
from chronopanel.operators import ordered as od
from chronopanel.operators import wealth as wp
from chronopanel.operators import windows as win

NAV_W = "PARTITION BY family_id, arm ORDER BY date"


def nav_window():
    return Window.partitionBy("family_id", "arm").orderBy("date")


@query("w1_simple_returns", f"""
SELECT family_id, arm, date, {R('rel / lag(rel) OVER w - 1')} AS r1, {R('rel / lag(rel, 20) OVER w - 1')} AS r20, {R('rel / lag(rel, 63) OVER w - 1')} AS r63
FROM x_nav WINDOW w AS ({NAV_W})""")
def w1(r):
    w = nav_window()
    return r.nav().select("family_id", "arm", "date", *[rnd(win.pct_change("rel", n, w)).alias(f"r{n}") for n in (1, 20, 63)])


@query("w2_rolling_min_periods", f"""
WITH c AS (SELECT *, rel / lag(rel) OVER ({NAV_W}) - 1 AS ret FROM x_nav)
SELECT family_id, arm, date, CASE WHEN count(rel) OVER a >= 20 THEN {R('avg(rel) OVER a')} END AS mean63, CASE WHEN count(ret) OVER b >= 10 THEN {R('stddev_samp(ret) OVER b')} END AS std21,
 CASE WHEN count(rel) OVER c >= 50 THEN {R('max(rel) OVER c')} END AS max200
FROM c WINDOW a AS ({NAV_W} ROWS 62 PRECEDING), b AS ({NAV_W} ROWS 20 PRECEDING), c AS ({NAV_W} ROWS 199 PRECEDING)""")
def w2(r):
    w = nav_window()
    x = r.nav().withColumn("ret", win.pct_change("rel", 1, w))
    return x.select("family_id", "arm", "date", rnd(win.rolling(F.avg, "rel", 63, 20, w)).alias("mean63"),
                    rnd(win.rolling(F.stddev_samp, "ret", 21, 10, w)).alias("std21"), rnd(win.rolling(F.max, "rel", 200, 50, w)).alias("max200"))


@query("w3_rank_variants", f"""
SELECT decision_date, ticker, {R(AVG_RANK.format(p='decision_date', x='q'))} AS average_rank, {R('(' + AVG_RANK.format(p='decision_date', x='q') + ') / count(*) OVER (PARTITION BY decision_date)')} AS pct_rank,
 dense_rank() OVER (PARTITION BY decision_date ORDER BY q) AS dense_rank
FROM (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS decision_date, l_suppkey AS ticker, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2)""")
def w3(r):
    q = r.table("lineitem").groupBy(F.date_trunc("week", "l_shipdate").cast("date").alias("decision_date"), F.col("l_suppkey").alias("ticker")).agg(F.sum("l_quantity").alias("q"))
    x = od.rank_columns(q, ["decision_date"], "q", rank="average_rank", pct="pct_rank", dense="dense_rank")
    return x.select("decision_date", "ticker", rnd("average_rank").alias("average_rank"), rnd("pct_rank").alias("pct_rank"), "dense_rank")


@query("w3_first_rank_descending", """
SELECT decision_date, ticker, row_number() OVER (PARTITION BY decision_date ORDER BY score DESC, ticker) AS daily_rank, count(*) OVER (PARTITION BY decision_date) AS universe FROM x_signals""")
def w3_first(r):
    r.share("signals")
    from chronopanel.operators.gates import relative_ranks
    return relative_ranks(r.signals()).select("decision_date", "ticker", F.col("daily_rank").cast("long").alias("daily_rank"), "universe")


@query("w4_drawdowns", f"""
SELECT family_id, arm, date, {R('strategy_value / max(strategy_value) OVER w - 1')} AS drawdown, {R('bench_value / max(bench_value) OVER w - 1')} AS bench_drawdown, {R('rel / max(rel) OVER w - 1')} AS relative_drawdown
FROM x_nav WINDOW w AS ({NAV_W})""")
def w4(r):
    w = nav_window()
    return r.nav().select("family_id", "arm", "date", rnd(win.drawdown("strategy_value", w)).alias("drawdown"), rnd(win.drawdown("bench_value", w)).alias("bench_drawdown"),
                          rnd(win.drawdown("rel", w)).alias("relative_drawdown"))


PATH = f"""
p0 AS (SELECT family_id, arm, date, rel, row_number() OVER w AS pos, rel / lag(rel) OVER w - 1 AS ret, rel / max(rel) OVER w - 1 AS dd FROM x_nav WINDOW w AS ({NAV_W})),
p1 AS (SELECT *, CASE WHEN dd < 0 THEN pos - coalesce(max(CASE WHEN dd >= 0 THEN pos END) OVER ({NAV_W}), 0) ELSE 0 END AS run FROM p0),
p2 AS (SELECT *, CASE WHEN dd >= 0 AND lag(run) OVER ({NAV_W}) > 0 THEN lag(run) OVER ({NAV_W}) END AS recovery FROM p1)"""
METRICS = f"""
 SELECT e.family_id, e.arm, e.pos AS sessions, max(h.date) AS date, {R('sqrt(sum(least(h.ret, 0) * least(h.ret, 0)) / count(h.ret))')} AS downside_deviation, {R('avg(h.ret) * 252')} AS annual_excess, {R('min(h.dd)')} AS max_drawdown,
 {R('arg_max(h.dd, h.pos)')} AS current_drawdown, arg_max(h.run, h.pos) AS drawdown_sessions, max(h.run) AS max_drawdown_sessions, {R('avg((h.dd < 0)::INT)')} AS time_under_water,
 {R('sum(-h.dd)', 5)} AS impairment_area, {R('avg((h.dd <= -0.05)::INT)')} AS impaired_5pct, {R('avg((h.dd <= -0.1)::INT)')} AS impaired_10pct,
 {R('coalesce(list_avg(list_filter(list_sort(list(h.ret) FILTER (h.ret IS NOT NULL))[1:greatest(1, ceil((e.pos - 1) * 0.05))::BIGINT], lambda x: x < 0)), 0)')} AS expected_shortfall,
 {R('coalesce(list_avg(list_filter(list_sort(list(h.dd))[1:greatest(1, ceil(e.pos * 0.05))::BIGINT], lambda x: x < 0)), 0)')} AS cdar,
 {R('coalesce(median(h.recovery), 0)')} AS median_recovery, {R('avg(h.ret) * 252 / (sqrt(sum(least(h.ret, 0) * least(h.ret, 0)) / count(h.ret)) * sqrt(252))', 4)} AS sortino
 FROM e JOIN p2 h ON h.family_id = e.family_id AND h.arm = e.arm AND h.pos <= e.pos GROUP BY 1, 2, 3"""
W_OUT = ("downside_deviation", "annual_excess", "max_drawdown", "current_drawdown", "time_under_water", "impaired_5pct", "impaired_10pct", "expected_shortfall", "cdar", "median_recovery")


def w_select(df):
    return df.select("family_id", "arm", "date", F.col("pos").alias("sessions"), "drawdown_sessions", "max_drawdown_sessions", *[rnd(c).alias(c) for c in W_OUT],
                     rnd("impairment_area", 5).alias("impairment_area"), rnd("sortino", 4).alias("sortino"))


@query("w5_wealth_path_metrics", f"WITH {PATH}, e AS (SELECT family_id, arm, max(pos) AS pos FROM p2 GROUP BY 1, 2) {METRICS}")
def w5(r):
    return w_select(wp.wealth_metrics(r.nav(), ["family_id", "arm"], "last"))


@query("w6_prefix_wealth_metrics", f"WITH {PATH}, e AS (SELECT family_id, arm, max(pos) AS pos FROM p2 GROUP BY 1, 2, date_trunc('month', date) HAVING max(pos) > 1) {METRICS}")
def w6(r):
    return w_select(wp.wealth_metrics(r.nav(), ["family_id", "arm"], "month").where("pos > 1"))


@query("w7_trailing_excess", f"""
SELECT family_id, arm, date, {R('rel / lag(rel, 21) OVER w - 1')} AS excess_21, {R('rel / lag(rel, 63) OVER w - 1')} AS excess_63, {R('rel / lag(rel, 126) OVER w - 1')} AS excess_126, {R('rel / lag(rel, 252) OVER w - 1')} AS excess_252
FROM x_nav WINDOW w AS ({NAV_W})""")
def w7(r):
    w = nav_window()
    return r.nav().select("family_id", "arm", "date", *[rnd(win.pct_change("rel", n, w)).alias(f"excess_{n}") for n in (21, 63, 126, 252)])


@query("w8_ewma", f"""
WITH RECURSIVE s AS (SELECT family_id, arm, date, r, row_number() OVER ({NAV_W}) AS rn FROM x_ret),
e AS (SELECT family_id, arm, rn, date, r AS ewma FROM s WHERE rn = 1
      UNION ALL SELECT s.family_id, s.arm, s.rn, s.date, s.r * (2.0 / 64) + e.ewma * (1 - 2.0 / 64) FROM e JOIN s ON s.family_id = e.family_id AND s.arm = e.arm AND s.rn = e.rn + 1)
SELECT family_id, arm, date, {R('ewma')} AS ewma FROM e""")
def w8(r):
    from chronopanel.operators.folds import ewma
    return ewma(r.returns(), ["family_id", "arm"], "date", "r", span=63).select("family_id", "arm", "date", rnd("ewma").alias("ewma"))


@query("w9_forward_targets", f"""
SELECT family_id, arm, assessment_date, {R('lead(rel) OVER w / rel - 1')} AS future_1m, lead(assessment_date) OVER w AS available_1m, {R('lead(rel, 3) OVER w / rel - 1')} AS future_3m, lead(assessment_date, 3) OVER w AS available_3m
FROM x_month WINDOW w AS (PARTITION BY family_id, arm ORDER BY assessment_date)""")
def w9(r):
    from chronopanel.operators.models import forward_targets
    t = forward_targets(r.monthly(), ["family_id", "arm"])
    return t.select("family_id", "arm", "assessment_date", rnd("future_1m").alias("future_1m"), "available_1m", rnd("future_3m").alias("future_3m"), "available_3m")


@query("w10_forward_fill", f"""
SELECT family_id, arm, date, last_value(CASE WHEN positions > 0 THEN date END IGNORE NULLS) OVER w AS last_active, CAST(date_diff('day', last_value(CASE WHEN positions > 0 THEN date END IGNORE NULLS) OVER w, date) AS INT) AS days_since
FROM x_ret WINDOW w AS ({NAV_W})""")
def w10(r):
    last = F.last(F.when(F.col("positions") > 0, F.col("date")), ignorenulls=True).over(nav_window())
    return r.returns().withColumn("last_active", last).select("family_id", "arm", "date", "last_active", F.datediff("date", "last_active").alias("days_since"))


@query("w11_market_state", f"""
WITH t AS (SELECT ticker, date, close / lag(close) OVER w - 1 AS r1, close / lag(close, 20) OVER w - 1 AS r20, ln(1 + volume) AS lv FROM x_prices WINDOW w AS (PARTITION BY ticker ORDER BY date)),
x AS (SELECT date, avg((coalesce(r20, -1) > 0)::INT) AS breadth, stddev_pop(r1) AS dispersion, median(lv) AS liquidity FROM t GROUP BY 1),
b AS (SELECT date, close / avg(close) OVER (ORDER BY date ROWS 62 PRECEDING) - 1 AS trend, count(*) OVER (ORDER BY date) AS n, close / lag(close) OVER (ORDER BY date) - 1 AS r FROM x_bench),
v AS (SELECT *, stddev_pop(r) OVER (ORDER BY date ROWS 20 PRECEDING) AS vol, count(r) OVER (ORDER BY date ROWS 20 PRECEDING) AS nv FROM b),
m AS (SELECT *, row_number() OVER (PARTITION BY date_trunc('month', date) ORDER BY date DESC) AS rn FROM v JOIN x USING (date))
SELECT date AS assessment_date, CASE WHEN n >= 20 THEN {R('trend')} END AS benchmark_trend, CASE WHEN nv >= 10 THEN {R('vol')} END AS market_volatility, {R('breadth')} AS market_breadth,
 {R('dispersion')} AS cross_sectional_dispersion, {R('liquidity')} AS liquidity_state FROM m WHERE rn = 1""")
def w11(r):
    r.share("prices")
    from chronopanel.plans.market import monthly_market_state
    s = monthly_market_state(r.prices(), r.bench())
    return s.select("assessment_date", *[rnd(c).alias(c) for c in ("benchmark_trend", "market_volatility", "market_breadth", "cross_sectional_dispersion", "liquidity_state")])


@query("w12_lagged_market_features", f"""
WITH b AS (SELECT date, close, close / lag(close) OVER (ORDER BY date) - 1 AS ret FROM x_bench), l AS (SELECT *, lag(close) OVER (ORDER BY date) AS c1, lag(ret) OVER (ORDER BY date) AS r1 FROM b)
SELECT date AS decision_date, {R('c1 / lag(close, 21) OVER (ORDER BY date) - 1')} AS trailing_20, CASE WHEN count(r1) OVER v >= 20 THEN {R('stddev_samp(r1) OVER v * sqrt(252)')} END AS volatility_20,
 CASE WHEN count(c1) OVER d >= 252 THEN {R('c1 / max(c1) OVER d - 1')} END AS drawdown_252
FROM l WINDOW v AS (ORDER BY date ROWS 19 PRECEDING), d AS (ORDER BY date ROWS 251 PRECEDING)""")
def w12(r):
    from chronopanel.plans.market import lagged_features
    return lagged_features(r.bench()).select("decision_date", *[rnd(c).alias(c) for c in ("trailing_20", "volatility_20", "drawdown_252")])


@query("w13_benchmark_regimes", f"""
WITH b AS (SELECT date, bench_value AS x, bench_value / lag(bench_value) OVER (ORDER BY date) - 1 AS r, bench_value / lag(bench_value, 26) OVER (ORDER BY date) - 1 AS ret, row_number() OVER (ORDER BY date) AS n,
  avg(bench_value) OVER (ORDER BY date ROWS 39 PRECEDING) AS ma, bench_value / max(bench_value) OVER (ORDER BY date) - 1 AS dd FROM (SELECT DISTINCT date, bench_value FROM x_nav)),
v AS (SELECT *, CASE WHEN n >= 10 THEN x / ma - 1 END AS dist, CASE WHEN count(r) OVER (ORDER BY date ROWS 19 PRECEDING) >= 10 THEN stddev_samp(r) OVER (ORDER BY date ROWS 19 PRECEDING) END AS vol FROM b)
SELECT date, {R('ret')} AS ret, {R('dist')} AS distance, {R('dd')} AS drawdown, {R('vol')} AS vol, CASE WHEN ret IS NULL OR dist IS NULL THEN 'TRANSITION' WHEN abs(ret) < 0.005 AND abs(dist) < 0.003 AND vol < 0.02 THEN 'SIDEWAYS'
  WHEN ret <= -0.01 AND dist <= -0.002 THEN 'STRONG_BEAR' WHEN ret >= 0.01 AND dist >= 0.002 THEN 'STRONG_BULL' ELSE 'TRANSITION' END AS regime FROM v""")
def w13(r):
    from chronopanel.plans.market import benchmark_regimes
    return benchmark_regimes(r.bench_nav(), momentum=26, ma=(40, 10), vol=(20, 10), bull=0.01, bear=-0.01, distance=0.002, max_vol=0.02).select(
        "date", *[rnd(c).alias(c) for c in ("ret", "distance", "drawdown", "vol")], "regime")


@query("w14_true_range_atr", f"""
WITH t AS (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS pc FROM x_prices),
u AS (SELECT ticker, date, greatest(high - low, coalesce(abs(high - pc), high - low), coalesce(abs(low - pc), high - low)) AS tr FROM t)
SELECT ticker, date, {R('tr')} AS true_range, {R('CASE WHEN count(tr) OVER w >= 14 THEN avg(tr) OVER w ELSE 0 END')} AS atr FROM u WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 13 PRECEDING)""")
def w14(r):
    from chronopanel.operators.trades import true_range_atr
    return true_range_atr(r.prices()).select("ticker", "date", rnd("true_range").alias("true_range"), rnd("atr").alias("atr"))


@query("w15_top_state_runs", f"""
WITH m AS (SELECT *, quartile = 'TOP' AS t, row_number() OVER (PARTITION BY cluster_level, arm, cluster_id ORDER BY assessment_date) AS pos FROM x_state),
g AS (SELECT cluster_level, arm, cluster_id, count(*) AS length FROM (SELECT *, pos - row_number() OVER (PARTITION BY cluster_level, arm, cluster_id ORDER BY assessment_date) AS grp FROM m WHERE t) GROUP BY cluster_level, arm, cluster_id, grp)
SELECT cluster_level, arm, count(*) AS runs, {R('median(length)')} AS median_months, {R('quantile_cont(length, 0.75)')} AS p75_months, {R('quantile_cont(length, 0.9)')} AS p90_months, max(length) AS max_months FROM g GROUP BY 1, 2""")
def w15(r):
    r.share("state")
    from chronopanel.operators.evidence import top_durations
    return top_durations(r.state())


@query("w16_episodes", """
WITH d AS (SELECT DISTINCT ticker, entry_date FROM x_trades),
g AS (SELECT *, lag(entry_date) OVER (PARTITION BY ticker ORDER BY entry_date) AS prev FROM d),
n AS (SELECT *, CASE WHEN prev IS NULL OR (SELECT count(*) FROM range(0, date_diff('day', prev, entry_date)) t(i) WHERE isodow(prev + CAST(i AS INT)) <= 5) > 20 THEN 1 ELSE 0 END AS new_ep FROM g)
SELECT ticker, entry_date, CAST(sum(new_ep) OVER (PARTITION BY ticker ORDER BY entry_date) AS BIGINT) AS episode FROM n""")
def w16(r):
    d = r.trades().select("ticker", "entry_date").distinct()
    return win.episodes(d, ["ticker"], "entry_date", 20)


@query("w17_switch_costs", f"""
WITH s AS (SELECT family_id, activation_date, model_id, lag(model_id) OVER (PARTITION BY family_id ORDER BY activation_date) AS p FROM x_sched)
SELECT family_id, activation_date, (p IS NULL OR p <> model_id)::INT AS switch_first_counts, coalesce(p <> model_id, false)::INT AS switch_first_free, {R('(p IS NULL OR p <> model_id)::INT * 20 / 10000.0')} AS switch_cost FROM s""")
def w17(r):
    p = F.lag("model_id").over(Window.partitionBy("family_id").orderBy("activation_date"))
    s = r.schedule().withColumn("p", p)
    first = (F.col("p").isNull() | (F.col("p") != F.col("model_id"))).cast("int")
    return s.select("family_id", "activation_date", first.alias("switch_first_counts"),
                    F.coalesce(F.col("p") != F.col("model_id"), F.lit(False)).cast("int").alias("switch_first_free"), rnd(first * 20 / 10000.0).alias("switch_cost"))


@query("w18_compounded_wealth", f"""
WITH s AS (SELECT family_id, arm, assessment_date, excess_1m AS r FROM x_fmp WHERE excess_1m IS NOT NULL), c AS (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY family_id, arm ORDER BY assessment_date)) AS wealth FROM s),
d AS (SELECT *, wealth / max(wealth) OVER (PARTITION BY family_id, arm ORDER BY assessment_date) - 1 AS dd FROM c)
SELECT family_id, arm, count(*) AS months, {R('arg_max(wealth, assessment_date)')} AS terminal_wealth, {R('arg_max(wealth, assessment_date) ** (12.0 / count(*)) - 1')} AS cagr,
 {R('avg(r) / stddev_pop(r) * sqrt(12)')} AS sharpe, {R('min(dd)')} AS max_drawdown FROM d GROUP BY 1, 2""")
def w18(r):
    w = Window.partitionBy("family_id", "arm").orderBy("assessment_date")
    s = r.family_panel().where("excess_1m IS NOT NULL").withColumn("wealth", win.compounded("excess_1m", w)).withColumn("dd", win.drawdown("wealth", w))
    end = F.max_by("wealth", "assessment_date")
    return s.groupBy("family_id", "arm").agg(F.count(F.lit(1)).alias("months"), rnd(end).alias("terminal_wealth"), rnd(F.pow(end, 12.0 / F.count(F.lit(1))) - 1).alias("cagr"),
                                             rnd(F.avg("excess_1m") / F.stddev_pop("excess_1m") * F.sqrt(F.lit(12.0))).alias("sharpe"), rnd(F.min("dd")).alias("max_drawdown"))


@query("w19_non_overlapping_sample", f"""
SELECT family_id, arm, assessment_date, {R('fwd_3m')} AS fwd_3m FROM (SELECT *, row_number() OVER (PARTITION BY family_id, arm ORDER BY assessment_date) AS rn FROM x_fmp) WHERE (rn - 1) % 3 = 0""")
def w19(r):
    w = Window.partitionBy("family_id", "arm").orderBy("assessment_date")
    return r.family_panel().withColumn("rn", F.row_number().over(w)).where("(rn - 1) % 3 = 0").select("family_id", "arm", "assessment_date", rnd("fwd_3m").alias("fwd_3m"))


@query("w20_quartile_state", f"SELECT cluster_level, cluster_id, arm, assessment_date, rank, unit_count, quartile, {R('rank_pct')} AS rank_pct, date_pos FROM x_state")
def w20(r):
    return r.state().select("cluster_level", "cluster_id", "arm", "assessment_date", F.col("rank").cast("long").alias("rank"), "unit_count", "quartile", rnd("rank_pct").alias("rank_pct"), "date_pos")


@query("w21_daily_percentile", f"""
SELECT decision_date, ticker, {R('1 - (rank() OVER (PARTITION BY decision_date ORDER BY score DESC) + (count(*) OVER (PARTITION BY decision_date, score) - 1) / 2.0) / count(*) OVER (PARTITION BY decision_date)')} AS percentile FROM x_signals""")
def w21(r):
    r.share("signals")
    from chronopanel.operators.joins import daily_percentile
    return daily_percentile(r.signals(), "percentile").select("decision_date", "ticker", rnd("percentile").alias("percentile"))


@query("w22_max_drawdown_episode", f"""
WITH p AS (SELECT family_id, arm, date, rel, max(rel) OVER ({NAV_W}) AS pk FROM x_nav), q AS (SELECT *, rel / pk - 1 AS dd, max(CASE WHEN rel = pk THEN date END) OVER ({NAV_W}) AS pk_at FROM p),
t AS (SELECT family_id, arm, arg_min(date, (dd, date)) AS trough_date, arg_min(pk_at, (dd, date)) AS peak_date, min(dd) AS m FROM q GROUP BY 1, 2)
SELECT family_id, arm, peak_date, trough_date, {R('m')} AS max_drawdown, count(*) FILTER (q.date BETWEEN peak_date AND trough_date) AS episode_sessions FROM q JOIN t USING (family_id, arm) GROUP BY 1, 2, 3, 4, m""")
def w22(r):
    e = wp.max_drawdown_episode(r.nav(), ["family_id", "arm"])
    return e.groupBy("family_id", "arm", "peak_date", "trough_date").agg(rnd(F.first("max_drawdown")).alias("max_drawdown"), F.count_if("in_episode").alias("episode_sessions"))


@query("w23_segment_metrics", f"""
WITH s AS (SELECT *, year(date)::INT AS yr FROM x_nav), e AS (SELECT family_id, arm, yr, arg_max(rel, date) AS end_rel FROM s GROUP BY 1, 2, 3), b AS (SELECT *, lag(end_rel) OVER (PARTITION BY family_id, arm ORDER BY yr) AS prior FROM e),
d AS (SELECT s.family_id, s.arm, s.yr, s.date, s.rel, greatest(coalesce(prior, 0), max(s.rel) OVER (PARTITION BY s.family_id, s.arm, s.yr ORDER BY s.date)) AS pk FROM s JOIN b USING (family_id, arm, yr))
SELECT d.family_id, d.arm, d.yr, {R('any_value(end_rel) / any_value(prior) - 1')} AS segment_return, {R('min(d.rel / d.pk - 1)')} AS segment_drawdown, count(*) AS sessions FROM d JOIN b USING (family_id, arm, yr) GROUP BY 1, 2, 3""")
def w23(r):
    s = r.nav().withColumn("yr", F.year("date"))
    e = s.groupBy("family_id", "arm", "yr").agg(F.max_by("rel", "date").alias("end_rel"))
    b = e.withColumn("prior", F.lag("end_rel").over(Window.partitionBy("family_id", "arm").orderBy("yr")))
    j = s.join(b, ["family_id", "arm", "yr"])
    w = Window.partitionBy("family_id", "arm", "yr").orderBy("date")
    pk = F.greatest(F.coalesce("prior", F.lit(0.0)), F.max("rel").over(w))
    return j.withColumn("dd", F.col("rel") / pk - 1).groupBy("family_id", "arm", "yr").agg(
        rnd(F.first("end_rel") / F.first("prior") - 1).alias("segment_return"), rnd(F.min("dd")).alias("segment_drawdown"), F.count(F.lit(1)).alias("sessions"))


@query("w24_total_return_index", f"""
WITH d AS (SELECT ticker, payable_date, sum(cash) / 1e7 AS cash FROM x_dists GROUP BY 1, 2), pay AS (SELECT d.ticker, s.date, sum(cash) AS cash FROM d JOIN x_sessions s ON s.date = (SELECT min(date) FROM x_sessions z WHERE z.date >= payable_date) GROUP BY 1, 2),
u AS (SELECT p.ticker, p.date, p.close, exp(sum(ln(1 + coalesce(cash, 0) / p.open)) OVER (PARTITION BY p.ticker ORDER BY p.date)) AS units FROM x_prices p LEFT JOIN pay USING (ticker, date))
SELECT ticker, date, {R('units')} AS units, {R('units * close', 4)} AS total_return_value FROM u""")
def w24(r):
    from chronopanel.plans.market import total_return_index
    d = r.distributions().groupBy("ticker", "payable_date").agg((F.sum("cash").cast("double") / 1e7).alias("cash"))
    return total_return_index(r.prices(), d, r.sessions()).select("ticker", "date", rnd("units").alias("units"), rnd("total_return_value", 4).alias("total_return_value"))


@query("w25_momentum_universe", f"""
WITH m AS (SELECT ticker, date, lag(close, 5) OVER w / lag(close, 52) OVER w - 1 AS mom, avg(close * volume) OVER (PARTITION BY ticker ORDER BY date ROWS 12 PRECEDING) AS adv, count(*) OVER (PARTITION BY ticker ORDER BY date ROWS 12 PRECEDING) AS n FROM x_prices WINDOW w AS (PARTITION BY ticker ORDER BY date)),
u AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY round(adv, 6) DESC, ticker) AS liq FROM m WHERE n >= 13 AND mom IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY round(mom, 9) DESC, ticker) AS rank FROM u WHERE liq <= 30)
SELECT ticker, date, {R('mom')} AS momentum, rank, rank <= 5 AS fresh_pick FROM k WHERE rank <= 10""")
def w25(r):
    from chronopanel.plans.market import momentum_universe
    return momentum_universe(r.prices(), skip=5, lookback=52, adv=13, universe=30, keep=10, top=5).select(
        "ticker", "date", rnd("momentum").alias("momentum"), F.col("rank").cast("long").alias("rank"), "fresh_pick")


@query("w26_score_anchor", f"""
WITH p AS (SELECT decision_date, quantile_cont(score, 0.99) AS p99, row_number() OVER (ORDER BY decision_date) AS pos FROM x_signals GROUP BY 1)
SELECT a.decision_date AS assessment_date, count(b.pos) AS decision_days, {R('median(b.p99)')} AS median_p99 FROM p a JOIN p b ON b.pos < a.pos AND b.pos >= a.pos - 26 GROUP BY 1""")
def w26(r):
    r.share("signals")
    p = od.quantiles(r.signals(), ["decision_date"], "score", {"p99": 0.99})
    p = p.withColumn("pos", F.row_number().over(Window.orderBy("decision_date")))
    ahead = p.select(F.explode(F.sequence(F.col("pos") + 1, F.col("pos") + 26)).alias("pos"), F.col("p99").alias("v"))
    return p.join(ahead, "pos").groupBy(F.col("decision_date").alias("assessment_date")).agg(F.count("v").alias("decision_days"), rnd(median("v")).alias("median_p99"))


@query("w27_asof_market_state", f"""
WITH b AS (SELECT date, bench_value AS c, row_number() OVER (ORDER BY date) AS n FROM (SELECT DISTINCT date, bench_value FROM x_nav)),
v AS (SELECT date, c, coalesce(c / lag(c, 20) OVER o - 1, 0) AS m20, coalesce(c / lag(c, 60) OVER o - 1, 0) AS m60, coalesce(c / lag(c, 120) OVER o - 1, 0) AS m120, c / lag(c) OVER o - 1 AS r, c / avg(c) OVER (ORDER BY date ROWS 99 PRECEDING) - 1 AS trend, n FROM b WINDOW o AS (ORDER BY date)),
s AS (SELECT *, CASE WHEN n > 2 THEN stddev_pop(r) OVER (ORDER BY date ROWS 19 PRECEDING) ELSE 0 END AS vol FROM v), t AS (SELECT *, greatest(0, least(1, vol * 10 + greatest(0, -m20) * 2)) AS stress FROM s)
SELECT date, {R('m20')} AS m20, {R('m60')} AS m60, {R('m120')} AS m120, {R('vol')} AS vol20, {R('trend')} AS trend100, {R('stress')} AS stress,
 CASE WHEN stress > 0.7 THEN 'STRESS' WHEN m20 > 0 AND vol > 0.002 THEN 'UP_HIGH_VOL' WHEN m20 > 0 THEN 'UP_LOW_VOL' WHEN vol > 0.002 THEN 'DOWN_HIGH_VOL' ELSE 'DOWN_LOW_VOL' END AS regime FROM t""")
def w27(r):
    from chronopanel.plans.market import market_state
    return market_state(r.bench_nav(), high_vol=0.002).select("date", *[rnd(c).alias(c) for c in ("m20", "m60", "m120", "vol20", "trend100", "stress")], "regime")


@query("w28_weight_turnover", f"""
WITH n AS (SELECT arm, assessment_date, family_id, strategy_value / sum(strategy_value) OVER (PARTITION BY arm, assessment_date) AS w, excess_1m FROM x_fmp JOIN x_month USING (family_id, arm, assessment_date)),
d AS (SELECT DISTINCT arm, assessment_date, dense_rank() OVER (PARTITION BY arm ORDER BY assessment_date) AS pos FROM n), p AS (SELECT n.*, pos FROM n JOIN d USING (arm, assessment_date)),
j AS (SELECT coalesce(a.arm, b.arm) AS arm, coalesce(a.pos, b.pos + 1) AS pos, abs(coalesce(a.w, 0) - coalesce(b.w, 0)) AS dw FROM p a FULL JOIN p b ON a.arm = b.arm AND a.family_id = b.family_id AND a.pos = b.pos + 1),
t AS (SELECT arm, pos, 0.5 * sum(dw) AS turnover FROM j GROUP BY 1, 2), g AS (SELECT arm, pos, any_value(assessment_date) AS assessment_date, sum(w * coalesce(excess_1m, 0)) AS gross FROM p GROUP BY 1, 2)
SELECT arm, assessment_date, {R('turnover')} AS turnover, {R('turnover * 0.002')} AS cost, {R('gross - turnover * 0.002')} AS net, {R('exp(sum(ln(1 + gross - turnover * 0.002)) OVER (PARTITION BY arm ORDER BY pos))')} AS nav FROM t JOIN g USING (arm, pos)""")
def w28(r):
    from chronopanel.plans.market import allocation_path
    panel = r.family_panel()
    total = panel.groupBy("arm", "assessment_date").agg(F.sum("strategy_value").alias("_t"))
    w = panel.join(total, ["arm", "assessment_date"]).select("arm", "assessment_date", "family_id", (F.col("strategy_value") / F.col("_t")).alias("w"), F.coalesce("excess_1m", F.lit(0.0)).alias("ret"))
    return allocation_path(w, 0.002).select("arm", "assessment_date", *[rnd(c).alias(c) for c in ("turnover", "cost", "net", "nav")])
