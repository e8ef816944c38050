"""Aggregation operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronopanel.catalog.registry import R, query
from chronopanel.functions.rounding import rnd
from chronopanel.functions.stats import median, quantile, share
from chronopanel.operators import evidence as ev
from chronopanel.operators import ordered as od
from chronopanel.operators import surface as sf
from chronopanel.operators.joins import lag_pairs, paired_baseline


@query("a1_month_end_rows", f"SELECT family_id, arm, date, {R('rel')} AS rel FROM x_month")
def a1(r):
    return r.monthly().select("family_id", "arm", "date", rnd("rel").alias("rel"))


ACT = "FILTER (trade_count > 0)"
CELL = f"""count(*) AS folds, count(*) {ACT} AS active_folds, {R('avg((cagr_excess > 0)::INT)')} AS positive_fold_fraction,
 {R(f'coalesce(avg((cagr_excess > 0)::INT) {ACT}, 0)')} AS positive_active_fraction, {R('median(cagr_excess)')} AS median_excess,
 {R('quantile_cont(cagr_excess, 0.25)')} AS q25_excess, {R('min(cagr_excess)')} AS worst_excess,
 {R(f'coalesce(median(cagr_excess) {ACT}, 0)')} AS median_active, {R(f'coalesce(quantile_cont(cagr_excess, 0.25) {ACT}, 0)')} AS q25_active,
 {R(f'coalesce(min(cagr_excess) {ACT}, 0)')} AS worst_active, CAST(sum(trade_count) AS BIGINT) AS trade_count,
 {R('median(turnover)')} AS median_turnover, {R('min(worst_dd)')} AS worst_drawdown, count(*) - count(*) {ACT} AS inactive_folds,
 {R(f'count(*) {ACT} / count(*)')} AS active_fold_fraction"""
GATE = "active_folds >= 3 AND positive_active_fraction >= 0.6 AND median_active > 0 AND trade_count >= 8 AS robust_gate"
FOLDS = "f AS (SELECT h, d, fold, avg(cagr_excess) AS cagr_excess, sum(trade_count) AS trade_count, avg(turnover) AS turnover, min(worst_dd) AS worst_dd FROM x_surf GROUP BY 1, 2, 3)"


def hd_folds(r):
    return r.surface().groupBy("h", "d", "fold").agg(F.avg("cagr_excess").alias("cagr_excess"), F.sum("trade_count").alias("trade_count"),
                                                     F.avg("turnover").alias("turnover"), F.min("worst_dd").alias("worst_dd"))


@query("a2_cell_aggregate", f"WITH {FOLDS}, c AS (SELECT h, d, {CELL} FROM f GROUP BY 1, 2) SELECT *, {GATE} FROM c")
def a2(r):
    return sf.cell_aggregate(hd_folds(r), ["h", "d"])


@query("a3_surface_by_treatment", f"WITH c AS (SELECT h, d, treatment, {CELL} FROM x_surf GROUP BY 1, 2, 3) SELECT *, {GATE} FROM c")
def a3(r):
    return sf.cell_aggregate(r.surface(), ["h", "d", "treatment"])


@query("a4_treatment_summary", f"""
WITH c AS (SELECT h, d, treatment, {CELL} FROM x_surf GROUP BY 1, 2, 3), g AS (SELECT *, {GATE} FROM c),
p AS (SELECT g.*, g.median_active - b.median_active AS delta FROM g JOIN g b ON g.h = b.h AND g.d = b.d AND b.treatment = 'N'),
s AS (SELECT treatment, count(*) AS cells, count(*) FILTER (robust_gate) AS robust_cells, {R('avg(robust_gate::INT)')} AS robust_fraction,
 {R('avg((median_active > 0)::INT)')} AS positive_fraction, {R('median(median_active)')} AS median_of_medians, {R('quantile_cont(median_active, 0.25)')} AS q25_of_medians,
 {R('median(delta)')} AS median_delta, {R('quantile_cont(delta, 0.25)')} AS q25_delta, {R('min(delta)')} AS worst_delta,
 CASE WHEN treatment = 'N' THEN 0.0::DOUBLE ELSE {R('avg((delta > 0)::INT)')} END AS beat_fraction, CAST(sum(trade_count) AS BIGINT) AS total_trades FROM p GROUP BY 1),
k AS (SELECT *, CASE WHEN treatment = 'N' THEN cells = 49 AND robust_fraction >= 0.5 AND positive_fraction >= 0.5
      ELSE cells = 49 AND robust_fraction >= 0.5 AND beat_fraction >= 0.6 AND median_delta > 0 AND q25_delta >= 0 END AS passed FROM s)
SELECT *, row_number() OVER (ORDER BY passed DESC, q25_delta DESC, median_delta DESC, robust_fraction DESC, worst_delta DESC, treatment) AS treatment_rank FROM k""")
def a4(r):
    cells = sf.cell_aggregate(r.surface(), ["h", "d", "treatment"])
    cells = paired_baseline(cells, ["h", "d"], "treatment", "N", ["median_active"]).withColumnRenamed("delta_median_active", "delta")
    return sf.treatment_summary(cells, "treatment", "N", 49)


A5_FOLDS = """f AS (SELECT h, fold, avg(cagr_excess) AS cagr_excess, CAST(sum(trade_count) AS BIGINT) AS trade_count, avg(cagr_excess) AS total_return, -avg(turnover) / 20 AS bench_return
              FROM x_surf GROUP BY 1, 2)"""


def outer_folds(r):
    return r.surface().groupBy("h", "fold").agg(
        F.avg("cagr_excess").alias("cagr_excess"), F.sum("trade_count").alias("trade_count"),
        F.avg("cagr_excess").alias("total_return"), (-F.avg("turnover") / 20).alias("bench_return"))


@query("a5_outer_fold_summary", f"""WITH {A5_FOLDS}
SELECT h, count(*) AS folds, count(*) {ACT} AS active_folds, count(*) FILTER (cagr_excess > 0) AS positive_folds,
 {R(f'coalesce(avg((cagr_excess > 0)::INT) {ACT}, 0)')} AS positive_active_fraction, {R('median(cagr_excess)')} AS median_excess,
 {R('quantile_cont(cagr_excess, 0.25)')} AS q25_excess, {R(f'coalesce(min(cagr_excess) {ACT}, 0)')} AS worst_active,
 CAST(sum(trade_count) AS BIGINT) AS trade_count, {R('product(1 + total_return) - 1')} AS chained_return, {R('product(1 + bench_return) - 1')} AS chained_bench
FROM f GROUP BY 1""")
def a5(r):
    return sf.fold_summary(outer_folds(r), ["h"])


CLUS = f"""SELECT cluster_level, cluster_id, arm, assessment_date, {R('excess_1m')} AS excess_1m, {R('trailing_3m')} AS trailing_3m, {R('fwd_1m')} AS fwd_1m,
 {R('fwd_3m')} AS fwd_3m, {R('active_days')} AS active_days, member_count, trade_count, {R('no_opportunity')} AS no_opportunity, has_target FROM x_clus"""


@query("a6_cluster_panel", CLUS)
def a6(r):
    c = r.clusters()
    return c.withColumns({x: rnd(x) for x in ("excess_1m", "trailing_3m", "fwd_1m", "fwd_3m", "active_days", "no_opportunity")})


@query("a7_monthly_activity", """
SELECT family_id, arm, assessment_date, active_days, observed_days, trade_count, last_value(last_entry IGNORE NULLS) OVER w AS last_trade_date,
 CAST(date_diff('day', last_value(last_entry IGNORE NULLS) OVER w, assessment_date) AS INT) AS days_since_last_trade,
 trade_count > 0 OR coalesce(date_diff('day', last_value(last_entry IGNORE NULLS) OVER w, assessment_date) <= 63, false) AS recently_active
FROM x_act WINDOW w AS (PARTITION BY family_id, arm ORDER BY assessment_date)""")
def a7(r):
    from chronopanel.plans.panels import activity_recency
    return activity_recency(r.activity()).drop("last_entry")


@query("a8_bucket_votes", f"""
SELECT decision_date, ticker, arm, CAST(sum(n_families) AS BIGINT) AS raw_families, count(*) AS bucket_votes, {R('avg(score)')} AS mean_score, {R('median(score)')} AS median_score,
 {R('stddev_samp(score)')} AS std_score, {R('max(score) - min(score)')} AS score_range, {R('sum(score * n_events) / sum(n_events) - avg(score)')} AS raw_minus_dedup,
 {R('sum(n_families) / count(*)')} AS raw_density
FROM x_sets GROUP BY 1, 2, 3""")
def a8(r):
    from chronopanel.operators.consensus import bucket_votes
    return bucket_votes(r.sets(), ["decision_date", "ticker", "arm"])


@query("a9_pivot_buckets", f"""
SELECT decision_date, ticker, arm, {R("max(score) FILTER (h_bucket = 'SHORT')")} AS mean_score_short, {R("max(score) FILTER (h_bucket = 'MID')")} AS mean_score_mid,
 {R("max(score) FILTER (h_bucket = 'LONG')")} AS mean_score_long, max(n_families) FILTER (h_bucket = 'SHORT') AS families_short
FROM x_sets GROUP BY 1, 2, 3""")
def a9(r):
    wide = r.sets().groupBy("decision_date", "ticker", "arm").pivot("h_bucket", ["SHORT", "MID", "LONG"]).agg(
        F.max("score").alias("score"), F.max("n_families").alias("families"))
    return wide.select("decision_date", "ticker", "arm", rnd("SHORT_score").alias("mean_score_short"), rnd("MID_score").alias("mean_score_mid"),
                       rnd("LONG_score").alias("mean_score_long"), F.col("SHORT_families").alias("families_short"))


ROBUST = "median({0}) + 0.5 * avg({0}) - 0.5 * stddev_pop({0}) - 0.02 * avg(({0} <= 0)::INT)"


@query("a10_robust_statistics", f"""
SELECT h, treatment, count(cagr_excess) AS n, {R('avg(cagr_excess)')} AS mean, {R('median(cagr_excess)')} AS median, {R('stddev_pop(cagr_excess)')} AS std,
 {R('avg((cagr_excess <= 0)::INT)')} AS negative_rate, {R('avg(abs(cagr_excess))')} AS mean_abs, {R(ROBUST.format('cagr_excess'))} AS robust_score
FROM x_surf GROUP BY 1, 2""")
def a10(r):
    return ev.robust_fold_statistics(r.surface(), ["h", "treatment"], "cagr_excess")


AVG_RANK = "rank() OVER (PARTITION BY {p} ORDER BY {x}) + (count(*) OVER (PARTITION BY {p}, {x}) - 1) / 2.0"


@query("a11_fold_metrics", f"""
WITH p AS (SELECT date_trunc('quarter', decision_date)::DATE AS fold_id, score * 0.1 AS prediction, excess FROM x_panel),
k AS (SELECT *, {AVG_RANK.format(p='fold_id', x='prediction')} AS rx, {AVG_RANK.format(p='fold_id', x='excess')} AS ry FROM p)
SELECT fold_id, count(*) AS observations, {R('coalesce(corr(rx, ry), 0)')} AS spearman, {R('avg(abs(prediction - excess))')} AS mae,
 {R('1 - sum((prediction - excess) * (prediction - excess)) / (var_pop(excess) * count(*))')} AS r2, {R('avg(excess)')} AS mean_outcome
FROM k GROUP BY 1 HAVING count(*) >= 30""")
def a11(r):
    p = r.staged_panel().select(F.trunc("decision_date", "quarter").alias("fold_id"), (F.col("score") * 0.1).alias("prediction"), "excess")
    m = ev.fold_predictive_metrics(p, ["fold_id"], "prediction", "excess", 30)
    return m.select("fold_id", "observations", *[rnd(c).alias(c) for c in ("spearman", "mae", "r2", "mean_outcome")])


@query("a12_rank_ic_by_date", f"""
WITH k AS (SELECT decision_date, {AVG_RANK.format(p='decision_date', x='score')} AS rx, {AVG_RANK.format(p='decision_date', x='excess')} AS ry FROM x_panel)
SELECT decision_date, CASE WHEN count(*) >= 3 THEN {R('corr(rx, ry)')} END AS rank_ic, count(*) AS n_rows FROM k GROUP BY 1""")
def a12(r):
    return od.rank_ic(r.staged_panel(), ["decision_date"], "score", "excess").withColumn("rank_ic", rnd("rank_ic"))


@query("a12_rank_ic_overall", f"""
WITH k AS (SELECT rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0 AS rx,
                  rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS ry FROM lineitem)
SELECT {R('corr(rx, ry)')} AS rank_ic, count(*) AS n_rows FROM k""")
def a12_all(r):
    return od.rank_ic(r.table("lineitem"), [], "l_discount", "l_quantity").withColumn("rank_ic", rnd("rank_ic"))


@query("a13_top_spread", f"""
WITH k AS (SELECT *, quantile_cont(score, 0.75) OVER (PARTITION BY decision_date) AS cut FROM x_panel)
SELECT decision_date, count(*) AS n_rows, {R('avg(excess) FILTER (score >= cut) - avg(excess) FILTER (score < cut)')} AS spread
FROM k GROUP BY 1 HAVING count(*) >= 4 AND avg(excess) FILTER (score < cut) IS NOT NULL""")
def a13(r):
    return ev.top_spread(r.staged_panel(), ["decision_date"], "score", "excess").withColumn("spread", rnd("spread"))


A14 = """
th AS (SELECT decision_date, 0.85 + 0.01 * (year(decision_date) % 5) AS threshold FROM (SELECT DISTINCT decision_date FROM x_signals)),
act AS (SELECT s.decision_date, count(*) AS universe, min(score) AS score_min, max(score) AS score_max, any_value(threshold) AS threshold,
  count(*) FILTER (score >= threshold) AS crossings, median(score) AS score_median, quantile_cont(score, 0.9) AS score_p90, quantile_cont(score, 0.95) AS score_p95,
  quantile_cont(score, 0.975) AS score_p97_5, quantile_cont(score, 0.99) AS score_p99 FROM x_signals s JOIN th USING (decision_date) GROUP BY 1)"""


def activation(r):
    r.share("signals")
    th = r.signals().select("decision_date").distinct().withColumn("threshold", 0.85 + 0.01 * (F.year("decision_date") % 5))
    return ev.daily_activation(r.signals(), th, 0.05)


@query("a14_daily_activation", f"""
WITH {A14} SELECT decision_date, universe, crossings, {', '.join(R(c) + ' AS ' + c for c in ('score_min', 'score_max', 'threshold', 'score_median', 'score_p90', 'score_p95', 'score_p97_5', 'score_p99'))},
 CAST(greatest(1, ceil(universe * 0.05)) AS BIGINT) AS "limit", CAST(least(greatest(1, ceil(universe * 0.05)), crossings) AS BIGINT) AS final_eligible,
 {R('score_max - threshold')} AS max_margin, {R('threshold / score_p99')} AS threshold_over_p99 FROM act""")
def a14(r):
    d = activation(r)
    return d.withColumns({c: rnd(c) for c in ("score_min", "score_max", "threshold", "score_median", "score_p90", "score_p95", "score_p97_5",
                                              "score_p99", "max_margin", "threshold_over_p99")})


@query("a15_period_activation", f"""
WITH {A14} SELECT CAST(date_trunc('quarter', decision_date) AS DATE) AS period, count(*) AS days, count(*) FILTER (crossings > 0) AS days_with_crossing,
 {R('avg((crossings > 0)::INT)')} AS crossing_day_rate, CAST(sum(crossings) AS BIGINT) AS total_crossings,
 CAST(sum(least(greatest(1, ceil(universe * 0.05)), crossings)) AS BIGINT) AS total_eligible, {R('median(universe)')} AS median_universe,
 {R('median(score_p99)')} AS median_p99, {R('median(score_max - threshold)')} AS median_margin FROM act GROUP BY 1""")
def a15(r):
    return ev.period_activation(activation(r), "quarter")


@query("a16_alpha_table", f"""
WITH k AS (SELECT CAST(date_trunc('year', decision_date) AS DATE) AS period, excess, ({AVG_RANK.format(p='decision_date', x='score')}) / count(*) OVER (PARTITION BY decision_date) AS pct FROM x_panel)
SELECT period, count(*) AS n_rows, {', '.join(f"count(*) FILTER (pct >= {p}) AS {n}_rows, {R(f'avg(excess) FILTER (pct >= {p})')} AS {n}_mean, {R(f'avg((excess > 0)::INT) FILTER (pct >= {p})')} AS {n}_hit" for p, n in ((0.995, 'top_0_5pct'), (0.99, 'top_1pct'), (0.95, 'top_5pct'), (0.9, 'top_10pct')))},
 {R('avg(excess) FILTER (pct >= 0.9) - avg(excess) FILTER (pct <= 0.1)')} AS decile_spread FROM k GROUP BY 1""")
def a16(r):
    p = od.rank_columns(r.staged_panel(), ["decision_date"], "score", pct="pct").withColumn("period", F.trunc("decision_date", "year"))
    return ev.alpha_table(p, ["period"])


@query("a17_daily_top_threshold", f"""
SELECT family_id, count(*) AS days, {R('quantile_cont(top, 0.9)', 2)} AS q90, {R('quantile_cont(top, 0.5)', 2)} AS q50 FROM
 (SELECT family_id, decision_date, max(score) AS top FROM x_ord GROUP BY 1, 2) GROUP BY 1""")
def a17(r):
    top = r.order_signals().groupBy("family_id", "decision_date").agg(F.max("score").alias("top"))
    return top.groupBy("family_id").agg(F.count(F.lit(1)).alias("days"), rnd(quantile("top", 0.9), 2).alias("q90"), rnd(quantile("top", 0.5), 2).alias("q50"))


@query("a18_trade_concentration", f"""
WITH t AS (SELECT year(entry_date)::INT AS yr, *, greatest(excess, 0) AS pos FROM x_tr), k AS (SELECT *, row_number() OVER (PARTITION BY yr ORDER BY pos DESC, trade_id) AS rn FROM t),
a AS (SELECT yr, count(*) AS trades, sum(pos) AS p, sum(excess) AS s, max(excess) AS m, sum(pos) FILTER (rn <= 1) AS t1, sum(pos) FILTER (rn <= 5) AS t5, sum(pos) FILTER (rn <= 10) AS t10 FROM k GROUP BY 1),
b AS (SELECT yr, count(*) AS tickers, max(n) AS maxn, sum(n * n) / (sum(n) * sum(n)) AS h, count(*) FILTER (tv > 0) AS w, max(abs(tv)) / sum(abs(tv)) AS tc FROM
      (SELECT yr, ticker, count(*)::DOUBLE AS n, sum(excess) AS tv FROM t GROUP BY 1, 2) GROUP BY 1)
SELECT yr, trades, tickers, w AS independent_winners, {R('t1 / p')} AS top1_share, {R('t5 / p')} AS top5_share, {R('t10 / p')} AS top10_share, {R('maxn / trades')} AS top_ticker_share,
 {R('h')} AS hhi, {R('1 / h')} AS effective_names, {R('tc')} AS ticker_concentration, {R('(s - m) / greatest(1, trades - 1)')} AS leave_best_out FROM a JOIN b USING (yr)""")
def a18(r):
    return ev.trade_concentration(r.trade_returns().withColumn("yr", F.year("entry_date")), ["yr"], "excess")


@query("a19_leave_one_fold_out", f"""
WITH {A5_FOLDS}
SELECT a.h, a.fold AS removed, count(*) FILTER (b.trade_count > 0) AS active_folds,
 {R('coalesce(avg((b.cagr_excess > 0)::INT) FILTER (b.trade_count > 0), 0)')} AS positive_active, {R('median(b.cagr_excess) FILTER (b.trade_count > 0)')} AS median_active,
 {R('quantile_cont(b.cagr_excess, 0.25) FILTER (b.trade_count > 0)')} AS q25_active, {R('min(b.cagr_excess) FILTER (b.trade_count > 0)')} AS worst_active,
 {R('product(1 + b.total_return) - product(1 + b.bench_return)')} AS chained_excess
FROM f a JOIN f b ON a.h = b.h AND a.fold <> b.fold GROUP BY 1, 2""")
def a19(r):
    return ev.leave_one_out(outer_folds(r), ["h"], "fold")


REG = "reg AS (SELECT date, br, CASE WHEN ret4 > 0.004 THEN 'UP' WHEN ret4 < -0.004 THEN 'DOWN' ELSE 'FLAT' END AS regime FROM (SELECT date, br, sum(br) OVER (ORDER BY date ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS ret4 FROM x_bret))"


def regimes(r):
    w = Window.orderBy("date")
    b = r.table("lineitem").groupBy(F.date_trunc("week", "l_shipdate").cast("date").alias("date")).agg(
        (F.avg(F.col("l_discount") - F.col("l_tax")) - 0.01).alias("br"))
    ret4 = F.sum("br").over(w.rowsBetween(-4, -1))
    return b.select("date", "br", F.when(ret4 > 0.004, "UP").when(ret4 < -0.004, "DOWN").otherwise("FLAT").alias("regime"))


@query("a20_regime_attribution", f"""
WITH {REG} SELECT family_id, arm, regime, count(*) AS sessions, {R('product(1 + r) - 1')} AS r, {R('product(1 + br) - 1')} AS br FROM x_ret JOIN reg USING (date) GROUP BY 1, 2, 3""")
def a20(r):
    return ev.compounded_by(r.returns().join(regimes(r), "date"), ["family_id", "arm", "regime"], ["r", "br"])


@query("a21_segment_compounding", f"""
WITH c AS (SELECT family_id, decision_date AS date, avg(score) / 10000000 - 0.02 AS r FROM x_ord GROUP BY 1, 2),
s AS (SELECT c.*, s.model_id FROM c ASOF JOIN x_sched s ON s.family_id = c.family_id AND c.date >= s.activation_date)
SELECT family_id, model_id, count(*) AS sessions, min(date) AS first_date, max(date) AS last_date, {R('product(1 + r) - 1')} AS compounded,
 true AS reconstructs FROM s GROUP BY 1, 2""")
def a21(r):
    from chronopanel.operators.asof import asof_join
    c = r.order_signals().groupBy("family_id", F.col("decision_date").alias("date")).agg((F.avg("score") / 10000000 - 0.02).alias("r"))
    active = asof_join(c, r.schedule().drop("threshold"), ["family_id"], "date", "activation_date", how="inner")
    seg = active.groupBy("family_id", "model_id").agg(F.count(F.lit(1)).alias("sessions"), F.min("date").alias("first_date"),
                                                      F.max("date").alias("last_date"), F.product(1 + F.col("r")).alias("g"))
    whole = c.groupBy("family_id").agg(F.product(1 + F.col("r")).alias("_whole"))
    parts = seg.groupBy("family_id").agg(F.product("g").alias("_parts"))
    return seg.join(whole, "family_id").join(parts, "family_id").select(
        "family_id", "model_id", "sessions", "first_date", "last_date", rnd(F.col("g") - 1).alias("compounded"),
        (F.abs(F.col("_whole") - F.col("_parts")) <= 1e-9 * F.abs("_whole")).alias("reconstructs"))


@query("a22_threshold_jaccard", f"""
WITH v AS (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS decision_date, l_suppkey AS ticker, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
k AS (SELECT decision_date, count(*) FILTER (score >= 0.6 AND q >= 40) AS i, count(*) FILTER (score >= 0.6 OR q >= 40) AS u FROM x_signals JOIN v USING (decision_date, ticker) GROUP BY 1)
SELECT CAST(date_trunc('year', decision_date) AS DATE) AS period, {R('median(i / u)')} AS median_jaccard, count(*) AS days FROM k WHERE u > 0 GROUP BY 1""")
def a22(r):
    q = r.table("lineitem").groupBy(F.date_trunc("week", "l_shipdate").cast("date").alias("decision_date"), F.col("l_suppkey").alias("ticker")).agg(F.sum("l_quantity").alias("q"))
    a, b = F.col("score") >= 0.6, F.col("q") >= 40
    day = r.signals().join(q, ["decision_date", "ticker"]).groupBy("decision_date").agg(F.count_if(a & b).alias("i"), F.count_if(a | b).alias("u")).where("u > 0")
    return day.withColumn("j", F.col("i") / F.col("u")).groupBy(F.trunc("decision_date", "year").alias("period")).agg(
        rnd(median("j")).alias("median_jaccard"), F.count(F.lit(1)).alias("days"))


POS = """
e AS (SELECT t.*, s.idx, s.date FROM x_trades t JOIN x_sessions s ON s.date BETWEEN t.entry_date AND t.exit_date),
p AS (SELECT p.*, s.idx FROM x_prices p JOIN x_sessions s USING (date)),
pos AS (SELECT e.trade_id, e.ticker, e.date, e.entry_date, e.arm, CASE WHEN e.date = e.exit_date THEN c.open ELSE c.close END / CASE WHEN e.date = e.entry_date THEN c.open ELSE b.close END - 1 AS v
      FROM e JOIN p c ON c.ticker = e.ticker AND c.idx = e.idx LEFT JOIN p b ON b.ticker = e.ticker AND b.idx = e.idx - 1 WHERE e.date = e.entry_date OR b.close IS NOT NULL)"""


def positions(r, *more):
    r.share("prices", "trades")
    from chronopanel.operators.joins import position_sessions
    return position_sessions(r.trades(), r.prices(), r.sessions(), ["arm", *more])


EPISODE = POS + """,
nv AS (SELECT arm, date, round(avg(rel), 10) AS rel FROM x_nav GROUP BY 1, 2), pk AS (SELECT *, max(rel) OVER (PARTITION BY arm ORDER BY date) AS pk FROM nv),
dd AS (SELECT *, rel / pk - 1 AS dd, max(CASE WHEN rel = pk THEN date END) OVER (PARTITION BY arm ORDER BY date) AS pk_at FROM pk),
ep AS (SELECT arm, arg_min(pk_at, (dd, date)) AS peak_date, arg_min(date, (dd, date)) AS trough_date FROM dd GROUP BY 1),
ins AS (SELECT pos.*, t.hold, s.s_nationkey AS sector FROM pos JOIN ep ON ep.arm = pos.arm AND pos.date BETWEEN peak_date AND trough_date JOIN x_trades t USING (trade_id) LEFT JOIN supplier s ON s.s_suppkey = pos.ticker),
w AS (SELECT arm, sum(-least(v, 0)) AS w FROM ins GROUP BY 1),
l AS (SELECT 'ticker' AS dimension, ticker::VARCHAR AS key, * FROM ins UNION ALL SELECT 'sector', coalesce(sector::VARCHAR, 'UNKNOWN'), * FROM ins UNION ALL SELECT 'generation', year(entry_date)::VARCHAR, * FROM ins UNION ALL SELECT 'recipe', hold::VARCHAR, * FROM ins
 UNION ALL SELECT 'trade', trade_id::VARCHAR, * FROM ins),
sh AS (SELECT arm, dimension, key, sum(v) AS net, sum(-least(v, 0)) AS losses, count(DISTINCT date) AS sessions, count(DISTINCT trade_id) AS trades, coalesce(sum(-least(v, 0)) / nullif(any_value(w), 0), 0) AS share FROM l JOIN w USING (arm) GROUP BY 1, 2, 3)"""


def episode_losses(r):
    """Loss shares of each arm inside the deepest drawdown of its curve, by five dimensions."""
    from chronopanel.operators.wealth import max_drawdown_episode
    curve = r.nav().groupBy("arm", "date").agg(F.round(F.avg("rel"), 10).alias("rel"))
    episode = max_drawdown_episode(curve, ["arm"]).select("arm", "peak_date", "trough_date").distinct()
    sector = r.table("supplier").select(F.col("s_suppkey").alias("ticker"), F.col("s_nationkey").alias("sector"))
    inside = positions(r, "hold").join(episode, "arm").where(F.col("date").between(F.col("peak_date"), F.col("trough_date"))).join(sector, "ticker", "left")
    return ev.attribution(inside, ["arm"], {"ticker": F.col("ticker"), "sector": F.col("sector"), "generation": F.year("entry_date"), "recipe": F.col("hold"), "trade": F.col("trade_id")}, "interval_return", "date", "trade_id")


@query("a23_loss_attribution", f"WITH {EPISODE} SELECT arm, dimension, key, {R('net', 4)} AS net, {R('losses', 4)} AS losses, sessions, trades, {R('share')} AS share FROM sh")
def a23(r):
    return episode_losses(r).select("arm", "dimension", "key", rnd("net", 4).alias("net"), rnd("losses", 4).alias("losses"), "sessions", "trades", rnd("share").alias("share"))


@query("a23_dominant_cause", f"""
WITH {EPISODE}, t AS (SELECT arm, max(share) FILTER (dimension = 'ticker') AS t, max(share) FILTER (dimension = 'generation') AS g, arg_max(key, (share, key)) FILTER (dimension = 'ticker') AS top_ticker, arg_max(key, (share, key)) FILTER (dimension = 'generation') AS top_generation FROM sh GROUP BY 1)
SELECT arm, CASE WHEN t >= 0.5 THEN 'A_SINGLE_TICKER_OUTLIER' WHEN g >= 0.6 THEN 'B_GENERATION_CLUSTER' ELSE 'C_MULTI_NAME_OR_MARKET_CLUSTER' END AS cause, top_ticker, {R('t')} AS top_ticker_share, top_generation, {R('g')} AS top_generation_share FROM t""")
def a23_cause(r):
    return ev.dominant_cause(episode_losses(r), ["arm"])


PLATEAU = """CASE WHEN regexp_matches(family_id, '^H\\d{2}_D\\d{2}_N\\d{2}_(FIXED|LEARNED_EXIT)$') THEN
  printf('H%02d-%02d_D%02d-%02d_%s', ((h - 1) // 3) * 3 + 1, least(30, ((h - 1) // 3) * 3 + 3), ((d - 1) // 3) * 3 + 1, least(30, ((d - 1) // 3) * 3 + 3), substr(family_id, 13)) ELSE family_id END"""
FAMP = f"fp AS (SELECT *, {PLATEAU} AS plateau_id FROM (SELECT *, CAST(substr(family_id, 2, 2) AS BIGINT) AS h, CAST(substr(family_id, 6, 2) AS BIGINT) AS d FROM x_famy))"


@query("a24_plateau_collapse", f"""
WITH {FAMP} SELECT yr, plateau_id, {R('median(metric)')} AS metric, {R('median(n_trades)')} AS n_trades, arg_min(family_id, family_id) AS first_family, count(DISTINCT family_id) AS families
FROM fp GROUP BY 1, 2""")
def a24(r):
    x = r.family_years().withColumn("first_family", F.col("family_id"))
    out = sf.collapse_to_plateaus(x, "yr", ["metric", "n_trades"], ["first_family"])
    return out.withColumns({"metric": rnd("metric"), "n_trades": rnd("n_trades")})


@query("a25_plateau_horizon_contrasts", f"""
WITH {FAMP}, w AS (SELECT h, plateau_id, family_id, yr, max(metric) FILTER (arm = 'R') - max(metric) FILTER (arm = 'A') AS c FROM fp GROUP BY 1, 2, 3, 4)
SELECT plateau_id, CAST(h AS INT) AS h, {R('median(c)')} AS median_contrast, count(DISTINCT family_id) AS families FROM w WHERE c IS NOT NULL GROUP BY GROUPING SETS ((plateau_id), (h))""")
def a25(r):
    x = r.family_years().withColumn("plateau_id", sf.plateau_of_family()).withColumn("h", F.regexp_extract("family_id", r"^H(\d{2})", 1).cast("int"))
    w = x.groupBy("h", "plateau_id", "family_id", "yr").pivot("arm", ["A", "R"]).agg(F.max("metric")).withColumn("c", F.col("R") - F.col("A")).where("c IS NOT NULL")
    return w.groupingSets([["plateau_id"], ["h"]], "plateau_id", "h").agg(rnd(median("c")).alias("median_contrast"), F.countDistinct("family_id").alias("families"))


@query("a26_arm_comparison", f"""
WITH {FAMP}, w AS (SELECT yr, plateau_id, family_id, max(metric) FILTER (arm = 'A') AS a, max(metric) FILTER (arm = 'N') AS b, max(metric) FILTER (arm = 'R') AS c FROM fp GROUP BY 1, 2, 3),
p AS (SELECT yr, plateau_id, avg(b - a) AS ba, avg(c - b) AS cb FROM w WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL GROUP BY 1, 2)
SELECT yr, {R('median(ba)')} AS delta_ba, {R('median(cb)')} AS delta_cb, count(*) AS plateaus FROM p GROUP BY 1""")
def a26(r):
    from chronopanel.operators.consensus import compare_arms
    return compare_arms(r.family_years().withColumn("plateau_id", sf.plateau_of_family()), "yr", "metric", ("A", "N", "R"))


@query("a27_event_summaries", f"""
WITH e AS (SELECT family_id, activation_date, threshold - lag(threshold) OVER (PARTITION BY family_id ORDER BY activation_date) AS delta FROM x_sched)
SELECT family_id, CAST(year(activation_date) AS INT) AS yr, count(delta) AS events, {R('avg(delta)', 2)} AS mean_delta, {R('median(delta)', 2)} AS median_delta,
 {R('avg((delta > 0)::INT)')} AS positive_fraction FROM e GROUP BY GROUPING SETS ((family_id, yr), (family_id), (yr), ())""")
def a27(r):
    from chronopanel.operators.schedules import refit_events
    e = refit_events(r.schedule()).withColumn("yr", F.year("activation_date"))
    return e.groupingSets([["family_id", "yr"], ["family_id"], ["yr"], []], "family_id", "yr").agg(
        F.count("threshold_delta").alias("events"), rnd(F.avg("threshold_delta"), 2).alias("mean_delta"),
        rnd(median("threshold_delta"), 2).alias("median_delta"), rnd(share(F.col("threshold_delta") > 0)).alias("positive_fraction"))


@query("a28_feature_associations", f"""
WITH l AS (SELECT excess AS y, 'score' AS feature, score AS x FROM x_panel UNION ALL SELECT excess, 'bench_return', bench_return FROM x_panel UNION ALL SELECT excess, 'ticker', ticker::DOUBLE FROM x_panel),
k AS (SELECT feature, {AVG_RANK.format(p='feature', x='x')} AS rx, {AVG_RANK.format(p='feature', x='y')} AS ry FROM l)
SELECT feature, {R('corr(rx, ry)')} AS spearman, count(*) AS n_rows FROM k GROUP BY 1""")
def a28(r):
    return ev.feature_associations(r.staged_panel(), ["score", "bench_return", "ticker"], "excess").withColumn("spearman", rnd("spearman"))


BINS = """e AS (SELECT quantile_cont(score, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS q FROM x_panel),
b AS (SELECT score, excess, greatest(1, (score > q[1])::INT + (score > q[2])::INT + (score > q[3])::INT + (score > q[4])::INT + (score > q[5])::INT) AS bin FROM x_panel, e)"""


@query("a29_quintile_bins", f"""
WITH {BINS} SELECT CAST(bin AS BIGINT) AS bin, count(*) AS n_rows, {R('min(score)')} AS feature_min, {R('max(score)')} AS feature_max, {R('avg(excess)')} AS mean_target,
 {R('avg((excess > 0)::INT)')} AS positive_rate, {R('median(excess)')} AS median_target FROM b GROUP BY 1""")
def a29(r):
    b = ev.quintile_bins(r.staged_panel(), "score", "excess")
    return b.withColumns({c: rnd(c) for c in ("feature_min", "feature_max", "mean_target", "positive_rate", "median_target")})


@query("a29_monotonicity", f"""
WITH {BINS}, m AS (SELECT bin, avg(excess) AS mt FROM b GROUP BY 1), k AS (SELECT *, rank() OVER (ORDER BY mt) AS r FROM m)
SELECT count(*) AS bins, {R('regr_slope(mt, bin)')} AS slope, {R('corr(bin, r)')} AS spearman FROM k""")
def a29_mono(r):
    return ev.bin_monotonicity(ev.quintile_bins(r.staged_panel(), "score", "excess"))


@query("a30_yearly_returns", f"""
SELECT family_id, arm, CAST(year(date) AS INT) AS yr, {R('arg_max(strategy_value, date) / arg_min(strategy_value, date) - 1')} AS strategy_return,
 {R('arg_max(bench_value, date) / arg_min(bench_value, date) - 1')} AS bench_return, count(*) AS sessions FROM x_nav GROUP BY 1, 2, 3""")
def a30(r):
    span = lambda c: rnd(F.max_by(c, "date") / F.min_by(c, "date") - 1)
    return r.nav().groupBy("family_id", "arm", F.year("date").alias("yr")).agg(
        span("strategy_value").alias("strategy_return"), span("bench_value").alias("bench_return"), F.count(F.lit(1)).alias("sessions"))


@query("a35_transition_matrix", f"""
WITH p AS (SELECT a.cluster_level, a.arm, a.quartile AS f, b.quartile AS t FROM x_state a JOIN x_state b ON a.cluster_level = b.cluster_level AND a.arm = b.arm AND a.cluster_id = b.cluster_id AND b.date_pos = a.date_pos + 1)
SELECT cluster_level, arm, f AS from_state, t AS to_state, count(*) AS n, {R('count(*) / sum(count(*)) OVER (PARTITION BY cluster_level, arm)')} AS probability FROM p GROUP BY 1, 2, 3, 4""")
def a35(r):
    return ev.transitions(state_pairs(r, 1))


STATE_COLS = ["rank", "rank_pct", "quartile", "unit_count"]


def state_pairs(r, lag):
    r.share("state")
    s = r.state().drop("date_pos").select("cluster_level", "arm", "cluster_id", "assessment_date", *STATE_COLS)
    return lag_pairs(s, ["cluster_level", "arm"], ["cluster_id"], "assessment_date", lag, STATE_COLS)


@query("a36_persistence", f"""
WITH p AS (SELECT lg AS lag, a.cluster_level, a.arm, a.assessment_date, a.rank, b.rank AS fr, a.rank_pct, b.rank_pct AS frp, a.quartile, b.quartile AS fq
  FROM x_state a CROSS JOIN (SELECT unnest([1, 3]) AS lg) JOIN x_state b ON a.cluster_level = b.cluster_level AND a.arm = b.arm AND a.cluster_id = b.cluster_id AND b.date_pos = a.date_pos + lg),
k AS (SELECT *, rank() OVER (PARTITION BY lag, cluster_level, arm, assessment_date ORDER BY rank) AS ra, rank() OVER (PARTITION BY lag, cluster_level, arm, assessment_date ORDER BY fr) AS rb FROM p),
d AS (SELECT lag, cluster_level, arm, assessment_date, CASE WHEN count(*) > 1 THEN corr(ra, rb) END AS rc, avg((fq = 'TOP')::INT) FILTER (quartile = 'TOP') AS qp, avg(abs(rank_pct - frp)) AS turn,
  avg((fr <= 1)::INT) FILTER (rank <= 1) AS w1, avg((fr <= 3)::INT) FILTER (rank <= 3) AS w3, avg((fr <= 5)::INT) FILTER (rank <= 5) AS w5 FROM k GROUP BY 1, 2, 3, 4)
SELECT cluster_level, arm, CAST(lag AS INT) AS lag, count(rc) AS observations, {R('avg(rc)')} AS mean_rank_autocorrelation, {R('median(rc)')} AS median_rank_autocorrelation, {R('avg((rc > 0)::INT)')} AS positive_fraction,
 {R('avg(qp)')} AS top_quartile_persistence, {R('avg(w1)')} AS winner_persistence_1, {R('avg(w3)')} AS winner_persistence_3, {R('avg(w5)')} AS winner_persistence_5, {R('avg(turn)')} AS mean_rank_turnover,
 {R('quantile_cont(turn, 0.95)')} AS p95_rank_turnover FROM d GROUP BY 1, 2, 3""")
def a36(r):
    pairs = state_pairs(r, 1).withColumn("lag", F.lit(1)).unionByName(state_pairs(r, 3).withColumn("lag", F.lit(3)))
    return ev.persistence(pairs)


@query("a37_future_spread", f"""
WITH x AS (SELECT s.*, c FROM x_state s CROSS JOIN (SELECT unnest(['ALL', 'ACTIVE_ONLY', 'NO_OPPORTUNITY']) AS c)
  WHERE c = 'ALL' OR (c = 'ACTIVE_ONLY' AND no_opportunity < 1) OR (c = 'NO_OPPORTUNITY' AND no_opportunity > 0)),
d AS (SELECT cluster_level, arm, c, assessment_date, avg(fwd_1m) FILTER (quartile = 'TOP') - avg(fwd_1m) FILTER (quartile <> 'TOP') AS s FROM x GROUP BY 1, 2, 3, 4)
SELECT cluster_level, arm, c AS condition, count(*) AS observations, {R('avg(s)')} AS mean_spread, {R('median(s)')} AS median_spread FROM d WHERE s IS NOT NULL GROUP BY 1, 2, 3""")
def a37(r):
    return ev.future_spread(r.state(), "fwd_1m", {"ALL": F.lit(True), "ACTIVE_ONLY": F.col("no_opportunity") < 1, "NO_OPPORTUNITY": F.col("no_opportunity") > 0})


@query("a38_entry_rank_contribution", f"""
WITH k AS (SELECT *, row_number() OVER (PARTITION BY decision_date ORDER BY score DESC, ticker) AS rn FROM x_panel), g AS (SELECT rn, count(*) AS trades, sum(excess) AS s FROM k WHERE rn <= 6 GROUP BY 1)
SELECT CAST(rn AS INT) AS entry_rank, trades, {R('s / trades')} AS mean_excess, {R('sum(s) OVER (ORDER BY rn)', 4)} AS cumulative, {R('s / trades - lag(s / trades) OVER (ORDER BY rn)')} AS marginal FROM g""")
def a38(r):
    g = od.top_rows(r.panel(), ["decision_date"], [F.desc("score"), F.asc("ticker")], 6, "entry_rank").groupBy("entry_rank").agg(
        F.count(F.lit(1)).alias("trades"), F.sum("excess").alias("s"), F.avg("excess").alias("m"))
    w = Window.orderBy("entry_rank")
    return g.select("entry_rank", "trades", rnd("m").alias("mean_excess"), rnd(F.sum("s").over(w), 4).alias("cumulative"),
                    rnd(F.col("m") - F.lag("m").over(w)).alias("marginal"))


@query("a39_multi_seed_summary", f"""
WITH m AS (SELECT arm AS seed, family_id, max(strategy_value) AS terminal, min(rel) AS worst, avg(positions) AS avg_positions FROM x_nav GROUP BY 1, 2),
l AS (SELECT seed, 'terminal' AS metric, terminal AS v FROM m UNION ALL SELECT seed, 'worst', worst FROM m UNION ALL SELECT seed, 'avg_positions', avg_positions FROM m)
SELECT seed, metric, {R('min(v)')} AS min, {R('median(v)')} AS median, {R('avg(v)')} AS mean, {R('max(v)')} AS max FROM l GROUP BY 1, 2""")
def a39(r):
    m = r.nav().groupBy(F.col("arm").alias("seed"), "family_id").agg(
        F.max("strategy_value").alias("terminal"), F.min("rel").alias("worst"), F.avg("positions").alias("avg_positions"))
    long = m.unpivot(["seed", "family_id"], ["terminal", "worst", "avg_positions"], "metric", "v")
    return long.groupBy("seed", "metric").agg(rnd(F.min("v")).alias("min"), rnd(median("v")).alias("median"), rnd(F.avg("v")).alias("mean"), rnd(F.max("v")).alias("max"))


@query("a40_objective_audit", f"""
WITH b AS (SELECT assessment_date, arm, arg_max(fwd_1m, (round(excess_1m, 9), family_id)) AS picked, corr(excess_1m, fwd_1m) AS c FROM x_fmp WHERE excess_1m IS NOT NULL AND fwd_1m IS NOT NULL GROUP BY 1, 2)
SELECT arm, count(*) AS months, {R('product(1 + picked) - 1')} AS compounded, {R('avg(c)')} AS mean_corr FROM b GROUP BY 1""")
def a40(r):
    x = r.family_panel().where("excess_1m IS NOT NULL AND fwd_1m IS NOT NULL")
    b = x.groupBy("assessment_date", "arm").agg(F.max_by("fwd_1m", F.struct(F.round("excess_1m", 9), "family_id")).alias("picked"),
                                                od.safe_corr(F.col("excess_1m"), F.col("fwd_1m")).alias("c"))
    return b.groupBy("arm").agg(F.count(F.lit(1)).alias("months"), rnd(F.product(1 + F.col("picked")) - 1).alias("compounded"), rnd(F.avg("c")).alias("mean_corr"))
