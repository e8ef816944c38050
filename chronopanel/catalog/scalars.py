"""Projections, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronopanel.catalog.aggregates import PLATEAU
from chronopanel.catalog.registry import R, query
from chronopanel.catalog.selectors import VENUE, venue_quotes
from chronopanel.functions import domain as dm
from chronopanel.functions.rounding import clean, rnd
from chronopanel.functions.stats import median, share, sign_test, wilson
from chronopanel.operators import selection as sel
from chronopanel.operators import surface as sf


@query("p1_signal_active", f"SELECT decision_date, ticker, score >= 0.6 AS signal_active, {R('score - 0.6')} AS distance FROM x_signals")
def p1(r):
    return r.signals().select("decision_date", "ticker", (F.col("score") >= 0.6).alias("signal_active"), rnd(F.col("score") - 0.6).alias("distance"))


@query("p2_bands", """
SELECT p_partkey, CASE WHEN p_size <= 10 THEN 'SHORT' WHEN p_size <= 20 THEN 'MID' ELSE 'LONG' END AS bucket,
 CASE WHEN p_size BETWEEN 1 AND 5 THEN 'H01_05' WHEN p_size BETWEEN 6 AND 10 THEN 'H06_10' WHEN p_size BETWEEN 11 AND 20 THEN 'H11_20' WHEN p_size BETWEEN 21 AND 30 THEN 'H21_30' END AS band, p_size NOT BETWEEN 1 AND 30 AS out_of_band FROM part""")
def p2(r):
    from chronopanel.sources.scans import horizon_bucket
    s = F.col("p_size")
    band = F.when(s.between(1, 5), "H01_05").when(s.between(6, 10), "H06_10").when(s.between(11, 20), "H11_20").when(s.between(21, 30), "H21_30")
    return r.table("part").select("p_partkey", horizon_bucket("p_size").alias("bucket"), band.alias("band"), band.isNull().alias("out_of_band"))


@query("p3_plateau_ids", f"""
SELECT family_id, {PLATEAU} AS plateau_id FROM (SELECT family_id, CAST(substr(family_id, 2, 2) AS BIGINT) AS h, CAST(substr(family_id, 6, 2) AS BIGINT) AS d FROM x_fam) UNION ALL SELECT n_name, n_name FROM nation""")
def p3(r):
    ids = r.families().unionByName(r.table("nation").select(F.col("n_name").alias("family_id")))
    return ids.select("family_id", sf.plateau_of_family().alias("plateau_id"))


@query("p4_regime_masks", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN a IS NULL THEN 'TRANSITION' WHEN abs(a) < 0.01 AND abs(b) < 0.015 AND l_quantity < 30 THEN 'SIDEWAYS' WHEN a <= -0.02 AND b <= -0.01 THEN 'STRONG_BEAR' WHEN a >= 0.02 AND b >= 0.01 THEN 'STRONG_BULL' ELSE 'TRANSITION' END AS regime
FROM (SELECT *, CASE WHEN l_linenumber = 7 THEN NULL ELSE round(l_discount - 0.05, 6) END AS a, round(l_tax - 0.04, 6) AS b FROM lineitem)""")
def p4(r):
    from chronopanel.plans.market import regime_label
    a = F.when(F.col("l_linenumber") != 7, F.round(F.col("l_discount") - 0.05, 6))
    return r.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", regime_label(a, F.round(F.col("l_tax") - 0.04, 6), F.col("l_quantity"), 0.02, -0.02, 0.01, 30.0).alias("regime"))


@query("p5_activity_state", "SELECT family_id, arm, assessment_date, activity_state FROM x_fmp")
def p5(r):
    return r.family_panel().select("family_id", "arm", "assessment_date", "activity_state")


@query("p6_guarded_ratio", f"SELECT family_id, arm, assessment_date, CASE WHEN trade_count > 0 THEN {R('excess_1m / trade_count')} END AS excess_per_trade, CASE WHEN active_days > 0 THEN {R('excess_1m / active_days')} END AS excess_per_active_day FROM x_fmp")
def p6(r):
    ratio = lambda c: rnd(dm.guarded_ratio(F.col("excess_1m"), F.col(c).cast("double")))
    return r.family_panel().select("family_id", "arm", "assessment_date", ratio("trade_count").alias("excess_per_trade"), ratio("active_days").alias("excess_per_active_day"))


@query("p7_excess_forms", f"SELECT decision_date, ticker, {R('stock_return - bench_return')} AS excess, {R('(1 + stock_return) / (1 + bench_return) - 1')} AS relative_excess FROM x_outcomes")
def p7(r):
    s, b = F.col("stock_return"), F.col("bench_return")
    return r.outcomes().select("decision_date", "ticker", rnd(s - b).alias("excess"), rnd((1 + s) / (1 + b) - 1).alias("relative_excess"))


@query("p8_labels", "SELECT decision_date, ticker, (excess > 0.002)::INT AS positive_edge, (excess < -0.03)::INT AS downside FROM x_outcomes")
def p8(r):
    e = F.col("excess")
    return r.outcomes().select("decision_date", "ticker", (e > 0.002).cast("int").alias("positive_edge"), (e < -0.03).cast("int").alias("downside"))


@query("p9_annualized_return", f"""
WITH s AS (SELECT family_id, arm, arg_min(strategy_value, date) AS a, arg_max(strategy_value, date) AS b, date_diff('day', min(date), max(date)) AS days FROM x_nav GROUP BY 1, 2)
SELECT family_id, arm, {R('CASE WHEN a > 0 AND b > 0 THEN (b / a) ** (1 / greatest(days / 365.25, 1 / 365.25)) - 1 ELSE -1 END')} AS cagr FROM s""")
def p9(r):
    s = r.nav().groupBy("family_id", "arm").agg(F.min_by("strategy_value", "date").alias("a"), F.max_by("strategy_value", "date").alias("b"), F.datediff(F.max("date"), F.min("date")).alias("days"))
    return s.select("family_id", "arm", rnd(dm.annualized(F.col("a"), F.col("b"), F.col("days"))).alias("cagr"))


@query("p10_expense_multiplier", f"SELECT trade_id, {R("CASE WHEN trade_id % 2 = 0 THEN 1.0 ELSE 0.998 ** (date_diff('day', entry_date, exit_date) / 365.2425) END", 9)} AS multiplier FROM x_trades")
def p10(r):
    t = r.trades()
    return t.select("trade_id", rnd(dm.expense_multiplier(F.datediff("exit_date", "entry_date"), 0.002, F.col("trade_id") % 2 == 0), 9).alias("multiplier"))


@query("p11_venue_cost_bps", f"WITH {VENUE} SELECT decision_id, route_id, {R('cost', 4)} AS cost_bps FROM c")
def p11(r):
    return sel.venue_costs(venue_quotes(r)).select("decision_id", "route_id", rnd("cost", 4).alias("cost_bps"))


@query("p12_quote_validity", f"WITH {VENUE} SELECT decision_id, route_id, reason AS reject_reason FROM c")
def p12(r):
    return sel.venue_costs(venue_quotes(r)).select("decision_id", "route_id", "reject_reason")


@query("p13_benchmark_tax", f"SELECT trade_id, {R('greatest(0, 1000 * (1 + stock_return) - 1000 - 80) * 0.25 * 1.055')} AS tax FROM x_tr")
def p13(r):
    return r.trade_returns().select("trade_id", rnd(dm.benchmark_tax(F.lit(1000.0), 1000 * (1 + F.col("stock_return")), 80.0, 0.25, 0.055, 0.0)).alias("tax"))


@query("p14_cost_stress_grid", f"""
WITH t AS (SELECT arm, year(entry_date)::INT AS yr, sum(excess) AS gross, count(*) AS n, count(DISTINCT ticker) AS sw FROM x_tr GROUP BY 1, 2)
SELECT arm, yr, CAST(bps AS INT) AS bps, {R('gross - (n + sw) * bps / 10000.0', 5)} AS net_excess FROM t CROSS JOIN (SELECT unnest([0, 10, 20, 30, 50]) AS bps)""")
def p14(r):
    t = r.trade_returns().groupBy("arm", F.year("entry_date").alias("yr")).agg(F.sum("excess").alias("g"), F.count(F.lit(1)).alias("n"), F.countDistinct("ticker").alias("sw"))
    grid = t.withColumn("bps", F.explode(F.array(*[F.lit(b) for b in (0, 10, 20, 30, 50)])))
    return grid.select("arm", "yr", "bps", rnd(F.col("g") - (F.col("n") + F.col("sw")) * F.col("bps") / 10000.0, 5).alias("net_excess"))


@query("p15_deflated_sharpe", f"SELECT h, {R('avg(cagr_excess) / stddev_samp(cagr_excess) - sqrt(2 * ln(count(DISTINCT treatment || d))) / sqrt(count(*))')} AS deflated_sharpe FROM x_surf GROUP BY 1")
def p15(r):
    g = r.surface().groupBy("h").agg((F.avg("cagr_excess") / F.stddev_samp("cagr_excess")).alias("s"), F.countDistinct("treatment", "d").alias("a"), F.count(F.lit(1)).alias("n"))
    return g.select("h", rnd(dm.deflated_sharpe(F.col("s"), F.col("a"), F.col("n"))).alias("deflated_sharpe"))


Z = "1.959963984540054"


@query("p16_wilson_and_sign_test", f"""
WITH g AS (SELECT h, d, count(*) AS n, count(*) FILTER (cagr_excess > 0) AS k FROM x_surf GROUP BY 1, 2), p AS (SELECT *, k / n AS p FROM g),
w AS (SELECT *, (p + {Z} * {Z} / (2 * n)) / (1 + {Z} * {Z} / n) AS c, {Z} * sqrt((p * (1 - p) + {Z} * {Z} / (4 * n)) / n) / (1 + {Z} * {Z} / n) AS rad FROM p)
SELECT h, d, n, k, {R('greatest(0, c - rad)')} AS wilson_low, {R('least(1, c + rad)')} AS wilson_high,
 {R("list_sum(list_transform(range(k, n + 1), lambda j: factorial(CAST(n AS INT))::DOUBLE / (factorial(CAST(j AS INT))::DOUBLE * factorial(CAST(n - j AS INT))::DOUBLE))) / 2 ** n")} AS sign_p FROM w""")
def p16(r):
    g = r.surface().groupBy("h", "d").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("cagr_excess") > 0).alias("k"))
    low, high = wilson(F.col("k"), F.col("n"))
    return g.select("h", "d", "n", "k", rnd(low).alias("wilson_low"), rnd(high).alias("wilson_high"), rnd(sign_test(F.col("k"), F.col("n"))).alias("sign_p"))


@query("p17_canonical_identity", """
SELECT o_orderkey, substr(sha256('{"customer":"' || o_custkey || '","priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}'), 1, 16) AS identity FROM orders""")
def p17(r):
    return r.table("orders").select("o_orderkey", dm.canonical_identity({"status": F.col("o_orderstatus"), "customer": F.col("o_custkey"), "priority": F.col("o_orderpriority")}, 16).alias("identity"))


@query("p18_event_key", "SELECT strftime(decision_date, '%Y-%m-%d') || '|' || ticker || '|' || family_id || '|' || model_id AS event_key, count(*) AS n FROM x_ord GROUP BY 1")
def p18(r):
    key = F.concat_ws("|", F.date_format("decision_date", "yyyy-MM-dd"), "ticker", "family_id", "model_id")
    return r.order_signals().groupBy(key.alias("event_key")).agg(F.count(F.lit(1)).alias("n"))


WIDE = """w AS (SELECT decision_date, ticker, arm, max(score) FILTER (h_bucket = 'SHORT') AS s, max(score) FILTER (h_bucket = 'MID') AS m, max(score) FILTER (h_bucket = 'LONG') AS l, count(*) AS n FROM x_sets GROUP BY 1, 2, 3)"""


def wide_sets(r):
    x = r.sets().groupBy("decision_date", "ticker", "arm").pivot("h_bucket", ["SHORT", "MID", "LONG"]).agg(F.max("score"))
    return x.withColumnsRenamed({"SHORT": "s", "MID": "m", "LONG": "l"})


@query("p19_set_combination", f"""
WITH {WIDE} SELECT decision_date, ticker, arm, concat_ws('_', CASE WHEN s IS NOT NULL THEN 'SHORT' END, CASE WHEN m IS NOT NULL THEN 'MID' END, CASE WHEN l IS NOT NULL THEN 'LONG' END) AS combination,
 CASE n WHEN 1 THEN 'S1_SINGLE_BUCKET' WHEN 2 THEN 'S2_TWO_BUCKETS' ELSE 'S3_THREE_BUCKETS' END AS set_type FROM w""")
def p19(r):
    c = {"SHORT": F.col("s").isNotNull(), "MID": F.col("m").isNotNull(), "LONG": F.col("l").isNotNull()}
    n = sum(x.cast("int") for x in c.values())
    return wide_sets(r).select("decision_date", "ticker", "arm", dm.bucket_combination(c).alias("combination"), dm.set_type(n).alias("set_type"))


@query("p20_bucket_agreement", f"""
WITH {WIDE} SELECT decision_date, ticker, arm, CASE WHEN s IS NOT NULL AND m IS NOT NULL THEN (sign(s) = sign(m))::INT::DOUBLE END AS short_mid_agreement, {R('s - l')} AS short_minus_long,
 {R('list_stddev_samp(list_filter([s, m, l], lambda x: x IS NOT NULL))')} AS score_std, {R('greatest(s, m, l) - least(s, m, l)')} AS score_range FROM w""")
def p20(r):
    s, m, l = F.col("s"), F.col("m"), F.col("l")
    return wide_sets(r).select("decision_date", "ticker", "arm", dm.sign_agreement(s, m).alias("short_mid_agreement"), rnd(s - l).alias("short_minus_long"),
                               rnd(dm.nan_std([s, m, l])).alias("score_std"), rnd(F.greatest(s, m, l) - F.least(s, m, l)).alias("score_range"))


@query("p21_bucket_slope", f"""
SELECT decision_date, ticker, arm, CASE WHEN count(*) >= 2 THEN {R("regr_slope(score, CASE h_bucket WHEN 'SHORT' THEN 5 WHEN 'MID' THEN 15 ELSE 25 END)")} END AS slope FROM x_sets GROUP BY 1, 2, 3""")
def p21(r):
    return wide_sets(r).select("decision_date", "ticker", "arm", rnd(dm.row_slope({5: F.col("s"), 15: F.col("m"), 25: F.col("l")})).alias("slope"))


@query("p22_winsorize", f"SELECT decision_date, ticker, {R('greatest(least(excess, 0.2), -0.2)')} AS clipped FROM x_outcomes")
def p22(r):
    return r.outcomes().select("decision_date", "ticker", rnd(F.greatest(F.least("excess", F.lit(0.2)), F.lit(-0.2))).alias("clipped"))


@query("p23_shrinkage", f"""
WITH g AS (SELECT avg(excess) AS g FROM x_tr), t AS (SELECT ticker, CASE WHEN count(*) >= 3 THEN avg(excess) END AS l, count(*) AS n FROM x_tr GROUP BY 1)
SELECT ticker, {R('CASE WHEN l IS NULL THEN g ELSE n / (n + 20.0) * l + (1 - n / (n + 20.0)) * g END')} AS shrunk FROM t, g""")
def p23(r):
    tr = r.trade_returns()
    t = tr.groupBy("ticker").agg(F.avg("excess").alias("a"), F.count(F.lit(1)).alias("n")).withColumn("g", tr.agg(F.avg("excess")).scalar())
    return t.select("ticker", rnd(dm.shrink(F.when(F.col("n") >= 3, F.col("a")), F.col("g"), F.col("n"), 20.0)).alias("shrunk"))


@query("p24_zero_activity", f"""
WITH a AS (SELECT family_id, arm, assessment_date, {R('((1 + observed_days) / (1.0 + observed_days + 4)) ** (1 + trade_count)')} AS p FROM x_act)
SELECT family_id, arm, assessment_date, p, CASE WHEN p >= 0.25 THEN 'NORMAL' WHEN p >= 0.05 THEN 'WATCH' WHEN p >= 0.01 THEN 'ANOMALOUS' ELSE 'CRITICAL' END AS level FROM a""")
def p24(r):
    p = rnd(dm.zero_probability(1.0 + F.col("trade_count"), 1.0 + F.col("observed_days"), F.lit(4.0)))
    return r.activity().select("family_id", "arm", "assessment_date", p.alias("p"), dm.activity_level(p).alias("level"))


@query("p25_kill_switches", """
WITH k AS (SELECT family_id, arm, assessment_date, rel <= 0 AS structural, active_days = 0 AS activity, coalesce(trailing_3m < -0.02, false) AS alpha, coalesce(excess_1m < -0.015, false) AS regime FROM x_fmp)
SELECT *, CASE WHEN structural THEN 'STRUCTURAL_FAILURE' WHEN activity THEN 'ACTIVITY_ANOMALY' WHEN alpha THEN 'NEGATIVE_NET_ALPHA' WHEN regime THEN 'REGIME_DECAY' END AS reason FROM k""")
def p25(r):
    flags = {"structural": F.col("rel") <= 0, "activity": F.col("active_days") == 0, "alpha": F.coalesce(F.col("trailing_3m") < -0.02, F.lit(False)), "regime": F.coalesce(F.col("excess_1m") < -0.015, F.lit(False))}
    names = {"structural": "STRUCTURAL_FAILURE", "activity": "ACTIVITY_ANOMALY", "alpha": "NEGATIVE_NET_ALPHA", "regime": "REGIME_DECAY"}
    reason = F.coalesce(*[F.when(flags[k], F.lit(v)) for k, v in names.items()])
    return r.family_panel().select("family_id", "arm", "assessment_date", *[c.alias(k) for k, c in flags.items()], reason.alias("reason"))


@query("p26_stability_class", f"""
WITH m AS (SELECT family_id, arm, {R("avg(excess_1m) FILTER (assessment_date < DATE '1997-01-01')")} AS b, {R("avg(excess_1m) FILTER (assessment_date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31')")} AS k,
  {R("avg(excess_1m) FILTER (assessment_date > DATE '1999-12-31')")} AS f FROM x_fmp GROUP BY 1, 2)
SELECT family_id, arm, CASE WHEN k <= 0 THEN 'UNCLASSIFIED' WHEN b > 0 AND f > 0 AND least(b / k, f / k) >= 0.5 THEN 'STABLE' WHEN b > 0 AND f > 0 AND least(b / k, f / k) >= 0.25 THEN 'DECAY' ELSE 'COLLAPSE' END AS status FROM m""")
def p26(r):
    d, lo, hi = F.col("assessment_date"), F.to_date(F.lit("1997-01-01")), F.to_date(F.lit("1999-12-31"))
    mean = lambda c: rnd(F.avg(F.when(c, F.col("excess_1m"))))
    m = r.family_panel().groupBy("family_id", "arm").agg(mean(d < lo).alias("b"), mean(d.between(lo, hi)).alias("k"), mean(d > hi).alias("f"))
    return m.select("family_id", "arm", dm.stability_class(F.col("k"), F.col("b"), F.col("f"), F.lit(1), F.lit(1)).alias("status"))


@query("p27_threshold_verdict", """
WITH d AS (SELECT CAST(date_trunc('quarter', decision_date) AS DATE) AS q, count(DISTINCT decision_date) AS days, count(*) FILTER (score < 0.9) AS shadow, avg((score >= 0.9)::INT) AS rate, avg(excess) FILTER (score < 0.9) AS sm FROM x_panel GROUP BY 1)
SELECT q AS period, CASE WHEN days < 10 OR shadow < 5 THEN 'INSUFFICIENT_EVIDENCE' WHEN NOT rate < greatest(0.005, 0.25 * 0.4) THEN 'NO_RESTRICTION_EVIDENCE' WHEN sm > 0 THEN 'TOO_RESTRICTIVE' ELSE 'RARE_SIGNAL' END AS verdict FROM d""")
def p27(r):
    from chronopanel.operators.gates import threshold_verdict
    hot = F.col("score") >= 0.9
    d = r.panel().groupBy(F.trunc("decision_date", "quarter").alias("period")).agg(
        F.countDistinct("decision_date").alias("days"), F.count_if(~hot).alias("k"), share(hot).alias("rate"), F.avg(F.when(~hot, F.col("excess"))).alias("sm"))
    return d.select("period", threshold_verdict(F.col("days"), F.col("k"), F.col("rate"), F.col("sm"), historical_rate=0.4, min_days=10, min_shadow=5).alias("verdict"))


@query("p28_event_diagnosis", f"""
WITH m AS (SELECT family_id, arm, yr, {R('rr - lag(rr) OVER w')} AS dr, {R('dd - lag(dd) OVER w')} AS dk FROM (SELECT family_id, arm, year(assessment_date)::INT AS yr, avg(excess_1m) AS rr, min(excess_1m) AS dd FROM x_fmp GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY family_id, arm ORDER BY yr))
SELECT *, CASE WHEN dr > 0 AND dk >= 0 THEN 'RETURN_AND_RISK_HELPFUL' WHEN dr > 0 THEN 'RETURN_HELPFUL_RISK_WORSE' WHEN dk >= 0 THEN 'RETURN_WORSE_RISK_HELPFUL' ELSE 'RETURN_AND_RISK_HARMFUL' END AS diagnosis FROM m""")
def p28(r):
    from pyspark.sql import Window
    w = Window.partitionBy("family_id", "arm").orderBy("yr")
    m = r.family_panel().groupBy("family_id", "arm", F.year("assessment_date").alias("yr")).agg(F.avg("excess_1m").alias("rr"), F.min("excess_1m").alias("dd"))
    m = m.select("family_id", "arm", "yr", rnd(F.col("rr") - F.lag("rr").over(w)).alias("dr"), rnd(F.col("dd") - F.lag("dd").over(w)).alias("dk"))
    return m.withColumn("diagnosis", dm.event_diagnosis(F.col("dr"), F.col("dk")))


@query("p29_ablation_masks", f"""
WITH m AS (SELECT *, CAST(substr(family_id, 2, 2) AS INT) AS h, CAST(substr(family_id, 6, 2) AS INT) AS d, median(metric) OVER () AS med, (SELECT count(DISTINCT arm) FROM x_famy z WHERE z.family_id = x_famy.family_id AND z.yr = x_famy.yr) AS arms FROM x_famy),
x AS (SELECT *, unnest(['A_FULL'] || CASE WHEN h <> 30 THEN ['B_REMOVE_H30'] ELSE [] END || CASE WHEN h < 28 THEN ['C_REMOVE_H28_30'] ELSE [] END || CASE WHEN NOT (h >= 25 AND d >= 25) THEN ['D_REMOVE_LONG'] ELSE [] END
  || CASE WHEN metric >= med THEN ['G_HIGH'] ELSE [] END || CASE WHEN arms >= 2 THEN ['E_MULTI_ARM'] ELSE [] END) AS mask FROM m)
SELECT mask, count(*) AS n_rows, {R('avg(metric)')} AS mean_metric FROM x GROUP BY 1""")
def p29(r):
    from chronopanel.operators.ordered import quantiles
    x = r.family_years()
    arms = x.groupBy("family_id", "yr").agg(F.countDistinct("arm").alias("arms"))
    med = quantiles(x, [], "metric", {"m": 0.5})
    x = x.join(arms, ["family_id", "yr"]).withColumns({"h": F.regexp_extract("family_id", r"^H(\d{2})", 1).cast("int"), "d": F.regexp_extract("family_id", r"_D(\d{2})", 1).cast("int")}).withColumn("med", med.scalar())
    masks = {"A_FULL": F.lit(True), "B_REMOVE_H30": F.col("h") != 30, "C_REMOVE_H28_30": F.col("h") < 28, "D_REMOVE_LONG": ~((F.col("h") >= 25) & (F.col("d") >= 25)),
             "G_HIGH": F.col("metric") >= F.col("med"), "E_MULTI_ARM": F.col("arms") >= 2}
    return sel.masked(x, masks, "mask").groupBy("mask").agg(F.count(F.lit(1)).alias("n_rows"), rnd(F.avg("metric")).alias("mean_metric"))


@query("p30_path_identity", """
WITH t AS (SELECT arm, year(entry_date)::INT AS yr, entry_date AS d, sha256(ticker || '|' || exit_date || '|' || trade_id) AS h FROM x_trades), sub AS (SELECT arm, yr, d, substr(h, 1, 4) AS pre, sha256(string_agg(h, '' ORDER BY h)) AS s FROM t GROUP BY 1, 2, 3, 4),
dd AS (SELECT arm, yr, d, sha256(string_agg(pre || s, '' ORDER BY pre)) AS digest FROM sub GROUP BY 1, 2, 3) SELECT arm, yr, sha256(string_agg(strftime(d, '%Y-%m-%d') || digest, '' ORDER BY d)) AS path_id FROM dd GROUP BY 1, 2""")
def p30(r):
    from chronopanel.operators.audits import list_identity
    cols = [F.col(c).cast("string") for c in ("ticker", "exit_date", "trade_id")]
    return list_identity(r.trades().withColumn("yr", F.year("entry_date")), ["arm", "yr"], "entry_date", cols)


@query("p31_robust_score", f"SELECT family_id, arm, {R('median(excess_1m) + 0.5 * avg(excess_1m) - 0.5 * stddev_pop(excess_1m) - 0.02 * avg((excess_1m <= 0)::INT)')} AS robust_score FROM x_fmp GROUP BY 1, 2")
def p31(r):
    from chronopanel.functions.stats import robust_score
    return r.family_panel().groupBy("family_id", "arm").agg(rnd(robust_score("excess_1m")).alias("robust_score"))


@query("p32_infinity_cleansing", f"""
WITH x AS (SELECT l_linenumber, CASE WHEN l_tax = 0 THEN NULL ELSE l_discount / l_tax END AS v FROM lineitem) SELECT l_linenumber, count(*) AS n_rows, count(v) AS finite_rows, {R('avg(v)')} AS mean_ratio FROM x GROUP BY 1""")
def p32(r):
    raw = F.when(F.col("l_tax") == 0, F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(float("inf"))).otherwise(F.try_divide(F.col("l_discount"), F.col("l_tax")))
    return r.table("lineitem").withColumn("v", clean(raw)).groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n_rows"), F.count("v").alias("finite_rows"), rnd(F.avg("v")).alias("mean_ratio"))


@query("p33_treatment_parser", """
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'EQUAL_ACTIVE' WHEN 1 THEN 'RANK_POWER' WHEN 2 THEN 'SCORE_SOFTMAX' END AS family, CASE o_orderkey % 5 WHEN 1 THEN (1 + o_orderkey % 3)::DOUBLE WHEN 2 THEN 0.5::DOUBLE END AS strength FROM orders""")
def p33(r):
    k = F.col("o_orderkey")
    raw = (F.when(k % 5 == 0, "equal_active").when(k % 5 == 1, F.concat(F.lit(" RANK_POWER:"), 1 + k % 3)).when(k % 5 == 2, "score_softmax:0.5")
           .when(k % 5 == 3, "EQUAL_ACTIVE:2").otherwise("UNKNOWN:1"))
    return r.table("orders").select("o_orderkey", dm.treatment_spec(raw).alias("s")).select("o_orderkey", "s.family", "s.strength")


@query("p34_pareto_diagnosis", f"""
WITH a AS (SELECT h, d, treatment, {R('avg(cagr_excess)')} AS r, {R('min(cagr_excess)')} AS k FROM x_surf GROUP BY 1, 2, 3)
SELECT a.h, a.d, CASE WHEN abs(b.r - a.r) <= 1e-9 AND abs(b.k - a.k) <= 1e-9 THEN 'MATCH' WHEN b.r > a.r AND b.k > a.k THEN 'IMPROVES' WHEN b.r < a.r AND b.k < a.k THEN 'WORSENS' ELSE 'TRADEOFF' END AS verdict
FROM a JOIN a b ON a.h = b.h AND a.d = b.d AND a.treatment = 'A' AND b.treatment = 'R'""")
def p34(r):
    g = r.surface().groupBy("h", "d", "treatment").agg(rnd(F.avg("cagr_excess")).alias("r"), rnd(F.min("cagr_excess")).alias("k"))
    w = g.groupBy("h", "d").pivot("treatment", ["A", "R"]).agg(F.max("r").alias("r"), F.max("k").alias("k")).na.drop()
    return w.select("h", "d", dm.pareto(F.col("A_r"), F.col("R_r"), F.col("A_k"), F.col("R_k")).alias("verdict"))
