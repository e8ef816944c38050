"""Selector pools, choices, readiness, candidate sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronopanel.catalog.aggregates import AVG_RANK, REG, ROBUST, regimes
from chronopanel.catalog.registry import R, query
from chronopanel.functions.rounding import rnd
from chronopanel.functions.stats import median, share
from chronopanel.operators import consensus as cs
from chronopanel.operators import gates
from chronopanel.operators import ordered as od
from chronopanel.operators import selection as sel
from chronopanel.operators.joins import bucket_pairs

KEYS = ["decision_date", "ticker", "arm"]
CAND = "cd AS (SELECT *, score AS s_score, n_events / 10.0 - score AS s_depth, score * n_families AS s_breadth FROM x_sets)"
BO = "CASE h_bucket WHEN 'SHORT' THEN -1 WHEN 'MID' THEN -2 ELSE -3 END"
CHOICE = f"""{CAND},
ch AS (SELECT decision_date, ticker, arm, count(*) AS candidates, arg_max(h_bucket, (round(realized, 9), {BO})) AS oracle, max(realized) AS oracle_realized, avg(realized) AS equal_realized,
  arg_max(h_bucket, (round(s_score, 9), {BO})) AS c1, arg_max(realized, (round(s_score, 9), {BO})) AS r1, arg_max(h_bucket, (round(s_depth, 9), {BO})) AS c2, arg_max(realized, (round(s_depth, 9), {BO})) AS r2,
  arg_max(h_bucket, (round(s_breadth, 9), {BO})) AS c3, arg_max(realized, (round(s_breadth, 9), {BO})) AS r3 FROM cd GROUP BY 1, 2, 3 HAVING count(*) >= 2),
rows AS (SELECT decision_date, ticker, arm, candidates, pool, choice, realized, oracle, oracle_realized, equal_realized, oracle_realized - realized AS regret, choice <> c1 AS override, r1 AS base FROM
  (SELECT *, 'SCORE' AS pool, c1 AS choice, r1 AS realized FROM ch UNION ALL SELECT *, 'DEPTH', c2, r2 FROM ch UNION ALL SELECT *, 'BREADTH', c3, r3 FROM ch))"""


def choices(r):
    cd = r.sets().withColumns({"s_score": F.col("score"), "s_depth": F.col("n_events") / 10.0 - F.col("score"), "s_breadth": F.col("score") * F.col("n_families")})
    return cs.choice_rows(cd, KEYS, {"SCORE": "s_score", "DEPTH": "s_depth", "BREADTH": "s_breadth"})


@query("a31_pool_metrics", f"""
WITH {CHOICE} SELECT pool, count(*) AS sets, {R('avg(realized)')} AS mean_excess, {R('avg(regret)')} AS mean_regret, {R('avg((choice = oracle)::INT)')} AS oracle_hit_rate, count(*) FILTER (override) AS overrides,
 {R('avg((realized > base)::INT) FILTER (override)')} AS override_hit_rate, {R('avg(realized - base)')} AS delta_vs_base FROM rows GROUP BY 1""")
def a31(r):
    return cs.pool_metrics(choices(r), "SCORE")


@query("a32_pool_matrix", f"""
WITH {CHOICE} SELECT a.pool AS pool_a, b.pool AS pool_b, count(*) AS sets, {R('avg(a.realized - b.realized)')} AS mean_diff, {R('avg((a.realized - b.realized > 0)::INT)')} AS win_rate,
 {R('avg((a.choice <> b.choice)::INT)')} AS disagreement, {R('avg((a.choice = b.choice)::INT)')} AS agreement
FROM rows a JOIN rows b USING (decision_date, ticker, arm) WHERE (a.pool, b.pool) IN (('SCORE', 'DEPTH'), ('SCORE', 'BREADTH'), ('DEPTH', 'BREADTH')) GROUP BY 1, 2""")
def a32(r):
    return cs.pool_matrix(choices(r), KEYS, ["SCORE", "DEPTH", "BREADTH"])


@query("a33_contributions", f"""
WITH {CHOICE}, t AS (SELECT pool, ticker, sum(realized) AS c, count(*) AS n FROM rows GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY round(c, 9) DESC, ticker) AS rn, sum(greatest(c, 0)) OVER (PARTITION BY pool) AS p FROM t)
SELECT pool, count(*) AS tickers, CAST(sum(n) AS BIGINT) AS sets, {R('sum(c)')} AS total, {R('sum(greatest(c, 0)) FILTER (rn = 1) / any_value(p)')} AS top1_share, {R('sum(greatest(c, 0)) FILTER (rn <= 3) / any_value(p)')} AS top3_share FROM k GROUP BY 1""")
def a33(r):
    return sel.contributions(choices(r), "pool", "ticker", "realized")


@query("a34_set_type_robustness", f"""
WITH {CHOICE}, x AS (SELECT *, unnest(['ALL'] || CASE WHEN candidates = 2 THEN ['TWO_BUCKETS'] ELSE ['THREE_BUCKETS'] END || CASE WHEN arm = 'F' THEN ['ARM_F'] ELSE ['ARM_O'] END || CASE WHEN decision_date < DATE '1998-07-01' THEN ['EARLY'] ELSE ['LATE'] END) AS subset FROM rows)
SELECT subset, pool, count(*) AS sets, {R('avg(realized)')} AS mean_excess, {R('avg(regret)')} AS mean_regret FROM x GROUP BY 1, 2""")
def a34(r):
    early = F.col("decision_date") < F.to_date(F.lit("1998-07-01"))
    masks = {"ALL": F.lit(True), "TWO_BUCKETS": F.col("candidates") == 2, "THREE_BUCKETS": F.col("candidates") == 3, "ARM_F": F.col("arm") == "F",
             "ARM_O": F.col("arm") == "O", "EARLY": early, "LATE": ~early}
    return sel.masked(choices(r), masks, "subset").groupBy("subset", "pool").agg(
        F.count(F.lit(1)).alias("sets"), rnd(F.avg("realized")).alias("mean_excess"), rnd(F.avg("regret")).alias("mean_regret"))


@query("a41_incremental_metrics", f"""
WITH m AS (SELECT CAST(date_trunc('quarter', decision_date) AS DATE) AS q, score AS a, score * 0.5 + (ticker % 7) * 0.03 AS b, excess AS y FROM x_panel),
k AS (SELECT *, {AVG_RANK.format(p='q', x='a')} AS ra, {AVG_RANK.format(p='q', x='b')} AS rb, {AVG_RANK.format(p='q', x='y')} AS ry, quantile_cont(a, 0.75) OVER (PARTITION BY q) AS ca, quantile_cont(b, 0.75) OVER (PARTITION BY q) AS cb FROM m)
SELECT q AS period, count(*) AS n_rows, {R('corr(ra, ry)')} AS rank_ic_a, {R('corr(rb, ry)')} AS rank_ic_b, {R('corr(ra, ry) - corr(rb, ry)')} AS incremental_rank_ic,
 {R('avg(y) FILTER (a >= ca) - avg(y) FILTER (a < ca)')} AS spread_a, {R('avg(y) FILTER (b >= cb) - avg(y) FILTER (b < cb)')} AS spread_b, {R('corr(a, b)')} AS prediction_corr FROM k GROUP BY 1""")
def a41(r):
    from chronopanel.session import stage
    m = r.panel().select(F.trunc("decision_date", "quarter").alias("period"), F.col("score").alias("a"),
                         (F.col("score") * 0.5 + (F.col("ticker") % 7) * 0.03).alias("b"), F.col("excess").alias("y"))
    return sel.incremental_metrics(stage(m, "pred"), ["period"], "a", "b", "y")


RULES = f"""
x AS (SELECT *, quantile_cont(score, 0.75) OVER (PARTITION BY decision_date) AS cut FROM x_panel),
d AS (SELECT decision_date, count(*) AS n, avg(excess) AS e, arg_max(excess, (score, -ticker)) AS w, arg_max(ticker, (score, -ticker))::VARCHAR AS wk, avg(excess) FILTER (score >= cut) AS t,
      string_agg(CASE WHEN score >= cut THEN ticker::VARCHAR END, ',' ORDER BY ticker) AS tk, max(excess) AS o FROM x GROUP BY 1 HAVING count(*) >= 4),
l AS (SELECT decision_date, 'EQUAL' AS rule, e AS r, 'ALL' AS key FROM d UNION ALL SELECT decision_date, 'WINNER', w, wk FROM d UNION ALL SELECT decision_date, 'TOP_QUARTILE', t, tk FROM d UNION ALL SELECT decision_date, 'ORACLE', o, 'ORACLE' FROM d),
s AS (SELECT *, (lag(key) OVER (PARTITION BY rule ORDER BY decision_date) IS NULL OR lag(key) OVER (PARTITION BY rule ORDER BY decision_date) <> key)::INT AS sw FROM l),
c AS (SELECT s.*, cost, r - sw * cost / 10000.0 AS net FROM s CROSS JOIN (SELECT unnest([0, 10, 20, 30]) AS cost)),
p AS (SELECT *, exp(sum(ln(1 + net)) OVER (PARTITION BY rule, cost ORDER BY decision_date)) AS wealth FROM c),
q AS (SELECT *, wealth / max(wealth) OVER (PARTITION BY rule, cost ORDER BY decision_date) - 1 AS dd FROM p)"""


@query("a42_selector_rules", f"""
WITH {RULES} SELECT rule, CAST(cost AS INT) AS cost_bps, count(*) AS observations, CAST(sum(sw) AS BIGINT) AS switches, {R('avg(net)')} AS mean_net, {R('exp(avg(ln(1 + net)) * 12) - 1')} AS cagr,
 {R('min(dd)')} AS max_drawdown, {R('coalesce(avg(net) / stddev_pop(net) * sqrt(12), 0)')} AS sharpe FROM q GROUP BY 1, 2""")
def a42(r):
    from chronopanel.session import stage
    panel = stage(r.panel(), "panel")
    cut = od.quantiles(panel, ["decision_date"], "score", {"cut": 0.75})
    return cs.rule_path_summary(cs.daily_selector_rules(panel, cut), [0, 10, 20, 30], 12)


@query("a43_selection_pairs", f"""
WITH {CHOICE}, pr AS (SELECT a.decision_date, a.ticker, a.arm, CASE WHEN a.realized <> b.realized THEN (sign(a.score - b.score) = sign(a.realized - b.realized))::INT END AS ok
  FROM x_sets a JOIN x_sets b USING (decision_date, ticker, arm) WHERE CASE a.h_bucket WHEN 'SHORT' THEN 1 WHEN 'MID' THEN 2 ELSE 3 END < CASE b.h_bucket WHEN 'SHORT' THEN 1 WHEN 'MID' THEN 2 ELSE 3 END),
pa AS (SELECT decision_date, ticker, arm, count(ok) AS pairs, avg(ok) AS accuracy FROM pr GROUP BY 1, 2, 3)
SELECT a.decision_date, a.ticker, a.arm, a.choice AS t2_choice, b.choice AS t3_choice, {R('b.realized - a.realized')} AS t3_minus_t2, {R('a.regret')} AS t2_regret, {R('b.regret')} AS t3_regret, pairs, {R('accuracy')} AS accuracy
FROM rows a JOIN rows b USING (decision_date, ticker, arm) JOIN pa USING (decision_date, ticker, arm) WHERE a.pool = 'SCORE' AND b.pool = 'BREADTH'""")
def a43(r):
    ch = choices(r)
    return sel.selection_pairs(ch, cs.pairwise_accuracy(bucket_pairs(r.sets(), KEYS), KEYS), KEYS, "SCORE", "BREADTH")


@query("a44_choice_rows", f"WITH {CHOICE} SELECT decision_date, ticker, arm, candidates, pool, choice, {R('realized')} AS realized, oracle, {R('oracle_realized')} AS oracle_realized, {R('equal_realized')} AS equal_realized, {R('regret')} AS regret, override FROM rows")
def a44(r):
    return choices(r).withColumns({c: rnd(c) for c in ("realized", "oracle_realized", "equal_realized", "regret")})


@query("a45_below_median_share", f"""
WITH m AS (SELECT h, treatment, avg(cagr_excess) / stddev_pop(cagr_excess) AS s FROM x_surf GROUP BY 1, 2), k AS (SELECT h, list_sort(list(s)) AS l FROM m GROUP BY 1)
SELECT h, {R('len(list_filter(l, lambda x: x < l[1 + len(l) // 2])) / len(l)')} AS pbo FROM k""")
def a45(r):
    m = r.surface().groupBy("h", "treatment").agg((F.avg("cagr_excess") / F.stddev_pop("cagr_excess")).alias("s"))
    return sel.below_median_share(m, ["h"], "s")


@query("a46_context_matrix", f"""
WITH {REG}, f AS (SELECT DISTINCT year(date)::INT AS yr FROM x_bret), d AS (SELECT f.yr, mode(regime ORDER BY regime) AS context FROM f JOIN (SELECT year(date) AS y, regime, count(*) AS n FROM reg GROUP BY 1, 2) g ON g.y < f.yr JOIN reg ON year(reg.date) = g.y AND reg.regime = g.regime GROUP BY 1),
cnt AS (SELECT f.yr, reg.regime, count(*) AS n FROM f JOIN reg ON year(reg.date) < f.yr GROUP BY 1, 2), ctx AS (SELECT yr, regime AS context FROM (SELECT *, row_number() OVER (PARTITION BY yr ORDER BY n DESC, regime) AS rn FROM cnt) WHERE rn = 1)
SELECT c.yr, c.context, reg.regime, count(*) AS sessions, {R('product(1 + r) - 1')} AS r, {R('product(1 + br) - 1')} AS br
FROM (SELECT date, avg(r) AS r FROM x_ret GROUP BY 1) n JOIN reg USING (date) JOIN ctx c ON c.yr = year(date) GROUP BY 1, 2, 3""")
def a46(r):
    from chronopanel.session import stage
    day = stage(r.returns().groupBy("date").agg(F.avg("r").alias("r")).join(regimes(r), "date"), "regime-days")
    return sel.context_matrix(day, ["UP", "FLAT", "DOWN"])


@query("a47_readiness_gates", f"""
WITH f AS (SELECT fold, avg(cagr_excess) AS m, sum(trade_count) AS t FROM x_surf GROUP BY 1)
SELECT * FROM (SELECT 'enough_folds' AS gate, count(*) >= 5 AS passed FROM f UNION ALL SELECT 'all_folds_active', bool_and(t > 0) FROM f UNION ALL SELECT 'median_positive', median(m) > 0 FROM f
 UNION ALL SELECT 'no_open_schedule_gap', (SELECT max(activation_date - p) FROM (SELECT activation_date, lag(activation_date) OVER (PARTITION BY family_id ORDER BY activation_date) AS p FROM x_sched)) <= 62
 UNION ALL SELECT 'trades_cover_all_arms', (SELECT count(DISTINCT arm) FROM x_trades) = 2)""")
def a47(r):
    folds = r.surface().groupBy("fold").agg(F.avg("cagr_excess").alias("m"), F.sum("trade_count").alias("t"))
    gap = r.schedule().withColumn("g", F.datediff("activation_date", F.lag("activation_date").over(Window.partitionBy("family_id").orderBy("activation_date"))))
    return sel.readiness_gates([
        folds.agg((F.count(F.lit(1)) >= 5).alias("enough_folds"), F.bool_and(F.col("t") > 0).alias("all_folds_active"), (median("m") > 0).alias("median_positive")),
        gap.agg((F.max("g") <= 62).alias("no_open_schedule_gap")), r.trades().agg((F.countDistinct("arm") == 2).alias("trades_cover_all_arms"))])


HEALTH = """hl AS (SELECT family_id, assessment_date, count(excess_1m) OVER w AS n, avg(excess_1m) OVER w AS m, stddev_samp(excess_1m) OVER w AS sd, sum(trade_count) OVER w AS trades
 FROM x_fmp WHERE arm = 'F' WINDOW w AS (PARTITION BY family_id ORDER BY assessment_date))"""


def health(r, arm="F"):
    w = Window.partitionBy("family_id").orderBy("assessment_date")
    p = r.family_panel().where(F.col("arm") == arm)
    return p.select("family_id", "assessment_date", F.count("excess_1m").over(w).alias("n"), F.avg("excess_1m").over(w).alias("m"),
                    F.stddev_samp("excess_1m").over(w).alias("sd"), F.sum("trade_count").over(w).alias("trades"))


@query("a48_candidate_set", f"""
WITH {HEALTH}, l AS (SELECT *, round(m - 1.96 * sd / sqrt(n), 9) AS lcb FROM hl), e AS (SELECT *, CASE WHEN n < 12 THEN 'INSUFFICIENT_EVIDENCE' WHEN lcb IS NULL OR lcb <= -0.02 THEN 'NEGATIVE_LCB' END AS reason FROM l),
b AS (SELECT *, max(CASE WHEN reason IS NULL THEN lcb END) OVER (PARTITION BY assessment_date) AS best FROM e)
SELECT assessment_date, family_id, reason, {R('lcb')} AS lcb, reason IS NULL AND lcb >= best - 0.005 AS member FROM b""")
def a48(r):
    h = health(r).withColumn("lcb", F.round(F.col("m") - 1.96 * F.col("sd") / F.sqrt(F.nullif(F.col("n").cast("double"), F.lit(0.0))), 9))
    return sel.candidate_set(h, "assessment_date", min_n=12, floor=-0.02, margin=0.005).select("assessment_date", "family_id", "reason", rnd("lcb").alias("lcb"), "member")


@query("a49_oracle_and_false_discovery", f"""
WITH t AS (SELECT arm, family_id, sum(excess_1m) AS s FROM x_fmp GROUP BY 1, 2), p AS (SELECT arm, family_id, avg(fwd_1m) FILTER (excess_1m > 0) AS f FROM x_fmp GROUP BY 1, 2)
SELECT t.arm, arg_max(t.family_id, (round(s, 9), t.family_id)) AS best_family, {R('max(s)')} AS best_sum, {R('avg((f <= 0)::INT)')} AS false_discovery_rate FROM t JOIN p USING (arm, family_id) GROUP BY 1""")
def a49(r):
    t = r.family_panel().groupBy("arm", "family_id").agg(F.sum("excess_1m").alias("s"), F.avg(F.when(F.col("excess_1m") > 0, F.col("fwd_1m"))).alias("f"))
    return t.groupBy("arm").agg(F.max_by("family_id", F.struct(F.round("s", 9), "family_id")).alias("best_family"), rnd(F.max("s")).alias("best_sum"),
                                rnd(share(F.col("f") <= 0)).alias("false_discovery_rate"))


# ---- sorts, top-k, grids -------------------------------------------------

@query("k1_entry_candidates", f"""
WITH k AS (SELECT *, row_number() OVER (PARTITION BY decision_date ORDER BY score DESC, ticker) AS rn, count(*) OVER (PARTITION BY decision_date) AS n FROM x_signals)
SELECT decision_date, ticker, {R('score')} AS score, rn AS score_rank, {R('score - 0.85')} AS threshold_distance FROM k WHERE rn <= least(6, greatest(1, ceil(n * 0.05))) AND score >= 0.85""")
def k1(r):
    return gates.entry_candidates(r.signals(), 0.85, 0.05, 6).select("decision_date", "ticker", rnd("score").alias("score"), F.col("score_rank").cast("long").alias("score_rank"), rnd("threshold_distance").alias("threshold_distance"))


@query("k2_candidate_flags", """
WITH k AS (SELECT *, row_number() OVER (PARTITION BY decision_date ORDER BY score DESC, ticker) <= greatest(1, ceil(count(*) OVER (PARTITION BY decision_date) * 0.05)) AS relative, score >= 0.85 AS accepted FROM x_signals)
SELECT decision_date, ticker, relative, accepted, relative AND accepted AS accepted_relative, relative AND NOT accepted AS shadow_rejected FROM k""")
def k2(r):
    r.share("signals")
    return gates.gate_flags(r.signals(), 0.85, 0.05).select("decision_date", "ticker", "relative", "accepted", "accepted_relative", "shadow_rejected")


@query("k3_argmax_runner_up", f"""
WITH s AS (SELECT h, treatment, {R('median(cagr_excess)')} AS med, {R('avg(cagr_excess)')} AS mean, {R('avg((cagr_excess > 0)::INT)')} AS pos FROM x_surf GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY med DESC, mean DESC, pos DESC, treatment) AS rn FROM s)
SELECT a.h, a.treatment AS winner, a.med AS winner_median, b.treatment AS runner_up, b.med AS runner_median FROM k a LEFT JOIN k b ON a.h = b.h AND b.rn = 2 WHERE a.rn = 1""")
def k3(r):
    s = r.surface().groupBy("h", "treatment").agg(rnd(median("cagr_excess")).alias("med"), rnd(F.avg("cagr_excess")).alias("mean"), rnd(share(F.col("cagr_excess") > 0)).alias("pos"))
    return sel.winner_and_runner_up(s, ["h"], [F.desc("med"), F.desc("mean"), F.desc("pos"), F.asc("treatment")], "treatment", "med")


VENUE = """
v AS (SELECT l_orderkey AS decision_id, l_returnflag AS route_id, CAST(min(l_extendedprice) AS DECIMAL(18, 2)) AS bid, CAST(min(l_extendedprice) AS DECIMAL(18, 2)) + CAST(min(l_quantity) AS DECIMAL(18, 2)) AS ask,
  CAST(min(l_quantity) * 100 AS DECIMAL(18, 2)) AS size, CAST(2500 AS DECIMAL(18, 2)) AS notional, min(l_linenumber) AS age, min(l_discount) < 0.08 AS eligible FROM lineitem GROUP BY 1, 2),
c AS (SELECT *, (ask - bid)::DOUBLE / ((ask + bid)::DOUBLE / 2) * 10000 + 4 + CASE route_id WHEN 'A' THEN 30 WHEN 'N' THEN 3 ELSE 0 END + greatest(0, notional - size)::DOUBLE / notional::DOUBLE * 100 AS cost,
  CASE WHEN ask < bid THEN 'QUOTE_INVALID' WHEN age < 2 THEN 'LOOKAHEAD_QUOTE' WHEN age > 6 THEN 'QUOTE_STALE' ELSE 'OK' END AS reason FROM v)"""


def venue_quotes(r):
    li = r.table("lineitem")
    dec = lambda c: c.cast("decimal(18,2)")
    return li.groupBy(F.col("l_orderkey").alias("decision_id"), F.col("l_returnflag").alias("route_id")).agg(
        dec(F.min("l_extendedprice")).alias("bid"), (dec(F.min("l_extendedprice")) + dec(F.min("l_quantity"))).alias("ask"), dec(F.min("l_quantity") * 100).alias("size"),
        dec(F.lit(2500)).alias("notional"), F.min("l_linenumber").alias("age"), (F.min("l_discount") < 0.08).alias("eligible"))


@query("k4_cheapest_venue", f"""
WITH {VENUE}, e AS (SELECT *, row_number() OVER (PARTITION BY decision_id ORDER BY round(cost, 6), route_id) AS rn FROM c WHERE eligible), a AS (SELECT DISTINCT decision_id FROM c)
SELECT a.decision_id, CASE WHEN e.route_id IS NULL OR 60 - round(cost, 6) <= 10 THEN 'NO_TRADE' ELSE e.route_id END AS route, {R('60 - round(cost, 6)', 4)} AS remaining_edge,
 CASE WHEN e.route_id IS NULL THEN 'NO_ELIGIBLE_ROUTE' WHEN 60 - round(cost, 6) <= 10 THEN 'EDGE_NOT_ABOVE_HURDLE' ELSE 'MINIMUM_COST' END AS reason FROM a LEFT JOIN e ON e.decision_id = a.decision_id AND e.rn = 1""")
def k4(r):
    return sel.cheapest_route(sel.venue_costs(venue_quotes(r)), edge=60.0, hurdle=10.0).select("decision_id", "route", rnd("remaining_edge", 4).alias("remaining_edge"), "reason")


@query("k5_policy_grid", """
SELECT q.q AS quantile, f.f AS top_fraction, CAST(n.n AS INT) AS max_names, h.h, CAST(d.d AS INT) AS d FROM (SELECT unnest([0.5::DOUBLE, 0.8, 0.9]) AS q) q, (SELECT unnest([0.01::DOUBLE, 0.05]) AS f) f, (SELECT unnest(range(1, 7)) AS n) n,
 (SELECT DISTINCT h FROM x_surf) h, (SELECT unnest(range(1, 8)) AS d) d WHERE d.d <= h.h""")
def k5(r):
    horizons = r.surface().select("h").distinct()
    return sel.policy_grid(horizons, [0.5, 0.8, 0.9], [0.01, 0.05], range(1, 7), 7)


@query("k5_balanced_policies", """
WITH q AS (SELECT unnest([0.5::DOUBLE, 0.8, 0.9]) AS v, unnest(range(3)) AS i), f AS (SELECT unnest([0.01::DOUBLE, 0.05]) AS v, unnest(range(2)) AS i), n AS (SELECT unnest(range(1, 7)) AS v, unnest(range(6)) AS i), d AS (SELECT unnest(range(1, 11)) AS v, unnest(range(10)) AS i),
g AS (SELECT q.v AS qv, f.v AS fv, n.v AS nv, d.v AS dv, q.i AS qi, f.i AS fi, n.i AS ni, d.i AS di, ((q.i * 2 + f.i) * 6 + n.i) * 10 + d.i AS cell FROM q, f, n, d),
s AS (SELECT i % 3 AS qi, i % 2 AS fi, i % 6 AS ni, i AS di, i AS step FROM (SELECT unnest(range(10)) AS i) UNION ALL
 SELECT (i * 3 + i // 5) % 3, (i * 5 + i // 7) % 2, (i * 7 + i // 3) % 6, (i * 11 + i // 2) % 10, 10 + i FROM (SELECT unnest(range(8 * 360)) AS i)),
o AS (SELECT qv, fv, nv, dv, row_number() OVER (ORDER BY coalesce(step, 100000 + cell)) AS place FROM g LEFT JOIN (SELECT qi, fi, ni, di, min(step) AS step FROM s GROUP BY ALL) USING (qi, fi, ni, di))
SELECT h, CAST(place AS INTEGER) AS place, qv AS quantile, fv AS top_fraction, CAST(nv AS INTEGER) AS max_names, CAST(dv AS INTEGER) AS d FROM (SELECT DISTINCT h FROM x_surf), o WHERE place <= 48""")
def k5_balanced(r):
    return sel.balanced_policies(r.surface().select("h").distinct(), [0.5, 0.8, 0.9], [0.01, 0.05], list(range(1, 7)), list(range(1, 11)), 48)


@query("k6_deduplicated_policies", f"""
WITH p AS (SELECT h, d, treatment, string_agg(fold::VARCHAR, ',' ORDER BY fold) AS path, {R('median(cagr_excess)')} AS med FROM x_surf GROUP BY 1, 2, 3)
SELECT h, path, d, treatment, med FROM (SELECT *, row_number() OVER (PARTITION BY h, path ORDER BY med DESC, d, treatment) AS rn FROM p) WHERE rn = 1""")
def k6(r):
    p = r.surface().groupBy("h", "d", "treatment").agg(
        F.concat_ws(",", F.array_sort(F.collect_set(F.col("fold").cast("string")))).alias("path"), rnd(median("cagr_excess")).alias("med"))
    return od.top_rows(p, ["h", "path"], [F.desc("med"), F.asc("d"), F.asc("treatment")], 1, "rn").select("h", "path", "d", "treatment", "med")
