"""Trade tables, exit timing, allocation, composed flows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronopanel.catalog.aggregates import AVG_RANK
from chronopanel.catalog.registry import R, query
from chronopanel.catalog.timeseries import METRICS, PATH
from chronopanel.functions.rounding import rnd
from chronopanel.functions.stats import median, quantile, share
from chronopanel.operators import trades as tr
from chronopanel.operators.gates import entry_candidates
from chronopanel.operators.joins import authoritative_signals
from chronopanel.plans import evidence as pe
from chronopanel.session import stage

PICKS = """
k AS (SELECT *, row_number() OVER (PARTITION BY decision_date ORDER BY score DESC, ticker) AS rn, count(*) OVER (PARTITION BY decision_date) AS n FROM x_signals),
pick AS (SELECT * FROM k WHERE rn <= least(6, greatest(1, ceil(n * 0.05))) AND score >= 0.85),
nt AS (SELECT p.decision_date, p.ticker, p.score, p.rn, e.date AS entry_date, x.date AS exit_date, a.open AS entry_price, b.open AS exit_price, b.open / a.open AS gross, (b.open / a.open) / (bb.open / ba.open) - 1 AS excess
  FROM pick p JOIN x_sessions d ON d.date = p.decision_date JOIN x_sessions e ON e.idx = d.idx + 1 LEFT JOIN x_sessions x ON x.idx = d.idx + 6
  JOIN x_prices a ON a.ticker = p.ticker AND a.date = e.date LEFT JOIN x_prices b ON b.ticker = p.ticker AND b.date = x.date JOIN x_bench ba ON ba.date = e.date LEFT JOIN x_bench bb ON bb.date = x.date)"""


def gated(r):
    r.share("prices", "signals")
    return tr.next_open_trades(r.signals(), r.prices(), r.bench(), r.sessions(), threshold=0.85, top_fraction=0.05, max_names=6, hold=5)


@query("e0_gated_trades_by_month", f"""
WITH {PICKS}, m AS (SELECT CAST(date_trunc('month', decision_date) AS DATE) AS month, count(*) AS trades, count(*) FILTER (exit_price IS NULL) AS open_trades, {R('avg(gross - 1)')} AS mean_return, {R('avg(excess)')} AS mean_excess,
  {R('avg(gross * 0.999 * 0.999 - 1)')} AS mean_net_return FROM nt GROUP BY 1),
c AS (SELECT CAST(date_trunc('month', decision_date) AS DATE) AS month, score, excess FROM x_panel), i AS (SELECT month, {AVG_RANK.format(p='month', x='score')} AS rx, {AVG_RANK.format(p='month', x='excess')} AS ry FROM c)
SELECT m.*, rank_ic FROM m LEFT JOIN (SELECT month, CASE WHEN count(*) >= 3 THEN {R('corr(rx, ry)')} END AS rank_ic FROM i GROUP BY 1) USING (month)""")
def e0(r):
    r.share("prices", "signals")
    m = pe.gated_trades_by_month(r.signals(), r.prices(), r.bench(), r.sessions(), r.staged_panel(), threshold=0.85, top_fraction=0.05, max_names=6, hold=5)
    return m.select("month", "trades", "open_trades", *[rnd(c).alias(c) for c in ("mean_return", "mean_excess", "mean_net_return", "rank_ic")])


AUTHORITY = "au AS (SELECT s.decision_date, s.ticker, s.score FROM x_msig s ASOF JOIN x_msch a ON a.family_id = s.family_id AND a.activation_date <= s.decision_date WHERE a.model_id = s.model_id)"


@query("e1_authoritative_trades_by_month", f"""
WITH {AUTHORITY},{PICKS.replace('x_signals', 'au')}, m AS (SELECT CAST(date_trunc('month', decision_date) AS DATE) AS month, count(*) AS trades, count(*) FILTER (exit_price IS NULL) AS open_trades, {R('avg(gross - 1)')} AS mean_return, {R('avg(excess)')} AS mean_excess,
  {R('avg(gross * 0.999 * 0.999 - 1)')} AS mean_net_return FROM nt GROUP BY 1),
c AS (SELECT CAST(date_trunc('month', decision_date) AS DATE) AS month, au.score, o.excess FROM au JOIN x_outcomes o USING (decision_date, ticker)), i AS (SELECT month, {AVG_RANK.format(p='month', x='score')} AS rx, {AVG_RANK.format(p='month', x='excess')} AS ry FROM c WHERE excess IS NOT NULL)
SELECT m.*, rank_ic FROM m LEFT JOIN (SELECT month, CASE WHEN count(*) >= 3 THEN {R('corr(rx, ry)')} END AS rank_ic FROM i GROUP BY 1) USING (month)""")
def e1(r):
    """The flagship with its authority step: the scores of the model that each family has active, then gates, trades and rank IC."""
    r.share("prices", "model_signals")
    schedule = stage(r.model_schedule(), "model-schedule")
    live = stage(authoritative_signals(r.model_signals(), schedule).select("decision_date", "ticker", "score"), "authoritative")
    panel = live.join(r.outcomes().select("decision_date", "ticker", "excess"), ["decision_date", "ticker"])
    m = pe.gated_trades_by_month(live, r.prices(), r.bench(), r.sessions(), panel, threshold=0.85, top_fraction=0.05, max_names=6, hold=5)
    return m.select("month", "trades", "open_trades", *[rnd(c).alias(c) for c in ("mean_return", "mean_excess", "mean_net_return", "rank_ic")])


@query("r1_next_open_trades", f"""
WITH {PICKS} SELECT decision_date, ticker, {R('score')} AS score, rn AS score_rank, entry_date, exit_date, exit_price IS NULL AS is_open, {R('gross - 1')} AS stock_return, {R('excess')} AS excess, {R('gross * 0.999 * 0.999 - 1')} AS net_return FROM nt""")
def r1(r):
    return gated(r).select("decision_date", "ticker", rnd("score").alias("score"), F.col("score_rank").cast("long").alias("score_rank"), "entry_date", "exit_date", "is_open",
                           rnd("stock_return").alias("stock_return"), rnd("excess").alias("excess"), rnd("net_return").alias("net_return"))


HELD = """
ps AS (SELECT p.*, s.idx FROM x_prices p JOIN x_sessions s USING (date)), bs AS (SELECT b.*, s.idx FROM x_bench b JOIN x_sessions s USING (date)),
tx AS (SELECT t.*, a.idx AS ei, b.idx AS xi FROM x_trades t JOIN x_sessions a ON a.date = t.entry_date JOIN x_sessions b ON b.date = t.exit_date),
held AS (SELECT t.trade_id, t.ticker, t.ei, t.xi, p.idx, p.open, p.close, p.high, p.low FROM tx t JOIN ps p ON p.ticker = t.ticker AND p.idx BETWEEN t.ei AND t.xi LEFT JOIN ps q ON q.ticker = p.ticker AND q.idx = p.idx - 1 WHERE p.idx = t.ei OR q.close IS NOT NULL)"""


@query("r2_path_exits", f"""
WITH {HELD}, x AS (SELECT h.*, h.close / e.open / (b.close / be.open) - 1 AS ex FROM held h JOIN held e ON e.trade_id = h.trade_id AND e.idx = e.ei JOIN bs b ON b.idx = h.idx JOIN bs be ON be.idx = h.ei WHERE h.idx < h.xi),
v AS (SELECT s.idx, k.ticker FROM (SELECT *, row_number() OVER (PARTITION BY decision_date ORDER BY score DESC, ticker) AS rn, count(*) OVER (PARTITION BY decision_date) AS n FROM x_signals) k JOIN x_sessions s ON s.date = k.decision_date
  WHERE rn <= least(40, greatest(1, ceil(n * 0.5))) AND score >= 0.6),
y AS (SELECT x.*, v.ticker AS picked, greatest(0, max(ex) OVER (PARTITION BY trade_id ORDER BY x.idx)) AS pk FROM x LEFT JOIN v ON v.ticker = x.ticker AND v.idx = x.idx),
g AS (SELECT trade_id, ticker, ei, xi, min(CASE WHEN picked IS NULL THEN idx END) AS h4, min(CASE WHEN ex <= -0.1 THEN idx END) AS h1, min(CASE WHEN ex <= pk - 0.15 THEN idx END) AS h2, min(CASE WHEN ex >= 0.12 THEN idx END) AS h3 FROM y GROUP BY 1, 2, 3, 4),
l AS (SELECT *, 'RELATIVE_STOP_10' AS rule, h1 AS hit FROM g UNION ALL SELECT *, 'TRAILING_15', h2 FROM g UNION ALL SELECT *, 'TAKE_PROFIT_12', h3 FROM g UNION ALL SELECT *, 'SIGNAL_DECAY', h4 FROM g)
SELECT trade_id, ticker, rule, coalesce(hit, xi - 1) - ei + 1 AS held_sessions, hit IS NOT NULL AS early FROM l""")
def r2(r):
    r.share("prices", "trades")
    rules = {"RELATIVE_STOP_10": ("RELATIVE_STOP", -0.1), "TRAILING_15": ("TRAILING", 0.15), "TAKE_PROFIT_12": ("TAKE_PROFIT", 0.12), "SIGNAL_DECAY": ("SIGNAL_DECAY", 0.0)}
    valid = entry_candidates(r.signals(), 0.6, 0.5, 40)
    return tr.path_exits(r.trades(), r.prices(), r.bench(), r.sessions(), rules, valid).select("trade_id", "ticker", "rule", "held_sessions", "early")


SPECS = [{"id": "HARD_10", "hard": 0.10, "min_hold": 2}, {"id": "TRAIL_12", "trail": 0.12, "min_hold": 2}, {"id": "ATR_1", "atr": 1.0, "min_hold": 1}, {"id": "COMBINED", "hard": 0.12, "trail": 0.15, "atr": 1.0, "min_hold": 5}]


@query("r3_stop_overlay", f"""
WITH {HELD}, tr0 AS (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS pc FROM ps), tr1 AS (SELECT ticker, idx, date, greatest(high - low, coalesce(abs(high - pc), high - low), coalesce(abs(low - pc), high - low)) AS t FROM tr0),
atr AS (SELECT ticker, idx, CASE WHEN count(t) OVER w >= 14 THEN avg(t) OVER w ELSE 0 END AS atr FROM tr1 WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 13 PRECEDING)),
x AS (SELECT h.*, row_number() OVER w - 1 AS held_n, first(h.open) OVER w AS ep, max(h.high) OVER (PARTITION BY trade_id ORDER BY h.idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS kh, coalesce(lag(atr) OVER w, 0) AS ka FROM held h JOIN atr USING (ticker, idx) WINDOW w AS (PARTITION BY trade_id ORDER BY h.idx)),
y AS (SELECT trade_id, ticker, ei, idx, open, low, held_n, ep, greatest(ep, kh) AS kh, ka FROM x WHERE held_n >= 1 AND idx < xi),
z AS (SELECT *, 'HARD_10' AS spec, CASE WHEN held_n >= 2 THEN ep * 0.9 END AS lv FROM y UNION ALL SELECT *, 'TRAIL_12', CASE WHEN held_n >= 2 THEN kh * (1 - 0.12) END FROM y UNION ALL SELECT *, 'ATR_1', CASE WHEN held_n >= 1 THEN kh - 1.0 * ka END FROM y
  UNION ALL SELECT *, 'COMBINED', CASE WHEN held_n >= 5 THEN greatest(ep * (1 - 0.12), kh * (1 - 0.15), kh - 1.0 * ka) END FROM y),
f AS (SELECT *, row_number() OVER (PARTITION BY trade_id, spec ORDER BY idx) AS rn FROM z WHERE open <= lv OR low <= lv)
SELECT trade_id, ticker, spec, idx - ei AS held_sessions, CASE WHEN open <= lv THEN 'STOP_GAP' ELSE 'STOP_TOUCH' END AS reason, {R('CASE WHEN open <= lv THEN open ELSE lv END')} AS price FROM f WHERE rn = 1""")
def r3(r):
    r.share("prices", "trades")
    return tr.stop_overlay(r.trades(), r.prices(), r.sessions(), SPECS).select("trade_id", "ticker", "spec", "held_sessions", "reason", rnd("price").alias("price"))


@query("r4_learned_exits", f"""
WITH {HELD.replace('bs AS (SELECT b.*, s.idx FROM x_bench b JOIN x_sessions s USING (date)),', '')}, k AS (SELECT t.trade_id, t.ticker, s.idx, s.date FROM tx t JOIN x_sessions s ON s.idx BETWEEN t.ei AND t.xi - 1), j AS (SELECT k.*, g.score AS c FROM k LEFT JOIN x_signals g ON g.decision_date = k.date AND g.ticker = k.ticker)
SELECT trade_id, bool_or(c IS NULL) AS fallback, count(*) AS planned_days, CASE WHEN bool_or(c IS NULL) THEN max(idx) ELSE coalesce(min(CASE WHEN c <= 0.3 THEN idx END), max(idx)) END AS exit_idx FROM j GROUP BY 1""")
def r4(r):
    keys = r.trades().select("trade_id", "ticker", F.explode(F.sequence(F.col("entry_idx"), F.col("exit_idx") - 1)).alias("idx")).join(r.sessions(), "idx")
    preds = r.signals().select(F.col("decision_date").alias("date"), "ticker", F.col("score").alias("continuation"))
    return tr.learned_exits(keys, preds, 0.3).select("trade_id", "fallback", "planned_days", "exit_idx")


@query("r5_batch_weights", f"""
WITH k AS (SELECT *, row_number() OVER (PARTITION BY decision_date ORDER BY score DESC, ticker) AS rank FROM x_signals), b AS (SELECT * FROM k WHERE rank <= 6),
s AS (SELECT *, count(*) OVER d AS n, greatest(score - 0.8, 0) AS ex, stddev_pop(score) OVER d AS sd, avg(score) OVER d AS m FROM b WINDOW d AS (PARTITION BY decision_date)),
e AS (SELECT *, coalesce(greatest(min(CASE WHEN ex > 0 THEN ex END) OVER (PARTITION BY decision_date) * 1e-6, 1e-12), 1e-12) AS eps, CASE WHEN sd <= 1e-15 THEN 0 ELSE (score - m) / sd END AS z FROM s),
r AS (SELECT *, rank ** (-1.5) AS pw, (ex + eps) ** 1.5 AS epw, exp(1.5 * z - max(1.5 * z) OVER (PARTITION BY decision_date)) AS sm FROM e)
SELECT decision_date, ticker, rank, {R('1.0 / n')} AS w_equal, {R('pw / sum(pw) OVER d')} AS w_rank_power, {R('epw / sum(epw) OVER d')} AS w_excess_power, {R('sm / sum(sm) OVER d')} AS w_softmax FROM r WINDOW d AS (PARTITION BY decision_date)""")
def r5(r):
    w = tr.batch_weights(r.signals(), "decision_date", 0.8, 1.5, 6)
    return w.select("decision_date", "ticker", F.col("rank").cast("long").alias("rank"), *[rnd(c).alias(c) for c in ("w_equal", "w_rank_power", "w_excess_power", "w_softmax")])


@query("r6_performance_metrics", f"""
WITH n AS (SELECT *, strategy_value / lag(strategy_value) OVER w - 1 AS sr, bench_value / lag(bench_value) OVER w - 1 AS br, strategy_value / max(strategy_value) OVER w - 1 AS sd, bench_value / max(bench_value) OVER w - 1 AS bd, rel / max(rel) OVER w - 1 AS rd FROM x_nav WINDOW w AS (PARTITION BY family_id, arm ORDER BY date)),
a AS (SELECT family_id, arm, arg_min(strategy_value, date) AS s0, arg_max(strategy_value, date) AS s1, arg_min(bench_value, date) AS b0, arg_max(bench_value, date) AS b1, date_diff('day', min(date), max(date)) AS period_days, min(sd) AS md, min(bd) AS bmd, min(rd) AS rmd, stddev_samp(sr) * sqrt(252) AS sv, stddev_samp(br) * sqrt(252) AS bv, avg(positions) AS ap, max(positions) AS mp FROM n GROUP BY 1, 2),
t AS (SELECT arm, count(*) AS trade_count, avg((excess > 0)::INT) AS win_rate, avg(stock_return) AS mtr, median(excess) AS mte, avg(hold) AS mh FROM x_tr GROUP BY 1)
SELECT family_id, a.arm, period_days, mp AS max_positions, trade_count, {', '.join(f"{R(e)} AS {n}" for e, n in (('s1 / s0 - 1', 'total_return'), ('b1 / b0 - 1', 'bench_total_return'), ('(s1 / s0) ** (365.25 / period_days) - 1', 'cagr'), ('(s1 / s0) ** (365.25 / period_days) - (b1 / b0) ** (365.25 / period_days)', 'cagr_excess'), ('md', 'max_drawdown'), ('bmd', 'bench_max_drawdown'), ('rmd', 'worst_relative_drawdown'), ('sv', 'volatility'), ('bv', 'bench_volatility'), ('ap', 'average_positions'), ('win_rate', 'win_rate'), ('mtr', 'mean_trade_return'), ('mte', 'median_trade_excess'), ('mh', 'mean_holding')))} FROM a JOIN t ON t.arm = a.arm""")
def r6(r):
    from chronopanel.plans.performance import performance_metrics
    return performance_metrics(r.nav(), r.trade_returns(), ["family_id", "arm"])


@query("r7_overlay_summary", f"""
WITH f AS (SELECT d AS horizon, treatment AS candidate, fold, avg(cagr_excess) AS m FROM x_surf GROUP BY 1, 2, 3), j AS (SELECT a.*, a.m - b.m AS delta FROM f a JOIN f b ON a.horizon = b.horizon AND a.fold = b.fold AND b.candidate = 'N'),
s AS (SELECT horizon, candidate, count(*) AS folds, {R('median(m)')} AS median_excess, {R('median(delta)')} AS median_delta, {R('quantile_cont(delta, 0.25)')} AS q25_delta, {R('min(delta)')} AS worst_delta, {R('avg((delta > 0)::INT)')} AS positive_fraction FROM j GROUP BY 1, 2)
SELECT *, candidate <> 'N' AND row_number() OVER (PARTITION BY horizon, candidate = 'N' ORDER BY median_delta DESC, q25_delta DESC, worst_delta DESC, candidate) = 1 AS best FROM s""")
def r7(r):
    from chronopanel.operators.joins import paired_baseline
    f = r.surface().groupBy(F.col("d").alias("horizon"), F.col("treatment").alias("candidate"), "fold").agg(F.avg("cagr_excess").alias("m"))
    j = paired_baseline(f, ["horizon", "fold"], "candidate", "N", ["m"])
    s = j.groupBy("horizon", "candidate").agg(F.count(F.lit(1)).alias("folds"), rnd(median("m")).alias("median_excess"), rnd(median("delta_m")).alias("median_delta"), rnd(quantile("delta_m", 0.25)).alias("q25_delta"),
                                              rnd(F.min("delta_m")).alias("worst_delta"), rnd(share(F.col("delta_m") > 0)).alias("positive_fraction"))
    w = Window.partitionBy("horizon", F.col("candidate") == "N").orderBy(F.desc("median_delta"), F.desc("q25_delta"), F.desc("worst_delta"), "candidate")
    return s.withColumn("best", (F.col("candidate") != "N") & (F.row_number().over(w) == 1))


@query("r8_activation_funnel", f"""
WITH q AS (SELECT CAST(date_trunc('quarter', decision_date) AS DATE) AS fold_id, * FROM x_signals), e AS (SELECT CAST(date_trunc('quarter', entry_date) AS DATE) AS fold_id, count(*) AS entries FROM x_trades GROUP BY 1)
SELECT fold_id, count(DISTINCT decision_date) AS prediction_days, count(DISTINCT CASE WHEN score >= 1.02 THEN decision_date END) AS days_above, {R('count(DISTINCT CASE WHEN score >= 1.02 THEN decision_date END) / count(DISTINCT decision_date)')} AS activation_fraction,
 count(DISTINCT CASE WHEN score >= 1.02 THEN ticker END) AS tickers_above, coalesce(any_value(entries), 0) AS entries, CASE WHEN coalesce(any_value(entries), 0) > 0 THEN 'ACTIVE_FOLD' WHEN count(*) FILTER (score >= 1.02) = 0 THEN 'NO_SCORE_ABOVE_THRESHOLD' ELSE 'OTHER' END AS reason FROM q LEFT JOIN e USING (fold_id) GROUP BY 1""")
def r8(r):
    r.share("signals")
    from chronopanel.plans.performance import activation_funnel
    entries = r.trades().groupBy(F.trunc("entry_date", "quarter").alias("fold_id")).agg(F.count(F.lit(1)).alias("entries"))
    return activation_funnel(r.signals().withColumn("fold_id", F.trunc("decision_date", "quarter")), entries, 1.02)


@query("r9_state_selectors", f"""
WITH s AS (SELECT *, lag(quartile) OVER (PARTITION BY cluster_level, arm, cluster_id ORDER BY date_pos) = 'TOP' AND lag(date_pos) OVER (PARTITION BY cluster_level, arm, cluster_id ORDER BY date_pos) = date_pos - 1 AS was_top FROM x_state),
d AS (SELECT cluster_level, arm, assessment_date, max(fwd_1m) AS oracle, avg(fwd_1m) AS equal_weight, max(CASE WHEN rank = 1 THEN fwd_1m END) AS current_winner, avg(fwd_1m) FILTER (quartile = 'TOP') AS top_quartile, coalesce(avg(fwd_1m) FILTER (quartile = 'TOP' AND was_top), 0) AS persistent_top FROM s GROUP BY 1, 2, 3 HAVING count(fwd_1m) > 0),
l AS (UNPIVOT d ON oracle, equal_weight, current_winner, top_quartile, persistent_top INTO NAME rule VALUE v)
SELECT cluster_level, arm, rule, count(v) AS observations, {R('avg(v)')} AS mean_excess, {R('product(1 + v) - 1')} AS compounded FROM l GROUP BY 1, 2, 3""")
def r9(r):
    from chronopanel.plans.performance import state_selector_rules
    return state_selector_rules(r.state(), "fwd_1m")


@query("r10_baseline_comparison", f"""
WITH p AS (SELECT assessment_date, arm, family_id, fwd_1m, round(trailing_3m, 9) AS pred, round(excess_1m, 9) AS e1 FROM x_fmp WHERE trailing_3m IS NOT NULL AND fwd_1m IS NOT NULL),
g AS (SELECT arm, assessment_date, arg_max(family_id, (pred, family_id)) AS selected, arg_max(fwd_1m, (pred, family_id)) AS gross, avg(fwd_1m) AS equal_weight, max(fwd_1m) AS oracle, arg_max(fwd_1m, (e1, family_id)) AS trailing_1m FROM p GROUP BY 1, 2),
k AS (SELECT *, coalesce(lag(selected) OVER (PARTITION BY arm ORDER BY assessment_date) <> selected, false)::INT AS sw FROM g)
SELECT arm, CAST(bps AS INT) AS bps, count(*) AS months, CAST(sum(sw) AS BIGINT) AS switches, {R('avg(gross - sw * bps / 10000.0)')} AS selector_excess, {R('avg(equal_weight)')} AS equal_weight, {R('avg(trailing_1m)')} AS trailing_1m, {R('avg(oracle - (gross - sw * bps / 10000.0))')} AS oracle_regret, {R('avg(gross - sw * bps / 10000.0 - equal_weight)')} AS incremental
FROM k CROSS JOIN (SELECT unnest([0, 10, 20, 30, 50]) AS bps) GROUP BY 1, 2""")
def r10(r):
    from chronopanel.plans.performance import baseline_comparison
    p = r.family_panel().where("trailing_3m IS NOT NULL AND fwd_1m IS NOT NULL")
    return baseline_comparison(p, "trailing_3m", "excess_1m", "fwd_1m", [0, 10, 20, 30, 50])


@query("r11_basket_outcomes", f"""
WITH k AS (SELECT *, row_number() OVER (PARTITION BY decision_date ORDER BY score DESC, ticker) AS rn FROM x_signals), j AS (SELECT k.*, o.stock_return, o.bench_return FROM k LEFT JOIN x_outcomes o USING (decision_date, ticker) WHERE rn <= 3)
SELECT decision_date, count(*) AS members, bool_and(stock_return IS NOT NULL) AS complete, CASE WHEN bool_and(stock_return IS NOT NULL) THEN {R('avg(stock_return)')} END AS gross_return, CASE WHEN bool_and(stock_return IS NOT NULL) THEN {R('avg(stock_return) - avg(bench_return) - 0.002')} END AS net_excess FROM j GROUP BY 1""")
def r11(r):
    from chronopanel.operators.ordered import top_rows
    members = top_rows(r.signals(), ["decision_date"], [F.desc("score"), F.asc("ticker")], 3, "rn")
    return tr.basket_outcomes(members, r.outcomes(), 0.002).select("decision_date", "members", "complete", rnd("gross_return").alias("gross_return"), rnd("net_excess").alias("net_excess"))


T19 = f"""{PATH}, e AS (SELECT family_id, arm, max(pos) AS pos FROM p2 GROUP BY 1, 2, date_trunc('month', date) HAVING max(pos) > 1), risk AS ({METRICS}),
st AS (SELECT *, rel / lag(rel) OVER w - 1 AS x FROM x_nav WINDOW w AS (PARTITION BY family_id, arm ORDER BY date)),
tl AS (SELECT family_id, arm, date, rel / lag(rel, 4) OVER w - 1 AS x1, rel / lag(rel, 13) OVER w - 1 AS x3, rel / lag(rel, 26) OVER w - 1 AS x6, rel / lag(rel, 52) OVER w - 1 AS x12,
  avg(x) OVER (PARTITION BY family_id, arm ORDER BY date ROWS 3 PRECEDING) - avg(x) OVER (PARTITION BY family_id, arm ORDER BY date ROWS UNBOUNDED PRECEDING) AS rec FROM st WINDOW w AS (PARTITION BY family_id, arm ORDER BY date)),
es AS (SELECT family_id, arm, date, x, row_number() OVER (PARTITION BY family_id, arm ORDER BY date) AS rn FROM st WHERE x IS NOT NULL),
ew AS (SELECT family_id, arm, date, rn, x AS v FROM es WHERE rn = 1 UNION ALL SELECT es.family_id, es.arm, es.date, es.rn, es.x / 7 + ew.v * 6 / 7 FROM ew JOIN es ON es.family_id = ew.family_id AND es.arm = ew.arm AND es.rn = ew.rn + 1),
me AS (SELECT family_id, arm, date, (rel > lag(rel) OVER (PARTITION BY family_id, arm ORDER BY date))::INT AS up FROM (SELECT *, row_number() OVER (PARTITION BY family_id, arm, date_trunc('month', date) ORDER BY date DESC) AS k FROM x_nav) WHERE k = 1),
mp AS (SELECT family_id, arm, date, avg(up) OVER (PARTITION BY family_id, arm ORDER BY date ROWS UNBOUNDED PRECEDING) AS ppf FROM me),
tf AS (SELECT t.*, n_name AS family_id FROM x_tr t JOIN supplier ON s_suppkey = ticker JOIN nation ON n_nationkey = s_nationkey),
sg AS (SELECT n_name AS family_id, min(decision_date) AS activation_date, min(model_id) AS model_id FROM x_ord JOIN supplier ON s_suppkey = ticker JOIN nation ON n_nationkey = s_nationkey GROUP BY n_name, date_trunc('month', decision_date))"""


@query("t19_family_evidence", f"""
WITH RECURSIVE {T19}, b AS (SELECT r.family_id, r.arm, r.date, r.sessions, r.max_drawdown, r.cdar, r.expected_shortfall, x1, x3, x6, x12, rec, v, ppf, sg.model_id, sg.activation_date FROM risk r JOIN tl USING (family_id, arm, date) JOIN mp USING (family_id, arm, date)
  LEFT JOIN ew USING (family_id, arm, date) ASOF JOIN sg ON r.family_id = sg.family_id AND r.date >= sg.activation_date),
tt AS (SELECT b.family_id, b.arm, b.date, t.ticker, count(*) AS n, sum(t.excess) AS s, sum(greatest(t.excess, 0)) AS p, max(t.excess) AS m FROM b JOIN tf t ON t.family_id = b.family_id AND t.arm = b.arm AND t.exit_date <= b.date GROUP BY 1, 2, 3, 4),
t AS (SELECT family_id, arm, date, sum(n) AS n, sum(s) AS s, sum(p) AS p, max(m) AS m, max(p) AS tp, count(*) FILTER (s > 0) AS w, max(abs(s)) / nullif(sum(abs(s)), 0) AS c FROM tt GROUP BY 1, 2, 3)
SELECT b.* EXCLUDE (x1, x3, x6, x12, rec, v, ppf), {R('x1')} AS excess_1m, {R('x3')} AS excess_3m, {R('x6')} AS excess_6m, {R('x12')} AS excess_12m, {R('v')} AS ewma_excess, {R('rec')} AS recent_minus_long_run_excess, {R('ppf')} AS positive_period_fraction,
 CAST(coalesce(n, 0) AS BIGINT) AS matured_trades, {R('coalesce(greatest(m, 0) / nullif(p, 0), 0)')} AS top_trade_contribution, {R('coalesce(greatest(tp, 0) / nullif(p, 0), 0)')} AS top_ticker_contribution, CAST(coalesce(w, 0) AS BIGINT) AS independent_winners, {R('coalesce(c, 0)')} AS ticker_concentration,
 {R('coalesce((s - m) / greatest(1, n - 1), 0)')} AS leave_best_out, {R('least(1, sqrt(coalesce(n, 0) / 30.0))')} AS sample_weight FROM b LEFT JOIN t USING (family_id, arm, date)""")
def t19(r):
    r.share("prices", "returns")
    # trades and signals belong to the family of their ticker's nation
    family = r.table("supplier").join(r.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("ticker"), F.col("n_name").alias("family_id"))
    sched = (r.order_signals().drop("family_id").join(family, "ticker").groupBy("family_id", F.trunc("decision_date", "month").alias("_m"))
             .agg(F.min("decision_date").alias("activation_date"), F.min("model_id").alias("model_id")).drop("_m"))
    ev = pe.family_evidence(stage(r.nav(), "nav"), sched, r.trade_returns().join(family, "ticker")).where("pos > 1")
    return ev.select("family_id", "arm", "date", F.col("pos").alias("sessions"), "model_id", "activation_date", "matured_trades", "independent_winners",
                     *[rnd(c).alias(c) for c in ("max_drawdown", "cdar", "expected_shortfall", "excess_1m", "excess_3m", "excess_6m", "excess_12m", "ewma_excess", "recent_minus_long_run_excess", "positive_period_fraction",
                                                 "top_trade_contribution", "top_ticker_contribution", "ticker_concentration", "leave_best_out", "sample_weight")])


@query("t21_family_monthly_panel", f"""
SELECT family_id, arm, assessment_date, active_days, observed_days, trade_count, activity_state, {R('rel')} AS rel, {R('excess_1m')} AS excess_1m, {R('trailing_3m')} AS trailing_3m, {R('fwd_1m')} AS fwd_1m, {R('fwd_3m')} AS fwd_3m FROM x_fmp""")
def t21(r):
    return r.family_panel().select("family_id", "arm", "assessment_date", "active_days", "observed_days", "trade_count", "activity_state", *[rnd(c).alias(c) for c in ("rel", "excess_1m", "trailing_3m", "fwd_1m", "fwd_3m")])


@query("t22_opportunity_panel", f"""
WITH o AS (SELECT DISTINCT CAST(date_trunc('week', decision_date) AS DATE) AS decision_date, ticker, family_id, score FROM x_ord WHERE decision_date < DATE '2001-01-01'), o1 AS (SELECT decision_date, ticker, family_id, max(score) AS score FROM o WHERE decision_date < DATE '2001-01-01' GROUP BY 1, 2, 3),
rk AS (SELECT *, ({AVG_RANK.format(p='decision_date, family_id', x='score')}) / count(*) OVER (PARTITION BY decision_date, family_id) AS pct FROM o1),
sc AS (SELECT family_id, 'FULL' AS arm, activation_date, threshold * 0.8 AS threshold FROM x_sched UNION ALL SELECT family_id, 'HALF', activation_date, threshold / 2 FROM x_sched),
j AS (SELECT rk.*, s.arm, s.threshold FROM rk JOIN (SELECT *, lead(activation_date) OVER (PARTITION BY family_id, arm ORDER BY activation_date) AS nxt FROM sc) s ON s.family_id = rk.family_id AND rk.decision_date >= s.activation_date AND (s.nxt IS NULL OR rk.decision_date < s.nxt) WHERE score >= s.threshold)
SELECT j.decision_date, j.ticker, j.family_id, j.arm, {R('pct')} AS score_percentile, {R('score - threshold', 2)} AS distance, {R('x.excess')} AS excess, coalesce(x.excess IS NOT NULL AND x.terminal_date < DATE '2001-01-01', false) AS has_target, t.ticker IS NOT NULL AS trade_executed
FROM j LEFT JOIN x_outcomes x ON x.decision_date = j.decision_date AND x.ticker = j.ticker LEFT JOIN (SELECT DISTINCT ticker, entry_date FROM x_trades) t ON t.ticker = j.ticker AND t.entry_date = j.decision_date""")
def t22(r):
    sig = r.order_signals().where("decision_date < '2001-01-01'").groupBy(F.date_trunc("week", "decision_date").cast("date").alias("decision_date"), "ticker", "family_id").agg(F.max("score").alias("score"))
    s = r.schedule().select("family_id", "activation_date", "threshold")
    arms = s.withColumn("threshold", F.col("threshold") * 0.8).withColumn("arm", F.lit("FULL")).unionByName(s.withColumn("threshold", F.col("threshold") / 2).withColumn("arm", F.lit("HALF")))
    out = r.outcomes().select("decision_date", "ticker", "terminal_date", "excess")
    done = r.trades().select("ticker", F.col("entry_date").alias("decision_date"))
    p = pe.opportunity_panel(sig, arms, out, done, "2001-01-01")
    return p.select("decision_date", "ticker", "family_id", "arm", rnd("score_percentile").alias("score_percentile"), rnd("distance", 2).alias("distance"), rnd("excess").alias("excess"), "has_target", "trade_executed")


@query("r9_incumbent_rule", f"""
WITH RECURSIVE d AS (SELECT cluster_level, arm, assessment_date, max(CASE WHEN rank = 1 THEN cluster_id END) AS winner, list(cluster_id) FILTER (quartile = 'TOP') AS tops FROM x_state GROUP BY 1, 2, 3),
o AS (SELECT *, row_number() OVER (PARTITION BY cluster_level, arm ORDER BY assessment_date) AS rn FROM d),
f AS (SELECT cluster_level, arm, assessment_date, rn, winner AS inc FROM o WHERE rn = 1 UNION ALL SELECT o.cluster_level, o.arm, o.assessment_date, o.rn, CASE WHEN list_contains(o.tops, f.inc) THEN f.inc ELSE o.winner END FROM f JOIN o ON o.cluster_level = f.cluster_level AND o.arm = f.arm AND o.rn = f.rn + 1)
SELECT f.cluster_level, f.arm, f.assessment_date, f.inc AS incumbent, {R('s.fwd_1m')} AS fwd_1m FROM f JOIN x_state s ON s.cluster_level = f.cluster_level AND s.arm = f.arm AND s.assessment_date = f.assessment_date AND s.cluster_id = f.inc""")
def r9_incumbent(r):
    from chronopanel.operators import folds as fo
    r.share("state")
    keys = ["cluster_level", "arm", "assessment_date"]
    # the TOP set of a month is a quarter of the cluster registry
    day = r.state().groupBy(*keys).agg(F.max(F.when(F.col("rank") == 1, F.col("cluster_id"))).alias("winner"),
                                       F.collect_list(F.when(F.col("quartile") == "TOP", F.col("cluster_id"))).alias("top"))
    held = fo.kept_incumbent(day, ["cluster_level", "arm"], "assessment_date")
    return held.join(r.state().select(*keys, F.col("cluster_id").alias("incumbent"), rnd("fwd_1m").alias("fwd_1m")), [*keys, "incumbent"])


@query("w25_buffered_picks", """
WITH RECURSIVE m AS (SELECT ticker, date, lag(close, 5) OVER w / lag(close, 52) OVER w - 1 AS mom, avg(close * volume) OVER (PARTITION BY ticker ORDER BY date ROWS 12 PRECEDING) AS adv, count(*) OVER (PARTITION BY ticker ORDER BY date ROWS 12 PRECEDING) AS n FROM x_prices WINDOW w AS (PARTITION BY ticker ORDER BY date)),
u AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY round(adv, 6) DESC, ticker) AS liq FROM m WHERE n >= 13 AND mom IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY round(mom, 9) DESC, ticker) AS rank FROM u WHERE liq <= 30),
d AS (SELECT date, list(ticker ORDER BY rank) AS ranked, row_number() OVER (ORDER BY date) AS rn FROM k WHERE rank <= 10 GROUP BY date),
f AS (SELECT date, rn, ranked[1:5] AS held, 0::BIGINT AS kept FROM d WHERE rn = 1
 UNION ALL SELECT date, rn, list_concat(keep, list_filter(ranked, lambda x: NOT list_contains(keep, x)))[1:5], len(keep) FROM (SELECT d.date, d.rn, d.ranked, list_filter(f.held, lambda x: list_contains(d.ranked, x)) AS keep FROM f JOIN d ON d.rn = f.rn + 1))
SELECT date, array_to_string(list_sort(held), ',') AS held, kept FROM f""")
def w25_buffered(r):
    from chronopanel.operators import folds as fo
    from chronopanel.plans.market import momentum_universe
    ranked = momentum_universe(r.prices(), skip=5, lookback=52, adv=13, universe=30, keep=10, top=5)
    # ten ranked names per session and universe: the state walks the calendar
    day = ranked.groupBy("date").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "ticker"))), lambda x: x["ticker"]).alias("ranked"))
    return fo.buffered_picks(day.withColumn("universe", F.lit("ALL")), ["universe"], "date", 5).drop("universe")
