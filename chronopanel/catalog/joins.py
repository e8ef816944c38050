"""Joins: as-of, interval, lag, cardinality-checked, paired, expansion."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronopanel.catalog.registry import R, query
from chronopanel.contracts import checked_join
from chronopanel.functions.rounding import rnd
from chronopanel.operators import asof as ao
from chronopanel.operators import calendar as cal
from chronopanel.operators import joins as jn
from chronopanel.operators import ordered as od
from chronopanel.sources.roles import week


@query("j1_asof_backward", f"""
SELECT o.decision_date, o.ticker, o.family_id, o.model_id, s.activation_date, s.model_id AS active_model, {R('s.threshold', 2)} AS threshold
FROM x_ord o ASOF LEFT JOIN x_sched s ON o.family_id = s.family_id AND o.decision_date >= s.activation_date""")
def j1(r):
    out = ao.asof_join(r.order_signals(), r.schedule().withColumnRenamed("model_id", "active_model"), ["family_id"],
                       "decision_date", "activation_date")
    return out.select("decision_date", "ticker", "family_id", "model_id", "activation_date", "active_model",
                      rnd("threshold", 2).alias("threshold"))


@query("j2_authority_stitch", f"""
SELECT o.decision_date, o.ticker, o.family_id, o.model_id, {R('o.score', 2)} AS score
FROM x_ord o ASOF JOIN x_sched s ON o.family_id = s.family_id AND o.decision_date >= s.activation_date WHERE o.model_id = s.model_id""")
def j2(r):
    return jn.authoritative_signals(r.order_signals(), r.schedule()).select(
        "decision_date", "ticker", "family_id", "model_id", rnd("score", 2).alias("score"))


@query("j3_causal_schedule_expansion", f"""
WITH sc AS (SELECT family_id, 'FULL' AS arm, activation_date, threshold FROM x_sched
            UNION ALL SELECT family_id, 'HALF', activation_date, threshold / 2 FROM x_sched WHERE month(activation_date) % 2 = 1)
SELECT o.decision_date, o.ticker, o.family_id, o.model_id, s.arm, s.activation_date, {R('s.threshold', 2)} AS threshold
FROM x_ord o JOIN (SELECT *, lead(activation_date) OVER (PARTITION BY family_id, arm ORDER BY activation_date) AS nxt FROM sc) s
  ON s.family_id = o.family_id AND o.decision_date >= s.activation_date AND (s.nxt IS NULL OR o.decision_date < s.nxt)""")
def j3(r):
    s = r.schedule().select("family_id", "activation_date", "threshold")
    half = s.where(F.month("activation_date") % 2 == 1).withColumn("threshold", F.col("threshold") / 2)
    arms = s.withColumn("arm", F.lit("FULL")).unionByName(half.withColumn("arm", F.lit("HALF")))
    return jn.causal_schedule_expansion(r.order_signals(), arms).select(
        "decision_date", "ticker", "family_id", "model_id", "arm", "activation_date", rnd("threshold", 2).alias("threshold"))


@query("j4_strictly_prior_asof", f"""
SELECT o.decision_date, o.family_id, {R('o.top', 2)} AS raw_threshold, s.activation_date AS source_date,
       {R('CASE WHEN s.threshold IS NULL THEN o.top ELSE least(o.top, s.threshold) END', 2)} AS effective_threshold
FROM (SELECT decision_date, family_id, max(score) AS top FROM x_ord GROUP BY 1, 2) o
ASOF LEFT JOIN x_sched s ON o.family_id = s.family_id AND o.decision_date > s.activation_date""")
def j4(r):
    tops = r.order_signals().groupBy("decision_date", "family_id").agg(F.max("score").alias("top"))
    out = ao.asof_join(tops, r.schedule().drop("model_id"), ["family_id"], "decision_date", "activation_date", strict=True)
    return out.select("decision_date", "family_id", rnd("top", 2).alias("raw_threshold"), F.col("activation_date").alias("source_date"),
                      rnd(F.least("top", "threshold"), 2).alias("effective_threshold"))


@query("j5_metadata_before_entry", """
SELECT t.trade_id, t.ticker, t.entry_date, p.day AS known_at, p.flag AS meta
FROM x_trades t ASOF LEFT JOIN (SELECT CAST(l_shipdate AS DATE) AS day, l_suppkey AS ticker, max(l_returnflag) AS flag FROM lineitem GROUP BY 1, 2) p
ON p.ticker = t.ticker AND t.entry_date > p.day""")
def j5(r):
    meta = r.table("lineitem").groupBy(F.to_date("l_shipdate").alias("known_at"), F.col("l_suppkey").alias("ticker")).agg(
        F.max("l_returnflag").alias("meta"))
    trades = r.trades().select("trade_id", "ticker", "entry_date")
    return ao.asof_join(trades, meta, ["ticker"], "entry_date", "known_at", strict=True)


@query("j6_cardinality_checked_join", """
SELECT o_orderpriority, c_mktsegment, count(*) AS n_rows FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""")
def j6(r):
    left = r.table("orders").select(F.col("o_custkey").alias("k"), "o_orderpriority")
    right = r.table("customer").select(F.col("c_custkey").alias("k"), "c_mktsegment")
    return checked_join(left, right, ["k"], cardinality="m:1").groupBy("o_orderpriority", "c_mktsegment").agg(
        F.count(F.lit(1)).alias("n_rows"))


@query("j6_duplicate_key_audit", """
SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def j6_dups(r):
    from chronopanel.contracts import duplicate_keys
    return duplicate_keys(r.table("lineitem"), ["l_orderkey", "l_linenumber"])


@query("j7_matured_expansion", f"""
WITH base AS (SELECT o.family_id, CAST(date_trunc('week', o.decision_date) AS DATE) AS decision_date, o.ticker, max(o.score) AS score
              FROM x_ord o ASOF JOIN x_sched s ON o.family_id = s.family_id AND o.decision_date >= s.activation_date
              WHERE o.model_id = s.model_id GROUP BY 1, 2, 3),
m AS (SELECT b.*, x.terminal_date, x.excess FROM base b JOIN x_outcomes x ON x.decision_date = b.decision_date AND x.ticker = b.ticker
      WHERE x.terminal_date <= DATE '2000-12-31')
SELECT m.family_id, variant, count(*) AS n_rows, {R('avg(excess)')} AS mean_excess, max(terminal_date) AS latest_terminal
FROM m JOIN (SELECT DISTINCT c_mktsegment AS family_id, 'N' || (c_nationkey % 5) AS variant FROM customer) v USING (family_id) GROUP BY 1, 2""")
def j7(r):
    variants = r.table("customer").select(F.col("c_mktsegment").alias("family_id"),
                                          F.concat(F.lit("N"), F.col("c_nationkey") % 5).alias("variant")).distinct()
    base = jn.authoritative_signals(r.order_signals(), r.schedule()).groupBy(
        "family_id", week("decision_date").alias("decision_date"), "ticker").agg(F.max("score").alias("score"))
    return jn.matured_expansion(base, r.outcomes(), variants, "2000-12-31").select(
        "family_id", "variant", "n_rows", rnd("mean_excess").alias("mean_excess"), "latest_terminal")


@query("j8_distribution_interval_join", f"""
SELECT t.trade_id, t.ticker, count(*) AS n_events, {R('sum(d.cash)', 2)} AS cash FROM x_trades t
JOIN (SELECT ticker, ex_date, sum(cash) AS cash FROM x_dists GROUP BY 1, 2) d
  ON d.ticker = t.ticker AND d.ex_date > t.entry_date AND d.ex_date <= t.exit_date GROUP BY 1, 2""")
def j8(r):
    events = r.distributions().groupBy("ticker", "ex_date").agg(F.sum("cash").alias("cash"))
    hits = ao.interval_join(r.trades(), events, ["ticker"], "entry_date", "exit_date", "ex_date")
    return hits.groupBy("trade_id", "ticker").agg(F.count(F.lit(1)).alias("n_events"), rnd(F.sum("cash"), 2).alias("cash"))


@query("j9_lag_pairs", f"""
WITH p AS (SELECT *, dense_rank() OVER (PARTITION BY arm ORDER BY assessment_date) AS pos FROM x_month)
SELECT a.family_id, a.arm, a.assessment_date, b.assessment_date AS future_date, {R('b.rel / a.rel - 1')} AS change
FROM p a JOIN p b ON a.family_id = b.family_id AND a.arm = b.arm AND b.pos = a.pos + 3""")
def j9(r):
    pairs = jn.lag_pairs(r.monthly().select("family_id", "arm", "assessment_date", "rel"), ["arm"], ["family_id"],
                         "assessment_date", 3, ["rel"])
    return pairs.select("family_id", "arm", "assessment_date", F.col("future_assessment_date").alias("future_date"),
                        rnd(F.col("future_rel") / F.col("rel") - 1).alias("change"))


@query("j10_bucket_pairs", f"""
SELECT a.decision_date, a.ticker, a.arm, a.h_bucket AS bucket_a, b.h_bucket AS bucket_b, {R('a.score - b.score')} AS score_diff,
       {R('a.realized - b.realized')} AS realized_diff
FROM x_sets a JOIN x_sets b ON a.decision_date = b.decision_date AND a.ticker = b.ticker AND a.arm = b.arm
 AND CASE a.h_bucket WHEN 'SHORT' THEN 1 WHEN 'MID' THEN 2 ELSE 3 END < CASE b.h_bucket WHEN 'SHORT' THEN 1 WHEN 'MID' THEN 2 ELSE 3 END""")
def j10(r):
    return jn.bucket_pairs(r.sets(), ["decision_date", "ticker", "arm"]).select(
        "decision_date", "ticker", "arm", "bucket_a", "bucket_b", rnd("score_diff").alias("score_diff"),
        rnd("realized_diff").alias("realized_diff"))


@query("j11_outer_reconciliation", f"""
SELECT coalesce(a.date, b.date) AS date, coalesce(a.ticker, b.ticker) AS ticker,
       CASE WHEN b.ticker IS NULL THEN 'LEFT_ONLY' WHEN a.ticker IS NULL THEN 'RIGHT_ONLY' ELSE 'BOTH' END AS side,
       {R('a.close - b.close')} AS close_diff
FROM x_prices a FULL JOIN (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS date, o_custkey AS ticker, min(o_totalprice) / 5000.0 AS close
                           FROM orders GROUP BY 1, 2) b ON a.date = b.date AND a.ticker = b.ticker""")
def j11(r):
    other = r.table("orders").groupBy(week("o_orderdate").alias("date"), F.col("o_custkey").alias("ticker")).agg(
        (F.min("o_totalprice") / 5000.0).alias("close"))
    out = jn.reconcile(r.prices().select("date", "ticker", "close"), other, ["date", "ticker"], ["close"])
    return out.select("date", "ticker", "side", rnd(F.col("left_close") - F.col("right_close")).alias("close_diff"))


@query("j12_realized_outcomes", f"""
SELECT s.decision_date, s.ticker, o.entry_date, o.terminal_date, {R('o.stock_return')} AS stock_return, {R('o.bench_return')} AS bench_return,
       {R('o.excess')} AS excess FROM x_signals s JOIN x_outcomes o USING (decision_date, ticker)""")
def j12(r):
    return r.panel().select("decision_date", "ticker", "entry_date", "terminal_date", rnd("stock_return").alias("stock_return"),
                            rnd("bench_return").alias("bench_return"), rnd("excess").alias("excess"))


SURF_CELL = "SELECT h, d, treatment, median(cagr_excess) AS med, quantile_cont(cagr_excess, 0.25) AS q25, median(turnover) AS turn FROM x_surf GROUP BY 1, 2, 3"


@query("j13_paired_baseline", f"""
WITH c AS ({SURF_CELL})
SELECT a.h, a.d, a.treatment, {R('a.med - b.med')} AS delta_median, {R('a.q25 - b.q25')} AS delta_q25, {R('a.turn - b.turn')} AS delta_turnover,
       a.treatment <> 'N' AND {R('a.med - b.med')} > 0 AS beats_baseline
FROM c a JOIN c b ON a.h = b.h AND a.d = b.d AND b.treatment = 'N'""")
def j13(r):
    from chronopanel.functions.stats import median, quantile
    cells = r.surface().groupBy("h", "d", "treatment").agg(
        median("cagr_excess").alias("med"), quantile("cagr_excess", 0.25).alias("q25"), median("turnover").alias("turn"))
    out = jn.paired_baseline(cells, ["h", "d"], "treatment", "N", ["med", "q25", "turn"])
    return out.select("h", "d", "treatment", rnd("delta_med").alias("delta_median"), rnd("delta_q25").alias("delta_q25"),
                      rnd("delta_turn").alias("delta_turnover"),
                      ((F.col("treatment") != "N") & (rnd("delta_med") > 0)).alias("beats_baseline"))


@query("j14_arm_contrasts", f"""
SELECT h, fold, {R("avg(cagr_excess) FILTER (treatment = 'N') - avg(cagr_excess) FILTER (treatment = 'A')")} AS f_minus_a,
       {R("avg(cagr_excess) FILTER (treatment = 'R') - avg(cagr_excess) FILTER (treatment = 'N')")} AS m_minus_f
FROM x_surf GROUP BY 1, 2""")
def j14(r):
    wide = r.surface().groupBy("h", "fold").pivot("treatment", ["A", "N", "R"]).agg(F.avg("cagr_excess"))
    return wide.select("h", "fold", rnd(F.col("N") - F.col("A")).alias("f_minus_a"), rnd(F.col("R") - F.col("N")).alias("m_minus_f"))


@query("j15_executed_flag", """
SELECT s.decision_date, count(*) AS n_rows, count(*) FILTER (t.ticker IS NOT NULL) AS executed
FROM x_signals s LEFT JOIN (SELECT DISTINCT ticker, entry_date FROM x_trades) t ON t.ticker = s.ticker AND t.entry_date = s.decision_date GROUP BY 1""")
def j15(r):
    done = r.trades().select("ticker", F.col("entry_date").alias("decision_date")).distinct()
    flagged = jn.executed_flag(r.signals(), done, ["ticker", "decision_date"])
    return flagged.groupBy("decision_date").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("trade_executed").alias("executed"))


@query("j16_position_sessions", f"""
WITH e AS (SELECT t.*, s.idx, s.date FROM x_trades t JOIN x_sessions s ON s.date BETWEEN t.entry_date AND t.exit_date),
p AS (SELECT p.*, s.idx FROM x_prices p JOIN x_sessions s USING (date)),
v AS (SELECT e.trade_id, e.ticker, e.date, e.date = e.entry_date AS is_entry, e.date = e.exit_date AS is_exit,
      CASE WHEN e.date = e.entry_date THEN c.open ELSE b.close END AS base, CASE WHEN e.date = e.exit_date THEN c.open ELSE c.close END AS term
      FROM e JOIN p c ON c.ticker = e.ticker AND c.idx = e.idx LEFT JOIN p b ON b.ticker = e.ticker AND b.idx = e.idx - 1)
SELECT trade_id, ticker, date, is_entry, is_exit, {R('term / base - 1')} AS interval_return FROM v WHERE base IS NOT NULL""")
def j16(r):
    r.share("prices", "trades")
    return jn.position_sessions(r.trades(), r.prices(), r.sessions()).select(
        "trade_id", "ticker", "date", "is_entry", "is_exit", rnd("interval_return").alias("interval_return"))


@query("j17_forward_asof", """
SELECT ticker, ex_date, payable_date, (SELECT min(date) FROM x_sessions s WHERE s.date >= payable_date) AS payment_session FROM x_dists""")
def j17(r):
    d = r.distributions().select("ticker", "ex_date", "payable_date")
    return ao.forward_asof(d, r.sessions().select(F.col("date").alias("payment_session")), "payable_date", "payment_session")


RANKED = """
l AS (SELECT decision_date, ticker, 1 - (rank() OVER (PARTITION BY decision_date ORDER BY score DESC)
        + (count(*) OVER (PARTITION BY decision_date, score) - 1) / 2.0) / count(*) OVER (PARTITION BY decision_date) AS pl FROM x_signals),
v AS (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS decision_date, l_suppkey AS ticker, sum(l_quantity) AS score FROM lineitem GROUP BY 1, 2),
q AS (SELECT decision_date, ticker, 1 - (rank() OVER (PARTITION BY decision_date ORDER BY score DESC)
        + (count(*) OVER (PARTITION BY decision_date, score) - 1) / 2.0) / count(*) OVER (PARTITION BY decision_date) AS pq FROM v)"""


def second_model(r):
    return r.table("lineitem").groupBy(week("l_shipdate").alias("decision_date"), F.col("l_suppkey").alias("ticker")).agg(
        F.sum("l_quantity").alias("score"))


@query("j18_intersection_blend", f"""
WITH {RANKED} SELECT decision_date, ticker, {R('least(pl, pq)')} AS score FROM l JOIN q USING (decision_date, ticker) WHERE pl >= 0.5 AND pq >= 0.5""")
def j18(r):
    r.share("signals")
    a, b = jn.daily_percentile(r.signals(), "pl"), jn.daily_percentile(second_model(r), "pq")
    return jn.intersection_blend(a, b, "pl", "pq", 0.5).select("decision_date", "ticker", rnd("score").alias("score"))


@query("j19_percentile_blend", f"""
WITH {RANKED} SELECT decision_date, ticker, {R('0.5 * pl + 0.5 * pq')} AS score FROM l JOIN q USING (decision_date, ticker)""")
def j19(r):
    r.share("signals")
    a, b = jn.daily_percentile(r.signals(), "pl"), jn.daily_percentile(second_model(r), "pq")
    return (a.select("decision_date", "ticker", "pl").join(b.select("decision_date", "ticker", "pq"), ["decision_date", "ticker"])
            .select("decision_date", "ticker", rnd(0.5 * F.col("pl") + 0.5 * F.col("pq")).alias("score")))


@query("j20_fallback_repair", """
WITH f AS (SELECT CAST(o_orderdate AS DATE) AS day, o_custkey AS ticker FROM orders GROUP BY 1, 2)
SELECT CASE WHEN p.vol < 5 AND f.day IS NOT NULL THEN 'fallback' ELSE 'primary' END AS provider, p.vol >= 5 AS quality_ok, count(*) AS n_rows
FROM x_daily p LEFT JOIN f USING (day, ticker) GROUP BY 1, 2""")
def j20(r):
    from chronopanel.sources.scans import repair_with_fallback
    primary = r.daily().select("day", "ticker", "lo", (F.col("vol") >= 5).alias("quality_ok"))
    fallback = r.table("orders").groupBy(F.to_date("o_orderdate").alias("day"), F.col("o_custkey").alias("ticker")).agg(
        F.min("o_totalprice").alias("lo"))
    return repair_with_fallback(primary, fallback, ["day", "ticker"], "lo", "quality_ok").groupBy("provider", "quality_ok").agg(
        F.count(F.lit(1)).alias("n_rows"))


@query("j21_semi_anti_filters", """
SELECT decision_date, count(*) AS n_rows FROM x_signals s
WHERE ticker IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)
  AND NOT EXISTS (SELECT 1 FROM x_dists d WHERE d.ticker = s.ticker AND d.ex_date = s.decision_date) GROUP BY 1""")
def j21(r):
    eligible = r.table("supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("ticker"))
    excluded = r.distributions().select("ticker", F.col("ex_date").alias("decision_date"))
    kept = r.signals().join(eligible, "ticker", "left_semi").join(excluded, ["ticker", "decision_date"], "left_anti")
    return kept.groupBy("decision_date").agg(F.count(F.lit(1)).alias("n_rows"))


BAND = "CASE WHEN {0} <= 5 THEN '{1}01_05' WHEN {0} <= 10 THEN '{1}06_10' WHEN {0} <= 20 THEN '{1}11_20' ELSE '{1}21_30' END"


@query("j22_cluster_membership", f"""
WITH m AS (SELECT family_id, CAST(substr(family_id, 2, 2) AS INT) AS h, CAST(substr(family_id, 6, 2) AS INT) AS d, substr(family_id, 10, 2) AS n, substr(family_id, 13) AS e FROM x_fam),
b AS (SELECT *, {BAND.format('h', 'H')} AS hb, {BAND.format('d', 'D')} AS db,
      CASE WHEN h <= 5 THEN 'FAST' WHEN h <= 10 THEN 'SHORT' WHEN h <= 20 THEN 'MID' ELSE 'LONG' END AS region FROM m)
SELECT family_id, 'FAMILY' AS cluster_level, 'FAMILY::' || family_id AS cluster_id FROM b
UNION ALL SELECT family_id, 'H_BAND', 'H_BAND::' || hb FROM b
UNION ALL SELECT family_id, 'HD_GRID', 'HD_GRID::' || hb || '::' || db || '::N' || n || '::' || e FROM b
UNION ALL SELECT family_id, 'ECONOMIC_REGION', 'ECONOMIC_REGION::' || region || '::' || db FROM b""")
def j22(r):
    from chronopanel.sources.scans import family_metadata
    return jn.cluster_membership(family_metadata(r.families()))


@query("j23_state_join", f"""
SELECT m.family_id, m.arm, m.date, {R('l.b1')} AS bench_lag1, {R('l.ret4')} AS bench_ret4 FROM x_month m
LEFT JOIN (SELECT date, lag(bench_value) OVER (ORDER BY date) AS b1, lag(bench_value) OVER (ORDER BY date) / lag(bench_value, 5) OVER (ORDER BY date) - 1 AS ret4
           FROM (SELECT DISTINCT date, bench_value FROM x_nav)) l USING (date)""")
def j23(r):
    w = Window.orderBy("date")
    state = r.bench_nav().select("date", F.lag("bench_value").over(w).alias("b1"),
                                 (F.lag("bench_value").over(w) / F.lag("bench_value", 5).over(w) - 1).alias("ret4"))
    return r.monthly().select("family_id", "arm", "date").join(state, "date", "left").select(
        "family_id", "arm", "date", rnd("b1").alias("bench_lag1"), rnd("ret4").alias("bench_ret4"))


@query("j24_old_new_scores", f"""
WITH v AS (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS decision_date, l_suppkey AS ticker, sum(l_quantity) AS score FROM lineitem GROUP BY 1, 2),
a AS (SELECT *, row_number() OVER (PARTITION BY decision_date ORDER BY score DESC, ticker) AS rn FROM x_signals),
b AS (SELECT *, row_number() OVER (PARTITION BY decision_date ORDER BY score DESC, ticker) AS rn FROM v),
k AS (SELECT decision_date, count(*) FILTER (a.rn <= 5 AND b.rn <= 5) AS k_both, count(*) FILTER (a.rn <= 5 OR b.rn <= 5) AS k_any,
      avg(a.score) AS ma, avg(b.score) AS mb FROM a JOIN b USING (decision_date, ticker) GROUP BY 1)
SELECT decision_date, {R('k_both / k_any')} AS top_jaccard, {R('ma')} AS old_mean, {R('mb')} AS new_mean FROM k""")
def j24(r):
    r.share("signals")
    return jn.score_overlap(r.signals(), second_model(r), top=5).select(
        "decision_date", rnd("jaccard").alias("top_jaccard"), rnd("old_mean").alias("old_mean"), rnd("new_mean").alias("new_mean"))


@query("j25_paired_rules", f"""
SELECT a.h, a.d, a.fold, {R('a.cagr_excess - a.turnover * 0.002 - (b.cagr_excess - b.turnover * 0.002)')} AS difference
FROM x_surf a JOIN x_surf b ON a.h = b.h AND a.d = b.d AND a.fold = b.fold AND a.treatment = 'R' AND b.treatment = 'A'""")
def j25(r):
    net = r.surface().withColumn("net", F.col("cagr_excess") - F.col("turnover") * 0.002)
    return jn.rule_difference(net, ["h", "d", "fold"], "treatment", "R", "A", "net").select(
        "h", "d", "fold", rnd("difference").alias("difference"))
