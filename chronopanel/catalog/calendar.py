"""Calendar, maturity and walk-forward operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronopanel.catalog.registry import R, query
from chronopanel.functions.rounding import rnd
from chronopanel.operators import calendar as cal
from chronopanel.operators import schedules as sch
from chronopanel.operators.asof import asof_join
from chronopanel.operators.digests import digest_sql


@query("t1_terminal_session", """
SELECT s.decision_date, s.ticker, t.date AS terminal_date FROM x_signals s
JOIN x_sessions d ON d.date = s.decision_date LEFT JOIN x_sessions t ON t.idx = d.idx + 4""")
def t1(r):
    return cal.attach_terminal(r.signals(), r.sessions(), 4).select("decision_date", "ticker", "terminal_date")


CUTOFFS = "SELECT max(CAST(o_orderdate AS DATE)) AS cutoff FROM orders GROUP BY date_trunc('month', o_orderdate)"


def month_cutoffs(r):
    return (r.table("orders").groupBy(F.trunc("o_orderdate", "month"))
            .agg(F.max(F.to_date("o_orderdate")).alias("cutoff")).select("cutoff"))


@query("t2_latest_matured_decision", f"""
WITH c AS ({CUTOFFS}), pos AS (SELECT cutoff, (SELECT max(idx) FROM x_sessions s WHERE s.date <= cutoff) AS idx FROM c)
SELECT cutoff, CAST(h AS INT) AS horizon, s.date AS latest_decision
FROM pos CROSS JOIN (SELECT unnest([1, 5, 20]) AS h) LEFT JOIN x_sessions s ON s.idx = pos.idx - h WHERE pos.idx IS NOT NULL""")
def t2(r):
    return cal.latest_matured(month_cutoffs(r), r.sessions(), [1, 5, 20])


@query("t3_maturity_filter", f"""
SELECT decision_date, count(*) AS n_rows, {R('avg(excess)')} AS mean_excess FROM x_panel
WHERE terminal_date <= DATE '1998-06-30' GROUP BY 1""")
def t3(r):
    known = cal.matured(r.panel(), F.to_date(F.lit("1998-06-30")))
    return known.groupBy("decision_date").agg(F.count(F.lit(1)).alias("n_rows"), rnd(F.avg("excess")).alias("mean_excess"))


@query("t3_mature_sessions", """
SELECT d.date AS decision_date, t.date AS terminal_date FROM x_sessions d JOIN x_sessions t ON t.idx = d.idx + 20
WHERE t.date <= DATE '1999-12-31'""")
def t3_sessions(r):
    s = r.sessions().withColumnRenamed("date", "decision_date")
    return cal.matured(cal.attach_terminal(s, r.sessions(), 20), F.to_date(F.lit("1999-12-31"))).select(
        "decision_date", "terminal_date")


@query("t4_fold_availability", """
SELECT CAST(year(s.decision_date) AS INT) AS fold_id, CASE WHEN bool_and(t.date IS NOT NULL) THEN max(t.date) END AS available_at,
       count(*) AS n_rows
FROM x_signals s JOIN x_sessions d ON d.date = s.decision_date LEFT JOIN x_sessions t ON t.idx = d.idx + 4 GROUP BY 1""")
def t4(r):
    df = cal.attach_terminal(r.signals(), r.sessions(), 4).withColumn("fold_id", F.year("decision_date"))
    return cal.fold_availability(df)


@query("t5_evidence_snapshot", f"""
WITH c AS (SELECT max(date) AS cutoff FROM x_sessions GROUP BY year(date)),
v AS (SELECT cutoff, excess, terminal_date, CAST(year(decision_date) AS VARCHAR) AS fold_id FROM c JOIN x_panel ON terminal_date <= cutoff),
d AS (SELECT cutoff, {digest_sql('fold_id')} AS fingerprint FROM (SELECT DISTINCT cutoff, fold_id FROM v) GROUP BY 1)
SELECT cutoff, count(*) AS n_rows, count(DISTINCT fold_id) AS n_folds, max(terminal_date) AS latest_terminal, {R('avg(excess)')} AS mean_excess, any_value(fingerprint) AS fingerprint
FROM v JOIN d USING (cutoff) GROUP BY 1""")
def t5(r):
    cutoffs = r.sessions().groupBy(F.year("date")).agg(F.max("date").alias("cutoff")).select("cutoff")
    return sch.evidence_snapshots(r.panel().withColumn("fold_id", F.year("decision_date").cast("string")), cutoffs).select(
        "cutoff", "n_rows", "n_folds", "latest_terminal", rnd("mean_excess").alias("mean_excess"), "fingerprint")


@query("t6_refit_dates", """
SELECT CAST(date_trunc('month', date) AS DATE) AS period, min(date) AS first_session, max(date) AS last_session
FROM x_sessions GROUP BY 1""")
def t6(r):
    return cal.period_dates(r.sessions())


@query("t6_assessment_dates", """
SELECT date, idx FROM x_sessions WHERE (idx + 1) % 10 = 0 OR idx = (SELECT max(idx) FROM x_sessions)""")
def t6_nth(r):
    return cal.every_nth(r.sessions(), 10)


@query("t7_session_maps", """
SELECT s.date, n.date AS next_session, p.date AS previous_session FROM x_sessions s
LEFT JOIN x_sessions n ON n.idx = s.idx + 1 LEFT JOIN x_sessions p ON p.idx = s.idx - 1""")
def t7(r):
    s = r.sessions()
    return cal.shift_sessions(s, 1, "next_session").join(cal.shift_sessions(s, -1, "previous_session"), "date")


@query("t8_expanding_folds", """
WITH RECURSIVE f AS (
  SELECT 0 AS fold, 108 AS vs WHERE (SELECT max(idx) FROM x_sessions) >= 108 + 26 - 1
  UNION ALL SELECT fold + 1, vs + 26 FROM f WHERE vs + 26 + 25 <= (SELECT max(idx) FROM x_sessions))
SELECT CAST(fold AS BIGINT) AS fold, a.date AS train_end, b.date AS valid_start, c.date AS valid_end
FROM f JOIN x_sessions a ON a.idx = vs - 5 JOIN x_sessions b ON b.idx = vs JOIN x_sessions c ON c.idx = vs + 25""")
def t8(r):
    s = r.sessions()
    folds = cal.expanding_folds(s, train=104, validation=26, step=26, purge=4)
    for c in ("train_end", "valid_start", "valid_end"):
        at = s.select(F.col("idx").alias(c), F.col("date").alias(f"_{c}"))
        folds = folds.join(at, c).drop(c).withColumnRenamed(f"_{c}", c)
    return folds.select("fold", "train_end", "valid_start", "valid_end")


@query("t9_train_calibration_split", f"""
WITH c AS (SELECT idx AS c FROM x_sessions WHERE (idx + 1) % 26 = 0),
     p AS (SELECT x.*, s.idx FROM x_panel x JOIN x_sessions s ON s.date = x.decision_date)
SELECT c AS cutoff_idx, CASE WHEN idx > c - 26 THEN 'CALIBRATION' ELSE 'TRAIN' END AS part, count(*) AS n_rows,
       {R('avg(excess)')} AS mean_excess
FROM c JOIN p ON (idx > c - 26 AND idx <= c) OR (idx > c - 26 - 4 - 104 AND idx <= c - 26 - 4) GROUP BY 1, 2""")
def t9(r):
    s = r.sessions()
    cut = s.where("(idx + 1) % 26 = 0").select(F.col("idx").alias("cutoff_idx"))
    parts = sch.train_calibration_split(s, cut, train=104, purge=4, calibration=26)
    return (r.panel().groupBy("decision_date").agg(F.count(F.lit(1)).alias("n"), F.sum("excess").alias("s"))
            .join(parts, "decision_date").groupBy("cutoff_idx", "part")
            .agg(F.sum("n").alias("n_rows"), rnd(F.sum("s") / F.sum("n")).alias("mean_excess")))


@query("t10_fixed_cohorts", f"""
WITH p AS (SELECT x.*, (s.idx - 1) // 21 AS cohort FROM x_panel x JOIN x_sessions s ON s.date = x.decision_date WHERE s.idx >= 1),
     k AS (SELECT cohort, count(*) AS n_rows, {R('avg(greatest(least(excess, 0.2), -0.2))')} AS clipped_excess, max(terminal_date) AS matured_at
           FROM p GROUP BY 1)
SELECT CAST(cohort AS BIGINT) AS cohort, n_rows, clipped_excess, matured_at,
       row_number() OVER (ORDER BY cohort DESC) <= 12 AS in_last_12 FROM k WHERE matured_at <= DATE '2001-06-30'""")
def t10(r):
    return sch.cohort_evidence(r.panel(), r.sessions(), length=21, keep=12, cap=0.2, cutoff="2001-06-30").select(
        "cohort", "n_rows", rnd("clipped_excess").alias("clipped_excess"), "matured_at", "in_last_12")


@query("t11_fold_ranges", """
SELECT arm AS fold_id, min(entry_date) AS start_date, max(exit_date) AS end_date, count(*) AS n_rows,
       row_number() OVER (ORDER BY min(entry_date), arm) AS fold_order FROM x_trades GROUP BY 1""")
def t11(r):
    ranges = r.trades().groupBy(F.col("arm").alias("fold_id")).agg(
        F.min("entry_date").alias("start_date"), F.max("exit_date").alias("end_date"), F.count(F.lit(1)).alias("n_rows"))
    return ranges.withColumn("fold_order", F.row_number().over(Window.orderBy("start_date", "fold_id")).cast("long"))


@query("t12_refit_events", f"""
SELECT family_id, activation_date, lag(model_id) OVER w AS old_model, model_id AS new_model,
       {R('threshold - lag(threshold) OVER w', 2)} AS threshold_delta, lead(activation_date) OVER w AS interval_end,
       coalesce(model_id <> lag(model_id) OVER w, false) AS model_changed
FROM x_sched WINDOW w AS (PARTITION BY family_id ORDER BY activation_date)""")
def t12(r):
    return sch.refit_events(r.schedule()).select("family_id", "activation_date", "old_model", "new_model",
                                                 rnd("threshold_delta", 2).alias("threshold_delta"),
                                                 "interval_end", "model_changed")


@query("t13_abc_schedules", f"""
WITH cal AS (SELECT family_id, min(decision_date) AS activation_date, quantile_cont(top, 0.9) AS threshold
             FROM (SELECT family_id, decision_date, max(score) AS top FROM x_ord GROUP BY 1, 2)
             GROUP BY family_id, date_trunc('quarter', decision_date)),
     fz AS (SELECT family_id, arg_min(model_id, activation_date) AS model_id, min(activation_date) AS activation_date,
                   arg_min(threshold, activation_date) AS threshold FROM x_sched GROUP BY 1)
SELECT family_id, 'A_FROZEN' AS arm, model_id, activation_date, {R('threshold', 2)} AS threshold FROM fz
UNION ALL SELECT cal.family_id, 'B_RECALIBRATED', fz.model_id, cal.activation_date, {R('cal.threshold', 2)} FROM cal JOIN fz USING (family_id)
UNION ALL SELECT family_id, 'C_REFIT', model_id, activation_date, {R('threshold', 2)} FROM x_sched""")
def t13(r):
    top = r.order_signals().groupBy("family_id", "decision_date").agg(F.max("score").alias("top"))
    calibrations = (top.groupBy("family_id", F.trunc("decision_date", "quarter"))
                    .agg(F.min("decision_date").alias("activation_date"), F.expr("percentile(top, 0.9)").alias("threshold"))
                    .select("family_id", "activation_date", "threshold"))
    return sch.arm_schedules(r.schedule(), calibrations).select("family_id", "arm", "model_id", "activation_date",
                                                                rnd("threshold", 2).alias("threshold"))


T14_TOPS = """
tops AS (SELECT s.family_id, s.decision_date, t.date AS terminal_date, top, count_rows FROM (
           SELECT family_id, CAST(date_trunc('week', decision_date) AS DATE) AS decision_date, max(score) AS top, count(*) AS count_rows
           FROM x_ord GROUP BY 1, 2) s JOIN x_sessions d ON d.date = s.decision_date JOIN x_sessions t ON t.idx = d.idx + 4)"""


def weekly_tops(r):
    tops = (r.order_signals().groupBy("family_id", F.date_trunc("week", "decision_date").cast("date").alias("decision_date"))
            .agg(F.max("score").alias("top"), F.count(F.lit(1)).alias("count_rows")))
    return cal.attach_terminal(tops, r.sessions(), 4)


@query("t14_recalibration", f"""
WITH {T14_TOPS}, c AS (SELECT DISTINCT CAST(date_trunc('quarter', date) AS DATE) AS cutoff FROM x_sessions),
w AS (SELECT c.cutoff, tops.*, row_number() OVER (PARTITION BY c.cutoff, family_id ORDER BY decision_date DESC) AS rn
      FROM c JOIN tops ON terminal_date <= cutoff)
SELECT cutoff, family_id, {R('quantile_cont(top, 0.9)', 2)} AS threshold, count(*) AS window_days, min(decision_date) AS calibration_start,
       max(decision_date) AS calibration_end, max(terminal_date) AS latest_terminal
FROM w WHERE rn <= 60 GROUP BY 1, 2""")
def t14(r):
    cutoffs = r.sessions().select(F.trunc("date", "quarter").alias("cutoff")).distinct()
    return sch.recalibrate(weekly_tops(r), cutoffs, window=60, quantile=0.9).select(
        "cutoff", "family_id", rnd("threshold", 2).alias("threshold"), "window_days", "calibration_start",
        "calibration_end", "latest_terminal")


@query("t15_entry_policy_search", f"""
WITH day AS (SELECT decision_date, count(*) AS n, max(score) AS top FROM x_panel GROUP BY 1),
g AS (SELECT q, f FROM (SELECT unnest([0.2, 0.5, 0.8]) AS q) CROSS JOIN (SELECT unnest([0.02, 0.1]) AS f)),
th AS (SELECT q, f, CASE q WHEN 0.2 THEN (SELECT quantile_cont(top, 0.2) FROM day) WHEN 0.5 THEN (SELECT quantile_cont(top, 0.5) FROM day)
                    ELSE (SELECT quantile_cont(top, 0.8) FROM day) END AS threshold FROM g),
rk AS (SELECT p.*, n, row_number() OVER (PARTITION BY decision_date ORDER BY score DESC, ticker) AS rn FROM x_panel p JOIN day USING (decision_date)),
pk AS (SELECT q, f, threshold, decision_date, avg(excess) AS v FROM th JOIN rk ON score >= threshold AND rn <= least(5, greatest(1, ceil(n * f)))
       GROUP BY 1, 2, 3, 4),
dd AS (SELECT th.q, th.f, th.threshold, day.decision_date, coalesce(v, 0) AS v, (v IS NOT NULL)::INT AS active
       FROM th CROSS JOIN day LEFT JOIN pk ON pk.q = th.q AND pk.f = th.f AND pk.decision_date = day.decision_date),
mm AS (SELECT q, f, threshold, date_trunc('month', decision_date) AS m, avg(v) AS mv, sum(active) AS active FROM dd GROUP BY 1, 2, 3, 4),
s AS (SELECT q, f, threshold, sum(active) AS active_dates, count(*) AS month_count, {R('median(mv)')} AS median_month, {R('quantile_cont(mv, 0.25)')} AS q25_month,
      {R('avg((mv > 0)::INT)')} AS positive_fraction, {R('min(mv)')} AS worst_month FROM mm GROUP BY 1, 2, 3)
SELECT CAST(q AS DOUBLE) AS quantile, CAST(f AS DOUBLE) AS top_fraction, {R('threshold')} AS threshold, CAST(active_dates AS BIGINT) AS active_dates, month_count, median_month,
       q25_month, positive_fraction, worst_month,
       row_number() OVER (ORDER BY median_month DESC, q25_month DESC, positive_fraction DESC, worst_month DESC, active_dates, q DESC, f) AS rank
FROM s WHERE active_dates >= 8""")
def t15(r):
    from chronopanel.operators.gates import entry_policy_search
    return entry_policy_search(r.panel(), [0.2, 0.5, 0.8], [0.02, 0.1], max_names=5, minimum_active=8)


T16_PREP = """
rows AS (SELECT *, score >= 0.9 AS accepted, row_number() OVER (PARTITION BY decision_date ORDER BY score DESC, ticker) <= greatest(1, ceil(n * 0.05)) AS relative
         FROM (SELECT *, count(*) OVER (PARTITION BY decision_date) AS n FROM x_panel)),
day AS (SELECT decision_date, max(terminal_date) AS terminal_date, count(*) AS n_rows, max(accepted::INT) AS crossing,
        quantile_cont(score, 0.99) AS p99, count(*) FILTER (relative) AS n_relative,
        count(*) FILTER (relative AND accepted) AS n_accepted, sum(excess) FILTER (relative AND accepted) AS s_accepted,
        count(*) FILTER (relative AND NOT accepted) AS n_shadow, coalesce(sum(excess) FILTER (relative AND NOT accepted), 0) AS s_shadow,
        count(*) FILTER (relative AND NOT accepted AND excess > 0) AS h_shadow
        FROM rows GROUP BY 1),
c AS (SELECT date AS assessment_date FROM x_sessions WHERE (idx + 1) % 10 = 0)"""


@query("t16_threshold_windows", f"""
WITH {T16_PREP},
w AS (SELECT assessment_date, day.*, row_number() OVER (PARTITION BY assessment_date ORDER BY decision_date DESC) AS rn
      FROM c JOIN day ON terminal_date <= assessment_date AND decision_date <= assessment_date),
l AS (SELECT assessment_date, CAST(lb AS INT) AS lookback, count(*) AS matured_days, CAST(sum(n_rows) AS BIGINT) AS evaluated_rows, avg(crossing) AS rate,
      CAST(sum(n_shadow) AS BIGINT) AS shadow_count, sum(s_shadow) / nullif(sum(n_shadow), 0) AS shadow_mean,
      sum(h_shadow) / nullif(sum(n_shadow), 0) AS shadow_hit, median(0.9 / p99) AS pressure
      FROM w CROSS JOIN (SELECT unnest([13, 26]) AS lb) WHERE rn <= lb GROUP BY 1, 2)
SELECT assessment_date, lookback, matured_days, evaluated_rows, {R('rate')} AS crossing_rate, shadow_count,
       {R('shadow_mean')} AS shadow_mean, {R('shadow_hit')} AS shadow_hit, {R('pressure')} AS median_pressure,
       CASE WHEN matured_days < 10 OR shadow_count < 5 THEN 'INSUFFICIENT_EVIDENCE'
            WHEN NOT (0.9 >= 0.01 AND rate < greatest(0.005, 0.25 * 0.9)) THEN 'NO_RESTRICTION_EVIDENCE'
            WHEN shadow_mean > 0 THEN 'TOO_RESTRICTIVE' ELSE 'RARE_SIGNAL' END AS verdict
FROM l""")
def t16(r):
    from chronopanel.operators.gates import daily_gate_summary, threshold_windows
    day = daily_gate_summary(r.panel(), threshold=0.9, top_fraction=0.05)
    return threshold_windows(day, cal.every_nth_only(r.sessions(), 10), [13, 26],
                             historical_rate=0.9, min_days=10, min_shadow=5, threshold=0.9)


@query("t17_weighted_evidence", f"""
WITH {T16_PREP},
w AS (SELECT assessment_date, day.*, row_number() OVER (PARTITION BY assessment_date ORDER BY decision_date DESC) AS rn
      FROM c JOIN day ON terminal_date <= assessment_date AND decision_date < assessment_date),
l AS (SELECT assessment_date, lb, wt, count(*) AS days, avg(crossing) AS rate, sum(n_shadow) AS shadow_count,
      sum(s_shadow) / nullif(sum(n_shadow), 0) AS shadow_mean, median(p99) AS p99
      FROM w CROSS JOIN (SELECT unnest([13, 26, 52]) AS lb, unnest([0.5, 0.3, 0.2]) AS wt) WHERE rn <= lb GROUP BY 1, 2, 3),
s AS (SELECT *, CASE WHEN days >= ceil(lb * 0.8) AND shadow_count >= 5 THEN (rate < greatest(0.005, 0.25 * 0.98) AND coalesce(shadow_mean, -1) > 0)::INT END AS signal FROM l)
SELECT assessment_date, {R('sum(wt * signal) / sum(CASE WHEN signal IS NOT NULL THEN wt END)')} AS weighted_evidence,
       {R('sum(wt * p99) / sum(wt)')} AS weighted_p99,
       coalesce(sum(wt * signal) / sum(CASE WHEN signal IS NOT NULL THEN wt END) >= 0.5, false) AS adapt_active,
       {R('CASE WHEN coalesce(sum(wt * signal) / sum(CASE WHEN signal IS NOT NULL THEN wt END) >= 0.5, false) THEN 0.95 * sum(wt * p99) / sum(wt) END')} AS replacement_threshold
FROM s GROUP BY 1""")
def t17(r):
    from chronopanel.operators.gates import daily_gate_summary, weighted_evidence
    day = daily_gate_summary(r.panel(), threshold=0.9, top_fraction=0.05)
    return weighted_evidence(day, cal.every_nth_only(r.sessions(), 10), {13: 0.5, 26: 0.3, 52: 0.2},
                             historical_rate=0.98, pressure=0.95, trigger=0.5, min_fraction=0.8, min_shadow=5)


@query("t18_gate_observation", f"""
WITH q AS (SELECT assessment_date, family_id, avg(r) AS quality, 1.0 / count(*) OVER (PARTITION BY assessment_date) AS prior_w, last(strategy_value ORDER BY date) AS nav
           FROM (SELECT *, last_day(date) AS assessment_date FROM x_nav) GROUP BY 1, 2),
m AS (SELECT *, median(quality) OVER (PARTITION BY assessment_date) AS center, nav / sum(nav) OVER (PARTITION BY assessment_date) AS adaptive_w FROM
      (SELECT assessment_date, family_id, avg(r) AS quality, sum(strategy_value) AS nav FROM (SELECT *, last_day(date) AS assessment_date FROM x_nav) GROUP BY 1, 2)),
s AS (SELECT assessment_date, any_value(center) AS center, 1.4826 * median(abs(quality - center)) AS mad, stddev_pop(quality) AS sd,
      avg(quality) AS prior_score, sum(adaptive_w * quality) AS adaptive_score FROM m GROUP BY 1),
z AS (SELECT *, CASE WHEN mad > 1e-12 THEN mad WHEN sd > 1e-12 THEN sd ELSE 1.0 END AS scale FROM s)
SELECT assessment_date, {R('center')} AS quality_center, {R('scale')} AS quality_scale, {R('prior_score')} AS prior_score,
       {R('adaptive_score')} AS adaptive_score, {R('greatest(least((adaptive_score - prior_score) / scale, 3.0), -3.0)')} AS advantage_z
FROM z""")
def t18(r):
    quality = (r.nav().groupBy(F.last_day("date").alias("assessment_date"), "family_id")
               .agg(F.avg("r").alias("quality"), F.sum("strategy_value").alias("weight")))
    return sch.gate_observation(quality, "assessment_date", clip=3.0)


@query("t20_visibility", f"""
WITH c AS (SELECT last_session AS t FROM (SELECT max(date) AS last_session FROM x_sessions GROUP BY date_trunc('quarter', date)))
SELECT t, family_id, count(*) AS visible, max(activation_date) AS latest,
       {digest_sql("strftime(activation_date, '%Y-%m-%d') || ':' || model_id")} AS fingerprint
FROM c JOIN x_sched ON activation_date <= t GROUP BY 1, 2""")
def t20(r):
    times = r.sessions().groupBy(F.trunc("date", "quarter")).agg(F.max("date").alias("t")).select("t")
    return sch.visible_generations(r.schedule(), times).select("t", "family_id", "visible", "latest", "fingerprint")


@query("t23_next_unseen_fold", f"""
WITH f AS (SELECT h, treatment, fold, avg(cagr_excess) AS metric FROM x_surf GROUP BY 1, 2, 3),
a AS (SELECT DISTINCT h, treatment, fold AS as_of FROM f)
SELECT a.h, a.treatment, a.as_of, min(f.fold) AS next_fold, {R('arg_min(f.metric, f.fold)')} AS next_metric
FROM a LEFT JOIN f ON f.h = a.h AND f.treatment = a.treatment AND f.fold > a.as_of GROUP BY 1, 2, 3""")
def t23(r):
    folds = r.surface().groupBy("h", "treatment", "fold").agg(F.avg("cagr_excess").alias("metric"))
    return sch.next_unseen_fold(folds, ["h", "treatment"], "fold").select(
        "h", "treatment", "as_of", "next_fold", rnd("metric").alias("next_metric"))


@query("t24_required_exit_keys", """
WITH p AS (SELECT decision_date, ticker, row_number() OVER (PARTITION BY decision_date ORDER BY score DESC, ticker) AS rn FROM x_signals)
SELECT DISTINCT t.date AS exit_check_date, p.ticker, CAST(3 - k AS INT) AS remaining
FROM p JOIN x_sessions d ON d.date = p.decision_date CROSS JOIN (SELECT unnest([0, 1, 2]) AS k)
JOIN x_sessions t ON t.idx = d.idx + 1 + k WHERE rn <= 3""")
def t24(r):
    from chronopanel.operators.gates import required_exit_keys
    return required_exit_keys(r.signals(), r.sessions(), top=3, hold=4)


@query("t25_policies_as_of", f"""
WITH c AS (SELECT max(date) AS t FROM x_sessions GROUP BY date_trunc('quarter', date)),
v AS (SELECT c.t, s.*, row_number() OVER (PARTITION BY c.t, family_id ORDER BY activation_date) AS first_rn,
      row_number() OVER (PARTITION BY c.t, family_id ORDER BY activation_date DESC) AS last_rn,
      count(*) OVER (PARTITION BY c.t, family_id) AS n FROM c JOIN x_sched s ON activation_date <= t)
SELECT t, family_id, 'INITIAL_STATIC' AS policy, model_id, 1.0::DOUBLE AS weight FROM v WHERE first_rn = 1
UNION ALL SELECT t, family_id, 'NEWEST_VISIBLE', model_id, 1.0 FROM v WHERE last_rn = 1
UNION ALL SELECT t, family_id, 'EQUAL_POOL', model_id, {R('sum(1.0 / n)')} FROM v GROUP BY t, family_id, model_id""")
def t25(r):
    times = r.sessions().groupBy(F.trunc("date", "quarter")).agg(F.max("date").alias("t")).select("t")
    return sch.policies_as_of(r.schedule(), times).select("t", "family_id", "policy", "model_id", rnd("weight").alias("weight"))


T26_STATE = """
st AS (SELECT family_id, date_trunc('month', activation_date)::DATE AS assessment_date, activation_date, model_id,
              (extract(month FROM activation_date) IN (1, 4, 7, 10)) AS grew FROM x_sched)"""


@query("t26_refit_plan_arms", f"""
WITH {T26_STATE},
e AS (SELECT *, count(*) FILTER (grew) OVER w AS fold_count, row_number() OVER w AS rn FROM st WINDOW w AS (PARTITION BY family_id ORDER BY assessment_date)),
k AS (SELECT *, coalesce(fold_count > lag(fold_count) OVER (PARTITION BY family_id ORDER BY assessment_date), true) AS expanded FROM e),
a AS (SELECT k.*, arm, CASE arm WHEN 'A_FIRST' THEN rn = 1 WHEN 'F_FOLD' THEN expanded ELSE true END AS refit
      FROM k CROSS JOIN (SELECT unnest(['A_FIRST', 'F_FOLD', 'M_MONTHLY']) AS arm))
SELECT family_id, assessment_date, arm, refit,
       max(CASE WHEN refit THEN assessment_date END) OVER (PARTITION BY family_id, arm ORDER BY assessment_date) AS active_fit FROM a""")
def t26(r):
    quarter_start = F.month("activation_date").isin(1, 4, 7, 10)
    w = Window.partitionBy("family_id").orderBy("assessment_date")
    state = (r.schedule().withColumn("assessment_date", F.trunc("activation_date", "month"))
             .withColumn("n_folds", F.count_if(quarter_start).over(w)))
    return sch.refit_plan_arms(state)


@query("t27_evidence_events", f"""
WITH {T26_STATE},
v AS (SELECT a.family_id, a.assessment_date, count(b.assessment_date) AS visible,
      {digest_sql("strftime(b.assessment_date, '%Y-%m-%d')")} AS identity
      FROM st a LEFT JOIN st b ON a.family_id = b.family_id AND b.grew AND b.assessment_date <= a.assessment_date GROUP BY 1, 2)
SELECT * FROM (SELECT family_id, assessment_date, identity, visible - coalesce(lag(visible) OVER (PARTITION BY family_id ORDER BY assessment_date), 0) AS new_evidence FROM v)
WHERE new_evidence > 0""")
def t27(r):
    quarter_start = F.month("activation_date").isin(1, 4, 7, 10)
    state = r.schedule().withColumn("assessment_date", F.trunc("activation_date", "month"))
    evidence = state.where(quarter_start).select("family_id", F.col("assessment_date").alias("matured_at"))
    return sch.evidence_events(state.select("family_id", "assessment_date"), evidence)


@query("t28_visibility_snapshots", f"""
WITH q AS (SELECT DISTINCT family_id, CAST(date_trunc('quarter', activation_date) AS DATE) AS t FROM x_sched),
m AS (SELECT DISTINCT q.family_id, q.t, s.model_id FROM q JOIN x_sched s ON s.family_id = q.family_id AND s.activation_date <= q.t),
d AS (SELECT q.family_id, q.t, count(m.model_id) AS visible_models, {digest_sql('m.model_id')} AS fingerprint FROM q LEFT JOIN m ON m.family_id = q.family_id AND m.t = q.t GROUP BY 1, 2)
SELECT q.family_id, q.t, count(s.model_id) AS visible, any_value(d.visible_models) AS visible_models, any_value(d.fingerprint) AS fingerprint, coalesce(bool_or(s.model_id = '5-LOW'), false) AS incumbent_visible
FROM q LEFT JOIN x_sched s ON s.family_id = q.family_id AND s.activation_date <= q.t JOIN d ON d.family_id = q.family_id AND d.t = q.t GROUP BY 1, 2""")
def t28(r):
    return sch.visibility_snapshots(r.schedule(), incumbent="5-LOW")


@query("t29_recipe_assessments", f"""
WITH f AS (SELECT treatment AS candidate_id, fold, avg(cagr_excess) AS metric, make_date(fold, 12, 31) AS available_at FROM x_surf GROUP BY 1, 2),
c AS (SELECT max(date) AS t FROM x_sessions GROUP BY date_trunc('quarter', date)),
s AS (SELECT t, candidate_id, count(*) AS fold_count, {R('median(metric) + 0.5 * avg(metric) - 0.5 * stddev_pop(metric) - 0.02 * avg((metric <= 0)::INT)')} AS robust_score
      FROM c JOIN f ON available_at <= t GROUP BY 1, 2)
SELECT t, candidate_id AS winner, fold_count, robust_score FROM
 (SELECT *, row_number() OVER (PARTITION BY t ORDER BY robust_score DESC, candidate_id) AS rn FROM s) WHERE rn = 1""")
def t29(r):
    folds = (r.surface().groupBy(F.col("treatment").alias("candidate_id"), "fold").agg(F.avg("cagr_excess").alias("metric"))
             .withColumn("available_at", F.make_date("fold", F.lit(12), F.lit(31))))
    times = r.sessions().groupBy(F.trunc("date", "quarter")).agg(F.max("date").alias("t")).select("t")
    return sch.recipe_assessments(folds, times)


@query("t30_fold_segments", """
WITH f AS (SELECT DISTINCT family_id, date_trunc('quarter', date)::DATE AS fold_id, min(date) AS s, max(date) AS e FROM x_nav GROUP BY 1, 2)
SELECT family_id, fold_id, s AS start_date, e AS end_date,
       CASE WHEN e < DATE '1997-02-10' THEN 'BACKWARD' WHEN s > DATE '1999-08-20' THEN 'FORWARD'
            WHEN s >= DATE '1997-02-10' AND e <= DATE '1999-08-20' THEN 'KNOWN' ELSE 'STRADDLES' END AS segment FROM f""")
def t30(r):
    folds = (r.nav().groupBy("family_id", F.trunc("date", "quarter").alias("fold_id"))
             .agg(F.min("date").alias("start_date"), F.max("date").alias("end_date")))
    return sch.fold_segments(folds, "1997-02-10", "1999-08-20")
