"""Keyed folds and bootstrap inference."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronopanel.catalog.registry import R, query
from chronopanel.functions.rounding import rnd
from chronopanel.functions.stats import median, robust_score
from chronopanel.operators import digests as dg
from chronopanel.operators import folds as fo
from chronopanel.operators import resample as rs
from chronopanel.operators.asof import asof_join
from chronopanel.session import stage

SERIES = "s AS (SELECT family_id, arm, assessment_date AS as_of, excess_1m AS value, row_number() OVER (PARTITION BY family_id, arm ORDER BY assessment_date) AS rn FROM x_fmp WHERE excess_1m IS NOT NULL)"


def excess_series(r):
    return r.family_panel().where("excess_1m IS NOT NULL").select("family_id", "arm", F.col("assessment_date").alias("as_of"), F.col("excess_1m").alias("value"))


CHOICES = f"""
fm AS (SELECT h, treatment, fold, avg(cagr_excess) AS metric FROM x_surf GROUP BY 1, 2, 3), ts AS (SELECT max(date) AS t FROM x_sessions GROUP BY date_trunc('quarter', date)),
sc AS (SELECT h, t, treatment, count(*) AS n, max(make_date(fold, 12, 31)) AS ev, {R('median(metric)')} AS med, {R('median(metric) + 0.5 * avg(metric) - 0.5 * stddev_pop(metric) - 0.02 * avg((metric <= 0)::INT)')} AS rob
  FROM fm JOIN ts ON make_date(fold, 12, 31) <= t GROUP BY 1, 2, 3),
ch AS (SELECT h, t AS assessment_date, max(ev) AS evidence_date, CAST(sum(n) AS BIGINT) AS fingerprint, arg_max(treatment, (med, -ascii(treatment))) AS winner, max(rob) FILTER (treatment = 'A') AS sa, max(rob) FILTER (treatment = 'N') AS sn,
  max(rob) FILTER (treatment = 'R') AS sr, row_number() OVER (PARTITION BY h ORDER BY t) AS rn FROM sc GROUP BY 1, 2)"""


def recipe_choices(r):
    f = (r.surface().groupBy("h", "treatment", "fold").agg(F.avg("cagr_excess").alias("metric")).withColumn("available_at", F.make_date("fold", F.lit(12), F.lit(31))))
    state = dg.running_robust_score(f.select("h", "treatment", "available_at", "metric"), ["h", "treatment"], "available_at", "metric")
    state = state.select("h", "treatment", "available_at", "n", rnd("median").alias("med"), rnd("robust").alias("rob"))
    times = r.sessions().groupBy(F.trunc("date", "quarter")).agg(F.max("date").alias("t")).select("t")
    seen = asof_join(times, state, [], "t", "available_at", how="inner", fan_out=["h", "treatment"])
    return seen.groupBy("h", F.col("t").alias("assessment_date")).agg(
        F.max("available_at").alias("evidence_date"), F.sum("n").alias("fingerprint"), F.max_by("treatment", F.struct("med", -F.ascii("treatment"))).alias("winner"),
        F.map_from_entries(F.collect_list(F.struct("treatment", "rob"))).alias("scores"))


SC = "CASE {0} WHEN 'A' THEN ch.sa WHEN 'N' THEN ch.sn ELSE ch.sr END"


@query("f1_recipe_hysteresis", f"""
WITH RECURSIVE {CHOICES},
st AS (SELECT h, rn, assessment_date, NULL::VARCHAR AS before, winner AS inc, NULL::VARCHAR AS ch, NULL::VARCHAR AS shown, 0 AS n, 0 AS shown_n, evidence_date AS ed, fingerprint AS fp, 'INITIAL_CAUSAL_RECIPE' AS reason FROM ch WHERE rn = 1
 UNION ALL SELECT h, rn, assessment_date, inc0, CASE WHEN reason = 'HYSTERESIS_SWITCH_CONFIRMED' THEN winner ELSE inc0 END, CASE WHEN reason IN ('DUPLICATE_MATURED_EVIDENCE_IGNORED', 'NO_NEW_RECIPE_EVIDENCE') THEN ch0 WHEN reason = 'CHALLENGER_CONFIRMATION_PENDING' THEN winner END,
  CASE WHEN reason IN ('DUPLICATE_MATURED_EVIDENCE_IGNORED', 'NO_NEW_RECIPE_EVIDENCE') THEN ch0 WHEN reason = 'INCUMBENT_RECONFIRMED' THEN NULL ELSE winner END,
  CASE WHEN reason IN ('DUPLICATE_MATURED_EVIDENCE_IGNORED', 'NO_NEW_RECIPE_EVIDENCE') THEN n0 WHEN reason = 'CHALLENGER_CONFIRMATION_PENDING' THEN n1 ELSE 0 END,
  CASE WHEN reason IN ('DUPLICATE_MATURED_EVIDENCE_IGNORED', 'NO_NEW_RECIPE_EVIDENCE') THEN n0 WHEN reason IN ('CHALLENGER_CONFIRMATION_PENDING', 'HYSTERESIS_SWITCH_CONFIRMED') THEN n1 ELSE 0 END,
  CASE WHEN reason IN ('DUPLICATE_MATURED_EVIDENCE_IGNORED', 'NO_NEW_RECIPE_EVIDENCE') THEN ed0 ELSE ed1 END, CASE WHEN reason IN ('DUPLICATE_MATURED_EVIDENCE_IGNORED', 'NO_NEW_RECIPE_EVIDENCE') THEN fp0 ELSE fp1 END, reason
 FROM (SELECT ch.h, ch.rn, ch.assessment_date, st.inc AS inc0, st.ch AS ch0, st.n AS n0, st.ed AS ed0, st.fp AS fp0, ch.evidence_date AS ed1, ch.fingerprint AS fp1, ch.winner, CASE WHEN st.ch = ch.winner THEN st.n + 1 ELSE 1 END AS n1,
   CASE WHEN ch.evidence_date = st.ed THEN 'DUPLICATE_MATURED_EVIDENCE_IGNORED' WHEN ch.fingerprint = st.fp THEN 'NO_NEW_RECIPE_EVIDENCE' WHEN ch.winner = st.inc THEN 'INCUMBENT_RECONFIRMED' WHEN {SC.format('ch.winner')} - {SC.format('st.inc')} <= 0 THEN 'NO_STRICT_ROBUST_SCORE_IMPROVEMENT'
    WHEN (CASE WHEN st.ch = ch.winner THEN st.n + 1 ELSE 1 END) >= 2 THEN 'HYSTERESIS_SWITCH_CONFIRMED' ELSE 'CHALLENGER_CONFIRMATION_PENDING' END AS reason FROM st JOIN ch ON ch.h = st.h AND ch.rn = st.rn + 1))
SELECT h, assessment_date, before AS incumbent_before, inc AS incumbent_after, shown AS challenger, CAST(shown_n AS BIGINT) AS confirmations, reason FROM st""")
def f1(r):
    return fo.recipe_hysteresis(recipe_choices(r), ["h"], confirmations=2)


B_FOLDS = "pf AS (SELECT h, (row_number() OVER (PARTITION BY h ORDER BY fold) - 1) AS pos, max(m) FILTER (treatment = 'N') AS a, max(m) FILTER (treatment = 'R') AS b FROM (SELECT h, treatment, fold, avg(cagr_excess) AS m FROM x_surf GROUP BY 1, 2, 3) GROUP BY h, fold)"


def paired_folds(r):
    w = r.surface().groupBy("h", "fold").pivot("treatment", ["N", "R"]).agg(F.avg("cagr_excess")).na.drop()
    return rs.index_series(w.withColumnsRenamed({"N": "a", "R": "b"}), ["h"], "fold", ["a", "b"])


def mdraw(n, *parts):
    return f"(('0x' || substr(md5({' || chr(124) || '.join(parts)}), 1, 7))::BIGINT % {n})"


ROB = "median({0}) + 0.5 * avg({0}) - 0.5 * stddev_pop({0}) - 0.02 * avg(({0} <= 0)::INT)"
B6 = f"""{B_FOLDS}, sz AS (SELECT h, count(*) AS n FROM pf GROUP BY 1), dr AS (SELECT h, rep, {mdraw('n', "'11'", 'rep', 'i')} AS pos FROM sz, (SELECT unnest(range(1, 5001)) AS rep), LATERAL (SELECT unnest(range(1, n + 1)) AS i)),
rp AS (SELECT h, rep, ({ROB.format('b')}) - ({ROB.format('a')}) AS s FROM dr JOIN pf USING (h, pos) GROUP BY 1, 2),
bs AS (SELECT h, {R('avg(s)')} AS boot_mean, {R('quantile_cont(s, 0.05)')} AS q05, {R('quantile_cont(s, 0.95)')} AS q95, {R('avg((s > 0)::INT)')} AS positive_fraction FROM rp GROUP BY 1),
ob AS (SELECT h, count(*) AS folds, {R('(' + ROB.format('b') + ') - (' + ROB.format('a') + ')')} AS robust_delta FROM pf GROUP BY 1)"""


def paired_bootstrap(r):
    s = stage(paired_folds(r), "paired-folds")
    delta = robust_score("b") - robust_score("a")
    boot = rs.summarize(rs.iid_samples(s, ["h"], ["a", "b"], reps=5000, seed=11), ["h"], delta)
    return s.groupBy("h").agg(F.count(F.lit(1)).alias("folds"), rnd(delta).alias("robust_delta")).join(boot, "h").withColumns(
        {c: rnd(c) for c in ("boot_mean", "q05", "q95", "positive_fraction")})


@query("f2_bootstrap_acceptance", f"WITH {B6} SELECT h, folds, robust_delta, positive_fraction, folds >= 3 AND positive_fraction >= 0.8 AND robust_delta >= 0.0005 AS accepted FROM bs JOIN ob USING (h)")
def f2(r):
    ok = (F.col("folds") >= 3) & (F.col("positive_fraction") >= 0.8) & (F.col("robust_delta") >= 0.0005)
    return paired_bootstrap(r).select("h", "folds", "robust_delta", "positive_fraction", ok.alias("accepted"))


F2_PAIRS = f"""
nf AS (SELECT h, t, list(fold ORDER BY fold) AS folds FROM (SELECT DISTINCT ch.h, assessment_date AS t, fold FROM ch JOIN fm ON fm.h = ch.h AND fm.treatment = ch.winner AND make_date(fold, 12, 31) <= assessment_date) GROUP BY 1, 2),
rw AS (SELECT ch.h, assessment_date AS t, winner, sa, sn, sr, rn, coalesce(lag(folds) OVER (PARTITION BY ch.h ORDER BY assessment_date) <> folds, false) AS nw FROM ch JOIN nf ON nf.h = ch.h AND nf.t = ch.assessment_date),
pr AS (SELECT rw.h, rw.t, winner, v.rival, CASE winner WHEN 'A' THEN sa WHEN 'N' THEN sn ELSE sr END AS sw, CASE v.rival WHEN 'A' THEN sa WHEN 'N' THEN sn ELSE sr END AS si FROM rw, (VALUES ('A'), ('N'), ('R')) v(rival) WHERE nw AND v.rival <> winner),
sr AS (SELECT pr.h, pr.t, pr.rival, a.metric AS a, b.metric AS b, row_number() OVER (PARTITION BY pr.h, pr.t, pr.rival ORDER BY a.fold) - 1 AS pos, count(*) OVER (PARTITION BY pr.h, pr.t, pr.rival) AS n
  FROM pr JOIN fm a ON a.h = pr.h AND a.treatment = pr.rival JOIN fm b ON b.h = pr.h AND b.treatment = pr.winner AND b.fold = a.fold WHERE make_date(a.fold, 12, 31) <= pr.t AND si IS NOT NULL),
sz2 AS (SELECT DISTINCT h, t, rival, n FROM sr), dr2 AS (SELECT h, t, rival, rep, {mdraw('n', "'11'", 'rep', 'i')} AS pos FROM sz2, (SELECT unnest(range(1, 5001)) AS rep), LATERAL (SELECT unnest(range(1, n + 1)) AS i)),
gn AS (SELECT h, t, rival, rep, ({ROB.format('b')}) - ({ROB.format('a')}) AS g FROM dr2 JOIN sr USING (h, t, rival, pos) GROUP BY 1, 2, 3, 4),
pb AS (SELECT h, t, rival, {R('avg((g > 0)::INT)')} AS probability FROM gn GROUP BY 1, 2, 3),
vd AS (SELECT pr.h, pr.t, pr.rival, probability, n >= 5 AND probability >= 0.9 AND sw - si >= 0.005 AS accepted FROM pr JOIN sz2 USING (h, t, rival) JOIN pb USING (h, t, rival))"""


@query("f2_running_incumbent", f"""
WITH RECURSIVE {CHOICES}, {F2_PAIRS.strip()},
st AS (SELECT h, t, rn, NULL::VARCHAR AS before, winner AS inc, NULL::DOUBLE AS probability, false AS switched FROM rw WHERE rn = 1
 UNION ALL SELECT rw.h, rw.t, rw.rn, st.inc, CASE WHEN v.accepted THEN rw.winner ELSE st.inc END, v.probability, coalesce(v.accepted, false) FROM st JOIN rw ON rw.h = st.h AND rw.rn = st.rn + 1 LEFT JOIN vd v ON v.h = rw.h AND v.t = rw.t AND v.rival = st.inc)
SELECT st.h, st.t AS assessment_date, rw.winner, rw.nw AS new_folds, before AS incumbent_before, inc AS incumbent_after, probability, switched FROM st JOIN rw ON rw.h = st.h AND rw.rn = st.rn""")
def f2_running(r):
    surface = stage(r.surface().groupBy("h", "treatment", "fold").agg(F.avg("cagr_excess").alias("metric")), "recipe-folds")
    metrics = surface.select("h", F.col("treatment").alias("candidate"), "fold", F.make_date("fold", F.lit(12), F.lit(31)).alias("available_at"), "metric")
    out = rs.running_incumbent(stage(recipe_choices(r), "recipe-choices"), metrics, ["h"], "assessment_date")
    return out.select("h", "assessment_date", "winner", "new_folds", F.col("before").alias("incumbent_before"), F.col("incumbent").alias("incumbent_after"), "probability", "switched")


CP = "least(1, 0.02 + 0.98 * (p0 * 0.9 + greatest(0, least(1, (m0 - value) / 0.02)) * 0.1))"
CP_REC = f"""c AS (SELECT family_id, arm, as_of, rn, {CP.replace('p0', '0.0').replace('m0', '0.0')} AS p, 0.1 * value AS m FROM s WHERE rn = 1
 UNION ALL SELECT family_id, arm, as_of, rn, {CP}, 0.9 * m0 + 0.1 * value FROM (SELECT s.*, c.p AS p0, c.m AS m0 FROM c JOIN s ON s.family_id = c.family_id AND s.arm = c.arm AND s.rn = c.rn + 1))"""


@query("f3_change_detector", f"WITH RECURSIVE {SERIES}, {CP_REC} SELECT family_id, arm, as_of, {R('p')} AS probability, {R('1 / (0.02 + p * 0.1)')} AS run_length, {R('greatest(0.25, 1 - p)')} AS forgetting FROM c")
def f3(r):
    out = fo.change_detector(excess_series(r), ["family_id", "arm"], "as_of", "value", 0.02).drop("value")
    return out.withColumns({c: rnd(c) for c in ("probability", "run_length", "forgetting")})


@query("f4_activity_posterior", f"""
WITH d AS (SELECT family_id, arm, date AS as_of, positions > 0 AS traded, row_number() OVER w AS rn, sum((positions > 0)::INT) OVER w AS k FROM x_ret WINDOW w AS (PARTITION BY family_id, arm ORDER BY date)),
e AS (SELECT *, rn - coalesce(max(CASE WHEN traded THEN rn END) OVER (PARTITION BY family_id, arm ORDER BY as_of), 0) AS streak FROM d)
SELECT family_id, arm, as_of, {R('1.0 + k')} AS a, {R('1.0 + rn')} AS b, CAST(streak AS BIGINT) AS streak, {R('((1.0 + rn) / (1.0 + rn + streak)) ** (1.0 + k)')} AS p_zero FROM e""")
def f4(r):
    rows = r.returns().select("family_id", "arm", F.col("date").alias("as_of"), "positions")
    out = fo.activity_posterior(rows, ["family_id", "arm"], "as_of", F.lit(True), F.col("positions") > 0).drop("positions")
    return out.withColumns({c: rnd(c) for c in ("a", "b", "p_zero")})


ALPHA = """SELECT family_id, arm, as_of, rn, d0 * dc + value * (1 - dc) AS d, (n0 * m0 + value) / (n0 + 1) AS m, n0 + 1 AS n, ((n0 * (m0 - (n0 * m0 + value) / (n0 + 1)) ** 2 + (value - (n0 * m0 + value) / (n0 + 1)) ** 2) / greatest(1, n0)) AS var"""


@query("f5_discounted_alpha", f"""
WITH RECURSIVE {SERIES}, a AS (SELECT family_id, arm, as_of, rn, value * 0.03 AS d, value AS m, 1 AS n, 0.0::DOUBLE AS var FROM s WHERE rn = 1
 UNION ALL {ALPHA} FROM (SELECT s.*, a.d AS d0, a.m AS m0, a.n AS n0, 0.97 AS dc FROM a JOIN s ON s.family_id = a.family_id AND s.arm = a.arm AND s.rn = a.rn + 1))
SELECT family_id, arm, as_of, {R('d')} AS discounted, {R('m')} AS mean, CAST(n AS BIGINT) AS n, {R('m - 1.96 * sqrt(var / n)')} AS lcb FROM a""")
def f5(r):
    out = fo.discounted_alpha(excess_series(r), ["family_id", "arm"], "as_of", "value").drop("value")
    return out.withColumns({c: rnd(c) for c in ("discounted", "mean", "lcb")})


@query("f5b_health_update", f"""
WITH RECURSIVE {SERIES}, {CP_REC}, a AS (SELECT family_id, arm, as_of, rn, value * 0.03 AS d, value AS m, 1 AS n, 0.0::DOUBLE AS var FROM s WHERE rn = 1
 UNION ALL {ALPHA} FROM (SELECT s.*, a.d AS d0, a.m AS m0, a.n AS n0, 0.97 * greatest(0.25, 1 - c.p) AS dc FROM a JOIN s ON s.family_id = a.family_id AND s.arm = a.arm AND s.rn = a.rn + 1 JOIN c ON c.family_id = a.family_id AND c.arm = a.arm AND c.rn = a.rn))
SELECT family_id, arm, as_of, {R('d')} AS discounted, CAST(n AS BIGINT) AS n, {R('1 / sqrt(n)')} AS uncertainty FROM a""")
def f5b(r):
    # already seen outcomes (same family, arm and date) are skipped before the fold
    rows = excess_series(r)
    rows = rows.unionByName(rows).dropDuplicates(["family_id", "arm", "as_of"])
    out = fo.forgetful_alpha(rows, ["family_id", "arm"], "as_of", "value", 0.02)
    return out.select("family_id", "arm", "as_of", rnd("discounted").alias("discounted"), "n", rnd("uncertainty").alias("uncertainty"))


F6_ROWS = """hr AS (SELECT family_id, arm, assessment_date AS as_of, rel <= 0.8 AS sk, coalesce(trailing_3m < -0.06, false) AS kk, active_days >= 2 AS cand, round(avg(excess_1m) OVER w, 9) AS lcb, row_number() OVER w AS rn FROM x_fmp WINDOW w AS (PARTITION BY family_id, arm ORDER BY assessment_date))"""
F6_CASE = """CASE WHEN hr.sk THEN 'SUSPENDED' WHEN hr.kk AND s0 = 'PROBATION' THEN 'SUSPENDED' WHEN hr.kk AND s0 = 'CHAMPION' THEN 'PROBATION' WHEN NOT hr.cand THEN CASE WHEN s0 = 'CHAMPION' THEN 'PROBATION' ELSE s0 END
 WHEN s0 IN ('SUSPENDED', 'SHADOW') THEN 'CANDIDATE' WHEN s0 = 'CANDIDATE' AND hr.lcb > 0 THEN 'CHAMPION' ELSE s0 END"""


@query("f6_lifecycle", f"""
WITH RECURSIVE {F6_ROWS}, st AS (SELECT family_id, arm, as_of, rn, {F6_CASE} AS state, 0 AS k FROM (SELECT *, 'SHADOW' AS s0 FROM hr WHERE rn = 1) hr
 UNION ALL SELECT family_id, arm, as_of, rn, ns, CASE WHEN ns = s0 THEN k0 + 1 ELSE 0 END FROM (SELECT hr.family_id, hr.arm, hr.as_of, hr.rn, st.state AS s0, st.k AS k0, {F6_CASE.replace('s0', 'st.state')} AS ns FROM st JOIN hr ON hr.family_id = st.family_id AND hr.arm = st.arm AND hr.rn = st.rn + 1))
SELECT family_id, arm, as_of, state, CAST(k AS BIGINT) AS sessions_in_state FROM st""")
def f6(r):
    w = Window.partitionBy("family_id", "arm").orderBy("assessment_date")
    rows = r.family_panel().select("family_id", "arm", F.col("assessment_date").alias("as_of"), (F.col("rel") <= 0.8).alias("structural_kill"), F.coalesce(F.col("trailing_3m") < -0.06, F.lit(False)).alias("statistical_kill"),
                                   (F.col("active_days") >= 2).alias("candidate"), F.round(F.avg("excess_1m").over(w), 9).alias("lcb"))
    return fo.lifecycle(rows, ["family_id", "arm"], "as_of", F.col("structural_kill"), F.col("statistical_kill"), F.col("candidate"), F.col("lcb"))


@query("f7_blend_weight_steps", f"""
WITH RECURSIVE {SERIES}, g AS (SELECT family_id, arm, as_of, rn, avg(value) OVER w / 0.01 AS z, count(*) OVER w AS n FROM s WINDOW w AS (PARTITION BY family_id, arm ORDER BY as_of ROWS 5 PRECEDING)),
l AS (SELECT family_id, arm, as_of, rn, CASE WHEN n < 3 THEN 0.0::DOUBLE END AS lam, false AS updated FROM g WHERE rn = 1
 UNION ALL SELECT family_id, arm, as_of, rn, nl, abs(nl - l0) > 1e-15 FROM (SELECT g.*, l.lam AS l0, CASE WHEN g.n < 3 THEN l.lam ELSE greatest(0, least(1, l.lam + greatest(-0.1, least(0.1, least(1, greatest(0, g.z) / 2.0) - l.lam)))) END AS nl FROM l JOIN g ON g.family_id = l.family_id AND g.arm = l.arm AND g.rn = l.rn + 1))
SELECT family_id, arm, as_of, {R('lam')} AS lam, updated FROM l""")
def f7(r):
    w = Window.partitionBy("family_id", "arm").orderBy("as_of").rowsBetween(-5, 0)
    rows = excess_series(r).withColumns({"rolling": F.avg("value").over(w) / 0.01, "observations": F.count(F.lit(1)).over(w)})
    out = fo.blend_weight(rows, ["family_id", "arm"], "as_of", F.col("rolling") / 2.0, F.col("observations") >= 3, 0.1)
    return out.withColumn("lam", rnd("lam"))


@query("f8_champion_spells", f"""
WITH x AS (SELECT *, coalesce(lag(model_id) OVER w <> model_id, false)::INT AS sw FROM x_sched WINDOW w AS (PARTITION BY family_id ORDER BY activation_date)), y AS (SELECT *, sum(sw) OVER (PARTITION BY family_id ORDER BY activation_date) AS spell FROM x),
z AS (SELECT family_id, spell, count(*) AS len, sum((model_id = '5-LOW')::INT) AS fb FROM y GROUP BY 1, 2) SELECT family_id, count(*) - 1 AS switches, CAST(sum(fb) AS BIGINT) AS fallback_rows, {R('avg(len)')} AS mean_duration, max(len) AS longest FROM z GROUP BY 1""")
def f8(r):
    return fo.champion_spells(r.schedule(), ["family_id"], "activation_date", "model_id", "5-LOW").withColumn("mean_duration", rnd("mean_duration"))


@query("f9_paired_edge_bound", f"""
WITH p AS (SELECT family_id, max(excess_1m) FILTER (arm = 'F') - max(excess_1m) FILTER (arm = 'O') - 0.001 AS d FROM x_fmp GROUP BY family_id, assessment_date)
SELECT family_id, count(d) AS observations, {R('avg(d)')} AS mean_edge, {R('stddev_samp(d) / sqrt(count(d))')} AS standard_error, {R('avg(d) - 1.96 * stddev_samp(d) / sqrt(count(d))')} AS lcb FROM p WHERE d IS NOT NULL GROUP BY 1""")
def f9(r):
    wide = r.family_panel().groupBy("family_id", "assessment_date").pivot("arm", ["F", "O"]).agg(F.max("excess_1m"))
    return fo.paired_edge(wide, ["family_id"], "F", "O", 0.001).withColumns({c: rnd(c) for c in ("mean_edge", "standard_error", "lcb")})


# ---- resampling -----------------------------------------------------------

BLOCK = """sz AS (SELECT k, count(*) AS n FROM sr GROUP BY 1),
dr AS (SELECT k, n, rep, i, {b} AS st FROM sz, (SELECT unnest(range(1, {reps} + 1)) AS rep), LATERAL (SELECT unnest(range(1, n + 1)) AS i)),
dl AS (SELECT *, least({block}, n - st) AS len FROM dr), dc AS (SELECT *, sum(len) OVER (PARTITION BY k, rep ORDER BY i) - len AS have FROM dl),
pk AS (SELECT k, rep, st + j AS pos FROM dc, LATERAL (SELECT unnest(range(0, least(len, n - have)::BIGINT)) AS j) WHERE have < n)"""
SUMMARY = f"{R('avg(s)')} AS boot_mean, {R('quantile_cont(s, 0.05)')} AS q05, {R('quantile_cont(s, 0.95)')} AS q95, {R('avg((s > 0)::INT)')} AS positive_fraction"
MONTHLY = "sr AS (SELECT arm AS k, row_number() OVER (PARTITION BY arm ORDER BY assessment_date) - 1 AS pos, avg(excess_1m) AS v FROM x_fmp WHERE excess_1m IS NOT NULL GROUP BY arm, assessment_date)"


def monthly_series(r):
    m = r.family_panel().where("excess_1m IS NOT NULL").groupBy(F.col("arm").alias("k"), "assessment_date").agg(F.avg("excess_1m").alias("v"))
    return stage(rs.index_series(m, ["k"], "assessment_date", ["v"]), "series")


def rounded(boot):
    return boot.withColumns({c: rnd(c) for c in ("boot_mean", "q05", "q95", "positive_fraction")})



@query("b1_block_bootstrap_mean", f"""
WITH {MONTHLY}, {BLOCK.format(b=mdraw('n', "'17'", 'rep', 'i'), reps=1000, block=5)}, rp AS (SELECT k, rep, avg(v) AS s FROM pk JOIN sr USING (k, pos) GROUP BY 1, 2) SELECT k, {SUMMARY} FROM rp GROUP BY 1""")
def b1(r):
    return rounded(rs.summarize(rs.block_samples(monthly_series(r), ["k"], ["v"], block=5, reps=1000, seed=17), ["k"], F.avg("v")))


@query("b2_partition_block_bootstrap", f"""
WITH {MONTHLY}, {BLOCK.format(b='3 * ' + mdraw('ceil(n / 3.0)::BIGINT', "'23'", 'rep', 'i'), reps=1000, block=3)}, rp AS (SELECT k, rep, avg(v) AS s FROM pk JOIN sr USING (k, pos) GROUP BY 1, 2),
ob AS (SELECT k, count(*) AS n, {R('avg(v)')} AS mean, {R('median(v)')} AS median FROM sr GROUP BY 1) SELECT k, n, mean, median, {SUMMARY} FROM rp JOIN ob USING (k) GROUP BY 1, 2, 3, 4""")
def b2(r):
    s = monthly_series(r)
    boot = rounded(rs.summarize(rs.block_samples(s, ["k"], ["v"], block=3, reps=1000, seed=23, fixed=True), ["k"], F.avg("v")))
    return s.groupBy("k").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("v")).alias("mean"), rnd(median("v")).alias("median")).join(boot, "k")


@query("b3_cagr_contrast_bootstrap", f"""
WITH sr AS (SELECT 'ALL' AS k, row_number() OVER (ORDER BY date) - 1 AS pos, avg(r) FILTER (arm = 'F') AS a, avg(r) FILTER (arm = 'O') AS b FROM x_ret GROUP BY date),
sz AS (SELECT k, count(*) AS n FROM sr GROUP BY 1), dr AS (SELECT k, n, rep, i, {mdraw('(n - 20)', "'31'", 'rep', 'i')} AS st FROM sz, (SELECT unnest(range(1, 2001)) AS rep), LATERAL (SELECT unnest(range(1, ceil(n / 21.0)::BIGINT + 1)) AS i)),
pk AS (SELECT k, rep, st + j AS pos FROM dr, LATERAL (SELECT unnest(range(0, least(21, n - 21 * (i - 1))::BIGINT)) AS j)),
rp AS (SELECT k, rep, exp(avg(ln(1 + a)) * 52) - exp(avg(ln(1 + b)) * 52) AS s FROM pk JOIN sr USING (k, pos) GROUP BY 1, 2)
SELECT k, {R('avg(s)')} AS boot_mean, {R('quantile_cont(s, 0.025)')} AS q025, {R('quantile_cont(s, 0.975)')} AS q975, {R('avg((s > 0)::INT)')} AS positive_fraction FROM rp GROUP BY 1""")
def b3(r):
    """Contrast of two arms' CAGR excess; both subtract the same benchmark path, which therefore cancels."""
    w = r.returns().groupBy("date").pivot("arm", ["F", "O"]).agg(F.avg("r")).select(F.lit("ALL").alias("k"), "date", F.col("F").alias("a"), F.col("O").alias("b"))
    s = stage(rs.index_series(w, ["k"], "date", ["a", "b"]), "series")
    cagr = lambda c: F.exp(F.avg(F.log1p(c)) * 52)
    out = rs.summarize(rs.block_samples(s, ["k"], ["a", "b"], block=21, reps=2000, seed=31, whole=True), ["k"], cagr("a") - cagr("b"), {"q025": 0.025, "q975": 0.975})
    return out.withColumns({c: rnd(c) for c in ("boot_mean", "q025", "q975", "positive_fraction")})


@query("b4_cluster_bootstrap", f"""
WITH cl AS (SELECT 'ticker' AS k, ticker::VARCHAR AS u, avg(excess) AS v FROM x_tr GROUP BY 1, 2 UNION ALL SELECT 'quarter', strftime(date_trunc('quarter', entry_date)::DATE, '%Y-%m-%d'), avg(excess) FROM x_tr GROUP BY 1, 2),
sr AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY u) - 1 AS pos, v FROM cl), sz AS (SELECT k, count(*) AS n FROM sr GROUP BY 1),
dr AS (SELECT k, rep, {mdraw('n', "'41'", 'rep', 'i')} AS pos FROM sz, (SELECT unnest(range(1, 1001)) AS rep), LATERAL (SELECT unnest(range(1, n + 1)) AS i)), rp AS (SELECT k, rep, avg(v) AS s FROM dr JOIN sr USING (k, pos) GROUP BY 1, 2)
SELECT k, n AS clusters, {SUMMARY} FROM rp JOIN sz USING (k) GROUP BY 1, 2""")
def b4(r):
    t = r.trade_returns()
    unit = F.array(F.struct(F.lit("ticker").alias("k"), F.col("ticker").cast("string").alias("u")), F.struct(F.lit("quarter").alias("k"), F.trunc("entry_date", "quarter").cast("string").alias("u")))
    means = t.select("excess", F.inline(unit)).groupBy("k", "u").agg(F.avg("excess").alias("v"))
    s = stage(rs.index_series(means, ["k"], "u", ["v"]), "clusters")
    boot = rounded(rs.summarize(rs.iid_samples(s, ["k"], ["v"], reps=1000, seed=41), ["k"], F.avg("v")))
    return s.groupBy("k").agg(F.count(F.lit(1)).alias("clusters")).join(boot, "k")


@query("b5_median_bootstrap_gate", f"""
WITH pl AS (SELECT h, d, {R("median(cagr_excess) FILTER (treatment = 'R') - median(cagr_excess) FILTER (treatment = 'A')")} AS v FROM x_surf GROUP BY 1, 2),
sr AS (SELECT h AS k, row_number() OVER (PARTITION BY h ORDER BY d) - 1 AS pos, v FROM pl WHERE v IS NOT NULL), sz AS (SELECT k, count(*) AS n, {R('avg((v > 0)::INT)')} AS direction FROM sr GROUP BY 1),
dr AS (SELECT k, rep, {mdraw('n', "'53'", 'rep', 'i')} AS pos FROM sz, (SELECT unnest(range(1, 5001)) AS rep), LATERAL (SELECT unnest(range(1, n + 1)) AS i)), rp AS (SELECT k, rep, median(v) AS s FROM dr JOIN sr USING (k, pos) GROUP BY 1, 2),
bs AS (SELECT k, {SUMMARY} FROM rp GROUP BY 1) SELECT bs.*, n AS plateaus, direction, direction >= 0.6 AND q05 > 0 AS gate_pass FROM bs JOIN sz USING (k)""")
def b5(r):
    m = lambda t: F.expr(f"percentile(CASE WHEN treatment = '{t}' THEN cagr_excess END, 0.5)")
    p = r.surface().groupBy(F.col("h").alias("k"), "d").agg(rnd(m("R") - m("A")).alias("v")).where("v IS NOT NULL")
    s = stage(rs.index_series(p, ["k"], "d", ["v"]), "plateau-medians")
    boot = rounded(rs.summarize(rs.iid_samples(s, ["k"], ["v"], reps=5000, seed=53), ["k"], median("v")))
    base = s.groupBy("k").agg(F.count(F.lit(1)).alias("plateaus"), rnd(F.avg((F.col("v") > 0).cast("int"))).alias("direction"))
    return boot.join(base, "k").withColumn("gate_pass", (F.col("direction") >= 0.6) & (F.col("q05") > 0))


@query("b6_paired_fold_bootstrap", f"WITH {B6} SELECT h, folds, robust_delta, boot_mean, q05, q95, positive_fraction FROM bs JOIN ob USING (h)")
def b6(r):
    return paired_bootstrap(r)
