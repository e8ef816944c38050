"""Walk-forward models, ensembles, recipe selection, SQL functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronopanel.catalog.aggregates import AVG_RANK
from chronopanel.catalog.inference import BLOCK, SUMMARY, mdraw
from chronopanel.catalog.registry import R, query
from chronopanel.catalog.selectors import KEYS
from chronopanel.functions import sqlfuncs
from chronopanel.functions.rounding import rnd
from chronopanel.functions.stats import hhi, median, share, wilson
from chronopanel.operators import boosting as bo
from chronopanel.operators import evidence as ev
from chronopanel.operators import models as mo
from chronopanel.operators import ordered as od
from chronopanel.operators import resample as rs
from chronopanel.operators.joins import bucket_pairs
from chronopanel.session import stage

FEATURES = ["excess_1m", "trailing_3m", "trailing_6m"]


def model_panel(r):
    w = Window.partitionBy("family_id", "arm").orderBy("assessment_date")
    p = r.family_panel().withColumns({"available_at": F.lead("assessment_date").over(w), "activity": F.col("active_days") / F.col("observed_days")})
    return stage(p.where("excess_1m IS NOT NULL"), "model-panel")


def gate_panel(r):
    w = Window.partitionBy("family_id", "arm").orderBy("assessment_date")
    p = r.family_panel().withColumns({"available_at": F.lead("assessment_date").over(w), "available_3m": F.lead("assessment_date", 3).over(w), "activity": F.col("active_days") / F.col("observed_days"),
                                      "drawdown": F.col("rel") / F.max("rel").over(w) - 1})
    p = p.where("excess_1m IS NOT NULL")
    return p.join(p.groupBy("assessment_date").agg(F.avg("excess_1m").alias("market")), "assessment_date")


MODEL_ROWS = """mp0 AS (SELECT *, rel / lag(rel, 6) OVER w - 1 AS trailing_6m, rel / max(rel) OVER w - 1 AS drawdown, active_days / observed_days AS activity, lead(assessment_date) OVER w AS available_at,
  lead(assessment_date, 3) OVER w AS available_3m FROM x_fmp WINDOW w AS (PARTITION BY family_id, arm ORDER BY assessment_date)), mp AS (SELECT *, avg(excess_1m) OVER (PARTITION BY assessment_date) AS market FROM mp0 WHERE excess_1m IS NOT NULL),
cal AS (SELECT assessment_date AS t, row_number() OVER (ORDER BY assessment_date) - 1 AS i FROM (SELECT DISTINCT assessment_date FROM mp))"""


def ridge_sql(name: str, features: list[str], target: str, available: str, ridge: float = 1e-4) -> str:
    """CTEs that fit a ridge per date by plain elimination; the last one, ``name``, holds family_id, arm, assessment_date and p."""
    p, zs = len(features), range(len(features) + 1)
    out = [f"{name}_tr AS (SELECT t, {target} AS y, {', '.join(features)} FROM cal JOIN mp ON {available} <= t WHERE {target} IS NOT NULL AND i >= 24)",
           f"{name}_st AS (SELECT t, {', '.join(f'coalesce(avg({f}), 0) AS m{k}, CASE WHEN coalesce(stddev_pop({f}), 0) < 1e-12 THEN 1 ELSE stddev_pop({f}) END AS s{k}' for k, f in enumerate(features, 1))} FROM {name}_tr GROUP BY t)",
           f"{name}_z AS (SELECT t, y, 1.0::DOUBLE AS z0, {', '.join(f'coalesce(({f} - m{k}) / s{k}, 0) AS z{k}' for k, f in enumerate(features, 1))} FROM {name}_tr JOIN {name}_st USING (t))",
           f"{name}_e0 AS (SELECT t, {', '.join(f'sum(z{i} * z{j}){f' + {ridge}' if i == j else ''} AS g{i}_{j}' for i in zs for j in zs)}, {', '.join(f'sum(z{i} * y) AS y{i}' for i in zs)} FROM {name}_z GROUP BY t)"]
    for k in range(p):
        cells = [f"g{i}_{j}" if i <= k else f"g{i}_{j} - g{i}_{k} / g{k}_{k} * g{k}_{j} AS g{i}_{j}" for i in zs for j in zs if (j >= i if i <= k else j > k)]
        out.append(f"{name}_e{k + 1} AS (SELECT t, {', '.join(cells)}, {', '.join(f'y{i}' if i <= k else f'y{i} - g{i}_{k} / g{k}_{k} * y{k} AS y{i}' for i in zs)} FROM {name}_e{k})")
    last = f"{name}_e{p}"
    for i in reversed(zs):
        rest = "".join(f" - g{i}_{j} * b{j}" for j in range(i + 1, p + 1))
        out.append(f"{name}_b{i} AS (SELECT *, (y{i}{rest}) / g{i}_{i} AS b{i} FROM {last})")
        last = f"{name}_b{i}"
    score = " + ".join(["b0", *(f"b{k} * coalesce(({f} - m{k}) / s{k}, 0)" for k, f in enumerate(features, 1))])
    out.append(f"{name} AS (SELECT family_id, arm, assessment_date, {score} AS p FROM mp JOIN {last} b ON b.t = assessment_date JOIN {name}_st USING (t))")
    return ",\n".join(out)


@query("m1_walk_forward_ridge", f"""
WITH {MODEL_ROWS}, {ridge_sql('rd', FEATURES, 'fwd_1m', 'available_at')}
SELECT mp.assessment_date, family_id, arm, {R('p')} AS predicted, {R('fwd_1m')} AS realized, n AS train_rows FROM rd JOIN mp USING (family_id, arm, assessment_date) JOIN (SELECT t, count(*) AS n FROM rd_tr GROUP BY 1) c ON c.t = mp.assessment_date WHERE fwd_1m IS NOT NULL""")
def m1(r):
    out = mo.walk_forward_ridge(model_panel(r), FEATURES, "fwd_1m", "available_at", min_months=24)
    return out.where("fwd_1m IS NOT NULL").select("assessment_date", "family_id", "arm", rnd("predicted").alias("predicted"), rnd("fwd_1m").alias("realized"), "train_rows")


#: Feature groups: performance, downside, generation health, market state; a gate adds one group to the groups before it.
PERFORMANCE, DOWNSIDE, HEALTH, MARKET = ["excess_1m", "trailing_3m"], ["drawdown"], ["activity"], ["market"]
GATES = {"GATE1": ([], PERFORMANCE), "GATE1B": (PERFORMANCE, DOWNSIDE), "GATE2": (PERFORMANCE, HEALTH), "GATE3": (PERFORMANCE + HEALTH, MARKET)}
GATE_MODELS = {"perf": PERFORMANCE, "perf_down": PERFORMANCE + DOWNSIDE, "perf_health": PERFORMANCE + HEALTH, "all_market": PERFORMANCE + HEALTH + MARKET}
COMPARED = {"GATE1": (None, "perf"), "GATE1B": ("perf", "perf_down"), "GATE2": ("perf", "perf_health"), "GATE3": ("perf_health", "all_market")}
TARGETS = {1: ("fwd_1m", "available_at"), 3: ("fwd_3m", "available_3m")}


def gate_rows_sql() -> str:
    """One row per gate, months and assessment: what the added features change in the top pick and in the rank correlation."""
    parts, rows = [], []
    for months, (target, available) in TARGETS.items():
        parts += [ridge_sql(f"{name}_{months}", features, target, available) for name, features in GATE_MODELS.items()]
        joins = " ".join(f"JOIN {name}_{months} {name} ON {name}.family_id = mp.family_id AND {name}.arm = mp.arm AND {name}.assessment_date = mp.assessment_date" for name in GATE_MODELS)
        columns = ", ".join(f"round({name}.p, 9) AS {name}" for name in GATE_MODELS)
        parts.append(f"sc_{months} AS (SELECT mp.family_id, mp.arm, mp.assessment_date, {target} AS y, {columns} FROM mp {joins} WHERE {target} IS NOT NULL)")
        ranks = ", ".join(f"{AVG_RANK.format(p='assessment_date', x=c)} AS r_{c}" for c in ("y", *GATE_MODELS))
        parts.append(f"rk_{months} AS (SELECT *, {ranks} FROM sc_{months})")
        each = ", ".join(f"arg_max(y, ({c}, -fa)) AS t_{c}, CASE WHEN count(*) >= 3 AND stddev_pop(r_y) > 1e-12 AND stddev_pop(r_{c}) > 1e-12 THEN corr(r_{c}, r_y) END AS c_{c}" for c in GATE_MODELS)
        parts.append(f"dt_{months} AS (SELECT assessment_date, {each}, avg(y) AS t_none, 0.0::DOUBLE AS c_none FROM (SELECT *, row_number() OVER (ORDER BY family_id, arm) AS fa FROM rk_{months}) GROUP BY 1)")
        rows += [f"SELECT '{g}' AS gate, {months} AS months, assessment_date, t_{b} - t_{a or 'none'} AS top, c_{b} - c_{a or 'none'} AS ic FROM dt_{months}" for g, (a, b) in COMPARED.items()]
    return ",\n".join(parts) + ",\ngr AS (" + " UNION ALL ".join(rows) + ")"


@query("m2_incremental_feature_gate", f"""
WITH {MODEL_ROWS}, {gate_rows_sql()},
sr AS (SELECT gate || '|' || months AS k, row_number() OVER (PARTITION BY gate, months ORDER BY assessment_date) - 1 AS pos, top AS v FROM gr WHERE top IS NOT NULL),
{BLOCK.format(b=mdraw('n', "'31'", 'rep', 'i'), reps=1000, block=3)}, rp AS (SELECT k, rep, avg(v) AS s FROM pk JOIN sr USING (k, pos) GROUP BY 1, 2),
bs AS (SELECT k, {SUMMARY} FROM rp GROUP BY 1),
g AS (SELECT gate, CAST(months AS INTEGER) AS months, count(*) AS n, {R('avg(top)')} AS mean_top, {R('median(ic)')} AS median_ic FROM gr GROUP BY 1, 2)
SELECT gate, months, n, mean_top, median_ic, boot_mean, q05, q95, positive_fraction, gate || '_' || months || CASE WHEN q05 > 0 AND median_ic > 0 THEN 'M_PASS' ELSE 'M_FAIL' END AS status
FROM g JOIN bs ON bs.k = gate || '|' || months""")
def m2(r):
    """Four gates at two horizons; a gate passes where the top pick's gain is positive in the 5 % quantile and the rank correlation gains in the median."""
    panel = stage(gate_panel(r), "gate-panel")
    rows = None
    for months, (target, available) in TARGETS.items():
        scored = mo.walk_forward_ridges(panel, GATE_MODELS, target, available, min_months=24).where(F.col(target).isNotNull())
        scored = stage(scored.select("assessment_date", "family_id", "arm", F.col(target).alias("y"), *[F.round(n, 9).alias(n) for n in GATE_MODELS]), "gate-predictions")
        by_date = scored.groupBy("assessment_date").agg(F.avg("y").alias("t_none"), F.lit(0.0).alias("c_none"), *[F.min_by("y", F.struct((-F.col(n)).alias("s"), "family_id", "arm")).alias(f"t_{n}") for n in GATE_MODELS])
        for n in GATE_MODELS:
            by_date = by_date.join(od.rank_ic(scored, ["assessment_date"], n, "y", name=f"c_{n}").drop("n_rows"), "assessment_date")
        gates = F.array(*[F.struct(F.lit(g).alias("gate"), (F.col(f"t_{b}") - F.col(f"t_{a or 'none'}")).alias("top"), (F.col(f"c_{b}") - F.col(f"c_{a or 'none'}")).alias("ic")) for g, (a, b) in COMPARED.items()])
        part = by_date.select("assessment_date", F.lit(months).alias("months"), F.inline(gates))
        rows = part if rows is None else rows.unionByName(part)
    rows = stage(rows, "gate-rows").withColumn("k", F.concat_ws("|", "gate", F.col("months").cast("string")))
    series = stage(rs.index_series(rows.where("top IS NOT NULL"), ["k"], "assessment_date", ["top"]), "gate-series")
    boot = rs.summarize(rs.block_samples(series, ["k"], ["top"], block=3, reps=1000, seed=31), ["k"], F.avg("top"))
    base = rows.groupBy("k", "gate", "months").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("top")).alias("mean_top"), rnd(median("ic")).alias("median_ic"))
    out = base.join(boot, "k").withColumns({c: rnd(c) for c in ("boot_mean", "q05", "q95", "positive_fraction")})
    passed = F.when((F.col("q05") > 0) & (F.col("median_ic") > 0), "M_PASS").otherwise("M_FAIL")
    return out.withColumn("status", F.concat(F.col("gate"), F.lit("_"), F.col("months").cast("string"), passed)).drop("k")


FEATURE_ARMS = {"PERFORMANCE": PERFORMANCE, "WITH_HEALTH": PERFORMANCE + DOWNSIDE + HEALTH}
BOOST_FEATURES = list(dict.fromkeys(f for fs in FEATURE_ARMS.values() for f in fs))
BOOST_ROWS = f"""{MODEL_ROWS}, fd AS (SELECT t AS fold FROM cal WHERE i >= 24),
fr AS (SELECT fold, arm AS execution_arm, family_id, fold = assessment_date AS test, available_at AS known_at, fwd_1m AS y, {', '.join(BOOST_FEATURES)} FROM mp JOIN fd ON fold = assessment_date OR available_at <= fold WHERE fwd_1m IS NOT NULL)"""


def boosting_sql(rounds: int, rate: float, bins: int, least: int) -> str:
    """The rounds of one-cut trees, one after the other, over unpivoted rows."""
    values = ", ".join(f"('{f}', {k}, {f}::DOUBLE)" for k, f in enumerate(BOOST_FEATURES))
    use = " OR ".join(f"(feature_arm = '{name}' AND f IN ({', '.join(str(BOOST_FEATURES.index(f)) for f in fs)}))" for name, fs in FEATURE_ARMS.items())
    arms = ", ".join(f"('{name}')" for name in FEATURE_ARMS)
    out = [BOOST_ROWS, "ri AS (SELECT *, row_number() OVER (ORDER BY fold, execution_arm, family_id, test, known_at, y) AS id FROM fr)",
           f"uv AS (SELECT id, fold, execution_arm, test, v.f, v.x FROM ri, LATERAL (VALUES {values}) v(n, f, x))",
           "rk AS (SELECT fold, execution_arm, f, x, rank() OVER w - 1 AS below, count(*) OVER (PARTITION BY fold, execution_arm, f) AS n FROM uv WHERE NOT test AND x IS NOT NULL WINDOW w AS (PARTITION BY fold, execution_arm, f ORDER BY x))",
           f"ct AS (SELECT fold, execution_arm, f, b, min(x) AS cut FROM (SELECT *, (below * {bins}) // n AS b FROM rk) WHERE b > 0 GROUP BY 1, 2, 3, 4)",
           "bn AS (SELECT uv.id, uv.fold, uv.execution_arm, uv.f, CASE WHEN uv.x IS NULL THEN -1 ELSE count(ct.cut) END AS bin FROM uv LEFT JOIN ct ON ct.fold = uv.fold AND ct.execution_arm = uv.execution_arm AND ct.f = uv.f AND ct.cut <= uv.x GROUP BY uv.id, uv.fold, uv.execution_arm, uv.f, uv.x)",
           f"s0 AS (SELECT ri.*, feature_arm, avg(y) FILTER (NOT test) OVER (PARTITION BY fold, execution_arm, feature_arm) AS pred FROM ri, (VALUES {arms}) a(feature_arm))"]
    for k in range(rounds):
        out += [f"h{k} AS (SELECT s.fold, s.execution_arm, feature_arm, f, bin, sum(y - pred) AS g, count(*) AS n FROM s{k} s JOIN bn USING (id) WHERE NOT test AND ({use}) GROUP BY ALL)",
                f"w{k} AS (SELECT *, sum(g) OVER x AS gl, sum(n) OVER x AS nl, sum(g) OVER (PARTITION BY fold, execution_arm, feature_arm, f) AS ga, sum(n) OVER (PARTITION BY fold, execution_arm, feature_arm, f) AS na FROM h{k} WINDOW x AS (PARTITION BY fold, execution_arm, feature_arm, f ORDER BY bin))",
                f"c{k} AS (SELECT fold, execution_arm, feature_arm, f, bin, gl / nl AS low, (ga - gl) / (na - nl) AS high, row_number() OVER (PARTITION BY fold, execution_arm, feature_arm ORDER BY round(gl * gl / nl + (ga - gl) * (ga - gl) / (na - nl), 12) DESC, f, bin) AS rn FROM w{k} WHERE nl >= {least} AND na - nl >= {least})",
                f"s{k + 1} AS (SELECT s.* EXCLUDE (pred), pred + coalesce({rate} * CASE WHEN bn.bin <= c.bin THEN low ELSE high END, 0) AS pred FROM s{k} s LEFT JOIN c{k} c ON c.rn = 1 AND c.fold = s.fold AND c.execution_arm = s.execution_arm AND c.feature_arm = s.feature_arm LEFT JOIN bn ON bn.id = s.id AND bn.f = c.f)"]
    return ",\n".join(out)


def boosting_rows(r):
    return stage(bo.fold_rows(gate_panel(r), ["family_id"], "arm", BOOST_FEATURES, "fwd_1m", "available_at", "assessment_date", 24), "fold-rows")


@query("m3_walk_forward_boosting", f"""
WITH {boosting_sql(4, 0.1, 8, 10)}
SELECT fold, execution_arm, feature_arm, family_id, {R('pred')} AS predicted, {R('y')} AS realized FROM s4 WHERE test AND pred IS NOT NULL""")
def m3_boosting(r):
    """Every month from the 25th on, both execution arms and both feature arms."""
    out = bo.boosted_stumps(boosting_rows(r), ["family_id"], FEATURE_ARMS, rounds=4, rate=0.1, bins=8, least=10)
    return out.select("fold", "execution_arm", "feature_arm", "family_id", rnd("predicted").alias("predicted"), rnd("realized").alias("realized"))


@query("m3_fold_manifest", f"""
WITH {BOOST_ROWS} SELECT fold, execution_arm, count(*) FILTER (NOT test) AS train_rows, count(*) FILTER (test) AS test_rows, max(known_at) FILTER (NOT test) AS last_train, coalesce(max(known_at) FILTER (NOT test) > fold, false) AS leak FROM fr GROUP BY 1, 2""")
def m3_manifest(r):
    return bo.manifest(boosting_rows(r))


def regression_sql() -> str:
    parts, rows = [], []
    for arm in ("F", "O"):
        for name, features in FEATURE_ARMS.items():
            own = f"rg_{arm}_{name}"
            parts.append(ridge_sql(own, features, "fwd_1m", "available_at").replace(f"{own}_tr AS (SELECT t, fwd_1m AS y", f"{own}_tr AS (SELECT t, fwd_1m AS y", 1).replace("WHERE fwd_1m IS NOT NULL", f"WHERE arm = '{arm}' AND fwd_1m IS NOT NULL", 1))
            rows.append(f"SELECT p.assessment_date AS fold, p.arm AS execution_arm, '{name}' AS feature_arm, p.family_id, {R('p.p')} AS predicted FROM {own} p JOIN mp USING (family_id, arm, assessment_date) WHERE p.arm = '{arm}' AND fwd_1m IS NOT NULL")
    return "WITH " + MODEL_ROWS + ",\n" + ",\n".join(parts) + "\n" + " UNION ALL ".join(rows)


@query("m3_walk_forward_regression", regression_sql())
def m3(r):
    """Monthly ridge per execution arm, both feature arms from one set of moments."""
    panel = stage(gate_panel(r), "gate-panel")
    out = None
    for arm in [x["arm"] for x in panel.select("arm").distinct().orderBy("arm").collect()]:          # execution arms, a handful
        scored = mo.walk_forward_ridges(panel.where(F.col("arm") == arm), FEATURE_ARMS, "fwd_1m", "available_at", min_months=24).where("fwd_1m IS NOT NULL")
        rows = scored.select(F.col("assessment_date").alias("fold"), F.col("arm").alias("execution_arm"), "family_id", F.inline(F.array(*[F.struct(F.lit(n).alias("feature_arm"), rnd(n).alias("predicted")) for n in FEATURE_ARMS])))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("m4_pairwise_choice", """
WITH RECURSIVE pr AS (SELECT a.decision_date, a.ticker, a.arm, a.h_bucket AS ba, b.h_bucket AS bb, a.score - b.score AS x, a.realized - b.realized AS y FROM x_sets a JOIN x_sets b ON a.decision_date = b.decision_date AND a.ticker = b.ticker AND a.arm = b.arm
  AND CASE a.h_bucket WHEN 'SHORT' THEN 1 WHEN 'MID' THEN 2 ELSE 3 END < CASE b.h_bucket WHEN 'SHORT' THEN 1 WHEN 'MID' THEN 2 ELSE 3 END),
k AS (SELECT x, (y > 0)::INT AS y FROM pr WHERE y <> 0 AND decision_date + INTERVAL 1 MONTH < DATE '1999-01-01'), sc AS (SELECT stddev_samp(x) AS sd, count(*) AS n FROM k), z AS (SELECT x / sd AS z, y, n FROM k, sc),
st AS (SELECT 0 AS i, 0.0::DOUBLE AS b UNION ALL SELECT i + 1, b - (sum((1 / (1 + exp(-b * z)) - y) * z) + b) / (sum(z * z * (1 / (1 + exp(-b * z))) * (1 - 1 / (1 + exp(-b * z)))) + 1) FROM st, z WHERE i < 30 GROUP BY i, b),
m AS (SELECT arg_max(b, i) / any_value(sd) AS w FROM st, sc), p AS (SELECT pr.*, 1 / (1 + exp(-w * x)) AS p FROM pr, m WHERE decision_date >= DATE '1999-01-01'),
win AS (SELECT decision_date, ticker, arm, ba AS h_bucket, p AS v FROM p UNION ALL SELECT decision_date, ticker, arm, bb, 1 - p FROM p)
SELECT s.decision_date, s.ticker, s.arm, s.h_bucket, """ + R("coalesce(sum(v), 0)", 4) + """ AS expected_wins, count(v) AS pairs FROM (SELECT DISTINCT decision_date, ticker, arm, h_bucket FROM x_sets WHERE decision_date >= DATE '1999-01-01') s LEFT JOIN win USING (decision_date, ticker, arm, h_bucket) GROUP BY 1, 2, 3, 4""")
def m4(r):
    sets = stage(r.sets(), "sets")
    # the outcome of a month's set is known a month later
    pairs = bucket_pairs(sets, KEYS).withColumn("matured_date", F.add_months("decision_date", 1))
    return mo.pairwise_expected_wins(pairs, sets, KEYS, "1999-01-01").withColumn("expected_wins", rnd("expected_wins", 4))


@query("m5_rank_ensemble", f"""
WITH s AS (SELECT decision_date, ticker, arm, h_bucket, score AS a, n_events::DOUBLE AS b FROM x_sets),
k AS (SELECT *, coalesce(({AVG_RANK.format(p='decision_date, arm', x='a')} - 1) / nullif(count(*) OVER (PARTITION BY decision_date, arm) - 1, 0), 1) AS pa, coalesce(({AVG_RANK.format(p='decision_date, arm', x='b')} - 1) / nullif(count(*) OVER (PARTITION BY decision_date, arm) - 1, 0), 1) AS pb FROM s)
SELECT decision_date, ticker, arm, h_bucket, {R('(pa + pb) / 2')} AS ensemble FROM k""")
def m5(r):
    s = stage(r.sets().select("decision_date", "ticker", "arm", "h_bucket", F.col("score").alias("a"), F.col("n_events").cast("double").alias("b")), "sets")
    return mo.rank_ensemble(s, ["decision_date", "arm"], ["a", "b"]).select("decision_date", "ticker", "arm", "h_bucket", rnd("ensemble").alias("ensemble"))


@query("m6_batch_scoring", f"""
SELECT family_id, arm, assessment_date, 1 AS horizon, {R('0.001 + 0.5 * coalesce(excess_1m, 0) - 0.1 * coalesce(trailing_3m, 0)')} AS model_score FROM x_fmp UNION ALL SELECT family_id, arm, assessment_date, 3, {R('0.002 + 0.3 * coalesce(trailing_3m, 0)')} FROM x_fmp""")
def m6(r):
    out = mo.linear_scores(r.family_panel(), {1: {"excess_1m": 0.5, "trailing_3m": -0.1}, 3: {"trailing_3m": 0.3}}, {1: 0.001, 3: 0.002})
    return out.select("family_id", "arm", "assessment_date", "horizon", rnd("model_score").alias("model_score"))


M7 = f"""p AS (SELECT c AS candidate_id, year(decision_date)::INT AS fold_id, CASE c WHEN 'RAW' THEN score * 0.1 WHEN 'TILT' THEN score * 0.05 + (ticker % 7) * 0.01 ELSE -score * 0.1 END AS prediction, excess FROM x_panel, (SELECT unnest(['RAW', 'TILT', 'REVERSED']) AS c)),
k AS (SELECT *, {AVG_RANK.format(p='candidate_id, fold_id', x='prediction')} AS rx, {AVG_RANK.format(p='candidate_id, fold_id', x='excess')} AS ry FROM p),
m AS (SELECT candidate_id, fold_id, {R('coalesce(corr(rx, ry), 0)')} AS spearman, {R('avg(abs(prediction - excess))')} AS mae FROM k GROUP BY 1, 2 HAVING count(*) >= 20)"""


def recipe_folds(r):
    s = F.col("score")
    cands = F.array(*[F.struct(F.lit(n).alias("candidate_id"), c.alias("prediction")) for n, c in (("RAW", s * 0.1), ("TILT", s * 0.05 + (F.col("ticker") % 7) * 0.01), ("REVERSED", -s * 0.1))])
    p = stage(r.panel().select(F.year("decision_date").alias("fold_id"), "excess", F.inline(cands)), "recipe-predictions")
    return ev.fold_predictive_metrics(p, ["candidate_id", "fold_id"], "prediction", "excess", 20).withColumns({"spearman": rnd("spearman"), "mae": rnd("mae")})


@query("m7_recipe_selection", f"""
WITH {M7}, g AS (SELECT candidate_id, {R('median(spearman)')} AS median_spearman, {R('avg(spearman)')} AS mean_spearman, {R('avg((spearman > 0)::INT)')} AS positive_fraction, {R('avg(mae)')} AS mean_mae, count(*) AS fold_count FROM m GROUP BY 1 HAVING count(*) >= 3)
SELECT *, row_number() OVER (ORDER BY median_spearman DESC, mean_spearman DESC, positive_fraction DESC, mean_mae, candidate_id) AS rank FROM g""")
def m7(r):
    return mo.select_recipe(recipe_folds(r), 3)


@query("m8_recipe_timeline", f"""
WITH f AS (SELECT treatment AS candidate_id, fold, avg(cagr_excess) AS metric, make_date(fold, 12, 31) AS available_at FROM x_surf GROUP BY 1, 2), c AS (SELECT max(date) AS t FROM x_sessions GROUP BY date_trunc('quarter', date)),
s AS (SELECT t, candidate_id, count(*) AS fold_count, {R('median(metric) + 0.5 * avg(metric) - 0.5 * stddev_pop(metric) - 0.02 * avg((metric <= 0)::INT)')} AS robust_score FROM c JOIN f ON available_at <= t GROUP BY 1, 2),
w AS (SELECT t, candidate_id AS winner FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY robust_score DESC, candidate_id) AS rn FROM s) WHERE rn = 1), x AS (SELECT t, winner, coalesce(lag(winner) OVER (ORDER BY t) <> winner, false)::INT AS changed FROM w)
SELECT t, winner, changed, CAST(sum(changed) OVER (ORDER BY t) AS BIGINT) AS changes_so_far FROM x""")
def m8(r):
    from chronopanel.operators.schedules import recipe_assessments
    f = (r.surface().groupBy(F.col("treatment").alias("candidate_id"), "fold").agg(F.avg("cagr_excess").alias("metric")).withColumn("available_at", F.make_date("fold", F.lit(12), F.lit(31))))
    times = r.sessions().groupBy(F.trunc("date", "quarter")).agg(F.max("date").alias("t")).select("t")
    w = Window.orderBy("t")
    x = recipe_assessments(f, times).withColumn("changed", F.coalesce(F.lag("winner").over(w) != F.col("winner"), F.lit(False)).cast("int"))
    return x.select("t", "winner", "changed", F.sum("changed").over(w).alias("changes_so_far"))


# ---- function surface -----------------------------------------------------

@query("u1_aggregate_columns", f"""
WITH g AS (SELECT ticker, count(*) AS n, count(*) FILTER (excess > 0) AS k, sum(hold * hold)::DOUBLE / (sum(hold)::DOUBLE * sum(hold)::DOUBLE) AS h, {R('median(excess) + 0.5 * avg(excess) - 0.5 * stddev_pop(excess) - 0.02 * avg((excess <= 0)::INT)')} AS robust FROM x_tr GROUP BY 1),
w AS (SELECT *, k / n AS p, 1.959963984540054 AS z FROM g) SELECT ticker, n, {R('h')} AS hhi, robust AS robust_score, {R('greatest(0, ((p + z * z / (2 * n)) / (1 + z * z / n)) - z * sqrt((p * (1 - p) + z * z / (4 * n)) / n) / (1 + z * z / n))')} AS wilson_low FROM w""")
def u1(r):
    from chronopanel.functions.stats import robust_score
    g = r.trade_returns().groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("excess") > 0).alias("k"), rnd(hhi(F.col("hold").cast("double"))).alias("hhi"), rnd(robust_score("excess")).alias("robust_score"))
    return g.select("ticker", "n", "hhi", "robust_score", rnd(wilson(F.col("k"), F.col("n"))[0]).alias("wilson_low"))


@query("u2_python_fold_fallback", f"""
WITH RECURSIVE s AS (SELECT user_id, ts, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
e AS (SELECT user_id, rn, event_id, value AS m FROM s WHERE rn = 1 UNION ALL SELECT s.user_id, s.rn, s.event_id, e.m + 0.25 * (s.value - e.m) FROM e JOIN s ON s.user_id = e.user_id AND s.rn = e.rn + 1)
SELECT user_id, event_id, {R('m', 4)} AS ewma FROM e""")
def u2(r):
    from chronopanel.operators.folds import keyed_fold

    def step(state, row):
        m = row["value"] if state is None else state["m"] + 0.25 * (row["value"] - state["m"])
        return {"m": m}, {"event_id": row["event_id"], "ewma": m}

    ev_ = r.events().select("user_id", "ts", "event_id", "value")
    return keyed_fold(ev_, ["user_id"], ["ts", "event_id"], step, "user_id long, event_id long, ewma double").withColumn("ewma", rnd("ewma", 4))


@query("u3_sql_functions", f"""
SELECT trade_id, {R('0.7 * stock_return + 0.3 * 0.01')} AS shrunk, {R('(10.0 / (10.0 + hold)) ** 2.0')} AS p_zero, {R('CASE WHEN 1 + stock_return > 0 THEN (1 + stock_return) ** (1 / greatest(hold * 7 / 365.25, 1 / 365.25)) - 1 ELSE -1 END', 3)} AS annualized FROM x_tr""")
def u3(r):
    sqlfuncs.register(r.spark)
    return r.trade_returns().selectExpr(
        "trade_id", "round(cp_shrink(stock_return, 0.01D, 7D, 3D) + 1e-9, 6) + 0.0D AS shrunk", "round(cp_zero_probability(2D, 10D, cast(hold AS double)) + 1e-9, 6) + 0.0D AS p_zero",
        "round(cp_annualized(1D, 1D + stock_return, cast(hold * 7 AS double)) + 1e-9, 3) + 0.0D AS annualized")


@query("u4_fold_table_function", """
WITH RECURSIVE f AS (SELECT 0 AS fold, 108 AS vs WHERE (SELECT max(idx) FROM x_sessions) >= 133 UNION ALL SELECT fold + 1, vs + 26 FROM f WHERE vs + 51 <= (SELECT max(idx) FROM x_sessions))
SELECT CAST(fold AS BIGINT) AS fold, CAST(vs - 5 AS BIGINT) AS train_end, CAST(vs AS BIGINT) AS valid_start, CAST(vs + 25 AS BIGINT) AS valid_end FROM f""")
def u4(r):
    sqlfuncs.register(r.spark)
    n = r.sessions().agg(F.count(F.lit(1)).alias("n"))
    n.createOrReplaceTempView("cp_session_count")
    return r.spark.sql("SELECT f.* FROM cp_session_count, LATERAL cp_folds(n, 104, 26, 26, 4) AS f")
