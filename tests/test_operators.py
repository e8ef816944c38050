"""Brute-force, mutation-invariance and contract tests on small fixtures."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronopanel.contracts import ContractError, assert_unique, checked_join, require_columns
from chronopanel.operators import asof as ao
from chronopanel.operators import calendar as cal
from chronopanel.operators import folds as fo
from chronopanel.operators import models as mo
from chronopanel.operators import ordered as od
from chronopanel.operators import surface as sf
from chronopanel.operators import wealth as wp
from chronopanel.operators.gates import relative_ranks
from chronopanel.session import scratch_path
from chronopanel.sources import scans, stores

DAY = dt.date(2020, 1, 6)


def day(i):
    return DAY + dt.timedelta(days=int(i))


@pytest.fixture(scope="module")
def hot(spark):
    """One date holds a third of all rows, and one score value half of those."""
    rng = np.random.default_rng(1)
    n = 6000
    d = np.where(rng.random(n) < 1 / 3, 0, rng.integers(1, 30, n))
    x = np.where(rng.random(n) < 0.5, 0.25, np.round(rng.random(n), 3))
    pdf = pd.DataFrame({"decision_date": [day(i) for i in d], "ticker": np.arange(n), "score": x, "excess": np.round(rng.normal(size=n), 2)})
    return pdf, spark.createDataFrame(pdf).cache()


def test_ranks_match_pandas_on_hot_groups(hot):
    pdf, df = hot
    got = od.rank_columns(df, ["decision_date"], "score", rank="r", pct="p", dense="d").toPandas().sort_values("ticker").reset_index(drop=True)
    g = pdf.groupby("decision_date")["score"]
    assert np.allclose(got["r"], g.rank(method="average"))
    assert np.allclose(got["p"], g.rank(method="average", pct=True))
    assert (got["d"].to_numpy() == g.rank(method="dense").to_numpy()).all()


def test_quantiles_match_numpy_on_hot_groups(hot):
    pdf, df = hot
    got = od.quantiles(df, ["decision_date"], "score", {"a": 0.1, "b": 0.5, "c": 0.99}).toPandas().set_index("decision_date")
    for d, g in pdf.groupby("decision_date"):
        assert np.allclose(got.loc[d, ["a", "b", "c"]].astype(float), np.quantile(g["score"], [0.1, 0.5, 0.99]))


def test_rank_ic_matches_pandas_and_is_null_when_constant(spark, hot):
    pdf, df = hot
    got = od.rank_ic(df, ["decision_date"], "score", "excess").toPandas().set_index("decision_date")["rank_ic"]
    for d, g in pdf.groupby("decision_date"):
        assert got[d] == pytest.approx(g["score"].rank().corr(g["excess"].rank()))
    flat = spark.createDataFrame([(1, 1.0, float(i)) for i in range(5)], "k int, x double, y double")
    assert od.rank_ic(flat, ["k"], "x", "y").first()["rank_ic"] is None


def test_row_numbers_are_exact_on_hot_days(hot):
    pdf, df = hot
    got = relative_ranks(df).toPandas().set_index("ticker")["daily_rank"]
    want = pdf.sort_values(["decision_date", "score", "ticker"], ascending=[True, False, True]).groupby("decision_date").cumcount() + 1
    assert (got.loc[pdf.loc[want.index, "ticker"]].to_numpy() == want.to_numpy()).all()


def test_top_rows_limits_before_the_shuffle(hot):
    _, df = hot
    plan = od.top_rows(df, ["decision_date"], [F.desc("score"), F.asc("ticker")], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize("strict", [False, True])
def test_asof_matches_pandas(spark, strict):
    rng = np.random.default_rng(2)
    left = pd.DataFrame({"k": rng.integers(0, 4, 400), "t": [day(x) for x in rng.integers(0, 200, 400)], "id": range(400)})
    right = pd.DataFrame({"k": rng.integers(0, 4, 60), "s": [day(x) for x in rng.integers(0, 200, 60)]}).drop_duplicates().reset_index(drop=True)
    right["v"] = range(len(right))
    got = ao.asof_join(spark.createDataFrame(left), spark.createDataFrame(right), ["k"], "t", "s", strict=strict).toPandas().set_index("id")["v"]
    for row in left.itertuples():
        c = right[(right.k == row.k) & ((right.s < row.t) if strict else (right.s <= row.t))]
        want = c.sort_values("s").v.iloc[-1] if len(c) else None
        assert (pd.isna(got[row.id]) and want is None) or got[row.id] == want


def test_asof_ignores_future_rows(spark):
    left = spark.createDataFrame([(1, day(10)), (1, day(20))], "k int, t date")
    sched = [(1, day(0), 1.0), (1, day(15), 2.0)]
    run = lambda rows: sorted(map(tuple, ao.asof_join(left, spark.createDataFrame(rows, "k int, s date, v double"), ["k"], "t", "s").collect()))
    assert run(sched) == run([*sched, (1, day(21), 99.0), (1, day(300), -1.0)])


def test_interval_join_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    a = [(int(i), int(k), day(s), day(s + h)) for i, (k, s, h) in enumerate(zip(rng.integers(0, 3, 80), rng.integers(0, 90, 80), rng.integers(1, 60, 80)))]
    b = [(int(k), day(d)) for k, d in set(zip(rng.integers(0, 3, 90).tolist(), rng.integers(0, 140, 90).tolist()))]
    got = {(r["id"], r["p"]) for r in ao.interval_join(spark.createDataFrame(a, "id int, k int, s date, e date"), spark.createDataFrame(b, "k int, p date"), ["k"], "s", "e", "p").collect()}
    assert got == {(i, p) for i, k, s, e in a for kk, p in b if k == kk and s < p <= e}


def test_maturity_filter_ignores_unmatured_rows(spark):
    s = cal.session_index(spark.createDataFrame([(day(i),) for i in range(10)], "date date"))
    rows = cal.attach_terminal(spark.createDataFrame([(day(i),) for i in range(10)], "decision_date date"), s, 3)
    known = cal.matured(rows, F.lit(day(5))).toPandas()
    assert sorted(known["decision_date"]) == [day(0), day(1), day(2)]
    assert rows.where("terminal_date IS NULL").count() == 3


def test_contracts_raise(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(ContractError):
        require_columns(df, ["missing"])
    with pytest.raises(ContractError):
        assert_unique(df, ["k"])
    with pytest.raises(Exception, match="not unique"):
        checked_join(spark.createDataFrame([(1,)], "k int"), df, ["k"]).collect()
    with pytest.raises(ContractError):
        scans.guarded_panel(df, ["k"], date="k", development_end="2020-02-01", holdout_boundary="2020-01-01")
    bad = spark.createDataFrame([(day(3), day(1), 1, 0.5)], "decision_date date, terminal_date date, ticker int, score double")
    with pytest.raises(ContractError):
        stores.write_immutable(bad, scratch_path(spark, "never-written"), ["decision_date", "ticker"])


def test_guarded_scan_pushes_filters_and_columns(spark, sf_dir):
    df = scans.guarded_panel(spark.read.parquet(f"{sf_dir}/orders.parquet"), ["o_orderdate", "o_custkey"], date="o_orderdate", development_end="1999-06-30", holdout_boundary="1999-09-01")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate), LessThan(o_orderdate" in plan
    assert "o_totalprice" not in plan


def test_wealth_metrics_match_scalar_definition(spark):
    rng = np.random.default_rng(4)
    rel = np.exp(np.cumsum(rng.normal(0, 0.02, 300)))
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "date": [day(i) for i in range(300)], "rel": rel}))
    got = wp.wealth_metrics(df, ["k"]).first()
    s = pd.Series(rel)
    ret, dd = s.pct_change().dropna(), s / s.cummax() - 1
    k, kd = max(1, int(np.ceil(len(ret) * 0.05))), max(1, int(np.ceil(len(dd) * 0.05)))
    assert got["expected_shortfall"] == pytest.approx(ret[ret < 0].sort_values()[:k].mean())
    assert got["cdar"] == pytest.approx(dd[dd < 0].sort_values()[:kd].mean())
    assert got["downside_deviation"] == pytest.approx(np.sqrt((ret.clip(upper=0) ** 2).mean()))
    longest = run = 0
    for v in dd:
        run = run + 1 if v < 0 else 0
        longest = max(longest, run)
    assert got["max_drawdown_sessions"] == longest


def test_connected_components_match_flood_fill(spark):
    rng = np.random.default_rng(5)
    cells = {(int(h), int(d)) for h, d in zip(rng.integers(1, 16, 90), rng.integers(1, 16, 90))}
    got = {(r["h"], r["d"]): r["component"] for r in sf.connected_components(spark.createDataFrame(sorted(cells), "h int, d int")).collect()}
    seen = {}
    for start in sorted(cells):
        if start in seen:
            continue
        stack = [start]
        while stack:
            c = stack.pop()
            if c in seen or c not in cells:
                continue
            seen[c] = start[0] * 1_000_000 + start[1]
            stack += [(c[0] + i, c[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    assert got == seen


def test_ridge_matches_numpy(spark):
    rng = np.random.default_rng(6)
    rows = []
    months = [dt.date(2018 + m // 12, m % 12 + 1, 1) for m in range(36)]
    for i, m in enumerate(months):
        for f in range(8):
            a, b = rng.normal(size=2)
            rows.append((m, f, float(a), None if rng.random() < 0.1 else float(b), float(0.5 * a + rng.normal() * 0.1), months[i + 1] if i + 1 < 36 else None))
    pdf = pd.DataFrame(rows, columns=["assessment_date", "f", "a", "b", "y", "av"])
    df = spark.createDataFrame(rows, "assessment_date date, f int, a double, b double, y double, av date")
    got = mo.walk_forward_ridge(df, ["a", "b"], "y", "av", min_months=24).toPandas()
    t = months[30]
    train, test = pdf[pdf.av.notna() & (pdf.av <= t)], pdf[pdf.assessment_date == t]
    x = train[["a", "b"]].to_numpy(float)
    mean, sd = np.nanmean(x, 0), np.nanstd(x, 0)
    z = lambda v: np.column_stack([np.ones(len(v)), np.nan_to_num((v - mean) / sd)])
    beta = np.linalg.solve(z(x).T @ z(x) + np.eye(3) * 1e-4, z(x).T @ train.y.to_numpy())
    want = dict(zip(test.f, z(test[["a", "b"]].to_numpy(float)) @ beta))
    for r in got[got.assessment_date == t].itertuples():
        assert r.predicted == pytest.approx(want[r.f], abs=1e-9)
    assert min(got.assessment_date) == months[24]


def test_ridge_ignores_future_outcomes(spark):
    months = [dt.date(2018 + m // 12, m % 12 + 1, 1) for m in range(30)]
    base = [(m, f, float((i * 7 + f * 3) % 11), float((i + f) % 5), months[i + 1] if i < 29 else None) for i, m in enumerate(months) for f in range(4)]
    schema = "assessment_date date, f int, a double, y double, av date"
    run = lambda rows: {(r["assessment_date"], r["f"]): r["predicted"] for r in mo.walk_forward_ridge(spark.createDataFrame(rows, schema), ["a"], "y", "av").collect()}
    cut = months[26]
    changed = [(m, f, a, y + 1000 if av is not None and av > cut else y, av) for m, f, a, y, av in base]
    a, b = run(base), run(changed)
    assert all(a[k] == b[k] for k in a if k[0] <= cut)


def test_keyed_fold_keeps_order_and_never_mixes_keys(spark):
    rows = [(k, i, float(i * (k + 1))) for k in range(5) for i in np.random.default_rng(k).permutation(50).tolist()]
    got = fo.ewma(spark.createDataFrame(rows, "k int, t int, v double"), ["k"], "t", "v", span=3).toPandas()
    for k, g in got.groupby("k"):
        want = pd.Series([i * (k + 1.0) for i in range(50)]).ewm(span=3, adjust=False).mean()
        assert np.allclose(g.sort_values("t")["ewma"], want)


def test_decayed_folds_of_long_series(spark):
    """10,000 rows a key, past the reach of a double's ratio ** -t, against plain recursions."""
    rng = np.random.default_rng(3)
    rows = [(k, t, float(v)) for k in ("a", None) for t, v in enumerate(rng.normal(0, 1, 10_000))]
    df = spark.createDataFrame(rows, "k string, t int, v double")
    got, seen = fo.ewma(df, ["k"], "t", "v", span=13).toPandas(), fo.change_detector(df, ["k"], "t", "v", 0.5).toPandas()
    for k in ("a", None):
        v = np.array([x for key, _, x in rows if key == k])
        pick = lambda frame: frame[frame["k"].isna() if k is None else frame["k"] == k].sort_values("t")
        assert np.allclose(pick(got)["ewma"], pd.Series(v).ewm(span=13, adjust=False).mean())
        mean, p, want = 0.0, 0.0, []
        for x in v:
            p = fo.HAZARD + (1 - fo.HAZARD) * (fo.DECAY * p + (1 - fo.DECAY) * min(1.0, max(0.0, (mean - x) / 0.5)))
            mean = fo.DECAY * mean + (1 - fo.DECAY) * x
            want.append(p)
        assert np.allclose(pick(seen)["probability"], want)


def test_hysteresis_rejects_changed_evidence(spark):
    rows = [("k", day(3), day(2), 1, "A", {"A": 1.0, "B": 0.0})]
    run = lambda more: fo.recipe_hysteresis(spark.createDataFrame(rows + more, "k string, assessment_date date, evidence_date date, fingerprint long, winner string, scores map<string,double>"), ["k"]).orderBy("assessment_date").collect()
    for bad, name in ((("k", day(4), day(2), 2, "A", {"A": 1.0}), fo.CHANGED), (("k", day(4), day(1), 1, "A", {"A": 1.0}), fo.BACKWARDS), (("k", day(4), day(3), 2, "B", {"B": 9.0}), fo.INCUMBENT_MISSING),
                      (("k", day(4), day(2), 1, "B", {"B": 9.0}), fo.INCUMBENT_MISSING), (("k", day(4), day(3), 2, "B", {"A": 1.0}), fo.WINNER_MISSING)):
        with pytest.raises(Exception, match=name):
            run([bad])


def test_hysteresis_needs_folds(spark):
    schema = "k string, assessment_date date, evidence_date date, fingerprint long, winner string, scores map<string,double>, folds map<string,long>"
    both = {"A": 1.0, "B": 2.0}
    run = lambda folds: fo.recipe_hysteresis(spark.createDataFrame([("k", day(2), day(1), 1, "A", both, {"A": 3, "B": 3}), ("k", day(3), day(2), 2, "B", both, folds)], schema), ["k"], least_folds=3).collect()
    assert len(run({"A": 3, "B": 4})) == 2
    for folds, name in (({"A": 2, "B": 3}, fo.INCUMBENT_SHORT), ({"A": 3, "B": 2}, fo.WINNER_SHORT), ({"A": 3}, fo.WINNER_SHORT)):
        with pytest.raises(Exception, match=name):
            run(folds)


def test_lifecycle_knows_the_ensemble(spark):
    events = {"none": (False, False, False, 0.0), "candidate": (False, False, True, -1.0), "kill strong": (False, True, True, 1.0), "structural": (True, False, True, 1.0)}
    rows = [(e, 1, *v, "ENSEMBLE") for e, v in events.items()]
    df = spark.createDataFrame(rows, "k string, t int, s boolean, x boolean, c boolean, b double, start string")
    got = fo.lifecycle(df, ["k"], "t", F.col("s"), F.col("x"), F.col("c"), F.col("b"), start=F.col("start")).collect()
    assert {r["k"]: r["state"] for r in got} == {"none": "PROBATION", "candidate": "ENSEMBLE", "kill strong": "PROBATION", "structural": "SUSPENDED"}


def test_hysteresis_confirms_on_two_expansions(spark):
    better = {"A": 1.0, "B": 2.0}
    rows = [("k", day(d), day(e), f, w, better) for d, e, f, w in ((2, 1, 1, "A"), (3, 1, 1, "A"), (4, 2, 1, "A"), (5, 3, 2, "B"), (6, 3, 2, "B"), (7, 4, 3, "B"), (8, 5, 4, "A"), (9, 6, 5, "B"))]
    got = fo.recipe_hysteresis(spark.createDataFrame(rows, "k string, assessment_date date, evidence_date date, fingerprint long, winner string, scores map<string,double>"), ["k"]).orderBy("assessment_date").collect()
    assert [(r["incumbent_after"], r["challenger"], r["confirmations"], r["reason"]) for r in got] == [
        ("A", None, 0, "INITIAL_CAUSAL_RECIPE"), ("A", None, 0, "DUPLICATE_MATURED_EVIDENCE_IGNORED"), ("A", None, 0, "NO_NEW_RECIPE_EVIDENCE"), ("A", "B", 1, "CHALLENGER_CONFIRMATION_PENDING"),
        ("A", "B", 1, "DUPLICATE_MATURED_EVIDENCE_IGNORED"), ("B", "B", 2, "HYSTERESIS_SWITCH_CONFIRMED"), ("B", "A", 0, "NO_STRICT_ROBUST_SCORE_IMPROVEMENT"), ("B", None, 0, "INCUMBENT_RECONFIRMED")]


def test_family_store_replaces_only_published_families(spark):
    df = spark.createDataFrame([("a", day(1), 1.0), ("b", day(1), 2.0)], "family_id string, decision_date date, score double")
    store = stores.FamilyStore.fresh(spark)
    store.publish(df)
    store.publish(df.where("family_id = 'a'").withColumn("score", F.lit(9.0)))
    assert {(r["family_id"], r["score"]) for r in store.read().collect()} == {("a", 9.0), ("b", 2.0)}


def test_tail_sweep_equals_sorted_prefixes():
    rng = np.random.default_rng(12)
    for n in (1, 2, 7, 150):
        ret, dd = rng.normal(0, 1, n).round(1), np.minimum(0, rng.normal(-0.2, 0.3, n)).round(1)
        recovery = np.where(rng.random(n) < 0.3, rng.integers(1, 9, n), np.nan)
        ret[0] = np.nan
        ends = np.unique(rng.integers(0, n, 20))
        for end, got in zip(ends, wp.tail_sweep(ret, dd, recovery, ends, 0.05)):
            worst = lambda x, m: (lambda k: np.mean([v for v in k if v < 0]) if any(v < 0 for v in k) else 0.0)(sorted(x[~np.isnan(x)])[:max(1, int(np.ceil(m * 0.05)))])
            back = recovery[:end + 1][~np.isnan(recovery[:end + 1])]
            assert np.allclose(got, (worst(ret[:end + 1], end), worst(dd[:end + 1], end + 1), np.median(back) if len(back) else 0.0))


def test_ranks_cut_each_group_by_its_own_values(spark, monkeypatch):
    monkeypatch.setattr(od, "RANGE_ROWS", 7)
    monkeypatch.setattr(od, "RANGES", 8)
    rng = np.random.default_rng(21)
    rows = [(g, float(round(rng.normal(offset, scale), 3))) for g, offset, scale, n in (("a", 0, 1, 120), ("b", 1e8, 5, 90), ("c", -3e-5, 1, 40), ("d", 7, 0, 20), ("e", 1, 1, 3)) for _ in range(n)]
    df = spark.createDataFrame(rows, "g string, v double")
    counts = df.groupBy("g", "v").count()
    widest = {r.g: r.n for r in od.with_range(counts, ["g"], "v").groupBy("g", "_range").count().groupBy("g").agg(F.max("count").alias("n")).collect()}
    levels = {g: len({v for k, v in rows if k == g}) for g in widest}
    assert all(widest[g] <= max(7, 2 * levels[g] / 8 + 2) for g in widest)
    frame = pd.DataFrame(rows, columns=["g", "v"])
    want = frame.groupby("g")["v"].rank(method="average")
    got = od.rank_columns(df, ["g"], "v", rank="r").toPandas().sort_values(["g", "v"])["r"].to_numpy()
    assert np.allclose(got, frame.assign(r=want).sort_values(["g", "v"])["r"].to_numpy())
    whole = od.quantiles(df, [], "v", {"q": 0.3}).first()["q"]
    assert np.isclose(whole, np.quantile(frame["v"], 0.3))


def test_ridge_keeps_its_digits_far_from_zero(spark):
    rng = np.random.default_rng(5)
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=30 * k) for k in range(8)]
    rows = [(days[k], days[k + 1] if k < 7 else None, *map(float, x), float(x @ np.arange(1, 13) + rng.normal())) for k in range(8) for x in rng.normal(0, 1, (30, 12))]
    names = [f"x{k}" for k in range(12)]
    schema = "assessment_date date, available_at date, " + ", ".join(f"{n} double" for n in names) + ", y double"
    plain = spark.createDataFrame(rows, schema)
    moved = plain.withColumns({n: F.col(n) + 1e8 for n in names})
    fit = lambda df: np.array([r.predicted for r in mo.walk_forward_ridge(df, names, "y", "available_at", min_months=4).orderBy("assessment_date", "y").collect()])
    a, b = fit(plain), fit(moved)
    assert len(a) == 120 and np.allclose(a, b, rtol=1e-6, atol=1e-6)


def test_epoch_sink_pins_types_and_replays_once(spark):
    sink = stores.EpochSink(spark, scratch_path(spark, "epochs"))
    one = spark.createDataFrame([(1, 0.5)], "k int, v double")
    sink.append(one, 0)
    wider = spark.createDataFrame([(2, "7")], "k long, v string")
    for _ in range(2):
        sink.append(wider, 1)
    assert sorted(map(tuple, sink.read().collect())) == [(1, 0.5), (2, 7.0)] and sink.read().dtypes == one.dtypes
    with pytest.raises(ContractError):
        sink.append(one.withColumn("extra", F.lit(1)), 2)


def test_balanced_policies_cover_every_level(spark):
    from chronopanel.operators.selection import balanced_policies
    got = balanced_policies(spark.createDataFrame([(1,), (2,)], "h int"), [0.5, 0.8, 0.9], [0.01, 0.05], list(range(1, 7)), list(range(1, 11)), 3).toPandas()
    for _, own in got.groupby("h"):
        assert len(own) == 10 and own["d"].nunique() == 10 and own["quantile"].nunique() == 3 and own["top_fraction"].nunique() == 2 and own["max_names"].nunique() == 6
    whole = balanced_policies(spark.createDataFrame([(1,)], "h int"), [0.5, 0.8], [0.01], [1, 2], [1, 2], 99)
    assert whole.count() == 8


def test_decayed_sum_spreads_and_keeps_missing(spark):
    rows = [("k", dt.date(2000, 1, 1) + dt.timedelta(days=d), None if d < 3 or d % 11 == 0 else float(d % 7)) for d in range(0, 2500, 2)]
    got = [r["s"] for r in fo.decayed_sum(spark.createDataFrame(rows, "g string, t date, v double"), ["g"], "t", F.col("v"), 0.8, "s").orderBy("t").collect()]
    s, want = None, []
    for _, _, v in rows:
        s = v if s is None else (v or 0.0) + 0.8 * s
        want.append(s)
    assert [x is None for x in got] == [x is None for x in want] and np.allclose([x for x in got if x is not None], [x for x in want if x is not None])


def test_running_incumbent_needs_its_evidence(spark):
    from chronopanel.operators import resample as rs
    day_of = lambda y: dt.date(y, 12, 31)
    value = {"A": 0.01, "B": 0.03, "C": 0.011}
    metrics = spark.createDataFrame([("h", c, y, day_of(y), value[c] + 0.0001 * (y % 3)) for c in value for y in range(2000, 2012)], "k string, candidate string, fold int, available_at date, metric double")
    scores = lambda *skip: {c: v for c, v in value.items() if c not in skip}
    rows = [("h", day_of(2003), "A", scores()), ("h", day_of(2004), "B", scores()), ("h", day_of(2005), "C", scores()), ("h", dt.date(2006, 1, 15), "A", scores())]
    schema = "k string, t date, winner string, scores map<string,double>"
    got = rs.running_incumbent(spark.createDataFrame(rows, schema), metrics, ["k"], "t", reps=50).orderBy("t").collect()
    assert [(r.before, r.incumbent, r.switched, r.new_folds) for r in got] == [(None, "A", False, False), ("A", "B", True, True), ("B", "B", False, True), ("B", "B", False, False)]
    bad = rows[:2] + [("h", day_of(2005), "C", scores("B"))]
    with pytest.raises(Exception, match=fo.INCUMBENT_MISSING):
        rs.running_incumbent(spark.createDataFrame(bad, schema), metrics, ["k"], "t", reps=50).collect()


def test_set_digests_tell_sets_apart(spark):
    from chronopanel.operators import digests as dg
    a = [("a", 1, "x"), ("a", 2, "y"), ("a", 3, "x"), ("a", 4, "z")]
    b = [("b", 1, "z"), ("b", 2, "x"), ("b", 3, "y"), ("b", 4, None)]
    got = {(r.g, r.t): r for r in dg.prefix_digests(spark.createDataFrame(a + b, "g string, t int, m string"), ["g"], "t", "m").collect()}
    assert [got["a", t].members for t in (1, 2, 3, 4)] == [1, 2, 2, 3] and [got["a", t].seen for t in (1, 2, 3, 4)] == [1, 2, 3, 4]
    assert got["a", 2].identity == got["a", 3].identity != got["a", 1].identity
    assert got["a", 4].identity == got["b", 3].identity == got["b", 4].identity
    many = spark.range(3000).select((F.col("id") % 3).alias("g"), F.col("id").alias("t"), (F.col("id") * 7).cast("string").alias("m"))
    prefixes = dg.prefix_digests(many, ["g"], "t", "m")
    assert prefixes.select("identity").distinct().count() == 3000


def test_running_robust_score_equals_prefixes(spark):
    from chronopanel.operators import digests as dg
    rng = np.random.default_rng(3)
    v = rng.normal(0, 1, 60).round(2)
    got = dg.running_robust_score(spark.createDataFrame([("k", k, float(x)) for k, x in enumerate(v)], "k string, t int, v double"), ["k"], "t", "v").orderBy("t").collect()
    for k, r in enumerate(got):
        p = v[:k + 1]
        assert np.isclose(r.median, np.median(p)) and np.isclose(r.robust, np.median(p) + 0.5 * p.mean() - 0.5 * p.std() - 0.02 * (p <= 0).mean()) and r.n == k + 1


def test_stumps_learn_a_step_without_later_targets(spark):
    from chronopanel.operators import boosting as bo
    months = [dt.date(2020 + k // 12, k % 12 + 1, 1) for k in range(8)]
    rows = [(months[k], months[k + 1] if k < 7 else None, "X", i, float(i), float((i >= 20) * 2 - 1) if k < 6 else 99.0) for k in range(8) for i in range(40)]
    panel = spark.createDataFrame(rows, "d date, known date, arm string, i int, x double, y double")
    folds = bo.fold_rows(panel, ["i"], "arm", ["x"], "y", "known", "d", 3)
    got = bo.boosted_stumps(folds, ["i"], {"ALL": ["x"]}, rounds=4, rate=0.5, bins=8, least=5)
    early = {(r.fold, r.i): r.predicted for r in got.where("fold < '2020-07-01'").collect()}
    assert early and all(abs(p - ((i >= 20) * 2 - 1)) < 0.1 for (_, i), p in early.items())
    assert not bo.manifest(folds).where("leak").count()
