"""Neighbourhoods, plateaus, audits and content identities."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronopanel.catalog.aggregates import CELL, FOLDS, GATE, hd_folds
from chronopanel.catalog.registry import R, query
from chronopanel.functions.rounding import rnd
from chronopanel.operators import audits as au
from chronopanel.operators import surface as sf
from chronopanel.session import stage

DESIGN = "dg AS (SELECT CAST(h AS INT) AS h, CAST(d AS INT) AS d FROM (SELECT unnest(range(1, 11)) AS h), (SELECT unnest(range(1, 8)) AS d) WHERE d <= h)"
CELLS = f"{FOLDS}, c AS (SELECT h, d, {CELL} FROM f GROUP BY 1, 2), cells AS (SELECT *, {GATE} FROM c), {DESIGN}"
LOCAL = f"""{CELLS},
nb AS (SELECT a.h, a.d, a.median_active, b.h AS bh, b.d AS bd FROM cells a JOIN dg b ON abs(a.h - b.h) <= 1 AND abs(a.d - b.d) <= 1 AND NOT (a.h = b.h AND a.d = b.d)),
ls AS (SELECT nb.h, nb.d, count(*) AS expected_neighbours, count(c2.h) AS local_neighbours, {R('coalesce(avg(c2.robust_gate::INT), 0)')} AS robust_neighbour_fraction, {R('coalesce(median(c2.median_active), 0)')} AS median_neighbour,
  {R('coalesce(min(c2.median_active), 0)')} AS worst_neighbour, {R('coalesce(median(abs(c2.median_active - nb.median_active)), 0)')} AS median_abs_delta FROM nb LEFT JOIN cells c2 ON c2.h = nb.bh AND c2.d = nb.bd GROUP BY 1, 2),
loc AS (SELECT cells.*, expected_neighbours, local_neighbours, robust_neighbour_fraction, median_neighbour, worst_neighbour, median_abs_delta, {R('local_neighbours / expected_neighbours')} AS coverage,
  robust_gate AND local_neighbours = expected_neighbours AND local_neighbours >= 2 AND robust_neighbour_fraction >= 0.5 AND median_neighbour > 0 AS stable FROM cells JOIN ls USING (h, d))"""


def local_cells(r):
    return sf.local_stability(sf.cell_aggregate(hd_folds(r), ["h", "d"]), sf.expected_cells(r.spark, 10, 7))


@query("k7_grid_neighbours", f"WITH {LOCAL} SELECT h, d, robust_gate, expected_neighbours, local_neighbours, coverage, robust_neighbour_fraction, median_neighbour, worst_neighbour, median_abs_delta, stable FROM loc")
def k7(r):
    return local_cells(r).select("h", "d", "robust_gate", "expected_neighbours", "local_neighbours", "coverage", "robust_neighbour_fraction", "median_neighbour", "worst_neighbour", "median_abs_delta", "stable")


@query("k8_connected_plateaus", f"""
WITH RECURSIVE {LOCAL}, st AS (SELECT *, h * 1000000 + d AS id FROM loc WHERE median_active > 0.0045),
reach AS (SELECT id AS src, h, d, id FROM st UNION SELECT r.src, s.h, s.d, s.id FROM reach r JOIN st s ON abs(r.h - s.h) <= 1 AND abs(r.d - s.d) <= 1),
comp AS (SELECT id, min(src) AS component FROM reach GROUP BY 1),
pl AS (SELECT component, count(*) AS cells, min(h) AS h_min, max(h) AS h_max, min(d) AS d_min, max(d) AS d_max, {R('min(median_active)')} AS worst_cell, {R('median(median_active)')} AS median_cell, {R('median(q25_active)')} AS median_q25,
  min(positive_active_fraction) AS min_positive, CAST(sum(trade_count) AS BIGINT) AS total_trades FROM st JOIN comp USING (id) GROUP BY 1)
SELECT CAST(component AS BIGINT) AS component, cells, h_min, h_max, d_min, d_max, worst_cell, median_cell, median_q25, min_positive, total_trades,
 row_number() OVER (ORDER BY worst_cell DESC, median_q25 DESC, min_positive DESC, cells DESC, median_cell DESC, component) AS plateau_rank FROM pl""")
def k8(r):
    # the plateau criterion here is a median above 45 bps, which leaves several components
    return sf.plateaus(stage(local_cells(r).withColumn("stable", F.col("median_active") > 0.0045), "cells"))


@query("k8_islands_four_neighbour", f"""
WITH RECURSIVE {CELLS}, st AS (SELECT *, h * 1000000 + d AS id FROM cells WHERE median_active > 0.0045),
reach AS (SELECT id AS src, h, d, id FROM st UNION SELECT r.src, s.h, s.d, s.id FROM reach r JOIN st s ON abs(r.h - s.h) + abs(r.d - s.d) = 1)
SELECT h, d, CAST(min(src) AS BIGINT) AS component FROM reach GROUP BY 1, 2""")
def k8_four(r):
    cells = stage(sf.cell_aggregate(hd_folds(r), ["h", "d"]).where("median_active > 0.0045"), "cells")
    return sf.connected_components(cells, [(0, 1), (1, 0), (0, -1), (-1, 0)])


@query("k9_equal_subwindows", """
WITH d AS (SELECT DISTINCT year(date)::INT AS yr, date FROM x_sessions), n AS (SELECT *, ntile(4) OVER (PARTITION BY yr ORDER BY date) AS part FROM d)
SELECT yr, CAST(part AS INT) AS part, min(date) AS first_date, max(date) AS last_date, count(*) AS sessions FROM n GROUP BY 1, 2 HAVING count(*) >= 3""")
def k9(r):
    s = r.sessions().withColumn("yr", F.year("date")).withColumn("part", F.ntile(4).over(Window.partitionBy("yr").orderBy("date")))
    return s.groupBy("yr", "part").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count(F.lit(1)).alias("sessions")).where("sessions >= 3")


@query("k10_published_order", f"SELECT h, d, treatment, fold, {R('cagr_excess')} AS cagr_excess FROM x_surf ORDER BY h, d, treatment, fold")
def k10(r):
    return r.surface().select("h", "d", "treatment", "fold", rnd("cagr_excess").alias("cagr_excess")).orderBy("h", "d", "treatment", "fold")


# ---- set operations and audits -------------------------------------------

@query("d1_union_partials", "SELECT arm, h_bucket, count(*) AS n_rows FROM x_sets GROUP BY 1, 2")
def d1(r):
    s = r.sets()
    parts = [s.where(F.col("h_bucket") == b) for b in ("SHORT", "MID", "LONG")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("arm", "h_bucket").agg(F.count(F.lit(1)).alias("n_rows"))


@query("d2_surface_coverage", f"""
WITH {DESIGN}, s AS (SELECT h, d, count(*) AS n, max(((h + d) % 4 <> 0)::INT) AS ok FROM (SELECT h, d, treatment FROM x_surf GROUP BY 1, 2, 3) GROUP BY 1, 2),
e AS (SELECT h, d FROM dg UNION ALL SELECT 11, 1), j AS (SELECT e.h AS eh, s.h AS sh, n, ok FROM e FULL JOIN s ON e.h = s.h AND e.d = s.d)
SELECT count(eh) AS expected, count(sh) AS observed, count(*) FILTER (eh IS NOT NULL AND coalesce(ok, 0) = 1) AS complete, count(*) FILTER (eh IS NOT NULL AND sh IS NULL) AS missing,
 count(*) FILTER (eh IS NOT NULL AND coalesce(ok, 0) = 0) AS incomplete, count(*) FILTER (eh IS NULL) AS unexpected, count(*) FILTER (sh IS NOT NULL AND n > 1) AS duplicates,
 count(*) FILTER ((eh IS NOT NULL AND (sh IS NULL OR coalesce(ok, 0) = 0)) OR eh IS NULL OR n > 1) = 0 AS surface_complete FROM j""")
def d2(r):
    status = r.surface().select("h", "d", "treatment").distinct().withColumn("status", F.when((F.col("h") + F.col("d")) % 4 == 0, "FAILED").otherwise("COMPLETE"))
    design = sf.expected_cells(r.spark, 10, 7).unionByName(r.spark.range(1).select(F.lit(11).alias("h"), F.lit(1).alias("d")))
    return sf.coverage_report(status, design, ["h", "d"])


@query("d3_coverage_classes", """
WITH e AS (SELECT family_id, assessment_date FROM x_fmp), g AS (SELECT DISTINCT f.family_id, m.assessment_date FROM (SELECT DISTINCT family_id FROM x_fmp) f, (SELECT DISTINCT assessment_date FROM x_fmp) m),
o AS (SELECT family_id, assessment_date, count(*) AS n FROM x_fmp WHERE trade_count > 0 GROUP BY 1, 2)
SELECT CASE WHEN o.n IS NULL THEN 'MISSING' WHEN o.n = 2 THEN 'COMPLETE' ELSE 'PARTIAL' END AS coverage, count(*) AS n_rows FROM g LEFT JOIN o USING (family_id, assessment_date) GROUP BY 1""")
def d3(r):
    p = r.family_panel()
    observed = p.where("trade_count > 0").select("family_id", "assessment_date", "arm")
    return au.coverage_classes(p.select("family_id").distinct(), p.select("assessment_date").distinct(), observed, 2)


@query("d4_exact_deduplication", """
SELECT count(*) AS n_rows, (SELECT count(*) FROM lineitem) - count(*) AS exact_duplicates, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS key_conflicts FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem)""")
def d4(r):
    return au.deduplication_audit(r.table("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), ["l_orderkey", "l_linenumber"])


@query("d5_input_manifest", """
WITH d AS (SELECT day, count(*) AS u FROM x_daily GROUP BY 1), b AS (SELECT CAST(x AS DATE) AS day FROM (SELECT unnest(generate_series((SELECT min(day) FROM d)::TIMESTAMP, (SELECT max(day) FROM d)::TIMESTAMP, INTERVAL 1 DAY)) AS x) WHERE isodow(x) <= 5)
SELECT (SELECT CAST(sum(u) AS BIGINT) FROM d) AS n_rows, (SELECT count(*) FROM (SELECT day, ticker FROM x_daily GROUP BY 1, 2 HAVING count(*) > 1)) AS duplicate_keys, (SELECT min(day) FROM d) AS first_day, (SELECT max(day) FROM d) AS last_day,
 (SELECT min(u) FROM d) AS min_universe, (SELECT max(u) FROM d) AS max_universe, (SELECT count(*) FROM b WHERE day NOT IN (SELECT day FROM d)) AS missing_business_days""")
def d5(r):
    return au.input_manifest(r.daily(), "day", "ticker")


@query("d6_observation_audit", """
SELECT count(*) AS n_rows, count(*) FILTER (NOT decision_date < terminal_date) AS bad_order, count(*) FILTER (terminal_date > DATE '2000-12-31') AS unmatured, count(*) FILTER (excess IS NULL OR isnan(excess) OR isinf(excess)) AS non_finite,
 count(*) FILTER (decision_date >= DATE '2001-06-01') AS holdout_rows, 0::BIGINT AS duplicate_keys FROM x_panel""")
def d6(r):
    return au.oos_audit(r.panel(), ["decision_date", "ticker"], "2000-12-31", "2001-06-01", "excess")


@query("d7_prediction_interval_audit", """
WITH i AS (SELECT family_id, activation_date, lead(activation_date) OVER (PARTITION BY family_id ORDER BY activation_date) AS nxt FROM x_sched),
j AS (SELECT o.decision_date, o.family_id, count(i.activation_date) AS n FROM x_ord o LEFT JOIN i ON i.family_id = o.family_id AND o.decision_date >= i.activation_date AND (i.nxt IS NULL OR o.decision_date < i.nxt) GROUP BY o.decision_date, o.family_id, o.ticker, o.model_id)
SELECT family_id, count(*) AS n_rows, count(*) FILTER (n = 0) AS uncovered, count(*) FILTER (n > 1) AS ambiguous FROM j GROUP BY 1""")
def d7(r):
    return au.interval_audit(r.order_signals(), r.schedule(), "family_id", "decision_date", "activation_date")


@query("d8_schedule_audit", """
SELECT family_id, count(*) AS activations, count(*) - count(DISTINCT activation_date) AS same_date_conflicts, count(DISTINCT model_id) AS models, count(DISTINCT model_id) = 1 AND count(DISTINCT threshold) = 1 AS frozen, min(activation_date) AS first_activation FROM x_sched GROUP BY 1""")
def d8(r):
    return au.schedule_audit(r.schedule())


@query("d9_store_coverage", "SELECT ticker, min(day) AS first_day, max(day) AS last_day, count(*) AS n_days, min(day) <= DATE '1995-03-01' AND max(day) >= DATE '2001-09-01' AS spans_window FROM x_daily GROUP BY 1")
def d9(r):
    return au.store_coverage(r.daily(), "1995-03-01", "2001-09-01")


@query("d10_boundary_quality", """
WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, min(ts) AS f, max(ts) AS l FROM events GROUP BY 1, 2), s AS (SELECT CAST(ts AS DATE) AS day, min(ts) AS o, max(ts) AS c FROM events GROUP BY 1)
SELECT user_id, day, CAST(date_diff('second', o, f) AS BIGINT) AS open_delay, date_diff('second', o, f) BETWEEN 0 AND 14400 AS open_ok, abs(date_diff('second', l, c)) <= 14400 AS close_ok FROM d JOIN s USING (day)""")
def d10(r):
    return au.boundary_quality(r.events(), 14400)


@query("d11_provider_difference", f"""
WITH f AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS date, o_custkey AS ticker, min(o_totalprice) / 2000.0 AS alt FROM orders GROUP BY 1, 2), j AS (SELECT abs(alt / close - 1) * 10000 AS bps FROM x_prices JOIN f USING (date, ticker))
SELECT count(*) AS n_rows, {R('median(bps)', 3)} AS median_bps, {R('quantile_cont(bps, 0.95)', 3)} AS p95_bps, {R('quantile_cont(bps, 0.99)', 3)} AS p99_bps, {R('max(bps)', 3)} AS max_bps, count(*) FILTER (bps > 500) AS over_500, count(*) FILTER (bps > 1000) AS over_1000 FROM j""")
def d11(r):
    alt = r.table("orders").groupBy(F.date_trunc("week", "o_orderdate").cast("date").alias("date"), F.col("o_custkey").alias("ticker")).agg((F.min("o_totalprice") / 2000.0).alias("alt"))
    return au.provider_difference(r.prices(), alt, ["date", "ticker"], "close", "alt", (500, 1000))


@query("d12_score_parity", f"""
WITH v AS (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS decision_date, l_suppkey AS ticker, max(l_extendedprice * (1 - l_tax)) / 100000.0 AS s2 FROM lineitem GROUP BY 1, 2), j AS (SELECT score, s2 FROM x_signals JOIN v USING (decision_date, ticker)), q AS (SELECT quantile_cont(score, [0.5, 0.75, 0.9, 0.95]) AS q FROM x_signals)
SELECT count(*) AS n_rows, {R('max(abs(score - s2))')} AS max_abs_delta, {', '.join(f"count(*) FILTER ((score >= q[{i}]) <> (s2 >= q[{i}])) AS mismatch_{n}" for i, n in ((1, 50), (2, 75), (3, 90), (4, 95)))} FROM j, q""")
def d12(r):
    r.share("signals")
    v = r.table("lineitem").groupBy(F.date_trunc("week", "l_shipdate").cast("date").alias("decision_date"), F.col("l_suppkey").alias("ticker")).agg(
        (F.max(F.col("l_extendedprice") * (1 - F.col("l_tax"))) / 100000.0).alias("s2"))
    return au.score_parity(r.signals(), v, ["decision_date", "ticker"], "score", "s2", {50: 0.5, 75: 0.75, 90: 0.9, 95: 0.95})


@query("d13_baseline_consistency", """
WITH a AS (SELECT h, treatment, avg(cagr_excess) AS m FROM x_surf GROUP BY 1, 2), b AS (SELECT h, avg(cagr_excess) AS m FROM x_surf GROUP BY 1)
SELECT treatment, count(*) AS cells, count(*) FILTER (abs(a.m - b.m) <= 0.001) AS within_tolerance, bool_and(abs(a.m - b.m) <= 0.001) AS consistent FROM a JOIN b USING (h) GROUP BY 1""")
def d13(r):
    a = r.surface().groupBy("h", "treatment").agg(F.avg("cagr_excess").alias("m"))
    b = r.surface().groupBy("h").agg(F.avg("cagr_excess").alias("m"))
    return au.baseline_consistency(a, b, ["h"], "treatment", "m", 0.001)


@query("d14_execution_quality", f"""
WITH k AS (SELECT *, row_number() OVER (PARTITION BY decision_date ORDER BY score DESC, ticker) AS rn FROM x_signals), p AS (SELECT * FROM k WHERE rn <= 5 AND score >= 0.8),
j AS (SELECT p.*, e.date AS entry_date, b.volume, b.open FROM p JOIN x_sessions d ON d.date = p.decision_date LEFT JOIN x_sessions e ON e.idx = d.idx + 1 LEFT JOIN x_prices b ON b.date = e.date AND b.ticker = p.ticker)
SELECT CAST(year(decision_date) AS INT) AS yr, count(*) AS candidates, count(open) AS executable, count(*) FILTER (open IS NULL) AS missing_next_open, {R('avg(volume)')} AS mean_volume FROM j GROUP BY 1""")
def d14(r):
    r.share("prices", "signals")
    return au.execution_quality(r.signals(), r.prices(), r.sessions(), threshold=0.8, max_names=5)


@query("d15_slice_digest", """
WITH rowh AS (SELECT CAST(o_orderdate AS DATE) AS day, sha256(o_orderkey || '|' || o_custkey || '|' || o_orderstatus || '|' || o_orderpriority) AS h FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '2000-12-31'),
sub AS (SELECT day, substr(h, 1, 4) AS pre, sha256(string_agg(h, '' ORDER BY h)) AS s FROM rowh GROUP BY 1, 2), d AS (SELECT day, sha256(string_agg(pre || s, '' ORDER BY pre)) AS digest FROM sub GROUP BY 1)
SELECT count(*) AS days, sha256(string_agg(strftime(day, '%Y-%m-%d') || digest, '' ORDER BY day)) AS root FROM d""")
def d15(r):
    o = r.table("orders")
    cols = [F.col(c).cast("string") for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")]
    return au.slice_digest(o, F.to_date("o_orderdate"), "2000-12-31", cols)


@query("d16_frame_fingerprint")
def d16(r):
    """Order-independent 64-bit content identity of whole tables (engine-specific hash, so no SQL twin)."""
    from chronopanel.sources.stores import content_fingerprint
    out = None
    for t in ("orders", "customer", "supplier", "part"):
        one = content_fingerprint(r.table(t)).select(F.lit(t).alias("table_name"), "n_rows", "xor_hash", "sum_hash")
        out = one if out is None else out.unionByName(one)
    return out


@query("d17_evidence_growth", """
WITH y AS (SELECT DISTINCT family_id, arm, year(assessment_date)::INT AS yr, quarter(assessment_date)::INT AS q FROM x_fmp WHERE trade_count > 1), s AS (SELECT family_id, arm, yr, list_sort(list(q)) AS qs FROM y GROUP BY 1, 2, 3), l AS (SELECT *, lag(qs) OVER (PARTITION BY family_id, arm ORDER BY yr) AS p FROM s)
SELECT family_id, arm, yr, CAST(len(list_filter(qs, lambda x: NOT list_contains(coalesce(p, []), x))) AS INT) AS added, CAST(len(list_filter(coalesce(p, []), lambda x: NOT list_contains(qs, x))) AS INT) AS lost,
 p IS NULL OR len(list_filter(qs, lambda x: NOT list_contains(p, x))) > 0 AS expanded FROM l""")
def d17(r):
    from chronopanel.operators.schedules import evidence_growth
    s = r.family_panel().where("trade_count > 1").groupBy("family_id", "arm", F.year("assessment_date").alias("yr")).agg(F.collect_set(F.quarter("assessment_date")).alias("qs"))
    return evidence_growth(s, ["family_id", "arm"], "yr", "qs").select("family_id", "arm", "yr", "added", "lost", "expanded")


@query("d18_fold_segment_filter", """
WITH f AS (SELECT arm, date_trunc('quarter', entry_date)::DATE AS fold_id, min(entry_date) AS s, max(exit_date) AS e FROM x_trades GROUP BY 1, 2), c AS (SELECT *, fold_id - 30 AS calibration_end FROM f)
SELECT arm, count(*) AS folds, count(*) FILTER (NOT calibration_end < s) AS not_causal, count(*) FILTER (s <= DATE '1998-06-30' AND e > DATE '1998-06-30') AS straddling, count(*) FILTER (calibration_end < s AND NOT (s <= DATE '1998-06-30' AND e > DATE '1998-06-30')) AS kept FROM c GROUP BY 1""")
def d18(r):
    f = r.trades().groupBy("arm", F.trunc("entry_date", "quarter").alias("fold_id")).agg(F.min("entry_date").alias("s"), F.max("exit_date").alias("e")).withColumn("calibration_end", F.date_sub("fold_id", 30))
    return au.fold_filter_audit(f, "1998-06-30", ["arm"])


@query("d19_feature_coverage_gate", """
SELECT * FROM (SELECT 'orders' AS panel, CAST(max(o_orderdate) AS DATE) AS last_date FROM orders UNION ALL SELECT 'lineitem', CAST(max(l_shipdate) AS DATE) FROM lineitem) p, (SELECT least((SELECT CAST(max(o_orderdate) AS DATE) FROM orders), (SELECT CAST(max(l_shipdate) AS DATE) FROM lineitem)) AS usable_until)""")
def d19(r):
    return au.coverage_gate({"orders": (r.table("orders"), "o_orderdate"), "lineitem": (r.table("lineitem"), "l_shipdate")})
