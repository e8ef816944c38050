"""Scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronopanel.catalog.registry import R, query
from chronopanel.functions.rounding import rnd
from chronopanel.sources import scans, stores


@query("s1_guarded_scan", f"""
SELECT CAST(o_orderdate AS DATE) AS decision_date, o_custkey AS ticker, {R('o_totalprice', 2)} AS score
FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '1999-06-30' AND CAST(o_orderdate AS DATE) < DATE '1999-09-01'
  AND o_orderstatus <> 'P'""")
def s1(r):
    # a finished order ('P' = still locked) plays the holdout flag
    panel = scans.guarded_panel(
        r.table("orders"), ["o_orderdate", "o_custkey", "o_totalprice"], date="o_orderdate",
        development_end="1999-06-30", holdout_boundary="1999-09-01", locked=F.col("o_orderstatus") == "P")
    return panel.select(F.to_date("o_orderdate").alias("decision_date"), F.col("o_custkey").alias("ticker"),
                        rnd("o_totalprice", 2).alias("score"))


@query("s1_guarded_scan_date_list", """
SELECT CAST(l_shipdate AS DATE) AS decision_date, count(*) AS n_rows
FROM lineitem WHERE CAST(l_shipdate AS DATE) <= DATE '2000-12-31'
  AND CAST(l_shipdate AS DATE) IN (SELECT max(CAST(l_shipdate AS DATE)) FROM lineitem GROUP BY date_trunc('month', l_shipdate))
GROUP BY 1""")
def s1_dates(r):
    ends = (r.table("lineitem").groupBy(F.trunc("l_shipdate", "month"))
            .agg(F.max(F.to_date("l_shipdate")).alias("date")).select("date"))
    panel = scans.guarded_panel(r.table("lineitem"), ["l_shipdate"], date="l_shipdate",
                                development_end="2000-12-31", holdout_boundary="2001-01-01", dates=ends)
    return panel.groupBy(F.to_date("l_shipdate").alias("decision_date")).agg(F.count(F.lit(1)).alias("n_rows"))


@query("s2_prediction_loader", f"""
SELECT CAST(l_shipdate AS DATE) AS decision_date, CAST(l_suppkey AS VARCHAR) AS ticker, CAST(l_linenumber AS BIGINT) AS horizon,
       {R("try_cast(replace(printf('%.2f', l_discount), '0.07', 'n/a') AS DOUBLE)")} AS score
FROM lineitem WHERE upper(l_returnflag) <> 'N' AND try_cast(replace(printf('%.2f', l_discount), '0.07', 'n/a') AS DOUBLE) IS NOT NULL""")
def s2(r):
    raw = r.table("lineitem").select(
        F.col("l_shipdate").alias("decision_date"), F.col("l_suppkey").alias("ticker"),
        F.col("l_linenumber").alias("horizon_sessions"), F.col("l_returnflag").alias("family"),
        F.expr("replace(format_string('%.2f', l_discount), '0.07', 'n/a')").alias("predicted"))
    return scans.load_predictions(raw, excluded_family="N").select(
        "decision_date", "ticker", "horizon", rnd("score").alias("score"))


@query("s2_prediction_audit", """
SELECT count(*) FILTER (upper(l_returnflag) <> 'N' AND l_discount <> 0.07) AS n_rows,
       count(*) - count(*) FILTER (upper(l_returnflag) <> 'N' AND l_discount <> 0.07) AS excluded_rows,
       count(DISTINCT l_suppkey) FILTER (upper(l_returnflag) <> 'N' AND l_discount <> 0.07) AS n_tickers,
       count(DISTINCT l_linenumber) FILTER (upper(l_returnflag) <> 'N' AND l_discount <> 0.07) AS n_horizons
FROM lineitem""")
def s2_audit(r):
    raw = r.table("lineitem").select(
        F.col("l_shipdate").alias("decision_date"), F.col("l_suppkey").alias("ticker"),
        F.col("l_linenumber").alias("horizon_sessions"), F.col("l_returnflag").alias("family"),
        F.expr("replace(format_string('%.2f', l_discount), '0.07', 'n/a')").alias("predicted"))
    return scans.prediction_audit(raw, excluded_family="N")


@query("s3_holdout_role_audit", """
SELECT 'status' AS role_column, count(*) FILTER (upper(trim(o_orderstatus)) IN ('P')) AS holdout_rows, count(*) AS n_rows FROM orders
UNION ALL
SELECT 'stage', count(*) FILTER (upper(trim(o_orderpriority)) IN ('P', '1-URGENT')), count(*) FROM orders""")
def s3(r):
    frame = r.table("orders").select(F.lower("o_orderstatus").alias("status"),
                                     F.concat(F.lit(" "), "o_orderpriority").alias("stage"))
    audit = scans.holdout_audit(frame, {"status": ["P"], "stage": ["P", "1-URGENT"]})
    return audit


@query("s4_price_panel", f"""
SELECT date, ticker, {R('open')} AS open, {R('close')} AS close FROM x_prices
WHERE (ticker IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) OR ticker = 1) AND open > 0 AND close > 0""")
def s4(r):
    manifest = r.table("supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("ticker"))
    panel = scans.price_panel(r.prices(), manifest, benchmark=1)
    return panel.select("date", "ticker", rnd("open").alias("open"), rnd("close").alias("close"))


@query("s4_missing_tickers", """
SELECT c_custkey AS ticker FROM customer WHERE c_acctbal > 9000 AND c_custkey NOT IN (SELECT l_suppkey FROM lineitem)""")
def s4_missing(r):
    wanted = r.table("customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("ticker"))
    return scans.missing_tickers(wanted, r.daily())


@query("s5_daily_projection", f"""
SELECT p.day AS date, p.ticker, {R('CASE WHEN p.vol >= 5 THEN p.lo WHEN f.lo IS NOT NULL THEN f.lo ELSE p.lo END')} AS open,
       p.vol >= 5 AS quality_ok,
       CASE WHEN p.vol >= 5 THEN 'primary' WHEN f.lo IS NOT NULL THEN 'fallback' ELSE 'primary' END AS provider
FROM x_daily p LEFT JOIN (SELECT CAST(o_orderdate AS DATE) AS day, o_custkey AS ticker, min(o_totalprice) / 5000.0 AS lo
                          FROM orders GROUP BY 1, 2) f ON f.day = p.day AND f.ticker = p.ticker""")
def s5(r):
    primary = r.daily().select(F.col("day").alias("date"), "ticker", F.col("lo").alias("open"),
                               (F.col("vol") >= 5).alias("quality_ok"))
    fallback = (r.table("orders").groupBy(F.to_date("o_orderdate").alias("date"), F.col("o_custkey").alias("ticker"))
                .agg((F.min("o_totalprice") / 5000.0).alias("open")))
    return scans.repair_with_fallback(primary, fallback, ["date", "ticker"], "open", "quality_ok").select(
        "date", "ticker", rnd("open").alias("open"), "quality_ok", "provider")


@query("s6_replay_inputs", f"""
SELECT day AS date, ticker, {R('lo')} AS open FROM x_daily
WHERE ticker = 1 OR (day BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' AND vol >= 10)""")
def s6(r):
    frame = r.daily().select(F.col("day").alias("date"), "ticker", F.col("lo").alias("open"),
                             (F.col("vol") >= 10).alias("boundary_ok"))
    return scans.replay_inputs(frame, 1, "1997-01-01", "1998-12-31").select("date", "ticker", rnd("open").alias("open"))


@query("s7_raw_bar_audit", """
SELECT event_type AS source, count(*) AS n_lines,
       count(*) FILTER (try_cast(props AS JSON) IS NULL) AS invalid_json,
       count(*) FILTER (event_id % 5 = 4) AS missing_timestamp,
       min(date_trunc('second', ts)) FILTER (event_id % 5 <> 4) AS first_ts,
       max(date_trunc('second', ts)) FILTER (event_id % 5 <> 4) AS last_ts
FROM events GROUP BY 1""")
def s7(r):
    # the event table re-read as raw JSON lines whose timestamp key varies by line
    e = r.events()
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    key = F.element_at(F.array(*[F.lit(k) for k in ("t", "timestamp", "ts", "time", "none")]),
                       (F.col("event_id") % 5 + 1).cast("int"))
    lines = e.select(F.col("event_type").alias("source"),
                     F.to_json(F.map_from_arrays(F.array(key, F.lit("k")), F.array(stamp, F.col("props")))).alias("value"))
    return scans.raw_bar_audit(lines)


@query("s8_model_scan", f"""
SELECT decision_date, ticker, model_id, {R('score', 2)} AS score FROM x_ord
WHERE model_id IN (SELECT model_id FROM x_sched WHERE family_id = 'BUILDING' AND activation_date < DATE '1995-04-01')""")
def s8(r):
    ids = r.schedule().where("family_id = 'BUILDING' AND activation_date < '1995-04-01'").select("model_id").distinct()
    return stores.scan_models(r.order_signals(), ids).select("decision_date", "ticker", "model_id",
                                                             rnd("score", 2).alias("score"))


@query("s9_family_store", """
SELECT family_id, count(*) AS n_rows, min(decision_date) AS first_date, max(decision_date) AS last_date
FROM x_ord GROUP BY 1""")
def s9(r):
    store = stores.FamilyStore.fresh(r.spark)
    store.publish(r.order_signals())
    return store.row_counts()


@query("s10_immutable_write", """
SELECT 'MISS' AS first_write, 'HIT' AS second_write, 'CONFLICT' AS changed_write, count(*) AS n_rows
FROM x_panel""")
def s10(r):
    return stores.immutable_roundtrip(r.panel())


@query("s11_append_sink", f"""
SELECT year(decision_date) AS yr, count(*) AS n_rows, {R('sum(score)', 2)} AS total FROM x_ord GROUP BY 1""")
def s11(r):
    """Four chunks by year; the second comes with wider types."""
    sig = r.order_signals().withColumn("yr", F.year("decision_date").cast("long"))
    wider = lambda chunk, epoch: chunk.withColumns({"score": F.col("score").cast("decimal(30,6)"), "yr": F.col("yr").cast("string")}) if epoch == 1 else chunk
    table = stores.append_chunks(r.spark, [sig.where(F.pmod("yr", F.lit(4)) == k) for k in range(4)], wider)
    return table.groupBy("yr").agg(F.count(F.lit(1)).alias("n_rows"), rnd(F.sum("score"), 2).alias("total"))


@query("s12_upsert_sum", """
SELECT decision_date, ticker, arm, h_bucket, CAST(sum(n_families) AS BIGINT) AS eligible_family_count
FROM x_sets GROUP BY 1, 2, 3, 4""")
def s12(r):
    parts = [r.sets().where(F.col("arm") == a) for a in ("F", "O")]
    return stores.merge_partials(parts, ["decision_date", "ticker", "arm", "h_bucket"],
                                 {"n_families": "eligible_family_count"})


@query("s13_cell_documents", f"""
SELECT h, d, treatment, status, fold, {R('cagr_excess')} AS cagr_excess FROM (
  SELECT h, d, treatment, CASE WHEN (h + d) % 4 = 0 THEN 'FAILED' ELSE 'COMPLETE' END AS status, fold, cagr_excess
  FROM x_surf) WHERE status = 'COMPLETE'""")
def s13(r):
    # a document holds one cell: at most one outer row per fold year
    docs = r.surface().groupBy("h", "d", "treatment").agg(F.collect_list(F.struct("fold", "cagr_excess")).alias("outer_rows")).withColumn(
        "status", F.when((F.col("h") + F.col("d")) % 4 == 0, "FAILED").otherwise("COMPLETE"))
    path = stores.write_json(r.spark, docs, "cells")
    cells = stores.read_cell_documents(r.spark, path)
    return cells.select(F.col("h").cast("int").alias("h"), F.col("d").cast("int").alias("d"), "treatment", "status",
                        F.col("fold").cast("int").alias("fold"), rnd("cagr_excess").alias("cagr_excess"))


@query("s14_candidate_metrics", f"""
SELECT h, treatment AS candidate_id, count(*) AS fold_count, {R('avg(cagr_excess)')} AS mean_metric
FROM x_surf WHERE make_date(fold, 12, 31) <= DATE '1999-12-31' AND d > 1 GROUP BY 1, 2""")
def s14(r):
    rows = r.surface().select(
        "h", F.col("treatment").alias("candidate_id"), (F.col("d") > 1).alias("selection_only"),
        F.format_string("wf_%d-01-01_%d-12-31_D%d", "fold", "fold", "d").alias("fold_id"), "cagr_excess")
    path = stores.write_json(r.spark, rows, "metrics")
    return stores.candidate_choices(r.spark, path, "1999-12-31").select(
        F.col("h").cast("int").alias("h"), "candidate_id", "fold_count", rnd("mean_metric").alias("mean_metric"))


@query("s15_family_metadata", """
SELECT family_id, CAST(substr(family_id, 2, 2) AS INT) AS horizon_h, CAST(substr(family_id, 6, 2) AS INT) AS holding_d,
       CAST(substr(family_id, 10, 2) AS INT) AS max_names_n, substr(family_id, 13) AS exit_mode,
       CASE WHEN CAST(substr(family_id, 2, 2) AS INT) <= 10 THEN 'SHORT'
            WHEN CAST(substr(family_id, 2, 2) AS INT) <= 20 THEN 'MID' ELSE 'LONG' END AS h_bucket
FROM x_fam""")
def s15(r):
    return scans.family_metadata(r.families())


@query("s16_latest_segment", """
SELECT arm AS seed, family_id, CAST(max(year(date)) AS BIGINT) AS latest_segment, count(*) FILTER (year(date) = 2001) AS rows_in_2001
FROM x_ret GROUP BY 1, 2""")
def s16(r):
    rows = r.returns().withColumn("segment", F.year("date")).withColumnRenamed("arm", "seed")
    path = stores.write_segments(r.spark, rows, ["seed", "family_id", "segment"])
    return stores.latest_segments(r.spark, path, 2001)


@query("s17_nav_points", f"""
SELECT date, family_id, {R('strategy_value')} AS nav, {R('bench_value')} AS benchmark_nav, arm FROM x_nav""")
def s17(r):
    docs = r.nav().groupBy("family_id", "arm").agg(F.collect_list(F.struct(
        F.col("date").cast("string").alias("date"), F.col("strategy_value").alias("nav"),
        F.col("bench_value").alias("benchmark_nav"))).alias("points"))
    path = stores.write_json(r.spark, docs, "nav")
    return stores.read_points(r.spark, path).select("date", "family_id", "arm", rnd("nav").alias("nav"),
                                                    rnd("benchmark_nav").alias("benchmark_nav"))


@query("s18_interval_features", """
SELECT f.family_id, f.activation_date, count(*) AS n_rows FROM
 (SELECT *, lead(activation_date) OVER (PARTITION BY family_id ORDER BY activation_date) AS nxt FROM x_sched) f
JOIN x_ord o ON o.family_id = f.family_id AND o.decision_date > f.activation_date AND o.decision_date <= f.nxt
GROUP BY 1, 2""")
def s18(r):
    from pyspark.sql import Window
    w = Window.partitionBy("family_id").orderBy("activation_date")
    spans = r.schedule().withColumn("interval_end", F.lead("activation_date").over(w)).where("interval_end IS NOT NULL")
    hits = scans.interval_slice(spans, r.order_signals(), ["family_id"], "activation_date", "interval_end", "decision_date")
    return hits.groupBy("family_id", "activation_date").agg(F.count(F.lit(1)).alias("n_rows"))


@query("s19_gather_distinct", f"""
SELECT DISTINCT decision_date, ticker, model_id, {R('score', 2)} AS score FROM x_ord WHERE model_id IN ('1-URGENT', '2-HIGH')""")
def s19(r):
    sig = r.order_signals()
    files = [sig, sig.where("model_id = '2-HIGH'")]
    got = stores.gather_signals(r.spark, files, ["1-URGENT", "2-HIGH"], ["decision_date", "ticker", "model_id"])
    return got.select("decision_date", "ticker", "model_id", rnd("score", 2).alias("score"))


@query("s20_report_table", f"""
SELECT family_id, arm, {R('max(strategy_value)')} AS peak FROM x_nav GROUP BY 1, 2""")
def s20(r):
    report = r.nav().groupBy("family_id", "arm").agg(rnd(F.max("strategy_value")).alias("peak"))
    path = stores.write_report(r.spark, report, ["family_id", "arm"])
    return r.spark.read.schema("family_id string, arm string, peak double").csv(path, header=True)
