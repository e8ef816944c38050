"""Data audits: single-pass counts, coverage classes, digests."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopanel.functions.rounding import rnd
from chronopanel.functions.stats import median, quantile
from chronopanel.operators.asof import asof_join
from chronopanel.operators.ordered import quantiles, top_rows


def coverage_classes(units: DataFrame, dates: DataFrame, observed: DataFrame, expected_rows: int) -> DataFrame:
    """Expected keys (registry x calendar) against observed rows: COMPLETE, PARTIAL or MISSING."""
    u, d = units.columns[0], dates.columns[0]
    calendar = dates.agg(F.collect_set(d).alias("_d"))                    # one row per calendar date
    expected = units.withColumn("_d", calendar.scalar()).select(u, F.explode("_d").alias(d))
    seen = observed.groupBy(u, d).agg(F.count(F.lit(1)).alias("n"))
    label = F.when(F.col("n").isNull(), "MISSING").when(F.col("n") == expected_rows, "COMPLETE").otherwise("PARTIAL")
    return expected.join(seen, [u, d], "left").groupBy(label.alias("coverage")).agg(F.count(F.lit(1)).alias("n_rows"))


def deduplication_audit(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exact duplicates removed and keys that still disagree, from one grouped pass."""
    exact = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    per_key = exact.groupBy(*keys).agg(F.count(F.lit(1)).alias("_d"), F.sum("_n").alias("_t"))
    return per_key.agg(F.sum("_d").alias("n_rows"), F.sum(F.col("_t") - F.col("_d")).alias("exact_duplicates"), F.sum(F.col("_d") - 1).alias("key_conflicts"))


def input_manifest(df: DataFrame, date: str, unit: str) -> DataFrame:
    """Rows, duplicate keys, span, universe range and missing business days."""
    keyed = df.groupBy(date, unit).agg(F.count(F.lit(1)).alias("_n"))
    days = keyed.groupBy(date).agg(F.count(F.lit(1)).alias("_u"), F.sum("_n").alias("_r"), F.count_if(F.col("_n") > 1).alias("_dup"))
    s = days.agg(F.sum("_r").alias("n_rows"), F.sum("_dup").alias("duplicate_keys"), F.min(date).alias("first_day"), F.max(date).alias("last_day"),
                 F.min("_u").alias("min_universe"), F.max("_u").alias("max_universe"), F.count_if(F.weekday(date) < 5).alias("_seen"))
    span = F.size(F.filter(F.sequence("first_day", "last_day"), lambda d: F.weekday(d) < 5))
    return s.withColumn("missing_business_days", (span - F.col("_seen")).cast("long")).drop("_seen")


def oos_audit(df: DataFrame, keys: Sequence[str], cutoff: str, holdout: str, value: str) -> DataFrame:
    """Maturity order, unmatured, non-finite, holdout and duplicate-key counts."""
    v = F.col(value)
    per = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(~(F.col("decision_date") < F.col("terminal_date"))).alias("_o"),
        F.count_if(F.col("terminal_date") > F.to_date(F.lit(cutoff))).alias("_u"),
        F.count_if(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))).alias("_f"), F.count_if(F.col("decision_date") >= F.to_date(F.lit(holdout))).alias("_h"))
    return per.agg(F.sum("_n").alias("n_rows"), F.sum("_o").alias("bad_order"), F.sum("_u").alias("unmatured"), F.sum("_f").alias("non_finite"),
                   F.sum("_h").alias("holdout_rows"), F.count_if(F.col("_n") > 1).alias("duplicate_keys"))


def interval_audit(predictions: DataFrame, schedule: DataFrame, key: str, date: str, start: str) -> DataFrame:
    """Predictions outside every generation interval, or inside more than one."""
    per_start = schedule.groupBy(key, start).agg(F.count(F.lit(1)).alias("_k"))
    j = asof_join(predictions, per_start, [key], date, start)
    return j.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("_k").isNull()).alias("uncovered"), F.count_if(F.col("_k") > 1).alias("ambiguous"))


def schedule_audit(schedule: DataFrame) -> DataFrame:
    models, thresholds = F.countDistinct("model_id"), F.countDistinct("threshold")
    return schedule.groupBy("family_id").agg(
        F.count(F.lit(1)).alias("activations"), (F.count(F.lit(1)) - F.countDistinct("activation_date")).alias("same_date_conflicts"),
        models.alias("models"), ((models == 1) & (thresholds == 1)).alias("frozen"), F.min("activation_date").alias("first_activation"))


def store_coverage(daily: DataFrame, start: str, end: str) -> DataFrame:
    g = daily.groupBy("ticker").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("n_days"))
    return g.withColumn("spans_window", (F.col("first_day") <= F.to_date(F.lit(start))) & (F.col("last_day") >= F.to_date(F.lit(end))))


def boundary_quality(events: DataFrame, tolerance: int) -> DataFrame:
    """First and last stamp per (unit, day) against the day's session bounds, in seconds."""
    day = F.to_date("ts")
    unit = events.groupBy("user_id", day.alias("day")).agg(F.min("ts").alias("f"), F.max("ts").alias("l"))
    bounds = unit.groupBy("day").agg(F.min("f").alias("o"), F.max("l").alias("c"))
    sec = lambda a, b: F.unix_seconds(F.date_trunc("second", b).cast("timestamp")) - F.unix_seconds(F.date_trunc("second", a).cast("timestamp"))
    x = unit.join(bounds, "day").withColumn("open_delay", sec("o", "f")).withColumn("close_lead", sec("l", "c"))
    return x.select("user_id", "day", "open_delay", F.col("open_delay").between(0, tolerance).alias("open_ok"), (F.abs("close_lead") <= tolerance).alias("close_ok"))


def provider_difference(a: DataFrame, b: DataFrame, keys: Sequence[str], x: str, y: str, limits: Sequence[int]) -> DataFrame:
    """Distribution of absolute differences in bps; quantiles over the whole table come from the count table."""
    j = a.join(b, list(keys)).select((F.abs(F.col(y) / F.col(x) - 1) * 10000).alias("bps"))
    q = quantiles(j, [], "bps", {"median_bps": 0.5, "p95_bps": 0.95, "p99_bps": 0.99})
    s = j.agg(F.count(F.lit(1)).alias("n_rows"), F.max("bps").alias("max_bps"), *[F.count_if(F.col("bps") > k).alias(f"over_{k}") for k in limits])
    for c in ("median_bps", "p95_bps", "p99_bps"):
        s = s.withColumn(c, rnd(q.select(c).scalar(), 3))
    return s.withColumn("max_bps", rnd("max_bps", 3))


def score_parity(a: DataFrame, b: DataFrame, keys: Sequence[str], x: str, y: str, levels: dict[int, float]) -> DataFrame:
    """Largest score difference and threshold-crossing mismatches at several quantiles of the reference scores."""
    q = quantiles(a, [], x, {f"q{k}": v for k, v in levels.items()})
    arr = q.select(F.array(*[f"q{k}" for k in levels]).alias("q"))
    j = a.join(b, list(keys)).withColumn("_q", arr.scalar())
    miss = [F.count_if((F.col(x) >= F.get("_q", F.lit(i))) != (F.col(y) >= F.get("_q", F.lit(i)))).alias(f"mismatch_{k}") for i, k in enumerate(levels)]
    return j.agg(F.count(F.lit(1)).alias("n_rows"), rnd(F.max(F.abs(F.col(x) - F.col(y)))).alias("max_abs_delta"), *miss)


def baseline_consistency(a: DataFrame, b: DataFrame, keys: Sequence[str], arm: str, value: str, tolerance: float) -> DataFrame:
    ok = F.abs(F.col(value) - F.col("_base")) <= tolerance
    j = a.join(b.withColumnRenamed(value, "_base"), list(keys))
    return j.groupBy(arm).agg(F.count(F.lit(1)).alias("cells"), F.count_if(ok).alias("within_tolerance"), F.bool_and(ok).alias("consistent"))


def execution_quality(signals: DataFrame, prices: DataFrame, sessions: DataFrame, threshold: float, max_names: int) -> DataFrame:
    """Whether gated candidates had a bar at their next open, per year."""
    from chronopanel.operators.calendar import shift_sessions
    picks = top_rows(signals, ["decision_date"], [F.desc("score"), F.asc("ticker")], max_names, "_rn").where(F.col("score") >= threshold)
    nxt = shift_sessions(sessions, 1, "entry_date").withColumnRenamed("date", "decision_date")
    bars = prices.select(F.col("date").alias("entry_date"), "ticker", "open", "volume")
    j = picks.join(nxt, "decision_date").join(bars, ["entry_date", "ticker"], "left")
    return j.groupBy(F.year("decision_date").alias("yr")).agg(
        F.count(F.lit(1)).alias("candidates"), F.count("open").alias("executable"), F.count_if(F.col("open").isNull()).alias("missing_next_open"),
        rnd(F.avg("volume")).alias("mean_volume"))


def slice_digest(df: DataFrame, day: Column, end: str, columns: Sequence[Column]) -> DataFrame:
    """Order-independent SHA-256 of a date-bounded slice.

    Row hashes are folded by (day, hash prefix), then by day, then at the root;
    the prefix level splits a hot day into 65,536 groups, and only fixed-size
    digests travel upward. Equal rows both count, so multiplicity matters.
    """
    row = F.sha2(F.concat_ws("|", *columns), 256)
    h = df.where(day <= F.to_date(F.lit(end))).select(day.alias("day"), row.alias("h")).withColumn("pre", F.substring("h", 1, 4))
    fold = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), ""), 256)
    sub = h.groupBy("day", "pre").agg(fold("h").alias("s"))
    days = sub.groupBy("day").agg(fold(F.concat("pre", "s")).alias("digest"))
    return days.agg(F.count(F.lit(1)).alias("days"), fold(F.concat(F.col("day").cast("string"), "digest")).alias("root"))


def list_identity(df: DataFrame, by: Sequence[str], day: str, columns: Sequence[Column]) -> DataFrame:
    """Identity of a row list per group: sorted row hashes fold by (day, hash prefix), then day, then group."""
    h = df.select(*by, F.col(day).alias("_d"), F.sha2(F.concat_ws("|", *columns), 256).alias("h")).withColumn("pre", F.substring("h", 1, 4))
    fold = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), ""), 256)
    sub = h.groupBy(*by, "_d", "pre").agg(fold("h").alias("s"))
    days = sub.groupBy(*by, "_d").agg(fold(F.concat("pre", "s")).alias("digest"))
    return days.groupBy(*by).agg(fold(F.concat(F.col("_d").cast("string"), "digest")).alias("path_id"))


def fold_filter_audit(folds: DataFrame, boundary: str, by: Sequence[str]) -> DataFrame:
    """Folds whose calibration ends after their start, folds across the boundary, and the ones kept."""
    b = F.to_date(F.lit(boundary))
    causal, straddle = F.col("calibration_end") < F.col("s"), (F.col("s") <= b) & (F.col("e") > b)
    return folds.groupBy(*by).agg(F.count(F.lit(1)).alias("folds"), F.count_if(~causal).alias("not_causal"), F.count_if(straddle).alias("straddling"),
                                  F.count_if(causal & ~straddle).alias("kept"))


def coverage_gate(panels: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Last date per panel and the date up to which all of them reach."""
    last = [df.agg(F.to_date(F.max(c)).alias("last_date")).select(F.lit(n).alias("panel"), "last_date") for n, (df, c) in panels.items()]
    u = reduce(DataFrame.unionByName, last)
    return u.withColumn("usable_until", u.agg(F.min("last_date")).scalar())
