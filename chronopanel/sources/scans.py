"""Guarded scans: nothing at or after the holdout boundary is ever read."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopanel.contracts import ContractError, require_columns
from chronopanel.operators.asof import interval_join


def guarded_panel(df: DataFrame, columns: Sequence[str], *, date: str, development_end: str, holdout_boundary: str,
                  locked: Column | None = None, dates: DataFrame | None = None) -> DataFrame:
    """Project and filter on the raw column, so both reach the Parquet scan.

    ``date <= development_end AND date < holdout_boundary AND (locked = false OR locked IS NULL)``,
    optionally limited to a list of dates (a semi join).
    """
    if development_end >= holdout_boundary:
        raise ContractError("development end must lie before the holdout boundary")
    require_columns(df, [date, *columns])
    # end of day for timestamp columns: compare with the next midnight instead of casting the column
    keep = (F.col(date) < F.date_add(F.to_date(F.lit(development_end)), 1)) & \
           (F.col(date) < F.to_date(F.lit(holdout_boundary)))
    if locked is not None:
        keep = keep & (~locked | locked.isNull())
    out = df.where(keep).select(*columns)
    if dates is not None:
        wanted = dates.select(F.col(dates.columns[0]).alias("_d")).distinct()
        out = out.join(wanted, F.to_date(date) == F.col("_d"), "left_semi")
    return out


def leak_audit(df: DataFrame, date: str, holdout_boundary: str) -> DataFrame:
    """Rows at or after the boundary; any non-zero count is a leak."""
    return df.agg(F.count_if(F.col(date) >= F.to_date(F.lit(holdout_boundary))).alias("leaked_rows"),
                  F.count(F.lit(1)).alias("n_rows"))


def _typed_predictions(raw: DataFrame, excluded_family: str) -> DataFrame:
    kept = raw.where(F.upper("family") != excluded_family.upper())
    return kept.select(F.to_date("decision_date").alias("decision_date"), F.col("ticker").cast("string").alias("ticker"),
                       F.col("horizon_sessions").cast("long").alias("horizon"),
                       F.expr("try_cast(predicted AS double)").alias("score")).na.drop()


def load_predictions(raw: DataFrame, excluded_family: str) -> DataFrame:
    require_columns(raw, ["decision_date", "ticker", "horizon_sessions", "family", "predicted"])
    return _typed_predictions(raw, excluded_family)


def prediction_audit(raw: DataFrame, excluded_family: str) -> DataFrame:
    """One audit row in one pass over the source."""
    kept = (F.upper("family") != excluded_family.upper()) & F.expr("try_cast(predicted AS double)").isNotNull() \
        & F.col("decision_date").isNotNull() & F.col("ticker").isNotNull()
    return raw.agg(F.count_if(kept).alias("n_rows"), F.count_if(~F.coalesce(kept, F.lit(False))).alias("excluded_rows"),
                   F.countDistinct(F.when(kept, F.col("ticker"))).alias("n_tickers"),
                   F.countDistinct(F.when(kept, F.col("horizon_sessions"))).alias("n_horizons"))


def holdout_audit(df: DataFrame, roles: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rows per role column whose trimmed upper-case value names the holdout."""
    hits = [F.struct(F.lit(c).alias("role_column"),
                     F.count_if(F.upper(F.trim(c)).isin(list(v))).alias("holdout_rows"),
                     F.count(F.lit(1)).alias("n_rows")) for c, v in roles.items() if c in df.columns]
    return df.agg(F.array(*hits).alias("_h")).select(F.inline("_h"))


def price_panel(prices: DataFrame, manifest: DataFrame, benchmark) -> DataFrame:
    """Bars of the listed tickers plus the benchmark, with positive open and close."""
    wanted = manifest.select("ticker").union(
        manifest.sparkSession.range(1).select(F.lit(benchmark).cast(manifest.schema["ticker"].dataType).alias("ticker"))
    ).distinct()
    return prices.where("open > 0 AND close > 0").join(wanted, "ticker", "left_semi")


def missing_tickers(wanted: DataFrame, prices: DataFrame) -> DataFrame:
    return wanted.select("ticker").distinct().join(prices.select("ticker").distinct(), "ticker", "left_anti")


def repair_with_fallback(primary: DataFrame, fallback: DataFrame, keys: Sequence[str], value: str,
                         quality: str) -> DataFrame:
    """Replace a value only where its quality flag is bad and the fallback has one; tag the provider."""
    other = fallback.select(*keys, F.col(value).alias("_fallback"))
    use = ~F.col(quality) & F.col("_fallback").isNotNull()
    return (primary.join(other, list(keys), "left")
            .withColumn("provider", F.when(use, "fallback").otherwise("primary"))
            .withColumn(value, F.when(use, F.col("_fallback")).otherwise(F.col(value))).drop("_fallback"))


def replay_inputs(prices: DataFrame, benchmark, start: str, end: str, flag: str = "boundary_ok") -> DataFrame:
    """Full benchmark history plus the stocks inside the segment whose boundary flag is good."""
    inside = F.col("date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))) & F.col(flag)
    return prices.where((F.col("ticker") == benchmark) | inside)


def raw_bar_audit(lines: DataFrame, value: str = "value") -> DataFrame:
    """Audit raw JSON lines: invalid documents, missing timestamps, first and last timestamp."""
    path = [F.get_json_object(value, f"$.{k}") for k in ("t", "timestamp", "ts", "time")]
    valid = F.expr(f"try_parse_json({value})").isNotNull()
    stamp = F.try_to_timestamp(F.coalesce(*path))
    return lines.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(~valid).alias("invalid_json"),
        F.count_if(valid & stamp.isNull()).alias("missing_timestamp"),
        F.min(stamp.cast("timestamp_ntz")).alias("first_ts"), F.max(stamp.cast("timestamp_ntz")).alias("last_ts"))


FAMILY_PATTERN = r"^H(\d{2})_D(\d{2})_N(\d{2})_(FIXED|LEARNED_EXIT)$"


def family_metadata(df: DataFrame) -> DataFrame:
    """Family ids parsed into horizon, holding days, names and exit mode; a malformed id fails the task."""
    part = lambda i: F.regexp_extract("family_id", FAMILY_PATTERN, i)
    ok = F.col("family_id").rlike(FAMILY_PATTERN)
    parsed = df.select(
        F.when(ok, F.col("family_id")).otherwise(F.raise_error(F.concat(F.lit("bad family id: "), "family_id")))
        .alias("family_id"),
        part(1).cast("int").alias("horizon_h"), part(2).cast("int").alias("holding_d"),
        part(3).cast("int").alias("max_names_n"), part(4).alias("exit_mode"))
    return parsed.withColumn("h_bucket", horizon_bucket("horizon_h"))


def horizon_bucket(column: str) -> Column:
    return F.when(F.col(column) <= 10, "SHORT").when(F.col(column) <= 20, "MID").otherwise("LONG")


def interval_slice(spans: DataFrame, rows: DataFrame, keys: Sequence[str], start: str, end: str, date: str) -> DataFrame:
    """Rows in the half-open interval (start, end] of each span."""
    return interval_join(spans, rows, keys, start, end, date)
