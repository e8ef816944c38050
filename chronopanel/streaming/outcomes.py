"""Event-time twins of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.operators.asof import asof_join


def matured_outcomes(pending: DataFrame, outcomes: DataFrame, due_days: int, delay: str = "1 day") -> DataFrame:
    """Pending rows meet the outcome of the same key on their exact due date, once.

    Both sides carry watermarks and the join bounds event time, so state older than the due window is dropped.
    """
    p = pending.withWatermark("ts", delay).select(F.col("event_id").alias("pending_id"), "user_id", F.col("ts").alias("pending_ts"),
                                                  F.date_add(F.to_date("ts"), due_days).alias("due"))
    o = outcomes.withWatermark("ts", delay).select(F.col("event_id").alias("outcome_id"), F.col("user_id").alias("_u"), F.col("ts").alias("outcome_ts"), "value")
    bound = F.expr(f"outcome_ts >= pending_ts + interval {due_days - 1} days AND outcome_ts <= pending_ts + interval {due_days + 1} days")
    return p.join(o, (F.col("user_id") == F.col("_u")) & (F.to_date("outcome_ts") == F.col("due")) & bound).drop("_u")


def idempotent(stream: DataFrame, key: str, delay: str = "1 hour") -> DataFrame:
    """Identical re-deliveries are dropped while their first copy is inside the watermark."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def delivery_conflicts(batch: DataFrame, key: str) -> DataFrame:
    """Side output: keys delivered with different content."""
    payload = F.xxhash64(*[c for c in sorted(batch.columns) if c != key])
    return batch.groupBy(key).agg(F.count(F.lit(1)).alias("deliveries"), F.min(payload).alias("_a"), F.max(payload).alias("_b")).where("_a <> _b").drop("_a", "_b")


def matured_since(rows: DataFrame, ts, event_id: int) -> DataFrame:
    """Rows strictly after a composite (time, id) cursor."""
    return rows.where((F.col("ts") > ts) | ((F.col("ts") == ts) & (F.col("event_id") > event_id)))


def tumbling_activity(stream: DataFrame, size: str, delay: str) -> DataFrame:
    return (stream.withWatermark("ts", delay).groupBy(F.window("ts", size), "event_type")
            .agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("total"))
            .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "event_type", "n_events", "total"))


def sessions(stream: DataFrame, gap: str, delay: str) -> DataFrame:
    return (stream.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n_events"))
            .select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n_events"))


def sliding_statistics(stream: DataFrame, size: str, slide: str, delay: str) -> DataFrame:
    return (stream.withWatermark("ts", delay).groupBy(F.window("ts", size, slide), "event_type")
            .agg(F.count(F.lit(1)).alias("n_events"), F.avg("value").alias("mean_value"), F.max("value").alias("max_value"))
            .select(F.col("window.start").alias("window_start"), "event_type", "n_events", "mean_value", "max_value"))


def asof_stream(stream: DataFrame, schedule: DataFrame, keys: list[str], start: str) -> DataFrame:
    """Stream joined with the schedule row valid at each event's time (static side, no state)."""
    return asof_join(stream, schedule, keys, "ts", start, how="inner", grain="day")
