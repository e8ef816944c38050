"""Monthly panels: activity, family panel, cluster panel, ranked state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.operators.joins import date_positions


def monthly_activity(days: DataFrame) -> DataFrame:
    """Active days, observed days, entries and last entry per (family, arm, month)."""
    return days.groupBy("family_id", "arm", F.last_day("date").alias("assessment_date")).agg(
        F.count_if(F.col("positions") > 0).alias("active_days"), F.count(F.lit(1)).alias("observed_days"),
        F.sum("positions").alias("trade_count"), F.max(F.when(F.col("positions") > 0, F.col("date"))).alias("last_entry"))


def activity_recency(activity: DataFrame) -> DataFrame:
    """Carry the last entry date forward; days since, and recently active (entry this month or within 63 days)."""
    w = Window.partitionBy("family_id", "arm").orderBy("assessment_date")
    out = activity.withColumn("last_trade_date", F.last("last_entry", ignorenulls=True).over(w))
    days = F.datediff("assessment_date", "last_trade_date")
    return out.withColumn("days_since_last_trade", days).withColumn(
        "recently_active", (F.col("trade_count") > 0) | F.coalesce(days <= 63, F.lit(False)))


def activity_state(excess: str = "excess_1m") -> F.Column:
    return (F.when((F.col("active_days") == 0) & (F.col("trade_count") == 0), "NO_OPPORTUNITY")
            .when(F.col(excess) > 0, "ACTIVE_POSITIVE").when(F.col(excess) < 0, "ACTIVE_NEGATIVE").otherwise("ACTIVE_NEUTRAL"))


def family_monthly_panel(monthly: DataFrame, activity: DataFrame) -> DataFrame:
    """Trailing and forward relative returns at month grain, joined with activity (one row per family, arm, month)."""
    w = Window.partitionBy("family_id", "arm").orderBy("assessment_date")
    back = lambda n: F.col("rel") / F.lag("rel", n).over(w) - 1
    ahead = lambda n: F.lead("rel", n).over(w) / F.col("rel") - 1
    panel = monthly.select("family_id", "arm", "assessment_date", "rel", "strategy_value", "bench_value").withColumns({
        "excess_1m": back(1), "trailing_3m": back(3), "trailing_6m": back(6), "trailing_12m": back(12),
        "fwd_1m": ahead(1), "fwd_3m": ahead(3)})
    return panel.join(activity, ["family_id", "arm", "assessment_date"]).withColumn("activity_state", activity_state())


def cluster_panel(panel: DataFrame, membership: DataFrame) -> DataFrame:
    """Monthly means, sums and coverage per cluster, all levels in one aggregation."""
    return (panel.join(membership, "family_id").groupBy("cluster_level", "cluster_id", "arm", "assessment_date").agg(
        *[F.avg(c).alias(c) for c in ("excess_1m", "trailing_3m", "fwd_1m", "fwd_3m", "active_days")],
        F.countDistinct("family_id").alias("member_count"), F.sum("trade_count").alias("trade_count"),
        F.avg((F.col("activity_state") == "NO_OPPORTUNITY").cast("int")).alias("no_opportunity"),
        F.bool_and(F.col("fwd_1m").isNotNull()).alias("has_target")))


def state_frame(clusters: DataFrame) -> DataFrame:
    """Rank clusters per (level, arm, month) and cut them into TOP / MID / BOTTOM quarters.

    A cross-section holds one row per cluster, so its window is bounded by the registry.
    """
    x = clusters.where("excess_1m IS NOT NULL")
    cross = Window.partitionBy("cluster_level", "arm", "assessment_date")
    ranked = (x.withColumn("rank", F.row_number().over(cross.orderBy(F.desc(F.round("excess_1m", 9)), "cluster_id")))
              .withColumn("unit_count", F.count(F.lit(1)).over(cross)))
    top = F.ceil(F.col("unit_count") * 0.25)
    quartile = F.when(F.col("rank") <= top, "TOP").when(F.col("rank") > F.col("unit_count") - top, "BOTTOM").otherwise("MID")
    ranked = ranked.withColumn("quartile", quartile).withColumn(
        "rank_pct", (F.col("unit_count") - F.col("rank") + 1) / F.col("unit_count"))
    return ranked.join(date_positions(x, ["cluster_level", "arm"], "assessment_date"), ["cluster_level", "arm", "assessment_date"])
