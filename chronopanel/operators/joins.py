"""Domain joins built from equi-joins and conditional aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.operators.asof import asof_join
from chronopanel.operators.ordered import rank_columns, top_rows


def authoritative_signals(signals: DataFrame, schedule: DataFrame) -> DataFrame:
    """Keep only scores of the model that is active on their decision date; a family's ticker may have one such score a day."""
    active = schedule.withColumnRenamed("model_id", "_active")
    out = asof_join(signals, active, ["family_id"], "decision_date", "activation_date", how="inner")
    kept = out.where(F.col("model_id") == F.col("_active")).drop("_active")
    again = F.count(F.lit(1)).over(Window.partitionBy("family_id", "decision_date", "ticker"))
    name = F.when(F.col("_again") > 1, F.raise_error(F.lit("two authoritative scores for one family, date and ticker")).cast("string")).otherwise(F.col("family_id"))
    return kept.withColumn("_again", again).withColumn("family_id", name).drop("_again")


def causal_schedule_expansion(signals: DataFrame, arms: DataFrame) -> DataFrame:
    """Expand each row to every arm, using that arm's latest state at the decision date."""
    return asof_join(signals, arms, ["family_id"], "decision_date", "activation_date", how="inner", fan_out=["arm"])


def matured_expansion(base: DataFrame, outcomes: DataFrame, variants: DataFrame, cutoff: str) -> DataFrame:
    """Outcomes known at the cutoff, reduced at the shared base grain, then fanned out to sibling variants."""
    known = outcomes.where(F.col("terminal_date") <= F.to_date(F.lit(cutoff)))
    rows = base.join(known, ["decision_date", "ticker"])
    per_family = rows.groupBy("family_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg("excess").alias("mean_excess"), F.max("terminal_date").alias("latest_terminal"))
    return per_family.join(variants, "family_id")


def date_positions(df: DataFrame, by: Sequence[str], date: str, name: str = "date_pos") -> DataFrame:
    """Dense position of each date within ``by``, from the distinct dates only."""
    days = df.select(*by, date).distinct()
    return days.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(date)) - 1).cast("long"))


def lag_pairs(df: DataFrame, by: Sequence[str], unit: Sequence[str], date: str, lag: int, values: Sequence[str]) -> DataFrame:
    """Pair every row with the same unit ``lag`` dense dates later (positions, not row offsets)."""
    pos = date_positions(df, by, date)
    left = df.join(pos, [*by, date])
    right = left.select(*by, *unit, (F.col("date_pos") - lag).alias("date_pos"), F.col(date).alias(f"future_{date}"),
                        *[F.col(v).alias(f"future_{v}") for v in values])
    return left.join(right, [*by, *unit, "date_pos"])


BUCKETS = ("SHORT", "MID", "LONG")


def bucket_pairs(sets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ordered bucket pairs of a set: three fixed buckets pivot to columns, so at most three pairs, no self-join."""
    wide = sets.groupBy(*keys).pivot("h_bucket", list(BUCKETS)).agg(F.first("score").alias("score"), F.first("realized").alias("realized"))
    pair = lambda a, b: F.struct(
        F.lit(a).alias("bucket_a"), F.lit(b).alias("bucket_b"), (F.col(f"{a}_score") - F.col(f"{b}_score")).alias("score_diff"),
        (F.col(f"{a}_realized") - F.col(f"{b}_realized")).alias("realized_diff"))
    return wide.select(*keys, F.inline(F.array(*[pair(a, b) for i, a in enumerate(BUCKETS) for b in BUCKETS[i + 1:]]))).where(
        "score_diff IS NOT NULL")


def reconcile(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Full outer join with a side indicator."""
    a = left.select(*keys, F.lit(True).alias("_l"), *[F.col(v).alias(f"left_{v}") for v in values])
    b = right.select(*keys, F.lit(True).alias("_r"), *[F.col(v).alias(f"right_{v}") for v in values])
    side = F.when(F.col("_r").isNull(), "LEFT_ONLY").when(F.col("_l").isNull(), "RIGHT_ONLY").otherwise("BOTH")
    return a.join(b, list(keys), "full").withColumn("side", side).drop("_l", "_r")


def paired_baseline(cells: DataFrame, keys: Sequence[str], arm: str, baseline: str, values: Sequence[str]) -> DataFrame:
    """Deltas against the baseline arm of the same cell; a cell without baseline fails its task."""
    base = cells.groupBy(*keys).agg(*[F.max(F.when(F.col(arm) == baseline, F.col(v))).alias(f"base_{v}") for v in values])
    out = cells.join(base, list(keys))
    checked = F.when(F.col(f"base_{values[0]}").isNull(), F.raise_error(F.lit("baseline cell missing"))).otherwise(F.col(f"base_{values[0]}"))
    out = out.withColumn(f"base_{values[0]}", checked)
    for v in values:
        out = out.withColumn(f"delta_{v}", F.col(v) - F.col(f"base_{v}"))
    return out


def executed_flag(signals: DataFrame, executed: DataFrame, keys: Sequence[str]) -> DataFrame:
    done = executed.select(*keys).distinct().withColumn("trade_executed", F.lit(True))
    return signals.join(done, list(keys), "left").withColumn("trade_executed", F.coalesce("trade_executed", F.lit(False)))


#: Sessions of a block of bars.
BLOCK = 64


def position_sessions(trades: DataFrame, prices: DataFrame, sessions: DataFrame, keep: Sequence[str] = (), marks: Sequence[str] = ()) -> DataFrame:
    """One row per (trade, held session): entry day open->close, middle days close->close, exit day close->open.

    Trades meet their ticker's bars as whole stretches: bars lie in blocks of ``BLOCK`` sessions (the longest holding, if that is more)
    with the bars that a trade entered there may still hold, so a trade is shuffled once, not once per held session. ``keep``: more
    columns of the trades that go along, ``marks``: of the bars, which spares a join back to them. ``entry_open`` is the entry day's open.
    """
    fields = ["idx", "date", "open", "close", "high", "low", *marks]
    span = trades.agg(F.max(F.col("exit_idx") - F.col("entry_idx"))).first()[0] or 0
    size = max(BLOCK, span + 1)
    bar = F.struct(*fields)
    block = F.floor(F.col("idx") / size)
    bars = prices.join(sessions, "date").select("ticker", bar.alias("bar"), F.explode(F.when(
        F.col("idx") % size < span, F.array(block, block - 1)).otherwise(F.array(block))).alias("_block"))
    blocks = bars.groupBy("ticker", "_block").agg(F.array_sort(F.collect_list("bar")).alias("_bars"))
    held = trades.select("trade_id", "ticker", "entry_date", "exit_date", "entry_idx", "exit_idx", *keep, F.floor(F.col("entry_idx") / size).alias("_block"))
    # trades and bars grow with tickers: by its small files alone Spark would send one of them through the driver
    met = held.hint("merge").join(blocks.hint("merge"), ["ticker", "_block"]).drop("_block")
    path = F.filter("_bars", lambda x: (x["idx"] >= F.col("entry_idx")) & (x["idx"] <= F.col("exit_idx")))
    met = met.withColumn("_path", path).drop("_bars")
    first = F.get("_path", F.lit(0))
    met = met.withColumn("entry_open", F.when(first["idx"] == F.col("entry_idx"), first["open"]))
    prior = lambda x, i: F.when(F.get("_path", i - 1)["idx"] == x["idx"] - 1, F.get("_path", i - 1)["close"])
    out = met.select("*", F.inline(F.transform("_path", lambda x, i: F.struct(*[x[c].alias(c) for c in fields], prior(x, i).alias("prior_close"))))).drop("_path")
    is_entry, is_exit = F.col("idx") == F.col("entry_idx"), F.col("idx") == F.col("exit_idx")
    base = F.when(is_entry, F.col("open")).otherwise(F.col("prior_close"))
    term = F.when(is_exit, F.col("open")).otherwise(F.col("close"))
    return (out.withColumn("is_entry", is_entry).withColumn("is_exit", is_exit).withColumn("base_price", base)
            .where("base_price IS NOT NULL").withColumn("interval_return", term / F.col("base_price") - 1))


def daily_percentile(df: DataFrame, name: str, date: str = "decision_date") -> DataFrame:
    """1 - average rank (descending) / size."""
    return rank_columns(df, [date], "score", pct="_p", ascending=False).withColumn(name, 1 - F.col("_p")).drop("_p")


def intersection_blend(a: DataFrame, b: DataFrame, pa: str, pb: str, floor: float) -> DataFrame:
    """Names active in both models; the blended score is the worse percentile."""
    left = a.where(F.col(pa) >= floor).select("decision_date", "ticker", pa)
    right = b.where(F.col(pb) >= floor).select("decision_date", "ticker", pb)
    return left.join(right, ["decision_date", "ticker"]).withColumn("score", F.least(pa, pb))


def cluster_membership(meta: DataFrame) -> DataFrame:
    """Family -> four cluster levels."""
    band = lambda c, p: (F.when(F.col(c).between(1, 5), f"{p}01_05").when(F.col(c).between(6, 10), f"{p}06_10")
                         .when(F.col(c).between(11, 20), f"{p}11_20").when(F.col(c).between(21, 30), f"{p}21_30")
                         .otherwise(F.raise_error(F.lit(f"{c} outside all bands"))))
    hb, db = band("horizon_h", "H"), band("holding_d", "D")
    region = (F.when(F.col("horizon_h") <= 5, "FAST").when(F.col("horizon_h") <= 10, "SHORT")
              .when(F.col("horizon_h") <= 20, "MID").otherwise("LONG"))
    n = F.format_string("N%02d", "max_names_n")
    row = lambda level, *parts: F.struct(F.lit(level).alias("cluster_level"),
                                         F.concat_ws("::", F.lit(level), *parts).alias("cluster_id"))
    return meta.select("family_id", F.inline(F.array(
        row("FAMILY", F.col("family_id")), row("H_BAND", hb), row("HD_GRID", hb, db, n, F.col("exit_mode")),
        row("ECONOMIC_REGION", region, db))))


def score_overlap(old: DataFrame, new: DataFrame, top: int) -> DataFrame:
    """Per-day Jaccard overlap of the two top-k sets and the mean scores of both models."""
    order = [F.desc("score"), F.asc("ticker")]
    pick = lambda df, flag: top_rows(df, ["decision_date"], order, top, "_rn").select("decision_date", "ticker", F.lit(1).alias(flag))
    joined = (old.withColumnRenamed("score", "old").join(new.withColumnRenamed("score", "new"), ["decision_date", "ticker"])
              .groupBy("decision_date").agg(F.avg("old").alias("old_mean"), F.avg("new").alias("new_mean")))
    sets = (pick(old, "a").join(pick(new, "b"), ["decision_date", "ticker"], "full").groupBy("decision_date")
            .agg((F.count_if((F.col("a") == 1) & (F.col("b") == 1)) / F.count(F.lit(1))).alias("jaccard")))
    return joined.join(sets, "decision_date")


def rule_difference(df: DataFrame, keys: Sequence[str], rule: str, a: str, b: str, value: str) -> DataFrame:
    """Paired difference a - b per key where both rules exist; one conditional aggregate, no self-join."""
    pick = lambda x: F.max(F.when(F.col(rule) == x, F.col(value)))
    return df.where(F.col(rule).isin(a, b)).groupBy(*keys).agg((pick(a) - pick(b)).alias("difference")).where("difference IS NOT NULL")
