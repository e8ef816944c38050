"""Bucket consensus: one vote per horizon bucket, arm comparison, selector choices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.functions.rounding import rnd
from chronopanel.functions.stats import median, share


def bucket_votes(sets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Raw against deduplicated consensus; a set has at most three bucket rows."""
    return sets.groupBy(*keys).agg(
        F.sum("n_families").alias("raw_families"), F.count(F.lit(1)).alias("bucket_votes"), rnd(F.avg("score")).alias("mean_score"),
        rnd(median("score")).alias("median_score"), rnd(F.stddev_samp("score")).alias("std_score"),
        rnd(F.max("score") - F.min("score")).alias("score_range"),
        rnd(F.sum(F.col("score") * F.col("n_events")) / F.sum("n_events") - F.avg("score")).alias("raw_minus_dedup"),
        rnd(F.sum("n_families") / F.count(F.lit(1))).alias("raw_density"))


def compare_arms(rows: DataFrame, date: str, value: str, arms: tuple[str, str, str]) -> DataFrame:
    """Second minus first and third minus second arm: family deltas, plateau means, date medians."""
    a, b, c = arms
    wide = rows.groupBy(date, "plateau_id", "family_id").pivot("arm", list(arms)).agg(F.max(value)).na.drop(subset=list(arms))
    plateau = wide.groupBy(date, "plateau_id").agg(F.avg(F.col(b) - F.col(a)).alias("ba"), F.avg(F.col(c) - F.col(b)).alias("cb"))
    return plateau.groupBy(date).agg(rnd(median("ba")).alias("delta_ba"), rnd(median("cb")).alias("delta_cb"), F.count(F.lit(1)).alias("plateaus"))


def bucket_rank(column: str = "h_bucket") -> Column:
    """Fixed tie order of the buckets."""
    return F.when(F.col(column) == "SHORT", 1).when(F.col(column) == "MID", 2).otherwise(3)


def choice_rows(candidates: DataFrame, keys: Sequence[str], scores: dict[str, str]) -> DataFrame:
    """Per set and pool: the argmax candidate (ties by bucket order), the oracle, regret and override flag.

    A set has at most three candidates, so every choice is one ``max_by`` in a single aggregation.
    """
    order = -bucket_rank()
    pick = lambda score, out: F.max_by(out, F.struct(F.round(score, 9), order.alias("o")))
    first = next(iter(scores.values()))
    pools = F.array(*[F.struct(F.lit(p).alias("pool"), pick(s, "h_bucket").alias("choice"), pick(s, "realized").alias("realized")) for p, s in scores.items()])
    g = candidates.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("candidates"), pools.alias("_p"), pick("realized", "h_bucket").alias("oracle"), F.max("realized").alias("oracle_realized"),
        F.avg("realized").alias("equal_realized"), pick(first, "h_bucket").alias("_base")).where("candidates >= 2")
    return g.select(*keys, "candidates", F.inline("_p"), "oracle", "oracle_realized", "equal_realized", "_base").withColumn(
        "regret", F.col("oracle_realized") - F.col("realized")).withColumn("override", F.col("choice") != F.col("_base")).drop("_base")


def pool_metrics(choices: DataFrame, base_pool: str) -> DataFrame:
    """Per pool: mean excess, regret, hit rate, override count and hit rate against the base pool's pick."""
    keys = [c for c in ("decision_date", "ticker", "arm") if c in choices.columns]
    base = F.max(F.when(F.col("pool") == base_pool, F.col("realized"))).over(Window.partitionBy(*keys))
    x = choices.withColumn("_b", base)
    hit = F.when(F.col("override"), (F.col("realized") > F.col("_b")).cast("double"))
    return x.groupBy("pool").agg(
        F.count(F.lit(1)).alias("sets"), rnd(F.avg("realized")).alias("mean_excess"), rnd(F.avg("regret")).alias("mean_regret"),
        rnd(share(F.col("choice") == F.col("oracle"))).alias("oracle_hit_rate"), F.count_if("override").alias("overrides"),
        rnd(F.avg(hit)).alias("override_hit_rate"), rnd(F.avg(F.col("realized") - F.col("_b"))).alias("delta_vs_base"))


def pool_matrix(choices: DataFrame, keys: Sequence[str], pools: Sequence[str]) -> DataFrame:
    """Pairwise pool differences from one pivot over the fixed pool list; no self-join."""
    wide = choices.groupBy(*keys).pivot("pool", list(pools)).agg(F.first("realized").alias("v"), F.first("choice").alias("c"))
    pairs = F.array(*[F.struct(F.lit(a).alias("pool_a"), F.lit(b).alias("pool_b"), (F.col(f"{a}_v") - F.col(f"{b}_v")).alias("diff"),
                               (F.col(f"{a}_c") == F.col(f"{b}_c")).alias("agree")) for i, a in enumerate(pools) for b in pools[i + 1:]])
    return wide.select(F.inline(pairs)).groupBy("pool_a", "pool_b").agg(
        F.count("diff").alias("sets"), rnd(F.avg("diff")).alias("mean_diff"), rnd(share(F.col("diff") > 0)).alias("win_rate"),
        rnd(share(~F.col("agree"))).alias("disagreement"), rnd(share(F.col("agree"))).alias("agreement"))


def pairwise_accuracy(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of untied bucket pairs whose predicted order matches the realised order."""
    ok = F.when(F.col("realized_diff") != 0, (F.signum("score_diff") == F.signum("realized_diff")).cast("double"))
    return pairs.groupBy(*keys).agg(F.count(ok).alias("pairs"), F.avg(ok).alias("accuracy"))


def daily_selector_rules(panel: DataFrame, day_cut: DataFrame) -> DataFrame:
    """Equal, winner, top-quartile and oracle returns per day, plus a key of the chosen set."""
    x = panel.join(day_cut, "decision_date")
    top = F.col("score") >= F.col("cut")
    g = x.groupBy("decision_date").agg(
        F.count(F.lit(1)).alias("n"), F.avg("excess").alias("equal"),
        F.max_by("excess", F.struct("score", -F.col("ticker"))).alias("winner"), F.max_by("ticker", F.struct("score", -F.col("ticker"))).alias("winner_key"),
        F.avg(F.when(top, F.col("excess"))).alias("top"), F.bit_xor(F.when(top, F.xxhash64("ticker"))).alias("top_key"), F.max("excess").alias("oracle"))
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), v.alias("r"), k.cast("string").alias("key")) for n, v, k in (
        ("EQUAL", F.col("equal"), F.lit("ALL")), ("WINNER", F.col("winner"), F.col("winner_key")), ("TOP_QUARTILE", F.col("top"), F.col("top_key")),
        ("ORACLE", F.col("oracle"), F.lit("ORACLE")))])
    return g.where("n >= 4").select("decision_date", F.inline(rules))


def rule_path_summary(daily: DataFrame, costs: Sequence[int], periods: int) -> DataFrame:
    """Net wealth path per rule and switch cost; the first row counts as a switch. One row per (rule, day)."""
    w = Window.partitionBy("rule").orderBy("decision_date")
    x = daily.withColumn("switch", (F.lag("key").over(w).isNull() | (F.lag("key").over(w) != F.col("key"))).cast("int"))
    x = x.withColumn("cost_bps", F.explode(F.array(*[F.lit(c) for c in costs]))).withColumn("net", F.col("r") - F.col("switch") * F.col("cost_bps") / 10000.0)
    wc = Window.partitionBy("rule", "cost_bps").orderBy("decision_date")
    x = x.withColumn("wealth", F.exp(F.sum(F.log1p("net")).over(wc))).withColumn("dd", F.col("wealth") / F.max("wealth").over(wc) - 1)
    g = x.groupBy("rule", "cost_bps").agg(
        F.count(F.lit(1)).alias("observations"), F.sum("switch").alias("switches"), rnd(F.avg("net")).alias("mean_net"),
        rnd(F.exp(F.avg(F.log1p("net")) * periods) - 1).alias("cagr"), rnd(F.min("dd")).alias("max_drawdown"), F.stddev_pop("net").alias("_sd"), F.avg("net").alias("_m"))
    return g.withColumn("sharpe", rnd(F.coalesce(F.col("_m") / F.nullif("_sd", F.lit(0.0)) * F.sqrt(F.lit(float(periods))), F.lit(0.0)))).drop("_sd", "_m")
