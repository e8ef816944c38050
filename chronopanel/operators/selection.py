"""Selections, masks, grids, venue routing, gates over evidence tables."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.functions.rounding import rnd
from chronopanel.operators.evidence import top_spread
from chronopanel.operators.ordered import rank_ic, safe_corr, top_rows


def masked(df: DataFrame, masks: dict[str, Column], name: str) -> DataFrame:
    """One copy of a row per mask it satisfies; a single pass instead of a union of filters."""
    hits = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in masks.items()]))
    return df.withColumn(name, F.explode(hits))


def contributions(df: DataFrame, by: str, unit: str, value: str) -> DataFrame:
    t = df.groupBy(by, unit).agg(F.sum(value).alias("c"), F.count(F.lit(1)).alias("n"))
    top = top_rows(t, [by], [F.desc(F.round("c", 9)), F.asc(unit)], 3, "rn").groupBy(by).agg(
        F.sum(F.when(F.col("rn") == 1, F.greatest("c", F.lit(0.0)))).alias("_1"), F.sum(F.greatest("c", F.lit(0.0))).alias("_3"))
    tot = t.groupBy(by).agg(F.count(F.lit(1)).alias("tickers"), F.sum("n").alias("sets"), F.sum("c").alias("_t"), F.sum(F.greatest("c", F.lit(0.0))).alias("_p"))
    ratio = lambda c: rnd(F.col(c) / F.nullif("_p", F.lit(0.0)))
    return tot.join(top, by).select(by, "tickers", "sets", rnd("_t").alias("total"), ratio("_1").alias("top1_share"), ratio("_3").alias("top3_share"))


def incremental_metrics(df: DataFrame, by: Sequence[str], a: str, b: str, y: str) -> DataFrame:
    """Rank IC and top-quartile spread of two predictions and their differences per group."""
    ia, ib = rank_ic(df, by, a, y, name="rank_ic_a"), rank_ic(df, by, b, y, name="rank_ic_b").drop("n_rows")
    sa = top_spread(df, by, a, y).select(*by, F.col("spread").alias("spread_a"))
    sb = top_spread(df, by, b, y).select(*by, F.col("spread").alias("spread_b"))
    c = df.groupBy(*by).agg(safe_corr(F.col(a), F.col(b)).alias("prediction_corr"))
    j = reduce(lambda x, z: x.join(z, list(by), "left"), [ia, ib, sa, sb, c])
    return j.select(*by, "n_rows", rnd("rank_ic_a").alias("rank_ic_a"), rnd("rank_ic_b").alias("rank_ic_b"),
                    rnd(F.col("rank_ic_a") - F.col("rank_ic_b")).alias("incremental_rank_ic"), rnd("spread_a").alias("spread_a"),
                    rnd("spread_b").alias("spread_b"), rnd("prediction_corr").alias("prediction_corr"))


def selection_pairs(choices: DataFrame, accuracy: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Two pools side by side per set, by conditional aggregation."""
    val = lambda p, c: F.max(F.when(F.col("pool") == p, F.col(c)))
    g = choices.groupBy(*keys).agg(val(a, "choice").alias("t2_choice"), val(b, "choice").alias("t3_choice"), rnd(val(b, "realized") - val(a, "realized")).alias("t3_minus_t2"),
                                   rnd(val(a, "regret")).alias("t2_regret"), rnd(val(b, "regret")).alias("t3_regret"))
    return g.join(accuracy, list(keys)).withColumn("accuracy", rnd("accuracy"))


def below_median_share(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Share of attempts strictly below the upper median (attempts per group are few)."""
    arr = F.array_sort(F.collect_list(value))
    g = df.groupBy(*by).agg(arr.alias("_l")).withColumn("_m", F.get("_l", F.floor(F.size("_l") / 2).cast("int")))
    return g.select(*by, rnd(F.size(F.filter("_l", lambda x: x < F.col("_m"))) / F.size("_l")).alias("pbo"))


def context_matrix(days: DataFrame, regimes: Sequence[str]) -> DataFrame:
    """Dominant regime before each test year against per-regime returns inside it (days: date, r, br, regime)."""
    counts = days.groupBy(F.year("date").alias("yr"), "regime").agg(F.count(F.lit(1)).alias("n"))
    years = counts.select("yr").distinct()
    w = Window.partitionBy("regime").orderBy("yr").rowsBetween(Window.unboundedPreceding, -1)
    grid = years.withColumn("regime", F.explode(F.array(*[F.lit(x) for x in regimes])))
    seen = grid.join(counts, ["yr", "regime"], "left").withColumn("past", F.sum(F.coalesce("n", F.lit(0))).over(w)).where("past > 0")
    best = seen.withColumn("_rn", F.row_number().over(Window.partitionBy("yr").orderBy(F.desc("past"), "regime"))).where("_rn = 1")
    test = days.groupBy(F.year("date").alias("yr"), "regime").agg(
        F.count(F.lit(1)).alias("sessions"), rnd(F.product(1 + F.col("r")) - 1).alias("r"), rnd(F.product(1 + F.col("br")) - 1).alias("br"))
    return test.join(best.select("yr", F.col("regime").alias("context")), "yr").select("yr", "context", "regime", "sessions", "r", "br")


def readiness_gates(tables: Iterable[DataFrame]) -> DataFrame:
    """One row per gate from several one-row aggregates."""
    long = []
    for t in tables:
        rows = F.array(*[F.struct(F.lit(c).alias("gate"), F.coalesce(F.col(c), F.lit(False)).alias("passed")) for c in t.columns])
        long.append(t.select(F.inline(rows)))
    return reduce(DataFrame.unionByName, long)


def candidate_set(health: DataFrame, date: str, *, min_n: int, floor: float, margin: float) -> DataFrame:
    """Eligibility reason per family and membership within a margin of the best lower bound of the date."""
    reason = F.when(F.col("n") < min_n, "INSUFFICIENT_EVIDENCE").when(F.col("lcb").isNull() | (F.col("lcb") <= floor), "NEGATIVE_LCB")
    x = health.withColumn("reason", reason)
    best = x.groupBy(date).agg(F.max(F.when(F.col("reason").isNull(), F.col("lcb"))).alias("_best"))
    member = F.coalesce(F.col("reason").isNull() & (F.col("lcb") >= F.col("_best") - margin), F.lit(False))
    return x.join(best, date).withColumn("member", member).drop("_best")


def winner_and_runner_up(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str, value: str) -> DataFrame:
    top = top_rows(df, by, order, 2, "_rn")
    at = lambda i, c: F.max(F.when(F.col("_rn") == i, F.col(c)))
    return top.groupBy(*by).agg(at(1, name).alias("winner"), at(1, value).alias("winner_median"), at(2, name).alias("runner_up"), at(2, value).alias("runner_median"))


def venue_costs(quotes: DataFrame, slippage: float = 4.0, fx: dict[str, float] | None = None) -> DataFrame:
    """All-in cost in bps: spread, slippage, route FX, size-shortfall penalty; and the quote's validity reason."""
    d = lambda c: F.col(c).cast("double")
    fx = fx or {"A": 30.0, "N": 3.0}
    fx_cost = F.coalesce(F.element_at(F.create_map(*[z for k, v in fx.items() for z in (F.lit(k), F.lit(v))]), F.col("route_id")), F.lit(0.0))
    spread = (F.col("ask") - F.col("bid")).cast("double") / ((F.col("ask") + F.col("bid")).cast("double") / 2) * 10000
    short = F.greatest(F.lit(0.0), d("notional") - d("size")) / d("notional") * 100
    reason = (F.when(F.col("ask") < F.col("bid"), "QUOTE_INVALID").when(F.col("age") < 2, "LOOKAHEAD_QUOTE").when(F.col("age") > 6, "QUOTE_STALE").otherwise("OK"))
    return quotes.withColumn("cost", spread + slippage + fx_cost + short).withColumn("reject_reason", reason)


def cheapest_route(costs: DataFrame, edge: float, hurdle: float) -> DataFrame:
    """Cheapest eligible route per decision, or NO_TRADE with its reason. One row per (decision, route), so routes are few."""
    best = costs.groupBy("decision_id").agg(F.min_by(F.struct(F.col("route_id").alias("r"), F.round("cost", 6).alias("c")),
                                                     F.when(F.col("eligible"), F.struct(F.round("cost", 6), "route_id"))).alias("b"))
    left = F.lit(edge) - F.col("b.c")
    ok = left > hurdle
    return best.select("decision_id", F.when(F.col("b").isNull() | ~ok, "NO_TRADE").otherwise(F.col("b.r")).alias("route"), left.alias("remaining_edge"),
                       F.when(F.col("b").isNull(), "NO_ELIGIBLE_ROUTE").when(~ok, "EDGE_NOT_ABOVE_HURDLE").otherwise("MINIMUM_COST").alias("reason"))


#: Fixed values of the balanced walk: step and carry of each parameter's index.
STRIDES = ((3, 5), (5, 7), (7, 3), (11, 2))


def balanced_policies(horizons: DataFrame, quantiles: Sequence[float], fractions: Sequence[float], names: Sequence[int], holds: Sequence[int], budget: int) -> DataFrame:
    """``budget`` policies per horizon that cover every level of every parameter, with their place.

    First every holding period with the other parameters going round, then a walk over the grid whose indices advance by their
    own strides, at its first visits, then the grid's order. The budget is raised to the longest parameter list.
    """
    levels = (quantiles, fractions, names, holds)
    sizes = [len(x) for x in levels]
    total, budget = math.prod(sizes), max(budget, max(sizes))
    i = F.col("i")
    index = lambda parts: sum((parts[k] * math.prod(sizes[k + 1:]) for k in range(4)), F.lit(0))
    first = horizons.sparkSession.range(sizes[3]).select(index([F.col("id") % sizes[0], F.col("id") % sizes[1], F.col("id") % sizes[2], F.col("id")]).alias("cell"), F.col("id").alias("step"))
    walk = horizons.sparkSession.range(8 * total).withColumnRenamed("id", "i").select(
        index([(i * a + F.floor(i / b)) % n for (a, b), n in zip(STRIDES, sizes)]).alias("cell"), (i + sizes[3]).alias("step"))
    visit = first.union(walk).groupBy("cell").agg(F.min("step").alias("step"))
    grid = horizons.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(total - 1).cast("long"))).alias("cell")).join(visit, "cell", "left")
    place = F.row_number().over(Window.partitionBy(*horizons.columns).orderBy(F.coalesce("step", F.lit(9 * total) + F.col("cell"))))
    level = lambda k: F.element_at(F.array(*[F.lit(x) for x in levels[k]]), (F.floor(F.col("cell") / math.prod(sizes[k + 1:])) % sizes[k] + 1).cast("int"))
    return grid.withColumn("place", place).where(F.col("place") <= min(budget, total)).select(
        *horizons.columns, "place", level(0).alias("quantile"), level(1).alias("top_fraction"), level(2).alias("max_names"), level(3).alias("d"))


def policy_grid(horizons: DataFrame, quantiles: Sequence[float], fractions: Sequence[float], names: Iterable[int], d_max: int) -> DataFrame:
    """Every policy of the search space, exploded from fixed parameter tuples."""
    arr = lambda xs: F.array(*[F.lit(x) for x in xs])
    return (horizons.withColumn("quantile", F.explode(arr(quantiles))).withColumn("top_fraction", F.explode(arr(fractions)))
            .withColumn("max_names", F.explode(arr(names))).withColumn("d", F.explode(F.sequence(F.lit(1), F.least("h", F.lit(d_max))))))
