"""Design-surface evaluation: cell aggregates, treatments, neighbourhoods, plateaus, coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.functions.rounding import rnd
from chronopanel.functions.stats import median, quantile, share
from chronopanel.session import cut_lineage

ACTIVE = "CASE WHEN trade_count > 0 THEN cagr_excess END"


def cell_aggregate(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fold metrics per cell; a cell has one row per fold, so exact percentiles stay small."""
    active = F.col("trade_count") > 0
    v = F.expr(ACTIVE)
    agg = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("folds"), F.count_if(active).alias("active_folds"),
        share(F.col("cagr_excess") > 0).alias("positive_fold_fraction"),
        F.coalesce(share(v > 0), F.lit(0.0)).alias("positive_active_fraction"),
        median("cagr_excess").alias("median_excess"), quantile("cagr_excess", 0.25).alias("q25_excess"),
        F.min("cagr_excess").alias("worst_excess"), F.coalesce(median(ACTIVE), F.lit(0.0)).alias("median_active"),
        F.coalesce(quantile(ACTIVE, 0.25), F.lit(0.0)).alias("q25_active"), F.coalesce(F.min(v), F.lit(0.0)).alias("worst_active"),
        F.sum("trade_count").alias("trade_count"), median("turnover").alias("median_turnover"), F.min("worst_dd").alias("worst_drawdown"))
    doubles = [c for c, t in agg.dtypes if t == "double"]
    agg = agg.withColumns({c: rnd(c) for c in doubles}).withColumn("inactive_folds", F.col("folds") - F.col("active_folds")).withColumn(
        "active_fold_fraction", rnd(F.col("active_folds") / F.col("folds")))
    return agg.withColumn("robust_gate", (F.col("active_folds") >= 3) & (F.col("positive_active_fraction") >= 0.6)
                          & (F.col("median_active") > 0) & (F.col("trade_count") >= 8))


def treatment_summary(cells: DataFrame, arm: str, baseline: str, design_cells: DataFrame | int) -> DataFrame:
    """Per treatment: robust and positive shares, delta quantiles, pass rule and rank. ``cells`` carries ``delta``."""
    n = F.lit(design_cells) if isinstance(design_cells, int) else design_cells
    agg = cells.groupBy(arm).agg(
        F.count(F.lit(1)).alias("cells"), F.count_if("robust_gate").alias("robust_cells"),
        rnd(share(F.col("robust_gate"))).alias("robust_fraction"), rnd(share(F.col("median_active") > 0)).alias("positive_fraction"),
        rnd(median("median_active")).alias("median_of_medians"), rnd(quantile("median_active", 0.25)).alias("q25_of_medians"),
        rnd(median("delta")).alias("median_delta"), rnd(quantile("delta", 0.25)).alias("q25_delta"), rnd(F.min("delta")).alias("worst_delta"),
        rnd(share(F.col("delta") > 0)).alias("beat_fraction"), F.sum("trade_count").alias("total_trades"))
    is_base = F.col(arm) == baseline
    base_ok = (F.col("cells") == n) & (F.col("robust_fraction") >= 0.5) & (F.col("positive_fraction") >= 0.5)
    treat_ok = (F.col("cells") == n) & (F.col("robust_fraction") >= 0.5) & (F.col("beat_fraction") >= 0.6) & \
        (F.col("median_delta") > 0) & (F.col("q25_delta") >= 0)
    out = agg.withColumn("beat_fraction", F.when(is_base, 0.0).otherwise(F.col("beat_fraction"))).withColumn(
        "passed", F.when(is_base, base_ok).otherwise(treat_ok))
    order = Window.orderBy(F.desc("passed"), F.desc("q25_delta"), F.desc("median_delta"), F.desc("robust_fraction"), F.desc("worst_delta"), arm)
    return out.withColumn("treatment_rank", F.row_number().over(order).cast("long"))


def fold_summary(folds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Outer-fold summary that treats folds without trades as inactive, with chained growth.

    ``folds``: one row per (keys, fold) with cagr_excess, trade_count, total_return, bench_return.
    """
    chain = lambda c: F.product(F.greatest(F.lit(0.0), 1 + F.col(c))) - 1
    v = F.expr(ACTIVE)
    return folds.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("folds"), F.count_if(F.col("trade_count") > 0).alias("active_folds"),
        F.count_if(F.col("cagr_excess") > 0).alias("positive_folds"),
        rnd(F.coalesce(share(v > 0), F.lit(0.0))).alias("positive_active_fraction"),
        rnd(median("cagr_excess")).alias("median_excess"), rnd(quantile("cagr_excess", 0.25)).alias("q25_excess"),
        rnd(F.coalesce(F.min(v), F.lit(0.0))).alias("worst_active"), F.sum("trade_count").alias("trade_count"),
        rnd(chain("total_return")).alias("chained_return"), rnd(chain("bench_return")).alias("chained_bench"))


def expected_cells(spark, h_max: int, d_max: int) -> DataFrame:
    """Design grid (h, d) with d <= min(h, d_max)."""
    h = spark.range(1, h_max + 1).select(F.col("id").cast("int").alias("h"))
    return h.select("h", F.explode(F.sequence(F.lit(1), F.least("h", F.lit(d_max)))).alias("d"))


OFFSETS = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]


def neighbour_keys(cells: DataFrame, keep: Sequence[str] = (), offsets=OFFSETS) -> DataFrame:
    """Each cell with the keys of its grid neighbours (a fixed fan-out, then an equi-join)."""
    shift = F.array(*[F.struct((F.col("h") + i).alias("nh"), (F.col("d") + j).alias("nd")) for i, j in offsets])
    return cells.select("h", "d", *keep, F.inline(shift))


def local_stability(cells: DataFrame, design: DataFrame) -> DataFrame:
    """Neighbourhood coverage, robust share, median / worst neighbour and sensitivity per cell."""
    wanted = neighbour_keys(cells, ["robust_gate", "median_active"]).join(
        design.select(F.col("h").alias("nh"), F.col("d").alias("nd")), ["nh", "nd"])
    found = wanted.join(cells.select(F.col("h").alias("nh"), F.col("d").alias("nd"), F.col("median_active").alias("nv"),
                                     F.col("robust_gate").alias("nr")), ["nh", "nd"], "left").withColumn(
        "nd_abs", F.abs(F.col("nv") - F.col("median_active")))
    s = found.groupBy("h", "d").agg(
        F.count(F.lit(1)).alias("expected_neighbours"), F.count("nv").alias("local_neighbours"),
        rnd(F.coalesce(share(F.when(F.col("nv").isNotNull(), F.col("nr"))), F.lit(0.0))).alias("robust_neighbour_fraction"),
        rnd(F.coalesce(median("nv"), F.lit(0.0))).alias("median_neighbour"), rnd(F.coalesce(F.min("nv"), F.lit(0.0))).alias("worst_neighbour"),
        rnd(F.coalesce(median("nd_abs"), F.lit(0.0))).alias("median_abs_delta"))
    out = cells.join(s, ["h", "d"], "left").na.fill(
        {"expected_neighbours": 0, "local_neighbours": 0, "robust_neighbour_fraction": 0.0, "median_neighbour": 0.0,
         "worst_neighbour": 0.0, "median_abs_delta": 0.0})
    coverage = F.when(F.col("expected_neighbours") > 0, F.col("local_neighbours") / F.nullif("expected_neighbours", F.lit(0))).otherwise(1.0)
    return out.withColumn("coverage", rnd(coverage)).withColumn(
        "stable", F.col("robust_gate") & (F.col("coverage") >= 0.999999) & (F.col("local_neighbours") >= 2)
        & (F.col("robust_neighbour_fraction") >= 0.5) & (F.col("median_neighbour") > 0))


def connected_components(cells: DataFrame, offsets=OFFSETS) -> DataFrame:
    """Component label (smallest cell key) per cell by min-label propagation with pointer jumping.

    Every round is two equi-joins on cell keys; each round's result is
    checkpointed reliably, and the loop ends only when no label changes. Labels
    are (h, d) pairs, so no two cells share one; the component reads h * 10^6 + d
    as text or number only at the end.
    """
    nodes = cells.select("h", "d", F.struct("h", "d").alias("id")).distinct()
    edges = neighbour_keys(nodes, ["id"], offsets).join(
        nodes.select(F.col("h").alias("nh"), F.col("d").alias("nd"), F.col("id").alias("nid")), ["nh", "nd"]).select("id", "nid")
    edges = cut_lineage(edges)
    labels = cut_lineage(nodes.select("id", F.col("id").alias("label")))
    while True:
        near = edges.join(labels.select(F.col("id").alias("nid"), "label"), "nid").groupBy("id").agg(F.min("label").alias("_near"))
        hop = labels.join(near, "id", "left").select("id", F.col("label").alias("_old"), F.least("label", "_near").alias("label"))
        jump = hop.select(F.col("id").alias("label"), F.col("label").alias("_up"))
        step = cut_lineage(hop.join(jump, "label", "left").select("id", "_old", F.least("label", "_up").alias("label")))
        labels = step.select("id", "label")
        if step.where("label <> _old").isEmpty():
            break
    named = F.col("label.h").cast("decimal(20,0)") * 1_000_000 + F.col("label.d")
    return nodes.join(labels, "id").select("h", "d", F.when(F.col("label.d") < 1_000_000, named).otherwise(F.raise_error(F.lit("cell beyond the plateau id format"))).cast("long").alias("component"))


def plateaus(cells: DataFrame) -> DataFrame:
    """Plateau statistics and rank over the components of stable cells."""
    stable = cells.where("stable")
    comp = connected_components(stable)
    s = stable.join(comp, ["h", "d"]).groupBy("component").agg(
        F.count(F.lit(1)).alias("cells"), F.min("h").alias("h_min"), F.max("h").alias("h_max"), F.min("d").alias("d_min"),
        F.max("d").alias("d_max"), rnd(F.min("median_active")).alias("worst_cell"), rnd(median("median_active")).alias("median_cell"),
        rnd(median("q25_active")).alias("median_q25"), F.min("positive_active_fraction").alias("min_positive"),
        F.sum("trade_count").alias("total_trades"))
    order = Window.orderBy(F.desc("worst_cell"), F.desc("median_q25"), F.desc("min_positive"), F.desc("cells"), F.desc("median_cell"), "component")
    return s.withColumn("plateau_rank", F.row_number().over(order).cast("long"))


def coverage_report(status: DataFrame, design: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Missing, incomplete, unexpected and duplicate cells, and the completeness flag, in one full join."""
    seen = status.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max((F.col("status") == "COMPLETE").cast("int")).alias("_ok"))
    j = design.select(*keys).distinct().withColumn("_e", F.lit(1)).join(seen, list(keys), "full")
    exp, obs = F.col("_e").isNotNull(), F.col("_n").isNotNull()
    s = j.agg(F.count_if(exp).alias("expected"), F.count_if(obs).alias("observed"), F.count_if(exp & (F.coalesce("_ok", F.lit(0)) == 1)).alias("complete"),
              F.count_if(exp & ~obs).alias("missing"), F.count_if(exp & (F.coalesce("_ok", F.lit(0)) == 0)).alias("incomplete"),
              F.count_if(~exp).alias("unexpected"), F.count_if(obs & (F.col("_n") > 1)).alias("duplicates"))
    return s.withColumn("surface_complete", (F.col("missing") + F.col("incomplete") + F.col("unexpected") + F.col("duplicates")) == 0)


def plateau_id(h: Column, d: Column, mode: Column) -> Column:
    """Three-session structural neighbourhood of a (horizon, holding) pair."""
    h0, d0 = F.floor((h - 1) / 3) * 3 + 1, F.floor((d - 1) / 3) * 3 + 1
    return F.format_string("H%02d-%02d_D%02d-%02d_%s", h0, F.least(F.lit(30), h0 + 2), d0, F.least(F.lit(30), d0 + 2), mode)


def plateau_of_family(family: str = "family_id") -> Column:
    pattern = r"^H(\d{2})_D(\d{2})_N\d{2}_(FIXED|LEARNED_EXIT)$"
    part = lambda i: F.regexp_extract(family, pattern, i)
    num = lambda i: F.expr(f"try_cast(regexp_extract({family}, '{pattern}', {i}) AS bigint)".replace("\\", "\\\\"))
    return F.when(F.col(family).rlike(pattern), plateau_id(num(1), num(2), part(3))).otherwise(F.col(family))


def collapse_to_plateaus(panel: DataFrame, date: str, numeric: Sequence[str], first: Sequence[str] = ()) -> DataFrame:
    """Median of every numeric column per (date, plateau) and provenance of the first family."""
    x = panel.withColumn("plateau_id", plateau_of_family())
    return x.groupBy(date, "plateau_id").agg(*[median(c).alias(c) for c in numeric],
                                             *[F.min_by(c, "family_id").alias(c) for c in first],
                                             F.countDistinct("family_id").alias("families"))
