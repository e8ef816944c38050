"""Ranks, quantiles and rank correlation per group, safe for hot groups.

Everything is computed from the (group, value) count table, which map-side aggregation shrinks before any shuffle. Running
counts are two-level: a group of many values is cut into ranges of about ``RANGE_ROWS`` by its own approximate quantiles,
rows are ordered inside one (group, range) cell, and cell totals are prefix-summed. So a group holding a third of all rows
is spread whatever its scale, a small group is one window, and equal values share one counted row. The count table is
shuffled once for its cut points and totals and once by cell; windows and cell totals read that one exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values of a group that one window orders, and the most ranges a group is cut into.
RANGE_ROWS, RANGES = 100_000, 256


def with_range(counts: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Add ``_range``, a monotone bucket of ``value`` within its group; groups of up to ``RANGE_ROWS`` values have one."""
    by = list(by)
    points = [i / RANGES for i in range(1, RANGES)]
    step = F.greatest(F.lit(1), F.floor(F.lit(RANGES) / F.ceil(F.col("_levels") / RANGE_ROWS))).cast("int")
    cuts = (counts.groupBy(*by) if by else counts).agg(F.percentile_approx(value, points, 4 * RANGES).alias("_points"), F.count(F.lit(1)).alias("_levels"))
    # only groups of over RANGE_ROWS values have cuts, so their table is small whatever the number of groups and no row moves to meet it
    cuts = cuts.where(F.col("_levels") > RANGE_ROWS).select(*by, F.filter("_points", lambda x, i: (i + 1) % step == 0).alias("_cuts"))
    marked = counts.join(F.broadcast(cuts), by or F.lit(True), "left")
    # the number of cuts below the value, by halving steps: cuts ascend
    steps = F.array(*[F.lit(RANGES >> k) for k in range(1, RANGES.bit_length())])
    below = F.aggregate(steps, F.lit(0), lambda at, more: F.when(F.get("_cuts", at + more - 1) < F.col(value), at + more).otherwise(at))
    return marked.withColumn("_range", F.when(F.col("_cuts").isNull(), 0).otherwise(below)).drop("_cuts")


def value_counts(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(group, value) counts with ``below`` (rows strictly smaller), ``n`` (ties), ``dense``, ``size``, ``levels``."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    inner = Window.partitionBy(*by, "_range").orderBy(value)
    ranked = with_range(counts, by, value).withColumn("_cum", F.sum("n").over(inner)).withColumn("_pos", F.row_number().over(inner))
    cells = ranked.groupBy(*by, "_range").agg(F.max("_cum").alias("_cell"), F.max("_pos").alias("_lv"))
    outer = Window.partitionBy(*by).orderBy("_range")          # at most RANGES rows per group
    whole = Window.partitionBy(*by)
    cells = cells.select(*by, "_range", (F.sum("_cell").over(outer) - F.col("_cell")).alias("_before"),
                         (F.sum("_lv").over(outer) - F.col("_lv")).alias("_lv_before"),
                         F.sum("_cell").over(whole).alias("size"), F.sum("_lv").over(whole).alias("levels"))
    return (ranked.join(cells, [*by, "_range"])
            .select(*by, value, "n", (F.col("_before") + F.col("_cum") - F.col("n")).alias("below"),
                    (F.col("_lv_before") + F.col("_pos")).alias("dense"), "size", "levels"))


def average_rank(ascending: bool = True) -> Column:
    """Average-tie rank from a value_counts row."""
    up = F.col("below") + (F.col("n") + 1) / 2
    return up if ascending else F.col("size") + 1 - up


def rank_columns(df: DataFrame, by: Sequence[str], value: str, *, rank: str | None = None, pct: str | None = None,
                 dense: str | None = None, ascending: bool = True) -> DataFrame:
    """Attach average-tie rank, rank / size and dense rank of ``value`` within ``by``."""
    out = []
    if rank:
        out.append(average_rank(ascending).alias(rank))
    if pct:
        out.append((average_rank(ascending) / F.col("size")).alias(pct))
    if dense:
        d = F.col("dense") if ascending else F.col("levels") + 1 - F.col("dense")
        out.append(d.cast("long").alias(dense))
    table = value_counts(df, by, value).select(*by, value, *out)
    return df.join(table, [*by, value], "left")


def quantiles(df: DataFrame, by: Sequence[str], value: str, qs: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated quantiles per group, from the count table; no group is gathered."""
    t = value_counts(df, by, value)
    aggs = []
    for name, q in qs.items():
        pos = (F.col("size") - 1) * F.lit(float(q))
        lo, hi = F.floor(pos), F.ceil(pos)
        at = lambda p: F.max(F.when((F.col("below") <= p) & (p < F.col("below") + F.col("n")), F.col(value)))
        aggs += [at(lo).alias(f"_lo_{name}"), at(hi).alias(f"_hi_{name}"), F.max(pos - lo).alias(f"_w_{name}")]
    g = (t.groupBy(*by) if by else t).agg(*aggs)
    return g.select(*by, *[(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_w_{n}")).alias(n)
                           for n in qs])


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation, NULL for constant input (plain corr raises there in ANSI mode)."""
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when((sx > 1e-12) & (sy > 1e-12), F.covar_pop(x, y) / F.nullif(sx * sy, F.lit(0.0)))


def rank_ic(df: DataFrame, by: Sequence[str], x: str, y: str, *, min_rows: int = 3, name: str = "rank_ic") -> DataFrame:
    """Spearman correlation (average ties) per group; NULL below ``min_rows`` or for constant input."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y)
    ranked = rank_columns(rank_columns(pairs, by, x, rank="_rx"), by, y, rank="_ry")
    return (ranked.groupBy(*by) if by else ranked).agg(
        F.when(F.count(F.lit(1)) >= min_rows, safe_corr(F.col("_rx"), F.col("_ry"))).alias(name),
        F.count(F.lit(1)).alias("n_rows"))


def top_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per group. ``row_number <= k`` lets Spark keep only k rows per group and map task
    (WindowGroupLimit) before the shuffle, so a hot group costs k rows per task."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)
