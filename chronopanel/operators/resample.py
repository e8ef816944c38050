"""Bootstrap inference as joins over a replicate dimension.

Draws come from MD5 of (seed, key, replicate, draw), so results do not depend
on partitioning and any SQL engine can reproduce them. A series is at calendar
or cluster grain (one row per month, block or cluster); replicates multiply
that bounded size and spread over (key, replicate).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(n: Column, *parts: Column) -> Column:
    """Uniform integer in [0, n) from a 28-bit MD5 prefix."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long"), n)


def index_series(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    return df.select(*keys, (F.row_number().over(w) - 1).cast("long").alias("pos"), *values)


def valued(draws: DataFrame, series: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Draws (keys, rep, pos) with the values at their positions; a NULL key meets nothing.

    Draws come from exploded sequences, which Spark sizes like the few rows before, so an inner join would broadcast them. Every
    position drawn is in the series, so a left join has the same rows, and of a left join only the series may be broadcast.
    """
    known = draws.where(reduce(lambda x, y: x & y, (F.col(k).isNotNull() for k in keys)))
    return known.join(series, [*keys, "pos"], "left").select(*keys, "rep", *values)


def block_samples(series: DataFrame, keys: Sequence[str], values: Sequence[str], *, block: int, reps: int, seed: int,
                  fixed: bool = False, whole: bool = False) -> DataFrame:
    """Resampled rows (keys, rep, values): random-start blocks cut at the end of the series, fixed partition blocks, or whole blocks.

    Draws continue until n values are collected; the last block is trimmed. Whole blocks start only where all of a block
    fits, so n / block draws are enough; the other two may meet short blocks and draw up to n.
    """
    size = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= (block if whole else 1))
    blocks = F.ceil(F.col("n") / block) if fixed else F.col("n") - block + 1 if whole else F.col("n")
    draws = F.ceil(F.col("n") / block) if whole else F.col("n")
    d = (size.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), draws)))
         .withColumn("_b", draw(blocks, F.lit(seed), F.col("rep"), F.col("i"))))
    start = F.col("_b") * block if fixed else F.col("_b")
    d = d.withColumn("_start", start).withColumn("_len", F.least(F.lit(block), F.col("n") - F.col("_start")))
    before = F.sum("_len").over(Window.partitionBy(*keys, "rep").orderBy("i")) - F.col("_len")
    d = d.withColumn("_have", before).where("_have < n").withColumn("_take", F.least(F.col("_len"), F.col("n") - F.col("_have")))
    picks = d.select(*keys, "rep", F.explode(F.sequence(F.col("_start"), F.col("_start") + F.col("_take") - 1)).alias("pos"))
    return valued(picks, series, keys, values)


def iid_samples(series: DataFrame, keys: Sequence[str], values: Sequence[str], *, reps: int, seed: int) -> DataFrame:
    size = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    tasks = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))       # a given number: adaptive plans would join these few rows to one task again
    spread = size.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).repartition(tasks, *keys, "rep")
    d = spread.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).withColumn("pos", draw(F.col("n"), F.lit(seed), F.col("rep"), F.col("i")))
    return valued(d.select(*keys, "rep", "pos"), series, keys, values)


def summarize(samples: DataFrame, keys: Sequence[str], statistic: Column, band: dict[str, float] | None = None) -> DataFrame:
    """Replicate statistics reduced to mean, the band's quantiles (5% and 95%) and the positive fraction (one row per replicate, so exact)."""
    r = samples.groupBy(*keys, "rep").agg(statistic.alias("s"))
    return r.groupBy(*keys).agg(F.avg("s").alias("boot_mean"), *(F.expr(f"percentile(s, {q})").alias(name) for name, q in (band or {"q05": 0.05, "q95": 0.95}).items()),
                                F.avg((F.col("s") > 0).cast("int")).alias("positive_fraction"))


#: Fixed values of the acceptance rule: draws, paired folds, share of draws in which the challenger wins, robust gain.
DRAWS, PAIRED_FOLDS, PROBABILITY, ROBUST_GAIN = 5_000, 5, 0.9, 0.005


def running_incumbent(choices: DataFrame, metrics: DataFrame, keys: Sequence[str], order: str, *, reps: int = DRAWS, seed: int = 11) -> DataFrame:
    """Incumbent per assessment; a winner takes over only on new folds and if a paired bootstrap against the incumbent accepts it.

    ``choices``: keys, ``order``, winner, scores (map of candidate to robust score). ``metrics``: keys, candidate, fold,
    available_at, metric. Which pair is compared depends on the incumbent so far, so the job judges the winner of every row with new
    folds against every candidate, and a fold over the calendar looks the incumbent's verdict up. An incumbent without
    a score at an assessment that compares it fails the query.
    """
    from chronopanel.functions.rounding import rnd
    from chronopanel.functions.stats import robust_score
    from chronopanel.operators.folds import INCUMBENT_MISSING, carried

    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(order)
    seen = choices.select(*keys, order, F.col("winner").alias("candidate")).join(metrics, [*keys, "candidate"]).where(F.col("available_at") <= F.col(order))
    folds = seen.groupBy(*keys, order).agg(F.array_sort(F.collect_set("fold")).alias("folds"))          # one per calendar period
    rows = choices.join(folds, [*keys, order]).withColumn("new_folds", F.coalesce(F.lag("folds").over(w) != F.col("folds"), F.lit(False))).drop("folds")
    pairs = rows.where("new_folds").select(*keys, order, "winner", "scores", F.explode(F.map_keys("scores")).alias("rival")).where("rival <> winner")
    value = lambda who, name: metrics.select(*keys, F.col("candidate").alias(who), "fold", F.col("metric").alias(name), F.col("available_at").alias(f"{name}_at"))
    paired = (pairs.select(*keys, order, "winner", "rival").join(value("rival", "a"), [*keys, "rival"]).join(value("winner", "b"), [*keys, "winner", "fold"])
              .where(F.greatest("a_at", "b_at") <= F.col(order)))
    unit = [*keys, order, "rival"]
    series = index_series(paired, unit, "fold", ["a", "b"])
    chance = iid_samples(series, unit, ["a", "b"], reps=reps, seed=seed).groupBy(*unit, "rep").agg((robust_score("b") - robust_score("a")).alias("gain"))
    chance = chance.groupBy(*unit).agg(rnd(F.avg((F.col("gain") > 0).cast("int"))).alias("probability"))
    gain = F.element_at("scores", F.col("winner")) - F.element_at("scores", F.col("rival"))
    judged = pairs.join(series.groupBy(*unit).agg(F.count(F.lit(1)).alias("n")), unit).join(chance, unit).withColumn(
        "accepted", (F.col("n") >= PAIRED_FOLDS) & (F.col("probability") >= PROBABILITY) & (gain >= ROBUST_GAIN))
    table = judged.groupBy(*keys, order).agg(F.map_from_entries(F.collect_list(F.struct("rival", F.struct("accepted", "probability")))).alias("verdicts"))
    ready = rows.join(table, [*keys, order], "left")

    def step(s, x):
        held = s["incumbent"]
        asked = held.isNotNull() & x["new_folds"] & (x["winner"] != held)
        lost = F.when(asked & F.element_at(x["scores"], held).isNull(), F.raise_error(F.lit(INCUMBENT_MISSING)).cast("boolean")).otherwise(F.lit(False))
        verdict = F.when(asked & ~lost, F.element_at(x["verdicts"], held))
        switch = F.coalesce(verdict["accepted"], F.lit(False))
        return F.struct(F.when(held.isNull() | switch, x["winner"]).otherwise(held).alias("incumbent"), held.alias("before"), verdict["probability"].alias("probability"), switch.alias("switched"))

    kind = "struct<incumbent:string,before:string,probability:double,switched:boolean>"
    none = F.struct(F.lit(None).alias("incumbent"), F.lit(None).alias("before"), F.lit(None).alias("probability"), F.lit(False).alias("switched"))
    return carried(ready, keys, order, ["winner", "scores", "verdicts", "new_folds"], kind, none, step).join(rows.select(*keys, order, "winner", "new_folds"), [*keys, order])
