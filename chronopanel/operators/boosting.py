"""Walk-forward gradient boosting by shared histograms: every fold and arm of a round is one aggregation.

A model per fold date, execution arm and feature arm is a key of the tables, not a driver loop. Training rows of a fold are known
by its date, the fold's own rows are scored. Features are cut into bins by each fold's own training values. A round sums
residuals by (model, feature, bin), finds each model's best cut from running sums over at most ``bins`` rows, and adds the
two leaf means, shrunk, to the rows. Rounds are written tables, so recovery never repeats one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.operators.ordered import value_counts
from chronopanel.session import stage

MODEL = ["fold", "execution_arm"]


def fold_rows(panel: DataFrame, ids: Sequence[str], execution_arm: str, features: Sequence[str], target: str, available: str, date: str, min_months: int) -> DataFrame:
    """Training and test rows of every fold: fold, execution_arm, ids, test, y, known_at and the features.

    Folds are the panel's dates from the ``min_months``-th on, a calendar; a row trains every fold from the date its target is
    known and is tested in its own.
    """
    calendar = panel.select(date).distinct().withColumn("_i", F.row_number().over(Window.orderBy(date)) - 1)
    folds = calendar.where(F.col("_i") >= min_months).agg(F.array_sort(F.collect_list(date)).alias("_folds"))
    rows = panel.where(F.col(target).isNotNull()).select(*ids, F.col(execution_arm).alias("execution_arm"), F.col(date).alias("_date"), F.col(available).alias("known_at"), F.col(target).alias("y"), *features)
    every = rows.join(F.broadcast(folds), F.lit(True))                      # one row: the calendar
    used = F.filter("_folds", lambda t: (t == F.col("_date")) | F.coalesce(F.col("known_at") <= t, F.lit(False)))
    return every.withColumn("fold", F.explode(used)).withColumn("test", F.col("fold") == F.col("_date")).drop("_folds", "_date")


def manifest(rows: DataFrame) -> DataFrame:
    """Per fold and execution arm: training and test rows, the last date a training target became known, and whether it is later than the fold."""
    train = ~F.col("test")
    return rows.groupBy(*MODEL).agg(F.count_if(train).alias("train_rows"), F.count_if("test").alias("test_rows"), F.max(F.when(train, F.col("known_at"))).alias("last_train")).withColumn(
        "leak", F.coalesce(F.col("last_train") > F.col("fold"), F.lit(False)))


def binned(rows: DataFrame, features: Sequence[str], bins: int) -> DataFrame:
    """Replaces the features by ``b``, their bins: how many of the fold's cuts are at most the value, -1 for a missing one."""
    out = rows
    for k, f in enumerate(features):
        counts = value_counts(rows.where(~F.col("test")), MODEL, f)
        cuts = (counts.groupBy(*MODEL, F.floor(F.col("below") * bins / F.col("size")).alias("_b")).agg(F.min(f).alias("_cut")).where("_b > 0")
                .groupBy(*MODEL).agg(F.collect_list("_cut").alias(f"_cuts_{k}")))
        out = out.join(cuts, MODEL, "left")
    value = lambda k, f: F.when(F.col(f).isNull(), -1).otherwise(F.coalesce(F.size(F.filter(f"_cuts_{k}", lambda c: c <= F.col(f))), F.lit(0)))
    kept = [c for c in rows.columns if c not in features]
    return out.select(*kept, F.array(*[value(k, f) for k, f in enumerate(features)]).alias("b"))


def boosted_stumps(rows: DataFrame, ids: Sequence[str], feature_arms: dict[str, Sequence[str]], *, rounds: int = 5, rate: float = 0.1, bins: int = 16, least: int = 10) -> DataFrame:
    """Predictions of the test rows per fold, execution arm and feature arm: ids, ``predicted`` and ``realized``.

    Each round adds a one-cut tree; a side holds at least ``least`` training rows, a model without such a cut stays as it
    is. Ties take the first feature, then the lowest cut.
    """
    features = list(dict.fromkeys(f for fs in feature_arms.values() for f in fs))
    arms = F.array(*[F.struct(F.lit(name).alias("feature_arm"), F.array(*[F.lit(features.index(f)) for f in fs]).alias("use")) for name, fs in feature_arms.items()])
    base = binned(rows, features, bins).select("*", F.inline(arms))
    model = [*MODEL, "feature_arm"]
    start = base.where(~F.col("test")).groupBy(*model).agg(F.avg("y").alias("pred"))
    state = stage(base.join(start, model), "boosting-0")
    for k in range(rounds):
        cells = (state.where(~F.col("test")).select(*model, (F.col("y") - F.col("pred")).alias("r"), "b", F.explode("use").alias("f"))
                 .groupBy(*model, "f", F.get("b", F.col("f")).alias("bin")).agg(F.sum("r").alias("g"), F.count(F.lit(1)).alias("n")))
        inner, whole = Window.partitionBy(*model, "f").orderBy("bin"), Window.partitionBy(*model, "f")
        cuts = cells.select(*model, "f", "bin", F.sum("g").over(inner).alias("gl"), F.sum("n").over(inner).alias("nl"), F.sum("g").over(whole).alias("g"), F.sum("n").over(whole).alias("n"))
        cuts = cuts.where((F.col("nl") >= least) & (F.col("n") - F.col("nl") >= least)).withColumn("gr", F.col("g") - F.col("gl")).withColumn("nr", F.col("n") - F.col("nl"))
        gain = F.round(F.col("gl") * F.col("gl") / F.col("nl") + F.col("gr") * F.col("gr") / F.col("nr"), 12)
        best = cuts.groupBy(*model).agg(F.min_by(F.struct("f", "bin", (F.col("gl") / F.col("nl")).alias("low"), (F.col("gr") / F.col("nr")).alias("high")), F.struct((-gain).alias("s"), "f", "bin")).alias("cut"))
        step = F.when(F.get("b", F.col("cut.f")) <= F.col("cut.bin"), F.col("cut.low")).otherwise(F.col("cut.high"))
        state = stage(state.join(best, model, "left").withColumn("pred", F.col("pred") + F.coalesce(rate * step, F.lit(0.0))).drop("cut"), f"boosting-{k + 1}")
    return state.where("test").select(*model, *ids, F.col("pred").alias("predicted"), F.col("y").alias("realized"))
