"""Walk-forward targets and models."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def forward_targets(panel: DataFrame, keys: Sequence[str], months: Sequence[int] = (1, 3), date: str = "assessment_date") -> DataFrame:
    """Future relative return and the date it becomes known, per horizon in months."""
    w = Window.partitionBy(*keys).orderBy(date)
    for m in months:
        panel = panel.withColumn(f"future_{m}m", F.lead("rel", m).over(w) / F.col("rel") - 1).withColumn(f"available_{m}m", F.lead(date, m).over(w))
    return panel


def moment_cells(panel: DataFrame, features: Sequence[str], target: str, available: str) -> DataFrame:
    """``(at, cell, v)``: per availability date the sums of products of [value - shift or 0, is-present, 1] with each other and the target.

    Cells are the upper triangle of that Gram matrix, row by row, then its products with the target. Values are shifted by
    their mean over the panel, so squares of a large offset never cancel. Every task sums its own rows per date; the
    matrix is never wider than one cell column, however many features there are.
    """
    p, m = len(features), 2 * len(features) + 1
    train = panel.where(F.col(target).isNotNull() & F.col(available).isNotNull())
    shift = np.array([x or 0.0 for x in panel.agg(*[F.avg(f) for f in features]).first()])
    upper = np.triu_indices(m)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            value = lambda c: batch.column(batch.schema.get_field_index(c)).cast(pa.float64()).to_numpy(zero_copy_only=False)
            x = np.stack([value(f) for f in features], axis=1) - shift
            here = ~np.isnan(x)
            e, y = np.hstack([np.where(here, x, 0.0), here, np.ones((len(x), 1))]), value(target)
            at = np.array(batch.column(batch.schema.get_field_index("at")).to_pylist(), object)
            for date in set(at):
                rows = at == date
                held[date] = held.get(date, 0.0) + np.concatenate([(e[rows].T @ e[rows])[upper], e[rows].T @ y[rows]])
        for date, v in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([date] * len(v), pa.date32()), pa.array(np.arange(len(v)), pa.int32()), pa.array(v)], names=["at", "cell", "v"])

    rows = train.select(F.col(available).cast("date").alias("at"), *features, F.col(target).cast("double").alias(target))
    return rows.mapInArrow(sums, "at date, cell int, v double").groupBy("at", "cell").agg(F.sum("v").alias("v"))


def solve_ridge(g: np.ndarray, y: np.ndarray, use: Sequence[int], ridge: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(beta, mean, sd) of the features ``use``: z-scored over present values, missing ones at zero, the intercept penalised too."""
    p, m = (len(g) - 1) // 2, len(g)
    rows = list(use) + [p + u for u in use] + [m - 1]
    g, y, p = g[np.ix_(rows, rows)], y[rows], len(use)
    n = g[p:2 * p, 2 * p]
    mean = np.divide(g[:p, 2 * p], n, out=np.zeros(p), where=n > 0)
    var = np.divide(np.diag(g)[:p], n, out=np.zeros(p), where=n > 0) - mean ** 2
    sd = np.sqrt(np.maximum(var, 0.0))
    sd[~np.isfinite(sd) | (sd < 1e-12)] = 1.0
    a = np.zeros((p + 1, 2 * p + 1))
    a[0, 2 * p] = 1.0
    for i in range(p):
        a[i + 1, i], a[i + 1, p + i] = 1 / sd[i], -mean[i] / sd[i]
    return np.linalg.solve(a @ g @ a.T + np.eye(p + 1) * ridge, a @ y), mean, sd


def walk_forward_ridges(panel: DataFrame, models: dict[str, Sequence[str]], target: str, available: str, *, date: str = "assessment_date",
                        min_months: int = 24, ridge: float = 1e-4) -> DataFrame:
    """Walk-forward ridge of several feature sets: adds one column of predictions per model, and ``train_rows``.

    Training rows for date t have ``available <= t`` (hence an earlier assessment). Moments are summed per availability
    date, prefix-summed over dates cell by cell, and small systems are solved per date inside tasks, all models from one set
    of moments; scoring is a dot product in the JVM. Cost is one pass, whatever the number of dates and models.
    """
    features = list(dict.fromkeys(f for fs in models.values() for f in fs))
    m = 2 * len(features) + 1
    upper = np.triu_indices(m)
    shift = np.array([x or 0.0 for x in panel.agg(*[F.avg(f) for f in features]).first()])
    cells = moment_cells(panel, features, target, available)
    total = F.sum("v").over(Window.partitionBy("cell").orderBy("at"))
    moments = cells.withColumn("v", total).groupBy("at").agg(F.array_sort(F.collect_list(F.struct("cell", "v"))).alias("moments"), F.count(F.lit(1)).alias("_n"))
    # a prefix holds every cell from the first date on, since each date's tasks emit all cells
    dates = panel.select(F.col(date).cast("date").alias("at")).distinct().join(moments.select("at", F.lit(True).alias("fresh")), "at", "full")
    w = Window.orderBy("at")
    calendar = dates.select("at", (F.row_number().over(w) - 1).alias("_i"), F.last(F.when(F.col("fresh"), F.col("at")), ignorenulls=True).over(w).alias("known"))
    ready = calendar.where(F.col("_i") >= min_months).join(moments.withColumnRenamed("at", "known"), "known").select("at", F.col("moments.v").alias("v"))
    names = list(models)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for at, v in zip(b["at"], b["v"]):
                v, g = np.asarray(v), np.zeros((m, m))
                g[upper] = v[:len(upper[0])]
                g = np.triu(g) + np.triu(g, 1).T
                row = {"at": at, "train_rows": int(round(g[m - 1, m - 1]))}
                for name in names:
                    use = [features.index(f) for f in models[name]]
                    beta, mean, sd = solve_ridge(g, v[len(upper[0]):], use, ridge)
                    row |= {f"beta_{name}": beta.tolist(), f"mean_{name}": (mean + shift[use]).tolist(), f"sd_{name}": sd.tolist()}
                out.append(row)
            yield pd.DataFrame(out, columns=["at", "train_rows", *(f"{k}_{n}" for n in names for k in ("beta", "mean", "sd"))])

    coef = ready.mapInPandas(solve, "at date, train_rows long, " + ", ".join(f"{k}_{n} array<double>" for n in names for k in ("beta", "mean", "sd")))
    scored = panel.join(coef, panel[date].cast("date") == F.col("at")).drop("at")
    for name in names:
        z = F.get(f"beta_{name}", F.lit(0))
        for i, f in enumerate(models[name]):
            z = z + F.get(f"beta_{name}", F.lit(i + 1)) * F.coalesce((F.col(f) - F.get(f"mean_{name}", F.lit(i))) / F.get(f"sd_{name}", F.lit(i)), F.lit(0.0))
        scored = scored.withColumn(name, z).drop(f"beta_{name}", f"mean_{name}", f"sd_{name}")
    return scored


def walk_forward_ridge(panel: DataFrame, features: Sequence[str], target: str, available: str, **options) -> DataFrame:
    """:func:`walk_forward_ridges` of one model, in the column ``predicted``."""
    return walk_forward_ridges(panel, {"predicted": features}, target, available, **options)


def pairwise_expected_wins(pairs: DataFrame, sets: DataFrame, keys: Sequence[str], boundary: str, date: str = "decision_date", matured: str = "matured_date") -> DataFrame:
    """Pairwise choice model (logistic, no intercept) on score differences; expected wins per candidate of the sets from ``boundary`` on.

    Fitted on pairs whose outcome matured before ``boundary`` and is no tie; every later pair is scored whatever its
    outcome. A candidate without pairs has no wins. Unit penalty on the standardised weight.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    cut = F.to_date(F.lit(boundary))
    x = VectorAssembler(inputCols=["score_diff"], outputCol="features").transform(
        pairs.withColumn("label", F.when(F.col("realized_diff") != 0, (F.col("realized_diff") > 0).cast("double"))))
    known = x.where(F.col("label").isNotNull() & (F.col(matured) < cut))
    model = LogisticRegression(fitIntercept=False, regParam=1.0 / max(1, known.count()), tol=1e-12, maxIter=200).fit(known)
    scored = model.transform(x.where(F.col(date) >= cut)).withColumn("p", vector_to_array("probability")[1])
    wins = scored.select(*keys, F.inline(F.array(F.struct(F.col("bucket_a").alias("h_bucket"), F.col("p").alias("w")), F.struct(F.col("bucket_b").alias("h_bucket"), (1 - F.col("p")).alias("w")))))
    won = wins.groupBy(*keys, "h_bucket").agg(F.sum("w").alias("expected_wins"), F.count(F.lit(1)).alias("pairs"))
    every = sets.where(F.col(date) >= cut).select(*keys, "h_bucket").distinct()
    return every.join(won, [*keys, "h_bucket"], "left").na.fill({"expected_wins": 0.0, "pairs": 0})


def rank_ensemble(df: DataFrame, keys: Sequence[str], scores: Sequence[str]) -> DataFrame:
    """Mean rank percentile ((average rank - 1) / (n - 1), 1 for a single candidate) of several scores inside a set.

    Sets missing any score drop out, so every score is judged on the common sample.
    """
    from chronopanel.operators.ordered import average_rank, value_counts
    common = df.groupBy(*keys).agg(F.bool_and(sum((F.col(s).isNull()).cast("int") for s in scores) == 0).alias("_ok")).where("_ok").select(*keys)
    x = df.join(common, list(keys), "left_semi")
    for s in scores:
        pct = F.when(F.col("size") > 1, (average_rank() - 1) / F.nullif(F.col("size") - 1, F.lit(0))).otherwise(1.0)
        x = x.join(value_counts(x, keys, s).select(*keys, s, pct.alias(f"pct_{s}")), [*keys, s])
    return x.withColumn("ensemble", sum(F.col(f"pct_{s}") for s in scores) / len(scores))


def linear_scores(panel: DataFrame, weights: dict[int, dict[str, float]], intercept: dict[int, float]) -> DataFrame:
    """Batch scores of a frozen linear model for many horizons, as one projection plus an explode."""
    rows = F.array(*[F.struct(F.lit(h).alias("horizon"), (F.lit(intercept[h]) + sum(F.coalesce(F.col(f), F.lit(0.0)) * w for f, w in ws.items())).alias("model_score"))
                     for h, ws in weights.items()])
    return panel.select("*", F.inline(rows))


def select_recipe(fold_metrics: DataFrame, min_folds: int) -> DataFrame:
    """Rank candidates by median, mean, positive share of fold Spearman, then MAE, then id."""
    from chronopanel.functions.rounding import rnd
    from chronopanel.functions.stats import median, share
    g = fold_metrics.groupBy("candidate_id").agg(
        rnd(median("spearman")).alias("median_spearman"), rnd(F.avg("spearman")).alias("mean_spearman"), rnd(share(F.col("spearman") > 0)).alias("positive_fraction"),
        rnd(F.avg("mae")).alias("mean_mae"), F.count(F.lit(1)).alias("fold_count")).where(F.col("fold_count") >= min_folds)
    w = Window.orderBy(F.desc("median_spearman"), F.desc("mean_spearman"), F.desc("positive_fraction"), "mean_mae", "candidate_id")
    return g.withColumn("rank", F.row_number().over(w).cast("long"))
