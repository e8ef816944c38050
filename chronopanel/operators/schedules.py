"""Schedules, generations and evidence as of a cutoff.

Schedules hold one row per (family, activation) and assessments one per
calendar period, so joins between them are calendar-sized on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.operators.asof import asof_join
from chronopanel.operators.digests import LIMBS, digest, limbs, prefix_digests, running_robust_score


def evidence_snapshots(panel: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """What was known at each cutoff: matured rows, folds, identity.

    The panel collapses to one row per terminal session and fold; a fold joins the set on its first session, and
    running state over the calendar-sized table is then looked up as of each cutoff.
    """
    cells = panel.groupBy("terminal_date", "fold_id").agg(F.count(F.lit(1)).alias("n"), F.sum("excess").alias("s"))
    first = F.row_number().over(Window.partitionBy("fold_id").orderBy("terminal_date")) == 1
    cells = cells.where("terminal_date IS NOT NULL").withColumn("_first", first & F.col("fold_id").isNotNull())
    parts = {f"_l{k}": F.sum(F.when(F.col("_first"), x)) for k, x in enumerate(limbs(F.col("fold_id")))}
    day = cells.groupBy("terminal_date").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.count_if("_first").alias("f"), *[c.alias(k) for k, c in parts.items()])
    w = Window.orderBy("terminal_date")
    state = day.select("terminal_date", F.sum("n").over(w).alias("n_rows"), F.sum("s").over(w).alias("_s"), F.sum("f").over(w).alias("n_folds"),
                       digest([F.sum(k).over(w) for k in parts]).alias("fingerprint"))
    seen = asof_join(cutoffs, state, [], "cutoff", "terminal_date", how="inner")
    return seen.select("cutoff", "n_rows", "n_folds", F.col("terminal_date").alias("latest_terminal"), (F.col("_s") / F.col("n_rows")).alias("mean_excess"), "fingerprint")


def train_calibration_split(sessions: DataFrame, cutoffs: DataFrame, train: int, purge: int, calibration: int) -> DataFrame:
    """(cutoff_idx, decision_date, part): calibration window, purge gap, train window, all in sessions."""
    offsets = cutoffs.select("cutoff_idx", F.posexplode(F.sequence(
        F.col("cutoff_idx") - (train + purge + calibration - 1), F.col("cutoff_idx"))).alias("_p", "idx"))
    part = F.when(F.col("_p") < train, "TRAIN").when(F.col("_p") >= train + purge, "CALIBRATION")
    return (offsets.withColumn("part", part).where("part IS NOT NULL")
            .join(sessions.select("idx", F.col("date").alias("decision_date")), "idx")
            .select("cutoff_idx", "decision_date", "part"))


def cohort_evidence(panel: DataFrame, sessions: DataFrame, length: int, keep: int, cap: float, cutoff: str) -> DataFrame:
    """Matured fixed-length cohorts with clipped mean excess; flags the latest ``keep``."""
    from chronopanel.operators.calendar import cohorts
    at = cohorts(sessions, length).select(F.col("date").alias("decision_date"), "cohort")
    clipped = F.greatest(F.least(F.col("excess"), F.lit(cap)), F.lit(-cap))
    out = (panel.join(at, "decision_date").groupBy("cohort")
           .agg(F.count(F.lit(1)).alias("n_rows"), F.avg(clipped).alias("clipped_excess"),
                F.max("terminal_date").alias("matured_at")).where(F.col("matured_at") <= F.to_date(F.lit(cutoff))))
    return out.withColumn("in_last_12", F.row_number().over(Window.orderBy(F.desc("cohort"))) <= keep)


def refit_events(schedule: DataFrame) -> DataFrame:
    w = Window.partitionBy("family_id").orderBy("activation_date")
    old = F.lag("model_id").over(w)
    return (schedule.withColumn("old_model", old).withColumn("new_model", F.col("model_id"))
            .withColumn("threshold_delta", F.col("threshold") - F.lag("threshold").over(w))
            .withColumn("interval_end", F.lead("activation_date").over(w))
            .withColumn("model_changed", F.coalesce(F.col("new_model") != F.col("old_model"), F.lit(False))))


def arm_schedules(generations: DataFrame, calibrations: DataFrame) -> DataFrame:
    """Three arms: frozen model and threshold; frozen model, rolling threshold; rolling both."""
    first = generations.groupBy("family_id").agg(
        F.min("activation_date").alias("activation_date"), F.min_by("model_id", "activation_date").alias("model_id"),
        F.min_by("threshold", "activation_date").alias("threshold"))
    cols = ["family_id", "arm", "model_id", "activation_date", "threshold"]
    a = first.withColumn("arm", F.lit("A_FROZEN")).select(cols)
    b = calibrations.join(first.select("family_id", "model_id"), "family_id").withColumn("arm", F.lit("B_RECALIBRATED"))
    c = generations.withColumn("arm", F.lit("C_REFIT"))
    return a.unionByName(b.select(cols)).unionByName(c.select(cols))


def trailing_window(days: DataFrame, cutoffs: DataFrame, cutoff: str, keys: list[str], window: int) -> DataFrame:
    """The latest ``window`` matured day rows before each cutoff; days hold one row per (keys, session).

    Terminals grow with decisions, so the matured days of a cutoff are a prefix: its length comes from
    an as-of lookup and the window from equal positions. ``_rn`` = 1 is the newest day.
    """
    placed = days.where("terminal_date IS NOT NULL").withColumn(
        "_pos", F.row_number().over(Window.partitionBy(*keys).orderBy("decision_date")))
    marks = placed.select(*keys, "terminal_date", F.col("_pos").alias("_last"))
    heads = asof_join(cutoffs.select(cutoff).distinct(), marks, [], cutoff, "terminal_date", how="inner", fan_out=keys)
    wanted = heads.select(cutoff, *keys, "_last", F.explode(F.sequence(
        F.greatest(F.lit(1), F.col("_last") - (window - 1)), F.col("_last"))).alias("_pos"))
    return wanted.join(placed, [*keys, "_pos"]).withColumn("_rn", F.col("_last") - F.col("_pos") + 1).drop("_last", "_pos")


def recalibrate(tops: DataFrame, cutoffs: DataFrame, window: int, quantile: float) -> DataFrame:
    """Threshold = quantile of the last ``window`` matured daily tops, per family and cutoff."""
    rows = trailing_window(tops, cutoffs, "cutoff", ["family_id"], window)
    return rows.groupBy("cutoff", "family_id").agg(
        F.expr(f"percentile(top, {quantile})").alias("threshold"), F.count(F.lit(1)).alias("window_days"),
        F.min("decision_date").alias("calibration_start"), F.max("decision_date").alias("calibration_end"),
        F.max("terminal_date").alias("latest_terminal"))


def gate_observation(quality: DataFrame, date: str, clip: float) -> DataFrame:
    """Equal-weight prior against value-weighted adaptive quality, scaled by MAD (then std, then 1).

    ``quality`` has one row per (date, family); families are bounded by the registry.
    """
    from chronopanel.functions.rounding import rnd
    center = quality.groupBy(date).agg(F.expr("percentile(quality, 0.5)").alias("center"), F.sum("weight").alias("_tw"))
    j = quality.join(center, date)
    s = j.groupBy(date).agg(
        F.first("center").alias("center"), (F.lit(1.4826) * F.expr("percentile(abs(quality - center), 0.5)")).alias("mad"),
        F.stddev_pop("quality").alias("sd"), F.avg("quality").alias("prior"),
        F.sum(F.col("quality") * F.col("weight") / F.col("_tw")).alias("adaptive"))
    scale = F.when(F.col("mad") > 1e-12, F.col("mad")).when(F.col("sd") > 1e-12, F.col("sd")).otherwise(1.0)
    z = F.greatest(F.least((F.col("adaptive") - F.col("prior")) / scale, F.lit(clip)), F.lit(-clip))
    return s.select(date, rnd("center").alias("quality_center"), rnd(scale).alias("quality_scale"),
                    rnd("prior").alias("prior_score"), rnd("adaptive").alias("adaptive_score"), rnd(z).alias("advantage_z"))


def visible_generations(schedule: DataFrame, times: DataFrame) -> DataFrame:
    """Per time and family: how many generations are visible, the latest one, and their joint identity."""
    ident = F.concat_ws(":", F.col("activation_date").cast("string"), "model_id")
    state = prefix_digests(schedule.select("family_id", "activation_date", ident.alias("generation")), ["family_id"], "activation_date", "generation")
    seen = asof_join(times, state, [], "t", "activation_date", how="inner", fan_out=["family_id"])
    return seen.select("t", "family_id", F.col("seen").alias("visible"), F.col("activation_date").alias("latest"), F.col("identity").alias("fingerprint"))


def next_unseen_fold(folds: DataFrame, keys: list[str], fold: str) -> DataFrame:
    """First fold after each as-of fold (one row per key and fold)."""
    w = Window.partitionBy(*keys).orderBy(fold)
    return folds.select(*keys, F.col(fold).alias("as_of"), F.lead(fold).over(w).alias("next_fold"),
                        F.lead("metric").over(w).alias("metric"))


def policies_as_of(schedule: DataFrame, times: DataFrame) -> DataFrame:
    """Initial-static, newest-visible and equal-pool model weights at each time.

    A model's share of the pool is its own count so far over the family's, both looked up as of the time.
    """
    w, own = Window.partitionBy("family_id").orderBy("activation_date"), Window.partitionBy("family_id", "model_id").orderBy("activation_date")
    state = schedule.select("family_id", "activation_date", F.col("model_id").alias("last_model"), F.first("model_id").over(w).alias("first_model"), F.count(F.lit(1)).over(w).alias("n"))
    seen = asof_join(times, state, [], "t", "activation_date", how="inner", fan_out=["family_id"])
    single = seen.select("t", "family_id", F.inline(F.array(
        F.struct(F.lit("INITIAL_STATIC").alias("policy"), F.col("first_model").alias("model_id"), F.lit(1.0).alias("weight")),
        F.struct(F.lit("NEWEST_VISIBLE").alias("policy"), F.col("last_model").alias("model_id"), F.lit(1.0).alias("weight")))))
    counts = schedule.select("family_id", "model_id", "activation_date", F.count(F.lit(1)).over(own).alias("k"))
    pool = asof_join(times, counts, [], "t", "activation_date", how="inner", fan_out=["family_id", "model_id"]).join(seen.select("t", "family_id", "n"), ["t", "family_id"])
    return single.unionByName(pool.select("t", "family_id", F.lit("EQUAL_POOL").alias("policy"), "model_id", (F.col("k") / F.col("n")).alias("weight")))


def evidence_growth(state: DataFrame, keys: list[str], order: str, folds: str) -> DataFrame:
    """Per assessment: new and lost folds against the previous one, and whether the set grew or shrank."""
    w = Window.partitionBy(*keys).orderBy(order)
    prev = F.lag(folds).over(w)
    return (state.withColumn("_prev", prev)
            .withColumn("added", F.size(F.array_except(folds, F.coalesce("_prev", F.array().cast(state.schema[folds].dataType)))))
            .withColumn("lost", F.coalesce(F.size(F.array_except("_prev", folds)), F.lit(0)))
            .withColumn("expanded", F.col("_prev").isNull() | (F.col("added") > 0)).drop("_prev"))


def refit_plan_arms(state: DataFrame) -> DataFrame:
    """Refit decisions per arm: first only, when the matured-fold set grew (``n_folds``, which never falls), every month."""
    w = Window.partitionBy("family_id").orderBy("assessment_date")
    grown = state.withColumn("expanded", F.coalesce(F.col("n_folds") > F.lag("n_folds").over(w), F.lit(True))).withColumn("_rn", F.row_number().over(w))
    arms = F.array(*[F.struct(F.lit(n).alias("arm"), c.alias("refit")) for n, c in (
        ("A_FIRST", F.col("_rn") == 1), ("F_FOLD", F.col("expanded")), ("M_MONTHLY", F.lit(True)))])
    rows = grown.select("family_id", "assessment_date", F.inline(arms))
    wa = Window.partitionBy("family_id", "arm").orderBy("assessment_date")
    fit = F.last(F.when(F.col("refit"), F.col("assessment_date")), ignorenulls=True).over(wa)
    return rows.withColumn("active_fit", fit)


def evidence_events(assessments: DataFrame, evidence: DataFrame) -> DataFrame:
    """Assessments on which the visible evidence set grew, with the identity of that set."""
    ev = evidence.select("family_id", "matured_at").distinct()
    both = (assessments.withColumn("matured_at", F.lit(None).cast("date"))
            .unionByName(ev.select("family_id", F.col("matured_at").alias("assessment_date"), "matured_at")))
    grid = both.groupBy("family_id", "assessment_date").agg(F.max("matured_at").alias("matured_at"))
    seen = prefix_digests(grid, ["family_id"], "assessment_date", "matured_at").select("family_id", "assessment_date", "members", "identity")
    w = Window.partitionBy("family_id").orderBy("assessment_date")
    known = assessments.join(seen, ["family_id", "assessment_date"])
    return (known.withColumn("new_evidence", F.col("members") - F.coalesce(F.lag("members").over(w), F.lit(0))).where("new_evidence > 0")
            .select("family_id", "assessment_date", "identity", "new_evidence"))


def visibility_snapshots(schedule: DataFrame, incumbent: str) -> DataFrame:
    """Ids visible at each quarter start, their fingerprint, and whether the incumbent is among them."""
    q = schedule.select("family_id", F.trunc("activation_date", "quarter").alias("t")).distinct()
    w = Window.partitionBy("family_id").orderBy("activation_date")
    state = prefix_digests(schedule.select("family_id", "activation_date", "model_id"), ["family_id"], "activation_date", "model_id")
    state = state.withColumn("held", F.bool_or(F.col("model_id") == incumbent).over(w)).drop("model_id")
    seen = asof_join(q, state, ["family_id"], "t", "activation_date")
    return seen.select("family_id", "t", F.coalesce("seen", F.lit(0)).alias("visible"), F.coalesce("members", F.lit(0)).alias("visible_models"),
                       F.coalesce("identity", digest([F.lit(0)] * LIMBS)).alias("fingerprint"), F.coalesce("held", F.lit(False)).alias("incumbent_visible"))


def recipe_assessments(folds: DataFrame, times: DataFrame) -> DataFrame:
    """Winner by robust score over the folds visible at each assessment; a candidate has one fold per availability date."""
    from chronopanel.functions.rounding import rnd
    state = running_robust_score(folds.select("candidate_id", "available_at", "metric"), ["candidate_id"], "available_at", "metric")
    state = state.select("candidate_id", "available_at", F.col("n").alias("fold_count"), rnd("robust").alias("robust_score"))
    scored = asof_join(times, state, [], "t", "available_at", how="inner", fan_out=["candidate_id"])
    best = Window.partitionBy("t").orderBy(F.desc("robust_score"), "candidate_id")
    return (scored.withColumn("_rn", F.row_number().over(best)).where("_rn = 1")
            .select("t", F.col("candidate_id").alias("winner"), "fold_count", "robust_score"))


def fold_segments(folds: DataFrame, known_start: str, known_end: str) -> DataFrame:
    a, b = F.to_date(F.lit(known_start)), F.to_date(F.lit(known_end))
    s, e = F.col("start_date"), F.col("end_date")
    return folds.withColumn("segment", F.when(e < a, "BACKWARD").when(s > b, "FORWARD")
                            .when((s >= a) & (e <= b), "KNOWN").otherwise("STRADDLES"))
