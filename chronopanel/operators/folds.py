"""State carried along a calendar: closed forms as windows, the rest as an aggregate over a calendar-length array.

Series here are at calendar grain (one row per key and assessment, month or session), so a key's array is as long as
the calendar whatever the raw data holds. ``keyed_fold`` is the documented Python fallback for raw rows without an
expression: it streams sorted rows and gathers no group.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Step = Callable[[dict | None, dict], tuple[dict, dict]]


def keyed_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], step: Step, schema: str) -> DataFrame:
    """Run ``step(state, row) -> (state, output)`` over each key's rows in order.

    ``schema`` names the output columns: keys first, then what ``step`` emits.
    """
    keys = list(keys)
    names = [f.strip().split(" ")[0] for f in schema.split(",")]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                key = tuple(None if pd.isna(row[k]) else row[k] for k in keys)      # a NULL number arrives as NaN
                if key != current:
                    current, state = key, None
                state, emitted = step(state, row)
                out.append({**{k: row[k] for k in keys}, **emitted})
            yield pd.DataFrame(out, columns=names)

    ordered = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return ordered.mapInPandas(walk, schema)


#: States gathered before they join the finished ones, so that adding one never copies a whole series.
CHUNK = 64


def carried(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], state: str, start: Column, step: Callable[[Column, Column], Column]) -> DataFrame:
    """Keys, ``order`` and the state after every row. ``step(state, row)`` gives the next state; ``state`` is its DDL type."""
    rows = F.array_sort(F.collect_list(F.struct(order, *values)), lambda a, b: F.when(a[order] < b[order], -1).when(a[order] > b[order], 1).otherwise(0))

    def move(seen, row):
        after = step(F.element_at(seen["now"], -1), row).cast(state)
        full = F.size(seen["now"]) >= CHUNK
        return F.struct(F.when(full, F.array_append(seen["done"], seen["now"])).otherwise(seen["done"]).alias("done"), F.when(full, F.array(after)).otherwise(F.array_append(seen["now"], after)).alias("now"))

    none = F.struct(F.array().cast(f"array<array<{state}>>").alias("done"), F.array(start.cast(state)).alias("now"))
    walked = df.groupBy(*keys).agg(rows.alias("_rows")).select(*keys, "_rows", F.aggregate("_rows", none, move, lambda seen: F.flatten(F.array_append(seen["done"], seen["now"]))).alias("_seen"))
    after = F.arrays_zip(F.col(f"_rows.{order}").alias(order), F.slice("_seen", 2, F.size("_rows")).alias("_s"))
    return walked.select(*keys, F.inline(after)).select(*keys, order, "_s.*")


#: Rows of a block of a decayed sum; a strong decay has shorter ones, so that ratio ** -t stays under e ** 300.
BLOCK = 1_000


def decayed_sum(df: DataFrame, keys: Sequence[str], order: str, value: Column, ratio: float, name: str) -> DataFrame:
    """Adds s(t) = value(t) + ratio * s(t - 1), for series of any length.

    A segmented scan: a block of rows (of one year, where ``order`` is a date) is one running sum of values scaled by
    ratio ** -t, so a long series spreads over tasks; a block acts on what came before as one affine map, and the maps, one
    row a block, are folded along the series and joined back.
    """
    if ratio <= 0:
        return df.withColumn(name, value)
    keys, size = list(keys), BLOCK if ratio >= 1 else max(1, min(BLOCK, int(300 / -math.log(ratio))))
    slot = F.trunc(order, "year") if dict(df.dtypes)[order] in ("date", "timestamp", "timestamp_ntz") else F.lit(0)
    x = df.withColumn("_slot", slot)
    x = x.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_slot").orderBy(order)) - 1)
    x = x.withColumn("_b", F.struct("_slot", F.floor(F.col("_n") / size).alias("part"))).withColumn("_k", F.col("_n") % size + 1)
    x = x.withColumn("_s", F.pow(F.lit(ratio), "_k") * F.sum(value * F.pow(F.lit(ratio), -F.col("_k"))).over(Window.partitionBy(*keys, "_b").orderBy("_k"))).drop("_slot", "_n")
    plus = lambda here, before, decay: F.when(before.isNull(), here).otherwise(F.coalesce(here, F.lit(0.0)) + decay * before)      # nothing but NULL so far stays NULL
    ends = x.groupBy(*keys, "_b").agg(F.max_by("_s", "_k").cast("double").alias("_end"), F.max("_k").alias("_len"))
    left = carried(ends, keys, "_b", ["_end", "_len"], "struct<carry:double>", F.struct(F.lit(None).alias("carry")), lambda s, e: F.struct(plus(e["_end"], s["carry"], F.pow(F.lit(ratio), e["_len"])).alias("carry")))
    left = left.withColumn("_carry", F.lag("carry").over(Window.partitionBy(*keys).orderBy("_b"))).select(*[F.col(k).alias(f"_r_{k}") for k in keys], F.col("_b").alias("_rb"), "_carry")
    same = F.col("_b") == F.col("_rb")
    for k in keys:
        same = same & x[k].eqNullSafe(F.col(f"_r_{k}"))
    return x.join(left, same).withColumn(name, plus(F.col("_s"), F.col("_carry"), F.pow(F.lit(ratio), "_k"))).drop("_b", "_k", "_s", "_rb", "_carry", *[f"_r_{k}" for k in keys])


def ewma(df: DataFrame, keys: Sequence[str], order: str, value: str, span: int) -> DataFrame:
    """Recursive mean with alpha = 2 / (span + 1), seeded by the first value."""
    alpha = 2.0 / (span + 1)
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) == 1
    x = df.select(*keys, order, F.when(first, F.col(value)).otherwise(F.col(value) * alpha).alias("_v"))
    return decayed_sum(x, keys, order, F.col("_v"), 1 - alpha, "ewma").drop("_v")


#: Fixed values of the detector, the bound and the posterior.
DECAY, HAZARD, LEAST_MEMORY, Z95 = 0.9, 0.02, 0.25, 1.96


def change_detector(df: DataFrame, keys: Sequence[str], order: str, value: str, scale: float) -> DataFrame:
    """Change probability, expected run length and forgetting multiplier per row.

    The mean before a row is a decayed sum of earlier values. The probability is hazard + (1 - hazard) * (decayed
    probability + share of surprise), which never passes 1, so it is a decayed sum too.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    mean = decayed_sum(df, keys, order, F.col(value) * (1 - DECAY), DECAY, "_mean")
    surprise = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.coalesce(F.lag("_mean").over(w), F.lit(0.0)) - F.col(value)) / scale))
    x = mean.withColumn("_push", HAZARD + (1 - HAZARD) * (1 - DECAY) * surprise)
    p = F.col("probability")
    return decayed_sum(x, keys, order, F.col("_push"), (1 - HAZARD) * DECAY, "probability").drop("_mean", "_push").withColumns(
        {"run_length": 1 / (HAZARD + 0.1 * p), "forgetting": F.greatest(F.lit(LEAST_MEMORY), 1 - p)})


def activity_posterior(df: DataFrame, keys: Sequence[str], order: str, eligible: Column, traded: Column) -> DataFrame:
    """Counts of entries and opportunities so far, opportunities since the last entry, and the chance of none."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    hit = eligible & traded
    x = df.withColumn("_seen", F.count_if(eligible).over(w)).withColumn("a", 1.0 + F.count_if(hit).over(w)).withColumn("b", 1.0 + F.col("_seen"))
    x = x.withColumn("streak", F.col("_seen") - F.coalesce(F.max(F.when(hit, F.col("_seen"))).over(w), F.lit(0)))
    return x.drop("_seen").withColumn("p_zero", F.pow(F.col("b") / (F.col("b") + F.col("streak")), F.col("a")))


def discounted_alpha(df: DataFrame, keys: Sequence[str], order: str, value: str, discount: float = 0.97) -> DataFrame:
    """Discounted mean, plain running mean, count and the lower bound from the mean's last move."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    x = decayed_sum(df, keys, order, F.col(value) * (1 - discount), discount, "discounted")
    x = x.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("mean", F.avg(value).over(w))
    before = F.coalesce(F.lag("mean").over(Window.partitionBy(*keys).orderBy(order)), F.col(value))
    move = (F.col("n") - 1) * (F.col("_before") - F.col("mean")) ** 2 + (F.col(value) - F.col("mean")) ** 2
    return x.withColumn("_before", before).withColumn("lcb", F.col("mean") - Z95 * F.sqrt(move / F.greatest(F.lit(1), F.col("n") - 1) / F.col("n"))).drop("_before")


def forgetful_alpha(df: DataFrame, keys: Sequence[str], order: str, value: str, scale: float, discount: float = 0.97) -> DataFrame:
    """Discounted mean whose memory shortens after a change: each row uses the forgetting known before it."""
    seen = change_detector(df, keys, order, value, scale)
    memory = discount * F.coalesce(F.lag("forgetting").over(Window.partitionBy(*keys).orderBy(order)), F.lit(1.0))
    rows = seen.withColumn("_memory", memory)
    step = lambda s, x: F.struct((s["discounted"] * x["_memory"] + x[value] * (1 - x["_memory"])).alias("discounted"), (s["n"] + 1).alias("n"))
    out = carried(rows, keys, order, [value, "_memory"], "struct<discounted:double,n:long>", F.struct(F.lit(0.0).alias("discounted"), F.lit(0).alias("n")), step)
    return out.withColumn("uncertainty", 1 / F.sqrt("n"))


#: Fixed states. (state, event) -> state; an event is (statistical kill?, candidate?, bound above the margin?), a pair that is not listed keeps its state.
LIFECYCLE = {
    ("SHADOW", "candidate"): "CANDIDATE", ("SHADOW", "strong"): "CANDIDATE", ("SUSPENDED", "candidate"): "CANDIDATE", ("SUSPENDED", "strong"): "CANDIDATE",
    ("SHADOW", "kill candidate"): "CANDIDATE", ("SHADOW", "kill strong"): "CANDIDATE", ("SUSPENDED", "kill candidate"): "CANDIDATE", ("SUSPENDED", "kill strong"): "CANDIDATE",
    ("CANDIDATE", "strong"): "CHAMPION", ("CANDIDATE", "kill strong"): "CHAMPION", ("CHAMPION", "none"): "PROBATION", ("ENSEMBLE", "none"): "PROBATION",
    **{(s, f"kill {e}"): "PROBATION" for s in ("CHAMPION", "ENSEMBLE") for e in ("none", "candidate", "strong")},
    **{("PROBATION", f"kill {e}"): "SUSPENDED" for e in ("none", "candidate", "strong")},
    **{(s, "structural"): "SUSPENDED" for s in ("SHADOW", "CANDIDATE", "CHAMPION", "ENSEMBLE", "PROBATION", "SUSPENDED")},
}


def lifecycle(df: DataFrame, keys: Sequence[str], order: str, structural: Column, statistical: Column, candidate: Column, bound: Column, margin: float = 0.0, start: Column | None = None) -> DataFrame:
    """State and rows in it, by the declared table of transitions. A key starts in SHADOW, or in the state that ``start`` names on its rows."""
    kind = F.when(candidate & (bound > margin), "strong").when(candidate, "candidate").otherwise("none")
    event = F.when(structural, F.lit("structural")).when(statistical, F.concat(F.lit("kill "), kind)).otherwise(kind)
    table = F.create_map(*(F.lit(x) for (s, e), to in LIFECYCLE.items() for x in (f"{s}|{e}", to)))
    before = lambda s, x: F.coalesce(s["state"], x["_start"], F.lit("SHADOW"))
    step = lambda s, x: F.struct(F.coalesce(F.element_at(table, F.concat_ws("|", before(s, x), x["_event"])), before(s, x)).alias("state"))
    rows = df.withColumn("_event", event).withColumn("_start", F.lit(None).cast("string") if start is None else start)
    out = carried(rows, keys, order, ["_event", "_start"], "struct<state:string>", F.struct(F.lit(None).alias("state")), step)
    w = Window.partitionBy(*keys).orderBy(order)
    spell = out.withColumn("_new", F.coalesce((F.lag("state").over(w) != F.col("state")).cast("int"), F.lit(0))).withColumn("_spell", F.sum("_new").over(w))
    return spell.withColumn("sessions_in_state", (F.row_number().over(Window.partitionBy(*keys, "_spell").orderBy(order)) - 1).cast("long")).drop("_new", "_spell")


def blend_weight(df: DataFrame, keys: Sequence[str], order: str, target: Column, ready: Column, limit: float) -> DataFrame:
    """Weight that follows ``target`` (clipped to 0..1) by at most ``limit`` a row once ``ready``."""
    rows = df.select(*keys, order, F.when(ready, F.least(F.lit(1.0), F.greatest(F.lit(0.0), target))).alias("_goal"))
    move = lambda s, x: F.when(x["_goal"].isNull(), 0.0).otherwise(F.least(F.lit(limit), F.greatest(F.lit(-limit), x["_goal"] - s["lam"])))
    step = lambda s, x: F.struct((s["lam"] + move(s, x)).alias("lam"), (F.abs(move(s, x)) > 1e-15).alias("updated"))
    return carried(rows, keys, order, ["_goal"], "struct<lam:double,updated:boolean>", F.struct(F.lit(0.0).alias("lam"), F.lit(False).alias("updated")), step)


#: Reason codes and errors of recipe decisions.
INITIAL, RECONFIRMED, NO_IMPROVEMENT = "INITIAL_CAUSAL_RECIPE", "INCUMBENT_RECONFIRMED", "NO_STRICT_ROBUST_SCORE_IMPROVEMENT"
SWITCHED, PENDING = "HYSTERESIS_SWITCH_CONFIRMED", "CHALLENGER_CONFIRMATION_PENDING"
DUPLICATE, NOTHING_NEW = "DUPLICATE_MATURED_EVIDENCE_IGNORED", "NO_NEW_RECIPE_EVIDENCE"
BACKWARDS, CHANGED = "HYSTERESIS_NON_MONOTONIC_MATURED_EVIDENCE", "HYSTERESIS_SAME_DATE_EVIDENCE_CHANGED"
WINNER_MISSING, WINNER_SHORT = "HYSTERESIS_WINNER_NOT_IN_ELIGIBLE_CHOICES", "HYSTERESIS_WINNER_INSUFFICIENT_OOS_FOLDS"
INCUMBENT_MISSING, INCUMBENT_SHORT = "HYSTERESIS_INCUMBENT_MISSING_FROM_CAUSAL_CHOICES", "HYSTERESIS_INCUMBENT_INSUFFICIENT_OOS_FOLDS"


def recipe_hysteresis(df: DataFrame, keys: Sequence[str], order: str = "assessment_date", confirmations: int = 2, least_folds: int = 0) -> DataFrame:
    """Incumbent and challenger per assessment; only expansions of the evidence can confirm a challenger.

    Rows: assessment_date, evidence_date, fingerprint, winner, scores (map of candidate to robust score) and, with
    ``least_folds``, folds (map of candidate to fold count). An expansion is the first row of a fingerprint; later rows of it
    repeat the decision. Dates that go back, a new fingerprint on a date already used, and a winner or incumbent without
    a score or with too few folds fail the query.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    x = df.withColumn("_new", F.coalesce(F.lag("fingerprint").over(w) != F.col("fingerprint"), F.lit(True)).cast("int")).withColumn("_era", F.sum("_new").over(w))
    x = x.withColumn("_used", F.first("evidence_date").over(Window.partitionBy(*keys, "_era").orderBy(order)))
    fail = lambda name: F.raise_error(F.lit(name)).cast("long")
    short = lambda r, c: (F.coalesce(F.element_at(r["folds"], c), F.lit(0)) < least_folds) if least_folds else F.lit(False)
    missing = lambda r, c: F.element_at(r["scores"], c).isNull()
    row = {c: F.col(c) for c in ("scores", *(["folds"] if least_folds else []))}
    checked = (F.when(missing(row, F.col("winner")), fail(WINNER_MISSING)).when(short(row, F.col("winner")), fail(WINNER_SHORT)).when(F.col("evidence_date") < F.col("_last"), fail(BACKWARDS))
               .when((F.col("_new") == 1) & (F.col("evidence_date") == F.col("_last")), fail(CHANGED)))
    last = F.max("evidence_date").over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("_last", last).withColumn("_era", F.coalesce(checked, F.col("_era")))
    held = lambda r, c, then: F.when(missing(r, c), fail(INCUMBENT_MISSING)).when(short(r, c), fail(INCUMBENT_SHORT)).otherwise(then)

    def step(s, r):
        inc = s["incumbent_after"]
        streak = F.when(s["waiting"] == r["winner"], s["streak"] + 1).otherwise(F.lit(1))
        wins = held(r, inc, (F.element_at(r["scores"], r["winner"]) > F.element_at(r["scores"], inc)).cast("long")) == 1
        reason = (F.when(inc.isNull(), INITIAL).when((r["winner"] == inc) & ~wins, RECONFIRMED).when(~wins, NO_IMPROVEMENT).when(streak >= confirmations, SWITCHED).otherwise(PENDING))
        quiet, counted = reason.isin(INITIAL, RECONFIRMED), reason.isin(SWITCHED, PENDING)
        return F.struct(inc.alias("incumbent_before"), F.when(reason.isin(INITIAL, SWITCHED), r["winner"]).otherwise(inc).alias("incumbent_after"),
                        F.when(~quiet, r["winner"]).alias("challenger"), F.when(counted, streak).otherwise(F.lit(0)).alias("confirmations"),
                        F.when(reason == PENDING, r["winner"]).alias("waiting"), F.when(reason == PENDING, streak).otherwise(F.lit(0)).alias("streak"), reason.alias("reason"))

    kind = "struct<incumbent_before:string,incumbent_after:string,challenger:string,confirmations:long,waiting:string,streak:long,reason:string>"
    none = F.struct(*(F.lit(None).alias(c) for c in ("incumbent_before", "incumbent_after", "challenger")), F.lit(0).alias("confirmations"), F.lit(None).alias("waiting"), F.lit(0).alias("streak"), F.lit(None).alias("reason"))
    decided = carried(x.where("_new = 1"), keys, "_era", ["winner", *row], kind, none, step)
    again = F.when(F.col("evidence_date") == F.col("_used"), DUPLICATE).otherwise(NOTHING_NEW)
    fresh = F.col("_new") == 1
    kept = F.when(held(row, F.col("incumbent_after"), F.lit(1)) == 1, F.col("incumbent_after"))          # later rows of a fingerprint need its score too
    return x.join(decided, [*keys, "_era"]).select(
        *keys, order, F.when(fresh, F.col("incumbent_before")).otherwise(kept).alias("incumbent_before"), "incumbent_after",
        F.when(fresh, F.col("challenger")).otherwise(F.col("waiting")).alias("challenger"), F.when(fresh, F.col("confirmations")).otherwise(F.col("streak")).alias("confirmations"),
        F.when(fresh, F.col("reason")).otherwise(again).alias("reason"))


def kept_incumbent(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The incumbent while it is in the ``top`` set, else the ``winner`` of the row."""
    step = lambda s, x: F.struct(F.when(F.array_contains(x["top"], s["incumbent"]), s["incumbent"]).otherwise(x["winner"]).alias("incumbent"))
    return carried(df, keys, order, ["winner", "top"], "struct<incumbent:string>", F.struct(F.lit(None).alias("incumbent")), step)


def buffered_picks(df: DataFrame, keys: Sequence[str], order: str, size: int) -> DataFrame:
    """Names held while they stay in ``ranked`` (already cut at the buffer rank), filled up from the best ranked."""
    def step(s, x):
        kept = F.filter(s["names"], lambda n: F.array_contains(x["ranked"], n))
        return F.struct(F.slice(F.concat(kept, F.array_except(x["ranked"], kept)), 1, size).alias("names"), F.size(kept).alias("kept"))

    out = carried(df, keys, order, ["ranked"], f"struct<names:{dict(df.dtypes)['ranked']},kept:long>", F.struct(F.array().alias("names"), F.lit(0).alias("kept")), step)
    return out.select(*keys, order, F.array_join(F.array_sort("names"), ",").alias("held"), "kept")


def champion_spells(log: DataFrame, keys: Sequence[str], order: str, champion: str, fallback: str) -> DataFrame:
    """Switches, fallback rows and spell lengths of a decision log; pure windows."""
    w = Window.partitionBy(*keys).orderBy(order)
    prev = F.lag(champion).over(w)
    x = log.withColumn("_sw", F.coalesce((prev != F.col(champion)).cast("int"), F.lit(0))).withColumn("_spell", F.sum("_sw").over(w))
    spell = x.groupBy(*keys, "_spell").agg(F.count(F.lit(1)).alias("len"), F.sum((F.col(champion) == fallback).cast("int")).alias("fb"))
    return spell.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("switches"), F.sum("fb").alias("fallback_rows"), F.avg("len").alias("mean_duration"),
                                    F.max("len").alias("longest"))


def paired_edge(pairs: DataFrame, keys: Sequence[str], a: str, b: str, cost: float) -> DataFrame:
    """Mean challenger edge after switch cost with its 95% lower bound."""
    d = F.col(a) - F.col(b) - cost
    g = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("observations"), F.avg(d).alias("mean_edge"), F.stddev_samp(d).alias("_sd"))
    se = F.coalesce("_sd", F.lit(0.0)) / F.sqrt(F.col("observations").cast("double"))
    return g.withColumn("standard_error", se).withColumn("lcb", F.col("mean_edge") - 1.96 * F.col("standard_error")).drop("_sd")
