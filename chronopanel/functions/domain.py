"""Domain scalar columns: labels, costs, tax, annualisation, verdicts, identities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS_PER_YEAR = 365.2425


def guarded_ratio(a: Column, b: Column, eps: float = 1e-15) -> Column:
    """a / b, NULL when b is (nearly) zero."""
    return F.when(F.abs(b) > eps, F.try_divide(a, b))


def annualized(initial: Column, terminal: Column, days: Column) -> Column:
    """CAGR with a one-day floor on years (365.25 days); -1 for a non-positive start or end."""
    years = F.greatest(days / 365.25, F.lit(1 / 365.25))
    return F.when((initial > 0) & (terminal > 0), F.pow(F.try_divide(terminal, initial), 1 / years) - 1).otherwise(-1.0)


def expense_multiplier(days: Column, ratio: float, embedded: Column) -> Column:
    """(1 - ratio)^(days / 365.2425), applied once and only when expenses are not embedded in the series."""
    return F.when(embedded | (days == 0), 1.0).otherwise(F.pow(F.lit(1.0 - ratio), days / DAYS_PER_YEAR))


def benchmark_tax(initial: Column, terminal: Column, allowance: float, rate: float, surcharge: float, church: float) -> Column:
    gain = F.greatest(F.lit(0.0), terminal - initial - allowance)
    return gain * rate * (1.0 + surcharge + church)


def deflated_sharpe(sharpe: Column, attempts: Column, n: Column) -> Column:
    penalty = F.sqrt(2.0 * F.log(F.greatest(F.lit(1), attempts).cast("double"))) / F.sqrt(F.greatest(F.lit(1.0), n.cast("double")))
    return sharpe - penalty


def zero_probability(a: Column, b: Column, exposure: Column) -> Column:
    """Chance of no activity over ``exposure`` under a gamma(a, b) rate."""
    return F.pow(b / (b + F.greatest(F.lit(0.0), exposure)), a)


def activity_level(p: Column, watch: float = 0.25, anomalous: float = 0.05, critical: float = 0.01) -> Column:
    return (F.when(p >= watch, "NORMAL").when(p >= anomalous, "WATCH").when(p >= critical, "ANOMALOUS").otherwise("CRITICAL"))


def shrink(local: Column, whole: Column, n: Column, k: float) -> Column:
    rho = F.when(local.isNotNull(), n / (n + k)).otherwise(0.0)
    return rho * F.coalesce(local, F.lit(0.0)) + (1.0 - rho) * whole


def stability_class(known: Column, back: Column, forward: Column, back_active: Column, forward_active: Column) -> Column:
    worst = F.least(F.try_divide(back, known), F.try_divide(forward, known))
    both = (back > 0) & (forward > 0)
    return (F.when(known <= 0, "UNCLASSIFIED").when((back_active == 0) | (forward_active == 0), "NO_ACTIVITY")
            .when(both & (worst >= 0.5), "STABLE").when(both & (worst >= 0.25), "DECAY").otherwise("COLLAPSE"))


def pareto(ra: Column, rb: Column, ka: Column, kb: Column, tol: float = 1e-9) -> Column:
    """B against A on return and risk (both higher is better): equal on both, better on both, worse on both, or mixed."""
    same = (F.abs(rb - ra) <= tol) & (F.abs(kb - ka) <= tol)
    return F.when(same, "MATCH").when((rb > ra) & (kb > ka), "IMPROVES").when((rb < ra) & (kb < ka), "WORSENS").otherwise("TRADEOFF")


def event_diagnosis(dr: Column, dk: Column) -> Column:
    """Four classes from the signs of the return and risk deltas (risk: zero counts as helpful)."""
    return (F.when((dr > 0) & (dk >= 0), "RETURN_AND_RISK_HELPFUL").when(dr > 0, "RETURN_HELPFUL_RISK_WORSE")
            .when(dk >= 0, "RETURN_WORSE_RISK_HELPFUL").otherwise("RETURN_AND_RISK_HARMFUL"))


def bucket_combination(columns: dict[str, Column]) -> Column:
    """Names of the present buckets in fixed order, joined by underscores."""
    return F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in columns.items()])), "_")


def set_type(n: Column) -> Column:
    return F.when(n == 1, "S1_SINGLE_BUCKET").when(n == 2, "S2_TWO_BUCKETS").otherwise("S3_THREE_BUCKETS")


def sign_agreement(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), (F.signum(a) == F.signum(b)).cast("double"))


def nan_std(values: Sequence[Column]) -> Column:
    """Sample std over the non-NULL values of a row; NULL below two values."""
    arr = F.array_compact(F.array(*values))
    n = F.size(arr)
    mean = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x) / F.nullif(n, F.lit(0))
    ss = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean))
    return F.when(n >= 2, F.sqrt(ss / F.nullif(n - 1, F.lit(0))))


def row_slope(points: dict[float, Column]) -> Column:
    """Least-squares slope of present values over fixed centres; NULL below two points."""
    pairs = F.filter(F.array(*[F.struct(F.lit(float(x)).alias("x"), y.alias("y")) for x, y in points.items()]), lambda p: p["y"].isNotNull())
    n = F.size(pairs).cast("double")
    total = lambda f: F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + f(p))
    sx, sy = total(lambda p: p["x"]), total(lambda p: p["y"])
    sxy, sxx = total(lambda p: p["x"] * p["y"]), total(lambda p: p["x"] * p["x"])
    return F.when(n >= 2, (n * sxy - sx * sy) / F.nullif(n * sxx - sx * sx, F.lit(0.0)))


def canonical_identity(columns: dict[str, Column], length: int = 64) -> Column:
    """SHA-256 over canonical JSON (sorted names, string values)."""
    fields = [columns[k].cast("string").alias(k) for k in sorted(columns)]
    return F.substring(F.sha2(F.to_json(F.struct(*fields)), 256), 1, length)


def treatment_spec(raw: Column) -> Column:
    """Parse FAMILY[:strength] into (family, strength); unknown text yields NULL."""
    text = F.upper(F.trim(raw))
    pattern = r"^(EQUAL_ACTIVE|RANK_POWER|SCORE_EXCESS_POWER|SCORE_SOFTMAX)(?::([0-9.]+))?$"
    fam = F.regexp_extract(text, pattern, 1)
    strength = F.nullif(F.regexp_extract(text, pattern, 2), F.lit("")).try_cast("double")
    ok = (fam != "") & F.when(fam == "EQUAL_ACTIVE", strength.isNull()).otherwise(F.coalesce(strength > 0, F.lit(False)))
    return F.when(ok, F.struct(fam.alias("family"), strength.alias("strength")))
