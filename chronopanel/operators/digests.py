"""Identity and membership of growing sets, without the sets.

A set is told by the sum of its members' hashes: ``LIMBS`` numbers of 60 bits from each member's SHA-256, added apart modulo 2 ** 60 and
hashed once more. Adding a member is one addition, so a running sum gives the identity of every prefix from one row per
member; equal sets have equal digests whatever the order of arrival. A member that comes again counts once: only its
first row adds. Who is in a set at a time follows from the members' first dates.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.operators.wealth import OrderStatistics

LIMBS, MODULUS = 4, 1 << 60


def limbs(member: Column) -> list[Column]:
    """The numbers that a member adds."""
    h = F.sha2(member.cast("string"), 256)
    return [F.conv(F.substring(h, 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)") for k in range(LIMBS)]


def digest(sums: Sequence[Column]) -> Column:
    """Identity of the set whose members' limbs add up to ``sums``; an empty set's sums are NULL or 0."""
    rest = [F.coalesce(s, F.lit(0)).cast("decimal(38,0)") % F.lit(MODULUS).cast("decimal(38,0)") for s in sums]
    return F.sha2(F.concat_ws(":", *[r.cast("decimal(20,0)").cast("string") for r in rest]), 256)


def digest_sql(member: str) -> str:
    """SQL twin of ``digest`` as an aggregate over distinct members (NULL adds nothing)."""
    return "sha256(" + " || ':' || ".join(f"CAST(coalesce(sum(('0x' || substr(sha256({member}), {1 + 15 * k}, 15))::BIGINT), 0) % {MODULUS} AS VARCHAR)" for k in range(LIMBS)) + ")"


def prefix_digests(df: DataFrame, keys: Sequence[str], order: str, member: str) -> DataFrame:
    """Adds ``seen`` (rows so far), ``members`` (distinct ones) and ``identity`` of the members up to each row, ties by ``order`` together."""
    first = F.row_number().over(Window.partitionBy(*keys, member).orderBy(order)) == 1
    w = Window.partitionBy(*keys).orderBy(order)
    x = df.withColumn("_first", first & F.col(member).isNotNull())
    sums = [F.sum(F.when(F.col("_first"), part)).over(w) for part in limbs(F.col(member))]
    return x.withColumns({"seen": F.count(F.lit(1)).over(w), "members": F.count(F.when(F.col("_first"), 1)).over(w), "identity": digest(sums)}).drop("_first")


def running_median(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str = "median") -> DataFrame:
    """Adds the median of ``value`` up to each row, by one sweep over an order-statistic tree per series (calendar-long)."""
    keys = list(keys)

    def sweep(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        tree = OrderStatistics(table.column(value).cast(pa.float64()).to_numpy())
        out = []
        for k in range(len(tree.values)):
            if not np.isnan(tree.values[k]):
                tree.add(k)
            out.append((tree.smallest((tree.size + 1) // 2)[1] + tree.smallest(tree.size // 2 + 1)[1]) / 2 if tree.size else None)
        return table.append_column(name, pa.array(out, pa.float64()))

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]
    return df.groupBy(*keys).applyInArrow(sweep, ", ".join([*fields, f"{name} double"]))


def running_robust_score(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Adds ``n``, ``median`` and ``robust`` of the values up to each row; ``order`` is unique within ``keys``."""
    w = Window.partitionBy(*keys).orderBy(order)
    v = F.col(value)
    robust = F.col("median") + 0.5 * F.avg(v).over(w) - 0.5 * F.stddev_pop(v).over(w) - 0.02 * F.avg((v <= 0).cast("int")).over(w)
    return running_median(df, keys, order, value).withColumns({"n": F.count(F.lit(1)).over(w), "robust": robust})
