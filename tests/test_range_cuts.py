"""Ranges of a group's values: cuts meet the values without moving them, and each value finds its range by halving."""

import numpy as np
from pyspark.sql import functions as F

from chronopanel.operators import ordered as od


def test_cuts_are_sent_to_the_values(spark, monkeypatch):
    monkeypatch.setattr(od, "RANGE_ROWS", 40)
    df = spark.range(0, 3000, 1, 8).select((F.col("id") % 2).alias("g"), (F.pmod(F.xxhash64("id"), F.lit(700)) / 7).alias("v")).union(spark.range(5).selectExpr("2L", "double(id)"))
    counts = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    marked = od.with_range(counts, ["g"], "v")
    plan = marked._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan and "size(filter(" not in plan
    rows = marked.collect()
    assert len(rows) == counts.count() and {r._range for r in rows if r.g == 2} == {0}
    for g in (0, 1):
        got = sorted((r.v, r._range) for r in rows if r.g == g)
        assert [k for _, k in got] == sorted(k for _, k in got) and len({k for _, k in got}) > 8
    table = {(r.g, r.v): r.below for r in od.value_counts(df, ["g"], "v").collect()}
    for g in (0, 1, 2):
        v = np.array([r.v for r in df.where(F.col("g") == g).collect()])
        assert all(table[g, x] == (v < x).sum() for x in set(v.tolist()))
