"""Draws, which Spark sizes like the keys they come from, are not broadcast; the series may be."""

import re

import pytest
from pyspark.sql import functions as F

from chronopanel.operators import resample as rs


@pytest.mark.parametrize("sample", [lambda s: rs.iid_samples(s, ["k"], ["v"], reps=30, seed=41), lambda s: rs.block_samples(s, ["k"], ["v"], block=5, reps=30, seed=17),
                                    lambda s: rs.block_samples(s, ["k"], ["v"], block=5, reps=30, seed=17, whole=True)], ids=["iid", "block", "whole"])
def test_only_the_series_is_broadcast(spark, tmp_path, sample):
    rows = spark.range(2_000).select(F.when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("string")).alias("k"), F.floor(F.col("id") / 3).alias("pos"), F.col("id").cast("double").alias("v"))
    rows.write.parquet(f"{tmp_path}/series")                # a written table, as queries have it
    series = spark.read.parquet(f"{tmp_path}/series")
    drawn = sample(series)
    n = {r.k: r["count"] for r in series.where("k IS NOT NULL").groupBy("k").count().collect()}
    got = drawn.groupBy("k").agg(F.count("v").alias("values"), F.count("*").alias("rows")).collect()
    assert {r.k for r in got} == set(n)                      # a NULL key meets nothing
    assert all(r["values"] == r["rows"] and 30 * n[r.k] <= r["rows"] < 30 * (n[r.k] + 5) for r in got)
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert all("BuildRight" in x for x in re.findall(r"BroadcastHashJoin.*", plan)) and "LeftOuter" in plan
