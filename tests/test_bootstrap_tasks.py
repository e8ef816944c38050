"""Draws of few keys are made by many tasks."""

from pyspark.sql import functions as F

from chronopanel.operators import resample as rs


def test_draws_of_one_key_are_spread(spark):
    series = spark.range(40).select(F.lit("k").alias("k"), F.col("id").alias("pos"), F.col("id").cast("double").alias("v"))
    samples = rs.iid_samples(series, ["k"], ["v"], reps=200, seed=41)
    assert samples.count() == 8_000
    plan = samples._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM" in plan                     # a number of tasks that adaptive plans keep
