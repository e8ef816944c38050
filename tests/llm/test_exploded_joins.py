"""Exploded tables, which Spark sizes like their input, are not broadcast."""

from pyspark.sql import functions as F

from chronopanel.llm import simhash


def test_fingerprint_index_is_merged(spark):
    prints = spark.range(64).select((F.col("id") * 0x0101).alias("fp"))
    links = simhash.near_links(prints)
    numbers = [k * 0x0101 for k in range(64)]
    assert {(r.a, r.b) for r in links.collect()} == {(a, b) for a in numbers for b in numbers if a < b and (a ^ b).bit_count() <= simhash.MAX_BITS}
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_shingle_lists_are_merged(spark, monkeypatch):
    plans, plain = {}, simhash.stage

    def spy(df, name):
        plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        return plain(df, name)

    monkeypatch.setattr(simhash, "stage", spy)
    docs = spark.createDataFrame([(k, " ".join(f"w{k // 2}x{j}" for j in range(60)) + " end" * (k % 2)) for k in range(20)], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.one_of_each_group(docs).collect()) == list(range(0, 20, 2))
    assert "SortMergeJoin" in plans["shingle-lists"] and "Broadcast" not in plans["shingle-lists"]
