"""Roles whose keys are nearly as many as rows are grouped by a number of tasks that grows with the rows."""

import re

from chronopanel import session
from chronopanel.operators.joins import bucket_pairs
from chronopanel.sources.roles import Roles


def test_tasks_grow_with_rows(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 500)
    r = Roles(spark, sf_dir)
    many = -(-r.table("lineitem").count() // 500)
    assert many > 8
    assert r.daily().rdd.getNumPartitions() == r.sets().rdd.getNumPartitions() == many
    pairs = bucket_pairs(r.sets(), ["decision_date", "ticker", "arm"])
    pairs.count()
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    sizes = [int(x) for x in re.findall(r"hashpartitioning\([^\n]*, (\d+)\)", plan)]
    assert sizes and set(sizes) == {many}                       # the pivot has no exchange of its own
