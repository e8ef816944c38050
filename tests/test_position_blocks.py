"""Trades meet their bars in blocks: nothing is shuffled once per held session but the path by trade."""

import datetime

from pyspark.sql import functions as F

from chronopanel.operators import joins


def test_stretches_cross_blocks(spark, monkeypatch):
    monkeypatch.setattr(joins, "BLOCK", 4)
    day = lambda k: datetime.date(2000, 1, 3) + datetime.timedelta(7 * k)
    sessions = spark.createDataFrame([(day(k), k) for k in range(30)], "date date, idx long")
    have = {(t, k) for t in (1, 2) for k in range(30) if (k + t) % 7}
    prices = spark.createDataFrame([(t, day(k), 10.0 * t + k, 11.0 * t + k, 0.0, 0.0) for t, k in have], "ticker long, date date, open double, close double, high double, low double")
    spans = [(t, a, a + n) for t in (1, 2) for a in range(20) for n in (1, 3, 9)]
    trades = spark.createDataFrame([(i, t, day(a), day(b), a, b) for i, (t, a, b) in enumerate(spans)], "trade_id long, ticker long, entry_date date, exit_date date, entry_idx long, exit_idx long")
    out = joins.position_sessions(trades, prices, sessions)
    want = set()
    for i, (t, a, b) in enumerate(spans):
        for k in range(a, b + 1):
            if (t, k) in have and (k == a or (t, k - 1) in have):
                base = 10.0 * t + k if k == a else 11.0 * t + k - 1
                want.add((i, k, base, (10.0 if k == b else 11.0) * t + k))
    got = [(r.trade_id, r.idx, r.base_price, r.open if r.is_exit else r.close) for r in out.collect()]
    assert len(got) == len(want) and set(got) == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(ticker" in plan and not [x for x in plan.splitlines() if "hashpartitioning(ticker" in x and "idx#" in x.split("hashpartitioning")[1]]
