"""Positions of trades carry the trades' columns without a join back."""

from chronopanel.catalog.aggregates import positions
from chronopanel.sources.roles import Roles


def test_trades_are_read_once(spark, sf_dir):
    r = Roles(spark, sf_dir)
    held = positions(r, "hold")
    plan = held._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("hold#") and plan.count("/trades-") + plan.count("entry_idx") > 0
    assert sum("Relation" in line and "exit_idx#" in line for line in plan.splitlines()) == 1
    assert plan.count("strategy=merge") == 2                # bars are not sent through the driver
    t = {x.trade_id: (x.arm, x.hold) for x in r.trades().collect()}
    rows = held.select("trade_id", "arm", "hold").distinct().collect()
    assert rows and all(t[x.trade_id] == (x.arm, x.hold) for x in rows)
