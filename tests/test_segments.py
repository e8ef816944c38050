"""Segments rebuild the whole path whatever its size."""

import datetime as dt

from chronopanel.catalog.aggregates import a21


class Paths:
    """Signals of 80 days whose wealth grows to about 1e13, and the days at which models are activated."""

    def __init__(self, spark, starts):
        day = lambda k: dt.date(2000, 1, 1) + dt.timedelta(days=k)
        self.signals = spark.createDataFrame([(day(k), k, "F", "m", 5e6 + 12345.678 * (k * 37 % 80)) for k in range(80)], "decision_date date, ticker long, family_id string, model_id string, score double")
        self.starts = spark.createDataFrame([("F", day(k), f"m{k % 3}", 0.5) for k in starts], "family_id string, activation_date date, model_id string, threshold double")

    def order_signals(self):
        return self.signals

    def schedule(self):
        return self.starts


def test_large_wealth_reconstructs(spark):
    rows = a21(Paths(spark, [0, 13, 29, 44, 61])).collect()
    assert sum(r.sessions for r in rows) == 80 and all(r.reconstructs for r in rows)


def test_a_lost_session_is_seen(spark):
    rows = a21(Paths(spark, [1, 13, 29, 44, 61])).collect()
    assert sum(r.sessions for r in rows) == 79 and not any(r.reconstructs for r in rows)
