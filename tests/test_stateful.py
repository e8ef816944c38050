"""Streams with typed state give what the batch folds give, whatever the deliveries."""

from pyspark.sql import functions as F

from chronopanel.operators import folds as fo
from chronopanel.session import scratch_path
from chronopanel.streaming import stateful as sf
from chronopanel.streaming import steps
from chronopanel.streaming.runtime import drain, drain_parts, read_events


def rows_of(df, *columns):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*columns).collect())


def streamed(spark, events, parts, columns, row_schema, state, output, step, **options):
    build = lambda e: sf.ordered_fold(e.select("user_id", "ts", F.unix_micros("ts").alias("at"), F.col("event_id").alias("as_of"), *columns), ["user_id"], "ts", "2 days",
                                      f"at long, as_of long, {row_schema}", state, f"user_id long, as_of long, {output}", step, **options)
    with sf.rocksdb(spark):
        return drain_parts(events, parts, build, "test-fold", flush=True)


def sample(spark, sf_dir):
    """Three users; deliveries overlap in time, so a micro-batch brings rows before rows of the one before it."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id < 3").where("ts < '2024-01-20'").select("event_id", "ts", "user_id", "event_type", "value")
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) + F.col("event_id") % 2
    return events, [day < 7, (day >= 7) & (day < 13), day >= 13]


def test_change_detector_stream_equals_batch(spark, sf_dir):
    events, parts = sample(spark, sf_dir)
    for options in ({}, {"slot_ms": 21_600_000}):
        got = streamed(spark, events, parts, ["value"], "value double", steps.CHANGE_STATE, "probability double", steps.change(50.0), **options)
        want = fo.change_detector(events.withColumn("order", F.struct("ts", "event_id")), ["user_id"], "order", "value", 50.0)
        assert rows_of(got, "user_id", "as_of", "probability") == rows_of(want, "user_id", "event_id", "probability")


def test_idle_keys_are_forgotten(spark, sf_dir):
    events = spark.createDataFrame([(1, "2024-01-01 00:00:00", 1, "a", 5.0), (2, "2024-01-02 00:00:00", 1, "a", 6.0), (3, "2024-03-01 00:00:00", 1, "a", 7.0), (4, "2024-03-01 00:00:00", 2, "a", 8.0)],
                                   "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    parts = [F.col("event_id") <= 2, F.col("event_id") == 4, F.col("event_id") == 3]
    count = lambda state, row: ((n := (state or (0,))[0] + 1,), (row[1], n))
    got = streamed(spark, events, parts, ["value"], "value double", "n long", "n long", count, idle_days=10)
    assert rows_of(got, "as_of", "n") == [(1, 1), (2, 2), (3, 1), (4, 1)]


def run(step, rows):
    state, out = None, []
    for row in rows:
        state, emitted = step(state, row)
        out.append(emitted)
    return out


def test_steps_equal_the_batch_folds(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id < 6").select("user_id", "event_id", "ts", "event_type", "value").withColumn("order", F.struct("ts", "event_id"))
    keyed = {}
    for r in events.orderBy("ts", "event_id").collect():
        keyed.setdefault(r.user_id, []).append(r)
    walk = lambda step, row: sorted((u, *(round(x, 9) if isinstance(x, float) else x for x in e)) for u, rows in keyed.items() for e in run(step, [row(r) for r in rows]))
    eligible, hit = F.col("event_type") != "error", F.col("event_type") == "purchase"
    want = fo.activity_posterior(events, ["user_id"], "order", eligible, hit)
    assert walk(steps.activity, lambda r: (r.ts, r.event_id, r.event_type != "error", r.event_type == "purchase")) == rows_of(want, "user_id", "event_id", "a", "b", "streak", "p_zero")
    want = fo.forgetful_alpha(events, ["user_id"], "order", "value", 50.0).select("user_id", "order.event_id", "discounted", "n", "uncertainty")
    assert walk(steps.forgetful(50.0), lambda r: (r.ts, r.event_id, r.value)) == rows_of(want, "user_id", "event_id", "discounted", "n", "uncertainty")
    want = fo.lifecycle(events, ["user_id"], "order", F.col("value") > 200, F.col("event_type") == "error", F.col("event_type") != "view", F.col("value") - 40)
    want = want.select("user_id", "order.event_id", "state", "sessions_in_state")
    assert walk(steps.lifecycle(), lambda r: (r.ts, r.event_id, r.value > 200, r.event_type == "error", r.event_type != "view", r.value - 40)) == rows_of(want, "user_id", "event_id", "state", "sessions_in_state")


def test_hysteresis_step_equals_the_batch_fold(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id < 6")
    day = F.unix_date(F.to_date("ts"))
    score = lambda k: (F.xxhash64(F.floor(day / 2), F.lit(k)) % 50).cast("double")
    scores = F.create_map(*(c for k in ("view", "signup", "click", "error", "purchase") for c in (F.lit(k), score(k))))
    rows = events.select("user_id", "event_id", F.col("ts").alias("assessment_date"), F.to_date("ts").alias("evidence_date"), F.floor(day / 2).alias("fingerprint"), F.col("event_type").alias("winner"), scores.alias("scores"))
    want = fo.recipe_hysteresis(rows, ["user_id"]).join(rows.select("user_id", "assessment_date", "event_id"), ["user_id", "assessment_date"])
    keyed, got = {}, []
    for r in rows.orderBy("assessment_date").collect():
        keyed.setdefault(r.user_id, []).append((r.assessment_date, r.event_id, r.evidence_date.toordinal(), r.fingerprint, r.winner, r.scores, None))
    for user, own in keyed.items():
        got += [(user, *e) for e in run(steps.hysteresis(), own)]
    assert sorted(got, key=str) == sorted((tuple(r) for r in want.select("user_id", "event_id", "incumbent_before", "incumbent_after", "challenger", "confirmations", "reason").collect()), key=str)
    assert {fo.PENDING, fo.SWITCHED, fo.NO_IMPROVEMENT, fo.DUPLICATE, fo.NOTHING_NEW} <= {g[-1] for g in got}


def test_audited_deliveries_sum_to_the_input(spark):
    schema = "k string, day long, n long, ts timestamp_ntz"
    parts = [[("a", 1, 5), ("a", 3, 6), ("b", 2, 1)], [("a", 2, 9), ("a", 3, 7), ("a", 1, 5), ("b", 2, 1)], [("a", 4, 1), ("b", 1, 1), ("b", 3, 1)]]
    source, sink, ckpt = (scratch_path(spark, x) for x in ("audit-source", "audit-sink", "audit-checkpoint"))
    build = lambda e, monotone: sf.audit_deliveries(e, ["k"], "day", ["n"], monotone=monotone)
    for monotone, extra in ((True, {("a", 2): "LATE", ("b", 1): "LATE"}), (False, {("a", 2): "ACCEPTED", ("b", 1): "ACCEPTED"})):
        for part in parts:
            spark.createDataFrame([(*row, None) for row in part], schema).write.mode("append").parquet(f"{source}-{monotone}")
            with sf.rocksdb(spark):
                out = drain(build(read_events(spark, f"{source}-{monotone}", "*.parquet"), monotone), "audit", checkpoint=f"{ckpt}-{monotone}", path=f"{sink}-{monotone}")
        got = sorted((r.k, r.day, r.n, r.verdict) for r in out.collect())
        assert got == sorted([("a", 1, 5, "ACCEPTED"), ("a", 3, 6, "ACCEPTED"), ("b", 2, 1, "ACCEPTED"), ("a", 2, 9, extra["a", 2]), ("a", 3, 7, "CONFLICT"), ("a", 1, 5, "DUPLICATE"), ("b", 2, 1, "DUPLICATE"),
                              ("a", 4, 1, "ACCEPTED"), ("b", 1, 1, extra["b", 1]), ("b", 3, 1, "ACCEPTED")])
