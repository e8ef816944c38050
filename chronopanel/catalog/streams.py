"""Structured Streaming twins over the event table; every oracle is the batch answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronopanel.catalog.registry import R, query
from chronopanel.functions.rounding import rnd
from chronopanel.session import scratch_path
from chronopanel.streaming import outcomes as st
from chronopanel.streaming import stateful as sf
from chronopanel.streaming import steps
from chronopanel.streaming.runtime import drain, drain_parts, read_events


def events(r, **options):
    return read_events(r.spark, r.sf_dir, **options)


@query("z1_pending_to_matured", f"""
SELECT p.event_id AS pending_id, o.event_id AS outcome_id, p.user_id, {R('o.value')} AS value FROM events p JOIN events o ON o.user_id = p.user_id AND CAST(o.ts AS DATE) = CAST(p.ts AS DATE) + 2
WHERE p.event_type = 'signup' AND o.event_type = 'purchase'""")
def z1(r):
    out = st.matured_outcomes(events(r).where("event_type = 'signup'"), events(r).where("event_type = 'purchase'"), 2)
    return drain(out, "matured").select("pending_id", "outcome_id", "user_id", rnd("value").alias("value"))


@query("z2_idempotent_append", "SELECT event_type, count(*) AS n_events, count(DISTINCT event_id) AS n_ids FROM events GROUP BY 1")
def z2(r):
    twice = events(r).union(events(r))
    got = drain(st.idempotent(twice, "event_id", "40 days"), "idempotent")
    return got.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_events"), F.countDistinct("event_id").alias("n_ids"))


@query("z2_stream_conflicts", """
SELECT event_type, verdict, count(*) AS n_rows FROM (
 SELECT event_type, 'ACCEPTED' AS verdict FROM events UNION ALL
 SELECT event_type, CASE WHEN event_type = 'error' THEN 'CONFLICT' ELSE 'DUPLICATE' END FROM events UNION ALL
 SELECT event_type, 'DUPLICATE' FROM events WHERE event_type = 'error') GROUP BY 1, 2""")
def z2_stream(r):
    """Three deliveries of all events: the second changes the values of errors, the third repeats the errors of the first."""
    def deliver(e):
        keyed = e.withColumn("id_block", F.floor(F.col("event_id") / sf.BLOCK))
        return sf.audit_deliveries(keyed, ["id_block"], "event_id", ["ts", "user_id", "event_type", "value", "props"]).drop("id_block")

    e, error = r.events(), F.col("event_type") == "error"
    changed = e.withColumn("value", F.when(error, F.col("value") + 1).otherwise(F.col("value")))
    out = delivered(r, [e, changed, e.where(error)], deliver, "conflicts")
    return out.groupBy("event_type", "verdict").agg(F.count(F.lit(1)).alias("n_rows"))


def delivered(r, deliveries, build, name):
    """Each delivery is drained on its own, resuming one checkpoint with typed state."""
    spark, (source, path, ckpt) = r.spark, (scratch_path(r.spark, f"{name}-{x}") for x in ("source", "sink", "checkpoint"))
    with sf.rocksdb(spark):
        for rows in deliveries:
            rows.write.mode("append").parquet(source)
            out = drain(build(read_events(spark, source, "*.parquet")), name, checkpoint=ckpt, path=path)
    return out


@query("z2_delivery_conflicts", "SELECT event_id, 2::BIGINT AS deliveries FROM events WHERE event_type = 'error'")
def z2_conflicts(r):
    """A re-delivery that changed the value of error events is reported, identical ones are not."""
    e = r.events()
    again = e.withColumn("value", F.when(F.col("event_type") == "error", F.col("value") + 1).otherwise(F.col("value")))
    return st.delivery_conflicts(e.unionByName(again), "event_id")


@query("z3_matured_since_cursor", """
WITH c AS (SELECT ts, event_id FROM events WHERE event_id = (SELECT max(event_id) // 2 FROM events)) SELECT e.event_type, count(*) AS n_events FROM events e, c WHERE e.ts > c.ts OR (e.ts = c.ts AND e.event_id > c.event_id) GROUP BY 1""")
def z3(r):
    e = r.events()
    mid = e.agg((F.max("event_id") / 2).cast("long").alias("m"))
    cursor = e.where(F.col("event_id") == mid.scalar()).select("ts", "event_id").first()
    got = drain(st.matured_since(events(r), F.lit(cursor["ts"]), cursor["event_id"]), "since")
    return got.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_events"))


@query("z4_tumbling_activity", f"""
WITH w AS (SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n_events, sum(value) AS total FROM events GROUP BY 1, 2)
SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, event_type, n_events, {R('total', 3)} AS total FROM w""")
def z4(r):
    out = drain_parts(r.events(), [F.lit(True)], lambda e: st.tumbling_activity(e, "1 day", "1 hour"), "tumbling", flush=True)
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.col("window_end").cast("timestamp_ntz").alias("window_end"), "event_type", "n_events", rnd("total", 3).alias("total"))


@query("z5_session_windows", """
WITH g AS (SELECT user_id, ts, (lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR)::INT AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g),
x AS (SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n_events FROM s GROUP BY user_id, k) SELECT * FROM x""")
def z5(r):
    out = drain_parts(r.events(), [F.lit(True)], lambda e: st.sessions(e, "6 hours", "1 hour"), "sessions", flush=True)
    return out.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n_events")


@query("z6_sliding_statistics", f"""
WITH x AS (SELECT event_type, value, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 6 HOUR AS window_start FROM events, (SELECT unnest([0, 1, 2, 3]) AS k))
SELECT window_start, event_type, count(*) AS n_events, {R('avg(value)', 4)} AS mean_value, {R('max(value)', 4)} AS max_value FROM x GROUP BY 1, 2""")
def z6(r):
    out = drain_parts(r.events(), [F.lit(True)], lambda e: st.sliding_statistics(e, "1 day", "6 hours", "1 hour"), "sliding", flush=True)
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n_events", rnd("mean_value", 4).alias("mean_value"), rnd("max_value", 4).alias("max_value"))


#: Event time that one timer of a user folds: ten days.
FOLD_SLOT = 10 * 86_400_000


def folded(r, columns, row_schema, state_schema, output, step, name):
    """A fold per user over the events in three deliveries; the last rows leave when the marker moves the watermark."""
    build = lambda e: sf.ordered_fold(e.select("user_id", "ts", F.unix_micros("ts").alias("at"), F.col("event_id").alias("as_of"), *columns), ["user_id"], "ts", "1 hour",
                                      f"at long, as_of long, {row_schema}", state_schema, f"user_id long, as_of long, {output}", step, slot_ms=FOLD_SLOT)
    with sf.rocksdb(r.spark):
        return drain_parts(r.events(), thirds(r), build, name, flush=True)


Z7_ROWS = "s AS (SELECT user_id, event_id, event_type, value, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)"


@query("z7_stateful_fold", f"""
WITH RECURSIVE {Z7_ROWS},
c AS (SELECT user_id, event_id, rn, least(1, 0.02 + 0.98 * greatest(0, least(1, -value / 50)) * 0.1) AS p, 0.1 * value AS m FROM s WHERE rn = 1
 UNION ALL SELECT user_id, event_id, rn, least(1, 0.02 + 0.98 * (p0 * 0.9 + greatest(0, least(1, (m0 - value) / 50)) * 0.1)), 0.9 * m0 + 0.1 * value FROM (SELECT s.*, c.p AS p0, c.m AS m0 FROM c JOIN s ON s.user_id = c.user_id AND s.rn = c.rn + 1))
SELECT user_id, event_id AS as_of, {R('p')} AS probability FROM c""")
def z7(r):
    out = folded(r, ["value"], "value double", steps.CHANGE_STATE, "probability double", steps.change(50.0), "fold-change")
    return out.select("user_id", "as_of", rnd("probability").alias("probability"))


@query("z7_activity_posterior", f"""
WITH e AS (SELECT user_id, event_id, ts, event_type <> 'error' AS eligible, event_type = 'purchase' AS hit FROM events),
n AS (SELECT *, sum(eligible::INT) OVER w AS seen, sum(hit::INT) OVER w AS hits FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
k AS (SELECT *, seen - coalesce(max(CASE WHEN hit THEN seen END) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS streak FROM n)
SELECT user_id, event_id AS as_of, {R('1.0 + hits')} AS a, {R('1.0 + seen')} AS b, CAST(streak AS BIGINT) AS streak, {R('((1.0 + seen) / (1.0 + seen + streak)) ** (1.0 + hits)')} AS p_zero FROM k""")
def z7_activity(r):
    out = folded(r, [(F.col("event_type") != "error").alias("eligible"), (F.col("event_type") == "purchase").alias("traded")], "eligible boolean, traded boolean", steps.ACTIVITY_STATE,
                 "a double, b double, streak long, p_zero double", steps.activity, "fold-activity")
    return out.select("user_id", "as_of", rnd("a").alias("a"), rnd("b").alias("b"), "streak", rnd("p_zero").alias("p_zero"))


@query("z7_health_update", f"""
WITH RECURSIVE {Z7_ROWS},
c AS (SELECT user_id, event_id, rn, 0.02 + 0.98 * greatest(0, least(1, -value / 50)) * 0.1 AS p, 0.1 * value AS m, value * 0.03 AS d FROM s WHERE rn = 1
 UNION ALL SELECT user_id, event_id, rn, 0.02 + 0.98 * (p0 * 0.9 + greatest(0, least(1, (m0 - value) / 50)) * 0.1), 0.9 * m0 + 0.1 * value, d0 * k + value * (1 - k)
  FROM (SELECT s.*, c.p AS p0, c.m AS m0, c.d AS d0, 0.97 * greatest(0.25, 1 - c.p) AS k FROM c JOIN s ON s.user_id = c.user_id AND s.rn = c.rn + 1))
SELECT user_id, event_id AS as_of, {R('d')} AS discounted, rn AS n, {R('1 / sqrt(rn)')} AS uncertainty FROM c""")
def z7_health(r):
    out = folded(r, ["value"], "value double", steps.ALPHA_STATE, "discounted double, n long, uncertainty double", steps.forgetful(50.0), "fold-health")
    return out.select("user_id", "as_of", rnd("discounted").alias("discounted"), "n", rnd("uncertainty").alias("uncertainty"))


Z7_NEXT = """CASE WHEN sk THEN 'SUSPENDED' WHEN kk AND s0 = 'PROBATION' THEN 'SUSPENDED' WHEN kk AND s0 = 'CHAMPION' THEN 'PROBATION' WHEN NOT cand THEN CASE WHEN s0 = 'CHAMPION' THEN 'PROBATION' ELSE s0 END
 WHEN s0 IN ('SUSPENDED', 'SHADOW') THEN 'CANDIDATE' WHEN s0 = 'CANDIDATE' AND lcb > 0 THEN 'CHAMPION' ELSE s0 END"""


@query("z7_lifecycle", f"""
WITH RECURSIVE {Z7_ROWS}, h AS (SELECT user_id, event_id, rn, value > 200 AS sk, event_type = 'error' AS kk, event_type <> 'view' AS cand, value - 40 AS lcb FROM s),
st AS (SELECT user_id, event_id, rn, {Z7_NEXT} AS state, 0 AS k FROM (SELECT *, 'SHADOW' AS s0 FROM h WHERE rn = 1)
 UNION ALL SELECT user_id, event_id, rn, ns, CASE WHEN ns = s0 THEN k0 + 1 ELSE 0 END FROM (SELECT *, {Z7_NEXT} AS ns FROM (SELECT h.*, st.state AS s0, st.k AS k0 FROM st JOIN h ON h.user_id = st.user_id AND h.rn = st.rn + 1)))
SELECT user_id, event_id AS as_of, state, CAST(k AS BIGINT) AS sessions_in_state FROM st""")
def z7_lifecycle(r):
    columns = [(F.col("value") > 200).alias("structural"), (F.col("event_type") == "error").alias("statistical"), (F.col("event_type") != "view").alias("candidate"), (F.col("value") - 40).alias("bound")]
    return folded(r, columns, "structural boolean, statistical boolean, candidate boolean, bound double", steps.LIFE_STATE, "state string, sessions_in_state long", steps.lifecycle(), "fold-lifecycle")


Z7_SCORE = "(('0x' || substr(md5({0} || '|' || {1}), 1, 7))::BIGINT % 1000) / 1000.0"


@query("z7_recipe_hysteresis", f"""
WITH RECURSIVE {Z7_ROWS}, ch AS (SELECT user_id, rn, event_id, CAST(ts AS DATE) AS evidence_date, CAST(epoch(date_trunc('day', ts)) AS BIGINT) // 172800 AS fingerprint, event_type AS winner FROM s),
st AS (SELECT user_id, rn, event_id, NULL::VARCHAR AS before, winner AS inc, NULL::VARCHAR AS ch, NULL::VARCHAR AS shown, 0 AS n, 0 AS shown_n, evidence_date AS ed, fingerprint AS fp, 'INITIAL_CAUSAL_RECIPE' AS reason FROM ch WHERE rn = 1
 UNION ALL SELECT user_id, rn, event_id, inc0, CASE WHEN reason = 'HYSTERESIS_SWITCH_CONFIRMED' THEN winner ELSE inc0 END, CASE WHEN old THEN ch0 WHEN reason = 'CHALLENGER_CONFIRMATION_PENDING' THEN winner END,
  CASE WHEN old THEN ch0 WHEN reason = 'INCUMBENT_RECONFIRMED' THEN NULL ELSE winner END, CASE WHEN old THEN n0 WHEN reason = 'CHALLENGER_CONFIRMATION_PENDING' THEN n1 ELSE 0 END,
  CASE WHEN old THEN n0 WHEN reason IN ('CHALLENGER_CONFIRMATION_PENDING', 'HYSTERESIS_SWITCH_CONFIRMED') THEN n1 ELSE 0 END, CASE WHEN old THEN ed0 ELSE ed1 END, CASE WHEN old THEN fp0 ELSE fp1 END, reason
 FROM (SELECT *, reason IN ('DUPLICATE_MATURED_EVIDENCE_IGNORED', 'NO_NEW_RECIPE_EVIDENCE') AS old FROM (
  SELECT *, CASE WHEN ed1 = ed0 THEN 'DUPLICATE_MATURED_EVIDENCE_IGNORED' WHEN fp1 = fp0 THEN 'NO_NEW_RECIPE_EVIDENCE' WHEN winner = inc0 THEN 'INCUMBENT_RECONFIRMED'
    WHEN {Z7_SCORE.format('winner', 'fp1')} <= {Z7_SCORE.format('inc0', 'fp1')} THEN 'NO_STRICT_ROBUST_SCORE_IMPROVEMENT' WHEN n1 >= 2 THEN 'HYSTERESIS_SWITCH_CONFIRMED' ELSE 'CHALLENGER_CONFIRMATION_PENDING' END AS reason
  FROM (SELECT ch.user_id, ch.rn, ch.event_id, st.inc AS inc0, st.ch AS ch0, st.n AS n0, st.ed AS ed0, st.fp AS fp0, ch.evidence_date AS ed1, ch.fingerprint AS fp1, ch.winner, CASE WHEN st.ch = ch.winner THEN st.n + 1 ELSE 1 END AS n1
   FROM st JOIN ch ON ch.user_id = st.user_id AND ch.rn = st.rn + 1))))
SELECT user_id, event_id AS as_of, before AS incumbent_before, inc AS incumbent_after, shown AS challenger, CAST(shown_n AS BIGINT) AS confirmations, reason FROM st""")
def z7_hysteresis(r):
    """Every event is an assessment whose winner is its type; evidence grows every second day and scores all types."""
    print_ = F.floor(F.unix_date(F.to_date("ts")) / 2)
    score = lambda t: (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(t), print_.cast("string"))), 1, 7), 16, 10).cast("long") % 1000) / 1000.0
    kinds = ("view", "signup", "click", "error", "purchase")
    columns = [F.unix_date(F.to_date("ts")).cast("long").alias("evidence"), print_.alias("fingerprint"), F.col("event_type").alias("winner"),
               F.create_map(*(c for t in kinds for c in (F.lit(t), score(t)))).alias("scores"), F.lit(None).cast("map<string,long>").alias("folds")]
    return folded(r, columns, "evidence long, fingerprint long, winner string, scores map<string,double>, folds map<string,long>", steps.HYSTERESIS_STATE,
                  "incumbent_before string, incumbent_after string, challenger string, confirmations long, reason string", steps.hysteresis(), "fold-hysteresis")


def thirds(r):
    """The events in three deliveries, by time."""
    lo, hi = r.events().agg(F.min("ts"), F.max("ts")).first()
    a, b = (lo + (hi - lo) * k / 3 for k in (1, 2))
    return [F.col("ts") < F.lit(a), (F.col("ts") >= F.lit(a)) & (F.col("ts") < F.lit(b)), F.col("ts") >= F.lit(b)]


@query("z8_late_row_audit", """
WITH n AS (SELECT event_id % 3 AS k, max(ts) AS newest FROM events GROUP BY 1), e AS (SELECT event_type, ts < (SELECT max(newest) FROM n WHERE n.k < event_id % 3) - INTERVAL 20 DAY AS late FROM events)
SELECT event_type, count(*) AS n_rows, count(*) FILTER (coalesce(late, false)) AS late_rows FROM e GROUP BY 1""")
def z8(r):
    """Rows more than 20 days behind the evidence accepted in earlier micro-batches go to a side table, the rest to the accepted one.

    Three deliveries; each micro-batch writes under its epoch, so a repeated one replaces itself.
    """
    spark, (source, path, ckpt) = r.spark, (scratch_path(r.spark, x) for x in ("late-source", "late-audit", "late-checkpoint"))

    def audit(batch, epoch):
        kept = spark.read.schema("newest timestamp, epoch long").parquet(f"{path}/newest").where(F.col("epoch") < epoch).agg(F.max("newest")).first()[0] if epoch else None
        late = F.coalesce(F.col("ts") < F.lit(kept).cast("timestamp") - F.expr("INTERVAL 20 DAYS"), F.lit(False))
        batch.where(late).write.mode("overwrite").parquet(f"{path}/late/epoch={epoch}")
        batch.where(~late).write.mode("overwrite").parquet(f"{path}/accepted/epoch={epoch}")
        batch.agg(F.max("ts").alias("newest"), F.lit(epoch).cast("long").alias("epoch")).write.mode("append").parquet(f"{path}/newest")

    for k in range(3):
        r.events().where(F.col("event_id") % 3 == k).write.mode("append").parquet(source)
        (read_events(spark, source, "*.parquet").writeStream.foreachBatch(audit).option("checkpointLocation", ckpt).trigger(availableNow=True).start()).awaitTermination()
    both = spark.read.parquet(f"{path}/accepted").select("event_type", F.lit(0).alias("late")).unionByName(spark.read.parquet(f"{path}/late").select("event_type", F.lit(1).alias("late")))
    return both.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("late").alias("late_rows"))


@query("z8_stream_evidence_dates", """
WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2), b AS (SELECT min(day) AS lo, max(day) AS hi FROM d), c AS (SELECT lo + CAST((hi - lo) // 3 AS INTEGER) AS a, lo + CAST(2 * ((hi - lo) // 3) AS INTEGER) AS b FROM b),
one AS (SELECT event_type, day, n, 1 AS k FROM d, c WHERE day < c.b AND extract(day FROM day) % 7 <> 3), two AS (SELECT event_type, day, n + (extract(day FROM day) % 4 = 0)::INT AS n, 2 AS k FROM d, c WHERE day >= c.a AND extract(day FROM day) % 7 <> 5),
three AS (SELECT event_type, day, n, 3 AS k FROM d), al AS (SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three),
top AS (SELECT event_type, max(day) FILTER (k = 1) AS t1, max(day) FILTER (k <= 2) AS t2 FROM al GROUP BY 1),
first AS (SELECT event_type, day, arg_min(n, k) AS n0, min(k) AS k0 FROM al JOIN top USING (event_type) WHERE k = 1 OR (k = 2 AND day >= t1) OR (k = 3 AND day >= t2) GROUP BY 1, 2)
SELECT al.event_type, CASE WHEN f.day IS NULL OR al.k < f.k0 THEN 'LATE' WHEN al.k = f.k0 THEN 'ACCEPTED' WHEN al.n = f.n0 THEN 'DUPLICATE' ELSE 'CONFLICT' END AS verdict, count(*) AS n_rows
FROM al LEFT JOIN first f ON f.event_type = al.event_type AND f.day = al.day GROUP BY 1, 2""")
def z8_stream(r):
    """Daily evidence of each event type in three overlapping deliveries: new days behind the newest one are late, changed days conflict."""
    d = r.events().groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n")).withColumn("ts", F.col("day").cast("timestamp"))
    lo, hi = d.agg(F.min("day"), F.max("day")).first()
    third, skip = (hi - lo).days // 3, lambda k: F.dayofmonth("day") % 7 != k
    a, b = F.date_add(F.lit(lo), third), F.date_add(F.lit(lo), 2 * third)
    changed = d.withColumn("n", F.col("n") + (F.dayofmonth("day") % 4 == 0).cast("int"))
    parts = [d.where((F.col("day") < b) & skip(3)), changed.where((F.col("day") >= a) & skip(5)), d]
    build = lambda e: sf.audit_deliveries(e.withColumn("day_number", F.unix_date("day")), ["event_type"], "day_number", ["n"], monotone=True)
    return delivered(r, parts, build, "evidence-dates").groupBy("event_type", "verdict").agg(F.count(F.lit(1)).alias("n_rows"))


@query("z9_stream_static_asof", """
WITH sc AS (SELECT event_type, CAST(ts AS DATE) AS start_day, max(value) AS threshold FROM events WHERE extract(day FROM ts) % 5 = 1 GROUP BY 1, 2)
SELECT e.event_type, sc.start_day, count(*) AS n_events, count(*) FILTER (e.value > sc.threshold) AS above FROM events e ASOF JOIN sc ON e.event_type = sc.event_type AND e.ts >= sc.start_day GROUP BY 1, 2""")
def z9(r):
    e = r.events()
    sched = e.where(F.dayofmonth("ts") % 5 == 1).groupBy("event_type", F.to_date("ts").alias("start_day")).agg(F.max("value").alias("threshold"))
    out = st.asof_stream(events(r), sched, ["event_type"], "start_day")
    return drain(out, "asof").groupBy("event_type", "start_day").agg(F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("value") > F.col("threshold")).alias("above"))


@query("z10_resume_equals_continuous", f"""
WITH w AS (SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n_events, sum(value) AS total FROM events GROUP BY 1, 2)
SELECT window_start, event_type, n_events, {R('total', 3)} AS total FROM w""")
def z10(r):
    """The stream is stopped after each third of the time span and resumed from its checkpoint on the rest."""
    out = drain_parts(r.events(), thirds(r), lambda e: st.tumbling_activity(e, "1 day", "1 hour"), "resumed", flush=True)
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n_events", rnd("total", 3).alias("total"))
