"""Domain roles derived from the fixture tables, as SQL CTE bodies (DuckDB dialect)."""

WEEK = "CAST(date_trunc('week', {}) AS DATE)"

SQL_ROLES: dict[str, str] = {
    # one row per (day, ticker)
    "x_daily": """
      SELECT CAST(l_shipdate AS DATE) AS day, l_suppkey AS ticker,
             min(100 + l_quantity + 10 * l_discount) AS lo, max(100 + l_quantity + 10 * l_discount) AS hi,
             sum(l_quantity) AS vol
      FROM lineitem GROUP BY 1, 2""",
    # weekly bars
    "x_prices": """
      SELECT CAST(date_trunc('week', day) AS DATE) AS date, ticker,
             arg_min(lo, day) AS open, arg_max(hi, day) AS close, max(hi) AS high, min(lo) AS low, sum(vol) AS volume
      FROM x_daily GROUP BY 1, 2""",
    "x_sessions": """
      SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS BIGINT) AS idx
      FROM (SELECT DISTINCT CAST(date_trunc('week', l_shipdate) AS DATE) AS date FROM lineitem)""",
    "x_bench": "SELECT date, avg(open) AS open, avg(close) AS close FROM x_prices GROUP BY date",
    "x_signals": """
      SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS decision_date, l_suppkey AS ticker,
             max(l_extendedprice * (1 - l_discount)) / 100000.0 AS score
      FROM lineitem GROUP BY 1, 2""",
    # scores of competing models, and the model each family activates per quarter: the one of the strongest score on the quarter's first date
    "x_msig": """
      SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS decision_date, l_suppkey AS ticker, r_name AS family_id, l_returnflag AS model_id,
             max(l_extendedprice * (1 - l_discount)) / 100000.0 AS score
      FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL""",
    "x_msch": """
      SELECT family_id, activation_date, arg_max(model_id, (score, -ticker, -ascii(model_id))) AS model_id
      FROM x_msig JOIN (SELECT family_id, min(decision_date) AS activation_date FROM x_msig GROUP BY family_id, date_trunc('quarter', decision_date)) USING (family_id)
      WHERE decision_date = activation_date GROUP BY 1, 2""",
    # entry at the next open, exit at the +4 session close, both for ticker and benchmark
    "x_outcomes": """
      SELECT d.date AS decision_date, p.ticker, e.date AS entry_date, t.date AS terminal_date,
             p.open AS entry_open, q.close AS terminal_close, be.open AS bench_open, bt.close AS bench_close,
             q.close / p.open - 1 AS stock_return, bt.close / be.open - 1 AS bench_return,
             (q.close / p.open) / (bt.close / be.open) - 1 - 0.002 AS excess
      FROM x_sessions d
      JOIN x_sessions e ON e.idx = d.idx + 1
      JOIN x_sessions t ON t.idx = d.idx + 4
      JOIN x_prices p ON p.date = e.date
      JOIN x_prices q ON q.date = t.date AND q.ticker = p.ticker
      JOIN x_bench be ON be.date = e.date
      JOIN x_bench bt ON bt.date = t.date""",
    "x_panel": """
      SELECT s.decision_date, s.ticker, s.score, o.entry_date, o.terminal_date, o.stock_return, o.bench_return, o.excess
      FROM x_signals s JOIN x_outcomes o USING (decision_date, ticker)""",
    # model-tagged signals from orders
    "x_ord": """
      SELECT CAST(o_orderdate AS DATE) AS decision_date, o_custkey AS ticker, c_mktsegment AS family_id,
             o_orderpriority AS model_id, max(o_totalprice) AS score
      FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3, 4""",
    "x_sched": """
      SELECT f.family_id, f.activation_date, min(o.model_id) AS model_id, f.threshold
      FROM (SELECT family_id, min(decision_date) AS activation_date, quantile_cont(top, 0.5) AS threshold
            FROM (SELECT family_id, decision_date, max(score) AS top FROM x_ord GROUP BY 1, 2)
            GROUP BY family_id, date_trunc('month', decision_date)) f
      JOIN x_ord o ON o.family_id = f.family_id AND o.decision_date = f.activation_date
      GROUP BY f.family_id, f.activation_date, f.threshold""",
    # weekly wealth curves, one per (nation, line status), with a common benchmark
    "x_ret": """
      SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, n_name AS family_id, l_linestatus AS arm,
             avg(l_discount - l_tax) - 0.01 AS r, count(*) FILTER (l_returnflag = 'R') AS positions
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
      GROUP BY 1, 2, 3""",
    "x_bret": """
      SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, avg(l_discount - l_tax) - 0.01 AS br
      FROM lineitem GROUP BY 1""",
    "x_nav": """
      SELECT n.date, n.family_id, n.arm, n.positions, n.r, b.bench_value,
             exp(sum(ln(1 + n.r)) OVER (PARTITION BY n.family_id, n.arm ORDER BY n.date)) AS strategy_value,
             round(exp(sum(ln(1 + n.r)) OVER (PARTITION BY n.family_id, n.arm ORDER BY n.date)) / b.bench_value, 10) AS rel
      FROM x_ret n JOIN (SELECT date, br, exp(sum(ln(1 + br)) OVER (ORDER BY date)) AS bench_value FROM x_bret) b
        ON n.date = b.date""",
    "x_month": """
      SELECT * EXCLUDE (rn), last_day(date) AS assessment_date FROM (
        SELECT *, row_number() OVER (PARTITION BY family_id, arm, date_trunc('month', date) ORDER BY date DESC) AS rn
        FROM x_nav) WHERE rn = 1""",
    # strategy families from the part table
    "x_fam": """
      SELECT DISTINCT printf('H%02d_D%02d_N%02d_%s', h, 1 + CAST(p_partkey AS INT) % h, 1 + CAST(p_partkey AS INT) % 6,
             CASE WHEN p_partkey % 2 = 0 THEN 'FIXED' ELSE 'LEARNED_EXIT' END) AS family_id
      FROM (SELECT p_partkey, 1 + (p_size - 1) % 30 AS h FROM part)""",
    "x_trades": """
      SELECT t.trade_id, t.ticker, t.entry_date, x.date AS exit_date, t.hold, t.arm
      FROM (SELECT l_orderkey AS trade_id, min(l_suppkey) AS ticker,
                   CAST(date_trunc('week', min(l_shipdate)) AS DATE) AS entry_date,
                   1 + l_orderkey % 12 AS hold, min(l_linestatus) AS arm
            FROM lineitem GROUP BY l_orderkey) t
      JOIN x_sessions e ON e.date = t.entry_date
      JOIN x_sessions x ON x.idx = e.idx + t.hold""",
    "x_dists": """
      SELECT l_suppkey AS ticker, CAST(date_trunc('week', l_shipdate) AS DATE) AS ex_date,
             sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS cash,
             CAST(date_trunc('week', l_shipdate) AS DATE) + CAST(10 + l_suppkey % 9 AS INT) AS payable_date
      FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2, 4""",
    # outer results of a (horizon, holding) design surface
    "x_surf": """
      SELECT (p_size - 1) % 10 + 1 AS h, l_linenumber AS d, l_returnflag AS treatment,
             CAST(year(l_shipdate) AS INT) AS fold,
             avg(l_discount - l_tax) - 0.006 AS cagr_excess, count(*) FILTER (l_quantity > 25) AS trade_count,
             avg(l_quantity) / 50.0 AS turnover, -max(l_tax) AS worst_dd
      FROM lineitem JOIN part ON l_partkey = p_partkey
      WHERE l_linenumber <= (p_size - 1) % 10 + 1 GROUP BY 1, 2, 3, 4""",
    # active candidates: one row per (date, ticker, arm, horizon bucket)
    "x_sets": """
      SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS decision_date, l_suppkey AS ticker, l_linestatus AS arm,
             CASE WHEN p_size <= 15 THEN 'SHORT' WHEN p_size <= 30 THEN 'MID' ELSE 'LONG' END AS h_bucket,
             round(avg(l_discount) - 0.05, 9) AS score, round(avg(l_tax) - 0.04, 9) AS realized, count(*) AS n_events,
             count(DISTINCT p_size) AS n_families
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4""",
    # executed trades with open-to-open returns
    "x_tr": """
      SELECT t.*, a.open AS entry_price, b.open AS exit_price, b.open / a.open - 1 AS stock_return,
             (b.open / a.open) / (bb.open / ba.open) - 1 AS excess
      FROM x_trades t JOIN x_prices a ON a.ticker = t.ticker AND a.date = t.entry_date
      JOIN x_prices b ON b.ticker = t.ticker AND b.date = t.exit_date
      JOIN x_bench ba ON ba.date = t.entry_date JOIN x_bench bb ON bb.date = t.exit_date""",
    # monthly activity and the family monthly panel
    "x_act": """
      SELECT family_id, arm, last_day(date) AS assessment_date, count(*) FILTER (positions > 0) AS active_days,
             count(*) AS observed_days, CAST(sum(positions) AS BIGINT) AS trade_count, max(CASE WHEN positions > 0 THEN date END) AS last_entry
      FROM x_ret GROUP BY 1, 2, 3""",
    "x_fmp": """
      SELECT m.family_id, m.arm, m.assessment_date, m.rel, m.rel / lag(m.rel) OVER w - 1 AS excess_1m,
             m.rel / lag(m.rel, 3) OVER w - 1 AS trailing_3m, lead(m.rel) OVER w / m.rel - 1 AS fwd_1m,
             lead(m.rel, 3) OVER w / m.rel - 1 AS fwd_3m, a.active_days, a.observed_days, a.trade_count,
             CASE WHEN a.active_days = 0 AND a.trade_count = 0 THEN 'NO_OPPORTUNITY'
                  WHEN m.rel / lag(m.rel) OVER w - 1 > 0 THEN 'ACTIVE_POSITIVE'
                  WHEN m.rel / lag(m.rel) OVER w - 1 < 0 THEN 'ACTIVE_NEGATIVE' ELSE 'ACTIVE_NEUTRAL' END AS activity_state
      FROM x_month m JOIN x_act a USING (family_id, arm, assessment_date)
      WINDOW w AS (PARTITION BY m.family_id, m.arm ORDER BY m.assessment_date)""",
    "x_clus": """
      SELECT cluster_level, cluster_id, arm, assessment_date, avg(excess_1m) AS excess_1m, avg(trailing_3m) AS trailing_3m,
             avg(fwd_1m) AS fwd_1m, avg(fwd_3m) AS fwd_3m, count(DISTINCT family_id) AS member_count,
             CAST(sum(trade_count) AS BIGINT) AS trade_count, avg(active_days) AS active_days,
             avg((activity_state = 'NO_OPPORTUNITY')::INT) AS no_opportunity, bool_and(fwd_1m IS NOT NULL) AS has_target
      FROM (SELECT f.*, 'FAMILY' AS cluster_level, family_id AS cluster_id FROM x_fmp f
            UNION ALL SELECT f.*, 'REGION', r_name FROM x_fmp f JOIN nation ON n_name = family_id JOIN region ON r_regionkey = n_regionkey)
      GROUP BY 1, 2, 3, 4""",
    "x_state": """
      SELECT *, CASE WHEN rank <= ceil(unit_count * 0.25) THEN 'TOP' WHEN rank > unit_count - ceil(unit_count * 0.25) THEN 'BOTTOM' ELSE 'MID' END AS quartile,
             (unit_count - rank + 1) / unit_count AS rank_pct
      FROM (SELECT *, row_number() OVER (PARTITION BY cluster_level, arm, assessment_date ORDER BY round(excess_1m, 9) DESC, cluster_id) AS rank,
                   count(*) OVER (PARTITION BY cluster_level, arm, assessment_date) AS unit_count,
                   dense_rank() OVER (PARTITION BY cluster_level, arm ORDER BY assessment_date) - 1 AS date_pos
            FROM x_clus WHERE excess_1m IS NOT NULL)""",
    # yearly family metrics keyed by strategy family ids
    "x_famy": """
      SELECT printf('H%02d_D%02d_N%02d_%s', 1 + (p_size - 1) % 30, 1 + CAST(p_partkey AS INT) % (1 + (p_size - 1) % 30), 1 + CAST(p_partkey AS INT) % 6,
                    CASE WHEN p_partkey % 2 = 0 THEN 'FIXED' ELSE 'LEARNED_EXIT' END) AS family_id,
             CAST(year(l_shipdate) AS INT) AS yr, l_returnflag AS arm, avg(l_discount - l_tax) AS metric, count(*) AS n_trades
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3""",
}
