"""Domain roles (prices, signals, schedules, wealth curves, ...) derived from the fixture tables.

Every role aggregates to its calendar grain first, so no later step sees raw-row skew on a single key. Keys nearly
as many as rows (``daily``, ``sets``) are dealt to a number of tasks that grows with the rows before they are
grouped; the others are aggregated in the map tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronopanel.session import tasks_for


def week(column: str | Column) -> Column:
    return F.date_trunc("week", F.col(column) if isinstance(column, str) else column).cast("date")


class Roles:
    """Lazy views over one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._shared: dict[str, DataFrame] = {}

    def share(self, *names: str) -> "Roles":
        """Write a role that several branches read to the shared folder once; later calls return the table."""
        from chronopanel.session import stage
        for name in names:
            if name not in self._shared:
                self._shared[name] = stage(getattr(self, name)(), name)
        return self

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def daily(self) -> DataFrame:
        price = F.lit(100) + F.col("l_quantity") + F.lit(10) * F.col("l_discount")
        lines = self.table("lineitem")
        return (lines.select(F.to_date("l_shipdate").alias("day"), F.col("l_suppkey").alias("ticker"), price.alias("price"), "l_quantity")
                .repartition(tasks_for(lines), "day", "ticker").groupBy("day", "ticker")
                .agg(F.min("price").alias("lo"), F.max("price").alias("hi"), F.sum("l_quantity").alias("vol")))

    def prices(self) -> DataFrame:
        """Weekly bars (date, ticker, open, close, high, low, volume)."""
        if "prices" in self._shared:
            return self._shared["prices"]
        return (self.daily().groupBy(week("day").alias("date"), "ticker")
                .agg(F.min_by("lo", "day").alias("open"), F.max_by("hi", "day").alias("close"),
                     F.max("hi").alias("high"), F.min("lo").alias("low"), F.sum("vol").alias("volume")))

    def sessions(self) -> DataFrame:
        """The trading calendar (date, idx); one row per session, so the ordering window is calendar-sized."""
        source = self._shared.get("prices")
        dates = (self.table("lineitem").select(week("l_shipdate").alias("date")) if source is None else source.select("date")).distinct()
        return dates.select("date", (F.row_number().over(Window.orderBy("date")) - 1).cast("long").alias("idx"))

    def bench(self) -> DataFrame:
        return self.prices().groupBy("date").agg(F.avg("open").alias("open"), F.avg("close").alias("close"))

    def signals(self) -> DataFrame:
        if "signals" in self._shared:
            return self._shared["signals"]
        return (self.table("lineitem")
                .groupBy(week("l_shipdate").alias("decision_date"), F.col("l_suppkey").alias("ticker"))
                .agg((F.max(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / F.lit(100000.0)).alias("score")))

    def model_signals(self) -> DataFrame:
        """Scores of competing models (return flag) per week, ticker and its family (region)."""
        if "model_signals" in self._shared:
            return self._shared["model_signals"]
        place = (self.table("supplier").select(F.col("s_suppkey").alias("ticker"), F.col("s_nationkey").alias("n_nationkey")).join(self.table("nation"), "n_nationkey")
                 .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("ticker", F.col("r_name").alias("family_id")))
        scores = (self.table("lineitem").groupBy(week("l_shipdate").alias("decision_date"), F.col("l_suppkey").alias("ticker"), F.col("l_returnflag").alias("model_id"))
                  .agg((F.max(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / F.lit(100000.0)).alias("score")))
        return scores.join(place, "ticker").select("decision_date", "ticker", "family_id", "model_id", "score")

    def model_schedule(self) -> DataFrame:
        """The model a family activates per quarter: the one of the strongest score on the quarter's first date."""
        day = self.model_signals().groupBy("family_id", "decision_date").agg(F.max_by("model_id", F.struct("score", -F.col("ticker"), -F.ascii("model_id"))).alias("model_id"))
        quarter = F.trunc("decision_date", "quarter").alias("_q")
        return day.groupBy("family_id", quarter).agg(F.min("decision_date").alias("activation_date"), F.min_by("model_id", "decision_date").alias("model_id")).drop("_q")

    def outcomes(self, horizon: int = 4) -> DataFrame:
        from chronopanel.operators.outcomes import realized_outcomes
        self.share("prices")
        return realized_outcomes(self.prices(), self.bench(), self.sessions(), horizon, cost=0.002)

    def panel(self) -> DataFrame:
        out = self.outcomes().select("decision_date", "ticker", "entry_date", "terminal_date",
                                     "stock_return", "bench_return", "excess")
        return self.signals().join(out, ["decision_date", "ticker"])

    def staged_panel(self) -> DataFrame:
        """The panel as a written table, for operators that branch over it several times."""
        from chronopanel.session import stage
        return stage(self.panel(), "panel")

    def order_signals(self) -> DataFrame:
        orders = self.table("orders").select(F.to_date("o_orderdate").alias("decision_date"), "o_custkey",
                                             F.col("o_orderpriority").alias("model_id"), "o_totalprice")
        customer = self.table("customer").select(F.col("c_custkey").alias("o_custkey"),
                                                 F.col("c_mktsegment").alias("family_id"))
        return (orders.join(customer, "o_custkey")
                .groupBy("decision_date", F.col("o_custkey").alias("ticker"), "family_id", "model_id")
                .agg(F.max("o_totalprice").alias("score")))

    def schedule(self) -> DataFrame:
        """One activation per (family, month): its first decision date, model and median daily-top threshold."""
        day = (self.order_signals().groupBy("family_id", "decision_date")
               .agg(F.max("score").alias("top"), F.min("model_id").alias("model_id")))
        return (day.groupBy("family_id", F.trunc("decision_date", "month").alias("_month"))
                .agg(F.min("decision_date").alias("activation_date"),
                     F.min_by("model_id", "decision_date").alias("model_id"),
                     F.expr("percentile(top, 0.5)").alias("threshold"))
                .drop("_month"))

    def returns(self) -> DataFrame:
        if "returns" in self._shared:
            return self._shared["returns"]
        supplier = self.table("supplier").select("s_suppkey", "s_nationkey")
        nation = self.table("nation").select("n_nationkey", F.col("n_name").alias("family_id"))
        return (self.table("lineitem")
                .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
                .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
                .groupBy(week("l_shipdate").alias("date"), "family_id", F.col("l_linestatus").alias("arm"))
                .agg((F.avg(F.col("l_discount") - F.col("l_tax")) - 0.01).alias("r"),
                     F.count_if(F.col("l_returnflag") == "R").alias("positions")))

    def bench_nav(self) -> DataFrame:
        daily = (self.table("lineitem").groupBy(week("l_shipdate").alias("date"))
                 .agg((F.avg(F.col("l_discount") - F.col("l_tax")) - 0.01).alias("br")))
        return daily.select("date", F.exp(F.sum(F.log1p("br")).over(Window.orderBy("date"))).alias("bench_value"))

    def nav(self) -> DataFrame:
        """Wealth curves (date, family_id, arm, positions, r, bench_value, strategy_value, rel)."""
        w = Window.partitionBy("family_id", "arm").orderBy("date")
        return (self.returns().withColumn("strategy_value", F.exp(F.sum(F.log1p("r")).over(w)))
                .join(self.bench_nav(), "date")
                .withColumn("rel", F.round(F.col("strategy_value") / F.col("bench_value"), 10)))

    def monthly(self) -> DataFrame:
        """Last observation per (family, arm, month)."""
        from chronopanel.operators.windows import period_end_rows
        return (period_end_rows(self.nav(), ["family_id", "arm"], "date", "month")
                .withColumn("assessment_date", F.last_day("date")))

    def families(self) -> DataFrame:
        h = F.lit(1) + (F.col("p_size") - 1) % 30
        key = F.col("p_partkey").cast("int")
        return self.table("part").select(F.format_string(
            "H%02d_D%02d_N%02d_%s", h, F.lit(1) + key % h, F.lit(1) + key % 6,
            F.when(key % 2 == 0, "FIXED").otherwise("LEARNED_EXIT")).alias("family_id")).distinct()

    def trades(self) -> DataFrame:
        if "trades" in self._shared:
            return self._shared["trades"]
        first = (self.table("lineitem").groupBy(F.col("l_orderkey").alias("trade_id"))
                 .agg(F.min("l_suppkey").alias("ticker"), week(F.min("l_shipdate")).alias("entry_date"),
                      F.min("l_linestatus").alias("arm"))
                 .withColumn("hold", 1 + F.col("trade_id") % 12))
        s = self.sessions()
        entry = s.select(F.col("date").alias("entry_date"), F.col("idx").alias("entry_idx"))
        exit_ = s.select(F.col("date").alias("exit_date"), F.col("idx").alias("exit_idx"))
        return (first.join(entry, "entry_date").withColumn("exit_idx", F.col("entry_idx") + F.col("hold"))
                .join(exit_, "exit_idx")
                .select("trade_id", "ticker", "entry_date", "exit_date", "hold", "arm", "entry_idx", "exit_idx"))

    def distributions(self) -> DataFrame:
        ex = week("l_shipdate")
        return (self.table("lineitem").where("l_returnflag = 'R'")
                .groupBy(F.col("l_suppkey").alias("ticker"), ex.alias("ex_date"))
                .agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("cash"))
                .withColumn("payable_date", F.expr("date_add(ex_date, cast(10 + ticker % 9 as int))")))

    def surface(self) -> DataFrame:
        part = self.table("part").select("p_partkey", "p_size")
        h = (F.col("p_size") - 1) % 10 + 1
        return (self.table("lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
                .where(F.col("l_linenumber") <= h)
                .groupBy(h.alias("h"), F.col("l_linenumber").alias("d"), F.col("l_returnflag").alias("treatment"),
                         F.year("l_shipdate").alias("fold"))
                .agg((F.avg(F.col("l_discount") - F.col("l_tax")) - 0.006).alias("cagr_excess"),
                     F.count_if(F.col("l_quantity") > 25).alias("trade_count"),
                     (F.avg("l_quantity") / 50.0).alias("turnover"), (-F.max("l_tax")).alias("worst_dd")))

    def sets(self) -> DataFrame:
        part = self.table("part").select("p_partkey", "p_size")
        bucket = F.when(F.col("p_size") <= 15, "SHORT").when(F.col("p_size") <= 30, "MID").otherwise("LONG")
        lines = self.table("lineitem")
        tasks, keys = tasks_for(lines), ["decision_date", "ticker", "arm"]
        rows = (lines.select("l_partkey", F.trunc("l_shipdate", "month").alias("decision_date"), F.col("l_suppkey").alias("ticker"), F.col("l_linestatus").alias("arm"), "l_discount", "l_tax")
                .repartition(tasks, "l_partkey").join(part.repartition(tasks, "p_partkey").hint("merge"), F.col("l_partkey") == F.col("p_partkey")))
        # pivots group by the same keys, so they need no exchange of their own
        return (rows.select(*keys, bucket.alias("h_bucket"), "l_discount", "l_tax", "p_size").repartition(tasks, *keys).groupBy(*keys, "h_bucket")
                .agg(F.round(F.avg("l_discount") - 0.05, 9).alias("score"), F.round(F.avg("l_tax") - 0.04, 9).alias("realized"),
                     F.count(F.lit(1)).alias("n_events"), F.countDistinct("p_size").alias("n_families")))

    def trade_returns(self) -> DataFrame:
        from chronopanel.operators.trades import open_to_open
        self.share("prices")
        return open_to_open(self.trades(), self.prices(), self.bench())

    def activity(self) -> DataFrame:
        from chronopanel.plans.panels import monthly_activity
        return monthly_activity(self.returns())

    def family_panel(self) -> DataFrame:
        from chronopanel.plans.panels import family_monthly_panel
        self.share("returns")
        return family_monthly_panel(self.monthly(), self.activity())

    def membership(self) -> DataFrame:
        region = self.table("region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
        nation = self.table("nation").join(region, "n_regionkey")
        return nation.select(F.col("n_name").alias("family_id"), F.inline(F.array(
            F.struct(F.lit("FAMILY").alias("cluster_level"), F.col("n_name").alias("cluster_id")),
            F.struct(F.lit("REGION").alias("cluster_level"), F.col("r_name").alias("cluster_id")))))

    def clusters(self) -> DataFrame:
        from chronopanel.plans.panels import cluster_panel
        return cluster_panel(self.family_panel(), self.membership())

    def state(self) -> DataFrame:
        if "state" in self._shared:
            return self._shared["state"]
        from chronopanel.plans.panels import state_frame
        return state_frame(self.clusters())

    def family_years(self) -> DataFrame:
        h, key = F.lit(1) + (F.col("p_size") - 1) % 30, F.col("p_partkey").cast("int")
        fam = F.format_string("H%02d_D%02d_N%02d_%s", h, F.lit(1) + key % h, F.lit(1) + key % 6,
                              F.when(key % 2 == 0, "FIXED").otherwise("LEARNED_EXIT"))
        part = self.table("part").select("p_partkey", fam.alias("family_id"))
        return (self.table("lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
                .groupBy("family_id", F.year("l_shipdate").alias("yr"), F.col("l_returnflag").alias("arm"))
                .agg(F.avg(F.col("l_discount") - F.col("l_tax")).alias("metric"), F.count(F.lit(1)).alias("n_trades")))

    def events(self) -> DataFrame:
        return self.table("events")
