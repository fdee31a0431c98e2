"""Extensions: relational features that a query engine is expected to have, by Spark's own operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomline.plans.registry import query
from loomline.sources.fixtures import table


@query("ext_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
def grouping_sets(spark, sf):
    return table(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("ext_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube(spark, sf):
    return table(spark, sf, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("ext_pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(spark, sf):
    rows = table(spark, sf, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
                                                           F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("ext_join_revenue", """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def join_revenue(spark, sf):
    t = lambda n: table(spark, sf, n)
    joined = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("ext_rank_windows", "SELECT l_suppkey, l_orderkey, l_linenumber, rank() OVER w AS rk, dense_rank() OVER w AS dr FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_quantity DESC) QUALIFY rk <= 3")
def rank_windows(spark, sf):
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_quantity"))
    ranked = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", F.rank().over(w).alias("rk"), F.dense_rank().over(w).alias("dr")).where("rk <= 3")
    return ranked.withColumns({"rk": F.col("rk").cast("long"), "dr": F.col("dr").cast("long")})


@query("ext_intersect_keys", "SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal > 9000")
def intersect_keys(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")).intersect(table(spark, sf, "customer").where("c_acctbal > 9000").select("c_nationkey"))


@query("ext_except_keys", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def except_keys(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).exceptAll(table(spark, sf, "orders").select("o_custkey").distinct()).distinct()


@query("ext_full_outer", "SELECT coalesce(a.k, b.k) AS k, a.n AS suppliers, b.n AS customers FROM (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) a FULL JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9900 GROUP BY 1) b ON a.k = b.k")
def full_outer(spark, sf):
    count = lambda df, key, name: df.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias(name))
    a = count(table(spark, sf, "supplier").where("s_acctbal > 5000"), "s_nationkey", "suppliers")
    b = count(table(spark, sf, "customer").where("c_acctbal > 9900"), "c_nationkey", "customers")
    return a.join(b, "k", "full")


@query("ext_distinct_counts", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
def distinct_counts(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_suppkey").alias("suppliers"), F.countDistinct("l_partkey").alias("parts"))


@query("ext_sessions", """WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS f FROM events), g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM s)
SELECT user_id, epoch_us(min(ts)) // 1000 AS start_ms, count(*) AS n FROM g GROUP BY user_id, k""")
def sessions(spark, sf):
    events = table(spark, sf, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    start = F.timestamp_diff("MILLISECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), F.col("w.start"))
    return events.select("user_id", start.cast("long").alias("start_ms"), "n")


@query("ext_tumbling_windows", "SELECT event_type, epoch_ms(time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01')) AS start_ms, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark, sf):
    day = table(spark, sf, "events").groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))
    start = F.timestamp_diff("MILLISECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), F.col("w.start"))
    return day.select("event_type", start.cast("long").alias("start_ms"), "n", "total")


@query("ext_json_props", "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum FROM events GROUP BY event_type")
def json_props(spark, sf):
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("k_sum"))
