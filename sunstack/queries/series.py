"""Queries over telemetry, samples and job tables: runs, medians, offsets, ties, sets, orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, dates
from ..operators import matching, stack, windows
from ..sources.tables import load

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r(c, n: int = 6):
    return F.round(c, n)


@query("""WITH e AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY user_id) AS n, median(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
f AS (SELECT *, max(CASE WHEN k = 3 THEN m END) OVER (PARTITION BY user_id) AS a, max(CASE WHEN k = n - 2 THEN m END) OVER (PARTITION BY user_id) AS z FROM e)
SELECT event_id, round(CASE WHEN n <= 10 THEN value WHEN k <= 2 THEN a WHEN k > n - 2 THEN z ELSE m END, 6) AS median FROM f""")
def running_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.running_median(load(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value", 5).select("event_id", r("median").alias("median"))


@query("""WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events),
c AS (SELECT user_id, event_type, g, count(*) AS n FROM e GROUP BY ALL) SELECT user_id, event_type, max(n) AS longest FROM c GROUP BY ALL""")
def longest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.longest_run(load(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@query("""WITH e AS (SELECT user_id, value, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 4 AS bucket FROM events)
SELECT user_id, bucket, round(avg(value), 6) AS value FROM e GROUP BY ALL HAVING count(*) = 4""")
def average_every_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.bucket_means(load(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["value"], 4).withColumn("value", r("value"))


@query("""WITH n AS (SELECT o_custkey, o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT o_custkey, o_orderkey, n, coalesce(sum(n) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM n""")
def frame_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    orders = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    counts = orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"], "left").select("o_custkey", "o_orderkey", F.coalesce("n", F.lit(0)).alias("n"))
    return windows.offsets(counts, ["o_custkey"], ["o_orderkey"], "n")


@query("""WITH p AS (SELECT l_partkey, min((l_orderkey, l_linenumber)) AS p FROM lineitem GROUP BY ALL)
SELECT l.l_partkey, l_orderkey, l_linenumber, p.p[1] AS pivot_l_orderkey, p.p[2] AS pivot_l_linenumber FROM lineitem l JOIN p ON l.l_partkey = p.l_partkey WHERE (l_orderkey, l_linenumber) <> p.p""")
def wavefront_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = load(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber")
    return matching.wavefront_ties(images, "l_partkey", ["l_orderkey", "l_linenumber"])


@query("SELECT user_id, count(DISTINCT event_type) AS n FROM events GROUP BY ALL HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)")
def reference_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.covers_all(load(spark, sf_dir, "events"), "user_id", "event_type")


@query("""WITH s AS (SELECT o_custkey AS owner, list_sort(list(DISTINCT o_orderpriority)) AS members FROM orders GROUP BY ALL), f AS (SELECT members AS ref FROM s WHERE owner = (SELECT min(owner) FROM s WHERE len(members) = 4))
SELECT members, min(owner) AS owner FROM s, f WHERE list_has_all(ref, members) AND members <> ref GROUP BY ALL""")
def trace_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = matching.sets(load(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "owner"), "owner", "o_orderpriority")
    return matching.contained_in(sets, sets.where(F.size("members") == 4).orderBy("owner").limit(1))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def missing_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    return load(spark, sf_dir, "customer").join(o, F.col("c_custkey") == o["o_custkey"], "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def missing_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    return load(spark, sf_dir, "customer").join(o, F.col("c_custkey") == o["o_custkey"], "left_anti").select("c_custkey")


@query("""WITH j AS (SELECT o_orderkey, o_orderpriority, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderstatus DESC, o_orderkey) AS rank FROM orders) SELECT o_orderkey, rank FROM j""")
def job_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderpriority", F.desc("o_orderstatus"), "o_orderkey")
    return load(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(w).cast("bigint").alias("rank"))


@query("""WITH k AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY o_orderpriority, o_orderkey) AS k, count(*) OVER () AS n FROM orders) SELECT o_orderkey, o_orderpriority FROM k WHERE k < 10 OR k = n""")
def first_last_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return matching.first_and_last(rows, [F.col("o_orderpriority"), F.col("o_orderkey")], 10)


@query("""WITH a AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS a FROM part), b AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS rank FROM a WHERE a <= 7)
SELECT p_brand, p_partkey, rank FROM b WHERE rank <= 5""")
def topk_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = matching.top_k_two_stage(load(spark, sf_dir, "part"), ["p_brand"], "p_retailprice", "p_size", "p_partkey", 5)
    return out.select("p_brand", "p_partkey", F.col("rank").cast("bigint").alias("rank"))


@query("""SELECT user_id, min(ts) AS first_begin, max(ts + INTERVAL 2 SECOND) AS last_end, round((sum(epoch_us(ts)) + sum(epoch_us(ts + INTERVAL 2 SECOND))) / (2 * count(*)) / 1e6, 3) AS mean_s FROM events GROUP BY user_id""")
def frame_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").withColumn("te", F.col("ts") + F.expr("INTERVAL 2 SECOND"))
    return stack.observation_times(e, ["user_id"], "ts", "te").select("user_id", "first_begin", "last_end", r(F.col("mean_micros") / 1e6, 3).alias("mean_s"))


@query("""WITH c AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'), v AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY ALL)
SELECT c.event_id, round(v.value, 6) AS value FROM c ASOF LEFT JOIN v ON c.user_id = v.user_id AND c.ts >= v.ts""")
def asof_pointing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    views = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    clicks = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    return windows.asof(clicks, views, ["user_id"], "ts", "ts", ["value"]).select("event_id", r("value").alias("value"))


@query("""SELECT event_id, p_partkey FROM events e JOIN part p ON e.value BETWEEN p_size AND p_size + 0.5""")
def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select("event_id", "value")
    p = load(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("low"), (F.col("p_size") + 0.5).alias("high"))
    return windows.range_join(e, p, "value", "low", "high", 5.0).select("event_id", "p_partkey")


@query("""SELECT event_id, round(greatest(least(value, 80), 20), 6) AS clamped, round(value - 20 - 60 * floor((value - 20) / 60) + 20, 6) AS wrapped,
round(CASE WHEN value - 20 - 120 * floor((value - 20) / 120) > 60 THEN 120 - (value - 20 - 120 * floor((value - 20) / 120)) ELSE value - 20 - 120 * floor((value - 20) / 120) END + 20, 6) AS reflected FROM events""")
def restrict_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return load(spark, sf_dir, "events").select("event_id", r(arrays.restrict(v, 20.0, 80.0)).alias("clamped"), r(arrays.restrict_periodic(v, 20.0, 80.0)).alias("wrapped"), r(arrays.restrict_reflected(v, 80.0, 20.0)).alias("reflected"))


@query("""WITH w AS (SELECT l_returnflag, l_linestatus, l_extendedprice AS v, l_quantity AS w FROM lineitem) SELECT l_returnflag, l_linestatus, round(sum(v * w) / sum(w), 4) AS weighted_mean, round(stddev_pop(v), 4) AS stddev, round(stddev_samp(v), 4) AS stddev_sample,
round(sqrt(avg(v * v)), 4) AS rms, min(v) AS min, max(v) AS max, count(*) AS n FROM w GROUP BY ALL""")
def sample_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, w = F.col("l_extendedprice"), F.col("l_quantity")
    return load(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        r(F.sum(v * w) / F.sum(w), 4).alias("weighted_mean"), r(F.stddev_pop(v), 4).alias("stddev"), r(F.stddev_samp(v), 4).alias("stddev_sample"),
        r(F.sqrt(F.avg(v * v)), 4).alias("rms"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL""")
def step_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), r(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT l_suppkey, list_sort(list(DISTINCT l_linenumber)) AS lines, count(DISTINCT l_partkey) AS n_parts FROM lineitem GROUP BY ALL""")
def distinct_wavefronts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("lines"), F.countDistinct("l_partkey").alias("n_parts"))


@query("""SELECT s_suppkey, s_name, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def inherit_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, g = (load(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(g, n["n_regionkey"] == g["r_regionkey"]).select("s_suppkey", "s_name", "n_name", "r_name")


@query("""SELECT event_id, round(epoch_us(ts) / 86400000000.0 + 2440587.5, 6) AS jd, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS text, round((280.46061837 + 360.98564736629 * d + 0.000387933 * t * t - t * t * t / 38710000.0) - 360 * floor((280.46061837 + 360.98564736629 * d + 0.000387933 * t * t - t * t * t / 38710000.0) / 360), 4) AS gmst
FROM (SELECT *, epoch_us(ts) / 86400000000.0 + 2440587.5 - 2451545.0 AS d, (epoch_us(ts) / 86400000000.0 + 2440587.5 - 2451545.0) / 36525.0 AS t FROM events)""")
def julian_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    jd = dates.julian_day(F.col("ts"))
    return load(spark, sf_dir, "events").select("event_id", r(jd).alias("jd"), dates.time_text(F.col("ts")).alias("text"), r(dates.sidereal_time(jd), 4).alias("gmst"))
