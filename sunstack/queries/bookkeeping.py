"""Queries over job bookkeeping: wavefront lists, counts, cache need, step totals, orders, results and constraint groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import jobs
from ..sources.tables import load

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


_FILES = """f AS (SELECT o_custkey % 20 AS channel, o_orderkey AS file_number, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 11 END AS idx, 5 AS off,
CASE WHEN o_custkey % 20 < 7 THEN list_transform(range(o_orderkey % 4 + 1), lambda i: o_orderkey * 10 + i) ELSE [o_orderkey * 10] END AS frames FROM orders),
i AS (SELECT channel, file_number, idx, off, unnest(frames) AS frame_number, max(len(frames)) OVER (PARTITION BY channel) AS most FROM f),
w AS (SELECT channel, file_number, frame_number, CASE WHEN most > 1 THEN frame_number ELSE file_number + coalesce(idx, off) END AS wavefront FROM i)"""


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey") % 20
    frames = F.when(c < 7, F.transform(F.sequence(F.lit(0).cast("bigint"), k % 4), lambda i: k * 10 + i)).otherwise(F.array(k * 10))
    files = load(spark, sf_dir, "orders").select(c.alias("channel"), k.alias("file_number"), F.when(k % 3 == 0, k % 11).alias("index"), F.lit(5).alias("offset"), frames.alias("frames"))
    return jobs.wavefront_numbers(files)


@query(f"WITH {_FILES} SELECT * FROM w")
def wavefront_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _images(spark, sf_dir)


@query(f"WITH {_FILES}, s AS (SELECT DISTINCT l_partkey AS wavefront FROM lineitem) SELECT DISTINCT channel, 'cam.' || lpad(file_number::VARCHAR, 7, '0') || '.fits' AS file FROM w SEMI JOIN s USING (wavefront)")
def wavefront_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.files_of(_images(spark, sf_dir), load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("wavefront")), "cam.%07d.fits")


@query(f"WITH {_FILES} SELECT channel, wavefront % 5 AS part, count(*) AS n_images FROM w GROUP BY ROLLUP (channel, part)")
def image_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.image_counts(_images(spark, sf_dir).withColumn("part", F.col("wavefront") % 5), "channel", "part")


@query("SELECT o_custkey % 50 AS job, sum((o_orderkey % 60 + 40 + 2 * (o_orderkey % 9)) * (o_orderkey % 60 + 40 + 2 * (o_orderkey % 9)) * (o_custkey % 30 + 1))::BIGINT * 36 AS bytes FROM orders GROUP BY ALL")
def cache_need(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    objects = load(spark, sf_dir, "orders").select((c % 50).alias("job"), (k % 60 + 40).alias("patch_size"), (k % 9).alias("max_shift"), (c % 30 + 1).alias("n_images"))
    return jobs.cache_need(objects, 36)


@query("""SELECT user_id AS job, event_type AS step, count(*) AS n_parts, round(sum(value), 4) AS cpu_s, round(sum(event_id % 7 + 0.5), 4)::DOUBLE AS busy_s,
(max(epoch_us(ts) + (event_id % 7) * 1000000 + 500000) - min(epoch_us(ts))) / 1e6 AS elapsed_s FROM events GROUP BY ALL""")
def step_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    end = F.timestamp_micros(F.unix_micros(ts) + (F.col("event_id") % 7) * 1_000_000 + 500_000)
    parts = load(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("event_type").alias("step"), ts.alias("t_beg"), end.alias("t_end"), F.col("value").alias("cpu_s"))
    out = jobs.step_totals(parts, "job", "step")
    return out.select("job", "step", "n_parts", *[F.round(c, 4).alias(c) for c in ("cpu_s", "busy_s")], "elapsed_s")


@query("""WITH h AS (SELECT s_suppkey, s_nationkey, s_name, CASE WHEN s_suppkey % 4 = 0 THEN 'idle' ELSE 'active' END AS state, s_acctbal FROM supplier)
SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY state = 'idle', CASE WHEN state = 'idle' THEN NULL ELSE s_acctbal END NULLS LAST, s_suppkey) AS place,
row_number() OVER (PARTITION BY s_nationkey ORDER BY lower(CASE WHEN s_suppkey % 2 = 0 THEN upper(s_name) ELSE s_name END), CASE WHEN s_suppkey % 2 = 0 THEN upper(s_name) ELSE s_name END) AS by_name FROM h""")
def host_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = load(spark, sf_dir, "supplier").withColumn("state", F.when(F.col("s_suppkey") % 4 == 0, "idle").otherwise("active"))
    name = F.when(F.col("s_suppkey") % 2 == 0, F.upper("s_name")).otherwise(F.col("s_name"))
    rank = lambda order: F.row_number().over(Window.partitionBy("s_nationkey").orderBy(*order)).cast("bigint")
    return h.select("s_suppkey", rank(jobs.host_order(F.col("state"), F.col("s_acctbal"), F.col("s_suppkey"))).alias("place"), rank(jobs.nocase(name)).alias("by_name"))


@query("""WITH p AS (SELECT p_partkey, p_partkey // 50 AS iy, p_partkey % 50 AS ix FROM part), r AS (SELECT o_orderkey // 50 AS iy, o_orderkey % 50 AS ix, o_totalprice AS metric FROM orders WHERE o_orderstatus = 'F')
SELECT p_partkey, CASE WHEN metric IS NULL THEN 'open' ELSE 'done' END AS status, metric FROM p LEFT JOIN r USING (iy, ix)""")
def returned_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = lambda c: [F.floor(F.col(c) / 50).alias("iy"), (F.col(c) % 50).alias("ix")]
    patches = load(spark, sf_dir, "part").select("p_partkey", *grid("p_partkey"))
    results = load(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(*grid("o_orderkey"), F.col("o_totalprice").alias("metric"))
    return jobs.returned(patches, results).select("p_partkey", "status", "metric")


@query("""SELECT o_orderkey, i.i::INT AS frame_in_file FROM orders, range(6) i(i) WHERE i.i < o_orderkey % 6 + 1 AND (o_orderkey % 6 = 0 OR (i.i >= 1 AND i.i < o_orderkey % 6 + 1 - 2)) AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def listed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    n = F.col("o_orderkey") % 6 + 1
    present = jobs.only_present(o, load(spark, sf_dir, "customer").where("c_acctbal > 0"), "c_custkey")
    frames = present.select("o_orderkey", n.alias("n_in_file"), F.explode(F.sequence(F.lit(0), n.cast("int") - 1)).alias("frame_in_file"))
    return jobs.without_ends(frames, 1, 2).select("o_orderkey", "frame_in_file")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT p_partkey AS c, unnest([p_partkey // 7 * 3 + p_size % 2, p_partkey // 7 * 3 + 1 + p_size % 2]) AS v FROM part),
n AS (SELECT DISTINCT a.c AS a, b.c AS b FROM e a JOIN e b USING (v)), r AS (SELECT c, c AS g FROM (SELECT DISTINCT c FROM e) UNION SELECT n.b, r.g FROM r JOIN n ON r.c = n.a WHERE r.g < n.b)
SELECT c AS "constraint", min(g) AS "group" FROM r GROUP BY ALL""")
def constraint_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.floor(F.col("p_partkey") / 7) * 3 + F.col("p_size") % 2
    entries = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("constraint"), F.explode(F.array(base, base + 1)).alias("variable"))
    return jobs.constraint_groups(entries)
