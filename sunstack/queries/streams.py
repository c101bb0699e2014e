"""Queries over tables read as streams: windowed stacks and counts, filtered logs. What a stream gives is what a batch gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import ingest

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


@query("""SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL""")
def streamed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ingest.watch_table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    counts = ingest.windowed_counts(e, "at", "1 hour", None, "10 minutes", ["event_type"])
    out = ingest.run_into(counts, ingest.shared_folder(spark), "complete")
    return out.select(F.unix_micros("start").alias("start_us"), "event_type", "n", F.round("mean", 6).alias("mean"))


@query("""WITH f AS (SELECT label AS channel, vec_id // 100 * 100 AS start_s, list_sum(list_transform(embedding, lambda e: 1 + e::DOUBLE)) / 64 AS m, unnest(range(64)) AS pos, 1 + unnest(embedding)::DOUBLE AS v FROM embeddings)
SELECT start_s, channel, pos::INT AS pos, round(avg(v), 6) AS mean, count(*) AS n_frames FROM f WHERE abs(m - 1) <= 0.0175 GROUP BY ALL""")
def streamed_stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = ingest.watch_table(spark, sf_dir, "embeddings").select(F.col("label").alias("channel"), F.timestamp_seconds("vec_id").alias("at"), F.transform("embedding", lambda e: e.cast("double") + 1.0).alias("px"))
    out = ingest.run_into(ingest.windowed_stack(f, "at", "100 seconds", "10 seconds", 0.0175), ingest.shared_folder(spark), "complete")
    return out.select(F.unix_seconds("start").alias("start_s"), "channel", "pos", F.round("mean", 6).alias("mean"), "n_frames")


@query("""SELECT event_id, event_type, (1 << (event_id % 6))::INT AS mask FROM events WHERE (1 << (event_id % 6)) & 41 != 0""")
def streamed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = ingest.watch_table(spark, sf_dir, "events").select("event_id", "event_type", F.expr("shiftleft(1, cast(event_id % 6 as int))").alias("mask"))
    return ingest.run_into(ingest.log_stream(lines, 41), ingest.shared_folder(spark))
