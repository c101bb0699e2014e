"""Arriving frames: file streams, event-time stacks with a watermark, filtered logs.

State is one partial sum for each (window, channel, pixel) and ends with the watermark,
so it is bounded by the lateness allowed, not by the length of the stream."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, or on a local master, if that is unset, under the machine's temporary folder."""
    named, master = spark.conf.get("spark.checkpoint.dir", ""), spark.conf.get("spark.master", "")
    if not named and (not master.startswith("local") or master.startswith("local-cluster")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{named.rstrip('/') or 'file://' + tempfile.gettempdir()}/sunstack-stream/{uuid.uuid4().hex}"


def watch_table(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table of a folder as a stream of its files; the table may be one file or a folder of files."""
    path = f"{folder.rstrip('/')}/{table}.parquet"
    schema, there = spark.read.parquet(path).schema, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(there).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{table}.parquet").parquet(folder)


def watch_files(spark: SparkSession, folder: str, most_files: int = 50) -> DataFrame:
    """New image files of a folder, a bounded number for each trigger (back-pressure)."""
    return spark.readStream.format("binaryFile").option("maxFilesPerTrigger", most_files).load(folder)


def windowed_stack(frames: DataFrame, time: str, window: str, lateness: str, limit: float | None = None) -> DataFrame:
    """Mean of each pixel by channel and event-time window; frames later than the watermark are left out. frames: channel, time, px.

    With ``limit``, frames whose mean is further than that share from 1 are rejected first (a running median would need unbounded state)."""
    mean = F.aggregate("px", F.lit(0.0), lambda a, v: a + v) / F.size("px")
    good = frames if limit is None else frames.where(F.abs(mean - 1) <= limit)
    pixels = good.withWatermark(time, lateness).select(F.window(time, window).alias("w"), "channel", F.posexplode("px").alias("pos", "v"))
    out = pixels.groupBy("w", "channel", "pos").agg(F.avg("v").alias("mean"), F.count(F.lit(1)).alias("n_frames"))
    return out.select(F.col("w.start").alias("start"), "channel", "pos", "mean", "n_frames")


def windowed_counts(events: DataFrame, time: str, window: str, slide: str | None, lateness: str, keys: list[str]) -> DataFrame:
    w = F.window(time, window, slide) if slide else F.window(time, window)
    return events.withWatermark(time, lateness).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), *keys, "n", "mean")


def log_stream(lines: DataFrame, mask: int, level: str = "mask") -> DataFrame:
    """Log entries whose severity bit is in the mask."""
    return lines.where(F.col(level).bitwiseAND(mask) != 0)


def for_each_batch(stream: DataFrame, handle, checkpoint: str) -> StreamingQuery:
    """Call handle(batch, number) for every micro-batch, exactly once by checkpoint and number."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).start()


def run_once(stream: DataFrame, name: str, mode: str = "append") -> StreamingQuery:
    """Take what is there into a memory table and end."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def run_into(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Take what is there, batch by batch, into Parquet under a shared folder, and read it back: all batches, or the last for the complete mode.

    A batch is written under its number, so one that is done again replaces itself."""
    spark, last = stream.sparkSession, []

    def handle(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        last.append(number)

    query = stream.writeStream.foreachBatch(handle).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if not last:
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(f"{folder}/out/batch={max(last)}")
    return spark.read.schema(stream.schema).parquet(*[f"{folder}/out/batch={n}" for n in sorted(set(last))])
