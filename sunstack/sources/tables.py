"""Tables of a folder, and the frames, pixels and telemetry that stand behind them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 8  # an embedding of 64 numbers is a frame of 8 x 8


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tasks(spark: SparkSession) -> int:
    """Tasks for work that its input's bytes don't tell: three for each core, and as many as a shuffle has."""
    return max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by their keys for a kernel that takes long for each row: a small file is one task, whatever is done with its rows."""
    return df.repartition(tasks(df.sparkSession), *keys)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """channel, frame_no, px: pixels are 1 + e, so means lie near 1."""
    return load(spark, sf_dir, "embeddings").select(
        F.col("label").alias("channel"), F.col("vec_id").alias("frame_no"), F.transform("embedding", lambda e: e.cast("double") + 1.0).alias("px")
    )


def pixels(df: DataFrame) -> DataFrame:
    """One row for each pixel: pos, y, x, v beside the other columns."""
    keep = [c for c in df.columns if c != "px"]
    out = df.select(*keep, F.posexplode("px").alias("pos", "v"))
    return out.select(*keep, "pos", F.floor(F.col("pos") / SIDE).cast("int").alias("y"), (F.col("pos") % SIDE).alias("x"), "v")
