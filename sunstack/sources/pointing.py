"""Pointing logs: lines of time, two numbers, centre x, centre y and radius, to averaged pointing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates
from ..operators.windows import bucket_means


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """t (seconds), x, y, radius of every good line; comments and broken lines are left out."""
    return parse(spark.read.text(path))


def parse(lines: DataFrame) -> DataFrame:
    parts = F.split(F.trim("value"), r"\s+")
    number = lambda i: F.get(parts, i).try_cast("double")
    rows = lines.where(~F.col("value").rlike(r"^\s*([#;]|$)")).select(*[number(i).alias(n) for i, n in ((0, "t"), (3, "x"), (4, "y"), (5, "radius"))])
    return rows.dropna()


def convert(log: DataFrame, day: str, average: int = 1, scale: float = 1.0, angle: float = 0.0) -> DataFrame:
    """Mean of every ``average`` lines of a day, scaled and rotated (degrees), with heliographic coordinates."""
    mean = bucket_means(log.withColumn("day", F.lit(day)), ["day"], ["t", "x", "y"], ["t", "x", "y", "radius"], average) if average > 1 else log.withColumn("day", F.lit(day))
    c, s = F.cos(F.radians(F.lit(angle))), F.sin(F.radians(F.lit(angle)))
    at = dates.add_seconds(F.to_timestamp("day"), F.col("t"))
    p, b0, radius = dates.sun_pb(dates.julian_day(at))
    x, y = scale * (c * F.col("x") - s * F.col("y")), scale * (s * F.col("x") + c * F.col("y"))
    lat, lon = dates.to_heliographic(x, y, radius, p, b0)
    return mean.select(at.alias("time"), x.alias("x"), y.alias("y"), lat.alias("lat"), lon.alias("lon"), p.alias("p"), b0.alias("b0"))
