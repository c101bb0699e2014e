"""Tiles of the Mandelbrot set: the smoke test of split, run and merge."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import Job


class MandelbrotJob(Job):
    schema = "part_id int, y int, x int, n int"

    def __init__(self, size: int = 64, tiles: int = 4, most: int = 60) -> None:
        self.size, self.tiles, self.most = size, tiles, most

    def split(self, spark: SparkSession) -> DataFrame:
        ids = spark.range(self.tiles * self.tiles).select(F.col("id").cast("int").alias("part_id"))
        return ids.withColumn("ty", F.floor(F.col("part_id") / self.tiles)).withColumn("tx", F.col("part_id") % self.tiles)

    def run(self, pdf: pd.DataFrame) -> pd.DataFrame:
        side = self.size // self.tiles
        ty, tx = int(pdf["ty"].iloc[0]), int(pdf["tx"].iloc[0])
        y, x = np.mgrid[ty * side : (ty + 1) * side, tx * side : (tx + 1) * side]
        c = (x * 3.0 / self.size - 2.2) + 1j * (y * 3.0 / self.size - 1.5)
        z, n = np.zeros_like(c), np.zeros(c.shape, int)
        for _ in range(self.most):
            on = np.abs(z) <= 2
            z = np.where(on, z * z + c, z)
            n += on
        return pd.DataFrame({"part_id": int(pdf["part_id"].iloc[0]), "y": y.ravel(), "x": x.ravel(), "n": n.ravel()})
