"""A reconstruction as one plan: check, calibrate, cut, solve each patch, result table, mosaic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import calibrate, mosaic, stack


def mean_patches(cut: DataFrame) -> DataFrame:
    """patch_id, object, img, n_frames, status: the plain mean of each patch's cut-outs, by partial aggregates (a job that only flat-fields)."""
    pixels = cut.select("patch_id", "object", F.posexplode("px").alias("pos", "v"))
    means = pixels.groupBy("patch_id", "object", "pos").agg(F.avg("v").alias("m"), F.count(F.lit(1)).alias("n"))
    images = means.groupBy("patch_id", "object").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("img"), F.max("n").cast("int").alias("n_frames"))
    return images.select("patch_id", "object", "img", "n_frames", F.lit("ok").alias("status"))


def results(frames: DataFrame, patches: DataFrame, w: int, solve: Callable[[DataFrame], DataFrame] = mean_patches, calib: DataFrame | None = None, limit: float = stack.LIMIT) -> DataFrame:
    """The result table of a job: what ``solve`` gives for the cut-outs of the accepted, calibrated frames, with the place of each patch.

    frames: channel (its object), frame_no, px and what solve needs besides; patches: of ``mosaic.patch_grid``. Write it before it is used twice."""
    good = stack.check_frames(frames, limit).where("accepted").select("channel", "frame_no")
    ready = frames.join(good, ["channel", "frame_no"])
    ready = ready if calib is None else calibrate.calibrate(ready, calib).drop("status")
    cut = mosaic.cutouts(ready.withColumn("object", F.col("channel").cast("int")), patches.select("patch_id", "y0", "x0", "y1", "x1"), w).drop("y0", "x0", "y1", "x1")
    place = patches.select("patch_id", "y0", "x0", (F.col("x1") - F.col("x0") + 1).alias("n"))
    return solve(cut).join(F.broadcast(place), "patch_id")  # a plan of at most mosaic.MOST_PATCHES rows


def mosaics(result: DataFrame, n: int) -> DataFrame:
    """object, y, x, v: the patches of a result table (n x n images) blended over their overlaps; failed patches leave the others to it."""
    margin, blend = mosaic.tile_weights(n)
    p = result.where(F.col("img").isNotNull()).select("object", "y0", "x0", F.posexplode("img").alias("pos", "v"))
    y, x = F.floor(F.col("pos") / n), F.col("pos") % n
    tiles = p.select("object", (F.col("y0") + y).cast("int").alias("y"), (F.col("x0") + x).cast("int").alias("x"), "v", (mosaic.ramp(y, n, margin, blend) * mosaic.ramp(x, n, margin, blend)).alias("weight"))
    return mosaic.mosaic(tiles, ["object"]).select("object", "y", "x", "v")


#: Columns of a result table that may be left out on reading.
PARTS = ("img", "psf", "residual", "alpha", "metrics")


def write_results(result: DataFrame, path: str, parts: tuple[str, ...] = PARTS) -> None:
    """A result table as Parquet, one folder for each object; parts: the large columns to keep."""
    gone = [c for c in PARTS if c in result.columns and c not in parts]
    result.drop(*gone).write.mode("overwrite").partitionBy("object").parquet(path)


def read_results(spark: SparkSession, path: str, parts: tuple[str, ...] = PARTS, objects: list[int] | None = None) -> DataFrame:
    """A result table with the parts and objects asked for: others are neither listed nor read."""
    table = spark.read.parquet(path)
    table = table.drop(*[c for c in PARTS if c in table.columns and c not in parts])
    return table if objects is None else table.where(F.col("object").isin(objects))
