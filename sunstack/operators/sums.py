"""Sums of bursts, end to end: check, calibrate, mean, repair, with observation times and the frames left out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import calibrate, reconstruct, stack
from ..kernels import fourier


def repaired(px_of: DataFrame, w: int, reach: int = 2) -> DataFrame:
    """keys, px: null pixels of an image take the mean of the good ones within ``reach`` rows and columns, weighed by 1 / distance ** 2.

    An image's own expression, so no join: neighbours outside the frame or bad are left out, and a pixel without any stays 0."""
    offsets = [(y, x) for y in range(-reach, reach + 1) for x in range(-reach, reach + 1) if y or x]
    near = F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x"), F.lit(1.0 / (y * y + x * x)).alias("w")) for y, x in offsets])
    h = F.floor(F.size("px") / w)

    def filled(v, i):
        def add(a, o):
            y, x = F.floor(i / w) + o["y"], i % w + o["x"]
            n = F.when((y >= 0) & (y < h) & (x >= 0) & (x < w), F.get("px", (y * w + x).cast("int")))
            return F.when(n.isNull(), a).otherwise(F.struct((a["v"] + n * o["w"]).alias("v"), (a["w"] + o["w"]).alias("w")))

        zero = F.struct(F.lit(0.0).alias("v"), F.lit(0.0).alias("w"))
        return F.coalesce(v, F.aggregate(near, zero, add, lambda a: F.when(a["w"] > 0, a["v"] / a["w"]).otherwise(F.lit(0.0))))

    return px_of.withColumn("px", F.transform("px", filled))


def sum_frames(frames: DataFrame, calib: DataFrame, w: int, limit: float = stack.LIMIT, scatter=None) -> DataFrame:
    """A row for each channel: px (mean of the accepted frames, calibrated and repaired), n_frames, discarded, t_beg, t_end, mean_micros.

    frames: channel, frame_no, t_beg, t_end, px; calib: channel, dark, gain (0: a bad pixel). scatter: (gain, psf) to take scattered light out of
    the calibrated frames. Frames are rejected on their means before pixels are calibrated or exploded; bad pixels are
    repaired once, in the mean. A channel whose frames are all left out has no pixels; frames without pixels are left out."""
    frames = frames.where(F.col("px").isNotNull())
    checked = stack.check_frames(frames, limit).select("channel", "frame_no", "accepted")
    told = frames.join(checked, ["channel", "frame_no"])
    good = told.where("accepted")
    done = calibrate.calibrate(good.select("channel", "frame_no", "px"), calib)
    if scatter is not None:
        gain, psf = scatter
        done = reconstruct.map_images(done, lambda a: fourier.descatter(a, gain, psf), gain.shape[0], w)
    pixels = done.select("channel", F.posexplode("px").alias("pos", "v"))
    means = pixels.groupBy("channel", "pos").agg(F.avg("v").alias("m"))
    dead = calib.select("channel", F.posexplode("gain").alias("pos", "g")).where("g = 0").select("channel", "pos", F.lit(True).alias("bad"))
    means = means.join(dead, ["channel", "pos"], "left").withColumn("m", F.when(F.col("bad").isNull(), F.col("m")))
    images = means.groupBy("channel").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("px"))
    times = stack.observation_times(good, ["channel"], "t_beg", "t_end").toDF("channel", "t_beg", "t_end", "mean_micros")
    counts = told.groupBy("channel").agg(F.count_if("accepted").alias("n_frames"), F.array_sort(F.collect_list(F.when(~F.col("accepted"), F.col("frame_no")))).alias("discarded"))
    return counts.join(times, "channel", "left").join(repaired(images, w), "channel", "left")
