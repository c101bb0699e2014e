"""Frame calibration: dark, response, gain; the calibration side is one row for each channel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays

BROADCAST_BYTES = 64 << 20


def calibrate(frames: DataFrame, calib: DataFrame) -> DataFrame:
    """(px - dark) * gain, only where dark and gain exist and sizes agree; status tells ok, skipped or size.

    calib: channel, dark, gain. It is broadcast only if its measured pixels stay under BROADCAST_BYTES; otherwise the join shuffles on channel."""
    size = calib.agg(F.sum(8 * (F.size("dark") + F.size("gain")))).first()[0] or 0
    side = F.broadcast(calib) if size <= BROADCAST_BYTES else calib
    both = F.col("dark").isNotNull() & F.col("gain").isNotNull()
    fits = (F.size("px") == F.size("dark")) & (F.size("px") == F.size("gain"))
    done = F.zip_with(F.zip_with("px", "dark", lambda p, d: p - d), "gain", lambda v, g: v * g)
    status = F.when(~F.coalesce(both, F.lit(False)), "skipped").when(~fits, "size").otherwise("ok")
    joined = frames.join(side, "channel", "left").withColumn("status", status)
    return joined.withColumn("px", F.when(F.col("status") == "ok", done).otherwise(F.col("px"))).drop("dark", "gain")


def dark_and_gain(frames: DataFrame, pixels_of) -> DataFrame:
    """channel, dark (a tenth of the mean image) and gain (mean / pixel, 0 for dead pixels) from the frames themselves."""
    mean = pixels_of(frames).groupBy("channel", "pos").agg(F.avg("v").alias("m"))
    image = mean.groupBy("channel").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("image"))
    level = F.aggregate("image", F.lit(0.0), lambda a, v: a + v) / F.size("image")
    return image.select("channel", F.transform("image", lambda v: v / 10).alias("dark"), arrays.safe_divide(F.array_repeat(level, F.size("image")), F.col("image"), 1e-6).alias("gain"))
