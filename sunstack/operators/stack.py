"""Robust frame stacking: frames far from the running median of their means are left out before pixels are summed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import stats, windows

LIMIT = 0.0175


def check_frames(frames: DataFrame, limit: float = LIMIT, size: int = 3) -> DataFrame:
    """channel, frame_no, mean, accepted: |running median - mean| <= limit * (upper) median of the channel's means.

    Only means are sorted and collected by channel, never pixels."""
    means = frames.select("channel", "frame_no", stats.mean(F.col("px")).alias("mean"))
    near = windows.median3_clamped(means, ["channel"], ["frame_no"], "mean", "_m") if size == 3 else windows.running_median(means, ["channel"], ["frame_no"], "mean", size, "_m")
    middle = upper_median(means, "channel", "mean")
    return near.join(middle, "channel").select("channel", "frame_no", "mean", (F.abs(F.col("_m") - F.col("mean")) <= limit * F.col("median")).alias("accepted"))


def upper_median(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, median: the upper middle of each key's values, exactly, by two partial aggregates and no sort of a whole key.

    A quantile sketch brackets the middle; the values inside the bracket, less than a hundredth of a large key's, are counted off exactly."""
    q = F.percentile_approx(value, F.array(F.lit(0.497), F.lit(0.503)), 2000)
    bounds = rows.groupBy(key).agg(F.count(value).alias("_n"), q.alias("_q"))
    lo, hi, v = F.get("_q", 0), F.get("_q", 1), F.col(value)
    # The next value over the bracket stands in where the middle falls just behind it.
    sums = rows.join(bounds, key).groupBy(key).agg(
        F.first("_n").alias("_n"), F.count_if(v < lo).alias("_below"), F.array_sort(F.collect_list(F.when((v >= lo) & (v <= hi), v))).alias("_band"), F.min(F.when(v > hi, v)).alias("_next"))
    return sums.select(key, F.coalesce(F.get("_band", (F.floor(F.col("_n") / 2) - F.col("_below")).cast("int")), F.col("_next")).alias("median"))


def sum_frames(pixels: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean of each pixel over its frames, by partial and final aggregates."""
    keys = keys or ["channel"]
    return pixels.groupBy(*keys, "pos").agg(F.avg("v").alias("mean"), F.count(F.lit(1)).alias("n_frames"))


def stack_checked(frames: DataFrame, explode, limit: float = LIMIT) -> DataFrame:
    """Mean image of the accepted frames of each channel: rejection comes before the explode, so nothing is subtracted afterwards."""
    good = check_frames(frames, limit).where("accepted").select("channel", "frame_no")
    return sum_frames(explode(frames.join(good, ["channel", "frame_no"])))


def observation_times(frames: DataFrame, keys: list[str], begin: str, end: str) -> DataFrame:
    """First begin, last end and mean of begins and ends."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return frames.groupBy(*keys).agg(F.min(begin).alias("first_begin"), F.max(end).alias("last_end"),
                                     ((F.sum(micros(begin)) + F.sum(micros(end))) / (2 * F.count(F.lit(1)))).alias("mean_micros"))
