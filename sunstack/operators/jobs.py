"""Job bookkeeping as relations: image counts and lists by wavefront, cache need, totals by step, host and name orders, groups of constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wavefront_numbers(files: DataFrame) -> DataFrame:
    """file_number, frame_number, wavefront of every image. files: file_number, index (an own offset or null), offset, frames (numbers of a cube's planes, or of one image).

    A set of single images is numbered by file number plus offset; as soon as one file of the set (column ``channel``) is a cube, frame numbers are the wavefronts."""
    sizes = files.groupBy("channel").agg(F.max(F.size("frames")).alias("_most"))
    image = files.join(sizes, "channel").select("channel", "file_number", "_most", (F.col("file_number") + F.coalesce("index", "offset")).alias("_own"), F.explode("frames").alias("frame_number"))
    return image.select("channel", "file_number", "frame_number", F.when(F.col("_most") > 1, F.col("frame_number")).otherwise(F.col("_own")).alias("wavefront"))


def images_of(images: DataFrame, wanted: DataFrame) -> DataFrame:
    """Images whose wavefront is wanted (a semi-join; a wavefront may be wanted any number of times)."""
    return images.join(wanted.select("wavefront").distinct(), "wavefront", "left_semi")


def files_of(images: DataFrame, wanted: DataFrame, pattern: str) -> DataFrame:
    """channel, file: the name of each file that holds a wanted wavefront."""
    return images_of(images, wanted).select("channel", "file_number").distinct().select("channel", F.format_string(pattern, "file_number").alias("file"))


def image_counts(images: DataFrame, *levels: str) -> DataFrame:
    """Number of images at every level from the whole job down (a rollup); a level that is summed over is null."""
    return images.rollup(*levels).agg(F.count(F.lit(1)).alias("n_images"))


def only_present(listed: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """An incomplete list without its missing files."""
    return listed.join(present.select(key).distinct(), key, "left_semi")


def without_ends(frames: DataFrame, first: int, last: int) -> DataFrame:
    """Frames of cubes (column ``n_in_file`` over 1) but for the first and last of each file; single images stay."""
    at = F.col("frame_in_file")
    return frames.where((F.col("n_in_file") <= 1) | ((at >= first) & (at < F.col("n_in_file") - last)))


def cache_need(objects: DataFrame, n_patches: Column | int) -> DataFrame:
    """job, bytes: the sum over objects of (patch + 2 * shift) ** 2 * images, times the number of patches."""
    side = F.col("patch_size") + 2 * F.col("max_shift")
    return objects.groupBy("job").agg((F.sum(side * side * F.col("n_images")) * n_patches).alias("bytes"))


def step_totals(parts: DataFrame, *keys: str) -> DataFrame:
    """CPU and wall seconds, parts, and first to last of each step. parts: keys, t_beg, t_end, cpu_s."""
    seconds = lambda a, b: (F.unix_micros(b) - F.unix_micros(a)) / 1e6
    return parts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_parts"), F.sum("cpu_s").alias("cpu_s"), F.sum(seconds(F.col("t_beg"), F.col("t_end"))).alias("busy_s"),
        seconds(F.min("t_beg"), F.max("t_end")).alias("elapsed_s"))


def host_order(state: Column, last_active: Column, ident: Column) -> list[Column]:
    """Active hosts by the time since when they run, idle ones last."""
    return [(state == "idle").asc(), F.when(state != "idle", last_active).asc_nulls_last(), ident.asc()]


def nocase(name: Column) -> list[Column]:
    """Names without regard to case; equal ones in their own order."""
    return [F.lower(name).asc(), name.asc()]


def returned(patches: DataFrame, results: DataFrame) -> DataFrame:
    """Patches with the results that came back for their place in the grid; those without are still to be done."""
    found = results.withColumn("_found", F.lit(True))
    return patches.join(found, ["iy", "ix"], "left").withColumn("status", F.when(F.col("_found"), "done").otherwise("open")).drop("_found")


def constraint_groups(entries: DataFrame, write=None, most_rounds: int = 60) -> DataFrame:
    """constraint, group (the smallest constraint linked with it): constraints that share a variable, directly or through others, belong together.

    entries: constraint, variable. Each round every constraint takes the least group of the constraints that it shares a variable with, and
    then that group's own least, so rounds grow with the logarithm of a chain's length. write(df, round) cuts the lineage of a long run."""
    own = entries.select("constraint", "variable").distinct()
    now = own.select("constraint", F.col("constraint").alias("group")).distinct()
    for k in range(most_rounds):
        least = own.join(now, "constraint").groupBy("variable").agg(F.min("group").alias("_g"))
        new = own.join(least, "variable").groupBy("constraint").agg(F.min("_g").alias("group"))
        up = new.select(F.col("constraint").alias("group"), F.col("group").alias("_up"))
        new = new.join(up, "group").select("constraint", F.least("group", "_up").alias("group"))
        new = write(new, k) if write else new.checkpoint() if entries.sparkSession.sparkContext.getCheckpointDir() else new.cache()
        if new.join(now.withColumnRenamed("group", "_old"), "constraint").where(F.col("group") != F.col("_old")).isEmpty():
            return new
        now = new
    raise RuntimeError(f"groups didn't settle in {most_rounds} rounds")
