"""Queries over image kernels: transforms, pupils, restoration, tiles. No SQL form; their tests hold them against analytic properties."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernels import fourier, images, restore, zernike
from ..operators import reconstruct
from ..sources.tables import frames

QUERIES, ORACLES = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


#: A frame against itself moved up by a row: the shift is known.
ORACLES["frame_shifts"] = "SELECT label AS channel, vec_id AS frame_no, [-1.0::DOUBLE, 0.0::DOUBLE] AS shift FROM embeddings"


def rounded(name: str = "px", n: int = 5):
    return F.transform(name, lambda v: F.round(v, n))


@query
def descatter_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    gain, psf = np.full((8, 8), 0.2), np.ones((3, 3))
    return reconstruct.map_images(frames(spark, sf_dir), lambda a: fourier.descatter(a, gain, psf), 8, 8).select("channel", "frame_no", rounded().alias("px"))


@query
def frame_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    pairs = f.select("channel", "frame_no", F.col("px").alias("a"), F.concat(F.slice("px", 9, 56), F.slice("px", 1, 8)).alias("b"))
    shift = reconstruct.map_pairs(pairs, lambda a, b: list(images.find_shift(a, b, 0)[:2]), 8, 8, "a", "b")
    return pairs.select("channel", "frame_no", shift.alias("shift"))


@query
def inpaint_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconstruct.map_images(frames(spark, sf_dir), lambda a: images.inpaint(a, a < 0.9), 8, 8).select("channel", "frame_no", rounded(n=3).alias("px"))


@query
def restore_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of each channel's frames as patches of 8 x 8, three wavefronts each."""
    optics = restore.make_optics(8, 0.1, 1.0, 6.3e-7, [(j, "Z") for j in (2, 3, 4)], noise_filter=False)
    f = frames(spark, sf_dir)
    cut = f.select(F.col("channel").alias("patch_id"), F.lit(0).alias("object"), (F.col("frame_no") % 3).cast("int").alias("wavefront"), F.col("frame_no").cast("int").alias("frame_no"), "px")
    out = reconstruct.restore_patches(cut, optics, 3)
    return out.select("patch_id", "object", rounded("img", 3).alias("img"), F.round("metric", 6).alias("metric"), "n_frames", "status")
