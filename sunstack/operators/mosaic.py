"""Patches and mosaics: grids, cut-outs and the weighted sum of overlapping tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays


def patch_grid(spark: SparkSession, first: tuple[int, int], last: tuple[int, int], length: int, least_overlap: int) -> DataFrame:
    """patch_id, iy, ix, cy, cx, y0, x0, y1, x1 for centres spread over both axes (a plan of a few thousand rows)."""
    ys, xs = (arrays.segment(a, b, length, least_overlap) for a, b in zip(first, last, strict=True))
    rows = [(i * len(xs) + j, i, j, y, x, y - length // 2, x - length // 2, y + length // 2 - 1, x + length // 2 - 1) for i, y in enumerate(ys) for j, x in enumerate(xs)]
    return spark.createDataFrame(rows, "patch_id int, iy int, ix int, cy int, cx int, y0 int, x0 int, y1 int, x1 int")


MOST_PATCHES = 20_000


def cutouts(frames: DataFrame, patches: DataFrame, w: int) -> DataFrame:
    """Each patch of each frame as an array: a frame is exploded into its patches where it stands, with no join and no shuffle.

    patches: a plan of one frame, at most ``MOST_PATCHES`` rows (more are an error: split the plan)."""
    plan = patches.limit(MOST_PATCHES + 1).toPandas()
    if len(plan) > MOST_PATCHES:
        raise ValueError(f"more than {MOST_PATCHES} patches: split the plan")
    each = frames.withColumn("_p", F.explode(F.from_json(F.lit(plan.to_json(orient="records")), f"array<{patches.schema.simpleString()}>")))
    cut = F.flatten(F.transform(F.sequence(F.col("_p.y0"), F.col("_p.y1")), lambda y: F.slice("px", (y * w + F.col("_p.x0") + 1).cast("int"), F.col("_p.x1") - F.col("_p.x0") + 1)))
    return each.withColumn("px", cut).select(*frames.columns, "_p.*")


def ramp(i: Column, n: int, margin: int, blend: int) -> Column:
    """0 in the margin, a cosine rise over ``blend`` pixels, then 1; the same from the far end."""
    d = F.least(i, F.lit(n - 1) - i) - margin
    return F.when(d < 0, F.lit(0.0)).when(d >= blend, F.lit(1.0)).otherwise(0.5 - 0.5 * F.cos(F.lit(3.141592653589793) * (d + 1) / (blend + 1)))


def tile_weights(n: int, margin: int | None = None, blend: int | None = None) -> tuple[int, int]:
    margin = n // 8 if margin is None else margin
    return margin, (n - 2 * margin) // 3 if blend is None else blend


def mosaic(tiles: DataFrame, keys: list[str], least_weight: float = 1e-6) -> DataFrame:
    """keys, y, x, v: sum of weight * value over sum of weight, the plain sum where the weights don't exceed ``least_weight``.

    tiles: keys, y, x (of the mosaic), v, weight. A pixel is one partial-aggregated group, however many tiles overlap it."""
    sums = tiles.groupBy(*keys, "y", "x").agg(F.sum(F.col("weight") * F.col("v")).alias("wv"), F.sum("weight").alias("w"), F.sum("v").alias("raw"))
    return sums.select(*keys, "y", "x", F.when(F.col("w") > least_weight, F.col("wv") / F.col("w")).otherwise(F.col("raw")).alias("v"), "w")


def grid_mosaic(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of weight * value where the overlaps' weights already add up to 1."""
    return tiles.groupBy(*keys, "y", "x").agg(F.sum(F.col("weight") * F.col("v")).alias("v"))
