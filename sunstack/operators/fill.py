"""Pixel repair on exploded pixels: inverse distance, horizontal interpolation, box smoothing, trimming."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def inverse_distance_fill(pixels: DataFrame, keys: list[str], reach: int = 64, threshold: float = 1e-3) -> DataFrame:
    """Replace pixels at or under the threshold by the mean of the good ones (not 0) within +-reach, weight (d**2 + 4)**-2; 0 if there is none.

    Values come from the unfilled image. Bad pixels are few: they are spread over blocks of ``reach`` and meet only the good pixels of
    neighbouring blocks in an equi-join."""
    bad = F.col("v") <= threshold
    block = lambda c: F.floor(F.col(c) / (reach + 1))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    holes = pixels.where(bad).select(*keys, F.col("y").alias("hy"), F.col("x").alias("hx"), block("y").alias("a"), block("x").alias("b"), F.explode(around).alias("s"))
    holes = holes.select(*keys, "hy", "hx", (F.col("a") + F.col("s.i")).alias("by"), (F.col("b") + F.col("s.j")).alias("bx"))
    good = pixels.where(~bad & (F.col("v") != 0)).select(*keys, "y", "x", "v", block("y").alias("by"), block("x").alias("bx"))
    d2 = (F.col("y") - F.col("hy")) ** 2 + (F.col("x") - F.col("hx")) ** 2
    near = (F.abs(F.col("y") - F.col("hy")) <= reach) & (F.abs(F.col("x") - F.col("hx")) <= reach)
    w = 1.0 / ((d2 + 4.0) * (d2 + 4.0))
    found = holes.join(good, [*keys, "by", "bx"]).where(near).groupBy(*keys, "hy", "hx").agg((F.sum(w * F.col("v")) / F.sum(w)).alias("filled"))
    out = pixels.join(found.withColumnsRenamed({"hy": "y", "hx": "x"}), [*keys, "y", "x"], "left")
    return out.withColumn("v", F.when(bad, F.coalesce("filled", F.lit(0.0))).otherwise(F.col("v"))).drop("filled")


def horizontal_fill(pixels: DataFrame, keys: list[str], reach: int = 64, threshold: float = 1e-3) -> DataFrame:
    """Replace bad pixels from their row: the mean of both neighbours, or a neighbour and the second pixel of the other side, linearly; else by inverse distance."""
    w = Window.partitionBy(*keys, "y").orderBy("x")
    ok = lambda f, k: F.when(f("v", k).over(w) > 0, f("v", k).over(w))
    l1, l2, r1, r2 = ok(F.lag, 1), ok(F.lag, 2), ok(F.lead, 1), ok(F.lead, 2)
    row = F.coalesce((l1 + r1) / 2, (l2 + 2 * r1) / 3, (2 * l1 + r2) / 3)
    near = inverse_distance_fill(pixels, keys, reach, threshold).withColumnRenamed("v", "_near")
    out = pixels.withColumn("_row", row).join(near.select(*keys, "y", "x", "_near"), [*keys, "y", "x"])
    return out.withColumn("filled", F.when(F.col("v") <= threshold, F.coalesce("_row", "_near"))).drop("_row", "_near")


def box_smooth(pixels: DataFrame, keys: list[str], ny: int, nx: int) -> DataFrame:
    """Mean over the half-open box [y - ny, y + ny) x [x - nx, x + nx), clamped at the edges: row sums, then column sums, so no join."""
    wx = Window.partitionBy(*keys, "y").orderBy("x").rowsBetween(-nx, nx - 1)
    wy = Window.partitionBy(*keys, "x").orderBy("y").rowsBetween(-ny, ny - 1)
    rows = pixels.withColumn("_s", F.sum("v").over(wx)).withColumn("_n", F.count("v").over(wx))
    return rows.withColumn("v", F.sum("_s").over(wy) / F.sum("_n").over(wy)).drop("_s", "_n")


def trim_border(pixels: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """The pixels between the first and last rows and columns whose sums of magnitudes exceed the threshold, moved to the origin."""
    rows = pixels.groupBy(*keys, "y").agg(F.sum(F.abs("v")).alias("s")).where(F.col("s") > threshold).groupBy(*keys).agg(F.min("y").alias("y0"), F.max("y").alias("y1"))
    cols = pixels.groupBy(*keys, "x").agg(F.sum(F.abs("v")).alias("s")).where(F.col("s") > threshold).groupBy(*keys).agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    box = rows.join(cols, keys)
    inside = (F.col("y") >= F.col("y0")) & (F.col("y") <= F.col("y1")) & (F.col("x") >= F.col("x0")) & (F.col("x") <= F.col("x1"))
    return pixels.join(box, keys).where(inside).select(*keys, (F.col("y") - F.col("y0")).alias("y"), (F.col("x") - F.col("x0")).alias("x"), "v")


def bilinear(points: DataFrame, pixels: DataFrame, keys: list[str], missing: float | None = None) -> DataFrame:
    """Value at real (y, x) by four equi-joins on the floor indexes, as one: each point asks for its corners with weights."""
    fy, fx = F.floor("y"), F.floor("x")
    ty, tx = F.col("y") - fy, F.col("x") - fx
    corner = F.array(*[F.struct((fy + i).cast("int").alias("cy"), (fx + j).cast("int").alias("cx"), ((ty if i else 1 - ty) * (tx if j else 1 - tx)).alias("w")) for i in (0, 1) for j in (0, 1)])
    asked = points.select("*", F.explode(corner).alias("c")).select(*points.columns, F.col("c.cy").alias("cy"), F.col("c.cx").alias("cx"), F.col("c.w").alias("w")).where("w > 0")
    grid = pixels.select(*keys, F.col("y").alias("cy"), F.col("x").alias("cx"), "v")
    out = asked.join(grid, [*keys, "cy", "cx"], "left").groupBy(*points.columns).agg(F.sum(F.col("w") * F.col("v")).alias("s"), F.sum(F.when(F.col("v").isNotNull(), F.col("w"))).alias("ws"))
    return out.withColumn("v", F.when(F.abs(F.col("ws") - 1) < 1e-9, F.col("s")).otherwise(F.lit(missing))).drop("s", "ws")
