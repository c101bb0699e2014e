"""Queries over 8 x 8 frames: stacking, statistics, calibration, geometry, fills and mosaics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays, geometry
from ..operators import calibrate, fill, matching, mosaic, stack, stats
from ..sources.tables import frames, pixels

PX = "px AS (SELECT label AS channel, vec_id AS frame_no, unnest(range(64)) AS pos, 1 + unnest(embedding)::DOUBLE AS v FROM embeddings)"
YX = "yx AS (SELECT channel, frame_no, pos, (pos // 8)::INT AS y, (pos % 8)::INT AS x, v FROM px)"
FR = "fr AS (SELECT label AS channel, vec_id AS frame_no, list_transform(embedding, lambda e: 1 + e::DOUBLE) AS px FROM embeddings)"
CHECKED = """m AS (SELECT channel, frame_no, list_sum(px) / len(px) AS mean FROM fr),
n AS (SELECT *, lag(mean) OVER w AS b, lead(mean) OVER w AS a, lag(mean, 2) OVER w AS b2, lead(mean, 2) OVER w AS a2,
      list(mean) OVER (PARTITION BY channel) AS everything FROM m WINDOW w AS (PARTITION BY channel ORDER BY frame_no)),
k AS (SELECT channel, frame_no, mean,
      CASE WHEN coalesce(b, a2) IS NULL OR coalesce(a, b2) IS NULL THEN (mean + coalesce(b, a, mean)) / 2
           ELSE list_sort([coalesce(b, a2), mean, coalesce(a, b2)])[2] END AS med,
      list_sort(everything)[len(everything) // 2 + 1] AS g FROM n),
ok AS (SELECT channel, frame_no, mean, abs(med - mean) <= 0.0175 * g AS accepted FROM k)"""

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r(c, n: int = 6):
    return F.round(c, n)


@query(f"WITH {PX} SELECT channel, pos::INT AS pos, round(avg(v), 6) AS mean, count(*) AS n_frames FROM px GROUP BY ALL")
def stack_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stack.sum_frames(pixels(frames(spark, sf_dir))).withColumn("mean", r("mean"))


@query(f"WITH {FR}, {CHECKED} SELECT channel, frame_no, round(mean, 6) AS mean, accepted FROM ok")
def frame_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stack.check_frames(frames(spark, sf_dir)).withColumn("mean", r("mean"))


@query(f"WITH {FR}, {PX}, {CHECKED} SELECT channel, pos::INT AS pos, round(avg(v), 6) AS mean, count(*) AS n_frames FROM px JOIN ok USING (channel, frame_no) WHERE accepted GROUP BY ALL")
def stack_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stack.stack_checked(frames(spark, sf_dir), pixels).withColumn("mean", r("mean"))


_STATS = ("min", "max", "sum", "mean", "norm", "sqr_sum", "rms", "stddev", "stddev_sample", "median")


@query(f"""WITH {PX} SELECT channel, frame_no, round(min(v), 6) AS min, round(max(v), 6) AS max, round(sum(v), 6) AS sum, round(avg(v), 6) AS mean, round(sum(abs(v)), 6) AS norm,
round(sum(v * v), 6) AS sqr_sum, round(sqrt(avg(v * v)), 6) AS rms, round(stddev_pop(v), 6) AS stddev, round(stddev_samp(v), 6) AS stddev_sample, round(median(v), 6) AS median,
false AS has_infinity FROM px GROUP BY ALL""")
def frame_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = frames(spark, sf_dir).select("channel", "frame_no", stats.frame_stats(F.col("px")).alias("s"))
    return out.select("channel", "frame_no", *[r(f"s.{c}").alias(c) for c in _STATS], F.col("s.has_infinity").alias("has_infinity"))


@query(f"""WITH {PX}, f AS (SELECT channel, frame_no, avg(v) AS mean, median(v) AS med FROM px GROUP BY ALL)
SELECT channel, round(max(mean), 6) AS max_mean, round(max(med), 6) AS max_median, round(median(med), 6) AS median_median, round(median(mean), 6) AS median_mean FROM f GROUP BY channel""")
def norm_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).select("channel", stats.mean(F.col("px")).alias("mean"), stats.array_median(F.col("px")).alias("med"))
    return f.groupBy("channel").agg(r(F.max("mean")).alias("max_mean"), r(F.max("med")).alias("max_median"), r(F.median("med")).alias("median_median"), r(F.median("mean")).alias("median_mean"))


@query(f"""WITH {PX}, i AS (SELECT channel, pos, avg(v) AS m FROM px GROUP BY ALL), c AS (SELECT *, avg(m) OVER (PARTITION BY channel) AS l FROM i)
SELECT px.channel, frame_no, px.pos::INT AS pos, round((v - m / 10) * CASE WHEN abs(m) > 1e-6 THEN l / m ELSE 0 END, 6) AS v FROM px JOIN c ON px.channel = c.channel AND px.pos = c.pos""")
def calibrate_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    return pixels(calibrate.calibrate(f, calibrate.dark_and_gain(f, pixels))).select("channel", "frame_no", "pos", r("v").alias("v"))


@query(f"""WITH {FR}, g AS (SELECT a.channel, a.frame_no, a.px AS p, b.px AS q FROM fr a JOIN fr b ON b.frame_no = a.frame_no + 1)
SELECT channel, frame_no, list_transform(range(1, 65), lambda i: round(CASE WHEN abs(q[i] - 1) > 0.01 THEN p[i] / (q[i] - 1) ELSE 0 END, 4)) AS divided,
list_transform(range(1, 65), lambda i: round(p[i] + 0.25 * q[i], 6)) AS added,
round(list_sum(list_transform(range(1, 65), lambda i: (p[i] - q[i]) ** 2)) / 64, 6) AS chisq FROM g""")
def array_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    nxt = f.select((F.col("frame_no") - 1).alias("frame_no"), F.col("px").alias("q"))
    rounded = lambda c, n: F.transform(c, lambda v: F.round(v, n))
    return f.join(nxt, "frame_no").select(
        "channel", "frame_no", rounded(arrays.safe_divide(F.col("px"), arrays.scalar(F.col("q"), lambda v: v - 1), 0.01), 4).alias("divided"),
        rounded(arrays.weighted_add(F.col("px"), F.col("q"), 0.25), 6).alias("added"), r(stats.chi_square(F.col("px"), F.col("q"))).alias("chisq"))


@query(f"""WITH {PX}, {YX} SELECT frame_no, y - 1 AS y, 6 - x AS x, round(v, 6) AS v FROM yx WHERE y BETWEEN 1 AND 5 AND x BETWEEN 2 AND 6""")
def clip_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).select("frame_no", F.posexplode(arrays.clip(F.col("px"), 8, (7, 3, 2, 6))).alias("pos", "v"))
    return f.select("frame_no", F.floor(F.col("pos") / 5).cast("int").alias("y"), (F.col("pos") % 5).alias("x"), r("v").alias("v"))


@query(f"""WITH {PX}, {YX}, t AS (SELECT frame_no, y, x, v - 1 AS v FROM yx), a AS (SELECT frame_no, min(y) AS y0, max(y) AS y1 FROM (SELECT frame_no, y, sum(abs(v)) AS s FROM t GROUP BY ALL) WHERE s > 0.9 GROUP BY ALL),
b AS (SELECT frame_no, min(x) AS x0, max(x) AS x1 FROM (SELECT frame_no, x, sum(abs(v)) AS s FROM t GROUP BY ALL) WHERE s > 0.9 GROUP BY ALL)
SELECT t.frame_no, y - y0 AS y, x - x0 AS x, round(v, 6) AS v FROM t JOIN a USING (frame_no) JOIN b USING (frame_no) WHERE y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1""")
def trim_border(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels(frames(spark, sf_dir)).select("frame_no", "y", "x", (F.col("v") - 1).alias("v"))
    return fill.trim_border(p, ["frame_no"], 0.9).withColumn("v", r("v"))


@query(f"""WITH {PX}, {YX}, s AS (SELECT frame_no, y, x, CASE WHEN v < 0.93 THEN 0 ELSE v END AS v FROM yx), h AS (
SELECT a.frame_no, a.y, a.x, sum(b.v / pow((a.y - b.y) ** 2 + (a.x - b.x) ** 2 + 4, 2)) / sum(1 / pow((a.y - b.y) ** 2 + (a.x - b.x) ** 2 + 4, 2)) AS filled
FROM s a JOIN s b ON a.frame_no = b.frame_no AND abs(a.y - b.y) <= 3 AND abs(a.x - b.x) <= 3 WHERE a.v <= 0.001 AND b.v > 0.001 GROUP BY ALL)
SELECT s.frame_no, s.y, s.x, round(CASE WHEN s.v <= 0.001 THEN coalesce(filled, 0) ELSE s.v END, 6) AS v FROM s LEFT JOIN h USING (frame_no, y, x)""")
def idw_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels(frames(spark, sf_dir)).select("frame_no", "y", "x", F.when(F.col("v") < 0.93, 0.0).otherwise(F.col("v")).alias("v"))
    return fill.inverse_distance_fill(p, ["frame_no"], reach=3).withColumn("v", r("v"))


@query(f"""WITH {PX}, {YX}, s AS (SELECT frame_no, y, x, CASE WHEN v < 0.9 THEN 0 ELSE v END AS v FROM yx), g AS (SELECT *, CASE WHEN v > 0 THEN v END AS o FROM s),
w AS (SELECT *, lag(o) OVER w AS l1, lag(o, 2) OVER w AS l2, lead(o) OVER w AS r1, lead(o, 2) OVER w AS r2 FROM g WINDOW w AS (PARTITION BY frame_no, y ORDER BY x)), h AS (
SELECT a.frame_no, a.y, a.x, sum(b.v / pow((a.y - b.y) ** 2 + (a.x - b.x) ** 2 + 4, 2)) / sum(1 / pow((a.y - b.y) ** 2 + (a.x - b.x) ** 2 + 4, 2)) AS near
FROM s a JOIN s b ON a.frame_no = b.frame_no WHERE a.v <= 0.001 AND b.v > 0.001 GROUP BY ALL)
SELECT w.frame_no, w.y, w.x, round(v, 6) AS v, round(CASE WHEN v <= 0.001 THEN coalesce((l1 + r1) / 2, (l2 + 2 * r1) / 3, (2 * l1 + r2) / 3, near) END, 6) AS filled FROM w LEFT JOIN h USING (frame_no, y, x)""")
def horint_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels(frames(spark, sf_dir)).select("frame_no", "y", "x", F.when(F.col("v") < 0.9, 0.0).otherwise(F.col("v")).alias("v"))
    return fill.horizontal_fill(p, ["frame_no"]).select("frame_no", "y", "x", r("v").alias("v"), r("filled").alias("filled"))


@query(f"""WITH {PX}, {YX} SELECT a.frame_no, a.y, a.x, round(avg(b.v), 6) AS v FROM yx a JOIN yx b ON a.frame_no = b.frame_no AND b.y >= a.y - 2 AND b.y < a.y + 2 AND b.x >= a.x - 2 AND b.x < a.x + 2 GROUP BY ALL""")
def box_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill.box_smooth(pixels(frames(spark, sf_dir)).select("frame_no", "y", "x", "v"), ["frame_no"], 2, 2).select("frame_no", "y", "x", r("v").alias("v"))


@query(f"""WITH {PX}, {YX}, s AS (SELECT frame_no, avg(y) AS my, avg(x) AS mx, avg(v) AS c, var_pop(y) AS yy, var_pop(x) AS xx, covar_pop(y, x) AS yx, covar_pop(y, v) AS yv, covar_pop(x, v) AS xv, var_pop(v) AS vv, count(*) AS n FROM yx GROUP BY ALL),
f AS (SELECT *, (yv * xx - xv * yx) / (yy * xx - yx * yx) AS a, (xv * yy - yv * yx) / (yy * xx - yx * yx) AS b FROM s)
SELECT frame_no, n, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c, round(vv - a * yv - b * xv, 6) AS chisq FROM f""")
def plane_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.plane_fit(pixels(frames(spark, sf_dir)), ["frame_no"])
    return out.select("frame_no", "n", *[r(c).alias(c) for c in ("a", "b", "c", "chisq")])


@query(f"""WITH {PX}, {YX}, d AS (SELECT i, CASE WHEN least(i, 7 - i) - 1 < 0 THEN 0 WHEN least(i, 7 - i) - 1 >= 2 THEN 1 ELSE 0.5 - 0.5 * cos(pi() * (least(i, 7 - i)) / 3) END AS w FROM (SELECT unnest(range(8)) AS i)),
t AS (SELECT channel, y + 5 * ((frame_no // 4) % 4) AS y, x + 5 * (frame_no % 4) AS x, v, a.w * b.w AS w FROM yx JOIN d a ON a.i = y JOIN d b ON b.i = x)
SELECT channel, y::INT AS y, x::INT AS x, round(CASE WHEN sum(w) > 1e-6 THEN sum(w * v) / sum(w) ELSE sum(v) END, 6) AS v, round(sum(w), 6) AS w FROM t GROUP BY channel, y, x""")
def mosaic_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    margin, blend = mosaic.tile_weights(8)
    p = pixels(frames(spark, sf_dir))
    tiles = p.select("channel", (F.col("y") + 5 * (F.floor(F.col("frame_no") / 4) % 4)).cast("int").alias("y"), (F.col("x") + 5 * (F.col("frame_no") % 4)).cast("int").alias("x"), "v",
                     (mosaic.ramp(F.col("y"), 8, margin, blend) * mosaic.ramp(F.col("x"), 8, margin, blend)).alias("weight"))
    return mosaic.mosaic(tiles, ["channel"]).select("channel", "y", "x", r("v").alias("v"), r("w").alias("w"))


@query("""WITH s AS (SELECT unnest([8, 28, 49, 70, 91]) AS c, unnest(range(5)) AS i) SELECT (a.i * 5 + b.i)::INT AS patch_id, a.i::INT AS iy, b.i::INT AS ix, a.c::INT AS cy, b.c::INT AS cx,
(a.c - 16)::INT AS y0, (b.c - 16)::INT AS x0, (a.c + 15)::INT AS y1, (b.c + 15)::INT AS x1 FROM s a, s b""")
def patch_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mosaic.patch_grid(spark, (8, 8), (91, 91), 32, 8)


@query(f"""WITH {FR}, p AS (SELECT unnest(range(4)) AS patch_id), c AS (SELECT patch_id, frame_no, px, 4 * (patch_id // 2) AS y0, 4 * (patch_id % 2) AS x0 FROM fr, p)
SELECT patch_id::INT AS patch_id, frame_no, list_transform(range(16), lambda i: round(px[(y0 + i // 4) * 8 + x0 + i % 4 + 1], 6)) AS px FROM c""")
def patch_cutouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = spark.createDataFrame([(k, 4 * (k // 2), 4 * (k % 2), 4 * (k // 2) + 3, 4 * (k % 2) + 3) for k in range(4)], "patch_id int, y0 int, x0 int, y1 int, x1 int")
    return mosaic.cutouts(frames(spark, sf_dir), grid, 8).select("patch_id", "frame_no", F.transform("px", lambda v: F.round(v, 6)).alias("px"))


@query(f"""WITH {FR}, d AS (SELECT a.channel, a.frame_no, b.frame_no AS other, list_sum(list_transform(range(1, 65), lambda i: (a.px[i] - b.px[i]) ** 2)) AS d FROM fr a JOIN fr b ON a.channel = b.channel AND a.frame_no % 20 = 0 AND a.frame_no <> b.frame_no)
SELECT frame_no, arg_min(other, (d, other)) AS other, round(min(d), 6) AS d FROM d GROUP BY frame_no""")
def nearest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    a = f.where("frame_no % 20 = 0").select("channel", "frame_no", F.col("px").alias("p"))
    b = f.select("channel", F.col("frame_no").alias("other"), F.col("px").alias("q"))
    return matching.nearest_vectors(a, b, ["channel"], "frame_no", "other", "p", "q").select("frame_no", "other", r("d").alias("d"))


@query(f"""WITH {PX}, {YX} SELECT frame_no, y, x, round((1.02 * x + 0.01 * y + 0.3) / (0.001 * x + 0.002 * y + 1), 6) AS px, round((-0.015 * x + 0.98 * y - 0.2) / (0.001 * x + 0.002 * y + 1), 6) AS py,
round((0.1 + 0.9 * x + 0.02 * y * y + 0.003 * x * x * y)::DOUBLE, 6) AS wx, round((-0.2 + 1.1 * y + 0.01 * x * y)::DOUBLE, 6) AS wy FROM yx""")
def project_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels(frames(spark, sf_dir))
    x, y = geometry.project((1.02, 0.01, 0.3, -0.015, 0.98, -0.2, 0.001, 0.002, 1.0), F.col("x"), F.col("y"))
    a, b = [0.0] * 16, [0.0] * 16
    a[0], a[4], a[2], a[9] = 0.1, 0.9, 0.02, 0.003
    b[0], b[1], b[5] = -0.2, 1.1, 0.01
    wx, wy = geometry.warp(a, b, F.col("x"), F.col("y"))
    return p.select("frame_no", "y", "x", r(x).alias("px"), r(y).alias("py"), r(wx).alias("wx"), r(wy).alias("wy"))


@query(f"""WITH {PX}, {YX}, p AS (SELECT frame_no, y, x, least(y + 0.25, 7)::DOUBLE AS qy, least(x + 0.75, 7)::DOUBLE AS qx FROM yx), c AS (
SELECT p.frame_no, p.y, p.x, sum((1 - abs(qy - b.y)) * (1 - abs(qx - b.x)) * b.v) AS v FROM p JOIN yx b ON p.frame_no = b.frame_no AND abs(qy - b.y) < 1 AND abs(qx - b.x) < 1 GROUP BY ALL)
SELECT frame_no, y, x, round(v, 6) AS v FROM c""")
def interpolate_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels(frames(spark, sf_dir))
    asked = p.select("frame_no", F.col("y").alias("iy"), F.col("x").alias("ix"), F.least(F.col("y") + 0.25, F.lit(7.0)).alias("y"), F.least(F.col("x") + 0.75, F.lit(7.0)).alias("x"))
    return fill.bilinear(asked, p, ["frame_no"]).select("frame_no", F.col("iy").alias("y"), F.col("ix").alias("x"), r("v").alias("v"))


@query(f"""WITH {PX}, {YX}, s AS (SELECT frame_no, x, sqrt(sum(v * v)) AS s FROM yx GROUP BY ALL) SELECT yx.frame_no, y, yx.x, round(v / s, 6) AS v FROM yx JOIN s ON yx.frame_no = s.frame_no AND yx.x = s.x""")
def normalize_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.normalize_columns(pixels(frames(spark, sf_dir)), ["frame_no", "x"]).select("frame_no", "y", "x", r("v").alias("v"))


@query(f"""WITH {FR} SELECT frame_no, list_transform(range(64), lambda i: round(px[(i % 8) * 8 + i // 8 + 1], 6)) AS transposed, list_transform(range(64), lambda i: round(px[(i // 8) * 8 + 7 - i % 8 + 1], 6)) AS mirrored,
list_bool_and(list_transform(px, lambda v: v = 0)) AS all_zero, list_bool_and(list_transform(px, lambda v: abs(v) < 1.5)) AS all_smaller FROM fr""")
def array_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = lambda c: F.transform(c, lambda v: F.round(v, 6))
    px = F.col("px")
    return frames(spark, sf_dir).select("frame_no", rounded(arrays.transpose(px, 8, 8)).alias("transposed"), rounded(arrays.reverse_x(px, 8, 8)).alias("mirrored"),
                                        arrays.all_zero(px).alias("all_zero"), arrays.all_smaller(px, 1.5).alias("all_smaller"))


@query(f"""WITH {PX}, m AS (SELECT channel, frame_no, avg(v) AS m FROM px GROUP BY ALL) SELECT channel, frame_no, rank::BIGINT AS rank, round(m, 6) AS mean FROM (
SELECT *, row_number() OVER (PARTITION BY channel ORDER BY m DESC, frame_no) AS rank FROM m) WHERE rank <= 3""")
def brightest_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = frames(spark, sf_dir).select("channel", "frame_no", stats.mean(F.col("px")).alias("mean"))
    w = Window.partitionBy("channel").orderBy(F.desc("mean"), "frame_no")
    return m.withColumn("rank", F.row_number().over(w).cast("bigint")).where("rank <= 3").withColumn("mean", r("mean"))
