"""Queries over numpy kernels that SQL can express on small frames: transforms, windows, optics, codecs, linear algebra, frame sums."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernels import fourier, images, linalg, special, zernike
from ..operators import job, mosaic, reconstruct, sums
from ..sources import files
from ..sources.tables import frames, load, pixels, spread
from ..streaming import ingest
from .frames import CHECKED, FR, PX, YX

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def rounded(name: str = "px", n: int = 5):
    return F.transform(name, lambda v: F.round(v, n) + 0.0)


def _mapped(spark: SparkSession, sf_dir: str, kernel, n: int = 5) -> DataFrame:
    return reconstruct.map_images(frames(spark, sf_dir), kernel, 8, 8).select("channel", "frame_no", rounded(n=n).alias("px"))


def _cells(value: str, h: int = 8, w: int = 8, n: int = 5) -> str:
    """An h x w image from an expression in y and x over px (1-based list of 64)."""
    return f"list_transform(range({h * w}), lambda i: round({value.replace('$y', f'(i // {w})').replace('$x', f'(i % {w})')}, {n}) + 0.0) AS px"


@query(f"WITH {FR} SELECT channel, frame_no, {_cells('px[$y * 8 + $x + 1]')} FROM fr")
def fft_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir, lambda a: np.fft.ifft2(np.fft.fft2(a)).real)


_SUM_PSF = "list_sum(list_transform(range(64), lambda k: exp(-((k // 8 - 4) * (k // 8 - 4) + (k % 8 - 4) * (k % 8 - 4)) / 2.0)))"


@query(f"""WITH {FR}, w AS (SELECT {_SUM_PSF} AS total) SELECT channel, frame_no,
{_cells("list_sum(list_transform(range(64), lambda k: px[(($y - (k // 8) + 12) % 8) * 8 + ($x - (k % 8) + 12) % 8 + 1] * exp(-((k // 8 - 4) * (k // 8 - 4) + (k % 8 - 4) * (k % 8 - 4)) / 2.0))) / total")} FROM fr, w""")
def convolve_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    psf = np.outer(*[np.exp(-((np.arange(8) - 4) ** 2) / 2.0)] * 2)
    return _mapped(spark, sf_dir, lambda a: fourier.convolve(a, psf, True))


@query(f"""WITH {FR} SELECT channel, frame_no, {_cells("list_sum(list_transform(range(64), lambda k: px[k + 1] * px[((k // 8 + $y + 4) % 8) * 8 + (k % 8 + $x + 4) % 8 + 1]))")} FROM fr""")
def autocorrelations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir, fourier.autocorrelate)


@query(f"""WITH {PX}, k AS (SELECT ky, kx FROM range(-3, 4) a(ky), range(-3, 4) b(kx) WHERE abs(ky) > 1 AND abs(kx) > 1 AND ky * ky + kx * kx < 16),
s AS (SELECT channel, frame_no, ky, kx, sum(v * cos(2 * pi() * (ky * (pos // 8) + kx * (pos % 8)) / 8)) AS re, sum(v * sin(2 * pi() * (ky * (pos // 8) + kx * (pos % 8)) / 8)) AS im FROM px, k GROUP BY ALL)
SELECT channel, frame_no, round(sqrt(avg(re * re + im * im) / 64), 6) AS noise FROM s GROUP BY ALL""")
def frame_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reconstruct.measure_images(frames(spark, sf_dir), lambda a: fourier.noise(a, 1.0), 8, 8, "noise")
    return out.select("channel", "frame_no", F.round("noise", 6).alias("noise"))


_W = "(CASE WHEN least({0}, 7 - {0}) >= 2 THEN 1 ELSE 0.5 - 0.5 * cos(pi() * (least({0}, 7 - {0}) + 1) / 3) END)"


@query(f"""WITH {FR}, m AS (SELECT *, list_sum(px) / 64 AS m FROM fr) SELECT channel, frame_no, {_cells(f"(px[$y * 8 + $x + 1] - m) * {_W.format('$y')} * {_W.format('$x')} + m")} FROM m""")
def apodized_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir, lambda a: fourier.apodize(a, 2))


_BOX = "list_avg(list_transform(list_filter(range(64), lambda k: k // 8 >= $y - 2 AND k // 8 < $y + 2 AND k % 8 >= $x - 1 AND k % 8 < $x + 1), lambda k: px[k + 1]))"


@query(f"WITH {FR} SELECT channel, frame_no, {_cells(_BOX)} FROM fr")
def half_open_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir, lambda a: fourier.box_smooth(a, 2, 1))


def _bilinear(y: str, x: str) -> str:
    """px at real (y, x) inside the frame."""
    a, b = f"least(floor({y}), 6)::INT", f"least(floor({x}), 6)::INT"
    ty, tx = f"({y} - {a})", f"({x} - {b})"
    at = lambda i, j: f"px[({a} + {i}) * 8 + {b} + {j} + 1]"
    return f"(({at(0, 0)} * (1 - {ty}) + {at(1, 0)} * {ty}) * (1 - {tx}) + ({at(0, 1)} * (1 - {ty}) + {at(1, 1)} * {ty}) * {tx})"


@query(f"WITH {FR} SELECT channel, frame_no, {_cells(_bilinear('($y * 0.5::DOUBLE)', '($x * 0.7::DOUBLE)'), 15, 11)} FROM fr")
def congrid_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir, lambda a: images.congrid(a, 15, 11))


_DEN = "(0.001::DOUBLE * $x + 1)"
_YY, _XX = f"((-0.05::DOUBLE * $x + 0.98::DOUBLE * $y + 0.2) / {_DEN})", f"((0.98::DOUBLE * $x + 0.05::DOUBLE * $y + 0.3) / {_DEN})"


@query(f"WITH {FR} SELECT channel, frame_no, {_cells(f'CASE WHEN {_YY} < 0 OR {_XX} < 0 OR {_YY} > 7 OR {_XX} > 7 THEN 0 ELSE {_bilinear(_YY, _XX)} END')} FROM fr")
def transform_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = np.array([[0.98, 0.05, 0.3], [-0.05, 0.98, 0.2], [0.001, 0.0, 1.0]])
    return _mapped(spark, sf_dir, lambda a: images.transform(a, m))


@query("""WITH j AS (SELECT unnest(range(2, 61)) AS j), n AS (SELECT j, floor((sqrt(8 * j - 7) - 1) / 2)::INT AS n FROM j), k AS (SELECT j, n, j - n * (n + 1) // 2 AS k FROM n),
m AS (SELECT j, n, (CASE WHEN j % 2 = 0 THEN 1 ELSE -1 END * (n % 2 + 2 * ((k - 1 + (n + 1) % 2) // 2)))::INT AS m FROM k)
SELECT j::INT AS j, n, m, round(CASE WHEN (n - abs(m)) % 2 = 0 THEN 1 ELSE -1 END * 2.2698 * (n + 1) * exp(lgamma(n - 5.0 / 6) - 2 * lgamma(17.0 / 6) - lgamma(n + 23.0 / 6)), 8) AS variance FROM m""")
def zernike_variances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(j, *zernike.noll_to_nm(j), round(zernike.covariance(j, j), 8)) for j in range(2, 61)], "j int, n int, m int, variance double")


@query("""WITH g AS (SELECT y, x, (y - 7.5::DOUBLE) / 8 AS v, (x - 7.5::DOUBLE) / 8 AS u FROM range(16) a(y), range(16) b(x))
SELECT j::INT AS j, y::INT AS y, x::INT AS x, round(CASE j WHEN 1 THEN 1 WHEN 2 THEN 2 * u WHEN 3 THEN 2 * v WHEN 4 THEN sqrt(3) * (2 * (u * u + v * v) - 1) WHEN 5 THEN 2 * sqrt(6) * u * v ELSE sqrt(6) * (u * u - v * v) END, 6) + 0.0 AS z FROM g, range(1, 7) c(j)""")
def zernike_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("array<double>")
    def maps(j: pd.Series) -> pd.Series:
        return j.map(lambda k: zernike.zernike(int(k), 16, 8.0).ravel())

    j = spark.range(1, 7).select(F.col("id").cast("int").alias("j")).select("j", F.posexplode(maps("j")).alias("pos", "z"))
    return j.select("j", F.floor(F.col("pos") / 16).cast("int").alias("y"), (F.col("pos") % 16).alias("x"), (F.round("z", 6) + 0.0).alias("z"))


@query("""SELECT p_partkey, round(2 / pi() * (acos(q) - q * sqrt(1 - q * q)) * exp(-0.5 * 6.883877 * pow(q / (0.05 + a), 5.0 / 3)), 8) AS transfer, round(6.883877 * pow(q / (0.05 + a), 5.0 / 3), 5) AS structure
FROM (SELECT p_partkey, (p_partkey % 101) / 100.0::DOUBLE AS q, p_size / 50.0::DOUBLE AS a FROM part)""")
def long_exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("array<double>")
    def both(q: pd.Series, a: pd.Series) -> pd.Series:
        q, a = q.to_numpy(float), a.to_numpy(float)
        return pd.Series(list(np.column_stack((special.long_exposure(q, a), special.structure_function(q, a)))))

    p = spread(load(spark, sf_dir, "part"), "p_partkey").select("p_partkey", both((F.col("p_partkey") % 101) / 100.0, F.col("p_size") / 50.0 + 0.05).alias("v"))
    return p.select("p_partkey", F.round(F.get("v", 0), 8).alias("transfer"), F.round(F.get("v", 1), 5).alias("structure"))


_TYPES = {"u1": ("20 + 60 * (v - 0.5)", 0, 255), "i2": ("v * 1000", -32768, 32767), "i4": ("v * 100000", -(2**31), 2**31 - 1)}


@query(f"""WITH {FR}, k AS (SELECT * FROM (VALUES ('ANA', 'i2', false), ('ANA', 'i4', false), ('ANA', 'f4', false), ('ANA', 'f8', false), ('ANA', 'i2', true), ('ANA', 'i4', true), ('FITS', 'i2', false), ('FITS', 'f4', false), ('FITS', 'i2', true)) t(format, kind, packed))
SELECT channel, frame_no, format, kind, packed, 8::INT AS h, 8::INT AS w, 'frame ' || frame_no AS told,
list_transform(px, lambda v: CASE kind WHEN 'f4' THEN v::FLOAT::DOUBLE WHEN 'f8' THEN v WHEN 'i2' THEN round_even(v * 1000, 0) ELSE round_even(v * 100000, 0) END) AS px FROM fr, k""")
def image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame as the bytes of an ANA or FITS file of several types, raw and compressed, and back."""
    f = spread(frames(spark, sf_dir), "channel", "frame_no").withColumn("h", F.lit(8)).withColumn("w", F.lit(8))
    out = None
    for kind, code, dtype, scale, bits, rice in (("ANA", "i2", "int16", 1e3, None, False), ("ANA", "i4", "int32", 1e5, None, False), ("ANA", "f4", "float32", 1.0, None, False), ("ANA", "f8", "float64", 1.0, None, False),
                                                 ("ANA", "i2", "int16", 1e3, 5, False), ("ANA", "i4", "int32", 1e5, 9, False), ("FITS", "i2", "int16", 1e3, None, False), ("FITS", "f4", "float32", 1.0, None, False), ("FITS", "i2", "int16", 1e3, None, True)):
        text = F.concat(F.lit("HISTORY frame " if kind == "FITS" else "frame "), F.col("frame_no").cast("string"))
        own = files.encoded(f.withColumn("px", F.transform("px", lambda v, s=None: v * scale) if scale != 1.0 else F.col("px")).withColumn("header", text), kind, dtype, bits, rice)
        own = own.select(F.concat_ws("/", "channel", "frame_no", F.lit(code), F.lit(str(bits is not None or rice).lower())).alias("path"), "content")
        out = own if out is None else out.unionAll(own)
    part = lambda i: F.get(F.split("file", "/"), i)
    return files.decoded(out).select(part(0).cast("int").alias("channel"), part(1).cast("bigint").alias("frame_no"), "format", part(2).alias("kind"), (part(3) == "true").alias("packed"), "h", "w",
                                     F.regexp_extract("header", "(frame [0-9]+)", 1).alias("told"), "px")


@query("""WITH m AS (SELECT p_partkey, p_size + 3.0::DOUBLE AS a, p_partkey % 7 - 3.0::DOUBLE AS b, p_partkey % 5 + 1.0::DOUBLE AS c, p_size * -0.5::DOUBLE - 9 AS d, p_retailprice / 101 AS u, p_retailprice / 301 - 2 AS v FROM part)
SELECT p_partkey, round((u * d - b * v) / (a * d - b * c), 6) + 0.0 AS x, round((a * v - c * u) / (a * d - b * c), 6) + 0.0 AS y, round(abs(a * d - b * c), 6) AS det, 2::INT AS rank, round(d / (a * d - b * c), 6) + 0.0 AS inv_a FROM m""")
def linear_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2 x 2 systems solved by elimination, by triangles and by pivoted reflections, which have to agree."""
    @F.pandas_udf("array<double>")
    def solve(v: pd.Series) -> pd.Series:
        if not len(v):
            return v
        rows = np.stack([np.asarray(row, float) for row in v])
        a, b = rows[:, :4].reshape(-1, 2, 2), rows[:, 4:, None]
        x = linalg.gauss_jordan_all(a, b)
        order, low, up = linalg.lu_all(a)
        y = np.linalg.solve(up, np.linalg.solve(low, np.take_along_axis(b, order[:, :, None], axis=1)))
        q, r, columns, rank = linalg.pivoted_qr_all(a)
        z = np.empty(b.shape)
        np.put_along_axis(z, columns[:, :, None], np.linalg.solve(r, q.transpose(0, 2, 1) @ b), axis=1)
        if not (np.allclose(x, y) and np.allclose(x, z)):
            raise ValueError("solvers disagree")
        inverse = linalg.gauss_jordan_all(a, np.tile(np.eye(2), (len(a), 1, 1)))
        return pd.Series(list(np.column_stack((x[:, :, 0], np.abs(up[:, 0, 0] * up[:, 1, 1]), rank, inverse[:, 0, 0]))))

    k, s, p = F.col("p_partkey"), F.col("p_size"), F.col("p_retailprice")
    v = spread(load(spark, sf_dir, "part"), "p_partkey").select("p_partkey", solve(F.array((s + 3.0), (k % 7 - 3.0), (k % 5 + 1.0), (s * -0.5 - 9), p / 101, p / 301 - 2)).alias("v"))
    six = lambda i: F.round(F.get("v", i), 6) + 0.0
    return v.select("p_partkey", six(0).alias("x"), six(1).alias("y"), six(2).alias("det"), F.get("v", 3).cast("int").alias("rank"), six(4).alias("inv_a"))


@query("""SELECT p_partkey, round(a, 4) + 0.0 AS at, round(b, 6) AS least, round(b, 3) AS dxy, round(2 * a, 3) + 0.0 AS dxx, round(3 * 3.0::DOUBLE + 2 * least(1 + k, (3 + k) / 3), 6) AS best
FROM (SELECT p_partkey, p_size / 10.0::DOUBLE - 2 AS a, p_retailprice / 1001 AS b, p_partkey % 6 / 2.0::DOUBLE AS k FROM part)""")
def optima(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bracketed minima of parabolas, central differences, and small linear programmes by both pivot rules."""
    @F.pandas_udf("array<double>")
    def run(a: pd.Series, b: pd.Series, k: pd.Series) -> pd.Series:
        if not len(a):
            return a
        a, b, k = (v.to_numpy(float) for v in (a, b, k))
        f = lambda x: (x - a) ** 2 + b
        at, least = linalg.brent_all(f, *linalg.bracket_all(f, np.zeros(len(a)), np.full(len(a), 0.5)))
        j = linalg.jacobian(lambda v: np.stack([v[0] * v[1], v[0] ** 2 - v[1]]), np.stack([a, b]))
        right = np.column_stack((4.0 + k, 6.0 + k, np.full(len(k), 3.0)))
        best = [linalg.simplex_all(np.array([3.0, 2.0]), np.array([[1.0, 1.0], [1.0, 3.0], [1.0, 0.0]]), right, rule)[1] for rule in ("bland", "dantzig")]
        if (np.abs(best[0] - best[1]) > 1e-9).any():
            raise ValueError("pivot rules disagree")
        return pd.Series(list(np.column_stack((at, least, j[0, :, 0], j[1, :, 0], best[0]))))

    v = spread(load(spark, sf_dir, "part"), "p_partkey").select("p_partkey", run(F.col("p_size") / 10.0 - 2, F.col("p_retailprice") / 1001, F.col("p_partkey") % 6 / 2.0).alias("v"))
    out = lambda i, n: F.round(F.get("v", i), n) + 0.0
    return v.select("p_partkey", out(0, 4).alias("at"), out(1, 6).alias("least"), out(2, 3).alias("dxy"), out(3, 3).alias("dxx"), out(4, 6).alias("best"))


@query(f"WITH {PX}, {YX} SELECT channel, y, x, round(sum(v * (frame_no % 3 + 1) / 6.0), 6) AS v FROM yx GROUP BY ALL")
def grid_mosaics(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = pixels(frames(spark, sf_dir)).withColumn("weight", (F.col("frame_no") % 3 + 1) / 6.0)
    return mosaic.grid_mosaic(tiles, ["channel"]).select("channel", "y", "x", F.round("v", 6).alias("v"))


@query(f"""WITH {FR}, {CHECKED}, {PX}, g AS (SELECT px.*, CASE WHEN pos % 11 = 3 THEN 0 ELSE 1 + pos / 100.0::DOUBLE END AS gain, 0.1::DOUBLE + pos / 1000.0::DOUBLE AS dark FROM px JOIN ok USING (channel, frame_no) WHERE accepted),
c AS (SELECT channel, pos, CASE WHEN max(gain) > 0 THEN avg((v - dark) * gain) END AS m FROM g GROUP BY ALL),
b AS (SELECT a.channel, a.pos, a.m, sum(n.m / ((n.pos // 8 - a.pos // 8) * (n.pos // 8 - a.pos // 8) + (n.pos % 8 - a.pos % 8) * (n.pos % 8 - a.pos % 8))) AS wv, sum(1.0 / ((n.pos // 8 - a.pos // 8) * (n.pos // 8 - a.pos // 8) + (n.pos % 8 - a.pos % 8) * (n.pos % 8 - a.pos % 8))) AS w
      FROM c a JOIN c n ON a.channel = n.channel AND n.m IS NOT NULL AND a.pos != n.pos AND abs(n.pos // 8 - a.pos // 8) <= 2 AND abs(n.pos % 8 - a.pos % 8) <= 2 GROUP BY ALL),
i AS (SELECT channel, list(round(coalesce(m, wv / w), 6) ORDER BY pos) AS px FROM b GROUP BY ALL),
t AS (SELECT channel, count(*) FILTER (accepted) AS n_frames, list(frame_no ORDER BY frame_no) FILTER (NOT accepted) AS discarded, min(frame_no) FILTER (accepted) * 1000000 AS begin_us, max(frame_no) FILTER (accepted) * 1000000 + 500000 AS end_us,
      round(avg(frame_no * 1000000 + 250000) FILTER (accepted), 3) AS mean_us FROM ok GROUP BY ALL)
SELECT channel, n_frames, coalesce(discarded, []) AS discarded, begin_us, end_us, mean_us, px FROM i JOIN t USING (channel)""")
def sum_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded files to checked, calibrated, repaired sums with their times and the frames left out."""
    f = frames(spark, sf_dir).withColumn("h", F.lit(8)).withColumn("w", F.lit(8)).withColumn("header", F.lit(""))
    content = files.encoded(f, "ANA", "float64").select(F.concat_ws("/", "channel", "frame_no").alias("path"), "content")
    part = lambda i: F.get(F.split("file", "/"), i)
    seconds = F.timestamp_seconds("frame_no")
    read = files.decoded(content).select(part(0).cast("int").alias("channel"), part(1).cast("bigint").alias("frame_no"), "h", "w", "px")
    timed = read.withColumn("t_beg", seconds).withColumn("t_end", F.timestamp_micros(F.unix_micros(seconds) + 500_000))
    channels = f.select("channel").distinct()
    i = F.sequence(F.lit(0), F.lit(63))
    calib = channels.select("channel", F.transform(i, lambda p: 0.1 + p / 1000.0).alias("dark"), F.transform(i, lambda p: F.when(p % 11 == 3, 0.0).otherwise(1 + p / 100.0)).alias("gain"))
    out = sums.sum_frames(timed, calib, 8)
    micros = lambda c: F.unix_micros(F.col(c))
    return out.select("channel", "n_frames", "discarded", micros("t_beg").alias("begin_us"), micros("t_end").alias("end_us"), F.round("mean_micros", 3).alias("mean_us"), F.transform("px", lambda v: F.round(v, 6)).alias("px"))


@query(f"""WITH {FR}, {CHECKED}, {PX}, {YX} SELECT channel AS object, y, x, round(avg(v), 6) AS v FROM yx JOIN ok USING (channel, frame_no) WHERE accepted GROUP BY ALL""")
def flatfield_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check, cut into overlapping patches, average each, and blend: where patches agree, the mosaic is the mean image."""
    places = [(k, 2 * (k // 3), 2 * (k % 3)) for k in range(9)]
    patches = spark.createDataFrame([(k, y, x, y + 3, x + 3) for k, y, x in places], "patch_id int, y0 int, x0 int, y1 int, x1 int")
    out = job.mosaics(job.results(frames(spark, sf_dir), patches, 8), 4)
    return out.select("object", "y", "x", F.round("v", 6).alias("v"))


@query(f"""WITH {FR}, {CHECKED}, {PX}, {YX} SELECT channel AS object, y, x, round(avg(v), 6) AS v FROM yx JOIN ok USING (channel, frame_no) WHERE accepted AND channel IN (1, 2, 5) GROUP BY ALL""")
def result_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of a job written, read back for some objects without the parts that a mosaic doesn't need, and blended."""
    places = [(k, 2 * (k // 3), 2 * (k % 3)) for k in range(9)]
    patches = spark.createDataFrame([(k, y, x, y + 3, x + 3) for k, y, x in places], "patch_id int, y0 int, x0 int, y1 int, x1 int")
    folder = ingest.shared_folder(spark)
    made = job.results(frames(spark, sf_dir), patches, 8).withColumn("psf", F.array(F.lit(1.0))).withColumn("metrics", F.array(F.lit(0.5)))
    job.write_results(made, folder, ("img", "psf"))
    out = job.mosaics(job.read_results(spark, folder, ("img",), [1, 2, 5]), 4)
    return out.select("object", "y", "x", F.round("v", 6).alias("v"))
