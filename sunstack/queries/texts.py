"""Queries over job texts, pointing logs, table units and line profiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernels import images, special
from ..operators import reconstruct
from ..plans import config
from ..sources import fits, pointing
from ..sources.tables import frames, load, spread
from .frames import FR
from .kernels import _bilinear, _cells, rounded

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


_JOB = """momfbd {{ NUM_POINTS {points} ; patch
  MODES 2-4,K5-{last}
  TELESCOPE_D 0.97
  object {{ WAVELENGTH {wave} # nm
    ARCSECPERPIX 0.06
    PIXELSIZE 1.6e-05
    channel {{ IMAGE_DATA_DIR /data/cam/ // raw
      FILENAME_TEMPLATE im.%07d.fits
      IMAGE_NUM {first}-{end}
      DIVERSITY 1.5 mm, 0.25 }}
    channel {{ FILENAME_TEMPLATE d.%03d
      IMAGE_NUM {first}
      DT 3 }}
  }}
}}"""


@query("""SELECT p_partkey, 1::INT AS n_objects, 2::INT AS n_channels, round(p_retailprice, 2) AS wavelength, CASE WHEN (p_size + 6) % 4 = 0 THEN 0 ELSE 1 END::INT AS n_problems, (p_size + 6)::BIGINT AS points,
list_transform(range(4), lambda i: '/data/cam/im.' || lpad((p_partkey % 1000 + i)::VARCHAR, 7, '0') || '.fits') AS files, [printf('d.%03d', p_partkey % 1000 + 3)] AS other_files,
list_concat(['Z2', 'Z3', 'Z4'], list_transform(range(5, 8 + p_size % 3), lambda i: 'K' || i)) AS modes, [0.0015::DOUBLE, 0.25::DOUBLE] AS diversity, [true, false] AS physical, round(1.6e-05 * 180 * 3600 / pi() / 0.06, 6) AS focal, 'CHECKED' AS next_step FROM part""")
def job_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configuration text for each row, parsed, bound to its scopes, checked and expanded to files, modes and diversities."""
    schema = ("n_objects int, n_channels int, wavelength double, n_problems int, points bigint, files array<string>, other_files array<string>, modes array<string>, diversity array<double>, physical array<boolean>, focal double, next_step string")

    @F.pandas_udf(schema)
    def parse(text: pd.Series) -> pd.DataFrame:
        rows = []
        for t in text:
            (job,) = config.bind(config.parse_info(t))
            (obj,), (a, b) = job.parts, job.parts[0].parts
            div = config.diversity(str(a["DIVERSITY"]))
            rows.append((len(job.parts), len(obj.parts), float(a["WAVELENGTH"]), len(config.problems(job)), int(b["NUM_POINTS"]), config.image_files(a), config.image_files(b),
                         [f"{k}{n}" for n, k in config.mode_list(str(b["MODES"]))], [v for v, _ in div], [p for _, p in div],
                         config.image_scale(0.0, float(a["ARCSECPERPIX"]), float(a["PIXELSIZE"]))[0], config.next_step("CHECKING")))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])

    values = {"points": F.col("p_size") + 6, "last": 7 + F.col("p_size") % 3, "wave": F.round("p_retailprice", 2), "first": F.col("p_partkey") % 1000, "end": F.col("p_partkey") % 1000 + 3}
    text = F.lit(_JOB.replace("{{", "{").replace("}}", "}"))
    for name, v in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), v.cast("string"))
    p = spread(load(spark, sf_dir, "part"), "p_partkey").select("p_partkey", parse(text).alias("j"))
    return p.select("p_partkey", *[F.round(f"j.{c}", n).alias(c) if (n := {"wavelength": 2, "focal": 6}.get(c)) else F.col(f"j.{c}").alias(c) for c in (x.split()[0] for x in schema.split(", "))])


@query("""SELECT event_id + 0.5::DOUBLE AS t, round(2 * (cos(radians(30)) * value - sin(radians(30)) * user_id), 5) + 0.0 AS x, round(2 * (sin(radians(30)) * value + cos(radians(30)) * user_id), 5) + 0.0 AS y FROM events WHERE event_id % 5 != 4""")
def pointing_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a log, some of them comments or broken, to scaled and rotated positions."""
    i = F.col("event_id")
    good = F.format_string("%s.5 0 0 %s %s 950.0", i, F.col("value").cast("string"), F.col("user_id"))
    lines = load(spark, sf_dir, "events").select(F.when(i % 10 == 4, F.concat(F.lit("# "), good)).when(i % 10 == 9, "12.5 broken line").otherwise(good).alias("value"))
    out = pointing.convert(pointing.parse(lines), "2020-06-01", 1, 2.0, 30.0)
    seconds = (F.unix_micros("time") - F.unix_micros(F.to_timestamp(F.lit("2020-06-01")))) / 1e6
    return out.select(seconds.alias("t"), (F.round("x", 5) + 0.0).alias("x"), (F.round("y", 5) + 0.0).alias("y"))


@query("SELECT n_nationkey, n_name, n_regionkey, 'r' || n_regionkey || ' ' || n_name AS told FROM nation")
def table_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation as an ASCII table unit of a file, and read back."""
    @F.pandas_udf("key string, name string, region string, told string")
    def there_and_back(key: pd.Series, name: pd.Series, region: pd.Series) -> pd.DataFrame:
        def one(k, n, r) -> list[str]:
            columns = {"KEY": [str(k)], "NAME": [n], "REGION": [str(r)], "TOLD": [f"r{r} {n}"]}
            (found,) = fits.tables(fits.encode(None) + fits.encode_table(columns))
            return [found[c][0] for c in columns]

        return pd.DataFrame([one(*row) for row in zip(key, name, region, strict=True)], columns=["key", "name", "region", "told"])

    t = load(spark, sf_dir, "nation").select(there_and_back("n_nationkey", "n_name", "n_regionkey").alias("t"))
    return t.select(F.col("t.key").cast("int").alias("n_nationkey"), F.col("t.name").alias("n_name"), F.col("t.region").cast("int").alias("n_regionkey"), F.col("t.told").alias("told"))


@query("""WITH p AS (SELECT p_partkey, p_size % 12 / 4.0::DOUBLE AS x, 0.5::DOUBLE + (p_partkey % 10) / 5.0::DOUBLE AS a FROM part), y AS (SELECT i * 0.04::DOUBLE - 10 AS y FROM range(501) t(i))
SELECT p_partkey, round(sum(0.04 * a / pi() * exp(-y * y) / ((x - y) * (x - y) + a * a)), 6) AS voigt, round(sum(0.04 / pi() * (x - y) * exp(-y * y) / ((x - y) * (x - y) + a * a)), 6) + 0.0 AS faraday FROM p, y GROUP BY p_partkey""")
def line_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("array<double>")
    def both(x: pd.Series, a: pd.Series) -> pd.Series:
        return pd.Series(list(np.column_stack(special.faraday_voigt(x.to_numpy(float), a.to_numpy(float)))))

    p = spread(load(spark, sf_dir, "part"), "p_partkey").select("p_partkey", both(F.col("p_size") % 12 / 4.0, 0.5 + (F.col("p_partkey") % 10) / 5.0).alias("v"))
    return p.select("p_partkey", F.round(F.get("v", 0), 6).alias("voigt"), (F.round(F.get("v", 1), 6) + 0.0).alias("faraday"))


_PY, _PX = "(0.2::DOUBLE + 0.9::DOUBLE * $y + 0.01::DOUBLE * $x * $y)", "(0.1::DOUBLE + 0.95::DOUBLE * $x + 0.02::DOUBLE * $y)"


@query(f"WITH {FR} SELECT channel, frame_no, {_cells(f'CASE WHEN {_PY} < 0 OR {_PX} < 0 OR {_PY} > 7 OR {_PX} > 7 THEN 0 ELSE {_bilinear(_PY, _PX)} END')} FROM fr")
def polynomial_warps(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, q = np.zeros(16), np.zeros(16)
    p[0], p[4], p[1] = 0.1, 0.95, 0.02
    q[0], q[1], q[5] = 0.2, 0.9, 0.01
    out = reconstruct.map_images(frames(spark, sf_dir), lambda a: images.polynomial_transform(a, p, q), 8, 8)
    return out.select("channel", "frame_no", rounded().alias("px"))
