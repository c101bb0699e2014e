"""Profiles, windows, unit conversions and indexes as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ARCSEC = math.pi / 648000.0


def apodize_ramp(i: Column, n: int) -> Column:
    """Cosine rise from near 0 to near 1 over n samples."""
    return 0.5 - 0.5 * F.cos(F.lit(math.pi) * (i + 1) / (n + 1))


def gauss(x: Column, fwhm: float, centre: float = 0.0) -> Column:
    s = fwhm / (2.0 * math.sqrt(2.0 * math.log(2.0)))
    return F.exp(-((x - centre) * (x - centre)) / (2.0 * s * s))


def gauss2d(y: Column, x: Column, fwhm_y: float, fwhm_x: float, cy: float = 0.0, cx: float = 0.0) -> Column:
    return gauss(y, fwhm_y, cy) * gauss(x, fwhm_x, cx)


def lorentz(x: Column, fwhm: float, centre: float = 0.0, cavities: float = 1.0) -> Column:
    """Lorentz profile of height 1; more cavities make the flat-topped profile of a prefilter."""
    d2 = (x - centre) * (x - centre) * (4.0 / (fwhm * fwhm))
    return 1.0 / ((d2 if cavities == 1.0 else F.pow(d2, F.lit(cavities))) + 1.0)


def cauchy(x: Column, fwhm: float, centre: float = 0.0) -> Column:
    """Lorentz profile of unit area."""
    return lorentz(x, fwhm, centre) * (2.0 / (math.pi * fwhm))


def apodize(first: float, target: float, i: Column, n: int) -> Column:
    """Cosine passage from the first value to the target over n samples."""
    return 0.5 * (first + target) + 0.5 * (first - target) * F.cos(F.lit(math.pi) * i / (n - 1))


def hann(i: Column, n: int) -> Column:
    """Rise from 0 to 1 over n samples."""
    return 0.5 - 0.5 * F.cos(F.lit(math.pi) * i / (n - 1))


def n_choose_k(n: Column, k: Column) -> Column:
    """Exact for results below 2**63, as products of one factor at a time."""
    kk = F.least(k, n - k)
    product = F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.greatest(kk, F.lit(1)).cast("bigint")), F.lit(1).cast("decimal(38,0)"), lambda a, i: F.floor(a * (n - kk + i) / i).cast("decimal(38,0)"))
    return F.when((k < 0) | (k > n), F.lit(0).cast("decimal(38,0)")).when(kk == 0, F.lit(1).cast("decimal(38,0)")).otherwise(product).cast("bigint")


def almost_equal(a: Column, b: Column, relative: float = 4 * 2.0**-52) -> Column:
    """Equal to a few units in the last place."""
    return (a == b) | (F.abs(a - b) <= relative * F.greatest(F.abs(a), F.abs(b)))


def pix2cf(arcsec_per_pixel: float, diameter: float) -> float:
    """Pixels of image motion to tilt coefficient."""
    return math.pi * ARCSEC * arcsec_per_pixel * diameter


def cf2pix(arcsec_per_pixel: float, diameter: float) -> float:
    return 1.0 / pix2cf(arcsec_per_pixel, diameter)


def def2cf(ratio: float) -> float:
    """Defocus in metres to coefficient, for an aperture ratio: -pi r**2 / (8 sqrt 3)."""
    return -math.pi * ratio * ratio / (8.0 * math.sqrt(3.0))


def cf2def(ratio: float) -> float:
    return 1.0 / def2cf(ratio)


def noll_n(j: Column) -> Column:
    """Radial order of Noll index j (from 1)."""
    return F.floor((F.sqrt(8.0 * j - 7.0) - 1.0) / 2.0).cast("int")


def noll_m(j: Column) -> Column:
    """Azimuthal order, signed: even j are cosines (positive), odd j sines."""
    n = noll_n(j)
    k = j - n * (n + 1) / 2
    size = (n % 2) + 2 * F.floor((k - 1 + (n + 1) % 2) / 2)
    return F.when(j % 2 == 0, size).otherwise(-size).cast("int")


def noll_j(n: Column, m: Column) -> Column:
    """Noll index of (n, m); the inverse of ``noll_n``, ``noll_m``."""
    base = n * (n + 1) / 2
    size = F.abs(m)
    even_first = (n * (n + 1) / 2 + size) % 2 == 0
    low = base + size
    return F.when(m == 0, base + 1).when((m > 0) == even_first, low).otherwise(low + 1).cast("int")


def mandelbrot(x0: Column, y0: Column, most: int) -> Column:
    """Iterations until |z| > 2, at most ``most``."""
    def step(s: Column, _: Column) -> Column:
        x2, y2 = s["x"] * s["x"], s["y"] * s["y"]
        on = (s["live"]) & (x2 + y2 <= 4.0)
        return F.struct(F.when(on, x2 - y2 + x0).otherwise(s["x"]).alias("x"), F.when(on, 2.0 * s["x"] * s["y"] + y0).otherwise(s["y"]).alias("y"), (s["n"] + on.cast("int")).alias("n"), on.alias("live"))

    zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0).alias("n"), F.lit(True).alias("live"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), zero, step, lambda s: s["n"])
