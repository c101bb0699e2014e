"""Points, regions, intervals, homographies and polynomial warps as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def region(y0: Column, x0: Column, y1: Column, x1: Column) -> Column:
    """An inclusive rectangle; corners may come in either order."""
    return F.struct(F.least(y0, y1).alias("y0"), F.least(x0, x1).alias("x0"), F.greatest(y0, y1).alias("y1"), F.greatest(x0, x1).alias("x1"))


def inside(r: Column, y: Column, x: Column) -> Column:
    return (y >= r["y0"]) & (y <= r["y1"]) & (x >= r["x0"]) & (x <= r["x1"])


def intersect(a: Column, b: Column) -> Column:
    """The common rectangle, or null."""
    out = F.struct(F.greatest(a["y0"], b["y0"]).alias("y0"), F.greatest(a["x0"], b["x0"]).alias("x0"),
                   F.least(a["y1"], b["y1"]).alias("y1"), F.least(a["x1"], b["x1"]).alias("x1"))
    return F.when((out["y0"] <= out["y1"]) & (out["x0"] <= out["x1"]), out)


def enclose(a: Column, b: Column) -> Column:
    return F.struct(F.least(a["y0"], b["y0"]).alias("y0"), F.least(a["x0"], b["x0"]).alias("x0"),
                    F.greatest(a["y1"], b["y1"]).alias("y1"), F.greatest(a["x1"], b["x1"]).alias("x1"))


def grow(r: Column, by: Column | int) -> Column:
    """Move every side out (in for a negative number); null if nothing is left."""
    out = F.struct((r["y0"] - by).alias("y0"), (r["x0"] - by).alias("x0"), (r["y1"] + by).alias("y1"), (r["x1"] + by).alias("x1"))
    return F.when((out["y0"] <= out["y1"]) & (out["x0"] <= out["x1"]), out)


def to_global(r: Column, y: Column, x: Column) -> Column:
    """Local coordinates of a rectangle as coordinates of its frame."""
    return F.struct((r["y0"] + y).alias("y"), (r["x0"] + x).alias("x"))


def area(r: Column) -> Column:
    return (r["y1"] - r["y0"] + 1) * (r["x1"] - r["x0"] + 1)


def interval(lo: Column, hi: Column, lo_in: bool = True, hi_in: bool = True) -> Column:
    return F.struct(lo.alias("lo"), hi.alias("hi"), F.lit(lo_in).alias("lo_in"), F.lit(hi_in).alias("hi_in"))


def contains(i: Column, v: Column) -> Column:
    return ((v > i["lo"]) | (i["lo_in"] & (v == i["lo"]))) & ((v < i["hi"]) | (i["hi_in"] & (v == i["hi"])))


def overlaps(a: Column, b: Column) -> Column:
    touch_1, touch_2 = a["hi_in"] & b["lo_in"], b["hi_in"] & a["lo_in"]
    return ((a["hi"] > b["lo"]) | (touch_1 & (a["hi"] == b["lo"]))) & ((b["hi"] > a["lo"]) | (touch_2 & (b["hi"] == a["lo"])))


def common(a: Column, b: Column) -> Column:
    """The common interval; disjoint intervals are an error."""
    lo, hi = F.greatest(a["lo"], b["lo"]), F.least(a["hi"], b["hi"])
    out = F.struct(lo.alias("lo"), hi.alias("hi"),
                   (~((lo == a["lo"]) & ~a["lo_in"]) & ~((lo == b["lo"]) & ~b["lo_in"])).alias("lo_in"),
                   (~((hi == a["hi"]) & ~a["hi_in"]) & ~((hi == b["hi"]) & ~b["hi_in"])).alias("hi_in"))
    return F.when(overlaps(a, b), out).otherwise(F.raise_error(F.lit("disjoint intervals")).cast("struct<lo:double,hi:double,lo_in:boolean,hi_in:boolean>"))


def joined(a: Column, b: Column) -> Column:
    """The hull of two intervals that overlap; disjoint ones are an error."""
    out = F.struct(F.least(a["lo"], b["lo"]).alias("lo"), F.greatest(a["hi"], b["hi"]).alias("hi"),
                   F.when(a["lo"] == b["lo"], a["lo_in"] | b["lo_in"]).when(a["lo"] < b["lo"], a["lo_in"]).otherwise(b["lo_in"]).alias("lo_in"),
                   F.when(a["hi"] == b["hi"], a["hi_in"] | b["hi_in"]).when(a["hi"] > b["hi"], a["hi_in"]).otherwise(b["hi_in"]).alias("hi_in"))
    return F.when(overlaps(a, b), out).otherwise(F.raise_error(F.lit("disjoint intervals")).cast("struct<lo:double,hi:double,lo_in:boolean,hi_in:boolean>"))


def project(m: Sequence[float], x: Column, y: Column) -> tuple[Column, Column]:
    """A point through a 3 x 3 homography given by rows."""
    d = m[6] * x + m[7] * y + m[8]
    return (m[0] * x + m[1] * y + m[2]) / d, (m[3] * x + m[4] * y + m[5]) / d


def warp(p: Sequence[float], q: Sequence[float], x: Column, y: Column) -> tuple[Column, Column]:
    """A point through two 4 x 4 polynomials: the sum over j, k of p[4 j + k] x**j y**k; without coefficients unchanged."""
    if len(p) != 16 or len(q) != 16:
        return x, y

    def total(c: Sequence[float]) -> Column:
        powers = lambda v: [F.lit(1.0), v, v * v, v * v * v]
        px, py = powers(x), powers(y)
        out = F.lit(0.0)
        for j in range(4):
            for k in range(4):
                if c[4 * j + k]:
                    out = out + c[4 * j + k] * px[j] * py[k]
        return out

    return total(p), total(q)


def map_is_flipped(m: Sequence[float]) -> tuple[bool, bool]:
    """Whether a homography turns x, y around."""
    return m[0] < 0, m[4] < 0


def cut_geometry(cy: Column, cx: Column, off_y: Column, off_x: Column, half: int) -> Column:
    """Whole-pixel cut around a shifted centre, and the rest of the shift below a pixel."""
    y, x = cy + off_y, cx + off_x
    iy, ix = F.round(y), F.round(x)
    return F.struct((iy - half).cast("int").alias("y0"), (ix - half).cast("int").alias("x0"), (iy + half - 1).cast("int").alias("y1"), (ix + half - 1).cast("int").alias("x1"),
                    (y - iy).alias("rest_y"), (x - ix).alias("rest_x"))


def point(y: Column, x: Column) -> Column:
    return F.struct(y.alias("y"), x.alias("x"))


def add(a: Column, b: Column) -> Column:
    return point(a["y"] + b["y"], a["x"] + b["x"])


def subtract(a: Column, b: Column) -> Column:
    return point(a["y"] - b["y"], a["x"] - b["x"])


def scale(a: Column, by: Column | float) -> Column:
    return point(a["y"] * by, a["x"] * by)


def round_point(a: Column) -> Column:
    """The nearest whole point."""
    return point(F.round(a["y"]), F.round(a["x"]))


def rest(a: Column) -> Column:
    """What rounding leaves out."""
    return subtract(a, round_point(a))


def norm(a: Column) -> Column:
    return F.sqrt(a["y"] * a["y"] + a["x"] * a["x"])


def max_norm(a: Column) -> Column:
    return F.greatest(F.abs(a["y"]), F.abs(a["x"]))


def city_norm(a: Column) -> Column:
    return F.abs(a["y"]) + F.abs(a["x"])
