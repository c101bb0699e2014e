"""Statistics over frames and pixels: two-level aggregates, exact medians, fits.

Per-frame numbers come from array expressions (no shuffle); numbers over many frames
from partial and final hash aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(px: Column) -> Column:
    return F.filter(px, lambda v: ~F.isnan(v) & (F.abs(v) != float("inf")))


def total(px: Column) -> Column:
    return F.aggregate(px, F.lit(0.0), lambda a, v: a + v)


def mean(px: Column) -> Column:
    """NaN for no elements."""
    return F.when(F.size(px) == 0, F.lit(float("nan"))).otherwise(total(px) / F.size(px))


def norm(px: Column) -> Column:
    """Sum of magnitudes."""
    return F.aggregate(px, F.lit(0.0), lambda a, v: a + F.abs(v))


def squares(px: Column) -> Column:
    return F.aggregate(px, F.lit(0.0), lambda a, v: a + v * v)


def array_median(px: Column) -> Column:
    """Exact; the mean of the two middles for an even number of elements."""
    s, n = F.array_sort(px), F.size(px)
    low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return (F.get(s, low) + F.get(s, high)) / 2


def upper_median(values: Column) -> Column:
    """Element number n div 2 of the sorted list (from 0)."""
    s = F.array_sort(values)
    return F.get(s, F.floor(F.size(s) / 2).cast("int"))


def frame_stats(px: Column) -> Column:
    """min, max, sum, mean, norm, sqr_sum, rms, stddev (population), stddev_sample, median, has_infinity of the finite elements."""
    ok, n = finite(px), F.size(finite(px))
    m, ms = total(ok) / n, squares(ok) / n
    var = F.greatest(ms - m * m, F.lit(0.0))
    return F.struct(
        F.array_min(ok).alias("min"), F.array_max(ok).alias("max"), total(ok).alias("sum"), m.alias("mean"), norm(ok).alias("norm"), squares(ok).alias("sqr_sum"),
        F.sqrt(ms).alias("rms"), F.sqrt(var).alias("stddev"), F.when(n > 1, F.sqrt(var * n / (n - 1))).otherwise(F.lit(0.0)).alias("stddev_sample"),
        array_median(ok).alias("median"), (F.size(px) != n).alias("has_infinity"),
    )


def chi_square(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v) / F.size(a)


def chi_square_weighted(a: Column, b: Column, w: Column) -> Column:
    """Squared differences times weight, over the number of weights that aren't 0."""
    d = F.zip_with(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), w, lambda x, y: x * y)
    return F.aggregate(d, F.lit(0.0), lambda s, v: s + v) / F.size(F.filter(w, lambda v: v != 0))


def plane_fit(pixels: DataFrame, keys: list[str], y: str = "y", x: str = "x", v: str = "v") -> DataFrame:
    """Least squares v = a (y - mean y) + b (x - mean x) + c by normal-equation sums; one aggregate, with chisq / n."""
    sums = pixels.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("my"), F.avg(x).alias("mx"), F.avg(v).alias("c"),
        F.var_pop(y).alias("yy"), F.var_pop(x).alias("xx"), F.covar_pop(y, x).alias("yx"), F.covar_pop(y, v).alias("yv"), F.covar_pop(x, v).alias("xv"), F.var_pop(v).alias("vv"),
    )
    det = F.col("yy") * F.col("xx") - F.col("yx") * F.col("yx")
    a = F.when(det != 0, (F.col("yv") * F.col("xx") - F.col("xv") * F.col("yx")) / det)
    b = F.when(det != 0, (F.col("xv") * F.col("yy") - F.col("yv") * F.col("yx")) / det)
    return sums.select(*keys, "n", a.alias("a"), b.alias("b"), "c", (F.col("vv") - a * F.col("yv") - b * F.col("xv")).alias("chisq"))


def plane(a: Column, b: Column, c: Column, h: int, w: int) -> Column:
    """The plane of ``plane_fit`` as an array."""
    return F.transform(F.sequence(F.lit(0), F.lit(h * w - 1)), lambda i: a * (F.floor(i / w) - (h - 1) / 2) + b * (i % w - (w - 1) / 2) + c)


def normalize_columns(pixels: DataFrame, group: list[str], v: str = "v") -> DataFrame:
    """Divide by the root of the sum of squares of each group (a column or row of a matrix)."""
    size = pixels.groupBy(*group).agg(F.sqrt(F.sum(F.col(v) * F.col(v))).alias("_size"))
    return pixels.join(size, group).withColumn(v, F.when(F.col("_size") > 0, F.col(v) / F.col("_size")).otherwise(F.col(v))).drop("_size")
