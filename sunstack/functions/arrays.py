"""Array algebra on pixel arrays, as column expressions inside whole-stage code where Spark allows it."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def fill(n: Column | int, value: float) -> Column:
    return F.array_repeat(F.lit(float(value)), n)


def cast(px: Column, kind: str) -> Column:
    return F.transform(px, lambda v: v.cast(kind))


def scalar(px: Column, op: Callable[[Column], Column]) -> Column:
    """Apply op to every element: add, subtract, multiply, divide by a constant and the like."""
    return F.transform(px, op)


def _same(a: Column, b: Column, value: Column) -> Column:
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("arrays differ in size")).cast("array<double>"))


def elementwise(a: Column, b: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Element by element; arrays of different sizes are an error."""
    return _same(a, b, F.zip_with(a, b, op))


def safe_divide(a: Column, b: Column, eps: float = 1e-12) -> Column:
    """a / b, 0 where |b| is not above eps."""
    return F.zip_with(a, b, lambda x, y: F.when(F.abs(y) > eps, x / y).otherwise(F.lit(0.0)))


def weighted_add(a: Column, b: Column, weight: float | Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y * weight)


def weighted_subtract(a: Column, b: Column, weight: float | Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y * weight)


def fill_where(px: Column, value: float, test: Callable[[Column], Column]) -> Column:
    return F.transform(px, lambda v: F.when(test(v), F.lit(value)).otherwise(v))


def all_zero(px: Column) -> Column:
    return F.forall(px, lambda v: v == 0)


def all_smaller(px: Column, limit: float) -> Column:
    return F.forall(px, lambda v: F.abs(v) < limit)


def at(px: Column, w: Column | int, y: Column, x: Column) -> Column:
    """Element (y, x) of a row-major array of width w; null outside."""
    return F.get(px, (y * w + x).cast("int"))


def reverse_x(px: Column, h: int, w: int) -> Column:
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(h - 1)), lambda y: F.reverse(F.slice(px, y * w + 1, w))))


def reverse_y(px: Column, h: int, w: int) -> Column:
    return F.flatten(F.transform(F.sequence(F.lit(h - 1), F.lit(0), F.lit(-1)), lambda y: F.slice(px, y * w + 1, w)))


def transpose(px: Column, h: int, w: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(h * w - 1)), lambda i: F.get(px, ((i % h) * w + F.floor(i / h)).cast("int")))


def crop(px: Column, w: int, y0: int, x0: int, y1: int, x1: int) -> Column:
    """Rows y0..y1 and columns x0..x1, both ends included."""
    return F.flatten(F.transform(F.sequence(F.lit(y0), F.lit(y1)), lambda y: F.slice(px, y * w + x0 + 1, x1 - x0 + 1)))


def shift_view(px: Column, n: Column | int, size: int) -> Column:
    """A window of ``size`` elements that starts n elements in."""
    return F.slice(px, F.lit(n) + 1, size)


def insert(px: Column, h: int, w: int, out_h: int, out_w: int, y0: int, x0: int) -> Column:
    """The array at (y0, x0) of a larger array of zeros."""
    def cell(i: Column) -> Column:
        y, x = F.floor(i / out_w) - y0, i % out_w - x0
        inside = (y >= 0) & (y < h) & (x >= 0) & (x < w)
        return F.when(inside, F.get(px, (y * w + x).cast("int"))).otherwise(F.lit(0.0))

    return F.transform(F.sequence(F.lit(0), F.lit(out_h * out_w - 1)), cell)


def clip_box(clip: tuple[int, int, int, int], symmetric: bool = False) -> tuple[int, int, int, int, bool, bool]:
    """A 1-based clip x1, x2, y1, y2 as 0-based y0, x0, y1, x1 and whether y and x are flipped."""
    x1, x2, y1, y2 = clip
    flip_x, flip_y = x1 > x2, y1 > y2
    x1, x2, y1, y2 = min(x1, x2), max(x1, x2), min(y1, y2), max(y1, y2)
    if symmetric:
        side = min(x2 - x1, y2 - y1)
        x2, y2 = x1 + side, y1 + side
    return y1 - 1, x1 - 1, y2 - 1, x2 - 1, flip_y, flip_x


def clip(px: Column, w: int, box: tuple[int, int, int, int], symmetric: bool = False) -> Column:
    """Clip an image by 1-based x1, x2, y1, y2; a reversed pair flips that axis."""
    y0, x0, y1, x1, flip_y, flip_x = clip_box(box, symmetric)
    out = crop(px, w, y0, x0, y1, x1)
    h, width = y1 - y0 + 1, x1 - x0 + 1
    if flip_y:
        out = reverse_y(out, h, width)
    return reverse_x(out, h, width) if flip_x else out


def restrict(v: Column, low: float, high: float) -> Column:
    """Clamp to [low, high]; the ends may come in either order."""
    a, b = min(low, high), max(low, high)
    return F.greatest(F.least(v, F.lit(b)), F.lit(a))


def restrict_periodic(v: Column, low: float, high: float) -> Column:
    """Wrap into [low, high)."""
    a, b = min(low, high), max(low, high)
    if a == b:
        return F.lit(a) + v * 0
    return F.pmod(v - a, F.lit(b - a)) + a


def restrict_reflected(v: Column, low: float, high: float) -> Column:
    """Reflect at both ends of [low, high]."""
    a, b = min(low, high), max(low, high)
    span = b - a
    if span == 0:
        return F.lit(a) + v * 0
    r = F.pmod(v - a, F.lit(2 * span))
    return F.when(r > span, 2 * span - r).otherwise(r) + a


def saturate(v: Column, kind: str) -> Column:
    """Cast to a narrower integer type, clamped to its range."""
    bits = {"tinyint": 8, "smallint": 16, "int": 32}[kind]
    return F.greatest(F.least(F.round(v), F.lit(float(2 ** (bits - 1) - 1))), F.lit(-float(2 ** (bits - 1)))).cast(kind)


def segment(first: int, last: int, length: int, least_overlap: int) -> list[int]:
    """Start positions of overlapping segments over first..last: evenly spread, truncated, two at least unless first equals last."""
    if first == last:
        return [first]
    first, last = min(first, last), max(first, last)
    step = length - least_overlap
    n = max(2, int(-(-(last - first) // step)) + 1 if step > 0 else 2)
    return [int(first + i * (last - first) / (n - 1)) for i in range(n)]


def bit_count(v: Column) -> Column:
    return F.bit_count(v)


def next_power_of_two(v: Column) -> Column:
    return F.when(v <= 1, F.lit(1)).otherwise(F.pow(F.lit(2.0), F.ceil(F.log2(v))).cast("int"))


def lowest_set_bit(v: Column) -> Column:
    """Number of the lowest set bit from 1; 0 if none is set."""
    return F.when(v == 0, F.lit(0)).otherwise(F.bit_count(v.bitwiseXOR(v - 1)).cast("int"))


def swap_bytes(v: Column, n: int) -> Column:
    """An unsigned integer of n bytes with its bytes in reverse order."""
    return F.conv(F.array_join(F.reverse(F.regexp_extract_all(F.lpad(F.hex(v), 2 * n, "0"), F.lit("(..)"), 1)), ""), 16, 10).cast("bigint")


def permute(px: Column, dims: Sequence[int], order: Sequence[int]) -> Column:
    """The axes of a row-major array in another order (numpy's transpose)."""
    if sorted(order) != list(range(len(dims))):
        raise ValueError(f"{order} isn't an order of {len(dims)} axes")
    strides = [math.prod(dims[k + 1 :]) for k in range(len(dims))]
    new = [dims[k] for k in order]
    inner = [math.prod(new[k + 1 :]) for k in range(len(new))]

    def source(i: Column) -> Column:
        out = F.lit(0)
        for k, axis in enumerate(order):
            out = out + (F.floor(i / inner[k]) % new[k]) * strides[axis]
        return F.get(px, out.cast("int"))

    return F.transform(F.sequence(F.lit(0), F.lit(math.prod(dims) - 1)), source)


def weighted_multiply(a: Column, b: Column, weight: float | Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y * weight)


def neighbourhood(px: Column, h: int, w: int, y: Column, x: Column, reach: int) -> Column:
    """Elements within ``reach`` rows and columns of (y, x) that lie inside the array, row by row."""
    rows = F.sequence(F.greatest(y - reach, F.lit(0)), F.least(y + reach, F.lit(h - 1)))
    first, last = F.greatest(x - reach, F.lit(0)), F.least(x + reach, F.lit(w - 1))
    return F.flatten(F.transform(rows, lambda r: F.slice(px, (r * w + first + 1).cast("int"), (last - first + 1).cast("int"))))


def masked_total(px: Column, mask: Column) -> Column:
    """Sum of the elements whose mask isn't 0."""
    return F.aggregate(F.zip_with(px, mask, lambda v, m: F.when(m != 0, v).otherwise(F.lit(0.0))), F.lit(0.0), lambda a, v: a + v)


def masked_mean(px: Column, mask: Column) -> Column:
    """Mean of the elements whose mask isn't 0; null without any."""
    n = F.size(F.filter(mask, lambda m: m != 0))
    return F.when(n > 0, masked_total(px, mask) / n)


def without_border(px: Column, h: int, w: int, border: int) -> Column:
    """The middle of an image: ``border`` rows and columns less on every side."""
    return crop(px, w, border, border, h - 1 - border, w - 1 - border)
