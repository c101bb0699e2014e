"""Work that grows faster than its input's bytes: how it is dealt to tasks, and whole results all the same."""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pytest
from pyspark.sql import functions as F

from sunstack.kernels import linalg
from sunstack.operators import matching, windows
from sunstack.queries import QUERIES
from sunstack.sources import bits, files


def filled(df) -> int:
    """Partitions that have rows."""
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_range_join_of_one_bucket_fills_many_tasks(spark):
    left = spark.range(300).select("id", (F.col("id") % 3 * 0.5).alias("v")).coalesce(1)
    right = spark.range(40).select(F.col("id").alias("k"), F.lit(0.25).alias("low"), (F.col("id") % 2 + 0.5).alias("high")).coalesce(1)
    out = windows.range_join(left, right, "v", "low", "high", 5.0)
    assert out.columns == ["id", "v", "k", "low", "high"]
    assert filled(out) > 4
    want = sorted((i, k) for i in range(300) for k in range(40) if 0.25 <= i % 3 * 0.5 <= k % 2 + 0.5)
    assert sorted((r.id, r.k) for r in out.collect()) == want


def test_nearest_vectors_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(matching, "QUERY_BLOCK", 4)
    monkeypatch.setattr(matching, "SEARCH_BLOCK", 16)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(120, 5)).round(1)
    v[40:60] = v[7]  # copies: the smallest other id wins
    v[99, 2] = np.nan
    rows = [(i, int(i >= 100), v[i].tolist() if i != 50 else None) for i in range(120)] + [(500, 9, [1.0] * 5)]
    f = spark.createDataFrame(rows, "id long, key int, v array<double>").coalesce(1)
    a, b = f.where("id % 2 = 0"), f.select("key", F.col("id").alias("other"), F.col("v").alias("w"))
    out = matching.nearest_vectors(a, b, ["key"], "id", "other", "v", "w")
    want = {}
    for i, k, x in rows:
        near = [(reduce(add, ((p - q) * (p - q) for p, q in zip(x, y, strict=True)), 0.0), j) for j, h, y in rows if j != i and h == k and y] if x and i % 2 == 0 else []
        near = [n for n in near if n[0] == n[0]]
        if near:
            want[i] = min(near)
    assert {r.id: (r.d, r.other) for r in out.collect()} == want


def test_nearest_match_makes_no_row_for_each_pair(spark):
    plan = QUERIES["nearest_match"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan and "CoGroup" in plan.replace("FlatMapCoGroups", "CoGroup")


@pytest.mark.parametrize("name", ["job_texts", "optima", "linear_systems", "line_profiles", "long_exposures", "image_files"])
def test_a_small_file_fills_many_tasks(spark, name):
    assert filled(QUERIES[name](spark, "/root/testdata/sf0.001")) > 11


def test_stacks_of_systems():
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(60, 4, 4)), rng.normal(size=(60, 4, 2))
    assert np.allclose(a @ linalg.gauss_jordan_all(a, b), b)
    a[3, :, 2], a[4], a[5, 0] = a[3, :, 1], 0, 0
    order, low, up = linalg.lu_all(a)
    assert np.allclose(np.take_along_axis(a, order[:, :, None], axis=1), low @ up)
    q, r, columns, rank = linalg.pivoted_qr_all(a)
    assert np.allclose(np.take_along_axis(a, columns[:, None], axis=2), q @ r)
    assert rank.tolist() == np.linalg.matrix_rank(a).tolist()
    with pytest.raises(np.linalg.LinAlgError):
        linalg.gauss_jordan_all(a, b)


def test_stacks_of_minima_and_programmes():
    rng = np.random.default_rng(6)
    c, k = rng.normal(size=80) * 5, rng.uniform(0.2, 3, 80)
    f = lambda x, c, k: abs(x - c) * (x - c) ** 2 * k + (x - c) ** 2
    three = linalg.bracket_all(lambda x: f(x, c, k), np.zeros(80), np.full(80, 0.5))
    at, least = linalg.brent_all(lambda x: f(x, c, k), *three)
    for i in range(80):
        one = lambda x: f(x, c[i], k[i])  # noqa: B023, E731
        assert np.allclose(linalg.brent(one, *linalg.bracket(one, 0.0, 0.5)), (at[i], least[i]), atol=1e-6)
    a, cost, b = rng.uniform(0.1, 2, (4, 3)), rng.normal(size=3) + 1, rng.uniform(0, 3, (50, 4))
    for rule in ("bland", "dantzig"):
        x, v = linalg.simplex_all(cost, a, b, rule)
        assert np.allclose(v, [linalg.simplex(cost, a, y, rule)[1] for y in b])
        assert np.allclose(x @ cost, v) and (x @ a.T <= b + 1e-9).all()


@pytest.mark.parametrize("window", [64, 1 << 18])
def test_slices_of_whole_images(monkeypatch, window):
    monkeypatch.setattr(bits, "WINDOW", window)
    rng = np.random.default_rng(7)
    for kind, dtype in ((0, np.int16), (1, np.uint8), (4, np.int32)):
        info = np.iinfo(dtype)
        for h, w in ((1, 1), (3, 1), (8, 8), (5, 40)):
            for scale in (2, 300, 2e9):
                image = np.clip(rng.normal(size=(h, w)) * scale, info.min, info.max).astype(dtype)
                data = bits.slice_encode(image, 5, kind)
                assert (bits.slice_decode(data, h, w, 5, kind) == image).all()
                with pytest.raises(ValueError):
                    bits.slice_decode(data[:-1], h, w, 5, kind)


def test_decoded_images_travel_together(spark):
    f = spark.createDataFrame([(i, 1, 2, [float(i), 0.5], "") for i in range(500)], "id int, h int, w int, px array<double>, header string").coalesce(1)
    contents = files.encoded(f, "ANA", "float64").select(F.col("id").cast("string").alias("path"), "content")
    contents = contents.unionAll(spark.createDataFrame([("bad", bytearray(b"no image"))], "path string, content binary")).coalesce(1)
    got = files.decoded(contents).collect()
    assert sorted((int(r.file), r.px) for r in got if r.error is None) == [(i, [float(i), 0.5]) for i in range(500)]
    assert [r.file for r in got if r.error] == ["bad"]
