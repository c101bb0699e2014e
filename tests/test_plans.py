"""Registries, caches, jobs, special functions and ephemerides."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sunstack.kernels import ephemeris, special
from sunstack.plans import registry
from sunstack.plans.debug_job import MandelbrotJob


def test_routines_and_jobs(spark):
    r = registry.Routines()
    r.add("twice", lambda x: None if x is None else 2 * x, 1, help="doubles")
    assert r("TWICE", 4) == 8 and list(r.info()) == [("TWICE", "doubles")]
    with pytest.raises(TypeError):
        r("twice")
    r.register(spark, "twice", "bigint")
    assert spark.sql("SELECT twice(21) AS v").first()["v"] == 42
    jobs = registry.Jobs()
    jobs.register("debug", MandelbrotJob)
    out = jobs.new("DEBUG", 32, 2, 20).result(spark)
    assert out.count() == 32 * 32 and out.agg(F.max("n")).first()[0] == 20
    with pytest.raises(KeyError):
        jobs.new("none")
    assert registry.part_timeout(10, 0) == 200 and registry.part_timeout(10, 1) == 50


def test_frame_cache(spark, tmp_path):
    c = registry.FrameCache(spark)
    assert c.get("a", lambda: spark.range(5)).count() == 5
    c.store("a", str(tmp_path / "a"))
    assert c.delete("a") and not c.delete("a")
    assert c.load("b", str(tmp_path / "a")).count() == 5 and list(c.info()) == ["b"]
    c.clear()
    with pytest.raises(KeyError):
        c.get("b")
    w = registry.StopWatch()
    w.tic()
    assert all(v >= 0 for v in w.toc())


def test_profiles():
    x = np.linspace(-8, 8, 2001)
    h, f = special.faraday_voigt(x, 0.3)
    assert np.isclose(np.trapezoid(h, x), np.sqrt(np.pi), rtol=0.05)
    assert np.allclose(special.faraday_voigt(x, 0.0)[0], np.exp(-x * x), atol=1e-6)
    assert np.allclose(f, -f[::-1], atol=1e-9) and np.isclose(special.faraday_voigt(np.array([0.0]), 1.0)[0][0], 0.4275835761558, atol=1e-6)


def test_speckle_transfer():
    q = np.array([0.05, 0.3, 0.6, 0.9])
    weak = special.speckle_transfer(q, 100.0)
    telescope = special.long_exposure(q, 1e6)
    assert np.allclose(weak, telescope**2, rtol=0.05, atol=2e-3)
    strong = special.speckle_transfer(q, 0.1)
    assert (strong < weak).all() and (strong[1:] > special.long_exposure(q, 0.1)[1:] ** 2).all()


def test_ephemerides():
    ra, dec, r = ephemeris.sun(2451623.8)  # near the equinox of March 2000
    assert min(ra, 360 - ra) < 0.3 and abs(dec) < 0.15 and abs(r - 0.996) < 0.002
    ra, dec, _ = ephemeris.sun(2451716.6)  # solstice
    assert abs(dec - 23.44) < 0.02
    ra, dec, r = ephemeris.moon(2448724.5)  # a published example: 134.69, 13.77 degrees, 368410 km
    assert abs(ra - 134.69) < 0.3 and abs(dec - 13.77) < 0.2 and abs(r - 368410) < 1000
    d = ephemeris.planet("jupiter", np.array([2451545.0, 2451745.0]))[2]
    assert ((d > 3.9) & (d < 6.5)).all()
    alt, az = ephemeris.horizon(np.array([10.0]), np.array([30.0]), np.array([10.0]), 30.0)
    assert np.isclose(alt[0], 90)
