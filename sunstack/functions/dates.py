"""Times, Julian days and solar coordinates as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

DEG = math.pi / 180.0


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without time zone."""
    return F.unix_micros(ts.cast("timestamp"))


def julian_day(ts: Column) -> Column:
    return micros(ts) / 86_400_000_000.0 + 2440587.5


def time_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def add_seconds(ts: Column, seconds: Column) -> Column:
    return F.timestamp_micros((micros(ts) + seconds * 1_000_000).cast("bigint"))


def seconds_between(a: Column, b: Column) -> Column:
    return (micros(b) - micros(a)) / 1_000_000.0


def sidereal_time(jd: Column) -> Column:
    """Greenwich mean sidereal time in degrees (0 to 360)."""
    d = jd - 2451545.0
    t = d / 36525.0
    return F.pmod(280.46061837 + 360.98564736629 * d + 0.000387933 * t * t - t * t * t / 38710000.0, F.lit(360.0))


def obliquity(jd: Column) -> Column:
    """Mean obliquity of the ecliptic in degrees."""
    t = (jd - 2451545.0) / 36525.0
    return 23.439291111 - (46.8150 * t + 0.00059 * t * t - 0.001813 * t * t * t) / 3600.0


def nutation_longitude(jd: Column) -> Column:
    """Leading terms of the nutation in longitude, degrees."""
    t = (jd - 2451545.0) / 36525.0
    node, sun, moon = (125.04452 - 1934.136261 * t) * DEG, (280.4665 + 36000.7698 * t) * DEG, (218.3165 + 481267.8813 * t) * DEG
    return (-17.20 * F.sin(node) - 1.32 * F.sin(2 * sun) - 0.23 * F.sin(2 * moon) + 0.21 * F.sin(2 * node)) / 3600.0


def sun_longitude(jd: Column) -> tuple[Column, Column]:
    """Apparent ecliptic longitude (degrees) and distance (au) of the Sun, to about 0.01 degree."""
    t = (jd - 2451545.0) / 36525.0
    mean = 280.46646 + 36000.76983 * t + 0.0003032 * t * t
    anomaly = (357.52911 + 35999.05029 * t - 0.0001537 * t * t) * DEG
    centre = (1.914602 - 0.004817 * t) * F.sin(anomaly) + (0.019993 - 0.000101 * t) * F.sin(2 * anomaly) + 0.000289 * F.sin(3 * anomaly)
    e = 0.016708634 - 0.000042037 * t
    r = 1.000001018 * (1 - e * e) / (1 + e * F.cos(anomaly + centre * DEG))
    return F.pmod(mean + centre - 0.00569 - 0.00478 * F.sin((125.04 - 1934.136 * t) * DEG), F.lit(360.0)), r


def sun_position(jd: Column) -> tuple[Column, Column]:
    """Right ascension and declination of the Sun in degrees."""
    lon, _ = sun_longitude(jd)
    e, l = obliquity(jd) * DEG, lon * DEG  # noqa: E741
    return F.pmod(F.degrees(F.atan2(F.cos(e) * F.sin(l), F.cos(l))), F.lit(360.0)), F.degrees(F.asin(F.sin(e) * F.sin(l)))


def sun_pb(jd: Column) -> tuple[Column, Column, Column]:
    """Position angle P, latitude B0 of the disk's centre (degrees) and radius (arc seconds)."""
    lon, r = sun_longitude(jd)
    incline = 7.25 * DEG
    node = (73.6667 + 1.3958333 * (jd - 2396758.0) / 36525.0) * DEG
    l, e = lon * DEG, obliquity(jd) * DEG  # noqa: E741
    x = F.atan(-F.cos(l) * F.tan(e))
    y = F.atan(-F.cos(l - node) * F.tan(F.lit(incline)))
    return F.degrees(x + y), F.degrees(F.asin(F.sin(l - node) * math.sin(incline))), 959.63 / r


def local_tilt(hour_angle: Column, declination: Column, latitude: float) -> Column:
    """Parallactic angle in degrees (inputs in degrees)."""
    h, d, f = hour_angle * DEG, declination * DEG, latitude * DEG
    return F.degrees(F.atan2(F.sin(h), math.tan(f) * F.cos(d) - F.sin(d) * F.cos(h)))


def refraction(altitude: Column) -> Column:
    """Refraction in degrees for a true altitude in degrees."""
    return 1.02 / F.tan((altitude + 10.3 / (altitude + 5.11)) * DEG) / 60.0


def to_heliographic(x: Column, y: Column, radius: Column, p: Column, b0: Column) -> tuple[Column, Column]:
    """Heliographic latitude and longitude from the centre (degrees) of a position in arc seconds on the disk."""
    rho = F.asin(F.least(F.sqrt(x * x + y * y) / radius, F.lit(1.0)))
    theta = F.atan2(-x, y) - p * DEG
    lat = F.asin(F.sin(b0 * DEG) * F.cos(rho) + F.cos(b0 * DEG) * F.sin(rho) * F.cos(theta))
    return F.degrees(lat), F.degrees(F.asin(F.sin(rho) * F.sin(-theta) / F.cos(lat)))
