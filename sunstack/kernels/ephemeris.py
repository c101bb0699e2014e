"""Sun, Moon and planets from Keplerian elements and leading perturbations (degrees, astronomical units; accuracy of minutes of arc)."""

from __future__ import annotations

import numpy as np

# Mean elements at J2000 and rates per century (semi-major axis, eccentricity, inclination, mean longitude, perihelion, node).
ELEMENTS = {
    "mercury": ((0.38709927, 0.20563593, 7.00497902, 252.25032350, 77.45779628, 48.33076593), (0.00000037, 0.00001906, -0.00594749, 149472.67411175, 0.16047689, -0.12534081)),
    "venus": ((0.72333566, 0.00677672, 3.39467605, 181.97909950, 131.60246718, 76.67984255), (0.00000390, -0.00004107, -0.00078890, 58517.81538729, 0.00268329, -0.27769418)),
    "earth": ((1.00000261, 0.01671123, -0.00001531, 100.46457166, 102.93768193, 0.0), (0.00000562, -0.00004392, -0.01294668, 35999.37244981, 0.32327364, 0.0)),
    "mars": ((1.52371034, 0.09339410, 1.84969142, -4.55343205, -23.94362959, 49.55953891), (0.00001847, 0.00007882, -0.00813131, 19140.30268499, 0.44441088, -0.29257343)),
    "jupiter": ((5.20288700, 0.04838624, 1.30439695, 34.39644051, 14.72847983, 100.47390909), (-0.00011607, -0.00013253, -0.00183714, 3034.74612775, 0.21252668, 0.20469106)),
    "saturn": ((9.53667594, 0.05386179, 2.48599187, 49.95424423, 92.59887831, 113.66242448), (-0.00125060, -0.00050991, 0.00193609, 1222.49362201, -0.41897216, -0.28867794)),
    "uranus": ((19.18916464, 0.04725744, 0.77263783, 313.23810451, 170.95427630, 74.01692503), (-0.00196176, -0.00004397, -0.00242939, 428.48202785, 0.40805281, 0.04240589)),
    "neptune": ((30.06992276, 0.00859048, 1.77004347, -55.12002969, 44.96476227, 131.78422574), (0.00026291, 0.00005105, 0.00035372, 218.45945325, -0.32241464, -0.00508664)),
}


def heliocentric(planet: str, jd: np.ndarray) -> np.ndarray:
    """x, y, z in the ecliptic of J2000."""
    t = (np.asarray(jd, float) - 2451545.0) / 36525.0
    a, e, i, mean, peri, node = (p + r * t for p, r in zip(*ELEMENTS[planet], strict=True))
    w, m = np.radians(peri - node), np.radians((mean - peri + 180) % 360 - 180)
    ecc = m + e * np.sin(m)
    for _ in range(8):
        ecc = ecc - (ecc - e * np.sin(ecc) - m) / (1 - e * np.cos(ecc))
    x, y = a * (np.cos(ecc) - e), a * np.sqrt(1 - e * e) * np.sin(ecc)
    i, node = np.radians(i), np.radians(node)
    cw, sw, cn, sn, ci, si = np.cos(w), np.sin(w), np.cos(node), np.sin(node), np.cos(i), np.sin(i)
    return np.stack([(cw * cn - sw * sn * ci) * x + (-sw * cn - cw * sn * ci) * y, (cw * sn + sw * cn * ci) * x + (-sw * sn + cw * cn * ci) * y, sw * si * x + cw * si * y], axis=-1)


def _equatorial(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    e = np.radians(23.43928)
    y, z = v[..., 1] * np.cos(e) - v[..., 2] * np.sin(e), v[..., 1] * np.sin(e) + v[..., 2] * np.cos(e)
    return np.degrees(np.arctan2(y, v[..., 0])) % 360, np.degrees(np.arctan2(z, np.hypot(v[..., 0], y))), np.linalg.norm(v, axis=-1)


def planet(name: str, jd: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Right ascension, declination and distance from the Earth."""
    return _equatorial(heliocentric(name, jd) - heliocentric("earth", jd))


def sun(jd: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _equatorial(-heliocentric("earth", jd))


def moon(jd: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Right ascension, declination and distance (km) from the main terms of the lunar theory."""
    t = (np.asarray(jd, float) - 2451545.0) / 36525.0
    rad = np.radians
    long, d, m, mp, f = (rad(c + r * t) for c, r in ((218.3164477, 481267.88123421), (297.8501921, 445267.1114034), (357.5291092, 35999.0502909), (134.9633964, 477198.8675055), (93.2720950, 483202.0175233)))
    lon = np.degrees(long) + 6.288774 * np.sin(mp) + 1.274027 * np.sin(2 * d - mp) + 0.658314 * np.sin(2 * d) + 0.213618 * np.sin(2 * mp) - 0.185116 * np.sin(m) - 0.114332 * np.sin(2 * f)
    lat = 5.128122 * np.sin(f) + 0.280602 * np.sin(mp + f) + 0.277693 * np.sin(mp - f) + 0.173237 * np.sin(2 * d - f)
    r = 385000.56 - 20905.355 * np.cos(mp) - 3699.111 * np.cos(2 * d - mp) - 2955.968 * np.cos(2 * d)
    b, a = rad(lat), rad(lon)
    ra, dec, _ = _equatorial(np.stack([np.cos(b) * np.cos(a), np.cos(b) * np.sin(a), np.sin(b)], axis=-1))
    return ra, dec, r


def horizon(ra: np.ndarray, dec: np.ndarray, sidereal: np.ndarray, latitude: float) -> tuple[np.ndarray, np.ndarray]:
    """Altitude and azimuth (from north through east) for a local sidereal time in degrees."""
    h, d, f = np.radians(sidereal - ra), np.radians(dec), np.radians(latitude)
    alt = np.arcsin(np.sin(f) * np.sin(d) + np.cos(f) * np.cos(d) * np.cos(h))
    return np.degrees(alt), np.degrees(np.arctan2(-np.sin(h), np.cos(f) * np.tan(d) - np.sin(f) * np.cos(h))) % 360
