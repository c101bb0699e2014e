"""Special profiles and speckle transfer: complex error function, Voigt and Faraday-Voigt, Kolmogorov structure functions."""

from __future__ import annotations

import numpy as np


def faddeeva(z: np.ndarray, terms: int = 32) -> np.ndarray:
    """exp(-z**2) erfc(-i z) in the upper half plane by Weideman's rational series (coefficients by one FFT)."""
    m = 2 * terms
    k = np.arange(-m + 1, m)
    size = np.sqrt(terms / np.sqrt(2.0))
    t = size * np.tan(k * np.pi / (2 * m))
    f = np.concatenate(([0.0], np.exp(-t * t) * (size * size + t * t)))
    a = np.real(np.fft.fft(np.fft.fftshift(f))) / (2 * m)
    a = a[1 : terms + 1][::-1]
    z = np.asarray(z, complex)
    w = (size + 1j * z) / (size - 1j * z)
    return 2 * np.polyval(a, w) / (size - 1j * z) ** 2 + (1 / np.sqrt(np.pi)) / (size - 1j * z)


def faraday_voigt(x: np.ndarray, damping: float | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Voigt profile and Faraday-Voigt function of reduced frequency x for a damping >= 0."""
    w = faddeeva(np.asarray(x, float) + 1j * damping)
    return w.real, w.imag


def structure_function(r: np.ndarray, r0: float | np.ndarray) -> np.ndarray:
    """Kolmogorov phase structure function."""
    return 6.883877 * (np.abs(r) / r0) ** (5.0 / 3.0)


def long_exposure(q: np.ndarray, alpha: float | np.ndarray) -> np.ndarray:
    """Long-exposure transfer at frequency q (1 at the cut-off) for alpha = r0 / D: telescope times atmosphere."""
    q = np.clip(np.abs(q), 0, 1)
    telescope = 2 / np.pi * (np.arccos(q) - q * np.sqrt(1 - q * q))
    return telescope * np.exp(-0.5 * structure_function(q, alpha))


def speckle_transfer(q: np.ndarray, alpha: float, samples: int = 4000, seed: int = 0, corrected: float = 1.0) -> np.ndarray:
    """Mean squared short-exposure transfer at frequencies q by Monte-Carlo integration over pairs of pupil points.

    ``corrected`` scales the structure function (1: none corrected, near 0: adaptive optics takes nearly all)."""
    rng = np.random.default_rng(seed)
    out = []
    for f in np.atleast_1d(q):
        p = rng.uniform(-0.5, 0.5, (samples * 4, 2, 2))
        shift = np.array([f, 0.0])
        inside = (np.hypot(*(p - shift / 2).transpose(2, 0, 1)) < 0.5).all(axis=1) & (np.hypot(*(p + shift / 2).transpose(2, 0, 1)) < 0.5).all(axis=1)
        share = inside.mean()
        if not share:
            out.append(0.0)
            continue
        d = (p[inside, 0] - p[inside, 1])
        s = lambda v: structure_function(np.hypot(v[:, 0], v[:, 1]), alpha) * corrected  # noqa: E731, B023
        phase = structure_function(np.array([f]), alpha)[0] * corrected + s(d) - 0.5 * s(d + shift) - 0.5 * s(d - shift)
        out.append(float(np.exp(-np.maximum(phase, 0)).mean() * share / (np.pi / 4) ** 2))
    return np.array(out)
