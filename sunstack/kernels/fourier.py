"""Fourier kernels on single images (numpy, no Spark): transforms, convolution, noise, back-scatter, windows."""

from __future__ import annotations

import numpy as np


def center(a: np.ndarray) -> np.ndarray:
    """Move the zero frequency to the middle (n div 2)."""
    return np.fft.fftshift(a)


def decenter(a: np.ndarray) -> np.ndarray:
    """The inverse of ``center``, for odd sizes too."""
    return np.fft.ifftshift(a)


def power(image: np.ndarray) -> np.ndarray:
    f = np.fft.fft2(image)
    return (f * f.conj()).real


def convolve(a: np.ndarray, b: np.ndarray, normalize: bool = False) -> np.ndarray:
    """Cyclic convolution with a kernel whose centre is pixel n div 2; ``normalize`` makes the kernel's sum 1."""
    if a.shape != b.shape:
        raise ValueError(f"sizes differ: {a.shape} and {b.shape}")
    k = b / b.sum() if normalize else b
    return np.fft.irfft2(np.fft.rfft2(a) * np.fft.rfft2(decenter(k)), a.shape)


def correlate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cyclic cross-correlation with zero shift in the middle."""
    if a.shape != b.shape:
        raise ValueError(f"sizes differ: {a.shape} and {b.shape}")
    return center(np.fft.irfft2(np.fft.rfft2(a) * np.fft.rfft2(b).conj(), a.shape))


def autocorrelate(a: np.ndarray) -> np.ndarray:
    """Autocorrelation of a real or complex array, zero shift in the middle."""
    f = np.fft.fft2(a)
    out = center(np.fft.ifft2(f * f.conj()))
    return out if np.iscomplexobj(a) else out.real


def noise(image: np.ndarray, mask: float | None = None, limit: float | None = None) -> float:
    """Noise level from the power outside a cross of half width ``mask`` and inside a radius (squared frequency below ``limit``) ..."""
    h, w = image.shape
    mask = max(h, w) / 6 + 1 if mask is None else mask
    limit = h * w / 4 if limit is None else limit
    p = power(image)
    y, x = np.abs(np.fft.fftfreq(h, 1 / h))[:, None], np.abs(np.fft.fftfreq(w, 1 / w))[None, :]
    use = (y > mask) & (x > mask) & (y * y + x * x < limit)
    return float(np.sqrt(p[use].mean() / (h * w))) if use.any() else 0.0


def descatter(image: np.ndarray, gain: np.ndarray, psf: np.ndarray, eps: float = 1e-8, most: int = 50) -> np.ndarray:
    """Take light scattered back by the detector out: x <- image - gain * conv(gain * x), until the change is below eps."""
    h, w = image.shape
    k = np.zeros((2 * h, 2 * w))
    ph, pw = psf.shape
    y0, x0 = h - ph // 2, w - pw // 2
    k[y0 : y0 + ph, x0 : x0 + pw] = psf / psf.sum()
    kernel = np.fft.rfft2(decenter(k))
    x, before = image.astype(float).copy(), np.inf
    for _ in range(most):
        wide = np.zeros((2 * h, 2 * w))
        wide[:h, :w] = x * gain
        new = image - np.fft.irfft2(np.fft.rfft2(wide) * kernel, wide.shape)[:h, :w] * gain
        change = float(((new - x) ** 2).mean())
        x = new
        if change < eps or change >= before * 4:
            break
        before = change
    return x


def window(n: int, blend: int, margin: int = 0) -> np.ndarray:
    """0 in the margin, a cosine rise over ``blend`` samples, 1 in the middle, and the same down."""
    i = np.arange(n)
    d = np.minimum(i, n - 1 - i) - margin
    return np.where(d < 0, 0.0, np.where(d >= blend, 1.0, 0.5 - 0.5 * np.cos(np.pi * (d + 1) / (blend + 1))))


def apodize(image: np.ndarray, blend: int, margin: int = 0) -> np.ndarray:
    """Blend the edges into the mean."""
    w = window(image.shape[0], blend, margin)[:, None] * window(image.shape[1], blend, margin)[None, :]
    m = image.mean()
    return (image - m) * w + m


def noise_filter(object_power: np.ndarray, noise_power: np.ndarray, cutoff: float, smooth: int = 3) -> np.ndarray:
    """1 - noise / power, clamped to 0.2 .. 1, only where connected with zero frequency, smoothed and cut at ``cutoff``. Arrays are centred."""
    h, w = object_power.shape
    ratio = box_smooth(noise_power / np.maximum(object_power, 1e-300), smooth, smooth)
    f = 1.0 - ratio
    keep = connected(f > 0.2, h // 2, w // 2)
    f = np.where(keep, np.clip(f, 0.2, 1.0), 0.0)
    y, x = np.arange(h)[:, None] - h // 2, np.arange(w)[None, :] - w // 2
    return np.where(np.hypot(y, x) <= cutoff, f, 0.0)


def box_smooth(a: np.ndarray, ny: int, nx: int) -> np.ndarray:
    """Mean over the half-open box [y - ny, y + ny) x [x - nx, x + nx), clamped at the edges."""
    h, w = a.shape
    s = np.zeros((h + 1, w + 1))
    s[1:, 1:] = a.cumsum(0).cumsum(1)
    y0, y1 = np.clip(np.arange(h) - ny, 0, h), np.clip(np.arange(h) + ny, 0, h)
    x0, x1 = np.clip(np.arange(w) - nx, 0, w), np.clip(np.arange(w) + nx, 0, w)
    total = s[np.ix_(y1, x1)] - s[np.ix_(y0, x1)] - s[np.ix_(y1, x0)] + s[np.ix_(y0, x0)]
    return total / np.outer(y1 - y0, x1 - x0)


def connected(mask: np.ndarray, y: int, x: int) -> np.ndarray:
    """The 4-connected region of a mask that holds (y, x), by repeated dilation."""
    out = np.zeros_like(mask)
    if not mask[y, x]:
        return out
    out[y, x] = True
    while True:
        more = out.copy()
        more[1:] |= out[:-1]
        more[:-1] |= out[1:]
        more[:, 1:] |= out[:, :-1]
        more[:, :-1] |= out[:, 1:]
        more &= mask
        if (more == out).all():
            return out
        out = more
