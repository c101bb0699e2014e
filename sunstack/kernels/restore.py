"""Multi-object multi-frame blind deconvolution of one patch (numpy).

Notation: F image transforms, S optical transfer functions, P = sum conj(F) S,
Q = sum |S|**2. The metric of an object is sum |F|**2 - |P|**2 / Q over the frequencies
that the telescope passes, over the number of pixels squared; what is minimised is the
weighted sum over objects plus a regularisation of the coefficients.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from . import fourier, zernike
from .linalg import conjugate_gradient, null_space


@dataclass
class Optics:
    """What all patches share: pupil, modes (scaled by wavelength), diversity phases; broadcast once."""

    pupil: np.ndarray
    modes: np.ndarray
    n: int
    cutoff: float
    noise_filter: bool = True
    fit_plane: bool = False
    norm: float = field(init=False)

    def __post_init__(self) -> None:
        self.norm = 1.0 / np.sqrt((self.pupil**2).sum())
        y, x = np.fft.fftfreq(self.n, 1 / self.n)[:, None], np.fft.fftfreq(self.n, 1 / self.n)[None, :]
        self.support = np.hypot(y, x) < self.cutoff


def make_optics(n: int, arcsec: float, diameter: float, wavelength: float, modes: list[tuple[int, str]], inner: float = 0.0, **options: bool) -> Optics:
    _, radius, cutoff = zernike.pupil_size(n, arcsec, diameter, wavelength)
    pupil = zernike.make_pupil(n, radius, inner)
    maps = zernike.make_modes(modes, n, radius)
    maps = zernike.normalize(maps, pupil)
    return Optics(pupil, maps, n, cutoff, **options)


def otf(optics: Optics, phase: np.ndarray) -> np.ndarray:
    """Transfer function of a phase over the pupil: transform of the point spread, 1 at zero frequency, zero frequency first."""
    field_ = optics.pupil * np.exp(1j * phase) * optics.norm
    psf = np.abs(np.fft.fft2(field_)) ** 2
    out = np.fft.fft2(psf)
    return out / out[0, 0].real


def psf(optics: Optics, phase: np.ndarray) -> np.ndarray:
    out = fourier.center(np.abs(np.fft.fft2(optics.pupil * np.exp(1j * phase) * optics.norm)) ** 2)
    return out / out.sum()


def windowed(image: np.ndarray, blend: int, plane: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Image blended into its mean (after taking out a plane, if asked), and the plane."""
    n = image.shape[0]
    flat = np.zeros_like(image)
    if plane:
        y, x = np.indices(image.shape) - (n - 1) / 2
        flat = y * (y * image).sum() / (y * y).sum() + x * (x * image).sum() / (x * x).sum()
    return fourier.apodize(image - flat, blend), flat


class Patch:
    """All frames of a patch: images of object o with their wavefront and fixed (diversity) phase."""

    def __init__(self, optics: Optics, images: np.ndarray, objects: np.ndarray, wavefronts: np.ndarray, fixed: np.ndarray | None = None,
                 weights: dict[int, float] | None = None, regularize: float = 0.0) -> None:
        self.o, self.objects, self.regularize = optics, np.asarray(objects), regularize
        self.wave, self.n_waves = np.unique(wavefronts, return_inverse=True)[1], len(set(np.asarray(wavefronts).tolist()))
        self.weights = weights or {}
        self.fixed = np.zeros_like(images, dtype=float) if fixed is None else fixed
        blend = max(1, optics.n // 8)
        pairs = [windowed(i, blend, optics.fit_plane) for i in images]
        self.planes = np.array([p for _, p in pairs])
        self.images = np.array([w for w, _ in pairs])
        self.f = np.fft.fft2(self.images) * optics.support
        self.noise = np.array([fourier.noise(i) for i in images])

    def phases(self, alpha: np.ndarray) -> np.ndarray:
        a = alpha.reshape(self.n_waves, -1)
        return self.fixed + np.tensordot(a[self.wave], self.o.modes[: a.shape[1]], axes=1)

    def transfer(self, alpha: np.ndarray) -> np.ndarray:
        return np.array([otf(self.o, p) for p in self.phases(alpha)]) * self.o.support

    def pq(self, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        own = self.objects == k
        return (self.f[own].conj() * s[own]).sum(0), (np.abs(s[own]) ** 2).sum(0)

    def metric(self, alpha: np.ndarray) -> float:
        s, total = self.transfer(alpha), 0.0
        for k in np.unique(self.objects):
            p, q = self.pq(s, k)
            power = (np.abs(self.f[self.objects == k]) ** 2).sum()
            total += self.weights.get(int(k), 1.0) * (power - (np.abs(p) ** 2 / np.maximum(q, 1e-12)).sum()) / self.o.n**4
        return float(total + 0.5 * self.regularize * (alpha**2).sum())

    def gradient(self, alpha: np.ndarray) -> np.ndarray:
        """Exact gradient through transfer function, point spread and pupil field."""
        m = alpha.reshape(self.n_waves, -1).shape[1]
        out = np.zeros((self.n_waves, m))
        phase = self.phases(alpha)
        o = self.o
        fields = [np.fft.fft2(o.pupil * np.exp(1j * p) * o.norm) for p in phase]
        raw = [np.fft.fft2(np.abs(g) ** 2) for g in fields]
        scale = [r[0, 0].real for r in raw]
        s = np.array([r / c for r, c in zip(raw, scale, strict=True)]) * o.support
        for k in np.unique(self.objects):
            p, q = self.pq(s, k)
            q = np.maximum(q, 1e-12)
            w = self.weights.get(int(k), 1.0) / o.n**4
            for i in np.flatnonzero(self.objects == k):
                # d metric / d S, then back through the two transforms; the sum of the point spread doesn't depend on phase.
                d = -(2 * p * self.f[i] / q - 2 * (np.abs(p) ** 2 / q**2) * s[i]) * o.support / scale[i]
                back = np.fft.fft2(d.conj()).real
                inner = np.fft.fft2(back * fields[i].conj())
                g = -2 * (inner * o.pupil * np.exp(1j * phase[i]) * o.norm).imag
                out[self.wave[i]] += w * (g[None] * o.modes[:m]).sum(axis=(1, 2))
        return out.ravel() + self.regularize * alpha

    def restore(self, alpha: np.ndarray, k: int, wavefronts: np.ndarray | None = None) -> np.ndarray:
        """sum conj(S) F / sum |S|**2, filtered by noise, back in the image plane; a subset of wavefronts gives a trace object."""
        own = self.objects == k
        if wavefronts is not None:
            own &= np.isin(self.wave, wavefronts)
        s = self.transfer(alpha)[own]
        f = self.f[own]
        q = (np.abs(s) ** 2).sum(0)
        out = np.where(q > 1e-12, (s.conj() * f).sum(0) / np.maximum(q, 1e-12), 0)
        if self.o.noise_filter:
            level = (self.noise[own] ** 2).sum() * self.o.n**2
            signal = np.abs((s.conj() * f).sum(0)) ** 2 / np.maximum(q, 1e-12)
            out = out * fourier.decenter(fourier.noise_filter(fourier.center(signal), np.full(q.shape, level), 0.9 * self.o.cutoff))
        return np.fft.ifft2(out).real + self.planes[own].mean(0)

    def residual(self, alpha: np.ndarray, k: int) -> np.ndarray:
        """Image minus restored object seen through each frame's transfer function."""
        own = self.objects == k
        s, sharp = self.transfer(alpha)[own], np.fft.fft2(self.restore(alpha, k))
        return self.images[own] - np.fft.ifft2(sharp * s).real


def tie_constraints(objects: np.ndarray, channels: np.ndarray, wavefronts: np.ndarray, n_modes: int, tilts: tuple[int, ...] = (0, 1)) -> tuple[np.ndarray, np.ndarray]:
    """Constraint matrix over (image, mode) coefficients and its null space.

    Images of one wavefront share their coefficients (first holder the pivot), except tilts of different channels, which only sum to 0 over frames."""
    n = len(wavefronts)
    rows = []
    first: dict[int, int] = {}
    for i, w in enumerate(np.asarray(wavefronts).tolist()):
        if w in first:
            for m in range(n_modes):
                if m in tilts and channels[i] != channels[first[w]]:
                    continue
                row = np.zeros(n * n_modes)
                row[first[w] * n_modes + m], row[i * n_modes + m] = 1, -1
                rows.append(row)
        else:
            first[w] = i
    for m in tilts:
        if m < n_modes:
            row = np.zeros(n * n_modes)
            row[[i * n_modes + m for i in first.values()]] = 1
            rows.append(row)
    c = np.array(rows).reshape(-1, n * n_modes)
    return c, null_space(c)


def solve(patch: Patch, n_modes: int, start: int = 5, step: int = 5, tol: float = 1e-4, most: int = 40, init: np.ndarray | None = None) -> tuple[np.ndarray, list[float]]:
    """Coefficients (wavefronts x modes) and the metric after each step: few modes first, ``step`` more each round until all."""
    alpha = np.zeros((patch.n_waves, n_modes)) if init is None else init.copy()
    history = [patch.metric(alpha.ravel())]
    used = min(start, n_modes)
    while True:
        last = used >= n_modes
        x, fx, _ = conjugate_gradient(patch.metric, patch.gradient, alpha[:, :used].ravel(), tol=tol if last else 1e-2, most=most if last else 8)
        alpha[:, :used] = x.reshape(patch.n_waves, used)
        history.append(fx)
        if last:
            return alpha, history
        used = min(used + step, n_modes)
