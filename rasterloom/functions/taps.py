"""Weights of a resampling axis and of a Gaussian, as arrays, and their application to many lines at once.

Half-pixel centres; kernels widen by the scale when shrinking; weights of an output pixel sum to one, also at the edge.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .kernels import CUBIC_A, CUBIC_RADIUS, LANCZOS_RADIUS, LEGACY_NEAREST, TRIANGLE_RADIUS

# Longer Gaussians are applied by Fourier transform.
DIRECT_TAPS = 33


def _triangle(t: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, 1.0 - t)


def _cubic(t: np.ndarray) -> np.ndarray:
    near = ((CUBIC_A + 2) * t - (CUBIC_A + 3)) * t * t + 1
    far = CUBIC_A * (((t - 5) * t + 8) * t - 4)
    return np.where(t < 1, near, np.where(t < CUBIC_RADIUS, far, 0.0))


def _lanczos(t: np.ndarray) -> np.ndarray:
    return np.where(t < LANCZOS_RADIUS, np.sinc(t) * np.sinc(t / LANCZOS_RADIUS), 0.0)


KERNELS = {"bilinear": (_triangle, TRIANGLE_RADIUS), "bicubic": (_cubic, CUBIC_RADIUS), "lanczos": (_lanczos, LANCZOS_RADIUS)}


@lru_cache(maxsize=64)
def taps(method: str, n_in: int, n_out: int) -> tuple[np.ndarray, np.ndarray]:
    """Inputs and weights of every output, both of shape (taps, n_out); unused places have weight zero."""
    o = np.arange(n_out)
    if method == "nearest-exact":
        return ((2 * o + 1) * n_in // (2 * n_out))[None], np.ones((1, n_out))
    if method == LEGACY_NEAREST:
        return (o * n_in // n_out)[None], np.ones((1, n_out))
    if method == "area":
        first, last = o * n_in // n_out, -(-(o + 1) * n_in // n_out) - 1
    else:
        kernel, radius = KERNELS[method]
        scale = n_in / n_out
        wide = max(scale, 1.0)
        centre = scale * (o + 0.5)
        first = np.maximum(0, np.ceil(centre - radius * wide - 0.5)).astype(int)
        last = np.minimum(n_in - 1, np.floor(centre + radius * wide - 0.5)).astype(int)
    inputs = first[None] + np.arange((last - first).max() + 1)[:, None]
    used = inputs <= last
    weights = used * (1.0 if method == "area" else kernel(np.abs(inputs + 0.5 - centre) / wide))
    return np.minimum(inputs, n_in - 1), weights / weights.sum(axis=0)


def resampled(lines: np.ndarray, method: str, n_out: int) -> np.ndarray:
    """Lines along the first axis, resampled to ``n_out``."""
    inputs, weights = taps(method, len(lines), n_out)
    out = lines[inputs[0]] * weights[0][:, None]
    for i, w in zip(inputs[1:], weights[1:], strict=True):
        out += lines[i] * w[:, None]
    return out


def blurred(lines: np.ndarray, sigma: float) -> np.ndarray:
    """Lines along the first axis under a Gaussian of radius 3 sigma; what lies outside counts as zero."""
    radius = max(1, int(np.floor(sigma * 3.0)))
    bell = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2.0 * sigma * sigma))
    bell /= bell.sum()
    n = len(lines)
    if len(bell) <= DIRECT_TAPS:
        out = lines * bell[radius]
        for d in range(1, min(radius, n - 1) + 1):
            out[d:] += lines[:-d] * bell[radius + d]
            out[:-d] += lines[d:] * bell[radius - d]
        return out
    size = n + 2 * radius
    spectrum = np.fft.rfft(lines, size, axis=0) * np.fft.rfft(bell, size)[:, None]
    return np.fft.irfft(spectrum, size, axis=0)[radius : radius + n]
