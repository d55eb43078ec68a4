"""Scaling filters of orthogonal wavelets by name, from the factors of their product filter."""

from __future__ import annotations

import itertools
import math
from functools import cache

import numpy as np

#: Vanishing moments up to which filters are made.
MOST = 20


def _roots(n: int) -> np.ndarray:
    """Zeros inside the unit circle of the half-band polynomial with n vanishing moments, but for those at -1."""
    y = np.roots([math.comb(n - 1 + k, k) for k in range(n - 1, -1, -1)]) if n > 1 else np.array([])
    half = 1 - 2 * y
    z = half + np.sqrt(half * half - 1 + 0j)
    return np.where(np.abs(z) < 1, z, 1 / z)


def _filter(n: int, zeros: np.ndarray) -> np.ndarray:
    taps = np.array([1.0 + 0j])
    for z in sorted(zeros, key=lambda z: (abs(z), z.imag)):
        taps = np.convolve(taps, [1, -z])
    for _ in range(n):
        taps = np.convolve(taps, [0.5, 0.5])
    return _polished(taps.real * math.sqrt(2) / taps.real.sum(), n)


def _polished(taps: np.ndarray, n: int) -> np.ndarray:
    """Newton steps on what defines the filter: orthonormal to its even shifts, n vanishing moments."""
    size, x = 2 * n, np.linspace(-1, 1, 2 * n)
    moments = np.polynomial.legendre.legvander(x, n - 1).T * (-1.0) ** np.arange(size)
    for _ in range(8):
        gram = np.array([[taps[k + 2 * m] if k + 2 * m < size else 0.0 for k in range(size)] for m in range(n)])
        back = np.array([[taps[k - 2 * m] if k >= 2 * m else 0.0 for k in range(size)] for m in range(n)])
        off = np.concatenate([gram @ taps - (np.arange(n) == 0), moments @ taps])
        if np.abs(off).max() < 1e-15:
            break
        taps = taps - np.linalg.lstsq(np.concatenate([gram + back, moments]), off, rcond=None)[0]
    return taps


def _bend(taps: np.ndarray) -> float:
    """How far the phase is from a straight line, over frequencies that the filter lets pass."""
    w = np.linspace(0.01, 2.6, 256)
    phase = np.unwrap(np.angle(np.exp(-1j * np.outer(w, np.arange(len(taps)))) @ taps))
    return float(np.abs(phase - w * (phase @ w) / (w @ w)).max())


@cache
def scaling_filter(name: str) -> tuple[float, ...]:
    """Taps of "haar", "db1" to "db20" (all zeros inside the unit circle) and "sym2" to "sym20" (the zeros of each group inside
    or outside, so that the phase is closest to linear, most of the energy past the middle; up to sym3 these are the same).
    Other names raise."""
    kind, n = ("db", 1) if name == "haar" else (name.rstrip("0123456789"), int("0" + name.lstrip("abcdefghijklmnopqrstuvwxyz")))
    if kind not in ("db", "sym") or not (1 if kind == "db" else 2) <= n <= MOST:
        raise ValueError(f"no wavelet {name}; there are haar, db1 to db{MOST} and sym2 to sym{MOST}")
    zeros = _roots(n)
    if kind == "db" or n < 4:
        return tuple(_filter(n, zeros).tolist())
    groups = [np.array([z, z.conj()]) if z.imag > 1e-9 else np.array([z]) for z in zeros if z.imag > -1e-9]
    best = None
    for turned in itertools.product((False, True), repeat=len(groups) - 1):
        some = np.concatenate([groups[0], *[1 / g if t else g for g, t in zip(groups[1:], turned, strict=True)]])
        taps = np.array([1.0 + 0j])
        for z in some:
            taps = np.convolve(taps, [1, -z])
        for _ in range(n):
            taps = np.convolve(taps, [0.5, 0.5])
        bend = _bend(taps.real / taps.real.sum())
        if best is None or bend < best[0]:
            best = (bend, some)
    taps = _filter(n, best[1])
    late = taps**2 @ np.arange(2 * n) >= n - 0.5
    return tuple((taps if late else taps[::-1]).tolist())
