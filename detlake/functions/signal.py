"""Small numeric kernels that run inside Arrow tasks: matrices and one utterance.

They follow the public definitions of the short-time spectrum (centred frames,
zero padding, periodic Hann window), Slaney mel bands, the orthonormal DCT-II
and Savitzky-Golay slopes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from detlake import fixed_values as fv


def hann(win: int, n_fft: int) -> np.ndarray:
    """Periodic Hann window of ``win`` points, centred in ``n_fft``."""
    w = 0.5 - 0.5 * np.cos(2.0 * np.pi * np.arange(win) / win)
    left = (n_fft - win) // 2
    return np.pad(w, (left, n_fft - win - left))


def power_blocks(y: np.ndarray, n_fft: int, hop: int, win: int, block: int):
    """Power spectrum ``[T, 1 + n_fft/2]``, ``T = 1 + len(y) // hop``, in blocks of frames."""
    y = np.asarray(y, np.float64)
    half, shape, n = n_fft // 2, hann(win, n_fft), 1 + len(y) // hop
    for first in range(0, n, block):
        count = min(block, n - first)
        lo = first * hop - half
        hi = lo + (count - 1) * hop + n_fft
        part = np.pad(y[max(lo, 0):max(hi, 0)], (max(-lo, 0), max(hi - max(len(y), lo, 0), 0)))
        spectrum = np.fft.rfft(np.lib.stride_tricks.sliding_window_view(part, n_fft)[::hop] * shape, axis=1)
        yield spectrum.real ** 2 + spectrum.imag ** 2


def power(y: np.ndarray, n_fft: int, hop: int, win: int) -> np.ndarray:
    """The whole power spectrum of a short signal."""
    return np.concatenate(list(power_blocks(y, n_fft, hop, win, 1 << 30)))


def _triangles(sr: int, n_fft: int, corner: np.ndarray) -> np.ndarray:
    """Triangles over the bins of a spectrum, each from one corner over the next to the one after; corners ascend."""
    f = np.linspace(0.0, sr / 2.0, 1 + n_fft // 2)
    rise = (f - corner[:-1, None]) / np.diff(corner)[:, None]
    return np.clip(np.minimum(rise[:-1], 1.0 - rise[1:]), 0.0, None)


@lru_cache(maxsize=8)
def linear_bank(sr: int, n_fft: int, n_filter: int) -> np.ndarray:
    """``[n_filter, bins]`` triangles with evenly spaced corners from 0 to sr/2."""
    return _triangles(sr, n_fft, np.linspace(0.0, sr / 2.0, n_filter + 2))


def mel_to_hz(mel: np.ndarray) -> np.ndarray:
    step, knee = fv.MEL_HZ_PER_STEP, fv.MEL_BREAK_HZ / fv.MEL_HZ_PER_STEP
    growth = np.log(fv.MEL_LOG_STEP_NUMERATOR) / fv.MEL_LOG_STEP_DENOMINATOR
    mel = np.asarray(mel, np.float64)
    bent = fv.MEL_BREAK_HZ * np.exp(growth * np.maximum(mel - knee, 0.0))
    return np.where(mel < knee, step * mel, bent)


def hz_to_mel(hz: float) -> float:
    knee = fv.MEL_BREAK_HZ / fv.MEL_HZ_PER_STEP
    growth = np.log(fv.MEL_LOG_STEP_NUMERATOR) / fv.MEL_LOG_STEP_DENOMINATOR
    if hz < fv.MEL_BREAK_HZ:
        return hz / fv.MEL_HZ_PER_STEP
    return knee + np.log(hz / fv.MEL_BREAK_HZ) / growth


@lru_cache(maxsize=8)
def mel_bank(sr: int, n_fft: int, n_mels: int, fmin: float, fmax: float) -> np.ndarray:
    """``[n_mels, bins]`` area-normalised triangles, evenly spaced in mel."""
    corner = mel_to_hz(np.linspace(hz_to_mel(fmin), hz_to_mel(fmax), n_mels + 2))
    return _triangles(sr, n_fft, corner) * (2.0 / (corner[2:] - corner[:-2]))[:, None]


@lru_cache(maxsize=8)
def dct_matrix(n_in: int, n_out: int) -> np.ndarray:
    """First ``n_out`` rows of the orthonormal DCT-II of ``n_in`` points."""
    k, i = np.arange(n_out)[:, None], np.arange(n_in)[None, :]
    m = np.sqrt(2.0 / n_in) * np.cos(np.pi * k * (2 * i + 1) / (2 * n_in))
    m[0] /= np.sqrt(2.0)
    return m


def half_window(width: int, frames: int) -> int:
    """Half of the largest odd window of at most ``width`` that fits; below 1 there is none."""
    return (min(width, frames) - 1) // 2


def slope_weights(h: int, order: int) -> np.ndarray:
    """Weights over ``-h..h`` of the first or second derivative of the fit."""
    i = np.arange(-h, h + 1, dtype=np.float64)
    if order == 1:
        return i / np.sum(i ** 2)
    n, s2, s4 = 2 * h + 1, np.sum(i ** 2), np.sum(i ** 4)
    return 2.0 * (n * i ** 2 - s2) / (n * s4 - s2 ** 2)


def deltas(x: np.ndarray, width: int, order: int) -> np.ndarray:
    """Derivative of ``[T, C]`` along time; edge frames copy the nearest full window."""
    h = half_window(width, len(x))
    if h < 1:
        raise ValueError(f"too short for slopes: {len(x)} frames")
    windows = np.lib.stride_tricks.sliding_window_view(x, 2 * h + 1, axis=0)
    inner = windows @ slope_weights(h, order)
    return np.pad(inner, ((h, h), (0, 0)), mode="edge")
