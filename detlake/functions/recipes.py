"""Feature recipes: a name, a sample rate and a chain of steps from signal to matrix.

A step is a function of the rows so far and tells how wide its rows become. Steps
up to the last frame-wise one run on blocks of frames, so an hour of signal needs
memory for one block of spectra only. A recipe's identity is the digest of its
written form, for instance ``lfcc 16000 Hz: spectrum(n_fft=512 hop=160 win=400) > ...``.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from detlake import fixed_values as fv
from detlake.functions import signal as S

BLOCK = 4096  # frames worked on at once


@dataclass(frozen=True)
class Kind:
    """What a step does: ``run(rows, rate, **settings)``, ``width(before, **settings)``, per frame or not."""

    run: Callable
    width: Callable
    framewise: bool = True


def _decibel(rows, rate, floor):
    return 10.0 * np.log10(np.maximum(floor, rows))


def _slopes(rows, rate, width):
    return np.hstack([rows, S.deltas(rows, width, 1), S.deltas(rows, width, 2)])


KINDS = {
    "linear": Kind(lambda r, rate, n_fft, bands: r @ S.linear_bank(rate, n_fft, bands).T, lambda w, n_fft, bands: bands),
    "mel": Kind(
        lambda r, rate, n_fft, bands, low, high: r @ S.mel_bank(rate, n_fft, bands, low, high or rate / 2.0).T,
        lambda w, n_fft, bands, low, high: bands),
    "decibel": Kind(_decibel, lambda w, floor: w),
    "log": Kind(lambda r, rate, add: np.log(r + add), lambda w, add: w),
    "cosine": Kind(lambda r, rate, keep: r @ S.dct_matrix(r.shape[1], keep).T, lambda w, keep: keep),
    "slopes": Kind(_slopes, lambda w, width: 3 * w, framewise=False),
}


@dataclass(frozen=True)
class Recipe:
    """``spectrum`` is (n_fft, hop, win); ``steps`` are (kind, settings) pairs applied in order."""

    name: str
    rate: int
    spectrum: tuple[int, int, int]
    steps: tuple[tuple[str, tuple[tuple[str, object], ...]], ...] = ()

    @property
    def text(self) -> str:
        chain = [("spectrum", tuple(zip(("n_fft", "hop", "win"), self.spectrum))), *self.steps]
        written = [f"{kind}({' '.join(f'{k}={v}' for k, v in settings)})" for kind, settings in chain]
        return f"{self.name} {self.rate} Hz: {' > '.join(written)}"

    @property
    def feature_id(self) -> str:
        """Name and checksum of the written form; tables of different recipes never mix."""
        data = self.text.encode()
        return f"{self.name}-{zlib.crc32(data):08x}{zlib.adler32(data):08x}"

    @property
    def channels(self) -> int:
        width = 1 + self.spectrum[0] // 2
        for kind, settings in self.steps:
            width = KINDS[kind].width(width, **dict(settings))
        return width

    def matrix(self, y: np.ndarray) -> np.ndarray:
        """``[T, channels]`` of one signal in double precision."""
        apply = lambda rows, step: KINDS[step[0]].run(rows, self.rate, **dict(step[1]))
        cut = next((i for i, (kind, _) in enumerate(self.steps) if not KINDS[kind].framewise), len(self.steps))
        blocks = []
        for rows in S.power_blocks(y, *self.spectrum, BLOCK):
            for step in self.steps[:cut]:
                rows = apply(rows, step)
            blocks.append(rows)
        rows = np.concatenate(blocks)
        for step in self.steps[cut:]:
            rows = apply(rows, step)
        return rows


def _steps(*chain):
    return tuple((kind, tuple(settings.items())) for kind, settings in chain)


def lfcc(name: str, p: dict) -> Recipe:
    """Cepstra of evenly spaced bands, with slopes and curvatures unless left out."""
    chain = [("linear", {"n_fft": p["n_fft"], "bands": p["n_filter"]}), ("log", {"add": p["log_eps"]}),
             ("cosine", {"keep": p["n_lfcc"]})]
    if p["with_deltas"]:
        chain.append(("slopes", {"width": p["delta_width"]}))
    return Recipe(name, p["target_sr"], (p["n_fft"], p["hop_length"], p["win_length"]), _steps(*chain))


def logmel(name: str, p: dict) -> Recipe:
    """Mel bands in decibels."""
    bands = {"n_fft": p["n_fft"], "bands": p["n_mels"], "low": p["fmin"], "high": p["fmax"]}
    chain = [("mel", bands), ("decibel", {"floor": fv.POWER_FLOOR})]
    return Recipe(name, p["target_sr"], (p["n_fft"], p["hop_length"], p["win_length"]), _steps(*chain))


def bands(name: str, p: dict) -> Recipe:
    """Energies of evenly spaced bands."""
    return Recipe(name, p["target_sr"], (p["n_fft"], p["hop_length"], p["win_length"]),
                  _steps(("linear", {"n_fft": p["n_fft"], "bands": p["n_filter"]})))


def spectrum(name: str, p: dict) -> Recipe:
    """The power spectrum alone."""
    return Recipe(name, p["target_sr"], (p["n_fft"], p["hop_length"], p["win_length"]))
