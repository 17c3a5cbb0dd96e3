"""Telluric lines: transmission of the air from two absorption spectra, and exponents that make its lines vanish."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from lumenrv.functions.spectral import SPEED_OF_LIGHT
from lumenrv.kernels.curves import low_pass


@dataclass(frozen=True)
class Air:
    """Transmission of water and of all else on a grid of constant velocity step, and the lines of both (wavelength, depth)."""

    wave: np.ndarray
    water: np.ndarray
    others: np.ndarray
    water_lines: np.ndarray
    others_lines: np.ndarray

    def transmission(self, water: float, others: float, width: float = 0.0) -> np.ndarray:
        """Both spectra to a power each, smoothed by a Gaussian of so many grid steps."""
        t = np.maximum(self.others, 1e-6) ** others * np.maximum(self.water, 1e-6) ** water
        if not width:
            return t
        u = np.arange(-int(4 * width) - 1, int(4 * width) + 2)
        k = np.exp(-0.5 * (u / width) ** 2)
        return 1 - np.convolve(1 - t, k / k.sum(), "same")


def line_depth(wave: np.ndarray, flux: np.ndarray, lines: np.ndarray, reach: float, step: float = 500.0) -> float:
    """Depth of the mean line: cross-correlation with a list of lines at rest, against its own level at both ends."""
    grid = np.arange(-reach, reach + step, step)
    at = np.interp(lines[:, :1] * (1 + grid / SPEED_OF_LIGHT), wave, flux)
    ccf = (lines[:, 1:] * at).sum(axis=0) / lines[:, 1].sum()
    edge = np.abs(grid) > 0.7 * reach
    return float(ccf[edge].mean() - ccf[np.abs(grid) <= step].mean())


def rotation_kernel(step: float, vsini: float, limb: float = 0.6) -> np.ndarray:
    """Broadening of a rotating disk with linear limb darkening, on a grid of velocity step."""
    n = max(int(np.ceil(vsini / step)), 1)
    x = np.clip(1 - (np.arange(-n, n + 1) * step / vsini) ** 2, 0, None)
    k = 2 * (1 - limb) * np.sqrt(x) + 0.5 * np.pi * limb * x
    return k / k.sum()


def rotated(flux: np.ndarray, step: float, vsini: float, limb: float = 0.6) -> np.ndarray:
    k = rotation_kernel(step, vsini, limb)
    half = len(k) // 2
    return np.convolve(np.pad(flux, half, mode="edge"), k, "valid")


def correct_tellurics(spectra: DataFrame, air: Air, *, keys: list[str], wave: str = "wave", flux: str = "flux", width: float = 1.4, rounds: int = 20, reach: float = 20_000.0, settled: float = 1e-4, water: tuple[float, float] = (0.01, 15.0), others: tuple[float, float] = (0.05, 15.0)) -> DataFrame:
    """flux_tc (null where the air lets less than 1/e through), exponent_water, exponent_others, rounds for each exposure.

    Exponents are moved by secants until the mean water line and the mean other line have no depth left; the exposure is
    one row of arrays, and the air's spectra are an instrument's.
    """
    shared = spectra.sparkSession.sparkContext.broadcast(air)

    def solve(w: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, float, float, int]:
        a = shared.value
        level = low_pass(f, 201)
        flat = f / np.where(level > 0, level, np.nan)
        flat = np.where(np.isfinite(flat), flat, 1.0)
        inside = lambda lines: lines[(lines[:, 0] > w[0] * 1.0002) & (lines[:, 0] < w[-1] * 0.9998)]
        lists = (inside(a.water_lines), inside(a.others_lines))

        def depths(e: np.ndarray) -> np.ndarray:
            t = np.interp(w, a.wave, a.transmission(e[0], e[1], width))
            return np.array([line_depth(w, flat / np.maximum(t, 1e-3), x, reach) if len(x) else 0.0 for x in lists])

        low, high = np.array([water[0], others[0]]), np.array([water[1], others[1]])
        e, used = np.clip([1.0, 1.0], low, high), 0
        now = depths(e)
        for used in range(1, rounds + 1):
            slope = np.empty((2, 2))
            for k in range(2):
                moved = e.copy()
                moved[k] += 0.02
                slope[:, k] = (depths(moved) - now) / 0.02
            step = np.linalg.lstsq(slope, -now, rcond=1e-6)[0]
            e = np.clip(e + np.clip(step, -1, 1), low, high)
            now = depths(e)
            if np.abs(step).max() < settled:
                break
        t = np.interp(w, a.wave, a.transmission(e[0], e[1], width))
        return np.where(t > np.exp(-1), f / t, np.nan), float(e[0]), float(e[1]), used

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for _, r in part.iterrows():
                clean, ew, eo, used = solve(np.array(r[wave], float), np.array(r[flux], float))
                rows.append((*(r[k] for k in keys), [None if np.isnan(x) else x for x in clean.tolist()], ew, eo, used))
            yield pd.DataFrame(rows, columns=[*keys, "flux_tc", "exponent_water", "exponent_others", "rounds"])

    kinds = ", ".join(f"{k} {spectra.schema[k].dataType.simpleString()}" for k in keys)
    return spectra.select(*keys, wave, flux).mapInPandas(run, f"{kinds}, flux_tc array<double>, exponent_water double, exponent_others double, rounds int")
