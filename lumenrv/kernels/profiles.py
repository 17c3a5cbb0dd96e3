"""Fits of cross-correlations: a profile with shoulders, the vertex of a parabola, the best shift of a spectrum."""

from __future__ import annotations

import math

import numpy as np

from .curves import least_squares, low_pass, robust_polynomial


def shouldered(x: np.ndarray, centre: float, fwhm: float, depth: float, ears: float, power: float) -> np.ndarray:
    """Minus a super-Gaussian of some depth, plus one of twice its width and less height."""
    width = abs(fwhm) / (2 * (2 * math.log(2)) ** (1 / power))
    d = np.abs((x - centre) / width) ** power
    return 1 - depth * np.exp(-d) + depth / ears**2 * np.exp(-d / 2**power)


def vertex(x: np.ndarray, y: np.ndarray) -> float:
    """Where the parabola through the least point and its neighbours is least; at an end the last three points count."""
    k = min(max(int(np.argmin(y)), 1), len(y) - 2)
    a, b, _ = np.polyfit(x[k - 1 : k + 2] - x[k], y[k - 1 : k + 2], 2)
    return float(x[k] - b / (2 * a)) if a else float(x[k])


def correlation(wave: np.ndarray, flux: np.ndarray, lines: np.ndarray, weights: np.ndarray, velocities: np.ndarray, speed: float = 299792458.0, chunk: int = 64) -> np.ndarray:
    """Weighted sum of the flux at the lines' places, moved by each velocity; beyond the spectrum it is 0."""
    known = np.isfinite(flux)
    beta = -velocities / speed
    out = np.empty(len(velocities))
    for at in range(0, len(velocities), chunk):
        shift = np.sqrt((1 - beta[at : at + chunk]) / (1 + beta[at : at + chunk]))
        out[at : at + chunk] = (np.interp(lines * shift[:, None], wave[known], flux[known], 0.0, 0.0) * weights).sum(axis=1)
    return out


def systemic(velocities: np.ndarray, ccf: np.ndarray, filter_width: float = 1e5) -> dict[str, float]:
    """Velocity, width, contrast, signal over noise, shoulders and power of a correlation's dip, with a smooth background."""
    y = ccf / np.nanmedian(ccf)
    step = velocities[1] - velocities[0]
    fit = np.array([velocities[np.argmin(y)], 6000.0, 1 - np.nanmin(y), 3.0, 2.0])
    smooth = np.zeros(len(y))
    for _ in range(2):
        smooth = low_pass(y - shouldered(velocities, *fit), int(filter_width / step))
        fit, _ = least_squares(shouldered, velocities, y - smooth, fit.tolist())
    rest = y - smooth - shouldered(velocities, *fit)
    p = np.nanpercentile(rest, [15.865525393145708, 84.13447460685429])
    sigma = (p[1] - p[0]) / 2
    return {"vsys": fit[0], "fwhm": abs(fit[1]), "contrast": fit[2], "snr": fit[2] / sigma if sigma > 0 else math.inf, "ears": fit[3], "power": fit[4]}


def line_list_velocity(velocities: np.ndarray, ccf: np.ndarray) -> float:
    """Velocity of a correlation's dip over a cubic continuum without outliers."""
    level, _ = robust_polynomial(velocities, ccf, 3, 5)
    return vertex(velocities, ccf / np.polyval(level, velocities))


def best_shift(flux: np.ndarray, template: np.ndarray, reach: int = 50) -> float:
    """By how many grid points flux is rolled to fit a template best: least spread of their ratio, to parts of a point."""
    shifts = np.arange(-reach, reach)
    spread = []
    for k in shifts:
        with np.errstate(divide="ignore", invalid="ignore"):
            p = np.nanpercentile(np.roll(flux, k) / template, [16, 84])
        spread.append((p[1] - p[0]) / 2)
    spread = np.array(spread)
    return vertex(shifts.astype(float), spread / np.nanmedian(spread)) if np.isfinite(spread).all() else math.nan
