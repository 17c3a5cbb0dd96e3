"""Column expressions of spectroscopy: wavelengths in nm, velocities in m/s."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Speed of light, and the factor between a Gaussian's full width at half maximum and its sigma.
SPEED_OF_LIGHT = 299792458.0
FWHM = 2 * math.sqrt(2 * math.log(2))


def finite(x: Column) -> Column:
    """Null for NaN and infinities: missing values are null everywhere behind the ingest."""
    x = x.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def doppler_shift(wave: Column, velocity: Column) -> Column:
    beta = velocity / SPEED_OF_LIGHT
    return wave * F.sqrt((F.lit(1.0) - beta) / (F.lit(1.0) + beta))


def gauss(x: Column, amplitude: Column, centre: Column, sigma: Column, level: Column) -> Column:
    return amplitude * F.exp(F.pow((x - centre) / sigma, F.lit(2)) * -0.5) + level


def gauss_on_slope(x: Column, centre: Column, sigma: Column, amplitude: Column, level: Column, slope: Column) -> Column:
    d = x - centre
    return amplitude * F.exp(d * d * -0.5 / (sigma * sigma)) + level + d * slope


def gauss_with_ears(x: Column, centre: Column, fwhm: Column, amplitude: Column, ears: Column, exponent: Column) -> Column:
    """A super-Gaussian absorption with shoulders."""
    width = fwhm / (F.pow(F.lit(2 * math.log(2)), F.lit(1.0) / exponent) * 2)
    d = F.pow(F.abs(x - centre), exponent)
    return F.lit(1.0) - amplitude * F.exp(-d / F.pow(width, exponent)) + amplitude / (ears * ears) * F.exp(-d / F.pow(width * 2, exponent))


def fwhm(sigma: Column) -> Column:
    return sigma * FWHM


def normal_fraction(sigma: float = 1.0) -> float:
    """The share of a normal distribution within so many sigma."""
    return math.erf(sigma / math.sqrt(2))


def air_index(wave: Column, celsius: float = 15.0, pressure: float = 760.0) -> Column:
    """Refractive index of air; a vacuum wavelength is the air wavelength times it."""
    s = F.pow(F.lit(1e3) / wave, F.lit(2))
    density = 1e-6 * pressure * (1 + (1.049 - 0.0157 * celsius) * 1e-6 * pressure) / (720.883 * (1 + 0.003661 * celsius))
    return (F.lit(64.328) + F.lit(29498.1) / (F.lit(146.0) - s) + F.lit(255.4) / (F.lit(41.0) - s)) * density + 1


def polynomial(coefficients: Column, x: Column) -> Column:
    """Ascending coefficients (array), by Horner's rule."""
    return F.aggregate(F.reverse(coefficients), F.lit(0.0), lambda acc, c: acc * x + c)


def chebyshev(coefficients: Column, x: Column, low: float, high: float) -> Column:
    """Sum of c_k T_k of x scaled from low..high to -1..1, by Clenshaw's recurrence."""
    t = (x - low) * 2 / (high - low) - 1
    start = F.struct(F.lit(0.0).alias("one"), F.lit(0.0).alias("two"))
    step = lambda s, c: F.struct((c + t * 2 * s["one"] - s["two"]).alias("one"), s["one"].alias("two"))
    return F.aggregate(F.reverse(coefficients), start, step, lambda s: s["one"] - t * s["two"])


def width_terms(d2v: Column, sdv2: Column, ew: Column, calibration_ew: float = 5.5) -> dict[str, Column]:
    """dW, sdW, fwhm and sig_fwhm from the second-derivative velocity, its error and the line's equivalent sigma.

    An equivalent sigma of 0 (a calibration) stands for calibration_ew.
    """
    full = F.when(ew == 0, calibration_ew).otherwise(ew) * FWHM
    dw, sdw = d2v * (8 * math.log(2)), sdv2 * (8 * math.log(2))
    return {"dW": dw, "sdW": sdw, "fwhm": full + dw / full, "sig_fwhm": sdw / full}


def magic_grid_size(wave0: float, wave1: float, step: float = 500.0) -> int:
    return math.floor(math.log(wave1 / wave0) * SPEED_OF_LIGHT / step)


def magic_grid_point(i: Column, wave0: float, n: int, step: float = 500.0) -> Column:
    """The i-th of n wavelengths that lie a constant velocity step apart."""
    end = math.exp(n * step / SPEED_OF_LIGHT) * wave0
    return F.exp(i / n * math.log(end / wave0)) * wave0


def magic_grid_points(wave0: Column, wave1: Column, step: float = 500.0) -> Column:
    """Array of the wavelengths from wave0 up to near wave1 that lie a constant velocity step apart; empty where none fits."""
    n = F.floor(F.log(wave1 / wave0) * SPEED_OF_LIGHT / step)
    point = lambda i: F.exp(i / n * F.log(F.exp(n * step / SPEED_OF_LIGHT))) * wave0
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), point)).otherwise(F.array().cast("array<double>"))


def uniform_bins(wave0: float, wave1: float, n: int) -> Sequence[tuple[str, float, float]]:
    """Name, blue and red end of n bins of equal width in the logarithm."""
    edges = [math.exp(i / n * math.log(wave1 / wave0)) * wave0 for i in range(n + 1)]
    return [(f"{int((a + b) / 2)}nm", a, b) for a, b in zip(edges, edges[1:])]
