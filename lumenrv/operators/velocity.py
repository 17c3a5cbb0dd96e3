"""Velocities of single lines: exposures against a template."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from lumenrv.functions.spectral import SPEED_OF_LIGHT
from lumenrv.kernels.curves import Spline, low_pass, odd_ratio_mean

LINE_VELOCITIES = "line int, wave_start double, wave_end double, dv double, sdv double, d2v double, sd2v double, d3v double, sd3v double, n_pixels int, rms_ratio double, rounds int"


@dataclass(frozen=True)
class Template:
    """A spectrum without motion and the borders of its lines; of an instrument's size, so that it can be broadcast."""

    wave: np.ndarray
    flux: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def splines(self) -> list[Spline]:
        """The flux and its first three derivatives in velocity."""
        per_pixel = np.gradient(self.wave) / self.wave * SPEED_OF_LIGHT
        rows = [np.asarray(self.flux, float)]
        for _ in range(3):
            rows.append(np.gradient(rows[-1]) / per_pixel)
        return [Spline(self.wave, y, 3, "constant") for y in rows]


def _project(vector: np.ndarray, diff: np.ndarray, rms: np.ndarray) -> tuple[float, float]:
    with np.errstate(divide="ignore", invalid="ignore"):
        return float((diff * vector).sum() / (vector * vector).sum()), float(1 / np.sqrt(((vector / rms) ** 2).sum()))


def line_velocities(spectra: DataFrame, template: Template, *, keys: list[str], wave: str = "wave", flux: str = "flux", rounds: int = 20, width: int = 301, narrowest: int = 5, start: float = 0.0) -> DataFrame:
    """Velocity, width and skewness change of every line of every exposure (one row of arrays), by repeated projection.

    In each round the template is moved to the velocity so far, brought to the exposure's continuum by a running median of
    their ratio, and the rest is projected on the template's derivative line by line; the robust mean of the lines moves
    the velocity, until it moves by less than its error. Lines of fewer than narrowest pixels, beyond the spectrum or with
    missing flux give no row. dv holds the whole velocity. Exposures are independent of each other.
    """
    shared = spectra.sparkSession.sparkContext.broadcast(template)

    def measure(w: np.ndarray, f: np.ndarray, curves: list[Spline]) -> list[tuple]:
        t, rv = shared.value, start
        used, mean, err = 0, 0.0, 1.0
        while True:
            used += 1
            shift = np.sqrt((1 + rv / SPEED_OF_LIGHT) / (1 - rv / SPEED_OF_LIGHT))
            model = [c(w * shift) for c in curves]
            level = low_pass(np.where(model[0] > 0, f / np.where(model[0] > 0, model[0], 1), np.nan), width)
            first, second, third, fourth = (m * level for m in model)
            diff = f - first
            p = np.nanpercentile(diff, [15.865525393145708, 84.13447460685429])
            rms = np.full(len(f), max((p[1] - p[0]) / 2, 1e-12))
            lo = np.searchsorted(w, t.starts / shift)
            hi = np.searchsorted(w, t.ends / shift)
            last = used >= rounds or used > 1 and abs(mean) < err
            rows = []
            for k, (a, b) in enumerate(zip(lo.tolist(), hi.tolist())):
                if b - a < narrowest or a <= 0 or b >= len(w) - 1 or not np.isfinite(diff[a:b]).all():
                    continue
                part = slice(a, b)
                d = diff[part] - diff[part].mean()
                dv, sdv = _project(second[part] - second[part].mean(), d, rms[part])
                row = [k, float(t.starts[k]), float(t.ends[k]), -dv, sdv]
                if last:
                    for vector in (third, fourth):
                        row += _project(vector[part] - vector[part].mean(), d, rms[part])
                    row += [b - a, float(np.std(d) / rms[a])]
                rows.append(row)
            if not rows:
                return []
            if last:
                return [(*r[:3], rv * -1 + r[3], *r[4:], used) for r in rows]
            mean, err = odd_ratio_mean(np.array([r[3] for r in rows]), np.array([r[4] for r in rows]))
            rv -= mean

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        curves = shared.value.splines()
        names = [c.split()[0] for c in LINE_VELOCITIES.split(", ")]
        for part in parts:
            for _, row in part.iterrows():
                found = pd.DataFrame(measure(np.array(row[wave], float), np.array(row[flux], float), curves), columns=names)
                for k in keys:
                    found.insert(0, k, row[k])
                yield found[[*keys, *names]]

    kinds = ", ".join(f"{k} {spectra.schema[k].dataType.simpleString()}" for k in keys)
    return spectra.select(*keys, wave, flux).mapInPandas(run, f"{kinds}, {LINE_VELOCITIES}")
