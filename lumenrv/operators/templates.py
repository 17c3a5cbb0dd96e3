"""Systemic velocities by cross-correlation, registration of exposures, and templates that settle round by round."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenrv.functions.spectral import SPEED_OF_LIGHT, doppler_shift
from lumenrv.kernels import curves, profiles
from lumenrv.operators.orders import median_template, normalised_mask, one_dimensional
from lumenrv.operators.sequences import along, gradient, zero_crossings
from lumenrv.sources.scratch import materialize, parts_of

#: Lines that a list on the driver may have.
LINES = 1_000_000
#: Exposures whose velocities, two numbers each, are broadcast at most.
BROADCAST = 500_000
SYSTEMIC = ("vsys", "fwhm", "contrast", "snr", "ears", "power")


def _mask(lines: DataFrame, wave: str, weight: str) -> tuple[np.ndarray, np.ndarray]:
    """A line list (of an instrument's size, LINES at most) on the driver, to be broadcast."""
    rows = lines.filter(F.col(wave).isNotNull() & F.col(weight).isNotNull()).select(wave, weight).limit(LINES + 1).collect()
    if len(rows) > LINES:
        raise ValueError(f"a line list of more than {LINES} lines is none of an instrument's; correlate it with halos.correlated")
    rows.sort()
    return np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float)


def in_regions(lines: DataFrame, regions: Mapping[str, tuple[float, float]], wave: str, weight: str) -> DataFrame:
    """Lines of positive weight strictly inside one of some regions."""
    inside = F.lit(False)
    for low, high in regions.values():
        inside = inside | (F.col(wave).between(low, high) & (F.col(wave) != low) & (F.col(wave) != high))
    return lines.filter(inside & (F.col(weight) > 0))


def systemic_velocities(spectra: DataFrame, lines: DataFrame, *, keys: list[str], wave: str = "wave", flux: str = "flux", line: str = "wave", weight: str = "depth", reach: float = 3e5, step: float = 500.0, least_snr: float = 7.0) -> DataFrame:
    """vsys, fwhm, contrast, snr, ears, power of each row of arrays, and whether the signal is good enough.

    Rows without enough known pixels, or whose fit fails, have nulls and are not good. Spectra are independent of each other.
    """
    shared = spectra.sparkSession.sparkContext.broadcast(_mask(lines, line, weight))
    grid = np.arange(-reach, reach + step, step)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, depth = shared.value
        for part in parts:
            found = []
            for w, f in zip(part[wave], part[flux]):
                w, f = np.array(w, float), np.array(f, float)
                fit = dict.fromkeys(SYSTEMIC)
                if len(at) and np.isfinite(f).sum() > 3:
                    ccf = profiles.correlation(w, f, at, depth, grid)
                    if np.isfinite(ccf).all() and np.median(ccf) != 0:
                        try:
                            fit = profiles.systemic(grid, ccf)
                        except np.linalg.LinAlgError:  # no dip that a profile fits
                            pass
                found.append(fit)
            yield pd.concat([part[keys].reset_index(drop=True), pd.DataFrame(found, columns=SYSTEMIC, dtype=float)], axis=1)

    kinds = ", ".join(f"{k} {spectra.schema[k].dataType.simpleString()}" for k in keys)
    out = spectra.select(*keys, wave, flux).mapInPandas(run, f"{kinds}, {', '.join(f'{c} double' for c in SYSTEMIC)}")
    return out.withColumn("good", F.coalesce(F.col("snr") >= least_snr, F.lit(False)))


def mask_from_template(template: DataFrame, order: str, wave: str, flux: str, *, keys: list[str], least_depth: float = 0.0) -> DataFrame:
    """A line list from a template's rows: zero crossings of the slope, with weights by kind and depth, normalised by key."""
    rows = template.withColumn("__slope", gradient(F.col(flux), along(keys, order)))
    found = zero_crossings(rows, keys, order, wave, "__slope", flux).filter(F.abs("depth") >= least_depth)
    lines = found.select(*keys, F.col("crossing").alias("wave"), "kind", "depth", (F.col("kind") * F.abs(F.col("depth"))).alias("weight"))
    return normalised_mask(lines, keys, "weight")


def mask_velocity(template: DataFrame, lines: DataFrame, *, keys: list[str], wave: str = "wave", flux: str = "flux", reach: float = 200.0, step: float = 0.5) -> DataFrame:
    """Velocity (km/s) that takes a line list to each row of arrays (as doppler_shift has it): correlation, cubic continuum, parabola at the least."""
    shared = template.sparkSession.sparkContext.broadcast(_mask(lines.filter("weight > 0"), "wave", "weight"))
    grid = np.arange(-reach, reach + step, step)

    @F.pandas_udf("double")
    def velocity(waves: pd.Series, fluxes: pd.Series) -> pd.Series:
        at, weight = shared.value
        out = []
        for w, f in zip(waves, fluxes):
            ccf = profiles.correlation(np.array(w, float), np.array(f, float), at, weight, grid * -1000) if len(at) else np.zeros(0)
            out.append(profiles.line_list_velocity(grid, ccf) if len(ccf) and np.isfinite(ccf).all() and ccf.any() else None)
        return pd.Series(out, dtype=float)

    return template.select(*keys, velocity(wave, flux).alias("velocity"))


def registered(spectra: DataFrame, template: np.ndarray, *, key: str, flux: str, step: float, width: int) -> DataFrame:
    """key and shift (m/s) of each row of an array on the template's grid, both over their smooth parts."""
    smooth = curves.low_pass(template, width)
    shared = spectra.sparkSession.sparkContext.broadcast(template / smooth)  # of the grid's size

    @F.pandas_udf("double")
    def shift(rows: pd.Series) -> pd.Series:
        out = []
        for f in rows:
            f = np.array(f, float)
            with np.errstate(divide="ignore", invalid="ignore"):
                out.append(profiles.best_shift(f / curves.low_pass(f, width), shared.value) * step)
        return pd.Series(out)

    return spectra.select(key, shift(flux).alias("shift"))


def finished_template(template: DataFrame, keys: list[str], index: str, columns: dict[str, str], *, step: float, resolution: float, low_snr: float = 10.0, width: int = 101) -> DataFrame:
    """A template's fluxes and errors (columns: flux by its rms) without pixels of low signal, and smooth columns beside them.

    The signal, flux over rms, is smoothed by a running median of width pixels; below low_snr both are null, and so are they
    where the signal is not known. flux_savgol_d0 to d3 are the flux's local cubic and its derivatives by pixel, over a width
    of the resolution's in steps of step m/s. A template of keys is one array; it is of an instrument's size.
    """
    from lumenrv.operators.spectra import low_pass, savitzky_golay

    window = round(SPEED_OF_LIGHT / step / resolution)
    window += 1 - window % 2
    names = [index, *columns, *columns.values()]
    laid = template.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*names))).alias("__t"))
    array = lambda c: F.transform("__t", lambda t: t[c].cast("double"))
    done = laid.select(*keys, array(index).alias("__i"), *(array(c).alias(c) for c in names[1:]))
    for flux, rms in columns.items():
        snr = low_pass(F.zip_with(flux, rms, lambda f, r: F.try_divide(f, r)), width)
        kept = F.transform(snr, lambda s: F.coalesce(s >= low_snr, F.lit(False)))
        done = done.withColumn("__k", kept)
        cut = {c: F.zip_with(c, "__k", lambda x, k: F.when(k, x)) for c in (flux, rms)}
        done = done.withColumns(cut).withColumns({f"{flux}_savgol_d{n}": savitzky_golay(F.col(flux), window, derivative=n) for n in range(4)})
    out = ["__i", *names[1:], *(f"{c}_savgol_d{n}" for c in columns for n in range(4))]
    rows = done.select(*keys, F.inline(F.arrays_zip(*out)))
    return rows.select(*keys, F.col("__i").cast("long").alias(index), *out[1:])


def settled_template(orders: DataFrame, *, key: str = "exposure", wave0: float, step: float, n: int, bins: int = 19, rounds: int = 5, settled: float = 100.0, width: int = 101) -> tuple[DataFrame, DataFrame]:
    """Template (i, flux, rms, n) and velocities (key, velocity) of exposures given as orders with wave, flux, blaze and berv.

    Each round lays the exposures, moved by what is known of their velocities, on one grid, takes medians over bins of
    barycentric velocity, and registers every exposure on the result, until the velocities' corrections scatter by less than
    settled. Each round is written to the shared folder; of the template one array reaches the driver.
    """
    moves = materialize(orders.groupBy(key).agg(F.max("berv").alias("berv")).withColumn("velocity", F.lit(0.0)))
    from lumenrv.operators.intervals import place_in_order
    from lumenrv.operators.robust import exact_percentiles
    from lumenrv.operators.spectra import placed_values

    count = moves.count()
    parts = parts_of(orders.sparkSession, count)
    placed = place_in_order(moves.withColumn("__cell", F.floor(F.col("berv") / 100)), "__cell", ["berv", key])  # cells of 100 m/s
    binned = materialize(placed.select(key, F.floor(F.col("place") * min(bins, max(count, 1)) / max(count, 1)).cast("int").alias("bin")))  # one row for each exposure
    template = None
    for _ in range(rounds):
        if count <= BROADCAST:  # the exposures stay in the partitions that they came in
            placed = orders.drop("berv").join(F.broadcast(moves), key)
        else:
            placed = orders.drop("berv").join(moves, key).repartition(parts, key)
        moved = placed.withColumn("wave", F.transform("wave", lambda w: doppler_shift(w, F.col("velocity") - F.col("berv"))))
        laid = materialize(one_dimensional(moved, [key], wave0, step, n))
        template = materialize(median_template(laid, binned, key, bins=bins))
        grid = np.full(n, np.nan)
        for r in template.select("i", "flux").toLocalIterator():  # of the grid's size
            grid[r.i] = np.nan if r.flux is None else r.flux
        listed = laid.repartition(parts, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "flux"))).alias("__p"))  # a grid's size
        arrays = listed.select(key, placed_values(F.transform("__p", lambda p: p["i"].cast("double")), F.transform("__p", lambda p: p["flux"]), n).alias("flux"))
        shifts = materialize(registered(arrays, grid, key=key, flux="flux", step=step, width=width))
        # flux is compared with the template on a grid that rises with wavelength: a roll to the right is a rise in velocity
        moves = materialize(moves.join(shifts, key, "left").select(key, "berv", (F.col("velocity") - F.coalesce(F.nanvl("shift", F.lit(0.0)), F.lit(0.0))).alias("velocity")))
        found = exact_percentiles(shifts.withColumn("__one", F.lit(0)), ["__one"], "shift", (0.16, 0.84)).first()
        spread = found and found["p"]
        if spread is None or (spread[1] - spread[0]) / 2 < settled:
            break
    return template, moves.select(key, "velocity")
