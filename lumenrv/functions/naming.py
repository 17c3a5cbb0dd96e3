"""Names of a run's tables and files, and choices from fixed grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def stem(path: Column) -> Column:
    """The file's name without folders and without its last ending."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def line_file(path: Column, science: Column, template: Column) -> Column:
    """Name of an exposure's table of line velocities."""
    return F.concat_ws("_", stem(path), science, template, F.lit("lines.fits"))


def series_file(science: Column, template: Column, night: bool = False, drift: bool = False) -> Column:
    """Name of a time series; of nights, and with the drift taken off."""
    return F.concat(F.lit("nights_" if night else "series_"), science, F.lit("_"), template, F.lit("_drift.rdb" if drift else ".rdb"))


def template_file(science: Column, instrument: Column) -> Column:
    return F.format_string("Template_%s_%s.fits", science, F.lower(instrument))


def nearest(value: Column, grid: Sequence[float]) -> Column:
    """The grid's value nearest to another one, the smaller of two; null for a null."""
    pairs = F.transform(F.array(*(F.lit(float(x)) for x in grid)), lambda x: F.struct(F.abs(x - value).alias("d"), x.alias("x")))
    return F.when(value.isNotNull(), F.array_min(pairs)["x"])


#: The grid of stellar models.
MODEL_TEFF = tuple(range(3000, 6100, 100))
MODEL_LOGG = tuple(k / 2 for k in range(13))


def model_name(teff: Column, logg: Column) -> Column:
    """Name of the nearest stellar model of solar composition."""
    return F.format_string("lte%05d-%.2f-0.0", nearest(teff, MODEL_TEFF).cast("int"), nearest(logg, MODEL_LOGG))


def systemic_guess(berv: Column, estimate: Column, vsys: Column) -> Column:
    """First systemic velocity of an exposure, in its own frame."""
    return berv - (estimate + vsys)
