"""Dates as days: modified Julian dates, reduced Julian dates, local nights, and the strings of headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Zero points of the day counts.
MJD_ZERO = 2400000.5
UNIX_MJD = 40587
RJD_ZERO = 2400000.0


def mjd_of(ts: Column) -> Column:
    """Modified Julian date of a timestamp without zone."""
    return F.unix_micros(ts.cast("timestamp")) / 86400e6 + UNIX_MJD


def jd_to_mjd(jd: Column) -> Column:
    return jd - MJD_ZERO


def plot_date(mjd: Column) -> Column:
    """Days since 1970."""
    return mjd - UNIX_MJD


def rjd(bjd: Column, mid_exposure_mjd: Column) -> Column:
    """Reduced Julian date: of the barycentric date where there is one, else of the middle of the exposure."""
    return F.coalesce(bjd - RJD_ZERO, mid_exposure_mjd + 0.5)


def local_night(mjd: Column, longitude: float, day_fraction: float = 0.0) -> Column:
    """The night that a date belongs to: days counted from the site's local midnight (half days go to the even one)."""
    offset = ((-longitude + 360) / 360 + day_fraction) % 1
    return F.rint(mjd - offset) + offset


def metres_per_second(text: Column) -> Column:
    """The number of a header value such as `-12.5 m/s`."""
    return F.regexp_extract(text, r"^\s*([-+0-9.eE]+)\s*m/s\s*$", 1).try_cast("double")


def ascii_only(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7F]", "")


def indexed_key(template: str, index: Column) -> Column:
    """Header key of a position in a 2-D list, as in WAVE%04d."""
    return F.format_string(template, index)
