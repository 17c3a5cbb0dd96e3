"""The library's functions by name, for SQL texts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from lumenrv.functions.spectral import FWHM, SPEED_OF_LIGHT
from lumenrv.kernels import curves

#: Name, arguments and body of the functions that SQL can say.
SQL_FUNCTIONS = {
    "doppler_shift": ("wave DOUBLE, velocity DOUBLE", f"wave * sqrt((1 - velocity / {SPEED_OF_LIGHT}D) / (1 + velocity / {SPEED_OF_LIGHT}D))"),
    "gauss": ("x DOUBLE, amplitude DOUBLE, centre DOUBLE, sigma DOUBLE, level DOUBLE", "amplitude * exp(-0.5D * pow((x - centre) / sigma, 2)) + level"),
    "fwhm": ("sigma DOUBLE", f"sigma * {FWHM!r}D"),
    "finite": ("x DOUBLE", "CASE WHEN isnan(x) OR abs(x) = double('inf') THEN NULL ELSE x END"),
}


def _names(argument: AnalyzeArgument) -> list[str]:
    return [c.strip() for c in argument.value.split(",") if c.strip()]


class FindLines:
    """find_lines(TABLE(t), 'keys', 'place', 'wave', 'flux'): where the gradient of flux along place changes its sign.

    Rows have the keys, the place, kind (1 from falling to rising), crossing (wavelength) and depth, as zero_crossings gives
    them. The table is dealt by its keys and put in order of place by the function itself; three rows are held at a time.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument, keys: AnalyzeArgument, place: AnalyzeArgument, wave: AnalyzeArgument, flux: AnalyzeArgument) -> AnalyzeResult:
        schema = StructType([table.dataType[c] for c in (*_names(keys), place.value)])
        for name, kind in (("kind", IntegerType()), ("crossing", DoubleType()), ("depth", DoubleType())):
            schema = schema.add(name, kind)
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(c) for c in _names(keys)], orderBy=[OrderingColumn(place.value)])

    def __init__(self) -> None:
        self.held: list[tuple] = []  # (output columns, wave, flux) of the last rows
        self.slope: float | None = None  # of the row before the last one held
        self.seen = 0

    def _pair(self, one: tuple, two: tuple, before: float | None, slope: float | None, after: float | None) -> Iterator[tuple]:
        """The crossing between two neighbours with their slopes; before is the flux ahead of the first one."""
        if slope is None or after is None or np.sign(slope) == np.sign(after):
            return
        crossing = None if None in (one[1], two[1]) else one[1] - slope * (two[1] - one[1]) / (after - slope)
        known = None not in (before, two[2], one[2]) and before + two[2] != 0
        yield (*one[0], 1 if after > slope else -1, crossing, 1 - one[2] / ((before + two[2]) / 2) if known else 0.0)

    def eval(self, row: Row, keys: str, place: str, wave: str, flux: str) -> Iterator[tuple]:
        number = lambda x: None if x is None or math.isnan(x) else float(x)
        new = (tuple(row[c.strip()] for c in (*keys.split(","), place) if c.strip()), number(row[wave]), number(row[flux]))
        self.held.append(new)
        self.seen += 1
        if self.seen >= 2:  # the slope of the row before is known now
            y = [h[2] for h in self.held[-3:]]
            ends = (y[0], y[-1])
            slope = None if None in ends else (y[-1] - y[0]) / (2 if self.seen > 2 else 1)
            if self.seen >= 3:
                before = self.held[-4][2] if self.seen > 3 else None
                yield from self._pair(self.held[-3], self.held[-2], before, self.slope, slope)
            self.slope = slope
        self.held = self.held[-3:]

    def terminate(self) -> Iterator[tuple]:
        if self.seen >= 2:
            a, b = self.held[-2:]
            last = None if None in (a[2], b[2]) else b[2] - a[2]
            before = self.held[-3][2] if self.seen > 2 else None
            yield from self._pair(a, b, before, self.slope, last)


def register(spark: SparkSession) -> list[str]:
    """Register everything by name in the session; returns all names.

    Scalar: SQL_FUNCTIONS, chi2_tail(x, k), correlation_p(r, n). Aggregates of a group in one task (groups of any size: the
    operator robust_means): robust_mean(value, error), robust_mean_error(value, error). Tables: find_lines.
    """
    for name, (arguments, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS DOUBLE RETURN {body}")

    @F.pandas_udf("double")
    def chi2_tail(x: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series(curves.chi2_tails(x.to_numpy(float), k.to_numpy(float)))

    @F.pandas_udf("double")
    def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(curves.correlation_ps(r.to_numpy(float), n.to_numpy(float)))

    @F.pandas_udf("double")
    def robust_mean(value: pd.Series, error: pd.Series) -> float:
        return float(curves.odd_ratio_mean(value.to_numpy(float), error.to_numpy(float))[0])

    @F.pandas_udf("double")
    def robust_mean_error(value: pd.Series, error: pd.Series) -> float:
        return float(curves.odd_ratio_mean(value.to_numpy(float), error.to_numpy(float))[1])

    functions = {"chi2_tail": chi2_tail, "correlation_p": correlation_p, "robust_mean": robust_mean, "robust_mean_error": robust_mean_error}
    for name, f in functions.items():
        spark.udf.register(name, f)
    spark.udtf.register("find_lines", F.udtf(FindLines))
    return [*SQL_FUNCTIONS, *functions, "find_lines"]
