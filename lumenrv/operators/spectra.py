"""Operators on array columns: one spectrum, or one order of it, in a row."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenrv.functions.spectral import finite
from lumenrv.kernels import curves, groups
from lumenrv.operators import robust
from lumenrv.sources.scratch import materialize


def _arrays(x: object) -> np.ndarray:
    return np.array(x, dtype=float)  # None becomes NaN


def _on_arrays(fn: Callable[..., np.ndarray], *columns: Column) -> Column:
    """fn of each row's arrays as an array of the same kind; NaN in the result is null, a null input gives null."""

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for part in parts:
            out = []
            for row in zip(*((part,) if isinstance(part, pd.Series) else part)):  # one column comes bare
                y = None if any(x is None for x in row) else fn(*map(_arrays, row))
                out.append(None if y is None else [None if np.isnan(v) else v for v in y.tolist()])
            yield pd.Series(out, dtype=object)

    return run(*columns)


def spline_at(x: Column, y: Column, at: Column, degree: int = 3, outside: str = "extend") -> Column:
    """Interpolating spline through (x, y), evaluated at other places."""
    return _on_arrays(lambda x, y, at: curves.Spline(x, y, degree, outside)(at), x, y, at)


def placed_values(places: Column, values: Column, n: int) -> Column:
    """An array of n values with those given at their places (from 0) and null elsewhere."""

    def put(at: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.full(n, np.nan)
        inside = (at >= 0) & (at < n)
        out[at[inside].astype(int)] = y[inside]
        return out

    return _on_arrays(put, places, values)


def low_pass(values: Column, width: int = 101, degree: int = 2) -> Column:
    return _on_arrays(lambda v: curves.low_pass(v, width, degree), values)


def savitzky_golay(values: Column, width: int, order: int = 3, derivative: int = 0, step: float = 1.0) -> Column:
    return _on_arrays(lambda v: curves.savitzky_golay(v, width, order, derivative, step), values)


def polynomial_fit(x: Column, y: Column, degree: int, sigmas: float) -> Column:
    """Coefficients of a polynomial without outliers, highest power first."""
    return _on_arrays(lambda x, y: curves.robust_polynomial(x, y, degree, sigmas)[0], x, y)


def chi2_tail(x: Column, k: Column) -> Column:
    """Chance that chi squared with k degrees of freedom exceeds x; null for a null."""

    @F.pandas_udf("double")
    def run(x: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series(curves.chi2_tails(x.to_numpy(float), k.to_numpy(float)))

    return F.when(x.isNotNull() & k.isNotNull(), run(x, k))


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided chance of a correlation coefficient in n pairs; null for a null and for fewer than three pairs."""

    @F.pandas_udf("double")
    def run(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(curves.correlation_ps(r.to_numpy(float), n.to_numpy(float)))

    return F.when(r.isNotNull() & (n > 2), run(r, n))


def blaze_normalised(orders: DataFrame, keys: Sequence[str], order: str, pixel: str, wave: str, blaze: str, *, degree: int = 2) -> DataFrame:
    """Blaze over the smooth energy distribution of its exposure.

    An order's peak is the mean of its pixels above their 95th percentile, at their mean wavelength; a polynomial through
    the logarithms of the peaks (one row for each order) gives the distribution.
    """
    group = [*keys, order]
    top = orders.groupBy(*group).agg(F.percentile(blaze, F.lit(0.95)).alias("__top"))
    marked = orders.join(top, group).withColumn("__high", F.col(blaze) > F.col("__top"))
    peaks = marked.filter("__high").groupBy(*group).agg(F.avg(blaze).alias("__peak"), F.avg(wave).alias("__at")).filter("__peak > 0")
    gathered = peaks.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.log("__at").alias("x"), F.log("__peak").alias("y")))).alias("__p"))
    fits = gathered.withColumn("__c", polynomial_fit(F.transform("__p", lambda p: p["x"]), F.transform("__p", lambda p: p["y"]), degree, 5.0)).select(*keys, "__c")
    sed = F.exp(F.aggregate("__c", F.lit(0.0), lambda a, c: a * F.log(wave) + c))
    return orders.join(fits, list(keys)).withColumn("blaze_norm", F.col(blaze) / sed).drop("__c")


def _weighted_line(prob: Column, error: Column) -> dict[str, Column]:
    """Sums of the straight lines against the distance to the reference and against its logarithm, as aggregates."""
    one = robust.line_fit(F.col("__x"), F.col("__y"), prob / error)
    two = robust.line_fit(F.col("__l"), F.col("__y"), prob / error)
    return {**{f"__a_{k}": v for k, v in one.items()}, **{f"__b_{k}": v for k, v in two.items()}}


FIT = ("level", "level_err", "slope", "slope_err", "crx", "crx_err")


def chromatic_slope(df: DataFrame, keys: Sequence[str], wave: str, velocity: str, error: str, *, reference: float, bias: str | None = None, rounds: int = 10, gathered: int = 100_000) -> DataFrame:
    """Velocity at a reference wavelength (level), slope (per um) and CRX of each group, with errors.

    A straight line is fitted round by round: each point's weight is its chance to be valid, given the line before, over its
    error. Points ten errors off the median or with errors of a hundred medians take no part; where a group has errors of
    zero, all below half its first percentile count as that. A group stops when its level moves by less than a tenth of its
    error, at latest after rounds. Groups of fewer than three points have nulls. bias is taken off the velocities once the
    points are chosen. Groups of up to gathered rows are worked on in one row each after one shuffle, larger ones by grouped
    sums; both give the same numbers. df is read twice: hand over a written table where it is dear.
    """
    keys = list(keys)
    off = finite(F.col(bias)) if bias else F.lit(0.0)
    rows = df.select(*keys, finite(F.col(wave)).alias("__w"), finite(F.col(velocity)).alias("__v"), finite(F.col(error)).alias("__e"), off.alias("__o"))
    large = robust.crowded(rows, keys, gathered)
    few = rows if large is None else rows.join(large, robust._same(keys), "left_anti")
    lists = few.groupBy(*keys).agg(*(robust.listed(F.col(c), F.lit(True)).alias(c) for c in ("__w", "__v", "__e", "__o")))

    def run(w: np.ndarray, v: np.ndarray, e: np.ndarray, o: np.ndarray, sizes: np.ndarray) -> list[pa.Array]:
        return [pa.array(x, mask=~has) for x, has in zip(*groups.slopes(w, v, e, o, sizes, reference, rounds))]

    fit = robust.of_lists(run, dict.fromkeys(FIT, "double"))("__w", "__v", "__e", "__o")
    scaled = lambda t: t.select(*keys, *((F.col(k) * (1000 if "slope" in k else 1)).alias(k) for k in FIT))
    out = scaled(lists.select(*keys, fit.alias("__fit")).select(*keys, *(F.col("__fit")[k].alias(k) for k in FIT)))
    if large is not None:
        held = materialize(rows.join(large, robust._same(keys), "left_semi"))
        out = out.union(scaled(_slope_by_rounds(held, keys, reference, rounds)))
    return out


def _slope_by_rounds(rows: DataFrame, keys: list[str], reference: float, rounds: int) -> DataFrame:
    """chromatic_slope for groups of any size: every round is one grouping with partial sums."""
    same = lambda: reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], F.lit(True))
    named = lambda t: t.select(*(F.col(k).alias(f"__{k}") for k in keys), *[c for c in t.columns if c not in keys])
    middle = named(robust.exact_median(rows, keys, "__v", name="__vm")).join(robust.exact_median(rows, keys, "__e", name="__em"), same()).select(*keys, "__vm", "__em")
    good = materialize(rows.join(named(middle), same()).filter("__w is not null and __v is not null and __o is not null and abs(__v - __vm) < 10 * __e and __e < 100 * __em").select(*rows.columns))
    least = good.groupBy(*keys).agg(F.min("__e").alias("__least")).filter("__least = 0")
    floor = named(robust.exact_percentiles(good.join(named(least).drop("__least"), same(), "left_semi"), keys, "__e", [0.01], name="__f"))
    points = good.join(floor, same(), "left").select(
        *keys, (F.col("__w") - reference).alias("__x"), F.log(F.col("__w") / reference).alias("__l"), (F.col("__v") - F.col("__o")).alias("__y"), F.greatest("__e", F.coalesce(F.get("__f", F.lit(0)) / 2, F.col("__e"))).alias("__e"))
    state, done = None, None
    for _ in range(rounds):
        if state is None:
            sums = points.groupBy(*keys).agg(*(v.alias(k) for k, v in _weighted_line(F.lit(1.0), F.col("__e")).items())).withColumn("last", F.lit(float("inf")))
        else:
            g = F.exp(F.pow((F.col("__y") - F.col("level") - F.col("slope") * F.col("__x")) / F.col("__e"), F.lit(2)) * -0.5)
            met = points.join(named(state.filter("moving").select(*keys, "level", "slope")), same())
            sums = met.groupBy(*keys, F.col("level").alias("last")).agg(*(v.alias(k) for k, v in _weighted_line(g * (1 + 1e-4) / (g + 1e-4), F.col("__e")).items()))
        lines = {part: robust.line_from_sums(f"__{part}_") for part in "ab"}
        fit = sums.select(*keys, "last", *(lines["a"][k].alias(k) for k in ("level", "level_err", "slope", "slope_err")), lines["b"]["slope"].alias("crx"), lines["b"]["slope_err"].alias("crx_err"), (F.col("__a_n") >= 3).alias("__enough"))
        fit = fit.withColumn("moving", F.coalesce(F.col("__enough") & (F.abs(F.col("level") - F.col("last")) >= F.col("level_err") * 0.1), F.lit(False)))
        state = materialize(fit)  # one row a group
        settled = state.filter("not moving")
        done = settled if done is None else done.union(settled)
        if state.filter("moving").isEmpty():
            break
    else:
        done = done.union(state.filter("moving"))
    out = named(done.select(*keys, *(F.when(F.col("__enough"), F.col(k)).alias(k) for k in FIT)))
    return rows.select(*keys).distinct().join(out, same(), "left").select(*keys, *FIT)
