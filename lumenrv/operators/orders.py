"""Spectral orders: overlaps, edges, blaze, one-dimensional spectra, templates, masks."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenrv.functions.spectral import SPEED_OF_LIGHT, finite
from lumenrv.kernels.curves import Spline
from lumenrv.operators.ordered import in_blocks, running
from lumenrv.operators.robust import crowded, exact_median, robust_sigma


def trim_overlaps(df: DataFrame, keys: Sequence[str], order: str, wave: str, name: str = "inside") -> DataFrame:
    """Rows of wavelength arrays with a flag for each pixel: beyond the mirrored previous order and below the mirrored next."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = df.withColumns({"__b": F.reverse(F.lag(wave).over(w)), "__a": F.reverse(F.lead(wave).over(w))})
    above = F.transform(wave, lambda x, i: F.coalesce(x > F.get("__b", i), F.lit(True)))
    below = F.transform(wave, lambda x, i: F.coalesce(x < F.get("__a", i), F.lit(True)))
    return rows.withColumn(name, F.zip_with(above, below, lambda a, b: a & b)).drop("__b", "__a")


def is_monotone(wave: Column) -> Column:
    """Whether an array rises or falls all along."""
    steps = F.zip_with(F.slice(wave, F.lit(2), F.greatest(F.size(wave) - 1, F.lit(0))), F.slice(wave, F.lit(1), F.greatest(F.size(wave) - 1, F.lit(0))), lambda a, b: F.signum(a - b))
    return F.array_min(steps) == F.array_max(steps)


def sinc_blaze(wave: Column, order: Column, peak: Column, width: float = 1.0) -> Column:
    """(sin x / x)^2 of the distance from an order's peak in units of the order's free range."""
    x = (F.lit(1.0) - peak / wave) * order * math.pi / width
    return F.when(F.abs(x) < 1e-9, 1.0).otherwise(F.pow(F.sin(x) / x, F.lit(2)))


def normalised_mask(lines: DataFrame, keys: Sequence[str], weight: str, most: float = 10.0) -> DataFrame:
    """Lines whose weight is below most medians of the absolute weights, over the mean absolute weight of those."""
    by = list(keys) or ["__one"]
    rows = lines if keys else lines.withColumn("__one", F.lit(0))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in by]
    named = lambda t: t.select(*(F.col(k).alias(f"__{k}") for k in by), *(c for c in t.columns if c not in by))
    middle = named(exact_median(rows.withColumn("__a", F.abs(weight)), by, "__a", name="__middle_"))
    kept = rows.join(middle, same).filter(F.col(weight) < F.col("__middle_") * most).select(*rows.columns)
    mean = named(kept.groupBy(*by).agg(F.avg(F.abs(weight)).alias("__mean_")))
    return kept.join(mean, same).withColumn(weight, F.try_divide(F.col(weight), F.col("__mean_"))).select(*lines.columns)


def velocity_bins(df: DataFrame, keys: Sequence[str], velocity: str, bins: int, name: str = "bin", *, gathered: int = 100_000, blocks: int | None = None) -> DataFrame:
    """Exposures of an object dealt to bins of equal number in order of their barycentric velocity; equal ones by the first other column.

    Objects of up to gathered exposures are numbered in one task each, larger ones over blocks of the order.
    """
    other = [c for c in df.columns if c not in (*keys, velocity)][:1]
    order = [velocity, *other]
    same = [F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys]
    large = crowded(df, keys, gathered)
    w = Window.partitionBy(*keys)
    few = df if large is None else df.join(large, same, "left_anti")
    out = few.withColumn(name, F.floor((F.row_number().over(w.orderBy(*order)) - 1) * bins / F.count(F.lit(1)).over(w)).cast("int"))
    if large is None:
        return out
    many = df.join(large, same, "left_semi")
    counts = many.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).select(*(F.col(k).alias(f"__key_{k}") for k in keys), "__n")
    placed = running(in_blocks(many, keys, order, blocks), keys, order, sums={"__place": F.lit(1)}).join(counts, same)
    return out.union(placed.select(*df.columns, F.floor((F.col("__place") - 1) * bins / F.col("__n")).cast("int").alias(name)))


def box_noise(df: DataFrame, keys: Sequence[str], index: str, value: str, width: int) -> DataFrame:
    """Robust sigma in boxes of width pixels a quarter of it apart, where half of the pixels or more are known."""
    step = width // 4
    first = F.greatest(F.ceil((F.col(index) - width + 1) / F.lit(step)), F.lit(0)).cast("bigint")
    last = F.floor(F.col(index) / F.lit(step)).cast("bigint")
    dealt = df.withColumn("box", F.explode(F.sequence(first, last)))
    out = dealt.groupBy(*keys, "box").agg(robust_sigma(F.col(value)).alias("sigma"), F.count(finite(F.col(value))).alias("__k"), F.avg(index).alias("centre"))
    return out.filter(F.col("__k") * 2 >= width).drop("__k")


def edge_weights(valid: np.ndarray, size: int) -> np.ndarray:
    """Weights that fall towards the edges of the valid stretches: the mask smoothed by a Gaussian, from 0 to 1."""
    u = np.arange(-3 * size, 3 * size + 1)
    kernel = np.exp(-0.5 * (u / size) ** 2)
    w = np.convolve(valid.astype(float), kernel / kernel.sum(), "same") * valid
    if not valid.any() or w.max() == w[valid].min():
        return valid.astype(float)
    return np.clip((w - w[valid].min()) / (w.max() - w[valid].min()), 0, 1) * valid


def one_dimensional(orders: DataFrame, keys: Sequence[str], wave0: float, step: float, n: int, *, order: str = "ord", wave: str = "wave", flux: str = "flux", blaze: str = "blaze", smooth: int = 20) -> DataFrame:
    """Sum of all orders on a grid of constant velocity step: i, flux over weight, and weight, for each exposure.

    Every order is laid on the grid on its own, tapered at its edges; the sum over orders is a grouping.
    """
    names = [*keys, order]

    def lay(parts):
        for part in parts:
            rows = []
            for r in part.itertuples(index=False):
                w, f, b = (np.array(getattr(r, c), float) for c in (wave, flux, blaze))
                good = np.isfinite(f) & np.isfinite(b) & (b > 0.2 * np.nanmax(b)) if np.isfinite(b).any() else np.zeros(len(w), bool)
                if good.sum() < 10 or not (np.diff(w) > 0).all():
                    continue
                taper = edge_weights(good, smooth)
                lo, hi = (math.log(x / wave0) * SPEED_OF_LIGHT / step for x in (w[good][0], w[good][-1]))
                i = np.arange(max(math.ceil(lo), 0), min(math.floor(hi), n - 1) + 1)
                if not len(i):
                    continue
                at = wave0 * np.exp(i * step / SPEED_OF_LIGHT)
                whole = Spline(w, good.astype(float), 1, "zero")(at) > 0.9
                y = Spline(w, np.where(good, f * taper, np.nan), 5, "zero")(at)
                weight = Spline(w, np.where(good, b * taper, np.nan), 1, "zero")(at)
                rows.append(pd.DataFrame({**{k: getattr(r, k) for k in keys}, "i": i[whole], "y": y[whole], "w": weight[whole]}))
            if rows:
                yield pd.concat(rows)

    kinds = ", ".join(f"{k} {orders.schema[k].dataType.simpleString()}" for k in keys)
    laid = orders.select(*names, wave, flux, blaze).mapInPandas(lay, f"{kinds}, i long, y double, w double")
    out = laid.groupBy(*keys, "i").agg(F.sum("y").alias("y"), F.sum("w").alias("weight"))
    return out.filter("weight <> 0").select(*keys, "i", F.try_divide("y", F.col("weight")).alias("flux"), "weight")


def median_template(spectra_1d: DataFrame, exposures: DataFrame, key: str, *, bins: int = 19, least_weight: float = 0.1) -> DataFrame:
    """Template: weighted mean of each velocity bin's exposures, then median and half the 16-84 range over bins.

    exposures has key and bin. Grid points that fewer than half of the bins know have no value.
    """
    held = spectra_1d.filter(F.col("weight") >= least_weight).join(exposures.select(key, "bin"), key)
    means = held.groupBy("bin", "i").agg(F.try_divide(F.sum(F.col("flux") * F.col("weight")), F.sum("weight")).alias("f"))
    total = exposures.agg(F.count_distinct("bin").alias("bins"))  # one row
    out = means.groupBy("i").agg(F.percentile("f", F.array(F.lit(0.16), F.lit(0.5), F.lit(0.84))).alias("p"), F.count("f").alias("n")).join(F.broadcast(total))
    return out.select("i", F.when(F.col("n") * 2 >= F.col("bins"), F.get("p", F.lit(1))).alias("flux"), ((F.get("p", F.lit(2)) - F.get("p", F.lit(0))) / 2).alias("rms"), "n")
