"""Operators along an ordered axis, as windows within a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def along(keys: Sequence[str], order: Sequence[str] | str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*([order] if isinstance(order, str) else order))


def gradient(value: Column, w: WindowSpec) -> Column:
    """Half the difference of both neighbours, at the first and last row the difference to the only one; a missing one gives null."""
    before, after, there = F.lag(value).over(w), F.lead(value).over(w), F.lit(1)
    return F.when(F.lag(there).over(w).isNull(), after - value).when(F.lead(there).over(w).isNull(), value - before).otherwise((after - before) / 2)


def circular_sum(df: DataFrame, keys: Sequence[str], order: str, value: str, *, reach: int = 2, name: str = "box") -> DataFrame:
    """Sum of the values within reach places on both sides, around the ends."""
    every = Window.partitionBy(*keys)
    rows = df.withColumns({"__i": F.row_number().over(along(keys, order)) - 1, "__n": F.count(F.lit(1)).over(every)})
    ends = every.orderBy("__i")
    total = F.sum(value).over(ends.rowsBetween(-reach, reach))
    # the ends of the group, one small array each
    head = F.collect_list(F.when(F.col("__i") < reach, F.col(value))).over(every)
    tail = F.collect_list(F.when(F.col("__i") >= F.col("__n") - reach, F.col(value))).over(every)
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    wrapped = F.when(F.col("__i") < reach, add(F.slice("__tail", (F.col("__i") + 1).cast("int"), (F.lit(reach) - F.col("__i")).cast("int")))).otherwise(F.lit(0.0))
    over = F.col("__i") + reach - F.col("__n") + 1
    wrapped = wrapped + F.when(over > 0, add(F.slice("__head", F.lit(1), over.cast("int")))).otherwise(F.lit(0.0))
    return rows.withColumns({"__box": total, "__head": head, "__tail": tail}).withColumn(name, F.col("__box") + wrapped).drop("__i", "__n", "__box", "__head", "__tail")


def zero_crossings(df: DataFrame, keys: Sequence[str], order: str, wave: str, slope: str, flux: str) -> DataFrame:
    """Rows where a slope changes sign to the next row: kind (1 from falling to rising), crossing wavelength and depth.

    The crossing is where the straight line through both slopes is zero; the depth is one minus the flux over the mean of
    its neighbours' (0 at the ends). Missing slopes give no crossing.
    """
    w = along(keys, order)
    rows = df.withColumns({"__s": F.lead(slope).over(w), "__w": F.lead(wave).over(w), "__b": F.lag(flux).over(w), "__a": F.lead(flux).over(w)})
    found = rows.filter((F.signum("__s") != F.signum(slope)) & F.col(slope).isNotNull() & F.col("__s").isNotNull())
    at = F.col(wave) - F.try_divide(F.col(slope) * (F.col("__w") - F.col(wave)), F.col("__s") - F.col(slope))
    depth = F.coalesce(F.lit(1.0) - F.try_divide(F.col(flux), (F.col("__b") + F.col("__a")) / 2), F.lit(0.0))
    return found.withColumns({"kind": F.when(F.col("__s") > F.col(slope), 1).otherwise(-1), "crossing": at, "depth": depth}).drop("__s", "__w", "__b", "__a")


def moving_median(value: Column, w: WindowSpec, half: int) -> Column:
    """Median of the values within half places; null where fewer than half of them are known."""
    frame = w.rowsBetween(-half, half)
    return F.when(F.count(value).over(frame) >= half, F.percentile(value, F.lit(0.5)).over(frame))


def weighted_neighbours(value: Column, w: WindowSpec, weights: Sequence[float]) -> Column:
    """Sum of the neighbours times fixed weights (a smoothing or derivative filter); null where one is missing."""
    half = len(weights) // 2
    out = F.lit(0.0)
    for k, c in enumerate(weights):
        place = k - half
        near = F.lag(value, -place).over(w) if place < 0 else F.lead(value, place).over(w) if place else value
        out = out + near * float(c)
    return out


def box_medians(df: DataFrame, keys: Sequence[str], index: str, value: str, *, width: int, length: str) -> DataFrame:
    """Running medians in boxes of width, a quarter of it apart, from half a box before the start: box, centre, median.

    A box ends one place before the last at most; it counts with three places and three known values or more. length is
    a column with the number of places of the group. Each place goes to the few boxes that hold it.
    """
    step, start = width // 4, -width // 2
    i, n = F.col(index), F.col(length)
    first = F.greatest(F.ceil((i - width + 1 - start) / F.lit(step)), F.lit(0)).cast("bigint")
    last = F.least(F.floor((i - start) / F.lit(step)), F.ceil((n + width // 2 - start) / F.lit(step)) - 1).cast("bigint")
    held = df.filter(i < n - 1).withColumn("__box", F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    out = held.groupBy(*keys, F.col("__box").alias("box")).agg(F.avg(i).alias("centre"), F.percentile(value, F.lit(0.5)).alias("median"), F.count(F.lit(1)).alias("__n"), F.count(value).alias("__known"))
    return out.filter("__n >= 3 and __known >= 3").drop("__n", "__known")
