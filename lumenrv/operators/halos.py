"""Convolution and correlation along axes longer than a row: blocks of the axis, each with the halo that its ends need.

A row is dealt to the block of its place and, near a border, to the block beyond it as well, so that blocks are worked on by
themselves (overlap and save). A block is an array of width + halo numbers, whatever the length of the axis.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenrv.functions.spectral import finite
from lumenrv.kernels import curves


def halo_blocks(df: DataFrame, keys: Sequence[str], index: str, value: str, *, width: int, before: int, after: int) -> DataFrame:
    """keys, block, values and there: the numbers of places block * width - before up to (block + 1) * width + after as an array.

    Blocks without a row of their own are left out. A place without a row is zero; of several rows of a place the values add
    up. A missing value is null. there: the block's own places, from its first, that have a row.
    """
    i = F.col(index).cast("long")
    home = F.floor(i / width).cast("long")
    first, last = F.floor((i - after) / width).cast("long"), F.floor((i + before) / width).cast("long")
    rows = df.filter(F.col(index).isNotNull()).select(*keys, i.alias("__i"), finite(F.col(value)).alias("__v"), home.alias("__home"), F.explode(F.sequence(first, last)).alias("block"))
    known = F.when(F.count("__v") == F.count(F.lit(1)), F.sum("__v"))
    places = rows.groupBy(*keys, "block", "__home", "__i").agg(known.alias("__v"))
    at = (F.col("__i") - F.col("block") * width + before).cast("int")
    own = F.col("__home") == F.col("block")
    listed = places.groupBy(*keys, "block").agg(F.map_from_entries(F.collect_list(F.struct(at.alias("k"), F.struct(F.col("__v").alias("v")).alias("v")))).alias("__m"), F.collect_list(F.when(own, at - before)).alias("__t"))
    cell = lambda k: F.coalesce(F.try_element_at("__m", k.cast("int")), F.struct(F.lit(0.0).alias("v")))["v"]
    array = F.transform(F.sequence(F.lit(0), F.lit(width + before + after - 1)), cell)
    return listed.filter(F.size("__t") > 0).select(*keys, "block", array.alias("values"), F.array_sort("__t").alias("there"))


def convolved(df: DataFrame, keys: Sequence[str], index: str, value: str, kernel: Sequence[float], *, width: int = 4096, name: str = "convolved") -> DataFrame:
    """keys, index and the convolution with a kernel, centred as by numpy's 'same', at every place that has a row.

    Beyond the axis and where a row is missing there are zeros; where a missing value is within the kernel's reach the result
    is null. The result does not depend on width; a kernel longer than width makes more copies of each row.
    """
    k = np.asarray(kernel, float)
    left, right = len(k) // 2, (len(k) - 1) // 2
    blocks = halo_blocks(df, keys, index, value, width=width, before=left, after=right)

    @F.arrow_udf("array<double>")
    def valid(values: pa.Array) -> pa.Array:
        flat = values.flatten().to_numpy(zero_copy_only=False).astype(float)  # null becomes NaN
        rows = flat.reshape(len(values), width + left + right)
        out = np.stack([np.convolve(np.nan_to_num(r), k, "valid") for r in rows])
        lost = np.stack([np.convolve(np.isnan(r).astype(float), np.ones(len(k)), "valid") > 0.5 for r in rows])
        return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * width, pa.array(out.ravel(), mask=lost.ravel()))

    done = blocks.select(*keys, "block", "there", valid("values").alias("__y")).select(*keys, "block", "__y", F.explode("there").alias("__t"))
    return done.select(*keys, (F.col("block") * width + F.col("__t")).alias(index), F.get("__y", F.col("__t")).alias(name))


def correlated(df: DataFrame, template: DataFrame, keys: Sequence[str], index: str, value: str, weight: str, reach: int, *, width: int = 4096) -> DataFrame:
    """keys and ccf: for shifts -reach to reach the sum over all places i of the template's weight at i times the value at i + shift.

    Places without a value, or where it is missing, add nothing. Blocks of both meet by an equal join on the block's number;
    each gives 2 * reach + 1 numbers, which are added up by key. Keys without a block in common with the template are absent.
    """
    known = df.select(*keys, index, F.coalesce(finite(F.col(value)), F.lit(0.0)).alias(value))
    # a block with no value of its own can still be reached from the template's block: it gets a zero at its first place
    ends = known.select(*keys, index, value, F.explode(F.array_distinct(F.transform(F.array(F.lit(-reach), F.lit(0), F.lit(reach)), lambda s: F.floor((F.col(index) + s) / width)))).alias("block"))
    empty = ends.select(*keys, (F.col("block") * width).alias(index), F.lit(0.0).alias(value)).distinct()
    blocks = halo_blocks(known.select(*keys, F.col(index).cast("long").alias(index), value).union(empty), keys, index, value, width=width, before=reach, after=reach)
    lists = halo_blocks(template.select(index, weight), [], index, weight, width=width, before=0, after=0).select(F.col("block").alias("__b"), F.transform("values", lambda v: F.coalesce(v, F.lit(0.0))).alias("__w"))

    @F.arrow_udf("array<double>")
    def products(values: pa.Array, weights: pa.Array) -> pa.Array:
        x = values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(values), width + 2 * reach)
        w = weights.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(values), width)
        out = np.concatenate([np.correlate(a, b, "valid") for a, b in zip(x, w)])
        return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * (2 * reach + 1), pa.array(out))

    met = blocks.join(lists, F.col("block") == F.col("__b")).select(*keys, F.posexplode(products("values", "__w")).alias("__s", "__p"))
    sums = met.groupBy(*keys, "__s").agg(F.sum("__p").alias("__p"))
    return sums.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__s", "__p"))), lambda p: p["__p"]).alias("ccf"))


def rough_velocity(spectra: DataFrame, lines: DataFrame, keys: Sequence[str], index: str, value: str, weight: str, *, step: float, reach: int, filter_width: int, start_width: float = 2000.0, least_snr: float = 7.0, width: int = 4096) -> DataFrame:
    """keys, velocity, ewidth, snr and ok of spectra on a grid of constant velocity step, from their correlation with a list of lines.

    The correlation less its own low-pass is fitted by a Gaussian with level and slope; velocity is that of its centre (a
    shift to larger places is a receding star), ok whether its depth or height is least_snr robust sigmas or more. Where the fit fails all are
    null and ok is false.
    """
    ccf = correlated(spectra, lines, keys, index, value, weight, reach, width=width)

    @F.arrow_udf("struct<velocity: double, ewidth: double, snr: double>")
    def fit(rows: pa.Array) -> pa.Array:
        out = []
        x = np.arange(-reach, reach + 1) * step
        model = lambda x, a, centre, sigma, level, slope: a * np.exp(-0.5 * ((x - centre) / sigma) ** 2) + level + (x - centre) * slope
        for r in rows.to_pylist():
            y = np.array(r, float)
            y = y - curves.low_pass(y, filter_width)
            peak = int(np.argmax(np.abs(y - np.median(y))))
            try:
                p, _ = curves.least_squares(model, x, y, [y[peak] - np.median(y), x[peak], start_width, float(np.median(y)), 0.0])
                low, high = np.percentile(y, [15.865525393145708, 84.13447460685429])
                out.append({"velocity": float(p[1]), "ewidth": abs(float(p[2])), "snr": abs(float(p[0])) / ((high - low) / 2)})
            except (ValueError, ArithmeticError, np.linalg.LinAlgError):
                out.append(None)
        return pa.array(out, pa.struct([("velocity", pa.float64()), ("ewidth", pa.float64()), ("snr", pa.float64())]))

    done = ccf.select(*keys, fit("ccf").alias("__f")).select(*keys, *(finite(F.col(f"__f.{c}")).alias(c) for c in ("velocity", "ewidth", "snr")))
    return done.withColumn("ok", F.coalesce(F.col("snr") >= least_snr, F.lit(False)))


def peak_vertex(values: Column, best: Column) -> Column:
    """Place of a parabola's vertex through an array's value at best (from 0) and its neighbours; best itself at an end."""
    a, b, c = (F.get(values, best + k) for k in (-1, 0, 1))
    return F.coalesce(best + F.try_divide(a - c, (a - 2 * b + c) * 2), best.cast("double"))


def air_exponents(
    spectra: DataFrame, air: DataFrame, keys: Sequence[str], index: str, flux: str, species: Mapping[str, str], masks: Mapping[str, str], *, kernel: Sequence[float] = (1.0,),
    bounds: Mapping[str, tuple[float, float]], rounds: int = 20, settled: float = 1e-4, delta: float = 0.02,
) -> DataFrame:
    """Exponents of two absorbers of the air for every exposure of a table: keys, an exponent for each of species, rounds.

    air (one row a place): species names the columns of their transmissions, masks those of weights whose sum with a spectrum
    is how deep an absorber's lines are. With transmissions to the powers of the exponents, smoothed by the kernel, divided
    out, both depths shall be zero. All exposures move together: a round is one grouping that sums both depths at the present
    exponents and beside them, then a secant step of the two unknowns within bounds; an exposure whose step is below settled
    leaves. No spectrum is ever one row. Missing flux adds nothing. Exponents start at 1.
    """
    from pyspark.sql import Window

    from lumenrv.sources.scratch import materialize

    one, two = species
    half = len(kernel) // 2
    w = Window.partitionBy().orderBy(index)  # the air's grid is an instrument's
    logs = air.select(index, *(F.log(F.greatest(F.col(c), F.lit(1e-6))).alias(f"__t{k}") for k, c in enumerate(species.values())), *(F.col(masks[s]).alias(f"__m{k}") for k, s in enumerate(species)))
    near = F.array(*(F.struct(F.coalesce(F.lag("__t0", -j).over(w), F.lit(0.0)).alias("x"), F.coalesce(F.lag("__t1", -j).over(w), F.lit(0.0)).alias("y"), F.lit(float(kernel[half + j])).alias("k")) for j in range(-half, len(kernel) - half)))
    grid = materialize(logs.select(F.col(index).alias("__i"), near.alias("__near"), "__m0", "__m1"))
    met = materialize(spectra.select(*keys, index, finite(F.col(flux)).alias("__f")).filter("__f is not null").join(grid, F.col(index) == F.col("__i")).filter("__m0 <> 0 or __m1 <> 0"))
    total = float(np.sum(kernel))

    def depth(mask: str, a: Column, b: Column) -> Column:
        through = F.aggregate("__near", F.lit(0.0), lambda s, p: s + p["k"] * F.exp(p["x"] * a + p["y"] * b)) / total
        return F.sum(F.col(mask) * F.col("__f") / F.greatest(through, F.lit(1e-3)))

    low, high = ({s: bounds[s][k] for s in species} for k in (0, 1))
    start = {s: min(max(1.0, low[s]), high[s]) for s in species}
    state = materialize(met.select(*keys).distinct().select(*keys, F.lit(start[one]).alias("a"), F.lit(start[two]).alias("b"), F.lit(0).alias("rounds"), F.lit(True).alias("moving")))
    done = None
    for number in range(1, rounds + 1):
        live = state.filter("moving").select(*(F.col(k).alias(f"__key_{k}") for k in keys), "a", "b")
        same = [F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys]
        a, b = F.col("a"), F.col("b")
        sums = met.join(live, same).groupBy(*keys, "a", "b").agg(*(depth(f"__m{m}", a + da, b + db).alias(f"d{m}{n}") for m in (0, 1) for n, (da, db) in enumerate(((0.0, 0.0), (delta, 0.0), (0.0, delta)))))
        j = {f"{m}{n}": (F.col(f"d{m}{n + 1}") - F.col(f"d{m}0")) / delta for m in (0, 1) for n in (0, 1)}
        det = j["00"] * j["11"] - j["01"] * j["10"]
        steps = (F.try_divide(j["01"] * F.col("d10") - j["11"] * F.col("d00"), det), F.try_divide(j["10"] * F.col("d00") - j["00"] * F.col("d10"), det))
        limited = [F.coalesce(F.least(F.greatest(s, F.lit(-1.0)), F.lit(1.0)), F.lit(0.0)) for s in steps]
        new = sums.select(*keys, F.least(F.greatest(a + limited[0], F.lit(low[one])), F.lit(high[one])).alias("a"), F.least(F.greatest(b + limited[1], F.lit(low[two])), F.lit(high[two])).alias("b"), F.lit(number).alias("rounds"), (F.greatest(F.abs(limited[0]), F.abs(limited[1])) >= settled).alias("moving"))
        state = materialize(new)  # one row an exposure
        part = state.filter("not moving")
        done = part if done is None else done.union(part)
        if state.filter("moving").isEmpty():
            break
    else:
        done = done.union(state.filter("moving"))
    return done.select(*keys, F.col("a").alias(one), F.col("b").alias(two), "rounds")
