"""Outlier-resistant statistics by group."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenrv.functions.spectral import finite, normal_fraction
from lumenrv.kernels import groups
from lumenrv.sources.scratch import materialize


def _same(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys], F.lit(True))


def _square(error: Column) -> Column:
    return F.when(error * error > 0, error * error)


def _round(likely: Column, q: Column, odd: float) -> Column:
    """Weight of a point: its chance to be valid over its squared error."""
    return (F.lit(1.0) - F.lit(odd) / (likely + odd)) / q


def listed(value: Column, counts: Column) -> Column:
    """Values of a group as an array, NaN where missing, of the rows that count; arrays of the same rows go together."""
    return F.collect_list(F.when(counts, F.coalesce(value, F.lit(float("nan")))))


def of_lists(run: Callable[..., list[pa.Array]], fields: dict[str, str]) -> Callable[..., Column]:
    """A function of columns of listed(): run gets each one's values, one group after the other, and the groups' sizes."""
    kind = pa.struct([(k, pa.float64()) for k in fields])

    def whole(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for lists in batches:
            sizes = pc.list_value_length(lists[0]).to_numpy(zero_copy_only=False).astype(np.int64)
            values = [x.flatten().to_numpy(zero_copy_only=False) for x in lists]
            ends, parts = np.append(0, np.cumsum(sizes)), []
            for a, b in groups.slices(sizes):
                columns = run(*(v[ends[a] : ends[b]] for v in values), sizes[a:b])
                parts.append(pa.StructArray.from_arrays(columns, fields=list(kind)))
            yield pa.chunked_array(parts, kind).combine_chunks() if parts else pa.array([], kind)

    whole.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    return F.arrow_udf(whole, ", ".join(f"{k} {v}" for k, v in fields.items()))


def mean_of_lists(odd: float, rounds: int, converged: float, about_median: bool) -> Callable[..., Column]:
    """struct(mean, err) of the listed() values and squared errors of a group."""

    def run(v: np.ndarray, q: np.ndarray, sizes: np.ndarray) -> list[pa.Array]:
        return [pa.array(x, mask=np.isnan(x)) for x in groups.robust_means(v, q, sizes, odd, rounds, converged, about_median)]

    return of_lists(run, {"mean": "double", "err": "double"})


def crowded(df: DataFrame, keys: Sequence[str], most: int) -> DataFrame | None:
    """Keys (as __key) of the groups of more than most rows, or None where there is none, as is usual."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")).filter(F.col("__rows") > most)
    large = materialize(counts.select(*(F.col(k).alias(f"__key_{k}") for k in keys)))  # written first, so that df is counted once
    return None if large.isEmpty() else large


#: A group's histogram has so many steps of about equal counts.
STEPS = 1024


def _narrowed(rows: DataFrame, keys: list[str], targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round: rows (keys, __v) and targets (keys, __t: array of struct(s, k0, k1, f0, f1)) between the steps around each target.

    k0 and k1 are places among the rows of the group, f0 and f1 the values there once they are known. The steps are only a
    guess: exact counts below, at and between the two that enclose a target tell where its places lie.
    """
    steps = rows.groupBy(*keys).agg(F.percentile_approx("__v", F.array(*(F.lit(i / STEPS) for i in range(STEPS + 1))), F.lit(10 * STEPS)).alias("__q"), F.count(F.lit(1)).alias("__n"))
    named = targets.select(*(F.col(k).alias(f"__key_{k}") for k in keys), "__t")
    step = lambda i: F.get("__q", i.cast("int"))
    low = lambda t: F.greatest(F.floor(t["k0"] / F.col("__n") * STEPS) - 1, F.lit(0))
    high = lambda t: F.least(F.ceil(t["k1"] / F.col("__n") * STEPS) + 1, F.lit(STEPS))
    ends = F.transform("__t", lambda t: F.struct(t["s"].alias("s"), t["k0"].alias("k0"), t["k1"].alias("k1"), t["f0"].alias("f0"), t["f1"].alias("f1"), step(low(t)).alias("a"), step(high(t)).alias("b")))
    held = materialize(steps.join(named, _same(keys)).select(*(F.col(k).alias(f"__key_{k}") for k in keys), "__n", F.explode(ends).alias("__t")).select(*(f"__key_{k}" for k in keys), "__n", "__t.*"))
    met = rows.join(held, _same(keys))
    count = lambda c: F.sum(c.cast("long"))
    v, a, b = F.col("__v"), F.col("a"), F.col("b")
    sums = met.groupBy(*keys, "__n", "s", "k0", "k1", "f0", "f1", "a", "b").agg(count(v < a).alias("a0"), count(v <= a).alias("a1"), count(v < b).alias("b0"), count(v <= b).alias("b1"))

    def at(k: str, known: str) -> Column:
        place = F.col(k)
        return F.coalesce(F.col(known), F.when((place >= F.col("a0")) & (place < F.col("a1")), a), F.when((place >= F.col("b0")) & (place < F.col("b1")), b))

    found = sums.withColumns({"f0": at("k0", "f0"), "f1": at("k1", "f1")})
    place = F.when(F.col("f0").isNull(), F.col("k0")).otherwise(F.col("k1"))  # if both are open they lie in one stretch
    side = F.when(place < F.col("a0"), -1).when(place < F.col("b0"), 0).otherwise(1)
    before = F.when(side == -1, F.lit(0)).when(side == 0, F.col("a1")).otherwise(F.col("b1"))
    found = found.select(
        *keys, "s", (F.col("k0") - before).alias("k0"), (F.col("k1") - before).alias("k1"), "f0", "f1",
        F.when(side == 0, a).when(side == 1, b).alias("low"), F.when(side == -1, a).when(side == 0, b).alias("high"),
        F.when(side == -1, F.col("a0")).when(side == 0, F.col("b0") - F.col("a1")).otherwise(F.col("__n") - F.col("b1")).alias("left"))
    found = materialize(found)
    open_ = found.filter("f0 is null or f1 is null").select(*(F.col(k).alias(f"__key_{k}") for k in keys), F.col("s").alias("__s"), "low", "high")
    inside = F.coalesce(v > F.col("low"), F.lit(True)) & F.coalesce(v < F.col("high"), F.lit(True))
    again = [k for k in keys if k != "__share"]
    rest = rows.join(open_, _same(keys) & inside).select(*again, F.col("__s").alias("__share"), "__v")
    return found.select(*again, F.col("s").alias("__share"), "k0", "k1", "f0", "f1", "left"), materialize(rest)


def _percentiles_by_rounds(known: DataFrame, keys: list[str], shares: Sequence[float], gathered: int) -> DataFrame:
    """keys, __p for groups of any size: rounds narrow each percentile's stretch until gathered values at most are left of it."""
    counts = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    null = F.lit(None).cast("double")
    place = lambda i: F.lit(shares[i]) * (F.col("__n") - 1)
    target = lambda i: F.struct(F.lit(i).alias("s"), F.floor(place(i)).alias("k0"), F.ceil(place(i)).alias("k1"), null.alias("f0"), null.alias("f1"))
    counted = materialize(counts)
    targets, rows, by, done = counted.select(*keys, F.array(*map(target, range(len(shares)))).alias("__t")), known, keys, None
    while True:
        found, rows = _narrowed(rows, by, targets)
        by = [*keys, "__share"]
        few = found.filter((F.col("left") <= gathered) | (F.col("f0").isNotNull() & F.col("f1").isNotNull()))
        listed = rows.join(few.filter("f0 is null or f1 is null").select(*(F.col(k).alias(f"__key_{k}") for k in by)), _same(by), "left_semi").groupBy(*by).agg(F.array_sort(F.collect_list("__v")).alias("__l")).select(*(F.col(k).alias(f"__key_{k}") for k in by), "__l")
        at = lambda k, f: F.coalesce(F.col(f), F.get("__l", F.col(k).cast("int"))).alias(f)
        settled = few.join(listed, _same(by), "left").select(*by, at("k0", "f0"), at("k1", "f1"))
        done = settled if done is None else done.union(settled)
        more = found.filter((F.col("left") > gathered) & (F.col("f0").isNull() | F.col("f1").isNull()))
        if more.isEmpty():
            break
        targets = more.select(*by, F.array(F.struct(F.col("__share").alias("s"), "k0", "k1", "f0", "f1")).alias("__t"))
        rows = rows.join(more.select(*(F.col(k).alias(f"__key_{k}") for k in by)), _same(by), "left_semi")
    both = done.join(counted.select(*(F.col(k).alias(f"__key_{k}") for k in keys), "__n"), _same(keys))
    exact = F.element_at(F.array(*map(F.lit, shares)), F.col("__share") + 1) * (F.col("__n") - 1)
    part = exact - F.floor(exact)
    value = F.when(F.col("f0") == F.col("f1"), F.col("f0")).otherwise((1 - part) * F.col("f0") + part * F.col("f1"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("__share").alias("s"), value.alias("x"))))
    return both.groupBy(*keys).agg(F.transform(ordered, lambda p: p["x"]).alias("__p"))


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], *, name: str = "p", gathered: int = 20_000, infinite: bool = False) -> DataFrame:
    """Exact percentiles (linear between places, as an array) of groups of any size; missing values do not count.

    Groups of up to gathered values are sorted in one row. Of larger ones a histogram of about equal steps, with exact counts,
    tells between which values a percentile lies; what lies there goes into the next round, until gathered values at most are
    left. No array grows with a group, nor with its number of equal values. A group without values has no row. NaN and, unless
    infinite is set, infinities are missing. df is read twice: hand over a written table where that is dear.
    """
    keys = list(keys)
    x = F.col(value).cast("double")
    known = df.select(*keys, (F.nanvl(x, F.lit(None)) if infinite else finite(x)).alias("__v")).filter("__v is not null")
    large = crowded(known, keys, gathered)
    few = known if large is None else known.join(large, _same(keys), "left_anti")
    out = few.groupBy(*keys).agg(F.percentile("__v", F.array(*map(F.lit, shares))).alias("__p"))
    if large is not None:
        out = out.union(_percentiles_by_rounds(materialize(known.join(large, _same(keys), "left_semi")), keys, shares, gathered))
    return out.select(*keys, F.col("__p").alias(name))


def exact_median(df: DataFrame, keys: Sequence[str], value: str, *, name: str = "median", gathered: int = 20_000) -> DataFrame:
    return exact_percentiles(df, keys, value, [0.5], name="__p", gathered=gathered).select(*keys, F.get("__p", F.lit(0)).alias(name))


def _by_rounds(known: DataFrame, keys: list[str], odd: float, rounds: int, converged: float, middle: DataFrame) -> DataFrame:
    """Groups of any size, from their medians on: every round is one grouping with partial sums of the groups that still move."""
    named = [F.col(k).alias(f"__key_{k}") for k in keys]
    state = materialize(middle.select(*named, F.col("__g"), F.lit(float("inf")).alias("__last"), F.lit(1.0).alias("__bulk")))
    moving = F.coalesce(F.abs(F.col("__g") - F.col("__last")) / F.col("__bulk") > converged, F.lit(False))
    for i in range(rounds):
        go = state.filter(moving)
        if i and go.isEmpty():
            break
        weight = _round(F.exp(F.pow(F.col("__v") - F.col("__g"), F.lit(2)) / F.col("__q") * -0.5) * (1 - odd), F.col("__q"), odd)
        sums = known.join(go, _same(keys)).groupBy(*keys, "__g").agg(F.sum(F.col("__v") * weight).alias("__vw"), F.sum(weight).alias("__w"))
        moved = sums.select(*named, F.try_divide("__vw", "__w").alias("__n"), F.col("__g").alias("__last"), F.sqrt(F.try_divide(F.lit(1.0), F.col("__w"))).alias("__bulk"))
        state = materialize(moved.withColumnRenamed("__n", "__g").union(state.filter(~moving)))
    return state.select(*(F.col(f"__key_{k}").alias(k) for k in keys), F.struct(F.col("__g").alias("mean"), F.col("__bulk").alias("err")).alias("__m"))


def _means_by_rounds(held: DataFrame, keys: list[str], pairs: int, odd: float, rounds: int, converged: float, about_median: bool) -> DataFrame:
    """keys, __pair, __m for groups of any size: all pairs go through the same passes, as groups of their own."""
    by = [*keys, "__pair"]
    each = F.inline(F.array(*(F.struct(F.lit(i).alias("__pair"), F.col(f"__v{i}").alias("__v"), F.col(f"__q{i}").alias("__q")) for i in range(pairs))))
    every = held.select(*keys, each) if pairs > 1 else held.select(*keys, F.lit(0).alias("__pair"), F.col("__v0").alias("__v"), F.col("__q0").alias("__q"))
    middle_of = lambda t: _percentiles_by_rounds(t, by, [0.5], 20_000).select(*by, F.get("__p", F.lit(0)).alias("__g"))
    known = every.filter("__v is not null and __q is not null")
    if about_median:
        off = middle_of(every.filter("__v is not null").select(*by, "__v")).select(*(F.col(k).alias(f"__key_{k}") for k in by), F.col("__g").alias("__c"))
        known = materialize(known.join(off, _same(by)).select(*by, (F.col("__v") - F.col("__c")).alias("__v"), "__q"))
    return _by_rounds(known, by, odd, rounds, converged, middle_of(known.select(*by, "__v")))


def robust_means(
    df: DataFrame, keys: Sequence[str], pairs: Sequence[tuple[str, str, str, str]], *, odd: float = 2e-4, rounds: int = 10, converged: float = 1e-2,
    about_median: bool = False, count_name: str | None = None, rows_name: str | None = None, gathered: int = 100_000,
) -> DataFrame:
    """Means of mixtures of valid points and outliers, with errors, of several pairs (value, error, their names) in one grouping.

    A mean starts at the median; a point's weight is its chance to be valid over its squared error. It settles when it moves by
    converged of its error or less, at latest after rounds. Points with a missing value or error, or an error of zero, do not count; a
    group without any has nulls. With about_median the median of a group's values, also of those without an error, is taken off
    first. Groups of up to gathered rows are worked on in one row each after one shuffle; larger ones go round by round with
    partial sums, for all pairs at once. Both ways give the same numbers. count_name adds the number of points of the first pair, rows_name that of
    rows. df is read twice, and nothing of its rows is written unless groups are larger: hand over a written table where it is dear.
    """
    keys = list(keys)
    points = df.select(*keys, *(c for i, (value, error, *_) in enumerate(pairs) for c in (finite(F.col(value)).alias(f"__v{i}"), _square(finite(F.col(error))).alias(f"__q{i}"))))
    large = crowded(points, keys, gathered)
    small = points if large is None else points.join(large, _same(keys), "left_anti")
    lists = []
    for i in range(len(pairs)):
        v, q = F.col(f"__v{i}"), F.col(f"__q{i}")
        counts = v.isNotNull() & (F.lit(about_median) | q.isNotNull())
        lists += [listed(v, counts).alias(f"__l{i}"), listed(q, counts).alias(f"__s{i}")]
    totals = [F.count(F.lit(1)).alias("__rows"), F.count(F.col("__v0") + F.col("__q0")).alias("__n")]
    mean = mean_of_lists(odd, rounds, converged, about_median)
    out = small.groupBy(*keys).agg(*totals, *lists).select(*keys, "__rows", "__n", *(mean(f"__l{i}", f"__s{i}").alias(f"__m{i}") for i in range(len(pairs))))
    if large is not None:
        held = materialize(points.join(large, _same(keys), "left_semi"))
        found = _means_by_rounds(held, keys, len(pairs), odd, rounds, converged, about_median)
        wide = found.groupBy(*keys).agg(*(F.max(F.when(F.col("__pair") == i, F.col("__m"))).alias(f"__m{i}") for i in range(len(pairs))))
        wide = wide.select(*(F.col(k).alias(f"__key_{k}") for k in keys), *(f"__m{i}" for i in range(len(pairs))))
        out = out.union(held.groupBy(*keys).agg(*totals).join(wide, _same(keys), "left").select(*keys, "__rows", "__n", *(f"__m{i}" for i in range(len(pairs)))))
    named = [c for i, (_, _, name, error_name) in enumerate(pairs) for c in (F.col(f"__m{i}.mean").alias(name), F.col(f"__m{i}.err").alias(error_name))]
    return out.select(*keys, *named, *([F.col("__n").cast("long").alias(count_name)] if count_name else []), *([F.col("__rows").alias(rows_name)] if rows_name else []))


def odd_ratio_mean(df: DataFrame, keys: Sequence[str], value: str, error: str, *, name: str = "mean", error_name: str = "mean_err", **settings) -> DataFrame:
    """robust_means of one pair."""
    return robust_means(df, keys, [(value, error, name, error_name)], **settings)


def robust_sigma(value: Column, sigma: float = 1.0) -> Column:
    """Half the distance of the percentiles that lie sigma around the median; an aggregate that skips missing values."""
    p = (1 + normal_fraction(sigma)) / 2
    ends = F.percentile(finite(value), F.array(F.lit(1 - p), F.lit(p)))
    return (F.get(ends, F.lit(1)) - F.get(ends, F.lit(0))) / 2


def percentiles(value: Column, shares: Sequence[float]) -> Column:
    return F.percentile(finite(value), F.array(*map(F.lit, shares)))


def nan_stats(value: Column) -> dict[str, Column]:
    """Aggregates that skip missing values; the sum of none is 0."""
    v = finite(value)
    return {
        "n_valid": F.count(v), "total": F.coalesce(F.sum(v), F.lit(0.0)), "mean": F.avg(v), "median": F.percentile(v, F.lit(0.5)),
        "std": F.stddev_pop(v), "least": F.min(v), "most": F.max(v),
    }


def inverse_variance(value: Column, error: Column) -> tuple[Column, Column]:
    """Weighted mean and error as aggregates: numerator and denominator skip missing values apart; without errors null."""
    v, q = finite(value), F.pow(finite(error), F.lit(2))
    inverse = F.try_divide(F.lit(1.0), q)
    total = F.sum(inverse)
    mean = F.try_divide(F.coalesce(F.sum(v * inverse), F.lit(0.0)), total)
    return mean, F.sqrt(F.try_divide(F.lit(1.0), total))


def derivative_projection(vector: Column, difference: Column, rms: Column) -> tuple[Column, Column]:
    """Projection of a difference on a derivative and its error; one missing term makes both null."""
    whole = F.count(finite(vector) + finite(difference) + finite(rms)) == F.count(F.lit(1))
    value = F.try_divide(F.sum(difference * vector), F.sum(vector * vector))
    error = F.sqrt(F.try_divide(F.lit(1.0), F.sum(F.pow(vector / rms, F.lit(2)))))
    return F.when(whole, value), F.when(whole, error)


def line_fit(x: Column, y: Column, weight: Column) -> dict[str, Column]:
    """Sums of a weighted straight line (weights multiply the residuals, as in polynomial fitting), as aggregates."""
    w = weight * weight
    return {"n": F.count(F.lit(1)), "s": F.sum(w), "sx": F.sum(w * x), "sy": F.sum(w * y), "sxx": F.sum(w * x * x), "sxy": F.sum(w * x * y), "syy": F.sum(w * y * y)}


def line_from(sums: Callable[[str], Column]) -> dict[str, Column]:
    """Slope, level and their errors from line_fit's sums; the covariance is scaled by the residuals' chi squared."""
    s, sx, sy, sxx, sxy, syy, n = (sums(c) for c in ("s", "sx", "sy", "sxx", "sxy", "syy", "n"))
    det = s * sxx - sx * sx
    slope, level = F.try_divide(s * sxy - sx * sy, det), F.try_divide(sxx * sy - sx * sxy, det)
    chi = F.greatest(syy - slope * sxy - level * sy, F.lit(0.0))
    scale = F.try_divide(chi, n - 2)
    return {"slope": slope, "level": level, "slope_err": F.sqrt(scale * F.try_divide(s, det)), "level_err": F.sqrt(scale * F.try_divide(sxx, det))}


def line_from_sums(prefix: str = "") -> dict[str, Column]:
    """line_from columns of the given prefix."""
    return line_from(lambda c: F.col(prefix + c))
