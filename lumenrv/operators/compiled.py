"""From velocities of lines to a table of exposures: kept lines, biases, zero point, bands and regions, slopes, widths."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenrv.functions.spectral import finite, width_terms
from lumenrv.operators import robust
from lumenrv.operators.intervals import range_join
from lumenrv.operators.spectra import chromatic_slope, correlation_p
from lumenrv.sources.scratch import materialize


def kept_lines(facts: DataFrame, exposure: str, line: str, first: Column, wave: str, low: float, high: float, pixels: str, most: int) -> DataFrame:
    """The lines within the wavelength window and of fewer than most pixels, as the exposure of least first has them."""
    least = facts.agg(F.min(F.struct(first.alias("f"), exposure)).alias("__f")).select(F.col(f"__f.{exposure}").alias("__one"))  # one row
    of_first = facts.join(F.broadcast(least), F.col(exposure) == F.col("__one"))
    return of_first.filter((F.col(wave) > low) & (F.col(wave) < high) & (F.col(pixels) < most)).select(line).distinct()


def line_biases(
    facts: DataFrame, exposure: str, line: str, value: str, error: str, *, least_share: float = 0.1, least: int = 3, most: float = 100.0, centred: bool = True,
    few_exposures: bool = False, force_sigma: bool = False, correlated: tuple[DataFrame, float] | None = None,
) -> DataFrame:
    """line, bias, bias_err, scale: the robust mean of a line's differences from its exposures' robust means, about their median.

    Lines measured in less than least_share of the exposures have null, and so have those measured fewer than least times,
    unless few_exposures (for tables of fewer than five exposures) gives these their plain mean and its error. With
    force_sigma each line's errors are scaled (by scale, else 1) to the spread of its differences. correlated, (exposure, x) and a chance, drops
    the lines whose differences follow x beyond that chance. With centred the robust mean of all biases is taken off, and
    biases beyond most robust sigmas are null. facts are read several times: hand over a written table.
    """
    rows = facts.select(exposure, line, finite(F.col(value)).alias("__v"), finite(F.col(error)).alias("__s"))
    guess = robust.odd_ratio_mean(rows, [exposure], "__v", "__s", name="__g").select(exposure, "__g")
    share = rows.groupBy(line).agg((F.count("__v") / F.count(F.lit(1))).alias("__share"), F.count("__v").alias("__known"), F.avg("__v").alias("__mean"), (F.stddev_pop("__v") / F.sqrt(F.count("__v"))).alias("__err"))
    often = share.filter((F.col("__share") >= least_share) & (F.col("__known") >= least)).select(line)
    diff = materialize(rows.join(often, line, "left_semi").join(guess, exposure).select(exposure, line, (F.col("__v") - F.col("__g")).alias("__d"), "__s"))
    scales = _unit_spread(diff, line) if force_sigma else None
    if scales is not None:
        diff = materialize(diff.join(scales, line, "left").withColumn("__s", F.col("__s") * F.col("scale")).drop("scale"))
    if correlated:
        column, least_p = correlated
        diff = _uncorrelated(diff, exposure, line, column, least_p)
    found = robust.odd_ratio_mean(diff, [line], "__d", "__s", name="bias", error_name="bias_err", about_median=True)
    if few_exposures:
        seldom = share.filter((F.col("__share") >= least_share) & (F.col("__known") < least)).select(line, F.col("__mean").alias("bias"), F.col("__err").alias("bias_err"))
        found = found.union(seldom)
    found = materialize(found)
    if centred:
        one = found.withColumn("__one", F.lit(0))
        zero = robust.odd_ratio_mean(one, ["__one"], "bias", "bias_err", name="__z").select("__one", "__z")
        low = (1 - robust.normal_fraction()) / 2
        spread = robust.exact_percentiles(one, ["__one"], "bias", (low, 1 - low), name="__p")  # one row, as zero
        sigma = (F.get("__p", F.lit(1)) - F.get("__p", F.lit(0))) / 2
        moved = one.join(F.broadcast(zero.join(spread, "__one")), "__one", "left").withColumn("bias", F.col("bias") - F.col("__z"))
        kept = F.coalesce(F.abs(F.col("bias")) <= sigma * most, F.lit(False))
        found = moved.select(line, F.when(kept, F.col("bias")).alias("bias"), "bias_err")
    out = share.select(line).join(found, line, "left")
    return out.join(scales, line, "left").withColumn("scale", F.coalesce("scale", F.lit(1.0))) if force_sigma else out.withColumn("scale", F.lit(1.0))


def _unit_spread(diff: DataFrame, line: str) -> DataFrame:
    """line, scale: half the distance of the 16th and 84th percentile of a line's differences over their errors."""
    ratio = diff.withColumn("__r", F.try_divide("__d", "__s"))
    spread = robust.exact_percentiles(ratio, [line], "__r", (0.16, 0.84), name="__p")
    return materialize(spread.select(line, ((F.get("__p", F.lit(1)) - F.get("__p", F.lit(0))) / 2).alias("scale")))


def _uncorrelated(diff: DataFrame, exposure: str, line: str, along: DataFrame, least_p: float) -> DataFrame:
    """Without the lines whose differences go with a number of the exposures (along: exposure, x) with less than a chance of least_p."""
    met = diff.join(along.select(exposure, finite(F.col("x")).alias("__x")), exposure).filter("__d is not null and __x is not null")
    found = met.groupBy(line).agg(F.corr("__d", "__x").alias("__c"), F.count(F.lit(1)).alias("__n"))
    bad = found.filter(correlation_p(F.col("__c"), F.col("__n")) < least_p).select(line)
    return materialize(diff.join(bad, line, "left_anti"))


def band_velocities(facts: DataFrame, exposure: str, bands: DataFrame, regions: Mapping[str, tuple[float, float]], wave: str, pixel: str, value: str, error: str, *, width: float) -> DataFrame:
    """exposure, band (with the region's name), vrad, svrad for every exposure, band and region.

    Bands (band, low, high) and regions hold what lies strictly inside. Where fewer than a tenth of the lines are measured,
    or there are fewer than five, both are 0.
    """
    one = lambda name, ends: F.when((F.col(pixel) > ends[0]) & (F.col(pixel) < ends[1]), name)
    held = range_join(facts.select(exposure, wave, pixel, value, error), bands, wave, "low", "high", width=width)
    held = held.withColumn("__r", F.explode(F.array_compact(F.array(*(one(k, v) for k, v in regions.items()))))).select(exposure, F.concat("band", "__r").alias("band"), value, error)
    found = robust.odd_ratio_mean(held, [exposure, "band"], value, error, name="vrad", error_name="svrad", count_name="__n", rows_name="__lines")
    names = bands.select(F.explode(F.array(*(F.concat("band", F.lit(k)) for k in regions))).alias("band"))  # bands times regions, a fixed number
    every = facts.select(exposure).distinct().join(F.broadcast(names))
    enough = (F.col("__n") * 10 >= F.col("__lines")) & (F.col("__lines") >= 5)
    out = every.join(found, [exposure, "band"], "left")
    return out.select(exposure, "band", *(F.when(F.coalesce(enough, F.lit(False)), F.col(c)).otherwise(0.0).alias(c) for c in ("vrad", "svrad")))


def velocity_table(
    facts: DataFrame, exposures: DataFrame, bands: DataFrame, *, exposure: str = "exposure", line: str = "line", first: str, window: tuple[float, float], most_pixels: int = 50, reference: float,
    regions: Mapping[str, tuple[float, float]] | None = None, calibration: bool = False, width: float = 30.0, projections: tuple[str, ...] = (), pivot: list[str] | None = None,
    force_sigma: bool = False, correlated: tuple[DataFrame, float] | None = None,
) -> DataFrame:
    """A row for each exposure: vrad, d2v, d3v, contrast and projections by robust means over lines, chromatic terms, widths, bands.

    facts: exposure, line, wave_start, n_pixels, pixel and value with error of dv, d2v, d3v, contrast (sig_contrast) and of the
    projections (s before their name). exposures: exposure, ew and further columns, which are carried along; first names the
    column whose least exposure settles the lines. A calibration keeps its first velocities and has no biases. Tables of fewer than
    five exposures give lines measured seldom their plain mean as bias; force_sigma and correlated are those of line_biases. Lines are joined by
    their identity. facts are read several times: hand over a written table; one copy of them, with biases, is written.
    """
    regions = regions or {"": (float("-inf"), float("inf"))}
    order = facts.join(exposures.select(exposure, F.col(first).alias("__first")), exposure)
    kept = materialize(kept_lines(order, exposure, line, F.col("__first"), "wave_start", *window, "n_pixels", most_pixels))
    rows = facts.join(kept, line, "left_semi")
    pairs = [("d2v", "sd2v"), ("d3v", "sd3v"), ("contrast", "sig_contrast"), *((p, f"s{p}") for p in projections)]
    if calibration:
        rows = materialize(rows.withColumn("__bias", F.lit(0.0)))
    else:
        settings = {"few_exposures": exposures.limit(5).count() < 5, "force_sigma": force_sigma, "correlated": correlated}
        bias = line_biases(rows, exposure, line, "dv", "sdv", **settings).select(line, F.col("bias").alias("__bias"), "scale")
        rows = materialize(rows.join(bias, line, "left").withColumn("sdv", F.col("sdv") * F.col("scale")).drop("scale"))  # the only copy of the facts
    rows = rows.withColumn("__rv", F.col("dv") - F.col("__bias"))
    means = robust.robust_means(rows, [exposure], [("__rv", "sdv", "vrad", "svrad"), *((v, e, v, e) for v, e in pairs)])
    out = exposures.join(means, exposure, "left")
    slope = chromatic_slope(rows, [exposure], "wave_start", "dv", "sdv", reference=reference, bias="__bias")
    slope = slope.select(exposure, F.col("level").alias("vrad_achromatic"), F.col("level_err").alias("svrad_achromatic"), F.col("slope").alias("vrad_chromatic_slope"), F.col("slope_err").alias("svrad_chromatic_slope"), F.col("crx").alias("CRX"), F.col("crx_err").alias("sCRX"))
    out = out.join(slope, exposure, "left").withColumns(width_terms(F.col("d2v"), F.col("sd2v"), F.col("ew")))
    long = band_velocities(rows, exposure, bands, regions, "wave_start", "pixel", "__rv", "sdv", width=width)
    names = pivot or [r.band + k for r in bands.select("band").collect() for k in regions]  # a fixed number of bands
    wide = long.groupBy(exposure).pivot("band", names).agg(F.first("vrad").alias("vrad"), F.first("svrad").alias("svrad"))
    wide = wide.select(exposure, *(F.col(f"{n}_{c}").alias(f"{c}_{n}") for n in names for c in ("vrad", "svrad")))
    return out.join(wide, exposure, "left")


def paired_columns(table: DataFrame) -> dict[str, str]:
    """Columns with the column of their errors: named with an s, or sig_, before the name."""
    names = {c for c, t in table.dtypes if t in ("double", "float")}
    return {c: e for c in table.columns if c in names for e in (f"s{c}", f"sig_{c}") if e in names}


def nightly_table(table: DataFrame, night: str, order: str) -> DataFrame:
    """One row for each night of any table: pairs of value and error by weighted mean, strings of the first row, means of the rest.

    A mean of a column without errors is null where one of its values is missing.
    """
    pairs = paired_columns(table)
    aggregates = []
    for c, kind in table.dtypes:
        if c == night or c in pairs.values():
            continue
        if c in pairs:
            mean, err = robust.inverse_variance(F.col(c), F.col(pairs[c]))
            aggregates += [mean.alias(c), err.alias(pairs[c])]
        elif kind in ("double", "float", "int", "bigint"):
            v = finite(F.col(c).cast("double"))
            aggregates.append(F.when(F.count(v) == F.count(F.lit(1)), F.avg(v)).alias(c))
        else:
            aggregates.append(F.min_by(c, order).alias(c))
    return table.groupBy(night).agg(*aggregates).select(*table.columns)


def drift_table(table: DataFrame, group: str, reference: Column, order: list[str]) -> DataFrame:
    """Each row of a table minus the first reference row of its group, in all columns with errors; errors add in squares."""
    pairs = paired_columns(table)
    key = F.struct(*order)
    firsts = table.filter(reference).groupBy(group).agg(F.min_by(F.struct(*(F.col(x).alias(f"__{x}") for p in pairs.items() for x in p)), key).alias("__f")).select(F.col(group).alias("__group"), "__f.*")
    met = table.join(firsts, F.col(group).eqNullSafe(F.col("__group")), "left").drop("__group")
    changed = {c: F.col(c) - F.col(f"__{c}") for c in pairs} | {e: F.sqrt(F.col(e) * F.col(e) + F.col(f"__{e}") * F.col(f"__{e}")) for e in pairs.values()}
    return met.withColumns(changed).select(*table.columns)


def corrected_table(table: DataFrame, drifts: DataFrame, key: str) -> DataFrame:
    """A table minus the drifts of the same key (a rounded time) in all columns with errors, null where there is none."""
    pairs = {c: e for c, e in paired_columns(table).items() if c in drifts.columns and e in drifts.columns}
    some = drifts.groupBy(F.col(key).alias("__key")).agg(*(F.min_by(x, F.struct(*(F.col(c) for c in pairs))).alias(f"__{x}") for p in pairs.items() for x in p))
    met = table.join(some, F.col(key) == F.col("__key"), "left")
    changed = {c: F.col(c) - F.col(f"__{c}") for c in pairs} | {e: F.sqrt(F.col(e) * F.col(e) + F.col(f"__{e}") * F.col(f"__{e}")) for e in pairs.values()}
    return met.withColumns(changed).select(*table.columns)
