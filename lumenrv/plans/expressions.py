"""Queries of column expressions, sources' keys and joins."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrv.functions import spectral, times
from lumenrv.operators import intervals
from lumenrv.plans.registry import query
from lumenrv.plans.surrogates import EXPOSURES, LINE_LIST, exposures, line_list, measurements, measurements_sql

C = "299792458.0"
#: Clean wavelength regions (nm) for cross-correlation, and the named bands.
CCF_REGIONS = {"r": (500, 650), "i": (750, 850), "y": (985, 1113), "h": (1500, 1700), "k": (2100, 2200)}
BANDS = {
    "u": (305.511, 403.064), "g": (379.764, 555.304), "r": (541.823, 699.442), "i": (669.241, 840.032), "z": (796.470, 1087.333),
    "y": (938.600, 1113.400), "j": (1148.178, 13494.41), "h": (1450.980, 1809.105), "k": (1985.930, 2401.514),
}


def bands_within(low: float, high: float) -> dict[str, tuple[float, float]]:
    """Bands that lie strictly inside an instrument's range."""
    return {k: v for k, v in BANDS.items() if v[0] > low and v[1] < high}


def values_sql(rows: dict[str, tuple[float, float]]) -> str:
    return ", ".join(f"('{k}', CAST({a!r} AS DOUBLE), CAST({b!r} AS DOUBLE))" for k, (a, b) in rows.items())


def small(spark: SparkSession, rows: dict[str, tuple[float, float]], name: str = "band") -> DataFrame:
    return spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in rows.items()], f"{name} string, low double, high double")


@query(f"""SELECT l_orderkey, l_linenumber, wave, dv, round(wave * sqrt((1 - dv * 1000 / {C}) / (1 + dv * 1000 / {C})), 9) AS shifted FROM {LINE_LIST}""")
def doppler_shift(spark, d):
    shifted = F.round(spectral.doppler_shift(F.col("wave"), F.col("dv") * 1000), 9).alias("shifted")
    return line_list(spark, d).select("l_orderkey", "l_linenumber", "wave", "dv", shifted)


@query(f"""WITH p AS (SELECT l_orderkey, l_linenumber, wave - 1400 AS x, 120e0 AS s FROM {LINE_LIST})
SELECT l_orderkey, l_linenumber, round(2.5 * exp(-0.5 * pow((x - 10) / s, 2)) + 0.25, 9) AS plain,
  round(2.5 * exp(-0.5 * pow(x - 10, 2) / pow(s, 2)) + 0.25 + (x - 10) * 0.001, 9) AS sloped,
  round(1 - 0.4 * exp(-pow(abs(x - 10), 2.2) / pow(s / (2 * pow({2 * math.log(2)!r}e0, 1 / 2.2)), 2.2))
    + 0.4 / 9 * exp(-pow(abs(x - 10), 2.2) / pow(2 * s / (2 * pow({2 * math.log(2)!r}e0, 1 / 2.2)), 2.2)), 9) AS eared,
  round(s * {spectral.FWHM!r}e0, 9) AS fwhm FROM p""")
def gauss_profiles(spark, d):
    x, s, n = F.col("wave") - 1400, F.lit(120.0), lambda v: F.lit(float(v))
    return line_list(spark, d).select(
        "l_orderkey", "l_linenumber", F.round(spectral.gauss(x, n(2.5), n(10), s, n(0.25)), 9).alias("plain"), F.round(spectral.gauss_on_slope(x, n(10), s, n(2.5), n(0.25), n(0.001)), 9).alias("sloped"),
        F.round(spectral.gauss_with_ears(x, n(10), s, n(0.4), n(3), n(2.2)), 9).alias("eared"), F.round(spectral.fwhm(s), 9).alias("fwhm"),
    )


@query(f"""SELECT l_orderkey, l_linenumber, wave, round(wave * (1e-6 * 760 * (1 + (1.049 - 0.0157 * 15) * 1e-6 * 760) / (720.883 * (1 + 0.003661 * 15))
  * (64.328 + 29498.1 / (146 - pow(1000 / wave, 2)) + 255.4 / (41 - pow(1000 / wave, 2))) + 1), 8) AS vacuum FROM {LINE_LIST}""")
def air_to_vacuum(spark, d):
    return line_list(spark, d).select("l_orderkey", "l_linenumber", "wave", F.round(F.col("wave") * spectral.air_index(F.col("wave")), 8).alias("vacuum"))


@query(f"""WITH p AS (SELECT exposure, snr, i, 2 * i / 4088.0 - 1 AS t FROM (SELECT exposure, snr, exposure * 37 % 4088 AS i FROM {EXPOSURES}))
SELECT exposure, i, round(1500 + snr / 10 + 40 * t + 3 * (2 * t * t - 1) - 0.5 * (4 * t * t * t - 3 * t), 5) AS wave FROM p""")
def cheby_wave(spark, d):
    """Wavelength of one pixel of each exposure by its own Chebyshev coefficients."""
    coefficients = F.array(F.lit(1500.0) + F.col("snr") / 10, *(F.lit(x) for x in (40.0, 3.0, -0.5)))
    i = F.col("exposure") * 37 % 4088
    return exposures(spark, d).select("exposure", i.alias("i"), F.round(spectral.chebyshev(coefficients, i.cast("double"), 0, 4088), 5).alias("wave"))


@query(f"""SELECT exposure, i, round(1500 + snr / 10 + i * (0.01 + i * (1e-6 - i * 1e-11)), 8) AS wave FROM (SELECT exposure, snr, exposure * 37 % 4088 AS i FROM {EXPOSURES})""")
def horner_wave(spark, d):
    """The same by ascending powers."""
    coefficients = F.array(F.lit(1500.0) + F.col("snr") / 10, *(F.lit(x) for x in (0.01, 1e-6, -1e-11)))
    i = F.col("exposure") * 37 % 4088
    return exposures(spark, d).select("exposure", i.alias("i"), F.round(spectral.polynomial(coefficients, i.cast("double")), 8).alias("wave"))


@query(f"""WITH o AS (SELECT s_suppkey AS ord, 990.0 + s_suppkey % 50 AS w0, (990.0 + s_suppkey % 50) * (1 + 1e-5 * (5 + s_suppkey % 7)) AS w1 FROM supplier),
n AS (SELECT *, CAST(floor(ln(w1 / w0) * {C} / 500) AS BIGINT) AS n FROM o), g AS (SELECT ord, w0, n, unnest(range(0, n)) AS i FROM n)
SELECT ord, i, round(exp(i / CAST(n AS DOUBLE) * ln(exp(n * 500 / {C}))) * w0, 6) AS wave FROM g""")
def magic_grid(spark, d):
    """Grids of constant velocity step between the ends of every order."""
    w0 = F.col("s_suppkey") % 50 + 990.0
    w1 = w0 * ((F.col("s_suppkey") % 7 + 5) * 1e-5 + 1)
    points = F.posexplode(spectral.magic_grid_points(w0, w1)).alias("i", "wave")
    return spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("ord"), points).select("ord", F.col("i").cast("long").alias("i"), F.round("wave", 6).alias("wave"))


@query(f"""WITH e AS (SELECT i, exp(i / 25.0 * ln(1950 / 900.0)) * 900 AS a, exp((i + 1) / 25.0 * ln(1950 / 900.0)) * 900 AS b FROM (SELECT CAST(unnest(range(0, 25)) AS BIGINT) AS i))
SELECT CAST(CAST(floor((a + b) / 2) AS BIGINT) AS VARCHAR) || 'nm' AS band, round(a, 9) AS low, round(b, 9) AS high, count(wave) AS lines FROM e LEFT JOIN {LINE_LIST} l ON wave > a AND wave < b GROUP BY ALL""")
def uniform_log_bins(spark, d):
    """Bins of equal width in the logarithm, with the lines of each."""
    bins = small(spark, {k: (a, b) for k, a, b in spectral.uniform_bins(900.0, 1950.0, 25)})
    held = intervals.range_join(line_list(spark, d).select("wave"), bins, "wave", "low", "high", width=30.0).groupBy("band").agg(F.count(F.lit(1)).alias("lines"))
    return bins.join(held, "band", "left").select("band", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"), F.coalesce("lines", F.lit(0)).alias("lines"))


@query(f"""SELECT exposure, round(mjd, 8) AS mjd, round(mjd - 40587, 8) AS plot_date,
  round(coalesce(CASE WHEN exposure % 3 = 0 THEN mjd + 2400000.5 + 0.01 END - 2400000.0, mjd + 0.02 + 0.5), 8) AS rjd,
  round(round_even(mjd - ((155.47 + 360) / 360 % 1), 0) + ((155.47 + 360) / 360 % 1), 8) AS night FROM {EXPOSURES}""")
def rjd_epoch_columns(spark, d):
    mjd = F.col("mjd")
    bjd = F.when(F.col("exposure") % 3 == 0, mjd + 2400000.5 + 0.01)
    return exposures(spark, d).select("exposure", F.round(mjd, 8).alias("mjd"), F.round(times.plot_date(mjd), 8).alias("plot_date"), F.round(times.rjd(bjd, mjd + 0.02), 8).alias("rjd"), F.round(times.local_night(mjd, -155.47), 8).alias("night"))


@query(f"""SELECT l_orderkey, l_linenumber, round(dv * {8 * math.log(2)!r}e0, 6) AS "dW", round(error * {8 * math.log(2)!r}e0, 6) AS "sdW",
  round(ew * {spectral.FWHM!r}e0 + dv * {8 * math.log(2)!r}e0 / (ew * {spectral.FWHM!r}e0), 6) AS fwhm, round(error * {8 * math.log(2)!r}e0 / (ew * {spectral.FWHM!r}e0), 9) AS sig_fwhm
  FROM (SELECT *, CASE WHEN weight = 0 THEN 5.5e0 ELSE weight * 30000 END AS ew FROM {LINE_LIST})""")
def fwhm_from_d2v(spark, d):
    terms = spectral.width_terms(F.col("dv"), F.col("error"), F.col("weight") * 30000)
    return line_list(spark, d).select("l_orderkey", "l_linenumber", *(F.round(v, 9 if k == "sig_fwhm" else 6).alias(k) for k, v in terms.items()))


@query("""SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '', 'g') AS folded, printf('WAVE%04d', doc_id % 10000) AS header_key,
  TRY_CAST(nullif(regexp_extract(CAST(n_chars / 8.0 AS VARCHAR) || ' m/s', '^\\s*([-+0-9.eE]+)\\s*m/s\\s*$', 1), '') AS DOUBLE) AS speed,
  split_part(source || '_' || lang || '_o.fits', '_', 2) AS fibre FROM documents""")
def header_strings(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    file = F.concat_ws("_", "source", "lang", F.lit("o.fits"))
    speed = F.concat((F.col("n_chars") / 8.0).cast("string"), F.lit(" m/s"))
    return docs.select("doc_id", times.ascii_only(F.col("text")).alias("folded"), times.indexed_key("WAVE%04d", F.col("doc_id") % 10000).alias("header_key"), times.metres_per_second(speed).alias("speed"), F.split_part(file, F.lit("_"), F.lit(2)).alias("fibre"))


@query(f"""WITH b(band, low, high) AS (VALUES {values_sql(bands_within(900, 1950))})
SELECT band, count(*) AS n, round(sum(weight), 4) AS weight FROM {LINE_LIST} l JOIN b ON l.wave > b.low AND l.wave < b.high GROUP BY band""")
def lines_in_bands(spark, d):
    """Lines of each named band by a range join."""
    joined = intervals.range_join(line_list(spark, d), small(spark, bands_within(900, 1950)), "wave", "low", "high", width=50.0)
    return joined.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 4).alias("weight"))


@query(f"""WITH r(region, low, high) AS (VALUES {values_sql(CCF_REGIONS)})
SELECT l_orderkey, l_linenumber, wave, count(*) AS n FROM {LINE_LIST} l WHERE weight > 0 AND EXISTS (SELECT 1 FROM r WHERE wave > low AND wave < high) GROUP BY ALL""")
def region_filter_semi(spark, d):
    regions = small(spark, CCF_REGIONS, "region").select("low", "high")
    kept = intervals.range_join(line_list(spark, d).filter("weight > 0"), regions, "wave", "low", "high", width=50.0, how="left_semi")
    return kept.groupBy("l_orderkey", "l_linenumber", "wave").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH o AS (SELECT CAST(i AS BIGINT) AS ord, 900.0 + 25 * i AS low, 930.0 + 25 * i AS high FROM (SELECT unnest(range(0, 42)) AS i)),
m AS (SELECT DISTINCT wave, weight FROM {LINE_LIST} WHERE weight < 0.05),
j AS (SELECT o.ord, m.wave, m.weight FROM m JOIN o ON m.wave > o.low AND m.wave < o.high),
s AS (SELECT ord, wave AS wave_start, lead(wave) OVER (PARTITION BY ord ORDER BY wave, weight) AS wave_end, weight FROM j)
SELECT ord, count(*) AS n, round(avg(wave_end - wave_start), 6) AS width, round(min(wave_start), 6) AS first, round(max(wave_end), 6) AS last FROM s WHERE wave_end IS NOT NULL GROUP BY ord""")
def line_segments(spark, d):
    """A line list over overlapping orders: segments from each line to the next of its order."""
    orders = spark.range(42).select(F.col("id").alias("ord"), (F.col("id") * 25 + 900.0).alias("low"), (F.col("id") * 25 + 930.0).alias("high"))
    mask = line_list(spark, d).filter("weight < 0.05").select("wave", "weight").distinct()
    placed = intervals.range_join(mask, orders, "wave", "low", "high", width=30.0).withColumn("place", F.struct("wave", "weight"))
    cut = intervals.consecutive(placed, ["ord"], "place")
    return cut.groupBy("ord").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("end.wave") - F.col("start.wave")), 6).alias("width"), F.round(F.min("start.wave"), 6).alias("first"), F.round(F.max("end.wave"), 6).alias("last"))


@query(f"""WITH e AS {EXPOSURES}, t AS (SELECT object AS target, mjd - 20 AS low, mjd + 20 AS high, snr FROM e)
SELECT e.exposure, coalesce(round(CAST(sum(CAST(t.snr AS DECIMAL(18, 9))) AS DOUBLE) / count(t.snr), 6), 0) AS vsys FROM e LEFT JOIN t ON e.object = t.target AND e.mjd > t.low AND e.mjd < t.high  GROUP BY e.exposure""")
def interval_lookup(spark, d):
    """Mean of a quantity over the intervals around an exposure's time, 0 without one."""
    every = exposures(spark, d)
    table = every.select(F.col("object").alias("target"), (F.col("mjd") - 20).alias("low"), (F.col("mjd") + 20).alias("high"), "snr")
    return intervals.interval_means(every, table, "object", "target", "mjd", "low", "high", {"snr": "vsys"}).select("exposure", F.coalesce(F.round("vsys", 6), F.lit(0.0)).alias("vsys"))


@query(f"""WITH e AS {EXPOSURES}, f AS (SELECT wavefile, arg_min(snr, (mjd, exposure)) AS ref FROM e WHERE kind = 'F' GROUP BY wavefile)
SELECT exposure, round(snr - ref, 6) AS drift FROM e LEFT JOIN f USING (wavefile)""")
def reference_drift(spark, d):
    """Drift against the first reference exposure of the same wavelength file."""
    marked = intervals.first_match(exposures(spark, d), ["wavefile"], F.col("kind") == "F", ["mjd", "exposure"], {"snr": "ref"})
    return marked.select("exposure", F.round(F.col("snr") - F.col("ref"), 6).alias("drift"))


@query(f"""WITH e AS {EXPOSURES}, g AS (SELECT CAST(round_even(mjd * 1e8, 0) AS BIGINT) AS t, arg_min(snr, exposure) AS drift FROM e WHERE exposure % 4 = 0 GROUP BY 1)
SELECT exposure, round(snr - drift, 6) AS corrected FROM e LEFT JOIN g ON CAST(round_even(mjd * 1e8, 0) AS BIGINT) = g.t""")
def drift_correct(spark, d):
    """Velocities minus the drift of the same rounded time, null where there is none."""
    every = exposures(spark, d).withColumn("t", intervals.time_key(F.col("mjd")))
    drift = every.filter("exposure % 4 = 0").groupBy("t").agg(F.min_by("snr", "exposure").alias("drift"))
    return every.join(drift, "t", "left").select("exposure", F.round(F.col("snr") - F.col("drift"), 6).alias("corrected"))


@query("""SELECT o_orderkey AS exposure, o_orderstatus AS kind FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o_orderkey AND l_returnflag = 'R')""")
def skip_done_anti(spark, d):
    every = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("exposure"), F.col("o_orderstatus").alias("kind"))
    done = spark.read.parquet(f"{d}/lineitem.parquet").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("exposure"))
    return intervals.drop_known(every, done, ["exposure"])


@query(f"""SELECT exposure, CASE WHEN exposure % 1000 = 999 THEN 'bad' WHEN snr < 30 THEN 'low snr' WHEN mjd < 50000 OR mjd > 51500 THEN 'date' ELSE 'kept' END AS verdict,
  (row_number() OVER (ORDER BY mjd, exposure) - 1) % 4 AS stripe FROM {EXPOSURES}""")
def quality_verdicts(spark, d):
    """Reject reasons in order, and the stripe of each exposure in order of time."""
    reason = F.when(F.col("exposure") % 1000 == 999, "bad").when(F.col("snr") < 30, "low snr").when(~F.col("mjd").between(50000, 51500), "date").otherwise("kept")
    placed = intervals.place_in_order(exposures(spark, d).withColumn("day", F.floor("mjd")), "day", ["mjd", "exposure"])
    return placed.select("exposure", reason.alias("verdict"), (F.col("place") % 4).alias("stripe"))


@query("""WITH h AS (SELECT doc_id, unnest([{'k': 'LANG', 'v': lang}, {'k': 'SOURCE', 'v': source}, {'k': 'CHARS', 'v': CAST(n_chars AS VARCHAR)}], recursive := true) FROM documents)
SELECT k, CASE WHEN count(DISTINCT v) = 1 THEN min(v) WHEN count(TRY_CAST(v AS DOUBLE)) < count(v) THEN arg_max(v, doc_id) END AS kept,
  CASE WHEN count(TRY_CAST(v AS DOUBLE)) = count(v) AND count(DISTINCT v) > 1 THEN round(avg(TRY_CAST(v AS DOUBLE)), 4) END AS cavg,
  CASE WHEN count(TRY_CAST(v AS DOUBLE)) = count(v) AND count(DISTINCT v) > 1 THEN round(stddev_pop(TRY_CAST(v AS DOUBLE)), 4) END AS cstd, count(v) AS cnum FROM h GROUP BY k""")
def header_merge(spark, d):
    """Headers of many files as one: equal values stay, numbers give mean and deviation, else the last value."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    header = F.create_map(F.lit("LANG"), "lang", F.lit("SOURCE"), "source", F.lit("CHARS"), F.col("n_chars").cast("string"))
    cards = docs.select("doc_id", F.explode(header).alias("k", "v")).withColumn("x", F.col("v").try_cast("double"))
    numbers, same = F.count("x") == F.count("v"), F.min("v") == F.max("v")
    return cards.groupBy("k").agg(
        F.when(same, F.min("v")).when(~numbers, F.max_by("v", "doc_id")).alias("kept"), F.when(numbers & ~same, F.round(F.avg("x"), 4)).alias("cavg"),
        F.when(numbers & ~same, F.round(F.stddev_pop("x"), 4)).alias("cstd"), F.count("v").alias("cnum"),
    )


@query(f"""SELECT event_id, CASE WHEN dv IS NULL THEN 'missing' WHEN dv > 300 THEN 'high' ELSE 'kept' END AS state FROM {measurements_sql()}""")
def nan_to_null(spark, d):
    """Missing values are found as null behind the ingest."""
    v = spectral.finite(F.col("dv"))
    return measurements(spark, d).select("event_id", F.when(v.isNull(), "missing").when(v > 300, "high").otherwise("kept").alias("state"))
