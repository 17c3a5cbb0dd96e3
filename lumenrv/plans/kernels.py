"""Queries that SQL cannot express: splines, filters, iterated fits, synthetic exposures, streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrv.functions.spectral import SPEED_OF_LIGHT
from lumenrv.kernels.curves import Spline
from lumenrv.operators import robust, telluric, velocity
from lumenrv.operators import spectra as A
from lumenrv.plans.registry import query
from lumenrv.plans.sequences import GAPPED, gapped
from lumenrv.plans.surrogates import measurements, measurements_sql, spectra
from lumenrv.sources.scratch import materialize, parts_of
from lumenrv.streaming.epochs import nightly_means


def arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exposure, ord, flux (array; every 50th exposure lacks a stretch)."""
    emb = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    flux = F.transform("embedding", lambda x, i: F.when((F.col("vec_id") % 50 == 0) & i.between(20, 26), None).otherwise(x.cast("double") + 1))
    return emb.select(F.col("vec_id").alias("exposure"), F.col("label").alias("ord"), flux.alias("flux"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i.cast("double")).alias("x"))


@query()
def spline_eval(spark, d):
    at = F.transform(F.sequence(F.lit(0), F.lit(62)), lambda i: i + 0.5)
    return arrays(spark, d).select("exposure", A.spline_at(F.col("x"), F.col("flux"), at).alias("between"))


@query()
def lowpass_spline(spark, d):
    return arrays(spark, d).select("exposure", A.low_pass(F.col("flux"), 21).alias("smooth"))


@query()
def savgol_nan(spark, d):
    return arrays(spark, d).select("exposure", A.savitzky_golay(F.col("flux"), 5).alias("smooth"), A.savitzky_golay(F.col("flux"), 5, derivative=1).alias("slope"))


@query()
def robust_polyfit(spark, d):
    return arrays(spark, d).select("exposure", A.polynomial_fit(F.col("x"), F.col("flux"), 2, 4.0).alias("coefficients"))


@query()
def blaze_norm(spark, d):
    rows = spectra(spark, d).withColumn("exposure", F.col("exposure") % 25).groupBy("exposure", "ord", "pixel").agg(F.avg("flux").alias("blaze"), F.avg(F.col("wave") + F.col("ord") * 40).alias("wave"))
    return A.blaze_normalised(rows, ["exposure"], "ord", "pixel", "wave", "blaze").select("exposure", "ord", "pixel", "blaze_norm")


@query()
def chi2_probability(spark, d):
    chi = spectra(spark, d).groupBy("exposure").agg(F.sum(F.pow((F.col("flux") - 1) / 0.15, F.lit(2))).alias("chi2"), F.count(F.lit(1)).alias("n"))
    return chi.withColumn("p", A.chi2_tail(F.col("chi2"), F.col("n").cast("double")))


@query()
def pearson_probability(spark, d):
    known = measurements(spark, d).filter(~F.isnan("dv"))
    r = known.groupBy("line").agg(F.corr("dv", F.col("epoch").cast("double")).alias("r"), F.count(F.lit(1)).alias("n")).filter("n > 2")
    return r.withColumn("p", A.correlation_p(F.col("r"), F.col("n")))


@query(f"""WITH m AS (SELECT ord, exposure % 19 AS bin, pixel, CASE WHEN count(flux) = count(*) THEN avg(flux) END AS f FROM {GAPPED} GROUP BY ALL),
p AS (SELECT ord, pixel, quantile_cont(f, 0.16) AS a, median(f) AS b, quantile_cont(f, 0.84) AS c, count(f) AS n, count(DISTINCT bin) AS bins FROM m GROUP BY ALL)
SELECT ord, pixel, CASE WHEN n * 2 >= bins THEN round(b, 9) END AS flux, round((c - a) / 2, 9) AS rms FROM p""")
def template_median(spark, d):
    """Template of each order: exposures in bins, means within bins, percentiles over bins; a pixel missing in one exposure is missing in its bin."""
    rows = gapped(spark, d).withColumn("bin", F.col("exposure") % 19)
    means = rows.groupBy("ord", "bin", "pixel").agg(F.when(F.count("flux") == F.count(F.lit(1)), F.avg("flux")).alias("f"))
    out = means.groupBy("ord", "pixel").agg(F.percentile("f", F.array(F.lit(0.16), F.lit(0.5), F.lit(0.84))).alias("p"), F.count("f").alias("n"), F.count_distinct("bin").alias("bins"))
    return out.select("ord", "pixel", F.when(F.col("n") * 2 >= F.col("bins"), F.round(F.get("p", F.lit(1)), 9)).alias("flux"), F.round((F.get("p", F.lit(2)) - F.get("p", F.lit(0))) / 2, 9).alias("rms"))


def synthetic_template(seed: int = 42, lines: int = 40, step: float = 500.0) -> velocity.Template:
    """A flat continuum with Gaussian lines of depth 0.1 to 0.6 on a grid of constant velocity step."""
    rng = np.random.default_rng(seed)
    wave = 1500 * np.exp(np.arange(8000) * step / SPEED_OF_LIGHT)
    at = np.sort(rng.uniform(wave[300], wave[-300], lines))
    depth, width = rng.uniform(0.1, 0.6, lines), at * 3000 / SPEED_OF_LIGHT
    flux = 1 - (depth * np.exp(-0.5 * ((wave[:, None] - at) / width) ** 2)).sum(axis=1)
    return velocity.Template(wave, flux, at - 4 * width, at + 4 * width)


def frames(spark: SparkSession, sf_dir: str, each: int) -> DataFrame:
    """exposure and noise (64 numbers): embeddings stacked by so many of them, pixel by pixel; few exposures to a partition."""
    emb = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.floor(F.col("vec_id") / each).cast("int").alias("exposure"), "embedding")
    n = emb.select("exposure").distinct().count()
    means = emb.select("exposure", F.posexplode("embedding").alias("i", "x")).groupBy("exposure", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    made = means.groupBy("exposure").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("noise"))
    return made.repartition(parts_of(spark, n))  # not by exposure, as made is, which would leave its few partitions


def spread_noise(exposure: int, noise: np.ndarray, n: int, sigma: float) -> np.ndarray:
    """n numbers of deviation sigma: those of a stack over and over, shuffled anew each time."""
    rng = np.random.default_rng(exposure)
    out = np.concatenate([rng.permutation(noise) for _ in range(-(-n // len(noise)))])[:n]
    return (out - out.mean()) / max(out.std(), 1e-12) * sigma


def moved_exposures(spark: SparkSession, sf_dir: str, known: Callable[[int], float], sigma: Callable[[int], float]) -> DataFrame:
    """exposure, known (m/s), wave, flux (arrays): the template moved by a known velocity, with the noise of stacked embeddings, made by the tasks."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        template = synthetic_template()
        curve = Spline(template.wave, template.flux, 3, "constant")
        for part in parts:
            rows = []
            for k, noise in zip(part["exposure"].tolist(), part["noise"]):
                v = known(k)
                shift = np.sqrt((1 - v / SPEED_OF_LIGHT) / (1 + v / SPEED_OF_LIGHT))
                flux = curve(template.wave * shift) * (1 + 0.1 * np.sin(template.wave / 3)) + spread_noise(k, np.array(noise, float), len(template.wave), sigma(k))
                rows.append((k, v, template.wave, flux))
            yield pd.DataFrame(rows, columns=["exposure", "known", "wave", "flux"])

    return frames(spark, sf_dir, 20).mapInPandas(run, "exposure int, known double, wave array<double>, flux array<double>")


@query()
def compute_rv_synthetic(spark, d):
    """Line velocities of exposures moved by known velocities, then the robust mean of each exposure."""
    made = moved_exposures(spark, d, lambda k: (0.0, 5.0, -5.0, 50.0, -50.0, 2000.0)[k % 6], lambda k: 0.002)
    found = materialize(velocity.line_velocities(made, synthetic_template(), keys=["exposure", "known"]))
    return robust.odd_ratio_mean(found, ["exposure", "known"], "dv", "sdv", name="vrad", error_name="svrad")


def synthetic_air(seed: int = 3, lines: int = 30) -> telluric.Air:
    rng = np.random.default_rng(seed)
    wave = 1490 * np.exp(np.arange(16_000) * 250.0 / SPEED_OF_LIGHT)
    lists, spectra_ = [], []
    for _ in range(2):
        at, depth = np.sort(rng.uniform(wave[800], wave[-800], lines)), rng.uniform(0.1, 0.5, lines)
        lists.append(np.stack([at, depth], axis=1))
        spectra_.append(1 - np.minimum((depth * np.exp(-0.5 * ((wave[:, None] - at) / (at * 1500 / SPEED_OF_LIGHT)) ** 2)).sum(axis=1), 0.9))
    return telluric.Air(wave, *spectra_, *lists)


def synthetic_absorbed(spark, air, exponents):
    rows = []
    for k, (water, others) in enumerate(exponents):
        rng = np.random.default_rng(k)
        rows.append((k, water, others, air.wave.tolist(), (air.transmission(water, others, 1.4) * (1 + 0.05 * np.sin(air.wave / 2)) + rng.normal(0, 0.002, len(air.wave))).tolist()))
    return spark.createDataFrame(rows, "exposure int, water double, others double, wave array<double>, flux array<double>")


@query()
def telluric_correction(spark, d):
    """Exposures through air of known exponents, with the noise of stacked embeddings, and what is found of them."""
    air = synthetic_air()
    shared = spark.sparkContext.broadcast(air)  # of an instrument's size

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = shared.value
        for part in parts:
            rows = []
            for k, noise in zip(part["exposure"].tolist(), part["noise"]):
                water, others = ((0.5, 1.0), (1.0, 1.0), (2.0, 1.3), (0.8, 1.8))[k % 4]
                flux = a.transmission(water, others, 1.4) * (1 + 0.05 * np.sin(a.wave / 2)) + spread_noise(k, np.array(noise, float), len(a.wave), 0.002)
                rows.append((k, water, others, a.wave, flux))
            yield pd.DataFrame(rows, columns=["exposure", "water", "others", "wave", "flux"])

    made = frames(spark, d, 100).mapInPandas(run, "exposure int, water double, others double, wave array<double>, flux array<double>")
    found = telluric.correct_tellurics(made, air, keys=["exposure", "water", "others"])
    known = F.filter("flux_tc", lambda x: x.isNotNull())
    mean = F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)
    return found.select("exposure", "water", "others", "exponent_water", "exponent_others", "rounds", F.size(known).alias("clean_pixels"), mean.alias("clean_mean"))


@query(f"""SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS night, round(sum(dv / pow(sdv, 2)) / sum(1 / pow(sdv, 2)), 9) AS mean, round(sqrt(1 / sum(1 / pow(sdv, 2))), 9) AS mean_err, count(*) AS n FROM {measurements_sql()} GROUP BY 1""")
def stream_epoch_agg(spark, d):
    """Nightly weighted means; the same function takes a stream."""
    out = nightly_means(measurements(spark, d).withColumn("dv", F.nanvl("dv", F.lit(None).cast("double"))), "ts", "dv", "sdv")
    return out.select("night", F.round("mean", 9).alias("mean"), F.round("mean_err", 9).alias("mean_err"), "n")
