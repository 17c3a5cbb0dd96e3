"""Queries along the pixels of spectra."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenrv.operators import sequences as S
from lumenrv.plans.registry import query
from lumenrv.plans.surrogates import SPECTRA, spectra

#: Five-point smoothing by a quadratic.
SMOOTH = tuple(x / 35 for x in (-3, 12, 17, 12, -3))
OVER = "OVER (PARTITION BY exposure ORDER BY pixel)"

#: Spectra of which every tenth lacks pixels 20 to 22 and the first or last one.
GAPPED = f"(SELECT exposure, ord, pixel, wave, CASE WHEN exposure % 10 = 0 AND (pixel BETWEEN 20 AND 22 OR pixel = 0 OR (pixel = 63 AND exposure % 20 = 0)) THEN NULL ELSE flux END AS flux FROM {SPECTRA})"


def gapped(spark, d):
    lost = (F.col("exposure") % 10 == 0) & (F.col("pixel").between(20, 22) | (F.col("pixel") == 0) | ((F.col("pixel") == 63) & (F.col("exposure") % 20 == 0)))
    return spectra(spark, d).withColumn("flux", F.when(~lost, F.col("flux")))


def slope_sql(column: str) -> str:
    return f"""(CASE WHEN lag(1) {OVER} IS NULL THEN lead({column}) {OVER} - {column} WHEN lead(1) {OVER} IS NULL THEN {column} - lag({column}) {OVER}
  ELSE (lead({column}) {OVER} - lag({column}) {OVER}) / 2 END)"""



@query(f"""SELECT exposure, pixel, round({slope_sql('flux')}, 9) AS slope FROM {GAPPED}""")
def gradient(spark, d):
    return gapped(spark, d).select("exposure", "pixel", F.round(S.gradient(F.col("flux"), S.along(["exposure"], "pixel")), 9).alias("slope"))


@query(f"""WITH s AS {SPECTRA}, n AS (SELECT unnest([-2, -1, 0, 1, 2]) AS k)
SELECT s.exposure, s.pixel, round(sum(t.flux), 9) AS box FROM s, n, s AS t WHERE t.exposure = s.exposure AND t.pixel = (s.pixel + n.k + 64) % 64 GROUP BY ALL""")
def boxcar5(spark, d):
    box = S.circular_sum(spectra(spark, d), ["exposure"], "pixel", "flux")
    return box.select("exposure", "pixel", F.round("box", 9).alias("box"))


@query(f"""WITH g AS (SELECT *, {slope_sql('flux')} AS slope FROM {GAPPED}),
n AS (SELECT *, lead(slope) {OVER} AS s2, lead(wave) {OVER} AS w2, lag(flux) {OVER} AS f0, lead(flux) {OVER} AS f2 FROM g)
SELECT exposure, pixel, CASE WHEN s2 > slope THEN 1 ELSE -1 END AS kind, round(wave - slope * (w2 - wave) / (s2 - slope), 6) AS crossing, round(coalesce(1 - flux / ((f0 + f2) / 2), 0), 6) AS depth
FROM n WHERE sign(s2) <> sign(slope) AND s2 IS NOT NULL""")
def line_finder(spark, d):
    """Lines of a spectrum: where the gradient changes sign."""
    rows = gapped(spark, d).withColumn("slope", S.gradient(F.col("flux"), S.along(["exposure"], "pixel")))
    found = S.zero_crossings(rows, ["exposure"], "pixel", "wave", "slope", "flux")
    return found.select("exposure", "pixel", "kind", F.round("crossing", 6).alias("crossing"), F.round("depth", 6).alias("depth"))


@query(f"""SELECT exposure, pixel, round(CASE WHEN count(flux) OVER w >= 3 THEN quantile_cont(flux, 0.5) OVER w END, 9) AS middle FROM {SPECTRA}
WINDOW w AS (PARTITION BY exposure ORDER BY pixel ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""")
def moving_median(spark, d):
    return spectra(spark, d).select("exposure", "pixel", F.round(S.moving_median(F.col("flux"), S.along(["exposure"], "pixel"), 3), 9).alias("middle"))


@query(f"""SELECT exposure, pixel, round({' + '.join(f"{c!r} * {'lag' if k < 2 else 'lead'}(flux, {abs(k - 2)}) {OVER}" for k, c in enumerate(SMOOTH))}, 9) AS smooth FROM {SPECTRA}""")
def savgol_smooth(spark, d):
    return spectra(spark, d).select("exposure", "pixel", F.round(S.weighted_neighbours(F.col("flux"), S.along(["exposure"], "pixel"), SMOOTH), 9).alias("smooth"))


@query(f"""WITH b AS (SELECT CAST(unnest(range(0, 40)) AS BIGINT) AS box), j AS (SELECT exposure, box, pixel, flux FROM {SPECTRA}, b WHERE pixel >= -11 + 5 * box AND pixel < -11 + 5 * box + 21 AND pixel < 63 AND -11 + 5 * box < 64 + 10)
SELECT exposure, box, round(avg(pixel), 6) AS centre, round(median(flux), 9) AS median FROM j GROUP BY ALL HAVING count(*) >= 3""")
def lowpass_box_median(spark, d):
    boxes = S.box_medians(spectra(spark, d).withColumn("n", F.lit(64)), ["exposure"], "pixel", "flux", width=21, length="n")
    return boxes.select("exposure", "box", F.round("centre", 6).alias("centre"), F.round("median", 9).alias("median"))


@query(f"""WITH g AS (SELECT CAST(unnest(range(-8, 9)) AS BIGINT) AS v), s AS {SPECTRA}, m AS (SELECT CAST(i AS INTEGER) AS at, 1 + i % 3 AS depth FROM (SELECT unnest([12, 20, 33, 41, 50]) AS i)),
c AS (SELECT exposure, v, sum(depth * flux) AS y FROM m, g, s WHERE s.pixel = m.at + g.v GROUP BY ALL)
SELECT exposure, v, round(y / median(y) OVER (PARTITION BY exposure), 9) AS ccf FROM c""")
def ccf_cross(spark, d):
    """Cross-correlation of a line list with spectra on a grid of shifts, over its median."""
    return _ccf(spark, d).select("exposure", "v", F.round("ccf", 9).alias("ccf"))


def _ccf(spark, d):
    from pyspark.sql import Window

    mask = [(i, 1 + i % 3) for i in (12, 20, 33, 41, 50)]
    wanted = spark.createDataFrame([(i + v, v, w) for i, w in mask for v in range(-8, 9)], "pixel int, v long, depth int")  # 85 rows
    y = spectra(spark, d).join(F.broadcast(wanted), "pixel").groupBy("exposure", "v").agg(F.sum(F.col("depth") * F.col("flux")).alias("y"))
    return y.withColumn("ccf", F.col("y") / F.percentile("y", F.lit(0.5)).over(Window.partitionBy("exposure")))


@query(f"""WITH g AS (SELECT CAST(unnest(range(-8, 9)) AS BIGINT) AS v), s AS {SPECTRA}, m AS (SELECT CAST(i AS INTEGER) AS at, 1 + i % 3 AS depth FROM (SELECT unnest([12, 20, 33, 41, 50]) AS i)),
c AS (SELECT exposure, v, sum(depth * flux) AS y FROM m, g, s WHERE s.pixel = m.at + g.v GROUP BY ALL)
SELECT exposure, arg_min(v, (round(y, 9), v)) AS low_at, arg_max(v, (round(y, 9), -v)) AS high_at FROM c GROUP BY exposure""")
def ccf_argmin(spark, d):
    """Where a cross-correlation is least and greatest; ties give the first."""
    y = F.round("y", 9)
    return _ccf(spark, d).groupBy("exposure").agg(F.min_by("v", F.struct(y, "v")).alias("low_at"), F.max_by("v", F.struct(y, -F.col("v"))).alias("high_at"))


@query(f"""SELECT exposure, pixel, amp, CAST(place AS BIGINT) AS place FROM (SELECT exposure, pixel, round(abs(flux - 1), 9) AS amp, row_number() OVER (PARTITION BY exposure ORDER BY abs(flux - 1), pixel) AS place FROM {SPECTRA}) WHERE place <= 4""")
def topk_amp(spark, d):
    """The four points of least amplitude of each spectrum; the number is the feature."""
    w = S.along(["exposure"], ["amp", "pixel"])
    rows = spectra(spark, d).select("exposure", "pixel", F.abs(F.col("flux") - 1).alias("amp"))
    return rows.withColumn("place", F.row_number().over(w).cast("long")).filter("place <= 4").select("exposure", "pixel", F.round("amp", 9).alias("amp"), "place")


@query(f"""WITH g AS (SELECT exposure, {slope_sql('wave')} / wave AS s FROM {SPECTRA}), m AS (SELECT exposure, median(s) * 299792.458 AS v, median(1 / s) / 299792458.0 AS w FROM g GROUP BY exposure)
SELECT exposure, round(v, 6) AS step, CASE WHEN floor(v * 2) = 0 THEN 250 ELSE 1000 * floor(v * 2) / 4 END AS rounded, CAST(floor(500000 * w) AS BIGINT) + CASE WHEN CAST(floor(500000 * w) AS BIGINT) % 2 = 0 THEN 1 ELSE 0 END AS scale FROM m""")
def velocity_step(spark, d):
    """Sampling of a spectrum in km/s, rounded to quarters of half a km/s in m/s, and the odd number of pixels of 500 km/s."""
    wave = F.col("wave")
    steps = spectra(spark, d).select("exposure", (S.gradient(wave, S.along(["exposure"], "pixel")) / wave).alias("s"))
    v = steps.groupBy("exposure").agg((F.percentile("s", F.lit(0.5)) * 299792.458).alias("v"), (F.percentile(F.lit(1.0) / F.col("s"), F.lit(0.5)) / 299792458.0).alias("w"))
    half, pixels = F.floor(F.col("v") * 2), F.floor(F.col("w") * 500000)
    return v.select("exposure", F.round("v", 6).alias("step"), F.when(half == 0, 250.0).otherwise(half * 1000 / 4.0).alias("rounded"), (pixels + F.when(pixels % 2 == 0, 1).otherwise(0)).alias("scale"))
