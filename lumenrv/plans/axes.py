"""Queries along axes longer than a row: convolution, correlation with a list of lines, exponents of the air."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from lumenrv.operators import halos
from lumenrv.plans.registry import query
from lumenrv.plans.surrogates import SPECTRA, spectra

#: An uneven kernel of 41 places.
KERNEL = [round((1 + 0.1 * j) * math.exp(-abs(j - 20) / 5), 6) for j in range(41)]


@query(f"""WITH k(j, w) AS (VALUES {', '.join(f'({j}, {w!r}e0)' for j, w in enumerate(KERNEL))}), e AS (SELECT event_type AS band, event_id AS place, CASE WHEN event_id % 170 <> 0 THEN value END AS v FROM events)
SELECT a.band, a.place, CASE WHEN count(b.place) = count(b.v) THEN round(coalesce(sum(b.v * w), 0), 8) END AS convolved FROM e a CROSS JOIN k LEFT JOIN e b ON b.band = a.band AND b.place = a.place + 20 - j GROUP BY a.band, a.place""")
def axis_convolved(spark, d):
    """A kernel of 41 places along the whole axis of each band; places of other bands are empty."""
    ev = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("band"), F.col("event_id").alias("place"), F.when(F.col("event_id") % 170 != 0, F.col("value")).alias("v"))
    return halos.convolved(ev, ["band"], "place", "v", KERNEL, width=1024).select("band", "place", F.round("convolved", 8).alias("convolved"))


@query(f"""WITH s AS {SPECTRA}, t AS (SELECT pixel, avg(flux) - 1 AS w FROM s GROUP BY pixel), g AS (SELECT CAST(unnest(range(-8, 9)) AS INTEGER) AS shift),
c AS (SELECT exposure, shift, sum(w * flux) AS y FROM t CROSS JOIN g JOIN s ON s.pixel = t.pixel + shift GROUP BY ALL)
SELECT exposure, arg_max(shift, (y, -shift)) AS shift, round(max(y), 6) AS peak, round(min(y), 6) AS trough FROM c GROUP BY exposure""")
def template_correlation(spark, d):
    """Best shift of every exposure against the mean of all, with the correlation there and its least."""
    s = spectra(spark, d)
    template = s.groupBy("pixel").agg((F.avg("flux") - 1).alias("w"))
    ccf = halos.correlated(s, template, ["exposure"], "pixel", "flux", "w", 8, width=16)
    best = F.array_position("ccf", F.array_max("ccf")) - 1
    return ccf.select("exposure", (best - 8).cast("int").alias("shift"), F.round(F.array_max("ccf"), 6).alias("peak"), F.round(F.array_min("ccf"), 6).alias("trough"))


WATER, OTHERS = (9, 24, 33, 50), (5, 17, 41, 57)


def absorbed(spark, d):
    """embeddings as spectra seen through air: planted exponents by the exposure's number."""
    s = spectra(spark, d)
    line = lambda centres, depth: 1 - sum((F.exp(F.pow((F.col("pixel") - c) / 1.2, F.lit(2)) * -0.5) * depth for c in centres), F.lit(0.0))
    rows = s.withColumns({"water": line(WATER, 0.5), "others": line(OTHERS, 0.4), "known_water": 0.5 + F.col("exposure") % 11 / 10, "known_others": 0.8 + F.col("exposure") % 5 / 10})
    return rows.withColumn("seen", (1 + 0.02 * (F.col("flux") - 1)) * F.pow("water", "known_water") * F.pow("others", "known_others"))


@query()
def air_exponents(spark, d):
    """Exponents of water and of all else for every exposure at once, beside the planted ones."""
    rows = absorbed(spark, d)
    mask = lambda centres: sum((F.when(F.col("pixel") == c, -1.0).when(F.abs(F.col("pixel") - c) == 4, 0.5).otherwise(0.0) for c in centres), F.lit(0.0))
    air = rows.groupBy("pixel").agg(F.max("water").alias("water"), F.max("others").alias("others")).withColumns({"in_water": mask(WATER), "in_others": mask(OTHERS)})
    names = {"water": "water", "others": "others"}
    found = halos.air_exponents(rows, air, ["exposure"], "pixel", "seen", names, {"water": "in_water", "others": "in_others"}, bounds={"water": (0.01, 15.0), "others": (0.05, 15.0)})
    known = rows.filter("pixel = 0").select("exposure", "known_water", "known_others")
    return found.join(known, "exposure").select("exposure", "known_water", "known_others", F.round("water", 5).alias("water"), F.round("others", 5).alias("others"), "rounds")
