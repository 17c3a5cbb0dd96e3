"""Queries of inputs, names, filters, sinks' tables, and the stages template, mask, systemic velocity."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenrv.functions import naming
from lumenrv.operators import robust, templates
from lumenrv.operators.sequences import along
from lumenrv.plans import instruments
from lumenrv.plans.expressions import CCF_REGIONS
from lumenrv.plans.kernels import moved_exposures, synthetic_template
from lumenrv.plans.registry import query
from lumenrv.plans.sequences import GAPPED, gapped
from lumenrv.plans.statistics import HIGH, LOW
from lumenrv.plans.surrogates import EXPOSURES, LINE_LIST, exposures, line_list, measurements, measurements_sql
from lumenrv.sources import tables


@query("""SELECT doc_id, source || '_' || lang || '_' || CAST(doc_id AS VARCHAR) || '.fits' AS name FROM documents
WHERE starts_with(source, 'src1') AND contains(source || '_' || lang, '_') AND lang IN ('en', 'de') AND CAST(doc_id % 3 AS VARCHAR) IN ('1', '2')""")
def file_search(spark, d):
    """Files by parts of their names and by values of their headers."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    name = F.concat(F.col("source"), F.lit("_"), F.col("lang"), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".fits"))
    header = F.create_map(F.lit("LANG"), F.col("lang"), F.lit("KIND"), (F.col("doc_id") % 3).cast("string"))
    files = docs.select("doc_id", name.alias("name"), header.alias("header"))
    return files.filter(tables.fits_search(F.col("name"), F.col("header"), prefix="src1", suffix=".fits", contains=("_",), keys={"LANG": ("en", "de"), "KIND": (1, 2)})).select("doc_id", "name")


@query(f"""SELECT exposure, 'exp' || exposure || '_o_OBJ' || object || '_TMPL_lines.fits' AS lines, CASE WHEN kind = 'F' THEN 'nights_' ELSE 'series_' END || 'OBJ' || object || '_TMPL' || CASE WHEN snr > 100 THEN '_drift.rdb' ELSE '.rdb' END AS series,
  'Template_OBJ' || object || '_spirou.fits' AS template FROM {EXPOSURES}""")
def file_names(spark, d):
    """Names of the files of a run."""
    name = F.concat(F.lit("OBJ"), F.col("object").cast("string"))
    path = F.concat(F.lit("/data/night/exp"), F.col("exposure").cast("string"), F.lit("_o.fits"))
    t = F.lit("TMPL")
    series = F.when(F.col("kind") == "F", F.when(F.col("snr") > 100, naming.series_file(name, t, True, True)).otherwise(naming.series_file(name, t, True))).otherwise(F.when(F.col("snr") > 100, naming.series_file(name, t, False, True)).otherwise(naming.series_file(name, t)))
    return exposures(spark, d).select("exposure", naming.line_file(path, name, t).alias("lines"), series.alias("series"), naming.template_file(name, F.lit("SPIROU")).alias("template"))


@query("""WITH g AS (SELECT CAST(unnest(range(3000, 6100, 100)) AS DOUBLE) AS t), l AS (SELECT CAST(i AS DOUBLE) / 2 AS g FROM (SELECT unnest(range(0, 13)) AS i)),
c AS (SELECT c_custkey, 2500 + c_acctbal * 0.4 AS teff, (c_custkey % 71) / 10.0 AS logg FROM customer),
b AS (SELECT c_custkey, arg_min(t, (abs(t - teff), t)) AS t, arg_min(l.g, (abs(l.g - logg), l.g)) AS g FROM c, g, l GROUP BY c_custkey)
SELECT c_custkey, printf('lte%05d-%.2f-0.0', CAST(t AS INTEGER), g) AS model FROM b""")
def model_choice(spark, d):
    """The nearest model of a star's temperature and gravity."""
    stars = spark.read.parquet(f"{d}/customer.parquet")
    return stars.select("c_custkey", naming.model_name((F.col("c_acctbal") * 0.4 + 2500).cast("double"), (F.col("c_custkey") % 71 / 10.0).cast("double")).alias("model"))


@query(f"SELECT exposure, round(snr * 100 - (object * 10 - 5000 + mjd % 7), 6) AS velocity FROM {EXPOSURES}")
def systemic_guess(spark, d):
    """First systemic velocity of each exposure."""
    return exposures(spark, d).select("exposure", F.round(naming.systemic_guess(F.col("snr") * 100, F.col("object") * 10 - 5000, F.col("mjd") % 7), 6).alias("velocity"))


@query(f"""WITH b AS (SELECT n_nationkey AS key, 'blaze_' || n_name AS file FROM nation)
SELECT exposure, file FROM {EXPOSURES} LEFT JOIN b ON b.key = wavefile""")
def calibration_files(spark, d):
    """Each exposure with the calibration that its header names; null without one."""
    files = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("wavefile"), F.concat(F.lit("blaze_"), "n_name").alias("file"))
    return exposures(spark, d).withColumn("wavefile", F.col("wavefile").cast("long")).join(files, "wavefile", "left").select("exposure", "file")


@query(f"""WITH t AS (SELECT object, avg(snr) AS level FROM {EXPOSURES} WHERE kind = 'F' GROUP BY object)
SELECT exposure, round(snr / level, 9) AS ratio FROM {EXPOSURES} JOIN t USING (object)""")
def template_objects(spark, d):
    """Exposures with the template of their object; others have no row."""
    every = exposures(spark, d)
    made = every.filter("kind = 'F'").groupBy("object").agg(F.avg("snr").alias("level"))
    return every.join(made, "object").select("exposure", F.round(F.col("snr") / F.col("level"), 9).alias("ratio"))


@query(f"SELECT object, count(DISTINCT CAST(floor(snr * 1000 / 30000) AS BIGINT)) AS n FROM {EXPOSURES} GROUP BY object")
def berv_spread(spark, d):
    """How many steps of barycentric velocity an object's exposures cover."""
    return exposures(spark, d).groupBy("object").agg(F.count_distinct(F.floor(F.col("snr") * 1000 / 30000)).alias("n"))


@query(f"SELECT wavefile, CAST(row_number() OVER (ORDER BY wavefile) AS BIGINT) AS place FROM (SELECT DISTINCT wavefile FROM {EXPOSURES})")
def distinct_in_order(spark, d):
    """The distinct wavelength files in order."""
    found = exposures(spark, d).select("wavefile").distinct()
    return found.withColumn("place", F.row_number().over(Window.orderBy("wavefile")).cast("long"))  # a row for each file


@query(f"""WITH s AS (SELECT exposure, (quantile_cont(flux - 1, {HIGH!r}) - quantile_cont(flux - 1, {LOW!r})) / 2 AS s, median(flux) AS m FROM {GAPPED} GROUP BY exposure)
SELECT exposure, pixel, round(CASE WHEN m >= 0.95 AND abs(flux - 1) / s <= 2 THEN flux END, 9) AS flux FROM {GAPPED} JOIN s USING (exposure)""")
def clipped_pixels(spark, d):
    """Pixels far off in units of the spectrum's robust sigma lose their flux, and spectra of little signal lose all."""
    rows = gapped(spark, d)
    stats = rows.groupBy("exposure").agg(robust.robust_sigma(F.col("flux") - 1).alias("s"), F.percentile("flux", F.lit(0.5)).alias("m"))
    ok = (F.col("m") >= 0.95) & (F.abs(F.col("flux") - 1) / F.col("s") <= 2)
    return rows.join(stats, "exposure").select("exposure", "pixel", F.round(F.when(ok, F.col("flux")), 9).alias("flux"))


@query(f"""WITH k AS (SELECT l_orderkey, l_linenumber, wave, weight - 0.05 AS weight FROM {LINE_LIST})
SELECT mask_type, count(*) AS n, round(sum(weight), 4) AS weight FROM (SELECT *, unnest(CASE WHEN weight < 0 THEN ['full', 'pos'] WHEN weight > 0 THEN ['full', 'neg'] ELSE ['full'] END) AS mask_type FROM k) GROUP BY mask_type""")
def mask_types(spark, d):
    """A line list as three masks."""
    lines = line_list(spark, d).withColumn("weight", F.col("weight") - 0.05)
    return tables.masks(lines, "weight").groupBy("mask_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 4).alias("weight"))


@query(f"""SELECT event_id, 'dv' AS quantity, dv AS value, sdv AS error FROM {measurements_sql()} UNION ALL
SELECT event_id, 'd2v', CAST(line AS DOUBLE), CAST(epoch AS DOUBLE) FROM {measurements_sql()}""")
def long_line_facts(spark, d):
    """Values and errors of each line as rows."""
    m = measurements(spark, d).withColumn("dv", F.nanvl("dv", F.lit(None).cast("double")))
    return tables.long_facts(m.withColumns({"d2v": F.col("line"), "sd2v": F.col("epoch")}), ["event_id"], {"dv": "sdv", "d2v": "sd2v"})


def stacked_exposures(spark: SparkSession, d: str) -> DataFrame:
    """exposure, known (m/s), wave, flux (arrays): spectra moved by velocities of their own, with the noise of stacked embeddings."""
    return moved_exposures(spark, d, lambda k: float((k % 25 - 12) * 700 + k % 5 * 40), lambda k: 0.002 * (1 + k % 5))


def known_lines(spark: SparkSession) -> DataFrame:
    """The lines of the synthetic template: centre, depth, in clean regions only."""
    t = synthetic_template()
    rows = [(float((a + b) / 2), float(1 - np.interp((a + b) / 2, t.wave, t.flux)), 1.0) for a, b in zip(t.starts, t.ends)]
    lines = spark.createDataFrame(rows, "wave double, depth double, weight double")
    return templates.in_regions(lines, CCF_REGIONS, "wave", "weight")


@query()
def systemic_velocity(spark, d):
    """Systemic velocity, width and contrast of each exposure by cross-correlation with a line list."""
    found = templates.systemic_velocities(stacked_exposures(spark, d), known_lines(spark), keys=["exposure", "known"], step=1000.0, reach=1e5)
    return found.select("exposure", "known", "vsys", "fwhm", "contrast", "snr", "good")


@query()
def mask_recipe(spark, d):
    """From a template to a line list with weights, and the list's own velocity against every exposure."""
    t = synthetic_template()
    template = spark.createDataFrame([("t", i, float(w), float(f)) for i, (w, f) in enumerate(zip(t.wave, t.flux))], "name string, i int, wave double, flux double")
    lines = templates.mask_from_template(template, "i", "wave", "flux", keys=["name"], least_depth=1e-6)
    return templates.mask_velocity(stacked_exposures(spark, d), lines, keys=["exposure", "known"])


@query()
def template_loop(spark, d):
    """Velocities of exposures by registration on a template that is built anew from them."""
    made = stacked_exposures(spark, d)
    one = made.select("exposure", "known", "wave", "flux", F.transform("wave", lambda w: F.lit(1.0)).alias("blaze"), F.lit(0).alias("ord"), F.lit(0.0).alias("berv"))
    _, moves = templates.settled_template(one, wave0=1500.5, step=500.0, n=7500, bins=5, rounds=4)
    return one.select("exposure", "known").join(moves, "exposure")


@query(f"""WITH r AS (SELECT exposure, pixel, flux, sum(CASE WHEN flux IS NOT NULL AND lag(flux) OVER (PARTITION BY exposure ORDER BY pixel) IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY exposure ORDER BY pixel) AS stretch
  FROM (SELECT *, lag(flux) OVER (PARTITION BY exposure ORDER BY pixel) AS before FROM {GAPPED}))
SELECT exposure, CAST(stretch AS BIGINT) AS stretch, count(*) AS n FROM r WHERE flux IS NOT NULL GROUP BY ALL""".replace("lag(flux) OVER (PARTITION BY exposure ORDER BY pixel) IS NULL", "before IS NULL"))
def line_widths_along(spark, d):
    """Pixels of each stretch of known flux of each spectrum."""
    w = along(["exposure"], "pixel")
    rows = gapped(spark, d).withColumn("start", (F.col("flux").isNotNull() & F.lag("flux").over(w).isNull()).cast("int"))
    return rows.withColumn("stretch", F.sum("start").over(w)).filter("flux is not null").groupBy("exposure", "stretch").agg(F.count(F.lit(1)).alias("n"))


ROTA = ("SPIROU", "CARMENES", "MAROONX", "EXPRES", "HARPS")
CONVENTIONS = f"""(SELECT *, ['{"', '".join(ROTA)}'][1 + exposure % 5] AS instrument, ['SCIENCE', 'FP', 'SUN', 'DARK'][1 + object % 4] AS type,
  CASE WHEN exposure % 7 <> 0 THEN snr END AS berv, CASE exposure % 5 WHEN 2 THEN 'm/s' ELSE 'km/s' END AS unit, CASE WHEN exposure % 3 <> 0 THEN mjd + 2400000.6 END AS bjd FROM {EXPOSURES})"""


@query(f"""SELECT exposure, round(CASE WHEN instrument = 'EXPRES' AND (type IN ('FP', 'SUN') OR berv IS NULL) THEN 0 WHEN type = 'FP' THEN 0 WHEN unit = 'km/s' THEN berv * 1000 ELSE berv END, 6) AS velocity,
  round(CASE instrument WHEN 'CARMENES' THEN bjd WHEN 'MAROONX' THEN mjd + 0.5 ELSE coalesce(bjd - 2400000.0, mjd + 0.51) END, 6) AS rjd,
  CASE WHEN type NOT IN ('SCIENCE', 'FP', 'LFC') THEN 'kind' WHEN berv IS NULL OR berv < 50 THEN 'order' WHEN snr < 150 THEN 'correlation' END AS reason FROM {CONVENTIONS}""")
def instrument_conventions(spark, d):
    """Velocities, dates and reject reasons by the rules of five instruments."""
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (i + 1).cast("int"))
    x = F.col("exposure")
    rows = exposures(spark, d).withColumns({
        "instrument": pick(ROTA, x % 5), "type": pick(("SCIENCE", "FP", "SUN", "DARK"), F.col("object") % 4), "berv": F.when(x % 7 != 0, F.col("snr").cast("double")),
        "unit": F.when(x % 5 == 2, "m/s").otherwise("km/s"), "bjd": F.when(x % 3 != 0, F.col("mjd") + 2400000.6)})
    velocity = instruments.velocity_of(F.col("instrument"), F.col("berv"), F.col("unit"), F.col("type"))
    date = instruments.reduced_date(F.col("instrument"), F.col("bjd"), F.col("mjd"), F.col("mjd") + 0.01)
    reason = instruments.reject_reason(F.col("type"), F.col("berv"), F.col("snr"), 50.0, 150.0)
    return rows.select("exposure", F.round(velocity, 6).alias("velocity"), F.round(date, 6).alias("rjd"), reason.alias("reason"))
