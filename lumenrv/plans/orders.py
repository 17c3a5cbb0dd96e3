"""Queries of headers, instruments and spectral orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenrv.functions import headers
from lumenrv.functions.spectral import SPEED_OF_LIGHT, gauss
from lumenrv.operators import orders as O
from lumenrv.operators.intervals import range_join
from lumenrv.plans import instruments
from lumenrv.plans.kernels import frames
from lumenrv.plans.registry import query
from lumenrv.plans.surrogates import EXPOSURES, LINE_LIST, SPECTRA, exposures, line_list, spectra


@query("""SELECT doc_id, coalesce(lang, source) AS target, TRY_CAST(CAST(n_chars AS VARCHAR) AS DOUBLE) AS chars, CASE WHEN doc_id % 2 = 0 THEN source ELSE lang END AS paired,
  [[CAST(n_chars AS DOUBLE), CAST(doc_id AS DOUBLE)], [CAST(NULL AS DOUBLE), CAST(doc_id % 7 AS DOUBLE)]]::VARCHAR AS grid, 'LANG' AS starred FROM documents""")
def header_lookup(spark, d):
    """Typed values with fallback keys, paired and numbered keys, wildcards."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    first = F.when(F.col("doc_id") % 2 == 0, "WANTED").otherwise("OTHER")
    second = F.when(F.col("doc_id") % 2 == 0, "OTHER").otherwise("WANTED")
    text = lambda c: F.col(c).cast("string")
    h = F.create_map(F.lit("LANG"), "lang", F.lit("SRC"), "source", F.lit("CHARS"), text("n_chars"), F.lit("N1"), first, F.lit("V1"), "source", F.lit("N2"), second, F.lit("V2"), "lang", F.lit("W0000"), text("n_chars"), F.lit("W0001"), text("doc_id"), F.lit("W0003"), (F.col("doc_id") % 7).cast("string"))
    grid = headers.numbered_list(F.col("h"), "W%04d", 2, 2)
    shown = F.concat(F.lit("["), F.array_join(F.transform(grid, lambda r: F.concat(F.lit("["), F.array_join(r.cast("array<string>"), ", ", "NULL"), F.lit("]"))), ", "), F.lit("]"))
    return docs.select("doc_id", h.alias("h")).select(
        "doc_id", headers.value_of(F.col("h"), ["OBJECT", "LANG", "SRC"]).alias("target"), headers.value_of(F.col("h"), ["CHARS"], "double").alias("chars"),
        headers.paired_value(F.col("h"), "N{}", "V{}", "WANTED", 2).alias("paired"), shown.alias("grid"), F.array_join(F.map_keys(headers.matching(F.col("h"), "LA*")), ",").alias("starred"),
    )


WINDOWS = ", ".join(f"('{i.name}', '{i.source}', CAST({i.window[0]} AS DOUBLE), CAST({i.window[1]} AS DOUBLE))" for i in instruments.INSTRUMENTS)


@query(f"""WITH i(instrument, source, low, high) AS (VALUES {WINDOWS})
SELECT instrument, source, count(l.wave) AS n, round(coalesce(avg(l.weight), 0), 6) AS weight FROM i LEFT JOIN {LINE_LIST} l ON l.wave > low AND l.wave < high GROUP BY ALL""")
def instrument_windows(spark, d):
    """Lines in each instrument's compiled range."""
    held = range_join(line_list(spark, d).select("wave", "weight"), instruments.table(spark).select("instrument", "source", "low", "high"), "wave", "low", "high", width=200.0)
    n = held.groupBy("instrument", "source").agg(F.count("wave").alias("n"), F.avg("weight").alias("weight"))
    out = instruments.table(spark).select("instrument", "source").join(n, ["instrument", "source"], "left")
    return out.select("instrument", "source", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("weight", F.lit(0.0)), 6).alias("weight"))


@query(f"""WITH e AS {EXPOSURES}, i AS (SELECT *, CASE exposure % 3 WHEN 0 THEN 'km/s' WHEN 1 THEN 'm/s' ELSE 'none' END AS unit, mjd % 60 - 30 AS berv FROM e)
SELECT exposure, round(CASE WHEN kind = 'P' OR unit = 'none' THEN 0 WHEN unit = 'km/s' THEN berv * 1000 ELSE berv END, 6) AS berv FROM i""")
def berv_conventions(spark, d):
    unit = F.when(F.col("exposure") % 3 == 0, "km/s").when(F.col("exposure") % 3 == 1, "m/s").otherwise("none")
    berv = F.col("mjd") % 60 - 30
    return exposures(spark, d).select("exposure", F.round(instruments.barycentric_velocity(berv, unit, F.col("kind") == "P"), 6).alias("berv"))


@query(f"""WITH o AS (SELECT exposure, ord, list(1000 + 0.5 * pixel + 25 * (exposure % 4) ORDER BY pixel) AS w FROM {SPECTRA} GROUP BY ALL),
n AS (SELECT exposure, ord, w, lag(w) OVER p AS b, lead(w) OVER p AS a FROM o WINDOW p AS (PARTITION BY ord, exposure // 4 ORDER BY exposure)),
x AS (SELECT exposure, ord, unnest(range(1, 65)) AS i, w, a, b FROM n)
SELECT exposure, ord, sum(CASE WHEN coalesce(w[i] > b[65 - i], true) AND coalesce(w[i] < a[65 - i], true) THEN 1 ELSE 0 END)::INTEGER AS kept FROM x GROUP BY exposure, ord""")
def order_overlaps(spark, d):
    """Pixels of an order that are not nearer to the middle of a neighbouring one."""
    emb = spark.read.parquet(f"{d}/embeddings.parquet")
    wave = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i * 0.5 + 1000 + F.col("vec_id") % 4 * 25)
    rows = emb.select(F.col("vec_id").alias("exposure"), F.col("label").alias("ord"), F.floor(F.col("vec_id") / 4).alias("group"), wave.alias("wave"))
    cut = O.trim_overlaps(rows, ["ord", "group"], "exposure", "wave")
    return cut.select("exposure", "ord", F.size(F.filter("inside", lambda x: x)).alias("kept"))


@query(f"""WITH l AS {LINE_LIST}, m AS (SELECT l_linenumber AS k, median(abs(weight)) AS m FROM l GROUP BY 1), f AS (SELECT l.* FROM l JOIN m ON l_linenumber = k AND weight < 1.5 * m.m)
SELECT l_linenumber, count(*) AS n, round(sum(weight / w), 4) AS total, round(max(weight / w), 6) AS most FROM f JOIN (SELECT l_linenumber AS k, avg(abs(weight)) AS w FROM f GROUP BY 1) ON l_linenumber = k GROUP BY l_linenumber""")
def mask_weights(spark, d):
    """Line masks without extreme weights, over their mean."""
    mask = O.normalised_mask(line_list(spark, d).select("l_linenumber", "weight"), ["l_linenumber"], "weight", 1.5)
    return mask.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 4).alias("total"), F.round(F.max("weight"), 6).alias("most"))


@query(f"""WITH e AS (SELECT exposure, object, mjd % 60 AS berv FROM {EXPOSURES})
SELECT exposure, CAST(floor((row_number() OVER (PARTITION BY object ORDER BY berv, exposure) - 1) * 4.0 / count(*) OVER (PARTITION BY object)) AS INTEGER) AS bin FROM e""")
def berv_bins(spark, d):
    rows = exposures(spark, d).select("exposure", "object", (F.col("mjd") % 60).alias("berv"))
    return O.velocity_bins(rows, ["object"], "berv", 4).select("exposure", "bin")


@query(f"""WITH b AS (SELECT CAST(unnest(range(0, 20)) AS BIGINT) AS box), j AS (SELECT exposure, box, pixel, flux FROM {SPECTRA}, b WHERE pixel >= 4 * box AND pixel < 4 * box + 16)
SELECT exposure, box, round((quantile_cont(flux, 0.8413447460685429) - quantile_cont(flux, 0.15865525393145707)) / 2, 6) AS sigma, round(avg(pixel), 6) AS centre FROM j GROUP BY ALL HAVING count(flux) * 2 >= 16""")
def noise_boxes(spark, d):
    """Noise along a spectrum: robust spread in overlapping boxes."""
    found = O.box_noise(spectra(spark, d).select("exposure", "pixel", "flux"), ["exposure"], "pixel", "flux", 16)
    return found.select("exposure", "box", F.round("sigma", 6).alias("sigma"), F.round("centre", 6).alias("centre"))




@query(f"""WITH p AS (SELECT l_orderkey, l_linenumber, (1 - 1500 / wave) * 40 * pi() AS x FROM {LINE_LIST})
SELECT l_orderkey, l_linenumber, round(CASE WHEN abs(x) < 1e-9 THEN 1 ELSE pow(sin(x) / x, 2) END, 9) AS blaze FROM p""")
def artificial_blaze(spark, d):
    return line_list(spark, d).select("l_orderkey", "l_linenumber", F.round(O.sinc_blaze(F.col("wave"), F.lit(40.0), F.lit(1500.0)), 9).alias("blaze"))


@query()
def template_from_exposures(spark, d):
    """Exposures of overlapping orders as one-dimensional spectra, binned and reduced to a template."""
    stacks = frames(spark, d, 20)
    e = stacks.select("exposure")
    o = stacks.withColumn("ord", F.explode(F.sequence(F.lit(0), F.lit(2))))
    wave = F.transform(F.sequence(F.lit(0), F.lit(899)), lambda i: F.exp((i + F.col("ord") * 700) * 500.0 / SPEED_OF_LIGHT) * 1500.0)
    rows = o.withColumn("wave", wave).withColumn("blaze", F.transform("wave", lambda w, i: F.lit(1.0) - F.pow((i - 450.0) / 600, F.lit(2))))
    dip = lambda w: F.lit(1.0) - gauss(w, F.lit(0.4), F.lit(1501.5), F.lit(0.05), F.lit(0.0))
    rows = rows.withColumn("flux", F.zip_with(F.zip_with("wave", "blaze", lambda w, b: dip(w) * b), F.sequence(F.lit(0), F.lit(899)), lambda x, i: x * (1 + 1e-4 * F.get("noise", i % 64))))
    flat = O.one_dimensional(rows, ["exposure"], 1500.0, 500.0, 2300)
    bins = O.velocity_bins(e.withColumn("berv", F.sin(F.col("exposure") * 1.0)).withColumn("object", F.lit(0)), ["object"], "berv", 6)
    return O.median_template(flat, bins, "exposure")
