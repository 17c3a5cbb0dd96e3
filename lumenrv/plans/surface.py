"""Queries said in SQL with the library's functions, and over files that the library writes and reads as a data source."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenrv.functions.register import register
from lumenrv.operators import intervals, robust, templates
from lumenrv.plans import instruments
from lumenrv.plans.registry import QUERIES, SQL, query
from lumenrv.plans.sequences import gapped
from lumenrv.plans.statistics import robust_sql
from lumenrv.plans.surrogates import LINE_LIST, exposures, line_list, measurements, measurements_sql
from lumenrv.plans.workflow import Stage, Workflow
from lumenrv.sources.fits_source import load_fits
from lumenrv.sources.scratch import shared_dir
from lumenrv.sources.snapshots import SnapshotTable
from lumenrv.sources.tables import write_images
from lumenrv.streaming import references


@query(SQL["line_finder"])
def line_finder_sql(spark, d):
    """Lines of a spectrum by the table function."""
    register(spark)
    text = "SELECT exposure, pixel, kind, round(crossing, 6) AS crossing, round(depth, 6) AS depth FROM find_lines(TABLE(SELECT exposure, pixel, wave, flux FROM {spectra}), 'exposure', 'pixel', 'wave', 'flux')"
    return spark.sql(text, spectra=gapped(spark, d))


@query(SQL["robust_mean_by_group"])
def robust_mean_sql(spark, d):
    """Robust mean of each line by the aggregate."""
    register(spark)
    return spark.sql("SELECT line, round(robust_mean(dv, sdv), 5) AS mean, round(robust_mean_error(dv, sdv), 5) AS mean_err FROM {points} GROUP BY line", points=measurements(spark, d))


@query("""WITH x AS (SELECT vec_id // 50 AS chunk, label, list_avg(embedding::DOUBLE[]) AS m, embedding[1]::DOUBLE AS f FROM embeddings)
SELECT chunk, CASE WHEN chunk % 2 = 0 THEN 'SCIENCE' ELSE 'CALIBRATION' END AS kind, count(*) AS n_rows, round(avg(m), 6) AS mean, round(sum(f), 5) AS first FROM x GROUP BY chunk""")
def fits_archive(spark, d):
    """embeddings written as FITS files of fifty exposures each, read back by the data source: headers as columns, images as rows."""
    emb = spark.read.parquet(f"{d}/embeddings.parquet")
    kind = F.when(F.col("chunk") % 2 == 0, "SCIENCE").otherwise("CALIBRATION")
    rows = emb.select(F.floor(F.col("vec_id") / 50).alias("chunk"), "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    files = rows.groupBy("chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "x"))), lambda r: r["x"]).alias("pixels"))  # fifty rows each
    named = files.select(F.concat(F.col("chunk").cast("string"), F.lit(".fits")).alias("name"), F.create_map(F.lit("CHUNK"), F.col("chunk").cast("string"), F.lit("DPRTYPE"), kind).alias("header"), "pixels")
    folder = shared_dir(spark)
    write_images(named, folder).write.format("noop").mode("overwrite").save()
    back = load_fits(spark, folder, keys=["CHUNK", "DPRTYPE"], columns=["CHUNK", "DPRTYPE", "row", "pixels"])
    mean = F.aggregate("pixels", F.lit(0.0), lambda a, x: a + x) / F.size("pixels")
    found = back.groupBy(F.col("CHUNK").cast("long").alias("chunk"), F.col("DPRTYPE").alias("kind"))
    return found.agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg(mean), 6).alias("mean"), F.round(F.sum(F.get("pixels", F.lit(0))), 5).alias("first"))


@query(SQL["reference_drift"])
def reference_drift_stream(spark, d):
    """The drifts of reference_drift from a stream of files, in which references come late and revise what was given."""
    every = exposures(spark, d)
    folder = shared_dir(spark)
    each = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)  # four batches of so many files
    every.repartition(4 * each, "exposure").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(every.schema).option("maxFilesPerTrigger", each).parquet(f"{folder}/in")
    references.run_to_end(references.drifts(stream, "wavefile", "exposure", "mjd", "snr", F.col("kind") == "F"), f"{folder}/out", f"{folder}/checkpoint")
    last = references.settled(spark.read.parquet(f"{folder}/out"))
    return last.select(F.col("item").alias("exposure"), F.round(F.col("value") - F.col("reference"), 6).alias("drift"))


@query("""SELECT o_custkey AS source, count(*) AS n, round(sum(CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END * o_totalprice), 2) AS total FROM orders GROUP BY o_custkey""")
def snapshot_table(spark, d):
    """A table in two commits: customers of which an order has changed are replaced as a whole, the others stay as they are."""
    first = spark.read.parquet(f"{d}/orders.parquet").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")
    second = first.withColumn("o_totalprice", F.when(F.col("o_orderstatus") == "F", 2 * F.col("o_totalprice")).otherwise(F.col("o_totalprice")))
    table = SnapshotTable(spark, shared_dir(spark))
    for state in (first, second):
        rows = state.withColumn("__source", F.col("o_custkey").cast("string"))
        hashes = rows.groupBy(F.col("__source").alias("source")).agg(F.md5(F.concat(F.sum(F.xxhash64("o_orderkey", "o_totalprice").cast("decimal(38,0)")).cast("string"), F.lit(","), F.count(F.lit(1)).cast("string")).cast("binary")).alias("hash"))
        table.commit(hashes, lambda sources, rows=rows: rows.join(sources.withColumnRenamed("source", "__source"), "__source", "left_semi"))
    return table.read().groupBy(F.col("o_custkey").alias("source")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


WEEKS = robust_sql("SELECT epoch, dv AS v, sdv AS e FROM " + measurements_sql() + " WHERE dv IS NOT NULL", ["epoch"], "r")


@query(f"WITH {WEEKS} SELECT epoch // 7 AS week, round(sum(mean / pow(mean_err, 2)) / sum(1 / pow(mean_err, 2)), 5) AS mean, round(sqrt(1 / sum(1 / pow(mean_err, 2))), 5) AS mean_err, count(*) AS nights FROM r GROUP BY epoch // 7")
def staged_weeks(spark, d):
    """Velocities of nights, then of weeks, as declared stages; the second run finds both made."""
    nights = Stage("nights", lambda t, p: robust.odd_ratio_mean(measurements(spark, d, p["error"]), ["epoch"], "dv", "sdv"), ["events"], {"error": 20.0})

    def weekly(t, p):
        mean, err = robust.inverse_variance(F.col("mean"), F.col("mean_err"))
        return t["nights"].groupBy(F.floor(F.col("epoch") / p["days"]).alias("week")).agg(mean.alias("mean"), err.alias("mean_err"), F.count(F.lit(1)).alias("nights"))

    flow = Workflow(spark, shared_dir(spark), {"events": f"{d}/events.parquet"}, [nights, Stage("weeks", weekly, ["nights"], {"days": 7})])
    flow.run()
    found, _ = flow.run()
    return found["weeks"].select("week", F.round("mean", 5).alias("mean"), F.round("mean_err", 5).alias("mean_err"), "nights")


BAND_ROWS = instruments.band_rows()


@query(f"""WITH b(instrument, source, band, low, high, first, last) AS (VALUES {', '.join(f"('{i}', '{s}', '{b}', {lo!r}, {hi!r}, {a!r}, {z!r})" for i, s, b, lo, hi, a, z in BAND_ROWS)}),
l AS (SELECT wave, l_partkey * 13 % 4096 AS pixel, dv FROM {LINE_LIST.replace('SELECT l_orderkey', 'SELECT l_partkey, l_orderkey')})
SELECT instrument, source, band, count(wave) AS lines, round(avg(dv), 6) AS mean FROM b LEFT JOIN l ON wave > low AND wave < high AND pixel > first AND pixel < last GROUP BY ALL""")
def instrument_bands(spark, d):
    """Lines in every band and region of every instrument."""
    bands = spark.createDataFrame(BAND_ROWS, "instrument string, source string, band string, low double, high double, first double, last double")
    lines = line_list(spark, d, "l_partkey").select("wave", (F.col("l_partkey") * 13 % 4096).alias("pixel"), "dv")
    spans = bands.select("low", "high", "first", "last").distinct()  # the same for several instruments
    cells = lines.groupBy("wave", "pixel").agg(F.count(F.lit(1)).alias("n"), F.sum("dv").alias("s"), F.count("dv").alias("k"))  # equal lines are taken together
    met = intervals.range_join(cells, spans, "wave", "low", "high", width=100.0).filter("pixel > first and pixel < last")
    found = met.groupBy("low", "high", "first", "last").agg(F.sum("n").alias("lines"), (F.sum("s") / F.sum("k")).alias("mean"))
    return bands.join(found, ["low", "high", "first", "last"], "left").select("instrument", "source", "band", F.coalesce("lines", F.lit(0)).alias("lines"), F.round("mean", 6).alias("mean"))


@query()
def template_finish(spark, d):
    """The templates of template_median without pixels of low signal, with smooth columns."""
    template = QUERIES["template_median"](spark, d)
    return templates.finished_template(template, ["ord"], "pixel", {"flux": "rms"}, step=500.0, resolution=80_000, width=21)
