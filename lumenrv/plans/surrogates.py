"""Views of the driver's tables as spectroscopic facts, with SQL that gives the same rows.

events: a measurement of a line (user) on a night (day) in a band (type); every 17th value is missing.
embeddings: spectra, one of 64 pixels for each exposure. orders: exposures of an object. lineitem: a list of lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrv.functions.times import mjd_of


def measurements(spark: SparkSession, sf_dir: str, error: float = 20.0) -> DataFrame:
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    return ev.select(
        "event_id", F.col("user_id").alias("line"), F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).cast("long").alias("epoch"), F.col("event_type").alias("band"),
        F.when(F.col("event_id") % 17 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("dv"), ((F.col("event_id") % 5 + 1) * error).alias("sdv"), "ts",
    )


MEASUREMENTS = """(SELECT event_id, user_id AS line, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS epoch, event_type AS band,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS dv, CAST((event_id % 5 + 1) * {error} AS DOUBLE) AS sdv, ts FROM events)"""


def measurements_sql(error: float = 20.0) -> str:
    return MEASUREMENTS.format(error=error)


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exposure, ord, pixel, wave, flux (positive)."""
    emb = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = emb.select(F.col("vec_id").alias("exposure"), F.col("label").alias("ord"), F.posexplode("embedding").alias("pixel", "x"))
    return rows.select("exposure", "ord", "pixel", (F.col("pixel") * 0.5 + 1000).alias("wave"), (F.col("x").cast("double") + 1).alias("flux"))


SPECTRA = """(SELECT vec_id AS exposure, label AS ord, i - 1 AS pixel, 1000 + 0.5 * (i - 1) AS wave, CAST(embedding[i] AS DOUBLE) + 1 AS flux
  FROM embeddings, (SELECT CAST(unnest(range(1, 65)) AS INTEGER) AS i))"""


def exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exposure, object, mjd, kind, wavefile, snr."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("exposure"), F.col("o_custkey").alias("object"), mjd_of(F.col("o_orderdate")).alias("mjd"), F.col("o_orderstatus").alias("kind"), (F.col("o_custkey") % 50).alias("wavefile"), (F.col("o_totalprice") / 1000).alias("snr"))


EXPOSURES = """(SELECT o_orderkey AS exposure, o_custkey AS object, epoch_us(o_orderdate) / 86400e6 + 40587 AS mjd, o_orderstatus AS kind, o_custkey % 50 AS wavefile, o_totalprice / 1000 AS snr FROM orders)"""


def line_list(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """row of lines: order key, line number, wave 909..1950, weight, error."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 100 + 900).alias("wave"), F.col("l_discount").cast("double").alias("weight"), (F.col("l_tax") + 1).cast("double").alias("error"), F.col("l_quantity").cast("double").alias("dv"), *more)


LINE_LIST = "(SELECT l_orderkey, l_linenumber, l_extendedprice / 100 + 900 AS wave, CAST(l_discount AS DOUBLE) AS weight, CAST(l_tax + 1 AS DOUBLE) AS error, CAST(l_quantity AS DOUBLE) AS dv FROM lineitem)"
