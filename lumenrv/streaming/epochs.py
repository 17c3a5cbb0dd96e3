"""Streams of measurements: nightly means with late data, and incremental work that skips what is done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenrv.operators.robust import inverse_variance


def nightly_means(stream: DataFrame, time: str, value: str, error: str, *, late: str = "2 days", night: str = "1 day") -> DataFrame:
    """Weighted mean and error of each night; rows that come later than late after newer ones are left out.

    Works on a table as well, where nothing is late.
    """
    timed = stream.withColumn("__time", F.col(time).cast("timestamp"))
    timed = timed.withWatermark("__time", late) if timed.isStreaming else timed
    mean, err = inverse_variance(F.col(value), F.col(error))
    out = timed.groupBy(F.window("__time", night).alias("__w")).agg(mean.alias("mean"), err.alias("mean_err"), F.count(F.lit(1)).alias("n"))
    return out.select(F.date_format("__w.start", "yyyy-MM-dd").alias("night"), "mean", "mean_err", "n")


def process_new(stream: DataFrame, work: Callable[[DataFrame], DataFrame], done: str, keys: list[str], checkpoint: str, *, order: list[str] | None = None) -> StreamingQuery:
    """Run work on the rows of each batch whose keys are not yet in the parquet table done, and append its result there.

    Of rows of a batch with equal keys the least by order (default: all columns) stays. A batch that is run again after a
    failure finds its rows done.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c not in keys]
        fresh = batch
        if rest:
            fresh = batch.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*(order or rest))).alias("__r")).select(*keys, "__r.*").select(*batch.columns)
        else:
            fresh = batch.distinct()
        try:
            fresh = fresh.join(spark.read.parquet(done).select(*keys), keys, "left_anti")
        except AnalysisException as missing:
            if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise  # otherwise nothing has been done yet
        work(fresh).write.mode("append").parquet(done)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
