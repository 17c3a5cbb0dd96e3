"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Only on one machine (a local master) is a temporary folder made where the setting is absent.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.conf.get("spark.master", None) or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        base = _OWN.setdefault(app, "file://" + tempfile.mkdtemp(prefix="lumenrv-checkpoint-"))
    if "://" not in base and not base.startswith("file:"):  # as Spark itself would read it
        base = f"{spark.sparkContext._jsc.hadoopConfiguration().get('fs.defaultFS').rstrip('/')}{base}"
    return f"{base.replace('file:///', 'file:/').replace('file:/', 'file:///').rstrip('/')}/{uuid.uuid4().hex}"


def materialize(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Exposures of long arrays that a task is dealt: neither a table's size nor the merging of small partitions may say how many
#: of them meet in one batch of a worker, nor how many tasks work on them.
EXPOSURES_A_TASK = 32


def parts_of(spark: SparkSession, exposures: int) -> int:
    """A number of partitions for so many exposures of long arrays, to be given to repartition, which then keeps it."""
    return max(-(-exposures // EXPOSURES_A_TASK), min(exposures, int(spark.conf.get("spark.sql.shuffle.partitions"))), 1)
