"""RDB tables: tab-separated text whose first line has the names and whose second has the types (N number, S string)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def read_rdb(spark: SparkSession, path: str) -> DataFrame:
    """The table with doubles and strings; `nan` and empty fields are null. Several files need the same columns."""
    head = spark.read.text(path).limit(2).collect()
    if len(head) < 2:
        raise ValueError(f"{path} has no two header lines")
    names, kinds = (x.value.split("\t") for x in head)
    text = spark.read.csv(path, sep="\t", header=True, schema=", ".join(f"`{n}` string" for n in names), enforceSchema=True)
    border = F.lit(True)
    for n, k in list(zip(names, kinds))[:20]:
        border = border & (F.col(f"`{n}`") == k)
    rows = text.filter(~F.coalesce(border, F.lit(False)))
    number = lambda n: F.when(F.lower(F.trim(F.col(f"`{n}`"))).isin("nan", "", "null"), None).otherwise(F.trim(F.col(f"`{n}`"))).try_cast("double")
    return rows.select(*((number(n) if k.strip().startswith("N") else F.nullif(F.col(f"`{n}`"), F.lit(""))).alias(n) for n, k in zip(names, kinds)))


def write_rdb(df: DataFrame, path: str) -> None:
    """A folder of one text file: for the small tables of a result (a row for each exposure or night)."""
    kinds = ["N" if isinstance(f.dataType, NUMBERS) else "S" for f in df.schema.fields]
    field = lambda f: F.coalesce(F.regexp_replace(F.col(f"`{f.name}`").cast("string"), r"[\t\r\n]", " "), F.lit("nan" if isinstance(f.dataType, NUMBERS) else ""))
    lines = df.select(F.concat_ws("\t", *(field(f) for f in df.schema.fields)).alias("value"))
    head = df.sparkSession.createDataFrame([("\t".join(df.columns),), ("\t".join(kinds),)], "value string")
    head.coalesce(1).union(lines.coalesce(1)).coalesce(1).write.mode("overwrite").text(path)
