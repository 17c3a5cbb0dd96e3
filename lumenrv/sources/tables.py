"""Searches for inputs by name and header, and the tables that a run writes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REFERENCE = "ORDER int, WAVE_START double, WAVE_END double, WEIGHT_LINE double, XPIX double"
#: All columns of a table of lines, as a run keeps them for each object.
FULL_REFERENCE = f"{REFERENCE}, LINE_SNR double, LINE_DEPTH double, LOCAL_FLUX double, RMSRATIO double, NPIXLINE int, MEANXPIX double, MEANBLAZE double, AMP_CONTINUUM double, CHI2 double, CHI2_VALID_CDF double"
MASK_TYPES = ("full", "neg", "pos")


def fits_search(name: Column, header: Column, *, prefix: str = "", suffix: str = "", contains: Sequence[str] = (), keys: Mapping[str, Sequence[str]] | None = None) -> Column:
    """Whether a file's name and header fit: all of contains, and for each key one of its values (compared as text)."""
    out = name.startswith(prefix) & name.endswith(suffix)
    for part in contains:
        out = out & name.contains(part)
    for key, values in (keys or {}).items():
        out = out & F.coalesce(F.trim(F.try_element_at(header, F.lit(key))).isin(*map(str, values)), F.lit(False))
    return out


def required(df: DataFrame, what: str) -> DataFrame:
    """df, or an error if it has no rows."""
    if df.isEmpty():
        raise FileNotFoundError(f"no {what}")
    return df


def read_reference(spark: SparkSession, path: str, schema: str = REFERENCE) -> DataFrame:
    """A table of lines with their orders (with all columns: FULL_REFERENCE), as CSV with a header; nan and empty fields are null."""
    rows = spark.read.csv(path, header=True, schema=schema, nanValue="nan")
    return rows.select(*(F.nanvl(c, F.lit(None)).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes))


def write_reference(df: DataFrame, path: str, schema: str = REFERENCE) -> None:
    df.select(*(c.split()[0] for c in schema.split(", "))).write.mode("overwrite").csv(path, header=True)


def write_lines(df: DataFrame, path: str, science: str, template: str) -> None:
    """Line velocities as a table in parts of object and template; a run replaces its own part only."""
    out = df.withColumns({"object": F.lit(science), "template": F.lit(template)})
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("object", "template").parquet(path)


def read_lines(spark: SparkSession, path: str, science: str, template: str) -> DataFrame:
    return spark.read.parquet(path).filter((F.col("object") == science) & (F.col("template") == template))


def masks(lines: DataFrame, weight: str) -> DataFrame:
    """All lines, those of positive and those of negative weight, told apart by mask_type (a line is in two of the three)."""
    kinds = F.array_compact(F.array(F.lit("full"), F.when(F.col(weight) < 0, "pos"), F.when(F.col(weight) > 0, "neg")))
    return lines.withColumn("mask_type", F.explode(kinds))


def write_masks(lines: DataFrame, path: str, weight: str = "weight") -> None:
    masks(lines, weight).write.mode("overwrite").partitionBy("mask_type").parquet(path)


def long_facts(table: DataFrame, keys: Sequence[str], pairs: Mapping[str, str]) -> DataFrame:
    """A wide table of values and errors as rows: quantity, value, error."""
    items = F.array(*(F.struct(F.lit(v).alias("quantity"), F.col(v).cast("double").alias("value"), F.col(e).cast("double").alias("error")) for v, e in pairs.items()))
    return table.select(*keys, F.inline(items))


def _card(key: str, value: object) -> bytes:
    if isinstance(value, bool):
        text = f"{'T' if value else 'F':>20}"
    elif isinstance(value, (int, float)):
        text = f"{value!r:>20}"
    else:
        clean = str(value).encode("ascii", "ignore").decode().replace("'", "''")
        text = f"'{clean:<8}'"
    head = f"{key:<8}= {text}" if len(key) <= 8 else f"HIERARCH {key} = {text.strip()}"
    return head.ljust(80).encode()[:80] if len(head) <= 80 else b""  # longer ones cannot be written


def header_bytes(cards: Sequence[tuple[str, object]]) -> bytes:
    """A header of whole blocks."""
    raw = b"".join(_card(k, v) for k, v in cards) + b"END".ljust(80)
    return raw + b" " * (-len(raw) % 2880)


def fits_bytes(parts: Sequence[tuple[str, Mapping[str, object], np.ndarray | None]]) -> bytes:
    """A FITS file of images: name, header and pixels (rows first) of each part; the first may have none."""

    out = b""
    for i, (name, header, data) in enumerate(parts):
        axes = () if data is None else data.shape[::-1]
        fixed: list[tuple[str, object]] = [("SIMPLE", True) if i == 0 else ("XTENSION", "IMAGE"), ("BITPIX", -64 if axes else 8), ("NAXIS", len(axes)), *((f"NAXIS{k + 1}", int(n)) for k, n in enumerate(axes))]
        fixed += [("EXTEND", True)] if i == 0 else [("PCOUNT", 0), ("GCOUNT", 1)]
        taken = {k for k, _ in fixed}
        block = header_bytes([*fixed, ("EXTNAME", name), *((k, v) for k, v in header.items() if k not in taken and k not in ("", "END"))])
        body = b"" if data is None else np.ascontiguousarray(data, ">f8").tobytes()
        out += block + body + b"\0" * (-len(body) % 2880)
    return out


def write_images(rows: DataFrame, folder: str, *, name: str = "name", header: str = "header", pixels: str = "pixels") -> DataFrame:
    """A FITS file for each row (name, header map, pixels as rows of arrays), written by the tasks; returns name and bytes.

    A task that runs twice writes the same files again.
    """
    from collections.abc import Iterator

    import pandas as pd

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for part in parts:
            sizes = []
            for n, h, p in zip(part[name], part[header], part[pixels]):
                raw = fits_bytes([("PRIMARY", {}, None), ("IMAGE", dict(h or {}), np.array([list(r) for r in p], float))])
                store, path = fs.FileSystem.from_uri(f"{folder}/{n}")
                store.create_dir(path.rpartition("/")[0], recursive=True)
                with store.open_output_stream(path, compression=None) as sink:
                    sink.write(raw)
                sizes.append(len(raw))
            yield pd.DataFrame({"name": part[name], "bytes": sizes})

    return rows.select(name, header, pixels).mapInPandas(run, "name string, bytes long")


#: Column formats of binary tables for Spark's types, and numpy's for writing them.
FORMS = {"double": ("D", ">f8"), "float": ("E", ">f4"), "int": ("J", ">i4"), "bigint": ("K", ">i8"), "smallint": ("I", ">i2"), "boolean": ("L", "S1")}


def table_bytes(columns: Mapping[str, str], rows: Mapping[str, Sequence[object]], header: Mapping[str, object] | None = None, name: str = "TABLE") -> bytes:
    """A FITS file with one binary table; columns: Spark type by name. A missing number is NaN, 0 in whole numbers, a string ''."""
    n = len(next(iter(rows.values()), ()))
    fields, cards, data = [], [], {}
    for k, (column, kind) in enumerate(columns.items(), 1):
        values = rows[column]
        if kind == "string":
            raw = [str("" if v is None else v).encode("ascii", "ignore") for v in values]
            form, dtype = f"{max([1, *map(len, raw)])}A", f"S{max([1, *map(len, raw)])}"
            data[column] = np.array(raw, dtype)
        else:
            form, dtype = FORMS[kind]
            if kind == "boolean":
                data[column] = np.array([b"\0" if v is None else b"T" if v else b"F" for v in values], "S1")
            else:
                data[column] = np.array([(np.nan if kind in ("double", "float") else 0) if v is None else v for v in values], dtype)
        fields.append((column, dtype))
        cards += [(f"TTYPE{k}", column), (f"TFORM{k}", form)]
    table = np.zeros(n, np.dtype(fields))
    for column in columns:
        table[column] = data[column]
    fixed = [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", table.dtype.itemsize), ("NAXIS2", n), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", len(fields)), *cards, ("EXTNAME", name), *(header or {}).items()]
    raw = table.tobytes()
    return fits_bytes([("PRIMARY", {}, None)]) + header_bytes(fixed) + raw + b"\0" * (-len(raw) % 2880)


def write_tables(df: DataFrame, folder: str, file: str, *, header: Mapping[str, object] | None = None) -> DataFrame:
    """A FITS file with a binary table for each value of the column file (its name), written by the tasks; returns name and bytes.

    The rows of one file are one group: let a file be an exposure, a night or a part of a larger table. A task that runs twice writes the same file again.
    """
    import pandas as pd

    columns = {c: t for c, t in df.dtypes if c != file}
    if bad := {c: t for c, t in columns.items() if t != "string" and t not in FORMS}:
        raise TypeError(f"columns that a binary table cannot hold: {bad}")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        name = rows[file].iloc[0]
        plain = {c: [None if v is None or v is pd.NA or isinstance(v, float) and np.isnan(v) else v for v in rows[c]] for c in columns}
        raw = table_bytes(columns, plain, header)
        store, path = fs.FileSystem.from_uri(f"{folder}/{name}")
        store.create_dir(path.rpartition("/")[0], recursive=True)
        with store.open_output_stream(path, compression=None) as sink:
            sink.write(raw)
        return pd.DataFrame({"name": [name], "bytes": [len(raw)]})

    return df.filter(F.col(file).isNotNull()).groupBy(file).applyInPandas(run, "name string, bytes long")


def write_template(template: DataFrame, science: DataFrame, folder: str, name: str) -> None:
    """A template and the exposures it was made of: parquet tables template and science in folder/name, written over."""
    template.write.mode("overwrite").parquet(f"{folder}/{name}/template")
    science.write.mode("overwrite").parquet(f"{folder}/{name}/science")


def read_template(spark: SparkSession, folder: str, name: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/{name}/template"), spark.read.parquet(f"{folder}/{name}/science")
