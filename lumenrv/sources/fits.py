"""FITS files by Spark's binary reader: headers as maps, images as rows of arrays, binary tables as rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

BLOCK = 2880
#: Number formats of images (BITPIX) and of binary table columns.
PIXELS = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
COLUMNS = {"L": ("S1", 1), "B": (">u1", 1), "I": (">i2", 2), "J": (">i4", 4), "K": (">i8", 8), "E": (">f4", 4), "D": (">f8", 8), "A": ("S", 1)}


def cards(block: bytes) -> dict[str, str]:
    """Keys and values of a header; strings without quotes, HIERARCH keys without that word."""
    out: dict[str, str] = {}
    for at in range(0, len(block), 80):
        card = block[at : at + 80].decode("ascii", "replace")
        if card.startswith("END") and not card[3:].strip():
            break
        if card.startswith("HIERARCH") and "=" in card:
            key, _, rest = card[8:].partition("=")
        elif card[8:10] == "= ":
            key, rest = card[:8], card[10:]
        else:
            continue
        rest = rest.strip()
        if rest.startswith("'"):
            end = 1
            while (end := rest.find("'", end)) >= 0 and rest[end : end + 2] == "''":
                end += 2
            value = rest[1 : end if end > 0 else None].replace("''", "'").rstrip()
        else:
            value = rest.partition("/")[0].strip()
        out[key.strip()] = value
    return out


def units(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header and data of each part of a file."""
    at = 0
    while at + BLOCK <= len(raw):
        start = at
        while True:
            block = raw[at : at + BLOCK]
            at += BLOCK
            if any(block[k : k + 8] == b"END     " for k in range(0, BLOCK, 80)) or at >= len(raw):
                break
        head = cards(raw[start:at])
        axes = [int(head.get(f"NAXIS{k + 1}", 0)) for k in range(int(head.get("NAXIS", 0)))]
        size = abs(int(head.get("BITPIX", 8))) // 8 * int(np.prod(axes)) if axes else 0
        size += int(head.get("PCOUNT", 0)) if head.get("XTENSION") else 0
        yield head, raw[at : at + size]
        at += -(-size // BLOCK) * BLOCK


def image(head: dict[str, str], data: bytes) -> np.ndarray:
    """Pixels as doubles, scaled; blank integers are NaN. Rows come first."""
    axes = [int(head[f"NAXIS{k + 1}"]) for k in range(int(head["NAXIS"]))]
    raw = np.frombuffer(data, PIXELS[int(head["BITPIX"])], int(np.prod(axes)))
    out = raw.astype(float) * float(head.get("BSCALE", 1)) + float(head.get("BZERO", 0))
    if "BLANK" in head:
        out[raw == int(head["BLANK"])] = np.nan
    return out.reshape(axes[::-1])


def table(head: dict[str, str], data: bytes) -> pd.DataFrame:
    """Columns of a binary table; those of several values hold arrays."""
    fields, names, scales = [], [], []
    for k in range(1, int(head["TFIELDS"]) + 1):
        form = head[f"TFORM{k}"].strip()
        letter = form.lstrip("0123456789")[0]
        n = int(form[: len(form) - len(form.lstrip("0123456789"))] or 1)
        name = head.get(f"TTYPE{k}", f"col{k}")
        kind = COLUMNS[letter][0]
        fields.append((name, f"S{n}") if letter == "A" else (name, kind, (n,)))
        names.append((name, letter, n))
        scales.append((float(head.get(f"TSCAL{k}", 1)), float(head.get(f"TZERO{k}", 0))))
    rows = np.frombuffer(data, np.dtype(fields), int(head["NAXIS2"]))
    out = {}
    for (name, letter, n), (scale, zero) in zip(names, scales):
        col = rows[name]
        if letter == "A":
            out[name] = [x.decode("ascii", "replace").rstrip(" \0") for x in col]
            continue
        col = col == b"T" if letter == "L" else col.astype(col.dtype.newbyteorder("="))
        col = col * scale + zero if (scale, zero) != (1, 0) else col
        out[name] = col[:, 0] if n == 1 else list(col)
    return pd.DataFrame(out)


def _files(spark: SparkSession, path: str, glob: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def read_headers(spark: SparkSession, path: str, glob: str | None = "*.fits") -> DataFrame:
    """path, unit, name and header (map) of each part of each file, and the content's short MD5."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(p, i, h.get("EXTNAME"), h, c) for p, raw, c in zip(part["path"], part["content"], part["checksum"]) for i, (h, _) in enumerate(units(raw))]
            yield pd.DataFrame(rows, columns=["path", "unit", "name", "header", "checksum"])

    files = _files(spark, path, glob).selectExpr("path", "content", "substring(md5(content), 1, 16) as checksum")
    return files.mapInPandas(run, "path string, unit int, name string, header map<string,string>, checksum string")


def read_images(spark: SparkSession, path: str, glob: str | None = "*.fits", unit: int | str | None = None) -> DataFrame:
    """path, row (spectral order) and pixels (NaN as null) of the first image part, or of the part of a number or name."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for p, raw in zip(part["path"], part["content"]):
                for i, (h, data) in enumerate(units(raw)):
                    if data and "TFIELDS" not in h and (unit is None or unit in (i, h.get("EXTNAME"))):
                        pixels = np.atleast_2d(image(h, data))
                        lists = [[None if np.isnan(x) else x for x in r] for r in pixels.tolist()]
                        yield pd.DataFrame({"path": p, "row": np.arange(len(lists)), "pixels": lists})
                        break

    return _files(spark, path, glob).select("path", "content").mapInPandas(run, "path string, row int, pixels array<double>")


def read_tables(spark: SparkSession, path: str, schema: str, glob: str | None = "*.fits", unit: int | str | None = None) -> DataFrame:
    """path and the columns of schema, of the first binary table part, or of the part of a number or name."""
    names = [f.name for f in spark.createDataFrame([], schema).schema.fields]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for p, raw in zip(part["path"], part["content"]):
                for i, (h, data) in enumerate(units(raw)):
                    if "TFIELDS" in h and (unit is None or unit in (i, h.get("EXTNAME"))):
                        yield table(h, data)[names].assign(path=p)[["path", *names]]
                        break

    return _files(spark, path, glob).select("path", "content").mapInPandas(run, f"path string, {schema}")
