"""FITS files as a data source: spark.read.format("fits"). Headers are read block by block, pixels only where they are asked for.

Options: path (folder, or file), glob (default *.fits), keys (header keys, comma-separated, that become string columns), slices
(files a partition, default 16). Columns: path, unit, name, header, the keys, row and pixels. Without row and pixels in the
schema there is one row for each part of a file, and no pixel is read. Filters on path leave files unopened, those on unit,
name and keys leave pixels unread, those on row leave the other rows of an image unread. Files lie where pyarrow's file
systems reach; others are read by fits.read_images.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql.types import StructType

from lumenrv.sources.fits import BLOCK, PIXELS, cards

#: What can be told of a value without Spark; a null meets none of these.
TESTS: dict[type, Callable[[object, D.Filter], bool]] = {
    D.EqualTo: lambda v, f: v == f.value, D.In: lambda v, f: v in f.value, D.GreaterThan: lambda v, f: v > f.value, D.GreaterThanOrEqual: lambda v, f: v >= f.value,
    D.LessThan: lambda v, f: v < f.value, D.LessThanOrEqual: lambda v, f: v <= f.value, D.StringStartsWith: lambda v, f: v.startswith(f.value), D.StringEndsWith: lambda v, f: v.endswith(f.value),
    D.StringContains: lambda v, f: f.value in v, D.IsNotNull: lambda v, f: True,
}


def meets(value: object, filters: Iterable[D.Filter]) -> bool:
    return all(value is not None and TESTS[type(f)](value, f) for f in filters)


class FitsDataSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "fits"

    def keys(self) -> list[str]:
        return [k.strip() for k in self.options.get("keys", "").split(",") if k.strip()]

    def schema(self) -> str:
        keys = "".join(f", `{k}` string" for k in self.keys())
        return f"path string, unit int, name string, header map<string,string>{keys}, row int, pixels array<double>"

    def reader(self, schema: StructType) -> FitsReader:
        return FitsReader(self.options, schema)


class Files(D.InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class FitsReader(D.DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.options, self.names = dict(options), schema.fieldNames()
        self.arrow = pa.schema([(f.name, pa.map_(pa.string(), pa.string()) if f.name == "header" else pa.list_(pa.float64()) if f.name == "pixels" else pa.int32() if f.name in ("unit", "row") else pa.string()) for f in schema.fields])
        self.filters: dict[str, list[D.Filter]] = {}
        self.bytes_read = 0

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        for f in filters:
            if type(f) in TESTS and len(f.attribute) == 1 and f.attribute[0] in self.names and f.attribute[0] not in ("header", "pixels"):
                self.filters.setdefault(f.attribute[0], []).append(f)
            else:
                yield f

    def partitions(self) -> Sequence[D.InputPartition]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.options["path"])
        prefix = self.options["path"][: -len(path)] if self.options["path"].endswith(path) else ""
        info = store.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True))
        glob = self.options.get("glob", "*.fits")
        paths = sorted(f"{prefix}{x.path}" for x in found if x.type == fs.FileType.File and fnmatch.fnmatch(x.base_name, glob))
        paths = [p for p in paths if meets(p, self.filters.get("path", ()))]
        n = int(self.options.get("slices", 16))
        return [Files(paths[k : k + n]) for k in range(0, len(paths), n)] or [Files([])]

    def _bytes(self, source: pa.NativeFile, at: int, n: int) -> bytes:
        source.seek(at)
        raw = source.read(n)
        self.bytes_read += len(raw)
        return raw

    def _units(self, source: pa.NativeFile) -> Iterator[tuple[dict[str, str], int]]:
        """Header of each part and where its data begin; the data are passed over."""
        at, size = 0, source.size()
        while at + BLOCK <= size:
            raw = b""
            while at + BLOCK <= size:
                block = self._bytes(source, at, BLOCK)
                raw, at = raw + block, at + BLOCK
                if any(block[k : k + 8] == b"END     " for k in range(0, BLOCK, 80)):
                    break
            head = cards(raw)
            axes = [int(head.get(f"NAXIS{k + 1}", 0)) for k in range(int(head.get("NAXIS", 0)))]
            length = abs(int(head.get("BITPIX", 8))) // 8 * int(np.prod(axes)) if axes else 0
            length += int(head.get("PCOUNT", 0)) if head.get("XTENSION") else 0
            yield head, at
            at += -(-length // BLOCK) * BLOCK

    def _image_rows(self, source: pa.NativeFile, head: dict[str, str], at: int) -> Iterator[tuple[int, np.ndarray]]:
        axes = [int(head[f"NAXIS{k + 1}"]) for k in range(int(head["NAXIS"]))]
        kind = np.dtype(PIXELS[int(head["BITPIX"])])
        width = axes[0]
        for r in range(int(np.prod(axes[1:])) if len(axes) > 1 else 1):
            if not meets(r, self.filters.get("row", ())):
                continue
            raw = np.frombuffer(self._bytes(source, at + r * width * kind.itemsize, width * kind.itemsize), kind)
            out = raw.astype(float) * float(head.get("BSCALE", 1)) + float(head.get("BZERO", 0))
            if "BLANK" in head:
                out[raw == int(head["BLANK"])] = np.nan
            yield r, out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        wanted = {"row", "pixels"} & set(self.names)
        for full in partition.paths:
            store, path = fs.FileSystem.from_uri(full)
            with store.open_input_file(path) as source:
                for unit, (head, at) in enumerate(self._units(source)):
                    known = {**{k: head.get(k) for k in self.names}, "path": full, "unit": unit, "name": head.get("EXTNAME")}
                    if not all(meets(known[c], f) for c, f in self.filters.items() if c not in ("row", "pixels")):
                        continue
                    known["header"] = list(head.items())
                    if not wanted:
                        yield pa.RecordBatch.from_pylist([{c: known[c] for c in self.names}], self.arrow)
                    elif int(head.get("NAXIS", 0)) and "TFIELDS" not in head and int(head.get("NAXIS1", 0)):
                        for r, pixels in self._image_rows(source, head, at):
                            columns = []
                            for f in self.arrow:
                                if f.name == "pixels":
                                    columns.append(pa.ListArray.from_arrays(pa.array([0, len(pixels)], pa.int32()), pa.array(pixels, mask=np.isnan(pixels))))
                                else:
                                    columns.append(pa.array([r if f.name == "row" else known[f.name]], f.type))
                            yield pa.RecordBatch.from_arrays(columns, schema=self.arrow)


def register_fits(spark: SparkSession) -> None:
    """Make the format known to a session, and let filters be handed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FitsDataSource)


def load_fits(spark: SparkSession, path: str, *, keys: Sequence[str] = (), columns: Sequence[str] | None = None, glob: str = "*.fits", slices: int = 16) -> DataFrame:
    """Parts of FITS files with the given columns only (default: all): those without row and pixels cost their headers."""
    register_fits(spark)
    reader = spark.read.format("fits").option("keys", ",".join(keys)).option("glob", glob).option("slices", slices)
    if columns is not None:
        kinds = {"unit": "int", "header": "map<string,string>", "row": "int", "pixels": "array<double>"}
        reader = reader.schema(", ".join(f"`{c}` {kinds.get(c, 'string')}" for c in columns))
    return reader.load(path)
