"""Token-id files: independent zstandard frames with a trailing seek table and per-frame checksums.

One frame holds one document. A file is

    frame*  [skippable frame: document ids]  [skippable frame: seek table]

The seek table follows the published zstandard seekable format: for each frame its compressed size, its plain size and
the low 32 bits of the XXH64 of its plain bytes, then the number of frames, a descriptor byte and a magic number. Any
zstandard reader decompresses the whole file; a reader that wants some documents reads the tail, then those frames only.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import CachedBpe
from .common import byte_slices, materialize, shared_dir, texts

# Fixed values of the zstandard seekable format: magic numbers of the skippable frames and of the footer.
INDEX_MAGIC = 0x184D2A5D
SEEK_MAGIC = 0x184D2A5E
FOOTER_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

NULL_ID = -(1 << 63)
MANIFEST = "part int, file string, first_doc long, last_doc long, docs long, tokens long"


def encode_frames(df: DataFrame, tokenizer: str, end_id: int, level: int = 3) -> DataFrame:
    """doc_id, n_tokens, width (bytes an id), frame: each document's ids and end_id as one zstandard frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, pack = CachedBpe(tokenizer), zstandard.ZstdCompressor(level=level, write_content_size=True)
        width = max(bpe.dtype.itemsize, 2 if end_id < 1 << 16 else 4)
        for batch in batches:
            for part in byte_slices(batch, "text"):
                plain = [np.append(ids, end_id).astype(f"<u{width}").tobytes() for ids in bpe.encode(part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(p) // width for p in plain], pa.int64()), pa.array([width] * len(plain), pa.int32()),
                     pa.array([xxhash.xxh64_intdigest(p) & 0xFFFFFFFF for p in plain], pa.int64()), pa.array([pack.compress(p) for p in plain], pa.binary())],
                    ["doc_id", "n_tokens", "width", "checksum", "frame"])

    return df.mapInArrow(run, "doc_id long, n_tokens long, width int, checksum long, frame binary")


def write_token_files(df: DataFrame, tokenizer: str, folder: str, *, end_id: int, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = 64 << 20) -> DataFrame:
    """Encode every document and write files of about file_bytes in ascending id order; returns the manifest.

    The manifest has one row for each file: part (order of the files), file (uri), first_doc, last_doc, docs, tokens and
    start, the number of ids in all files before it. It is itself a table in the folder. Documents of one id follow each
    other by checksum; a null id sorts first and a null text is the empty one. An empty table gives an empty manifest.
    Files carry the task's attempt in their names and the manifest lists those of finished tasks, so a task that runs
    twice does no harm.
    """
    frames = materialize(encode_frames(texts(df, id_col, text_col), tokenizer, end_id), "none")
    total = frames.agg(F.sum(F.length("frame"))).first()[0] or 0
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_files = max(1, -(-total // file_bytes), min(parts, -(-total // (1 << 20))))  # files of a megabyte at least, so that small tables are written by several tasks

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        sink, name, sizes, docs = None, "", [], []
        tokens, width = 0, 2
        for batch in batches:
            if not batch.num_rows:
                continue
            if sink is None:
                task = TaskContext.get()
                name = f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}.zst"
                store, path = fs.FileSystem.from_uri(name)
                store.create_dir(path.rpartition("/")[0], recursive=True)
                sink = store.open_output_stream(path, compression=None)
            for doc, n, width, check, frame in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "width", "checksum", "frame"))):
                sink.write(frame)
                sizes.append((len(frame), n * width, check))
                docs.append(NULL_ID if doc is None else doc)
                tokens += n
        if sink is not None:
            ids = struct.pack("<II", len(docs), width) + np.array(docs, "<i8").tobytes()
            table = np.array(sizes, "<u4").tobytes() + struct.pack("<IBI", len(sizes), CHECKSUM_FLAG, FOOTER_MAGIC)
            for magic, body in ((INDEX_MAGIC, ids), (SEEK_MAGIC, table)):
                sink.write(struct.pack("<II", magic, len(body)) + body)
            sink.close()
            out = [task.partitionId(), name, *(None if x == NULL_ID else x for x in (docs[0], docs[-1])), len(docs), tokens]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(out, (pa.int32(), pa.string(), *[pa.int64()] * 4))], [c.split()[0] for c in MANIFEST.split(", ")])

    ordered = frames.repartitionByRange(n_files, "doc_id", "checksum", "n_tokens").sortWithinPartitions("doc_id", "checksum", "n_tokens")
    manifest = materialize(ordered.mapInArrow(write, MANIFEST))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    return materialize(manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0))))


class TokenFile:
    """Reader of one file: the tail gives each document's place, frames are read when asked for."""

    def __init__(self, uri: str):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        self.source = store.open_input_file(path)
        size = self.source.size()
        count, flag, magic = struct.unpack("<IBI", self.source.read_at(9, size - 9))
        if magic != FOOTER_MAGIC or not flag & CHECKSUM_FLAG:
            raise ValueError(f"{uri} has no seek table with checksums")
        at = size - 9 - 12 * count - 8
        self.sizes = np.frombuffer(self.source.read_at(12 * count, at + 8), "<u4").reshape(count, 3)
        at -= 8 + 8 * count
        n, self.width = struct.unpack("<II", self.source.read_at(8, at))
        self.docs = np.frombuffer(self.source.read_at(8 * n, at + 8), "<i8")
        self.places = np.concatenate([[0], np.cumsum(self.sizes[:, 0], dtype=np.int64)])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes[:, 1] // self.width, dtype=np.int64)])
        self.unpack = zstandard.ZstdDecompressor()

    def ids(self, i: int, raw: bytes | None = None) -> np.ndarray:
        """The ids of the i-th document, checked against its checksum."""
        raw = self.source.read_at(int(self.sizes[i, 0]), int(self.places[i])) if raw is None else raw
        plain = self.unpack.decompress(raw, max_output_size=int(self.sizes[i, 1]))
        if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.sizes[i, 2]:
            raise ValueError(f"checksum of document {self.docs[i]} does not fit")
        return np.frombuffer(plain, f"<u{self.width}").astype("<u4")

    def all(self, chunk: int = 4 << 20) -> Iterator[tuple[int, np.ndarray]]:
        """Every document in order, by reads of about chunk bytes."""
        i = 0
        while i < len(self.docs):
            j = max(i + 1, int(np.searchsorted(self.places, self.places[i] + chunk, "right")) - 1)
            raw = self.source.read_at(int(self.places[j] - self.places[i]), int(self.places[i]))
            for k in range(i, j):
                a, b = int(self.places[k] - self.places[i]), int(self.places[k + 1] - self.places[i])
                yield k, self.ids(k, raw[a:b])
            i = j


def read_token_files(manifest: DataFrame, doc_ids: list[int] | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and the ids, of all documents or of those asked for (a short list).

    Files whose range of ids holds none of doc_ids are not opened, and of the others only the frames asked for are read.
    """
    wanted = None if doc_ids is None else sorted(set(doc_ids))
    if wanted is not None:
        manifest = manifest.filter(F.exists(F.array(*map(F.lit, wanted)) if wanted else F.array().cast("array<long>"), lambda x: x.between(F.coalesce("first_doc", F.lit(NULL_ID)), F.col("last_doc"))))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                file, rows, held = TokenFile(name), [], 0
                found = file.all() if wanted is None else ((int(i), file.ids(int(i))) for i in np.flatnonzero(np.isin(file.docs, wanted)))
                for i, ids in found:
                    doc = int(file.docs[i])
                    rows.append((None if doc == NULL_ID else doc, start + int(file.starts[i]), len(ids), zlib.crc32(ids.tobytes()), ids))
                    held += len(ids)
                    if held > 1 << 20 or len(rows) >= 5000:
                        yield _rows(rows, with_ids)
                        rows, held = [], 0
                if rows:
                    yield _rows(rows, with_ids)

    n = max(1, manifest.count())
    return manifest.select("part", "file", "start").repartition(n, "part").mapInArrow(run, schema)


def _rows(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    arrays = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
    if with_ids:
        arrays.append(pa.array([r[4].astype(np.int32) for r in rows], pa.list_(pa.int32())))
    return pa.RecordBatch.from_arrays(arrays, names + ["ids"] * with_ids)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, written as seekable frames in id order and read back."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), shared_dir(spark), end_id=2)
    return read_token_files(manifest, with_ids=False)
