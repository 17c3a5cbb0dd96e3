"""Lexical retrieval packing: windows of related documents from a sharded BM25 inverted index.

Documents are encoded once; how many documents hold each token id, and the mean length, are counted over the whole corpus.
Shards are cut from an order of all documents that brings alike ones together: by the four nearest of some centres of hashed
term vectors (k-means over every document, a round is one pass), then by a minimum hash of token triples. A shard
is a bounded number of documents and tokens, and a group of copies of any size is spread over as many as it needs. In a shard an inverted index gives, for the seed of a window, the unused documents by falling BM25 score; they fill the window,
the last one is cut and its rest is the next seed. A window that its shard leaves open is filled from the next shard.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import CachedBpe, vocabulary_size
from .common import byte_slices, materialize, texts, tidied

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def min_hashes(flat: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The smallest hash of each document's token triples (shorter documents: of what there is)."""
    x = flat.astype(np.uint64)
    padded = np.append(x, np.zeros(2, np.uint64))
    h = (padded[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (padded[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (padded[2:] * np.uint64(0x165667B19E3779F9))
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    ends = np.cumsum(lens)
    short = lens < 3
    for back in (1, 2):  # triples that reach beyond a document do not count, unless it has no other
        h[(ends - back)[~short]] = np.uint64(0xFFFFFFFFFFFFFFFF)
    least = np.minimum.reduceat(h, ends - lens)
    least = (least ^ (least >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)  # longer documents have smaller ones: even that out
    return (least ^ (least >> np.uint64(27))).view(np.int64)


def term_counts(flat: np.ndarray, lens: np.ndarray, vocabulary: int, docs: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Place of the document, token id and how often, for the distinct ids of each document, some documents at a time."""
    ends = np.cumsum(lens)
    for at in range(0, len(lens), docs):
        n = lens[at : at + docs]
        mine = flat[ends[at] - lens[at] : ends[at + len(n) - 1]]
        pairs = np.repeat(np.arange(len(n), dtype=np.uint32) * np.uint32(vocabulary), n) + mine.astype(np.uint32)
        pairs.sort()
        first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
        doc, term = np.divmod(pairs[first], np.uint32(vocabulary))
        yield at + doc.astype(np.int64), term.astype(np.int64), np.diff(np.append(first, len(pairs)))


class Centres:
    """Centres of hashed term vectors; cells() numbers each document's four nearest ones in order."""

    def __init__(self, held: np.ndarray, documents: int, *, dims: int = 512, seed: int = 11):
        """held: for each token id how many of the documents hold it. There are no centres before begin()."""
        rng = np.random.default_rng(seed)
        vocabulary = len(held)
        self.dims, self.centres = dims, np.zeros((0, dims), np.float32)
        self.place = rng.integers(0, dims, vocabulary).astype(np.int32)
        self.weight = np.where(held > 1, np.maximum(0, np.log((documents + 1) / (held + 0.5))), 0) * rng.choice([-1.0, 1.0], vocabulary)
        self.rng = rng

    def begin(self, packed: list[bytes], centres: int = 16) -> None:
        """The first different ones of some documents' vectors are the first centres; of fewer than two there are none."""
        first = list(dict.fromkeys(packed))[:centres]
        if len(first) > 1:
            self.centres = unpacked(first, self.dims)

    def settle(self, sums: np.ndarray) -> None:
        """Centres become the directions of their documents' sums; one without stays."""
        size = np.sqrt((sums * sums).sum(axis=1))
        self.centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1e-9)[:, None], self.centres).astype(np.float32)

    def vectors(self, flat: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Unit vectors of documents: the ids' weights, summed in hashed places."""
        at = np.repeat(np.arange(len(lens)) * self.dims, lens) + self.place[flat]
        x = np.bincount(at, self.weight[flat], len(lens) * self.dims).reshape(-1, self.dims).astype(np.float32)
        x = np.copysign(np.log1p(np.abs(x)), x)  # so that no repeated word outweighs the rest
        return x / np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-9)[:, None]

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Of unit vectors."""
        if not len(self.centres):
            return np.zeros(len(x), np.int32)
        near = np.argsort(-(x @ self.centres.T), axis=1, kind="stable")[:, :4]
        return (near @ (len(self.centres) ** np.arange(near.shape[1])[::-1])).astype(np.int32)


def packed_vectors(x: np.ndarray) -> list[bytes]:
    """Vectors in signed bytes, the largest component of each as 127."""
    most = np.abs(x).max(axis=1, initial=0)
    return [v.tobytes() for v in np.rint(x * (127 / np.where(most > 0, most, 1))[:, None]).astype(np.int8)]


def unpacked(packed: list[bytes], dims: int) -> np.ndarray:
    """Unit vectors again."""
    x = np.frombuffer(b"".join(packed), np.int8).reshape(-1, dims).astype(np.float32)
    return x / np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-9)[:, None]


def fit_centres(coded: DataFrame, held: np.ndarray, documents: int, rounds: int = 8) -> tuple[Centres, DataFrame]:
    """Centres of all documents, and the documents' vectors: these are written once, and each round reads every one of them.

    The sums of a round are of whole numbers, so that they do not depend on an order; of each round one row a centre reaches
    the driver.
    """
    found = Centres(held, documents)
    shared = coded.sparkSession.sparkContext.broadcast(found)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                v = pa.array(packed_vectors(shared.value.vectors(*_ids(part))), pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "n", "near")), v], ["doc_id", "n", "near", "v"])

    written = materialize(coded.select("doc_id", "n", "near", "width", "ids").mapInArrow(tidied(vectors), "doc_id long, n long, near long, v binary"))
    # to begin with, documents by a hash of their number; the rounds are over all
    found.begin([bytes(r.v) for r in written.orderBy(F.xxhash64("doc_id"), "doc_id", "v").limit(128).collect()])
    for _ in range(rounds if len(found.centres) else 0):
        sums = np.zeros(found.centres.shape)
        for r in written.select("v").mapInArrow(tidied(nearest_sums(found.centres)), "k int, s binary").groupBy("k").applyInArrow(total_sums, "k int, s binary").collect():
            sums[r.k] = np.frombuffer(r.s)
        found.settle(sums)
    return found, written


def nearest_sums(centres: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For batches of packed vectors: for each centre the sum of the vectors to which it is the nearest, in whole 2**-13."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(centres.shape)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                x = unpacked(batch.column("v").slice(at, 1024).to_pylist(), centres.shape[1])
                near = (x @ centres.T).argmax(axis=1)
                x *= 8192  # 1,024 of them stay below 2**24, so that their sums are exact
                sums += (near == np.arange(len(centres))[:, None]).astype(np.float32) @ np.rint(x, out=x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums), dtype=np.int32)), pa.array([x.tobytes() for x in sums], pa.binary())], ["k", "s"])

    return run


def total_sums(tasks: pa.Table) -> pa.Table:
    """The sums of all tasks for one centre."""
    total = sum(np.frombuffer(x) for x in tasks.column("s").to_pylist())
    return pa.table({"k": tasks.column("k")[:1], "s": pa.array([total.tobytes()], pa.binary())})


@cache
def worker_encoder(tokenizer: str) -> CachedBpe:
    """The encoder that a worker's tasks share, so that each does not learn the same words anew; two workers of an executor share its memory."""
    return CachedBpe(tokenizer, 400_000)


def encode_documents(rows: DataFrame, tokenizer: str, end_id: int, vocabulary: int) -> DataFrame:
    """doc_id, n (ids with end_id), width, ids (little-endian) and near (hash of likeness).

    Each task adds one row that has held alone: for each token id how many of its documents hold it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_encoder(tokenizer)
        width = max(bpe.dtype.itemsize, 2 if end_id < 1 << 16 else 4)
        counts = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for part in byte_slices(batch, "text", 2 << 20):
                ids = [np.append(x, end_id).astype(f"<u{width}") for x in bpe.encode(part.column("text").to_pylist())]
                lens, flat = np.array([len(x) for x in ids]), np.concatenate(ids)
                cut = np.append(0, np.cumsum(lens))
                near = [min_hashes(flat[cut[i] : cut[i + 32]] if i + 32 < len(lens) else flat[cut[i] :], lens[i : i + 32]) for i in range(0, len(lens), 32)]  # arrays that fit the processor's cache
                for _, term, _ in term_counts(flat, lens, vocabulary):
                    counts += np.bincount(term, minlength=vocabulary)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(lens), pa.array(np.full(len(ids), width, np.int32)), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(np.concatenate(near)), pa.nulls(len(ids), pa.binary())],
                    names)
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64())] + [pa.array([counts.astype("<i8").tobytes()], pa.binary())], names)

    names = ["doc_id", "n", "width", "ids", "near", "held"]
    return rows.mapInArrow(tidied(run), "doc_id long, n long, width int, ids binary, near long, held binary")


ORDER = ["cell", "near", "doc_id", "n"]


def ranges(vectors: DataFrame, centres: Broadcast, parts: int) -> list[tuple]:
    """Where about equal numbers of documents begin in ORDER, from their vectors: one row a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                cells = centres.value.cells(unpacked(part.column("v").to_pylist(), centres.value.dims))
                yield pa.RecordBatch.from_arrays([pa.array(cells), *(part.column(c) for c in ORDER[1:])], ORDER)

    small = vectors.mapInArrow(tidied(run), "cell int, near long, doc_id long, n long")
    found = small.repartitionByRange(parts, *ORDER).groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct(*ORDER)).alias("first")).collect()
    return sorted(place(*r.first) for r in found)


def place(cell: int, near: int, doc_id: int | None, n: int) -> tuple:
    """A document's place in ORDER, a null id first."""
    return cell, near, doc_id is not None, doc_id or 0, n


def in_ranges(coded: DataFrame, centres: Broadcast, begins: list[tuple]) -> DataFrame:
    """coded with cell, each document's nearest centres, and part, the range that it falls in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                own = centres.value
                cells = own.cells(unpacked(packed_vectors(own.vectors(*_ids(some))), own.dims))
                keys = zip(cells.tolist(), *(some.column(c).to_pylist() for c in ORDER[1:]))
                part = [max(bisect_right(begins, place(*k)) - 1, 0) for k in keys]
                yield some.append_column("cell", pa.array(cells)).append_column("part", pa.array(part, pa.int32()))

    return coded.mapInArrow(tidied(run), "doc_id long, n long, width int, ids binary, near long, cell int, part int")


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch and each document's number of them."""
    width = batch.column("width")[0].as_py()
    col = batch.column("ids")
    raw = b"".join(x.as_buffer() for x in col)
    return np.frombuffer(raw, f"<u{width}"), batch.column("n").to_numpy()


def document_counts(tasks: DataFrame, vocabulary: int) -> np.ndarray:
    """How many documents hold each token id, from the counts of the encoding's tasks: one vector of the vocabulary's size reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for raw in batch.column("held"):
                counts += np.frombuffer(raw.as_buffer(), "<i8")
        terms = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(counts[terms])], ["term", "n"])

    rows = tasks.select("held").mapInArrow(tidied(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(vocabulary, np.int64)
    for r in rows:
        out[r["term"]] = r["n"]
    return out


class Shard:
    """BM25 inverted index of some documents; idf and mean length are the corpus's."""

    def __init__(self, flat: np.ndarray, lens: np.ndarray, idf: np.ndarray, mean: float, k1: float, b: float):
        n = len(lens)
        pairs = flat.astype(np.uint64) * np.uint64(n) + np.repeat(np.arange(n, dtype=np.uint64), lens)
        if len(idf) * n < 1 << 32:
            pairs = pairs.astype(np.uint32)
        pairs.sort()
        at = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.zeros(0, np.int64)
        tf = np.diff(np.append(at, len(pairs)))
        terms, docs = np.divmod(pairs[at].astype(np.int64), n)
        useful = idf[terms] > 0
        terms, docs, tf = terms[useful], docs[useful], tf[useful]
        self.weight = (idf[terms] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * lens[docs] / mean))).astype(np.float32)
        self.docs = docs
        self.first = np.searchsorted(terms, np.arange(len(idf) + 1))
        # terms of many documents as rows of a matrix, which adds up faster than their lists
        held = np.diff(self.first)
        common = np.flatnonzero((held * 8 >= n) & (held > 8))
        self.row = np.full(len(idf), -1, np.int32)
        self.row[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), n), np.float32)
        inside = self.row[terms] >= 0
        self.rows[self.row[terms[inside]], docs[inside]] = self.weight[inside]
        by_doc = np.argsort(docs, kind="stable")
        cut = np.searchsorted(docs[by_doc], np.arange(n + 1))
        self.of = [terms[by_doc[x:y]] for x, y in zip(cut[:-1].tolist(), cut[1:].tolist())]
        self.unused = np.ones(n, bool)
        self.next, self.n = 0, n

    def scores(self, terms: np.ndarray) -> np.ndarray:
        """BM25 scores of all documents for a query of distinct terms; used ones get -1."""
        row = self.row[terms]
        few = terms[row < 0]
        a, size = self.first[few], self.first[few + 1] - self.first[few]
        ends = np.cumsum(size)
        at = np.repeat(a - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
        out = np.bincount(self.docs[at], self.weight[at], self.n) + self.rows[row[row >= 0]].sum(axis=0)
        out[~self.unused] = -1
        return out

    def first_unused(self) -> int | None:
        while self.next < self.n and not self.unused[self.next]:
            self.next += 1
        return self.next if self.next < self.n else None


class Packer:
    """Fills windows from one shard after the other; rows are pieces in the order of PIECES."""

    def __init__(self, window: int, first_sequence: int):
        self.window, self.sequence, self.used = window, first_sequence, 0
        self.rest: tuple[int, int] | None = None  # document and how many of its ids are placed
        self.terms: np.ndarray | None = None  # the open window's seed
        self.rows: list[tuple] = []

    def _place(self, doc: int, done: int, shard: Shard, ids: list[np.ndarray], names: list) -> None:
        n = min(self.window - self.used, len(ids[doc]) - done)
        self.rows.append((names[doc], done, n, zlib.crc32(ids[doc][done : done + n].astype("<u4").tobytes()), len(ids[doc]), self.sequence, self.used))
        if self.terms is None:
            self.terms = shard.of[doc]
        self.used += n
        self.rest = (doc, done + n) if done + n < len(ids[doc]) else None
        if self.used == self.window:
            self.sequence, self.used, self.terms = self.sequence + 1, 0, None

    def fill(self, shard: Shard, ids: list[np.ndarray], names: list) -> None:
        """Place every document of a shard; the last window may stay open."""
        live: np.ndarray | None = None  # scores for the open window's seed, below zero for used documents
        asked = None
        while True:
            if self.rest:
                self._place(*self.rest, shard, ids, names)
                continue
            if self.terms is None:  # a new window begins with the first unused document
                doc = shard.first_unused()
                if doc is None:
                    return
            else:
                if asked is not self.terms:
                    asked, live = self.terms, shard.scores(self.terms)
                doc = int(live.argmax())  # of equal scores the first
                if live[doc] < 0:
                    return
                live[doc] = -1
            shard.unused[doc] = False
            self._place(doc, 0, shard, ids, names)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)


def pack(
    df: DataFrame, tokenizer: str, *, end_id: int, window: int = 2048, id_col: str = "doc_id", text_col: str = "text",
    shard_docs: int = 1024, shard_tokens: int = 2 << 20, partition_tokens: int = 2 << 20, k1: float = 1.2, b: float = 0.75,
) -> DataFrame:
    """Pieces of every whole document in sequences of window ids; each id lies in exactly one piece.

    A null text is the empty one and has its end id only; repeated rows are packed each. All sequences are full but the
    last of each partition of about partition_tokens ids. An empty table gives no pieces. The order of shards is fitted to
    all documents.
    """
    rows, vocabulary = texts(df, id_col, text_col), max(vocabulary_size(tokenizer), end_id + 1)
    written = materialize(encode_documents(rows, tokenizer, end_id, vocabulary))
    coded = written.filter("held is null").drop("held")
    docs, tokens = coded.agg(F.count("*"), F.sum("n")).first()
    held = document_counts(written.filter("held is not null"), vocabulary)
    own = np.where(np.arange(vocabulary) == end_id, 0, held)  # the end of every document tells nothing apart
    fitted, vectors = fit_centres(coded, own, docs)
    centres = df.sparkSession.sparkContext.broadcast(fitted)  # of fixed size
    # terms of more than half of all documents tell nothing apart: their idf is zero
    idf = np.maximum(0.0, np.log((docs - held + 0.5) / (held + 0.5)))
    idf[held == 0] = 0
    mean = (tokens or 0) / max(docs, 1)
    idf = df.sparkSession.sparkContext.broadcast(idf)  # of the vocabulary's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(window, TaskContext.get().partitionId() << 40)
        held: list[pa.RecordBatch] = []
        n = size = 0

        def shard() -> Iterator[pa.RecordBatch]:
            got = [_ids(x) for x in held]
            flat, lens = np.concatenate([x for x, _ in got]), np.concatenate([x for _, x in got])
            names = [x for h in held for x in h.column("doc_id").to_pylist()]
            packer.fill(Shard(flat, lens, idf.value, mean, k1, b), np.split(flat, np.cumsum(lens)[:-1]), names)
            held.clear()
            yield _batch(packer.rows)
            packer.rows = []

        for batch in batches:
            at = 0
            lens = batch.column("n").to_numpy()
            for i, x in enumerate(lens.tolist()):
                n, size = n + 1, size + x
                if n == shard_docs or size >= shard_tokens:
                    held.append(batch.slice(at, i + 1 - at))
                    yield from shard()
                    at, n, size = i + 1, 0, 0
            if at < batch.num_rows:
                held.append(batch.slice(at))
        if held:
            yield from shard()

    begins = ranges(vectors, centres, max(1, -(-(tokens or 0) // partition_tokens)))
    dealt = in_ranges(coded, centres, begins).repartitionById(max(len(begins), 1), "part")  # a range partitioning would take coded through Python twice
    return dealt.sortWithinPartitions(*ORDER).mapInArrow(tidied(run), PIECES)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of 2048 ids."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1)
