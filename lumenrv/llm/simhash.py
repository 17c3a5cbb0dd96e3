"""SimHash near-duplicates: Golay-code fuzzy hashing of fingerprints.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. Two fingerprints that differ in two bits or fewer agree
in one segment (two errors, three segments), and in each other segment they differ by two bits or fewer. The binary Golay
code of length 23 is perfect: every word lies within 3 bits of one codeword, and a word at exactly 3 bits from it has five
more codewords at 4 bits. Words that differ in two bits or fewer share at least one of these one to six codewords, so that
a segment in full with the codeword of the next segment is a key which such fingerprints share in at least one of its forms.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, materialize, texts, whole_groups
from .components import components, forest

#: The generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, and the segments.
GOLAY = 0xC75
SEGMENTS = ((0, 23), (23, 23), (46, 18))
SEED = 42


def fingerprint(raw: bytes, width: int = 3, chunk: int = 1 << 16) -> int:
    """SimHash of the word shingles of UTF-8 text; bytes.lower and bytes.split know ASCII only, as wanted."""
    words = raw.lower().split()
    if not words:
        return 0
    if len(words) < width:
        words, width = [b" ".join(words)], 1
    digest, counts, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(words) - width + 1
    for at in range(0, n, chunk):
        part = words[at : at + chunk + width - 1]
        grams = map(b" ".join, zip(*(part[k:] for k in range(width))))
        h = np.fromiter((digest(g, SEED) for g in grams), np.uint64, len(part) - width + 1)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """doc_id, body (hash of the text), fp (the fingerprint's bits) of every whole text; null texts count as empty ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text", 8 << 20):
                fp = np.array([fingerprint(x.as_buffer().to_pybytes(), width) for x in part.column("text")], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("body"), pa.array(fp.view(np.int64))], ["doc_id", "body", "fp"])

    return texts(df, id_col, text_col).withColumn("body", F.xxhash64("text")).mapInArrow(run, "doc_id long, body long, fp long")


@cache
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each 11-bit syndrome the error of the nearest codeword, and the five errors of 4 bits (0 where there are none)."""

    def rest(x: np.ndarray) -> np.ndarray:
        x = x.copy()
        for bit in range(22, 10, -1):
            x ^= np.where(x >> bit & 1, GOLAY << (bit - 11), 0)
        return x

    bits = 1 << np.arange(23, dtype=np.int64)
    near = np.zeros(2048, np.int64)
    ones = [np.zeros(1, np.int64)]
    for _ in range(4):
        grown = np.unique((ones[-1][:, None] | bits[None, :]).ravel())
        ones.append(grown[np.bitwise_count(grown) == np.bitwise_count(ones[-1][:1])[0] + 1])
    for k in (1, 2, 3):
        near[rest(ones[k])] = ones[k]
    far = np.zeros((2048, 5), np.int64)
    syndrome = rest(ones[4])
    three = np.bitwise_count(near[syndrome]) == 3  # of words nearer to a codeword the others are not needed
    order = np.argsort(syndrome[three], kind="stable")
    for s, group in zip(*_grouped(syndrome[three][order], ones[4][three][order])):
        far[s] = group
    return near, far


def _grouped(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    found, at = np.unique(keys, return_index=True)
    return found, np.split(values, at[1:])


def codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 12-bit indices of up to six codewords near each 23-bit word, and which of the six there are."""
    near, far = golay_tables()
    s = words.astype(np.int64)
    for bit in range(22, 10, -1):
        s ^= np.where(s >> bit & 1, GOLAY << (bit - 11), 0)
    errors = np.concatenate([near[s][:, None], far[s]], axis=1)
    there = np.concatenate([np.ones((len(s), 1), bool), far[s] != 0], axis=1)
    return (words.astype(np.int64)[:, None] ^ errors) >> 11, there


def golay_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place in fp and key of every key: a segment in full with a codeword index of the next one."""
    fp = fp.view(np.uint64)
    cut = [((fp >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    places, keys = [], []
    for i in range(3):
        index, there = codewords(cut[(i + 1) % 3])
        key = (i << 40 | cut[i] << 12)[:, None] | index
        rows, cols = np.nonzero(there)
        places.append(rows)
        keys.append(key[rows, cols])
    return np.concatenate(places), np.concatenate(keys)


def block_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The exact way for crowded keys: all bits but two of sixteen blocks of 4, so that a key has 256 members at most."""
    fp = fp.view(np.uint64)
    places, keys = [], []
    for i in range(16):
        for j in range(i):
            hole = np.uint64(15 << 4 * i | 15 << 4 * j)
            keys.append((fp & ~hole).view(np.int64))
            places.append(np.full(len(fp), i * 16 + j, np.int64))
    return np.concatenate(places), np.concatenate(keys)


def _keyed(fps: DataFrame, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                fp = batch.column("fp").to_numpy(zero_copy_only=False)[at : at + 20_000].copy()
                if kind == "golay":
                    rows, key = golay_keys(fp)
                    form, fp = np.zeros(len(key), np.int64), fp[rows]
                else:
                    form, key = block_keys(fp)
                    fp = np.tile(fp, 120)
                for k in range(0, len(key), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 100_000]) for x in (form, key, fp)], ["form", "key", "fp"])

    return fps.mapInArrow(run, "form long, key long, fp long")


def _verified(keyed: DataFrame, bits: int) -> DataFrame:
    """A spanning forest of the links within each key; keys are small here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["form", "key"]):
            form, key, fp = (table.column(c).to_numpy() for c in ("form", "key", "fp"))
            at = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (form[1:] != form[:-1])]))
            size = np.diff(np.append(at, len(key)))
            a, b = [], []
            for m in np.unique(size[size > 1]).tolist():
                rows = at[size == m]
                step = max(1, 2_000_000 // (m * m))
                left, right = np.triu_indices(m, 1)
                for k in range(0, len(rows), step):
                    group = fp[rows[k : k + step, None] + np.arange(m)]
                    g, p = np.nonzero(np.bitwise_count((group[:, left] ^ group[:, right]).view(np.uint64)) <= bits)
                    if m == 2:
                        a.append(group[g, 0])
                        b.append(group[g, 1])
                        continue
                    for one, pairs in zip(*_grouped(g, p)):
                        tree = np.array(forest(m, left[pairs].tolist(), right[pairs].tolist()))
                        a.append(group[one, tree[:, 0]])
                        b.append(group[one, tree[:, 1]])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return keyed.mapInArrow(run, "a long, b long")


def fingerprint_links(fps: DataFrame, *, bits: int = 2, crowded: int = 256) -> DataFrame:
    """a, b: links between distinct fingerprints that connect the same sets as all links of at most bits (2) bits do.

    Keys of more than crowded members go the exact way of block_keys; no key is dropped or cut.
    """
    if bits > 2:
        raise ValueError("the segments and blocks are made for two bits")
    keyed = materialize(_keyed(fps, "golay"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    sizes = materialize(sizes)
    few = keyed.join(sizes.filter(F.col("n") <= crowded).select("key"), "key").select("form", "key", "fp")
    n = fps.sparkSession.conf.get("spark.sql.shuffle.partitions")
    found = _verified(few.repartition(int(n), "form", "key").sortWithinPartitions("form", "key"), bits)
    dense = keyed.join(sizes.filter(F.col("n") > crowded).select("key"), "key", "left_semi").select("fp").distinct()
    more = _keyed(dense, "blocks").repartition(int(n), "form", "key").sortWithinPartitions("form", "key")
    return found.union(_verified(more, bits))


def _classes(df: DataFrame, id_col: str, text_col: str, bits: int, width: int) -> tuple[DataFrame, DataFrame]:
    """fingerprints() of df, and fp, first, component of each distinct fingerprint; both are written tables."""
    rows = materialize(fingerprints(df, id_col=id_col, text_col=text_col, width=width))
    groups = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    sets = components(fingerprint_links(groups.select("fp"), bits=bits))
    return rows, materialize(groups.join(sets.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp")))


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bits: int = 2, width: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable by links of at most bits bits.

    Every row of df gives a row: null and empty texts have fingerprint zero, repeated ids are rows of their own, and a
    null id stands in no component's minimum (its component_id is the others' smallest, or null).
    """
    rows, named = _classes(df, id_col, text_col, bits, width)
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = materialize(named.join(least, "component").select("fp", "component_id"))
    return rows.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bits: int = 2, width: int = 3) -> DataFrame:
    """df with one row of each component: that of the smallest id (null ids last), then of the smallest hash of the text.

    Of rows that repeat both id and text any one stays.
    """
    rows, named = _classes(df, id_col, text_col, bits, width)
    key = F.struct(F.col("doc_id").isNull(), "doc_id", "body")
    first = rows.groupBy("fp").agg(F.min(key).alias("key")).join(named.select("fp", "component"), "fp").groupBy("component").agg(F.min("key").alias("key"))
    kept = materialize(first.select(F.col("key.doc_id").alias("__id"), F.col("key.body").alias("__body")))
    own = df.withColumn("__hash", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    out = own.join(kept, F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__body")))
    return out.dropDuplicates(["__id", "__body"]).drop("__hash", "__id", "__body")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
