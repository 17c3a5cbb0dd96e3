"""Near copies: by SimHash fingerprints through Golay codewords, and by the Jaccard similarity of word shingles beside them.

Texts whose fingerprints differ in two bits or fewer are linked as simhash.fingerprint_links finds them. A 64-bit SimHash cannot
serve alone here: at a similarity of 0.8 fingerprints differ in about ten bits of 64, give or take three, and a radius that
holds them all leaves segments of two or three bits. So minimum hashes add candidates, whose whole sets decide; both kinds of
links make the components together. 32 bands of four minimum hashes miss a pair of
similarity 0.8 with a chance of (1 - 0.8^4)^32, about 5 in 100 million, and closer pairs less often.

Of a band's bucket only the connections matter. Its members are first held against one member (that which shares most
buckets), then against another one where they are not yet connected. Where they still are not, each is held against each: in
buckets of FEW members as pairs, in larger ones inside of cells, which are pairs of the bucket's blocks and give a forest of
the links that they find. So no bucket is cut, and no table of all pairs of a large one is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, materialize, texts, tidied, whole_groups
from .components import components, smallest_reached
from .simhash import fingerprint, fingerprint_links

#: Bands, minimum hashes in each, and the seed of the shingles' hashes and of the multipliers.
BANDS, ROWS = 32, 4
SEED = 42
#: Members of a bucket that is compared as pairs at most, and about how many shingles a block of a larger one holds.
FEW, BLOCK = 32, 250_000
_RANDOM = np.random.default_rng(SEED)
FACTORS = _RANDOM.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _RANDOM.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64)
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(raw: bytes, width: int) -> np.ndarray:
    """Distinct hashes of the word shingles of UTF-8 text in order; a text of fewer words is one shingle."""
    words = raw.lower().split()
    if len(words) < width:
        words, width = [b" ".join(words)], 1
    grams = map(b" ".join, zip(*(words[k:] for k in range(width))))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64, len(words) - width + 1))


def band_keys(held: np.ndarray, chunk: int = 2048) -> np.ndarray:
    """A key for each band of the minimum hashes of a set."""
    least = np.full(BANDS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(held), chunk):
        least = np.minimum(least, (held[None, at : at + chunk] * FACTORS + SHIFTS).min(axis=1))
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        key = (key ^ row) * MIX
        key ^= key >> np.uint64(29)
    return key


def _sketches(df: DataFrame, width: int) -> DataFrame:
    """doc_id, body, fp (fingerprint), node (hash of the set of shingles), n (its size) and keys of its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text", 8 << 20):
                fp, node, n, keys = [], [], [], []
                for x in part.column("text"):
                    raw = x.as_buffer().to_pybytes()
                    fp.append(fingerprint(raw, width))
                    held = shingle_set(raw, width)
                    node.append(xxhash.xxh3_64_intdigest(held.tobytes()))
                    n.append(len(held))
                    keys.append(band_keys(held).view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), pa.array(np.concatenate(keys)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("body"), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(n, pa.int64()), lists], ["doc_id", "body", "fp", "node", "n", "keys"])

    return df.mapInArrow(tidied(run), "doc_id long, body long, fp long, node long, n long, keys array<long>")


def _sets(df: DataFrame, width: int) -> DataFrame:
    """node and its whole set, for texts that come with their node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text", 8 << 20):
                held = [shingle_set(x.as_buffer().to_pybytes(), width).view(np.int64) for x in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(held, pa.list_(pa.int64()))], ["node", "held"])

    return df.select("node", "text").mapInArrow(tidied(run), "node long, held array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b of which the sets' Jaccard similarity is percent or more, in whole numbers."""
    pairs = materialize(pairs)  # read anew, so that a member of many pairs can be split
    one, two = (sets.select(F.col("node").alias(c), F.col("held").alias(f"of_{c}")) for c in ("a", "b"))
    both = pairs.join(one, "a").join(two, "b")
    both = both.select("a", "b", (F.size("of_a") + F.size("of_b")).cast("long").alias("n"), F.size(F.array_intersect("of_a", "of_b")).cast("long").alias("common"))
    return materialize(both.filter((100 + percent) * F.col("common") >= percent * F.col("n")).select("a", "b"))


def _unsettled(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members of the buckets that links do not yet connect, with their component."""
    named = materialize(members.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node")))
    open_keys = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key")
    return materialize(named.join(open_keys, "key"))


def _fitting(pairs: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs whose sizes allow the similarity."""
    fits = F.least("n", "other_n") * 100 >= percent * F.greatest("n", "other_n")
    return pairs.filter(fits).select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct()


def _against_one(members: DataFrame, order: Column, apart: bool, percent: int) -> DataFrame:
    """Pairs of each member with the member of its bucket that comes first in order, where they are not of one component."""
    firsts = members.groupBy("key").agg(F.min_by(F.struct(F.col("node").alias("other"), F.col("n").alias("other_n"), *([F.col("component").alias("other_component")] if apart else [])), order).alias("f"))
    pairs = members.join(firsts.select("key", "f.*"), "key")
    return _fitting(pairs.filter("component <> other_component" if apart else "node <> other"), percent)


def common_counts(held: list[np.ndarray], rows: np.ndarray, chunk: int = 4096) -> np.ndarray:
    """How many hashes each of some sets (rows) has in common with every set."""
    of, flat = np.repeat(np.arange(len(held)), [len(x) for x in held]), np.concatenate(held)
    order = np.argsort(flat, kind="stable")
    of, flat = of[order], flat[order]
    starts = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    sizes = np.diff(np.append(starts, len(flat)))
    column = np.repeat(np.cumsum(sizes > 1) - 1, sizes)  # hashes of one set alone are left out
    inside = np.repeat(sizes > 1, sizes)
    of, column = of[inside], column[inside]
    out = np.zeros((len(rows), len(held)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, chunk):
        a, b = np.searchsorted(column, (at, at + chunk))
        there = np.zeros((len(held), chunk), np.float32)
        there[of[a:b], column[a:b] - at] = 1
        out += there[rows] @ there.T
    return out


def cell_links(held: list[np.ndarray], component: np.ndarray, keys: np.ndarray, band: int, side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A forest (each member with the smallest that it reaches) of the links between a cell's members of different components that meet in no earlier band."""
    names, sizes = np.unique(component, return_counts=True)
    rows = np.flatnonzero(component != names[sizes.argmax()])  # each pair has one outside the largest component
    left, right = [], []
    for at in range(0, len(rows), 512):
        some = rows[at : at + 512]
        n = np.fromiter(map(len, held), np.int64, len(held))
        common = common_counts(held, some).astype(np.int64)
        found = (100 + percent) * common >= percent * (n[some][:, None] + n[None, :])
        found &= (component[some][:, None] != component[None, :]) & (side[some][:, None] | side[None, :] == 3)
        p, q = np.nonzero(found)
        fresh = ~(keys[some[p], :band] == keys[q, :band]).any(axis=1)
        left.append(some[p[fresh]])
        right.append(q[fresh])
    return smallest_reached(len(held), np.concatenate(left), np.concatenate(right)) if left else []


def _in_cells(members: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: links inside of large buckets; each pair is judged in the first large bucket in which it meets."""
    sizes = members.groupBy("key").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", "node", "component", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    wanted = materialize(sets.join(members.select("node").distinct(), "node").join(nodes.select("node", "keys"), "node"))
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cell = ["key", "i", "j"]
    cells = materialize(dealt).join(wanted, "node").repartition(parts, *cell).sortWithinPartitions(*cell)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups((x for b in batches for x in _row_slices(b, "held")), cell, 1):
            key, i, j, node, component, block = (table.column(c).to_numpy() for c in (*cell, "node", "component", "block"))
            starts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
            held, keys = table.column("held").combine_chunks(), table.column("keys").combine_chunks()
            for s, e in zip(starts.tolist(), np.append(starts[1:], len(node)).tolist()):
                if len(set(component[s:e].tolist())) > 1:
                    sets_ = [held[k].values.to_numpy() for k in range(s, e)]
                    bands = keys.slice(s, e - s).flatten().to_numpy().reshape(e - s, BANDS)
                    side = np.full(e - s, 3) if i[s] == j[s] else np.where(block[s:e] == i[s], 1, 2)
                    tree = np.array(cell_links(sets_, component[s:e], bands, int((bands == key[s]).any(axis=0).argmax()), side, percent), np.int64).reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays([pa.array(node[s:e][tree[:, k]]) for k in (0, 1)], ["a", "b"])

    return materialize(cells.mapInArrow(tidied(run), "a long, b long"))


def copy_links(nodes: DataFrame, sets_of, percent: int) -> DataFrame:
    """a, b: links that connect the same sets as all pairs of a common bucket that are similar enough do."""
    keyed = materialize(nodes.select("node", "n", F.explode("keys").alias("key")))
    shared = materialize(keyed.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1").select("key"))
    members = materialize(keyed.join(shared, "key"))
    met = members.groupBy("node").agg(F.count("*").alias("met"))
    sets = materialize(sets_of(members.select("node").distinct()))
    links = _verified(_against_one(members.join(met, "node"), F.struct(-F.col("met"), "node"), False, percent), sets, percent)
    left = _unsettled(members, links)
    links = materialize(links.union(_verified(_against_one(left, F.xxhash64("node", "key"), True, percent), sets, percent)))
    left = _unsettled(members.join(left.select("key").distinct(), "key"), links)
    size = materialize(left.groupBy("key").agg(F.count("*").alias("m")))
    small = left.join(size.filter(F.col("m") <= FEW), "key")
    other = small.select("key", F.col("node").alias("other"), F.col("n").alias("other_n"), F.col("component").alias("other_component"))
    pairs = small.join(other, "key").filter("node > other AND component <> other_component")
    large = materialize(left.join(size.filter(F.col("m") > FEW).select("key"), "key"))
    return links.union(_verified(_fitting(pairs, percent), sets, percent)).union(_in_cells(large, nodes, sets, percent))


def simhash_links(rows: DataFrame, bits: int) -> DataFrame:
    """a, b: links between the nodes of rows (node, fp) whose fingerprints are connected by differences of at most bits bits."""
    held = materialize(rows.select("node", "fp").distinct())
    sets = components(fingerprint_links(held.select("fp").distinct(), bits=bits)).withColumnRenamed("node", "fp")
    named = held.join(sets, "fp", "left").withColumn("class", F.coalesce("component", "fp"))
    least = named.groupBy("class").agg(F.min("node").alias("b"))
    return materialize(named.join(least, "class").filter("node <> b").select(F.col("node").alias("a"), "b").distinct())


def _row_slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about limit elements of one list column each, one row at least."""
    ends = np.cumsum(np.diff(batch.column(column).offsets.to_numpy()))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit)))
        yield batch.slice(at, to - at)
        at = to


def drop_near_copies(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, width: int = 5, bits: int = 2) -> DataFrame:
    """df with one row of each component: that of the smallest id (null ids last), then of the smallest hash of the text.

    Texts are linked where the fingerprints of their shingles of width words differ in bits bits or fewer, and where the Jaccard
    similarity of these shingles is percent or more. Of rows that repeat both id and text any one stays.
    """
    every = texts(df, id_col, text_col).withColumn("body", F.xxhash64("text"))
    rows = materialize(_sketches(every, width))
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "body")
    nodes = materialize(rows.groupBy("node").agg(F.min(key).alias("key"), F.first("n").alias("n"), F.first("keys").alias("keys")))

    def sets_of(wanted: DataFrame) -> DataFrame:
        holders = nodes.join(wanted, "node", "left_semi").select("node", F.col("key.doc_id").alias("__id"), F.col("key.body").alias("__body"))
        found = every.join(holders, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("body") == F.col("__body")))
        return _sets(found.dropDuplicates(["node"]), width)

    links = simhash_links(rows, bits).union(copy_links(nodes, sets_of, percent))
    named = nodes.join(components(links), "node", "left")
    first = named.groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("key").alias("key"))
    kept = materialize(first.select(F.col("key.doc_id").alias("__id"), F.col("key.body").alias("__body")))
    own = df.withColumn("__hash", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    out = own.join(kept, F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__body")))
    return out.dropDuplicates(["__id", "__body"]).drop("__hash", "__id", "__body")
