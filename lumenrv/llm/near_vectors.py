"""Near-duplicate vectors by Euclidean p-stable hashing.

A vector is normalised and projected on random directions; a projection, shifted by a random offset and divided by a width,
is rounded down, and some such numbers make the vector's bucket in one table. Vectors that share a bucket in any table are
compared by cosine in double precision. A link is counted in the first table in which its vectors meet, so that no table of
pairs is built: a cell of a bucket gives its members' numbers of links and a forest that connects the same sets.

Projections and tables follow from the number of vectors of the largest label (fitted_settings): so many projections that a
vector meets about one unrelated one in ten tables, and so many tables that two vectors at the threshold are missed with a
chance of one in a million, at any size. Only bucket numbers are shuffled for all tables; vectors go along where a bucket has
several members.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import materialize, whole_groups
from .components import components, smallest_reached


def same_cell(distance: float, width: float) -> float:
    """The chance that vectors at a distance fall into one cell of a random projection."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - math.sqrt(2 / math.pi) / r * (1 - math.exp(-r * r / 2))


def fitted_settings(vectors: int, cosine: float, miss: float = 1e-6, unrelated: float = 0.1) -> dict:
    """width, projections and tables for a number of vectors that are compared with each other.

    Unrelated unit vectors lie about the square root of 2 apart.
    """
    distance = math.sqrt(max(2 - 2 * cosine, 1e-4))
    width = 12 * distance
    near, far = same_cell(distance, width), same_cell(math.sqrt(2), width)
    projections = max(4, math.ceil(math.log(max(vectors, 1) / unrelated) / -math.log(far)))
    return {"width": width, "projections": projections, "tables": max(1, math.ceil(math.log(miss) / math.log1p(-(near**projections))))}


@cache
def _directions(dim: int, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Random directions, and offsets between 0 and 1."""
    rng = np.random.default_rng([seed, dim])
    return rng.standard_normal((dim, n)), rng.uniform(0, 1, n)


def bucket_keys(x: np.ndarray, label: np.ndarray, *, tables: int, projections: int, width: float, seed: int) -> np.ndarray:
    """One 64-bit bucket number for each unit vector (row) and table; labels are numbers."""
    directions, offsets = _directions(x.shape[1], tables * projections, seed)
    cells = np.floor(x @ directions / width + offsets).astype(np.int64).reshape(len(x), tables, projections)
    key = label.astype(np.int64).view(np.uint64)[:, None] ^ (np.arange(tables, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(x.shape[1]))
    for k in range(projections):
        key = (key ^ cells[:, :, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _unit(values: np.ndarray) -> np.ndarray:
    values = values.astype(np.float64)
    values = values / np.abs(values).max(axis=1)[:, None]  # so that squares neither overflow nor vanish
    return values / np.sqrt((values * values).sum(axis=1))[:, None]


def _rows(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    col = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _bucketed(rows: DataFrame, settings: dict) -> DataFrame:
    """key, node: a vector's bucket in every table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column("v").offsets.to_numpy())
            for dim in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == dim))
                for at in range(0, part.num_rows, 1000):
                    some = part.slice(at, 1000)
                    keys = bucket_keys(_unit(_rows(some.column("v"), dim)), some.column("mark").to_numpy(), **settings)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(some.column("node").to_numpy(), keys.shape[1]))], ["key", "node"])

    return rows.select("node", "mark", "v").mapInArrow(run, "key long, node long")


def _compared(cells: DataFrame, cosine: float, settings: dict) -> DataFrame:
    """node, links (others linked here for the first time, by number of copies), peer (the smallest node row of its set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["key", "i", "j"], 4000):
            node, n, block, key, i, j, mark = (table.column(c).to_numpy() for c in ("node", "n", "block", "key", "i", "j", "mark"))
            label, vectors = table.column("label").to_numpy(zero_copy_only=False), table.column("v").combine_chunks()
            sizes = np.diff(vectors.offsets.to_numpy())
            change = np.ones(len(node), bool)
            change[1:] = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            starts = np.flatnonzero(change)
            ends = np.append(starts[1:], len(node))
            look = _worth(vectors, sizes, starts, ends, cosine)
            for s, e in zip(starts[look].tolist(), ends[look].tolist()):
                # numbers of buckets may be equal by chance: labels and lengths are compared as well
                kinds = set(zip(label[s:e].tolist(), sizes[s:e].tolist()))
                for kind in kinds:
                    mine = np.arange(s, e) if len(kinds) == 1 else s + np.flatnonzero((label[s:e] == kind[0]) & (sizes[s:e] == kind[1]))
                    if len(mine) > 1 and (found := _cell(_rows(vectors.take(pa.array(mine)), kind[1]), mark[mine], node[mine], n[mine], block[mine], key[s], i[s], j[s], cosine, settings)):
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["node", "links", "peer"])

    return cells.mapInArrow(run, "node long, links long, peer long")


def _worth(vectors: pa.ListArray, sizes: np.ndarray, starts: np.ndarray, ends: np.ndarray, cosine: float, most: int = 16) -> np.ndarray:
    """Which cells need a closer look: small ones of equal lengths are compared many at a time, most of them hold no link."""
    look = ends - starts > 1
    first = np.cumsum(sizes) - sizes
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    even = np.minimum.reduceat(sizes, starts) == np.maximum.reduceat(sizes, starts)
    for m in range(2, most + 1):
        for dim in np.unique(sizes[starts[(ends - starts == m) & even]]).tolist():
            mine = np.flatnonzero((ends - starts == m) & even & (sizes[starts] == dim))
            step = max(1, 2_000_000 // (m * dim))
            for at in range(0, len(mine), step):
                some = mine[at : at + step]
                rows = starts[some][:, None] + np.arange(m)
                x = _unit(flat[first[rows][:, :, None] + np.arange(dim)].reshape(-1, dim)).reshape(-1, m, dim)
                near = np.matmul(x, x.transpose(0, 2, 1)) >= cosine - 1e-9
                look[some] = (near.sum(axis=(1, 2)) > m) | (m != near[:, np.arange(m), np.arange(m)].sum(axis=1))
    return look


def _cell(v: np.ndarray, mark: np.ndarray, node: np.ndarray, n: np.ndarray, block: np.ndarray, key: int, i: int, j: int, cosine: float, settings: dict) -> tuple | None:
    """The linked members of a cell, how many they link with for the first time, and the smallest row of their sets."""
    x = _unit(v)
    one = np.arange(len(x)) if i == j else np.flatnonzero(block == i)
    two = one if i == j else np.flatnonzero(block == j)
    degree, left, right, held, table = np.zeros(len(x), np.int64), [], [], None, 0
    for at in range(0, len(one), 1024):
        p, q = np.nonzero(x[one[at : at + 1024]] @ x[two].T >= cosine)
        p, q = one[at : at + 1024][p], two[q]
        if i == j:
            p, q = p[p < q], q[p < q]
        for lo in range(0, len(p), 200_000):
            a, b = p[lo : lo + 200_000], q[lo : lo + 200_000]
            if held is None:
                held = bucket_keys(x, mark, **settings)
                table = int((held == key).any(axis=0).argmax())
            fresh = ~(held[a, :table] == held[b, :table]).any(axis=1)
            a, b = a[fresh], b[fresh]
            np.add.at(degree, a, n[b])
            np.add.at(degree, b, n[a])
            left.append(a)
            right.append(b)
    if not degree.any():
        return None
    tree = dict(smallest_reached(len(x), np.concatenate(left), np.concatenate(right)))
    rows = np.flatnonzero(degree)
    return node[rows], degree[rows], np.array([node[tree.get(r, r)] for r in rows.tolist()])


def near_vectors(
    df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.98,
    settings: dict | None = None, block: int = 2048, seed: int = 7,
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row: vectors of equal, non-null labels link at the cosine or more.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing: n_links is 0 and the row
    is its own component; so do rows with a null label or a null id. Vectors of other lengths never link. Equal vectors of
    a label are hashed once and link with each other. A bucket of more than block members is dealt out as pairs of blocks.
    settings (tables, projections, width) replace fitted_settings.
    """
    kind = "float" if isinstance(getattr(df.schema[vector_col].dataType, "elementType", None), FloatType) else "double"
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast(f"array<{kind}>").alias("v"))
    sound = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("v", F.when(sound, F.transform("v", lambda x: x + F.lit(0).cast(kind))))  # one kind of zero
    good = materialize(rows.withColumns({"h1": F.when(F.col("v").isNotNull(), F.xxhash64("v")), "h2": F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(seed), "v"))}))
    copies = good.filter("v is not null").groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"), F.first("v").alias("v"))
    distinct = materialize(copies.withColumns({"node": F.monotonically_increasing_id(), "mark": F.xxhash64("label")}))
    if settings is None:
        most = distinct.groupBy("label").agg(F.count("*").alias("m")).agg(F.max("m")).first()[0]
        settings = fitted_settings(most or 0, cosine)
    settings = {**settings, "seed": seed}
    where = _bucketed(distinct, settings)
    sizes = materialize(where.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1").select("key", F.ceil(F.col("m") / block).cast("int").alias("blocks")))
    met = where.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", "node", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    cell = ["key", "i", "j"]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = dealt.join(distinct.select("node", "label", "mark", "n", "v"), "node").repartition(parts, *cell).sortWithinPartitions(*cell)
    found = materialize(_compared(cells, cosine, settings))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    sets = components(found.select(F.col("node").alias("a"), F.col("peer").alias("b")))
    same = ["label", "h1", "h2"]
    nodes = distinct.drop("v").join(links, "node", "left").join(sets, "node", "left").withColumn("component", F.coalesce("component", "node"))
    nodes = nodes.join(nodes.groupBy("component").agg(F.min("first").alias("component_id")), "component")
    nodes = nodes.select(*same, (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = good.select("vec_id", *same).join(nodes, same, "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP3_SQL = """
WITH RECURSIVE unit AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, least(e.vec_id, coalesce(m.b, e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(m.b, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN least m ON m.a = e.vec_id LEFT JOIN counts c ON c.a = e.vec_id
"""
