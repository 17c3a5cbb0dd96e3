"""Quality of documents: a regularised quadratic discriminant over statistics of their texts.

Each text gives a row of transformed statistics: square roots of shares (capitals, digits, marks, repeated words, pairs and
lines) and logarithms of sizes. The labelled rows of each class give counts, sums and sums of products, added up by Spark; from
these come means and covariances. A class covariance is drawn towards the pooled one, the more the fewer rows it has, and
then towards its mean variance by the oracle approximating shrinkage. A score is the chance of class 1: prior odds times the
ratio of two Gaussian densities, whose Mahalanobis distances come from Cholesky factors that are worked out once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, materialize
from .words import Hasher, code_points, text_starts

STATISTICS = (
    "log words", "log mean word length", "log deviation of word lengths", "log longest word", "log words a line", "capitals", "digits", "stops", "other marks", "beyond ASCII",
    "words without letters", "words that end in other marks", "words of capitals", "words of three letters or fewer", "words with a capital first", "repeated words",
    "words equal to the one before", "words equal to the one before that", "repeated pairs", "repeated lines",
)
BLANK, SMALL, CAPITAL, DIGIT, STOP, MARK = range(6)
#: Shares are of so many words or characters more than there are, so that a single one weighs little in a short text.
FEW_WORDS, FEW_CHARS = 8, 40


@cache
def _kinds() -> np.ndarray:
    """Kind of every code point."""

    def kind(c: str) -> int:
        return BLANK if c.isspace() else CAPITAL if c.isupper() else SMALL if c.isalpha() else DIGIT if c.isdigit() else STOP if c in ".,;:?'\"-()" else MARK

    return np.fromiter((kind(chr(c)) for c in range(0x110000)), np.uint8, 0x110000)


def _repeated(keys: np.ndarray) -> np.ndarray:
    return pd.Series(keys).duplicated().to_numpy()


def statistics(batch: list[str]) -> np.ndarray:
    """A row of STATISTICS for each text; a text without words has zeros."""
    n, out = len(batch), np.zeros((len(batch), len(STATISTICS)))
    joined, borders = "".join(batch), text_starts(batch)
    points = code_points(joined)
    if not len(points):
        return out
    kind = _kinds()[points]
    doc = np.repeat(np.arange(n), np.diff(borders))
    cut = np.zeros(len(points) + 1, bool)
    cut[borders] = True
    inside = np.concatenate([[False], kind != BLANK, [False]])
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    if not len(starts):
        return out
    per = lambda at, w=None: np.bincount(at, w, n)
    of = doc[starts]
    words = per(of)
    has = np.maximum(words, 1)
    length = (ends - starts).astype(float)
    mean = per(of, length) / has
    done = np.stack([np.append(0, np.cumsum(kind == k)) for k in (CAPITAL, SMALL, MARK)])
    capitals, small, _ = done[:, ends] - done[:, starts]
    hasher = Hasher()
    mixed = np.uint64(0x9E3779B97F4A7C15)
    salt = of.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    keys = hasher.slices(points, starts, ends)
    same = of[1:] == of[:-1]
    pairs = (keys[:-1] * mixed + keys[1:] + salt[1:])[same]
    lines_at = np.unique(np.concatenate([borders[:-1], np.flatnonzero(points == 10) + 1]))
    lines_end = np.append(lines_at[1:], len(points))
    full = (np.searchsorted(starts, lines_end) - np.searchsorted(starts, lines_at)) > 0  # lines with words
    lines_at, lines_end = lines_at[full], lines_end[full]
    line_of = doc[lines_at]
    lines_end = lines_end - (points[lines_end - 1] == 10)
    lines = np.maximum(per(line_of), 1)
    line_keys = hasher.slices(points, lines_at, lines_end) + line_of.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    longest = np.zeros(n)
    np.maximum.at(longest, of, length)
    more, chars = has + FEW_WORDS, per(of, length) + FEW_CHARS
    back = lambda k: per(of[k:], ((keys[k:] == keys[:-k]) & (of[k:] == of[:-k])).astype(float)) / more
    share = lambda flags: per(of, flags.astype(float)) / more
    kinds = lambda k: per(doc[kind == k]) / chars
    columns = (
        np.log1p(words), np.log1p(mean), np.log1p(np.sqrt(np.maximum(per(of, length * length) / has - mean * mean, 0))), np.log1p(longest), np.log1p(words / lines),
        *(np.sqrt(x) for x in (
            kinds(CAPITAL), kinds(DIGIT), kinds(STOP), kinds(MARK), per(doc[points > 127]) / chars,
            share(capitals + small == 0), share(kind[ends - 1] == MARK), share((capitals > 1) & (small == 0)), share(length <= 3), share(kind[starts] == CAPITAL),
            share(_repeated(keys + salt)), back(1), back(2), per(of[1:][same], _repeated(pairs).astype(float)) / more, per(line_of, _repeated(line_keys).astype(float)) / lines,
        )),
    )
    return np.where((words > 0)[:, None], np.stack(columns, axis=1), 0.0)


@dataclass(frozen=True)
class Gaussian:
    """A class: log of its prior, mean, and the inverse of its covariance's Cholesky factor with half the log determinant."""

    prior: float
    mean: np.ndarray
    inverse: np.ndarray
    half_log_det: float

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) @ self.inverse.T
        return self.prior - self.half_log_det - 0.5 * (z * z).sum(axis=1)


def shrunk(covariance: np.ndarray, n: float) -> np.ndarray:
    """Drawn towards its mean variance by the oracle approximating shrinkage for Gaussian rows."""
    p = len(covariance)
    trace, square = np.trace(covariance), (covariance * covariance).sum()
    below = (n + 1 - 2 / p) * (square - trace * trace / p)
    rho = 1.0 if below <= 0 else min(1.0, ((1 - 2 / p) * square + trace * trace) / below)
    return (1 - rho) * covariance + rho * trace / p * np.eye(p)


def fit(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], *, own_rows: float = 10.0, floor: float = 1e-3) -> tuple[np.ndarray, dict[int, Gaussian]]:
    """Scales of the statistics and the classes, from count, sums and sums of products of each class.

    A class's own covariance counts by its rows, the pooled one by own_rows a statistic; floor is added to each variance.
    """
    p = len(STATISTICS)
    n = {c: s[0] for c, s in sums.items()}
    mean = {c: s[1] / s[0] for c, s in sums.items()}
    scatter = {c: s[2] - s[0] * np.outer(mean[c], mean[c]) for c, s in sums.items()}
    pooled = sum(scatter.values()) / max(sum(n.values()) - len(n), 1) + 1e-6 * np.eye(p)
    scale = np.sqrt(np.diag(pooled))
    pooled = pooled / np.outer(scale, scale)
    classes = {}
    for c in sums:
        own = scatter[c] / np.outer(scale, scale)
        mix = (own + own_rows * p * pooled) / (n[c] + own_rows * p)
        factor = np.linalg.cholesky(shrunk(mix, n[c] + own_rows * p) + floor * np.eye(p))
        classes[c] = Gaussian(np.log(n[c] / sum(n.values())), mean[c] / scale, np.linalg.inv(factor), float(np.log(np.diag(factor)).sum()))
    return scale, classes


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def class_sums(rows: DataFrame, label: str, stats: str) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sums and sums of products of the statistics of each class: 2 * (1 + p + p * p) numbers reach the driver."""
    p = len(STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + p + p * p))
        for batch in batches:
            if batch.num_rows:
                y = batch.column(0).to_numpy(zero_copy_only=False)
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
                for c in (0, 1):
                    part = x[y == c]
                    total[c] += np.concatenate([[len(part)], part.sum(axis=0), (part.T @ part).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["c", "s"])

    parts = rows.select(F.col(label).cast("int"), stats).mapInArrow(run, "c int, s array<double>")
    found: dict[int, np.ndarray] = {}
    for r in parts.select("c", F.posexplode("s").alias("i", "x")).groupBy("c", "i").agg(F.sum("x").alias("x")).collect():
        found.setdefault(r.c, np.zeros(1 + p + p * p))[r.i] = r.x
    return {c: (s[0], s[1 : 1 + p], s[1 + p :].reshape(p, p)) for c, s in found.items() if s[0] > 0}


def score_quality(
    df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, slice_bytes: int = 2 << 20,
) -> DataFrame:
    """id, held_out, score, predicted (1 at threshold or more) and statistics of every row of df; other columns go.

    labels has doc_id and quality; of an id labelled more than once the mean decides, null labels and ids do not count, and ids
    whose crc32 modulo 4 is 2 teach nothing. Every other labelled row teaches, without a sample. Null and empty texts have
    statistics of zero and a score like any other; repeated ids keep their rows. If only one class is labelled, or none,
    all scores are the smoothed share of class 1. Whole texts are read once: their statistics are written and read again.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            parts = [statistics(b.column("text").to_pylist()) for b in byte_slices(pa.RecordBatch.from_arrays([column], ["text"]), "text", slice_bytes)]
            flat = np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * len(STATISTICS)), pa.array(flat.ravel()))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    stats = F.arrow_udf(run, "array<double>")(F.coalesce(F.col(text_col), F.lit("")))
    known = materialize(df.select(F.col(id_col).alias(id_col), stats.alias("statistics")))

    voted = labels.filter("quality is not null and doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg((F.avg("quality") >= 0.5).cast("int").alias("__label"))
    sums = class_sums(known.join(voted.filter(~held_out(F.col("__id"))), F.col(id_col) == F.col("__id")), "__label", "statistics")
    if len(sums) == 2:
        fitted = df.sparkSession.sparkContext.broadcast(fit(sums))  # some thousand numbers

        @F.arrow_udf("double")
        def score(column: pa.Array) -> pa.Array:
            scale, classes = fitted.value
            x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS)) / scale
            return pa.array(1 / (1 + np.exp(-np.clip(classes[1].log_density(x) - classes[0].log_density(x), -500, 500))))

        scored = known.withColumn("score", score("statistics"))
    else:
        n = {c: s[0] for c, s in sums.items()}
        scored = known.withColumn("score", F.lit((n.get(1, 0) + 1.0) / (sum(n.values()) + 2.0)))
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "statistics")


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")).drop("statistics")
