"""Line dedup by pairwise alignment: overlapping documents are found by rare lines they share and aligned by patience diff.

Lines are compared without the white space at their ends; blank ones do not count. A block is a run of such lines, of
min_words words or more, that a later and an earlier document both hold. Only documents that may share a block are paired:

* Texts of equal lines are one class; all but its first member are copies as a whole.
* In each first member the runs of lines that other documents hold too, of min_words words or more, are kept in view.
  Documents that share a rare line there (of RARE holders at most) are paired, each with each earlier one.
* Runs of common lines alone take the exact way: every shortest window of lines with min_words words is hashed, and each
  of its holders is paired with its first holder, so that a passage of any number of holders gives one pair a holder.

Each pair is aligned: patience diff over the lines in view, again over what a pass leaves (passages that were moved or
repeated), and at last a check of the windows with lines still left, for which no line is unique. Aligned blocks of the later
document go. A line goes if, and only if, it lies in a block.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, let, materialize, tidied

#: Most holders of a rare line, and about how many pairs of one earlier document go to one group.
RARE, DEALT = 8, 200
LINED = "id long, body long, hi long, lo long, total long, hashes binary, words array<int>, raw array<int>"
KEY = "key struct<known: boolean, id: long, body: long>"
INT_LIST = pa.list_(pa.int32())


def windows(words: list[int], min_words: int) -> set[tuple[int, int]]:
    """Start and end of the shortest windows of min_words words or more, from each line on and up to each line."""
    out, total, start = set(), 0, 0
    for end, n in enumerate(words, 1):  # up to each line
        total += n
        while total - words[start] >= min_words:
            total -= words[start]
            start += 1
        if total >= min_words:
            out.add((start, end))
    total, end = 0, len(words)
    for start in range(len(words) - 1, -1, -1):  # from each line on
        total += words[start]
        while total - words[end - 1] >= min_words:
            end -= 1
            total -= words[end]
        if total >= min_words:
            out.add((start, end))
    return out


def stretches(inside: list[bool], words: list[int], min_words: int) -> list[tuple[int, int]]:
    """Start and end of the runs of lines inside that have min_words words or more."""
    out, start, total = [], 0, 0
    for i, x in enumerate([*inside, False]):
        if x:
            total += words[i]
        else:
            if total >= min_words:
                out.append((start, i))
            start, total = i + 1, 0
    return out


def _lines(raw: bytes) -> list[bytes]:
    return [raw[k : k + 16] for k in range(0, len(raw), 16)]


def _halves(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


class Earlier:
    """The earlier document of some pairs: hashes of its lines, their places, and its windows."""

    def __init__(self, hashes: bytes, words: list[int], min_words: int):
        self.raw, self.words, self.min_words = hashes, words, min_words
        self.lines = _lines(hashes)
        self.places: dict[bytes, list[int]] = {}
        for i, x in enumerate(self.lines):
            self.places.setdefault(x, []).append(i)
        self._windows: set[bytes] | None = None

    def only(self, line: bytes, start: int, end: int) -> int | None:
        """The place of a line that stands once between start and end."""
        at = self.places.get(line)
        if at is None:
            return None
        k = bisect_left(at, start)
        return at[k] if k < len(at) and at[k] < end and (k + 1 == len(at) or at[k + 1] >= end) else None

    def holds(self, window: bytes) -> bool:
        """Whether one of the shortest windows has these lines."""
        if self._windows is None:
            self._windows = {self.raw[16 * s : 16 * e] for s, e in windows(self.words, self.min_words)}
        return window in self._windows


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest rising choice of pairs that rise in their first number."""
    tops: list[int] = []
    top_at: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        before.append(top_at[pile - 1] if pile else -1)
        tops[pile : pile + 1], top_at[pile : pile + 1] = [j], [k]
    out, k = [], top_at[-1] if top_at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def patience(later: list[bytes], start: int, end: int, earlier: Earlier) -> list[tuple[int, int]]:
    """Patience diff of some lines of the later document with the earlier one: matched places, rising in both."""
    out, todo, b = [], [(start, end, 0, len(earlier.lines))], earlier.lines
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and later[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and later[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        seen: dict[bytes, int | None] = {}
        for i in range(a0, a1):
            seen[later[i]] = None if later[i] in seen else i
        anchors = rising([(i, j) for x, i in seen.items() if i is not None and (j := earlier.only(x, b0, b1)) is not None])
        if anchors:
            for i, j in anchors:
                todo.append((a0, i, b0, j))
                out.append((i, j))
                a0, b0 = i + 1, j + 1
            todo.append((a0, a1, b0, b1))
    return sorted(out)


def aligned_lines(later: list[bytes], words: list[int], earlier: Earlier) -> set[int]:
    """Places of the later document's lines that lie in blocks which the earlier one holds."""
    least, gone = earlier.min_words, set()
    in_view = stretches([x in earlier.places for x in later], words, least)
    todo = list(in_view)
    while todo:
        start, end = todo.pop()
        matched = patience(later, start, end, earlier)
        found, k = set(), 0
        for m in range(1, len(matched) + 1):  # runs on one diagonal
            if m == len(matched) or matched[m][0] != matched[m - 1][0] + 1 or matched[m][1] != matched[m - 1][1] + 1:
                i, n = matched[k][0], m - k
                if sum(words[i : i + n]) >= least:
                    found.update(range(i, i + n))
                k = m
        if found:
            gone |= found
            todo.extend((start + s, start + e) for s, e in stretches([i not in found for i in range(start, end)], words[start:end], least))
    for start, end in in_view:
        if any(i not in gone for i in range(start, end)):
            for s, e in windows(words[start:end], least):
                place = range(start + s, start + e)
                if any(i not in gone for i in place) and earlier.holds(b"".join(later[start + s : start + e])):
                    gone.update(place)
    return gone


def split_lines(rows: DataFrame) -> DataFrame:
    """LINED of every text: hash of all its lines that are not blank, and their hashes, words and places among all lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text", 2 << 20):
                hi, lo, total, hashes, words, raws = [], [], [], [], [], []
                for text in part.column("text"):
                    held = [(raw, line) for raw, x in enumerate(text.as_buffer().to_pybytes().split(b"\n")) if (line := x.strip())]
                    hashes.append(b"".join(xxhash.xxh3_128_digest(line) for _, line in held))
                    words.append([len(line.split()) for _, line in held])
                    raws.append([raw for raw, _ in held])
                    total.append(sum(words[-1]))
                    a, b = _halves(xxhash.xxh3_128_digest(hashes[-1]))
                    hi.append(a)
                    lo.append(b)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("body"), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(total, pa.int64()), pa.array(hashes, pa.binary()), pa.array(words, INT_LIST), pa.array(raws, INT_LIST)],
                    ["id", "body", "hi", "lo", "total", "hashes", "words", "raw"])

    return rows.mapInArrow(tidied(run), LINED)


def _held_lines(reps: DataFrame) -> DataFrame:
    """h (64 bits of its hash), doc: the distinct lines of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "hashes", 2 << 20):
                held = [np.unique(np.frombuffer(x.as_buffer(), "<i8")[::2]) for x in part.column("hashes")]
                doc = np.repeat(part.column("doc").to_numpy(), [len(x) for x in held])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held)), pa.array(doc)], ["h", "doc"])

    return reps.select("doc", "hashes").mapInArrow(tidied(run), "h long, doc long")


def _marks(rows: DataFrame, min_words: int) -> DataFrame:
    """For the lines in view: doc and its key, and the hash of each rare line (lines 1) or window of common lines (their number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "hashes", 2 << 20):
                row, hi, lo, lines = [], [], [], []
                for d, (raw, words, h, n) in enumerate(zip(*(part.column(c).to_pylist() for c in ("hashes", "words", "h", "n")))):
                    holders = dict(zip(h, n))
                    of = [holders.get(x, 1) for x in np.frombuffer(raw, "<i8")[::2].tolist()]
                    seen = set()
                    for s, e in stretches([x > 1 for x in of], words, min_words):
                        for i in range(s, e):
                            if of[i] <= RARE:
                                seen.add((*_halves(raw[16 * i : 16 * i + 16]), 1))
                        for a, b in stretches([x > RARE for x in of[s:e]], words[s:e], min_words):
                            for x, y in windows(words[s + a : s + b], min_words):
                                seen.add((*_halves(xxhash.xxh3_128_digest(raw[16 * (s + a + x) : 16 * (s + a + y)])), -(y - x)))
                    for a, b, k in seen:
                        row.append(d)
                        hi.append(a)
                        lo.append(b)
                        lines.append(k)
                of_row = [part.column(c).take(pa.array(row, pa.int32())) for c in ("doc", "key")]
                yield pa.RecordBatch.from_arrays([*of_row, pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(lines, pa.int32())], ["doc", "key", "hi", "lo", "lines"])

    return rows.mapInArrow(tidied(run), f"doc long, {KEY}, hi long, lo long, lines int")


def _pairs(reps: DataFrame, min_words: int) -> DataFrame:
    """later, earlier: the documents (doc) that may share a block, each window's holders with its first one."""
    lines = _held_lines(reps)
    shared = materialize(lines.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"))
    in_docs = lines.join(shared, "h").groupBy("doc").agg(F.collect_list(F.struct("h", "n")).alias("held"))
    rows = reps.select("doc", "key", "hashes", "words").join(in_docs, "doc").select("doc", "key", "hashes", "words", F.col("held.h").alias("h"), F.col("held.n").alias("n"))
    marks = materialize(_marks(rows, min_words))
    holder = F.struct("key", "doc")
    rare = marks.filter("lines = 1").groupBy("hi", "lo").agg(F.array_sort(F.collect_list(holder)).alias("held")).filter("size(held) > 1")  # RARE at most
    rare = rare.select("held", F.explode(F.sequence(F.lit(2), F.size("held"))).alias("i"))
    rare = rare.select(F.element_at("held", F.col("i"))["doc"].alias("later"), F.explode(F.slice("held", F.lit(1), F.col("i") - 1)).alias("e")).select("later", F.col("e.doc").alias("earlier"))
    common = marks.filter("lines < 0")
    firsts = common.groupBy("hi", "lo", "lines").agg(F.min(holder).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    common = common.join(firsts, ["hi", "lo", "lines"]).select(F.col("doc").alias("later"), F.col("first.doc").alias("earlier")).filter("later <> earlier")
    return materialize(rare.union(common).distinct())


def _aligned(reps: DataFrame, pairs: DataFrame, min_words: int) -> DataFrame:
    """key and gone (places of deleted lines among all lines) for each pair that shares blocks.

    The later documents come to their earlier one in groups of about DEALT, so that one with very many is split.
    """
    groups = F.ceil(F.col("n") / DEALT).cast("int")
    sizes = pairs.groupBy("earlier").agg(F.count("*").alias("n")).withColumn("groups", groups).drop("n")
    sizes = materialize(sizes)
    body = ["hashes", "words", "raw", "key"]
    first = sizes.select(F.col("earlier").alias("doc"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), F.lit(0).alias("turn"), F.col("earlier"))
    rest = pairs.join(sizes, "earlier").select(F.col("later").alias("doc"), F.pmod(F.xxhash64("later"), F.col("groups")).cast("int").alias("part"), F.lit(1).alias("turn"), "earlier")
    asked = materialize(first.union(rest))  # read anew, so that a document of many pairs can be split
    n = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = asked.join(reps.select("doc", *body), "doc").repartition(n, "earlier", "part").sortWithinPartitions("earlier", "part", "turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        earlier = None
        for batch in batches:
            for part in byte_slices(batch, "hashes", 1 << 20):
                keys, gone = [], []
                for i, (turn, hashes, words) in enumerate(zip(*(part.column(c).to_pylist() for c in ("turn", "hashes", "words")))):
                    if turn == 0:
                        earlier = Earlier(hashes, words, min_words)
                    elif found := aligned_lines(_lines(hashes), words, earlier):
                        raw = part.column("raw")[i].values.to_numpy()
                        keys.append(i)
                        gone.append(raw[sorted(found)])
                yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(keys, pa.int32())), pa.array(gone, INT_LIST)], ["key", "gone"])

    return rows.mapInArrow(tidied(run), f"{KEY}, gone array<int>")


def kept_ranges(gone: Column) -> Column:
    """What is left between the lines of gone (rising, not empty), as 1-based starts and lengths; the last range is open."""
    end = F.array(F.lit(2**31 - 2))
    gaps = F.zip_with(F.concat(F.array(F.lit(-1)), gone), F.concat(gone, end), lambda a, b: F.struct((a + 2).alias("start"), (b - a - 1).alias("n")))
    return F.filter(gaps, lambda r: r["n"] > 0)


def common_lines(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 40) -> DataFrame:
    """id, body (hash of the text) and gone (0-based lines to delete, rising), for documents that lose any."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("body"), text.alias("text"))
    lined = materialize(split_lines(rows).filter(F.col("total") >= min_words))
    key = F.struct(F.col("id").isNotNull().alias("known"), F.coalesce("id", F.lit(0).cast("long")).alias("id"), "body")
    classes = lined.groupBy("hi", "lo").agg(F.min(key).alias("key"), F.min_by(F.struct("hashes", "words", "raw"), key).alias("of"), F.count("*").alias("n"))
    reps = materialize(classes.select(F.monotonically_increasing_id().alias("doc"), "hi", "lo", "key", "n", "of.*"))
    copies = lined.withColumn("own", key).join(reps.filter("n > 1").select("hi", "lo", "key"), ["hi", "lo"]).filter("own <> key")
    copies = copies.groupBy("id", "body").agg(F.first("raw").alias("gone"))
    blocks = _aligned(reps, _pairs(reps, min_words), min_words).groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"))
    blocks = blocks.select(F.when(F.col("key.known"), F.col("key.id")).alias("id"), F.col("key.body").alias("body"), "gone")
    return blocks.union(copies)


def dedup_lines(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 40, gone_col: str = "removed_lines") -> DataFrame:
    """df with blocks of lines that earlier documents hold deleted from the texts, and the numbers of the deleted lines.

    Order is by id (a null id first), then by the text's hash. Rows that repeat both id and text are one document: all
    of them keep or lose the same lines. Null texts stay null, blank lines are never matched or deleted; a text without
    repeated blocks is returned as it is. White space is ASCII's. A column named as gone_col is replaced.
    """
    cut = common_lines(df, id_col=id_col, text_col=text_col, min_words=min_words).select(*(F.col(c).alias(f"__{c}") for c in ("id", "body", "gone")))
    own = df.withColumn("__hash", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    out = own.join(cut, F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__body")), "left")
    left = let(F.split(F.col(text_col), "\n", -1), lambda lines: F.flatten(F.transform(kept_ranges(F.col("__gone")), lambda r: F.slice(lines, r["start"], r["n"]))))
    out = out.withColumn(text_col, F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n")))
    return out.withColumn(gone_col, F.coalesce("__gone", F.array().cast("array<int>"))).drop("__hash", "__id", "__body", "__gone")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the blocks of lines that earlier documents hold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", F.size("removed_lines").alias("n_removed"), F.array_join("removed_lines", ",").alias("removed_lines"), "text")


#: All pairs of lines that a later and an earlier document share, runs of them on one diagonal, and the words of each run.
OP9_SQL = r"""
WITH texts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS all_lines FROM documents),
lines AS (SELECT doc_id, i - 1 AS raw, trim(all_lines[i], chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM texts, LATERAL (SELECT unnest(range(1, len(all_lines) + 1)) AS i)),
placed AS MATERIALIZED (SELECT doc_id, raw, line, row_number() OVER (PARTITION BY doc_id ORDER BY raw) AS p, length(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM lines WHERE line <> ''),
met AS (SELECT b.doc_id AS later, a.doc_id AS earlier, b.raw, b.p, b.words, b.p - a.p AS diagonal FROM placed a JOIN placed b ON a.line = b.line AND a.doc_id < b.doc_id),
runs AS (SELECT *, p - row_number() OVER (PARTITION BY later, earlier, diagonal ORDER BY p) AS run FROM met),
sums AS (SELECT later, raw, sum(words) OVER (PARTITION BY later, earlier, diagonal, run) AS held FROM runs),
gone AS (SELECT later, list_sort(list(DISTINCT raw)) AS raws FROM sums WHERE held >= 40 GROUP BY later)
SELECT d.doc_id, coalesce(len(raws), 0) AS n_removed, coalesce(array_to_string(raws, ','), '') AS removed_lines,
  CASE WHEN raws IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(1, len(all_lines) + 1), lambda i: NOT list_contains(raws, i - 1)), lambda i: all_lines[i]), chr(10)) END AS text
FROM documents d JOIN texts USING (doc_id) LEFT JOIN gone ON later = d.doc_id
"""
