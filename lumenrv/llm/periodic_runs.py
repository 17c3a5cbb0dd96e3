"""Periodic runs of words: stretches that repeat a block of words four times and more, found by a suffix tree.

The tree of a slice of documents is kept as arrays. Suffixes are put in order by doubling the compared length; what is
equal so far is sorted on, so that ordinary prose is settled after few rounds. Neighbours' common prefixes give the inner
nodes as intervals of that order. As Stoye and Gusfield do, each node's leaves outside its largest child are visited: a
leaf at place i below a node of depth p starts a tandem repeat if i + p lies below the node too (and ends one if i - p
does), and the repeat branches if it cannot be moved on by one word. A branching repeat is the right end of a run; rotated
to the left as far as it goes (by the equal stretches that doubling has left) it is the whole run, and repeats of
multiples of a period merge with it. Work is n log n in a document's words, memory some hundred bytes a word of a slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, let, texts
from .words import spread

#: A run has so many words at least, and so many periods.
WORDS, PERIODS = 6, 4


def doubled_ranks(codes: np.ndarray) -> list[np.ndarray]:
    """For k = 0, 1, ...: equal numbers for places whose next 2**k codes are equal, until all numbers differ.

    The numbers of k sort the places by these codes; the last array is the place of each suffix in order. Every document's
    codes are its own and end with one that occurs nowhere else, so that equal stretches lie inside of a document.
    """
    n = len(codes)
    rank = np.empty(n, np.int64)
    order = np.argsort(codes, kind="stable")
    first = np.append(True, np.diff(codes[order]) != 0)
    heads = np.flatnonzero(first)
    rank[order] = heads[np.cumsum(first) - 1]
    levels, step = [rank], 1
    active = order[~(first & np.append(first[1:], True))]  # the places that share their number, in order
    while len(active):
        key = rank[active] * n + rank[active + step]
        by = np.argsort(key, kind="stable")
        active, key = active[by], key[by]
        group = rank[active]
        at = np.arange(len(active))
        opens = np.append(True, np.diff(group) != 0)
        inside = at - at[opens][np.cumsum(opens) - 1]  # place in the old group
        first = np.append(True, np.diff(key) != 0)
        rank = rank.copy()
        rank[active] = (group + inside)[first][np.cumsum(first) - 1]
        levels.append(rank)
        active = active[~(first & np.append(first[1:], True))]
        step *= 2
    return levels


def common_prefixes(levels: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix in order with the one before it; 0 for the first, and one 0 behind."""
    out = np.zeros(len(order) + 1, np.int64)
    live = np.arange(1, len(order))
    sets = []
    for rank in levels:
        live = live[rank[order[live - 1]] == rank[order[live]]]
        if not len(live):
            break
        sets.append(live)
    for k in range(len(sets) - 1, -1, -1):  # 2**k equal codes are known for sets[k]; those of larger k have been measured further
        at = sets[k]
        here, before = order[at] + out[at], order[at - 1] + out[at]
        out[at] += (levels[k][here] == levels[k][before]).astype(np.int64) << k
    return out


def _reach(depth: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each place the next one behind it of a lesser depth; the last place's is the least of all."""
    least, step, out = [depth], 1, at + 1
    live = np.arange(len(at))
    grown = []
    while len(live):  # ever longer steps while all depths in them are as large
        held = out[live]
        fits = held + step <= len(depth)
        live, held = live[fits], held[fits]
        go = least[-1][held] >= depth[at[live]]
        live = live[go]
        out[live] += step
        grown.append(live)
        if len(live):
            half = least[-1]
            least.append(np.minimum(half[: len(half) - step], half[step:]) if len(half) > step else half[:0])
            step *= 2
    moved = np.unique(np.concatenate(grown)) if grown else live
    for k in range(len(least) - 1, -1, -1):  # then ever shorter ones
        held = out[moved]
        fits = held < len(least[k])
        live = moved[fits]
        go = least[k][out[live]] >= depth[at[live]]
        out[live[go]] += 1 << k
    return out


def inner_nodes(prefix: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes with least leaves or more: first leaf, end, depth, and of their children (node, first leaf, end as the next start)."""
    at = np.flatnonzero(prefix[:-1] > 0)
    end = _reach(prefix, at)
    turned = prefix[::-1].copy()
    last = len(prefix) - 1
    turned[0] = 0
    start = last - _reach(turned, last - at)  # the nearest place before of a lesser depth is where the first leaf stands
    keep = end - start >= least
    at, start, end = at[keep], start[keep], end[keep]
    depth = prefix[at]
    by = np.lexsort((at, depth, start))
    at, start, end, depth = at[by], start[by], end[by], depth[by]
    first = np.ones(len(at), bool)
    first[1:] = (np.diff(start) != 0) | (np.diff(depth) != 0)
    node = np.cumsum(first) - 1
    start, end, depth = start[first], end[first], depth[first]
    of = np.concatenate([np.arange(len(start)), node])
    begin = np.concatenate([start, at])
    by = np.lexsort((begin, of))
    of, begin = of[by], begin[by]
    return start, end, depth, of, begin


def branching_repeats(codes: np.ndarray, levels: list[np.ndarray], least: int = PERIODS) -> tuple[np.ndarray, np.ndarray]:
    """Start and period of tandem repeats that cannot be moved on by one word, of all that have least equal blocks and more.

    The blocks of a run all begin below the node of their words, which has least leaves then; nodes with fewer are left out.
    """
    rank = levels[-1]
    order = np.empty(len(codes), np.int64)
    order[rank] = np.arange(len(codes))
    start, end, depth, of, begin = inner_nodes(common_prefixes(levels, order), least)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    last = np.append(np.diff(of) != 0, True)
    until = np.append(begin[1:], 0)
    until[last] = end
    size = until - begin
    heads = np.flatnonzero(np.append(True, last[:-1]))
    most = np.maximum.reduceat(size, heads)
    largest = np.flatnonzero(size == most[of])
    largest = largest[np.append(True, np.diff(of[largest]) != 0)]  # one a node
    small = np.ones(len(size), bool)
    small[largest] = False
    of, begin, size = of[small], begin[small], size[small]
    found = []
    many = np.cumsum(size)
    for a, b in _chunks(many, 1 << 21):  # some million leaves at a time
        node = np.repeat(of[a:b], size[a:b])
        i, p = order[spread(begin[a:b], size[a:b])], depth[node]
        low, high = start[node], end[node]
        for j, k in ((i, i + p), (i - p, i)):  # a repeat's first and second half
            other = k if j is i else j
            held = rank[np.maximum(other, 0)]
            good = np.flatnonzero((other >= 0) & (low <= held) & (held < high))
            j, q = j[good], p[good]
            ends = codes[j] != codes[j + 2 * q]
            found.append((j[ends], q[ends]))
    starts, periods = (np.concatenate(x) for x in zip(*found))
    return starts, periods


def _chunks(done: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of about most in the sizes of which done has the running sum."""
    a = 0
    while a < len(done):
        b = max(a + 1, int(np.searchsorted(done, (done[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def runs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of all maximal runs, by start."""
    levels = doubled_ranks(codes)
    start, period = branching_repeats(codes, levels)
    end = start + 2 * period
    for k in range(len(levels) - 1, -1, -1):  # rotated to the left by 2**k words at once where these are equal a period apart
        back = start - (1 << k)
        equal = np.flatnonzero(back >= 0)
        equal = equal[levels[k][back[equal]] == levels[k][back[equal] + period[equal]]]
        start[equal] = back[equal]
    enough = end - start >= np.maximum(WORDS, PERIODS * period)
    start, end, period = start[enough], end[enough], period[enough]
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    first = np.ones(len(start), bool)
    first[1:] = (np.diff(start) != 0) | (np.diff(end) != 0)  # the same stretch by multiples of its period is one run
    return start[first], end[first], period[first]


def _slice_runs(batch: list[str]) -> tuple[list[list[tuple[int, int, int]]], list[str]]:
    """(start, length, period) of each text's runs, and the text without the words that a run repeats."""
    words = [t.encode().split() for t in batch]  # splits at the six blanks of ASCII
    numbers: list[int] = []
    base = 0
    for held in words:
        seen: dict[bytes, int] = {}
        numbers.extend([base + seen.setdefault(w, len(seen)) for w in held])
        base += len(seen) + 1
        numbers.append(base - 1)  # a mark of its own behind each text
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    begin = np.cumsum(size) - size
    found: list[list[tuple[int, int, int]]] = [[] for _ in batch]
    start, end, period = runs(np.array(numbers, np.int64))
    of = np.searchsorted(begin, start, "right") - 1
    for d, s, n, p in zip(of.tolist(), (start - begin[of]).tolist(), (end - start).tolist(), period.tolist()):
        found[d].append((s, n, p))
    out = []
    for held, mine in zip(words, found):
        if mine:
            gone = np.zeros(len(held) + 1, np.int64)
            for s, n, p in mine:
                gone[s + p] += 1
                gone[s + n] -= 1
            kept = np.cumsum(gone)[:-1] == 0
            held = [held[i] for i in np.flatnonzero(kept).tolist()]
        out.append(b" ".join(held).decode())
    return found, out


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = 3 << 20) -> DataFrame:
    """doc_id, runs (start, length, period in words, by start, then period) and collapsed, the text with each run once.

    Words are split at the six blanks of ASCII. A run is a stretch with smallest period q of max(6, 4 q) words or more that
    neither neighbour extends. collapsed has the words, joined by one space, that no run holds after its first q. A null or
    empty text has no run and collapses to ''. Every row is on its own: repeated ids and null ids each keep their row; other
    columns go. A text is worked on whole, however long it is; slice_bytes bounds how many texts share a pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text", slice_bytes):
                found, collapsed = _slice_runs(part.column("text").to_pylist())
                flat = [x for mine in found for x in mine]
                ends = np.append(0, np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))).astype(np.int32)
                fields = [pa.array([x[k] for x in flat], pa.int64()) for k in range(3)]
                listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(RUN)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), listed, pa.array(collapsed, pa.string())], ["doc_id", "runs", "collapsed"])

    return texts(df, id_col, text_col).mapInArrow(run, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(df: DataFrame) -> DataFrame:
    """doc_id and text; where the crc32 of the id ends in 0, the words from a place on are replaced by a repeated block of them."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def repeat(words: Column) -> Column:
        n, g = F.size(words), F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.when(n > 0, F.array_join(F.transform(words, lambda w, i: F.when(i >= a, F.get(words, (a + (i - a) % p).cast("int"))).otherwise(w)), " ")).otherwise("")

    return texts(df).select("doc_id", F.when(h % 10 == 0, let(words, repeat)).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, in part planted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = periodic_runs(planted(docs))
    more = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda a, b: F.when(more(a, b), b).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", "best.*", F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
