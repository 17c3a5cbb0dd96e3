"""Toxicity of documents: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Inputs are words: each has a vector of its own if the labelled rows held it often enough, next to vectors of its runs of
three to five characters (their mean, and the greatest of their first place). Training starts the first places where the
labels put them: at the log odds of the word or run over their deviation, if beyond what chance gives. The network reads
windows of words in both directions, attention weighs its states, and a document's score is that of its worst window. All
overlapping windows of the whole text are scored. All windows of a labelled document take part in training: before epochs
0, 1, 2, 4, 8 each document's worst window is picked anew, so that labels of documents teach windows.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, give_back, materialize, texts, tidied
from .words import WordCache, code_points, text_starts

HIDDEN, WORD_DIM, CHAR_DIM, ATTENTION = 8, 8, 8, 8
GRAMS = 1 << 15


@cache
def _in_words() -> np.ndarray:
    """Which code points are letters or digits."""
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


def folded(text: str) -> str:
    """Small letters; forms that stand for others (wide, mathematical, ligatures) as those."""
    return (text if text.isascii() or unicodedata.is_normalized("NFKC", text) else unicodedata.normalize("NFKC", text)).lower()


def word_places(points: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of letters and digits; a run ends where its text ends."""
    inside = np.ones(len(points) + 2, bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = _in_words()[points]
    first = np.zeros(len(points) + 1, bool)
    first[borders] = True
    starts = inside[1:] & (~inside[:-1] | first)
    ends = inside[:-1] & (~inside[1:] | first)
    return np.flatnonzero(starts), np.flatnonzero(ends)


def gram_ids(words: list[str], many: int = 20_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed runs of three to five characters of each word between < and >: all ids, each word's first and number of them."""
    if not words:
        return (np.zeros(0, np.int64),) * 3
    if len(words) > many:  # some thousand words at a time
        parts = [gram_ids(words[k : k + many], many) for k in range(0, len(words), many)]
        sizes = np.concatenate([p[2] for p in parts])
        return np.concatenate([p[0] for p in parts]), np.cumsum(sizes) - sizes, sizes
    marked = [f"<{w}>" for w in words]
    points = code_points("".join(marked)).astype(np.uint64)
    lens = np.fromiter(map(len, marked), np.int64, len(marked))
    ends = np.cumsum(lens)
    left = np.repeat(ends, lens) - np.arange(len(points))  # characters up to the word's end
    padded = np.append(points, np.zeros(4, np.uint64))
    ids, there = np.empty((len(points), 3), np.int64), np.empty((len(points), 3), bool)
    h = (padded[:-4] * np.uint64(0x9E3779B1)) ^ (padded[1:-3] * np.uint64(0x85EBCA77C2B2AE63))
    for k, n in enumerate((3, 4, 5)):
        h = (h ^ padded[n - 1 : len(padded) - 5 + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        ids[:, k], there[:, k] = (h >> np.uint64(7)).astype(np.int64) & (GRAMS - 1), left >= n
    sizes = np.add.reduceat(there.sum(axis=1), ends - lens)
    return ids[there].astype(np.int32), np.cumsum(sizes) - sizes, sizes


def surety(held: np.ndarray, total: np.ndarray, beyond: float) -> np.ndarray:
    """Log odds of label 1 over their deviation, for counts of documents by label (n x 2), drawn in by beyond on both sides."""
    odds = np.log((held[:, 1] + 0.5) / (total[1] + 1)) - np.log((held[:, 0] + 0.5) / (total[0] + 1))
    z = odds / np.sqrt((1 / (held + 0.5)).sum(axis=1))
    return (np.sign(z) * np.clip(np.abs(z) - beyond, 0, 8) / 2).astype(np.float32)


def window_starts(n: int, size: int, stride: int) -> np.ndarray:
    """Starts of overlapping windows that cover n words; the last one ends with the text."""
    if n <= size:
        return np.zeros(1 if n else 0, np.int64)
    return np.append(np.arange(0, n - size, stride), n - size)


def gathered(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of values by their places at, in an array of n rows."""
    out = np.zeros((n, values.shape[1]), np.float32)
    if len(at):
        order = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(at[order]) != 0))
        out[at[order][first]] = np.add.reduceat(values[order], first)
    return out


class Net:
    """The network. params: vectors Ew (row 0: other words), Ec; input weights W, b; recurrent U; attention A, a, v; output o, c."""

    def __init__(self, vocabulary: dict[str, int], params: dict[str, np.ndarray]):
        self.vocabulary, self.p = vocabulary, params

    @classmethod
    def new(cls, vocabulary: dict[str, int], rng: np.random.Generator) -> Net:
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[-2])).astype(np.float32)
        return cls(vocabulary, {
            "Ew": (0.05 * draw(len(vocabulary) + 1, WORD_DIM)), "Ec": np.zeros((GRAMS, CHAR_DIM), np.float32), "W": draw(2, d, 3 * h), "b": np.zeros((2, 3 * h), np.float32),
            "U": draw(2, h, 3 * h), "A": draw(2 * h, ATTENTION), "a": np.zeros(ATTENTION, np.float32), "v": draw(ATTENTION, 1)[:, 0], "o": draw(2 * h, 1)[:, 0], "c": np.full(1, -1.0, np.float32),
        })

    def inputs(self, words: list[str]) -> np.ndarray:
        """Word vector and mean triple vector of each word."""
        return self.mixed(np.array([self.vocabulary.get(w, 0) for w in words], np.int64), *gram_ids(words))

    def learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For a WordCache: the input parts of the gates."""
        return self.projected(self.inputs(words)).ravel(), np.full(len(words), 6 * HIDDEN)

    def mixed(self, ids: np.ndarray, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, many: int = 20_000) -> np.ndarray:
        if len(ids) > many:  # some thousand words at a time
            cuts = range(0, len(ids), many)
            ends = [int(starts[k + many]) if k + many < len(ids) else len(flat) for k in cuts]
            return np.concatenate([self.mixed(ids[k : k + many], flat[starts[k] : e], starts[k : k + many] - starts[k], sizes[k : k + many]) for k, e in zip(cuts, ends)])
        if not len(ids):
            return np.zeros((0, WORD_DIM + CHAR_DIM), np.float32)
        vectors = self.p["Ec"][flat]
        chars = np.add.reduceat(vectors, starts) / sizes[:, None]  # every word has runs, as it is marked at both ends
        chars[:, 0] = np.maximum.reduceat(vectors[:, 0], starts)
        own = self.p["Ew"][ids] * (ids > 0)[:, None]
        return np.concatenate([own, chars.astype(np.float32)], axis=1)

    def projected(self, x: np.ndarray) -> np.ndarray:
        """Input parts of the gates of both directions, side by side."""
        out = np.empty((len(x), 6 * HIDDEN), np.float32)
        for k in range(0, len(x), 20_000):
            for side, part in enumerate(np.split(out[k : k + 20_000], 2, axis=1)):
                part[:] = x[k : k + 20_000] @ self.p["W"][side] + self.p["b"][side]
        return out

    def states(self, gates: np.ndarray, at: np.ndarray, sizes: np.ndarray | None, keep: list | None = None) -> np.ndarray:
        """States of both directions for windows of word rows at (N x T); sizes: words in each, if not all are full."""
        n, t = at.shape
        h = HIDDEN
        u = np.zeros((2 * h, 6 * h), np.float32)
        u[:h, : 3 * h], u[h:, 3 * h :] = self.p["U"]
        state, out = np.zeros((n, 2 * h), np.float32), np.empty((n, t, 2 * h), np.float32)
        for k in range(t):
            g = np.concatenate([gates[at[:, k], : 3 * h], gates[at[:, t - 1 - k], 3 * h :]], axis=1)
            r = state @ u
            zr = (g.reshape(n, 2, 3 * h)[:, :, : 2 * h] + r.reshape(n, 2, 3 * h)[:, :, : 2 * h]) * 0.5
            np.tanh(zr, out=zr)
            zr += 1.0
            zr *= 0.5
            z, reset = zr[:, :, :h], zr[:, :, h:]
            rn = r.reshape(n, 2, 3 * h)[:, :, 2 * h :]
            new = np.tanh(g.reshape(n, 2, 3 * h)[:, :, 2 * h :] + reset * rn)
            old = state.reshape(n, 2, h)
            nxt = new + z * (old - new)
            if sizes is not None:  # padding leaves a state as it was
                nxt[:, 0] = np.where((k < sizes)[:, None], nxt[:, 0], old[:, 0])
                nxt[:, 1] = np.where((t - 1 - k < sizes)[:, None], nxt[:, 1], old[:, 1])
            if keep is not None:
                keep.append((old, z, reset, new, rn))
            state = np.ascontiguousarray(nxt).reshape(n, 2 * h)
            out[:, k, :h], out[:, t - 1 - k, h:] = state[:, :h], state[:, h:]
        return out

    def pooled(self, hs: np.ndarray, sizes: np.ndarray | None) -> tuple[np.ndarray, ...]:
        e = np.tanh(hs @ self.p["A"] + self.p["a"])
        s = e @ self.p["v"]
        if sizes is not None:
            s = np.where(np.arange(hs.shape[1]) < sizes[:, None], s, -1e9)
        w = np.exp(s - s.max(axis=1, keepdims=True))
        w /= w.sum(axis=1, keepdims=True)
        ctx = np.einsum("nt,nth->nh", w, hs)
        return e, w, ctx, ctx @ self.p["o"] + self.p["c"][0]

    def logits(self, gates: np.ndarray, at: np.ndarray, sizes: np.ndarray | None = None, chunk: int = 2048) -> np.ndarray:
        out = [self.pooled(self.states(gates, at[i : i + chunk], s := sizes[i : i + chunk] if sizes is not None else None), s)[3] for i in range(0, len(at), chunk)]
        return np.concatenate(out) if out else np.zeros(0, np.float32)

    def gradients(self, at: np.ndarray, sizes: np.ndarray, target: np.ndarray, weight: np.ndarray, words: tuple, own: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weighted cross entropy; words: triples of the distinct words, own: their vector rows (0: dropped)."""
        p, h, (n, t) = self.p, HIDDEN, at.shape
        used, at = np.unique(at, return_inverse=True)
        at = at.reshape(n, t)
        flat, _, lens = words
        flat, lens = flat[_spread(words, used)], lens[used]
        starts = np.cumsum(lens) - lens
        ids = own[used]
        x = self.mixed(ids, flat, starts, lens)
        kept: list = []
        hs = self.states(self.projected(x), at, sizes, kept)
        e, w, ctx, logit = self.pooled(hs, sizes)
        d = weight * (1 / (1 + np.exp(-logit)) - target) / weight.sum()
        g = {"c": np.array([d.sum()], np.float32), "o": ctx.T @ d}
        dctx = d[:, None] * p["o"]
        dw = np.einsum("nh,nth->nt", dctx, hs)
        dhs = w[:, :, None] * dctx[:, None, :]
        ds = w * (dw - (w * dw).sum(axis=1, keepdims=True))
        g["v"] = np.einsum("nt,ntk->k", ds, e)
        de = ds[:, :, None] * p["v"] * (1 - e * e)
        g["A"] = np.einsum("nth,ntk->hk", hs, de)
        g["a"] = de.sum(axis=(0, 1))
        dhs = dhs + de @ p["A"].T
        each = np.empty((2, n, t, 3 * h), np.float32)
        g["U"] = np.zeros_like(p["U"])
        dh = np.zeros((n, 2, h), np.float32)
        for k in range(t - 1, -1, -1):
            old, z, reset, new, rn = kept[k]
            dh[:, 0] += dhs[:, k, :h]
            dh[:, 1] += dhs[:, t - 1 - k, h:]
            live = np.stack([k < sizes, t - 1 - k < sizes], axis=1)[:, :, None]
            dn = dh * (1 - z) * live
            dnp = dn * (1 - new * new)
            drn = dnp * reset
            dzp = dh * (old - new) * z * (1 - z) * live
            drp = dnp * rn * reset * (1 - reset)
            back = np.concatenate([dzp, drp, drn], axis=2)
            dg = np.concatenate([dzp, drp, dnp], axis=2)
            dh = np.where(live, dh * z, dh)
            for side, step in ((0, k), (1, t - 1 - k)):
                g["U"][side] += old[:, side].T @ back[:, side]
                dh[:, side] += back[:, side] @ p["U"][side].T
                each[side, :, step] = dg[:, side]
        dgates = np.concatenate([gathered(at.ravel(), x.reshape(-1, 3 * h), len(used)) for x in each], axis=1)
        g["W"] = np.stack([x.T @ dgates[:, : 3 * h], x.T @ dgates[:, 3 * h :]])
        g["b"] = np.stack([dgates[:, : 3 * h].sum(axis=0), dgates[:, 3 * h :].sum(axis=0)])
        dx = dgates[:, : 3 * h] @ p["W"][0].T + dgates[:, 3 * h :] @ p["W"][1].T
        g["Ew"] = gathered(ids, dx[:, :WORD_DIM] * (ids > 0)[:, None], len(p["Ew"]))
        each_run = np.repeat(dx[:, WORD_DIM:] / lens[:, None], lens, axis=0)
        first = p["Ec"][flat, 0]
        top = first == np.repeat(x[:, WORD_DIM], lens)  # the greatest; equal ones share
        each_run[:, 0] = top * np.repeat(dx[:, WORD_DIM] / np.add.reduceat(top.astype(np.float32), starts), lens)
        g["Ec"] = gathered(flat, each_run, GRAMS)
        return g


def _spread(grams: tuple, rows: np.ndarray) -> np.ndarray:
    """Places of all runs of some words."""
    _, starts, sizes = grams
    starts, sizes = starts[rows], sizes[rows]
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def train(docs: Iterable[tuple[list[str], int]], *, epochs: int = 12, least_steps: int = 300, batch: int = 128, rate: float = 0.01, decay: float = 0.02, drop: float = 0.25, seed: int = 5, least_docs: int = 3, window: int = 64) -> Net:
    """Fit to documents given as windows (words joined by spaces) and a label 0 or 1; few documents get smaller batches and more epochs.

    docs are gone through once, and of each only the numbers of its words are kept.
    """
    row: dict[str, int] = {}
    each, lengths, labels = [np.zeros((0, window), np.int32)], [], []
    for windows, y in docs:
        mine = np.zeros((len(windows), window), np.int32)
        for k, x in enumerate(windows):
            ids = [row.setdefault(w, len(row)) for w in x.split(" ")]
            mine[k, : len(ids)] = ids
            lengths.append(len(ids))
        each.append(mine)
        labels.append(y)
    doc = np.repeat(np.arange(len(labels)), [len(x) for x in each[1:]])
    at, sizes = np.concatenate(each), np.array(lengths, np.int64)
    del each
    batch = min(batch, max(16, len(labels) // 16))
    epochs = max(epochs, -(-least_steps // max(1, -(-len(labels) // batch))))
    rng = np.random.default_rng(seed)
    words = list(row)
    grams = gram_ids(words)
    total, held, grams_held = np.zeros(2), np.zeros((len(words), 2)), np.zeros((GRAMS, 2))
    borders = np.searchsorted(doc, np.arange(len(labels) + 1))
    for i, y in enumerate(labels):
        mine = slice(borders[i], borders[i + 1])
        own_rows = np.unique(at[mine][np.arange(window) < sizes[mine, None]])
        total[y] += 1
        held[own_rows, y] += 1
        grams_held[np.unique(grams[0][_spread(grams, own_rows)]), y] += 1
    net = Net.new({words[i]: k + 1 for k, i in enumerate(np.flatnonzero(held.sum(axis=1) >= least_docs).tolist())}, rng)
    if not labels:
        return net
    net.p["Ew"][:, 0] = 0
    net.p["Ew"][1:, 0] = surety(held[held.sum(axis=1) >= least_docs], total, 2.0)
    net.p["Ec"][:, 0] = surety(grams_held, total, 3.0)
    own = np.array([net.vocabulary.get(w, 0) for w in words], np.int64)
    del row, words, held, grams_held
    label = np.array(labels, np.float32)
    share = min(max(label.mean(), 1e-3), 1 - 1e-3)
    weights = np.where(label == 1, min(0.25 / share, 4.0), 1.0).astype(np.float32)  # rare labels count a little more
    first = {name: np.zeros_like(x) for name, x in net.p.items()}
    second = {name: np.zeros_like(x) for name, x in net.p.items()}
    step = 0
    hint = net.mixed(own, *grams)[:, [0, WORD_DIM]].sum(axis=1)  # for the first choice of windows
    for epoch in range(epochs):
        if epoch in (0, 1, 2, 4, 8) or epoch % 16 == 0:
            score = net.logits(net.projected(net.mixed(own, *grams)), at, sizes) if epoch else np.where(np.arange(window) < sizes[:, None], hint[at], -9).max(axis=1)
            order = np.lexsort((score, doc))
            worst = order[np.append(doc[order][1:] != doc[order][:-1], True)]
        worst = rng.permutation(worst)
        for s in range(0, len(worst), batch):
            pick = worst[s : s + batch]
            dropped = np.where(rng.random(len(own)) < drop, 0, own)  # so that triples learn beside whole words
            g = net.gradients(at[pick], sizes[pick], label[doc[pick]], weights[doc[pick]], grams, dropped)
            step += 1
            lr = rate * (1 - 0.9 * step / (epochs * -(-len(worst) // batch)))
            for name, x in g.items():
                first[name] += 0.1 * (x - first[name])
                second[name] += 0.01 * (x * x - second[name])
                pace = lr * 0.1 if name in ("Ew", "Ec") else lr  # few rows must not be learned by heart
                net.p[name] = (net.p[name] * (1 - decay * lr) - pace * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def score_batch(net: Net, cache: WordCache, texts: list[str], window: int, stride: int) -> np.ndarray:
    """Scores of whole texts; a text without words scores 0."""
    low = [folded(t) for t in texts]
    joined, borders = "".join(low), text_starts(low)
    points = code_points(joined)
    starts, ends = word_places(points, borders)
    out = np.zeros(len(texts))
    if not len(starts):
        return out
    codes, at, _ = cache.places(joined, points, starts, ends)
    gates = cache.items[: cache.filled].reshape(-1, 6 * HIDDEN)[at // (6 * HIDDEN)]
    cut = np.searchsorted(starts, borders)
    full, full_doc, few, few_doc = [], [], [], []
    for i, (a, b) in enumerate(zip(cut.tolist(), cut[1:].tolist())):
        if b - a >= window:
            full.append(a + window_starts(b - a, window, stride))
            full_doc.append(np.full(len(full[-1]), i))
        elif b > a:
            few.append((a, b - a))
            few_doc.append(i)
    best = np.full(len(texts), -np.inf)
    if full:
        at = codes[np.concatenate(full)[:, None] + np.arange(window)]
        np.maximum.at(best, np.concatenate(full_doc), net.logits(gates, at))
    if few:
        a, n = np.array(few).T
        at = codes[np.minimum(a[:, None] + np.arange(n.max()), len(codes) - 1)]
        np.maximum.at(best, np.array(few_doc), net.logits(gates, at, n))
    return np.where(np.isfinite(best), 1 / (1 + np.exp(-np.clip(best, -50, 50))), 0.0)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def labelled_windows(df: DataFrame, labels: DataFrame, *, each: int, most: int, window: int, stride: int) -> Iterator[tuple[list[str], int]]:
    """The training sample: at most each documents of each label, with all their windows, and most windows of each label in all.

    Ids are taken in the order of their hash, so that the sample does not depend on partitions; a document that has more
    windows than are left is passed over. Of rows with one id the least text stands for them. The driver gets each document's
    words once, as an Arrow column, and cuts one document's windows at a time.
    """
    ids = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic")).filter(~held_out(F.col("doc_id")))
    picked = [ids.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each) for y in (0, 1)]
    rows = texts(df).join(F.broadcast(picked[0].union(picked[1])), "doc_id")  # each * 2 ids at most
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def cut(words: list[str]) -> list[str]:
        return [" ".join(words[s : s + window]) for s in window_starts(len(words), window, stride).tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            joined, n, chars = [], [], []
            for text in batch.column("text").to_pylist():
                low = folded(text)
                starts, ends = word_places(code_points(low), np.array([0, len(low)]))
                words = [low[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
                windows = cut(words)
                joined.append(" ".join(words))
                n.append(len(windows))
                chars.append(sum(map(len, windows)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("toxic"), pa.array(joined, pa.string()), pa.array(n, pa.int32()), pa.array(chars, pa.int64())], ["doc_id", "toxic", "words", "n", "chars"])

    held = materialize(rows.select("doc_id", "toxic", "text").mapInArrow(tidied(run), "doc_id long, toxic int, words string, n int, chars long"))
    sizes = held.select("doc_id", "toxic", "n", "chars").orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    left, chosen = {0: most, 1: most}, []
    for r in sizes:  # each * 2 rows; windows are words of a text, so that characters are bounded too
        cost = max(r.n, r.chars // 1000)
        if 0 < cost <= left[r.toxic]:
            left[r.toxic] -= cost
            chosen.append(r.doc_id)
    ids = held.sparkSession.createDataFrame([(i,) for i in chosen], "doc_id long")
    got = held.join(F.broadcast(ids), "doc_id").select("doc_id", "toxic", "words").toArrow()
    words, toxic = got.column("words"), got.column("toxic")
    for i in pc.sort_indices(got.column("doc_id")).to_pylist():
        yield cut(words[i].as_py().split(" ")), toxic[i].as_py()


def score_toxicity(
    df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 64, stride: int = 48,
    train_each: int = 2000, train_windows: int = 100_000, threshold: float = 0.7,
) -> DataFrame:
    """df with score, predicted (1 at threshold or more) and held_out; columns of these names are replaced.

    labels has doc_id and toxic; rows whose crc32 of the id modulo 3 is 1 teach nothing. The network is fitted to train_each
    documents of each label with train_windows windows (or thousands of characters in them) at most. Null and empty texts and texts without words score 0; without labels a constant
    network scores. Only words of the text are inputs.
    """
    source = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    give_back()
    trained = train(labelled_windows(source, labels, each=train_each, most=train_windows, window=window, stride=stride), window=window)
    give_back()
    net = df.sparkSession.sparkContext.broadcast(trained)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = net.value
        cache = WordCache(model.learn, np.float32, 150_000, 150_000 * 6 * HIDDEN)
        for column in batches:
            batch = pa.RecordBatch.from_arrays([column], ["text"])
            parts = [score_batch(model, cache, p.column("text").to_pylist(), window, stride) for p in byte_slices(batch, "text", 2 << 20)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0))

    whole = tidied(run)
    whole.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    score = F.arrow_udf(whole, "double")
    out = df.withColumn("score", score(F.coalesce(F.col(text_col), F.lit(""))))
    return out.withColumns({"predicted": (F.col("score") >= threshold).cast("int"), "held_out": held_out(F.col(id_col))})


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return scored.select("doc_id", "held_out", "score", "predicted")
