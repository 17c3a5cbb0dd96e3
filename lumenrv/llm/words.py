"""Words of an Arrow batch: each distinct word is worked on once, the rest is array arithmetic.

A word of up to eight characters below U+0100, an eighth one below U+0080, is looked up by those characters themselves, a number
below 2**63. Any other is looked up by a hash, from 2**63 on, and then compared with the word kept under it, so that words of equal hashes (such can be
made) only cost time, and no hash is taken for a word's own characters.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd

#: Base of the rolling hash, odd so that it has an inverse modulo 2**64, and values of the code points.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
VALUES = np.random.default_rng(20_240_601).integers(1, 1 << 64, 1 << 16, np.uint64) | np.uint64(1)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


class Hasher:
    """64-bit polynomial hashes of slices of a code point array, by one running sum."""

    def __init__(self) -> None:
        self.power = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            n = max(n, 2 * len(self.power))
            for name, base in (("power", BASE), ("inverse", INVERSE)):
                a = np.full(n, base, np.uint64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))

    def slices(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray, many: int = 1 << 14) -> np.ndarray:
        """Hashes of ascending slices, some thousands at a time so that the sums stay in the processor's cache."""
        out = np.empty(len(starts), np.uint64)
        for at in range(0, len(starts), many):
            s, e = starts[at : at + many], ends[at : at + many]
            base = s[0]
            out[at : at + many] = self._few(points[base : e[-1]], s - base, e - base)
        return out

    def _few(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._grow(len(points) + 1)
        total = np.zeros(len(points) + 1, np.uint64)
        if len(points) and int(points.max()) > 0xFFFF:
            values = VALUES[points & 0xFFFF] + (points >> 16).astype(np.uint64) * np.uint64(BASE)
        else:
            values = VALUES[points]
        np.cumsum(values * self.power[: len(points)], out=total[1:])
        out = (total[ends] - total[starts]) * self.inverse[starts]
        return out ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class WordCache:
    """Values of words (some items of dtype each), learned in bulk when a word is first seen.

    Hashes, sorted, lead to places in one array of items and in one of the words' characters, which are compared. Beyond
    cache_words words, 24 items or 24 characters a word, the half that was used least recently goes. learn(words) gives all
    items in order and how many each word has.
    """

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], dtype: str | np.dtype, cache_words: int = 600_000, items: int | None = None):
        self.learn, self.cache_words = learn, cache_words
        self.most, self.most_points = items or 24 * cache_words, 24 * cache_words
        self.hasher = Hasher()
        self.keys, self.turn = np.zeros(0, np.uint64), 0
        self.at, self.size, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.begin, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.items, self.filled = np.zeros(1 << 16, np.dtype(dtype)), 0
        self.points, self.written = np.zeros(1 << 16, np.uint32), 0
        self.fresh = np.zeros(0, bool)

    def _append(self, items: np.ndarray) -> None:
        self.items, self.filled = _grown(self.items, self.filled, items)

    def _shrink(self) -> None:
        keep = self.used > np.median(self.used)
        for name in ("keys", "at", "size", "begin", "length", "used"):
            setattr(self, name, getattr(self, name)[keep])
        self.items, self.points = self.items[spread(self.at, self.size)], self.points[spread(self.begin, self.length)]
        self.at, self.begin = np.cumsum(self.size) - self.size, np.cumsum(self.length) - self.length
        self.filled, self.written = len(self.items), len(self.points)

    def _near(self, found: np.ndarray) -> np.ndarray:
        order = np.argsort(found)
        near = np.empty(len(found), np.int64)
        near[order] = np.searchsorted(self.keys, found[order])  # in order, which spares the processor's cache
        return near

    def _other(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray, near: np.ndarray, short: np.ndarray, many: int = 1 << 14) -> np.ndarray:
        """The slices that are not the word at their place near, though of its key (short: the key is the word); two characters are compared at a time."""
        mine, kept = _pairs(points), _pairs(self.points[: self.written])
        bad = self.length[near] != ends - starts
        ask = np.flatnonzero(~short & ~bad)
        for at in range(0, len(ask), many):
            live = ask[at : at + many]
            s, n, b = starts[live], (ends - starts)[live], self.begin[near[live]]
            while len(live):
                differ = (mine[s] ^ kept[b]) & np.where(n > 1, _BOTH, _ONE)
                bad[live[differ != 0]] = True
                more = np.flatnonzero((n > 2) & (differ == 0))
                live, s, b, n = live[more], s[more] + 2, b[more] + 2, n[more] - 2
        return np.flatnonzero(bad)

    def _keys(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A key of each slice, and which keys are the slices themselves; the two kinds share no number."""
        short, packed = _short(points, starts, ends)
        return np.where(short, packed, self.hasher.slices(points, starts, ends) | _HASHED), short

    def places(self, joined: str, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each slice the number of its word among the distinct ones; the distinct words' places and sizes in items."""
        keys, short = self._keys(points, starts, ends)
        codes, found = pd.factorize(keys)
        if len(self.keys) > self.cache_words or self.filled > self.most or self.written > self.most_points:
            self._shrink()
        self.turn += 1
        near = self._near(found)
        new = np.ones(len(found), bool)
        inside = near < len(self.keys)
        new[inside] = self.keys[near[inside]] != found[inside]
        if new.any():
            first = np.empty(len(found), np.int64)
            first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            at = first[new]
            items, sizes = self.learn([joined[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist())])
            lengths = (ends - starts)[at]
            fields = {"keys": found[new], "at": self.filled + np.cumsum(sizes) - sizes, "size": sizes, "begin": self.written + np.cumsum(lengths) - lengths, "length": lengths, "used": np.full(len(at), self.turn)}
            self._append(items)
            self.points, self.written = _grown(self.points, self.written, points[spread(starts[at], lengths)])
            order = np.argsort(found[new])
            where = near[new][order]
            for name, x in fields.items():
                setattr(self, name, np.insert(getattr(self, name), where, x[order]))
            near = self._near(found)
        self.used[near] = self.turn
        self.fresh = new[codes]  # the slices whose words were learned just now
        at, size = self.at[near], self.size[near]
        other = self._other(points, starts, ends, near[codes], short)
        if len(other):  # words of another's hash are learned for this call alone
            alone: dict[str, int] = {}
            codes = codes.copy()
            codes[other] = [len(found) + alone.setdefault(joined[s:e], len(alone)) for s, e in zip(starts[other].tolist(), ends[other].tolist())]
            items, sizes = self.learn(list(alone))
            at, size = np.append(at, self.filled + np.cumsum(sizes) - sizes), np.append(size, sizes)
            self._append(items)
            self.fresh[other] = True
        return codes, at, size

    def encode(self, joined: str, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All items in order as one array, and how many each slice gave."""
        codes, at, size = self.places(joined, points, starts, ends)
        lens = size[codes]
        return self.items[spread(at[codes], lens)], lens


_ONE, _BOTH, _HASHED = np.uint64(0xFFFFFFFF), np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(1 << 63)


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _short(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which slices are eight characters below U+0100 (the eighth below U+0080) at most, and these characters as one number below 2**63."""
    n = ends - starts
    wide = points > 0xFF
    short = n <= 8
    if wide.any():
        before = np.append(0, np.cumsum(wide))
        short &= before[ends] == before[starts]
    letters = np.append(points.astype(np.uint8), np.zeros(8, np.uint8))
    eight = np.ndarray(len(points) + 1, "<u8", letters, strides=(1,))
    packed = eight[starts] & _MASKS[np.minimum(n, 8)]
    return short & (packed < _HASHED), packed


def _pairs(points: np.ndarray) -> np.ndarray:
    """Each character with the next one as one number; behind the last one is nothing."""
    padded = np.append(points.astype("<u4", copy=False), np.zeros(1, "<u4"))
    return np.ndarray(len(points), "<u8", padded, strides=(4,))


def _grown(held: np.ndarray, filled: int, more: np.ndarray) -> tuple[np.ndarray, int]:
    """held with more written from filled on, in an array that at least doubles when it is full; and what is filled then."""
    if filled + len(more) > len(held):
        held = np.concatenate([held[:filled], np.zeros(max(len(held), len(more)), held.dtype)])
    held[filled : filled + len(more)] = more
    return held, filled + len(more)


def spread(at: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """at[0], at[0]+1, ... of lens[0] places, then those of the next."""
    ends = np.cumsum(lens)
    return np.repeat(at - ends + lens, lens) + np.arange(ends[-1] if len(ends) else 0)


def text_starts(texts: list[str]) -> np.ndarray:
    """Offsets of the texts in their concatenation, and its length."""
    return np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])


def per_text(flat: np.ndarray, lens: np.ndarray, starts: np.ndarray, borders: np.ndarray) -> list[np.ndarray]:
    """Cut flat by texts: starts are the words' starts, borders the texts' offsets; every text's start is a word's."""
    done = np.concatenate([[0], np.cumsum(lens)])
    cut = done[np.searchsorted(starts, borders)].tolist()
    return [flat[a:b] for a, b in zip(cut, cut[1:])]
