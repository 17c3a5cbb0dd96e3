"""Outlier-resistant means and straight lines of many groups at once (numpy only).

Values come one group after the other, with the groups' sizes. A missing value is NaN.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def slices(sizes: np.ndarray, most: int = 500_000) -> Iterator[tuple[int, int]]:
    """First and last (exclusive) group of pieces of about most values."""
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")), a + 1)
        yield a, b
        a = b


def firsts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def middles(v: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Median of each group; a group without values has none."""
    out = np.full(len(sizes), np.nan)
    some = sizes > 0
    starts, n = firsts(sizes)[some], sizes[some]
    if len(v) > 32 * len(n):
        v = np.concatenate([np.sort(v[a : a + k]) for a, k in zip(starts.tolist(), n.tolist())]) if len(n) else v
    else:
        v = v[np.lexsort((v, np.repeat(np.arange(len(sizes)), sizes)))]
    out[some] = (v[starts + (n - 1) // 2] + v[starts + n // 2]) / 2
    return out


def known(v: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without missing values."""
    there = ~np.isnan(v)
    return v[there], counted(there, sizes)


def counted(there: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.append(0, np.cumsum(there))
    starts = firsts(sizes)
    return ends[starts + sizes] - ends[starts]


def robust_means(v: np.ndarray, q: np.ndarray, sizes: np.ndarray, odd: float, rounds: int, converged: float, about_median: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Means and errors of values with squared errors q; what lacks one of them takes no part but in the median that is taken off."""
    if about_median:
        v = v - np.repeat(middles(*known(v, sizes)), sizes)
    there = ~np.isnan(v) & ~np.isnan(q)
    v, q, sizes = v[there], q[there], counted(there, sizes)
    g, last, bulk = middles(v, sizes), np.full(len(sizes), np.inf), np.where(sizes > 0, 1.0, np.nan)
    mine = np.arange(len(sizes))
    with np.errstate(all="ignore"):
        for _ in range(rounds):
            moving = np.abs(g[mine] - last[mine]) / bulk[mine] > converged
            if not moving.all():
                go = np.repeat(moving, sizes)
                v, q, sizes, mine = v[go], q[go], sizes[moving], mine[moving]
            if not len(mine):
                break
            off = v - np.repeat(g[mine], sizes)
            w = (1.0 - odd / (np.exp(off * off / q * -0.5) * (1 - odd) + odd)) / q
            starts = firsts(sizes)
            total = np.add.reduceat(w, starts)
            total[total == 0] = np.nan
            last[mine], g[mine], bulk[mine] = g[mine], np.add.reduceat(v * w, starts) / total, np.sqrt(1.0 / total)
    return g, bulk


def _line(w: np.ndarray, x: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Slope, level and their errors of weighted straight lines, and which groups have one."""
    starts = firsts(sizes)
    s, sx, sy, sxx, sxy, syy = (np.add.reduceat(t, starts) for t in (w, w * x, w * y, w * x * x, w * x * y, w * y * y))
    det = s * sxx - sx * sx
    slope, level = (s * sxy - sx * sy) / det, (sxx * sy - sx * sxy) / det
    scale = np.maximum(syy - slope * sxy - level * sy, 0.0) / (sizes - 2)
    return slope, level, np.sqrt(scale * s / det), np.sqrt(scale * sxx / det), det != 0


def slopes(w: np.ndarray, v: np.ndarray, e: np.ndarray, o: np.ndarray, sizes: np.ndarray, reference: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """level, level_err, slope, slope_err, crx, crx_err of each group (as rows), and which of them it has: see spectra.chromatic_slope."""
    out, has = np.full((6, len(sizes)), np.nan), np.zeros((6, len(sizes)), bool)
    with np.errstate(all="ignore"):
        vm, em = (np.repeat(middles(*known(c, sizes)), sizes) for c in (v, e))
        good = ~np.isnan(w) & ~np.isnan(o) & (np.abs(v - vm) < e * 10) & (e < em * 100)
        sizes = counted(good, sizes)
        mine = np.flatnonzero(sizes >= 3)
        good[good] = np.repeat(sizes >= 3, sizes)
        w, y, e, sizes = w[good], v[good] - o[good], e[good], sizes[mine]
        if not len(mine):
            return out, has
        starts = firsts(sizes)
        for k in np.flatnonzero(np.minimum.reduceat(e, starts) == 0):
            errors = e[starts[k] : starts[k] + sizes[k]]
            errors[:] = np.maximum(errors, np.percentile(errors, 1) / 2)
        x, ratio = w - reference, w / reference
        log = np.log(np.where(ratio > 0, ratio, np.nan))
        level = np.full(len(mine), np.inf)
        for i in range(rounds):
            weight = 1.0 / e
            if i:
                g = np.exp(((y - np.repeat(out[0, mine], sizes) - np.repeat(out[2, mine], sizes) * x) / e) ** 2 * -0.5)
                weight *= g * (1 + 1e-4) / (g + 1e-4)
            weight *= weight
            slope, new, slope_err, level_err, one = _line(weight, x, y, sizes)
            crx, _, crx_err, _, two = _line(weight, log, y, sizes)
            two &= ~np.isnan(np.add.reduceat(log, firsts(sizes)))
            out[:, mine], has[:, mine] = (new, level_err, slope, slope_err, crx, crx_err), (one, one, one, one, two, two)
            moving = (np.abs(new - level) >= level_err * 0.1) | (i == 0)
            level = new[moving]
            if not moving.all():
                go = np.repeat(moving, sizes)
                x, y, e, log, sizes, mine = x[go], y[go], e[go], log[go], sizes[moving], mine[moving]
            if not len(mine):
                break
    return out, has
