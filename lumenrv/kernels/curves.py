"""Small numerical helpers for arrays of one spectrum or one group: splines, filters, fits and tail probabilities."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np


def _basis(knots: np.ndarray, x: np.ndarray, degree: int) -> np.ndarray:
    """Values of all B-splines at x (n x m)."""
    local, first = _local_basis(knots, x, degree)
    out = np.zeros((len(x), len(knots) - degree - 1))
    out[np.arange(len(x))[:, None], first[:, None] + np.arange(degree + 1)] = local
    return out


def _local_basis(knots: np.ndarray, x: np.ndarray, degree: int) -> tuple[np.ndarray, np.ndarray]:
    """The degree + 1 B-splines that are not zero at each x (n x degree + 1) and the places of the first ones."""
    m = len(knots) - degree - 1
    span = np.clip(np.searchsorted(knots, x, "right") - 1, degree, m - 1)
    local = np.zeros((len(x), degree + 1))
    local[:, 0] = 1
    for d in range(1, degree + 1):
        grown = np.zeros_like(local)
        for r in range(d):
            right, left = knots[span + r + 1], knots[span + r + 1 - d]
            share = local[:, r] / np.where(right > left, right - left, 1)
            grown[:, r] += (right - x) * share
            grown[:, r + 1] += (x - left) * share
        local = grown
    return local, span - degree


class Spline:
    """Interpolating spline of degree 1 to 5 through points of ascending x; outside: extended, zero or constant.

    Knots are at inner points for odd degrees and half way between points for even ones. Points that are not finite go;
    too few of them give a spline that is NaN everywhere.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, degree: int = 3, outside: str = "extend"):
        known = np.isfinite(x) & np.isfinite(y)
        x, y = np.asarray(x, float)[known], np.asarray(y, float)[known]
        order = np.argsort(x, kind="stable")
        x, y = x[order], y[order]
        self.degree, self.outside, self.ok = degree, outside, len(x) > degree
        if not self.ok:
            return
        self.low, self.high = x[0], x[-1]
        if degree % 2:
            inner = x[(degree + 1) // 2 : len(x) - (degree + 1) // 2]
        else:
            middle = (x[1:] + x[:-1]) / 2
            inner = middle[degree // 2 : len(middle) - degree // 2]
        self.knots = np.concatenate([np.full(degree + 1, x[0]), inner, np.full(degree + 1, x[-1])])
        self.values = self._solve(x, y)

    def _solve(self, x: np.ndarray, y: np.ndarray, size: int = 64) -> np.ndarray:
        """Elimination by blocks of a band, without pivots between them: collocation matrices of splines are totally positive."""
        k, n = self.degree, len(x)
        if k == 1:  # hat functions: a coefficient is the value at its point
            return y
        if n <= 2 * size:
            return np.linalg.solve(_basis(self.knots, x, k), y)
        local, first = _local_basis(self.knots, x, k)
        column = first[:, None] + np.arange(k + 1)

        def rows(at: int, end: int, lo: int, hi: int) -> np.ndarray:
            out = np.zeros((end - at, hi - lo))
            out[np.arange(end - at)[:, None], column[at:end] - lo] = local[at:end]
            return out

        steps: list[tuple[np.ndarray, np.ndarray]] = []  # a block's values are h - g times the next block's first ones
        for at in range(0, n, size):
            end = min(at + size, n)
            lo, hi = max(at - k, 0), min(end + k, n)
            part, rest = rows(at, end, lo, hi), np.array(y[at:end], float)
            middle = part[:, at - lo : end - lo].copy()
            if at:
                g, h = steps[-1]
                before = part[:, : at - lo]
                middle[:, : g.shape[1]] -= before @ g[-(at - lo) :]
                rest -= before @ h[-(at - lo) :]
            done = np.linalg.solve(middle, np.concatenate([part[:, end - lo :], rest[:, None]], axis=1))
            steps.append((done[:, :-1], done[:, -1]))
        out, after = [], np.zeros(0)
        for g, h in reversed(steps):
            after = h - g @ after[: g.shape[1]]
            out.append(after)
        return np.concatenate(out[::-1])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float)
        if not self.ok:
            return np.full(x.shape, np.nan)
        inside = np.clip(x, self.low, self.high) if self.outside != "extend" else x
        flat = inside.ravel()
        m, k = len(self.values), self.degree
        span = np.clip(np.searchsorted(self.knots, flat, "right") - 1, k, m - 1)
        d = [self.values[span - k + r] for r in range(k + 1)]
        for r in range(1, k + 1):  # de Boor
            for j in range(k, r - 1, -1):
                left, right = self.knots[span - k + j], self.knots[span + 1 + j - r]
                a = (flat - left) / np.where(right > left, right - left, 1)
                d[j] = (1 - a) * d[j - 1] + a * d[j]
        out = d[k].reshape(x.shape)
        if self.outside == "zero":
            out = np.where((x < self.low) | (x > self.high), 0.0, out)
        return out


def low_pass(values: np.ndarray, width: int = 101, degree: int = 2) -> np.ndarray:
    """Spline through running medians of boxes of width, a quarter of it apart; missing values are skipped."""
    n, centre, median = len(values), [], []
    for low in range(-width // 2, n + width // 2, width // 4):
        a, b = max(low, 0), min(low + width, n - 1)
        part = values[a:b]
        known = part[np.isfinite(part)]
        if b - a >= 3 and len(known) >= 3:
            centre.append((a + b - 1) / 2)
            median.append(np.median(known))
    x, at = np.unique(centre, return_inverse=True)
    if len(x) < 3:
        return np.full(n, np.nan)
    y = np.bincount(at, median) / np.bincount(at)
    return Spline(x, y, degree, "constant")(np.arange(n))


def savitzky_golay(values: np.ndarray, width: int, order: int = 3, derivative: int = 0, step: float = 1.0) -> np.ndarray:
    """Local polynomial with Gaussian weights over three widths (odd number of places), reflected at the ends.

    Missing values take no part; where more than half of a window is missing the result is.
    """
    total = 3 * width + (3 * width + 1) % 2
    half = total // 2
    u = np.arange(-half, half + 1)
    weight = np.exp(-0.5 * (u / (width / (2 * math.sqrt(2 * math.log(2))))) ** 2)
    basis = u[:, None] ** np.arange(order + 1)
    padded = np.pad(values, half, mode="reflect")
    windows = np.lib.stride_tricks.sliding_window_view(padded, total)
    known = np.isfinite(windows)
    scale = math.factorial(derivative) / step**derivative
    whole = np.linalg.pinv(basis * weight[:, None]) * weight
    out = np.where(known, windows, 0) @ whole[derivative]
    for i in np.flatnonzero(~known.all(axis=1)):
        k = known[i]
        fit = np.linalg.lstsq(basis[k] * weight[k, None], windows[i][k] * weight[k], rcond=None)[0] if 2 * k.sum() >= total else None
        out[i] = np.nan if fit is None else fit[derivative]
    return out * scale


def robust_polynomial(x: np.ndarray, y: np.ndarray, degree: int, sigmas: float, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (highest first) and kept points of a polynomial without outliers.

    Each round fits the kept points and keeps, of all points, those whose residual is less than sigmas medians of all
    residuals (points can come back; with a median of 0 only exact ones stay), until no point that was fitted lies beyond.
    It ends as well when too few points would be left, or after rounds.
    """
    keep = np.isfinite(x) & np.isfinite(y)
    fit = np.full(degree + 1, np.nan)
    for _ in range(rounds):
        if keep.sum() <= degree:
            break
        fit = np.polyfit(x[keep], y[keep], degree)
        off = np.abs(y - np.polyval(fit, x))
        typical = np.nanmedian(off)
        share = np.divide(off, typical) if typical > 0 else np.where(off == 0, 0.0, np.where(np.isnan(off), np.nan, np.inf))
        most, keep = np.max(share[keep]), share < sigmas
        if most <= sigmas:
            break
    return fit, keep


def least_squares(model: Callable[..., np.ndarray], x: np.ndarray, y: np.ndarray, start: list[float], rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Parameters and covariance by Levenberg and Marquardt's method with numerical derivatives."""
    p, damp = np.array(start, float), 1e-3
    rest = y - model(x, *p)

    def slopes(p: np.ndarray) -> np.ndarray:
        step = 1e-6 * np.maximum(np.abs(p), 1e-6)
        return np.stack([(model(x, *(p + d)) - model(x, *(p - d))) / (2 * s) for s, d in zip(step, np.diag(step))], axis=1)

    j = slopes(p)
    for _ in range(rounds):
        a, g = j.T @ j, j.T @ rest
        move = np.linalg.lstsq(a + damp * np.diag(np.maximum(np.diag(a), 1e-30)), g, rcond=None)[0]
        after = y - model(x, *(p + move))
        if np.isfinite(after).all() and after @ after < rest @ rest:
            done = rest @ rest - after @ after < 1e-14 * (rest @ rest)
            p, rest, damp = p + move, after, damp / 5
            j = slopes(p)
            if done:
                break
        else:
            damp *= 4
            if damp > 1e14:
                break
    free = max(len(x) - len(p), 1)
    return p, np.linalg.pinv(j.T @ j) * (rest @ rest) / free


def odd_ratio_mean(value: np.ndarray, error: np.ndarray, odd: float = 2e-4, rounds: int = 10, converged: float = 1e-2) -> tuple[float, float]:
    """The outlier-resistant mean of one small group; operators.robust has it for groups of any size."""
    keep = np.isfinite(value) & np.isfinite(error)
    if not keep.any():
        return math.nan, math.nan
    v, q = value[keep], error[keep] ** 2
    mean, last, bulk = float(np.median(v)), math.inf, 1.0
    for _ in range(rounds):
        if not abs(mean - last) / bulk > converged:
            break
        last = mean
        w = (1 - odd / ((1 - odd) * np.exp(-0.5 * (v - mean) ** 2 / q) + odd)) / q
        mean, bulk = float((v * w).sum() / w.sum()), float(np.sqrt(1 / w.sum()))
    return mean, bulk


_LGAMMA = np.vectorize(math.lgamma, otypes=[float])


def _log_gamma(x: np.ndarray) -> np.ndarray:
    found, at = np.unique(x, return_inverse=True)
    return _LGAMMA(found)[at] if len(found) else np.zeros(0)


def _fraction(step: Callable[[int, np.ndarray], tuple[np.ndarray, np.ndarray]], first: np.ndarray, rounds: int) -> np.ndarray:
    """first / (b0 + a1 / (b1 + ...)) for many arguments at once by Lentz's method; step(i, places) gives a_i and b_i."""
    out, c, d = first.copy(), np.full(len(first), 1e300), first.copy()
    open_ = np.arange(len(first))
    for i in range(1, rounds):
        if not len(open_):
            break
        a, b = step(i, open_)
        d[open_] = 1 / (a * d[open_] + b)
        c[open_] = b + a / c[open_]
        factor = c[open_] * d[open_]
        out[open_] *= factor
        open_ = open_[np.abs(factor - 1) >= 1e-15]
    return out


def chi2_tails(x: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Chances that chi squared with k degrees of freedom exceeds x: a series below the mean, a continued fraction above."""
    a, x = np.asarray(k, float) / 2, np.asarray(x, float) / 2
    out = np.where(x <= 0, 1.0, np.nan)
    fine = np.isfinite(x) & np.isfinite(a) & (x > 0) & (a > 0)
    front = np.zeros(len(x))
    front[fine] = np.exp(a[fine] * np.log(x[fine]) - x[fine] - _log_gamma(a[fine]))
    low = np.flatnonzero(fine & (x < a + 1))
    term = 1 / a[low]
    total, open_, n = term.copy(), np.arange(len(low)), 0
    while len(open_):
        n += 1
        term[open_] *= x[low[open_]] / (a[low[open_]] + n)
        total[open_] += term[open_]
        open_ = open_[term[open_] > 1e-16 * total[open_]]
    out[low] = np.maximum(0.0, 1 - total * front[low])
    high = np.flatnonzero(fine & (x >= a + 1))
    start = x[high] + 1 - a[high]
    out[high] = front[high] * _fraction(lambda i, at: (-i * (i - a[high[at]]), start[at] + 2 * i), 1 / start, 10_000)
    return out


def chi2_tail(x: float, k: float) -> float:
    return float(chi2_tails(np.array([x]), np.array([k]))[0])


def _beta_shares(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta functions by their continued fraction, mirrored where that converges faster."""
    turn = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, 1 - x, x)
    inner = (x > 0) & (x < 1)
    y = np.where(inner, x, 0.5)
    front = np.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * np.log(y) + b * np.log1p(-y)) / a

    def step(i: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m, p, q, z = i // 2, a[at], b[at], y[at]
        odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
        return (odd if i % 2 else m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))), np.ones(len(at))

    share = np.where(inner, front * _fraction(step, np.ones(len(x)), 2000), (x >= 1).astype(float))
    return np.where(turn, 1 - share, share)


def correlation_ps(r: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Two-sided chances of a correlation coefficient of r or more in n independent pairs."""
    fine = np.isfinite(r) & (n > 2)
    out = np.full(len(r), np.nan)
    out[fine] = _beta_shares((n[fine] - 2) / 2, np.full(fine.sum(), 0.5), np.maximum(0.0, 1 - r[fine] ** 2))
    return out


def correlation_p(r: float, n: int) -> float:
    return float(correlation_ps(np.array([r], float), np.array([n], float))[0])
