"""Kernels over many groups at once, and the passes that large groups take."""

import numpy as np
import pytest

from lumenrv.kernels import curves, groups
from lumenrv.operators import robust


@pytest.mark.parametrize("about", [False, True])
@pytest.mark.parametrize("size", [3, 200])
def test_means_of_many_groups_equal_those_of_each(about, size):
    rng = np.random.default_rng(4)
    sizes = np.append(rng.integers(1, size, 40), [0, 1])
    v = rng.normal(3, 1, sizes.sum()) + 40 * (rng.random(sizes.sum()) < 0.05) * (size > 3)
    q = rng.uniform(0.5, 2, len(v))
    q[::9] = np.nan
    means, errs = groups.robust_means(v, q, sizes, 2e-4, 10, 1e-2, about)
    ends = np.append(0, np.cumsum(sizes))
    for i, (a, b) in enumerate(zip(ends, ends[1:])):
        if not np.isfinite(q[a:b]).any():
            assert np.isnan(means[i]) and np.isnan(errs[i])
        else:
            assert (means[i], errs[i]) == pytest.approx(curves.odd_ratio_mean(v[a:b] - (np.median(v[a:b]) if about else 0), np.sqrt(q[a:b])), rel=1e-9, abs=1e-12)


def test_slices_hold_every_group_once():
    sizes = np.array([5, 0, 9, 30, 1, 1, 0])
    assert list(groups.slices(sizes, 10)) == [(0, 2), (2, 3), (3, 4), (4, 7)]


def test_several_pairs_of_large_groups_take_the_passes_of_one(spark, monkeypatch):
    df = spark.createDataFrame([(i % 2, float(i % 37), 1.0 + i % 3) for i in range(400)], "k int, v double, e double")
    written = []
    monkeypatch.setattr(robust, "materialize", lambda t, f=robust.materialize: written.append(1) or f(t))
    passes = []
    for n in (1, 3):
        written.clear()
        got = robust.robust_means(df, ["k"], [("v", "e", f"m{i}", f"s{i}") for i in range(n)], gathered=50).collect()
        passes.append(len(written))
        assert all(r.m0 == r[f"m{n - 1}"] for r in got)
    assert passes[0] == passes[1]
