"""Convolution, correlation and exponents by blocks against plain numpy, at several widths of a block."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenrv.operators import halos
from lumenrv.plans import axes, catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("width", [3, 16, 4096])
@pytest.mark.parametrize("size", [1, 2, 7, 40])
def test_convolution_equals_numpy(spark, width, size):
    rng = np.random.default_rng(size)
    kernel, rows, x = rng.normal(size=size), [], {}
    for k, n in (("a", 90), (None, 50)):
        x[k] = rng.normal(size=n)
        x[k][13] = np.nan
        gap = set(range(30, 36)) if k == "a" else set()
        rows += [(k, i, None if np.isnan(v) else float(v), "z") for i, v in enumerate(x[k]) if i not in gap]
        x[k][sorted(gap)] = 0.0
    df = spark.createDataFrame([*rows, ("a", None, 1.0, "z")], "k string, i int, v double, block string")
    got = halos.convolved(df, ["k"], "i", "v", kernel.tolist(), width=width).collect()
    assert len(got) == len(rows)
    for r in got:
        pad = np.concatenate([np.zeros(60), x[r.k], np.zeros(60)])
        want = np.convolve(pad, kernel, "same")[60 + r.i]
        assert (math.nan if r.convolved is None else r.convolved) == pytest.approx(want, abs=1e-9, nan_ok=True)
    assert halos.convolved(df.limit(0), ["k"], "i", "v", kernel.tolist()).collect() == []


@pytest.mark.parametrize("width", [5, 64])
def test_correlation_equals_numpy(spark, width):
    rng = np.random.default_rng(2)
    x = {k: rng.normal(size=n) for k, n in (("a", 70), ("b", 20))}
    w = {int(i): float(v) for i, v in zip(rng.choice(80, 12, replace=False), rng.normal(size=12))}
    df = spark.createDataFrame([(k, i, float(v)) for k, xs in x.items() for i, v in enumerate(xs)] + [("a", 3, None)], "k string, i int, v double")
    t = spark.createDataFrame(list(w.items()), "i int, w double")
    got = {r.k: r.ccf for r in halos.correlated(df, t, ["k"], "i", "v", "w", 9, width=width).collect()}
    for k, xs in x.items():
        want = [sum(v * xs[i + s] for i, v in w.items() if 0 <= i + s < len(xs)) for s in range(-9, 10)]
        assert got[k] == pytest.approx(want)


def test_planted_shifts_come_back(spark):
    rng = np.random.default_rng(4)
    n, step = 3000, 500.0
    lines = np.sort(rng.choice(np.arange(150, n - 150), 120, replace=False))
    rows, planted = [], {1: 3.3, 2: -7.6, 3: 0.0}
    for e, shift in planted.items():
        i = np.arange(n)
        y = 1 - 0.4 * np.exp(-0.5 * ((i[:, None] - lines - shift) / 2.5) ** 2).sum(axis=1) + rng.normal(0, 0.02, n)
        rows += [(e, int(k), float(v)) for k, v in zip(i, y)]
    rows += [(4, int(k), float(v)) for k, v in enumerate(rng.normal(1, 0.02, n))]
    df = spark.createDataFrame(rows, "e int, i int, v double")
    mask = spark.createDataFrame([(int(k), 1.0) for k in lines], "i int, w double")
    got = {r.e: r for r in halos.rough_velocity(df, mask, ["e"], "i", "v", "w", step=step, reach=60, filter_width=60, width=512).collect()}
    for e, shift in planted.items():
        assert got[e].ok and got[e].velocity == pytest.approx(shift * step, abs=0.3 * step)
    assert not got[4].ok


def test_planted_exponents_come_back(spark):
    rows = catalog.queries()["air_exponents"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert all(abs(r.water - r.known_water) < 0.1 and abs(r.others - r.known_others) < 0.1 and r.rounds < 12 for r in rows)
    assert np.std([r.water - r.known_water for r in rows]) < 0.02


def test_smoothed_air_and_exposures_without_lines(spark):
    kernel = [0.25, 0.5, 0.25]
    i = np.arange(64)
    air = {s: 1 - 0.5 * sum(np.exp(-0.5 * ((i - c) / 1.2) ** 2) for c in cs) for s, cs in (("water", axes.WATER), ("others", axes.OTHERS))}
    rows = []
    for e, (a, b) in enumerate([(0.6, 1.3), (2.5, 0.4), (1.0, 1.0)]):
        t = np.log(np.stack([air["water"], air["others"]]))
        raw = np.exp(a * t[0] + b * t[1])
        pad = np.concatenate([[1.0], raw, [1.0]])
        rows += [(e, int(k), float(v)) for k, v in zip(i, pad[:-2] * 0.25 + pad[1:-1] * 0.5 + pad[2:] * 0.25)]
    rows += [(9, int(k), None) for k in i]
    mask = lambda centres: [sum(-1.0 if k == c else 0.5 if abs(k - c) == 4 else 0.0 for c in centres) for k in i]
    grid = spark.createDataFrame([(int(k), float(air["water"][k]), float(air["others"][k]), mask(axes.WATER)[k], mask(axes.OTHERS)[k]) for k in i], "i int, w double, o double, mw double, mo double")
    got = {r.e: r for r in halos.air_exponents(spark.createDataFrame(rows, "e int, i int, f double"), grid, ["e"], "i", "f", {"water": "w", "others": "o"}, {"water": "mw", "others": "mo"}, kernel=kernel, bounds={"water": (0.01, 15.0), "others": (0.05, 15.0)}).collect()}
    assert [(got[e].water, got[e].others) for e in range(3)] == [pytest.approx(p, abs=1e-3) for p in [(0.6, 1.3), (2.5, 0.4), (1.0, 1.0)]]
    assert 9 not in got


def test_vertex(spark):
    row = spark.createDataFrame([([0.0, 3.0, 5.0, 4.0],)], "y array<double>").select(halos.peak_vertex(F.col("y"), F.lit(2)).alias("v"), halos.peak_vertex(F.col("y"), F.lit(0)).alias("e")).first()
    assert row.v == pytest.approx(2 + (3 - 4) / (2 * (3 - 10 + 4))) and row.e == 0.0
