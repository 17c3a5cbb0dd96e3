"""Running values, bracketing joins, sweeps and sums over lines against plain Python, with keys that span many blocks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenrv.operators import intervals, ordered


def keyed(rng, n=400):
    """Half of the rows have one key, some have none."""
    return [(("hot" if i % 2 else None if i % 10 == 0 else f"k{i % 7}"), float(rng.integers(0, 60)), i, None if i % 5 == 0 else float(rng.normal())) for i in range(n)]


@pytest.mark.parametrize("blocks", [1, 5, 40])
@pytest.mark.parametrize("backwards", [False, True])
def test_running_values_equal_a_loop(spark, blocks, backwards):
    rows = keyed(np.random.default_rng(5))
    df = spark.createDataFrame(rows, "k string, x double, i int, v double")
    laid = ordered.in_blocks(df, ["k"], ["x", "i"], blocks)
    got = ordered.running(laid, ["k"], ["x", "i"], sums={"s": F.col("v"), "n": F.lit(1)}, lasts={"l": F.col("v")}, before={"b": F.col("v")}, backwards=backwards)
    got = {r.i: (r.s, r.n, r.l, r.b) for r in got.collect()}
    assert len({r["__block"] for r in laid.select("__block").distinct().collect()}) > blocks // 2
    for k in {r[0] for r in rows}:
        s, last = None, None
        for n, (_, _, i, v) in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]), reverse=backwards)):
            before = last
            s, last = (s, last) if v is None else ((s or 0) + v, v)
            assert got[i] == (None if s is None else pytest.approx(s), n + 1, last, before)


@pytest.mark.parametrize("blocks", [1, 30])
def test_bracketing_equals_brute_force(spark, blocks):
    rng = np.random.default_rng(6)
    points = [(k, None if i % 17 == 0 else x, i, "p") for k, x, i, _ in keyed(rng)] + [("none", 3.0, 1000, "p"), ("hot", -9.0, 1001, "p"), ("hot", 99.0, 1002, "p"), ("hot", 5.0, 1003, "p"), ("hot", 5.0, 1003, "p")]
    steps = [(k, x * 1.5, i) for k, x, i, _ in keyed(rng, 150)] + [("hot", None, 999)]
    p = spark.createDataFrame(points, "k string, x double, i int, before string")
    got = ordered.bracketed(p.withColumnRenamed("before", "kind"), spark.createDataFrame(steps, "k string, x double, i int"), ["k"], "x", ["x", "i"], blocks=blocks).collect()
    assert len(got) == len(points)
    for r in got:
        mine = [(x, i) for k, x, i in steps if k == r.k and x is not None]
        low, high = ([z for z in mine if z[0] <= r.x], [z for z in mine if z[0] > r.x]) if r.x is not None else ([], [])
        assert (r.before and tuple(r.before)) == (max(low) if low else None)
        assert (r.after and tuple(r.after)) == (min(high) if high else None)


def test_empty_sides(spark):
    p, s = spark.createDataFrame([("a", 1.0)], "k string, x double"), spark.createDataFrame([("a", 1.0, 2)], "k string, x double, i int")
    assert ordered.bracketed(p.limit(0), s, ["k"], "x", ["i"]).collect() == []
    assert ordered.bracketed(p, s.limit(0), ["k"], "x", ["i"]).first()["before"] is None


@pytest.mark.parametrize("blocks, gathered", [(1, 0), (25, 0), (25, 60), (None, 10_000)])
def test_means_over_intervals_equal_brute_force(spark, blocks, gathered):
    """Very many intervals hold a point; ends and points meet at equal places."""
    rng = np.random.default_rng(7)
    points = [(k, None if i % 19 == 0 else x, i) for k, x, i, _ in keyed(rng)] + [("hot", 10.0, 5000)] * 3
    table = [(k, x - (10 if i % 3 else 40), x + (10 if i % 4 else -15), v) for k, x, i, v in keyed(rng, 500)] + [("hot", 10.0, 10.0, 1e6), ("hot", 12.0, 10.0, 1e6), ("hot", None, 5.0, 1e6), (None, 0.0, 50.0, 1.0)]
    p, t = spark.createDataFrame(points, "k string, x double, i int"), spark.createDataFrame(table, "o string, low double, high double, v double")
    got = intervals.interval_means(p, t, "k", "o", "x", "low", "high", {"v": "m"}, blocks=blocks, gathered=gathered).collect()
    assert len(got) == len(points)
    for r in got:
        held = [v for o, a, b, v in table if o is not None and o == r.k and None not in (a, r.x) and a < r.x < b and v is not None]
        assert r.m == (pytest.approx(np.mean(held), abs=1e-9) if held else None)


def slow_line(wave, science, model, rms, vector, start, end, least=5):
    a, z = np.searchsorted(wave, start, "right") - 1, np.searchsorted(wave, end, "right") - 1
    if a < 0 or z > len(wave) - 2 or z - a < least:
        return None
    w = np.ones(z - a + 1)
    if wave[a] < start:
        w[0] = 1 - (wave[a + 1] - start) / (wave[a + 1] - wave[a])
    if wave[z + 1] > end:
        w[-1] = 1 - (end - wave[z]) / (wave[z] - wave[z - 1])
    m, v = model[a : z + 1], vector[a : z + 1] * w
    if np.isnan(m).any() or (m <= 0).any() or np.isnan(rms[a : z + 1]).any():
        return None
    diff, mean = (science[a : z + 1] - m) * w, np.sum(rms[a : z + 1] * w) / w.sum()
    c = m - m.mean()
    known = np.isfinite(diff)
    return (np.sum(diff * v) / np.sum(v**2), mean / math.sqrt(np.sum(v**2)), 1 + np.sum(diff * c) / np.sum(c**2), mean / math.sqrt(np.sum(c**2)), len(diff),
            np.sum(w * np.arange(a, z + 1)) / w.sum(), np.nansum((diff / mean) ** 2), np.nanstd(diff) / mean, known.mean())


@pytest.mark.parametrize("blocks", [1, 20])
def test_sums_over_lines_equal_sums_over_pixels(spark, blocks):
    """Many lines a pixel and many pixels a line, over blocks that cut orders."""
    rng = np.random.default_rng(9)
    pixels, lines, orders = [], [], {}
    for exposure, n in ((1, 300), (2, 40), (None, 60)):
        wave = 500 + np.cumsum(rng.uniform(0.5, 1.5, n))
        science, model, rms, vector = rng.normal(1, 0.1, n), rng.uniform(0.5, 1.5, n), rng.uniform(0.1, 0.2, n), rng.normal(size=n)
        science[30], model[20], rms[25], model[10] = np.nan, np.nan, np.nan, -1.0
        orders[exposure] = (wave, science, model, rms, vector)
        none = lambda x: None if np.isnan(x) else float(x)
        pixels += [(exposure, i, *(none(x) for x in row)) for i, row in enumerate(zip(*orders[exposure]))]
        for _ in range(150):
            start = rng.choice([rng.uniform(495, wave[-1] + 3), rng.choice(wave)])
            lines.append((exposure, float(start), float(start + rng.choice([1.0, 6.5, 9.0, 30.0]))))
        lines.append((exposure, float(wave[31]), float(wave[38])))
    lines += [(7, 500.0, 600.0), (1, None, 510.0)]
    p = spark.createDataFrame(pixels, "exposure int, pixel int, wave double, science double, model double, rms double, d1 double")
    n = spark.createDataFrame(lines, "exposure int, start double, end double").withColumn("dv_note", F.lit("x"))
    got = ordered.line_sums(n, p, ["exposure"], vectors={"dv": "d1"}, blocks=blocks).collect()
    assert len(got) == len(lines)
    seen = 0
    for r in got:
        want = slow_line(*orders[r.exposure], r.start, r.end) if r.exposure in orders and r.start is not None else None
        mine = (r.dv, r.sdv, r.contrast, r.sig_contrast, r.n_pixels, r.mean_pixel, r.chi2, r.rms_ratio, r.frac_valid)
        if want is None:
            assert mine == (None,) * 9
        else:
            seen += 1
            assert [math.nan if x is None else x for x in mine] == pytest.approx(want, rel=1e-6, abs=1e-9, nan_ok=True)
    assert seen > 100


def test_bins_of_velocities_over_blocks(spark):
    from lumenrv.operators import orders

    rows = [(k, x, i) for k, x, i, _ in keyed(np.random.default_rng(11), 300)]
    df = spark.createDataFrame(rows, "object string, berv double, exposure int")
    got = {g: sorted((r.object or "", r.exposure, r.bin) for r in orders.velocity_bins(df, ["object"], "berv", 7, gathered=g, blocks=9).collect()) for g in (100_000, 20)}
    assert got[20] == got[100_000]
    hot = sorted((x, i) for k, x, i in rows if k == "hot")
    assert {(i, n * 7 // len(hot)) for n, (_, i) in enumerate(hot)} == {(e, b) for o, e, b in got[20] if o == "hot"}


def test_templates_there_and_back(spark, tmp_path):
    from lumenrv.sources import tables

    t, s = spark.createDataFrame([(1, 0.5)], "i int, flux double"), spark.createDataFrame([("a.fits", 60000.5)], "FILENAME string, MJD double")
    for _ in range(2):
        tables.write_template(t, s, f"file://{tmp_path}", "GL699")
    back = tables.read_template(spark, f"file://{tmp_path}", "GL699")
    assert [tuple(x.first()) for x in back] == [(1, 0.5), ("a.fits", 60000.5)]


def test_line_sums_behind_missing_pixels_at_the_start(spark):
    """The running sums of an order are null until a first pixel is known; a line without any science has no chi squared."""
    wave = [1000 + 0.5 * i for i in range(40)]
    rows = [(1, i, w, None if i < 12 else 1.0 + 0.01 * i, 1.0 + 0.1 * (i % 3), 0.1 if i >= 1 else None, 0.3 * (i % 5 + 1)) for i, w in enumerate(wave)]
    p = spark.createDataFrame(rows, "exposure int, pixel int, wave double, science double, model double, rms double, d1 double")
    n = spark.createDataFrame([(1, 1, 1004.2, 1009.3), (1, 2, 1001.0, 1005.2)], "exposure int, line int, start double, end double")
    some, none = ordered.line_sums(n, p, ["exposure"], vectors={"dv": "d1"}, blocks=2).orderBy("line").collect()
    w = [1 - (1004.5 - 1004.2) / 0.5] * 0 + [1.0] * 11
    w[0], w[-1] = 1 - (1004.5 - 1004.2) / 0.5, 1 - (1009.3 - 1009.0) / 0.5
    chi2 = sum((w[i - 8] * (rows[i][3] - rows[i][4]) / 0.1) ** 2 for i in range(12, 19))
    assert some.n_pixels == 11 and some.dv is None and some.chi2 == pytest.approx(chi2) and some.rms_ratio > 0
    assert none.n_pixels == 9 and none.frac_valid == 0 and none.chi2 is None and none.rms_ratio is None


def test_points_in_arrays(spark):
    a = spark.createDataFrame([(1, 0, [1.0, 3.0, 2.0, None, 5.0]), (2, 0, None), (3, 1, [1.0])], "key long, grp int, v array<double>")
    p = spark.createDataFrame([(10, 0, 2.5), (11, 0, 0.5), (12, 0, 5.0), (13, 0, None)], "point long, grp int, at double")
    for many in (1, 256):
        got = {(r.key, r.point): tuple(r)[3:] for r in ordered.bracketed_in_arrays(a, p, "grp", key="key", values="v", point="point", at="at", many=many).collect()}
        assert got == {
            (1, 10): (2, 1, 2.0, 3.0), (1, 11): (None, 0, None, 1.0), (1, 12): (4, None, 5.0, None), (1, 13): (None,) * 4,
            **{(2, k): (None,) * 4 for k in (10, 11, 12, 13)},
        }
