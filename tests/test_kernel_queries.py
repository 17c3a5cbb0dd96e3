"""Queries without SQL: every one is collected on the smallest tables, those of kernels are compared with plain numpy."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenrv.kernels import curves, profiles
from lumenrv.plans import catalog, kernels

SF = "/root/testdata/sf0.001"
WITHOUT = sorted(set(catalog.queries()) - set(catalog.oracle_sql()))
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def arrays(spark):
    return {r.exposure: (np.array(r.x, float), np.array(r.flux, float)) for r in kernels.arrays(spark, SF).collect()}


def plain_spline(x, y, at, degree):
    """Interpolation by a dense system of truncated powers (well conditioned for few points only)."""
    mid = (x[1:] + x[:-1]) / 2
    inner = x[(degree + 1) // 2 : len(x) - (degree + 1) // 2] if degree % 2 else mid[degree // 2 : len(mid) - degree // 2]
    scale = (x[-1] - x[0]) / 2
    u, v, k = ((z - x[0]) / scale - 1 for z in (x, at, inner))
    basis = lambda z: np.concatenate([np.polynomial.chebyshev.chebvander(z, degree), np.maximum(z[:, None] - k, 0) ** degree], axis=1)
    return basis(v) @ np.linalg.lstsq(basis(u), y, rcond=None)[0]


def plain_savgol(y, width, order, derivative):
    total = 3 * width + (3 * width + 1) % 2
    half = total // 2
    weight = [math.exp(-0.5 * (k / (width / 2.3548200450309493)) ** 2) for k in range(-half, half + 1)]
    out = []
    for i in range(len(y)):
        at = [abs(i + k) if i + k < len(y) else 2 * (len(y) - 1) - i - k for k in range(-half, half + 1)]
        known = [(k, y[j], w) for k, j, w in zip(range(-half, half + 1), at, weight) if not math.isnan(y[j])]
        if 2 * len(known) < total:
            out.append(math.nan)
            continue
        u, v, w = (np.array(z, float) for z in zip(*known))
        out.append(np.polyfit(u, v, order, w=w)[::-1][derivative] * math.factorial(derivative))
    return np.array(out)


def close(got, want, tol=1e-6):
    got = np.array([math.nan if v is None else v for v in got], float)
    return np.allclose(got, want, rtol=tol, atol=tol, equal_nan=True)


def test_splines(spark):
    known = arrays(spark)
    for r in catalog.queries()["spline_eval"](spark, SF).collect()[:60]:
        x, y = known[r.exposure]
        ok = np.isfinite(y)
        assert close(r.between, plain_spline(x[ok], y[ok], np.arange(63) + 0.5, 3), 1e-5)


@pytest.mark.parametrize("degree", [1, 2, 3, 5])
def test_long_splines_are_solved_by_blocks(degree):
    rng = np.random.default_rng(degree)
    x = np.cumsum(rng.uniform(0.5, 1.5, 1000))
    y = np.sin(x / 7) + rng.normal(0, 0.1, 1000)
    s = curves.Spline(x, y, degree)
    assert np.allclose(s(x), y, atol=1e-9)
    assert np.allclose(s.values, np.linalg.solve(curves._basis(s.knots, x, degree), y), atol=1e-8)


def test_low_pass(spark):
    known = arrays(spark)
    for r in catalog.queries()["lowpass_spline"](spark, SF).collect()[:60]:
        y = known[r.exposure][1]
        held = {}
        for low in range(-11, 64 + 10, 5):
            at = [i for i in range(max(low, 0), min(low + 21, 63))]
            v = [y[i] for i in at if not math.isnan(y[i])]
            if len(at) >= 3 and len(v) >= 3:
                held.setdefault((at[0] + at[-1]) / 2, []).append(np.median(v))
        x = np.array(sorted(held))
        want = plain_spline(x, np.array([np.mean(held[c]) for c in x]), np.clip(np.arange(64.0), x[0], x[-1]), 2)
        assert close(r.smooth, want, 1e-5)


def test_savitzky_golay_with_gaps(spark):
    known = arrays(spark)
    rows = catalog.queries()["savgol_nan"](spark, SF).collect()
    for r in [*rows[:12], *(r for r in rows if r.exposure % 50 == 0)][:24]:
        y = known[r.exposure][1]
        assert close(r.smooth, plain_savgol(y, 5, 3, 0)) and close(r.slope, plain_savgol(y, 5, 3, 1))


def test_polynomials_without_outliers(spark):
    known = arrays(spark)
    for r in catalog.queries()["robust_polyfit"](spark, SF).collect()[:60]:
        x, y = known[r.exposure]
        keep = np.isfinite(y)
        for _ in range(100):
            fit = np.polynomial.polynomial.polyfit(x[keep], y[keep], 2)
            off = np.abs(y - np.polynomial.polynomial.polyval(x, fit))
            n = off / np.median(off[np.isfinite(off)])
            most, keep = n[keep].max(), n < 4
            if most <= 4:
                break
        assert close(r.coefficients[::-1], fit)


def test_points_come_back_into_a_fit():
    x = np.arange(40.0)
    y = 2 * x + np.random.default_rng(1).normal(0, 0.1, 40)
    y[5] += 1000
    fit, keep = curves.robust_polynomial(x, y, 1, 5)
    assert fit == pytest.approx([2, 0], abs=0.1) and not keep[5] and keep.sum() >= 38
    exact, held = curves.robust_polynomial(x, np.where(x == 3, 9.0, 1.0), 0, 5)
    assert held.sum() in (0, 39) and np.isfinite(exact).all()


def test_tail_probabilities(spark):
    rng = np.random.default_rng(0)
    for r in catalog.queries()["chi2_probability"](spark, SF).collect()[:40]:
        m, x = r.n // 2, r.chi2 / 2  # an even number of degrees: a finite sum
        assert r.n % 2 == 0 and r.p == pytest.approx(sum(math.exp(k * math.log(x) - x - math.lgamma(k + 1)) for k in range(m)), rel=1e-9, abs=1e-15)
    for r in catalog.queries()["pearson_probability"](spark, SF).collect()[:10]:
        n = r.n - 2
        t = abs(r.r) * math.sqrt(n / (1 - r.r**2))
        u = np.linspace(0, math.atan(t / math.sqrt(n)), 20_001)  # Student's density by its angle
        density = np.cos(u) ** (n - 1) * math.exp(math.lgamma((n + 1) / 2) - math.lgamma(n / 2)) / math.sqrt(math.pi)
        assert r.p == pytest.approx(1 - 2 * np.trapezoid(density, u), abs=1e-6)
    assert curves.chi2_tails(rng.uniform(0, 5, 0), np.zeros(0)).shape == (0,)


def test_blazes(spark):
    rows = catalog.queries()["blaze_norm"](spark, SF).toPandas()
    from lumenrv.plans.surrogates import spectra

    blaze = spectra(spark, SF).withColumn("exposure", F.col("exposure") % 25).groupBy("exposure", "ord", "pixel").agg(F.avg("flux").alias("b"), F.avg(F.col("wave") + F.col("ord") * 40).alias("w")).toPandas()
    assert len(rows) == len(blaze)
    for k in (0, 7, 20):
        mine = blaze[blaze.exposure == k]
        peaks = [(m.w[m.b > np.percentile(m.b, 95)].mean(), m.b[m.b > np.percentile(m.b, 95)].mean()) for _, m in mine.groupby("ord")]
        x, y = np.log(np.array(sorted(peaks))).T
        fit, _ = curves.robust_polynomial(x, y, 2, 5.0)
        got = rows[rows.exposure == k].merge(mine, on=["ord", "pixel"])
        assert close(got.blaze_norm, got.b / np.exp(np.polyval(fit, np.log(got.w))), 1e-5)


def test_known_velocities_come_back(spark):
    q = catalog.queries()
    rows = q["systemic_velocity"](spark, SF).collect()
    off = np.array([r.vsys - r.known for r in rows])
    assert len(rows) == 25 and np.std(off) < 25 and all(r.good and r.snr > 7 for r in rows)
    rows = q["mask_recipe"](spark, SF).collect()
    assert len(rows) == 25 and np.std([r.velocity * 1000 + r.known for r in rows]) < 200
    rows = q["template_loop"](spark, SF).collect()
    assert len(rows) == 25 and np.std([r.velocity - r.known for r in rows]) < 60
    rows = q["compute_rv_synthetic"](spark, SF).collect()
    assert rows and all(abs(r.vrad - r.known) < 5 * r.svrad + 1 for r in rows)
    assert q["telluric_correction"](spark, SF).count() > 0


def test_every_query_is_collected(spark):
    assert {"lowpass_spline", "savgol_nan", "template_loop"} <= set(WITHOUT)
    for name in set(WITHOUT) - {"systemic_velocity", "mask_recipe", "template_loop", "compute_rv_synthetic", "telluric_correction"}:
        rows = catalog.queries()[name](spark, SF).collect()
        assert rows, name


def test_profiles():
    x = np.linspace(-50, 50, 401)
    y = profiles.shouldered(x, 3.0, 10.0, 0.4, 3.0, 2.0)
    assert profiles.vertex(x, y) == pytest.approx(3.0, abs=0.01)
    curve = lambda u: 1 + 0.2 * np.sin(u / 5) + 0.1 * np.sin(u / 3.3) + 0.1 * np.sin(u / 11)
    at = np.arange(600.0)
    assert profiles.best_shift(curve(at - 7), curve(at)) == pytest.approx(-7, abs=0.2)
    assert profiles.best_shift(curve(at + 3.4), curve(at)) == pytest.approx(3.4, abs=0.3)


def test_percentiles_of_groups_of_any_size(spark):
    from lumenrv.operators import robust

    rng = np.random.default_rng(8)
    rows = [(k, float(v)) for k, n in ((0, 1), (1, 2), (2, 10), (3, 999), (4, 30_000)) for v in rng.normal(size=n)] + [(5, float(i % 3)) for i in range(25_000)] + [(None, 2.0), (7, float("nan"))]
    df, shares = spark.createDataFrame(rows, "k int, v double").repartition(3), (0.0, 0.16, 0.5, 0.84, 0.995, 1.0)
    got = {r.k: r.p for r in robust.exact_percentiles(df, ["k"], "v", shares).collect()}
    assert got.keys() == {0, 1, 2, 3, 4, 5, None}
    for k, p in got.items():
        assert p == pytest.approx(np.percentile([v for j, v in rows if j == k], [100 * s for s in shares]))


def test_tables_there_and_back(spark, tmp_path):
    from lumenrv.sources import fits, tables

    lines = spark.createDataFrame([(1, 500.0, -1.0), (2, 501.0, 0.0), (3, 502.0, 2.0)], "line int, wave double, weight double")
    tables.write_masks(lines, f"file://{tmp_path}/masks")
    got = spark.read.parquet(f"{tmp_path}/masks").groupBy("mask_type").agg(F.count("*").alias("n")).collect()
    assert {r.mask_type: r.n for r in got} == {"full": 3, "pos": 1, "neg": 1}
    for name in ("A", "B", "A"):
        tables.write_lines(lines, f"file://{tmp_path}/lines", name, "T")
    assert tables.read_lines(spark, f"file://{tmp_path}/lines", "A", "T").count() == 3
    ref = spark.createDataFrame([(0, 1.0, 2.0, 3.0, 4.5), (1, 2.0, 3.0, None, 9.0)], tables.REFERENCE)
    tables.write_reference(ref, f"file://{tmp_path}/ref")
    assert sorted(map(tuple, tables.read_reference(spark, f"file://{tmp_path}/ref").collect())) == sorted(map(tuple, ref.collect()))
    images = spark.createDataFrame([("a.fits", {"OBJECT": "it's é", "ESO INS LONG KEY": "7"}, [[1.0, 2.0], [3.0, float("nan")]])], "name string, header map<string,string>, pixels array<array<double>>")
    assert tables.write_images(images, f"file://{tmp_path}/images").collect()[0].bytes % 2880 == 0
    back = fits.read_images(spark, f"file://{tmp_path}/images").orderBy("row").collect()
    assert [r.pixels for r in back] == [[1.0, 2.0], [3.0, None]]
    header = fits.read_headers(spark, f"file://{tmp_path}/images").filter("unit = 1").collect()[0].header
    assert header["OBJECT"] == "it's" and header["ESO INS LONG KEY"] == "7"
    with pytest.raises(FileNotFoundError):
        tables.required(lines.limit(0), "lines")


def test_nightly_and_drift_tables(spark):
    from lumenrv.operators import compiled

    rows = [(1, "a", 10.0, 1.0, 0.5, 0.1, 3.0, "F"), (1, "b", 20.0, 2.0, None, 0.1, None, "O"), (2, "c", 5.0, 1.0, 0.7, 0.2, 4.0, "O")]
    table = spark.createDataFrame(rows, "night int, name string, vrad double, svrad double, contrast double, sig_contrast double, other double, kind string")
    assert compiled.paired_columns(table) == {"vrad": "svrad", "contrast": "sig_contrast"}
    one, two = compiled.nightly_table(table, "night", "name").orderBy("night").collect()
    assert (one.vrad, one.svrad) == pytest.approx((12.0, math.sqrt(0.8))) and one.contrast == pytest.approx(0.25) and one.other is None and one.name == "a"
    assert two.other == 4.0
    drift = {r.name: r for r in compiled.drift_table(table, "night", F.col("kind") == "F", ["name"]).collect()}
    assert drift["b"].vrad == 10.0 and drift["b"].svrad == pytest.approx(math.sqrt(5)) and drift["c"].vrad is None
    fixed = {r.name: r for r in compiled.corrected_table(table, spark.createDataFrame([(1, 3.0, 4.0)], "night int, vrad double, svrad double"), "night").collect()}
    assert fixed["a"].vrad == 7.0 and fixed["a"].svrad == pytest.approx(math.sqrt(17)) and fixed["a"].contrast == 0.5 and fixed["c"].vrad is None


def test_functions_by_name(spark):
    from lumenrv.functions.register import register

    assert set(register(spark)) >= {"doppler_shift", "chi2_tail"}
    row = spark.sql("SELECT doppler_shift(1000D, 299792.458D) AS a, chi2_tail(3.841458820694124D, 1D) AS b, correlation_p(0.5D, 20D) AS c, finite(double('NaN')) AS d, fwhm(1D) AS e, gauss(1D, 2D, 1D, 3D, 0.5D) AS f").collect()[0]
    assert (row.a, row.b, row.c, row.e, row.f) == pytest.approx((1000 * math.sqrt(0.999 / 1.001), 0.05, 0.024769, 2.354820, 2.5), rel=1e-4) and row.d is None
