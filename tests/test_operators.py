import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenrv.functions import spectral, times
from lumenrv.kernels import curves
from lumenrv.functions import headers
from lumenrv.operators import intervals, orders, robust, sequences, spectra, telluric, velocity
from lumenrv.plans import instruments
from lumenrv.plans.kernels import synthetic_absorbed, synthetic_air, synthetic_template

NAN = float("nan")


def test_robust_mean_both_ways_equal_the_kernel(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(6):
        for i in range(200):
            v = rng.normal(k, 1) + (50 if rng.random() < 0.05 else 0)
            rows.append((k if k < 5 else None, NAN if i % 13 == 0 else float(v), float(1 + i % 3), "x"))
    rows += [(7, NAN, 1.0, "x"), (8, 3.0, None, "x")]
    df = spark.createDataFrame(rows, "k int, v double, e double, mean string")
    want = {}
    for k in {r[0] for r in rows}:
        mine = [(r[1], math.nan if r[2] is None else r[2]) for r in rows if r[0] == k]
        want[k] = curves.odd_ratio_mean(*map(np.array, zip(*mine)))
    for gathered in (100_000, 50):
        got = {r.k: (r.g, r.b) for r in robust.odd_ratio_mean(df, ["k"], "v", "e", name="g", error_name="b", gathered=gathered).collect()}
        assert got.keys() == want.keys()
        for k, (g, b) in want.items():
            if math.isnan(g):
                assert got[k] == (None, None)
            else:
                assert got[k] == pytest.approx((g, b), rel=1e-9)
    assert robust.odd_ratio_mean(df.limit(0), ["k"], "v", "e").count() == 0


SHARES = (0.0, 0.005, 0.16, 0.5, 0.84, 0.999, 1.0)


@pytest.mark.parametrize("gathered", [20_000, 40])
def test_exact_percentiles(spark, gathered):
    """Skewed, tied and far-flung groups; rounds go on until 40 values are left."""
    rng = np.random.default_rng(8)
    rows = [(k, float(v)) for k, n in ((0, 1), (1, 2), (2, 999), (3, 5000)) for v in rng.normal(size=n)] + [(4, float(i % 3)) for i in range(3000)] + [(None, 2.0)]
    rows += [(5, float(v)) for v in np.exp(rng.normal(0, 60, 3000))] + [(6, 7.5)] * 2500 + [(7, v) for v in [1.0] * 1500 + list(map(float, rng.normal(size=1500)))]
    df = spark.createDataFrame([(k, v, 1) for k, v in rows] + [(8, NAN, 1), (8, None, 1), (3, NAN, 1), (3, float("inf"), 1)], "v int, x double, p int")
    got = {r.v: r.q for r in robust.exact_percentiles(df, ["v"], "x", SHARES, name="q", gathered=gathered).collect()}
    assert got.keys() == {k for k, _ in rows}
    for k, q in got.items():
        assert q == pytest.approx(np.percentile([v for j, v in rows if j == k], [100 * s for s in SHARES]).tolist(), rel=1e-12)
    assert robust.exact_median(df.filter("v = 2"), ["v"], "x", gathered=gathered).columns == ["v", "median"]
    assert robust.exact_percentiles(df.limit(0), ["v"], "x", [0.5], gathered=gathered).collect() == []


@pytest.mark.parametrize("gathered", [20_000, 40])
def test_percentiles_with_infinities(spark, gathered):
    v = [-math.inf] * 300 + [float(i) for i in range(400)] + [math.inf] * 500
    df = spark.createDataFrame([(x,) for x in v], "x double").withColumn("k", F.lit(1))
    got = robust.exact_percentiles(df, ["k"], "x", [0.1, 0.5, 0.9, 1.0], infinite=True, gathered=gathered).first().p
    assert got == [-math.inf, 299.5, math.inf, math.inf]
    assert robust.exact_percentiles(df, ["k"], "x", [0.5], gathered=gathered).first().p == [199.5]


def test_several_pairs_about_their_median_both_ways(spark):
    rng = np.random.default_rng(3)
    rows = [(i % 3, float(rng.normal(5, 1)), 1.0 + i % 2, None if i % 7 == 0 else float(rng.normal()), NAN if i % 11 == 0 else 2.0) for i in range(900)] + [(9, None, 1.0, 4.0, None)]
    df = spark.createDataFrame(rows, "k int, a double, sa double, b double, sb double")
    pairs = [("a", "sa", "ma", "ea"), ("b", "sb", "mb", "eb")]
    for gathered in (100_000, 50):
        for about in (False, True):
            got = {r.k: r for r in robust.robust_means(df, ["k"], pairs, about_median=about, count_name="n", rows_name="m", gathered=gathered).collect()}
            assert got[9].ma is None and got[9].mb is None and got[9].m == 1
            for k in range(3):
                for i, (m, e) in enumerate((("ma", "ea"), ("mb", "eb"))):
                    v, s = (np.array([math.nan if r[c] is None else r[c] for r in rows if r[0] == k]) for c in (1 + 2 * i, 2 + 2 * i))
                    want = curves.odd_ratio_mean(v - (np.nanmedian(v) if about else 0), s)
                    assert (got[k][m], got[k][e]) == pytest.approx(want, rel=1e-9, abs=1e-12)
                assert got[k].m == 300


def test_outliers_do_not_move_the_mean():
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.normal(0, 1, 950), np.full(50, 50.0)])
    g, b = curves.odd_ratio_mean(v, np.ones(1000))
    assert abs(g) < 4 * b and abs(v.mean()) > 2


def test_range_join_equals_brute_force(spark):
    rng = random.Random(4)
    points = [(i, rng.choice([rng.uniform(-20, 50), float(rng.randint(0, 40)), None])) for i in range(300)]
    ranges = [(j, a, a + rng.choice([0.0, 0.5, 7.0, 30.0])) for j, a in enumerate(rng.uniform(-15, 40) if k % 2 else float(k) for k in range(40))]
    p, r = spark.createDataFrame(points, "i int, x double"), spark.createDataFrame(ranges, "j int, low double, high double")
    for closed in (False, True):
        want = sorted((i, j) for i, x in points for j, a, b in ranges if x is not None and (a <= x <= b if closed else a < x < b))
        got = sorted((q.i, q.j) for q in intervals.range_join(p, r, "x", "low", "high", width=3.0, closed=closed).collect())
        assert got == want


def test_first_match_and_segments(spark):
    df = spark.createDataFrame([("a", 3, "F", 1.0), ("a", 1, "O", 2.0), ("a", 2, "F", 3.0), (None, 1, "F", 4.0), ("b", 1, "O", 5.0)], "g string, t int, kind string, v double")
    got = {(r.g, r.t): r.ref for r in intervals.first_match(df, ["g"], F.col("kind") == "F", ["t"], {"v": "ref"}).collect()}
    assert got == {("a", 3): 3.0, ("a", 1): 3.0, ("a", 2): 3.0, (None, 1): 4.0, ("b", 1): None}
    cut = [(r.g, r.start, r.end) for r in intervals.consecutive(df, ["g"], "t").orderBy("g", "start").collect()]
    assert cut == [("a", 1, 2), ("a", 2, 3)]


@pytest.mark.parametrize("n", [1, 3, 5, 9])
def test_circular_sum(spark, n):
    v = [float(i * i) for i in range(n)]
    got = [r.box for r in sequences.circular_sum(spark.createDataFrame([(0, i, x) for i, x in enumerate(v)], "k int, i int, v double"), ["k"], "i", "v").orderBy("i").collect()]
    if n >= 5:
        assert got == pytest.approx([sum(v[(i + k) % n] for k in range(-2, 3)) for i in range(n)])
    assert len(got) == n


def test_box_medians_are_those_of_the_low_pass(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=130)
    v[20:60] = np.nan
    df = spark.createDataFrame([(0, i, None if np.isnan(x) else float(x), 130) for i, x in enumerate(v)], "k int, i int, v double, n int")
    got = [(r.centre, r.median) for r in sequences.box_medians(df, ["k"], "i", "v", width=41, length="n").orderBy("box").collect()]
    want = []
    for low in range(-41 // 2, 130 + 41 // 2, 41 // 4):
        part = np.arange(130)[max(low, 0) : min(low + 41, 129)]
        if len(part) >= 3 and np.isfinite(v[part]).sum() >= 3:
            want.append((part.mean(), np.nanmedian(v[part])))
    assert len(got) == len(want) and np.array(got) == pytest.approx(np.array(want))


@pytest.mark.parametrize("degree", [1, 2, 3, 5])
@pytest.mark.parametrize("n", [9, 300, 900, 5000])
def test_splines_reproduce_polynomials(degree, n):
    rng = np.random.default_rng(n)
    x, c = np.sort(rng.uniform(0, 10, n)), rng.normal(size=degree + 1)
    y = np.polyval(c, x)
    y[n // 2] = np.nan if n > 9 else y[n // 2]
    at = np.linspace(x[0], x[-1], 77)
    assert curves.Spline(x, y, degree)(at) == pytest.approx(np.polyval(c, at), rel=1e-8, abs=1e-8)
    assert np.isnan(curves.Spline(x[:degree], y[:degree], degree)(at)).all()


def test_filters_and_fits():
    x = np.arange(200.0)
    smooth = curves.savitzky_golay(3 + 0.5 * x + 0.01 * x**2, 7, 3, 1, 2.0)
    assert smooth[40:160] == pytest.approx((0.5 + 0.02 * x[40:160]) / 2)
    gaps = np.where((x > 50) & (x < 120), np.nan, 1.0)
    assert np.isnan(curves.savitzky_golay(gaps, 7)[80]) and curves.low_pass(gaps, 101)[80] == pytest.approx(1.0)
    y = 2 * x + 1
    y[::20] += 500
    assert curves.robust_polynomial(x, y + np.random.default_rng(0).normal(0, 0.1, 200), 1, 5)[0] == pytest.approx([2, 1], abs=0.1)
    model = lambda x, a, m, s, z: a * np.exp(-0.5 * ((x - m) / s) ** 2) + z
    p, _ = curves.least_squares(model, x, model(x, 4, 90, 12, 1), [3, 80, 8, 0])
    assert np.abs(p) == pytest.approx([4, 90, 12, 1], rel=1e-5)
    assert curves.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05) and curves.chi2_tail(50, 30) == pytest.approx(0.012402, rel=1e-4)
    assert curves.correlation_p(0.5, 20) == pytest.approx(0.024769, rel=1e-4)


def test_array_operators_pass_nulls(spark):
    df = spark.createDataFrame([([1.0, None, 3.0, 4.0, 5.0, 6.0], None), (None, 1.0)], "y array<double>, z double")
    x = F.array(*(F.lit(float(i)) for i in range(6)))
    got = [r[0] for r in df.select(spectra.spline_at(x, F.col("y"), F.array(F.lit(1.0)))).collect()]
    assert got == [pytest.approx([2.0]), None]


def test_known_velocities_are_recovered(spark):
    template = synthetic_template(lines=30)
    rows = []
    for k, v in enumerate((0.0, 50.0, -1500.0)):
        shift = np.sqrt((1 - v / spectral.SPEED_OF_LIGHT) / (1 + v / spectral.SPEED_OF_LIGHT))
        flux = curves.Spline(template.wave, template.flux, 3, "constant")(template.wave * shift) + np.random.default_rng(k).normal(0, 0.002, len(template.wave))
        rows.append((v, template.wave.tolist(), flux.tolist()))
    made = spark.createDataFrame(rows, "known double, wave array<double>, flux array<double>")
    found = velocity.line_velocities(made, template, keys=["known"])
    for r in robust.odd_ratio_mean(found, ["known"], "dv", "sdv").collect():
        assert abs(r.mean - r.known) < 4 * r.mean_err


def test_day_counts(spark):
    row = spark.range(1).select(times.local_night(F.lit(59000.5), 0.0).alias("a"), times.local_night(F.lit(59001.5), 0.0).alias("b"), times.metres_per_second(F.lit("-12.5 m/s")).alias("v"), times.metres_per_second(F.lit("x")).alias("n")).first()
    assert tuple(row) == (59000.0, 59002.0, -12.5, None)
    assert [b[0] for b in spectral.uniform_bins(900, 1950, 25)][::24] == ["914nm", "1920nm"]


def test_air_exponents_are_found(spark):
    air = synthetic_air()
    made = synthetic_absorbed(spark, air, [(0.5, 1.0), (2.0, 1.4)])
    for r in telluric.correct_tellurics(made, air, keys=["exposure", "water", "others"]).collect():
        assert r.exponent_water == pytest.approx(r.water, abs=0.05) and r.exponent_others == pytest.approx(r.others, abs=0.05)
        clean = np.array(r.flux_tc, float)
        assert np.nanstd(clean / curves.low_pass(clean, 201)) < 0.02
    k = telluric.rotation_kernel(100.0, 5000.0)
    assert k.sum() == pytest.approx(1) and k[0] < k[len(k) // 2] and telluric.rotated(np.ones(300), 100.0, 5000.0) == pytest.approx(1)


def test_one_dimensional_spectra_and_templates(spark):
    from lumenrv.plans.orders import template_from_exposures

    rows = template_from_exposures(spark, "/root/testdata/sf0.001").filter("flux is not null").collect()
    assert len(rows) > 1800
    at = np.array([1500 * math.exp(r.i * 500 / spectral.SPEED_OF_LIGHT) for r in rows])
    want = 1 - 0.4 * np.exp(-0.5 * ((at - 1501.5) / 0.05) ** 2)
    assert np.array([r.flux for r in rows]) == pytest.approx(want, abs=1e-4)


def test_headers_and_parameters(spark):
    df = spark.createDataFrame([({"A": "1.5", "AB1": "x", "B": "\u00e9" * 3, "LONG": "y" * 80},)], "h map<string,string>")
    h = F.col("h")
    row = df.select(headers.value_of(h, ["Z", "A"], "double").alias("a"), headers.matching(h, "A?1").alias("m"), headers.translated(h, {"A": "KW_A"}, {"B": "c"}).alias("t"), headers.ascii_header(h, ["AB1"]).alias("s")).first()
    assert (row.a, row.m, row.t["KW_A"], row.t["B"], row.s) == (1.5, {"AB1": "x"}, "1.5", "c", {"A": "1.5", "B": ""})
    with pytest.raises(Exception, match="no key of"):
        df.select(headers.value_of(h, ["Q"], required=True)).collect()
    found = instruments.parameters(("file", {"N_ITERATIONS": 5, "OWN": 1}), ("call", {"N_ITERATIONS": 7}))
    assert found["N_ITERATIONS"][:2] == (7, "call") and found["OWN"][1] == "file" and found["SNR_THRES"][1] == "default"
    assert instruments.parameter_table(spark, found).count() == len(found)


def test_monotone_orders(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([3.0, 2.0],), ([1.0, 3.0, 2.0],)], "w array<double>")
    assert [r[0] for r in df.select(orders.is_monotone(F.col("w"))).collect()] == [True, True, False]
