"""The data source, table functions and aggregates for SQL."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumenrv.functions.register import register
from lumenrv.operators import sequences
from lumenrv.sources import fits_source, tables


@pytest.fixture
def archive(spark, tmp_path):
    rows = [(f"night{k % 2}/{k}.fits", {"OBJECT": "star" if k % 3 else "lamp", "MJD": str(60000 + k), "LONG": "x"}, [[float(k * 1000 + r * 10 + c) for c in range(400)] for r in range(5)]) for k in range(6)]
    df = spark.createDataFrame(rows, "name string, header map<string,string>, pixels array<array<double>>")
    sizes = {r.name: r.bytes for r in tables.write_images(df, f"file://{tmp_path}/in").collect()}
    return f"file://{tmp_path}/in", sizes


def cost(path, schema, filters=(), keys="OBJECT,MJD"):
    """Rows and bytes that a reader needs, in this process."""
    source = fits_source.FitsDataSource({"path": path, "keys": keys, "slices": "2"})
    reader = source.reader(StructType.fromDDL(schema))
    left = list(reader.pushFilters(list(filters)))
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    return rows, reader.bytes_read, left


def test_headers_cost_their_blocks_only(archive):
    path, sizes = archive
    D = fits_source.D
    heads, small, _ = cost(path, "path string, name string, OBJECT string")
    assert len(heads) == 12 and small == 12 * 2880
    every, large, _ = cost(path, "OBJECT string, row int, pixels array<double>")
    assert len(every) == 30 and large == 12 * 2880 + 6 * 5 * 400 * 8
    lamps, part, left = cost(path, "OBJECT string, row int, pixels array<double>", [D.EqualTo(("OBJECT",), "lamp")])
    assert len(lamps) == 10 and part == 12 * 2880 + 2 * 5 * 400 * 8 and left == []
    few, least, _ = cost(path, "path string, row int, pixels array<double>", [D.StringContains(("path",), "night1"), D.In(("row",), (0, 4))])
    assert len(few) == 6 and least == 3 * (2 * 2880 + 2 * 400 * 8)
    other = D.EqualTo(("header", "OBJECT"), "lamp")
    assert cost(path, "path string", [other])[2] == [other]
    assert cost(path, "path string, unit int", [D.GreaterThan(("unit",), 7)])[0] == []


def test_filters_reach_the_files_through_spark(spark, archive):
    path, _ = archive
    df = fits_source.load_fits(spark, path, keys=["OBJECT", "MJD"])
    assert df.columns == ["path", "unit", "name", "header", "OBJECT", "MJD", "row", "pixels"]
    got = df.filter("OBJECT = 'star' and row = 2 and path like '%night1%'").select("MJD", "pixels", "name", F.col("header")["LONG"].alias("l")).orderBy("MJD").collect()
    assert [(r.MJD, r.pixels[:2], len(r.pixels), r.name, r.l) for r in got] == [(str(60000 + k), [k * 1000 + 20.0, k * 1000 + 21.0], 400, "IMAGE", "x") for k in (1, 5)]
    heads = fits_source.load_fits(spark, path, keys=["OBJECT"], columns=["path", "unit", "OBJECT"])
    assert heads.count() == 12 and heads.filter("OBJECT is not null").count() == 6
    assert fits_source.load_fits(spark, path, glob="none*.fits", columns=["path"]).collect() == []


def test_find_lines_in_sql_equals_the_operator(spark):
    rng = np.random.default_rng(1)
    rows = [(k, i, 500.0 + i, None if rng.random() < 0.05 else float(rng.integers(0, 4))) for k in (1, 2, None) for i in range(200)] + [(3, 0, 1.0, 1.0), (4, 0, 1.0, 1.0), (4, 1, 2.0, 2.0), (5, 0, 1.0, 1.0), (5, 1, 2.0, 5.0), (5, 2, 3.0, 2.0)]
    df = spark.createDataFrame(rows, "k int, i int, wave double, flux double").repartition(3)
    register(spark)
    got = spark.sql("SELECT * FROM find_lines(TABLE({t}), 'k', 'i', 'wave', 'flux')", t=df)
    assert got.columns == ["k", "i", "kind", "crossing", "depth"]
    laid = df.withColumn("slope", sequences.gradient(F.col("flux"), sequences.along(["k"], "i")))
    want = sequences.zero_crossings(laid, ["k"], "i", "wave", "slope", "flux").select("k", "i", "kind", "crossing", "depth")
    key = lambda r: (str(r.k), r.i)
    for a, b in zip(sorted(got.collect(), key=key), sorted(want.collect(), key=key), strict=True):
        assert tuple(a)[:3] == tuple(b)[:3] and (a.crossing, a.depth) == (pytest.approx(b.crossing), pytest.approx(b.depth))


def test_aggregates_and_several_keys_in_sql(spark):
    register(spark)
    df = spark.createDataFrame([("a", "x", i, float(i), float((i * 7) % 5), 1.0 + i % 2) for i in range(50)] + [("b", "x", 0, 0.0, float("nan"), None)], "g string, h string, i int, w double, v double, e double")
    rows = spark.sql("SELECT g, robust_mean(v, e) AS m, robust_mean_error(v, e) AS s FROM {t} GROUP BY g", t=df).collect()
    got = {r.g: (r.m, r.s) for r in rows}
    assert got["a"][0] == pytest.approx(2, abs=0.3) and all(x is None or math.isnan(x) for x in got["b"])
    lines = spark.sql("SELECT * FROM find_lines(TABLE({t}), 'g, h', 'i', 'w', 'v')", t=df)
    assert lines.columns[:3] == ["g", "h", "i"] and lines.count() > 10


def test_binary_tables_there_and_back(spark, tmp_path):
    from lumenrv.sources import fits

    rows = [("a.fits", 1, 2.5, "x", True, 7), ("a.fits", 2, None, None, None, None), ("b.fits", 3, float("nan"), "longer é", False, 9), (None, 4, 1.0, "lost", True, 1)]
    df = spark.createDataFrame(rows, "file string, n int, v double, s string, ok boolean, big long")
    sizes = {r.name: r.bytes for r in tables.write_tables(df, f"file://{tmp_path}/t", "file", header={"OBJECT": "star"}).collect()}
    assert sorted(sizes) == ["a.fits", "b.fits"] and all(v % 2880 == 0 for v in sizes.values())
    back = fits.read_tables(spark, f"{tmp_path}/t", "n int, v double, s string, ok boolean, big long").orderBy("n").collect()
    none = lambda x: None if x is None or math.isnan(x) else x
    assert [(r.n, none(r.v), r.s, r.ok, r.big) for r in back] == [(1, 2.5, "x", True, 7), (2, None, "", False, 0), (3, None, "longer", False, 9)]
    assert fits.read_headers(spark, f"{tmp_path}/t").filter("unit = 1").first().header["OBJECT"] == "star"
    with pytest.raises(TypeError):
        tables.write_tables(df.withColumn("x", F.array("n")), "file:///tmp/none", "file")


def test_line_tables_have_all_columns(spark, tmp_path):
    names = [c.split()[0] for c in tables.FULL_REFERENCE.split(", ")]
    assert len(names) == 15
    row = tuple(k if c.endswith(" int") else None if k == 6 else k + 0.5 for k, c in enumerate(tables.FULL_REFERENCE.split(", ")))
    tables.write_reference(spark.createDataFrame([row], tables.FULL_REFERENCE), f"file://{tmp_path}/r", tables.FULL_REFERENCE)
    assert tuple(tables.read_reference(spark, f"file://{tmp_path}/r", tables.FULL_REFERENCE).first()) == row


def test_finished_templates(spark):
    from lumenrv.kernels import curves
    from lumenrv.plans import catalog

    before = {}
    for r in catalog.queries()["template_median"](spark, "/root/testdata/sf0.001").collect():
        before.setdefault(r.ord, {})[r.pixel] = (math.nan if r.flux is None else r.flux, math.nan if r.rms is None else r.rms)
    got = catalog.queries()["template_finish"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == sum(map(len, before.values()))
    nan = lambda v: math.nan if v is None else v
    some = {o: {r.pixel: r for r in got if r.ord == o} for o in list(before)[:3]}
    for o, rows in some.items():
        flux, rms = np.array([before[o][i] for i in range(64)]).T
        snr = curves.low_pass(flux / rms, 21)
        kept = np.where(snr >= 10, flux, np.nan)
        assert [nan(rows[i].flux) for i in range(64)] == pytest.approx(kept.tolist(), nan_ok=True)
        window = round(299792458.0 / 500 / 80_000)
        for n in range(4):
            want = curves.savitzky_golay(kept, window + 1 - window % 2, derivative=n)
            assert [nan(rows[i][f"flux_savgol_d{n}"]) for i in range(64)] == pytest.approx(want.tolist(), nan_ok=True, abs=1e-9)


def test_bands_of_instruments():
    from lumenrv.plans import instruments

    by = {(i.name, i.source): i for i in instruments.INSTRUMENTS}
    assert list(instruments.bands_of(by["SPIROU", "CADC"]))[:8] == ["Y", "gapYJ", "J", "gapJH", "H", "gapHK", "K", "redK"]
    assert [b for b in instruments.bands_of(by["HARPS", "ESO"]) if not b.endswith("nm")] == ["g"]
    assert [b for b in instruments.bands_of(by["NIRPS_HE", "APERO"]) if not b.endswith("nm")] == ["h"]
    assert [b for b in instruments.bands_of(by["MAROONX", "BLUE"]) if not b.endswith("nm")] == ["u", "g", "r"]
    assert "_1532-2556" in instruments.regions_of(by["NIRPS_HA", "ESO"]) and instruments.regions_of(by["MAROONX", "RED"])["_2018-4036"] == (2018, 4096)


def test_parameters_of_files_and_command_lines():
    from lumenrv.plans import instruments

    text = "# a run\n---\nN_ITERATIONS: 7 # fewer\nOBJECTS:\n  - 'GL 699'\n  - PROXIMA\nDO_TELLUCLEAN: true\nMJD_START: None\nNAME: some text: with colon\nSTEP: 2.5e2\nEMPTY:\n"
    found = instruments.parameters_from_file(text)
    assert found == {"N_ITERATIONS": 7, "OBJECTS": ["GL 699", "PROXIMA"], "DO_TELLUCLEAN": True, "MJD_START": None, "NAME": "some text: with colon", "STEP": 250.0, "EMPTY": None}
    line = instruments.parameters_from_arguments(["--n-iterations=3", "--plot", "--name", "x y", "--list=[1, 2]"])
    assert line == {"N_ITERATIONS": 3, "PLOT": True, "NAME": "x y", "LIST": [1, 2]}
    both = instruments.parameters(("file", found), ("call", {"N_ITERATIONS": 5, "STEP": 1}), ("command line", line))
    assert both["N_ITERATIONS"][:2] == (3, "command line") and both["STEP"][:2] == (1, "call") and both["OBJECTS"][1] == "file" and both["CUT_PEARSONR"][:2] == (-1, "default")
    for bad in ("- x", "  key: 1", "no colon"):
        with pytest.raises(ValueError):
            instruments.parameters_from_file(bad)
    with pytest.raises(ValueError):
        instruments.parameters_from_arguments(["stray"])
